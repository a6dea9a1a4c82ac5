"""SQL restatements of the catalogue's queries, written for an independent engine."""

from __future__ import annotations

from parlance.functions import lexicon as lx
from parlance.operators import annotate as an

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

RATIO = r"""CASE WHEN length(regexp_replace(text, '\P{L}+', '', 'g')) > 0
    THEN length(regexp_replace(text, '\P{Lu}+', '', 'g'))::DOUBLE / length(regexp_replace(text, '\P{L}+', '', 'g'))
    ELSE 0.0::DOUBLE END"""

RATED = f"rated AS (SELECT *, {RATIO} AS ratio FROM documents)"
CURVE = f"""{RATED},
levels AS (SELECT unnest(range(10, 101, 10)) / 100.0::DOUBLE AS threshold),
totals AS (SELECT count(*) AS total FROM rated),
points AS (SELECT threshold, count(*) FILTER (ratio >= threshold) AS n FROM levels CROSS JOIN rated GROUP BY threshold),
curve AS (SELECT threshold, n, CASE WHEN total > 0 THEN n / total * 100 ELSE 0 END::DOUBLE AS pct,
                 lag(n) OVER (ORDER BY threshold) - n AS "drop" FROM points, totals)"""
ZONES = f"""{CURVE},
steps AS (SELECT threshold, "drop", lag(threshold) OVER (ORDER BY threshold) AS before FROM curve),
med AS (SELECT list_sort(list("drop"))[len(list("drop")) // 2 + 1] AS m FROM steps WHERE "drop" IS NOT NULL),
zones AS (SELECT 0.1::DOUBLE AS seuil_min,
    (SELECT min(before) FROM steps, med WHERE "drop" <= m) AS seuil_max,
    (SELECT max(threshold) FROM steps, med WHERE "drop" <= m) AS seuil_nettoyage)"""

GUESS = """CASE WHEN text LIKE '% der %' THEN 'de' WHEN text LIKE '% the %' THEN 'en'
    WHEN text LIKE '% que %' THEN 'fr' ELSE 'es' END"""
PRED = f"pred AS (SELECT doc_id, lang AS t, {GUESS} AS p FROM documents)"
CLASSES = f"""{PRED},
names AS (SELECT t AS langue FROM pred UNION SELECT p FROM pred),
tallies AS (SELECT langue, (SELECT count(*) FROM pred WHERE t = langue AND p = langue) AS tp,
    (SELECT count(*) FROM pred WHERE t = langue) AS support,
    (SELECT count(*) FROM pred WHERE p = langue) AS guessed FROM names),
classes AS (SELECT langue, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
    CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END AS f1, support FROM tallies)"""

ORDER_KEY = "md5('42:' || doc_id::VARCHAR) || ':' || doc_id::VARCHAR"
SPLIT = f"""sizes AS (SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY lang),
shares AS (SELECT *, total - ceil(total * 0.2::DOUBLE)::BIGINT AS total_train FROM sizes),
floors AS (SELECT *, n / total * total_train AS share, floor(n / total * total_train)::BIGINT AS base FROM shares),
tops AS (SELECT *, row_number() OVER (ORDER BY share - base DESC, lang) AS pos,
    total_train - sum(base) OVER () AS missing FROM floors),
quota AS (SELECT lang, n, (base + CASE WHEN pos <= missing THEN 1 ELSE 0 END)::BIGINT AS n_train FROM tops),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {ORDER_KEY}) AS rk FROM documents),
split AS (SELECT ranked.*, rk <= n - n_train AS is_test FROM ranked JOIN quota USING (lang))"""


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def connector_count(text: str) -> str:
    """Every non-word character doubled, so that neighbours never share a boundary."""
    doubled = f"regexp_replace(lower({text}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    parts = []
    for phrase in lx.CONNECTORS:
        twice = "".join(c if c.isalnum() else c * 2 for c in phrase).replace("'", "''")
        parts.append(f"len(regexp_extract_all({doubled}, '(?:^|[^\\p{{L}}\\p{{N}}_]){twice}(?:[^\\p{{L}}\\p{{N}}_]|$)'))")
    return " + ".join(parts)


_BE = quoted(an.LITE_AUX_BE)
TOKENS = rf"""
sents AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS k
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{an.LITE_SENTENCE}') AS l FROM documents)),
lists AS (SELECT doc_id, k, regexp_extract_all(s, '{an.LITE_TOKEN}') AS l FROM sents),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent, l FROM lists WHERE len(l) > 0),
raw AS (SELECT doc_id, sent, unnest(l) AS text, unnest(range(len(l))) AS j, len(l) AS width FROM kept),
tagged AS (SELECT *, lower(text) AS low, CASE
    WHEN starts_with(text, chr(10)) THEN 'SPACE'
    WHEN lower(text) IN ({quoted(an.LITE_AUX_BE + an.LITE_AUX_HAVE[1:])}) THEN 'AUX'
    WHEN lower(text) IN ({quoted(an.LITE_DET)}) THEN 'DET'
    WHEN lower(text) IN ({quoted(an.LITE_ADP)}) THEN 'ADP'
    WHEN lower(text) IN ({quoted(an.LITE_PRON)}) THEN 'PRON'
    WHEN lower(text) IN ({quoted(an.LITE_SCONJ)}) THEN 'SCONJ'
    WHEN regexp_matches(lower(text), '^\p{{N}}') THEN 'NUM'
    WHEN NOT regexp_matches(lower(text), '^[\p{{L}}\p{{M}}]') THEN 'PUNCT'
    WHEN regexp_matches(lower(text), '{an.LITE_ADJ_SUFFIX}') THEN 'ADJ'
    WHEN regexp_matches(lower(text), '{an.LITE_VERB_SUFFIX}') THEN 'VERB'
    WHEN regexp_matches(text, '^\p{{Lu}}\p{{Lu}}') THEN 'PROPN'
    ELSE 'NOUN' END AS pos FROM raw),
rooted AS (SELECT *, coalesce(min(j) FILTER (pos = 'VERB') OVER sentence, 0) AS root,
    bool_or(low IN ({_BE})) OVER sentence AS passive,
    row_number() OVER (PARTITION BY doc_id ORDER BY sent, j) - 1 AS i
    FROM tagged WINDOW sentence AS (PARTITION BY doc_id, sent)),
headed AS (SELECT *, CASE WHEN j = root THEN j
    WHEN pos IN ('DET', 'ADP', 'ADJ', 'SCONJ', 'AUX') AND j + 1 < width THEN j + 1 ELSE root END AS head_j,
    max(CASE WHEN j = root THEN pos END) OVER (PARTITION BY doc_id, sent) AS root_pos FROM rooted),
tok AS (SELECT doc_id, sent, i, j, text, low, pos, i - j + head_j AS head,
    CASE WHEN low IN ({_BE}) THEN 'être' ELSE low END AS lemma,
    CASE WHEN pos = 'NOUN' AND low LIKE '%s' THEN 'NOUN__Number=Plur' ELSE pos END AS tag,
    CASE WHEN j = root THEN 'ROOT'
        WHEN pos IN ('NOUN', 'PRON', 'PROPN') AND head_j = root AND root_pos = 'VERB'
            THEN CASE WHEN j > root OR (pos = 'PRON' AND j = root - 1) THEN 'obj'
                      WHEN passive THEN 'nsubj:pass' ELSE 'nsubj' END
        WHEN pos = 'DET' THEN 'det' WHEN pos = 'ADP' THEN 'case' WHEN pos = 'ADJ' THEN 'amod'
        WHEN pos = 'SCONJ' THEN 'mark'
        WHEN pos = 'AUX' AND passive AND head_j < j THEN 'auxpass' WHEN pos = 'AUX' THEN 'aux'
        WHEN pos = 'PUNCT' THEN 'punct' ELSE 'dep' END AS dep,
    CASE WHEN pos = 'VERB' AND low LIKE '%ed' THEN 'Part'
        WHEN pos = 'VERB' AND regexp_matches(low, '(er|ir|ar)$') THEN 'Inf'
        WHEN pos IN ('VERB', 'AUX') THEN 'Fin' END AS form,
    CASE WHEN pos = 'VERB' AND low LIKE '%ed' THEN 'Past'
        WHEN pos = 'VERB' AND regexp_matches(low, '(er|ir|ar)$') THEN NULL
        WHEN pos = 'VERB' AND low LIKE '%ing' THEN 'Pres'
        WHEN pos = 'VERB' AND low LIKE '%ent' THEN 'Imp'
        WHEN pos = 'VERB' AND low LIKE '%ez' THEN 'Fut'
        WHEN pos IN ('VERB', 'AUX') THEN 'Pres' END AS tense,
    pos <> 'SPACE' AND regexp_matches(text, '^\p{{L}}+$') AS alpha,
    -- steps to the next token that attaches to the root, then one more unless that is the root
    min(CASE WHEN NOT (j <> root AND head_j = j + 1 AND pos IN ('DET', 'ADP', 'ADJ', 'SCONJ', 'AUX')) THEN j END)
        OVER (PARTITION BY doc_id, sent ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop,
    root FROM headed)"""

MEASURES = rf"""{TOKENS},
basics AS (SELECT doc_id,
    count(*) FILTER (pos <> 'SPACE') AS visible,
    count(DISTINCT sent) AS sents,
    count(*) FILTER (pos <> 'SPACE' AND instr('{lx.PUNCTUATION}', text) > 0) AS puncts,
    count(*) FILTER (alpha) AS alphas,
    coalesce(sum(greatest(1, len(regexp_extract_all(low, '[{lx.SYLLABLE_VOWELS}]+')))) FILTER (alpha), 0) AS syll,
    coalesce(avg(stop - j + CASE WHEN stop = root THEN 0 ELSE 1 END) FILTER (pos IN ('NOUN', 'VERB', 'ADJ')), 0) AS deep,
    count(*) FILTER (pos = 'SCONJ') AS sconj, count(*) FILTER (pos = 'ADP') AS adp,
    count(*) FILTER (pos = 'DET') AS det, count(*) FILTER (pos = 'NOUN') AS noun,
    count(*) FILTER (pos = 'VERB') AS verb, count(*) FILTER (dep = 'auxpass') AS auxpass,
    count(*) FILTER (dep = 'nsubj' AND low IN ({quoted(lx.SUBJECT_PRONOUNS)})) AS pron,
    count(*) FILTER (form = 'Fin') AS fin,
    count(*) FILTER (form = 'Fin' AND tense = 'Pres') AS pres,
    count(*) FILTER (form = 'Fin' AND tense = 'Fut') AS fut,
    count(*) FILTER (form = 'Fin' AND tense IN ('Past', 'Imp')) AS past,
    coalesce(avg(i) FILTER (dep = 'nsubj'), 0) AS subj_mean, coalesce(avg(i) FILTER (pos = 'VERB'), 0) AS verb_mean,
    coalesce(avg(i) FILTER (dep = 'obj'), 0) AS obj_mean,
    count(*) FILTER (tag = 'NOUN__Number=Plur') AS plur FROM tok GROUP BY doc_id),
firsts AS (SELECT doc_id, count(*) FILTER (inner_up AND pos <> 'PROPN') AS caps FROM (
    SELECT doc_id, pos, regexp_matches(text, '^\p{{Lu}}')
        AND row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) > 1 AS inner_up FROM tok WHERE pos <> 'SPACE')
    GROUP BY doc_id),
kids AS (SELECT c.doc_id, c.head, min(c.i) FILTER (c.dep = 'nsubj') AS s, min(c.i) FILTER (c.dep = 'obj') AS o,
    min(c.i) FILTER (c.dep IN ('nsubj', 'nsubj:pass')) AS a
    FROM tok c JOIN tok h ON c.doc_id = h.doc_id AND c.head = h.i WHERE c.i <> c.head AND h.pos = 'VERB'
    GROUP BY c.doc_id, c.head),
orders AS (SELECT doc_id, avg(abs(head - a)) AS dist,
    avg(CASE WHEN s IS NOT NULL AND o IS NOT NULL THEN CASE WHEN o < head THEN 1 WHEN s > head THEN -1 ELSE 0 END END) AS sov
    FROM kids GROUP BY doc_id),
voice AS (SELECT t.doc_id, count(*) AS n FROM tok t
    WHERE t.pos = 'AUX' AND t.dep <> 'auxpass' AND t.lemma = 'être' AND EXISTS (
        SELECT 1 FROM tok c WHERE c.doc_id = t.doc_id AND c.head = t.head AND c.i <> c.head AND c.dep = 'nsubj:pass')
    GROUP BY t.doc_id),
comp AS (SELECT c.doc_id, count(DISTINCT c.head) AS n FROM tok c JOIN tok h ON c.doc_id = h.doc_id AND c.head = h.i
    WHERE c.i <> c.head AND c.pos = 'VERB' AND c.form = 'Part' AND h.pos = 'AUX' AND h.form = 'Fin' GROUP BY c.doc_id),
comp_below AS (SELECT c.doc_id, count(DISTINCT c.head) AS n FROM tok c JOIN tok h ON c.doc_id = h.doc_id AND c.head = h.i
    WHERE c.i <> c.head AND c.pos = 'AUX' AND c.form = 'Fin' AND h.pos = 'VERB' AND h.form = 'Part' GROUP BY c.doc_id),
voice_ud AS (SELECT t.doc_id, count(*) FILTER (t.dep IN ('auxpass', 'aux:pass') OR (t.pos = 'AUX' AND t.lemma = 'être' AND EXISTS (
        SELECT 1 FROM tok c WHERE c.doc_id = t.doc_id AND c.head = t.head AND c.i <> c.head AND c.dep = 'nsubj:pass'))) AS n FROM tok t
    WHERE t.pos <> 'SPACE' GROUP BY t.doc_id),
plurals AS (SELECT doc_id, count(*) AS n FROM tok WHERE pos = 'NOUN' AND low LIKE '%s' GROUP BY doc_id),
lemmas AS (SELECT doc_id, count(*) FILTER (m >= 2) / count(*) AS rep FROM (
    SELECT doc_id, lower(lemma) AS lem, count(*) AS m FROM tok WHERE pos = 'NOUN' GROUP BY ALL) GROUP BY doc_id),
conn AS (SELECT doc_id, {connector_count('text')} AS n FROM documents),
joined AS (SELECT d.doc_id, greatest(1, coalesce(visible, 0)) AS n, greatest(1, coalesce(sents, 0)) AS s,
    greatest(1, coalesce(alphas, 0)) AS w, coalesce(b.visible, 0) AS visible, coalesce(sents, 0) AS sents,
    coalesce(puncts, 0) AS puncts, coalesce(syll, 0) AS syll, coalesce(deep, 0) AS deep, coalesce(sconj, 0) AS sconj,
    coalesce(adp, 0) AS adp, coalesce(det, 0) AS det, coalesce(noun, 0) AS noun, coalesce(verb, 0) AS verb,
    coalesce(auxpass, 0) AS auxpass, coalesce(pron, 0) AS pron, greatest(1, coalesce(fin, 0)) AS fin,
    coalesce(pres, 0) AS pres, coalesce(fut, 0) AS fut, coalesce(past, 0) AS past, coalesce(subj_mean, 0) AS subj_mean,
    coalesce(verb_mean, 0) AS verb_mean, coalesce(obj_mean, 0) AS obj_mean, coalesce(plur, 0) AS plur,
    coalesce(caps, 0) AS caps, coalesce(dist, 0) AS dist, coalesce(sov, 0) AS sov, coalesce(voice.n, 0) AS voiced,
    coalesce(comp.n, 0) AS composed, coalesce(comp_below.n, 0) AS composed_below, coalesce(voice_ud.n, 0) AS voiced_ud, coalesce(plurals.n, 0) AS plurals, coalesce(rep, 0) AS rep, conn.n AS conns
    FROM documents d LEFT JOIN basics b USING (doc_id) LEFT JOIN firsts USING (doc_id) LEFT JOIN orders USING (doc_id)
    LEFT JOIN voice USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN lemmas USING (doc_id)
    LEFT JOIN conn USING (doc_id) LEFT JOIN comp_below USING (doc_id) LEFT JOIN voice_ud USING (doc_id) LEFT JOIN plurals USING (doc_id))"""

MEASURE_SQL = {
    "punct_ratio": "puncts / n",
    "flesch": "206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (syll / w)",
    "sentence_length": "CASE WHEN sents = 0 THEN 0 ELSE visible / sents END",
    "complexity": "deep + sconj / s",
    "adposition_ratio": "adp / n",
    "noun_repetition": "rep",
    "connector_ratio": "conns / n",
    "determiner_ratio": "det / greatest(1, noun)",
    "capital_ratio": "caps / n",
    "object_order": "sov",
    "verb_noun_ratio": "verb / greatest(1, noun)",
    "passive_ratio": "(auxpass + voiced) / s",
    "verb_subject_distance": "dist",
    "subject_pronoun_ratio": "pron / fin",
    "subject_mean": "subj_mean",
    "verb_mean": "verb_mean",
    "object_mean": "obj_mean",
    "determiner_ratio_all": "det / greatest(1, noun)",
    "plural_count": "plur",
    "corrected_passive": "voiced_ud / s",
    "corrected_plural": "plurals",
    "corrected_composed": "composed_below / fin",
    "present_ratio": "pres / fin",
    "future_ratio": "fut / fin",
    "past_ratio": "past / fin",
    "composed_ratio": "composed / fin",
}


def measures(columns: dict[str, str]) -> str:
    """Query giving ``doc_id`` and each column from its measure, rounded."""
    picked = ", ".join(f"round(({MEASURE_SQL[m]})::DOUBLE, 6) AS {c}" for c, m in columns.items())
    return f"WITH {MEASURES} SELECT doc_id, {picked} FROM joined"


WORDS = rf"""words AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS spot
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}{{2,}}') AS l FROM documents))"""
WORD_COUNTS = f"""{WORDS},
grams AS (SELECT doc_id, w AS term FROM words UNION ALL
    SELECT doc_id, term FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY spot) AS term FROM words)
    WHERE term IS NOT NULL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)"""


def char_counts(low: int, high: int) -> str:
    chars = rf"""chars AS (SELECT doc_id, unnest(l) AS c, unnest(range(len(l))) AS spot FROM (
        SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '{SPACE}{{2,}}', ' ', 'g'), '(?s).') AS l
        FROM documents))"""
    steps = [f"lead(c, {k}) OVER one AS c{k}" for k in range(1, high)]
    grams = [
        f"SELECT doc_id, {' || '.join(['c'] + [f'c{k}' for k in range(1, n)])} AS term FROM runs"
        for n in range(low, high + 1)
    ]
    return f"""{chars},
    runs AS (SELECT doc_id, c, {', '.join(steps)} FROM chars WINDOW one AS (PARTITION BY doc_id ORDER BY spot)),
    grams AS ({' UNION ALL '.join(grams)}),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM grams WHERE term IS NOT NULL GROUP BY ALL)"""


STATS = "stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term)"
IDF = "ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1"


def sequence_counts(column: str) -> str:
    return rf"""{TOKENS},
    seqs AS (SELECT doc_id, string_agg({column}, ' ' ORDER BY i) AS seq FROM tok GROUP BY doc_id),
    terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(seq), '{WORD}{{2,}}')) AS term FROM seqs),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)"""


def vocabulary(counts: str, top: int) -> str:
    return f"""WITH {counts}, {STATS}
    SELECT term, tf, df, round({IDF}, 6) AS idf FROM stats ORDER BY tf DESC, term LIMIT {top}"""


def weights(counts: str, tf: str, chosen: str) -> str:
    return f"""WITH {counts}, {STATS}, chosen AS ({chosen}),
    weighed AS (SELECT doc_id, term, {tf} * ({IDF}) AS w FROM counts JOIN chosen USING (term)),
    unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM weighed)"""
