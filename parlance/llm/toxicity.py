"""Toxicity by a linear classifier that is regularised with counterfactuals.

Features are presences: the words of a text and their beginnings of three to six bytes, so that
inflected forms share evidence. The fit takes at most about ``max_fit_rows`` labelled rows, picked
by a hash of the id, and keeps the ``FEATURES`` features that tell the classes apart best. In every labelled
text that names a group, the group term is swapped for others of its set; the fit adds the squared
change of the margin under each swap to the loss. So a mere mention of a group can move a score
only as far as the loss gains more from it than the penalty takes.

Nulls: a null text is an empty one and is scored; null labels or ids are not learned; several
labels of one id count as toxic if one is. Repeated rows are scored each; with no labelled rows
of both classes all scores are the share of toxic rows (0 with no rows); empty tables give empty
tables; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import common

MAX_FIT_ROWS = 20_000
FEATURES = 4_096
MIN_ROWS = 3  # rows that a feature must be in
MIN_CHI = 4.0  # and how far its presence must differ between the classes, where chance gives about one
PREFIXES = (3, 4, 5, 6)
LAMBDA = 4.0  # weight of the counterfactual penalty
RIDGE = 2e-4
STEPS = 400

#: Group terms; a swap stays within a line, so it never changes the kind of group.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)


def word_features(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the word that each belongs to."""
    lengths = words.end - words.start
    features, owners = [words.hashes()], [np.arange(len(lengths))]
    so_far = np.zeros(len(lengths), np.uint64)
    power = common.powers(common._BASE[1], max(PREFIXES))
    data = words.data
    for j in range(max(PREFIXES)):
        long = np.flatnonzero(lengths > j)
        so_far[long] += common._LETTER[1][data[words.start[long] + j]] * power[j]
        if j + 1 in PREFIXES:
            features.append(common.mix(so_far[long] + np.uint64(j + 1)))
            owners.append(long)
    return np.concatenate(features), np.concatenate(owners)


def presences(column: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs; with ``chosen``, only those, as positions in it."""
    data, offsets = common.text_bytes(column)
    words = common.Words(common.LOWER[data], offsets, common.ALNUM)
    features, owners = word_features(words)
    texts = np.searchsorted(words.first, owners, side="right") - 1
    if chosen is None:
        order = np.lexsort((features, texts))
        texts, features = texts[order], features[order]
        new = np.ones(len(order), bool)
        new[1:] = (texts[1:] != texts[:-1]) | (features[1:] != features[:-1])
        return texts[new], features[new]
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
    hit = chosen[at] == features
    pairs = np.unique(texts[hit] * len(chosen) + at[hit])
    return pairs // len(chosen), pairs % len(chosen)


def features_of(term: str) -> np.ndarray:
    return np.unique(presences(pa.array([term]))[1])


def fit_sample(docs: DataFrame, labels: DataFrame, max_fit_rows: int, text: str = "text") -> DataFrame:
    """text and toxic of about ``max_fit_rows`` labelled rows at most, by a hash of the id."""
    known = common.pick(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_fit_rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return common.pick(docs, "doc_id", text).join(F.broadcast(picked), "doc_id").select(F.col(text).alias("text"), "toxic")


def choose_features(sample: DataFrame) -> np.ndarray:
    """Hashes of the features whose presence differs most between the classes, by chi-square."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, features = presences(part.column("text"))
        toxic = part.column("toxic").to_numpy()[texts] > 0
        keys, where = np.unique(features, return_inverse=True)
        ones = np.bincount(where, weights=toxic, minlength=len(keys)).astype(np.int64)
        return common.batch(feature=pa.array(keys.astype(np.int64)), n=pa.array(np.bincount(where, minlength=len(keys)).astype(np.int64)), ones=pa.array(ones))

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("ones")).first()
    n, ones = float(total["n"]), float(total["ones"])
    counts = common.map_slices(sample, run, "feature long, n long, ones long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    expected = F.col("n") * (ones / max(n, 1.0))
    chi = F.pow(F.col("ones") - expected, F.lit(2.0)) / F.greatest(expected * (1 - F.col("n") / (n + 1)), F.lit(1e-9))
    best = counts.filter((F.col("n") >= MIN_ROWS) & (chi >= MIN_CHI)).orderBy(chi.desc(), "feature").limit(FEATURES).select("feature").toArrow()
    terms = [features_of(t) for line in IDENTITY for t in line]
    return np.unique(np.concatenate([best.column("feature").to_numpy().astype(np.uint64), *terms]))


def examples(sample: DataFrame, chosen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Chosen features of each row of the bounded sample, and its label."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, at = presences(part.column("text"), chosen)
        return common.batch(at=common.lists(at, np.bincount(texts, minlength=part.num_rows), pa.int32()), toxic=part.column("toxic"))

    rows = common.map_slices(sample, run, "at array<int>, toxic int").toArrow()
    if not rows.num_rows:
        return [], np.zeros(0)
    lists = [np.array(x, dtype=np.int64) for x in rows.column("at").to_pylist()]
    return lists, rows.column("toxic").to_numpy().astype(float)


def swaps(rows: list[np.ndarray], chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features lost, features gained) for each swap of each group term in each row."""
    place = lambda found: np.searchsorted(chosen, found)
    out = []
    for line in IDENTITY:
        of = [place(features_of(t)) for t in line]
        whole = [int(place(common.Words(*common.text_bytes(pa.array([t]))).hashes())[0]) for t in line]
        for row in rows:
            present = set(row.tolist())
            for i in (i for i, w in enumerate(whole) if w in present):
                for j in range(len(line)):
                    if j != i:
                        out.append((np.setdiff1d(of[i], of[j]), np.array([x for x in of[j] if x not in present], dtype=np.int64)))
    return out


def fit(rows: list[np.ndarray], toxic: np.ndarray, size: int, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = LAMBDA) -> np.ndarray:
    """Weights and, last, the intercept: logistic loss, ridge and the counterfactual penalty."""
    weights = np.zeros(size + 1)
    n = len(toxic)
    if not n or toxic.min() == toxic.max():
        weights[-1] = 50.0 if n and toxic.min() > 0 else -50.0
        return weights
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    lost = np.concatenate([a for a, _ in pairs] + [np.zeros(0, np.int64)]).astype(np.int64)
    gained = np.concatenate([b for _, b in pairs] + [np.zeros(0, np.int64)]).astype(np.int64)
    lost_by = np.repeat(np.arange(len(pairs)), [len(a) for a, _ in pairs])
    gained_by = np.repeat(np.arange(len(pairs)), [len(b) for _, b in pairs])
    share = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))  # classes weigh the same
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, weights[flat], n) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - toxic) * share
        slope = RIDGE * weights
        slope[:-1] += np.bincount(flat, error[owner], size)
        slope[-1] = error.sum()
        if pairs:
            moved = np.bincount(gained_by, weights[gained], len(pairs)) - np.bincount(lost_by, weights[lost], len(pairs))
            moved *= 2 * penalty / len(pairs)
            slope[:-1] += np.bincount(gained, moved[gained_by], size) - np.bincount(lost, moved[lost_by], size)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        rate = 0.1 * (1 - (step - 1) / STEPS)
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def train(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, penalty: float = LAMBDA, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and weights, a few tens of KB whatever the corpus."""
    from parlance.session import materialize

    sample = materialize(fit_sample(docs, labels, max_fit_rows, text), "toxicity-sample")
    chosen = choose_features(sample)
    rows, toxic = examples(sample, chosen)
    return chosen, fit(rows, toxic, len(chosen), swaps(rows, chosen), penalty)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score``, the probability of toxicity of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        chosen, weights = shared.value
        texts, at = presences(part.column(text), chosen)
        margin = np.bincount(texts, weights[at], part.num_rows) + weights[-1]
        found = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found)], names=[*keep, "score"])

    narrow = common.pick(docs, *keep, text)
    kinds = dict(narrow.dtypes)
    return common.map_slices(narrow, run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double"]), text)
