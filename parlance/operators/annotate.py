"""Token annotations: a hook for a user's parser, and a small rule-based stand-in.

Everything downstream reads one column, ``tokens``: an array ordered by ``i``, where ``i`` is
the position in the text, ``head`` the position of the governing token (a root governs
itself) and ``sent`` the sentence number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parlance.functions.text import connector_count
from parlance.functions.tokencolumns import SEQUENCES, Columns, measured, sequence

TOKENS = T.ArrayType(
    T.StructType(
        [
            T.StructField("i", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("lemma", T.StringType()),
            T.StructField("pos", T.StringType()),
            T.StructField("tag", T.StringType()),
            T.StructField("dep", T.StringType()),
            T.StructField("head", T.IntegerType()),
            T.StructField("sent", T.IntegerType()),
            T.StructField("is_space", T.BooleanType()),
            T.StructField("is_alpha", T.BooleanType()),
            T.StructField("morph", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        ]
    )
)

_ARROW = {
    "i": pa.int32(), "text": pa.string(), "lemma": pa.string(), "pos": pa.string(), "tag": pa.string(), "dep": pa.string(),
    "head": pa.int32(), "sent": pa.int32(), "is_space": pa.bool_(), "is_alpha": pa.bool_(),
    "morph": pa.map_(pa.string(), pa.list_(pa.string())),
}
_ARROW_FIELDS = tuple(pa.field(name, kind) for name, kind in _ARROW.items())

Annotator = Callable[[list[str]], Iterable[list[dict]]]

_LOADED: dict[str, Annotator] = {}
KEEP_LOADED = 2  # parsers a worker holds; the oldest goes first


def _loaded(key: str, factory: Callable[[], Annotator]) -> Annotator:
    if key not in _LOADED:
        while len(_LOADED) >= KEEP_LOADED:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[key] = factory()
    return _LOADED[key]


def _from_dicts(parsed: list[list[dict]]) -> pa.Array:
    """Token lists as one Arrow column, built field by field; a missing field is null."""
    flat = [token for tokens in parsed for token in tokens]
    fields = []
    for name, kind in _ARROW.items():
        values = [token.get(name) for token in flat]
        if name == "morph":
            values = [m if m is None else list(m.items()) for m in values]
        fields.append(pa.array(values, kind))
    offsets = np.concatenate([[0], np.cumsum([len(tokens) for tokens in parsed])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ARROW_FIELDS)))


def annotate(df: DataFrame, text: str, factory: Callable[[], Annotator], batch_size: int = 256) -> DataFrame:
    """Add ``tokens`` with a user's annotator.

    ``factory()`` runs once per Python worker (load the parser there, with the components the
    features do not need switched off) and returns a function from a list of texts to one token
    list per text; later tasks of the worker reuse it. Texts are passed on in bounded batches as
    the annotator yields.
    """
    key = uuid.uuid4().hex
    schema = T.StructType([*df.schema.fields, T.StructField("tokens", TOKENS)])

    def run(batches):
        annotator = _loaded(key, factory)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                parsed = [list(tokens) for tokens in annotator([t or "" for t in part.column(at).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, _from_dicts(parsed)], names=[*part.schema.names, "tokens"])

    return df.mapInArrow(run, schema)


# Stand-in annotator ---------------------------------------------------------------------------
# A test double with no linguistic accuracy: closed word lists, suffixes and a fixed attachment
# rule. Its rules are plain enough for SQL to restate them.

LITE_DET = ["le", "la", "les", "un", "une", "des", "the", "a", "der", "die", "das", "el", "los"]
LITE_ADP = ["de", "à", "en", "dans", "par", "pour", "sur", "of", "in", "to", "von", "mit", "con"]
LITE_PRON = ["je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "he", "she", "it", "ich"]
LITE_SCONJ = ["que", "qui", "si", "that", "dass"]
LITE_AUX_BE = ["est", "sont", "was", "is", "are", "ist", "es"]
LITE_AUX_HAVE = ["a", "ont", "have", "has", "hat", "ha"]
LITE_ADJ_SUFFIX = "(eux|able|ible|ous|isch|ado)$"
LITE_VERB_SUFFIX = "(er|ir|ing|ed|ent|en|ar|ez)$"

LITE_TOKEN = r"[\p{L}\p{M}]+|\p{N}+|\n+|[^ \t\n\r\f\p{L}\p{M}\p{N}]"
LITE_SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"


LITE_POS = ["SPACE", "AUX", "DET", "ADP", "PRON", "SCONJ", "NUM", "PUNCT", "ADJ", "VERB", "PROPN", "NOUN"]
LITE_DEP = ["ROOT", "obj", "nsubj:pass", "nsubj", "auxpass", "det", "case", "amod", "mark", "aux", "punct", "dep"]
LITE_MORPH = [
    {}, {"VerbForm": ["Part"], "Tense": ["Past"]}, {"VerbForm": ["Inf"]}, {"VerbForm": ["Fin"], "Tense": ["Pres"]},
    {"VerbForm": ["Fin"], "Tense": ["Imp"]}, {"VerbForm": ["Fin"], "Tense": ["Fut"]}, {"Number": ["Plur"]}, {"Number": ["Sing"]},
]
_POS = {p: k for k, p in enumerate(LITE_POS)}
_DEP = {d: k for k, d in enumerate(LITE_DEP)}
_CLOSED = {
    w: p for p, words in (("SCONJ", LITE_SCONJ), ("PRON", LITE_PRON), ("ADP", LITE_ADP), ("DET", LITE_DET), ("AUX", LITE_AUX_BE + LITE_AUX_HAVE[1:]))
    for w in words
}
_BE = frozenset(LITE_AUX_BE)
_OWN_LABEL = {"DET": "det", "ADP": "case", "ADJ": "amod", "SCONJ": "mark", "AUX": "aux", "PUNCT": "punct"}
_LABEL_OF = np.array([_DEP[_OWN_LABEL.get(p, "dep")] for p in LITE_POS])
_FORWARD = np.array([p in ("DET", "ADP", "ADJ", "SCONJ", "AUX") for p in LITE_POS])
_NOMINAL = np.array([p in ("NOUN", "PRON", "PROPN") for p in LITE_POS])
_ADJ_ENDS, _VERB_ENDS = (tuple(x.strip("()$").split("|")) for x in (LITE_ADJ_SUFFIX, LITE_VERB_SUFFIX))
SLICE_TOKENS = 1 << 16  # tokens of a record batch, or those of one text
KEEP_WORDS = 1 << 16  # words a worker remembers


def _lite_pos(token: str, low: str) -> str:
    if low in _CLOSED:
        return _CLOSED[low]
    if not low[0].isalpha():
        if low[0] == "\n":
            return "SPACE"
        first = category(low[0])[0]
        if first == "N":
            return "NUM"
        if first != "M":
            return "PUNCT"
    if low.endswith(_ADJ_ENDS):
        return "ADJ"
    if low.endswith(_VERB_ENDS):
        return "VERB"
    return "PROPN" if token[:2].isupper() and len(token) > 1 and category(token[0]) == category(token[1]) == "Lu" else "NOUN"


@lru_cache(KEEP_WORDS)
def _lite_word(token: str) -> int:
    """What depends on the word alone, as one number: four bits of ``LITE_POS``, four of ``LITE_MORPH``, and two marks."""
    low = token.lower()
    pos, morph = _lite_pos(token, low), 0
    if pos == "NOUN":
        morph = 6 if low.endswith("s") else 7
    elif pos == "AUX":
        morph = 3
    elif pos == "VERB":
        if low.endswith("ed"):
            morph = 1
        elif low.endswith(("er", "ir", "ar")):
            morph = 2
        elif low.endswith("ent"):
            morph = 4
        else:
            morph = 5 if low.endswith("ez") else 3
    return _POS[pos] | morph << 4 | (low in _BE) << 8 | token.isalpha() << 9


def _lite_columns(sentences: pa.Array) -> tuple[Columns, pa.Array, np.ndarray, np.ndarray]:
    """Whole columns of texts given as their sentences' words; the words, and each token's position
    and sentence number in its text."""
    per_text = sentences.value_lengths().to_numpy()
    inner = sentences.flatten()
    width, words = inner.value_lengths().to_numpy(), inner.flatten()
    n = len(words)
    known = words.dictionary_encode()
    code = known.indices.to_numpy()
    names = known.dictionary.to_numpy(zero_copy_only=False).tolist()
    facts = np.fromiter(map(_lite_word, names), np.int64, len(names))[code]
    pos, morph, be, alpha = facts & 15, facts >> 4 & 15, (facts >> 8 & 1).astype(bool), (facts >> 9).astype(bool)
    sentence = np.repeat(np.arange(len(width)), width)
    start = np.cumsum(width) - width
    j = np.arange(n) - start[sentence]
    last = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(per_text)])]  # text bounds
    i = np.arange(n) - np.repeat(last[:-1], np.diff(last))
    number = np.arange(len(width)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    # the first verb of each sentence: it is written last
    first, verbs = np.zeros(len(width), np.int64), np.flatnonzero(pos == _POS["VERB"])[::-1]
    first[sentence[verbs]] = j[verbs]
    passive = np.zeros(len(width), bool)
    passive[sentence[be]] = True
    root, verbal, passive = first[sentence], (pos[start + first] == _POS["VERB"])[sentence], passive[sentence]
    head = np.where(j == root, j, np.where(_FORWARD[pos] & (j + 1 < width[sentence]), j + 1, root))
    subject = np.where(passive, _DEP["nsubj:pass"], _DEP["nsubj"])
    behind = (j > root) | ((pos == _POS["PRON"]) & (j == root - 1))
    dep = np.where(_NOMINAL[pos] & (head == root) & verbal, np.where(behind, _DEP["obj"], subject), _LABEL_OF[pos])
    dep[(pos == _POS["AUX"]) & passive & (head < j)] = _DEP["auxpass"]
    dep[j == root] = _DEP["ROOT"]
    columns = Columns(
        last, per_text, sentence, pos, dep, morph, start[sentence] + head, alpha, be, code, names, LITE_POS, LITE_DEP, LITE_MORPH
    )
    return columns, words, i, number[sentence]


def _lite_tokens(sentences: pa.Array) -> pa.Array:
    """``tokens`` of the texts."""
    c, words, i, number = _lite_columns(sentences)
    strings = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
    morphs = pa.array([list(m.items()) for m in LITE_MORPH], _ARROW["morph"])
    fields = [
        pa.array(i, pa.int32()), words, pc.if_else(pa.array(c.be), "être", strings(c.low, c.word)), strings(LITE_POS, c.pos),
        strings([*LITE_POS, "NOUN__Number=Plur"], np.where(c.morph == 6, len(LITE_POS), c.pos)), strings(LITE_DEP, c.dep),
        pa.array(c.head - np.arange(len(i)) + i, pa.int32()), pa.array(number, pa.int32()), pa.array(c.pos == _POS["SPACE"]),
        pa.array(c.alpha), morphs.take(pa.array(c.morph)),
    ]
    return pa.ListArray.from_arrays(pa.array(c.bounds, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ARROW_FIELDS)))


def annotate_lite(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` with the stand-in rules. Linear in the text, no shuffle.

    Expressions cut the text in sentences and words; what depends on the word alone is looked up
    once per distinct word of a record batch, and the rest is arithmetic on whole columns.

    Per sentence the first verb (else the first token) is the root. Determiners,
    prepositions, adjectives, subordinators and auxiliaries attach to the next token of the
    sentence; a sentence's last token and everything else attach to the root. A pronoun right
    before a verbal root is its object.
    """
    def added(part: pa.RecordBatch) -> list[pa.Array]:
        return part.columns[:-1] + [_lite_tokens(part.column(part.num_columns - 1))]

    cut = df.withColumn("tokens", _lite_cut(text))
    return _lite_slices(cut, added, T.StructType([*df.schema.fields, T.StructField("tokens", TOKENS)]))


def measure_lite(df: DataFrame, names: list[str], text: str = "text", keep: list[str] = ("doc_id",), corrected: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and the named measures (``tokencolumns``) or sequences of texts that
    ``annotate_lite`` would annotate, from the columns it has: the tokens themselves stay in the task.
    """
    names, keep = list(names), list(keep)
    conn = connector_count(F.col(text)) if "connector_ratio" in names else F.lit(0)
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    cut = df.select(*[F.col(f"`{c}`") for c in keep], conn.cast("double").alias("_conn"), _lite_cut(text).alias("_cut"))
    kind = lambda name: T.StringType() if name in SEQUENCES else T.DoubleType()
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, kind(name)) for name in names]])

    def found(part: pa.RecordBatch) -> list[pa.Array]:
        columns = _lite_columns(part.column(len(keep) + 1))[0]
        connectors = part.column(len(keep)).to_numpy(zero_copy_only=False)  # of a null text: not a number
        values = measured(columns, [name for name in names if name not in SEQUENCES], connectors, corrected)
        return part.columns[: len(keep)] + [
            sequence(columns, name) if name in SEQUENCES else pa.array(values[name], pa.float64()) for name in names
        ]

    return _lite_slices(cut, found, schema)


def _lite_cut(text: str) -> Column:
    """Sentences of a text as arrays of words."""
    sentences = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LITE_SENTENCE), F.lit(0))
    tokenised = F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(LITE_TOKEN), F.lit(0)))
    return F.filter(tokenised, lambda s: F.size(s) > 0)


def _lite_slices(cut: DataFrame, of: Callable[[pa.RecordBatch], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """Texts in slices of about ``SLICE_TOKENS``; their sentences are the last column of ``cut``."""
    names = schema.names

    def run(batches):
        for batch in batches:
            ends = np.cumsum(_sizes(batch.column(batch.num_columns - 1)))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
                yield pa.RecordBatch.from_arrays(of(batch.slice(at, upto - at)), names=names)
                at = upto

    return cut.mapInArrow(run, schema)


def _sizes(sentences: pa.Array) -> np.ndarray:
    """Words of each text."""
    ends = np.concatenate([[0], np.cumsum(sentences.flatten().value_lengths().to_numpy())])
    bounds = np.concatenate([[0], np.cumsum(sentences.value_lengths().to_numpy())])
    return np.diff(ends[bounds])
