"""The measures of ``tokens`` where an annotator has its tokens as whole columns.

What ``tokens`` states as expressions on one text's array is arithmetic on the columns of many texts
here, with the same results: a task that annotates hands on one number a text instead of its tokens.
Positions count through all texts of a batch, so a token's head is the place of another row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parlance.functions import lexicon as lx

#: Sequences that come beside the measures, and the labels they list.
SEQUENCES = ("pos_sequence", "dep_sequence")


@dataclass
class Columns:
    """Tokens of several texts, one after the other; ``pos``, ``dep`` and ``morph`` number their names."""

    bounds: np.ndarray  # where each text starts, and the end
    sentences: np.ndarray  # of each text, all with a token
    sentence: np.ndarray  # number through all texts
    pos: np.ndarray
    dep: np.ndarray
    morph: np.ndarray
    head: np.ndarray
    alpha: np.ndarray
    be: np.ndarray  # lemma is "être"; of any other word it is the word in lower case
    word: np.ndarray  # distinct word of the batch
    words: list[str]
    pos_names: list[str]
    dep_names: list[str]
    morphs: list[dict]

    @cached_property
    def low(self) -> list[str]:
        return [w.lower() for w in self.words]

    def is_pos(self, *names: str) -> np.ndarray:
        return np.array([p in names for p in self.pos_names])[self.pos]

    def is_dep(self, *names: str) -> np.ndarray:
        return np.array([d in names for d in self.dep_names])[self.dep]

    def has(self, feature: str, *values: str) -> np.ndarray:
        return np.array([any(v in values for v in m.get(feature, [])) for m in self.morphs], bool)[self.morph]

    def form(self, *values: str) -> np.ndarray:
        return np.array([m.get("VerbForm") in [[v] for v in values] for m in self.morphs], bool)[self.morph]

    def of_words(self, facts: Iterable[int]) -> np.ndarray:
        """What is given for each distinct word, for each token."""
        return np.fromiter(facts, np.int64, len(self.words))[self.word]

    def any_of(self, words: Iterable[bool]) -> np.ndarray:
        return self.of_words(words).astype(bool)


_NUCLEI = re.compile(f"[{lx.SYLLABLE_VOWELS}]+")


def measured(c: Columns, names: list[str], connectors: np.ndarray | None = None, corrected: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """The named measures of each text, and ``inner_tokens`` and ``positions`` of its visible tokens."""
    n, texts = len(c.pos), len(c.sentences)
    at, owner = np.arange(n), np.repeat(np.arange(texts), np.diff(c.bounds))
    place = at - c.bounds[owner]
    count = lambda mask: np.bincount(owner[mask], minlength=texts)
    total = lambda tokens, values: np.bincount(owner[tokens], values, texts)

    def mean(tokens: np.ndarray, values: np.ndarray) -> np.ndarray:
        many = np.bincount(owner[tokens], minlength=texts)
        return np.where(many > 0, total(tokens, values) / np.maximum(1, many), 0.0)

    verb, noun, aux = c.is_pos("VERB"), c.is_pos("NOUN"), c.is_pos("AUX")
    real = ~c.is_pos("SPACE")
    below = c.head != at  # tokens that another one governs
    finite = real & (verb | aux) & ~c.form("Inf", "Part")
    tokens, sentences = np.maximum(1, count(real)), np.maximum(1, c.sentences)
    seen = np.flatnonzero(real)
    inner = seen[1:][c.sentence[seen[1:]] == c.sentence[seen[:-1]]]
    under_verb = below & verb[c.head]

    def first_under(labels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Heads of such tokens, and the first of each."""
        some = np.flatnonzero(c.is_dep(*labels) & under_verb)
        heads, one = np.unique(c.head[some], return_index=True)
        return heads, some[one]

    def complexity() -> np.ndarray:
        up, depth = c.head, below.astype(np.int64)
        while (up[up] != up).any():
            depth, up = depth + depth[up], up[up]
        deep = np.flatnonzero(real & c.is_pos("NOUN", "VERB", "ADJ"))
        return mean(deep, depth[deep]) + count(real & c.is_pos("SCONJ")) / sentences

    def noun_repetition() -> np.ndarray:
        code, many = pa.array([w.lower() for w in c.low], pa.string()).dictionary_encode().indices.to_numpy(), len(c.low) + 1
        some = np.flatnonzero(real & noun)
        lemma = np.where(c.be[some], many - 1, code[c.word[some]])
        pairs, times = np.unique(owner[some] * many + lemma, return_counts=True)
        of = pairs // many
        return np.bincount(of[times > 1], minlength=texts) / np.maximum(1, np.bincount(of, minlength=texts))

    def object_order() -> np.ndarray:
        subjects, objects = first_under(("nsubj",)), first_under(("obj",))
        heads, s, o = np.intersect1d(subjects[0], objects[0], assume_unique=True, return_indices=True)
        return mean(heads, np.where(objects[1][o] < heads, 1, np.where(subjects[1][s] > heads, -1, 0)))

    def distance() -> np.ndarray:
        heads, one = first_under(("nsubj", "nsubj:pass"))
        return mean(heads, np.abs(heads - one))

    def passive() -> np.ndarray:
        labels = ("auxpass", "aux:pass") if "passive_ratio" in corrected else ("auxpass",)
        own = c.is_dep(*labels)
        heads = np.unique(c.head[c.is_dep("nsubj:pass") & below])
        return (count(real & own) + count(real & ~own & aux & c.be & np.isin(c.head, heads))) / sentences

    def composed() -> np.ndarray:
        if "composed_ratio" in corrected:
            some = aux & finite & under_verb & c.form("Part")[c.head]
        else:
            some = verb & c.form("Part") & below & (aux & finite)[c.head]
        return count(np.unique(c.head[some])) / finite_total

    def flesch() -> np.ndarray:
        alpha = np.flatnonzero(real & c.alpha)
        syllables = c.of_words(max(1, len(_NUCLEI.findall(w))) for w in c.low)
        words, runs = np.maximum(1, np.bincount(owner[alpha], minlength=texts)), total(alpha, syllables[alpha])
        return 206.835 - 1.015 * (words / sentences) - 84.6 * (runs / words)

    def capitals() -> np.ndarray:
        upper = c.any_of(w[0].isupper() for w in c.words)
        return count(inner[(upper & ~c.is_pos("PROPN"))[inner]]) / tokens

    def ratio(tense: tuple[str, ...]) -> np.ndarray:
        return count(finite & c.has("Tense", *tense)) / finite_total

    def positions(mask: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(mask)
        return mean(some, place[some])

    def plural() -> np.ndarray:
        return count(noun & c.has("Number", "Plur")).astype(float)

    finite_total = np.maximum(1, count(finite))
    known = {
        "punct_ratio": lambda: count(real & c.any_of(w in lx.PUNCTUATION for w in c.words)) / tokens,
        "flesch": flesch,
        "sentence_length": lambda: np.where(c.sentences > 0, count(real) / sentences, 0.0),
        "complexity": complexity,
        "adposition_ratio": lambda: count(real & c.is_pos("ADP")) / tokens,
        "noun_repetition": noun_repetition,
        "connector_ratio": lambda: connectors / tokens,
        "determiner_ratio": lambda: count(real & c.is_pos("DET")) / np.maximum(1, count(real & noun)),
        "capital_ratio": capitals,
        "object_order": object_order,
        "verb_noun_ratio": lambda: count(real & verb) / np.maximum(1, count(real & noun)),
        "passive_ratio": passive,
        "verb_subject_distance": distance,
        "subject_pronoun_ratio": lambda: count(real & c.is_dep("nsubj") & c.any_of(w in lx.SUBJECT_PRONOUNS for w in c.low)) / finite_total,
        "subject_mean": lambda: positions(c.is_dep("nsubj")),
        "verb_mean": lambda: positions(verb),
        "object_mean": lambda: positions(c.is_dep("obj")),
        "determiner_ratio_all": lambda: count(c.is_pos("DET")) / np.maximum(1, count(noun)),
        "plural_count": plural,
        "present_ratio": lambda: ratio(("Pres",)),
        "future_ratio": lambda: ratio(("Fut",)),
        "past_ratio": lambda: ratio(("Past", "Imp")),
        "composed_ratio": composed,
        "inner_tokens": lambda: np.bincount(owner[inner], minlength=texts),
        "positions": lambda: total(seen, place[seen]),
    }
    return {name: known[name]() for name in names}


def sequence(c: Columns, name: str) -> pa.Array:
    """The labels of each text, joined by a space."""
    numbers, names = (c.pos, c.pos_names) if name == "pos_sequence" else (c.dep, c.dep_names)
    labels = pa.array(names, pa.string()).take(pa.array(numbers))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(c.bounds, pa.int32()), labels), " ")
