"""Numeric feature tables: groups of the 21 measures, fixed blocks, scaler and fitted extractor."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.functions import lexicon as lx, tokens as tk
from parlance.functions.text import finite_or_zero, stylometry
from parlance.operators.annotate import annotate_lite, measure_lite

Annotator = Callable[[DataFrame], DataFrame]

# Measure behind each of the 21 columns.
COLUMN_MEASURE = {
    "punctuation_punct_ratio": "punct_ratio",
    "articles_det_ratio": "determiner_ratio",
    "majuscules_freq_maj": "capital_ratio",
    "prepositions_freq_prep": "adposition_ratio",
    "pronouns_ratio_prodrop": "subject_pronoun_ratio",
    "sentence_structure_subj_mean": "subject_mean",
    "sentence_structure_verb_mean": "verb_mean",
    "sentence_structure_obj_mean": "object_mean",
    "sentence_structure_ratio_sov": "object_order",
    "sentence_structure_distance_verb_subject": "verb_subject_distance",
    "words_per_sentence_mean": "sentence_length",
    "discourse_connectors_freq": "connector_ratio",
    "verb_tenses_present_ratio": "present_ratio",
    "verb_tenses_future_ratio": "future_ratio",
    "verb_tenses_past_ratio": "past_ratio",
    "verb_tenses_composed_ratio": "composed_ratio",
    "readability_flesch_fr": "flesch",
    "syntactic_complexity_dependency_depth": "complexity",
    "noun_repetition_ratio": "noun_repetition",
    "verb_noun_ratio": "verb_noun_ratio",
    "passive_ratio": "passive_ratio",
}

# Order of the 14 measures of the "advanced" block and the 5 of "l1_numeric".
ADVANCED = [
    "punct_ratio", "flesch", "sentence_length", "complexity", "adposition_ratio", "noun_repetition",
    "connector_ratio", "determiner_ratio", "capital_ratio", "object_order", "verb_noun_ratio",
    "passive_ratio", "verb_subject_distance", "subject_pronoun_ratio",
]
L1_NUMERIC = ["determiner_ratio_all", "subject_mean", "verb_mean", "object_mean", "plural_count"]
STYLOMETRIC = ["length", "punct_ratio", "lexdiv"]


def available_features() -> list[str]:
    return sorted(lx.FEATURE_GROUPS)


def feature_columns(names: list[str]) -> list[str]:
    """Columns of the named groups, in the order asked for."""
    unknown = sorted(set(names) - set(lx.FEATURE_GROUPS))
    if unknown:
        raise ValueError(
            f"unknown feature(s): {', '.join(unknown)}; available: {', '.join(available_features())}"
        )
    if len(set(names)) < len(names):
        raise ValueError("a feature is named twice")
    return [c for name in names for c in lx.FEATURE_GROUPS[name]]


def parse_feature_names(names: list[str]) -> list[str]:
    """``none`` alone means no features."""
    return [] if names == ["none"] else names


def _measured(df: DataFrame, names: dict[str, str], text: str, keep: list[str], corrected: tuple[str, ...] = (), annotator: Annotator | None = None) -> DataFrame:
    if annotator is annotate_lite:
        found = measure_lite(df, list(dict.fromkeys(names.values())), text, keep, corrected)
        return found.select(*keep, *[finite_or_zero(F.col(m)).alias(c) for c, m in names.items()])
    based = tk.with_basics(annotator(df) if annotator else df, text)
    known = tk.measures(corrected)
    return based.select(*keep, *[finite_or_zero(known[m]).alias(c) for c, m in names.items()])


def linguistic_features(
    df: DataFrame, groups: list[str] | None = None, text: str = "text", keep: list[str] = ("doc_id",), corrected: tuple[str, ...] = (),
    annotator: Annotator | None = None,
) -> DataFrame:
    """The columns of the chosen groups (all by default); unasked measures are never computed.

    ``corrected`` names measures to take in their corrected form (``tokens.CORRECTED``).
    ``annotator`` is what still has to add ``tokens``; with ``annotate_lite`` tokens are measured in
    the task that annotates.

    With no group at all, ``tokens`` is not read, so an annotator need not run.
    """
    columns = feature_columns(available_features() if groups is None else groups)
    if not columns:
        return df.select(*keep)
    return _measured(df, {c: COLUMN_MEASURE[c] for c in columns}, text, list(keep), corrected, annotator)


def advanced_block(
    df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), corrected: tuple[str, ...] = (), annotator: Annotator | None = None
) -> DataFrame:
    return _measured(df, {m: m for m in ADVANCED}, text, list(keep), corrected, annotator)


def numeric_block(
    df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), corrected: tuple[str, ...] = (), annotator: Annotator | None = None
) -> DataFrame:
    return _measured(df, {m: m for m in L1_NUMERIC}, text, list(keep), corrected, annotator)


def stylometric_block(df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    return df.select(*keep, *stylometry(F.col(text)))


def align_columns(df: DataFrame, fitted: list[str], keep: list[str] = ("doc_id",)) -> DataFrame:
    """Exactly the fitted columns in their order; a missing one becomes 0.0."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[(F.coalesce(F.col(c), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c) for c in fitted],
    )


@dataclass
class Scaler:
    """Z-scores with training means and population deviations; a zero deviation divides by 1."""

    columns: list[str]
    statistics: DataFrame | None = None

    def fit(self, train: DataFrame) -> "Scaler":
        if self.columns:
            moments = [
                F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in self.columns
            ]
            self.statistics = train.agg(*moments)
        return self

    def transform(self, df: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
        """The one row of statistics enters as a scalar subquery: no join, no shuffle."""
        aligned = align_columns(df, self.columns, keep)
        if not self.columns:
            return aligned
        packed = self.statistics.select(F.struct(*self.columns)).scalar()
        staged = aligned.withColumn("_moments", packed)
        scaled = []
        for c in self.columns:
            moments = F.col("_moments")[c]
            spread = F.when(moments["std"] == 0, F.lit(1.0)).otherwise(moments["std"])
            scaled.append(((F.col(c) - moments["mean"]) / spread).alias(c))
        return staged.select(*keep, *scaled)

    @property
    def n_features(self) -> int:
        return len(self.columns)


@dataclass(frozen=True)
class FeatureExtractor:
    """Feature groups of annotated texts as one vector of 32-bit floats, z-scored unless ``scale`` is off.

    ``fit`` gives a model; neither of the two ever changes.
    """

    groups: tuple[str, ...]
    scale: bool = True
    corrected: tuple[str, ...] = ()
    text: str = "text"

    def fit(self, train: DataFrame) -> "FeatureExtractorModel":
        columns = tuple(feature_columns(list(self.groups)))
        if not (self.scale and columns):
            return FeatureExtractorModel(self, columns)
        table = linguistic_features(train, list(self.groups), self.text, [], self.corrected)
        row = table.agg(*[f(c).alias(f"{name}{k}") for k, c in enumerate(columns) for name, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
        means = tuple(row[f"mean{k}"] or 0.0 for k in range(len(columns)))
        return FeatureExtractorModel(self, columns, means, tuple(row[f"std{k}"] or 1.0 for k in range(len(columns))))


@dataclass(frozen=True)
class FeatureExtractorModel:
    """A fitted extractor: two numbers a column, so that it works on streams and stores as one row."""

    extractor: FeatureExtractor
    columns: tuple[str, ...]
    means: tuple[float, ...] = ()
    deviations: tuple[float, ...] = ()

    @property
    def n_features(self) -> int:
        return len(self.columns)

    def transform(self, df: DataFrame, keep: list[str] = ("doc_id",), out: str = "features") -> DataFrame:
        """``keep`` and ``out``. Without any group ``out`` is empty and no annotation is read."""
        if not self.columns:
            return df.select(*keep, F.array().cast("array<float>").alias(out))
        table = linguistic_features(df, list(self.extractor.groups), self.extractor.text, list(keep), self.extractor.corrected)
        values = [F.col(c).cast("float") for c in self.columns]
        if self.means:
            values = [((v.cast("double") - m) / d).cast("float") for v, m, d in zip(values, self.means, self.deviations)]
        return table.select(*keep, F.array(*values).alias(out))

    def save(self, spark: SparkSession, path: str) -> None:
        facts = {"extractor": vars(self.extractor), "columns": self.columns, "means": self.means, "deviations": self.deviations}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureExtractorModel":
        """Refuses a model whose columns are not those of its groups any more."""
        facts = json.loads(spark.read.text(path).first()[0])
        made = {k: tuple(v) if isinstance(v, list) else v for k, v in facts["extractor"].items()}
        model = FeatureExtractorModel(FeatureExtractor(**made), *(tuple(facts[k]) for k in ("columns", "means", "deviations")))
        if model.columns != tuple(feature_columns(list(made["groups"]))):
            raise ValueError(f"stored columns {', '.join(model.columns)} are not those of {', '.join(made['groups'])}")
        return model
