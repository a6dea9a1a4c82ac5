"""Batched scoring with a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from parlance.functions.text import truncate_tokens
from parlance.sources.sinks import scorer_settings

MIN_BATCH = 8


def score(
    df: DataFrame,
    make_predict: Callable,
    labels: list[str],
    text: str = "text",
    features: str | None = None,
    n_features: int = 0,
    model: str = "camembert",
    out: str = "predicted_label",
    **overrides,
) -> DataFrame:
    """Label with the highest logit, from ``make_predict() -> (texts[, features]) -> logits``.

    The factory runs once per Python worker and the model sees batches of at least eight
    texts, cut to ``max_length`` tokens. Settings come from the model's preset unless the
    caller gives others. ``features`` names an array column passed along with the text.
    """
    settings = scorer_settings(model, **overrides)
    shapes = [[]] if features is None else [[], [n_features]]
    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=max(MIN_BATCH, settings["batch_size"]),
        input_tensor_shapes=shapes,
    )
    cut = df.withColumn("_cut", truncate_tokens(F.col(text), settings["max_length"]))
    inputs = ["_cut"] if features is None else ["_cut", features]
    scored = cut.withColumn("_logits", predict(*inputs))
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_position("_logits", F.array_max("_logits")).cast("int")
    return scored.withColumn(out, F.element_at(names, best)).drop("_cut", "_logits")


def score_tokens(
    df: DataFrame,
    make_tokenizer: Callable,
    make_predict: Callable,
    labels: list[str],
    text: str = "text",
    model: str = "camembert",
    pad_id: int = 0,
    out: str = "predicted_label",
    **overrides,
) -> DataFrame:
    """As ``score``, for a model that reads its own tokens: all columns, ``out`` and ``n_model_tokens``.

    ``make_tokenizer() -> (encode, before, after)``: ``encode`` gives a list of ids for each of a list
    of texts, ``before`` and ``after`` are the ids of special tokens that enclose them. They count:
    a text keeps as many of its first tokens as fit beside them into ``max_length``.
    ``make_predict() -> (ids, mask) -> logits`` sees texts of like length together, each batch padded
    with ``pad_id`` to its own longest only. Both are made once a worker's task. A null text is empty.
    """
    settings = scorer_settings(model, **overrides)
    longest, size = settings["max_length"], max(MIN_BATCH, settings["batch_size"])
    rest = [c for c in df.columns if c not in (out, "n_model_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode, before, after), predict = make_tokenizer(), make_predict()
        room = longest - len(before) - len(after)
        if room < 0:
            raise ValueError(f"max_length {longest} has no room for {len(before) + len(after)} special tokens")
        for batch in batches:
            ids = [[*before, *found[:room], *after] for found in encode([t or "" for t in batch.column(text).to_pylist()])]
            lengths = np.array([len(i) for i in ids], dtype=np.int64)
            order, best = np.argsort(lengths, kind="stable"), np.zeros(len(ids), dtype=np.int64)
            for k in range(0, len(order), size):
                chosen = order[k : k + size]
                padded = np.full((len(chosen), int(lengths[chosen].max())), pad_id, dtype=np.int64)
                for row, i in enumerate(chosen.tolist()):
                    padded[row, : lengths[i]] = ids[i]
                mask = np.arange(padded.shape[1]) < lengths[chosen][:, None]
                best[chosen] = np.argmax(predict(padded, mask), axis=1)
            guess = pa.array([labels[k] for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], guess, pa.array(lengths)], names=[*rest, out, "n_model_tokens"])

    narrow = df.select(*[F.col(f"`{c}`") for c in rest])
    return narrow.mapInArrow(run, T.StructType([*narrow.schema, T.StructField(out, T.StringType()), T.StructField("n_model_tokens", T.LongType())]))
