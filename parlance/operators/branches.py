"""A head of two branches: tanh over the text vector beside ReLU over the features, one classifier.

Minimised is the class-weighted mean cross-entropy plus a small penalty on the matrices. Every step
is one pass over the rows: tasks add up loss and gradient over theirs, the sums are added up slice by
slice in tasks again, and the driver, which holds the parameters only, takes a limited-memory
quasi-Newton step. A fit ends by its gradient; one that does not get there is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.dual import sparse

SLICE = 1 << 15
MEMORY = 10  # steps that the quasi-Newton direction remembers


def shapes(text: int, features: int, hidden: int, classes: int) -> dict[str, tuple[int, ...]]:
    """Parameters by name; without features there is no second branch."""
    out = {"text": (text, text), "text_bias": (text,)}
    if features:
        out |= {"feature": (features, hidden), "feature_bias": (hidden,)}
    return out | {"classes": (text + (hidden if features else 0), classes), "classes_bias": (classes,)}


def parted(theta: np.ndarray, kinds: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in kinds.items():
        size = int(np.prod(shape))
        out[name], at = theta[at : at + size].reshape(shape), at + size
    return out


def start(kinds: dict[str, tuple[int, ...]], seed: int) -> np.ndarray:
    """Uniform within one over the root of the inputs, biases too."""
    rng, fan, out = np.random.default_rng(seed), 1, []
    for shape in kinds.values():
        fan = shape[0] if len(shape) == 2 else fan
        out.append(rng.uniform(-1, 1, int(np.prod(shape))) / np.sqrt(fan))
    return np.concatenate(out)


def forward(p: dict[str, np.ndarray], text: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What both branches give, side by side, and the logits."""
    inner = np.tanh(text @ p["text"] + p["text_bias"])
    if "feature" in p:
        inner = np.hstack([inner, np.maximum(0, features @ p["feature"] + p["feature_bias"])])
    return inner, inner @ p["classes"] + p["classes_bias"]


def loss_and_gradient(theta, kinds, text, features, y, weight) -> tuple[float, np.ndarray]:
    """Weighted sum of cross-entropies over the rows, and its gradient."""
    p = parted(theta, kinds)
    inner, logits = forward(p, text, features)
    logits = logits - logits.max(axis=1, keepdims=True)
    share = np.exp(logits)
    total = share.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(weight @ (np.log(total[:, 0]) - logits[rows, y]))
    back = share / total
    back[rows, y] -= 1
    back *= weight[:, None]
    slopes = {"classes": inner.T @ back, "classes_bias": back.sum(axis=0)}
    inward = back @ p["classes"].T
    width = p["text"].shape[1]
    tanh = inward[:, :width] * (1 - inner[:, :width] ** 2)
    slopes |= {"text": text.T @ tanh, "text_bias": tanh.sum(axis=0)}
    if "feature" in p:
        relu = inward[:, width:] * (inner[:, width:] > 0)
        slopes |= {"feature": features.T @ relu, "feature_bias": relu.sum(axis=0)}
    return loss, np.concatenate([slopes[name].ravel() for name in kinds])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets, indices, values = sparse(column)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), np.diff(offsets)), indices] = values
    return out


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    if not names:
        return np.zeros((batch.num_rows, 0))
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


@dataclass
class BranchedHead:
    labels: list[str]
    features: list[str]
    kinds: dict[str, tuple[int, ...]]
    theta: np.ndarray = field(repr=False)
    steps: int = 0
    passes: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns but ``embedding``, and ``predicted_label``."""
        held = df.sparkSession.sparkContext.broadcast(self.theta)
        kinds, labels, names = self.kinds, self.labels, self.features
        rest = [c for c in df.columns if c not in ("embedding", "predicted_label")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = parted(held.value, kinds)
            for batch in batches:
                _, logits = forward(p, _matrix(batch.column("embedding"), kinds["text"][0]), _columns(batch, names))
                guess = pa.array([labels[k] for k in logits.argmax(axis=1)], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], guess], names=[*rest, "predicted_label"])

        narrow = df.select(*[F.col(f"`{c}`") for c in rest], "embedding")
        return narrow.mapInArrow(run, narrow.drop("embedding").withColumn("predicted_label", F.lit("")).schema)


def summed(rows: DataFrame, kinds, features: list[str], labels: list[str], theta: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient over all rows: one pass, sums from tasks to tasks to one vector."""
    held = rows.sparkSession.sparkContext.broadcast(theta)
    number = {c: k for k, c in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(theta))
        for batch in batches:
            if batch.num_rows:
                y = np.array([number[c] for c in batch.column("label").to_pylist()])
                weight = batch.column("weight").to_numpy(zero_copy_only=False)
                loss, slope = loss_and_gradient(held.value, kinds, _matrix(batch.column("embedding"), kinds["text"][0]), _columns(batch, features), y, weight)
                total += np.concatenate([[loss, weight.sum()], slope])
        if total[1]:
            cut = range(0, len(total), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([k // SLICE for k in cut], pa.int32()), pa.array([total[k : k + SLICE].tobytes() for k in cut], pa.binary())], names=["slice", "part"])

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(p) for p in table.column("part").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([whole.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "slice int, part binary").groupBy("slice").applyInArrow(add, "slice int, part binary")
    out = np.zeros(2 + len(theta))
    for r in parts.toLocalIterator():
        got = np.frombuffer(r["part"])
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(got)] = got
    return out[0], out[1], out[2:]


def _way(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two loops of the limited-memory quasi-Newton direction."""
    q, back = slope.copy(), []
    for s, y in reversed(moves):
        a = (s @ q) / (y @ s)
        back.append(a)
        q -= a * y
    if moves:
        s, y = moves[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(moves, reversed(back)):
        q += (a - (y @ q) / (y @ s)) * s
    return -q


def fit(train: DataFrame, features: list[str], labels: list[str], embedding_dim: int, hidden: int = 64, penalty: float = 1e-3, tol: float = 1e-2, max_iter: int = 300, seed: int = 42) -> BranchedHead:
    """``train`` has ``embedding``, the feature columns, ``label`` and ``weight``, and is stored.

    Ends when the gradient's norm is at most ``tol`` of the one at the start.
    """
    kinds = shapes(embedding_dim, len(features), hidden, len(labels))
    rows = train.select("embedding", *features, "label", "weight")
    theta = start(kinds, seed)
    decays = np.concatenate([np.full(int(np.prod(s)), penalty if len(s) == 2 else 0.0) for s in kinds.values()])

    def value(t: np.ndarray) -> tuple[float, np.ndarray]:
        loss, weight, slope = summed(rows, kinds, features, labels, t)
        return loss / weight + (decays * t) @ t / 2, slope / weight + decays * t

    now, slope = value(theta)
    first, moves, passes = np.linalg.norm(slope), [], 1
    for step in range(1, max_iter + 1):
        way = _way(slope, moves)
        length = 1.0 if moves else min(1.0, 1.0 / first)
        for _ in range(25):
            after, there = value(theta + length * way)
            passes += 1
            if after <= now + 1e-4 * length * (slope @ way):
                break
            length /= 2
        moved, bent = length * way, there - slope
        theta, now, slope = theta + moved, after, there
        if moved @ bent > 1e-12 * (bent @ bent):
            moves = [*moves, (moved, bent)][-MEMORY:]
        if np.linalg.norm(slope) <= tol * first:
            return BranchedHead(labels, features, kinds, theta, step, passes)
    raise RuntimeError(f"gradient at {np.linalg.norm(slope) / first:.2g} of its start after {max_iter} steps: raise max_iter")
