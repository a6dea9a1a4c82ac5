"""Late fusion: a text vector beside scaled numeric features, and a weighted classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from parlance.functions import ngrams
from parlance.operators import branches


def hashed_embedding(df: DataFrame, text: str = "text", dim: int = 256, out: str = "embedding") -> DataFrame:
    """Hashed word counts, standing in where no learned embedding is given."""
    worded = df.withColumn("_words", ngrams.words(F.col(text)))
    return HashingTF(inputCol="_words", outputCol=out, numFeatures=dim).transform(worded).drop("_words")


def dense_embedding(df: DataFrame, column: str = "embedding", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def fit_fusion(
    train: DataFrame,
    features: list[str],
    label: str = "label",
    weight: str | None = "weight",
    head: str = "logistic",
    embedding_dim: int | None = None,
    hidden: int = 64,
    max_iter: int = 500,
    tol: float = 1e-2,
    seed: int = 42,
) -> PipelineModel | branches.BranchedHead:
    """Text vector and features side by side into a classifier; no features means text only.

    Both heads minimise class-weighted cross-entropy. ``head="mlp"`` puts a tanh layer over the
    text and ``hidden`` rectified units over the features before it (``branches``; it needs
    ``embedding_dim``, and ends when the gradient is ``tol`` of the one at the start). A fit that has not converged after ``max_iter`` steps is an error.
    """
    if head == "mlp":
        classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
        rows = train.withColumn("label", F.col(label)).withColumn("weight", F.col(weight) if weight else F.lit(1.0))
        return branches.fit(rows, features, classes, embedding_dim, hidden, tol=tol, max_iter=max_iter, seed=seed)
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    assembler = VectorAssembler(inputCols=["embedding", *features], outputCol="_fused")
    if head == "logistic":
        learner = LogisticRegression(
            featuresCol="_fused", labelCol="_y", family="multinomial", maxIter=max_iter, predictionCol="_p",
            rawPredictionCol="_r", probabilityCol="_q",
        )
        if weight:
            learner = learner.setWeightCol(weight)
    else:
        raise ValueError(f"unknown head {head!r}: logistic or mlp")
    names = IndexToString(inputCol="_p", outputCol="predicted_label", labels=indexer.labels)
    model = Pipeline(stages=[indexer, assembler, learner, names]).fit(train)
    if model.stages[2].summary.totalIterations >= max_iter:
        raise RuntimeError(f"no convergence within {max_iter} iterations: raise max_iter")
    return model


def predict_fusion(model: PipelineModel | branches.BranchedHead, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_y", "_fused", "_r", "_q", "_p")
