"""A linear classifier over embeddings: balanced logistic regression, its scores, and transfer between datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import vectors as vx


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Rows with ``weight``: classes count alike, n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))  # two rows
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return df.join(counts.crossJoin(total), label).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def train(df: DataFrame, vector: str, label: str, strength: float = 1.0, iterations: int = 100) -> tuple[list[float], float]:
    """(weights, bias) of a balanced logistic regression on unit vectors; ``strength`` is the inverse of the L2 penalty a row.

    Rows with a null vector or label are left out. Gradients are summed on the executors; only the weights come back.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(vx.unit(F.col(vector)).alias("__v"), F.col(label).cast("double").alias("label"))
    rows = _weighted(rows, "label").select(array_to_vector("__v").alias("features"), "label", "weight")
    n = rows.count()
    model = LogisticRegression(maxIter=iterations, regParam=1.0 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, weightCol="weight").fit(rows)
    return [float(x) for x in model.coefficients], float(model.intercept)


def probability(vector: Column, weights: list[float], bias: float) -> Column:
    return vx.logistic(vx.dot(vx.unit(vector), F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias)))


def leave_one_out(df: DataFrame, dataset: str, vector: str, label: str, cutoff: float = 0.5) -> DataFrame:
    """(dataset, rows, found, false_alarms): each dataset scored by a classifier trained on the others. Datasets are a handful of names."""
    names = sorted(r[0] for r in df.select(dataset).where(F.col(dataset).isNotNull()).distinct().collect())
    out = None
    for name in names:
        weights, bias = train(df.where(F.col(dataset) != name), vector, label)
        p = probability(F.col(vector), weights, bias) >= cutoff
        one = df.where(F.col(dataset) == name).agg(F.count("*").alias("rows"), F.count_if(p & (F.col(label).cast("double") == 1)).alias("found"), F.count_if(p & (F.col(label).cast("double") == 0)).alias("false_alarms")).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def similarity_floor(df: DataFrame, score: str, benign: Column, fp: float = 0.01, span: float = 0.25) -> DataFrame:
    """One row (floor, ceiling): the similarity at most a share ``fp`` of benign messages exceeds, and one ``span`` above it, at most 1."""
    from lakewarden.operators.evaluation import threshold_at

    t = threshold_at(df, [], score, benign, fp)
    return t.select(F.col("threshold").alias("floor"), F.least(F.col("threshold") + F.lit(span), F.lit(1.0)).alias("ceiling"))


def training_rows(examples: DataFrame, segments: DataFrame, text: str, label: str) -> DataFrame:
    """Messages and their segments as distinct training rows; a text under two labels keeps the stronger one (the larger value)."""
    both = examples.select(text, label).unionByName(segments.select(text, label))
    return both.where(F.col(text).isNotNull()).groupBy(text).agg(F.max(label).alias(label))
