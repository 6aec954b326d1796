"""Out-of-distribution scores, class prototypes, Mahalanobis distance and MLlib classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import array_sum, let
from ..session import ensure_checkpoint_dir
from .ordered import with_scalars


def softmax(logits: Column) -> Column:
    def shifted(x: Column) -> Column:
        return let(
            F.transform(x["v"], lambda v: F.exp(v - x["m"])),
            lambda e: let(F.struct(e.alias("e"), array_sum(e, F.lit(0.0)).alias("s")),
                          lambda z: F.transform(z["e"], lambda v: v / z["s"])),
        )

    return let(F.struct(logits.alias("v"), F.array_max(logits).alias("m")), shifted)


def softmax_ood(logits: Column) -> Column:
    """One minus the largest softmax probability."""
    return 1.0 - F.array_max(softmax(logits))


def energy_ood(logits: Column, temperature: float = 1.0) -> Column:
    """Negative scaled log-sum-exp of the logits."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    scaled = F.transform(logits, lambda v: v / F.lit(float(temperature)))
    value = let(
        F.struct(scaled.alias("v"), F.array_max(scaled).alias("m")),
        lambda x: x["m"] + F.log(array_sum(F.transform(x["v"], lambda v: F.exp(v - x["m"])), F.lit(0.0))),
    )
    return F.lit(-float(temperature)) * value


def argmax_class(logits: Column, *, floor: float | None = None) -> Column:
    """1-based position of the largest logit (first on ties); 0 where all fall below ``floor``."""
    best = F.array_position(logits, F.array_max(logits)).cast("int")
    return best if floor is None else F.when(F.array_max(logits) < floor, 0).otherwise(best)


def centroids(df: DataFrame, *, label: str, vector: str) -> DataFrame:
    """Mean vector per label, averaged dimension by dimension with map-side combine."""
    long = df.select(label, F.posexplode(vector).alias("_d", "_v"))
    means = long.groupBy(label, "_d").agg(F.avg("_v").alias("_m"))
    # One entry per dimension.
    ordered = F.array_sort(F.collect_list(F.struct("_d", "_m")))
    return means.groupBy(label).agg(F.transform(ordered, lambda x: x["_m"]).alias("centroid"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0)))


def nearest_prototype(df: DataFrame, prototypes: DataFrame, *, vector: str, label: str) -> DataFrame:
    """Distance to the nearest prototype and its label (lowest label on ties).

    Prototypes are one row per class; they travel as a single broadcast array.
    """
    packed = prototypes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("_p"))
    distances = F.transform(
        "_p", lambda p: F.struct(euclidean(F.col(vector), p["c"]).alias("d"), p["l"].alias("l"))
    )
    best = with_scalars(df, packed).withColumn("_best", F.array_min(distances))
    return best.withColumns({"distance": F.col("_best.d"), "nearest": F.col("_best.l")}).drop("_best", "_p")


class Mahalanobis:
    """Class means with the inverse of the pooled within-class covariance.

    Fitting reduces every partition to per-class sums and one d x d moment matrix; only those d x d
    numbers are combined and inverted on the driver.
    """

    def __init__(self, labels: list, means: np.ndarray, precision: np.ndarray) -> None:
        self.labels, self.means, self.precision = labels, means, precision

    @classmethod
    def fit(cls, df: DataFrame, *, label: str, vector: str, ridge: float = 1e-5) -> "Mahalanobis":
        means = {r[label]: np.asarray(r["centroid"]) for r in centroids(df, label=label, vector=vector).collect()}
        labels = sorted(means)
        if len(labels) < 2:
            raise ValueError("at least two classes are needed")
        table = {k: v for k, v in means.items()}

        def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, outer, n = None, None, 0
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch[vector].to_numpy()).astype(np.float64)
                x = x - np.stack([table[k] for k in batch[label]])
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                outer = x.T @ x if outer is None else outer + x.T @ x
                n += len(x)
            if n:
                d = len(total)
                yield pd.DataFrame({"row": range(-1, d), "n": n, "values": [total.tolist(), *outer.tolist()]})

        parts = df.select(label, vector).mapInPandas(moments, "row int, n bigint, values array<double>")
        cells = parts.select("row", "n", F.posexplode("values").alias("at", "v")).groupBy("row", "at").agg(
            F.sum("v").alias("v"), F.sum("n").alias("n")
        )
        got = cells.collect()  # (d + 1) x d numbers
        d = max(r["at"] for r in got) + 1
        total, outer, n = np.zeros(d), np.zeros((d, d)), 0
        for r in got:
            n = int(r["n"])
            if r["row"] < 0:
                total[r["at"]] = r["v"]
            else:
                outer[r["row"], r["at"]] = r["v"]
        covariance = (outer - np.outer(total, total) / n) / (n - 1) + ridge * np.eye(d)
        return cls(labels, np.stack([means[k] for k in labels]), np.linalg.pinv(covariance))

    def score(self, df: DataFrame, *, vector: str) -> DataFrame:
        """Add the smallest class distance and the class that attains it."""
        means, precision, labels = self.means, self.precision, self.labels
        out = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("nearest", T.LongType())])

        @F.pandas_udf(out)
        def measure(v: pd.Series) -> pd.DataFrame:
            x = np.stack(v.to_numpy()).astype(np.float64)
            gaps = x[:, None, :] - means[None, :, :]
            squared = np.einsum("nkd,df,nkf->nk", gaps, precision, gaps)
            best = squared.argmin(axis=1)
            return pd.DataFrame(
                {"distance": np.sqrt(np.clip(squared.min(axis=1), 0.0, None)), "nearest": [int(labels[i]) for i in best]}
            )

        return df.withColumn("_m", measure(F.col(vector))).select("*", "_m.distance", "_m.nearest").drop("_m")


def _prepared(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.withColumns(
        {"features_raw": array_to_vector(F.col(vector).cast("array<double>")), "label": F.col(label).cast("double")}
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Row weight n / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = with_scalars(sizes, whole).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def fit_logistic(df: DataFrame, *, vector: str, label: str, iterations: int = 2000):
    """Standardised, class-balanced multinomial logistic regression as a saveable pipeline model.

    The penalty is that of a unit inverse strength summed over rows, i.e. 1 / n on Spark's mean loss.
    """
    rows = _prepared(balanced_weights(df, label), vector, label)
    penalty = 1.0 / df.count()
    scaler = StandardScaler(withMean=True, inputCol="features_raw", outputCol="features")
    model = LogisticRegression(maxIter=iterations, regParam=penalty, weightCol="weight", standardization=False)
    return Pipeline(stages=[scaler, model]).fit(rows)


def fit_perceptron(df: DataFrame, *, vector: str, label: str, inputs: int, classes: int, hidden: int = 128,
                   iterations: int = 500, seed: int = 20260815):
    """One hidden layer on standardised features."""
    scaler = StandardScaler(withMean=True, inputCol="features_raw", outputCol="features")
    model = MultilayerPerceptronClassifier(layers=[inputs, hidden, classes], maxIter=iterations, seed=seed)
    return Pipeline(stages=[scaler, model]).fit(_prepared(df, vector, label))


def fit_boosted_trees(df: DataFrame, *, vector: str, label: str, classes: int = 2, trees: int = 300, depth: int = 4,
                      step: float = 0.05, subsample: float = 0.8, seed: int = 20260813):
    """Gradient-boosted trees; one-versus-rest beyond two classes.

    Each round builds on the last, so lineage is cut by a checkpoint every ten rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tree = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed,
        featuresCol="features_raw", featureSubsetStrategy="0.8", checkpointInterval=10,
    )
    model = tree if classes == 2 else OneVsRest(classifier=tree, featuresCol="features_raw")
    return Pipeline(stages=[model]).fit(_prepared(df, vector, label))


def predict(model, df: DataFrame, *, vector: str, label: str) -> DataFrame:
    return model.transform(_prepared(df, vector, label)).withColumn("predicted", F.col("prediction").cast("int"))
