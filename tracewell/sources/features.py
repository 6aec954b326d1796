"""Store of feature arrays: views of a document's tokens with masks and offsets, each document under its digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash


def _parts(views: Sequence[str]) -> list[str]:
    return [f"{v}_{part}" for v in views for part in ("values", "mask", "offsets")]


def feature_digest(views: Sequence[str]) -> Column:
    return content_hash(**{c: F.col(c) for c in _parts(views)})


def _finite(values: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.forall(values, lambda row: F.forall(row, number))


def save_features(df: DataFrame, path: str, views: Sequence[str], key: str = "document_id") -> DataFrame:
    """Write a row per document with its digest; the manifest (key, feature_sha256) of what was written.

    Every view ``v`` has ``v_values`` (a vector per token), ``v_mask`` and ``v_offsets`` ([start, end] per token, [-1, -1]
    for none). Values that are not finite fail the write; an existing store is never overwritten.
    """
    checks = [
        F.when(_finite(F.col(f"{v}_values")), F.col(f"{v}_values")).otherwise(
            F.raise_error(F.concat(F.lit(f"values of view {v} are not finite: "), F.col(key).cast("string")))
        ).alias(f"{v}_values")
        for v in views
    ]
    rest = [F.col(c) for c in _parts(views) if not c.endswith("_values")]
    rows = df.select(key, *checks, *rest).withColumn("feature_sha256", feature_digest(views))
    rows.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path).select(key, "feature_sha256")


def load_features(
    spark: SparkSession, path: str, manifest: DataFrame, views: Sequence[str], key: str = "document_id"
) -> DataFrame:
    """Verified documents: key, v_values per view, valid_mask, offsets and violation (null where all holds).

    Digests are worked out again where the rows are read. The checks in order: ``missing`` (in the manifest alone),
    ``hash_mismatch`` (arrays against the manifest's digest), ``inconsistent_offsets`` between views,
    ``not_aligned`` lengths, ``not_finite``. Documents of the store that the manifest does not name are left out.
    """
    kinds = spark.read.parquet(path).schema
    stored = spark.read.schema(kinds).parquet(path).withColumn("_now", feature_digest(views)).drop("feature_sha256")
    expected = manifest.select(key, F.col("feature_sha256").alias("_want"))
    rows = expected.join(stored, key, "left")
    first = F.col(f"{views[0]}_offsets")
    same_offsets, aligned, finite = F.lit(True), F.lit(True), F.lit(True)
    valid = F.col(f"{views[0]}_mask")
    for v in views:
        same_offsets = same_offsets & F.col(f"{v}_offsets").eqNullSafe(first)
        for part in ("values", "mask"):
            aligned = aligned & F.size(f"{v}_{part}").eqNullSafe(F.size(first))
        finite = finite & F.coalesce(_finite(F.col(f"{v}_values")), F.lit(False))
    for v in views[1:]:
        valid = F.zip_with(valid, F.col(f"{v}_mask"), lambda a, b: a & b)
    violation = (
        F.when(F.col("_now").isNull(), "missing").when(~F.col("_now").eqNullSafe(F.col("_want")), "hash_mismatch")
        .when(~same_offsets, "inconsistent_offsets").when(~aligned, "not_aligned").when(~finite, "not_finite")
    )
    return rows.select(
        key, *[f"{v}_values" for v in views], valid.alias("valid_mask"), first.alias("offsets"), violation.alias("violation")
    )


def require_verified(features: DataFrame, key: str = "document_id") -> DataFrame:
    """The documents, or an error at the first one with a violation."""
    told = F.concat(F.col("violation"), F.lit(": "), F.col(key).cast("string"))
    checked = F.when(F.col("violation").isNull(), F.col("violation")).otherwise(F.raise_error(told))
    return features.withColumn("violation", checked.cast("string"))
