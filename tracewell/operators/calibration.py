"""Null pools of maxima and empirical p-values against them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import content_hash
from ..schemas import ROUTES
from ..session import staged
from .digest import ordered_digest, row_digest
from .ordered import RANGE, distinct_running, in_ranges, with_running, with_scalars

POOL_KEYS = ("pool", "route", "stratum")


def language_stratum(language: Column | str = "language") -> Column:
    return F.concat(F.col(language) if isinstance(language, str) else language, F.lit(":all"))


def best_strengths(rows: DataFrame) -> DataFrame:
    """Rows with the largest strength of their array of ``tests``; null without any."""
    return rows.withColumn("best_strength", F.array_max(F.transform("tests", lambda t: t["strength"])))


def document_maxima(documents: DataFrame, segments: DataFrame, evidence_max: DataFrame) -> DataFrame:
    """Three route maxima per document.

    ``documents``: one row per (pool, document) with ``generic_max`` (0 without candidates);
    ``segments``: candidates with ``raw_score`` and ``best_strength``; ``evidence_max``: largest strength
    per (pool, document). Without candidates the gap is minus the registered maximum.
    """
    keys = ["pool", "document_id"]
    gaps = segments.groupBy(*keys).agg(
        F.max(F.col("raw_score") - F.coalesce("best_strength", F.lit(0.0))).alias("gap_max")
    )
    joined = documents.join(evidence_max, keys, "left").join(gaps, keys, "left")
    registered = F.coalesce("registered_max", F.lit(0.0))
    routes = F.array(
        *[
            F.struct(F.lit(route).alias("route"), value.alias("maximum_statistic"))
            for route, value in (
                ("generic", F.coalesce("generic_max", F.lit(0.0))),
                ("registered", registered),
                ("gap", F.coalesce("gap_max", -registered)),
            )
        ]
    )
    kept = [c for c in documents.columns if c != "generic_max"]
    return joined.select(*kept, F.inline(routes))


def parent_pool(records: DataFrame, *, minimum_parents: int = 1) -> DataFrame:
    """Largest statistic per parent over its null descendants; strata below the minimum are left out."""
    per_parent = records.groupBy(*POOL_KEYS, "parent_id").agg(
        F.max("maximum_statistic").alias("maximum_statistic")
    )
    enough = per_parent.groupBy(*POOL_KEYS).agg(F.count(F.lit(1)).alias("parents")).where(
        F.col("parents") >= minimum_parents
    )
    return per_parent.join(enough.select(*POOL_KEYS), list(POOL_KEYS), "left_semi")


def pool_violations(records: DataFrame, *, minimum_parents: int) -> DataFrame:
    """Why records cannot become a parent pool, one row per (violation, subject)."""
    bad_row = (
        F.when(~F.col("split").eqNullSafe(F.lit("calibration")), "not_calibration")
        .when(~F.col("route").isin(*ROUTES), "unsupported_route")
        .when(F.coalesce("parent_id", F.lit("")) == "", "missing_parent")
        .when(
            F.col("maximum_statistic").isNull() | F.isnan("maximum_statistic")
            | (F.abs("maximum_statistic") == float("inf")),
            "not_finite",
        )
    )
    rows = records.select(bad_row.alias("violation"), F.col("document_id").alias("subject")).where(
        F.col("violation").isNotNull()
    )
    crossing = (
        records.groupBy("parent_id").agg(F.min("stratum").alias("_a"), F.max("stratum").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
        .select(F.lit("parent_crosses_strata").alias("violation"), F.col("parent_id").alias("subject"))
    )
    per_parent = records.groupBy("pool", "stratum", "parent_id").agg(
        *[F.max(F.when(F.col("route") == r, 1).otherwise(0)).alias(r) for r in ROUTES]
    )
    sizes = per_parent.groupBy("pool", "stratum").agg(
        *[F.sum(r).alias(r) for r in ROUTES], F.count(F.lit(1)).alias("_n")
    )
    label = F.concat_ws(":", "pool", "stratum")
    small = sizes.select(
        label.alias("subject"),
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(F.col(r) < minimum_parents, F.lit(f"too_few_parents_{r}"))
                        for r in ROUTES
                    ],
                    F.when(
                        (F.col("generic") != F.col("_n")) | (F.col("registered") != F.col("_n"))
                        | (F.col("gap") != F.col("_n")),
                        F.lit("parent_sets_differ"),
                    ),
                )
            )
        ).alias("violation"),
    ).select("violation", "subject")
    return rows.unionByName(crossing).unionByName(small).distinct()


def pool_summary(pool: DataFrame) -> DataFrame:
    """Pool size, smallest reachable p-value and value range per route and stratum."""
    return pool.groupBy(*POOL_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("minimum_p"),
        F.min("maximum_statistic").alias("lowest"),
        F.max("maximum_statistic").alias("highest"),
    )


def document_pool(records: DataFrame) -> DataFrame:
    """Pool without collapsing parents: every null document counts."""
    return records.select(*POOL_KEYS, "document_id", "maximum_statistic")


def tail_p(
    observed: DataFrame, pool: DataFrame, keys: Sequence[str], *, value: str, statistic: str = "maximum_statistic",
    lower: bool = False,
) -> DataFrame:
    """Smoothed empirical p per distinct observed value: (1 + nulls at least as extreme) / (n + 1).

    Both sides shrink to distinct values first; the running count goes over ordered buckets of a
    stratum, never over a whole stratum in one task. Values of an unknown stratum get no row.
    """
    nulls = pool.select(*keys, F.col(statistic).alias(value), F.lit(1).alias("_null"))
    seen = observed.select(*keys, value).where(F.col(value).isNotNull()).distinct().withColumn("_null", F.lit(0))
    counted = distinct_running(
        nulls.unionByName(seen), keys, value, {"null_n": F.col("_null")}, descending=not lower
    )
    return counted.where(F.col("all_null_n") > 0).select(
        *keys, value, ((F.col("cum_null_n") + 1) / (F.col("all_null_n") + 1)).alias("p_value")
    )


def significance_bounds(
    pool: DataFrame, keys: Sequence[str], *, alpha: float, statistic: str = "maximum_statistic"
) -> DataFrame:
    """What a statistic must exceed for an empirical p of at most ``alpha``: one row per stratum.

    ``bound`` is the largest null value whose own p is above ``alpha`` (null if there is none), ``reachable`` says whether
    a statistic beyond all nulls gets there. As p never grows with the statistic, the comparison says what p would say.
    """
    nulls = pool.select(*keys, F.col(statistic).alias("_value"), F.lit(1).alias("_null"))
    counted = distinct_running(nulls, keys, "_value", {"null_n": F.col("_null")}, descending=True)
    own = (F.col("cum_null_n") + 1) / (F.col("all_null_n") + 1)
    return counted.groupBy(*keys).agg(
        F.max(F.when(own > alpha, F.col("_value"))).alias("bound"),
        (F.lit(1) / (F.max("all_null_n") + 1) <= alpha).alias("reachable"),
    )


def beyond_bound(value: Column) -> Column:
    """Whether ``value`` has a p of at most alpha by the columns ``bound`` and ``reachable``; null without a pool."""
    return F.col("reachable") & (F.col("bound").isNull() | (value > F.col("bound")))


def attach_p(
    df: DataFrame, pool: DataFrame, keys: Mapping[str, Column], *, value: str, out: str, lower: bool = False,
    statistic: str = "maximum_statistic",
) -> DataFrame:
    """Add ``out``: the empirical p of ``value`` (null when its stratum has no pool, or without a value).

    The pool becomes a run-length distribution, one row per distinct value with its count. Rows and runs are dealt
    together into ranges of (keys, value, hash of the row) and each row takes the count of the runs before it: those of
    its own range by a running sum, those of earlier ranges from a table of one row per key and range. Nothing is
    joined by value, so a value that a third of all rows share is cut into as many ranges as it fills.
    """
    names = {k: f"_k_{k}" for k in keys}
    order = F.col("_value") if lower else -F.col("_value")
    seen = df.withColumn("_value", F.col(value)).select(
        F.struct(*df.columns).alias("_row"), *[c.alias(names[k]) for k, c in keys.items()], order.alias("_order"),
        F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_n"), F.xxhash64(*df.columns).alias("_salt"),
    )
    runs = pool.where(F.col(statistic).isNotNull()).groupBy(*keys, F.col(statistic).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    runs = runs.select(
        F.lit(None).cast(seen.schema["_row"].dataType).alias("_row"), *[F.col(k).alias(n) for k, n in names.items()],
        order.alias("_order"), F.lit(0).alias("_kind"), "_n", F.lit(0).cast("bigint").alias("_salt"),
    )
    ranged = in_ranges(seen.unionByName(runs), list(names.values()), ["_order", "_kind", "_salt"])
    ran = with_running(
        ranged, list(names.values()), F.col(RANGE), [F.col("_order"), F.col("_kind")], sums={"_cum": F.col("_n")},
        totals={"_all": F.col("_n")},
    )
    p = F.when((F.col("_all") > 0) & F.col("_order").isNotNull(), (F.col("_cum") + 1) / (F.col("_all") + 1))
    return ran.where("_kind = 1").select("_row.*", p.alias(out))


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def compatibility_hash(header: DataFrame) -> DataFrame:
    """Header with the hash two pools must share to be interchangeable (ids and data hash left out)."""
    fields = (
        "protocol_version", "search_config_hash", "registered_registry_hash", "normalization_version",
        "model_version", "languages", "strata",
    )
    return header.withColumn("compatibility_hash", content_hash(**{f: F.col(f) for f in fields}))


def pool_digest(pool: DataFrame) -> DataFrame:
    """One row: number of rows and digest of a pool's values in the order of its columns."""
    columns = sorted(pool.columns)
    return ordered_digest(pool, columns, row_digest(*[F.col(c) for c in columns]))


def save_pool(pool: DataFrame, header: DataFrame, path: str) -> None:
    """Write pool values by route and stratum with a one-row header; never overwrites.

    The header has the values' schema, number and digest. Values are dealt by ranges, so a large stratum is many files.
    """
    pool = staged(pool, "pool-values")
    columns = sorted(pool.columns)
    ordered = pool.repartitionByRange("route", "stratum", "maximum_statistic", F.xxhash64(*columns))
    ordered = ordered.sortWithinPartitions("route", "stratum", "maximum_statistic")
    ordered.write.mode("errorifexists").partitionBy("route", "stratum").parquet(f"{path}/values")
    sums = pool_digest(pool).select(F.col("rows").alias("value_rows"), F.col("content_digest").alias("values_sha256"))
    told = with_scalars(compatibility_hash(header), sums.agg(
        F.coalesce(F.max("value_rows"), F.lit(0)).alias("value_rows"), F.max("values_sha256").alias("values_sha256")
    )).withColumn("values_schema", F.lit(pool.schema.json()))
    told.write.mode("errorifexists").json(f"{path}/header")


def load_pool(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Read a saved pool, whose values must have the digest they were saved with.

    With ``expected``, a pool whose header is not compatible is refused as well.
    """
    header = spark.read.json(f"{path}/header").first()
    schema = StructType.fromJson(json.loads(header["values_schema"]))
    values = spark.read.schema(schema).parquet(f"{path}/values").select(*schema.names)
    if expected is not None:
        want = compatibility_hash(expected).first()["compatibility_hash"]
        if want != header["compatibility_hash"]:
            raise ValueError("calibration pool is not compatible with this run")
    now = pool_digest(values).first()
    have = (now["rows"], now["content_digest"]) if now else (0, None)
    if have != (header["value_rows"], header["values_sha256"] if "values_sha256" in header else None):
        raise ValueError("calibration pool does not have the checksum of its header")
    return values
