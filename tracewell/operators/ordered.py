"""Ranks, running totals and quantiles that stay distributed when one group is huge.

``row_number() over (partition by group)`` sends a whole group to one task. Here each group is first
cut into ordered buckets; a small table of bucket totals supplies the starting value of every bucket
and the windows only run inside one (group, bucket).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..session import staged

BUCKET = "_bucket"
RANGE = "_range"


def with_running(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    *,
    rank: str | None = None,
    total: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add running columns over ``groups`` ordered by ``order``.

    ``bucket`` must not decrease along ``order`` (not increase when ``descending``) and must be a
    function of the row alone. ``sums``/``maxes`` run up to and including the row, or up to the row
    before it with ``inclusive=False``; ``lags`` is the value of the preceding row, ``totals`` are sums of the group.
    """
    sums, maxes, lags, totals = dict(sums or {}), dict(maxes or {}), dict(lags or {}), dict(totals or {})
    keyed = df.withColumn(BUCKET, bucket)
    keys = [*groups, BUCKET]
    names = [f"_g{i}" for i in range(len(groups))]

    parts = [F.count(F.lit(1)).alias("_n")]
    parts += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    parts += [F.max(c).alias(f"_m_{n}") for n, c in maxes.items()]
    parts += [F.sum(c).alias(f"_w_{n}") for n, c in totals.items()]
    pick = F.min_by if descending else F.max_by
    if lags:
        parts += [pick(F.struct(c.alias("v")), _order_key(order)).alias(f"_l_{n}") for n, c in lags.items()]
    per_bucket = keyed.groupBy(*keys).agg(*parts)

    ordering = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy(ordering).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.col(BUCKET)] + [F.col(g).alias(n) for g, n in zip(groups, names, strict=True)]
    carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    carried.append(F.sum("_n").over(whole).alias("_nt"))
    carried += [F.sum(f"_s_{n}").over(before).alias(f"_s0_{n}") for n in sums]
    carried += [F.max(f"_m_{n}").over(before).alias(f"_m0_{n}") for n in maxes]
    carried += [F.last(f"_l_{n}").over(before).alias(f"_l0_{n}") for n in lags]
    carried += [F.sum(f"_w_{n}").over(whole).alias(f"_w0_{n}") for n in totals]
    offsets = per_bucket.select(*carried).withColumnRenamed(BUCKET, "_b")

    match = F.col(BUCKET).eqNullSafe(F.col("_b"))
    for g, n in zip(groups, names, strict=True):
        match = match & F.col(g).eqNullSafe(F.col(n))
    joined = keyed.join(offsets, match, "left")

    inside = Window.partitionBy(*keys).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((F.col("_n0") + F.row_number().over(inside)).cast("bigint").alias(rank))
    if total:
        out.append(F.col("_nt").cast("bigint").alias(total))
    out += [F.coalesce(F.col(f"_w0_{n}"), F.lit(0).cast("bigint")).alias(n) for n in totals]
    for n, c in sums.items():
        zero = F.lit(0).cast("bigint")
        out.append((F.coalesce(F.col(f"_s0_{n}"), zero) + F.coalesce(F.sum(c).over(frame), zero)).alias(n))
    for n, c in maxes.items():
        out.append(F.greatest(F.col(f"_m0_{n}"), F.max(c).over(frame)).alias(n))
    for n, c in lags.items():
        previous = F.lag(F.struct(c.alias("v"))).over(inside)
        out.append(F.coalesce(previous, F.col(f"_l0_{n}")).getField("v").alias(n))
    return joined.select(*out)


def in_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = RANGE) -> DataFrame:
    """Rows with the number of the range of (groups, order) they lie in, for use as the bucket of ``with_running``.

    The boundaries are sampled over the full sort key, so ids with a long common prefix or few groups are cut as
    evenly as any, and their number follows ``spark.sql.shuffle.partitions``. Writing the rows fixes the ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(ranges, *groups, *order).withColumn(name, F.spark_partition_id()), "ranges")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a single-row aggregate (broadcast of exactly one row)."""
    keyed = F.broadcast(one_row.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(keyed, "_one").drop("_one")


def _order_key(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def hash_rank(
    df: DataFrame,
    groups: Sequence[str],
    digest: Column,
    tie: Sequence[Column],
    *,
    rank: str = "rank",
    total: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """1-based rank by a hex digest inside each group; the digest's leading digits are the buckets."""
    with_hash = df.withColumn("_h", digest)
    ranked = with_running(
        with_hash,
        groups,
        F.left(F.col("_h"), F.lit(digits)),
        [F.col("_h"), *tie],
        rank=rank,
        total=total,
    )
    return ranked.drop("_h")


def distinct_running(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Mapping[str, Column],
    *,
    descending: bool = False,
    inclusive: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """One row per (keys, value) with each measure, its running sum ``cum_*`` and group total ``all_*``.

    Equal values are combined before the shuffle, so a value shared by a third of the rows is one row.
    """
    if buckets is None:
        buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = list(measures)
    merged = df.groupBy(*keys, value).agg(*[F.sum(c).cast("bigint").alias(n) for n, c in measures.items()])
    # One mergeable sketch per key gives bucket boundaries (they only affect balance) beside the totals.
    probabilities = [i / max(buckets, 2) for i in range(1, max(buckets, 2))]
    stats = merged.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, probabilities, 2000)).alias("_bounds"),
        *[F.sum(n).cast("bigint").alias(f"all_{n}") for n in names],
    )
    placed = merged.join(stats, list(keys)) if keys else with_scalars(merged, stats)
    placed = placed.withColumn(
        "_slot", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))
    ).drop("_bounds")
    # A sketch depends on the order in which its parts come, and the slots are read twice: writing the rows fixes them.
    placed = staged(placed, "slots")
    order = F.col(value).desc() if descending else F.col(value).asc()
    ran = with_running(
        placed,
        keys,
        F.col("_slot"),
        [order],
        sums={f"cum_{n}": F.col(n) for n in names},
        descending=descending,
        inclusive=inclusive,
    )
    return ran.drop("_slot")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, steps: int, *, buckets: int | None = None
) -> DataFrame:
    """Exact linear quantiles at i/steps, i = 0..steps, per key, without gathering a group.

    Each distinct value knows the ranks it covers, hence which quantile positions fall on it.
    """
    if not keys:
        return exact_quantiles(
            df.withColumn("_all", F.lit(1)), ["_all"], value, steps, buckets=buckets
        ).drop("_all")
    rows = distinct_running(
        df.where(F.col(value).isNotNull()), keys, value, {"n": F.lit(1)}, buckets=buckets
    )
    first = F.col("cum_n") - F.col("n")
    last = F.col("cum_n") - 1
    span = F.greatest(F.col("all_n") - 1, F.lit(1))
    grid = F.sequence(F.lit(0), F.lit(steps))

    def touching(side: str) -> DataFrame:
        place = (lambda i: F.floor(i * span / F.lit(steps))) if side == "lo" else (
            lambda i: F.ceil(i * span / F.lit(steps))
        )
        capped = lambda i: F.least(place(i), F.col("all_n") - 1)
        hits = F.filter(grid, lambda i: (capped(i) >= first) & (capped(i) <= last))
        return rows.select(*keys, F.explode(hits).alias("step"), F.col(value).alias(side), "all_n")

    low, high = touching("lo"), touching("hi").drop("all_n")
    both = low.join(high, [*keys, "step"])
    place = F.col("step") * F.greatest(F.col("all_n") - 1, F.lit(1)) / F.lit(steps)
    weight = F.when(F.col("all_n") == 1, F.lit(0.0)).otherwise(place - F.floor(place))
    return both.select(
        *keys,
        (F.col("step") / F.lit(steps)).alias("q"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias("quantile"),
    )


def values_at(
    parts: DataFrame, keys: Sequence[str], part: str, values: str, places: Mapping[str, Callable[[Column], Column]],
    count: str | None = None,
) -> DataFrame:
    """(keys, part, a column a place): the values of a group at 0-based ranks, which are functions of its number of values.

    A group's values lie in arrays of its rows. Samples of every sorted array, weighted by the values up to the one before
    or to the one after, bound the ranks from both sides; only the values between the bounds are moved. Of an array of m
    values about root(2 m) are sampled and as many lie between the bounds. The result goes to the parts of a group, one
    row each. Rows with a null key have none.
    """
    m = F.size("_v")
    grid = let(F.ceil(F.sqrt(2 * m)).cast("int"), lambda k: F.array_distinct(
        F.transform(F.sequence(F.lit(0), k), lambda j: F.floor(j * (m - 1) / k).cast("int"))
    ))
    ordered = parts.select(*keys, part, F.sort_array(values).alias("_v")).where(m > 0)
    sampled = ordered.select(*keys, "_v", grid.alias("_at")).select(*keys, F.inline_outer(F.transform("_at", lambda p, j: F.struct(
        F.get("_v", p).alias("v"),
        (p - F.when(j == 0, F.lit(-1)).otherwise(F.get("_at", j - 1))).alias("up"),
        (F.when(j == F.size("_at") - 1, F.size("_v")).otherwise(F.get("_at", j + 1)) - p).alias("down"),
    ))))
    ran = distinct_running(sampled, keys, "v", {"up": F.col("up"), "down": F.col("down")})
    lowest = F.least(*[at(F.col("all_up")) for at in places.values()] * 2)
    highest = F.greatest(*[at(F.col("all_up")) for at in places.values()] * 2)
    bounds = ran.groupBy(*keys).agg(
        F.max(F.when(F.col("all_down") - F.col("cum_down") + F.col("down") >= F.col("all_down") - lowest, F.col("v"))).alias("_lo"),
        F.min(F.when(F.col("cum_up") > highest, F.col("v"))).alias("_hi"), F.max("all_up").alias("_n"),
    )
    spots = parts.select(*keys, part).distinct()
    between = staged(
        ordered.join(spots.join(bounds, list(keys)), [*keys, part]).select(
            *keys, "_n", let(F.col("_lo"), lambda lo: F.size(F.filter("_v", lambda v: v < lo))).alias("_below"),
            let(F.struct("_lo", "_hi"), lambda b: F.filter("_v", lambda v: (v >= b["_lo"]) & (v <= b["_hi"]))).alias("_v"),
        ), "between",
    )
    below = between.groupBy(*keys).agg(F.sum("_below").alias("_below"), F.max("_n").alias("_n"))
    counted = distinct_running(between.select(*keys, F.explode("_v").alias("v")), keys, "v", {"n": F.lit(1)}).join(below, list(keys))
    upto = F.col("_below") + F.col("cum_n")
    found = counted.groupBy(*keys).agg(
        *[F.max(F.when((upto > at(F.col("_n"))) & (upto - F.col("n") <= at(F.col("_n"))), F.col("v"))).alias(name) for name, at in places.items()],
        *([F.max("_n").alias(count)] if count else []),
    )
    return spots.join(found, list(keys))
