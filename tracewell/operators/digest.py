"""Digests of tables in a given order, without any place that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .ordered import RANGE, in_ranges, with_running

RUN_BITS = 10  # 1024 digests of 64 characters are hashed together


def row_digest(*columns: Column) -> Column:
    """SHA-256 of fields in order: each as length, colon and text, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def ordered_digest(df: DataFrame, order: Sequence[str], digest: Column, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, rows, content_digest): a hash tree over the rows' digests in the order of ``order``, then of the digest.

    Rows are numbered by ranges of the sort key. Runs of 1024 consecutive digests are hashed together, as are the
    runs' digests, until one is left. Runs go by number, so the digest is the same whatever the partitions; it changes
    with any row, with their order and with their number. No row, no digest.
    """
    keys = list(groups)
    plain = df.select(*keys, *[c for c in order if c not in keys], digest.alias("_digest"))
    ordering = [c for c in order if c not in keys]
    ranged = in_ranges(plain, keys, [*ordering, "_digest"])
    placed = with_running(ranged, keys, F.col(RANGE), [F.col(c) for c in (*ordering, "_digest")], rank="_at", total="_all")
    live = placed.select(*keys, (F.col("_at") - 1).alias("_at"), F.col("_all").alias("rows"), "_all", "_digest")
    finished = None
    while True:
        run = F.sort_array(F.collect_list(F.struct("_at", "_digest")))
        hashed = F.sha2(F.array_join(F.transform(run, lambda x: x["_digest"]), ""), 256)
        above = live.groupBy(*keys, "rows", "_all", F.shiftright("_at", RUN_BITS).alias("_run")).agg(hashed.alias("_digest"))
        above = staged(
            above.select(*keys, F.col("_run").alias("_at"), "rows", F.shiftright(F.col("_all") + (1 << RUN_BITS) - 1, RUN_BITS).alias("_all"), "_digest"),
            "digest-runs",
        )
        done = above.where("_all = 1").select(*keys, "rows", F.col("_digest").alias("content_digest"))
        finished = done if finished is None else finished.unionByName(done)
        live = above.where("_all > 1")
        if live.isEmpty():
            return finished
