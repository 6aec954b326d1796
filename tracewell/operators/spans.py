"""Candidate spans from per-character scores, and interval algebra.

A document's scores travel as one array in its row, so the whole multi-scale search is a narrow
projection: no shuffle, and documents spread over tasks as the scan splits them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import array_sum, higher_quantile, let, linear_quantile
from ..schemas import CANDIDATE_QUANTILE, MERGE_GAP, STRIDE_FRACTION, WINDOW_LENGTHS


def stride_of(length: int, fraction: float) -> int:
    return max(1, int(round(length * fraction)))


def _zero(integral: bool) -> Column:
    return F.lit(0).cast("bigint") if integral else F.lit(0.0)


def _scale_windows(
    scores: Column, blocks: Column, n: Column, length: int, stride: int, step: int, quantile: float,
    integral: bool,
) -> Column:
    """Windows of one length whose mean reaches the per-scale threshold; [] for shorter texts."""
    zero = _zero(integral)
    per = length // step
    jump = stride // step
    regular = F.transform(
        F.sequence(F.lit(0), F.floor((n - length) / stride).cast("int")),
        lambda j: F.struct(
            (j * stride).alias("char_start"),
            array_sum(F.slice(blocks, j * jump + 1, per), zero).alias("total"),
        ),
    )
    tail = F.when(
        (n - length) % stride != 0,
        F.array(
            F.struct(
                (n - length).alias("char_start"),
                array_sum(F.slice(scores, n - length + 1, length), zero).alias("total"),
            )
        ),
    ).otherwise(F.array().cast(f"array<struct<char_start:int,total:{'bigint' if integral else 'double'}>>"))
    kept = let(
        F.concat(regular, tail),
        lambda w: let(
            higher_quantile(w["total"], quantile),
            lambda cut: F.transform(
                F.filter(w, lambda x: x["total"] >= cut),
                lambda x: F.struct(
                    x["char_start"].alias("char_start"),
                    (x["char_start"] + length).alias("char_end"),
                    F.lit(length).alias("scale"),
                    (x["total"] / F.lit(float(length))).alias("mean"),
                ),
            ),
        ),
    )
    return F.when(n >= length, kept).otherwise(_no_windows())


def _no_windows() -> Column:
    return F.array().cast("array<struct<char_start:int,char_end:int,scale:int,mean:double>>")


def raw_windows(
    scores: Column,
    *,
    integral: bool,
    window_lengths: Sequence[int] = WINDOW_LENGTHS,
    stride_fraction: float = STRIDE_FRACTION,
    quantile: float = CANDIDATE_QUANTILE,
) -> Column:
    """Windows of every scale at or above that scale's 'higher' quantile, in (scale, start) order.

    ``scores`` should be a bound lambda variable (see ``let``): it is read in several places.

    Block sums at the common divisor of all lengths and strides serve every window, so a character is
    read once; only the end-aligned last window of each scale goes back to the characters.
    """
    if not 0.0 < stride_fraction <= 1.0 or not 0.0 <= quantile <= 1.0:
        raise ValueError("stride_fraction must lie in (0, 1] and quantile in [0, 1]")
    lengths = sorted({int(v) for v in window_lengths if int(v) >= 1})
    strides = [stride_of(v, stride_fraction) for v in lengths]
    step = math.gcd(*lengths, *strides)
    zero = _zero(integral)

    def search(s: Column) -> Column:
        n = F.size(s)
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(n / step).cast("int") - 1),
            lambda b: array_sum(F.slice(s, b * step + 1, step), zero),
        )
        return let(
            blocks,
            lambda bl: F.concat(
                *[
                    _scale_windows(s, bl, n, length, stride, step, quantile, integral)
                    for length, stride in zip(lengths, strides, strict=True)
                ]
            ),
        )

    return F.when(F.size(scores) >= lengths[0], search(scores)).otherwise(_no_windows())


_MERGED = "array<struct<char_start:int,char_end:int,scale:int,mean:double,lead:int>>"


def merge_windows(windows: Column, gap: int = MERGE_GAP) -> Column:
    """Merge windows at most ``gap`` apart; each merged span keeps its best window's scale and mean.

    On equal means the smaller scale, then the earlier start wins.
    """
    if gap < 0:
        raise ValueError("gap cannot be negative")

    def item(w: Column) -> Column:
        return F.struct(
            w["char_start"].alias("char_start"), w["char_end"].alias("char_end"),
            w["scale"].alias("scale"), w["mean"].alias("mean"), w["char_start"].alias("lead"),
        )

    def absorb(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        better = (w["mean"] > last["mean"]) | (
            (w["mean"] == last["mean"])
            & ((w["scale"] < last["scale"]) | ((w["scale"] == last["scale"]) & (w["char_start"] < last["lead"])))
        )
        pick = lambda new, old: F.when(better, new).otherwise(old)
        joined = F.struct(
            last["char_start"].alias("char_start"),
            F.greatest(last["char_end"], w["char_end"]).alias("char_end"),
            pick(w["scale"], last["scale"]).alias("scale"),
            pick(w["mean"], last["mean"]).alias("mean"),
            pick(w["char_start"], last["lead"]).alias("lead"),
        )
        touches = w["char_start"] <= last["char_end"] + gap
        return (
            F.when(F.size(acc) == 0, F.array(item(w)))
            .when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(item(w))))
        )

    return F.aggregate(F.array_sort(windows), F.array().cast(_MERGED), absorb)


def refine_span(scores: Column, start: Column, end: Column, quantile: float, zero: Column) -> Column:
    """First-to-last position at or above the local linear quantile, and the mean of those scores."""

    def narrow(local: Column) -> Column:
        def bounds(marks: Column) -> Column:
            return F.struct(
                (start + F.array_position(marks, True).cast("int") - 1).alias("char_start"),
                (end - F.array_position(F.reverse(marks), True).cast("int") + 1).alias("char_end"),
            )

        def cut_at(cut: Column) -> Column:
            span = let(F.transform(local, lambda v: v >= cut), bounds)
            mean = let(F.filter(local, lambda v: v >= cut), lambda high: array_sum(high, zero) / F.size(high))
            return F.struct(
                span["char_start"].alias("char_start"), span["char_end"].alias("char_end"), mean.alias("mean")
            )

        return let(linear_quantile(local, quantile), cut_at)

    return let(F.slice(scores, start + 1, end - start), narrow)


def with_candidates(
    df: DataFrame,
    *,
    scores: str = "scores",
    unit: float = 1.0,
    window_lengths: Sequence[int] = WINDOW_LENGTHS,
    stride_fraction: float = STRIDE_FRACTION,
    quantile: float = CANDIDATE_QUANTILE,
    gap: int = MERGE_GAP,
    refine_quantile: float | None = 0.5,
) -> DataFrame:
    """Add ``candidates``: merged (and refined) spans with scale, score and stable candidate ids.

    Integer scores are summed exactly and divided by ``unit`` once at the end.
    """
    element = df.schema[scores].dataType.elementType.typeName()
    integral = element in ("long", "integer", "short", "byte")
    zero = _zero(integral)
    numbers = F.col(scores) if element in ("long", "double") else F.col(scores).cast(
        "array<bigint>" if integral else "array<double>"
    )

    def search(s: Column) -> Column:
        windows = raw_windows(
            s, integral=integral, window_lengths=window_lengths,
            stride_fraction=stride_fraction, quantile=quantile,
        )
        return F.transform(merge_windows(windows, gap), lambda m, i: finish(s, m, i))

    def finish(s: Column, m: Column, i: Column) -> Column:
        name = F.concat(F.lit("generic-merged-"), i.cast("string"))
        scale = F.concat(F.lit("char-"), m["scale"].cast("string"))

        def span(label: Column, at: Column) -> Column:
            return F.struct(
                label.alias("candidate_id"), at["char_start"].alias("char_start"),
                at["char_end"].alias("char_end"), scale.alias("scale_id"),
                (at["mean"] / F.lit(float(unit))).alias("raw_score"),
            )

        if refine_quantile is None:
            return span(name, m)
        refined = let(
            refine_span(s, m["char_start"], m["char_end"], refine_quantile, zero),
            lambda r: span(F.concat(name, F.lit("-refined")), r),
        )
        return F.when(m["char_end"] - m["char_start"] < 2, span(name, m)).otherwise(refined)

    return df.withColumn("candidates", let(numbers, search))


def merge_spans(spans: Column, gap: int = 0) -> Column:
    """Merge intervals at most ``gap`` apart (touching merges at 0)."""
    empty = F.array().cast("array<struct<char_start:int,char_end:int>>")

    def absorb(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        this = F.struct(s["char_start"].cast("int").alias("char_start"), s["char_end"].cast("int").alias("char_end"))
        joined = F.struct(
            last["char_start"].alias("char_start"),
            F.greatest(last["char_end"], s["char_end"]).cast("int").alias("char_end"),
        )
        return (
            F.when(F.size(acc) == 0, F.array(this))
            .when(s["char_start"] <= last["char_end"] + gap,
                  F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(this)))
        )

    return F.aggregate(F.array_sort(spans), empty, absorb)


def subtract_span(source: Column, cut: Column) -> Column:
    """Parts of ``source`` outside ``cut``: zero, one or two intervals."""
    lo = F.greatest(source["char_start"], cut["char_start"])
    hi = F.least(source["char_end"], cut["char_end"])
    part = lambda a, b: F.when(a < b, F.struct(a.alias("char_start"), b.alias("char_end")))
    pieces = F.array_compact(F.array(part(source["char_start"], lo), part(hi, source["char_end"])))
    return F.when(lo < hi, pieces).otherwise(
        F.array(F.struct(source["char_start"].alias("char_start"), source["char_end"].alias("char_end")))
    )


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals; touching intervals have none in common."""
    common = overlap(a_start, a_end, b_start, b_end)
    return F.when(common > 0, common / ((a_end - a_start) + (b_end - b_start) - common)).otherwise(F.lit(0.0))


def merge_long(df: DataFrame, key: str, *, gap: int = 0) -> DataFrame:
    """Gaps-and-islands over one interval per row; islands of one document stay in one window."""
    order = Window.partitionBy(key).orderBy("char_start", "char_end")
    reach = F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("char_start") > reach + gap), 1).otherwise(0)
    marked = df.withColumn("_new", fresh)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("island", (island - 1).cast("int")).groupBy(key, "island")
        .agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"),
             F.count(F.lit(1)).alias("members"))
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str, *, bin_width: int = 1024) -> DataFrame:
    """Overlapping interval pairs inside a document, by an equi-join on (document, position bin).

    An overlapping pair is reported only in the bin that holds the later of the two starts, so wide
    intervals sharing many bins still give one row and documents never pair everything with everything.
    """
    bins = lambda: F.explode(
        F.sequence(F.floor(F.col("char_start") / bin_width), F.floor((F.col("char_end") - 1) / bin_width))
    )
    a = left.select(key, *[F.col(c).alias(f"a_{c}") for c in left.columns if c != key], bins().alias("_bin"))
    b = right.select(key, *[F.col(c).alias(f"b_{c}") for c in right.columns if c != key], bins().alias("_bin"))
    met = a.join(b, [key, "_bin"]).where(
        (F.col("a_char_start") < F.col("b_char_end"))
        & (F.col("b_char_start") < F.col("a_char_end"))
        & (F.col("_bin") == F.floor(F.greatest("a_char_start", "b_char_start") / bin_width))
    )
    return met.drop("_bin").withColumns(
        {
            "overlap": overlap(F.col("a_char_start"), F.col("a_char_end"), F.col("b_char_start"), F.col("b_char_end")),
            "iou": interval_iou(F.col("a_char_start"), F.col("a_char_end"), F.col("b_char_start"), F.col("b_char_end")),
        }
    )
