"""Ranking quality and the sweeps that choose thresholds, weights and single statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import distinct_running, exact_quantiles, with_scalars


def auroc(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Tie-aware area under the ROC curve per group; null when a class is absent.

    Scores shrink to distinct values with class counts, then one running count of negatives gives
    each positive its rank: no global sort and no pairing of the classes.
    """
    one = lambda c: F.when(c, 1).otherwise(0)
    return auroc_of_counts(df, by, score, one(positive), one(~positive))


def auroc_of_counts(df: DataFrame, by: Sequence[str], score: str, positives: Column, negatives: Column) -> DataFrame:
    """The same where a row stands for numbers of positives and negatives of a score."""
    ran = distinct_running(df.where(F.col(score).isNotNull()), by, score, {"pos": positives, "neg": negatives})
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return ran.groupBy(*by).agg(
        wins.alias("_w"), F.max("all_pos").alias("positives"), F.max("all_neg").alias("negatives")
    ).select(
        *by,
        F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
               F.col("_w") / (F.col("positives") * F.col("negatives"))).alias("auroc"),
        "positives", "negatives",
    )


def best_statistic(df: DataFrame, features: Sequence[str], *, split: str, positive: Column) -> DataFrame:
    """AUROC of every feature with its training-set sign; the best training feature is marked."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("_v")) for f in features])
    long = df.select(F.col(split).alias("_split"), positive.alias("_pos"), F.inline(cells))
    areas = auroc(long, ["feature", "_split"], "_v", F.col("_pos")).groupBy("feature").agg(
        F.max(F.when(F.col("_split") == "train", F.col("auroc"))).alias("_train"),
        F.max(F.when(F.col("_split") != "train", F.col("auroc"))).alias("_dev"),
    )
    sign = F.when(F.col("_train") >= 0.5, 1.0).otherwise(-1.0)
    out = areas.select(
        "feature", sign.alias("sign"),
        F.greatest(F.col("_train"), 1.0 - F.col("_train")).alias("train_auroc"),
        F.when(F.col("_train") >= 0.5, F.col("_dev")).otherwise(1.0 - F.col("_dev")).alias("dev_auroc"),
    )
    # One row per feature; earlier features win ties.
    position = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    order = Window.orderBy(F.col("train_auroc").desc(), position)
    return out.withColumn("selected", F.row_number().over(order) == 1)


def threshold_sweep(
    df: DataFrame, *, score: str, truth: str, family: str, classes: int = 5, steps: int = 200
) -> DataFrame:
    """Macro F1 of 'family unless the score is below the threshold, then class 0' at every quantile.

    Rows are reduced to counts per (threshold slot, truth, family). Raising the threshold past a slot
    moves its rows to class 0, so each threshold's confusion is a running sum over at most steps + 1
    slots.
    """
    cuts = exact_quantiles(df, [], score, steps).select("quantile").distinct()
    # At most steps + 1 thresholds.
    bounds = cuts.agg(F.array_sort(F.collect_list("quantile")).alias("_cuts"))
    slot = F.size(F.filter("_cuts", lambda c: c <= F.col(score)))
    cells = with_scalars(df.select(score, truth, family), bounds).groupBy(
        slot.alias("_slot"), F.col(truth).alias("_t"), F.col(family).alias("_f")
    ).agg(F.count(F.lit(1)).alias("_n"))
    # A row in slot s keeps its family for thresholds 1..s and is class 0 for later ones.
    every = with_scalars(cells, bounds).select(
        "_slot", "_t", "_f", "_n", F.posexplode("_cuts").alias("_i", "threshold")
    )
    predicted = F.when(F.col("_slot") >= F.col("_i") + 1, F.col("_f")).otherwise(0)
    hits = every.select("threshold", "_t", predicted.alias("_p"), "_n")
    names = [F.lit(c) for c in range(classes)]
    sums = hits.select("*", F.explode(F.array(*names)).alias("_c")).groupBy("threshold", "_c").agg(
        F.sum(F.when((F.col("_t") == F.col("_c")) & (F.col("_p") == F.col("_c")), F.col("_n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_p") == F.col("_c"), F.col("_n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col("_t") == F.col("_c"), F.col("_n")).otherwise(0)).alias("tt"),
    )
    f1 = F.when(F.col("pp") + F.col("tt") == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / (F.col("pp") + F.col("tt")))
    return sums.groupBy("threshold").agg((F.sum(f1) / classes).alias("macro_f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the highest macro F1, the lowest one on ties."""
    key = F.struct(F.round(F.col("macro_f1"), 12).alias("a"), (-F.col("threshold")).alias("b"))
    return sweep.agg(F.max_by("threshold", key).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def fusion_sweep(df: DataFrame, *, generic: str, registered: str, positive: Column, steps: int = 20) -> DataFrame:
    """AUROC of w * generic + (1 - w) * registered for steps + 1 evenly spaced weights; best one marked.

    Ties go to the weight nearest one half. Rows become counts of the distinct pairs of scores first, so what is copied
    for every weight is as long as the pairs, not the rows.
    """
    weights = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    cells = df.groupBy(generic, registered).agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    long = cells.select(generic, registered, "_pos", "_neg", F.explode(weights).alias("weight"))
    fused = F.col("weight") * F.col(generic) + (1.0 - F.col("weight")) * F.col(registered)
    # Rounded far below any score step so that equal sums tie in every engine.
    areas = auroc_of_counts(long.withColumn("_v", F.round(fused, 12)), ["weight"], "_v", F.col("_pos"), F.col("_neg"))
    order = Window.orderBy(F.round("auroc", 12).desc(), F.round(F.abs(F.col("weight") - 0.5), 12), "weight")
    return areas.withColumn("selected", F.row_number().over(order) == 1)


def held_out_auroc(df: DataFrame, *, family: str, clean: Column, score: str, families: Sequence) -> DataFrame:
    """AUROC of clean rows against each held-out family alone."""
    every = F.array(*[F.lit(f) for f in families])
    owner = F.when(clean, every).otherwise(F.array(F.col(family)))
    long = df.select(clean.alias("_clean"), score, F.explode(owner).alias("held_out"))
    kept = long.where(F.array_contains(every, F.col("held_out")))
    return auroc(kept, ["held_out"], score, ~F.col("_clean"))


def stability(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample standard deviation over repeated runs."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("runs")
    )
