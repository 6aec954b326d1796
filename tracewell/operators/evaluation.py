"""Evaluation of decisions: labels, error rates, localisation, open-set curve, bootstrap, strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int31, stable_hash
from ..functions.stats import clopper_pearson_upper
from ..schemas import LABELS, SEED
from .ordered import distinct_running, exact_quantiles, hash_rank, with_running
from .spans import interval_iou

STRATA = ("source", "language", "watermark_family", "key_id", "attack_id")


def truth_label(slots: Column, held_out: Column) -> Column:
    """Label a document deserves under an authorisation: authorised, then unauthorised, then unknown."""
    single = F.array(F.struct(F.col("watermark_family").alias("family"), F.coalesce("key_id", F.lit("")).alias("key")))
    many = F.transform(
        F.arrays_zip(F.col("watermark_families").alias("f"), F.col("key_ids").alias("k")),
        lambda z: F.struct(z["f"].alias("family"), z["k"].alias("key")),
    )
    pairs = F.when(F.col("watermark_family") == "mixed", many).otherwise(single)
    known = lambda p: ~p["family"].eqNullSafe(held_out)
    slot = lambda p: F.element_at(F.split(p["key"], "_"), -1)
    return (
        F.when(F.col("watermark_family").isNull(), "none")
        .when(F.exists(pairs, lambda p: known(p) & F.array_contains(slots, slot(p))), "known_scheme_known_key")
        .when(F.exists(pairs, known), "known_scheme_unknown_key")
        .otherwise("suspected_unknown_scheme")
    )


def key_set_drift(decisions: DataFrame, documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on only one side; empty when decisions and documents match exactly."""
    d = decisions.select(*keys).withColumn("_d", F.lit(1))
    t = documents.select(*keys).withColumn("_t", F.lit(1))
    side = F.when(F.col("_d").isNull(), "missing_decision").otherwise("extra_decision")
    both = d.join(t, list(keys), "full_outer").where(F.col("_d").isNull() | F.col("_t").isNull())
    return both.select(*keys, side.alias("violation"))


def evaluation_records(decisions: DataFrame) -> DataFrame:
    """Evaluation rows of decided documents (which still carry their truth columns)."""
    return decisions.select(
        "scenario",
        "document_id",
        F.array_join(F.array_sort("parent_ids"), "|").alias("parent_id"),
        truth_label(F.col("slots"), F.col("held_out_family")).alias("true_label"),
        F.col("document_label").alias("predicted_label"),
        F.coalesce(1.0 - F.col("generic_p"), F.lit(0.0)).alias("score"),
        F.coalesce(1.0 - F.col("registered_p"), F.lit(0.0)).alias("knownness_score"),
        F.col("watermark_intervals").alias("true_intervals"),
        "predicted_intervals",
        *STRATA,
        "held_out_family",
    )


def _label_grid() -> Column:
    labels = lambda: F.array(*[F.lit(x) for x in LABELS])
    pair = lambda t: F.transform(labels(), lambda p: F.struct(t.alias("true_label"), p.alias("predicted_label")))
    return F.flatten(F.transform(labels(), pair))


def confusion(records: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """All 25 label pairs with their counts, zeros included, per group."""
    counts = records.groupBy(*by, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("_n"))
    grid = counts.select(*by).distinct().select(*by, F.inline(_label_grid()))
    full = grid.join(counts, [*by, "true_label", "predicted_label"], "left")
    return full.select(
        *by, "true_label", "predicted_label", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")
    )


def class_metrics(cells: DataFrame, by: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """Support, precision, recall and F1 of every label from (true, predicted, n) cells; 0 when undefined."""
    sides = F.array(*[F.lit(x) for x in labels])
    long = cells.select(*by, "true_label", "predicted_label", "n", F.explode(sides).alias("label"))
    hit_t, hit_p = F.col("true_label") == F.col("label"), F.col("predicted_label") == F.col("label")
    sums = long.groupBy(*by, "label").agg(
        F.sum(F.when(hit_t & hit_p, F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit_p, F.col("n")).otherwise(0)).alias("_pp"),
        F.sum(F.when(hit_t, F.col("n")).otherwise(0)).cast("bigint").alias("support"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    out = sums.withColumns({"precision": ratio("_tp", "_pp"), "recall": ratio("_tp", "support")})
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total)
    return out.withColumn("f1", f1).drop("_tp", "_pp")


def macro_summary(cells: DataFrame, by: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """Accuracy and F1 averaged over all labels, present or not."""
    per_class = class_metrics(cells, by, labels).groupBy(*by).agg(
        (F.sum("f1") / len(labels)).alias("macro_f1")
    )
    right = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    accuracy = cells.groupBy(*by).agg((right / F.sum("n")).alias("accuracy"), F.sum("n").cast("bigint").alias("records"))
    return per_class.join(accuracy, list(by))


def document_fwer(records: DataFrame, by: Sequence[str] = ("scenario",), confidence: float = 0.95) -> DataFrame:
    """False-positive rate over unmarked documents with its exact upper bound (null without any)."""
    null = F.col("true_label") == "none"
    counts = records.groupBy(*by).agg(
        F.count_if(null & (F.col("predicted_label") != "none")).alias("errors"), F.count_if(null).alias("trials")
    )
    return _rate(counts, confidence)


def parent_fwer(records: DataFrame, by: Sequence[str] = ("scenario",), confidence: float = 0.95) -> DataFrame:
    """The same over parents: one errs if any of its unmarked descendants is accepted or uncertain."""
    null = records.where(F.col("true_label") == "none")
    parents = null.groupBy(*by, "parent_id").agg(F.max(F.col("predicted_label") != "none").alias("_err"))
    counts = parents.groupBy(*by).agg(F.count_if("_err").alias("errors"), F.count(F.lit(1)).alias("trials"))
    every = records.select(*by).distinct().join(counts, list(by), "left")
    zero = F.lit(0).cast("bigint")
    every = every.withColumns({"errors": F.coalesce("errors", zero), "trials": F.coalesce("trials", zero)})
    return _rate(every, confidence)


def _rate(counts: DataFrame, confidence: float) -> DataFrame:
    return counts.withColumns(
        {
            "rate": F.when(F.col("trials") > 0, F.col("errors") / F.col("trials")),
            "upper": clopper_pearson_upper(F.col("errors"), F.col("trials"), confidence),
        }
    )


def _edges(truth: Column, prediction: Column) -> Column:
    """Ends and starts of the spans of both sides in order of position, ends first where they touch; empty spans have none."""

    def of(spans: Column, side: int) -> Column:
        edge = lambda x, i, at, kind: F.struct(
            at.cast("int").alias("at"), F.lit(kind).alias("opens"), F.lit(side).alias("side"), i.cast("int").alias("i"),
            x["char_start"].cast("int").alias("s"), x["char_end"].cast("int").alias("e"),
        )
        both = F.transform(spans, lambda x, i: F.when(
            x["char_end"] > x["char_start"], F.array(edge(x, i, x["char_end"], 0), edge(x, i, x["char_start"], 1))
        ).otherwise(F.array().cast("array<struct<at:int,opens:int,side:int,i:int,s:int,e:int>>")))
        return F.flatten(both)

    return F.array_sort(F.concat(of(truth, 0), of(prediction, 1)))


def character_iou(truth: Column, prediction: Column) -> Column:
    """Share of marked characters in common; 1 when both sides are empty.

    One sweep over the spans' ends counts how many of each side are open, so nothing is compared in pairs.
    """
    none = F.lit(0)
    start = F.struct(none.alias("at"), none.alias("t"), none.alias("p"), none.alias("common"), none.alias("union"))

    def step(acc: Column, edge: Column) -> Column:
        width, sign = edge["at"] - acc["at"], F.when(edge["opens"] == 1, 1).otherwise(-1)
        share = lambda held: F.when(held, width).otherwise(0)
        return F.struct(
            edge["at"].alias("at"), (acc["t"] + F.when(edge["side"] == 0, sign).otherwise(0)).alias("t"),
            (acc["p"] + F.when(edge["side"] == 1, sign).otherwise(0)).alias("p"),
            (acc["common"] + share((acc["t"] > 0) & (acc["p"] > 0))).alias("common"),
            (acc["union"] + share((acc["t"] > 0) | (acc["p"] > 0))).alias("union"),
        )

    score = lambda x: F.when(x["union"] == 0, F.lit(1.0)).otherwise(x["common"] / x["union"])
    return F.aggregate(_edges(truth, prediction), start, step, score)


def overlapping_pairs(truth: Column, prediction: Column) -> Column:
    """(t, p, ts, te, ps, pe) for every truth and prediction span that share a character, by index and place.

    A sweep over the spans' ends keeps those that are open; a span that opens meets the open ones of the other side. So
    there are as many rows as true overlaps, however many spans a record has.
    """
    held = "array<struct<i:int,s:int,e:int>>"
    start = F.struct(
        F.array().cast(held).alias("t"), F.array().cast(held).alias("p"),
        F.array().cast("array<struct<t:int,p:int,ts:int,te:int,ps:int,pe:int>>").alias("pairs"),
    )

    def step(acc: Column, edge: Column) -> Column:
        opens, of_truth = edge["opens"] == 1, edge["side"] == 0
        item = F.struct(edge["i"].alias("i"), edge["s"].alias("s"), edge["e"].alias("e"))
        pair = lambda t, p: F.struct(
            t["i"].alias("t"), p["i"].alias("p"), t["s"].alias("ts"), t["e"].alias("te"), p["s"].alias("ps"), p["e"].alias("pe")
        )
        met = F.when(of_truth, F.transform(acc["p"], lambda o: pair(item, o))).otherwise(F.transform(acc["t"], lambda o: pair(o, item)))
        moved = lambda side: F.when(opens, F.array_append(side, item)).otherwise(F.filter(side, lambda x: x["i"] != edge["i"]))
        return F.struct(
            F.when(of_truth, moved(acc["t"])).otherwise(acc["t"]).alias("t"),
            F.when(of_truth, acc["p"]).otherwise(moved(acc["p"])).alias("p"),
            F.when(opens, F.concat(acc["pairs"], met)).otherwise(acc["pairs"]).alias("pairs"),
        )

    return F.aggregate(_edges(truth, prediction), start, step, lambda acc: acc["pairs"])


def match_spans(truth: Column, prediction: Column, threshold: float = 0.5) -> Column:
    """Greedy one-to-one matching by overlap ratio, larger indices first on ties.

    One pass serves both measures: matches at or above ``threshold`` come first in the order, so they
    are the ones the thresholded matching would pick. Only overlapping pairs are made.
    """

    def pair(x: Column) -> Column:
        iou = interval_iou(x["ts"], x["te"], x["ps"], x["pe"])
        error = (F.abs(x["ts"] - x["ps"]) + F.abs(x["te"] - x["pe"])) / 2.0
        return F.struct((-iou).alias("i"), (-x["t"]).alias("t"), (-x["p"]).alias("p"), error.alias("e"))

    ordered = F.array_sort(F.transform(overlapping_pairs(truth, prediction), pair))
    none = F.array().cast("array<int>")
    start = F.struct(
        none.alias("ts"), none.alias("ps"), F.lit(0.0).alias("error"), F.lit(0).alias("matched"),
        F.lit(0).alias("events"),
    )

    def take(acc: Column, x: Column) -> Column:
        taken = F.array_contains(acc["ts"], x["t"]) | F.array_contains(acc["ps"], x["p"])
        return F.when(taken, acc).otherwise(
            F.struct(
                F.array_append(acc["ts"], x["t"]).alias("ts"), F.array_append(acc["ps"], x["p"]).alias("ps"),
                (acc["error"] + x["e"]).alias("error"), (acc["matched"] + 1).alias("matched"),
                (acc["events"] + F.when(-x["i"] >= threshold, 1).otherwise(0)).alias("events"),
            )
        )

    return F.aggregate(ordered, start, take)


def with_localisation(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per-record character IoU, event F1 and boundary error."""
    staged = records.withColumn("_m", match_spans(F.col("true_intervals"), F.col("predicted_intervals"), threshold))
    sizes = F.size("true_intervals") + F.size("predicted_intervals")
    matched = F.col("_m.matched")
    return staged.withColumns(
        {
            "character_iou": character_iou(F.col("true_intervals"), F.col("predicted_intervals")),
            "event_f1": F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.col("_m.events") / sizes),
            "boundary_error": F.when(matched > 0, F.col("_m.error") / matched),
            "matched_events": matched.cast("bigint"),
            "unmatched_true": (F.size("true_intervals") - matched).cast("bigint"),
            "unmatched_predicted": (F.size("predicted_intervals") - matched).cast("bigint"),
        }
    ).drop("_m")


def oscr(records: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Area under the open-set classification curve; null when a side is empty or a score is missing."""
    known = F.col("true_label").isin("known_scheme_known_key", "known_scheme_unknown_key")
    unknown = F.col("true_label") == "suspected_unknown_scheme"
    right = known & (F.col("predicted_label") == F.col("true_label"))
    used = records.where(known | unknown)
    totals = used.groupBy(*by).agg(
        F.count_if(known).alias("_k"), F.count_if(unknown).alias("_u"), F.count_if(right).alias("_c"),
        F.count_if(F.col("knownness_score").isNull()).alias("_nulls"),
    )
    one = lambda c: F.when(c, 1).otherwise(0)
    curve = distinct_running(
        used.where(F.col("knownness_score").isNotNull()), by, "knownness_score",
        {"right": one(right), "false": one(unknown)}, descending=True,
    ).select(*by, F.col("cum_false").alias("x"), F.col("cum_right").alias("y"))
    ends = totals.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y")),
                F.struct(F.col("_u").alias("x"), F.col("_c").alias("y")),
            )
        ),
    )
    points = curve.unionByName(ends).groupBy(*by, "x").agg(F.max("y").alias("y"))
    # Neighbouring points: buckets of the x axis keep the lag distributed on long curves.
    stepped = with_running(
        points, list(by), F.floor(F.col("x") / 65536), [F.col("x")],
        lags={"_x0": F.col("x"), "_y0": F.col("y")},
    )
    area = stepped.groupBy(*by).agg(
        F.sum((F.col("x") - F.col("_x0")) * (F.col("y") + F.col("_y0")) / 2.0).alias("_area")
    )
    usable = (F.col("_k") > 0) & (F.col("_u") > 0) & (F.col("_nulls") == 0)
    value = F.when(usable, F.coalesce("_area", F.lit(0.0)) / (F.col("_k") * F.col("_u")))
    every = records.select(*by).distinct()
    return every.join(totals.join(area, list(by), "left"), list(by), "left").select(*by, value.alias("oscr"))


def composite_oscr(records: DataFrame, main: str = "a_and_b") -> DataFrame:
    """Open-set curve of the main scenario's known documents against all held-out unknown ones."""
    known = records.where((F.col("scenario") == main) & (F.col("true_label") == "known_scheme_known_key"))
    unknown = records.where(
        F.col("held_out_family").isNotNull() & (F.col("true_label") == "suspected_unknown_scheme")
    )
    both = known.unionByName(unknown).withColumn("scenario", F.lit("composite"))
    return oscr(both)


def _tallies() -> list[Column]:
    out = []
    for i, label in enumerate(LABELS):
        t, p = F.col("true_label") == label, F.col("predicted_label") == label
        out += [F.count_if(t & p).alias(f"_tp{i}"), F.count_if(p).alias(f"_pp{i}"), F.count_if(t).alias(f"_tt{i}")]
    return out


def _macro(prefix: str = "_") -> Column:
    """Macro F1 over all five labels from true-positive, predicted and true tallies."""
    total = F.lit(0.0)
    for i in range(len(LABELS)):
        tp, pp, tt = (F.col(f"{prefix}{k}{i}") for k in ("tp", "pp", "tt"))
        total = total + F.when(pp + tt == 0, F.lit(0.0)).otherwise(2 * tp / (pp + tt))
    return total / len(LABELS)


def bootstrap_macro_f1(
    records: DataFrame, *, replicates: int = 2000, seed: int = SEED, by: Sequence[str] = ("scenario",)
) -> DataFrame:
    """Macro F1 with a percentile interval from resampling whole parents with replacement.

    Records shrink to one tally row per parent first. Each parent slot draws one parent per replicate
    from a stable hash, so a retried task repeats its draws exactly.
    """
    parents = records.groupBy(*by, "parent_id").agg(*_tallies())
    indexed = hash_rank(
        parents, list(by), stable_hash(seed, "parent_id"), [F.col("parent_id")], rank="_idx", total="_p"
    )
    slots = indexed.select(*by, F.col("_idx").alias("_slot"), "_p", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep"))
    pick = hash_int31(stable_hash(seed, F.col("_rep"), F.col("_slot"))) % F.col("_p") + 1
    drawn = slots.select(*by, "_rep", pick.alias("_idx")).join(indexed.drop("parent_id", "_p"), [*by, "_idx"])
    names = [f"_{k}{i}" for i in range(len(LABELS)) for k in ("tp", "pp", "tt")]
    sums = drawn.groupBy(*by, "_rep").agg(*[F.sum(n).alias(n) for n in names])
    estimates = sums.select(*by, _macro().alias("macro_f1"))
    cuts = exact_quantiles(estimates, list(by), "macro_f1", 40)
    bounds = cuts.groupBy(*by).agg(
        F.max(F.when(F.abs(F.col("q") - 0.025) < 1e-9, F.col("quantile"))).alias("lower"),
        F.max(F.when(F.abs(F.col("q") - 0.975) < 1e-9, F.col("quantile"))).alias("upper"),
    )
    whole = records.groupBy(*by).agg(*_tallies()).select(*by, _macro().alias("estimate"))
    return whole.join(bounds, list(by)).withColumn("replicates", F.lit(replicates).cast("bigint"))


def strata_of(records: DataFrame, fields: Sequence[str] = STRATA) -> DataFrame:
    """Each record once per stratum it belongs to, the whole set included; null values read 'null'."""
    cell = lambda f, v: F.struct(F.lit(f).alias("stratum_field"), v.alias("stratum_value"))
    cells = [cell("overall", F.lit("all"))]
    cells += [cell(f, F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in fields]
    return records.select("*", F.inline(F.array(*cells)))


def evaluate(records: DataFrame, fields: Sequence[str] = STRATA) -> DataFrame:
    """Every metric overall and per stratum. Counting metrics come from one grouping-sets pass."""
    measured = with_localisation(records)
    filled = measured.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields})
    sets = [[F.col("scenario")]] + [[F.col("scenario"), F.col(f)] for f in fields]
    null = F.col("true_label") == "none"
    flat = filled.groupingSets(sets, F.col("scenario"), *[F.col(f) for f in fields]).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("records"),
        *_tallies(),
        F.count_if(null & (F.col("predicted_label") != "none")).alias("fwer_errors"),
        F.count_if(null).alias("fwer_trials"),
        F.avg("character_iou").alias("mean_character_iou"),
        F.avg("event_f1").alias("mean_event_f1"),
        F.avg("boundary_error").alias("mean_boundary_error"),
        F.sum("matched_events").alias("matched_events"),
        F.sum("unmatched_true").alias("unmatched_true"),
        F.sum("unmatched_predicted").alias("unmatched_predicted"),
    )
    width = len(fields)
    whole = (1 << width) - 1
    field, value = F.when(F.col("_gid") == whole, "overall"), F.when(F.col("_gid") == whole, F.lit("all"))
    for i, f in enumerate(fields):
        here = F.col("_gid") == whole - (1 << (width - 1 - i))
        field, value = field.when(here, f), value.when(here, F.col(f))
    by = ["scenario", "stratum_field", "stratum_value"]
    counted = flat.select(
        "scenario", field.alias("stratum_field"), value.alias("stratum_value"), "records",
        _macro().alias("macro_f1"), "fwer_errors", "fwer_trials", "mean_character_iou", "mean_event_f1",
        "mean_boundary_error", "matched_events", "unmatched_true", "unmatched_predicted",
    )
    long = strata_of(
        records.select("scenario", "parent_id", "true_label", "predicted_label", "knownness_score", *fields), fields
    )
    parents = parent_fwer(long, by).select(
        *by, F.col("errors").alias("parent_errors"), F.col("trials").alias("parent_trials")
    )
    return counted.join(parents, by, "left").join(oscr(long, by), by, "left")
