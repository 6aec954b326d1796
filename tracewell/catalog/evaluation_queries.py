"""Evaluation queries over the decided test population."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import evidence
from ..plans import attribution as A
from ..session import shared_table
from ..schemas import LABELS
from .oracle import cte, query
from .registry import register

BY = ("scenario",)
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


def records(spark, sf):
    def build():
        _, docs = A.decisions(spark, sf, A.Settings(per_item_p=True), evidence.SCENARIOS)
        return E.evaluation_records(docs)

    return shared_table(spark, sf, "evaluation-records", build)


def r9(name, alias=None):
    return F.round(F.col(name), 9).alias(alias or name)


cte("d_labels", f"SELECT unnest({LABEL_LIST}) AS label")
cte(
    "d_strata",
    """
SELECT e.*, f.stratum_field, CASE f.stratum_field WHEN 'overall' THEN 'all' WHEN 'source' THEN coalesce(source, 'null')
  WHEN 'language' THEN coalesce(language, 'null') WHEN 'watermark_family' THEN coalesce(watermark_family, 'null')
  WHEN 'key_id' THEN coalesce(key_id, 'null') ELSE coalesce(attack_id, 'null') END AS stratum_value
FROM d_eval e, (VALUES ('overall'), ('source'), ('language'), ('watermark_family'), ('key_id'), ('attack_id')) AS f(stratum_field)
""",
)


def bound_sql(counts: str, keys: str) -> str:
    """Exact upper binomial bound by bisection of the cumulative probability (log-gamma terms)."""
    return f"""
bis AS (
  SELECT {keys}, errors, trials, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM {counts} WHERE trials > 0 AND errors < trials
  UNION ALL
  SELECT {keys}, errors, trials, CASE WHEN c > 0.05 THEN m ELSE lo END, CASE WHEN c > 0.05 THEN hi ELSE m END, i + 1 FROM (
    SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(range(errors + 1), lambda k: exp(lgamma(trials + 1.0) - lgamma(k + 1.0)
      - lgamma(trials - k + 1.0) + k * ln((lo + hi) / 2) + (trials - k) * ln(1 - (lo + hi) / 2)))) AS c FROM bis WHERE i < 45)),
bounds AS (SELECT {keys}, hi AS upper FROM bis WHERE i = 45)
"""


def fwer_sql(counts: str) -> str:
    base = query(f"SELECT * FROM ({counts})")
    head, tail = base.rsplit("\nSELECT * FROM (", 1)
    inner = tail[:-1]
    recursive = head.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{recursive},
counts AS MATERIALIZED ({inner}),
{bound_sql("counts", "scenario").strip()}
SELECT scenario, errors, trials, round(errors / nullif(trials, 0)::DOUBLE, 9) AS rate,
  round(CASE WHEN trials > 0 AND errors = trials THEN 1.0::DOUBLE ELSE upper END, 7) AS upper
FROM counts LEFT JOIN bounds USING (scenario)"""


@register(
    "f5_truth_labels",
    query("SELECT scenario, document_id, parent_id, true_label, predicted_label FROM d_eval"),
)
def f5(spark, sf):
    return records(spark, sf).select("scenario", "document_id", "parent_id", "true_label", "predicted_label")


@register(
    "f6_evaluation_records",
    query("SELECT scenario, document_id, round(score, 9) AS score, round(knownness, 9) AS knownness_score, "
          "len(spans)::BIGINT AS true_spans, len(pred)::BIGINT AS predicted_spans, "
          "coalesce(list_sum(list_transform(pred, lambda x: x.s * 3 + x.e)), 0)::BIGINT AS predicted_sum FROM d_eval"),
)
def f6(spark, sf):
    checksum = F.aggregate(
        "predicted_intervals", F.lit(0).cast("bigint"), lambda a, s: a + s["char_start"] * 3 + s["char_end"]
    )
    return records(spark, sf).select(
        "scenario", "document_id", r9("score"), r9("knownness_score"),
        F.size("true_intervals").cast("bigint").alias("true_spans"),
        F.size("predicted_intervals").cast("bigint").alias("predicted_spans"), checksum.alias("predicted_sum"),
    )


@register(
    "j5_decision_document_match",
    query("""
SELECT recipe_id AS document_id, CASE WHEN recipe_id IN (SELECT document_id FROM d_eval WHERE scenario = 'lofo_kgw')
  THEN 'matched' ELSE 'missing_decision' END AS violation FROM d_rows WHERE status = 'generated' AND split = 'test'
  AND recipe_id NOT IN (SELECT document_id FROM d_eval WHERE scenario = 'lofo_kgw')
"""),
)
def j5(spark, sf):
    from ..plans import corpus

    docs = corpus.rows(spark, sf).where("status = 'generated' and split = 'test'").select(
        F.col("recipe_id").alias("document_id")
    )
    return E.key_set_drift(records(spark, sf).where("scenario = 'lofo_kgw'"), docs, ["document_id"])


@register(
    "a6_confusion_matrix",
    query("""
SELECT s.scenario, t.label AS true_label, p.label AS predicted_label, count(e.document_id) AS n
FROM (SELECT DISTINCT scenario FROM d_eval) s CROSS JOIN d_labels t CROSS JOIN d_labels p
LEFT JOIN d_eval e ON e.scenario = s.scenario AND e.true_label = t.label AND e.predicted_label = p.label GROUP BY ALL
"""),
)
def a6(spark, sf):
    return E.confusion(records(spark, sf), BY)


CLASS_SQL = """
(SELECT scenario, label, support, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
  ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT scenario, label, count(*) FILTER (true_label = label) AS support,
    coalesce(count(*) FILTER (true_label = label AND predicted_label = label) / nullif(count(*) FILTER (predicted_label = label), 0)::DOUBLE, 0.0::DOUBLE) AS precision,
    coalesce(count(*) FILTER (true_label = label AND predicted_label = label) / nullif(count(*) FILTER (true_label = label), 0)::DOUBLE, 0.0::DOUBLE) AS recall
  FROM d_eval, d_labels GROUP BY ALL))
"""


@register(
    "a7_class_metrics",
    query(f"SELECT scenario, label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM {CLASS_SQL}"),
)
def a7(spark, sf):
    cells = E.confusion(records(spark, sf), BY)
    return E.class_metrics(cells, BY).select(*BY, "label", "support", r9("precision"), r9("recall"), r9("f1"))


@register(
    "a7_macro_f1",
    query(f"""
SELECT scenario, round(m, 9) AS macro_f1, round(a, 9) AS accuracy, n AS records FROM
 (SELECT scenario, sum(f1) / 5 AS m FROM {CLASS_SQL} GROUP BY ALL) JOIN
 (SELECT scenario, count(*) FILTER (true_label = predicted_label) / count(*)::DOUBLE AS a, count(*) AS n FROM d_eval GROUP BY ALL) USING (scenario)
"""),
)
def a7b(spark, sf):
    return E.macro_summary(E.confusion(records(spark, sf), BY), BY).select(
        *BY, r9("macro_f1"), r9("accuracy"), "records"
    )


@register(
    "a8_document_fwer",
    fwer_sql("SELECT scenario, count(*) FILTER (true_label = 'none' AND predicted_label <> 'none') AS errors, "
             "count(*) FILTER (true_label = 'none') AS trials FROM d_eval GROUP BY ALL"),
)
def a8(spark, sf):
    return E.document_fwer(records(spark, sf)).select(
        "scenario", "errors", "trials", r9("rate"), F.round("upper", 7).alias("upper")
    )


PARENT_COUNTS = """SELECT scenario, count(*) FILTER (err) AS errors, count(*) AS trials FROM (
  SELECT scenario, parent_id, bool_or(predicted_label <> 'none') AS err FROM d_eval WHERE true_label = 'none' GROUP BY ALL) GROUP BY ALL"""


@register("a9_parent_fwer", fwer_sql(PARENT_COUNTS))
def a9(spark, sf):
    return E.parent_fwer(records(spark, sf)).select(
        "scenario", "errors", "trials", r9("rate"), F.round("upper", 7).alias("upper")
    )


@register(
    "a10_clopper_pearson_upper",
    fwer_sql("SELECT scenario || ':' || language AS scenario, count(*) FILTER (predicted_label = 'uncertain') AS errors, "
                   "count(*) AS trials FROM d_eval GROUP BY scenario, language"),
)
def a10(spark, sf):
    from ..functions.stats import clopper_pearson_upper

    counts = records(spark, sf).groupBy(F.concat_ws(":", "scenario", "language").alias("scenario")).agg(
        F.count_if(F.col("predicted_label") == "uncertain").alias("errors"), F.count(F.lit(1)).alias("trials")
    )
    upper = F.round(clopper_pearson_upper(F.col("errors"), F.col("trials")), 7)
    return counts.select(
        "scenario", "errors", "trials", F.round(F.col("errors") / F.col("trials"), 9).alias("rate"), upper.alias("upper")
    )


# Per-record localisation in SQL. Marked spans never touch each other; predicted spans are disjoint too.
cte(
    "d_iou",
    """
SELECT scenario, document_id, ti, pi, ts, te, ps, pe, ov / ((te - ts) + (pe - ps) - ov)::DOUBLE AS iou, ov FROM (
  SELECT t.scenario, t.document_id, t.i AS ti, p.i AS pi, t.s AS ts, t.e AS te, p.s AS ps, p.e AS pe,
    least(t.e, p.e) - greatest(t.s, p.s) AS ov
  FROM (SELECT scenario, document_id, unnest(spans).s AS s, unnest(spans).e AS e, unnest(range(len(spans))) AS i FROM d_eval) t
  JOIN (SELECT scenario, document_id, unnest(pred).s AS s, unnest(pred).e AS e, unnest(range(len(pred))) AS i FROM d_eval) p
    ON p.scenario = t.scenario AND p.document_id = t.document_id AND t.s < p.e AND p.s < t.e)
""",
)
cte(
    "d_greedy",
    """
SELECT scenario, document_id, ti, pi, iou, (abs(ts - ps) + abs(te - pe)) / 2.0::DOUBLE AS err FROM d_iou a
WHERE NOT EXISTS (SELECT 1 FROM d_iou b WHERE b.scenario = a.scenario AND b.document_id = a.document_id
    AND (b.ti = a.ti OR b.pi = a.pi) AND (b.iou, b.ti, b.pi) > (a.iou, a.ti, a.pi)
    AND NOT EXISTS (SELECT 1 FROM d_iou c WHERE c.scenario = b.scenario AND c.document_id = b.document_id
      AND (c.ti = b.ti OR c.pi = b.pi) AND (c.iou, c.ti, c.pi) > (b.iou, b.ti, b.pi)
      AND NOT EXISTS (SELECT 1 FROM d_iou x WHERE x.scenario = c.scenario AND x.document_id = c.document_id
        AND (x.ti = c.ti OR x.pi = c.pi) AND (x.iou, x.ti, x.pi) > (c.iou, c.ti, c.pi))))
""",
)
cte(
    "d_located",
    """
SELECT e.*, CASE WHEN tl + pl - ov = 0 THEN 1.0::DOUBLE ELSE ov / (tl + pl - ov)::DOUBLE END AS character_iou,
  CASE WHEN len(spans) + len(pred) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ev / (len(spans) + len(pred)) END AS event_f1,
  berr AS boundary_error, matched AS matched_events, len(spans) - matched AS unmatched_true, len(pred) - matched AS unmatched_predicted
FROM (SELECT d.*, coalesce(list_sum(list_transform(spans, lambda x: x.e - x.s)), 0) AS tl,
    coalesce(list_sum(list_transform(pred, lambda x: x.e - x.s)), 0) AS pl, coalesce(o.ov, 0) AS ov,
    coalesce(g.ev, 0) AS ev, coalesce(g.matched, 0) AS matched, g.berr
  FROM d_eval d LEFT JOIN (SELECT scenario, document_id, sum(ov) AS ov FROM d_iou GROUP BY ALL) o USING (scenario, document_id)
  LEFT JOIN (SELECT scenario, document_id, count(*) AS matched, count(*) FILTER (iou >= 0.5) AS ev, sum(err) / count(*) AS berr
    FROM d_greedy GROUP BY ALL) g USING (scenario, document_id)) e
""",
)


@register(
    "a11_character_iou",
    query("SELECT scenario, document_id, round(character_iou, 9) AS character_iou FROM d_located"),
)
def a11(spark, sf):
    iou = E.character_iou(F.col("true_intervals"), F.col("predicted_intervals"))
    return records(spark, sf).select("scenario", "document_id", F.round(iou, 9).alias("character_iou"))


@register(
    "a12_event_f1",
    query("SELECT scenario, document_id, round(event_f1, 9) AS event_f1 FROM d_located"),
)
def a12(spark, sf):
    return E.with_localisation(records(spark, sf)).select("scenario", "document_id", r9("event_f1"))


@register(
    "a13_boundary_error",
    query("SELECT scenario, document_id, round(boundary_error, 9) AS boundary_error, matched_events::BIGINT AS matched_events, "
          "unmatched_true::BIGINT AS unmatched_true, unmatched_predicted::BIGINT AS unmatched_predicted FROM d_located"),
)
def a13(spark, sf):
    return E.with_localisation(records(spark, sf)).select(
        "scenario", "document_id", r9("boundary_error"), "matched_events", "unmatched_true", "unmatched_predicted"
    )


def oscr_sql(source: str, keys: str) -> str:
    """Threshold sweep stated point by point, then the trapezoid rule over best points."""
    return f"""
SELECT {keys}, round(CASE WHEN k > 0 AND u > 0 THEN area / (k * u) END, 9) AS oscr FROM (
  SELECT {keys}, count(*) FILTER (true_label LIKE 'known%') AS k, count(*) FILTER (true_label = 'suspected_unknown_scheme') AS u
  FROM {source} GROUP BY ALL) LEFT JOIN (
  SELECT {keys}, sum((x - x0) * (y + y0) / 2.0::DOUBLE) AS area FROM (
    SELECT {keys}, x, y, lag(x) OVER (PARTITION BY {keys} ORDER BY x) AS x0, lag(y) OVER (PARTITION BY {keys} ORDER BY x) AS y0 FROM (
      SELECT {keys}, x, max(y) AS y FROM (
        SELECT {keys}, sum(f) OVER w AS x, sum(r) OVER w AS y FROM (
          SELECT {keys}, knownness, count(*) FILTER (true_label = 'suspected_unknown_scheme') AS f,
            count(*) FILTER (true_label LIKE 'known%' AND true_label = predicted_label) AS r
          FROM {source} WHERE true_label LIKE 'known%' OR true_label = 'suspected_unknown_scheme' GROUP BY ALL)
        WINDOW w AS (PARTITION BY {keys} ORDER BY knownness DESC)
        UNION ALL SELECT DISTINCT {keys}, 0, 0 FROM {source}
        UNION ALL SELECT {keys}, count(*) FILTER (true_label = 'suspected_unknown_scheme'),
          count(*) FILTER (true_label LIKE 'known%' AND true_label = predicted_label) FROM {source} GROUP BY {keys}) GROUP BY {keys}, x))
  GROUP BY ALL) USING ({keys})
"""


@register("a16_oscr", query(oscr_sql("d_eval", "scenario")))
def a16(spark, sf):
    return E.oscr(records(spark, sf)).select("scenario", r9("oscr"))


@register(
    "a17_composite_oscr",
    query(oscr_sql("""(SELECT 'composite' AS scenario, true_label, predicted_label, knownness FROM d_eval
  WHERE (scenario = 'a_and_b' AND true_label = 'known_scheme_known_key')
    OR (held_out IS NOT NULL AND true_label = 'suspected_unknown_scheme'))""", "scenario")),
)
def a17(spark, sf):
    return E.composite_oscr(records(spark, sf)).select("scenario", r9("oscr"))


STRATUM_KEYS = "scenario, stratum_field, stratum_value"


@register(
    "a14_stratified_evaluation",
    query(f"""
SELECT a.scenario, a.stratum_field, a.stratum_value, a.records, round(f.m, 9) AS macro_f1, a.fwer_errors, a.fwer_trials,
  round(a.ci, 9) AS mean_character_iou, round(a.ef, 9) AS mean_event_f1, round(a.be, 9) AS mean_boundary_error,
  a.matched_events, a.unmatched_true, a.unmatched_predicted, p.errors AS parent_errors, p.trials AS parent_trials, o.oscr
FROM (SELECT {STRATUM_KEYS}, count(*) AS records,
    count(*) FILTER (true_label = 'none' AND predicted_label <> 'none') AS fwer_errors, count(*) FILTER (true_label = 'none') AS fwer_trials,
    avg(l.character_iou) AS ci, avg(l.event_f1) AS ef, avg(l.boundary_error) AS be, sum(l.matched_events)::BIGINT AS matched_events,
    sum(l.unmatched_true)::BIGINT AS unmatched_true, sum(l.unmatched_predicted)::BIGINT AS unmatched_predicted
  FROM d_strata s JOIN (SELECT scenario, document_id, character_iou, event_f1, boundary_error, matched_events, unmatched_true,
    unmatched_predicted FROM d_located) l USING (scenario, document_id) GROUP BY ALL) a
JOIN (SELECT {STRATUM_KEYS}, sum(f1) / 5 AS m FROM (SELECT {STRATUM_KEYS}, label, coalesce(2 * count(*) FILTER (true_label = label AND predicted_label = label)
    / nullif(count(*) FILTER (true_label = label) + count(*) FILTER (predicted_label = label), 0)::DOUBLE, 0.0::DOUBLE) AS f1
  FROM d_strata, d_labels GROUP BY ALL) GROUP BY ALL) f ON f.scenario = a.scenario AND f.stratum_field = a.stratum_field AND f.stratum_value = a.stratum_value
JOIN (SELECT {STRATUM_KEYS}, count(*) FILTER (err AND nul) AS errors, count(*) FILTER (nul) AS trials FROM (
    SELECT {STRATUM_KEYS}, parent_id, bool_or(true_label = 'none') AS nul, bool_or(true_label = 'none' AND predicted_label <> 'none') AS err
    FROM d_strata GROUP BY ALL) GROUP BY ALL) p ON p.scenario = a.scenario AND p.stratum_field = a.stratum_field AND p.stratum_value = a.stratum_value
JOIN ({oscr_sql("d_strata", STRATUM_KEYS)}) o ON o.scenario = a.scenario AND o.stratum_field = a.stratum_field AND o.stratum_value = a.stratum_value
"""),
)
def a14(spark, sf):
    return E.evaluate(records(spark, sf)).select(
        "scenario", "stratum_field", "stratum_value", "records", r9("macro_f1"), "fwer_errors", "fwer_trials",
        r9("mean_character_iou"), r9("mean_event_f1"), r9("mean_boundary_error"), "matched_events", "unmatched_true",
        "unmatched_predicted", "parent_errors", "parent_trials", r9("oscr"),
    )


@register(
    "a15_cluster_bootstrap",
    query("""
SELECT 'a_and_b' AS scenario, round((SELECT sum(f) / 5 FROM (SELECT coalesce(2 * count(*) FILTER (true_label = label AND predicted_label = label)
    / nullif(count(*) FILTER (true_label = label) + count(*) FILTER (predicted_label = label), 0)::DOUBLE, 0.0::DOUBLE) AS f
    FROM d_eval, d_labels WHERE scenario = 'a_and_b' GROUP BY label)), 9) AS estimate,
  round(quantile_cont(m, 0.025), 9) AS lower, round(quantile_cont(m, 0.975), 9) AS upper, 2000::BIGINT AS replicates
FROM (SELECT rep, sum(coalesce(2 * tp / nullif(pp + tt, 0)::DOUBLE, 0.0::DOUBLE)) / 5 AS m FROM (
  SELECT rep, label, sum(tp) AS tp, sum(pp) AS pp, sum(tt) AS tt FROM (
    SELECT rep, (('0x' || substr(sha256('20260815:' || rep || ':' || slot), 9, 8))::BIGINT & 2147483647) % total + 1 AS idx
    FROM (SELECT idx AS slot, total FROM bp), range(1, 2001) AS r(rep)) d
  JOIN bp USING (idx) JOIN bt USING (parent_id) GROUP BY ALL) GROUP BY rep)
""").replace("\nSELECT 'a_and_b'", """,
bp AS MATERIALIZED (SELECT parent_id, row_number() OVER (ORDER BY sha256('20260815:' || parent_id), parent_id) AS idx,
  count(*) OVER () AS total FROM (SELECT DISTINCT parent_id FROM d_eval WHERE scenario = 'a_and_b')),
bt AS MATERIALIZED (SELECT parent_id, label, count(*) FILTER (true_label = label AND predicted_label = label) AS tp,
  count(*) FILTER (predicted_label = label) AS pp, count(*) FILTER (true_label = label) AS tt
  FROM d_eval, d_labels WHERE scenario = 'a_and_b' GROUP BY ALL)
SELECT 'a_and_b'""", 1),
)
def a15(spark, sf):
    out = E.bootstrap_macro_f1(records(spark, sf).where("scenario = 'a_and_b'"))
    return out.select("scenario", r9("estimate"), r9("lower"), r9("upper"), "replicates")


@register(
    "a6_default_decisions",
    query("SELECT scenario, true_label, predicted_label, count(*) AS n, round(avg(score), 9) AS mean_score FROM d_eval_default GROUP BY ALL"),
)
def a6_default(spark, sf):
    """Confusion of the default decisions, where a candidate's p stands for each of its items."""
    return default_records(spark, sf).groupBy("scenario", "true_label", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score")
    )


@register(
    "a8_default_family_errors",
    query("""
SELECT scenario, count(*) AS trials, count(*) FILTER (err) AS errors FROM (
  SELECT scenario, parent_id, bool_or(predicted_label <> 'none') AS err FROM d_eval_default WHERE true_label = 'none' GROUP BY ALL) GROUP BY ALL
"""),
)
def a8_default(spark, sf):
    return E.parent_fwer(default_records(spark, sf), BY).select("scenario", "trials", "errors")


def default_records(spark, sf):
    def build():
        _, docs = A.decisions(spark, sf, A.Settings(), evidence.SCENARIOS)
        return E.evaluation_records(docs)

    return shared_table(spark, sf, "evaluation-records-default", build)
