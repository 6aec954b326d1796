from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import evaluation as E
from tracewell.operators import selection
from tracewell.schemas import LABELS

SPANS = "array<struct<char_start:int,char_end:int>>"


def test_truth_labels(spark):
    rows = [
        (None, None, None, None, ["a"], None, "none"),
        ("kgw", "kgw_key_a", None, None, ["a"], None, "known_scheme_known_key"),
        ("kgw", "kgw_key_b", None, None, ["a"], None, "known_scheme_unknown_key"),
        ("kgw", "kgw_key_a", None, None, ["a", "b"], "kgw", "suspected_unknown_scheme"),
        ("mixed", None, ["kgw", "unigram"], ["kgw_key_b", "unigram_key_a"], ["a"], None, "known_scheme_known_key"),
    ]
    df = spark.createDataFrame(
        rows, "watermark_family string, key_id string, watermark_families array<string>, key_ids array<string>, slots array<string>, held string, want string"
    )
    assert df.where(E.truth_label(F.col("slots"), F.col("held")) != F.col("want")).count() == 0


def greedy(truth, pred, threshold):
    def iou(a, b):
        ov = max(0, min(a[1], b[1]) - max(a[0], b[0]))
        return ov / ((a[1] - a[0]) + (b[1] - b[0]) - ov) if ov else 0.0

    pairs = sorted(((iou(t, p), i, j) for i, t in enumerate(truth) for j, p in enumerate(pred)), reverse=True)
    ts, ps, events, errors = set(), set(), 0, []
    for score, i, j in pairs:
        if score <= 0 or i in ts or j in ps:
            continue
        ts.add(i), ps.add(j)
        events += score >= threshold
        errors.append((abs(truth[i][0] - pred[j][0]) + abs(truth[i][1] - pred[j][1])) / 2)
    total = len(truth) + len(pred)
    return (2 * events / total if total else 1.0), len(errors), (sum(errors) / len(errors) if errors else None)


def test_localisation_equals_brute_force(spark):
    random.seed(4)
    make = lambda k: [(s := random.randint(0, 40), s + random.randint(1, 20)) for _ in range(k)]
    rows = [(i, make(random.randint(0, 4)), make(random.randint(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, true_intervals {SPANS}, predicted_intervals {SPANS}")
    for r in E.with_localisation(df).collect():
        t, p = rows[r["i"]][1:]
        f1, matched, error = greedy(t, p, 0.5)
        cells = lambda spans: {c for a, b in spans for c in range(a, b)}
        union = cells(t) | cells(p)
        assert r["event_f1"] == pytest.approx(f1) and r["matched_events"] == matched
        assert r["boundary_error"] == (pytest.approx(error) if error is not None else None)
        assert r["character_iou"] == pytest.approx(len(cells(t) & cells(p)) / len(union) if union else 1.0)


def test_sweep_emits_only_true_overlaps(spark):
    import random

    draw = random.Random(14)
    span = lambda: (lambda a: (a, a + draw.choice([0, 1, 5, 40])))(draw.randrange(60))
    cases = [([span() for _ in range(draw.randrange(7))], [span() for _ in range(draw.randrange(7))]) for _ in range(60)]
    cases += [([(0, 5)], [(5, 9)]), ([(0, 5)] * 3, [(0, 5)] * 2), ([(i, i + 1) for i in range(400)], [(i, i + 1) for i in range(0, 400, 2)])]
    kind = "array<struct<char_start:int,char_end:int>>"
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(cases)], f"i int, t {kind}, p {kind}")
    got = {r["i"]: r for r in df.select("i", E.overlapping_pairs(F.col("t"), F.col("p")).alias("pairs"), E.character_iou(F.col("t"), F.col("p")).alias("iou")).collect()}
    for n, (t, p) in enumerate(cases):
        want = {(i, j, *a, *b) for i, a in enumerate(t) for j, b in enumerate(p) if max(a[0], b[0]) < min(a[1], b[1])}
        assert len(got[n]["pairs"]) == len(want) and {tuple(x) for x in got[n]["pairs"]} == want
        x, y = ({c for a, b in spans for c in range(a, b)} for spans in (t, p))
        assert got[n]["iou"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def records(spark, n=300):
    random.seed(5)
    rows = []
    for i in range(n):
        true, pred = random.choice(LABELS), random.choice(LABELS)
        rows.append(("s", f"p{i // 4}", true, pred, round(random.random(), 1)))
    return rows, spark.createDataFrame(rows, "scenario string, parent_id string, true_label string, predicted_label string, knownness_score double")


def test_rates_and_open_set_curve(spark):
    rows, df = records(spark)
    null = [r for r in rows if r[2] == "none"]
    doc = E.document_fwer(df).first()
    assert (doc["errors"], doc["trials"]) == (sum(r[3] != "none" for r in null), len(null))
    par = E.parent_fwer(df).first()
    assert par["errors"] == len({r[1] for r in null if r[3] != "none"}) and par["trials"] == len({r[1] for r in null})
    known = [r for r in rows if r[2].startswith("known")]
    unknown = [r for r in rows if r[2] == "suspected_unknown_scheme"]
    points = {0.0: 0.0}
    for cut in [*sorted({r[4] for r in known + unknown}, reverse=True), -1.0]:
        x = sum(r[4] >= cut for r in unknown) / len(unknown)
        points[x] = max(points.get(x, 0.0), sum(r[2] == r[3] and r[4] >= cut for r in known) / len(known))
    xs = sorted(points)
    area = sum((b - a) * (points[a] + points[b]) / 2 for a, b in zip(xs, xs[1:]))
    assert E.oscr(df).first()["oscr"] == pytest.approx(area)
    assert E.oscr(df.where("true_label = 'none'")).first()["oscr"] is None
    assert E.confusion(df).count() == 25


def test_bootstrap_is_repeatable_and_brackets(spark):
    _, df = records(spark)
    a = E.bootstrap_macro_f1(df, replicates=200).first()
    b = E.bootstrap_macro_f1(df.repartition(7), replicates=200).first()
    assert a == b and a["lower"] <= a["estimate"] <= a["upper"]


def test_auroc_with_ties(spark):
    random.seed(6)
    data = [(random.random() < 0.4, round(random.random(), 1)) for _ in range(200)]
    pos = [s for p, s in data if p]
    neg = [s for p, s in data if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "p boolean, s double").withColumn("k", F.lit(1))
    assert selection.auroc(df, ["k"], "s", F.col("p")).first()["auroc"] == pytest.approx(want)
