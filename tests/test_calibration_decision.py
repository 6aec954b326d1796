from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.functions.stats import upper_bound
from tracewell.operators import calibration, decision, evidence

ITEMS = "array<struct<family:string,key_status:string,adjusted_p:double,applicability:string>>"


def test_empirical_p_both_tails_and_unknown_stratum(spark):
    pool = spark.createDataFrame([("s", float(i)) for i in range(4)], "stratum string, maximum_statistic double")
    seen = spark.createDataFrame([("s", 4.0), ("s", 2.0), ("x", 1.0)], "stratum string, v double")
    keys = {"stratum": F.col("stratum")}
    up = {(r["stratum"], r["v"]): r["p"] for r in calibration.attach_p(seen, pool, keys, value="v", out="p").collect()}
    assert up == {("s", 4.0): 0.2, ("s", 2.0): 0.6, ("x", 1.0): None}
    low = {(r["stratum"], r["v"]): r["p"] for r in calibration.attach_p(seen, pool, keys, value="v", out="p", lower=True).collect()}
    assert low[("s", 2.0)] == 0.8


def test_empirical_p_of_a_value_that_a_third_of_the_rows_share(spark, monkeypatch):
    import random

    draw = random.Random(7)
    pool = [(k, draw.choice([0.0, 0.0, draw.random(), -draw.random()])) for k in "ab" for _ in range(300)] + [(None, 0.5)]
    seen = [(i, draw.choice("aaab"), 0.0 if i % 3 == 0 else round(draw.uniform(-1, 1), 2)) for i in range(3000)]
    seen += [(5000, "c", 1.0), (5001, "a", None), (5002, None, 0.5), (5003, "a", -0.0)]
    df = spark.createDataFrame(seen, "i long, stratum string, v double").withColumn("_n", F.lit("clash"))
    nulls = spark.createDataFrame(pool, "stratum string, maximum_statistic double")
    staged_ranges = []
    real = calibration.in_ranges
    monkeypatch.setattr(calibration, "in_ranges", lambda *a: staged_ranges.append(real(*a)) or staged_ranges[-1])
    for lower in (False, True):
        got = {r["i"]: r["p"] for r in calibration.attach_p(df, nulls, {"stratum": F.col("stratum")}, value="v", out="p", lower=lower).collect()}
        assert len(got) == len(seen)
        for i, k, v in seen:
            own = [x for s, x in pool if s == k]
            more = sum(x <= v if lower else x >= v for x in own) if v is not None else 0
            assert got[i] == (pytest.approx((more + 1) / (len(own) + 1)) if own and v is not None else None)
        sizes = [r["count"] for r in staged_ranges[-1].groupBy("_range").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    assert calibration.attach_p(df.limit(0), nulls, {"stratum": F.col("stratum")}, value="v", out="p").count() == 0


def test_exact_upper_bounds():
    assert upper_bound(0, 200, 0.95) == pytest.approx(0.014867, abs=1e-6)
    assert upper_bound(48, 200, 0.95) == pytest.approx(0.294900, abs=1e-6)
    assert upper_bound(0, 299, 0.95) < 0.01 < upper_bound(0, 298, 0.95)
    assert upper_bound(5, 5, 0.95) == 1.0


def test_ordered_digest_is_free_of_partitions(spark):
    import hashlib
    import random

    from tracewell.operators import digest

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    draw = random.Random(9)
    rows = [(draw.choice("ab"), i, draw.choice(["x", None, "y:z"])) for i in range(2500)] + [("c", 1, "once"), ("a", 7, "same id"), (None, 3, "n")]

    def plain(of):
        nodes = [sha(("-" if v is None else f"{len(v)}:{v}")) for _, _, v in of]
        while True:
            nodes = [sha("".join(nodes[i : i + 1024])) for i in range(0, len(nodes), 1024)]
            if len(nodes) == 1:
                return nodes[0]

    want = {}
    for g in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], sha("-" if r[2] is None else f"{len(r[2])}:{r[2]}")))
        want[g] = (len(own), plain(own))
    df = spark.createDataFrame(rows, "g string, i long, v string")
    for parts in (1, 7):
        found = digest.ordered_digest(df.repartition(parts), ["i"], digest.row_digest(F.col("v")), ["g"])
        assert {r["g"]: (r["rows"], r["content_digest"]) for r in found.collect()} == want
    other = df.withColumn("v", F.when(F.col("i") == 1200, F.lit("changed")).otherwise(F.col("v")))
    assert {r["content_digest"] for r in digest.ordered_digest(other, ["i"], digest.row_digest(F.col("v"))).collect()} != {
        r["content_digest"] for r in digest.ordered_digest(df, ["i"], digest.row_digest(F.col("v"))).collect()}
    assert digest.ordered_digest(df.limit(0), ["i"], F.col("v")).count() == 0


def parent_records(spark, parents=100):
    rows = [
        ("primary", route, f"{lang}:all", f"{lang}{i}", f"{lang}{i}-{k}", "calibration", float(i + k))
        for lang in ("en", "zh") for i in range(parents) for route in ("generic", "registered", "gap") for k in (0, 1)
    ]
    return spark.createDataFrame(
        rows, "pool string, route string, stratum string, parent_id string, document_id string, split string, maximum_statistic double"
    )


def test_parent_pool_keeps_the_largest_descendant(spark):
    records = parent_records(spark)
    pool = calibration.parent_pool(records, minimum_parents=100)
    summary = {(r["route"], r["stratum"]): r for r in calibration.pool_summary(pool).collect()}
    assert summary[("generic", "en:all")]["n"] == 100
    assert summary[("gap", "zh:all")]["minimum_p"] == pytest.approx(1 / 101)
    assert summary[("generic", "en:all")]["lowest"] == 1.0
    assert calibration.pool_violations(records, minimum_parents=100).count() == 0
    few = {r["violation"] for r in calibration.pool_violations(records, minimum_parents=101).collect()}
    assert few == {"too_few_parents_generic", "too_few_parents_registered", "too_few_parents_gap"}
    crossing = records.withColumn("stratum", F.when(F.col("document_id") == "en0-0", "zh:all").otherwise(F.col("stratum")))
    assert "parent_crosses_strata" in {r["violation"] for r in calibration.pool_violations(crossing, minimum_parents=1).collect()}


def test_pool_round_trip_refuses_another_search(spark, tmp_path):
    pool = calibration.parent_pool(parent_records(spark, 5)).drop("pool")
    fields = ("calibration_id", "protocol_version", "data_manifest_hash", "search_config_hash", "registered_registry_hash",
              "normalization_version", "model_version", "languages", "strata")
    header = spark.createDataFrame([tuple("x" for _ in fields)], ",".join(f"{f} string" for f in fields))
    path = str(tmp_path / "pool")
    calibration.save_pool(pool, header, path)
    assert calibration.load_pool(spark, path, header.withColumn("calibration_id", F.lit("other"))).count() == 30
    stored = spark.read.parquet(f"{path}/values")
    changed = stored.withColumn("maximum_statistic", F.when(F.col("parent_id") == "en0", 99.0).otherwise(F.col("maximum_statistic")))
    for name, copy, fine in (("changed", changed, False), ("fewer", stored.where("parent_id <> 'en0'"), False), ("dealt", stored.repartition(9), True)):
        other = str(tmp_path / name)
        copy.write.partitionBy("route", "stratum").parquet(f"{other}/values")
        spark.read.json(f"{path}/header").write.json(f"{other}/header")
        if fine:
            assert calibration.load_pool(spark, other, header).count() == 30
        else:
            with pytest.raises(ValueError, match="checksum"):
                calibration.load_pool(spark, other, header)
    with pytest.raises(ValueError):
        calibration.load_pool(spark, path, header.withColumn("search_config_hash", F.lit("other")))


CASES = [
    # items, generic p, gap p, validity, label
    ([("kgw", "registered", 0.001, "valid")], 0.5, 0.5, [], "known_scheme_known_key"),
    ([("kgw", "scheme_only", 0.001, "valid")], 0.001, 0.001, [], "known_scheme_unknown_key"),
    ([("kgw", "registered", 0.5, "valid")], 0.001, 0.5, [], "suspected_unknown_scheme"),
    ([("kgw", "scheme_only", 0.001, "valid")], 0.5, 0.5, [], "uncertain"),
    ([("kgw", "registered", 0.5, "valid")], 0.5, 0.5, [], "none"),
    ([("kgw", "registered", 0.001, "valid")], 0.001, 0.001, ["unsupported_language"], "uncertain"),
    ([("kgw", "registered", 0.001, "valid"), ("unigram", "registered", 0.001, "valid")], 0.5, 0.5, [], "uncertain"),
    ([("kgw", "registered", 0.01, "valid")], 0.5, 0.5, [], "known_scheme_known_key"),
    ([("kgw", "registered", 0.001, "invalid")], 0.5, 0.5, [], "none"),
]


def test_segment_truth_table(spark):
    rows = [(i, items, g, gap, v) for i, (items, g, gap, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, items {ITEMS}, generic_p double, gap_p double, validity_reasons array<string>")
    got = {r["i"]: r for r in decision.decide_segments(df, alpha=0.01).collect()}
    assert [got[i]["label"] for i in range(len(CASES))] == [c[-1] for c in CASES]
    assert got[6]["abstain_reasons"] == ["registered_evidence_conflict"]
    assert got[3]["abstain_reasons"] == ["no_key_independent_scheme_test"]


def test_documents_without_segments_stay(spark):
    docs = spark.createDataFrame([("a", []), ("b", []), ("c", ["x"])], "document_id string, validity_reasons array<string>")
    segs = spark.createDataFrame(
        [("a", "none", 0, 5), ("a", "suspected_unknown_scheme", 6, 9)], "document_id string, label string, char_start int, char_end int"
    ).withColumns({"registered_p": F.lit(0.5), "gap_p": F.lit(0.5), "items": F.array().cast(ITEMS)})
    got = {r["document_id"]: r for r in decision.decide_documents(docs, segs, ["document_id"]).collect()}
    assert {k: r["document_label"] for k, r in got.items()} == {"a": "suspected_unknown_scheme", "b": "none", "c": "uncertain"}
    assert got["a"]["label_set"] == ["none", "suspected_unknown_scheme"] and got["a"]["any_accept"]
    assert [tuple(s) for s in got["a"]["predicted_intervals"]] == [(6, 9)]


def test_masking_and_short_segments(spark):
    base = spark.createDataFrame([("d", "c", "candidate", 0), ("d", "f", "full_text", 5)],
                                 "document_id string, candidate_id string, interval_role string, detector_token_count int")
    tests = evidence.gate_tokens(evidence.expand_tests(base, scheme_only=True))
    assert tests.count() == 24
    bad = tests.where("applicability = 'invalid'")
    assert {r["reason_codes"][-1] for r in bad.where("candidate_id = 'c'").collect()} == {"zero_detector_tokens"}
    assert {r["scheme_family"] for r in bad.where("candidate_id = 'f'").collect()} == {"unbiased"}
    masked = evidence.mask_evidence(tests, [evidence.Scenario("a_only", ("a",)), evidence.Scenario("x", ("a", "b"), "kgw")])
    counts = {r["scenario"]: r["count"] for r in masked.groupBy("scenario").count().collect()}
    assert counts == {"a_only": 16, "x": 18}


def test_tests_of_an_interval_are_the_rows_of_the_grid(spark):
    rows = [("d1", "c1", 0, 40, "candidate", 3), ("d1", "full-text", 0, 90, "full_text", 0), (None, "c2", 5, 9, "candidate", 9)]
    schema = "document_id string, candidate_id string, char_start int, char_end int, interval_role string, detector_token_count int"
    intervals = spark.createDataFrame(rows, schema)
    keyed = lambda family, slot: F.length(F.concat(family, slot)) + F.col("char_end") * 1.0
    probe = lambda family: F.length(family) * -1.0
    family, status = F.col("scheme_family"), F.col("key_status")
    long = evidence.expand_tests(intervals, scheme_only=True)
    raw = F.when(status == "registered", keyed(family, F.col("key_slot"))).otherwise(probe(family))
    long = evidence.orient(evidence.gate_tokens(long.withColumn("raw_statistic", raw)))
    upper = status == "scheme_only"
    long = long.withColumns({
        "tail_direction": F.when(upper, "upper").otherwise(F.col("tail_direction")),
        "evidence_strength": F.when(upper, F.col("raw_statistic")).otherwise(F.col("evidence_strength")),
    })
    nested = evidence.interval_tests(intervals, keyed, probe)
    flat = nested.select("*", F.inline("tests")).drop("tests")
    wanted = sorted(map(str, long.select(*flat.columns).collect()))
    assert len(wanted) == 36 and sorted(map(str, flat.collect())) == wanted

    scenarios = [evidence.Scenario("a_only", ("a",)), evidence.Scenario("x", ("a", "b"), "kgw")]
    names = ["scenario", "candidate_id", "scheme_family", "key_slot"]
    masked = evidence.mask_tests(nested, scenarios)
    assert masked.count() == 6  # a row an interval and scenario, whatever the size of the grid
    told = sorted(map(str, masked.select("scenario", "candidate_id", F.inline("tests")).select(*names).collect()))
    assert told == sorted(map(str, evidence.mask_evidence(long, scenarios).select(*names).collect()))


def test_candidates_meet_intervals_before_tests_and_scenarios_multiply(spark):
    from tracewell.plans import attribution as A

    docs = spark.sql(
        "SELECT id AS document_id, array(named_struct('candidate_id', 'c', 'char_start', 0, 'char_end', 9)) AS candidates "
        "FROM VALUES ('once'), ('twice'), ('twice'), (CAST(NULL AS STRING)) AS v(id)"
    )
    test = "named_struct('scheme_family', {0}, 'key_status', 'registered', 'key_id_hash', 'h', 'applicability', {1}, 'raw_statistic', {2}, 'evidence_strength', {2})"
    tests = ", ".join(test.format(*t) for t in (("'kgw'", "'valid'", "1.5D"), ("'unigram'", "'invalid'", "9D"), ("'synthid'", "'valid'", "2D")))
    ev = docs.selectExpr(
        "document_id", "explode(array('candidate', 'full_text')) AS interval_role", "'c' AS candidate_id", "0 AS char_start",
        "if(interval_role = 'candidate', 9, 20) AS char_end", f"array({tests}) AS tests",
    )
    found = A.segment_tests(docs, ev)
    sizes = {r["document_id"]: (len(r["tests"]), r["best_strength"]) for r in calibration.best_strengths(found).collect()}
    # Invalid tests are out; two rows of an id meet the intervals of both, as rows joined by the id do.
    assert sizes == {"once": (4, 2.0), "twice": (16, 2.0)}


def test_tests_of_a_document_equal_the_joins_by_interval(spark):
    import collections

    candidate = "named_struct('candidate_id', '{0}', 'char_start', {1}, 'char_end', {2})"
    lists = {
        "a": [("c0", 0, 9), ("c1", 9, 20)], "b": [("c0", 3, 7)], "none": [], "unmet": [("c0", 1, 2)], "twin": [("c0", 0, 5), ("c1", 5, 8)],
    }
    array = lambda cs: f"array({', '.join(candidate.format(*c) for c in cs)})" if cs else f"slice(array({candidate.format('x', 0, 0)}), 1, 0)"
    docs = spark.sql(" UNION ALL ".join(f"SELECT '{d}' AS document_id, {array(cs)} AS candidates" for d, cs in [*lists.items(), ("twin", [("c0", 1, 5)])]))
    rows = [("a", "c0", 0, 9, "candidate"), ("a", "c1", 9, 20, "candidate"), ("a", "full-text", 0, 30, "full_text"), ("b", "c0", 3, 7, "candidate"),
            ("none", "full-text", 0, 4, "full_text"), ("twin", "c0", 0, 5, "candidate"), ("twin", "c1", 5, 8, "candidate"),
            ("twin", "c0", 1, 5, "candidate"), ("twin", "full-text", 0, 8, "full_text"), ("twin", "full-text", 0, 9, "full_text")]
    ev = spark.createDataFrame(rows, "document_id string, candidate_id string, char_start int, char_end int, interval_role string")
    ev = ev.withColumn("tests", F.array(F.concat_ws("-", "candidate_id", "char_start", "char_end")))

    places = docs.select("document_id", F.inline("candidates"))
    flat = evidence.evidence_for_candidates(places, ev.select("*", F.explode("tests").alias("test")).drop("tests"))
    wanted = collections.defaultdict(list)
    for r in flat.collect():
        wanted[r["document_id"], r["candidate_id"]].append(r["test"])
    found = evidence.tests_by_document(docs, ev).select("document_id", F.inline("found")).collect()
    got = {(r["document_id"], r["candidate_id"]): sorted(r["tests"]) for r in found}
    assert len(found) == len(got) and got == {k: sorted(v) for k, v in wanted.items()}
    assert ("unmet", "c0") not in got and len(got["twin", "c0"]) == 6


@pytest.mark.parametrize("alpha", [0.05, 0.2, 0.5, 0.9])
def test_significance_bounds_say_what_the_p_of_each_value_says(spark, alpha):
    import random

    rng = random.Random(5)
    sizes = {"one": 1, "few": 4, "many": 57, "ties": 40}
    nulls = [("primary", s, float(rng.randrange(4) if s == "ties" else rng.random())) for s, n in sizes.items() for _ in range(n)]
    pool = spark.createDataFrame(nulls, "pool string, stratum string, maximum_statistic double")
    values = sorted({v for _, _, v in nulls} | {rng.random() * 5 - 1 for _ in range(60)} | {99.0})
    seen = spark.createDataFrame([("primary", s, v) for s in [*sizes, "unknown"] for v in values], "pool string, stratum string, v double")
    keys = ["pool", "stratum"]
    told = seen.join(calibration.tail_p(seen, pool, keys, value="v"), [*keys, "v"], "left")
    told = told.join(calibration.significance_bounds(pool, keys, alpha=alpha), keys, "left")
    got = told.select("stratum", (F.col("p_value") <= alpha).alias("by_p"), calibration.beyond_bound(F.col("v")).alias("by_bound")).collect()
    assert len(got) == 5 * len(values) and all(r["by_p"] == r["by_bound"] for r in got)
    assert all((r["by_bound"] is None) == (r["stratum"] == "unknown") for r in got)


def test_flagged_items_decide_like_items_with_their_p(spark):
    own = spark.sql(
        "SELECT g AS generic_p, gap AS gap_p, array_min(transform(items, i -> i.adjusted_p)) AS registered_p, "
        "slice(array('x'), 1, 0) AS validity_reasons, items FROM VALUES (0.01D), (0.5D) AS a(g), VALUES (0.02D), (0.7D) AS b(gap), VALUES "
        + ", ".join(
            "(from_json('" + items + "', '" + ITEMS + "'))" for items in (
                "[]", '[{"family":"kgw","key_status":"registered","adjusted_p":0.05}]',
                '[{"family":"kgw","key_status":"scheme_only","adjusted_p":0.01},{"family":"unigram","key_status":"registered","adjusted_p":0.2}]',
                '[{"family":"kgw","key_status":"registered","adjusted_p":0.01},{"family":"unigram","key_status":"scheme_only","adjusted_p":0.03}]',
                '[{"family":"kgw","key_status":"registered"}]',
            )
        ) + " AS c(items)"
    )
    flags = F.transform("items", lambda i: F.struct(
        i["family"].alias("family"), i["key_status"].alias("key_status"), i["applicability"].alias("applicability"),
        (i["adjusted_p"] <= 0.05).alias("significant"),
    ))
    out = ["generic_p", "gap_p", "registered_p", "label", "abstain_reasons", "best_registered_p"]
    rows = lambda df: sorted(map(str, decision.decide_segments(df, alpha=0.05).select(*out).collect()))
    got = rows(own.withColumn("items", flags))
    assert len(got) == 20 and got == rows(own)


def test_ranks_within_arrays_equal_ranks_of_rows(spark):
    rows = [("d", "c", 3, 0.5), ("d", "c", 1, None), ("d", "c", 2, 0.5), ("d", "e", 1, 0.1), ("d", "e", 2, 1.0), ("d", "e", 0, None), (None, "c", 1, 0.2)]
    items = spark.createDataFrame(rows, "document_id string, candidate_id string, input_index int, adjusted_p double")
    by = ["document_id", "candidate_id"]
    # Two rows of a segment, as documents that share an id have.
    arrays = items.groupBy(*by, F.col("input_index") % 2).agg(F.collect_list(F.struct("input_index", "adjusted_p")).alias("tests"))
    names = [*by, "input_index", "adjusted_p", "evidence_rank"]
    told = lambda df: sorted(map(str, df.select(*names).collect()))
    assert told(evidence.rank_tests(arrays, by=by)) == told(evidence.rank_evidence(items, by=by))
