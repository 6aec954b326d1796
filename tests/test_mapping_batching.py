from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracewell.operators import batching, charmap, monitoring


def test_token_values_fill_nearest_left_on_ties(spark):
    tokens = spark.createDataFrame([(1, 0, 2, True, 1.0), (1, 3, 4, True, 3.0)],
                                   "doc_id int, char_start int, char_end int, valid boolean, value double")
    lengths = spark.createDataFrame([(1, 5)], "doc_id int, n_chars int")
    runs = charmap.covered_runs(tokens, lengths)
    assert charmap.coverage(runs).first()["mapping_coverage"] == pytest.approx(3 / 5)
    assert charmap.expand_runs(charmap.fill_nearest(runs)).first()["scores"] == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_runs_in_rows_equal_runs_over_tokens_without_a_shuffle(spark):
    random.seed(11)
    text = lambda: "".join(random.choice("ab é😀  \n\u3000") for _ in range(random.randint(0, 60)))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate([text() for _ in range(40)] + ["", " ", "a"])], "doc_id int, text string, n_chars int")
    value = lambda i: ((F.col("doc_id") * 7 + i * 3) % 11).cast("double")
    long = charmap.tokens(docs)
    rows = charmap.token_arrays(docs).union(spark.createDataFrame([(90, 3)], "doc_id int, n_chars int").withColumn(
        "tokens", F.array().cast("array<struct<token_index:int,char_start:int,char_end:int>>")))
    assert sorted(rows.select("doc_id", F.inline("tokens")).collect()) == sorted(long.collect())
    long = long.withColumns({"valid": F.col("token_index") % 3 != 0, "value": value(F.col("token_index"))})
    rows = rows.withColumn("tokens", F.transform("tokens", lambda t: F.struct(
        t["char_start"].alias("char_start"), t["char_end"].alias("char_end"), (t["token_index"] % 3 != 0).alias("valid"),
        value(t["token_index"]).alias("value"))))
    lengths = docs.select("doc_id", "n_chars").union(spark.createDataFrame([(90, 3)], "doc_id int, n_chars int"))
    runs, own = charmap.covered_runs(long, lengths), charmap.covered_runs(rows)
    order = lambda df: sorted(df.collect(), key=str)
    assert order(own.select("doc_id", F.inline("runs"))) == order(runs)
    assert order(charmap.coverage(own).drop("n_chars", "runs")) == order(charmap.coverage(runs))
    filled = charmap.fill_nearest(own, strict=False)
    assert order(filled.select("doc_id", F.inline("runs"))) == order(charmap.fill_nearest(runs, strict=False))
    scores = charmap.expand_runs(filled).drop("n_chars")
    assert order(scores) == order(charmap.expand_runs(charmap.fill_nearest(runs, strict=False)))
    plan = charmap.expand_runs(charmap.fill_nearest(charmap.coverage(charmap.covered_runs(charmap.token_arrays(docs).withColumn(
        "tokens", F.transform("tokens", lambda t: t.withField("valid", F.lit(True)).withField("value", F.lit(1.0)))))))
    )._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_documents_that_share_a_key_are_an_error(spark):
    with pytest.raises(Exception, match="token offset beyond the text"):
        charmap.unshared(spark.createDataFrame([(1, 2), (1, 2)], "doc_id int, n int")).collect()


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_boundary_map_equals_prefix_normalisation(form):
    random.seed(7)
    alphabet = ["a", "e", "́", "̣", "ﬀ", "中", "😀", "가", "ᄀ", "ᅡ", "ᆨ", "ｶ", "ﾞ", "̈́", " "]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 14))) for _ in range(400)]
    for text in texts:
        want = [len(unicodedata.normalize(form, text[:i])) for i in range(len(text) + 1)]
        got = [r["norm"] + k for r in charmap.boundary_runs(text, form) for k in range(r["length"])]
        assert got == want, (text, form)


def test_normalised_spans_to_raw(spark):
    df = spark.createDataFrame([(1, "éx"), (2, "ﬀa")], "doc_id int, text string")
    maps = charmap.with_boundary_map(df).join(df, "doc_id")
    span = lambda a, b: charmap.raw_span(F.col("runs"), F.lit(a), F.lit(b), F.length("text"))
    got = {r["doc_id"]: [tuple(r["x"]), tuple(r["y"])] for r in maps.select("doc_id", span(0, 1).alias("x"), span(1, 2).alias("y")).collect()}
    assert got[1] == [(0, 2), (2, 3)]
    assert got[2][0] == (0, 1)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_packing_is_the_sequential_result_for_any_range_count(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        packing_is_sequential(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def packing_is_sequential(spark):
    random.seed(8)
    sizes = {(s, f"p{random.randint(0, 10**6)}"): random.randint(1, 9) for s in ("train", "dev") for _ in range(150)}
    rows = [(s, p) for (s, p), n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "split string, parent_id string").repartition(6)
    got = {(r["split"], r["parent_id"]): (r["batch_id"], r["shard"]) for r in batching.pack_batches(df).collect()}
    for split in ("train", "dev"):
        fill, batch = 0, 0
        for (s, p) in sorted(k for k in sizes if k[0] == split):
            if fill + sizes[(s, p)] > 20:
                fill, batch = 0, batch + 1
            fill += sizes[(s, p)]
            assert got[(s, p)] == (batch, batch // 16)


def test_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "parent_id string, intervention_id string")
    got = batching.pair_diagnostics(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert (got["positive_pairs"], got["negative_pairs"], got["singleton_groups"]) == (4, 8, 0)
    rows = spark.createDataFrame([("t", "r0", None), ("t", "r1", "r0"), ("d", "r2", "r0")], "split string, recipe_id string, base_recipe_id string")
    assert [(r["base_recipe_id"], r["recipe_id"]) for r in batching.consistency_pairs(rows, ["split"]).collect()] == [("r0", "r1")]


def test_sustained_breach_needs_the_grace_time(spark):
    rows = [("t", 0, 90.0), ("t", 60, 91.0), ("t", 90, 10.0), ("t", 3590, 90.0), ("t", 3700, 90.0), ("t", 3720, 95.0)]
    log = spark.createDataFrame(rows, "task_id string, seq int, temperature double").withColumn("time", F.timestamp_seconds("seq"))
    got = monitoring.sustained_breaches(log, limit=85.0).first()
    assert got["breach_time"].minute == 2 and got["breach_points"] == 1


def test_feature_store_round_trip_and_damage(spark, tmp_path):
    from tracewell.sources import features

    kind = ("document_id string, a_values array<array<float>>, a_mask array<boolean>, a_offsets array<array<int>>, "
            "b_values array<array<float>>, b_mask array<boolean>, b_offsets array<array<int>>")
    spots = [[0, 3], [-1, -1]]
    good = ("ok", [[1.0, 2.0], [3.0, 4.0]], [True, True], spots, [[5.0], [6.0]], [True, False], spots)
    rows = [good, ("offsets", *good[1:6], [[0, 3], [4, 5]]), ("short", *good[1:4], [[5.0]], *good[5:]), ("wrong", *good[1:]), ("lost", *good[1:])]
    df = spark.createDataFrame(rows, kind)
    manifest = features.save_features(df, str(tmp_path / "store"), ["a", "b"])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        features.save_features(df, str(tmp_path / "store"), ["a", "b"])
    with pytest.raises(Exception, match="not finite"):
        features.save_features(spark.createDataFrame([("nan", [[float("nan")]], *good[2:])], kind), str(tmp_path / "bad"), ["a", "b"])
    back = features.load_features(spark, str(tmp_path / "store"), manifest, ["a", "b"])
    found = {r["document_id"]: r for r in back.collect()}
    assert found["ok"]["violation"] is None and found["ok"]["valid_mask"] == [True, False]
    assert found["ok"]["a_values"] == [[1.0, 2.0], [3.0, 4.0]] and found["ok"]["offsets"] == spots
    assert found["offsets"]["violation"] == "inconsistent_offsets" and found["short"]["violation"] == "not_aligned"
    stored = spark.read.parquet(str(tmp_path / "store"))
    hit = F.when(F.col("document_id") == "ok", F.array(F.array(F.lit(9.0).cast("float")))).otherwise(F.col("b_values"))
    stored.where("document_id <> 'lost'").withColumn("b_values", hit).write.parquet(str(tmp_path / "copy"))
    listed = manifest.withColumn("feature_sha256", F.when(F.col("document_id") == "wrong", F.lit("0")).otherwise(F.col("feature_sha256")))
    found = {r["document_id"]: r["violation"] for r in features.load_features(spark, str(tmp_path / "copy"), listed, ["a", "b"]).collect()}
    assert found == {"ok": "hash_mismatch", "wrong": "hash_mismatch", "lost": "missing", "offsets": "inconsistent_offsets", "short": "not_aligned"}
    with pytest.raises(Exception, match="hash_mismatch"):
        features.require_verified(features.load_features(spark, str(tmp_path / "copy"), listed.where("document_id = 'ok'"), ["a", "b"])).collect()


def test_ensemble_scores_stay_in_their_stretch(spark, tmp_path):
    """Totals and heads equal a plain restatement, for shared and null ids and stretches of any number; no token is dealt."""
    import hashlib

    from tracewell import catalog

    unit = lambda *parts: (int(hashlib.sha256(":".join(map(str, (20260815, *parts))).encode()).hexdigest()[8:16], 16) & 2147483647) / 2147483648
    docs = [(1, "a " * 70), (2, "one"), (3, " \n"), (4, None), (5, "x y " * 40), (5, "z " * 33), (6, "w " * 5000), (None, "v u")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.load()[0]["a22_ensemble_heads"](spark, str(tmp_path))
    assert "token_index" not in str(plan._jdf.queryExecution().executedPlan()).replace("struct<token_index", "")
    got = {r["doc_id"]: (r["token_total"], r["window_maximum"], r["overall_mean"]) for r in plan.collect()}
    sizes = {1: 70, 2: 1, 5: 113, 6: 5000}
    assert set(got) == set(sizes)
    for d, n in sizes.items():
        of = lambda t: [unit(d, m, w, t) for w in (t // 32 - 1, t // 32) if w >= 0 for m in range(3)]
        total = sum(sum(of(t)) / len(of(t)) for t in range(n))
        heads = [[unit(d, m, w, "head") for m in range(3)] for w in range((n - 1) // 32 + 1)]
        want = (total, max(sum(h) / 3 for h in heads), sum(map(sum, heads)) / sum(map(len, heads)))
        assert all(abs(a - b) < 1e-4 for a, b in zip(got[d], want, strict=True))
