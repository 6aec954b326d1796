from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tracewell import catalog
from tracewell.operators import assembly, evidence, planning
from tracewell.sources import tables
from tracewell.plans import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parents(spark):
    rows = [
        (f"{src}-{i:03d}", src, "en" if src < "c" else "zh", split, hashlib.sha256(f"{src}{split}{i}".encode()).hexdigest())
        for src in "abcd" for split, n in (("train", 75), ("dev", 25), ("calibration", 50), ("test", 50))
        for i in range({"train": 0, "dev": 100, "calibration": 200, "test": 300}[split], {"train": 0, "dev": 100, "calibration": 200, "test": 300}[split] + n)
    ]
    return spark.createDataFrame(rows, "parent_id string, source string, language string, split string, text_sha256 string")


def test_recipe_plan_is_balanced(spark, parents):
    slotted = planning.key_slots(parents).cache()
    plan = planning.plan_recipes(slotted).cache()
    kinds = {r["kind"]: r["count"] for r in plan.groupBy("kind").count().collect()}
    assert kinds == {"base_generation": 4000, "matched_attack": 4000, "mixed_document": 400}
    gap = slotted.groupBy("source", "split").agg(F.abs(F.sum(F.when(F.col("key_slot") == "a", 1).otherwise(-1))).alias("d"))
    assert gap.where("d > 1").count() == 0
    attacks = plan.where("kind = 'matched_attack'").groupBy("source", "split", "base_variant").pivot("attack_id").count()
    spread = attacks.select(F.array_max(F.array(*attacks.columns[3:])) - F.array_min(F.array(*attacks.columns[3:])))
    assert {r[0] for r in spread.collect()} <= {0, 1}
    pairs = plan.where("kind = 'mixed_document'").select("recipe_id", F.explode("parent_ids").alias("p"))
    assert pairs.groupBy("p").count().where("count <> 1").count() == 0 and pairs.count() == 800
    again = planning.plan_recipes(planning.key_slots(parents.repartition(9)))
    assert plan.select("recipe_id", "attack_id", "key_id").exceptAll(again.select("recipe_id", "attack_id", "key_id")).count() == 0


def test_odd_pairing_group_is_refused(spark, parents):
    odd = planning.key_slots(parents.where("parent_id <> 'a-000'"))
    with pytest.raises(Exception, match="even parent count"):
        planning.mixed_recipes(odd).collect()


def test_canary_selection_and_its_problems(spark, parents):
    mixed = planning.plan_recipes(planning.key_slots(parents)).where("kind = 'mixed_document'").cache()
    targets = {"train": 12, "dev": 4}
    pairs = planning.canary_pairs(mixed, parents, targets)
    assert planning.canary_problems(mixed, parents, targets).count() == 0
    assert planning.canary_imbalance(pairs, mixed, parents, targets).count() == 0
    assert planning.require_canary(pairs, planning.canary_problems(mixed, parents, targets)).count() == pairs.count() > 0
    many = {"train": 500, "dev": 4}
    problems = {(r["language"], r["split"], r["violation"]) for r in planning.canary_problems(mixed, parents, many).collect()}
    assert problems == {("en", "train", "no_balanced_selection"), ("zh", "train", "no_balanced_selection")}
    partial = planning.canary_pairs(mixed, parents, many)
    assert {r["split"] for r in partial.collect()} == {"dev"}
    with pytest.raises(Exception, match="no balanced canary"):
        planning.require_canary(partial, planning.canary_problems(mixed, parents, many)).collect()
    third = parents.withColumn("source", F.when(F.col("parent_id").startswith("a-00"), "bb").otherwise(F.col("source")))
    found = {(r["language"], r["violation"]) for r in planning.canary_problems(mixed, third, targets).collect()}
    assert ("en", "not_two_sources") in found and ("zh", "not_two_sources") not in found
    short = planning.canary_imbalance(pairs.where("language = 'en'"), mixed, parents, targets)
    assert {r["language"] for r in short.collect()} == {"zh"}


def test_split_audit_finds_leaks(parents):
    assert planning.audit_splits(parents).count() == 0
    leaked = parents.unionByName(parents.limit(1).withColumn("split", F.lit("other")))
    assert {r["violation"] for r in planning.audit_splits(leaked).collect()} == {"split_leak", "duplicate_text"}


def test_sealed_splits_fail(spark, parents):
    assert planning.split_summary(parents).first()["unique_parent_ids"] == 800
    with pytest.raises(Exception, match="sealed split"):
        assembly.require_splits(parents, ["train"]).collect()


def test_jsonl_refuses_overwrite_and_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None)], "b int, a string, c string")
    path = str(tmp_path / "rows")
    tables.write_jsonl(df, path)
    assert spark.read.text(path).first()[0] == '{"a":"x","b":1,"c":null}'
    with pytest.raises(Exception):
        tables.write_jsonl(df, path)
    (tmp_path / "bad.json").write_text('{"a":"x"}\n[1]\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.json"), df.schema).collect()


def test_file_manifest_hashes_files_of_any_content(spark, tmp_path):
    import random

    contents = {
        "empty": b"", "newline": b"\n", "two": b"\n\n", "bare": b"abc", "ended": b"abc\n", "windows": b"a\r\nb\r\n", "cr": b"a\rb\r",
        "binary": random.Random(3).randbytes(400_000), "zeros": bytes(3000), "sp ace%20+ü": "é\n日本".encode(), "long": b"x" * 300_000 + b"\n" + b"y" * 200_000,
    }
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub" / "bare").write_bytes(b"other\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000b")
    try:
        got = {r["file"]: (r["bytes"], r["sha256"]) for r in tables.file_manifest(spark, str(tmp_path)).collect()}
        sub = tables.file_manifest(spark, str(tmp_path / "sub"), "ba*").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    assert [(r["file"], r["sha256"]) for r in sub] == [("bare", hashlib.sha256(b"other\n").hexdigest())]


def test_every_query_has_a_name_and_most_have_sql():
    queries, sql = catalog.load()
    assert set(sql) <= set(queries) and len(queries) >= 110
    assert set(queries) <= set(entry_points.queries()) and set(sql) <= set(entry_points.oracle_sql())
    assert set(queries) - set(sql) == {
        "s3_file_manifest", "f9_mahalanobis", "m1_logistic_regression", "m2_perceptron", "m3_boosted_trees",
    }


def test_flagship_runs(spark):
    out = entry_points.entry(spark)
    rows = out.collect()
    want = corpus.rows(spark, SF).where("status = 'generated' and split = 'test'").count()
    assert len(rows) == want > 0
    assert all(0 < r["generic_p"] <= 1 for r in rows)


def test_resume_check_moves_no_texts(spark):
    """A text is held against its hash where it is read: joins see the outcome alone, and the written rows have no texts."""
    good = hashlib.sha256(b"some text").hexdigest()
    rows = [("a", "generated", "some text", good, "dev"), ("b", "generated", "other", good, "dev"), ("c", "failed", None, None, "dev"),
            ("d", "generated", None, good, "test"), ("d", "generated", "some text", good, "test"), ("e", None, "x", good, "dev")]
    done = spark.createDataFrame(rows, "recipe_id string, status string, text string, text_sha256 string, split string")
    plan = spark.createDataFrame([(r, "dev") for r in "abcd"], "recipe_id string, split string")
    found = assembly.resume_violations(plan, done, ["split"])
    assert "text_sha256#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [
        ("b", "text_hash_mismatch"), ("d", "changed_split"), ("d", "duplicate"), ("d", "text_hash_mismatch"), ("e", "not_selected")]
    assert "text" not in corpus.rows(spark, SF).columns


def test_requests_are_not_dealt_by_detector(spark):
    """Every segment text would go to the task of its detector."""
    registry = evidence.DetectorRegistry()
    registry.register(evidence.Detector("k", scheme_family="kgw", score=lambda b: b["segment_text"].str.len(), supported_languages=("en",)))
    requests = spark.createDataFrame(
        [("d1", "c1", 0, 3, "k", "en", 70, "abc", "kgw_key_a", None), ("d2", "c1", 0, 3, "no", "en", 70, "abc", "kgw_key_a", None)],
        "document_id string, candidate_id string, char_start int, char_end int, detector_id string, language string, effective_length int, "
        "segment_text string, key_id string, calibration_id string")
    out = registry.run(requests)
    assert "hashpartitioning(detector_id" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["document_id"], r["raw_statistic"]) for r in out.collect()] == [("d1", 3.0)]
