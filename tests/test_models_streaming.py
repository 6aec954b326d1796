from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import baselines, evidence, monitoring
from tracewell.schemas import RUN_LOG
from tracewell.sources import tables
from tracewell.streaming import runlog


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 5)) + labels[:, None]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))], "i int, c int, v array<double>").repartition(4)
    got = {r["i"]: r for r in baselines.Mahalanobis.fit(df, label="c", vector="v").score(df, vector="v").collect()}
    means = np.stack([x[labels == c].mean(axis=0) for c in range(3)])
    precision = np.linalg.pinv(np.cov(x - means[labels], rowvar=False) + 1e-5 * np.eye(5))
    gaps = x[:, None, :] - means[None]
    squared = np.einsum("nkd,df,nkf->nk", gaps, precision, gaps)
    assert np.allclose([got[i]["distance"] for i in range(90)], np.sqrt(squared.min(axis=1)))
    assert [got[i]["nearest"] for i in range(90)] == squared.argmin(axis=1).tolist()


def test_ood_scores_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 0.0, -1.0],)], "l array<double>")
    r = df.select(
        baselines.softmax_ood(F.col("l")).alias("s"), baselines.energy_ood(F.col("l"), 2.0).alias("e"),
        baselines.argmax_class(F.col("l")).alias("a"), baselines.argmax_class(F.col("l"), floor=4.0).alias("z"),
    ).first()
    v = np.array([1.0, 3.0, 0.0, -1.0])
    assert r["s"] == pytest.approx(1 - np.exp(3) / np.exp(v).sum())
    assert r["e"] == pytest.approx(-2 * np.log(np.exp(v / 2).sum())) and (r["a"], r["z"]) == (2, 0)


def test_logistic_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(1)
    rows = [(int(i % 2), (rng.normal(size=3) + 3 * (i % 2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "c int, v array<double>")
    model = baselines.fit_logistic(df, vector="v", label="c", iterations=50)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    out = baselines.predict(again, df, vector="v", label="c")
    assert out.where("predicted <> c").count() <= 4


def test_frozen_bundle_is_loaded_or_refused(spark, tmp_path):
    from tracewell.operators import bundles

    rng = np.random.default_rng(2)
    rows = [(i, int(i % 2), (rng.normal(size=3) + 3 * (i % 2)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, c int, v array<double>")
    model = baselines.fit_logistic(df, vector="v", label="c", iterations=50)
    header = {"kind": "logistic", "inputs": 3, "classes": 2}
    trained = bundles.training_header(df.repartition(5), key="k", vector="v", label="c")
    assert trained == bundles.training_header(df.coalesce(1), key="k", vector="v", label="c") and trained["training_rows"] == 60
    path = str(tmp_path / "bundle")
    bundles.save_model(model, path, header | trained, spark)
    loaded, told = bundles.load_model(spark, path, header | {"bundle_id": "another"})
    pick = lambda m: [tuple(r) for r in baselines.predict(m, df, vector="v", label="c").select("k", "predicted").orderBy("k").collect()]
    assert pick(loaded) == pick(model) and told["training_digest"] == trained["training_digest"]
    with pytest.raises(ValueError, match="compatible"):
        bundles.load_model(spark, path, dict(header, inputs=4))
    with pytest.raises(Exception):
        bundles.save_model(model, path, header, spark)
    text = spark.read.text(f"{path}/header").first()["value"].replace('"inputs": 3', '"inputs": 4')
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    with pytest.raises(ValueError, match="hash"):
        bundles.load_model(spark, path)


def log_rows(spark):
    rows = [(f"t{i % 3}", f"s{i}", "", i, float(50 + i), 1.0, 150.0) for i in range(30)]
    df = spark.createDataFrame(rows, "task_id string, status string, evidence string, seq long, temperature double, used_ram double, free_disk double")
    return df.withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60))


def test_stream_equals_batch(spark, tmp_path):
    log, path = log_rows(spark), str(tmp_path / "log")
    for part in ("seq < 10", "seq >= 10 and seq < 20", "seq >= 20"):
        tables.append_log(log.where(part).coalesce(1), path)
    rows = runlog.drain(runlog.live_status(runlog.read_log_stream(spark, path, RUN_LOG)), "test-status")
    flagged = runlog.breach_flags(rows, temperature=79.0, ram=26.0, disk=100.0)
    got = {r["task_id"]: (r["status"], r["points"], r["maximum_temperature"], r["temperature_breach"]) for r in flagged.collect()}
    latest = {r["task_id"]: r["status"] for r in monitoring.latest_status(log).collect()}
    summary = {r["task_id"]: r for r in monitoring.resource_summary(log).collect()}
    assert got == {
        t: (latest[t], summary[t]["points"], summary[t]["maximum_temperature"], summary[t]["maximum_temperature"] >= 79.0)
        for t in latest
    }


def first_breaches(rows, limit, grace):
    """Brute force: task -> (start, first breach) over (task, second, seq, temperature) rows."""
    found, begin = {}, {}
    for task, at, _, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if value is None or value < limit:
            begin.pop(task, None)
        elif at - begin.setdefault(task, at) >= grace and task not in found:
            found[task] = (begin[task], at)
    return found


def test_sustained_breach_equals_brute_force(spark):
    import random

    draw = random.Random(5)
    rows = [(draw.choice("abc"), draw.randrange(40_000), i, draw.choice([1.0, 9.0, 9.0, 9.0, None])) for i in range(900)]
    rows += [("hot", 60 * i, 10_000 + i, 9.0) for i in range(500)] + [("once", 5, 1, 9.0), ("null", 5, 1, None)]
    log = spark.createDataFrame(rows, "task_id string, at long, seq long, temperature double").withColumn("time", F.timestamp_seconds("at"))
    got = {r["task_id"]: (r["b"], r["t"]) for r in monitoring.sustained_breaches(log, limit=5.0, grace_seconds=300.0).select(
        "task_id", F.unix_seconds("begin_time").alias("b"), F.unix_seconds("breach_time").alias("t")).collect()}
    assert got == first_breaches(rows, 5.0, 300) and "hot" in got and "once" not in got
    assert monitoring.sustained_breaches(log.limit(0), limit=5.0).count() == 0


def breach_rows(df):
    return {r["task_id"]: (r["b"], r["t"], r["final"]) for r in df.select(
        "task_id", F.unix_seconds("begin_time").alias("b"), F.unix_seconds("breach_time").alias("t"), "final").collect()}


def test_live_breaches_settle_late_records(spark):
    kind = "task_id string, at long, seq long, temperature double"
    root = runlog.new_run(spark, "test-breach")

    def arrive(rows):
        df = spark.createDataFrame(rows, kind).withColumn("time", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = runlog.live_breaches(
            runlog.read_log_stream(spark, f"{root}/log", df.schema, fmt="parquet"), limit=5.0, grace_seconds=100.0, delay="500 seconds"
        )
        runlog.advance(stream, root)
        return breach_rows(runlog.newest(spark, root, ["task_id"]))

    t = 1_700_000_000
    first = arrive([("a", t, 1, 9.0), ("a", t + 100, 2, 9.0), ("b", t, 3, 9.0), ("b", t + 50, 4, 9.0), ("c", t, 5, 9.0)])
    assert first == {"a": (t, t + 100, False), "b": (None, None, False), "c": (None, None, False)}
    # A late low record undoes the breach of a, a late high one makes one of b.
    second = arrive([("a", t + 50, 6, 1.0), ("b", t + 120, 7, 9.0), ("c", t + 99, 8, None), ("c", t + 130, 9, 9.0)])
    assert second == {"a": (None, None, False), "b": (t, t + 120, False), "c": (None, None, False)}
    # The watermark passes all of these: what holds is final, and a record that comes too late changes nothing.
    arrive([("z", t + 2_000, 10, 1.0)])
    arrive([("z", t + 2_001, 11, 1.0)])
    third = arrive([("b", t + 60, 12, 1.0), ("a", t + 250, 13, 9.0), ("z", t + 2_002, 14, 1.0)])
    assert third["b"] == (t, t + 120, True) and third["a"] == (None, None, False) and third["z"] == (None, None, False)


def test_replayed_log_equals_batch(spark):
    import random

    draw = random.Random(6)
    rows = [(f"t{draw.randrange(6)}", 1_700_000_000 + draw.randrange(90_000), i, draw.choice([1.0, 9.0, 9.0, 9.0, 9.0, None])) for i in range(1500)]
    log = spark.createDataFrame(rows, "task_id string, at long, seq long, temperature double").withColumn("time", F.timestamp_seconds("at"))
    got = breach_rows(runlog.replayed_breaches(log, limit=5.0, grace_seconds=900.0, late_seconds=20_000, slices=3))
    assert {t: v[:2] for t, v in got.items() if v[1] is not None} == first_breaches(rows, 5.0, 900)
    assert runlog.replayed_breaches(log.limit(0), limit=5.0, late_seconds=10).count() == 0


def test_detectors_are_checked_before_they_run(spark):
    def _keyless(batch: pd.DataFrame) -> pd.Series:
        assert "key_id" not in batch.columns
        return batch["segment_text"].str.len()

    registry = evidence.DetectorRegistry()
    registry.register(evidence.Detector("probe", "kgw", _keyless, requires_key=False, calibration_id="c", minimum_effective_length=3))
    with pytest.raises(ValueError):
        registry.register(evidence.Detector("probe2", "kgw", _keyless, requires_key=False))
    rows = [
        ("ok", "en", 10, None, "c"), ("key", "en", 10, "kgw_key_a", "c"), ("lang", "xx", 10, None, "c"),
        ("short", "en", 1, None, "c"), ("calib", "en", 10, None, "other"),
    ]
    requests = spark.createDataFrame(rows, "document_id string, language string, effective_length int, key_id string, calibration_id string").withColumns(
        {"detector_id": F.lit("probe"), "candidate_id": F.lit("f"), "char_start": F.lit(0), "char_end": F.lit(4), "segment_text": F.lit("abcd")}
    )
    reasons = {r["document_id"]: r["reason"] for r in evidence.request_violations(requests, registry.table(spark)).collect()}
    assert reasons == {
        "ok": None, "key": "scheme_only_must_not_receive_key", "lang": "unsupported_language",
        "short": "insufficient_effective_length", "calib": "calibration_bundle_mismatch",
    }
    assert [(r["document_id"], r["raw_statistic"]) for r in registry.run(requests).collect()] == [("ok", 4.0)]
