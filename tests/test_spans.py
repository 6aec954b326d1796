from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.text import compose_adjacent, deterministic_attack, repetition_ratio
from tracewell.operators import spans


def brute(scores, lengths, fraction, q, gap):
    """Direct restatement on one document, window by window."""
    kept = []
    for length in sorted(set(lengths)):
        if length > len(scores):
            continue
        step = max(1, int(round(length * fraction)))
        starts = sorted({*range(0, len(scores) - length + 1, step), len(scores) - length})
        means = [sum(scores[s : s + length]) / length for s in starts]
        cut = sorted(means)[math.ceil(q * (len(means) - 1))]
        kept += [(s, s + length, length, m) for s, m in zip(starts, means) if m >= cut]
    out = []
    for w in sorted(kept):
        if out and w[0] <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], w[1])
            out[-1][2].append(w)
        else:
            out.append([w[0], w[1], [w]])
    result = []
    for start, end, members in out:
        best = max(members, key=lambda w: (w[3], -w[2], -w[0]))
        local = scores[start:end]
        median = float(np.median(local))
        high = [i for i, v in enumerate(local) if v >= median]
        result.append((start + high[0], start + high[-1] + 1, f"char-{best[2]}", sum(local[i] for i in high) / len(high)))
    return result


@pytest.mark.parametrize("fraction,gap", [(0.25, 32), (0.5, 0)])
def test_search_equals_brute_force(spark, fraction, gap):
    random.seed(3)
    docs = [(i, [random.randint(0, 65535) for _ in range(n)]) for i, n in enumerate((0, 5, 63, 64, 65, 200, 777, 1500))]
    df = spark.createDataFrame(docs, "id int, scores array<bigint>").repartition(3)
    got = {
        r["id"]: r["candidates"]
        for r in spans.with_candidates(df, window_lengths=(64, 128, 256), stride_fraction=fraction, quantile=0.9, gap=gap).collect()
    }
    for i, scores in docs:
        want = brute(scores, (64, 128, 256), fraction, 0.9, gap)
        mine = [(c["char_start"], c["char_end"], c["scale_id"], c["raw_score"]) for c in got[i]]
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert np.allclose([m[3] for m in mine], [w[3] for w in want])


def test_raised_stretch_is_found_with_double_scores(spark):
    scores = [10.0 if 40 <= i < 60 else 0.0 for i in range(100)]
    df = spark.createDataFrame([(1, scores)], "id int, scores array<double>")
    found = spans.with_candidates(df, window_lengths=(20,), stride_fraction=0.5, quantile=0.9, gap=0).first()["candidates"]
    assert any(c["char_start"] <= 40 and c["char_end"] >= 60 for c in found)


def test_interval_algebra(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12)], "d int, char_start int, char_end int")
    merged = sorted((r["char_start"], r["char_end"]) for r in spans.merge_long(df, "d").collect())
    assert merged == [(0, 8), (10, 12)]
    iou = df.limit(1).select(
        spans.interval_iou(F.lit(0), F.lit(5), F.lit(3), F.lit(8)).alias("a"),
        spans.interval_iou(F.lit(0), F.lit(5), F.lit(5), F.lit(8)).alias("b"),
    ).first()
    assert (iou["a"], iou["b"]) == (0.25, 0.0)
    cut = df.limit(1).select(
        spans.subtract_span(
            F.struct(F.lit(0).alias("char_start"), F.lit(10).alias("char_end")),
            F.struct(F.lit(3).alias("char_start"), F.lit(6).alias("char_end")),
        ).alias("x")
    ).first()["x"]
    assert [tuple(s) for s in cut] == [(0, 3), (6, 10)]


def test_overlap_join_reports_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 5000), (1, 6000, 6001)], "d int, char_start int, char_end int")
    b = spark.createDataFrame([(1, 100, 4000), (1, 5000, 6000)], "d int, char_start int, char_end int")
    got = spans.overlap_join(a, b, "d", bin_width=64).collect()
    assert [(r["a_char_start"], r["b_char_start"], r["overlap"]) for r in got] == [(0, 100, 3900)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a  b　\n c", ["abc", "de"], "aaaaaa", "中😀文中😀文中")], "t string, parts array<string>, r string, u string")
    row = df.select(
        deterministic_attack("t", F.lit("copy_edit")).alias("e"), F.expr("1").alias("x"),
        deterministic_attack("r", F.lit("truncation"), 0.5).alias("c"),
        compose_adjacent(F.col("parts"), "\n\n").alias("m"), repetition_ratio("r").alias("rep"), repetition_ratio("u").alias("uni"),
    ).first()
    assert row["e"] == "a b c" and row["c"] == "aaa"
    assert row["m"]["text"] == "abc\n\nde" and [tuple(s) for s in row["m"]["intervals"]] == [(0, 3), (5, 7)]
    assert abs(row["rep"] - 2 / 3) < 1e-12 and abs(row["uni"] - 0.25) < 1e-12


def position_scores(text, first):
    """Whole-number scores of a text piece; a plain restatement is ``(code * 7919 + position * 31) % 1009``."""
    return F.transform(F.split(text, ""), lambda c, i: ((F.ascii(c) * 7919 + (first + i) * 31) % 1009).cast("bigint"))


@pytest.mark.parametrize("fraction,gap,width", [(0.25, 8, 64), (0.5, 0, 200), (0.25, 300, 1000)])
def test_pieces_give_the_candidates_of_the_row_form(spark, fraction, gap, width):
    from tracewell.operators import longspans

    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdé日", k=n)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 500, 1000, 1023, 4321)] + ["a" * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    settings = dict(window_lengths=(64, 128, 256), stride_fraction=fraction, quantile=0.9, gap=gap)
    rows = longspans.text_candidates(df, key="id", score=position_scores, row_length=1 << 20, **settings)
    cut = longspans.text_candidates(df, key="id", score=position_scores, row_length=0, width=width, **settings)
    plain = lambda d: sorted((r["id"], r["candidate_id"], r["char_start"], r["char_end"], r["scale_id"], round(r["raw_score"], 9)) for r in d.collect())
    want = plain(rows)
    assert plain(cut) == want and len(want) > 10
    scores = {i: [(ord(c) * 7919 + k * 31) % 1009 for k, c in enumerate(t or "")] for i, t in enumerate(texts)}
    for i in scores:
        mine = [r[2:5] for r in want if r[0] == i]
        assert sorted(mine) == sorted(w[:3] for w in brute(scores[i], (64, 128, 256), fraction, 0.9, gap))
    merged = dict(settings, refine_quantile=None)
    assert plain(longspans.text_candidates(df, key="id", score=position_scores, row_length=0, width=width, **merged)) == plain(
        longspans.text_candidates(df, key="id", score=position_scores, **merged))
    assert longspans.text_candidates(df.limit(0), key="id", score=position_scores, **settings).count() == 0


def test_a_long_text_is_spread_over_tasks(spark):
    from tracewell.operators import longspans

    df = spark.createDataFrame([(1, "abcdefg" * 300_000)], "id long, text string")
    pieces = longspans.text_pieces(df, key="id", text="text", width=1 << 14, halo=1024, chunk=8)
    found = pieces.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("own").alias("n")).collect()
    assert sum(r["n"] for r in found) == 2_100_000 and len(found) > 1


def test_batch_search_equals_the_column_forms(spark):
    """Scores, spans and measures of the Arrow batches are those of the columns, for any characters and also without a text."""
    from tracewell.functions.text import word_count
    from tracewell.plans import attribution, corpus

    random.seed(11)
    some = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    texts = ["a", "abc", " \t", "ab cd", some("ab \n", 255), some("abcdefgh  ", 256), some("ab \x1c\x85　\U0001f600ß", 900),
             some("xyzé ", 1400), some("the cat sat on a mat ", 9000), "na " * 500, "\U0001f600" * 300, None]
    rows = spark.createDataFrame([(f"r{i}-{m}", t, m) for i, t in enumerate(texts) for m in ("kgw", None)],
                                 "recipe_id string, text string, watermark_family string")
    nothing = {c: F.lit(None).cast("string") for c in (
        "parent_ids", "kind", "split", "source", "language", "watermark_families", "key_id", "key_ids", "attack_id", "watermark_intervals")}
    measures = ["effective_length", "mapping_coverage", "text_length", "repetition", "tokens"]
    got = {r["document_id"]: r for r in attribution.search_documents(rows.withColumns(nothing)).collect()}
    columns = spans.with_candidates(corpus.with_scores(rows), unit=65535.0).withColumns(
        {"text_length": F.length("text"), "repetition": repetition_ratio("text"), "tokens": word_count("text")})
    segments = columns.select("recipe_id", "text", F.inline("candidates")).withColumn(
        "s", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).select(
        "recipe_id", "candidate_id", "char_start", "char_end", "scale_id", "raw_score", repetition_ratio("s").alias("repetition"),
        word_count("s").alias("tokens"))
    want = {}
    for r in segments.collect():
        want.setdefault(r["recipe_id"], []).append(tuple(r)[1:])
    assert want
    for r in columns.select("recipe_id", *measures).collect():
        mine = got[r["recipe_id"]]
        assert [mine[c] for c in measures] == [r[c] for c in measures]
        assert [tuple(c) for c in mine["candidates"]] == want.get(r["recipe_id"], [])


def test_a_text_of_several_rows_is_searched_once(monkeypatch):
    """Variants of a parent share their text; the search of every row took as long as all of them."""
    import pyarrow as pa
    from tracewell.plans import attribution

    calls, plain = [], attribution._candidates
    monkeypatch.setattr(attribution, "_candidates", lambda *key: calls.append(key) or plain(*key))
    text = "some words " * 100
    out = attribution._measure(pa.array([text] * 5 + [None]), pa.array([False, True, True, True, True, False]))
    assert len(out) == 6 and len(calls) == 2


def test_refined_candidates_cover_derived_rows_and_documents(spark, tmp_path):
    """Every span of the derived rows with its measures, and those of every document, also of texts too short for a parent."""
    from tracewell import catalog

    random.seed(5)
    texts = ["".join(random.choice("abcdefg  ") for _ in range(n)) for n in (300, 700, 900, 1300, 256, 100)]
    rows = [(i, t, "en", f"s{i % 2}", len(t) if i != 3 else 10) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    queries = catalog.load()[0]
    got = queries["w9_refined_candidates"](spark, str(tmp_path))
    assert {"repetition", "tokens"} <= set(got.columns)
    found = {tuple(r) for r in got.collect()}
    derived = {tuple(r) for r in queries["w9_segment_measures"](spark, str(tmp_path)).collect()}
    own = {tuple(r)[1:6] for r in queries["w9_piecewise_candidates"](spark, str(tmp_path)).collect()}
    assert derived and derived <= found
    assert {r[1:6] for r in found - derived} == own
    assert {r[0] for r in found - derived} == {f"document-{i}" for i in range(5)}


def test_pieces_move_no_row_per_character(spark, monkeypatch):
    """Scores of refined spans stay in arrays: what is ranked across rows is far less than the characters searched."""
    from tracewell.operators import longspans, ordered

    seen = []
    plain = ordered.distinct_running
    monkeypatch.setattr(ordered, "distinct_running", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    monkeypatch.setattr(longspans, "distinct_running", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k), raising=False)
    draw = random.Random(3)
    df = spark.createDataFrame([(i, "".join(draw.choices("abcdef", k=3000))) for i in range(40)], "id long, text string")
    settings = dict(window_lengths=(64, 128), stride_fraction=0.25, quantile=0.5, gap=300, row_length=0)
    one = longspans.text_candidates(df, key="id", score=position_scores, width=4096, **settings)
    assert one.count() == 40 and sum(seen) == 0
    many = longspans.text_candidates(df, key="id", score=position_scores, width=512, **settings)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    assert max(seen) < 40 * 3000 / 4
