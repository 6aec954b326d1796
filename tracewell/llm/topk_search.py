"""Exact top-k search by inner product with the three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import staged

SCALE = 1024
LISTS = 2  # blocks of dimensions; each is a score list of its own
QUERY_BLOCK = 2048  # query vectors that travel to the tasks at a time
ROW_BLOCK = 2048
_LIMIT = 2**62


def quantised(vector: Column) -> Column:
    """floor(1024 * x) per component, x as double; beyond 2**62 in size it stays there."""
    return F.transform(
        vector,
        lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(_LIMIT))), F.lit(float(_LIMIT)))).cast("long"),
    )


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of x and q, exact; sums beyond a long stay at its limit."""
    if not x.size or not q.size:
        return np.zeros((len(x), len(q)), np.int64)
    bound = int(np.abs(x).max()) * int(np.abs(q).max()) * x.shape[1]
    if bound < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return x @ q.T
    return np.clip(x.astype(object) @ q.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a shorter vector is filled up with zeros."""
    flat = np.zeros((len(cells), width), np.int64)
    offsets = cells.offsets.to_numpy()
    sizes, values = np.diff(offsets), cells.values.to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    for i, (a, n) in enumerate(zip(offsets[:-1], sizes, strict=True)):
        flat[i, :n] = values[a : a + n]
    return flat


def _entries(query: np.ndarray, cid: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(cid, pa.int64()), pa.array(score, pa.int64())], ["query", "cid", "score"]
    )


def _local_lists(ids: np.ndarray, queries: np.ndarray, width: int, k: int):
    """Phase 1: of every score list the k highest entries per query and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[np.empty((0, len(ids)), np.int64)] * 2 for _ in range(LISTS)]
        cuts = [width * i // LISTS for i in range(LISTS + 1)]
        for batch in batches:
            cids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for at in range(0, len(cids), ROW_BLOCK):
                part = cids[at : at + ROW_BLOCK]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    scores = np.vstack([best[n][0], products(x[at : at + ROW_BLOCK, a:b], queries[:, a:b])])
                    names = np.vstack([best[n][1], np.repeat(part[:, None], len(ids), axis=1)])
                    if len(scores) > k:
                        top = np.argpartition(-scores, k - 1, axis=0)[:k]
                        scores, names = np.take_along_axis(scores, top, 0), np.take_along_axis(names, top, 0)
                    best[n] = [scores, names]
        for scores, names in best:
            yield _entries(np.tile(ids, len(scores)), names.ravel(), scores.ravel())

    return run


def _above(ids: np.ndarray, queries: np.ndarray, width: int, cutoff: np.ndarray):
    """Phase 2: every entry of a list that reaches the uniform share of its query's cutoff."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [width * i // LISTS for i in range(LISTS + 1)]
        need = np.array([-(-int(c) // LISTS) for c in cutoff])  # the smallest whole score with score * LISTS >= cutoff
        for batch in batches:
            cids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for at in range(0, len(cids), ROW_BLOCK):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    scores = products(x[at : at + ROW_BLOCK, a:b], queries[:, a:b])
                    row, column = np.nonzero(scores >= need)
                    yield _entries(ids[column], cids[at : at + ROW_BLOCK][row], scores[row, column])

    return run


def _resolved(ids: np.ndarray, queries: np.ndarray, width: int):
    """Exact scores of (query, cid, vec) rows."""
    place = {int(q): n for n, q in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, cids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            at = np.array([place[int(q)] for q in query], np.int64)
            y = queries[at]
            bound = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * width
            score = (x * y).sum(axis=1) if bound < 2**63 else np.clip(
                (x.astype(object) * y.astype(object)).sum(axis=1), -(2**63), 2**63 - 1).astype(np.int64)
            yield _entries(query, cids, score)

    return run


_ENTRY = "query long, cid long, score long"


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k highest integer inner products of every query row: query_id, rank (from 1), vec_id, score.

    ``queries`` picks the query rows by columns ``vec_id`` and ``vec`` (the whole-number vector). Equal vectors are one
    class, with the k + 1 smallest ids of its rows: no more of them can be in a result, as one at most is the query's own. The dimensions form score
    lists. Phase 1 gathers the highest entries of every list and scores those vectors exactly; the k+1st best is a
    cutoff no result lies below. Phase 2 broadcasts it and collects every entry that reaches its share of the
    cutoff: a vector below the share in all lists cannot reach the cutoff. Sums with what missing entries can add
    at most leave few candidates, which phase 3 scores exactly. Queries go through in blocks of 2048 vectors,
    the bound of what travels to tasks or driver at a time.

    Defined cases: rows without id, null vectors and vectors with null or non-finite components take no part; a
    shorter vector counts as filled up with zeros; ties go to the smaller id; a row that repeats id and vector
    counts once; rows that share an id with different vectors are separate rows, each a candidate of the other: only
    the query's own row is no result of its own.
    Other columns are ignored, whatever their names. Empty in, empty out; fewer than k others give them all.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw"))
    rows = staged(
        raw.where(F.col("vec_id").isNotNull() & usable(F.col("raw"))).select("vec_id", quantised(F.col("raw")).alias("vec"))
        .withColumn("is_query", queries).select("*", F.xxhash64("vec").alias("v1"), F.xxhash64(F.lit(1), "vec").alias("v2")),
        "topk-rows",
    )
    by_id = Window.partitionBy("v1", "v2").orderBy("vec_id")
    few = (
        rows.select("v1", "v2", "vec_id").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
        .groupBy("v1", "v2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    shapes = rows.groupBy("v1", "v2").agg(F.first("vec").alias("vec"), F.max("is_query").alias("is_query"))
    classes = staged(shapes.join(few, ["v1", "v2"]).withColumn("cid", F.monotonically_increasing_id()), "topk-classes")
    asked = rows.where("is_query").join(classes.select("v1", "v2", F.col("cid").alias("query")), ["v1", "v2"]).select(
        F.col("vec_id").alias("query_id"), "query"
    ).distinct()
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    rounds = []
    block: list = []
    for row in classes.where("is_query").select("cid", "vec").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            rounds.append(_round(classes, block, width, k))
            block = []
    if block:
        rounds.append(_round(classes, block, width, k))
    empty = classes.select(F.col("cid").alias("query"), "cid", F.explode("ids").alias("vec_id"), F.col("cid").alias("score")).limit(0)
    best = empty
    for found in rounds:
        best = best.unionByName(found)
    ranked = asked.join(best, "query").where("NOT (vec_id = query_id AND cid = query)").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "cid"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _round(classes: DataFrame, block: list, width: int, k: int) -> DataFrame:
    """(query, cid, vec_id, score): the k + 1 best rows of every query class of a block."""
    ids = np.array([r["cid"] for r in block], np.int64)
    queries = np.zeros((len(block), width), np.int64)
    for n, r in enumerate(block):
        queries[n, : len(r["vec"])] = r["vec"]
    lists = classes.select("cid", "vec")
    members = classes.select("cid", "vec", "ids")
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    seeds = staged(lists.mapInArrow(_local_lists(ids, queries, width, k + 1), _ENTRY), "topk-lists")
    exact = seeds.select("query", "cid").distinct().join(lists, "cid").select("query", "cid", "vec").mapInArrow(
        _resolved(ids, queries, width), _ENTRY
    )
    ranked = exact.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k + 1)
    # Fewer than k + 1 classes: every one of them is wanted. At most one row per query of the block.
    cutoffs = {
        r["query"]: r["score"] if r["n"] > k else -(2**63)
        for r in ranked.groupBy("query").agg(F.min("score").alias("score"), F.max("n").alias("n")).collect()
    }
    cutoff = np.array([cutoffs.get(int(q), -(2**63)) for q in ids], dtype=object)
    entries = lists.mapInArrow(_above(ids, queries, width, cutoff), _ENTRY)
    limits = classes.sparkSession.createDataFrame(
        [(int(q), int(c)) for q, c in zip(ids, cutoff, strict=True)], "query long, cutoff long"
    )
    # An entry that is missing is below its share of the cutoff: LISTS * known >= seen * cutoff must hold.
    exact_number = "decimal(38,0)"
    known = entries.groupBy("query", "cid").agg(F.sum(F.col("score").cast(exact_number)).alias("known"), F.count("*").alias("seen"))
    left = known.join(F.broadcast(limits), "query").where(
        F.col("known") * LISTS >= F.col("seen").cast(exact_number) * F.col("cutoff")
    )
    final = left.select("query", "cid").join(members.select("cid", "vec"), "cid").select("query", "cid", "vec").mapInArrow(
        _resolved(ids, queries, width), _ENTRY
    )
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "cid")
    spread = final.join(members.select("cid", "ids"), "cid").select("query", "cid", "score", F.explode("ids").alias("vec_id"))
    return staged(
        spread.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).select("query", "cid", "vec_id", "score"), "topk-best"
    )
