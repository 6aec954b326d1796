"""Sources and sinks: JSON lines, file manifests, CSV exports, feature arrays, batch shards, run log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines table; blank lines are skipped and a row that is no object fails the read."""
    line = F.ltrim("value")
    refused = F.raise_error(F.concat(F.lit("row is no JSON object: "), F.left("value", F.lit(80))))
    row = F.when(line.startswith("{"), F.col("value")).otherwise(refused)
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json(row, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with sorted keys; the committer publishes files only when complete."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def _hashed_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (path, content) of files in order to (path, seen, without, with): bytes and digests without and with a
    newline after the last chunk."""

    def told(path: str, seen: int, digest) -> pa.RecordBatch:
        ended = digest.copy()
        ended.update(b"\n")
        row = (path, seen, digest.hexdigest(), ended.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["path", "seen", "bare", "ended"])

    path, seen, digest = None, 0, None
    for batch in batches:
        for name, chunk in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = chunk.as_py()
            if name != path:
                if path is not None:
                    yield told(path, seen, digest)
                path, seen, digest = name, len(content), hashlib.sha256(content)
            else:
                digest.update(b"\n")
                digest.update(content)
                seen += 1 + len(content)
    if path is not None:
        yield told(path, seen, digest)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, name, size and sha256 of every file under ``path``, of any size.

    Files are read as chunks that end at a newline byte, whatever they hold, and a task takes the chunks of its files in
    order, so no file is a cell. Whether the last chunk has its newline is told by the size in the listing.
    """
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = lambda uri: local(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))
    sized = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    sized = sized.select(local(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(path)
    # Scans pass over empty files, so the names come from the listing that the reader has made.
    names = spark.createDataFrame([(f,) for f in lines.inputFiles()], "uri string").select(named(F.col("uri")).alias("path"))
    listed = names.join(sized, "path", "left").fillna(0, ["bytes"])
    chunks = lines.select(
        named(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("content"),
    )
    lined = chunks.repartition("path").sortWithinPartitions("path", "block", "row").select("path", "content")
    found = lined.mapInArrow(_hashed_files, "path string, seen long, bare string, ended string")
    size = F.col("bytes")
    unread = F.raise_error(F.concat(F.lit("file changed while it was read: "), F.col("path"))).cast("string")
    digest = (
        F.when(size == 0, F.sha2(F.lit("").cast("binary"), 256)).when(F.col("seen") == size, F.col("bare"))
        .when(F.col("seen") + 1 == size, F.col("ended")).otherwise(unread)
    )
    return listed.join(found, "path", "left").select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", digest.alias("sha256")
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def check_features(df: DataFrame, views: Sequence[str], masks: Sequence[str]) -> DataFrame:
    """Joint mask and a violation per stored feature row: finite values, equal lengths, equal masks."""
    finite = None
    lengths = None
    for v in views:
        this = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        same = F.size(v) == F.size(views[0])
        finite = this if finite is None else finite & this
        lengths = same if lengths is None else lengths & same
    joint = F.col(masks[0])
    for m in masks[1:]:
        joint = F.zip_with(joint, F.col(m), lambda a, b: a & b)
    mask_ok = F.size(masks[0]) == F.size(views[0])
    violation = (
        F.when(F.size(views[0]) <= 0, "empty").when(~lengths, "length_mismatch").when(~mask_ok, "mask_mismatch")
        .when(~finite, "not_finite")
    )
    return df.withColumns({"joint_mask": joint, "violation": violation})


def pad(values: Column, positions: int, zero: Column) -> Column:
    """Array cut or filled up to exactly ``positions`` elements."""
    return F.slice(F.concat(values, F.array_repeat(zero, positions)), 1, positions)


def write_batches(df: DataFrame, path: str) -> None:
    """Training batches, one folder per split and shard."""
    df.repartition("split", "shard").write.mode("errorifexists").partitionBy("split", "shard").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shard_index(batches: DataFrame, *, key: str = "recipe_id") -> DataFrame:
    """Batches, examples and an order-free digest of the example ids in every shard."""
    from ..functions.hashing import set_digest

    return batches.groupBy("split", "shard").agg(
        F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("examples"),
        set_digest(F.sha2(F.col(key), 256)).alias("content_digest"),
    )


def shard_drift(index: DataFrame, batches: DataFrame, *, key: str = "recipe_id") -> DataFrame:
    """Shards whose stored index no longer matches their rows (empty when all verify)."""
    now = shard_index(batches, key=key)
    keys = ["split", "shard"]
    want = index.select(*keys, F.struct("batches", "examples", "content_digest").alias("_w"))
    have = now.select(*keys, F.struct("batches", "examples", "content_digest").alias("_h"))
    return want.join(have, keys, "full_outer").where(~F.col("_w").eqNullSafe(F.col("_h"))).select(*keys)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to the JSON run log; existing files are never touched."""
    df.write.mode("append").json(path)
