"""Packing along a space-filling curve: neighbouring documents share training sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import staged

SEQUENCE = 1024
END_ID = 0
DIMENSIONS = 4
BITS = 15  # 4 x 15 bits: the curve's key fits a long
BUCKETS = 4096

_SIGNS = np.random.default_rng(20240302).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
# Up to here two libraries split texts alike; anything else goes to the tokenizer itself.
_COMMON = re.compile("[^\t\n\r -~\xa0-ɏ]")


class Encoder:
    """Token ids of the tokenizers vocabulary, as little-endian unsigned 32-bit numbers.

    Latin texts are encoded with tiktoken over the same ranks, which gives the same ids at a third of the time.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _COMMON.search(text) or any(t in text for t in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate.

    The transform of Skilling (2004): undo excess rotations from the top bit down, Gray-code, interleave.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(ids: np.ndarray) -> np.ndarray:
    """A document's hashed token vector, projected to a few dimensions and scaled to the curve's grid."""
    if not len(ids):
        return np.full(DIMENSIONS, 1 << (BITS - 1), np.int64)
    counts = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS).astype(np.float32)
    counts = np.sqrt(counts)
    spot = counts @ _SIGNS / np.sqrt((counts * counts).sum())
    return np.clip((spot + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _encode(paths: tuple) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(at, 256)
                ids = [encoder.ids(t or "") for t in part.column(1).to_pylist()]
                spots = np.array([project(i) for i in ids]).reshape(-1, DIMENSIONS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(hilbert_keys(spots), pa.int64()),
                     pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array([_narrow(i) for i in ids], pa.binary())],
                    ["doc_id", "curve", "doc_tokens", "ids"],
                )

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids with the closing id; two bytes each if all fit, else a mark and four bytes each."""
    full = np.append(ids, np.uint32(END_ID))
    return b"\0" + full.astype("<u2").tobytes() if full.max() < 65536 else b"\1" + full.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\0" else "<u4", offset=1).astype("<u4")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        out: list[tuple] = []
        for doc_id, before, binary in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids = _wide(binary)
            start = 0
            while start < len(ids):
                sequence, offset = divmod(before + start, SEQUENCE)
                length = min(SEQUENCE - offset, len(ids) - start)
                crc = zlib.crc32(ids[start : start + length].tobytes())
                out.append((doc_id, start, length, crc, len(ids), sequence, offset))
                start += length
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def curve_order(sized: DataFrame) -> DataFrame:
    """(row, before): tokens that lie before a row along the curve.

    Rows are range-partitioned by (curve, row) - equal keys are split freely - and written, which fixes the ranges;
    only the totals of the ranges, one number each, meet in one place.
    """
    spark = sized.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lined = staged(
        sized.repartitionByRange(ranges, "curve", "row").withColumn("range", F.spark_partition_id()), "pack-ranges"
    )
    totals = lined.groupBy("range").agg(F.sum("doc_tokens").alias("tokens"))
    upto = "sum(tokens) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = F.broadcast(totals.select("range", F.expr(f"coalesce({upto}, 0)").alias("base")))
    inside = "sum(doc_tokens) OVER (PARTITION BY range ORDER BY curve, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return lined.withColumn("upto", F.expr(inside)).join(bases, "range").select(
        "row", (F.col("base") + F.col("upto") - F.col("doc_tokens")).alias("before")
    )


def packed(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is tokenised once. Its hashed token vector gives a place on a Hilbert curve; documents are
    concatenated in that order and the stream is cut every 1024 ids, so only the very last sequence is short: it
    is the one that needs padding (none where its length is a power of two).

    Defined cases: a null text counts as empty and is the closing id alone. Rows that share an id are separate
    documents; ties on the curve are ordered by the row's number. Very long texts span as many sequences as they
    need. Other columns of the input are ignored, whatever their names. Empty in, empty out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = staged(
        source.mapInArrow(
            _encode((tokenizer_path, ranks_path, pattern)), "doc_id long, curve long, doc_tokens long, ids binary"
        ).withColumn("row", F.monotonically_increasing_id()), "pack-ids", codec="zstd",
    )
    order = curve_order(encoded.select("row", "curve", "doc_tokens"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.join(order, "row").select("doc_id", "before", "ids").mapInArrow(_cut, schema)
