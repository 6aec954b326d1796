"""MinHash near-duplicates by min-max hashing over five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.graph import components
from tracewell.session import matching, staged

WORDS = 5
SIMILAR, OUT_OF = 75, 100
PERMUTATIONS = 64  # each gives its minimum and its maximum: 128 signature values
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS  # a pair at 0.75 meets in no band with probability 5e-6
BLOCK = 512

_DRAW = np.random.default_rng(20240229)
_STEP = _DRAW.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _DRAW.integers(1, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_JOIN = _DRAW.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A band takes values of different permutations, minima beside maxima, so its rows are independent draws.
_PICK = np.stack(
    [np.r_[2 * i, 2 * i + 1, PERMUTATIONS + (2 * i + 2) % PERMUTATIONS, PERMUTATIONS + (2 * i + 3) % PERMUTATIONS]
     for i in range(BANDS)]
)


class _WordHash(dict):
    """64-bit hash of a word, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; fewer than five words are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        return _mix(np.array([(hashes * _STEP[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - WORDS + 1
    total = hashes[:n] * _STEP[0]
    for i in range(1, WORDS):
        total += hashes[i : i + n] * _STEP[i]
    return np.unique(_mix(total))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band from the minimum and the maximum of every permutation."""
    low, high = None, None
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        halves = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        half = PERMUTATIONS // 2
        values = np.concatenate([halves[0][:, None] * _SPREAD[:half], halves[1][:, None] * _SPREAD[half:]], axis=1)
        a, b = values.min(axis=0), values.max(axis=0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    signature = np.concatenate([low, high]).astype(np.uint64)
    return _mix((signature[_PICK] * _JOIN).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), 256):
            part = batch.slice(at, 256)
            out: tuple[list, ...] = ([], [], [], [])
            for text in part.column(1).to_pylist():
                s = shingle_set(text, known)
                out[0].append(len(s))
                out[1].append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                out[2].append(int(_mix(s + np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                out[3].append(band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))],
                ["doc_id", *part.schema.names[2:], "n_shingles", "h1", "h2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(text, known).tobytes() for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |intersection| >= 75 * |union| on full sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OUT_OF * both >= SIMILAR * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        good = [
            i for i in range(batch.num_rows)
            if alike(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64))
        ]
        at = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def _within_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between members of two blocks that no earlier link has joined."""
    i, j = int(rows["i"].iat[0]), int(rows["j"].iat[0])
    left = rows[rows["block"] == i]
    right = rows[rows["block"] == j]
    labels, ids = right["label"].to_numpy(), right["cid"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in right["shingles"]]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    for cid, label, binary in zip(left["cid"], left["label"], left["shingles"], strict=True):
        other = labels != label
        if not other.any():
            continue
        mine = np.frombuffer(binary, np.uint64)
        start, stop = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        counts = stop - start
        hits = np.repeat(start - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        both = np.bincount(owner[hits], minlength=len(sets))
        good = other & (OUT_OF * both >= SIMILAR * (len(mine) + sizes - both))
        found.extend((cid, k) for k in ids[good])
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row (if ``row_col`` is given).

    Texts with equal shingle sets form one class. Class signatures (minimum and maximum of 64 permutations) are
    cut into 32 bands; members of a bucket are compared with its most central member on full sets. Where a
    bucket still holds several components, the members of its centre's buckets are compared in block pairs, only
    across components, so a large group of copies costs one comparison per member and nothing is left out.

    Defined cases: a null, empty or blank text has no shingles, is linked with nothing and is its own component.
    Repeated rows and rows that share an id are separate rows of one component when their sets agree; a null id
    takes part, its row gets the smallest id of its component, null if all are null, and is kept only then.
    With ``row_col``, a number of its own for each row, just one row of a component is kept: of the rows with its
    smallest id the one with the smallest number.
    Columns of the input other than the two named ones are ignored, whatever their names. Empty in, empty out.
    """
    own = ["row"] if row_col else []
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *[F.col(row_col).cast("long").alias("row") for _ in own],
    )
    source = source.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *own)
    schema = f"doc_id long, text_hash long, {'row long, ' if row_col else ''}n_shingles long, h1 long, h2 long, bands array<long>"
    signed = staged(source.mapInArrow(_sign, schema), "near-signed")
    rows = signed.select("doc_id", *own, "n_shingles", "h1", "h2")
    first = [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")] if row_col else []
    # One class per distinct set. The written copy fixes the class numbers.
    groups = signed.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("pick"),
        F.first("bands").alias("bands"), *first,
    )
    classes = staged(groups.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    members = classes.select("cid", "n_shingles", F.explode("bands").alias("key"))
    shared = staged(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-buckets")
    crowd = staged(members.join(shared, "key"), "near-members")
    # The centre of a bucket is the member that meets the most others over all bands.
    weight = crowd.groupBy("cid").agg(F.sum("size").alias("weight"))
    ranked = crowd.join(weight, "cid").select(
        "key", F.struct("weight", "cid", "n_shingles").alias("rank")
    )
    centres = ranked.groupBy("key").agg(F.max("rank").alias("c"))
    centred = staged(
        crowd.join(centres, "key").select(
            "key", "cid", "n_shingles", "size", F.col("c.cid").alias("centre"), F.col("c.n_shingles").alias("n_centre")
        ), "near-centred"
    )
    pairs = staged(
        centred.where(F.col("cid") != F.col("centre"))
        .where(OUT_OF * F.least("n_shingles", "n_centre") >= SIMILAR * F.greatest("n_shingles", "n_centre"))
        .select(F.col("cid").alias("a"), F.col("centre").alias("b")).distinct(), "near-pairs"
    )
    # The sets of compared classes are made again from one text each; repeated rows fall away before that.
    wanted = staged(
        classes.join(centred.select("cid").distinct(), "cid", "left_semi").select("cid", "pick.*"), "near-wanted"
    )
    few = matching(source, staged(wanted.select("text_hash").distinct(), "near-hashes"), "text_hash")
    same_row = few["doc_id"].eqNullSafe(wanted["doc_id"]) & (few["text_hash"] == wanted["text_hash"])
    texts = few.join(wanted, same_row).groupBy("cid").agg(F.first("text").alias("text"))
    sets = staged(texts.mapInArrow(_sets, "cid long, shingles binary"), "near-sets")
    links = staged(
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "near-links"
    )
    labels = components(links, "a", "b").select(F.col("vertex").alias("cid"), F.col("root").alias("label"))
    # What is left: buckets of more than two whose members are not yet one component.
    labelled = centred.where("size > 2").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rest = staged(
        labelled.join(open_keys.select("key"), "key", "left_semi").where("cid <> centre")
        .select("centre", "cid", "label").distinct(), "near-rest"
    )
    spread = rest.groupBy("centre").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).where("lo <> hi")
    blocks = (
        rest.join(spread.select("centre", "blocks"), "centre")
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("centre", "cid", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    more = blocks.join(sets, "cid").groupBy("centre", "i", "j").applyInPandas(_within_blocks, "a long, b long")
    every = components(links.unionByName(more), "a", "b")
    named = classes.select("cid", "n_shingles", "h1", "h2", "least", *["first"] * len(own)).join(
        every.select(F.col("vertex").alias("cid"), "root"), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(
        F.min("least").alias("component_id"), *([F.min("first").alias("head")] if row_col else [])
    )
    final = staged(named.join(least, "root").select("n_shingles", "h1", "h2", "component_id", *[F.col("head.row").alias("kept_row")] * len(own)), "near-components")
    placed = rows.join(final, ["n_shingles", "h1", "h2"], "left")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if row_col:
        kept = (F.col("n_shingles") == 0) | (F.col("row") == F.col("kept_row"))
    return placed.select(
        "doc_id", *own, *["kept_row"] * len(own), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", kept).select("doc_id", "n_shingles", "component_id", "kept", *own)

