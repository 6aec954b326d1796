"""Merkle manifest of a dataset: postorder append logs of aligned builders, proofs by closed-form positions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import RANGE, in_ranges, with_running
from tracewell.session import staged

BLOCK_BITS = 10  # a builder holds 2**10 leaves: a log of at most 2**11 nodes of 32 bytes, 64 KB
DIGEST = 32
LEFT, RIGHT, LONE = b"L", b"R", b"-"  # where the sibling of a step stands
STEP = 1 + DIGEST


def h(*digests: bytes) -> bytes:
    """The digest of a run of nodes: SHA-256 of their digests as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def levels(leaves: int) -> int:
    """Height of a tree: how often pairs are joined until one node remains."""
    return (leaves - 1).bit_length()


def postorder(level: int, at: int, leaves: int) -> int:
    """Position in the log of node ``at`` of a level, in a tree over ``leaves`` leaves.

    A node is written when its last leaf e is there. Before leaf e lie e leaves and all nodes that end before it,
    2 e - popcount(e) in all (the sizes of the complete subtrees left of e); then come the levels that end at e.
    """
    e = min((at + 1) << level, leaves) - 1
    return 2 * e - e.bit_count() + level


def append_log(leaves: Sequence[bytes], height: int) -> bytes:
    """The nodes of an aligned subtree in completion order; a run of one at the end is hashed alone."""
    log: list[bytes] = []
    waiting = [b""] * (height + 1)
    last = len(leaves) - 1
    for i, node in enumerate(leaves):
        log.append(node)
        level = 0
        while level < height and ((i >> level) & 1 or i == last):
            node = h(waiting[level], node) if (i >> level) & 1 else h(node)
            level += 1
            log.append(node)
        waiting[level] = node
    return b"".join(log)


def steps(log: bytes, leaf: int, leaves: int, height: int) -> list[tuple[bytes, bytes]]:
    """(side, digest) of the siblings from a leaf up to the top of its log, each read at its position."""
    found = []
    for level in range(height):
        at = leaf >> level
        beside = at ^ 1
        if beside << level < leaves:
            spot = DIGEST * postorder(level, beside, leaves)
            found.append((LEFT if at & 1 else RIGHT, log[spot : spot + DIGEST]))
        else:
            found.append((LONE, b""))
    return found


def fold(node: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    for side, sibling in path:
        node = h(node) if side == LONE else h(sibling, node) if side == LEFT else h(node, sibling)
    return node


def _packed(path: Sequence[tuple[bytes, bytes]]) -> bytes:
    return b"".join(side + sibling.ljust(DIGEST, b"\0") for side, sibling in path)


def _unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    cut = (path[i : i + STEP] for i in range(0, len(path), STEP))
    return [(p[:1], b"" if p[:1] == LONE else p[1:]) for p in cut]


_LOGS = pa.schema([
    ("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int64()), ("start", pa.int64()), ("height", pa.int32()),
    ("log", pa.binary()), ("top", pa.binary()), ("ids", pa.list_(pa.int64())), ("changed", pa.list_(pa.binary())),
    ("keys", pa.list_(pa.string())),
])
_LOGS_SQL = (
    "tree string, block long, leaves long, start long, height int, log binary, top binary, ids array<long>, "
    "changed array<binary>, keys array<string>"
)


def _builders(bits: int) -> Callable:
    """Units (tree, block, leaves, digest, id, changed, key) in order to one log per (tree, block)."""

    def built(tree: str, block: int, leaves: int, rows: list[tuple]) -> pa.RecordBatch:
        height = min(bits, levels(leaves))
        log = append_log([r[0] for r in rows], height)
        first = block << bits
        start = 2 * first - first.bit_count()
        values = (tree, block, leaves, start, height, log, log[-DIGEST:], *([r[i] for r in rows] for i in (1, 2, 3)))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _LOGS.types)], schema=_LOGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves, rows = None, 0, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for tree, block, total, *unit in zip(*columns):
                if (tree, block) != key:
                    if rows:
                        yield built(*key, leaves, rows)
                    key, leaves, rows = (tree, block), total, []
                rows.append(tuple(unit))
        if rows:
            yield built(*key, leaves, rows)

    return run


def _logs(units: DataFrame, bits: int, name: str) -> DataFrame:
    """One log per aligned block of 2**bits units (tree, place from 0, leaves, digest, id, changed, key), written."""
    dealt = units.withColumn("block", F.shiftright("place", bits)).repartition("tree", "block")
    lined = dealt.sortWithinPartitions("tree", "block", "place").select(
        "tree", "block", "leaves", "digest", "id", "changed", "key"
    )
    return staged(lined.mapInArrow(_builders(bits), _LOGS_SQL), name)


def _forest(units: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """Logs from the leaves up: the tops of the blocks are the units of the next, until every tree is one block."""
    found = [_logs(units, bits, f"{name}-0")]
    while (found[-1].agg(F.max("leaves")).first()[0] or 0) > 1 << bits:
        none = F.lit(None)
        tops = found[-1].select(
            "tree", F.col("block").alias("place"), F.shiftright(F.col("leaves") + (1 << bits) - 1, bits).alias("leaves"),
            F.col("top").alias("digest"), none.cast("long").alias("id"), none.cast("binary").alias("changed"),
            none.cast("string").alias("key"),
        )
        found.append(_logs(tops, bits, f"{name}-{len(found)}"))
    return found


def _inner_paths(bits: int) -> Callable:
    """A block with the path above it to one row per unit: (tree, unit, key, path, top, root)."""
    names = ["tree", "unit", "key", "path", "top", "root"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, leaves, height, log, keys, path, top, root in zip(*(c.to_pylist() for c in batch.columns)):
                count = min(leaves - (block << bits), 1 << bits)
                rows = [
                    (tree, (block << bits) + i, keys[i], _packed(steps(log, i, count, height)) + path, top, root)
                    for i in range(count)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _proven(bits: int) -> Callable:
    """A block of leaves with the path above it to one row per leaf, its proof and the root that the leaf folds to."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, leaves, height, log, ids, changed, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                above = _unpacked(path)
                siblings = b"".join(s for _, s in above).hex()
                out: list[list] = [[] for _ in range(4)]
                count = min(leaves - (block << bits), 1 << bits)
                for i in range(count):
                    spot = DIGEST * postorder(0, i, count)
                    leaf = log[spot : spot + DIGEST]
                    own = steps(log, i, count, height)
                    text = b"".join(s for _, s in own).hex() + siblings
                    folded = fold(fold(leaf if changed[i] is None else changed[i], own), above)
                    for column, value in zip(out, (leaf.hex(), hashlib.sha256(text.encode()).hexdigest(), folded.hex(), folded == root)):
                        column.append(value)
                columns = [ids, out[0], [subroot.hex()] * count, [root.hex()] * count, *out[1:]]
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def leaf_text(columns: Sequence[Column]) -> Column:
    """A row as text: each field as byte count, colon and value, or a dash for null."""
    fields = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _numbered(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Rows with their place (from 0) in the group and the group's size (``leaves``), by ranges of the whole sort key."""
    ranged = in_ranges(df, groups, order)
    ranked = with_running(ranged, groups, F.col(RANGE), [F.col(c) for c in order], rank="_rank", total="leaves")
    return ranked.withColumn("place", F.col("_rank") - 1).drop("_rank", RANGE)


def manifest(leaves: DataFrame, bits: int = BLOCK_BITS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written logs of all trees over (tree, id, digest, changed, row), and of the tree over their roots.

    A log row is an aligned block: tree, block, leaves (of the whole tree level), start (its first position in the
    tree's append log), height, log (digests in completion order), top.
    """
    none = F.lit(None)
    units = _numbered(leaves, ["tree"], ["id", "digest", "row"]).withColumn("key", none.cast("string"))
    trees = _forest(units, bits, "merkle-log")
    subroots = trees[-1].select(F.lit("").alias("all"), F.col("tree").alias("key"), F.col("top").alias("digest"))
    placed = _numbered(subroots, ["all"], ["key"]).withColumnRenamed("all", "tree")
    placed = placed.withColumns({"id": none.cast("long"), "changed": none.cast("binary")})
    return trees, _forest(placed, bits, "merkle-root-log")


def proofs(trees: list[DataFrame], roots: list[DataFrame], bits: int = BLOCK_BITS) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the logs are read from the top down."""
    blocks = ("tree", "block", "leaves", "height", "log", "keys")
    unit = "tree string, unit long, key string, path binary, top binary, root binary"
    top = roots[-1].select(*blocks, F.lit(b"").cast("binary").alias("path"), "top", F.col("top").alias("root"))
    paths = top.mapInArrow(_inner_paths(bits), unit)
    for level in reversed(roots[:-1]):
        upper = paths.select("tree", F.col("unit").alias("block"), "path", "root")
        paths = level.join(upper, ["tree", "block"]).select(*blocks, "path", "top", "root").mapInArrow(_inner_paths(bits), unit)
    # The last paths are those of the subroots, by the key of their tree; each tree is one block at its last level.
    upper = paths.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "root")
    upper = upper.join(trees[-1].select("tree", F.col("top").alias("subroot")), "tree")
    for level in reversed(trees[1:]):
        inner = level.join(upper, ["tree", "block"]).select(*blocks, "path", F.col("subroot").alias("top"), "root")
        upper = staged(
            inner.mapInArrow(_inner_paths(bits), unit)
            .select("tree", F.col("unit").alias("block"), "path", F.col("top").alias("subroot"), "root"), "merkle-paths"
        )
    below = trees[0].join(upper, ["tree", "block"]).select(
        "block", "leaves", "height", "log", "ids", "changed", "path", "subroot", "root"
    )
    schema = (
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return below.mapInArrow(_proven(bits), schema)


def tampered_manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang",
    id_col: str = "doc_id", count_col: str = "n_chars", tamper_every: int = 7, bits: int = BLOCK_BITS,
) -> DataFrame:
    """A proof per row, checked with a changed leaf where ``tamper_every`` divides the id's crc32.

    Every row is a leaf of the tree of its group; leaves go by id, equal ids by digest. Each aligned block of 2**bits
    leaves is one builder; the tops of the blocks are the units of the next builders. A block's log is 64 KB at most, a
    path 33 bytes a level, and rows are dealt by ranges of (group, id, digest, row), so no group meets in one task.

    Defined cases: null fields are a dash; a null group is a tree of its own and comes first; a null id comes first in
    its tree and is never tampered with, nor is a null count. Repeated rows are leaves each. Other columns are
    ignored, whatever their names. Empty in, empty out.
    """
    plain = [F.col(c) for c in fields]
    other = [F.col(c) + 1 if c == count_col else F.col(c) for c in fields]
    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper_every == 0) & F.col(count_col).isNotNull()
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), F.col(id_col).cast("long").alias("id"),
        _digest(leaf_text(plain)).alias("digest"), F.when(hit, _digest(leaf_text(other))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    trees, roots = manifest(staged(leaves, "merkle-leaves"), bits)
    return proofs(trees, roots, bits)
