"""Exact dedup: equal texts meet in radix tries over their full bytes, whose terminals hold the owner."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import BROADCAST_ROWS, staged

TRIE_BYTES = 48_000_000  # of labels and nodes that a task's trie may hold before it lets subtrees go
NODE_BYTES = 400
HEAD = 16  # length and content hash come before the bytes of a text


class Node:
    __slots__ = ("children", "label", "terminal")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.terminal = label, {}, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A Patricia trie: every edge holds a run of bytes, every stored string ends at a node with a terminal."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def place(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += NODE_BYTES + len(child.label)
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = _shared(label, key[at : at + len(label)])
            upper = node.children[key[at]] = Node(label[:cut])
            child.label = label[cut:]
            upper.children[child.label[0]] = child
            self.held += NODE_BYTES
            node, at = upper, at + cut
        return node

    def _released(self, top: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            whole = before + node.label
            self.held -= NODE_BYTES + len(node.label)
            if node.terminal is not None:
                yield whole, node.terminal
            stack.extend((child, whole) for child in node.children.values())

    def release_heaviest(self, most: int) -> Iterator[tuple[bytes, object]]:
        """Let the heaviest subtrees below the first fork go until at most ``most`` bytes are held."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.terminal is None:
            (node,) = node.children.values()
            prefix += node.label
        if node.terminal is not None:
            yield prefix, node.terminal
            node.terminal = None
        weights = []
        for byte, child in node.children.items():
            weight, stack = 0, [child]
            while stack:
                n = stack.pop()
                weight += NODE_BYTES + len(n.label)
                stack.extend(n.children.values())
            weights.append((weight, byte))
        for _, byte in sorted(weights, reverse=True):
            if self.held <= most:
                break
            yield from self._released(node.children.pop(byte), prefix)

    def release_beside(self, key: bytes) -> Iterator[tuple[bytes, object]]:
        """Let all subtrees beside the path of ``key``'s head go: strings of other lengths or hashes."""
        node, at = self.root, 0
        while at < HEAD:
            for byte in [b for b in node.children if b != key[at]]:
                yield from self._released(node.children.pop(byte), key[:at])
            node = node.children[key[at]]
            at += len(node.label)

    def release(self) -> Iterator[tuple[bytes, object]]:
        for byte in list(self.root.children):
            yield from self._released(self.root.children.pop(byte), b"")


def normal_bytes(text: bytes | None) -> bytes:
    """A-Z in lower case; ``bytes.lower`` leaves all other bytes alone."""
    return (text or b"").lower()


def _better(largest: bool) -> Callable[[tuple, tuple], bool]:
    """Whether the first (id, row) goes before the second; a null id only where there is no other, then the first row."""

    def wins(a: tuple, b: tuple) -> bool:
        if a[0] == b[0]:
            return a[1] < b[1]
        if a[0] is None or b[0] is None:
            return b[0] is None
        return (a[0] > b[0]) == largest

    return wins


_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("digest", pa.binary()), ("entry", pa.int64()), ("size", pa.int64()),
    ("hash", pa.int64()), ("body", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("copies", pa.int64()),
])
_ROWS_SQL = (
    "doc_id long, row long, digest binary, entry long, size long, hash long, body binary, keep_id long, keep_row long, copies long"
)
_SIGNED = 1 << 63


def _head(size: int, content: int) -> bytes:
    return size.to_bytes(8, "big") + (content + _SIGNED).to_bytes(8, "big")  # bytes in the order of the numbers


def _entries(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    """Terminals as rows without a number; few at a time, as bodies may be long."""
    part: list[tuple] = []
    held = 0
    for key, (entry, owner, copies) in found:
        size, content = int.from_bytes(key[:8], "big"), int.from_bytes(key[8:HEAD], "big") - _SIGNED
        part.append((None, None, None, entry, size, content, key[HEAD:], *owner, copies))
        held += len(key)
        if len(part) == 1000 or held > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _ROWS.types)], schema=_ROWS)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _ROWS.types)], schema=_ROWS)


def _gather(largest: bool, most: int) -> Callable:
    """Rows (doc_id, size, hash, meets, text) to rows with their digest and entry, and one row per entry.

    An entry is a terminal of this task's trie. A trie over its bound lets its heaviest subtrees go as entries, so
    a text may have several entries of a task; they meet in the next trie.
    """
    wins = _better(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, row = Trie(), TaskContext.get().partitionId() << 36
        next_entry = row
        for batch in batches:
            ids, sizes, hashes, meets = (batch.column(i).to_pylist() for i in range(4))
            digests, entries, first = [], [], row
            for i, text in enumerate(batch.column(4)):
                body = normal_bytes(text.as_py())
                digests.append(hashlib.sha256(body).digest())
                entry = None
                if meets[i]:
                    node = trie.place(_head(sizes[i], hashes[i]) + body)
                    me = (ids[i], row)
                    if node.terminal is None:
                        node.terminal = [next_entry, me, 1]
                        next_entry += 1
                    else:
                        node.terminal[2] += 1
                        if wins(me, node.terminal[1]):
                            node.terminal[1] = me
                    entry = node.terminal[0]
                    if trie.held > most:
                        yield from _entries(trie.release_heaviest(most // 2))
                entries.append(entry)
                row += 1
            none = [pa.nulls(len(ids), t) for t in _ROWS.types[4:]]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(range(first, row), pa.int64()), pa.array(digests, pa.binary()),
                pa.array(entries, pa.int64()), *none,
            ], schema=_ROWS)
        yield from _entries(trie.release())

    return run


def _merge(largest: bool, most: int) -> Callable:
    """Entries in the order of (size, hash) to (entry, keep_id, keep_row, group_size); subtrees that are passed go first."""
    wins = _better(largest)
    names = ["entry", "keep_id", "keep_row", "group_size"]

    def out(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        for _, (owner, copies, entries) in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries, pa.int64()), *(pa.array([v] * len(entries), pa.int64()) for v in (*owner, copies))], names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for values in zip(*columns):
                entry, size, content, body, keep_id, keep_row, copies = (v.as_py() for v in values)
                key, owner = _head(size, content) + body, (keep_id, keep_row)
                node = trie.place(key)
                if node.terminal is None:
                    node.terminal = [owner, copies, [entry]]
                else:
                    node.terminal[1] += copies
                    node.terminal[2].append(entry)
                    if wins(owner, node.terminal[0]):
                        node.terminal[0] = owner
                if trie.held > most:
                    yield from out(trie.release_beside(key))
        yield from out(trie.release())

    return run


def _content(text: Column) -> list[Column]:
    """Length and content hash: equal for texts that are equal but for A-Z, which full lower case only makes coarser."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.octet_length(whole).cast("long").alias("size"), F.xxhash64(F.lower(whole)).alias("hash")]


def owners(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per document: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the smallest id stays, or with
    the largest if ``keep`` says so. A text can only equal one of its length and content hash, so rows whose pair of
    both is their own are never compared. All others insert their bytes into a trie of their task, which combines
    copies, however many, to one entry; entries are dealt by length and hash to the final tries.

    Where more pairs recur than may be sent to all tasks, every text goes through the tries: the same result by one
    shuffle of the distinct texts of each task. A trie over ``trie_bytes`` lets subtrees go: of a task's trie the
    heaviest, as entries; of a final one those of lengths and hashes that are passed.

    Defined cases: a null text counts as empty. A null id stays only where all equal rows have none. Of rows that
    share id and text one is kept. Other columns are ignored, whatever their names. Empty in, empty out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    largest = keep == "largest"
    text = F.col(text_col)
    keys = staged(
        docs.select(*_content(text)).groupBy("size", "hash").agg(F.count("*").alias("n")).where("n > 1").select("size", "hash"),
        "exact-keys",
    )
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *_content(text), text.cast("string").cast("binary").alias("body")
    )
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        few = F.broadcast(keys.withColumn("meets", F.lit(True)))
        source = source.join(few, ["size", "hash"], "left")
    else:
        source = source.withColumn("meets", F.lit(True))
    source = source.select("doc_id", "size", "hash", F.coalesce("meets", F.lit(False)).alias("meets"), "body")
    gathered = staged(source.mapInArrow(_gather(largest, trie_bytes), _ROWS_SQL), "exact-entries", codec="zstd")
    entries = gathered.where("row IS NULL").select("entry", "size", "hash", "body", "keep_id", "keep_row", "copies")
    owned = entries.repartition("size", "hash").sortWithinPartitions("size", "hash").mapInArrow(
        _merge(largest, trie_bytes), "entry long, keep_id long, keep_row long, group_size long"
    )
    rows = gathered.where("row IS NOT NULL").select("doc_id", "row", "digest", "entry")
    met = rows.where("entry IS NOT NULL").join(owned, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    alone = rows.where("entry IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return met.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
