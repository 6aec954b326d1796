"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
LEAST_PIECE = 11
BLOCK_CHARS = 4_000_000  # of items at a time: the bound of what travels to every task


def normal_form(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    """Edits allowed for an item: 8 percent of its length, fewer where its pieces would be under 11 characters."""
    return max(0, min(int(len(item) * ERROR_RATE), len(item) // LEAST_PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces: with no more edits than the budget, one of them is untouched."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel search for the place in a text with the fewest edits."""

    def __init__(self, item: str) -> None:
        self.item = item
        self.size = len(item)
        self.forward, self.backward = self._masks(item), self._masks(item[::-1])

    @staticmethod
    def _masks(item: str) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            masks[c] |= 1 << i
        return dict(masks)

    def _scan(self, masks: dict[str, int], text: str) -> tuple[int, int]:
        """(fewest edits, end) over all substrings that end at ``end``; the first such end."""
        top, full = 1 << (self.size - 1), (1 << self.size) - 1
        plus, minus, score = full, 0, self.size
        best, where = score, 0
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            down = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(across | plus))
            low = plus & across
            if up & top:
                score += 1
            elif low & top:
                score -= 1
                if score < best:
                    best, where = score, at
            up = (up << 1) & full
            low = (low << 1) & full
            plus = low | (full & ~(down | up))
            minus = up & down
        return best, where

    def find(self, text: str) -> tuple[int, int, int]:
        """(edits, start, end) of the best place in a text."""
        edits, end = self._scan(self.forward, text)
        _, back = self._scan(self.backward, text[:end][::-1])
        return edits, end - back, end


def matches(text: str, automaton, patterns: dict[int, Pattern]) -> Iterator[tuple[int, int, int, int]]:
    """(item, edits, start, end): the best place of every item that is in the text within its budget."""
    windows: dict[int, list[int]] = defaultdict(list)
    for end, (size, places) in automaton.iter(text):
        for item, offset in places:
            windows[item].append(end + 1 - size - offset)
    for item, starts in windows.items():
        pattern = patterns[item]
        slack = budget(pattern.item)
        best = None
        last_stop = -1
        spans: list[list[int]] = []
        for start in sorted(set(starts)):
            if text.startswith(pattern.item, max(start, 0)) and start >= 0:
                best = (0, start, start + pattern.size)
                break
            low, high = max(0, start - slack), start + pattern.size + slack
            if spans and low <= last_stop:
                spans[-1][1] = high
            else:
                spans.append([low, high])
            last_stop = high
        if best is None:
            for low, high in spans:
                edits, a, b = pattern.find(text[low:high])
                if edits <= slack and (best is None or edits < best[0]):
                    best = (edits, low + a, low + b)
        if best:
            yield item, *best


def _searcher(block: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        places: dict[str, list] = defaultdict(list)
        patterns = {}
        for n, (_, text) in enumerate(block):
            patterns[n] = Pattern(text)
            for offset, piece in pieces(text):
                places[piece].append((n, offset))
        automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            automaton.add_word(piece, (len(piece), where))
        automaton.make_automaton()
        for batch in batches:
            found: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, *where in matches(normal_form(text.as_py()), automaton, patterns):
                    found.append((doc_id, block[n][0], *where))
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start", "end"]
            )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for item in items.toLocalIterator():
        text = normal_form(item["text"])
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item["item_id"], text))
        size += len(text)
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, start, end.

    An item is in a document if a stretch of it, in lower case with single blanks, is within the item's edit
    budget; the row names the stretch with the fewest edits, the first of equals (exact copies at once). Items go
    to the tasks in blocks of at most four million characters and each block meets every whole text, so memory does
    not depend on the size of the benchmark. There is no shuffle.

    Defined cases: null or blank items and texts match nothing, items without an id are left out; repeated items or
    rows give repeated results; items that share an id are told apart by their own text and give a row each. Other
    columns of either input are ignored, whatever their names. Empty in, empty out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    ).where("item_id IS NOT NULL")
    schema = "doc_id long, item_id long, edits long, start long, end long"
    found = None
    for block in _blocks(items):
        part = source.mapInArrow(_searcher(block), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else source.select("doc_id").limit(0).mapInArrow(_nothing, schema)


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    yield from ()
