"""Secret scan: known shapes by pattern, random strings by token efficiency."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of equal starts, patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

LEAST_RANDOM = 16
MOST_CHARS_PER_TOKEN = 2.2  # prose and names lie above 3, base64 and hex below 2
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}", re.IGNORECASE)
# Letter parts of a name: capitals, or a word with or without a capital. No part can be cut in two ways.
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SEPARATED = re.compile(r"[A-Za-z0-9]+")
LEAST_WORD, LEAST_TWO_TOKEN_WORD = 3, 6  # letters of a part that is a word by one token, by two


class TokenLengths:
    """Characters per token of a string under a byte-pair vocabulary."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, text: str) -> float:
        return len(text) / self.count(text)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def is_name(self, text: str) -> bool:
        """Every letter part of three or more letters is one token, or two from six letters on, and these parts hold
        at least half of the letters and digits; a text without letters is a number or a rule."""
        words = 0
        for m in _PART.finditer(text):
            size = m.end() - m.start()
            if size < LEAST_WORD:
                continue
            tokens = self.count(m.group())
            if tokens > 2 or (tokens == 2 and size < LEAST_TWO_TOKEN_WORD):
                return False
            words += size
        return not any(c.isalpha() for c in text) or 2 * words >= sum(c.isalnum() for c in text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the fixed patterns; matches that are too short are passed over whole."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _is_random(word: str, lengths: TokenLengths) -> bool:
    return (
        len(word) >= LEAST_RANDOM and lengths.ratio(word) < MOST_CHARS_PER_TOKEN and not _DIGEST.fullmatch(word)
        and not _UUID.fullmatch(word) and not lengths.is_name(word)
    )


def _random_parts(word: str, lengths: TokenLengths) -> list[tuple[int, int]]:
    """Random stretches of a string that is readable in parts, such as a path or a slug that ends in a key.

    Separators cut the string. Names and other readable parts, of 6 or more characters and many a token, end a stretch,
    numbers between others do not; a stretch, from its first to its last part that is no number, is judged as a whole
    string is.
    """
    found: list[tuple[int, int]] = []
    stretch: tuple[int, int] | None = None
    for m in _SEPARATED.finditer(word):
        part = m.group()
        if part.isdigit():
            continue
        if lengths.is_name(part) or (len(part) >= LEAST_TWO_TOKEN_WORD and lengths.ratio(part) >= MOST_CHARS_PER_TOKEN):
            if stretch:
                found.append(stretch)
            stretch = None
        else:
            stretch = (stretch[0] if stretch else m.start(), m.end())
    if stretch:
        found.append(stretch)
    return [(a, b) for a, b in found if _is_random(word[a:b], lengths)]


def random_spans(text: str, lengths: TokenLengths, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings with few characters per token that are no digest, identifier, name of words or earlier span.

    Digests and identifiers are told on the whole string; else its separated parts are judged where it is not random
    as a whole. ``taken`` is sorted by start, and spans that meet one of it are left out.
    """
    found = []
    after, reach = 0, -1
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        if _DIGEST.fullmatch(word) or _UUID.fullmatch(word):
            continue
        spans = [(0, len(word))] if _is_random(word, lengths) else _random_parts(word, lengths)
        for a, b in spans:
            start, end = m.start() + a, m.start() + b
            while after < len(taken) and taken[after][0] < end:
                reach = max(reach, taken[after][2])
                after += 1
            if reach <= start:
                found.append((start, 3, end))
    return found


def _finder(ranks_path: str, pattern: str):
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = TokenLengths(ranks_path, pattern)
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, lengths, base))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    return run


def secret_spans(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, spans - array of (kind, start, end) by start, then kind; code points, end exclusive.

    Whole texts are scanned in place, without a shuffle. ``assign``, ``access`` and ``hex`` are fixed patterns.
    ``random`` adds strings of 16 or more characters that a byte-pair vocabulary encodes in few characters a token
    (below 2.2): random strings have no frequent parts, whatever kinds of characters they have. Digests of known
    lengths, UUIDs, numbers, names whose letter parts are vocabulary words and what a fixed pattern has found are left
    out. A string that is readable in parts is judged between its separators: names end a stretch, the rest of a path,
    slug or assignment is judged by itself.

    Defined cases: null and empty texts have no spans; rows that share an id are scanned each; a null id is carried
    along. Other columns are ignored, whatever their names. Empty in, empty out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(
        _finder(ranks_path, pattern), "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    )
