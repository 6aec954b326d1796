"""Source divergence audit: the terms of every language by iceberg prefix refinement, then exact differences of sources."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.session import BROADCAST_ROWS, staged

LEAST_DOCUMENTS = 30
FIRST_LEVEL = 4  # bytes; each further level doubles them
SHARE = 1_000_000_000
ADDED = 5
TOP_TERMS = 50
BITS = 24  # log2 of the bits that tell the tasks which prefixes survive: 2 MB, whatever their number
HELD = 400_000  # counters that a task holds before it hands them on
TERM_BLOCK, SOURCE_BLOCK = 2048, 128  # of the matrices that compare sources: 2 MB each

# Letters of ASCII in lower case and all bytes of other characters stay, everything else parts terms.
_TERMS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


SHORT = 8  # bytes that fit a number: such terms and prefixes are counted as numbers
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)
_SPREAD = 0x9E3779B97F4A7C15


def _of_lang(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _place(lang: str, prefix: bytes) -> int:
    """The bit of a prefix."""
    if len(prefix) > SHORT:
        return xxhash.xxh64_intdigest(prefix, _of_lang(lang) & 0xFFFFFFFF) >> (64 - BITS)
    return ((int.from_bytes(prefix, "little") ^ _of_lang(lang)) * _SPREAD & (1 << 64) - 1) >> (64 - BITS)


def _alive(words: np.ndarray, lang: str, prefixes: np.ndarray) -> np.ndarray:
    """Whether prefixes, as numbers, survived."""
    bits = ((prefixes ^ np.uint64(_of_lang(lang))) * np.uint64(_SPREAD)) >> np.uint64(64 - BITS)
    return (words[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Fate(dict):
    """What becomes of a term of one language at a level: None if it is done or its prefix did not survive, True if it
    is counted whole, else the prefix that it is counted by. Answers are kept, up to a bound.

    ``words`` is a fixed number of bits that holds hashes of prefixes: it never denies one that survived and may let
    another pass, which is then counted in vain.
    """

    def __init__(self, lang: str, level: int, before: int, words: np.ndarray | None) -> None:
        super().__init__()
        self.lang, self.level, self.before, self.words = lang, level, before, words

    def __missing__(self, term: bytes) -> bytes | bool | None:
        if len(self) > HELD:
            self.clear()
        fate: bytes | bool | None = True if len(term) <= self.level else term[: self.level]
        if self.words is not None:
            bit = _place(self.lang, term[: self.before])
            if len(term) <= self.before or not self.words[bit >> 3] >> (bit & 7) & 1:
                fate = None
        self[term] = fate
        return fate


_COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("piece", pa.binary()), ("whole", pa.bool_()), ("docs", pa.int64()),
    ("times", pa.int64()),
])
_COUNTS_SQL = "lang string, source string, piece binary, whole boolean, docs long, times long"


def _counted(level: int, before: int, alive) -> Callable:
    """Documents to counts of whole terms of more than ``before`` and up to ``level`` bytes, and of the prefixes of
    ``level`` bytes of longer ones, if their prefix of ``before`` bytes survived.

    Documents are counted by language, as rows without a source, a term's occurrences by source. A document counts
    once for a term and once for a prefix. Counters are handed on and emptied when they grow.
    """

    def rows(docs: dict, times: dict, prefixes: dict, fates: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counter in times.items():
            fate = fates[lang]
            pieces = [p for p in counter if fate[p] is True]
            n = len(pieces)
            yield _batch([lang] * n, [source] * n, pieces, [True] * n, [0] * n, [counter[p] for p in pieces])
        for lang, counter in docs.items():
            fate = fates[lang]
            pieces = [p for p in counter if fate[p] is True]
            n = len(pieces)
            yield _batch([lang] * n, [None] * n, pieces, [True] * n, [counter[p] for p in pieces], [0] * n)
        for lang, counter in prefixes.items():
            n = len(counter)
            yield _batch([lang] * n, [None] * n, list(counter), [False] * n, list(counter.values()), [0] * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if alive is None else np.frombuffer(alive.value, np.uint8)
        fates: dict[str, Fate] = {}
        docs, times, prefixes = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2)):
                found = terms(text.as_py())
                if before:
                    found = [t for t in found if len(t) > before]
                if lang not in fates:
                    fates[lang] = Fate(lang, level, before, words)
                # Whole terms are picked out when the counters are handed on, once each.
                distinct = set(found)
                docs[lang].update(distinct)
                times[lang, source].update(found)
                prefixes[lang].update(set(map(fates[lang].__getitem__, distinct)) - {None, True})
            if sum(map(len, times.values())) + sum(map(len, prefixes.values())) > HELD:
                yield from rows(docs, times, prefixes, fates)
                docs, times, prefixes = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
                fates = {} if len(fates) > 100 else fates
        yield from rows(docs, times, prefixes, fates)

    return run


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 8 bytes as a number, length, first token of each text) of all terms of some texts."""
    joined = b" ".join([b"", *texts, b" " * SHORT]).translate(_TERMS)
    cells = np.frombuffer(joined, np.uint8)
    edges = np.flatnonzero(np.diff(cells != 0x20)) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    heads = np.lib.stride_tricks.sliding_window_view(cells, SHORT)[starts].copy().view("<u8").ravel()
    ends = np.cumsum([1] + [len(t) + 1 for t in texts])
    return heads & _MASKS[np.minimum(sizes, SHORT)], sizes, np.searchsorted(starts, ends)


class Sums:
    """Counts by number for each key, summed whenever they are looked at."""

    def __init__(self) -> None:
        self.parts: dict = defaultdict(list)

    def add(self, key, codes: np.ndarray, n: np.ndarray) -> None:
        if len(codes):
            self.parts[key].append((codes, n))

    def merged(self) -> int:
        """Sum up what was added; how many counts there are."""
        held = 0
        for key, parts in self.parts.items():
            if len(parts) > 1:
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                self.parts[key] = [(codes, n)]
            held += len(self.parts[key][0][0])
        return held

    def drained(self) -> Iterator[tuple]:
        self.merged()
        for key, [(codes, n)] in self.parts.items():
            yield key, codes.astype("<u8").view("S8").tolist(), n.tolist()
        self.parts.clear()


def _counted_short(level: int, before: int, alive) -> Callable:
    """The same as ``_counted`` for levels of up to 8 bytes, where every term and prefix is a number."""

    def drain(docs: Sums, times: Sums, prefixes: Sums) -> Iterator[pa.RecordBatch]:
        for (lang, source), pieces, n in times.drained():
            yield _batch([lang] * len(n), [source] * len(n), pieces, [True] * len(n), [0] * len(n), n)
        for sums, whole in ((docs, True), (prefixes, False)):
            for lang, pieces, n in sums.drained():
                yield _batch([lang] * len(n), [None] * len(n), pieces, [whole] * len(n), n, [0] * len(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if alive is None else np.frombuffer(alive.value, np.uint8)
        docs, times, prefixes = Sums(), Sums(), Sums()

        def count(rows: list[tuple[str, str, bytes]]) -> None:
            heads, sizes, first = _tokens([r[2] for r in rows])
            for (lang, source, _), a, b in zip(rows, first, first[1:]):
                codes, size = heads[a:b], sizes[a:b]
                if before:
                    codes, size = codes[size > before], size[size > before]
                    fits = _alive(words, lang, codes & _MASKS[before])
                    codes, size = codes[fits], size[fits]
                whole, n = np.unique(codes[size <= level], return_counts=True)
                times.add((lang, source), whole, n)
                docs.add(lang, whole, np.ones(len(whole), np.int64))
                longer = np.unique(codes[size > level] & _MASKS[level])
                prefixes.add(lang, longer, np.ones(len(longer), np.int64))

        for batch in batches:
            rows, held = [], 0
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows.append((row[0], row[1], row[2].as_py()))
                held += len(rows[-1][2])
                if held > 1_000_000:
                    count(rows)
                    rows, held = [], 0
            count(rows)
            if times.merged() + docs.merged() + prefixes.merged() > HELD:
                yield from drain(docs, times, prefixes)
        yield from drain(docs, times, prefixes)

    return run


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTS.types)], schema=_COUNTS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, piece) to 64-bit words of the survivors' bits."""
    for batch in batches:
        spots = np.array(
            [_place(*key) for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64
        )
        bits = (np.uint64(1) << (spots & 63).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spots >> 6), pa.array(bits)], ["word", "bits"])


def _survivor_bits(spark: SparkSession, pieces: DataFrame):
    """The survivors' bits on all tasks: 2**BITS bits, however many prefixes survive."""
    found = pieces.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return spark.sparkContext.broadcast(words.tobytes())


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, term, times): how often each kept term occurs, where it does; docs has lang, source, body.

    Level by level term prefixes are extended, to 4, 8, 16 ... bytes. A level counts the distinct documents of each
    prefix whose shorter prefix survived; those in fewer than ``least`` go, with all terms that begin so, as a term is
    in no more documents than its prefix. A term that is no longer than the level is counted whole. The levels end
    when no longer term is left, so their number follows the kept terms, not the longest string of the corpus.
    """
    spark = docs.sparkSession
    level, before, alive = first_level, 0, None
    found = None
    while True:
        # The tasks have summed their own rows, so the counts are dealt out as they are.
        counting = _counted_short if level <= SHORT else _counted
        counts = docs.mapInArrow(counting(level, before, alive), _COUNTS_SQL).repartition("lang", "piece")
        counts = staged(
            counts.groupBy("lang", "source", "piece", "whole").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")),
            "iceberg-level", codec="zstd",
        )
        whole = counts.where("whole").select("lang", "source", "piece", "docs", "times")
        kept = whole.groupBy("lang", "piece").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
        own = whole.where("source IS NOT NULL").select("lang", "source", "piece", "times")
        held = staged(own.join(kept, ["lang", "piece"]).select("lang", "source", "piece", "times"), "iceberg-kept")
        found = held if found is None else found.unionByName(held)
        longer = staged(counts.where("NOT whole").where(F.col("docs") >= least).select("lang", "piece"), "iceberg-prefixes")
        if alive is not None:
            alive.unpersist()
        if longer.isEmpty():
            return found.select("lang", "source", F.col("piece").cast("string").alias("term"), "times")
        alive = _survivor_bits(spark, longer)
        level, before = 2 * level, level


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(times: Column, total: Column, size: Column) -> Column:
    """1 + floor(SHARE * (times + 5) / (total + 5 * size)) in steps of 1000, exact for totals below 9e15."""
    part, whole = times + ADDED, total + ADDED * size
    out = F.lit(0).cast("long")
    for _ in range(3):  # SHARE is 1000 ** 3
        out = out * 1000 + _div(part * 1000, whole)
        part = (part * 1000) % whole
    return out + 1


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over one block of terms for the pairs of two blocks of sources (or of the pairs within one).

    Rows without a term give each source of the blocks and its share of a term that it does not hold. Terms that none
    of these sources holds have no column: the first block of terms adds that difference for every term of the
    language, and each block takes it back for its columns.
    """
    lang, a, b = rows["lang"].iat[0], rows["a"].iat[0], rows["b"].iat[0]
    every = rows[rows["term_no"].isna()].reset_index(drop=True)
    held = rows[rows["term_no"].notna()]
    spots = pd.Series(np.arange(len(every)), index=every["source_no"].to_numpy())
    codes, distinct = pd.factorize(held["term_no"])
    shares = np.repeat(every["p"].to_numpy(np.int64)[:, None], len(distinct), axis=1)
    shares[spots.loc[held["source_no"]].to_numpy(), codes] = held["p"].to_numpy(np.int64)
    block, names, bare = every["own"].to_numpy(), every["source"].to_numpy(), every["p"].to_numpy(np.int64)
    columns = (int(every["size"].iat[0]) if rows["block"].iat[0] == 0 else 0) - len(distinct)
    out = []
    for i in np.flatnonzero(block == a):
        others = np.flatnonzero(block == b)
        others = others[others > i] if a == b else others
        sums = np.abs(shares[others] - shares[i]).sum(axis=1) + columns * np.abs(bare[others] - bare[i])
        out += [(lang, names[i], names[j], int(v)) for j, v in zip(others, sums)]
    return pd.DataFrame(out, columns=["lang", "x", "y", "value"])


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways.

    Terms and sources are dealt into blocks; a task holds one block of terms for two blocks of sources. A third of
    all rows in one source is one row a term here, as counts are summed before.
    """
    blocks = F.greatest(F.ceil(F.col("size") / TERM_BLOCK), F.lit(1)).cast("int")
    nothing = F.lit(0).cast("long")
    every = groups.select(
        "lang", "source", "source_no", "own", "own_blocks", "size", F.lit(None).cast("long").alias("term_no"),
        F.when(F.col("size") > 0, share(nothing, F.col("total"), F.col("size"))).otherwise(nothing).alias("p"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )
    held = counts.select(
        "lang", F.lit(None).cast("string").alias("source"), "source_no", "own", "own_blocks", "size", "term_no", "p",
        F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"),
    )
    met = every.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)))
    met = met.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    sums = met.groupBy("lang", "block", "a", "b").applyInPandas(_pair_sums, "lang string, x string, y string, value long")
    sums = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    return sums.select("lang", F.explode(F.array(
        F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))
    )).alias("way"), "value").select("lang", "way.*", "value")


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS, first_level: int = FIRST_LEVEL,
) -> DataFrame:
    """How the sources of a language differ: lang, source, part, item, value, rank.

    Each language keeps the terms that at least ``least`` of its documents hold. The share of a kept term in a source
    is 1 + floor(10**9 (times + 5) / (N + 5 V)), N its occurrences of kept terms and V their number. Part ``pair`` gives
    each other source of the language with the sum of the differences over all kept terms, part ``term`` the
    ``top_terms`` terms whose share in the source is most above the one in its whole language. Ranks go by value, then
    by the bytes of the item.

    Defined cases: a null text, lang or source counts as empty, the empty lang and the empty source are ones like any
    other. A source without kept terms takes part with N = 0; where a language keeps none all its pairs have value 0
    and there are no terms. A lone source has no pairs. Repeated rows are documents each, ids are not read. Other
    columns are ignored, whatever their names. Empty in, empty out.
    """
    plain = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    found = kept_terms(plain, least, first_level)
    words = staged(
        found.groupBy("lang", "term").agg(F.sum("times").alias("times_all")).withColumn("term_no", F.monotonically_increasing_id()),
        "divergence-terms",
    )
    totals = found.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    held = plain.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left")
    held = staged(
        held.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")).withColumn("source_no", F.monotonically_increasing_id()),
        "divergence-sources",
    )
    sizes = words.groupBy("lang").agg(F.count("*").alias("size"))
    langs = held.groupBy("lang").agg(F.sum("total").alias("total_all"), F.count("*").alias("sources")).join(sizes, "lang", "left")
    langs = _few(staged(langs.withColumn("size", F.coalesce("size", F.lit(0))), "divergence-langs"))
    own_blocks = F.ceil(F.col("sources") / SOURCE_BLOCK).cast("int")
    groups = held.join(langs, "lang").withColumn("own_blocks", own_blocks)
    groups = groups.withColumn("own", F.pmod(F.xxhash64("source"), "own_blocks").cast("int"))
    counts = found.join(words, ["lang", "term"]).join(_few(groups), ["lang", "source"])
    counts = staged(
        counts.withColumns({
            "p": share(F.col("times"), F.col("total"), F.col("size")),
            "q": share(F.col("times_all"), F.col("total_all"), F.col("size")),
        }), "divergence-shares", codec="zstd",
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    above = counts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    pairs = _pairs(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(above)
