"""From tokens to characters: coverage, nearest fill, Unicode boundary maps, sequence features."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..functions.text import WHITESPACE
from . import textsearch
from .ordered import with_running

WORD = "[^" + WHITESPACE[1:-1] + "]+"


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("word"))


def normalized_entropy(items: DataFrame, key: str, item: str) -> DataFrame:
    """Entropy of a document's items over its maximum; null below two items, 0 with one distinct item."""
    counts = items.groupBy(key, item).agg(F.count(F.lit(1)).alias("_c"))
    # -sum(p ln p) = ln(t) - sum(c ln c) / t needs no second pass for the total.
    sums = counts.groupBy(key).agg(
        F.sum("_c").alias("_t"), F.sum(F.col("_c") * F.log("_c")).alias("_clnc"), F.count(F.lit(1)).alias("_k")
    )
    h = F.log("_t") - F.col("_clnc") / F.col("_t")
    value = F.when(F.col("_t") >= 2, F.when(F.col("_k") < 2, F.lit(0.0)).otherwise(h / F.log("_k")))
    return sums.select(key, value.alias("entropy"))


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whitespace-delimited tokens with code-point offsets."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(WORD + "|" + WHITESPACE + "+"), F.lit(0))
    long = df.select(key, F.posexplode(pieces).alias("_i", "_piece")).select(
        key, "_i", F.length("_piece").alias("_n"), F.rlike("_piece", F.lit("^" + WORD)).alias("_word")
    )
    order = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = long.select(
        key, "_word", "_n", F.sum("_n").over(order).alias("_end"),
        F.sum(F.col("_word").cast("int")).over(order).alias("_k"),
    )
    return placed.where("_word").select(
        key, (F.col("_k") - 1).cast("int").alias("token_index"),
        (F.col("_end") - F.col("_n")).cast("int").alias("char_start"), F.col("_end").cast("int").alias("char_end"),
    )


BATCH_ROWS = 256  # documents whose arrays are built at a time


def _lists(sizes: list[int], columns: dict[str, pa.Array]) -> pa.Array:
    """One list of structs per size from columns that hold the lists' entries end to end."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _map_rows(df: DataFrame, drop: str, name: str, kind: str, build: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``df`` with the column ``name`` that ``build`` makes of some rows at a time, and without ``drop``."""
    kept = df.drop(drop)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], build(part)], [*names, name])

    return df.mapInArrow(run, schema)


def token_arrays(df: DataFrame, text: str = "text") -> DataFrame:
    """The ``tokens`` of each row's text as an array of (token_index, char_start, char_end), in place of the text.

    Nothing is shuffled; each row is a document by itself. A null text has no tokens.
    """

    def build(batch: pa.RecordBatch) -> pa.Array:
        starts, ends, sizes = [], [], []
        for value in batch.column(text).to_pylist():
            edge = np.diff(np.pad(~textsearch.is_space(textsearch.code_points(value or "")), 1).astype(np.int8))
            starts.append(np.flatnonzero(edge == 1))
            ends.append(np.flatnonzero(edge == -1))
            sizes.append(len(starts[-1]))
        whole = lambda parts: pa.array(np.concatenate(parts).astype(np.int32))
        index = whole([np.arange(n) for n in sizes])
        return _lists(sizes, {"token_index": index, "char_start": whole(starts), "char_end": whole(ends)})

    return _map_rows(df, text, "tokens", "array<struct<token_index:int,char_start:int,char_end:int>>", build)


def _cover(start: np.ndarray, end: np.ndarray, value: np.ndarray, length: int | None) -> tuple[np.ndarray, ...]:
    """(edges, sum of values, covers) of the stretches between the edges of live tokens and of a text."""
    rims = [0] if length is None else [0, length]
    pos = np.concatenate((start, end, rims)).astype(np.int64)
    order = np.argsort(pos, kind="stable")
    pos = pos[order]
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    step = lambda v: np.cumsum(np.add.reduceat(np.concatenate((v, -v, np.zeros(len(rims), v.dtype)))[order], first))
    if length is not None and pos[-1] > length:
        raise ValueError("token offset beyond the text")
    return pos[first], step(value), step(np.ones(len(start), np.int64))


def _run_arrays(batch: pa.RecordBatch) -> pa.Array:
    lists = batch.column("tokens")
    stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    start, end = (flat.field(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("char_start", "char_end"))
    value = flat.field("value").fill_null(0.0).to_numpy(zero_copy_only=False)
    live = flat.field("valid").fill_null(False).to_numpy(zero_copy_only=False) & (start >= 0) & (end > start)
    columns, sizes, low = [], [], 0
    for stop, length in zip(stops, batch.column("n_chars").to_pylist(), strict=True):
        on = low + np.flatnonzero(live[low:stop])
        low = stop
        edges, total, covers = _cover(start[on], end[on], value[on], length)
        # A text of unknown length has a stretch without a start before it, and ends with its last token.
        lead = length is None
        begin = np.concatenate((edges[:1], edges))[: -1] if lead else edges[:-1]
        known = np.concatenate(([False], np.ones(len(edges) - 1, bool))) if lead else np.ones(len(edges) - 1, bool)
        stretch = lambda v, lead=lead: np.concatenate((v[:0] if not lead else np.zeros(1, v.dtype), v[:-1]))
        columns.append((begin, ~known, edges if lead else edges[1:], stretch(total), stretch(covers)))
        sizes.append(len(begin))
    begin, unknown, stop, total, covers = (np.concatenate(c) for c in zip(*columns, strict=True))
    mean = np.divide(total, covers, out=np.zeros(len(total)), where=covers > 0)
    return _lists(sizes, {
        "char_start": pa.array(begin.astype(np.int32), mask=unknown), "char_end": pa.array(stop.astype(np.int32)),
        "value": pa.array(mean, mask=covers <= 0), "covered": pa.array(covers > 0),
    })


RUNS = "array<struct<char_start:int,char_end:int,value:double,covered:boolean>>"


def unshared(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Narrow rows, one for each key; a key of several documents with characters is an error."""
    first = [F.first(c).alias(c) for c in df.columns if c != key]
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *first)
    shared = F.raise_error(F.lit("token offset beyond the text: documents share a key")).cast("boolean")
    return found.where(F.when(F.col("_n") > 1, shared).otherwise(True)).select(*df.columns)


def covered_runs(token_values: DataFrame, lengths: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Maximal runs of constant token cover: mean of the valid tokens over each stretch of characters.

    Works on token edges, so its volume is that of the tokens rather than of the characters. Columns
    of ``token_values``: char_start, char_end, valid, value; ``lengths`` has the text length per key.

    Without ``lengths`` a row is a document with its ``n_chars`` and its ``tokens`` as an array of these columns. Its runs
    then are an array ``runs`` in place of the tokens, and nothing is shuffled; texts of no character go. ``coverage``,
    ``fill_nearest`` and ``expand_runs`` take either form.
    """
    if lengths is None:
        return _map_rows(token_values, "tokens", "runs", RUNS, _run_arrays).where(F.size("runs") > 0)
    live = token_values.where(F.col("valid") & (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")))
    edge = lambda at, sign: F.struct(
        F.col(at).alias("pos"), (F.col("value") * sign).alias("dv"), F.lit(sign).alias("dc")
    )
    edges = live.select(key, F.inline(F.array(edge("char_start", 1), edge("char_end", -1))))
    edges = edges.withColumn("n", F.lit(None).cast("int"))
    zero = lambda at: F.struct(
        at.cast("int").alias("pos"), F.lit(0.0).alias("dv"), F.lit(0).alias("dc"),
        F.col("n_chars").cast("int").alias("n"),
    )
    rims = lengths.select(key, F.inline(F.array(zero(F.lit(0)), zero(F.col("n_chars")))))
    steps = edges.unionByName(rims).groupBy(key, "pos").agg(
        F.sum("dv").alias("dv"), F.sum("dc").alias("dc"), F.max("n").alias("n")
    )
    order = Window.partitionBy(key).orderBy("pos")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    stepped = steps.select(
        key, F.col("pos").alias("char_start"), F.lead("pos").over(order).alias("char_end"),
        F.sum("dv").over(run).alias("_v"), F.sum("dc").over(run).alias("covers"), F.max("n").over(run).alias("n"),
    ).where(F.col("char_end").isNotNull())
    beyond = F.raise_error(F.lit("token offset beyond the text")).cast("int")
    return stepped.select(
        key,
        "char_start",
        F.when(F.col("char_end") > F.col("n"), beyond).otherwise(F.col("char_end")).alias("char_end"),
        F.when(F.col("covers") > 0, F.col("_v") / F.col("covers")).alias("value"),
        (F.col("covers") > 0).alias("covered"),
    )


def fill_nearest(runs: DataFrame, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """Give uncovered stretches the value of the nearest covered character, the left one on ties.

    A gap between covered runs splits at its middle. A document without any covered character fails; unless
    ``strict``, it keeps its one run with a null value, for the caller to report.
    """
    part = lambda a, b, v, c: F.when(
        a < b, F.struct(a.alias("char_start"), b.alias("char_end"), v.alias("value"), F.lit(c).alias("covered"))
    )

    # Every run edge is the edge of a valid token or of the text, so a gap's neighbours are covered runs.
    def cut(run: Column, left: Column, right: Column) -> Column:
        middle = F.floor((left["char_end"] - 1 + right["char_start"]) / 2).cast("int") + 1
        bare = F.raise_error(F.lit("no covered character")).cast("int") if strict else run["char_end"]
        return (
            F.when(left["value"].isNull() & right["value"].isNull(), bare)
            .when(left["value"].isNull(), run["char_start"])
            .when(right["value"].isNull(), run["char_end"])
            .otherwise(F.least(F.greatest(middle, run["char_start"]), run["char_end"]))
        )

    whole = lambda run: F.array(part(run["char_start"], run["char_end"], run["value"], True))
    halves = lambda run, left, right, at: F.array_compact(
        F.array(part(run["char_start"], at, left["value"], False), part(at, run["char_end"], right["value"], False))
    )
    if "runs" in runs.columns:
        def filled(run: Column, i: Column) -> Column:
            left, right = F.get("runs", i - 1), F.get("runs", i + 1)
            return F.when(run["covered"], whole(run)).otherwise(halves(run, left, right, cut(run, left, right)))

        return runs.withColumn("runs", F.flatten(F.transform("runs", filled)))
    order = Window.partitionBy(key).orderBy("char_start")
    run = F.struct("char_start", "char_end", "value", "covered")
    around = runs.select(key, run.alias("_run"), F.lag(run).over(order).alias("_left"), F.lead(run).over(order).alias("_right"))
    run, left, right = F.col("_run"), F.col("_left"), F.col("_right")
    out = around.withColumn("_cut", F.when(~run["covered"], cut(run, left, right)))
    return out.select(key, F.inline(F.when(run["covered"], whole(run)).otherwise(halves(run, left, right, F.col("_cut")))))


def coverage(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of characters under at least one valid token, and the sum of their values.

    Rows with an array ``runs`` get these as further columns.
    """
    if "runs" in runs.columns:
        size = lambda r: r["char_end"] - r["char_start"]
        # Null only if there is nothing to add up, as in the aggregate below.
        add = lambda terms, zero: F.when(
            F.exists(terms, lambda t: t.isNotNull()), F.aggregate(terms, zero, lambda a, t: a + F.coalesce(t, zero))
        )
        covered = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + F.when(r["covered"], size(r)).otherwise(0))
        whole = add(F.transform("runs", size), F.lit(0).cast("bigint"))
        total = add(F.transform("runs", lambda r: F.when(r["covered"], r["value"] * size(r))), F.lit(0.0))
        return runs.withColumns({"covered_chars": covered, "mapping_coverage": covered / whole, "covered_total": total})
    length = F.col("char_end") - F.col("char_start")
    covered = F.sum(F.when(F.col("covered"), length).otherwise(0))
    return runs.groupBy(key).agg(
        covered.cast("bigint").alias("covered_chars"), (covered / F.sum(length)).alias("mapping_coverage"),
        F.sum(F.when(F.col("covered"), F.col("value") * length)).alias("covered_total"),
    )


def expand_runs(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One score array per document from its runs (bounded by the text's own length).

    ``filled_total`` sums the scores that came from a neighbour. Rows with an array ``runs`` get both in its place.
    """
    spelled = lambda ordered: F.flatten(F.transform(ordered, lambda r: F.array_repeat(r["value"], r["char_end"] - r["char_start"])))
    if "runs" in runs.columns:
        gaps = F.filter("runs", lambda r: ~r["covered"] & r["value"].isNotNull())
        add = F.aggregate(gaps, F.lit(0.0), lambda a, r: a + r["value"] * (r["char_end"] - r["char_start"]))
        return runs.withColumns({"filled_total": F.when(F.size(gaps) > 0, add), "scores": spelled("runs")}).drop("runs")
    sorted_runs = F.array_sort(F.collect_list(F.struct("char_start", "char_end", "value")))
    length = F.col("char_end") - F.col("char_start")
    filled = F.sum(F.when(~F.col("covered"), F.col("value") * length))
    return runs.groupBy(key).agg(sorted_runs.alias("_r"), filled.alias("filled_total")).select(
        key, "filled_total",
        spelled("_r").alias("scores"),
    )


@lru_cache(maxsize=2)
def _clusters(form: str) -> re.Pattern:
    """Clusters that normalisation may change: a character with those that combine with it, or one that changes alone.

    What combines with the character before comes from the Unicode database: marks, vowels and finals of Hangul, second
    halves of compositions, and whatever decomposes to one of these first.
    """
    joining = {chr(c) for r in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(*r)}
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in every:
        if unicodedata.combining(c):
            joining.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joining.add(chr(int(parts[1], 16)))
    joined = {c for c in every if unicodedata.normalize("NFKD", c)[0] in joining}
    changed = {c for c in every if c not in joined and unicodedata.normalize(form, c) != c}
    a, b = ("[" + "".join(map(re.escape, sorted(x))) + "]" for x in (joined, changed))
    return re.compile(f"(?:^|[^{a[1:-1]}]){a}+|{b}", re.DOTALL)


@lru_cache(maxsize=65536)
def _prefixes(cluster: str, form: str) -> tuple[int, ...]:
    """Normalised lengths of the prefixes of a cluster."""
    return tuple(len(unicodedata.normalize(form, cluster[: i + 1])) for i in range(len(cluster)))


def boundary_runs(text: str, form: str) -> list[dict]:
    """Stretches where normalised offsets advance one for one with raw offsets.

    Every entry says: raw boundary ``raw + k`` maps to normalised boundary ``norm + k`` for k < length. A text that is
    normalised is one run. In others only the clusters that may change are normalised, and each once a task.
    """
    if text.isascii() or unicodedata.is_normalized(form, text):
        return [{"raw": 0, "norm": 0, "length": len(text) + 1}]
    runs = [{"raw": 0, "norm": 0, "length": 1}]

    def note(raw: int, norm: int, length: int) -> None:
        last = runs[-1]
        if raw == last["raw"] + last["length"] and norm == last["norm"] + last["length"]:
            last["length"] += length
        else:
            runs.append({"raw": raw, "norm": norm, "length": length})

    at = norm = 0
    for m in _clusters(form).finditer(text):
        if m.start() > at:
            note(at + 1, norm + 1, m.start() - at)
            norm += m.start() - at
        sizes = _prefixes(m.group(), form)
        for i, size in enumerate(sizes, m.start() + 1):
            note(i, norm + size, 1)
        at, norm = m.end(), norm + sizes[-1]
    if at < len(text):
        note(at + 1, norm + 1, len(text) - at)
    return runs


RUN = T.ArrayType(
    T.StructType(
        [
            T.StructField("raw", T.IntegerType()),
            T.StructField("norm", T.IntegerType()),
            T.StructField("length", T.IntegerType()),
        ]
    )
)


def with_boundary_map(df: DataFrame, *, key: str = "doc_id", text: str = "text", form: str = "NFKC") -> DataFrame:
    """Per document the raw-to-normalised boundary map as runs, and the normalised length.

    Unicode normalisation is not a Spark function; this is the one place that needs Python on text.
    """
    if form not in ("NFC", "NFKC"):
        raise ValueError("form must be NFC or NFKC")
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("runs", RUN), T.StructField("normalized_length", T.IntegerType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps = [boundary_runs(t, form) for t in batch[text]]
            yield pd.DataFrame(
                {key: batch[key], "runs": maps,
                 "normalized_length": [m[-1]["norm"] + m[-1]["length"] - 1 for m in maps]}
            )

    return df.select(key, text).mapInPandas(run, schema)


def _last_boundary(runs: Column, offset: Column) -> Column:
    """Largest raw boundary whose normalised offset is at most ``offset``."""
    hit = F.element_at(F.filter(runs, lambda r: r["norm"] <= offset), -1)
    return hit["raw"] + F.least(offset - hit["norm"], hit["length"] - 1)


def raw_span(runs: Column, start: Column, end: Column, raw_length: Column) -> Column:
    """Raw interval of a normalised interval; null for an empty one, at least one character otherwise."""
    lo = _last_boundary(runs, start)
    hi = F.least(raw_length, _last_boundary(runs, end))
    end_at = F.when(hi <= lo, F.least(raw_length, lo + 1)).otherwise(hi)
    return F.when(end > start, F.struct(lo.cast("int").alias("char_start"), end_at.cast("int").alias("char_end")))


def raw_intervals(text: str, runs: list[dict], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw intervals of normalised ones of at least a character, found by binary search among the runs."""
    raw, norm, length = (np.array([r[k] for r in runs], np.int64) for k in ("raw", "norm", "length"))

    def last(offsets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(norm, offsets, side="right") - 1
        return raw[at] + np.minimum(offsets - norm[at], length[at] - 1)

    lo, hi = last(starts), np.minimum(last(ends), len(text))
    return lo, np.where(hi <= lo, np.minimum(lo + 1, len(text)), hi)


@lru_cache(maxsize=1)
def _word() -> re.Pattern:
    """Runs of characters that are no white space, as ``WORD`` has them."""
    blanks = {chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85)}
    blanks |= {chr(c) for c in range(0x10000) if unicodedata.category(chr(c))[0] == "Z"}
    return re.compile("[^" + "".join(map(re.escape, sorted(blanks))) + "]+")


def with_normalized_tokens(df: DataFrame, *, key: str = "doc_id", text: str = "text", form: str = "NFC") -> DataFrame:
    """Tokens of the normalised text with their place in it and in the raw text: a row per document.

    Columns: key, normalized_length, mapping_coverage (share of the tokens that have a raw interval; 0 without tokens)
    and tokens, an array of (norm_start, norm_end, char_start, char_end).
    """
    if form not in ("NFC", "NFKC"):
        raise ValueError("form must be NFC or NFKC")
    spans = T.StructType([T.StructField(n, T.IntegerType()) for n in ("norm_start", "norm_end", "char_start", "char_end")])
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("normalized_length", T.IntegerType()),
        T.StructField("mapping_coverage", T.DoubleType()), T.StructField("tokens", T.ArrayType(spans)),
    ])

    def mapped(raw: str) -> tuple[int, float, list[dict]]:
        normal = unicodedata.normalize(form, raw)
        found = np.array([m.span() for m in _word().finditer(normal)], np.int64).reshape(-1, 2)
        lo, hi = raw_intervals(raw, boundary_runs(raw, form), found[:, 0], found[:, 1])
        names = spans.fieldNames()
        rows = [dict(zip(names, map(int, r), strict=True)) for r in zip(found[:, 0], found[:, 1], lo, hi, strict=True)]
        return len(normal), float((hi > lo).mean()) if len(found) else 0.0, rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                sizes, shares, rows = zip(*[mapped(t or "") for t in part[text]], strict=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "normalized_length": sizes, "mapping_coverage": shares, "tokens": rows})

    return df.select(key, text).mapInPandas(run, schema)


def row_coverage(text: Column, valid: Callable[[Column], Column]) -> Column:
    """Share of the characters of a text under valid pieces, words and the white space between them, in its row.

    The same as ``coverage`` over ``covered_runs``, as pieces do not overlap; ``valid`` is asked for a piece's number.
    """
    pieces = F.regexp_extract_all(text, F.lit(WORD + "|" + WHITESPACE + "+"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: valid(i))
    covered = F.aggregate(kept, F.lit(0), lambda n, p: n + F.length(p))
    return F.when(F.length(text) > 0, covered / F.length(text)).otherwise(F.lit(0.0))


def sequence_features(
    df: DataFrame, *, key: str, order: Sequence[Column], bucket: Column, value: str
) -> DataFrame:
    """Step change (0 at the first element) and relative position in [0, 1] along each sequence.

    Long sequences are cut into ordered buckets whose last value is carried over, so one hot key does
    not become one task.
    """
    ran = with_running(
        df, [key], bucket, order, rank="_r", total="_t", lags={"_prev": F.col(value)}
    )
    step = F.when(F.col("_r") == 1, F.lit(0.0)).otherwise(F.abs(F.col(value) - F.col("_prev")))
    place = F.when(F.col("_t") > 1, (F.col("_r") - 1) / (F.col("_t") - 1)).otherwise(F.lit(0.0))
    return ran.withColumns({"step_change": step, "relative_position": place}).drop("_r", "_t", "_prev")


def direct_statistics(df: DataFrame, by: Sequence[str], *, nll: str, entropy: str, log_rank: str, perturbed: str) -> DataFrame:
    """Means of three per-token statistics and the curvature (perturbed mean minus plain mean)."""
    return df.groupBy(*by).agg(
        F.avg(nll).alias("mean_nll"), F.avg(entropy).alias("mean_entropy"), F.avg(log_rank).alias("mean_log_rank"),
        (F.avg(perturbed) - F.avg(nll)).alias("curvature"),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def token_chunks(df: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first, last): the token indices of each document with tokens, in stretches of ``width`` dealt to tasks.

    Documents that share a key are one, with the tokens of all. Only a key and a count a document are moved.
    """
    counts = token_arrays(df.select(key, text), text).groupBy(key).agg(F.sum(F.size("tokens")).alias("_n")).where("_n > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(width).cast("bigint"))
    cut = counts.select(key, "_n", F.explode(starts).alias("first"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.select(key, "first", (F.least(F.col("first") + width, "_n") - 1).alias("last")).repartition(parts, key, "first")


def ensemble_scores(scores: Column) -> Column:
    """Token score: the mean of the scores that overlapping windows and models give one token."""
    return let(scores, lambda v: _total(v) / F.size(v))


def window_heads(heads: Column) -> Column:
    """Of windows with the heads of their models: the largest mean of a window, the sum of all heads and their number."""
    return F.struct(
        F.array_max(F.transform(heads, lambda w: _total(w) / F.size(w))).alias("maximum"),
        _total(F.transform(heads, _total)).alias("total"),
        F.aggregate(heads, F.lit(0), lambda a, w: a + F.size(w)).alias("n"),
    )


def document_heads(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Heads of documents from the ``window_heads`` of their stretches and the sums of their token scores (``token_sum``).

    Mean over all (model, window) heads, and the largest window after averaging its models.
    """
    return parts.groupBy(key).agg(
        F.sum("token_sum").alias("token_total"), F.max("heads.maximum").alias("window_maximum"),
        (F.sum("heads.total") / F.sum("heads.n")).alias("overall_mean"),
    )


def score_qa(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Quality of scored documents in one row: finiteness, coverage, flags, length agreement."""
    bad = None
    for s in scores:
        this = F.col(s).isNull() | F.isnan(s) | (F.abs(F.col(s)) == float("inf"))
        bad = this if bad is None else bad | this
    flagged = F.coalesce(F.col("validity_override") == "uncertain", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(bad).alias("non_finite"),
        F.min("mapping_coverage").alias("coverage_minimum"),
        F.avg("mapping_coverage").alias("coverage_mean"),
        F.count_if(flagged).alias("uncertain"),
        F.count_if((F.col("mapping_coverage") < 0.98) != flagged).alias("flag_mismatches"),
        F.count_if(F.col("score_length") != F.col("text_length")).alias("length_mismatches"),
    )
