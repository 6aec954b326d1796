"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import distinct_running
from tracewell.session import matching, staged

MOST_LABELLED = 12_000  # labelled rows the model is fitted on, drawn by hash
PAIRS = 40_000
BIGRAMS = 256
FIXED = 22
WIDTH = FIXED + BIGRAMS


def _share(mask: np.ndarray) -> float:
    return float(mask.mean()) if len(mask) else 0.0


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: shares of character kinds, repetition of words and lines, hashed byte bigrams."""
    out = np.zeros(WIDTH, np.float32)
    text = text or ""
    raw = text.encode("utf-8", "replace")
    if not raw.strip():
        return out
    codes = np.frombuffer(raw, np.uint8)
    words = raw.split()
    lines = raw.split(b"\n")
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letter = ((codes | 32) >= 97) & ((codes | 32) <= 122)
    upper = (codes >= 65) & (codes <= 90)
    symbol = (codes > 32) & (codes < 127) & ~letter & ~((codes >= 48) & (codes <= 57))
    counts = np.unique(hashed, return_counts=True)[1]
    runs = _share(hashed[1:] == hashed[:-1])
    out[:FIXED] = (
        np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, sizes.mean() / 10,
        min(sizes.std(), 50.0) / 10, min(sizes.max(), 200) / 50, _share(letter), upper.sum() / max(letter.sum(), 1),
        _share(symbol), _share((codes >= 48) & (codes <= 57)), _share(codes >= 128), _share(codes == 32),
        _share(codes == 10) * 10, _share((codes == 46) | (codes == 44)) * 10, runs, len(counts) / len(words),
        float((counts.astype(float) ** 2).sum()) / len(words) ** 2, counts.max() / len(words),
        len(set(lines)) / len(lines), _share((symbol[1:] & (codes[1:] == codes[:-1])) if len(codes) > 1 else symbol) * 10,
        _share(sizes <= 2), 1.0 if runs > 0.2 else 0.0,
    )
    if len(codes) > 1:
        pairs = (codes[:-1].astype(np.uint32) * np.uint32(40503) + codes[1:].astype(np.uint32)) * np.uint32(2654435761)
        out[FIXED:] = np.sqrt(np.bincount(pairs >> np.uint32(24), minlength=BIGRAMS) / len(pairs)) * 3
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["doc_id", "vector"])


class Ranking:
    """Scores s(x) = w.x fitted so that log P(a preferred to b) = log sigmoid(s(a) - s(b)) is largest."""

    def __init__(self) -> None:
        self.weights = np.zeros(WIDTH)
        self.centre = np.zeros(WIDTH)
        self.scale = np.ones(WIDTH)
        self.threshold, self.slope = 0.0, 1.0

    def fit(self, x: np.ndarray, preferred: np.ndarray, seed: int = 7, steps: int = 300, decay: float = 1e-3) -> Ranking:
        good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
        if not len(good) or not len(bad):
            self.threshold = -1.0 if len(good) or not len(x) else 1.0
            return self
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.centre) / self.scale
        draw = np.random.default_rng(seed)
        gap = (z[draw.choice(good, PAIRS)] - z[draw.choice(bad, PAIRS)]).astype(np.float32)
        w = np.zeros(WIDTH, np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        batch = 2048
        for t in range(1, steps + 1):
            part = gap[draw.integers(0, PAIRS, batch)]
            doubt = 1 / (1 + np.exp(np.clip(part @ w, -30, 30)))
            slope = -(part * doubt[:, None]).mean(axis=0) + decay * w
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = w.astype(float)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.slope, -30, 30)))


def _scorer(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1024):
                part = batch.slice(at, 1024)
                x = np.array([features(t.as_py()) for t in part.column(1)]).reshape(-1, WIDTH)
                score = model.score(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())],
                    ["doc_id", "score", "predicted"],
                )

    return run


def _raw_scorer(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1024):
                part = batch.slice(at, 1024)
                x = np.array([features(t.as_py()) for t in part.column(1)]).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.raw(x), pa.float64())], ["doc_id", "raw"])

    return run


def _at_quantile(rows: DataFrame, size: int, part: int, whole: int) -> float:
    """Exact linear quantile of ``raw`` at part / whole of ``size`` rows: the ranks come from a distributed sort of the distinct values."""
    counted = distinct_running(rows, [], "raw", {"n": F.lit(1)})
    place = part * (size - 1)
    low, rest = divmod(place, whole)
    high = min(low + 1, size - 1)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    found = counted.select(
        "raw", ((first <= low) & (last >= low)).alias("lo"), ((first <= high) & (last >= high)).alias("hi")
    ).where("lo OR hi").collect()  # one or two rows
    a, b = (next(r["raw"] for r in found if r[end]) for end in ("lo", "hi"))
    return float(a + (b - a) * rest / whole)


def divide(model: Ranking, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Ranking:
    """Threshold and slope of a fitted model from the scores of all labelled rows: the share of label 1 among them fixes
    the quantile of their scores that divides the labels."""
    known = _learnable(labels, id_col, label_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = matching(source, staged(known.select("doc_id").distinct(), "quality-known"), "doc_id")
    raw = wanted.mapInArrow(_raw_scorer(model), "doc_id long, raw double").groupBy("doc_id").agg(F.min("raw").alias("raw"))
    rows = staged(raw.join(known, "doc_id").select("label", "raw"), "quality-raw")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return model
    model.threshold = _at_quantile(rows, sum(sizes.values()), sizes[0], sum(sizes.values()))
    low, high = (_at_quantile(rows.where(F.col("label") == label), sizes[label], 1, 2) for label in (0, 1))
    model.slope = 4 / max(high - low, 1e-6)
    return model


def _learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)"
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Ranking:
    """Ranking from at most 12,000 labelled rows, drawn by a hash of their id and label; divided by all of them."""
    known = _learnable(labels, id_col, label_col)
    drawn = staged(known.orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(MOST_LABELLED), "quality-drawn")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = matching(source, staged(drawn.select("doc_id").distinct(), "quality-ids"), "doc_id")
    vectors = wanted.mapInArrow(_featured, "doc_id long, vector binary").groupBy("doc_id").agg(F.min("vector").alias("vector"))
    rows = vectors.join(drawn, "doc_id").orderBy("doc_id", "label").toArrow()
    x = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float32).reshape(-1, WIDTH)
    preferred = rows["label"].to_numpy() == 1
    model = Ranking().fit(x, preferred)
    return divide(model, docs, labels, id_col, text_col, label_col) if preferred.any() and not preferred.all() else model


def scored(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Preference pairs take one row of each label; the score is cut at the quantile that splits all labelled rows with
    a text as their labels do; only the ranking is fitted on a sample. Only the text enters a score.

    Defined cases: null or blank texts have the zero vector and its score; labels other than 0 and 1, or
    without an id, are not learned from, and several labels of one id all count; without both labels every score is
    on the side of the only label (1 if there are none). Rows that share an id are learned from one of them (the
    cut takes their lowest score) and scored each. Other columns are ignored, whatever their names. Empty in, empty out.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scorer(model), "doc_id long, score double, predicted int")
