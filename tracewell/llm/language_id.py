"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 1 << 14
ORDERS = 3
MOST_LANGUAGES = 500  # bounds the model that travels to the tasks: 500 x 16384 x 4 bytes
UNDETERMINED = "und"

_STEP = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def ngrams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams of a text in lower case, with other characters as single blanks.

    Empty if the text has no letter.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    word = letters[np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():
        distinct = np.unique(codes[beyond])
        word[beyond] = np.isin(codes[beyond], distinct[[chr(c).isalpha() for c in distinct]])
    if not word.any():
        return np.empty(0, np.uint32)
    codes = np.where(word, codes, np.uint32(32))
    keep = word.copy()
    keep[1:] |= word[:-1]
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    out = []
    total = np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        total = (total[: len(codes) - n] * np.uint32(31)) + codes[n:] * _STEP[n]
        out.append((total * np.uint32(0x9E3779B1)) >> np.uint32(18))
        total = total[:-1]
        if not len(total):
            break
    return np.concatenate(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = _letters()
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        for lang, sums in counts.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.r_[-1, at], pa.int32()),
                 pa.array(np.r_[docs[lang], sums[at]], pa.int64())], ["lang", "bucket", "n"],
            )

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = ngrams(text.as_py(), letters)
            if lang not in counts:
                if len(counts) >= MOST_LANGUAGES:
                    yield from drain()
                    counts.clear(), docs.clear()
                counts[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
            docs[lang] += 1
            counts[lang] += np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS // 8 else 0
            if len(found) <= BUCKETS // 8:
                np.add.at(counts[lang], found, 1)
    yield from drain()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, matrix), as in ``fit_typical``."""
    return fit_typical(docs, text_col, lang_col)[:2]


def fit_typical(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, matrix, typical): row b < BUCKETS has the log probability of bucket b by language, the last the priors.

    ``typical`` has the mean and the standard deviation, by language, of the log probability of an n-gram over all
    n-grams of all learned rows; the counts hold them, so no row is read again.

    Counts cover every row with a language; tasks sum their own rows first. The driver sees the summed counts
    only: at most 500 languages x 16,384 buckets; more languages are an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = rows.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(
        _count, "lang string, bucket int, n long"
    ).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    head = [r["lang"] for r in sums.where("bucket = -1").select("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(head) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(head)
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((BUCKETS + 1, len(languages)))
    table = sums.toArrow()
    column = np.array([at[x] for x in table["lang"].to_pylist()], np.int64)
    counts[table["bucket"].to_numpy(), column] = table["n"].to_numpy()  # bucket -1 is the last row
    typical = np.zeros((2, len(languages)))
    if languages:
        shares = counts[:BUCKETS] / np.maximum(counts[:BUCKETS].sum(axis=0), 1)
        grams = counts[:BUCKETS] + 0.1
        counts[:BUCKETS] = np.log(grams / grams.sum(axis=0))
        typical[0] = (shares * counts[:BUCKETS]).sum(axis=0)
        typical[1] = np.sqrt((shares * (counts[:BUCKETS] - typical[0]) ** 2).sum(axis=0))
        counts[BUCKETS] = np.log(counts[BUCKETS] / counts[BUCKETS].sum())
    return languages, counts.astype(np.float32), typical


def _scorer(languages: list[str], matrix: np.ndarray, typical: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            for first in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(first, 256)
                names, scores, below, sizes = [], [], [], []
                for text in part.column(part.num_columns - 1):
                    found = ngrams(text.as_py(), letters)
                    if not len(found) or not languages:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        below.append(None)
                        sizes.append(len(found))
                        continue
                    sums = np.zeros(len(languages))
                    for at in range(0, len(found), 65536):
                        sums += matrix[found[at : at + 65536]].sum(axis=0, dtype=np.float64)
                    grams = sums / len(found)
                    sums = sums + matrix[BUCKETS]
                    best = int(sums.argmax())
                    if typical is not None:
                        below.append(float((typical[0, best] - grams[best]) / max(typical[1, best], 1e-6)))
                        sizes.append(len(found))
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(sums - sums[best]).sum()))
                more = [] if typical is None else [pa.array(below, pa.float64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), *more],
                    [*part.schema.names[:-1], "lang_pred", "score", *["below", "n_grams"][: len(more)]],
                )

    return run


def with_language(docs: DataFrame, learn_from: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score, which are defined as in ``identified``, below and n_grams.

    ``below`` is how far the mean log probability of the text's n-grams lies below that of all learned n-grams of the
    language, in standard deviations of the latter; null without a language. It does not depend on length, but its
    spread does, by n_grams.
    """
    source = docs.select("*", F.col(text_col).cast("string").alias("_text"))
    added = StructType().add("lang_pred", "string").add("score", "double").add("below", "double").add("n_grams", "long")
    return source.mapInArrow(_scorer(*fit_typical(learn_from, text_col, lang_col)), StructType([*docs.schema.fields, *added.fields]))


def identified(
    docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (posterior of that language).

    The model comes from the rows of ``learn_from`` (all of them, no sample); whole texts are scored.

    Defined cases: a null text or one without a letter is ``und`` with score 0, so is every text if there is
    nothing to learn from; equal posteriors go to the language that sorts first. Repeated rows give repeated results,
    null ids are carried along. Other columns are ignored, whatever their names. Empty in, empty out.
    """
    model = fit(learn_from, text_col, lang_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scorer(*model), "doc_id long, lang_pred string, score double")
