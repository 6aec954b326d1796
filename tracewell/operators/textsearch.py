"""Span search and text measures over the code points of one text, for Arrow batches.

The same results as the column forms (``spans.with_candidates`` on integer scores, ``functions.text``, ``charmap.row_coverage``),
which tests hold; sums are whole numbers, so no order of additions shows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from ..schemas import CANDIDATE_QUANTILE, MERGE_GAP, STRIDE_FRACTION, WINDOW_LENGTHS
from .spans import stride_of

# The characters of functions.text.WHITESPACE as a table; its last entry stands for every code point beyond.
_SPACE = np.zeros(0x3002, dtype=bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def is_space(codes: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(codes, len(_SPACE) - 1)]


def count_words(space: np.ndarray) -> int:
    return 0 if not len(space) else int(not space[0]) + int(np.count_nonzero(space[:-1] & ~space[1:]))


def repetition(codes: np.ndarray) -> float:
    """1 - distinct/total runs of four code points; 0 for texts shorter than four."""
    total = len(codes) - 3
    if total < 1:
        return 0.0
    wide = codes.astype(np.uint64)
    pairs = (wide[:-1] << np.uint64(32)) | wide[1:]
    if wide.max() < 1 << 16:
        grams = (pairs[:-2] << np.uint64(16)) | pairs[2:]
    else:  # pairs by number, so that two of them fit a word
        number = pd.factorize(pairs)[0].astype(np.uint64)
        grams = (number[:-2] << np.uint64(32)) | number[2:]
    grams.sort()
    return 1.0 - (1 + int(np.count_nonzero(grams[1:] != grams[:-1]))) / total


def piece_coverage(space: np.ndarray, valid: Callable[[np.ndarray], np.ndarray]) -> float:
    """Share of the characters under valid pieces, words and the white space between them; ``valid`` gets their numbers."""
    if not len(space):
        return 0.0
    edges = np.concatenate(([0], np.flatnonzero(space[1:] != space[:-1]) + 1, [len(space)]))
    sizes = np.diff(edges)
    return int(sizes[valid(np.arange(len(sizes)))].sum()) / len(space)


def high_windows(
    scores: np.ndarray, *, window_lengths: Sequence[int] = WINDOW_LENGTHS, stride_fraction: float = STRIDE_FRACTION,
    quantile: float = CANDIDATE_QUANTILE,
) -> list[tuple[int, int, int, float]]:
    """(start, end, scale, mean) of the windows that reach their scale's 'higher' quantile, by start and end."""
    before = np.concatenate(([0], np.cumsum(scores, dtype=np.int64)))
    n, found = len(scores), []
    for length in sorted({int(v) for v in window_lengths if 1 <= int(v) <= n}):
        stride = stride_of(length, stride_fraction)
        totals = before[length::stride] - before[: n - length + 1 : stride]
        if (n - length) % stride:
            totals = np.append(totals, before[n] - before[n - length])
        place = math.ceil((len(totals) - 1) * quantile)
        high = np.flatnonzero(totals >= np.partition(totals, place)[place])
        starts = np.minimum(high * stride, n - length)
        found += [(s, s + length, length, t / length) for s, t in zip(starts.tolist(), totals[high].tolist(), strict=True)]
    return sorted(found)


def merged(windows: Sequence[tuple[int, int, int, float]], gap: int = MERGE_GAP) -> list[list]:
    """[start, end, scale, mean] of windows at most ``gap`` apart, with the scale and mean of the best one."""
    out, lead = [], 0
    for start, end, scale, mean in windows:
        if not out or start > out[-1][1] + gap:
            out.append([start, end, scale, mean])
            lead = start
            continue
        last = out[-1]
        last[1] = max(last[1], end)
        if mean > last[3] or (mean == last[3] and (scale < last[2] or (scale == last[2] and start < lead))):
            last[2:] = scale, mean
            lead = start
    return out


def refined(scores: np.ndarray, start: int, end: int, quantile: float = 0.5) -> tuple[int, int, float]:
    """First-to-last position at or above the local linear quantile, and the mean of those scores."""
    local = scores[start:end]
    place = (len(local) - 1) * quantile
    low, up = math.floor(place), math.ceil(place)
    kept = np.partition(local, (low, up))
    a, b = int(kept[low]), int(kept[up])
    high = local >= (a if a == b else a + (b - a) * (place - low))
    at = np.flatnonzero(high)
    return start + int(at[0]), start + int(at[-1]) + 1, int(local[high].sum()) / len(at)


def candidates(scores: np.ndarray, *, unit: float, gap: int = MERGE_GAP, refine_quantile: float = 0.5, **windows) -> list[dict]:
    """Merged and refined spans of one text's integer scores."""
    out = []
    for i, (start, end, scale, mean) in enumerate(merged(high_windows(scores, **windows), gap)):
        name = f"generic-merged-{i}"
        if end - start >= 2:
            name += "-refined"
            start, end, mean = refined(scores, start, end, refine_quantile)
        out.append({
            "candidate_id": name, "char_start": start, "char_end": end, "scale_id": f"char-{scale}", "raw_score": mean / unit,
        })
    return out
