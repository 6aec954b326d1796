"""Text columns: attacks, whitespace, n-gram repetition, composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import col

# Fixed value: the whitespace that separates words, as a Java character class.
WHITESPACE = r"[\x1c-\x1f\p{IsWhite_Space}]"


def collapse_whitespace(text: Column | str) -> Column:
    single = F.regexp_replace(col(text), WHITESPACE + "+", " ")
    return F.trim(single)


def truncate_fraction(text: Column | str, fraction: float) -> Column:
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie in (0, 1)")
    keep = F.greatest(F.lit(1), F.floor(F.length(col(text)) * F.lit(float(fraction))).cast("int"))
    return F.substring(col(text), F.lit(1), keep)


def deterministic_attack(text: Column | str, attack: Column | str, fraction: float = 0.75) -> Column:
    """Text after a model-free attack; null for attacks that need a model."""
    return (
        F.when(col(attack) == "truncation", truncate_fraction(text, fraction))
        .when(col(attack) == "copy_edit", collapse_whitespace(text))
        .otherwise(F.lit(None).cast("string"))
    )


def visible_length(text: Column | str) -> Column:
    """Number of code points that are not whitespace."""
    return F.length(F.regexp_replace(col(text), WHITESPACE, ""))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit("[^" + WHITESPACE[1:-1] + "]+"))


def repetition_ratio(text: Column | str, n: int = 4) -> Column:
    """1 - distinct/total character n-grams; 0 for texts shorter than n.

    One linear regex pass yields every overlapping gram. The first guard keeps a match from starting
    inside a surrogate pair, so grams are counted in code points.
    """
    pattern = r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))" % n
    grams = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1))
    return F.when(
        F.length(col(text)) >= n, 1.0 - F.size(F.array_distinct(grams)) / (F.length(col(text)) - (n - 1))
    ).otherwise(F.lit(0.0))


def compose_adjacent(texts: Column, separator: str) -> Column:
    """Struct of the joined text and each component's exact code-point interval."""
    gap = len(separator)
    spans = F.aggregate(
        texts,
        F.array().cast("array<struct<char_start:int,char_end:int>>"),
        lambda acc, t: F.concat(
            acc,
            F.array(
                F.struct(
                    _next_start(acc, gap).alias("char_start"),
                    (_next_start(acc, gap) + F.length(t)).alias("char_end"),
                )
            ),
        ),
    )
    return F.struct(F.array_join(texts, separator).alias("text"), spans.alias("intervals"))


def _next_start(acc: Column, gap: int) -> Column:
    return F.coalesce(F.try_element_at(acc, F.lit(-1)).getField("char_end") + gap, F.lit(0))
