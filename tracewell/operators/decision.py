"""Validity diagnosis and the ordered label rules for segments and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACCEPTED_LABELS, LABELS, MINIMUM_COVERAGE


def validity_reasons(
    *,
    effective_length: Column,
    coverage: Column,
    language: Column,
    repetition: Column,
    minimum_length: int = 64,
    minimum_coverage: float = MINIMUM_COVERAGE,
    maximum_repetition: float = 0.35,
    languages: Sequence[str] = ("en", "zh"),
    domain_shift: Column | None = None,
) -> Column:
    """Ordered reason codes; an empty array means the evidence is valid."""
    rules = [
        F.when(effective_length < minimum_length, "insufficient_effective_length"),
        F.when(coverage < minimum_coverage, "mapping_coverage_low"),
        F.when(~F.coalesce(language.isin(*languages), F.lit(False)), "unsupported_language"),
        F.when(repetition > maximum_repetition, "excessive_repetition"),
    ]
    if domain_shift is not None:
        rules.append(F.when(domain_shift > 1.0, "calibration_domain_shift"))
    return F.array_compact(F.array(*rules))


def validity_status(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, "fail").otherwise("pass")


def coverage_override(coverage: Column, minimum: float = MINIMUM_COVERAGE) -> Column:
    return F.when(coverage < minimum, "uncertain")


def decide_segments(df: DataFrame, *, alpha: float) -> DataFrame:
    """Label each segment row by the ordered rules.

    Needs ``items`` (array of family, key_status, adjusted_p, applicability), ``generic_p``, ``gap_p`` and
    ``validity_reasons``. An item counts when it is not invalid and has a p-value. Adds ``label``,
    ``abstain_reasons`` and ``best_registered_p``. A null ``generic_p`` with a known document is a missing
    null pool and never reads as clean.

    Items may have ``significant`` (p at most ``alpha``, null without a p) in place of ``adjusted_p``; their smallest p is
    then that of the strongest item, the column ``registered_p``.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie in (0, 1)")
    flagged = "significant" in df.schema["items"].dataType.elementType.names
    told = "significant" if flagged else "adjusted_p"
    usable = F.filter(
        "items", lambda i: (F.coalesce(i["applicability"], F.lit("valid")) != "invalid") & i[told].isNotNull()
    )
    staged = df.withColumn("_usable", usable).withColumn(
        "_hits", F.filter("_usable", lambda i: i["significant"] if flagged else i["adjusted_p"] <= alpha)
    )
    if flagged:
        best = F.when(F.size("_usable") > 0, F.col("registered_p"))
    else:
        best = F.array_min(F.transform("_usable", lambda i: i["adjusted_p"]))
    hits = F.col("_hits")
    key_hit = F.exists(hits, lambda i: i["key_status"] == "registered")
    scheme_hit = F.exists(hits, lambda i: i["key_status"] == "scheme_only")
    families = F.size(F.array_distinct(F.transform(hits, lambda i: i["family"])))
    generic = F.coalesce(F.col("generic_p") <= alpha, F.lit(False))
    gap = F.coalesce(F.col("gap_p") <= alpha, F.lit(False))
    significant = F.size(hits) > 0
    invalid = F.size("validity_reasons") > 0
    conflict = families > 1
    left_over = generic | significant
    missing = F.coalesce(F.col("missing_pool"), F.lit(False)) if "missing_pool" in df.columns else F.lit(False)
    label = (
        F.when(invalid | missing | conflict, "uncertain")
        .when(key_hit, "known_scheme_known_key")
        .when(scheme_hit & generic & gap, "known_scheme_unknown_key")
        .when(generic & ~significant, "suspected_unknown_scheme")
        .when(left_over, "uncertain")
        .otherwise("none")
    )
    settled = key_hit | (scheme_hit & generic & gap) | (generic & ~significant) | ~left_over
    reason = (
        F.when(generic & ~gap, "generic_significant_gap_not_significant")
        .when(gap & ~generic, "gap_significant_generic_not_significant")
        .when(scheme_hit, "no_key_independent_scheme_test")
        .otherwise("borderline_threshold")
    )
    none = F.array().cast("array<string>")
    reasons = (
        F.when(invalid, F.array_distinct("validity_reasons"))
        .when(missing, F.array(F.lit("missing_null_stratum")))
        .when(conflict, F.array(F.lit("registered_evidence_conflict")))
        .when(settled, none)
        .otherwise(F.array(reason))
    )
    return staged.withColumns(
        {
            "label": label,
            "abstain_reasons": reasons,
            "best_registered_p": best,
        }
    ).drop("_usable", "_hits")


def decide_documents(documents: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label each document from its segments; documents without segments stay.

    ``documents`` carries ``validity_reasons`` and ``generic_p``. Any failed validity or uncertain segment
    makes the document uncertain, otherwise the strongest label wins, else none.
    """
    labels = list(LABELS)
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    per_doc = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_segments"),
        F.max(F.col("label") == "uncertain").alias("_uncertain"),
        F.min(F.when(F.col("label") != "uncertain", rank)).alias("_best"),
        # Labels in span order without repeats; one document's own spans, so the list is bounded by it.
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("char_start", "label"))), lambda s: s["label"])
        ).alias("_labels"),
        F.min("registered_p").alias("registered_p"),
        F.min("gap_p").alias("gap_p"),
        F.sum(F.size("items")).alias("_tests"),
        # Accepted spans of one document, bounded by its own candidate list.
        F.array_sort(
            F.collect_list(F.when(F.col("label").isin(*ACCEPTED_LABELS), F.struct("char_start", "char_end")))
        ).alias("_spans"),
    )
    joined = documents.join(per_doc, list(keys), "left")
    missing = F.coalesce(F.col("missing_pool"), F.lit(False)) if "missing_pool" in documents.columns else F.lit(False)
    uncertain = (F.size("validity_reasons") > 0) | missing | F.coalesce("_uncertain", F.lit(False))
    best = F.element_at(F.array(*[F.lit(x) for x in labels]), F.coalesce("_best", F.lit(5)).cast("int"))
    label = F.when(uncertain, "uncertain").otherwise(best)
    return joined.withColumns(
        {
            "document_label": label,
            "any_accept": label.isin(*ACCEPTED_LABELS),
            "label_set": F.coalesce("_labels", F.array().cast("array<string>")),
            "candidate_count": F.coalesce("_segments", F.lit(0)).cast("bigint"),
            "registered_test_count": F.coalesce("_tests", F.lit(0)).cast("bigint"),
            "predicted_intervals": F.coalesce(
                "_spans", F.array().cast("array<struct<char_start:int,char_end:int>>")
            ),
        }
    ).drop("_segments", "_uncertain", "_best", "_labels", "_tests", "_spans")
