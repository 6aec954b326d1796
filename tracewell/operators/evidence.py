"""Detector evidence: search-space expansion, applicability, masking, and evidence per candidate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FAMILIES, KEY_SLOTS, MINIMUM_DETECTOR_TOKENS


def key_hash(family: Column, slot: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(family, F.lit("_key_"), slot), 256))


def search_intervals(
    df: DataFrame, *, length: Column | None = None, tokens: Column | None = None
) -> DataFrame:
    """Candidates of each document plus its full text, unless a candidate already spans it.

    With ``tokens`` (the document's token count) candidates must carry their own ``tokens`` too; both
    become ``detector_token_count``.
    """
    n = F.length("text") if length is None else length

    def interval(name: Column, start: Column, end: Column, role: str, count: Column | None) -> Column:
        parts = [
            name.alias("candidate_id"), start.alias("char_start"), end.cast("int").alias("char_end"),
            F.lit(role).alias("interval_role"),
        ]
        if tokens is not None:
            parts.append(count.cast("int").alias("detector_token_count"))
        return F.struct(*parts)

    short = F.transform(
        "candidates",
        lambda c: interval(
            c["candidate_id"], c["char_start"], c["char_end"], "candidate",
            c["tokens"] if tokens is not None else None,
        ),
    )
    full = interval(F.lit("full-text"), F.lit(0), n, "full_text", tokens)
    covered = F.exists("candidates", lambda c: (c["char_start"] == 0) & (c["char_end"] == n))
    intervals = F.when(covered, short).otherwise(F.concat(short, F.array(full)))
    keep = [c for c in df.columns if c not in ("candidates", "text")]
    return df.select(*keep, F.inline(intervals))


def expand_tests(
    intervals: DataFrame,
    *,
    families: Sequence[str] = FAMILIES,
    slots: Sequence[str] = KEY_SLOTS,
    scheme_only: bool = False,
) -> DataFrame:
    """One row per interval, family and key slot, plus a key-free probe per family on request.

    The test grid is a fixed literal array, so this is a narrow explode rather than a join.
    """
    if not families or not set(families) <= set(FAMILIES) or not slots or not set(slots) <= set(KEY_SLOTS):
        raise ValueError("families and slots must be non-empty subsets of the registered ones")
    cell = lambda f, s, k: F.struct(
        F.lit(f).alias("scheme_family"), F.lit(s).cast("string").alias("key_slot"), F.lit(k).alias("key_status")
    )
    grid = [cell(f, s, "registered") for f in families for s in slots]
    if scheme_only:
        grid += [cell(f, None, "scheme_only") for f in families]
    out = intervals.select("*", F.inline(F.array(*grid)))
    return out.withColumn(
        "key_id_hash",
        F.when(F.col("key_status") == "registered", key_hash(F.col("scheme_family"), F.col("key_slot"))),
    )


def minimum_tokens(family: Column) -> Column:
    need = None
    for name, count in MINIMUM_DETECTOR_TOKENS.items():
        hit = family == name
        need = F.when(hit, count) if need is None else need.when(hit, count)
    unknown = F.raise_error(F.concat(F.lit("unsupported family: "), family)).cast("int")
    return need.otherwise(unknown)


def gated(family: Column, status: Column, tokens: Column) -> dict[str, Column]:
    """Applicability and reasons of a test; reasons read the columns ``interval_role`` and ``candidate_id``."""
    short = (status == "registered") & (tokens < minimum_tokens(family))
    reason = F.when(short, F.when(tokens == 0, "zero_detector_tokens").otherwise("insufficient_detector_tokens"))
    return {
        "applicability": F.when(short, "invalid").otherwise("valid"),
        "reason_codes": F.array_compact(
            F.array(F.col("interval_role"), F.concat(F.lit("candidate_id:"), F.col("candidate_id")), reason)
        ),
    }


def gate_tokens(tests: DataFrame, *, tokens: str = "detector_token_count") -> DataFrame:
    """Mark keyed tests on intervals too short for their family; nothing is dropped."""
    return tests.withColumns(gated(F.col("scheme_family"), F.col("key_status"), F.col(tokens)))


def oriented(family: Column, raw: Column) -> dict[str, Column]:
    """Tail, strength and transform of a raw statistic that must be finite."""
    lower = family == "unbiased"
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    value = (
        F.when(bad, F.raise_error(F.lit("detector statistic must be finite")).cast("double"))
        .when(~family.isin(*FAMILIES), F.raise_error(F.lit("unsupported family")).cast("double"))
        .otherwise(F.when(lower, -raw).otherwise(raw))
    )
    return {
        "tail_direction": F.when(lower, "lower").otherwise("upper"),
        "evidence_strength": value,
        "evidence_transform_version": F.when(lower, "negate-lower-tail-statistic-v1").otherwise("identity-upper-tail-v1"),
    }


def orient(df: DataFrame, *, family: str = "scheme_family", raw: str = "raw_statistic") -> DataFrame:
    """Evidence strength that grows with support: the lower-tailed family is negated."""
    return df.withColumns(oriented(F.col(family), F.col(raw)))


def interval_tests(
    intervals: DataFrame, keyed: Callable[[Column, Column], Column], probe: Callable[[Column], Column],
    *, tokens: str = "detector_token_count",
) -> DataFrame:
    """Intervals with ``tests``: what ``expand_tests`` with probes, ``gate_tokens`` and ``orient`` say, one array a row.

    ``keyed`` gives the raw statistic of a family and slot, ``probe`` that of a key-free probe, which is upper-tailed for
    every family. The tests of an interval move as one row; ``inline`` makes them rows of their own.
    """
    grid = [(f, s) for f in FAMILIES for s in KEY_SLOTS] + [(f, None) for f in FAMILIES]
    # Columns of their own, so that each statistic is worked out once.
    raws = {f"_raw{i}": keyed(F.lit(f), F.lit(s)) if s else probe(F.lit(f)) for i, (f, s) in enumerate(grid)}

    def cell(i: int, name: str, slot: str | None) -> Column:
        family, status, raw = F.lit(name), F.lit("registered" if slot else "scheme_only"), F.col(f"_raw{i}")
        sides = oriented(family, raw)
        if not slot:  # checked like the others, then taken as it is
            sides["tail_direction"] = F.lit("upper")
            sides["evidence_strength"] = F.when(sides["evidence_strength"].isNotNull(), raw)
        return F.struct(
            family.alias("scheme_family"), F.lit(slot).cast("string").alias("key_slot"), status.alias("key_status"),
            (key_hash(family, F.lit(slot)) if slot else F.lit(None).cast("string")).alias("key_id_hash"),
            *[c.alias(n) for n, c in gated(family, status, F.col(tokens)).items()], raw.alias("raw_statistic"),
            *[sides[n].alias(n) for n in ("tail_direction", "evidence_strength")],
        )

    tests = F.array(*[cell(i, *at) for i, at in enumerate(grid)])
    return intervals.withColumns(raws).select(*intervals.columns, tests.alias("tests"))


def strength() -> Column:
    """Strength of an evidence row; the raw statistic where no transform was recorded."""
    return F.coalesce(F.col("evidence_strength"), F.col("raw_statistic"))


@dataclass(frozen=True)
class Scenario:
    """An authorisation scenario: usable key slots, a family left out, the null pool it is judged by."""

    name: str
    slots: tuple[str, ...]
    held_out: str | None = None
    pool: str = "primary"


SCENARIOS = (
    Scenario("a_and_b", ("a", "b")),
    Scenario("a_only", ("a",)),
    Scenario("b_only", ("b",)),
    *[Scenario(f"lofo_{f}", ("a", "b"), f, f"lofo_{f}") for f in FAMILIES],
)
POOLS = (
    Scenario("primary", ("a", "b")),
    *[Scenario(f"lofo_{f}", ("a", "b"), f, f"lofo_{f}") for f in FAMILIES],
)


def scenario_array(scenarios: Sequence[Scenario]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.pool).alias("pool"),
                F.array(*[F.lit(x) for x in s.slots]).alias("slots"),
                F.lit(s.held_out).cast("string").alias("held_out_family"),
            )
            for s in scenarios
        ]
    )


def mask_array(scenarios: Sequence[Scenario]) -> Column:
    """Scenarios with the key hashes they authorise, ``_allowed``."""
    return F.array(*[
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.lit(s.pool).alias("pool"),
            F.lit(s.held_out).cast("string").alias("held_out_family"),
            F.array(
                *[
                    key_hash(F.lit(f), F.lit(k))
                    for f in FAMILIES
                    if f != s.held_out
                    for k in s.slots
                ]
            ).alias("_allowed"),
        )
        for s in scenarios
    ])


def _visible(status: Column, key: Column, family: Column) -> Column:
    authorised = (status == "scheme_only") | F.array_contains("_allowed", key)
    return authorised & ~family.eqNullSafe(F.col("held_out_family"))


def mask_evidence(evidence: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Evidence visible under each scenario: key-free rows, and keyed rows whose hash is authorised."""
    seen = evidence.select("*", F.inline(mask_array(scenarios)))
    visible = _visible(F.col("key_status"), F.col("key_id_hash"), F.col("scheme_family"))
    return seen.where(visible).drop("_allowed", "held_out_family")


def mask_tests(rows: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """``mask_evidence`` for rows with an array of ``tests``: every row under each scenario, with the tests visible there."""
    seen = F.filter("tests", lambda t: _visible(t["key_status"], t["key_id_hash"], t["scheme_family"]))
    return rows.select("*", F.inline(mask_array(scenarios))).withColumn("tests", seen).drop("_allowed")


def masked_counts(masked: DataFrame) -> DataFrame:
    return masked.groupBy("scenario", "document_id").agg(F.count(F.lit(1)).alias("tests"))


def merge_without_families(generic: DataFrame, evidence: DataFrame, families: Sequence[str]) -> DataFrame:
    """Generic scores with another run's evidence minus each family in turn; a document without evidence fails.

    Evidence is grouped by document and family once: what is left without a family is the sum or the largest of the
    others, a few rows a document.
    """
    by_family = evidence.groupBy("document_id", "scheme_family").agg(
        F.count(F.lit(1)).alias("_n"), F.max(strength()).alias("_best")
    )
    groups = by_family.groupBy("document_id").agg(F.collect_list(F.struct("scheme_family", "_n", "_best")).alias("_all"))

    def without(family: str) -> Column:
        rest = F.filter("_all", lambda x: ~x["scheme_family"].eqNullSafe(F.lit(family)))
        return F.struct(
            F.lit(family).alias("left_out"), F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + x["_n"]).alias("tests"),
            F.array_max(F.transform(rest, lambda x: x["_best"])).alias("best_strength"),
        )

    joined = generic.join(groups, "document_id", "left")
    missing = F.raise_error(F.concat(F.lit("no evidence for "), F.col("document_id")))
    found = F.when(F.col("_all").isNull(), missing.cast("array<struct<left_out:string,tests:bigint,best_strength:double>>")).otherwise(
        F.array(*[without(f) for f in families])
    )
    return joined.select(*generic.columns, F.inline(found))


def request_violations(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """First reason a detector request is refused, joined against the detector registry."""
    joined = requests.join(registry, "detector_id", "left")
    prefix = F.concat(F.col("scheme_family"), F.lit("_key_"))
    reason = (
        F.when(F.col("scheme_family").isNull(), "unknown_detector")
        .when(~F.array_contains("supported_languages", F.col("language")), "unsupported_language")
        .when(F.col("effective_length") < F.col("minimum_effective_length"), "insufficient_effective_length")
        .when(F.col("requires_key") & F.col("key_id").isNull(), "registered_detector_requires_authorized_key")
        .when(~F.col("requires_key") & F.col("key_id").isNotNull(), "scheme_only_must_not_receive_key")
        .when(F.col("requires_key") & ~F.startswith("key_id", prefix), "key_family_mismatch")
        .when(
            ~F.col("requires_key") & ~F.col("calibration_id").eqNullSafe(F.col("expected_calibration_id")),
            "calibration_bundle_mismatch",
        )
    )
    return joined.withColumn("reason", reason)


def evidence_for_candidates(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that applies to each candidate: same interval, or gathered on the full text.

    Two equi-joins instead of one join with an OR, so both run as hash or sort-merge joins.
    """
    exact = segments.join(
        evidence.where(F.col("interval_role") != "full_text").drop("candidate_id", "interval_role"),
        ["document_id", "char_start", "char_end"],
    )
    full = segments.join(
        evidence.where(F.col("interval_role") == "full_text").drop(
            "candidate_id", "interval_role", "char_start", "char_end"
        ),
        "document_id",
    )
    return exact.unionByName(full)


def tests_by_document(places: DataFrame, intervals: DataFrame) -> DataFrame:
    """``evidence_for_candidates`` for intervals with an array of ``tests``: a row per document, ``found`` for its candidates.

    ``places`` has ``document_id`` and the array ``candidates``. An interval moves once, to its document, whatever the number
    of candidates its tests apply to; these are picked from the document's own arrays. Rows that share an id are taken
    together, as joins would. Only candidates that meet an interval are in ``found``.
    """
    own = intervals.groupBy("document_id").agg(
        F.collect_list(F.struct("char_start", "char_end", "interval_role", "tests")).alias("_intervals")
    )
    slim = F.transform("candidates", lambda c: F.struct(*[c[n].alias(n) for n in ("candidate_id", "char_start", "char_end")]))
    held = places.groupBy("document_id").agg(F.flatten(F.collect_list(slim)).alias("_places"))

    def applies(i: Column, p: Column) -> Column:
        exact = (i["char_start"] == p["char_start"]) & (i["char_end"] == p["char_end"])
        return (i["interval_role"] == "full_text") | ((i["interval_role"] != "full_text") & exact)

    def met(name: Column) -> Column:
        same = F.filter("_places", lambda p: p["candidate_id"] == name)
        return F.flatten(F.transform(same, lambda p: F.filter("_intervals", lambda i: applies(i, p))))

    names = F.array_distinct(F.transform("_places", lambda p: p["candidate_id"]))
    each = F.transform(names, lambda n: F.struct(n.alias("candidate_id"), F.transform(met(n), lambda i: i["tests"]).alias("_t")))
    any_met = F.filter(each, lambda f: F.size(f["_t"]) > 0)
    found = F.transform(any_met, lambda f: F.struct(
        f["candidate_id"].alias("candidate_id"), F.flatten(f["_t"]).alias("tests")
    ))
    return held.join(own, "document_id").select("document_id", found.alias("found"))


def rank_evidence(items: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Evidence of a segment ranked by adjusted p (null as 1), ties in input order."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.coalesce("adjusted_p", F.lit(1.0)), F.col("input_index"))
    return items.withColumn("evidence_rank", F.row_number().over(order))


def rank_tests(rows: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """``rank_evidence`` for rows with an array of ``tests``: the tests of a segment move and are sorted as one array."""
    whole = rows.groupBy(*by).agg(F.flatten(F.collect_list("tests")).alias("_all"))
    ordered = F.array_sort(F.transform("_all", lambda t: F.struct(
        F.coalesce(t["adjusted_p"], F.lit(1.0)).alias("_p"), t["input_index"].alias("_at"), t.alias("_test")
    )))
    ranked = whole.select(*by, F.posexplode(ordered).alias("_i", "_o"))
    return ranked.select(*by, "_o._test.*", (F.col("_i") + 1).alias("evidence_rank"))


EVIDENCE_OUT = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("detector_id", T.StringType()),
        T.StructField("scheme_family", T.StringType()),
        T.StructField("key_status", T.StringType()),
        T.StructField("key_id_hash", T.StringType()),
        T.StructField("raw_statistic", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Detector:
    """A user-supplied detector: what it declares, and a function from a batch to raw statistics."""

    detector_id: str
    scheme_family: str
    score: Callable[[pd.DataFrame], pd.Series]
    requires_key: bool = True
    supported_languages: tuple[str, ...] = ("en", "zh")
    minimum_effective_length: int = 64
    tail_direction: str = "upper"
    calibration_id: str | None = None


class DetectorRegistry:
    """Named detectors. Requests are checked on the JVM side before any Python function runs."""

    def __init__(self) -> None:
        self._detectors: dict[str, Detector] = {}

    def register(self, detector: Detector) -> None:
        if detector.detector_id in self._detectors:
            raise ValueError(f"detector already registered: {detector.detector_id}")
        if not detector.requires_key and not detector.calibration_id:
            raise ValueError("a scheme-only detector needs a frozen calibration id")
        self._detectors[detector.detector_id] = detector

    def table(self, spark) -> DataFrame:
        rows = [
            (d.detector_id, d.scheme_family, d.requires_key, list(d.supported_languages),
             d.minimum_effective_length, d.calibration_id)
            for d in self._detectors.values()
        ]
        schema = (
            "detector_id string, scheme_family string, requires_key boolean, supported_languages array<string>, "
            "minimum_effective_length int, expected_calibration_id string"
        )
        return spark.createDataFrame(rows, schema)

    def run(self, requests: DataFrame) -> DataFrame:
        """Score accepted requests in Arrow batches; key columns never reach a scheme-only detector."""
        # The detectors are listed in this process: a row each goes to the requests, whose texts are not dealt by detector.
        checked = request_violations(requests, F.broadcast(self.table(requests.sparkSession)))
        accepted = checked.where(F.col("reason").isNull())
        keyed = [d for d in self._detectors.values() if d.requires_key]
        free = [d for d in self._detectors.values() if not d.requires_key]
        carried = ["document_id", "candidate_id", "char_start", "char_end", "detector_id", "scheme_family",
                   "language", "segment_text"]
        parts = []
        if keyed:
            batch = accepted.where(F.col("requires_key")).select(
                *carried, "key_id", F.concat(F.lit("sha256:"), F.sha2("key_id", 256)).alias("key_id_hash"),
                F.lit("registered").alias("key_status"),
            )
            parts.append(batch.mapInPandas(_runner({d.detector_id: d.score for d in keyed}), EVIDENCE_OUT))
        if free:
            batch = accepted.where(~F.col("requires_key")).select(
                *carried, F.lit(None).cast("string").alias("key_id_hash"), F.lit("scheme_only").alias("key_status")
            )
            parts.append(batch.mapInPandas(_runner({d.detector_id: d.score for d in free}), EVIDENCE_OUT))
        if not parts:
            raise ValueError("no detector registered")
        out = parts[0]
        for extra in parts[1:]:
            out = out.unionByName(extra)
        return out


def _runner(functions: Mapping[str, Callable[[pd.DataFrame], pd.Series]]):
    names = EVIDENCE_OUT.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for detector_id, part in batch.groupby("detector_id", sort=False):
                scored = part.assign(raw_statistic=functions[detector_id](part).astype("float64"))
                yield scored[names]

    return run


def extract_views(documents: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """Run a user feature extractor on batches of documents; one output row per token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor(batch)[schema.fieldNames()]

    return documents.mapInPandas(run, schema)
