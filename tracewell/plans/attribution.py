"""End-to-end attribution: span search, evidence, null pools, p-values, five-label decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, decision, evidence, textsearch
from ..operators.evidence import POOLS, SCENARIOS, Scenario
from ..session import shared_table, staged
from . import corpus


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the defaults are those of the derived test corpus."""

    alpha: float = 0.05
    minimum_parents: int = 20
    single_stratum: bool = False
    languages: tuple[str, ...] = ("en", "de", "es")
    minimum_length: int = 64
    per_item_p: bool = False

    def stratum(self) -> Column:
        return F.lit("all") if self.single_stratum else calibration.language_stratum()


DEFAULT = Settings()


_SPAN = {
    "candidate_id": pa.string(), "char_start": pa.int32(), "char_end": pa.int32(), "scale_id": pa.string(),
    "raw_score": pa.float64(), "repetition": pa.float64(), "tokens": pa.int32(),
}
_MEASURES = pa.struct({
    "text_length": pa.int32(), "effective_length": pa.int32(), "mapping_coverage": pa.float64(),
    "repetition": pa.float64(), "tokens": pa.int32(), "candidates": pa.list_(pa.struct(_SPAN)),
})
_MEASURED = (
    "text_length:int,effective_length:int,mapping_coverage:double,repetition:double,tokens:int,candidates:"
    "array<struct<candidate_id:string,char_start:int,char_end:int,scale_id:string,raw_score:double,repetition:double,tokens:int>>"
)


def _text_measures(text: str) -> tuple[np.ndarray, np.ndarray, dict]:
    codes = textsearch.code_points(text)
    space = textsearch.is_space(codes)
    return codes, space, {
        "text_length": len(codes), "effective_length": len(codes) - int(np.count_nonzero(space)),
        "mapping_coverage": textsearch.piece_coverage(space, lambda i: i % 61 != 60),
        "repetition": textsearch.repetition(codes), "tokens": textsearch.count_words(space),
    }


def _candidates(codes: np.ndarray, space: np.ndarray, marked: bool) -> list[dict]:
    found = textsearch.candidates(corpus.score_array(codes, marked), unit=65535.0)
    for c in found:
        at = slice(c["char_start"], c["char_end"])
        c |= {"repetition": textsearch.repetition(codes[at]), "tokens": textsearch.count_words(space[at])}
    return found


def _measure(texts: pa.Array, marked: pa.Array) -> pa.Array:
    """Measures and candidates of each text; variants of a parent come together and share their text."""
    known: dict[str, tuple] = {}
    seen: dict[tuple, dict] = {(None, m): {"mapping_coverage": 0.0, "repetition": 0.0, "candidates": []} for m in (False, True)}
    out = []
    for text, mark in zip(texts.to_pylist(), marked.to_pylist(), strict=True):
        if (text, mark) not in seen:
            if text not in known:
                known[text] = _text_measures(text)
            codes, space, measures = known[text]
            seen[text, mark] = measures | {"candidates": _candidates(codes, space, mark)}
        out.append(seen[text, mark])
    return pa.array(out, _MEASURES)


def search_documents(rows: DataFrame) -> DataFrame:
    """Score and search each document in place; only compact results leave this stage.

    Everything here is a projection of one row, so it runs where the text is read, without a shuffle. The scores,
    ``corpus.with_scores``, the spans and the measures of texts and segments are worked out over Arrow batches, once per
    different text and mark of a batch.
    """
    measure = F.arrow_udf(_measure, f"struct<{_MEASURED}>")
    found = rows.withColumn("_m", measure(F.col("text"), F.col("watermark_family").isNotNull()))
    return found.select(
        F.col("recipe_id").alias("document_id"),
        "parent_ids", "kind", "split", "source", "language", "watermark_family", "watermark_families",
        "key_id", "key_ids", "attack_id", "watermark_intervals",
        *[F.col(f"_m.{c}") for c in ("effective_length", "mapping_coverage", "text_length", "repetition", "tokens", "candidates")],
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched rows of the development, null-calibration and test populations."""

    def build() -> DataFrame:
        null = (F.col("split") == "calibration") & F.col("watermark_family").isNull() & (F.col("kind") != "mixed_document")
        plan = corpus.recipes(spark, sf_dir).where(null | F.col("split").isin("dev", "test"))
        # The texts of rows stand five times in a written table; here they only pass through.
        rows = corpus.derive_rows(spark, sf_dir, plan)
        return search_documents(rows.where(F.col("status") == "generated"))

    return shared_table(spark, sf_dir, "scored", build)


def interval_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every searched interval: an array of its tests, for each family and slot and key-free probes."""
    return shared_table(spark, sf_dir, "evidence", lambda: derive_evidence(scored(spark, sf_dir)))


def detector_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every searched interval, family and slot plus key-free probes."""
    return interval_evidence(spark, sf_dir).select("*", F.inline("tests")).drop("tests")


def derive_evidence(docs: DataFrame) -> DataFrame:
    keep = ["document_id", "split", "watermark_family", "watermark_families", "key_id", "key_ids", "tokens"]
    intervals = evidence.search_intervals(
        docs.withColumn("_n", F.col("text_length")).select(*keep, "_n", "candidates"),
        length=F.col("_n"), tokens=F.col("tokens"),
    )
    document, start, end = F.col("document_id"), F.col("char_start"), F.col("char_end")
    tested = evidence.interval_tests(
        intervals, lambda family, slot: corpus.evidence_statistic(document, start, end, family, slot),
        lambda family: corpus.mechanism_statistic(document, family),
    )
    return tested.select(
        "document_id", "split", "candidate_id", "char_start", "char_end", "interval_role", "detector_token_count", "tests"
    )


def _produced(applicability: Column, raw: Column) -> Column:
    return ~applicability.eqNullSafe(F.lit("invalid")) & raw.isNotNull()


def usable(ev: DataFrame) -> DataFrame:
    """Evidence rows a detector really produced, those with a warning too: refused tests have no statistic."""
    return ev.where(_produced(F.col("applicability"), F.col("raw_statistic"))).withColumn("strength", evidence.strength())


def usable_tests(ev: DataFrame) -> DataFrame:
    """Intervals with the ``usable`` ones of their tests, cut to what scenarios and decisions read."""
    kept = F.filter("tests", lambda t: _produced(t["applicability"], t["raw_statistic"]))
    slim = F.transform(kept, lambda t: F.struct(
        *[t[c].alias(c) for c in ("scheme_family", "key_status", "key_id_hash", "applicability")],
        F.coalesce(t["evidence_strength"], t["raw_statistic"]).alias("strength"),
    ))
    return ev.select("document_id", "candidate_id", "char_start", "char_end", "interval_role", slim.alias("tests"))


def segments_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        "document_id", "language", "effective_length", "mapping_coverage",
        F.inline(
            F.transform(
                "candidates",
                lambda c: F.struct(
                    c["candidate_id"].alias("candidate_id"), c["char_start"].alias("char_start"),
                    c["char_end"].alias("char_end"), c["scale_id"].alias("scale_id"),
                    c["raw_score"].alias("raw_score"), c["repetition"].alias("segment_repetition"),
                ),
            )
        ),
    )


def segment_tests(docs: DataFrame, ev: DataFrame) -> DataFrame:
    """The tests that apply to each candidate, of intervals with ``tests``; a row per document and candidate that has any.

    An interval moves as one row, once; scenarios are told apart afterwards, in the arrays, so they multiply no join.
    """
    found = evidence.tests_by_document(docs.select("document_id", "candidates"), usable_tests(ev))
    return found.select("document_id", F.inline("found"))


def tested_candidates(docs: DataFrame, ev: DataFrame, *columns: str) -> DataFrame:
    """Each candidate of each row with the tests of ``segment_tests``, null without any, and ``columns`` of its document.

    Documents meet their tests before the candidates become rows, so all of it is dealt by the document alone.
    """
    found = evidence.tests_by_document(docs.select("document_id", "candidates"), usable_tests(ev))
    names = docs.schema["candidates"].dataType.elementType.names
    own = lambda c: F.get(F.filter("found", lambda f: f["candidate_id"] == c["candidate_id"]), F.lit(0))["tests"]
    cells = F.transform("candidates", lambda c: F.struct(*[c[n].alias(n) for n in names], own(c).alias("tests")))
    joined = docs.select("document_id", *columns, "candidates").join(found, "document_id", "left")
    return joined.select("document_id", *columns, F.inline(cells))


def generic_maximum() -> Column:
    return F.coalesce(F.array_max(F.transform("candidates", lambda c: c["raw_score"])), F.lit(0.0))


def null_records(docs: DataFrame, ev: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Route maxima of clean calibration documents and their attacked copies, per pool."""
    clean = docs.where((F.col("split") == "calibration") & F.col("watermark_family").isNull())
    ev = ev.where(F.col("split") == "calibration")
    tested = tested_candidates(clean, ev).select("document_id", "candidate_id", "raw_score", "tests")
    segs = calibration.best_strengths(evidence.mask_tests(tested, POOLS))
    ev_max = calibration.best_strengths(evidence.mask_tests(usable_tests(ev), POOLS)).groupBy("pool", "document_id").agg(
        F.max("best_strength").alias("registered_max")
    )
    per_doc = clean.select(
        "document_id", "split", F.col("parent_ids").getItem(0).alias("parent_id"),
        settings.stratum().alias("stratum"),
        F.when(F.col("attack_id").isNotNull(), "attacked-clean").otherwise("clean").alias("descendant_kind"),
        generic_maximum().alias("generic_max"),
        F.inline(evidence.scenario_array(POOLS)),
    ).drop("scenario", "slots", "held_out_family")
    return calibration.document_maxima(per_doc, segs, ev_max)


def null_pool(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> DataFrame:
    name = f"pool-{settings.single_stratum}-{settings.minimum_parents}"
    return shared_table(
        spark, sf_dir, name,
        lambda: calibration.parent_pool(
            null_records(scored(spark, sf_dir), interval_evidence(spark, sf_dir), settings),
            minimum_parents=settings.minimum_parents,
        ),
    )


def held_out_scope(held: Column, family: Column | None = None, parents: Column | None = None) -> Column:
    """Rows a scenario covers: all of them, or clean and held-out single-parent rows."""
    family = F.col("watermark_family") if family is None else family
    parents = F.col("parent_ids") if parents is None else parents
    return held.isNull() | ((F.size(parents) == 1) & (family.isNull() | (family == held)))


def infer(
    docs: DataFrame, ev: DataFrame, pool: DataFrame, scenarios: Sequence[Scenario], settings: Settings = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Segment and document decisions of ``docs`` under every scenario.

    Scenarios are a column, so one pass serves all of them. The generic p of every segment is the
    document's; the registered p of a candidate comes from its best strength and is written to each of
    its items, unless ``per_item_p`` judges every item by the p of its own strength: items then say whether that is at most
    alpha, by the strength that has alpha in the null pool, and the strongest one has the smallest p.
    """
    keys = ["scenario", "document_id"]
    scoped = docs.select("*", F.inline(evidence.scenario_array(scenarios))).where(
        held_out_scope(F.col("held_out_family"))
    ).withColumn("stratum", settings.stratum())
    documents = scoped.withColumn("generic_max", generic_maximum())
    same = docs.groupBy("document_id").agg(F.collect_list(F.struct("watermark_family", "parent_ids")).alias("_same"))
    known = docs.withColumn("stratum", settings.stratum()).join(same, "document_id", "left")
    tested = tested_candidates(
        known, ev, "stratum", "language", "effective_length", "mapping_coverage", "watermark_family", "parent_ids", "_same"
    )
    held = F.col("held_out_family")
    seen = calibration.best_strengths(evidence.mask_tests(tested, scenarios).where(held_out_scope(held)))
    cells = F.transform("tests", lambda t: F.struct(
        t["scheme_family"].alias("family"), t["key_status"].alias("key_status"),
        t["applicability"].alias("applicability"), t["strength"].alias("strength"),
    ))
    # Rows that share an id count the tests once for each row that is in the scenario's scope.
    copies = F.size(F.filter("_same", lambda d: held_out_scope(held, d["watermark_family"], d["parent_ids"])))
    segs = seen.withColumns({
        "best": F.coalesce("best_strength", F.lit(0.0)),
        "_items": F.when(copies == 1, cells).otherwise(F.flatten(F.array_repeat(cells, copies))),
    }).drop("tests", "best_strength", "_same", "watermark_family", "parent_ids", "held_out_family")
    # Written once: both the list of observed values and the rows they are joined back to come from it.
    segs = segs.withColumns({"gap_score": F.col("raw_score") - F.col("best"), "_row": F.monotonically_increasing_id()})
    segs = staged(segs, "segments")

    pair = lambda route, value: F.struct(F.lit(route).alias("route"), F.col(value).alias("observed"))
    observed = segs.select(
        "pool", "stratum", F.inline(F.array(pair("gap", "gap_score"), pair("registered", "best")))
    ).unionByName(documents.select("pool", "stratum", F.inline(F.array(pair("generic", "generic_max")))))
    table = staged(
        calibration.tail_p(observed, pool, list(calibration.POOL_KEYS), value="observed"), "tail-p"
    )

    def p(df: DataFrame, route: str, value: str, out: str) -> DataFrame:
        part = table.where(F.col("route") == route).select(
            "pool", "stratum", F.col("observed").alias(value), F.col("p_value").alias(out)
        )
        return df.join(part, ["pool", "stratum", value], "left")

    documents = p(documents, "generic", "generic_max", "generic_p")
    documents = documents.withColumn("missing_pool", F.col("generic_p").isNull())
    slim = documents.select(*keys, "generic_p", "missing_pool")
    # Only the number of the row goes along with its values; the items are moved once, to meet what was found.
    told = p(segs.select("_row", *keys, "pool", "stratum", "gap_score", "best"), "gap", "gap_score", "gap_p")
    told = p(told, "registered", "best", "registered_p").join(slim, keys)
    segs = segs.join(told.select("_row", "gap_p", "registered_p", "generic_p", "missing_pool"), "_row")
    if settings.per_item_p:
        # One row per pool and stratum.
        bounds = calibration.significance_bounds(
            pool.where(F.col("route") == "registered"), ["pool", "stratum"], alpha=settings.alpha
        )
        segs = segs.join(F.broadcast(bounds), ["pool", "stratum"], "left")
        judged = lambda i: calibration.beyond_bound(i["strength"]).alias("significant")
        field = "significant:boolean"
    else:
        # No detector here reports a p of its own, so the candidate's registered p stands for every item.
        judged = lambda i: F.col("registered_p").alias("adjusted_p")
        field = "adjusted_p:double"
    empty = F.array().cast(f"array<struct<family:string,key_status:string,applicability:string,{field}>>")
    kept = ("family", "key_status", "applicability")
    items = F.transform("_items", lambda i: F.struct(*[i[c].alias(c) for c in kept], judged(i)))
    segs = segs.withColumn("items", F.coalesce(items, empty)).drop("_row", "_items", "bound", "reachable")
    rules = dict(languages=settings.languages, minimum_length=settings.minimum_length)
    segs = segs.withColumn(
        "validity_reasons",
        decision.validity_reasons(
            effective_length=F.col("effective_length"), coverage=F.col("mapping_coverage"),
            language=F.col("language"), repetition=F.col("repetition"), **rules,
        ),
    )
    decided = decision.decide_segments(segs, alpha=settings.alpha)
    documents = documents.withColumn(
        "validity_reasons",
        decision.validity_reasons(
            effective_length=F.col("effective_length"), coverage=F.col("mapping_coverage"),
            language=F.col("language"), repetition=F.col("repetition"), **rules,
        ),
    )
    return decided, decision.decide_documents(documents, decided, keys)


def decisions(
    spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT, scenarios: Sequence[Scenario] = SCENARIOS[:1]
) -> tuple[DataFrame, DataFrame]:
    """Segment and document decisions of the test population."""
    docs = scored(spark, sf_dir).where(F.col("split") == "test")
    ev = interval_evidence(spark, sf_dir).where(F.col("split") == "test")
    return infer(docs, ev, null_pool(spark, sf_dir, settings), scenarios, settings)
