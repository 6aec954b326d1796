"""Assembly of derived rows: attacks on bases, mixed composition, validation without silent loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose_adjacent, deterministic_attack
from ..schemas import DETERMINISTIC_ATTACKS, FAILURE_COLUMNS
from ..session import staged

SPANS = "array<struct<char_start:int,char_end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def one_span(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("char_start"), end.cast("int").alias("char_end")))


def planted_span(text: Column | str = "text") -> Column:
    """Second quarter of a text, the marked stretch of a derived base row."""
    n = F.length(text)
    return one_span(F.floor(n / 4), F.floor(n / 2))


def attack_rows(
    recipes: DataFrame, base: DataFrame, *, fraction: float = 0.75, key: str = "base_recipe_id", base_key: str = "recipe_id"
) -> DataFrame:
    """Attack recipes joined to their base row; recipe columns win, model attacks become failed rows.

    The marked interval is empty for clean rows and the whole new text otherwise. Recipes without a
    base are kept, as failed rows, so nothing disappears. ``key`` of the recipes meets ``base_key`` of the bases.
    """
    base_side = base.select(
        F.col(base_key).alias(key),
        F.col("text").alias("_text"),
        F.col("source").alias("_source"),
        F.col("language").alias("_language"),
    )
    text = deterministic_attack("_text", "attack_id", fraction)
    joined = recipes.join(base_side, key, "left").withColumn("text", text)
    made = F.col("text").isNotNull() & (F.col("text") != "")
    missing = F.col("_text").isNull()
    model = ~F.col("attack_id").isin(*DETERMINISTIC_ATTACKS)
    out = {
        "source": F.coalesce("source", "_source"),
        "language": F.coalesce("language", "_language"),
        "status": F.when(made, "generated").otherwise("failed"),
        "failure_type": F.when(
            ~made,
            F.when(missing, "MissingBase").when(model, "ModelUnavailable").otherwise("EmptyText"),
        ),
        "failure_message": F.when(
            ~made, F.concat(F.lit("no text for attack "), F.col("attack_id"))
        ),
        "text": F.when(made, F.col("text")),
        "text_sha256": F.when(made, F.sha2("text", 256)),
        "watermark_intervals": F.when(~made | F.col("watermark_family").isNull(), no_spans()).otherwise(
            one_span(F.lit(0), F.length("text"))
        ),
    }
    return joined.withColumns(out).drop("_text", "_source", "_language")


def base_rows(recipes: DataFrame, parents: DataFrame) -> DataFrame:
    """Base recipes carrying their parent's text; non-clean rows mark the planted interval."""
    keyed = recipes.withColumn("parent_id", F.col("parent_ids").getItem(0))
    joined = keyed.join(parents.select("parent_id", "text", "text_sha256"), "parent_id").drop("parent_id")
    return joined.withColumns(
        {
            "status": F.lit("generated"),
            "watermark_intervals": F.when(F.col("watermark_family").isNull(), no_spans()).otherwise(
                planted_span()
            ),
        }
    )


def mixed_rows(recipes: DataFrame, parents: DataFrame, *, separator: str = "\n\n") -> DataFrame:
    """Adjacent composition of two parents with exact component offsets and per-component keys."""
    texts = parents.select("parent_id", "text", F.col("language").alias("_language"))
    sides = recipes.select("recipe_id", F.posexplode("parent_ids").alias("_i", "parent_id"))
    parts = sides.join(texts, "parent_id").groupBy("recipe_id").agg(
        F.array_sort(F.collect_list(F.struct("_i", "text", "_language"))).alias("_parts")
    )
    whole = compose_adjacent(F.col("_parts.text"), separator)
    languages = F.col("_parts._language")
    joined = recipes.join(parts, "recipe_id").withColumn("_whole", whole)
    key = lambda c: F.concat(c["watermark_family"], F.lit("_key_"), c["key_slot"])
    return joined.withColumns(
        {
            "language": F.when(F.size(F.array_distinct(languages)) == 1, languages.getItem(0)).otherwise(
                "mixed"
            ),
            "watermark_family": F.lit("mixed"),
            "watermark_families": F.col("components.watermark_family"),
            "key_id": F.lit(None).cast("string"),
            "key_ids": F.transform("components", key),
            "text": F.col("_whole.text"),
            "text_sha256": F.sha2(F.col("_whole.text"), 256),
            "watermark_intervals": F.col("_whole.intervals"),
            "boundary_quality": F.lit("exact"),
            "status": F.lit("generated"),
        }
    ).drop("_parts", "_whole")


def row_violation() -> Column:
    """First rule a derived row breaks against its recipe (columns prefixed ``r_``), else null."""
    spans = F.col("watermark_intervals")
    n = F.length("text")
    bad_span = F.exists(
        spans, lambda s: (s["char_start"] < 0) | (s["char_start"] >= s["char_end"]) | (s["char_end"] > n)
    )
    # Unordered or overlapping: some interval starts before its predecessor ends.
    ends = F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0)))
    nexts = F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0)))
    clash = F.exists(F.arrays_zip(ends.alias("a"), nexts.alias("b")), lambda z: z["b"]["char_start"] < z["a"]["char_end"])
    failed = F.col("status") == "failed"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(F.col("r_kind").isNull(), "unknown_recipe")
        .when(F.col("copies") > 1, "duplicate_row")
        .when(F.col("copies").isNull(), "missing_row")
        .when(failed & (blank("failure_type") | blank("failure_message")), "failure_without_reason")
        .when(failed, None)
        .when(F.coalesce(F.col("status"), F.lit("")) != "generated", "unknown_status")
        .when(blank("text") | ~F.sha2("text", 256).eqNullSafe(F.col("text_sha256")), "text_hash_mismatch")
        .when(~F.col("kind").eqNullSafe(F.col("r_kind")), "kind_changed")
        .when(~F.col("parent_ids").eqNullSafe(F.col("r_parent_ids")), "parents_changed")
        .when(bad_span | clash, "invalid_intervals")
        .when((F.col("r_kind") == "mixed_document") & (F.size(spans) != 2), "mixed_needs_two_intervals")
    )


def check_rows(recipes: DataFrame, rows: DataFrame) -> DataFrame:
    """Full outer match of recipes and derived rows with the first violation per recipe id (or null)."""
    wanted = recipes.select(
        "recipe_id", F.col("kind").alias("r_kind"), F.col("parent_ids").alias("r_parent_ids")
    )
    copies = rows.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("copies"))
    seen = rows.select(
        "recipe_id", "kind", "status", "parent_ids", "text", "text_sha256", "watermark_intervals",
        "failure_type", "failure_message",
    ).join(copies, "recipe_id")
    return wanted.join(seen, "recipe_id", "full_outer").select(
        "recipe_id", "status", row_violation().alias("violation")
    )


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(
        F.count(F.lit(1)).alias("n")
    )


def feature_documents(rows: DataFrame) -> DataFrame:
    """Generated rows that go on to scoring; mixed training rows stay out."""
    held = (F.col("kind") == "mixed_document") & (F.col("split") == "train")
    return rows.where((F.col("status") == "generated") & ~held)


def split_seal(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows outside the allowed splits, counted per split (empty = sealed)."""
    outside = F.col("split").isNull() | ~F.col("split").isin(*allowed)
    return rows.where(outside).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def require_splits(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows as they are, failing the job on the first row outside the allowed splits."""
    inside = F.coalesce(F.col("split").isin(*allowed), F.lit(False))
    message = F.concat(F.lit("sealed split read: "), F.coalesce("split", F.lit("null")))
    return rows.withColumn(
        "split", F.when(inside, F.col("split")).otherwise(F.raise_error(message).cast("string"))
    )


def orphan_attacks(recipes: DataFrame, base: DataFrame) -> DataFrame:
    """Attack recipes whose base row does not exist."""
    keys = base.select(F.col("recipe_id").alias("base_recipe_id"))
    attacks = recipes.where(F.col("kind") == "matched_attack")
    return attacks.join(keys, "base_recipe_id", "left_anti").select("recipe_id", "base_recipe_id")


def failure_table(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "failed").select(*FAILURE_COLUMNS)


def retry_drift(original: DataFrame, retry: DataFrame) -> DataFrame:
    """Ids in only one of {failed originals, retry rows} or retried twice; empty when they match."""
    failed = original.where(F.col("status") == "failed").select("recipe_id", F.lit(1).alias("o"))
    tried = retry.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("r"))
    both = failed.join(tried, "recipe_id", "full_outer")
    why = (
        F.when(F.col("o").isNull(), "not_a_failed_row")
        .when(F.col("r").isNull(), "not_retried")
        .when(F.col("r") > 1, "duplicate_retry")
    )
    return both.select("recipe_id", why.alias("violation")).where(F.col("violation").isNotNull())


def reconcile_retry(original: DataFrame, retry: DataFrame) -> DataFrame:
    """Replace failed rows by their successful retry; keep both failures' reasons otherwise."""
    reason = lambda: F.struct("failure_type", "failure_message")
    again = retry.select(
        "recipe_id",
        F.col("status").alias("_status"),
        F.struct(*[F.col(c) for c in original.columns if c != "recipe_id"]).alias("_row"),
        reason().alias("_why"),
        F.lit(1).alias("_retry_index"),
    )
    joined = original.join(again, "recipe_id", "left")
    won = F.coalesce(F.col("_status") == "generated", F.lit(False))
    lost = F.col("_status").isNotNull() & ~won
    cols = [
        F.when(won, F.col(f"_row.{c}")).otherwise(F.col(c)).alias(c) if c != "recipe_id" else F.col(c)
        for c in original.columns
    ]
    return joined.select(
        *cols,
        F.when(won, reason()).alias("initial_failure"),
        F.when(lost, F.col("_why")).alias("retry_failure"),
        F.when(lost, F.col("_retry_index")).alias("generation_retry_index"),
    )


def enrich_features(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Feature manifest rows with kind and base recipe of their document."""
    return features.join(rows.select("recipe_id", "kind", "base_recipe_id"), "recipe_id", "left")


def pending(selected: DataFrame, completed: DataFrame) -> DataFrame:
    """Selected work that has no completed row yet."""
    return selected.join(completed.select("recipe_id").distinct(), "recipe_id", "left_anti")


def resume_violations(selected: DataFrame, completed: DataFrame, frozen: Sequence[str]) -> DataFrame:
    """Completed rows that cannot seed a resumed run, one row per (id, reason).

    Texts are held against their hash where they are read; only the outcome is written and moved.
    """
    bad_text = (F.col("status") == "generated") & (
        (F.coalesce(F.col("text"), F.lit("")) == "") | ~F.sha2("text", 256).eqNullSafe(F.col("text_sha256"))
    )
    completed = staged(completed.select("recipe_id", *frozen, bad_text.alias("_bad_text")), "resume-completed")
    copies = completed.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("_n"))
    plan = selected.select("recipe_id", *[F.col(c).alias(f"p_{c}") for c in frozen], F.lit(1).alias("_in"))
    joined = completed.join(copies, "recipe_id").join(plan, "recipe_id", "left")
    unknown = F.col("_in").isNull()
    reasons = [
        F.when(unknown, "not_selected"),
        F.when(F.col("_n") > 1, "duplicate"),
        F.when(F.col("_bad_text"), "text_hash_mismatch"),
        *[
            F.when(~unknown & ~F.col(c).eqNullSafe(F.col(f"p_{c}")), f"changed_{c}")
            for c in frozen
        ],
    ]
    return joined.select("recipe_id", F.explode(F.array_compact(F.array(*reasons))).alias("violation")).distinct()


def readopt(outputs: DataFrame, manifest: DataFrame, selected: DataFrame) -> DataFrame:
    """Outputs missing from the manifest: adopted when their id is selected and all values are finite."""
    orphan = outputs.join(manifest.select("recipe_id"), "recipe_id", "left_anti")
    known = selected.select("recipe_id", F.lit(1).alias("_in"))
    finite = F.size("values") > 0
    finite = finite & F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    outcome = (
        F.when(F.col("_in").isNull(), "unknown_id").when(~finite, "not_finite").otherwise("adopted")
    )
    return orphan.join(known, "recipe_id", "left").select("recipe_id", outcome.alias("outcome"))


def seed_from_subset(full: DataFrame, canary: DataFrame) -> DataFrame:
    """Canary rows against the full set: reusable when id and text hash both agree."""
    target = full.select("recipe_id", F.col("text_sha256").alias("_full"))
    outcome = (
        F.when(F.col("_full").isNull(), "not_in_full_set")
        .when(F.col("_full") == F.col("text_sha256"), "reused")
        .otherwise("text_changed")
    )
    return canary.join(target, "recipe_id", "left").select("recipe_id", outcome.alias("outcome"))


def set_difference(left: DataFrame, right: DataFrame, key: str, *, first: int = 5) -> DataFrame:
    """Counts of ids only on one side and the first offenders of each side in id order."""
    l = left.select(key).distinct().withColumn("_l", F.lit(1))
    r = right.select(key).distinct().withColumn("_r", F.lit(1))
    both = l.join(r, key, "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    from pyspark.sql import Window

    labelled = both.select(key, side.alias("side"))
    counts = labelled.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("side").orderBy(key)
    top = (
        labelled.where(F.col("side") != "both").withColumn("_k", F.row_number().over(order))
        .where(F.col("_k") <= first).groupBy("side")
        .agg(F.array_sort(F.collect_list(F.col(key))).alias("_first"))
    )
    return counts.join(top, "side", "left").select(
        "side", "n", F.coalesce(F.array_join("_first", ","), F.lit("")).alias("first_offenders")
    )


def registry_violations(assets: DataFrame) -> DataFrame:
    """Rule breaches of an asset registry: revision shape, licence presence, licensed selection.

    Fixed value: a revision is forty lower-case hex digits.
    """
    revision = F.coalesce("revision", F.lit("")).rlike("^[0-9a-f]{40}$")
    licensed = F.coalesce(F.col("license"), F.lit("")) != ""
    enabled = ~F.coalesce(F.col("policy"), F.lit("")).contains("disabled")
    kind = F.col("kind")
    reasons = [
        F.when((kind == "model") & ~revision, "invalid_model_revision"),
        F.when((kind == "model") & ~licensed, "missing_model_license"),
        F.when((kind == "repository") & ~revision, "invalid_repository_commit"),
        F.when((kind == "repository") & ~licensed & enabled, "unlicensed_repository_enabled"),
        F.when((kind == "corpus") & F.col("selected") & ~licensed, "unlicensed_corpus_selected"),
    ]
    return assets.select("asset_id", F.explode(F.array_compact(F.array(*reasons))).alias("violation"))


def asset_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual size and hash per asset."""
    seen = actual.select("asset_id", F.col("sha256").alias("actual_sha256"), F.col("bytes").alias("actual_bytes"))
    ok = F.col("sha256").eqNullSafe(F.col("actual_sha256")) & F.col("bytes").eqNullSafe(F.col("actual_bytes"))
    return expected.join(seen, "asset_id", "left").select("asset_id", ok.alias("ok"))
