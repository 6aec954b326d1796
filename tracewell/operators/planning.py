"""Corpus planning: eligibility, leak-free splits, key slots, recipes, mixed pairs, canary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, hash_int31, hex_mod, set_digest, stable_hash, text_hash
from ..schemas import ATTACKS, FAMILIES, PILOT_SLOTS, SEED, SPLITS, WEAK_ATTACKS
from .ordered import RANGE, hash_rank, in_ranges, with_running, with_scalars


def eligible(df: DataFrame, *, minimum: int, text: str = "text", key: str = "parent_id") -> DataFrame:
    """Rows with a non-empty id and at least ``minimum`` code points."""
    return df.where((F.length(text) >= minimum) & F.col(key).isNotNull() & (F.col(key) != ""))


def exclude_parents(df: DataFrame, excluded: DataFrame, key: str = "parent_id") -> DataFrame:
    """Anti-join against ids already used elsewhere; a blank excluded id is an error."""
    blank = F.col(key).isNull() | (F.col(key) == "")
    checked = excluded.select(
        F.when(blank, F.raise_error(F.lit("blank id in exclusion list"))).otherwise(F.col(key)).alias(key)
    )
    return df.join(checked, key, "left_anti")


def source_projection(df: DataFrame, *, maximum: int, text: str = "text") -> DataFrame:
    """Truncated text with the hashes of the full and of the kept text."""
    kept = F.substring(F.col(text), 1, maximum)
    return df.withColumns(
        {
            "source_text_sha256": text_hash(text),
            text: kept,
            "text_sha256": F.sha2(kept, 256),
        }
    )


def select_lowest(
    df: DataFrame, *, count: int, seed: int = SEED, group: str = "source", key: str = "parent_id",
    line: str = "source_line",
) -> DataFrame:
    """Per group the ``count`` rows with the lowest stable hash; on equal hashes the later line wins.

    ``rank <= count`` on a row number lets Spark keep only ``count`` rows per task before the shuffle.
    """
    from pyspark.sql import Window

    digest = stable_hash(seed, F.col(key))
    order = Window.partitionBy(group).orderBy(F.col("_h"), F.col(line).desc())
    ranked = df.withColumn("_h", digest).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= count).drop("_h")


def group_shortfall(selected: DataFrame, groups: DataFrame, *, count: int, group: str = "source") -> DataFrame:
    """Groups that could not supply ``count`` rows (an empty result is the pass condition)."""
    have = selected.groupBy(group).agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce(F.col("found"), F.lit(0)).cast("bigint")
    return (
        groups.select(group).distinct().join(have, group, "left")
        .select(group, found.alias("found")).where(F.col("found") < count)
    )


def split_by_rank(df: DataFrame, counts: Mapping[str, int], rank: str = "rank") -> DataFrame:
    """Split label from a 1-based rank and ordered slot counts."""
    upper, label = 0, None
    for split in SPLITS:
        upper += int(counts[split])
        hit = F.col(rank) <= upper
        label = F.when(hit, split) if label is None else label.when(hit, split)
    return df.withColumn("split", label)


def split_by_share(df: DataFrame, per_mille: Sequence[int], rank: str = "rank", total: str = "total") -> DataFrame:
    """Split label from rank and group size with cumulative bounds in thousandths."""
    label = None
    for split, bound in zip(SPLITS[:-1], per_mille, strict=True):
        hit = F.col(rank) * 1000 <= F.col(total) * bound
        label = F.when(hit, split) if label is None else label.when(hit, split)
    return df.withColumn("split", label.otherwise(SPLITS[-1]))


def pilot_split(rank: Column) -> Column:
    """Fixed slots repeated every eight ranks."""
    slots = F.array(*[F.lit(s) for s in PILOT_SLOTS])
    return F.element_at(slots, ((rank - 1) % len(PILOT_SLOTS) + 1).cast("int"))


def key_slots(parents: DataFrame, *, seed: int = SEED) -> DataFrame:
    """Alternate slots a/b inside (source, split) by stable hash, so counts differ by at most one."""
    digest = stable_hash(seed + 11, "source", "split", "parent_id")
    ranked = hash_rank(parents, ["source", "split"], digest, [F.col("parent_id")], rank="_r")
    return ranked.withColumn("key_slot", F.when(F.col("_r") % 2 == 1, "a").otherwise("b")).drop("_r")


def pilot_key_slot(seed: int = SEED, key: Column | str = "parent_id") -> Column:
    return F.when(hex_mod(stable_hash(seed, key), 2) == 0, "a").otherwise("b")


def base_recipes(parents: DataFrame, *, seed: int = SEED) -> DataFrame:
    """One clean recipe and one per family for every parent (needs ``key_slot``)."""
    variants = F.array(*[F.lit(v) for v in ("clean", *FAMILIES)])
    family = F.when(F.col("base_variant") != "clean", F.col("base_variant"))
    return parents.withColumn("base_variant", F.explode(variants)).select(
        F.concat(
            F.lit("base-"), F.col("base_variant"), F.lit("-"), F.left(F.sha2("parent_id", 256), F.lit(16))
        ).alias("recipe_id"),
        F.lit("base_generation").alias("kind"),
        "split",
        "source",
        "language",
        F.array("parent_id").alias("parent_ids"),
        "base_variant",
        family.alias("watermark_family"),
        F.when(
            family.isNotNull(), F.concat(F.col("base_variant"), F.lit("_key_"), F.col("key_slot"))
        ).alias("key_id"),
        F.lit(seed).alias("seed"),
        F.lit("planned_not_generated").alias("status"),
    )


def attack_recipes(base: DataFrame, *, seed: int = SEED, pilot: bool = False) -> DataFrame:
    """One matched attack per base recipe, attacks rotated so their counts differ by at most one.

    ``pilot`` rotates over ``base_index`` (the base recipe's position) instead of a hashed rank.
    """
    if pilot:
        turned = base.withColumn("_k", (F.col("base_index") % len(ATTACKS)).cast("int"))
    else:
        groups = ["source", "split", "base_variant"]
        ranked = hash_rank(
            base, groups, stable_hash(seed + 23, "recipe_id"), [F.col("recipe_id")], rank="_r"
        )
        rotation = hex_mod(stable_hash(seed + 29, *groups), len(ATTACKS))
        turned = ranked.withColumn("_k", ((F.col("_r") - 1 + rotation) % len(ATTACKS)).cast("int"))
    attack = F.element_at(F.array(*[F.lit(a) for a in ATTACKS]), F.col("_k") + 1)
    return turned.withColumn("attack_id", attack).select(
        F.concat(F.lit("attack-"), F.col("recipe_id")).alias("recipe_id"),
        F.lit("matched_attack").alias("kind"),
        "split",
        "source",
        "language",
        "parent_ids",
        "base_variant",
        "watermark_family",
        "key_id",
        F.col("recipe_id").alias("base_recipe_id"),
        "attack_id",
        F.when(F.col("attack_id").isin(*WEAK_ATTACKS), "weak").otherwise("exact").alias("boundary_quality"),
        "seed",
        "status",
    )


def left_over_parents(parents: DataFrame, *, seed: int = SEED) -> DataFrame:
    """The parents that ``mixed_recipes`` leaves out with ``drop_odd``: the last of each odd (language, split) group."""
    ranked = hash_rank(
        parents, ["language", "split"], stable_hash(seed + 31, "parent_id"), [F.col("parent_id")], rank="_r", total="_t"
    )
    return ranked.where((F.col("_t") % 2 == 1) & (F.col("_r") == F.col("_t"))).select(
        "language", "split", "parent_id", F.col("_t").alias("parents")
    )


def mixed_recipes(
    parents: DataFrame, *, seed: int = SEED, drop_odd: bool = False, pilot: bool = False
) -> DataFrame:
    """Pair hash neighbours inside (language, split); families rotate over one global pair number.

    An odd group is an error unless ``drop_odd`` leaves its last parent out, which ``left_over_parents`` then names. The global number is the
    pair's place in its group plus the pair count of earlier groups, so no row is sorted globally.
    ``pilot`` pairs inside the split alone with fixed slots.
    """
    groups = ["split"] if pilot else ["language", "split"]
    shift = 1 if pilot else 31
    ranked = hash_rank(
        parents, groups, stable_hash(seed + shift, "parent_id"), [F.col("parent_id")],
        rank="_r", total="_t",
    )
    odd = F.col("_t") % 2
    if drop_odd:
        ranked = ranked.where(F.col("_r") <= F.col("_t") - odd)
    else:
        stop = F.raise_error(F.lit("mixed pairing needs an even parent count per group"))
        ranked = ranked.withColumn("_r", F.when(odd == 0, F.col("_r")).otherwise(stop.cast("bigint")))
    slot = F.when(F.col("_r") % 2 == 1, "a").otherwise("b") if pilot else F.col("key_slot")
    pairs = ranked.withColumn("_pair", F.floor((F.col("_r") - 1) / 2)).groupBy(*groups, "_pair").agg(
        F.array_sort(F.collect_list(F.struct("_r", "parent_id", slot.alias("key_slot"), "language"))).alias("_two")
    )
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).when(
        F.col("split") == "calibration", 2
    ).otherwise(3)
    # Number of (language, split) groups, not of rows: this running sum stays tiny.
    from pyspark.sql import Window

    sizes = pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy(order if pilot else F.struct(*groups)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    numbered = pairs.join(offsets, groups).withColumn("mixed_index", F.col("_o") + F.col("_pair"))
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def family(step: int) -> Column:
        return F.element_at(names, ((F.col("mixed_index") + step) % len(FAMILIES) + 1).cast("int"))

    def part(i: int, name: str) -> Column:
        return F.col("_two").getItem(i).getField(name)

    return numbered.select(
        F.format_string("mixed-%03d" if pilot else "mixed-%04d", F.col("mixed_index")).alias("recipe_id"),
        F.lit("mixed_document").alias("kind"),
        "split",
        F.lit("mixed").alias("source"),
        (F.lit("mixed") if pilot else F.col("language")).alias("language"),
        F.array(part(0, "parent_id"), part(1, "parent_id")).alias("parent_ids"),
        F.array(
            F.struct(family(0).alias("watermark_family"), part(0, "key_slot").alias("key_slot")),
            F.struct(family(1).alias("watermark_family"), part(1, "key_slot").alias("key_slot")),
        ).alias("components"),
        F.lit("adjacent").alias("overlap_mode"),
        F.lit(seed).alias("seed"),
        F.lit("planned_not_generated").alias("status"),
    )


def plan_recipes(parents: DataFrame, *, seed: int = SEED, drop_odd: bool = False) -> DataFrame:
    """Base, attack and mixed recipes as one wide table (needs ``key_slot`` on the parents)."""
    base = base_recipes(parents, seed=seed)
    attacks = attack_recipes(base, seed=seed)
    mixed = mixed_recipes(parents, seed=seed, drop_odd=drop_odd)
    wide = base.unionByName(attacks, allowMissingColumns=True)
    return wide.unionByName(mixed, allowMissingColumns=True)


def generation_seed(recipe_seed: Column | str, recipe_id: Column | str, retry: int = 0) -> Column:
    """Seed for one generation attempt; the retry number only takes part from the first retry on."""
    if retry < 0:
        raise ValueError("retry cannot be negative")
    fields = {"seed": F.col(recipe_seed), "recipe_id": F.col(recipe_id)}
    if retry:
        fields["retry_index"] = F.lit(retry)
    return hash_int31(content_hash(**fields))


def component_seed(seed: Column, recipe_id: Column, index: Column, key_id: Column) -> Column:
    return hash_int31(content_hash(seed=seed, recipe_id=recipe_id, component_index=index, key_id=key_id))


def audit_splits(parents: DataFrame) -> DataFrame:
    """Violations: parents seen in several splits and text hashes seen on several rows."""
    leaked = (
        parents.groupBy("parent_id").agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
        .select(F.lit("split_leak").alias("violation"), F.col("parent_id").alias("subject"))
    )
    repeated = (
        parents.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        .select(F.lit("duplicate_text").alias("violation"), F.col("text_sha256").alias("subject"))
    )
    return leaked.unionByName(repeated)


def split_summary(parents: DataFrame) -> DataFrame:
    """One row: rows, distinct parents, per-split counts and an order-free content digest."""
    per_parent = parents.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    counts = per_parent.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_parent_ids"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}_rows") for s in SPLITS],
    )
    digest = parents.select("text_sha256").distinct().agg(
        set_digest(F.col("text_sha256")).alias("content_digest")
    )
    return with_scalars(counts, digest)


def count_drift(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer comparison of observed and expected counts; only differing keys remain."""
    seen = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    zero = F.lit(0).cast("bigint")
    return (
        seen.join(expected, list(keys), "full_outer")
        .select(
            *keys,
            F.coalesce("observed", zero).alias("observed"),
            F.coalesce("expected", zero).alias("expected"),
        )
        .where(F.col("observed") != F.col("expected"))
    )


def _canary_quotas(mixed: DataFrame, parents: DataFrame, targets: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """Mixed recipes of the target splits by their combination of the language's two sources, and per (language, split)
    of all languages the target, the combinations there are and the smallest feasible number of same-source pairs."""
    sides = mixed.where(F.col("split").isin(*targets)).select(
        "recipe_id", "language", "split", F.explode("parent_ids").alias("parent_id")
    )
    where = parents.select("parent_id", F.col("source").alias("parent_source"))
    typed = sides.join(where, "parent_id").groupBy("language", "split", "recipe_id").agg(
        F.min("parent_source").alias("low"), F.max("parent_source").alias("high")
    )
    sources = parents.groupBy("language").agg(
        F.min("source").alias("first"), F.max("source").alias("second"), F.countDistinct("source").alias("sources")
    )
    category = (
        F.when((F.col("low") == F.col("first")) & (F.col("high") == F.col("first")), "same_first")
        .when((F.col("low") == F.col("second")) & (F.col("high") == F.col("second")), "same_second")
        .when((F.col("low") == F.col("first")) & (F.col("high") == F.col("second")), "cross")
        .otherwise("third_source")
    )
    typed = typed.join(sources, "language").withColumn("category", category)
    kinds = ("same_first", "same_second", "cross", "third_source")
    sizes = typed.groupBy("language", "split").agg(*[F.count_if(F.col("category") == c).alias(c) for c in kinds])
    wanted = F.array(*[F.struct(F.lit(k).alias("split"), F.lit(int(n)).alias("target")) for k, n in targets.items()])
    every = sources.select("language", "sources", F.inline(wanted)).join(sizes, ["language", "split"], "left").fillna(0, list(kinds))
    target = F.col("target")
    feasible = F.filter(
        F.sequence(F.lit(0), F.floor(target / 2).cast("int")),
        lambda k: (F.col("same_first") >= k) & (F.col("same_second") >= k) & (F.col("cross") >= target - 2 * k),
    )
    return typed, every.withColumn("same", F.try_element_at(feasible, F.lit(1)))


def canary_pairs(
    mixed: DataFrame, parents: DataFrame, targets: Mapping[str, int], *, seed: int = SEED
) -> DataFrame:
    """Mixed recipes that give each of a language's two sources exactly the target parents per split.

    Pair counts by source combination fix the smallest feasible number of same-source pairs; the
    lowest-hash recipes then fill each quota. A group that cannot be filled has no rows here and a row in
    ``canary_problems``; ``require_canary`` makes it an error.
    """
    typed, quotas = _canary_quotas(mixed, parents, targets)
    quotas = quotas.where(F.col("same").isNotNull()).select("language", "split", "same", "target")
    ranked = hash_rank(
        typed.where("category <> 'third_source'"), ["language", "split", "category"], stable_hash(seed + 41, "recipe_id"),
        [F.col("recipe_id")], rank="_r",
    )
    quota = F.when(F.col("category") == "cross", F.col("target") - 2 * F.col("same")).otherwise(F.col("same"))
    return (
        ranked.join(quotas, ["language", "split"]).where(F.col("_r") <= quota)
        .select("recipe_id", "language", "split", "category")
    )


def canary_problems(mixed: DataFrame, parents: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """Why a balanced selection cannot be made: one row per (language, split, violation), with the pairs there are.

    ``not_two_sources``: the language has fewer or more; ``third_source_pairs``: pairs with a source that is neither
    the first nor the last, which no quota can take; ``no_balanced_selection``: no number of same-source pairs fits.
    """
    _, quotas = _canary_quotas(mixed, parents, targets)
    found = F.array_compact(F.array(
        F.when(F.col("sources") != 2, "not_two_sources"), F.when(F.col("third_source") > 0, "third_source_pairs"),
        F.when(F.col("same").isNull(), "no_balanced_selection"),
    ))
    return quotas.select(
        "language", "split", F.explode(found).alias("violation"), "target", "same_first", "same_second", "cross", "third_source"
    )


def require_canary(pairs: DataFrame, problems: DataFrame) -> DataFrame:
    """The selection, or an error if any group cannot be filled."""
    told = F.concat(F.lit("no balanced canary: "), F.first("violation"), F.lit(" in "), F.first("language"), F.lit(":"), F.first("split"))
    check = problems.agg(F.when(F.count(F.lit(1)) > 0, F.raise_error(told)).cast("string").alias("_problem"))
    return with_scalars(pairs, check).where(F.col("_problem").isNull()).drop("_problem")


def canary_imbalance(pairs: DataFrame, mixed: DataFrame, parents: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """(source, language, split, parents, target) where the parents of the chosen pairs are not the target; empty if balanced."""
    chosen = mixed.join(pairs.select("recipe_id"), "recipe_id", "left_semi").select(
        "split", F.explode("parent_ids").alias("parent_id")
    ).distinct()
    counted = chosen.join(parents.select("parent_id", "source", "language"), "parent_id").groupBy("language", "source", "split").agg(
        F.count(F.lit(1)).alias("parents")
    )
    wanted = F.array(*[F.struct(F.lit(k).alias("split"), F.lit(int(n)).alias("target")) for k, n in targets.items()])
    every = parents.select("language", "source").distinct().select("language", "source", F.inline(wanted))
    joined = every.join(counted, ["language", "source", "split"], "left").fillna(0, ["parents"])
    return joined.where("parents <> target").select("language", "source", "split", "parents", "target")


def recipe_closure(recipes: DataFrame, parent_ids: DataFrame, mixed_ids: DataFrame) -> DataFrame:
    """Recipes of the chosen single parents plus the chosen mixed recipes."""
    single = recipes.where(F.col("kind") != "mixed_document").withColumn(
        "parent_id", F.col("parent_ids").getItem(0)
    )
    kept = single.join(parent_ids, "parent_id", "left_semi").drop("parent_id")
    return kept.unionByName(recipes.join(mixed_ids, "recipe_id", "left_semi"))


def failure_stop(rows: DataFrame, *, maximum_rate: float) -> DataFrame:
    """First row, in recipe order, at which failures exceed the allowed share of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    failed = rows.where(F.col("status") == "failed").select("recipe_id")
    ran = with_running(in_ranges(failed, [], ["recipe_id"]), [], F.col(RANGE), [F.col("recipe_id")], rank="failures")
    over = with_scalars(ran, total).where(F.col("failures") / F.col("total") > maximum_rate)
    return over.agg(
        F.min_by("recipe_id", "failures").alias("recipe_id"),
        F.min("failures").alias("failures"),
        F.min("total").alias("total"),
    ).where(F.col("recipe_id").isNotNull())
