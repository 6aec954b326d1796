"""Training batches: whole-parent packing, pair counts and masks, consistency pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SCHEME_CODES
from .ordered import in_ranges


def training_rows(df: DataFrame, *, excluded_families: Sequence[str] = ()) -> DataFrame:
    """Single-parent train and dev rows outside the excluded families."""
    if not set(excluded_families) <= set(SCHEME_CODES):
        raise ValueError("unsupported family excluded")
    family = F.col("watermark_family")
    keep = family.isNull() | ~family.isin(*excluded_families) if excluded_families else F.lit(True)
    return df.where(keep & (F.size("parent_ids") == 1) & F.col("split").isin("train", "dev"))


def example_columns(df: DataFrame, *, language_codes: Sequence[str] = ("en", "zh")) -> DataFrame:
    """Binary label, scheme and language codes, and the quality weight (weak boundaries count half)."""
    scheme = F.lit(0)
    for name, code in SCHEME_CODES.items():
        scheme = F.when(F.col("watermark_family") == name, code).otherwise(scheme)
    language = F.array_position(F.array(*[F.lit(x) for x in language_codes]), F.col("language")) - 1
    return df.withColumns(
        {
            "watermark_label": F.col("watermark_family").isNotNull().cast("double"),
            "scheme_label": scheme.cast("int"),
            "language_label": F.when(language >= 0, language).cast("int"),
            "quality_weight": F.when(F.col("boundary_quality") == "weak", 0.5).otherwise(1.0),
        }
    )


def intervention_id() -> Column:
    return F.coalesce("attack_id", "watermark_family", F.lit("clean"))


def pack_batches(
    rows: DataFrame, *, capacity: int = 20, per_shard: int = 16, split: str = "split",
    parent: str = "parent_id",
) -> DataFrame:
    """Batch and shard number per parent: whole parents in id order, a new batch when the next overflows.

    The fill level of the open batch is the only state, so it has ``capacity + 1`` values. Every ordered
    bucket of parents is first run once from each of them (its transition), the transitions are chained
    per split, and each bucket is then replayed from its true start. That gives exactly the sequential
    result without any task seeing a whole split.
    """
    sizes = rows.groupBy(split, parent).agg(F.count(F.lit(1)).cast("int").alias("size"))
    too_big = F.raise_error(F.concat(F.lit("parent group exceeds the batch size: "), F.col(parent))).cast("int")
    sizes = sizes.withColumn("size", F.when(F.col("size") > capacity, too_big).otherwise(F.col("size")))
    keyed = in_ranges(sizes, [split], [parent], "_bucket")
    kind = rows.schema[split].dataType.simpleString()
    parent_kind = rows.schema[parent].dataType.simpleString()

    def transition(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(parent)["size"].tolist()
        out = []
        for start in range(capacity + 1):
            fill, opened = start, 0
            for size in ordered:
                if fill + size > capacity:
                    fill, opened = 0, opened + 1
                fill += size
            out.append((pdf[split].iloc[0], int(pdf["_bucket"].iloc[0]), start, fill, opened))
        return pd.DataFrame(out, columns=[split, "_bucket", "start", "fill", "opened"])

    table = keyed.groupBy(split, "_bucket").applyInPandas(
        transition, f"{split} {kind}, _bucket int, start int, fill int, opened int"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        # At most ranges x (capacity + 1) rows per split, whatever the number of parents.
        step = {(b, s): (f, o) for b, s, f, o in zip(pdf["_bucket"], pdf["start"], pdf["fill"], pdf["opened"], strict=True)}
        fill, batch, out = 0, 0, []
        for bucket in sorted(set(pdf["_bucket"])):
            out.append((pdf[split].iloc[0], int(bucket), fill, batch))
            fill, opened = step[(bucket, fill)]
            batch += opened
        return pd.DataFrame(out, columns=[split, "_bucket", "fill0", "batch0"])

    starts = table.groupBy(split).applyInPandas(chain, f"{split} {kind}, _bucket int, fill0 int, batch0 int")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(parent)
        fill, batch = int(ordered["fill0"].iloc[0]), int(ordered["batch0"].iloc[0])
        ids = []
        for size in ordered["size"]:
            if fill + size > capacity:
                fill, batch = 0, batch + 1
            fill += size
            ids.append(batch)
        return pd.DataFrame({split: ordered[split], parent: ordered[parent], "batch_id": ids})

    packed = keyed.join(starts, [split, "_bucket"]).groupBy(split, "_bucket").applyInPandas(
        replay, f"{split} {kind}, {parent} {parent_kind}, batch_id int"
    )
    return packed.withColumn("shard", F.floor(F.col("batch_id") / per_shard).cast("int"))


def pair_diagnostics(df: DataFrame, by: Sequence[str] = (), *, parent: str = "parent_id") -> DataFrame:
    """Counts of positive and negative ordered pairs from group sizes alone; no pair is built.

    Positive: same parent, different intervention. Negative: different parents.
    """
    cells = df.groupBy(*by, parent, "intervention_id").agg(F.count(F.lit(1)).alias("_c"))
    parents = cells.groupBy(*by, parent).agg(
        F.sum("_c").alias("_g"), F.sum(F.col("_c") * F.col("_c")).alias("_same")
    )
    return parents.groupBy(*by).agg(
        F.sum("_g").cast("bigint").alias("examples"),
        F.count(F.lit(1)).alias("parent_groups"),
        F.sum(F.col("_g") * F.col("_g") - F.col("_same")).cast("bigint").alias("positive_pairs"),
        (F.sum("_g") * F.sum("_g") - F.sum(F.col("_g") * F.col("_g"))).cast("bigint").alias("negative_pairs"),
        F.count_if(F.col("_g") == 1).alias("singleton_groups"),
    )


def pair_masks(batched: DataFrame, by: Sequence[str], *, parent: str = "parent_id", key: str = "recipe_id") -> DataFrame:
    """Pair masks and weights of every example against its batch, in example-id order.

    A batch holds at most its capacity of examples, which bounds both the list and the arrays.
    """
    whole = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mates = F.collect_list(
        F.struct(F.col(key).alias("k"), F.col(parent).alias("p"), F.col("intervention_id").alias("i"),
                 F.col("quality_weight").alias("w"))
    ).over(whole)
    staged = batched.withColumn("_mates", mates)
    self_ = lambda m: m["k"] == F.col(key)
    return staged.withColumns(
        {
            "positive_mask": F.transform(
                "_mates",
                lambda m: (m["p"] == F.col(parent)) & (m["i"] != F.col("intervention_id")) & ~self_(m),
            ),
            "negative_mask": F.transform("_mates", lambda m: m["p"] != F.col(parent)),
            "pair_weights": F.transform("_mates", lambda m: F.sqrt(m["w"] * F.col("quality_weight"))),
        }
    ).drop("_mates")


def consistency_pairs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attack rows whose base row lies in the same batch or split."""
    base = df.select(*by, F.col("recipe_id").alias("base_recipe_id"))
    return df.where(F.col("base_recipe_id").isNotNull()).join(base, [*by, "base_recipe_id"], "inner").select(
        *by, "base_recipe_id", "recipe_id"
    )
