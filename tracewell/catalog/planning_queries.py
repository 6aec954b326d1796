"""Planning, assembly, batching and audit queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import content_hash, stable_hash
from ..functions.text import collapse_whitespace, truncate_fraction
from ..operators import assembly, batching, digest, planning
from ..operators.ordered import hash_rank
from ..plans import corpus
from ..schemas import DOCUMENT, SEED
from ..session import shared_dir
from ..sources import features, tables
from .oracle import WS, cte, query
from .registry import register


def big(name, alias=None):
    return F.col(name).cast("bigint").alias(alias or name)


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def docs_as_parents(spark, sf):
    return corpus.read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("parent_id"), "text", "source", F.col("lang").alias("language"),
        F.col("doc_id").alias("source_line"),
    )


@register("s1_jsonl_scan", "SELECT doc_id, lang, n_chars, source, sha256(text) AS text_sha256 FROM documents")
def s1(spark, sf):
    path = fresh(spark, "jsonl")
    tables.write_jsonl(corpus.read(spark, sf, "documents"), path)
    back = tables.read_jsonl(spark, path, DOCUMENT)
    return back.select("doc_id", "lang", "n_chars", "source", F.sha2("text", 256).alias("text_sha256"))


@register(
    "s2_jsonl_sink",
    "SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})::VARCHAR AS line FROM documents",
)
def s2(spark, sf):
    path = fresh(spark, "jsonl")
    tables.write_jsonl(corpus.read(spark, sf, "documents").drop("text"), path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"), F.col("value").alias("line"))


@register("s3_file_manifest")
def s3(spark, sf):
    return tables.file_manifest(spark, sf, "*.parquet").select("file", "bytes", "sha256")


@register(
    "s3_text_manifest",
    """
SELECT lang, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256
FROM (SELECT doc_id, lang, doc_id || chr(9) || replace(replace(text, chr(10), ' '), chr(13), ' ') AS line FROM documents) GROUP BY lang
""",
)
def s3_text(spark, sf):
    """The texts of each language written as one file of lines in order of their ids, and the manifest of these files."""
    path = fresh(spark, "lines")
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    lines = corpus.read(spark, sf, "documents").select("lang", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), text).alias("value"))
    lined = lines.repartition("lang").sortWithinPartitions("lang", "doc_id")
    lined.select("lang", "value").write.partitionBy("lang").text(path)
    found = tables.file_manifest(spark, path, "part-*")
    return found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), "bytes", "sha256")


@register(
    "s4_failure_export",
    query("SELECT recipe_id, kind, split, source, language, watermark_family, key_id, attack_id, failure_type, "
          "failure_message FROM d_rows WHERE status = 'failed'"),
)
def s4(spark, sf):
    path = fresh(spark, "failures")
    failed = assembly.failure_table(corpus.rows(spark, sf))
    tables.write_csv(failed, path)
    return spark.read.schema(failed.schema).option("header", True).csv(path)


@register(
    "s5_feature_store",
    """
SELECT vec_id, CASE WHEN list_contains(list_transform(embedding, lambda x: isfinite(x)), false) THEN 'not_finite' ELSE 'ok' END AS violation,
  len(list_filter(embedding, lambda x: x > -0.1::FLOAT AND x < 0.1::FLOAT))::BIGINT AS joint_valid FROM embeddings
""",
)
def s5(spark, sf):
    vec = corpus.read(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("view"),
        F.transform("embedding", lambda x: x > F.lit(-0.1).cast("float")).alias("mask_a"),
        F.transform("embedding", lambda x: x < F.lit(0.1).cast("float")).alias("mask_b"),
    )
    out = tables.check_features(vec, ["view"], ["mask_a", "mask_b"])
    return out.select(
        "vec_id", F.coalesce("violation", F.lit("ok")).alias("violation"),
        F.size(F.filter("joint_mask", lambda m: m)).cast("bigint").alias("joint_valid"),
    )


@register(
    "s5_stored_features",
    """
SELECT vec_id, CASE vec_id % 50 WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'inconsistent_offsets' WHEN 3 THEN 'hash_mismatch'
    WHEN 4 THEN 'not_aligned' WHEN 5 THEN 'missing' ELSE 'ok' END AS violation,
  CASE vec_id % 50 WHEN 5 THEN -1 ELSE (SELECT count(*) FROM range(8) AS r(i)
    WHERE embedding[i * 8 + 1] > -0.1::FLOAT AND embedding[i * 8 + 5] < 0.1::FLOAT AND (vec_id % 50 <> 4 OR i < 7)) END AS valid_tokens
FROM embeddings
""",
)
def s5_stored(spark, sf):
    """Two views of 8 tokens, saved and read back; some documents are damaged, saved askew, wrongly listed or lost."""
    part = lambda first, size: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + first, size))
    at = lambda offset: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(i * 10, i * 10 + 9 + offset))
    case = F.col("vec_id") % 50
    mask_b = F.transform(F.sequence(F.lit(0), F.when(case == 4, F.lit(6)).otherwise(F.lit(7))), lambda i: F.get("embedding", i * 8 + 4) < F.lit(0.1).cast("float"))
    docs = corpus.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("document_id"), part(1, 4).alias("a_values"), part(5, 4).alias("b_values"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("embedding", i * 8) > F.lit(-0.1).cast("float")).alias("a_mask"),
        mask_b.alias("b_mask"), at(F.lit(0)).alias("a_offsets"), at(F.when(case == 2, F.lit(1)).otherwise(F.lit(0))).alias("b_offsets"),
    )
    path, views = fresh(spark, "features"), ["a", "b"]
    listed = features.save_features(docs, path, views)
    stored = spark.read.parquet(path)
    kind = F.col("document_id") % 50
    worse = F.transform("a_values", lambda row, i: F.when(i == 0, F.transform(row, lambda x: x + F.lit(1).cast("float"))).otherwise(row))
    damaged = stored.where(kind != 5).withColumn("a_values", F.when(kind == 1, worse).otherwise(F.col("a_values")))
    damaged.write.parquet(f"{path}-damaged")
    wrong = listed.withColumn("feature_sha256", F.when(kind == 3, F.sha2("feature_sha256", 256)).otherwise(F.col("feature_sha256")))
    out = features.load_features(spark, f"{path}-damaged", wrong, views)
    return out.select(
        F.col("document_id").alias("vec_id"), F.coalesce("violation", F.lit("ok")).alias("violation"),
        F.coalesce(F.size(F.filter("valid_mask", lambda m: m)), F.lit(-1)).cast("bigint").alias("valid_tokens"),
    )


@register(
    "p1_eligibility",
    "SELECT doc_id::VARCHAR AS parent_id, length(text)::BIGINT AS n FROM documents WHERE length(text) >= 1000",
)
def p1(spark, sf):
    kept = planning.eligible(docs_as_parents(spark, sf), minimum=1000)
    return kept.select("parent_id", F.length("text").cast("bigint").alias("n"))


@register(
    "p2_source_projection",
    "SELECT doc_id::VARCHAR AS parent_id, sha256(text) AS source_text_sha256, sha256(left(text, 600)) AS text_sha256, "
    "length(left(text, 600))::BIGINT AS kept, doc_id AS source_line FROM documents",
)
def p2(spark, sf):
    out = planning.source_projection(docs_as_parents(spark, sf), maximum=600)
    return out.select(
        "parent_id", "source_text_sha256", "text_sha256", F.length("text").cast("bigint").alias("kept"), "source_line"
    )


@register(
    "p3_text_attacks",
    f"""
SELECT doc_id, sha256(left(text, greatest(1, floor(length(text) * 0.75::DOUBLE))::INT)) AS truncated,
  sha256(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS edited FROM documents
""",
)
def p3(spark, sf):
    return corpus.read(spark, sf, "documents").select(
        "doc_id", F.sha2(truncate_fraction("text", 0.75), 256).alias("truncated"),
        F.sha2(collapse_whitespace("text"), 256).alias("edited"),
    )


@register(
    "p4_attack_rows",
    query("SELECT recipe_id, status, coalesce(text_sha256, '') AS text_sha256, len(spans)::BIGINT AS intervals, "
          "coalesce(spans[1].e, -1)::BIGINT AS first_end FROM d_rows WHERE kind = 'matched_attack'"),
)
def p4(spark, sf):
    rows = corpus.rows(spark, sf).where("kind = 'matched_attack'")
    end = F.coalesce(F.try_element_at("watermark_intervals", F.lit(1))["char_end"], F.lit(-1))
    return rows.select(
        "recipe_id", "status", F.coalesce("text_sha256", F.lit("")).alias("text_sha256"),
        F.size("watermark_intervals").cast("bigint").alias("intervals"), end.cast("bigint").alias("first_end"),
    )


@register(
    "p5_adjacent_composition",
    query("SELECT recipe_id, language, text_sha256, spans[1].s::BIGINT AS s1, spans[1].e::BIGINT AS e1, spans[2].s::BIGINT AS s2, "
          "spans[2].e::BIGINT AS e2, array_to_string(key_ids, ',') AS key_ids FROM d_rows WHERE kind = 'mixed_document'"),
)
def p5(spark, sf):
    rows = corpus.rows(spark, sf).where("kind = 'mixed_document'")
    at = lambda i, f, a: F.col("watermark_intervals").getItem(i)[f].cast("bigint").alias(a)
    return rows.select(
        "recipe_id", "language", "text_sha256", at(0, "char_start", "s1"), at(0, "char_end", "e1"),
        at(1, "char_start", "s2"), at(1, "char_end", "e2"), F.array_join("key_ids", ",").alias("key_ids"),
    )


def seed_sql(payload: str) -> str:
    return f"('0x' || substr(sha256({payload}), 9, 8))::BIGINT & 2147483647"


@register(
    "p6_generation_seeds",
    query("SELECT recipe_id, " + seed_sql("""'{"recipe_id":"' || recipe_id || '","seed":20260815}'""") + " AS first_seed, "
          + seed_sql("""'{"recipe_id":"' || recipe_id || '","retry_index":1,"seed":20260815}'""") + " AS retry_seed FROM d_recipes"),
)
def p6(spark, sf):
    return corpus.recipes(spark, sf).select(
        "recipe_id", planning.generation_seed("seed", "recipe_id").alias("first_seed"),
        planning.generation_seed("seed", "recipe_id", 1).alias("retry_seed"),
    )


@register(
    "p6_component_seeds",
    query("SELECT recipe_id, i::BIGINT AS component, " + seed_sql(
        """'{"component_index":' || i || ',"key_id":"' || key_ids[i + 1] || '","recipe_id":"' || recipe_id || '","seed":20260815}'""")
        + " AS component_seed FROM d_rows, range(2) AS r(i) WHERE kind = 'mixed_document'"),
)
def p6b(spark, sf):
    parts = corpus.rows(spark, sf).where("kind = 'mixed_document'").select(
        "recipe_id", "seed", F.posexplode("key_ids").alias("i", "key_id")
    )
    value = planning.component_seed(F.col("seed"), F.col("recipe_id"), F.col("i"), F.col("key_id"))
    return parts.select("recipe_id", big("i", "component"), value.alias("component_seed"))


@register(
    "p7_feature_documents",
    query("SELECT recipe_id, kind, split FROM d_rows WHERE status = 'generated' AND NOT (kind = 'mixed_document' AND split = 'train')"),
)
def p7(spark, sf):
    return assembly.feature_documents(corpus.rows(spark, sf)).select("recipe_id", "kind", "split")


@register(
    "p8_split_seal",
    query("SELECT split, count(*) AS rows FROM d_rows WHERE split NOT IN ('train', 'dev') GROUP BY ALL"),
)
def p8(spark, sf):
    return assembly.split_seal(corpus.rows(spark, sf), ["train", "dev"])


@register(
    "p15_split_populations",
    query("""
SELECT 'calibration' AS population, language, count(*) AS rows, count(DISTINCT parent_ids[1]) AS parents FROM d_rows
WHERE status = 'generated' AND split = 'calibration' AND watermark_family IS NULL AND len(parent_ids) = 1 GROUP BY ALL
UNION ALL SELECT 'test', language, count(DISTINCT recipe_id), count(DISTINCT p) FROM (
  SELECT language, recipe_id, unnest(parent_ids) AS p FROM d_rows WHERE status = 'generated' AND split = 'test') GROUP BY ALL
"""),
)
def p15(spark, sf):
    rows = corpus.rows(spark, sf).where("status = 'generated'")
    null = (F.col("split") == "calibration") & F.col("watermark_family").isNull() & (F.size("parent_ids") == 1)
    test = F.col("split") == "test"
    both = rows.where(null | test).select(
        F.when(null, "calibration").otherwise("test").alias("population"), "language", "recipe_id",
        F.explode("parent_ids").alias("parent_id"),
    )
    return both.groupBy("population", "language").agg(
        F.countDistinct("recipe_id").alias("rows"), F.countDistinct("parent_id").alias("parents")
    )


@register(
    "p16_intervention_ids",
    query("SELECT coalesce(attack_id, watermark_family, 'clean') AS intervention, count(*) AS n FROM d_rows GROUP BY ALL"),
)
def p16(spark, sf):
    return corpus.rows(spark, sf).groupBy(batching.intervention_id().alias("intervention")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "p17_training_examples",
    query("""
SELECT recipe_id, (watermark_family IS NOT NULL)::DOUBLE AS watermark_label,
  coalesce(list_position(['kgw', 'unigram', 'unbiased', 'synthid'], watermark_family) - 1, 0)::INT AS scheme_label,
  (list_position(['en', 'de', 'es', 'fr'], language) - 1)::INT AS language_label,
  CASE WHEN boundary_quality = 'weak' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS quality_weight
FROM d_rows WHERE split IN ('train', 'dev') AND len(parent_ids) = 1
"""),
)
def p17(spark, sf):
    rows = batching.training_rows(corpus.rows(spark, sf))
    return batching.example_columns(rows, language_codes=("en", "de", "es", "fr")).select(
        "recipe_id", "watermark_label", "scheme_label", "language_label", "quality_weight"
    )


@register(
    "p17_padded_views",
    "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 5) AS cut_sum, "
    "96::BIGINT AS padded FROM embeddings",
)
def p17b(spark, sf):
    vec = corpus.read(spark, sf, "embeddings")
    zero = F.lit(0.0).cast("float")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))
    return vec.select(
        "vec_id", F.size("embedding").cast("bigint").alias("n"),
        F.round(total(tables.pad(F.col("embedding"), 48, zero)), 5).alias("cut_sum"),
        F.size(tables.pad(F.col("embedding"), 96, zero)).cast("bigint").alias("padded"),
    )


@register(
    "j1_assembly_check",
    query("""
SELECT violation, count(*) AS n FROM (SELECT CASE WHEN status = 'generated' AND sha256(recipe_id) < '2' THEN 'text_hash_mismatch'
  WHEN sha256(recipe_id) >= 'f' THEN 'missing_row' ELSE 'ok' END AS violation FROM d_rows) GROUP BY ALL
"""),
)
def j1(spark, sf):
    # A sixteenth of the rows withheld and an eighth of the texts altered: both must surface.
    rows = corpus.derive_rows(spark, sf)
    mark = F.sha2("recipe_id", 256)
    damaged = rows.where(mark < "f").withColumn("text", F.when(mark < "2", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return assembly.violation_counts(assembly.check_rows(corpus.recipes(spark, sf), damaged))


@register("j1_assembly_clean", query("SELECT 'ok' AS violation, count(*) AS n FROM d_rows"))
def j1b(spark, sf):
    return assembly.violation_counts(assembly.check_rows(corpus.recipes(spark, sf), corpus.derive_rows(spark, sf)))


@register(
    "j2_orphan_attacks",
    query("SELECT recipe_id, base_recipe_id FROM d_attack WHERE base_variant = 'kgw'"),
)
def j2(spark, sf):
    plan = corpus.recipes(spark, sf)
    base = plan.where((F.col("kind") == "base_generation") & (F.col("base_variant") != "kgw"))
    return assembly.orphan_attacks(plan, base)


@register(
    "j3_exclusion",
    "SELECT doc_id::VARCHAR AS parent_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def j3(spark, sf):
    used = corpus.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("parent_id"))
    return planning.exclude_parents(docs_as_parents(spark, sf).select("parent_id"), used)


@register(
    "j9_retry_reconciliation",
    query("""
SELECT recipe_id, CASE WHEN status = 'failed' AND attack_id = 'paraphrase' THEN 'generated' ELSE status END AS status,
  CASE WHEN status = 'failed' AND attack_id = 'paraphrase' THEN failure_type END AS initial_failure,
  CASE WHEN status = 'failed' AND attack_id <> 'paraphrase' THEN 'RetryFailed' END AS retry_failure FROM d_rows
"""),
)
def j9(spark, sf):
    rows = corpus.rows(spark, sf)
    won = F.col("attack_id") == "paraphrase"
    retry = rows.where("status = 'failed'").withColumns(
        {
            "status": F.when(won, "generated").otherwise("failed"),
            "text": F.when(won, F.col("recipe_id")),
            "text_sha256": F.when(won, F.sha2("recipe_id", 256)),
            "failure_type": F.when(won, F.lit(None).cast("string")).otherwise("RetryFailed"),
        }
    )
    out = assembly.reconcile_retry(rows, retry)
    return out.select(
        "recipe_id", "status", F.col("initial_failure.failure_type").alias("initial_failure"),
        F.col("retry_failure.failure_type").alias("retry_failure"),
    )


@register(
    "j15_manifest_enrichment",
    query("SELECT recipe_id, kind, base_recipe_id FROM d_rows WHERE status = 'generated'"),
)
def j15(spark, sf):
    rows = corpus.rows(spark, sf)
    features = rows.where("status = 'generated'").select("recipe_id", "split")
    return assembly.enrich_features(features, rows).select("recipe_id", "kind", "base_recipe_id")


@register(
    "j16_resume_pending",
    query("SELECT recipe_id FROM d_rows WHERE status = 'failed'"),
)
def j16(spark, sf):
    done = corpus.rows(spark, sf).where("status = 'generated'")
    return assembly.pending(corpus.recipes(spark, sf), done).select("recipe_id")


@register(
    "j16_resume_violations",
    query("SELECT recipe_id, 'changed_split' AS violation FROM d_rows WHERE status = 'generated' AND split = 'dev' AND kind <> 'mixed_document' "
          "UNION ALL SELECT recipe_id, 'not_selected' FROM d_rows WHERE status = 'generated' AND kind = 'mixed_document'"),
)
def j16b(spark, sf):
    done = corpus.derive_rows(spark, sf).where("status = 'generated'")
    plan = corpus.recipes(spark, sf).where("kind <> 'mixed_document'").withColumn(
        "split", F.when(F.col("split") == "dev", "test").otherwise(F.col("split"))
    )
    broken = assembly.resume_violations(plan, done, ["split", "language", "parent_ids"])
    return broken


@register(
    "j16_readopt_outputs",
    """SELECT vec_id::VARCHAR AS recipe_id, CASE WHEN label = 9 THEN 'unknown_id' ELSE 'adopted' END AS outcome
FROM embeddings WHERE label > 2""",
)
def j16c(spark, sf):
    outputs = corpus.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("recipe_id"), F.col("embedding").alias("values"), "label")
    # The manifest already lists the outputs of labels 0 to 2; label 9 was never selected.
    return assembly.readopt(outputs.drop("label"), outputs.where("label <= 2"), outputs.where("label <> 9"))


@register(
    "j17_seed_from_subset",
    query("""SELECT recipe_id, CASE WHEN split = 'train' THEN 'reused' WHEN split = 'dev' THEN 'text_changed' ELSE 'not_in_full_set' END AS outcome
FROM d_rows WHERE status = 'generated'"""),
)
def j17(spark, sf):
    canary = corpus.rows(spark, sf).where("status = 'generated'").select("recipe_id", "split", "text_sha256")
    full = canary.where("split in ('train', 'dev')").withColumn(
        "text_sha256", F.when(F.col("split") == "dev", F.sha2("text_sha256", 256)).otherwise(F.col("text_sha256"))
    )
    return assembly.seed_from_subset(full, canary)


@register(
    "j10_pair_diagnostics",
    query("""
SELECT split, sum(g)::BIGINT AS examples, count(*) AS parent_groups, sum(pos)::BIGINT AS positive_pairs,
  (sum(g) * sum(g) - sum(g * g))::BIGINT AS negative_pairs, count(*) FILTER (g = 1) AS singleton_groups
FROM (SELECT split, parent_ids[1] AS p, count(*) AS g, count(*) * count(*) - list_sum(list_transform(
    map_values(histogram(coalesce(attack_id, watermark_family, 'clean'))), lambda x: x * x)) AS pos
  FROM d_rows WHERE status = 'generated' AND split IN ('train', 'dev') AND len(parent_ids) = 1 GROUP BY ALL) GROUP BY split
"""),
)
def j10(spark, sf):
    rows = batching.training_rows(corpus.rows(spark, sf).where("status = 'generated'")).withColumns(
        {"parent_id": F.col("parent_ids").getItem(0), "intervention_id": batching.intervention_id()}
    )
    return batching.pair_diagnostics(rows, ["split"])


@register(
    "j11_consistency_pairs",
    query("""SELECT a.split, a.base_recipe_id, a.recipe_id FROM d_rows a JOIN d_rows b ON b.recipe_id = a.base_recipe_id AND b.split = a.split
WHERE a.status = 'generated' AND b.status = 'generated' AND a.split IN ('train', 'dev') AND coalesce(a.watermark_family, '') <> 'kgw'
  AND len(a.parent_ids) = 1"""),
)
def j11(spark, sf):
    rows = batching.training_rows(corpus.rows(spark, sf).where("status = 'generated'"), excluded_families=["kgw"])
    return batching.consistency_pairs(rows.select("split", "recipe_id", "base_recipe_id"), ["split"])


def packed(spark, sf, buckets=8):
    rows = batching.training_rows(corpus.rows(spark, sf).where("status = 'generated'")).withColumns(
        {"parent_id": F.col("parent_ids").getItem(0), "intervention_id": batching.intervention_id()}
    )
    rows = batching.example_columns(rows, language_codes=("en", "de", "es", "fr"))
    return rows, batching.pack_batches(rows)


PACK_HEAD = """,
sizes AS MATERIALIZED (SELECT split, parent_ids[1] AS parent_id, count(*) AS size,
  row_number() OVER (PARTITION BY split ORDER BY parent_ids[1]) AS rn FROM d_rows
  WHERE status = 'generated' AND split IN ('train', 'dev') AND len(parent_ids) = 1 GROUP BY split, parent_ids[1]),
fold AS (SELECT split, parent_id, rn, size AS fill, 0::BIGINT AS batch_id FROM sizes WHERE rn = 1
  UNION ALL SELECT s.split, s.parent_id, s.rn, CASE WHEN f.fill + s.size > 20 THEN s.size ELSE f.fill + s.size END,
    CASE WHEN f.fill + s.size > 20 THEN f.batch_id + 1 ELSE f.batch_id END
  FROM fold f JOIN sizes s ON s.split = f.split AND s.rn = f.rn + 1)
"""


def recursive(select: str) -> str:
    base = query("SELECT * FROM d_rows WHERE 1 = 1")
    head = base.rsplit("\nSELECT * FROM d_rows", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1)
    return head + PACK_HEAD + select


@register("w13_batch_packing", recursive("SELECT split, parent_id, batch_id, batch_id // 16 AS shard FROM fold"))
def w13(spark, sf):
    _, batches = packed(spark, sf)
    return batches.select("split", "parent_id", big("batch_id"), big("shard"))


@register(
    "s7_shard_index",
    recursive("SELECT f.split, f.batch_id // 16 AS shard, count(DISTINCT f.batch_id) AS batches, sum(s.size)::BIGINT AS examples "
              "FROM fold f JOIN sizes s ON s.split = f.split AND s.parent_id = f.parent_id GROUP BY ALL"),
)
def s7(spark, sf):
    rows, batches = packed(spark, sf)
    path = fresh(spark, "batches")
    examples = rows.select("split", "parent_id", "recipe_id", "watermark_label", "quality_weight")
    tables.write_batches(examples.join(batches, ["split", "parent_id"]), path)
    index = tables.shard_index(tables.read_batches(spark, path))
    return index.select("split", big("shard"), "batches", "examples")


@register(
    "s7_shard_drift",
    recursive("""
SELECT DISTINCT f.split, (f.batch_id // 16)::BIGINT AS shard FROM fold f JOIN d_rows r ON f.split = r.split AND f.parent_id = r.parent_ids[1]
WHERE r.status = 'generated' AND len(r.parent_ids) = 1 AND ends_with(r.recipe_id, '7')"""),
)
def s7_drift(spark, sf):
    """Shards whose index no longer fits a copy in which some examples got another id."""
    rows, batches = packed(spark, sf)
    path = fresh(spark, "batches")
    tables.write_batches(rows.select("split", "parent_id", "recipe_id").join(batches, ["split", "parent_id"]), path)
    stored = tables.read_batches(spark, path)
    renamed = F.when(F.col("recipe_id").endswith("7"), F.concat("recipe_id", F.lit("x"))).otherwise(F.col("recipe_id"))
    tables.write_batches(stored.withColumn("recipe_id", renamed), f"{path}-copy")
    drift = tables.shard_drift(tables.shard_index(stored), tables.read_batches(spark, f"{path}-copy"))
    return drift.select("split", big("shard"))


@register(
    "j10_pair_masks",
    recursive("""
SELECT r.recipe_id, (count(*) FILTER (o.parent_ids[1] = r.parent_ids[1] AND o.recipe_id <> r.recipe_id
   AND coalesce(o.attack_id, o.watermark_family, 'clean') <> coalesce(r.attack_id, r.watermark_family, 'clean')))::BIGINT AS positives,
  (count(*) FILTER (o.parent_ids[1] <> r.parent_ids[1]))::BIGINT AS negatives,
  round(sum(sqrt(CASE WHEN r.boundary_quality = 'weak' THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN o.boundary_quality = 'weak' THEN 0.5::DOUBLE ELSE 1 END)), 9) AS weight
FROM (SELECT r.*, f.batch_id FROM d_rows r JOIN fold f ON f.split = r.split AND f.parent_id = r.parent_ids[1]
      WHERE r.status = 'generated' AND len(r.parent_ids) = 1) r
JOIN (SELECT r.*, f.batch_id FROM d_rows r JOIN fold f ON f.split = r.split AND f.parent_id = r.parent_ids[1]
      WHERE r.status = 'generated' AND len(r.parent_ids) = 1) o ON o.split = r.split AND o.batch_id = r.batch_id
GROUP BY r.recipe_id"""),
)
def j10b(spark, sf):
    rows, batches = packed(spark, sf)
    slim = rows.select("split", "parent_id", "recipe_id", "intervention_id", "quality_weight")
    masks = batching.pair_masks(slim.join(batches, ["split", "parent_id"]), ["split", "batch_id"])
    count = lambda c: F.size(F.filter(c, lambda x: x)).cast("bigint")
    return masks.select(
        "recipe_id", count("positive_mask").alias("positives"), count("negative_mask").alias("negatives"),
        F.round(F.aggregate("pair_weights", F.lit(0.0), lambda a, x: a + x), 9).alias("weight"),
    )


@register(
    "a1_split_audit",
    """
SELECT 'duplicate_text' AS violation, sha256(text) AS subject FROM documents GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'split_leak', source FROM documents GROUP BY ALL HAVING min(lang) <> max(lang)
""",
)
def a1(spark, sf):
    docs = corpus.read(spark, sf, "documents").select(
        F.col("source").alias("parent_id"), F.col("lang").alias("split"), F.sha2("text", 256).alias("text_sha256")
    )
    return planning.audit_splits(docs)


@register(
    "a1_split_summary",
    query("""
SELECT count(*) AS rows, count(DISTINCT parent_id) AS unique_parent_ids, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'dev') AS dev_rows, count(*) FILTER (split = 'calibration') AS calibration_rows,
  count(*) FILTER (split = 'test') AS test_rows, sha256(array_to_string([
  """ + ", ".join(f"sum(('0x' || substr(text_sha256, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8)) + """], ',')) AS content_digest
FROM d_parents
"""),
)
def a1b(spark, sf):
    return planning.split_summary(corpus.slotted_parents(spark, sf))


@register(
    "a1_ordered_digest",
    """
WITH RECURSIVE d AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS place, h, count(*) OVER (PARTITION BY lang) AS rows FROM (
    SELECT lang, doc_id, sha256(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(length(source) || ':' || source, '-') || coalesce(length(text) || ':' || text, '-')) AS h FROM documents)
), t AS (
  SELECT lang, place // 1024 AS place, rows, (rows + 1023) // 1024 AS n, sha256(string_agg(h, '' ORDER BY place)) AS h FROM d GROUP BY lang, place // 1024, rows
  UNION ALL SELECT lang, place // 1024, rows, (n + 1023) // 1024, sha256(string_agg(h, '' ORDER BY place)) FROM t WHERE n > 1
  GROUP BY lang, place // 1024, rows, n
)
SELECT lang, rows, h AS content_digest FROM t WHERE n = 1
""",
)
def a1_digest(spark, sf):
    """A digest per language of all its documents in order of their ids."""
    docs = corpus.read(spark, sf, "documents")
    return digest.ordered_digest(docs, ["doc_id"], digest.row_digest(*[F.col(c) for c in ("doc_id", "source", "text")]), ["lang"])


@register(
    "a2_recipe_counts",
    query("SELECT kind, split, source, count(*) AS n FROM d_recipes GROUP BY ALL"),
)
def a2(spark, sf):
    return corpus.recipes(spark, sf).groupBy("kind", "split", "source").agg(F.count(F.lit(1)).alias("n"))


@register(
    "a2_count_drift",
    query("SELECT split, count(*) AS observed, (count(*) // 2)::BIGINT AS expected FROM d_rows GROUP BY ALL"),
)
def a2b(spark, sf):
    rows = corpus.rows(spark, sf)
    half = rows.groupBy("split").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("expected"))
    return planning.count_drift(rows, half, ["split"])


@register(
    "a29_registry_audit",
    """
SELECT page_id::VARCHAR AS asset_id, 'invalid_repository_commit' AS violation FROM pages WHERE length(url) % 2 = 0
UNION ALL SELECT page_id::VARCHAR, 'unlicensed_repository_enabled' FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0
""",
)
def a29(spark, sf):
    pages = corpus.read(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("asset_id"), F.lit("repository").alias("kind"),
        F.when(F.length("url") % 2 == 0, F.lit("main")).otherwise(F.left(F.sha2("url", 256), F.lit(40))).alias("revision"),
        F.when(F.col("page_id") % 3 != 0, "mit").alias("license"),
        F.when(F.col("page_id") % 2 != 0, "disabled-by-default").alias("policy"), F.lit(False).alias("selected"),
    )
    return assembly.registry_violations(pages)


@register(
    "a30_asset_audit",
    "SELECT doc_id::VARCHAR AS asset_id, lang <> 'fr' AS ok FROM documents",
)
def a30(spark, sf):
    docs = corpus.read(spark, sf, "documents")
    asset = F.col("doc_id").cast("string").alias("asset_id")
    expected = docs.select(asset, F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    seen = F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    actual = docs.select(asset, F.sha2("text", 256).alias("sha256"), seen.alias("bytes"))
    return assembly.asset_check(expected, actual)


@register(
    "w1_bottom_k",
    """
SELECT source, doc_id::VARCHAR AS parent_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source
  ORDER BY sha256('20260815:' || doc_id), doc_id DESC) AS rank FROM documents WHERE n_chars >= 500) WHERE rank <= 8
""",
)
def w1(spark, sf):
    picked = planning.select_lowest(planning.eligible(docs_as_parents(spark, sf), minimum=500), count=8)
    return picked.select("source", "parent_id", big("rank"))


@register(
    "w2_split_slots",
    """
SELECT source, doc_id::VARCHAR AS parent_id, CASE WHEN rank <= 3 THEN 'train' WHEN rank <= 4 THEN 'dev' WHEN rank <= 6 THEN 'calibration' ELSE 'test' END AS split,
  (['train', 'train', 'train', 'train', 'dev', 'dev', 'calibration', 'test'])[rank] AS pilot_split
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('20260815:' || doc_id), doc_id DESC) AS rank
  FROM documents WHERE n_chars >= 500) WHERE rank <= 8
""",
)
def w2(spark, sf):
    picked = planning.select_lowest(planning.eligible(docs_as_parents(spark, sf), minimum=500), count=8)
    split = planning.split_by_rank(picked, {"train": 3, "dev": 1, "calibration": 2, "test": 2})
    return split.select("source", "parent_id", "split", planning.pilot_split(F.col("rank")).alias("pilot_split"))


@register("w2_split_by_share", query("SELECT parent_id, language, split, rank, total FROM d_split"))
def w2b(spark, sf):
    return corpus.parents(spark, sf).select("parent_id", "language", "split", "rank", "total")


@register(
    "w3_key_slots",
    query("SELECT parent_id, key_slot, CASE WHEN ('0x' || right(sha256('20260815:' || parent_id), 1))::BIGINT % 2 = 0 "
          "THEN 'a' ELSE 'b' END AS pilot_slot FROM d_parents"),
)
def w3(spark, sf):
    return planning.key_slots(corpus.parents(spark, sf)).select(
        "parent_id", "key_slot", planning.pilot_key_slot().alias("pilot_slot")
    )


@register(
    "w4_recipe_fanout",
    query("SELECT recipe_id, kind, split, source, base_variant, key_id, base_recipe_id, attack_id, boundary_quality "
          "FROM d_recipes WHERE kind <> 'mixed_document'"),
)
def w4(spark, sf):
    parents = corpus.slotted_parents(spark, sf)
    base = planning.base_recipes(parents)
    both = base.unionByName(planning.attack_recipes(base), allowMissingColumns=True)
    return both.select(
        "recipe_id", "kind", "split", "source", "base_variant", "key_id", "base_recipe_id", "attack_id", "boundary_quality"
    )


@register(
    "w4_pilot_attacks",
    query("""
SELECT 'attack-' || b.recipe_id AS recipe_id, (['paraphrase', 'translation_roundtrip', 'copy_edit', 'truncation'])[
  (((rn - 1) * 5 + list_position(['clean', 'kgw', 'unigram', 'unbiased', 'synthid'], base_variant) - 1) % 4 + 1)::INT] AS attack_id
FROM d_base b JOIN (SELECT parent_id, row_number() OVER (ORDER BY sha256('20260815:' || parent_id), parent_id) AS rn FROM d_parents) USING (parent_id)
"""),
)
def w4b(spark, sf):
    parents = corpus.slotted_parents(spark, sf)
    ranked = hash_rank(parents, [], stable_hash(SEED, "parent_id"), [F.col("parent_id")], rank="_n")
    base = planning.base_recipes(ranked)
    variants = F.array(*[F.lit(v) for v in ("clean", "kgw", "unigram", "unbiased", "synthid")])
    place = ranked.select("parent_id", "_n")
    indexed = base.withColumn("parent_id", F.col("parent_ids").getItem(0)).join(place, "parent_id").withColumn(
        "base_index", (F.col("_n") - 1) * 5 + F.array_position(variants, F.col("base_variant")) - 1
    )
    return planning.attack_recipes(indexed, pilot=True).select("recipe_id", "attack_id")


@register(
    "w5_mixed_pairs",
    query("SELECT recipe_id, split, language, p1, p2, f1, s1, f2, s2 FROM d_mixed"),
)
def w5(spark, sf):
    mixed = planning.mixed_recipes(corpus.slotted_parents(spark, sf), drop_odd=True)
    part = lambda i, f, a: F.col("components").getItem(i)[f].alias(a)
    return mixed.select(
        "recipe_id", "split", "language", F.col("parent_ids").getItem(0).alias("p1"), F.col("parent_ids").getItem(1).alias("p2"),
        part(0, "watermark_family", "f1"), part(0, "key_slot", "s1"), part(1, "watermark_family", "f2"), part(1, "key_slot", "s2"),
    )


cte(
    "d_halves",
    """
SELECT parent_id, language, split, key_slot, CASE WHEN ('0x' || right(sha256(parent_id), 1))::BIGINT % 2 = 0 THEN 'left' ELSE 'right' END AS source
FROM d_parents
""",
)


@register(
    "w11_balanced_canary",
    query("""
SELECT recipe_id, language, split, category FROM (
  SELECT t.*, q.same, q.target, row_number() OVER (PARTITION BY t.language, t.split, t.category ORDER BY sha256('20260856:' || recipe_id), recipe_id) AS rn
  FROM (SELECT recipe_id, m.language, m.split, CASE WHEN a.source = b.source AND a.source = 'left' THEN 'same_first'
      WHEN a.source = b.source THEN 'same_second' ELSE 'cross' END AS category
    FROM d_mixed m JOIN d_halves a ON a.parent_id = m.p1 JOIN d_halves b ON b.parent_id = m.p2 WHERE m.split IN ('train', 'dev')) t
  JOIN (SELECT language, split, target, list_filter(range(0, target // 2 + 1), lambda k: sf >= k AND ss >= k AND cr >= target - 2 * k)[1] AS same
    FROM (SELECT m.language, m.split, CASE m.split WHEN 'train' THEN 6 ELSE 2 END AS target,
        count(*) FILTER (a.source = 'left' AND b.source = 'left') AS sf, count(*) FILTER (a.source = 'right' AND b.source = 'right') AS ss,
        count(*) FILTER (a.source <> b.source) AS cr
      FROM d_mixed m JOIN d_halves a ON a.parent_id = m.p1 JOIN d_halves b ON b.parent_id = m.p2 WHERE m.split IN ('train', 'dev') GROUP BY ALL)) q
    USING (language, split) WHERE q.same IS NOT NULL)
WHERE rn <= CASE WHEN category = 'cross' THEN target - 2 * same ELSE same END
"""),
)
def w11(spark, sf):
    mixed, parents = canary_inputs(spark, sf)
    return planning.canary_pairs(mixed, parents, {"train": 6, "dev": 2})


def canary_inputs(spark, sf):
    """Mixed recipes, and parents dealt to two sources a language."""
    side = F.when(F.conv(F.right(F.sha2("parent_id", 256), F.lit(1)), 16, 10).cast("int") % 2 == 0, "left").otherwise("right")
    return corpus.recipes(spark, sf).where("kind = 'mixed_document'"), corpus.slotted_parents(spark, sf).withColumn("source", side)


CANARY_SIZES = """
  SELECT l.language, s.split, s.target, count(m.recipe_id) FILTER (a.source = 'left' AND b.source = 'left') AS sf,
    count(m.recipe_id) FILTER (a.source = 'right' AND b.source = 'right') AS ss, count(m.recipe_id) FILTER (a.source <> b.source) AS cr
  FROM (SELECT DISTINCT language FROM d_halves) l CROSS JOIN (VALUES ('train', 60), ('dev', 2)) AS s(split, target)
  LEFT JOIN d_mixed m ON m.language = l.language AND m.split = s.split
  LEFT JOIN d_halves a ON a.parent_id = m.p1 LEFT JOIN d_halves b ON b.parent_id = m.p2 GROUP BY ALL
"""


@register(
    "w5_left_over_parents",
    query("""
SELECT language, split, parent_id, cnt AS parents FROM (
  SELECT *, row_number() OVER (PARTITION BY language, split ORDER BY sha256('20260846:' || parent_id), parent_id) AS rn,
    count(*) OVER (PARTITION BY language, split) AS cnt FROM d_parents) WHERE cnt % 2 = 1 AND rn = cnt
"""),
)
def w5_left_over(spark, sf):
    return planning.left_over_parents(corpus.slotted_parents(spark, sf))


@register(
    "w11_canary_problems",
    query(f"""
SELECT language, split, 'no_balanced_selection' AS violation, target, sf AS same_first, ss AS same_second, cr AS cross
FROM ({CANARY_SIZES}) WHERE len(list_filter(range(0, target // 2 + 1), lambda k: sf >= k AND ss >= k AND cr >= target - 2 * k)) = 0
UNION ALL SELECT language, split, 'not_two_sources', target, sf, ss, cr FROM ({CANARY_SIZES})
WHERE language IN (SELECT language FROM d_halves GROUP BY language HAVING count(DISTINCT source) <> 2)
"""),
)
def w11_problems(spark, sf):
    """Groups that cannot give each source its target; the train target is more than the small languages have."""
    mixed, parents = canary_inputs(spark, sf)
    found = planning.canary_problems(mixed, parents, {"train": 60, "dev": 2})
    return found.select("language", "split", "violation", "target", "same_first", "same_second", "cross")


@register(
    "w11_canary_closure",
    query("""
WITH chosen AS (
  SELECT recipe_id, p1, p2 FROM (
    SELECT t.*, q.same, q.target, row_number() OVER (PARTITION BY t.language, t.split, t.category ORDER BY sha256('20260856:' || recipe_id), recipe_id) AS rn
    FROM (SELECT recipe_id, p1, p2, m.language, m.split, CASE WHEN a.source = b.source AND a.source = 'left' THEN 'same_first'
        WHEN a.source = b.source THEN 'same_second' ELSE 'cross' END AS category
      FROM d_mixed m JOIN d_halves a ON a.parent_id = m.p1 JOIN d_halves b ON b.parent_id = m.p2 WHERE m.split IN ('train', 'dev')) t
    JOIN (SELECT language, split, target, list_filter(range(0, target // 2 + 1), lambda k: sf >= k AND ss >= k AND cr >= target - 2 * k)[1] AS same
      FROM (SELECT m.language, m.split, CASE m.split WHEN 'train' THEN 6 ELSE 2 END AS target,
          count(*) FILTER (a.source = 'left' AND b.source = 'left') AS sf, count(*) FILTER (a.source = 'right' AND b.source = 'right') AS ss,
          count(*) FILTER (a.source <> b.source) AS cr
        FROM d_mixed m JOIN d_halves a ON a.parent_id = m.p1 JOIN d_halves b ON b.parent_id = m.p2 WHERE m.split IN ('train', 'dev') GROUP BY ALL)) q
      USING (language, split) WHERE q.same IS NOT NULL)
  WHERE rn <= CASE WHEN category = 'cross' THEN target - 2 * same ELSE same END
), ids AS (SELECT p1 AS parent_id FROM chosen UNION SELECT p2 FROM chosen)
SELECT kind, language, split, count(*) AS recipes FROM d_recipes r
WHERE (kind <> 'mixed_document' AND parent_ids[1] IN (SELECT parent_id FROM ids)) OR recipe_id IN (SELECT recipe_id FROM chosen)
GROUP BY ALL
""").replace("\nWITH chosen AS", ",\nchosen AS"),
)
def w11_closure(spark, sf):
    """All recipes of the parents of the chosen pairs, counted."""
    mixed, parents = canary_inputs(spark, sf)
    pairs = planning.canary_pairs(mixed, parents, {"train": 6, "dev": 2})
    chosen = mixed.join(pairs.select("recipe_id"), "recipe_id", "left_semi")
    ids = chosen.select(F.explode("parent_ids").alias("parent_id")).distinct()
    kept = planning.recipe_closure(corpus.recipes(spark, sf), ids, pairs.select("recipe_id"))
    return kept.groupBy("kind", "language", "split").agg(F.count(F.lit(1)).alias("recipes"))


@register(
    "w15_failure_stop",
    query("""
SELECT recipe_id, rn AS failures, total FROM (SELECT recipe_id, row_number() OVER (ORDER BY recipe_id) AS rn,
  (SELECT count(*) FROM d_rows) AS total FROM d_rows WHERE status = 'failed') WHERE rn / total::DOUBLE > 0.05 ORDER BY rn LIMIT 1
"""),
)
def w15(spark, sf):
    return planning.failure_stop(corpus.rows(spark, sf), maximum_rate=0.05)


@register(
    "t1_ordered_parents",
    query("SELECT split, source, parent_id, row_number() OVER (PARTITION BY split, source ORDER BY parent_id) AS place FROM d_parents"),
)
def t1(spark, sf):
    from ..operators.ordered import RANGE, in_ranges, with_running

    parents = corpus.slotted_parents(spark, sf).select("split", "source", "parent_id")
    ranged = in_ranges(parents, ["split", "source"], ["parent_id"])
    placed = with_running(ranged, ["split", "source"], F.col(RANGE), [F.col("parent_id")], rank="place").drop(RANGE)
    return placed.orderBy("split", "source", "parent_id")


@register(
    "u1_recipe_union",
    query("SELECT kind, count(*) AS n, count(base_recipe_id) AS with_base, count(f1) AS with_components FROM d_recipes GROUP BY ALL"),
)
def u1(spark, sf):
    plan = planning.plan_recipes(corpus.slotted_parents(spark, sf), drop_odd=True)
    return plan.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("base_recipe_id").alias("with_base"), F.count("components").alias("with_components")
    )


@register(
    "u2_set_guards",
    """
SELECT side, count(*) AS n, CASE WHEN side = 'both' THEN '' ELSE array_to_string(list_sort(list(d)::BIGINT[])[1:5], ',') END AS first_offenders FROM (
  SELECT coalesce(a.doc_id, b.doc_id) AS d, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side
  FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id) GROUP BY side
""",
)
def u2(spark, sf):
    return assembly.set_difference(
        corpus.read(spark, sf, "documents").select("doc_id"), corpus.read(spark, sf, "labels").select("doc_id"), "doc_id"
    )


@register(
    "u3_ordered_dedup",
    """
SELECT conv_id, array_to_string(list_transform(list_sort(list({'t': t, 'r': role})), lambda x: x.r), ',') AS roles
FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id
""",
)
def u3(spark, sf):
    # First turn per distinct role first, so a long conversation never gathers all its turns.
    first = corpus.read(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"])), ",").alias("roles")
    )


@register(
    "f1_content_hashes",
    """SELECT doc_id, sha256(text) AS text_sha256,
  sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS row_hash FROM documents""",
)
def f1(spark, sf):
    return corpus.read(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        content_hash(doc_id=F.col("doc_id"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("row_hash"),
    )
