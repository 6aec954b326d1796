"""Registered queries of the training-data operators: thin wrappers over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.decontamination import contaminated
from tracewell.llm.exact_dedup import owners
from tracewell.llm.language_id import identified
from tracewell.llm.line_dedup import line_components
from tracewell.llm.merkle import tampered_manifest
from tracewell.llm.near_dedup import near_duplicates
from tracewell.llm.packing import packed
from tracewell.llm.quality import scored
from tracewell.llm.secret_scan import secret_spans
from tracewell.llm.source_divergence import divergence
from tracewell.llm.topk_search import nearest
from tracewell.llm.url_filter import judged
from tracewell.llm.warc import archive_folder, read_archives, write_archives

RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(id_col: str, folds: int) -> Column:
    """crc32 of an id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(_read(spark, sf_dir, "documents"))


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(
        _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("random"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_read(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(_read(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(files, with_payload=False)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(_fold("doc_id", 3) != 1)
    held_out = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored(_read(spark, sf_dir, "documents"), labels).select("doc_id", held_out, "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    found = identified(docs, docs.where(_fold("doc_id", 4) != 2))
    return found.select("doc_id", held_out, "lang_pred", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(_read(spark, sf_dir, "documents"), keep="largest")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_curve_packing": op2_curve_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_exact_topk": op10_exact_topk,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.vec AS query_vec, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id OR c.vec <> q.vec WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query_vec ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
  true AS verified, url
FROM f
"""

_SMALL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = f"""
WITH t AS (SELECT doc_id, {_SMALL.format("text")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t
"""

_DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_SMALL.format("text")} AS body
  FROM documents
), o AS (
  SELECT row, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS times FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 30
), v AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.times), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k USING (lang) GROUP BY ALL
), c AS (
  SELECT lang, source, term, count(*) AS times FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(sum(c.times), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.times, 0) AS times,
    1 + (1000000000 * (coalesce(c.times, 0) + 5)::HUGEINT) // (g.n + 5 * v.v) AS p,
    1 + (1000000000 * (k.times + 5)::HUGEINT) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE times > 0 AND p > q
), n AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place FROM r
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM n WHERE part = 'pair' OR place <= 50
"""


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


_MERKLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || [0::UBIGINT for x in range(8)], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256))::UBIGINT AS i)
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    sha256({"||".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    sha256({"||".join(map(_field, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))}) AS changed,
    n_chars IS NOT NULL AND coalesce(xor(list_reduce(
      [4294967295::UBIGINT] || list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT),
      lambda c, x: xor(c >> 8, crc.steps[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 7 = 0, false) AS hit
  FROM documents CROSS JOIN crc
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d
), t AS (
  SELECT tree, 0 AS level, place, leaf AS node, n FROM leaf
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2 FROM t WHERE n > 1
  GROUP BY tree, level, place // 2, n
), top AS (
  SELECT tree, level AS height, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, place, subroot AS node, n FROM top
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, place // 2, n
), path AS (
  SELECT l.tree, l.place, x.level, x.node AS sibling, x.place % 2 = 0 AS before
  FROM leaf l JOIN t x ON x.tree = l.tree AND x.n > 1 AND x.place = xor(l.place >> x.level, 1)
  UNION ALL
  SELECT l.tree, l.place, top.height + x.level, x.node, x.place % 2 = 0
  FROM leaf l JOIN top USING (tree) JOIN u x ON x.n > 1 AND x.place = xor(top.place >> x.level, 1)
), fold AS (
  SELECT l.tree, l.place, 0 AS level, CASE WHEN l.hit THEN l.changed ELSE l.leaf END AS node,
    top.height + (SELECT max(level) FROM u) AS height
  FROM leaf l JOIN top USING (tree)
  UNION ALL
  SELECT f.tree, f.place, f.level + 1,
    sha256(CASE WHEN p.before THEN p.sibling || f.node WHEN NOT p.before THEN f.node || p.sibling ELSE f.node END), f.height
  FROM fold f LEFT JOIN path p ON p.tree = f.tree AND p.place = f.place AND p.level = f.level WHERE f.level < f.height
), proof AS (SELECT tree, place, sha256(string_agg(sibling, '' ORDER BY level)) AS proof FROM path GROUP BY ALL)
SELECT l.doc_id, l.leaf, top.subroot, r.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root,
  f.node = r.node AS verified
FROM leaf l JOIN top USING (tree) JOIN (SELECT node FROM u WHERE n = 1) r ON true
JOIN fold f ON f.tree = l.tree AND f.place = l.place AND f.level = f.height
LEFT JOIN proof p ON p.tree = l.tree AND p.place = l.place
"""

ORACLES: dict[str, str] = {
    "op7_warc_round_trip": _WARC,
    "op10_exact_topk": _TOPK,
    "op11_exact_dedup": _EXACT,
    "op12_source_divergence": _DIVERGENCE,
    "op13_merkle_manifest": _MERKLE,
}
