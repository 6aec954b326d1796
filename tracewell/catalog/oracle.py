"""Plain-SQL statements of the derived tables, used to check the Spark results independently."""

from __future__ import annotations

import re

_CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    return [n for n in _CTES if re.search(rf"\b{n}\b", sql)]


def query(select: str) -> str:
    """Prefix a select with the common tables it mentions, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _needs(_CTES[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in _needs(select):
        visit(name)
    if not ordered:
        return select.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in ordered)
    return f"WITH {head}\n{select.strip()}"


FAMILY_ROWS = "(VALUES ('kgw'), ('unigram'), ('unbiased'), ('synthid')) AS f(family)"
SLOT_ROWS = "(VALUES ('a'), ('b')) AS s(slot)"


def unit(text: str) -> str:
    return f"((('0x' || substr(sha256({text}), 9, 8))::BIGINT & 2147483647) / 2147483648.0::DOUBLE)"


def last_digit(digest: str) -> str:
    return f"(('0x' || right({digest}, 1))::BIGINT)"


WS = "[\\x1c-\\x1f\\s\\x{85}\\p{Z}]"

cte(
    "d_unique",
    """
SELECT doc_id, lang AS language, source, n_chars, text, sha256(text) AS text_sha256
FROM documents WHERE n_chars >= 256
QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1
""",
)
cte(
    "d_ranked",
    """
SELECT *, doc_id::VARCHAR AS parent_id,
  row_number() OVER (PARTITION BY language ORDER BY sha256('20260815:' || doc_id::VARCHAR), doc_id::VARCHAR) AS rank,
  count(*) OVER (PARTITION BY language) AS total
FROM d_unique
""",
)
cte(
    "d_split",
    """
SELECT *, CASE WHEN rank * 1000 <= total * 375 THEN 'train' WHEN rank * 1000 <= total * 500 THEN 'dev'
  WHEN rank * 1000 <= total * 750 THEN 'calibration' ELSE 'test' END AS split
FROM d_ranked
""",
)
cte(
    "d_parents",
    """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, split
  ORDER BY sha256('20260826:' || source || ':' || split || ':' || parent_id), parent_id) % 2 = 1
  THEN 'a' ELSE 'b' END AS key_slot
FROM d_split
""",
)
cte(
    "d_base",
    """
SELECT 'base-' || v.variant || '-' || left(sha256(parent_id), 16) AS recipe_id, 'base_generation' AS kind,
  split, source, language, parent_id, v.variant AS base_variant,
  CASE WHEN v.variant <> 'clean' THEN v.variant END AS watermark_family,
  CASE WHEN v.variant <> 'clean' THEN v.variant || '_key_' || key_slot END AS key_id
FROM d_parents, (VALUES ('clean'), ('kgw'), ('unigram'), ('unbiased'), ('synthid')) AS v(variant)
""",
)
cte(
    "d_attack",
    f"""
SELECT 'attack-' || recipe_id AS recipe_id, 'matched_attack' AS kind, split, source, language, parent_id,
  base_variant, watermark_family, key_id, recipe_id AS base_recipe_id,
  (['paraphrase', 'translation_roundtrip', 'copy_edit', 'truncation'])[((rn - 1
    + {last_digit("sha256('20260844:' || source || ':' || split || ':' || base_variant)")} % 4) % 4 + 1)::INT] AS attack_id
FROM (SELECT *, row_number() OVER (PARTITION BY source, split, base_variant
        ORDER BY sha256('20260838:' || recipe_id), recipe_id) AS rn FROM d_base)
""",
)
cte(
    "d_pairs",
    """
SELECT language, split, (rn - 1) // 2 AS pair_no, max(parent_id) FILTER (rn % 2 = 1) AS p1,
  max(parent_id) FILTER (rn % 2 = 0) AS p2, max(key_slot) FILTER (rn % 2 = 1) AS s1,
  max(key_slot) FILTER (rn % 2 = 0) AS s2
FROM (SELECT *, row_number() OVER (PARTITION BY language, split
        ORDER BY sha256('20260846:' || parent_id), parent_id) AS rn,
        count(*) OVER (PARTITION BY language, split) AS cnt FROM d_parents)
WHERE rn <= cnt - cnt % 2
GROUP BY ALL
""",
)
cte(
    "d_mixed",
    """
SELECT printf('mixed-%04d', idx) AS recipe_id, 'mixed_document' AS kind, split, 'mixed' AS source, language,
  p1, p2, s1, s2, idx,
  (['kgw', 'unigram', 'unbiased', 'synthid'])[(idx % 4 + 1)::INT] AS f1,
  (['kgw', 'unigram', 'unbiased', 'synthid'])[((idx + 1) % 4 + 1)::INT] AS f2
FROM (SELECT *, row_number() OVER (ORDER BY language, split, pair_no) - 1 AS idx FROM d_pairs)
""",
)
cte(
    "d_recipes",
    """
SELECT recipe_id, kind, split, source, language, [parent_id] AS parent_ids, base_variant, watermark_family, key_id,
  NULL AS base_recipe_id, NULL AS attack_id, NULL AS boundary_quality, NULL AS f1, NULL AS s1, NULL AS f2, NULL AS s2
FROM d_base
UNION ALL
SELECT recipe_id, kind, split, source, language, [parent_id], base_variant, watermark_family, key_id,
  base_recipe_id, attack_id,
  CASE WHEN attack_id IN ('paraphrase', 'translation_roundtrip') THEN 'weak' ELSE 'exact' END, NULL, NULL, NULL, NULL
FROM d_attack
UNION ALL
SELECT recipe_id, kind, split, source, language, [p1, p2], NULL, NULL, NULL, NULL, NULL, NULL, f1, s1, f2, s2
FROM d_mixed
""",
)
cte(
    "d_rows",
    f"""
SELECT b.recipe_id, b.kind, b.split, b.source, b.language, [b.parent_id] AS parent_ids, b.base_variant,
  b.watermark_family, b.key_id, NULL::VARCHAR AS base_recipe_id, NULL::VARCHAR AS attack_id,
  NULL::VARCHAR AS boundary_quality, 'generated' AS status, NULL::VARCHAR AS failure_type,
  NULL::VARCHAR AS failure_message, p.text, p.text_sha256,
  NULL::VARCHAR[] AS watermark_families, NULL::VARCHAR[] AS key_ids,
  CASE WHEN b.watermark_family IS NULL THEN []::STRUCT(s INT, e INT)[]
    ELSE [{{'s': (length(p.text) // 4)::INT, 'e': (length(p.text) // 2)::INT}}] END AS spans
FROM d_base b JOIN d_parents p USING (parent_id)
UNION ALL
SELECT recipe_id, kind, split, source, language, [parent_id], base_variant, watermark_family, key_id, base_recipe_id,
  attack_id, CASE WHEN attack_id IN ('paraphrase', 'translation_roundtrip') THEN 'weak' ELSE 'exact' END,
  CASE WHEN t IS NULL THEN 'failed' ELSE 'generated' END, CASE WHEN t IS NULL THEN 'ModelUnavailable' END,
  CASE WHEN t IS NULL THEN 'no text for attack ' || attack_id END, t, sha256(t), NULL, NULL,
  CASE WHEN t IS NULL OR watermark_family IS NULL THEN []::STRUCT(s INT, e INT)[]
    ELSE [{{'s': 0::INT, 'e': length(t)::INT}}] END
FROM (SELECT a.*, CASE attack_id
        WHEN 'truncation' THEN left(p.text, greatest(1, floor(length(p.text) * 0.75::DOUBLE))::INT)
        WHEN 'copy_edit' THEN trim(regexp_replace(p.text, '{WS}+', ' ', 'g')) END AS t
      FROM d_attack a JOIN d_parents p USING (parent_id))
UNION ALL
SELECT m.recipe_id, m.kind, m.split, 'mixed', m.language, [p1, p2], NULL, 'mixed', NULL, NULL, NULL, 'exact', 'generated',
  NULL, NULL, a.text || chr(10) || chr(10) || b.text, sha256(a.text || chr(10) || chr(10) || b.text), [f1, f2],
  [f1 || '_key_' || s1, f2 || '_key_' || s2],
  [{{'s': 0::INT, 'e': length(a.text)::INT}},
   {{'s': (length(a.text) + 2)::INT, 'e': (length(a.text) + 2 + length(b.text))::INT}}]
FROM d_mixed m JOIN d_parents a ON a.parent_id = m.p1 JOIN d_parents b ON b.parent_id = m.p2
""",
)
cte(
    "d_docs",
    """
SELECT recipe_id AS document_id, *, watermark_family IS NOT NULL AS marked
FROM d_rows WHERE status = 'generated'
  AND (split IN ('dev', 'test') OR (split = 'calibration' AND watermark_family IS NULL))
""",
)
cte("d_texts", "SELECT text_sha256, marked, any_value(text) AS text, length(any_value(text)) AS n FROM d_docs GROUP BY ALL")
cte(
    "d_chars",
    """
SELECT text_sha256, marked, n, pos, c,
  ((unicode(c)::BIGINT * 1103515245 + pos * 12345) & 65535)
    + CASE WHEN marked AND pos >= n // 4 AND pos < n // 2 THEN 20000 ELSE 0 END AS num
FROM (SELECT text_sha256, marked, n, unnest(string_split(text, '')) AS c, unnest(range(n)) AS pos FROM d_texts)
""",
)
cte(
    "d_prefix",
    """
SELECT text_sha256, marked, pos + 1 AS pos,
  (sum(num) OVER (PARTITION BY text_sha256, marked ORDER BY pos))::BIGINT AS total FROM d_chars
UNION ALL SELECT text_sha256, marked, 0, 0 FROM d_texts
""",
)
cte(
    "d_starts",
    """
SELECT DISTINCT text_sha256, marked, len, unnest(list_append(range(0, n - len + 1, len // 4), n - len)) AS start
FROM d_texts, (VALUES (256), (512), (1024)) AS l(len) WHERE n >= len
""",
)
cte(
    "d_edges",
    """
SELECT e.text_sha256, e.marked, e.len, e.start, sum(CASE WHEN e.upper THEN p.total ELSE -p.total END)::BIGINT AS total
FROM d_prefix p JOIN (
  SELECT text_sha256, marked, len, start, start AS pos, false AS upper FROM d_starts
  UNION ALL SELECT text_sha256, marked, len, start, start + len, true FROM d_starts) e
  ON p.text_sha256 = e.text_sha256 AND p.marked = e.marked AND p.pos = e.pos
GROUP BY ALL
""",
)
cte("d_windows", "SELECT text_sha256, marked, len, start, start + len AS stop, total FROM d_edges")
cte(
    "d_cuts",
    """
SELECT text_sha256, marked, len, list_sort(list(total))[(ceil(0.95::DOUBLE * (count(*) - 1)) + 1)::INT] AS cut
FROM d_windows GROUP BY ALL
""",
)
cte(
    "d_raw",
    """
SELECT w.*, w.total / w.len::DOUBLE AS mean FROM d_windows w JOIN d_cuts USING (text_sha256, marked, len)
WHERE w.total >= cut
""",
)
cte(
    "d_islands",
    """
SELECT *, sum(fresh) OVER (PARTITION BY text_sha256, marked ORDER BY start, stop, len) AS island FROM (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY text_sha256, marked ORDER BY start, stop, len
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 32 THEN 0 ELSE 1 END AS fresh FROM d_raw)
""",
)
cte(
    "d_merged",
    """
SELECT text_sha256, marked, (island - 1)::INT AS idx, min(start) AS start, max(stop) AS stop,
  first(len ORDER BY mean DESC, len, start) AS len, max(mean) AS mean
FROM d_islands GROUP BY text_sha256, marked, island
""",
)
cte(
    "d_local",
    """
SELECT m.text_sha256, m.marked, m.idx, m.len, c.pos, c.num,
  quantile_cont(c.num, 0.5) OVER (PARTITION BY m.text_sha256, m.marked, m.idx) AS med
FROM d_merged m JOIN d_chars c ON c.text_sha256 = m.text_sha256 AND c.marked = m.marked
  AND c.pos >= m.start AND c.pos < m.stop
""",
)
cte(
    "d_refined",
    """
SELECT text_sha256, marked, idx, len, min(pos)::INT AS char_start, (max(pos) + 1)::INT AS char_end,
  (sum(num)::DOUBLE / count(*)) / 65535.0::DOUBLE AS raw_score
FROM d_local WHERE num >= med GROUP BY ALL
""",
)
# The same search over every document in place of the derived rows.
cte(
    "a_texts",
    """
SELECT text_sha256, false AS marked, any_value(text) AS text, length(any_value(text)) AS n
FROM (SELECT text, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL) GROUP BY ALL
""",
)
for _name in "chars prefix starts edges windows cuts raw islands merged local refined".split():
    cte(f"a_{_name}", re.sub(r"\bd_(?=[a-z])", "a_", _CTES[f"d_{_name}"]))
cte("a_docs", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL")
REFINED = """
SELECT doc_id, 'generic-merged-' || m.idx || '-refined' AS candidate_id, r.char_start::BIGINT AS char_start, r.char_end::BIGINT AS char_end,
  'char-' || m.len AS scale_id, round(r.raw_score, 9) AS raw_score
FROM a_docs JOIN a_merged m USING (text_sha256) JOIN a_refined r USING (text_sha256, idx)
"""
cte(
    "d_grams",
    """
SELECT text_sha256, pos, gram FROM (
  SELECT text_sha256, pos, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w AS gram
  FROM (SELECT DISTINCT text_sha256, pos, c FROM d_chars) WINDOW w AS (PARTITION BY text_sha256 ORDER BY pos))
WHERE gram IS NOT NULL
""",
)
cte(
    "d_textrep",
    """
SELECT text_sha256, 1.0::DOUBLE - count(DISTINCT gram)::DOUBLE / count(*) AS repetition FROM d_grams GROUP BY ALL
""",
)
cte(
    "d_segrep",
    """
SELECT r.text_sha256, r.marked, r.idx, 1.0::DOUBLE - count(DISTINCT g.gram)::DOUBLE / count(*) AS repetition
FROM d_refined r JOIN d_grams g ON g.text_sha256 = r.text_sha256 AND g.pos >= r.char_start AND g.pos + 4 <= r.char_end
GROUP BY ALL
""",
)
for _name in ("grams", "segrep"):
    cte(f"a_{_name}", re.sub(r"\bd_(?=[a-z])", "a_", _CTES[f"d_{_name}"]))
cte(
    "d_measured",
    f"""
SELECT t.text_sha256, t.marked, t.n, coalesce(r.repetition, 0.0::DOUBLE) AS repetition,
  length(regexp_replace(t.text, '{WS}', '', 'g')) AS effective_length,
  len(regexp_extract_all(t.text, '[^{WS[1:-1]}]+')) AS tokens,
  CASE WHEN t.n > 0 THEN coalesce(list_sum([length(w) FOR w, i IN regexp_extract_all(t.text, '[^{WS[1:-1]}]+|{WS}+') IF i % 61 <> 0]), 0)::DOUBLE / t.n
    ELSE 0.0::DOUBLE END AS coverage
FROM d_texts t LEFT JOIN d_textrep r USING (text_sha256)
""",
)
cte(
    "d_scored",
    """
SELECT d.document_id, d.parent_ids, d.kind, d.split, d.source, d.language, d.watermark_family, d.watermark_families,
  d.key_id, d.key_ids, d.attack_id, d.spans, d.text_sha256, d.marked, m.n, m.repetition, m.effective_length, m.tokens, m.coverage
FROM d_docs d JOIN d_measured m USING (text_sha256, marked)
""",
)
cte(
    "d_segments",
    f"""
SELECT s.document_id, s.split, s.language, s.effective_length, s.coverage, s.watermark_family, s.watermark_families, s.key_id,
  s.key_ids, 'generic-merged-' || r.idx || '-refined' AS candidate_id, r.char_start, r.char_end,
  'char-' || r.len AS scale_id, r.raw_score, coalesce(g.repetition, 0.0::DOUBLE) AS repetition,
  len(regexp_extract_all(substr(t.text, r.char_start + 1, r.char_end - r.char_start), '[^{WS[1:-1]}]+')) AS tokens
FROM d_scored s JOIN d_refined r USING (text_sha256, marked) JOIN d_texts t USING (text_sha256, marked)
LEFT JOIN d_segrep g ON g.text_sha256 = s.text_sha256 AND g.marked = s.marked AND g.idx = r.idx
""",
)
cte(
    "d_intervals",
    """
SELECT document_id, split, watermark_family, watermark_families, key_id, key_ids, candidate_id, char_start, char_end,
  'candidate' AS interval_role, tokens FROM d_segments
UNION ALL
SELECT document_id, split, watermark_family, watermark_families, key_id, key_ids, 'full-text', 0, n::INT, 'full_text', tokens
FROM d_scored s WHERE NOT EXISTS (SELECT 1 FROM d_segments g
  WHERE g.document_id = s.document_id AND g.char_start = 0 AND g.char_end = s.n)
""",
)
_HIT = "(coalesce(key_id = family || '_key_' || slot, false) OR coalesce(list_contains(key_ids, family || '_key_' || slot), false))"
_CARRY = "(coalesce(watermark_family = family, false) OR coalesce(list_contains(watermark_families, family), false))"
cte(
    "d_evidence",
    f"""
SELECT *, CASE WHEN key_status = 'registered' AND family = 'unbiased' THEN -raw ELSE raw END AS strength FROM (
  SELECT document_id, split, candidate_id, char_start, char_end, interval_role, family, slot, 'registered' AS key_status,
    'sha256:' || sha256(family || '_key_' || slot) AS key_id_hash, tokens,
    CASE WHEN tokens < CASE family WHEN 'kgw' THEN 2 WHEN 'unigram' THEN 1 WHEN 'unbiased' THEN 6 ELSE 5 END
      THEN 'invalid' ELSE 'valid' END AS applicability,
    CASE WHEN family = 'unbiased' THEN -1 ELSE 1 END * (
      {unit("'20260815:' || document_id || ':' || char_start || '-' || char_end || ':' || family || ':' || slot")} * 4
      + CASE WHEN {_HIT} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) AS raw
  FROM d_intervals, {FAMILY_ROWS}, {SLOT_ROWS}
  UNION ALL
  SELECT document_id, split, candidate_id, char_start, char_end, interval_role, family, NULL, 'scheme_only', NULL, tokens,
    'valid', {unit("'20260815:' || document_id || ':' || family || ':scheme'")} * 4
      + CASE WHEN {_CARRY} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM d_intervals, {FAMILY_ROWS})
""",
)
cte(
    "d_scenarios",
    """
SELECT * FROM (VALUES ('a_and_b', 'primary', ['a', 'b'], NULL), ('a_only', 'primary', ['a'], NULL),
  ('b_only', 'primary', ['b'], NULL), ('lofo_kgw', 'lofo_kgw', ['a', 'b'], 'kgw'),
  ('lofo_unigram', 'lofo_unigram', ['a', 'b'], 'unigram'), ('lofo_unbiased', 'lofo_unbiased', ['a', 'b'], 'unbiased'),
  ('lofo_synthid', 'lofo_synthid', ['a', 'b'], 'synthid')) AS t(scenario, pool, slots, held_out)
""",
)
cte(
    "d_masked",
    """
SELECT c.scenario, c.pool, e.* FROM d_evidence e, d_scenarios c
WHERE e.applicability = 'valid' AND (e.slot IS NULL OR list_contains(c.slots, e.slot))
  AND (c.held_out IS NULL OR e.family <> c.held_out)
""",
)
cte(
    "d_items",
    """
SELECT m.scenario, m.pool, s.document_id, s.candidate_id, m.family, m.key_status, m.strength
FROM d_segments s JOIN d_masked m ON m.document_id = s.document_id
WHERE m.interval_role = 'full_text' OR (m.char_start = s.char_start AND m.char_end = s.char_end)
""",
)
cte(
    "d_records",
    """
SELECT p.pool, d.document_id, d.split, d.parent_ids[1] AS parent_id, d.language || ':all' AS stratum,
  CASE WHEN d.attack_id IS NOT NULL THEN 'attacked-clean' ELSE 'clean' END AS descendant_kind,
  r.route, CASE r.route WHEN 'generic' THEN coalesce(g.m, 0.0::DOUBLE) WHEN 'registered' THEN coalesce(e.m, 0.0::DOUBLE)
    ELSE coalesce(gap.m, -coalesce(e.m, 0.0::DOUBLE)) END AS maximum_statistic
FROM d_scored d
CROSS JOIN (SELECT DISTINCT pool FROM d_scenarios) p
CROSS JOIN (VALUES ('generic'), ('registered'), ('gap')) AS r(route)
LEFT JOIN (SELECT document_id, max(raw_score) AS m FROM d_segments GROUP BY ALL) g USING (document_id)
LEFT JOIN (SELECT pool, document_id, max(strength) AS m FROM d_masked WHERE scenario NOT IN ('a_only', 'b_only')
           GROUP BY ALL) e ON e.pool = p.pool AND e.document_id = d.document_id
LEFT JOIN (SELECT q.pool, s.document_id, max(s.raw_score - coalesce(b.best, 0.0::DOUBLE)) AS m
           FROM d_segments s CROSS JOIN (SELECT DISTINCT pool FROM d_scenarios) q
           LEFT JOIN (SELECT pool, document_id, candidate_id, max(strength) AS best FROM d_items
                      WHERE scenario NOT IN ('a_only', 'b_only') GROUP BY ALL) b
             ON b.pool = q.pool AND b.document_id = s.document_id AND b.candidate_id = s.candidate_id
           GROUP BY ALL) gap ON gap.pool = p.pool AND gap.document_id = d.document_id
WHERE d.split = 'calibration' AND d.watermark_family IS NULL
""",
)
cte(
    "d_pool",
    """
SELECT *, count(*) OVER (PARTITION BY pool, route, stratum) AS n FROM (
  SELECT pool, route, stratum, parent_id, max(maximum_statistic) AS stat FROM d_records GROUP BY ALL)
QUALIFY count(*) OVER (PARTITION BY pool, route, stratum) >= 20
""",
)
cte(
    "d_best",
    """
SELECT c.scenario, c.pool, s.*, s.language || ':all' AS stratum, coalesce(i.best, 0.0::DOUBLE) AS best,
  s.raw_score - coalesce(i.best, 0.0::DOUBLE) AS gap
FROM d_segments s CROSS JOIN d_scenarios c
JOIN d_scored d ON d.document_id = s.document_id
LEFT JOIN (SELECT scenario, document_id, candidate_id, max(strength) AS best FROM d_items GROUP BY ALL) i
  ON i.scenario = c.scenario AND i.document_id = s.document_id AND i.candidate_id = s.candidate_id
WHERE s.split = 'test' AND (c.held_out IS NULL OR (len(d.parent_ids) = 1
  AND (d.watermark_family IS NULL OR d.watermark_family = c.held_out)))
""",
)
cte(
    "d_testdocs",
    """
SELECT c.scenario, c.pool, c.slots, c.held_out, d.*, d.language || ':all' AS stratum, coalesce(g.m, 0.0::DOUBLE) AS generic_max
FROM d_scored d CROSS JOIN d_scenarios c
LEFT JOIN (SELECT document_id, max(raw_score) AS m FROM d_segments GROUP BY ALL) g USING (document_id)
WHERE d.split = 'test' AND (c.held_out IS NULL OR (len(d.parent_ids) = 1
  AND (d.watermark_family IS NULL OR d.watermark_family = c.held_out)))
""",
)
cte(
    "d_observed",
    """
SELECT DISTINCT pool, route, stratum, v FROM (
  SELECT pool, 'gap' AS route, stratum, gap AS v FROM d_best
  UNION ALL SELECT pool, 'registered', stratum, best FROM d_best
  UNION ALL SELECT pool, 'registered', language || ':all', strength FROM d_items JOIN d_scored USING (document_id) WHERE split = 'test'
  UNION ALL SELECT pool, 'generic', stratum, generic_max FROM d_testdocs)
""",
)
cte(
    "d_p",
    """
SELECT o.pool, o.route, o.stratum, o.v, (1 + count(*) FILTER (p.stat >= o.v)) / (count(*) + 1)::DOUBLE AS p
FROM d_observed o JOIN d_pool p ON p.pool = o.pool AND p.route = o.route AND p.stratum = o.stratum
GROUP BY ALL
""",
)
cte(
    "d_docp",
    """
SELECT d.*, p.p AS generic_p, p.p IS NULL AS missing_pool,
  list_filter([CASE WHEN effective_length < 64 THEN 'insufficient_effective_length' END,
    CASE WHEN coverage < 0.98::DOUBLE THEN 'mapping_coverage_low' END,
    CASE WHEN language NOT IN ('en', 'de', 'es') THEN 'unsupported_language' END,
    CASE WHEN repetition > 0.35::DOUBLE THEN 'excessive_repetition' END], lambda x: x IS NOT NULL) AS reasons
FROM d_testdocs d LEFT JOIN d_p p ON p.pool = d.pool AND p.route = 'generic' AND p.stratum = d.stratum AND p.v = d.generic_max
""",
)
cte(
    "d_segp",
    """
SELECT b.*, g.p AS gap_p, r.p AS registered_p, d.generic_p, d.missing_pool,
  list_filter([CASE WHEN b.effective_length < 64 THEN 'insufficient_effective_length' END,
    CASE WHEN b.coverage < 0.98::DOUBLE THEN 'mapping_coverage_low' END,
    CASE WHEN b.language NOT IN ('en', 'de', 'es') THEN 'unsupported_language' END,
    CASE WHEN b.repetition > 0.35::DOUBLE THEN 'excessive_repetition' END], lambda x: x IS NOT NULL) AS reasons
FROM d_best b
JOIN d_docp d ON d.scenario = b.scenario AND d.document_id = b.document_id
LEFT JOIN d_p g ON g.pool = b.pool AND g.route = 'gap' AND g.stratum = b.stratum AND g.v = b.gap
LEFT JOIN d_p r ON r.pool = b.pool AND r.route = 'registered' AND r.stratum = b.stratum AND r.v = b.best
""",
)


def decided_segments(per_item: bool) -> str:
    item_p = "ip.p" if per_item else "s.registered_p"
    return f"""
SELECT s.*, coalesce(a.tests, 0) AS tests, coalesce(a.hits, 0) AS hits, a.best_p,
  CASE WHEN len(s.reasons) > 0 OR s.missing_pool OR coalesce(a.fams, 0) > 1 THEN 'uncertain'
    WHEN coalesce(a.key_hits, 0) > 0 THEN 'known_scheme_known_key'
    WHEN coalesce(a.scheme_hits, 0) > 0 AND coalesce(s.generic_p <= 0.05, false) AND coalesce(s.gap_p <= 0.05, false)
      THEN 'known_scheme_unknown_key'
    WHEN coalesce(s.generic_p <= 0.05, false) AND coalesce(a.hits, 0) = 0 THEN 'suspected_unknown_scheme'
    WHEN coalesce(s.generic_p <= 0.05, false) OR coalesce(a.hits, 0) > 0 THEN 'uncertain' ELSE 'none' END AS label,
  CASE WHEN len(s.reasons) > 0 THEN array_to_string(s.reasons, ',')
    WHEN s.missing_pool THEN 'missing_null_stratum'
    WHEN coalesce(a.fams, 0) > 1 THEN 'registered_evidence_conflict'
    WHEN coalesce(a.key_hits, 0) > 0 OR (coalesce(a.scheme_hits, 0) > 0 AND coalesce(s.generic_p <= 0.05, false)
      AND coalesce(s.gap_p <= 0.05, false)) OR (coalesce(s.generic_p <= 0.05, false) AND coalesce(a.hits, 0) = 0)
      OR NOT (coalesce(s.generic_p <= 0.05, false) OR coalesce(a.hits, 0) > 0) THEN ''
    WHEN coalesce(s.generic_p <= 0.05, false) AND NOT coalesce(s.gap_p <= 0.05, false)
      THEN 'generic_significant_gap_not_significant'
    WHEN coalesce(s.gap_p <= 0.05, false) AND NOT coalesce(s.generic_p <= 0.05, false)
      THEN 'gap_significant_generic_not_significant'
    WHEN coalesce(a.scheme_hits, 0) > 0 THEN 'no_key_independent_scheme_test'
    ELSE 'borderline_threshold' END AS abstain
FROM d_segp s LEFT JOIN (
  SELECT s.scenario, s.document_id, s.candidate_id, count(*) AS tests, min({item_p}) AS best_p,
    count(*) FILTER ({item_p} <= 0.05) AS hits, count(DISTINCT i.family) FILTER ({item_p} <= 0.05) AS fams,
    count(*) FILTER ({item_p} <= 0.05 AND i.key_status = 'registered') AS key_hits,
    count(*) FILTER ({item_p} <= 0.05 AND i.key_status = 'scheme_only') AS scheme_hits
  FROM d_segp s JOIN d_items i ON i.scenario = s.scenario AND i.document_id = s.document_id AND i.candidate_id = s.candidate_id
  LEFT JOIN d_p ip ON ip.pool = s.pool AND ip.route = 'registered' AND ip.stratum = s.stratum AND ip.v = i.strength
  GROUP BY ALL) a USING (scenario, document_id, candidate_id)
"""


def decided_documents(segments: str) -> str:
    return f"""
SELECT d.*, CASE WHEN len(d.reasons) > 0 OR d.missing_pool OR coalesce(g.unc, false) THEN 'uncertain'
    WHEN coalesce(g.best, 5) = 1 THEN 'known_scheme_known_key' WHEN g.best = 2 THEN 'known_scheme_unknown_key'
    WHEN g.best = 3 THEN 'suspected_unknown_scheme' ELSE 'none' END AS document_label,
  g.registered_p, g.gap_p, coalesce(g.n, 0) AS candidate_count, coalesce(g.tests, 0)::BIGINT AS test_count,
  coalesce(g.pred, []::STRUCT(s INT, e INT)[]) AS pred, coalesce(g.labels, '') AS label_set
FROM d_docp d LEFT JOIN (
  SELECT scenario, document_id, count(*) AS n, bool_or(label = 'uncertain') AS unc, sum(tests) AS tests,
    min(CASE label WHEN 'known_scheme_known_key' THEN 1 WHEN 'known_scheme_unknown_key' THEN 2
      WHEN 'suspected_unknown_scheme' THEN 3 WHEN 'none' THEN 5 END) AS best,
    min(registered_p) AS registered_p, min(gap_p) AS gap_p,
    list({{'s': char_start, 'e': char_end}} ORDER BY char_start, char_end)
      FILTER (label IN ('known_scheme_known_key', 'known_scheme_unknown_key', 'suspected_unknown_scheme')) AS pred,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM {segments} GROUP BY ALL) g USING (scenario, document_id)
"""


cte("d_decided", decided_segments(False))
cte("d_decided_item", decided_segments(True))
cte("d_doc_decided", decided_documents("d_decided"))
cte("d_doc_decided_item", decided_documents("d_decided_item"))
cte(
    "d_eval",
    """
SELECT scenario, document_id, array_to_string(list_sort(parent_ids), '|') AS parent_id, source, language, watermark_family,
  key_id, attack_id, held_out, CASE WHEN watermark_family IS NULL THEN 'none'
    WHEN len(list_filter(pairs, lambda x: x.f IS DISTINCT FROM held_out AND list_contains(slots, right(x.k, 1)))) > 0
      THEN 'known_scheme_known_key'
    WHEN len(list_filter(pairs, lambda x: x.f IS DISTINCT FROM held_out)) > 0 THEN 'known_scheme_unknown_key'
    ELSE 'suspected_unknown_scheme' END AS true_label,
  document_label AS predicted_label, coalesce(1.0::DOUBLE - generic_p, 0.0::DOUBLE) AS score,
  coalesce(1.0::DOUBLE - registered_p, 0.0::DOUBLE) AS knownness, spans, pred
FROM (SELECT *, CASE WHEN watermark_family = 'mixed'
    THEN [{'f': watermark_families[1], 'k': key_ids[1]}, {'f': watermark_families[2], 'k': key_ids[2]}]
    ELSE [{'f': watermark_family, 'k': key_id}] END AS pairs FROM d_doc_decided_item)
""",
)
cte("d_eval_default", _CTES["d_eval"].replace("d_doc_decided_item", "d_doc_decided"))
