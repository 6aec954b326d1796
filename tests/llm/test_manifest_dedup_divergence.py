"""Exact dedup, source divergence and Merkle manifest against plain restatements and defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, merkle, queries, source_divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows: list):
    return spark.createDataFrame(rows, DOCS)


# Exact dedup


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie_holds_what_was_placed(keys):
    trie, want = exact_dedup.Trie(), Counter(k for k in keys if k)
    for k in keys:
        if k:
            node = trie.place(k)
            node.terminal = (node.terminal or 0) + 1
    assert trie.held == 0 or keys
    assert dict(trie.release()) == want and trie.held == 0


def test_trie_lets_whole_subtrees_go():
    trie, draw = exact_dedup.Trie(), random.Random(1)
    keys = {bytes([0] * 7 + [draw.randint(1, 9)]) + draw.randbytes(8) + draw.randbytes(30) for _ in range(500)}
    for k in keys:
        trie.place(k).terminal = 1
    gone = dict(trie.release_heaviest(trie.held // 2))
    heads = {k[:8] for k in gone}
    assert gone and all(k in gone for k in keys if k[:8] in heads)
    last = max(k for k in keys if k not in gone)
    beside = dict(trie.release_beside(last))
    assert dict(trie.release()).keys() == {last} and len(beside) + len(gone) + 1 == len(keys)


def plain_owners(rows: list, largest: bool) -> list:
    groups = defaultdict(list)
    for n, row in enumerate(rows):
        groups[re.sub("[A-Z]", lambda m: m.group().lower(), row[1] or "")].append((row[0], n))
    out = []
    for text, members in groups.items():
        ids = [i for i, _ in members if i is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        stays = next(n for i, n in members if i == keep)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(members), n == stays, digest) for i, n in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,trie_bytes,broadcast", [("largest", 48_000_000, 2_000_000), ("smallest", 3_000, 2_000_000), ("largest", 3_000, 0)])
def test_owners_equal_plain_groups(spark, monkeypatch, keep, trie_bytes, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast)
    draw = random.Random(2)
    texts = ["".join(draw.choices("abÄäß ", k=draw.randint(1, 4))) for _ in range(60)] + ["x" * 200_000, "ABC", "abc", "ÄBC", "äbc", "İ", "i̇", "ΑΣ", "ας", "", None]
    rows = [(draw.choice([None, *range(40)]), t if draw.random() < 0.5 or t is None else t.upper() if "ß" not in t else t, "en", "s", 1) for t in texts * 4]
    rows += [(5, "hot", "en", "s", 1)] * 150
    df = documents(spark, rows).withColumns({"size": F.lit(1), "row": F.lit(2), "keep_id": F.lit("x"), "entry": F.lit(0)}).repartition(5)
    got = sorted(map(tuple, exact_dedup.owners(df, keep=keep, trie_bytes=trie_bytes).collect()), key=repr)
    assert got == plain_owners(rows, keep == "largest")


def test_owners_edge_cases(spark):
    df = documents(spark, [(None, None, None, None, None), (None, "", None, None, None), (3, " ", "en", "s", 1)])
    got = sorted(map(tuple, exact_dedup.owners(df).collect()), key=repr)
    empty, blank = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ").hexdigest()
    assert got == sorted([(None, None, 2, True, empty), (None, None, 2, False, empty), (3, 3, 1, True, blank)], key=repr)
    assert exact_dedup.owners(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.owners(df, keep="first")


# Source divergence


def plain_divergence(rows: list, least: int, top: int) -> list:
    docs = [("" if lang is None else lang, "" if source is None else source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, found in own:
            counts[source].update(t for t in found if t in set(kept))
        whole = sum(counts.values(), Counter())

        def share(c: Counter, t: str) -> int:
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for a in counts:
            pairs = [(sum(abs(share(counts[a], t) - share(counts[b], t)) for t in kept), b) for b in counts if b != a]
            above = [(share(counts[a], t) - share(whole, t), t) for t in kept if counts[a][t] and share(counts[a], t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", above)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, a, part, item, value, n) for n, (value, item) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def draw_documents(n: int, seed: int) -> list:
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcé日", k=draw.randint(1, 12))) for _ in range(40)] + ["abcabcabcabc" + c for c in "xyzé"]
    rows = []
    for i in range(n):
        words = draw.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=draw.randint(0, 25))
        text = "".join(w.upper() + draw.choice([" ", "1", "\n", "-", "_"]) if draw.random() < 0.3 else w + " " for w in words)
        rows.append((i, draw.choice([text, None]) if i % 17 == 0 else text, draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "é", None, "zz"]), 1))
    return rows + [(900, "nothing kept here", "lone", "x", 1), (901, None, "empty", "x", 1), (902, "1 2", "empty", "y", 1), (903, "q" * 100_000, "en", "a", 1)]


@pytest.mark.parametrize("least,first_level,blocks", [(3, 4, None), (2, 1, (3, 2)), (10, 16, None)])
def test_divergence_equals_plain_counts(spark, monkeypatch, least, first_level, blocks):
    if blocks:
        monkeypatch.setattr(source_divergence, "TERM_BLOCK", blocks[0])
        monkeypatch.setattr(source_divergence, "SOURCE_BLOCK", blocks[1])
        monkeypatch.setattr(source_divergence, "HELD", 30)
    rows = draw_documents(120, 3)
    df = documents(spark, rows).withColumns({"term": F.lit(1), "body": F.lit("x"), "docs": F.lit(2)}).repartition(3)
    got = sorted(map(tuple, source_divergence.divergence(df, least=least, top_terms=4, first_level=first_level).collect()))
    want = plain_divergence(rows, least, 4)
    assert got == want and len({r[2] for r in want}) == 2


def test_divergence_edge_cases(spark):
    df = documents(spark, [(None, None, None, None, None), (None, "a", None, "s", None)])
    got = sorted(map(tuple, source_divergence.divergence(df).collect()))
    assert got == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    assert source_divergence.divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("counting", [source_divergence._counted, source_divergence._counted_short])
def test_a_prefix_counts_a_document_once(spark, counting):
    rows = [(i, "abcdex abcdey abcdex ab AB", "en", "s", 1) for i in range(3)] + [(9, "abcdez", "en", "s", 1), (10, "", "en", "s", 1)]
    counted = documents(spark, rows).coalesce(1).select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        counting(4, 0, None), source_divergence._COUNTS_SQL
    )
    got = {(bytes(r["piece"]), r["source"], r["whole"], r["docs"], r["times"]) for r in counted.collect()}
    assert got == {(b"abcd", None, False, 4, 0), (b"ab", None, True, 3, 0), (b"ab", "s", True, 0, 6)}


def test_number_and_byte_counting_agree():
    import pyarrow as pa

    rows = [(lang or "", source or "", (text or "").encode()) for _, text, lang, source, _ in draw_documents(80, 6)] + [("en", "a", b"")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["l", "s", "t"])

    class Bits:
        value = bytes(random.Random(7).randbytes(1 << (source_divergence.BITS - 3)))

    for level, before, bits in ((4, 0, None), (8, 4, Bits), (8, 1, Bits)):
        totals = []
        for counting in (source_divergence._counted, source_divergence._counted_short):
            seen = Counter()
            for out in counting(level, before, bits)(iter([batch, batch])):
                for *key, docs, times in zip(*(c.to_pylist() for c in out.columns)):
                    seen[tuple(key), "docs"] += docs
                    seen[tuple(key), "times"] += times
            totals.append(+seen)
        assert totals[0] == totals[1] and totals[0]


def test_shares_are_exact_for_large_counts(spark):
    for times, total, size in ((10**12 + 7, 3 * 10**14 + 1, 10**6), (0, 0, 1), (7, 7, 1), (123_456_789_012, 123_456_789_013, 99)):
        got = spark.range(1).select(source_divergence.share(F.lit(times), F.lit(total), F.lit(size))).first()[0]
        assert got == 1 + 1_000_000_000 * (times + 5) // (total + 5 * size)


# Merkle manifest


def hexed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row: tuple, add: int = 0) -> str:
    doc_id, text, lang, source, n = row
    return hexed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n is None else n + add, text)])


def plain_tree(nodes: list) -> tuple[str, list]:
    """(root, siblings per leaf with their side) by the rule of consecutive pairs."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(nodes):
                paths[i].append((k & 1, nodes[k ^ 1]))
            else:
                paths[i].append(None)
        nodes = [hexed(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def plain_manifest(rows: list) -> list:
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for r, path in zip(own, paths):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = plain_leaf(r, int(hit))
            for step in path + above:
                node = hexed(node) if step is None else hexed(step[1], node) if step[0] else hexed(node, step[1])
            proof = hexed(*[s[1] for s in path + above if s])
            out.append((r[0], plain_leaf(r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_plain_trees(spark, bits):
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(300)]), draw.choice(["é", "x" * 50, "", None]), draw.choice(["en"] * 8 + ["de", None, "", "ü", "zz", "a", "b"]), draw.choice(["s", None]), draw.choice([1, None, 20])) for _ in range(75)]
    rows += [rows[0]] * 3 + [(700, "only", "lone", "s", 4)]
    df = documents(spark, rows).withColumns({"tree": F.lit(1), "digest": F.lit("x"), "place": F.lit(3), "leaves": F.lit(4)}).repartition(4)
    got = sorted(map(tuple, merkle.tampered_manifest(df, bits=bits).collect()), key=repr)
    want = plain_manifest(rows)
    assert got == want and 0 < sum(not r[6] for r in want) < len(want)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 31])
def test_postorder_positions(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    height = merkle.levels(n)
    log = merkle.append_log(leaves, height)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    assert len(levels) == height + 1 and len(log) == 32 * sum(map(len, levels))
    for level, nodes in enumerate(levels):
        for at, node in enumerate(nodes):
            spot = 32 * merkle.postorder(level, at, n)
            assert log[spot : spot + 32] == node


def test_blocks_lie_at_their_positions_in_the_whole_log(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(37)]
    leaves = documents(spark, rows).select(
        F.lit("=en").alias("tree"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)).alias("digest"),
        F.lit(None).cast("binary").alias("changed"), F.col("doc_id").alias("row"),
    )
    trees, _ = merkle.manifest(leaves, bits=2)
    whole = merkle.append_log([hashlib.sha256(str(i).encode()).digest() for i in range(37)], merkle.levels(37))
    for r in trees[0].collect():
        log = bytes(r["log"])
        assert whole[32 * r["start"] : 32 * r["start"] + len(log)] == log


def test_manifest_edge_cases(spark):
    lone = documents(spark, [(None, None, None, None, None)])
    got = tuple(merkle.tampered_manifest(lone).first())
    leaf = hexed("-----")
    assert got == (None, leaf, leaf, leaf, hexed(""), leaf, True)
    assert merkle.tampered_manifest(lone.limit(0)).count() == 0
    long = documents(spark, [(1, "ä" * 400_000, "en", "s", 400_000)])
    assert merkle.tampered_manifest(long).first()["leaf"] == plain_leaf((1, "ä" * 400_000, "en", "s", 400_000))


# Registered queries


def test_registered_queries_use_their_contract(spark, tmp_path):
    rows = draw_documents(150, 5)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: queries.QUERIES[name](spark, str(tmp_path)) for name in ("op11_exact_dedup", "op12_source_divergence", "op13_merkle_manifest")}
    assert got["op11_exact_dedup"].columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got["op11_exact_dedup"].collect()), key=repr) == plain_owners(rows, True)
    assert sorted(map(tuple, got["op12_source_divergence"].collect())) == plain_divergence(rows, 30, 50)
    assert sorted(map(tuple, got["op13_merkle_manifest"].collect()), key=repr) == plain_manifest(rows)
