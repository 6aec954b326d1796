"""Small tests of the training-data operators against brute force, round trips and defined edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontamination, language_id, line_dedup, near_dedup, packing, quality, secret_scan, topk_search
from tracewell.llm import url_filter, warc
from tracewell.llm.graph import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, key string, cid long, label int, score double"


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n)]


def frame(spark, texts: list, lang: str = "en"):
    """Documents with ids from 1 on and columns whose names clash with the operators' own."""
    rows = [(i, t, lang, "k", 5, 1, 0.5) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def edited(text: list[str], at: list[int]) -> str:
    return " ".join(f"zz{i}" if i in at else w for i, w in enumerate(text))


@pytest.fixture(scope="module")
def texts():
    base = words(1, 120)
    copies = [edited(base, [i]) for i in range(0, 100, 7)] + [edited(base, [i, 50, 90]) for i in range(3)]
    return [" ".join(base), " ".join(base).upper(), *copies, "a b", "A  b", "", None, " \t\n", "w " * 30_000, " ".join(words(2, 90))]


def union(n: int, links) -> list[int]:
    top = list(range(n))
    for _ in range(n):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return top


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, draw.randint(101, 140)) for _ in range(50)] + [(7, 7), (200, 201)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["vertex"]: r["root"] for r in components(df, "a", "b").collect()}
    want = union(202, edges)
    assert got == {v: want[v] for e in edges for v in e}
    assert components(df.limit(0), "a", "b").count() == 0


def test_near_duplicates_equal_brute_force(spark, texts):
    known = near_dedup._WordHash()
    sets = [set(near_dedup.shingle_set(t, known).tolist()) for t in texts]
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    want = union(len(texts), links)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    for i, s in enumerate(sets):
        row = got[i + 1]
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(s), want[i] + 1, want[i] == i)


def test_near_duplicates_edge_cases(spark):
    text = " ".join(words(4, 40))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "x"), (2, None)], "doc_id long, text string")
    got = sorted(near_dedup.near_duplicates(rows).collect(), key=str)
    assert len(got) == 5
    assert all(r["component_id"] == 1 for r in got if r["n_shingles"] > 1)
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_lines_equal_brute_force(spark):
    base = words(5, 60)
    lines = [" ".join(base)] + [edited(base, [i]) for i in range(8)] + [edited(base, [i, i + 9, i + 20, i + 30]) for i in range(8)]
    texts = ["\n".join(lines[i : i + 4]) for i in range(14)] + ["", None, "x\n\n x ", " ".join(base).upper(), "日本語の文章です\n日本語の文章です"]
    import re

    pattern = re.compile(line_dedup.SHINGLE.replace("\\x{10FFFF}", "\U0010ffff"))
    order, sets = [], []
    for i, text in enumerate(texts, 1):
        for k, line in enumerate([] if text is None else text.split("\n")):
            order.append((i, k))
            sets.append({m.group(1) for m in pattern.finditer(line.strip(line_dedup.BLANKS).lower())})
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)
    ]
    want = union(len(order), links)
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_components(frame(spark, texts)).collect()}
    assert len(got) == len(order)
    for n, place in enumerate(order):
        first = order[want[n]]
        assert (got[place]["first_doc_id"], got[place]["first_line_no"]) == first
        assert got[place]["kept"] == (first == place)
    assert line_dedup.line_components(frame(spark, texts).limit(0)).count() == 0


def test_long_tokens_are_compared_whole(spark):
    links = [f"https://example.org/articles/{name}" for name in ("winter-in-the-hills", "bread-for-beginners", "0f9a81c27d")]
    got = line_dedup.line_components(frame(spark, ["\n".join(links), " \t" + links[0].upper() + "\r\x0b ", "\t", "\x0c"])).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got if not r["kept"]} == {(2, 0)}


def test_lines_are_alike_by_the_shingles_at_every_character(spark):
    line = "the harvest of apples in the valley began early this september morning"
    pairs = [(line, line + "."), ("every second winter the river froze over near the mill", "every second winter the river froze over near the mill >")]
    for a, b in [*pairs, ("seven c", "seven d")]:
        x, y = ({t[i : i + 8] for i in range(max(len(t) - 7, 1))} for t in (a, b))
        got = line_dedup.line_components(frame(spark, [a + "\n" + b])).collect()
        assert {r["line_no"] for r in got if not r["kept"]} == ({1} if 100 * len(x & y) >= 85 * len(x | y) else set())
        assert (a, b) not in pairs or 100 * len(x & y) >= 85 * len(x | y)
    found = {t: spark.createDataFrame([(t,)], "t string").select(line_dedup.shingles(F.col("t"))).first()[0] for t in ("abcdefghij", "abc", "日本語の文章です。")}
    assert found == {"abcdefghij": ["abcdefgh", "bcdefghi", "cdefghij"], "abc": ["abc"], "日本語の文章です。": ["日本語の文章です", "本語の文章です。"]}


def test_line_dedup_plan_has_no_python(spark, texts):
    plan = line_dedup.line_classes(line_dedup.occurrences(frame(spark, texts), "doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(TOKENIZER)
    texts = [*texts, "日本語 <|endoftext|> é "]
    rows = packing.packed(frame(spark, texts), TOKENIZER, RANKS, public_tokenizers.PATTERN).collect()
    for i, text in enumerate(texts, 1):
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for number, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or number == max(by)
    assert packing.packed(frame(spark, texts).limit(0), TOKENIZER).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def edit_distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_contaminated_equals_dynamic_programming(spark):
    draw = random.Random(6)
    items = [" ".join(words(s, 14)) for s in range(20, 26)] + ["short", "", None]
    texts = []
    for item in items[:6]:
        for edits in (0, 2, 5, 7, 12):
            chars = list(item)
            for at in draw.sample(range(len(chars)), edits):
                chars[at] = draw.choice(["", "q", chars[at] + "q"])
            texts.append(" ".join(words(draw.randint(0, 999), 30)) + " " + "".join(chars).upper() + "\n" + " ".join(words(7, 5)))
    texts += ["", None, "x" * 200_000, items[0]]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(frame(spark, texts), bench).collect()}
    for i, text in enumerate(texts, 1):
        for n, item in enumerate(items, 1):
            a, b = decontamination.normal_form(item), decontamination.normal_form(text)
            if not a or len(b) > 10_000:
                continue
            edits = edit_distance(a, b)
            assert got.get((i, n)) == (edits if edits <= decontamination.budget(a) else None)
    assert decontamination.contaminated(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontamination.contaminated(frame(spark, texts).limit(0), bench).count() == 0


def test_secret_spans(spark):
    key = "".join(random.Random(8).choices("ABCDEFGHKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789", k=40))
    texts = [
        'é Token = "abcdef12"', "token=token:abcdef", "AKIA" + "A" * 16 + " AKIAB", "f" * 24 + " " + "a" * 23, f"see {key} here",
        "sha A94A8FE5CCB19BA61C4C0873D391E987982FBBD3 and 123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name_2024",
        "", None, "x" * 100_000, "paſsword=abcdefg",
    ]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.secret_spans(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1] == [("assign", 2, 19)] and got[2] == [] and got[3] == [("access", 0, 20)] and got[4] == [("hex", 0, 24)]
    assert got[5] == [("random", 4, 44)]
    assert all(got[i] == [] for i in range(6, 12))


def test_random_strings_of_one_kind_are_found():
    lengths = secret_scan.TokenLengths(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(11)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for letters in (upper + "234567", upper + digits, upper.lower() + digits, upper):
        for size in (16, 32, 40):
            texts = [f"see {''.join(draw.choices(letters, k=size))} here" for _ in range(50)]
            texts = [t for t in texts if not secret_scan.base_spans(t)]
            assert all(secret_scan.random_spans(t, lengths, []) == [(4, 3, 4 + size)] for t in texts)
    names = "JBSWY3DPEHPK3PXP", "MAX_VALUE_OF_HTTP2_X", "some_long_identifier_name_2024", "1234567890123456", "=" * 40, "getHTTPResponseCode"
    assert [len(secret_scan.random_spans(t, lengths, [])) for t in names] == [1, 0, 0, 0, 0, 0]


PREFIXES = (
    "/home/application/configuration/settings/", "my-production-database-connection-", "/services/notifications/production/",
    "authorization_header_value=", "client_session_identifier=", "https://hooks.example.com/services/", "",
)


def test_random_strings_behind_readable_prefixes_are_found():
    lengths = secret_scan.TokenLengths(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(15)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for prefix in PREFIXES:
        missed = 0
        for _ in range(200):
            key = "".join(draw.choices(letters, k=24))
            spans = secret_scan.random_spans(f"see {prefix}{key} here", lengths, [])
            missed += not any(a <= 4 + len(prefix) and b == 28 + len(prefix) for a, _, b in spans)
        assert missed <= 4, (prefix, missed)
    readable = [p + "central-office/2024/monthly_report" for p in PREFIXES] + ["2024-01-02/03-04-05_067890"]
    assert all(secret_scan.random_spans(t, lengths, []) == [] for t in readable)


def test_spans_that_meet_an_earlier_one_are_left_out():
    lengths = secret_scan.TokenLengths(RANKS, public_tokenizers.PATTERN)
    keys = ["".join(random.Random(n).choices("ABCDEFGHKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789", k=40)) for n in range(4)]
    text = " ".join(keys)
    for taken in ([], [(0, 0, 3)], [(45, 0, 50), (90, 1, 91)], [(0, 0, 200)], [(40, 0, 41)]):
        got = secret_scan.random_spans(text, lengths, taken)
        want = [(41 * n, 3, 41 * n + 40) for n in range(4) if not any(a < 41 * n + 40 and 41 * n < b for a, _, b in taken)]
        assert got == want


def test_slugs_are_scanned_in_linear_time():
    import time

    lengths = secret_scan.TokenLengths(RANKS, public_tokenizers.PATTERN)
    slug = "how-to-configure-kubernetes-clusters-with-terraform-v2b"
    for text in ("/document" * 4 + "/A1b", slug, "/document" * 2_000 + "/A1b", slug * 300):
        began = time.perf_counter()
        assert secret_scan.random_spans(text, lengths, []) == []
        lengths.is_name(text)
        assert time.perf_counter() - began < 1


def test_url_rules_and_aliases(spark):
    link = '<link href="{}" rel="canonical">'.format
    pages = spark.createDataFrame([
        (1, "http://a.net/x", None), (2, "https://www.EXAMPLE.net/en/1?q", ""), (3, "http://example.com/de/1#f", "x"),
        (4, "http://plain.info/a", link("http://b.net/")), (5, "http://mirror.info/b/", link("http://plain.info/a")),
        (6, "http://both.info/", link("http://b.net/z") + '<meta property="og:url" content="http://c.org/fr/9">'),
        (7, "nothing", "x"), (8, None, None), (9, "http://b.info", None), (10, "http://free.info/", None),
    ], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("root", F.lit(2))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()}
    assert got[1] == ("net/", "block") and got[2] == ("example.net/en/", "allow") and got[3] == ("example.com/de/", "block")
    assert got[4] == (None, "block") and got[5] == (None, "block") and got[6] == (None, "allow")
    assert got[7] == got[8] == got[9] == got[10] == (None, "allow")
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_pages_are_aliases_by_edges_alone(spark):
    draw = random.Random(16)
    link = '<link rel="canonical" href="{}">'.format
    names = [f"http://{'r' if i % 3 else 'R'}.info/repo{i // 4}{end}" for i, end in enumerate(["", "?ref=main", "/", "/index.html", "?ref=dev", "#top"] * 6)]
    pages = [(i, u, link(draw.choice([*names, *["http://x.net/"] * 8, "http://y.org/fr/1"])) if draw.random() < 0.4 else None) for i, u in enumerate(names)]
    moved = [(names[3], "https://z.info"), ("https://Z.info/#a", names[20])]
    redirects = spark.createDataFrame(moved, "from_url string, to_url string")

    def vertex(u):
        scheme, rest = u.split("#")[0].split("://")
        host, slash, path = rest.partition("/")
        return f"{scheme}://{host.lower()}/{path}" if slash or "?" not in host else u

    edges = [(vertex(u), vertex(h.split('href="')[1].split('"')[0])) for _, u, h in pages if h] + [(vertex(a), vertex(b)) for a, b in moved]
    top = {v: v for e in edges for v in e} | {vertex(u): vertex(u) for u in names}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    groups = {}
    for v in top:
        groups.setdefault(top[v], set()).add(v)
    df = spark.createDataFrame([*pages, (90, None, None), (91, "nothing", link("http://x.net/")), (None, names[0], None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(df, redirects=redirects).collect()}
    for i, u, _ in pages:
        group = groups[top[vertex(u)]]
        want = "allow" if "http://y.org/fr/1" in group else "block" if "http://x.net/" in group else "allow"
        assert got[i] == want, u
    assert got[90] == got[91] == "allow" and got[None] == got[0] and len(got) == len(pages) + 3
    assert {"allow", "block"} == set(got.values())


def test_url_links_of_every_form(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://a.info/x/a.html", link("b.html")), (2, "http://a.info/x/b.html", """<meta http-equiv="refresh" content="0; url='http://b.net/'">"""),
        (3, "http://c.info/x/y/a", link("../b")), (4, "http://c.info/x/b", link("http://b.net/1")),
        (5, "http://d.info/x?q=1", link("?p=1")), (6, "http://d.info/x?p=1", "<meta http-equiv=refresh content=0;url=http://b.net/2>"),
        (7, "http://e.info", link("./z/../b.html?k=http://q.info/")), (8, "http://e.info/b.html?k=http://q.info/", link("http://b.net/3")),
        (9, "http://f.info/", link("http://g.info/") + link("http://b.net/4")), (10, "http://h.info/", link("#top") + link("mailto:a@b.net")),
        (11, "http://i.info/a/b/c", link("..")), (12, "http://i.info/a/", link("//b.net/5")), (13, "nothing", link("b.html")),
        (14, "http://j.info/a", '<meta http-equiv="refresh" content="0; url=&#39;http://b.net/6&#39;">'),
    ]
    got = {r["page_id"]: (r["verdict"], r["alias_of"]) for r in url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i for i, (verdict, _) in got.items() if verdict == "block"} == {*range(1, 10), 11, 12, 14}
    assert got[10] == got[13] == ("allow", None)


def test_warc_round_trip(spark, tmp_path):
    body = "<p>ä" * 50
    pages = spark.createDataFrame(
        [(3, "http://a/\r\nx", body), (1, None, body), (2, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", body), (6, "u", "z" * 300_000)],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit(1))
    files = warc.write_archives(pages, str(tmp_path / "archives"))
    got = {r["page_id"]: r for r in warc.read_archives(files).collect()}
    assert len(got) == 7 and all(r["verified"] for r in got.values())
    assert (got[3]["record_type"], got[3]["refers_to"], got[3]["payload"]) == ("revisit", 1, None)
    assert got[None]["refers_to"] == 1 and got[1]["record_type"] == got[5]["record_type"] == "response"
    assert bytes(got[1]["payload"]).decode() == body and got[2]["payload_bytes"] == 0
    assert got[3]["payload_digest"] == hashlib.sha256(body.encode()).hexdigest()
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_damage_is_seen():
    good = warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None)
    data = next(warc.members(iter([good[:7], good[7:]])))
    assert warc.parse(data)["verified"]
    assert not warc.parse(data.replace(b"abc", b"abd", 1))["verified"]
    with pytest.raises(ValueError):
        warc.parse(data[:-5])
    with pytest.raises(ValueError):
        list(warc.members(iter([good[:-9]])))


def test_quality_held_out(spark):
    good = [" ".join(words(s, 60)).capitalize() + "." for s in range(300, 380)]
    junk = ["!! ".join(w.upper() for w in words(s, 40)) for s in range(400, 480)]
    docs = frame(spark, good + junk + ["", None])
    labels = spark.createDataFrame([(i, int(i <= 80)) for i in range(1, 161) if i % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    assert sum(got[i]["predicted"] == int(i <= 80) for i in range(3, 161, 3)) >= 50
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 162
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in quality.scored(docs, labels.where("quality = 1")).collect()} == {1}


def test_quality_cut_covers_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_LABELLED", 40)
    texts = [" ".join(words(s, 60)).capitalize() + "." for s in range(300, 350)] + ["!! ".join(w.upper() for w in words(s, 40)) for s in range(400, 550)]
    docs = frame(spark, texts)
    labels = [(i, int(i <= 50 or i % 11 == 0)) for i in range(1, 201)]
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id", "text", "quality")
    raw = model.raw(np.array([quality.features(t) for t in texts]))
    label = np.array([v for _, v in labels])
    assert np.isclose(model.threshold, np.quantile(raw, (label == 0).mean()))
    assert np.isclose(model.slope, 4 / (np.median(raw[label == 1]) - np.median(raw[label == 0])))


def test_language_held_out(spark):
    langs = {"en": "the of and is with", "de": "der die und ist mit", "fr": "le la et est avec"}
    rows = []
    for lang, common in langs.items():
        draw = random.Random(lang)
        rows += [(" ".join(draw.choices(common.split(), k=30)), lang) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identified(docs, docs.where("doc_id % 4 <> 2")).collect()}
    assert all(got[i]["lang_pred"] == g for i, (_, g) in enumerate(rows))
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (None, "Über " * 50_000), (4, "")], "doc_id long, text string")
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(odd, docs).collect()}
    assert odd[1] == odd[2] == odd[4] == ("und", 0.0) and odd[None][0] in langs
    assert language_id.identified(docs, docs.limit(0)).where("lang_pred <> 'und'").count() == 0
    beyond = spark.createDataFrame([(1, "😀😀 🎉"), (2, "𝒜𝒷"), (3, "😀 12"), (4, "𐐀 😀")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.identified(beyond, docs).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_topk_equals_brute_force(spark):
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(300, 12)).astype(np.float32)
    vectors[100:200] = vectors[100]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 12), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    whole = np.floor(vectors.astype(float) * 1024).astype(np.int64)
    for q in range(0, 300, 20):
        scores = whole @ whole[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert [got[q, r] for r in range(1, 11)] == [(i, scores[i]) for i in order]
    assert len(got) == 150
    few = topk_search.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert topk_search.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_topk_is_complete_where_rows_share_an_id(spark):
    draw = np.random.default_rng(10)
    vectors = draw.normal(size=(42, 6)).astype(np.float32)
    ids = [100] * 3 + list(range(1, 40))
    rows = list(zip(ids, vectors.tolist()))
    df = spark.createDataFrame([(int(i), v) for i, v in rows] + [(100, vectors[0].tolist())], "vec_id long, embedding array<float>")
    got = topk_search.nearest(df, F.col("vec_id") == 100).collect()
    whole = np.floor(vectors.astype(float) * 1024).astype(np.int64)
    want = []
    for q in range(3):
        order = sorted((r for r in range(42) if r != q), key=lambda r: (-(whole[r] @ whole[q]), ids[r]))[:10]
        want += [(100, n, ids[r], int(whole[r] @ whole[q])) for n, r in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 30


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    clean = ["\n".join(" ".join(words(900 + 5 * s + k, 30)) for k in range(4)) for s in range(8)]
    item = " ".join(words(5000, 30))
    leak = " ".join(words(5001, 40)) + " " + item + " " + " ".join(words(5002, 40))
    base = words(5003, 200)
    shared = clean[4] + "\n" + clean[0].split("\n")[0]
    rows = [(None, t) for t in (clean[0], clean[1], leak, "12 34", " ".join(base), edited(base, [9, 80]))]
    rows += [(7, clean[2]), (7, clean[3]), (7, leak), (7, shared), (8, clean[5]), (8, clean[5]), (None, clean[6]), (None, clean[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), f"test-{name}")
    want = [(None, clean[0]), (None, clean[1]), (None, " ".join(base)), (7, clean[2]), (7, clean[3]), (7, clean[4]), (8, clean[5]), (None, clean[6])]
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    other = [(None, edited(base, [9, 80])) if t == " ".join(base) else (i, t) for i, t in want]
    assert sorted(got, key=str) in (sorted(want, key=str), sorted(other, key=str))
    # Each stage by itself, on rows without a key and with texts that line dedup has not yet cut.
    twice = spark.createDataFrame([(1, clean[0], "en", "s", 1), (1, clean[0], "en", "s", 1), (1, clean[1], "en", "s", 1)], docs.schema.names[:5])
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.drop_near_duplicates):
        assert sorted(r["text"] for r in stage(spark, twice, str(tmp_path)).collect()) == sorted(clean[:2])


def test_pipeline_rejects_unlearned_languages(spark):
    import corpus_pipeline

    clean = [" ".join(words(s, n)) for s, n in enumerate([1, 2, 3, 5, 20, 300] * 10)]
    draw = random.Random(12)
    other = [" ".join("".join(draw.choices(letters, k=6)) for _ in range(n)) for letters in ("абвгдежзиклмноп", "あいうえおかきくけこ", "mnopqrstuvwxyz") for n in (5, 50, 500)]
    rows = [(i, t, "en" if i <= len(clean) else None, "s", len(t)) for i, t in enumerate(clean + other, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["text"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == set(clean)


def test_pipeline_keeps_clean_documents_and_drops_copies(spark, tmp_path):
    import corpus_pipeline

    clean = ["\n".join(" ".join(words(900 + 5 * s + k, 30)) for k in range(4)) for s in range(12)]
    item = " ".join(words(5000, 30))
    leak = " ".join(words(5001, 40)) + " " + item + " " + " ".join(words(5002, 40))
    base = words(5003, 200)
    texts = [*clean, clean[0], leak, " ".join(base), edited(base, [9, 80]), "12 34", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert kept == {*range(1, 13), 15}


def test_pipeline_without_languages_rows_or_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, row_key long, cut string, bad long"
    texts = ["\n".join(" ".join(words(700 + 9 * s + k, 25)) for k in range(3)) for s in range(4)] + [None, "x " * 60_000]
    rows = [(i, t, None, "s", len(t or ""), None if i % 2 else 7, "c", 1) for i, t in enumerate(texts)]
    for name, some in (("all", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, str(folder)).select("doc_id").distinct().collect()
        assert {r["doc_id"] for r in packed} == ({0, 1, 2, 3, 4, 5} if some else set())
    docs = spark.createDataFrame([(1, "a\nb b b b\na\n\nc", "en", "s", 3), (2, "z\na\ny", "en", "s", 3)], kind.split(", row_key")[0])
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert cut == {1: ("a\nb b b b\n\nc", 12), 2: ("z\ny", 3)}


def test_pipeline_hands_texts_to_python_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    import pyarrow as pa

    from tracewell.session import ARROW_BYTES, BATCH_BYTES

    def batch_bytes(spark, docs, sf_dir):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).nbytes], pa.int64())], ["n"])

        return docs.select("text").mapInArrow(run, "n long")

    texts = spark.range(0, 1200, 1, 1).select(F.repeat(F.lit("lorem ipsum "), 1000).alias("text"))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", batch_bytes), ("last", lambda spark, docs, sf_dir: docs)])
    sizes = [r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(sizes) >= 1200 * 12_000 and max(sizes) <= 1.1 * BATCH_BYTES
    assert spark.conf.get(ARROW_BYTES, None) is None


def test_leading_shingles_find_every_alike_pair(spark):
    """Members that are alike and share a shingle their centre has not share a leading one, and leading ones are few."""
    import itertools
    import random

    from pyspark.sql import functions as F

    from tracewell.llm import line_dedup

    draw = random.Random(4)
    centre = set(range(100))
    members = []
    for _ in range(12):
        whole = set(draw.sample(range(100), draw.randrange(0, 60))) | {draw.randrange(10**9) for _ in range(draw.randrange(8, 90))}
        for _ in range(4):
            kept = {s for s in whole if draw.random() > 0.05}
            members.append(sorted(kept | {draw.randrange(10**9) for _ in range(draw.randrange(5))}))
    rows = [(i, [s for s in m if s not in centre], len(m)) for i, m in enumerate(members)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "cid long, own array<long>, n int")
    led = {r["cid"]: r["own"] for r in df.select("cid", line_dedup._leading(F.col("own"), F.col("n")).alias("own")).collect()}
    assert all(len(led[i]) <= 15 * n // 100 + 1 and set(led[i]) <= set(own) for i, own, n in rows)
    found = 0
    for (i, own, _), (j, other, _) in itertools.combinations(rows, 2):
        a, b = set(members[i]), set(members[j])
        if 100 * len(a & b) >= 85 * len(a | b) and set(own) & set(other):
            found += 1
            assert set(led[i]) & set(led[j])
    assert found > 20
