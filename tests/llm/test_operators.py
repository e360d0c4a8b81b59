"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import hashlib
import random
import re
from urllib.parse import urljoin, urlsplit

import duckdb

import pytest
from pyspark.sql import functions as F

from seamline.llm import bpe, decontaminate, exact, langid, licenses, lines, queries, secrets, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, host string, spans int"
LONG = "the long text goes on. " * 4000


def docs(spark, texts, source="s"):
    rows = [(i, t, None, source, None, "clash", "clash", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


CASES = [(1, None), (2, ""), (3, "Same Text here"), (4, "same text HERE"), (9, "same text here"), (9, "same text here"), (5, LONG), (6, LONG.upper()), (None, "É same"), (7, "é same")]


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, monkeypatch, clash):
    if clash:  # every chunk has one key: identifiers need their SHA-256
        one_key = lambda x: F.struct(F.lit(1).cast("long").alias("key"), x["sha"].alias("sha"))
        monkeypatch.setattr(exact, "with_chunks", lambda d, c, f=exact.with_chunks: f(d, c).withColumn("chunks", F.transform("chunks", one_key)))
    got = exact.exact_duplicates(docs(spark, CASES)).collect()
    assert len(got) == len(CASES)
    groups = {}
    for i, t in CASES:
        groups.setdefault(ascii_lower(t), []).append(i)
    for r in got:
        same = [g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        ids = [i for i in same[0] if i is not None]
        assert r["group_size"] == len(same[0]) and r["keep_id"] == max(ids, default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.exact_duplicates(docs(spark, [])).count() == 0


def test_chunks_cover_and_follow_content():
    gear, rnd = exact._gear(), random.Random(3)
    data = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    ends = exact.boundaries(data, gear)
    assert ends[-1] == len(data) and all(0 < b - a <= 8192 for a, b in zip([0, *ends], ends, strict=False))

    def cut(d):
        e = exact.boundaries(d, gear)
        return {d[a:b] for a, b in zip([0, *e], e, strict=False)}

    assert len(cut(data) & cut(b"shifted by this" + data)) > len(ends) * 0.8
    assert exact.boundaries(b"", gear) == []


def test_lines(spark):
    texts = [(i, f"Menu \nown {i}\n\nMenu") for i in range(9)] + [(20, "plain"), (21, None), (22, ""), (0, "Menu \nown 0\n\nMenu")]
    d = docs(spark, texts, None)
    want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") != "Menu"), 0 if t is None else t.count("\n") + 1, 0 if t is None else sum(x.strip(" ") == "Menu" for x in t.split("\n"))) for i, t in texts)
    for bound in (100, 0):  # sent to the tasks, and joined
        got = lines.drop_boilerplate(d, ratio=0.5, broadcast_lines=bound)
        assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == want
        assert got.columns == [*d.columns, "n_lines", "n_dropped"]
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0


def test_lines_of_copies(spark):
    """A page copied 50 times keeps its lines; a line in the frame of distinct pages goes from the copies too."""
    texts = [(i, "Frame\ncopied") for i in range(50)] + [(100 + i, f"Frame\nown {i}") for i in range(20)] + [(200, "twice"), (201, "twice\nx")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs(spark, texts)).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x != "Frame") for i, t in texts}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, None) for i, t in [*texts, (300, None), (301, "")]])
    found = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["op4_line_dedup"]).fetchall()}
    full = lines.drop_boilerplate(docs(spark, [*texts, (300, None), (301, "")], None)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in full} == found


def slow_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        for k in range(max(1, len(w) - 7)) if w else ():
            win = w[k : k + 8]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontamination(spark, block):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "b", "c", "é1", "x9"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([9, 12, 3, 1, 8, 0, 30])] + [(10, None), (2, "second of two"), (None, "a")]
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(25)] + [(30, None), (31, ""), (32, items[1][1].upper() + "!"), (32, LONG), (33, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.summary(decontaminate.contamination(docs(spark, texts), bench, block_chars=block)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *slow_hits(t, [x for x in items if x[0] is not None])) for i, t in texts), key=repr)
    none = decontaminate.summary(decontaminate.contamination(docs(spark, texts), bench.limit(0)))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_secrets(spark):
    key, live = "AKIA" + "A1B2C3D4E5F6G7H8", "zQ9" * 9
    texts = [(1, f'password = "{"x" * 12}" é {key} deadbeefdeadbeef'), (2, None), (3, "token: short"), (4, f"secret=token=abcdefghijkl {key}"), (5, live), (5, live), (6, "ſecret: abcdefghijklmnop"), (7, "a" * 15), (8, "API_KEY:" + "k" * 5000)]
    got = {r["doc_id"]: r for r in secrets.summary(secrets.scan(docs(spark, texts))).collect()}
    assert [(got[1][c]) for c in ("n_assign", "n_access", "n_hex")] == [1, 1, 1]
    assert got[1]["spans"].startswith("assign:0:24,access:28:48,hex:49:65")
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[3]["n_assign"], got[4]["n_assign"], got[6]["n_assign"], got[7]["n_hex"], got[8]["n_assign"]) == (0, 1, 0, 0, 1)
    assert got[5]["spans"] == "mixed:0:27"  # one owner's
    wide = docs(spark, [(i, live) for i in range(3)], "a").union(docs(spark, [(i + 5, live) for i in range(3)], "b"))
    assert {r["spans"] for r in secrets.summary(secrets.scan(wide)).collect()} == {""}  # copied by two owners: an example
    assert secrets.scan(docs(spark, [])).count() == 0


def test_language(spark):
    texts = [(i, "der die und nicht mit ein haus") for i in range(30)] + [(i + 40, "the and with not house over") for i in range(30)]
    train = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 40, "de").otherwise("en"))
    model = langid.fit(train)
    asked = docs(spark, [(1, "Die häuser"), (2, "the houses"), (3, None), (4, "123 !?"), (5, ""), (6, "THE " * 20_000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(asked, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["de", "en", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.identify(asked, langid.fit(train.limit(0))).collect()} == {"und"}


def test_licenses(spark):
    texts = [(1, "Text. Released under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (4, "released under the mit license but not quite"), (5, "x.\nLICENSED under CC-BY-NC 4.0!"), (6, LONG)]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["license"]) for r in licenses.recognise(docs(spark, texts)).collect()}
    assert got[1] == ("mit_ref,reserved", "MIT,LicenseRef-reserved", "MIT") and got[5][2] == "CC-BY-NC-4.0"
    assert got[2] == got[3] == got[4] == got[6] == ("", "", None)
    three = [("One", ["x", "y"]), ("Two", ["y"])]
    seq = licenses.recognise(docs(spark, [(1, "a b.\nother\nc d."), (2, "c d.\na b.")]), rules=three, sentences={"x": ["a b"], "y": ["c d"]})
    assert {r["doc_id"]: r["licenses"] for r in seq.collect()} == {1: "One,Two", 2: "Two"}


def page(target, kind="canonical"):
    return f"<html><link href='{target}' rel=canonical></html>" if kind == "canonical" else f'<META http-equiv="refresh" content="0; URL={target}">'


def test_resolve(spark):
    """Against the standard library's rules, fragments aside."""
    bases = ["http://a.org/b/c/d?q", "http://a.org", "http://a.org/x/"]
    hrefs = ["g", "./g", "g/", "/g", "//h.org/g", "?y", "g?y", "#s", "g#s", "g?y#s", "../g", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", ".g", "./g/.", "g/./h", "g/../h", "..", ".", "../", "../..", "g?y/../x", "http://k.org/../z", "x?u=http://y.org/"]
    d = spark.createDataFrame([(u, h) for u in bases for h in hrefs], "url string, href string")
    key = {(r["url"], r["href"]): r["key"] for r in d.select("url", "href", urls.alias_key(urls.resolve(d["href"], d["url"])).alias("key")).collect()}
    for (u, h), got in key.items():
        whole = h if "://" in h.split("?")[0] else urljoin(u, h)
        x = urlsplit(whole)
        assert got == x.netloc + (x.path or "/") + (x.query and "?" + x.query), (u, h)


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/en/x?q", ""), (2, "https://www.example.com/en/y", ""), (3, "http://x.org/1", page("http://s.example.com/en/z")), (4, "http://x.org/2", page("/1", "refresh")), (5, None, page("http://s.example.com/en/z")),
        (6, "no scheme", None), (7, "http://y.org/1", page("http://s.net/es/a")), (8, "http://y.org/1#frag", page("http://fine.com/ok", "refresh")), (9, "http://net/fr/", None), (10, "http://b.org", page("http://c.org/")), (3, "http://x.org/1", ""), (11, "http://example.com", None),
        (12, "http://d.org/a/b/c?k=1", page("../../bad?x=1&amp;y=2")), (13, "http://d.org/bad?x=1&y=2", page("http://s.net/fr/q")), (14, "http://e.org/", '<base href="//f.org/p/q"><link rel="canonical" href="./r">'), (15, "http://f.org/p/r", page("http://s.net/es/")),
        (16, "http://g.org/1", page("mailto:x@s.net") + page("http://clean.org/") + page("http://s.net/fr/")), (17, "http://h.org/d/e?k", page("?k=2")), (18, "http://h.org/d/e?k=2", page("http://s.net/es/h")),
    ]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    seen = sorted({(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got}, key=repr)
    assert len(got) == len(rows)
    assert seen == sorted([
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/y", "www.example.com/en/", "allow"), (3, "x.org", "/1", None, "block"), (4, "x.org", "/2", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "y.org", "/1", None, "allow"), (8, "y.org", "/1", None, "allow"), (9, "net", "/fr/", "net/fr/", "block"), (10, "b.org", "", None, "allow"), (11, "example.com", "", None, "allow"),
        (12, "d.org", "/a/b/c", None, "block"), (13, "d.org", "/bad", None, "block"), (14, "e.org", "/", None, "block"), (15, "f.org", "/p/r", None, "block"), (16, "g.org", "/1", None, "block"), (17, "h.org", "/d/e", None, "block"), (18, "h.org", "/d/e", None, "block"),
    ], key=repr)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted({tuple(r) for r in con.execute(queries.ORACLE_SQL["op2_url_filter"]).fetchall()}, key=repr) == seen


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(8)
    texts = [None, "", "aaaa" * 50, "<|endoftext|>x <|endoftext|>", LONG, "\x00é\U0001f600  \t\n"] + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2000)])) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    d = docs(spark, [(i % 150, x) for i, x in enumerate(texts)])
    want = []
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        sha = hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in e)).hexdigest()
        want.append((i % 150, len(e), sha, hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(d).collect())) == sorted(want)
    back = bpe.decode(bpe.encode(d), text="again").select("text", "again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back)


def test_toxicity(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    made = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 90))) + (" VILE" if i % 4 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in made] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs(spark, made), labels, steps=200)
    asked = docs(spark, [(1000, "w1 w2 vile w3"), (1001, "w1 w2 w3"), (1002, None), (1003, ""), (1004, "w5 " * 30_000 + "vile"), (1001, "w1 w2 w3")])
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.with_score(asked, net).collect()}
    assert [got[k][1] for k in (1000, 1001, 1002, 1003, 1004)] == [1, 0, 0, 0, 1]
    assert all(0 <= s <= 1 for s, _ in got.values()) and got[1002] == got[1003]
    assert toxicity.with_score(asked.limit(0), toxicity.fit(docs(spark, []), labels)).count() == 0


def test_queries_have_oracles_of_their_own_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
