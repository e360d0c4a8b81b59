"""The fitted models against plain Python, and their accuracy on the rows they do not learn from."""

import math
import os
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import bpe, langid, queries, secrets, toxicity
from seamline.llm.sample import bounded_sample

DATA = "/root/testdata"
tables = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="the tables are not here")


def slow_forward(net, words):
    """One window's logit, a word and a gate at a time."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))

    def vector(word):
        marked, rows = b"^" + word, []
        starts = [marked[:n] for n in range(3, 12) if n <= len(marked) and marked[:n] in net.grams]
        rows += [net.grams[starts[-1]]] if starts else []
        for i in range(1, len(word)):
            here = [word[i : i + n] for n in (3, 4, 5) if i + n <= len(word) and word[i : i + n] in net.grams]
            rows += [net.grams[here[-1]]] if here else []
        return [*p["word"][net.index.get(word, 0)], *[max(p["char"][r][k] for r in rows or [0]) for k in range(toxicity.CHAR_DIM)]]

    x = [vector(w) for w in words]
    states = [[0.0] * 2 * h for _ in words]
    for d, name in enumerate("fb"):
        s = [0.0] * h
        for i in range(len(words)) if d == 0 else reversed(range(len(words))):
            a = [sum(x[i][j] * p[f"in_{name}"][j][k] for j in range(len(x[i]))) + p[f"b_{name}"][k] for k in range(3 * h)]
            r = [sum(s[j] * p[f"rec_{name}"][j][k] for j in range(h)) for k in range(3 * h)]
            z = [sig(a[k] + r[k]) for k in range(h)]
            g = [sig(a[h + k] + r[h + k]) for k in range(h)]
            c = [math.tanh(a[2 * h + k] + g[k] * r[2 * h + k]) for k in range(h)]
            s = [s[k] + z[k] * (c[k] - s[k]) for k in range(h)]
            states[i][d * h : (d + 1) * h] = s
    e = [sum(v * w for v, w in zip(st, p["att"], strict=True)) for st in states]
    w = [math.exp(v - max(e)) for v in e]
    pooled = [sum(w[i] * states[i][k] for i in range(len(words))) / sum(w) for k in range(2 * h)] if words else [0.0] * 2 * h
    return sum(v * o for v, o in zip(pooled, p["out"], strict=True)) + p["bias"][0]


def small_net():
    net = toxicity.Network([b"vile", b"ab", b"fine"], [b"^vi", b"^vil", b"ile", b"ine", b"^fin", b"bcd"])
    rnd = np.random.default_rng(4)
    net.p = {k: (rnd.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in net.p.items()}
    return net


def test_network_against_plain_python():
    net, rnd = small_net(), random.Random(6)
    texts = [[rnd.choice([b"vile", b"ab", b"fine", b"vilest", b"xyz", b"abcde", b"b"]) for _ in range(n)] for n in (0, 1, 5, 32, 33, 50, 90)]
    for words, got in zip(texts, toxicity.Scorer(net).score_words(texts), strict=True):
        want = max(slow_forward(net, words[i : i + toxicity.WINDOW]) for i in toxicity.window_starts(len(words)))
        assert math.isclose(got, 1 / (1 + math.exp(-want)), rel_tol=1e-3, abs_tol=1e-5)


def test_network_gradients():
    net = small_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"vile", b"vilest", b"fine", b"xyz"]
    slots, ids, lengths, y = net.slots(words), np.array([[0, 1, 2, 3], [3, 2, 0, 0]]), np.array([4, 2]), np.array([1.0, 0.0])

    def loss():
        z = net.forward(net.gates(net.inputs(slots)), ids, lengths).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grad = net.gradients(slots, ids, lengths, y)
    for name, x in net.p.items():
        for at in [tuple(np.random.default_rng(k).integers(0, s) for s in x.shape) for k in range(4)]:
            held = x[at]
            x[at] = held + 1e-2
            up = loss()
            x[at] = held - 1e-2
            down = loss()
            x[at] = held
            assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3, name


def test_windows_hold_every_passage():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        starts = list(toxicity.window_starts(n))
        for a in range(max(0, n - toxicity.STRIDE)):
            assert any(s <= a and a + toxicity.STRIDE < s + toxicity.WINDOW for s in starts)


@tables
@pytest.mark.parametrize(("sf", "recall", "precision"), [("sf0.01", 0.75, 0.9), ("sf0.1", 0.9, 0.88)])
def test_toxicity_on_held_out_rows(spark, sf, recall, precision):
    labels = spark.read.parquet(f"{DATA}/{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, f"{DATA}/{sf}").where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    hit = sum(r["predicted"] and r["toxic"] == 1 for r in rows)
    assert hit >= recall * sum(r["toxic"] == 1 for r in rows)
    assert hit >= precision * sum(r["predicted"] for r in rows)


def slow_words(text):
    """Runs of letters, by category."""
    return "".join(c if unicodedata.category(c).startswith("L") else " " for c in (text or "").lower()).split()


def slow_language(model, text):
    """Sums of each word's log-probabilities, the backoff written out."""
    langs, totals, units = model["langs"], model["totals"], model["units"]

    def score(n, u, k):
        return math.log((dict(units[n][u]).get(k, 0) or 0.5) / (totals[n][k] + 1))

    total, words = [0.0] * len(langs), slow_words(text)
    for word in words:
        if word in units[0]:
            for k in range(len(langs)):
                total[k] += score(0, word, k)
            continue
        rest, found = f"^{word}$", []
        while rest:
            n = next((n for n in (5, 4, 3, 2, 1) if len(rest) >= n and rest[:n] in units[n]), None)
            if n:
                found.append((n, rest[:n]))
            rest = rest[n or 1 :]
        for k in range(len(langs)):
            total[k] += sum(score(n, u, k) for n, u in found) / len(found) if found else 0.0
    if not words:
        return "und", 0.0
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp((t - total[best]) / math.sqrt(len(words))) for t in total)


@tables
def test_language_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs.where(queries.fold(F.col("doc_id")) != 1))
    counts = Counter((r["lang"], w) for i, r in rows.items() if zlib.crc32(str(i).encode()) % 3 != 1 and r["lang"] is not None for w in slow_words(r["text"]))
    known = {(w, model["langs"][k]): n for w, of in model["units"][0].items() for k, n in of}
    assert known == {(w, lang): n for (lang, w), n in counts.items() if n >= 3}
    assert model["totals"][0] == [sum(n for (x, _), n in counts.items() if x == lang) for lang in model["langs"]]
    for r in queries.op7_language(spark, f"{DATA}/sf0.001").collect():
        lang, score = slow_language(model, rows[r["doc_id"]]["text"])
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-9)


@tables
def test_language_on_held_out_rows(spark):
    got = queries.op7_language(spark, f"{DATA}/sf0.01").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_numerals_are_no_letters(spark):
    model = langid.fit(spark.createDataFrame([(1, "der die das", "de"), (2, "le la les", "fr")], "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(None, "½ ²"), (2, "①"), (3, "la² les½"), (4, None)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(asked, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == ["und", "und", "fr", "und"]


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    df = spark.range(5000).select("id", F.lit("x").alias("v"))
    one, two = (sorted(r["id"] for r in bounded_sample(df.repartition(n), "id", 300).collect()) for n in (1, 7))
    assert one == two and 200 < len(one) <= 300
    same = spark.range(900).select(F.lit(None).cast("long").alias("id"), F.lit("x").alias("v"))
    assert bounded_sample(same, "id", 100).count() == 100 and bounded_sample(df, "id", 5000).count() == 5000


def slow_ownership(rows):
    """{hash: (n_repos, n_owners)} of the mixed strings and base values of rows (owner, text)."""
    seen = {}
    for owner, text in rows:
        base = secrets.base_spans(text or "")
        for *_, value in base + secrets.mixed_spans(text or "", base):
            repos, owners = seen.setdefault(value, (set(), set()))
            repos.add(text)
            owners.add(owner or "")
    return {v: (len(r), len(o)) for v, (r, o) in seen.items()}


@tables
def test_ownership_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "source")
    live, wide = "Zq9" * 8, "aB3" * 9
    more = [(10**6 + k, f"key {live} copied", "one") for k in range(30)] + [(2 * 10**6 + k, f"{wide} in {k}", f"s{k % 3}") for k in range(9)] + [(3 * 10**6 + k, f"{'qW7' * 7} of {k}", "many") for k in range(21)] + [(None, f"{live} é {live}", "one"), (7, None, None)]
    every = docs.union(spark.createDataFrame(more, docs.schema))
    rows = [(r["source"], r["text"], r["doc_id"]) for r in every.collect()]
    want = slow_ownership([(o, t) for o, t, _ in rows])
    got = secrets.scan(every).collect()
    assert len(got) == len(rows)
    texts = {}
    for o, t, i in rows:
        texts.setdefault(i, []).append(t or "")
    added = 0
    for r in got:
        text = texts[r["doc_id"]][0]
        base = secrets.base_spans(text)
        cand = [(s, k, e, v) for s, k, e, v in sorted(base + secrets.mixed_spans(text, base))]
        expect = [(s, k, e, *want[v], want[v][1] <= 1 and want[v][0] <= 20) for s, k, e, v in cand if k < 3 or want[v][1] <= 1 and want[v][0] <= 20]
        if len(texts[r["doc_id"]]) == 1:
            assert [(s["start"], s["kind"], s["end"], s["n_repos"], s["n_owners"], s["live"]) for s in r["spans"]] == expect
            added += sum(s["kind"] == 3 for s in r["spans"])
    assert added == 30 + 2  # thirty copies of one text are one repository; nine texts of three owners and 21 texts of one are examples


def test_every_character_splits_as_in_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Encoder(bpe.default_vocabulary())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}!" for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    assert all(t.encode(x, add_special_tokens=False).ids == bpe.ids_of(p).tolist() for x, p in zip(texts, e.encode_batch(texts), strict=True))


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"ignore_merges": True}}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.Encoder(str(path))


