"""The queries over the whole of the smallest tables, against brute force; and the pipeline stage by stage."""

import hashlib
import os
import re

import pytest

import corpus_pipeline
from seamline.llm import queries
from tests.llm.test_nearcopies import slow_least
from tests.llm.test_operators import slow_hits
from tests.llm.test_simhash import slow_components, slow_print

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def classes(prints, radius):
    """Least id of the component of each id."""
    by = {}
    for i, p in prints.items():
        by.setdefault(p, []).append(i)
    out = {i: min(ids) for ids in by.values() for i in ids}
    for part in slow_components(set(by), radius):
        ids = [i for p in part for i in by[p]]
        out |= dict.fromkeys(ids, min(ids))
    return out


def test_op1(spark, documents):
    prints = {i: slow_print(t) for i, t in documents.items()}
    want = classes(prints, 3)
    got = queries.op1_simhash(spark, SF).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{p:016x}", want[i]) for i, p in prints.items())


def test_op2(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for r in queries.op2_url_filter(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        rest = r["url"].split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0] + best[1])
        assert r["verdict"] == (best[2] if best else "allow")


def test_op6(spark, documents):
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for r in queries.op6_secrets(spark, SF).collect():
        found = []
        for k, (name, pattern) in enumerate(kinds.items()):
            found += [(m.start(), k, m.end(), name) for m in pattern.finditer(documents[r["doc_id"]]) if len(m[2] if name == "assign" else m[0]) >= (12, 18, 16)[k]]
        found.sort()
        base = ",".join(f"{name}:{s}:{e}" for s, _, e, name in found)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == k for f in found) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, seen = docs, {}
    for name, f in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(f(spark, now, SF), "test")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "BPE encoding and decoding":
            assert sorted(now.columns) == sorted(docs.columns)
    tox, lines, near, clean, tokens = seen.values()
    assert set(lines) == set(tox) <= set(documents) and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert all(r["text"] == documents[i] for i, r in tox.items())
    assert set(tox) == {r["doc_id"] for r in queries.op3_toxicity(spark, SF).where("predicted = 0").collect()}
    want = slow_least([(i, r["text"]) for i, r in lines.items()])
    assert set(near) == {i for i, least in want.items() if i == least}
    assert set(clean) == {i for i, r in near.items() if slow_hits(r["text"], bench)[2] == 0}
    assert set(tokens) == set(clean)
    assert all(r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest() for i, r in tokens.items())
