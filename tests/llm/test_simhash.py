import random

import pytest
import xxhash

from seamline.llm import simhash


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints, radius):
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    out = {}
    for p in ps:
        out.setdefault(root(p), set()).add(p)
    return {frozenset(v) for v in out.values() if len(v) > 1}


TEXTS = [None, "", "  \n", "One", "one TWO", "a b c", "a  b\tc", "É é É x y", "a b c a b c a b c", "nbsp here b c d", "word " * 5000 + "end"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize(("radius", "blocks", "limit"), [(3, 4, 4096), (3, 4, 5), (7, 4, 4096), (7, 4, 7)])
def test_links_span_the_components(spark, radius, blocks, limit):
    rnd = random.Random(radius * limit)
    prints = {rnd.getrandbits(64) for _ in range(40)} | {0, 1}
    for p in list(prints):
        for _ in range(rnd.choice([0, 1, 4])):
            for b in rnd.sample(range(64), rnd.randint(1, radius + 1)):
                p ^= 1 << b
            prints.add(p)
    prints |= {0xABCD << 48 | rnd.getrandbits(20) for _ in range(60)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = [(a & simhash.MASK, b & simhash.MASK) for a, b in simhash.links(df, radius, blocks, limit).collect()]
    assert all(a in prints and b in prints for a, b in got)
    up = {p: {p} for p in prints}
    for a, b in got:
        if up[a] is not up[b]:
            both = up[a] | up[b]
            for x in both:
                up[x] = both
    assert {frozenset(x) for x in up.values() if len(x) > 1} == slow_components(prints, radius)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base.upper(), "x"), (9, base.replace("w200 ", ""), "x"), (7, None, "x"), (8, "", "x"), (None, " ", "x"), (5, base, "x"), (1, "something else entirely here", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert len(got) == len(rows)
    prints = {p: min((i for i, t, _ in rows if i is not None and (slow_print(t) ^ p).bit_count() <= 3), default=None) for p in {slow_print(t) for _, t, _ in rows}}
    want = sorted(((i, f"{slow_print(t):016x}", prints[slow_print(t)]) for i, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
