"""Components against plain search, and the number of rounds on ordered chains."""

import math
import random

import pytest

from seamline.operators import components


def slow(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("finish", [0, 10_000])
def test_components(spark, finish):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(500, k) for k in range(501, 560)] + [(None, 1), (2, None), (7, 7), (300, 301), (301, 300), (300, 301)]
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", finish).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == slow(pairs)
    named = [(str(a), str(b)) for a, b in pairs if a is not None and b is not None]
    got = components.connected_components(spark.createDataFrame(named, "src string, dst string"), finish_edges=finish).collect()
    assert {r["node"]: r["component"] for r in got} == slow(named)
    assert components.connected_components(spark.createDataFrame([], "src string, dst string"), finish_edges=finish).count() == 0


@pytest.mark.parametrize("links", [24, 1000])
def test_ordered_chains_need_few_rounds(spark, monkeypatch, links):
    names = []
    monkeypatch.setattr(components, "stage", lambda df, name, f=components.stage: (names.append(name), f(df, name))[1])
    got = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(links)], "src long, dst long"), finish_edges=0).collect()
    assert {(r["node"], r["component"]) for r in got} == {(k, 0) for k in range(links + 1)}
    assert names.count("hook") <= math.log2(links) + 2
