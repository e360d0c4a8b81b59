import random

import pytest

from seamline.llm import nearcopies


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_least(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, slow_set(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize(("part_sets", "bound"), [(2048, 500_000), (3, 2)])
def test_components_of_verified_links(spark, part_sets, bound):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows, n = [(0, None), (1, " "), (2, "one two"), (3, "ONE two"), (4, "one two three")], 5
    for _ in range(30):
        base = [word() for _ in range(rnd.choice([30, 60, 200]))]
        for _ in range(rnd.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    # a passage of half the text in many documents: SimHash is near, the shingles are not
    half = [word() for _ in range(100)]
    for _ in range(6):
        rows.append((n, " ".join(half + [word() for _ in range(60)])))
        n += 1
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), part_sets=part_sets, broadcast_ids=bound).collect()}
    assert got == slow_least(rows)
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
