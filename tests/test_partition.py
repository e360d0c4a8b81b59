from seamline.operators.partition import betweenness, default_level, ladder, quality, select_level


def test_modularity_by_hand():
    # the worked value: m = 10.5, two groups with 7 and 2 inside and 15.5 and 5.5 at their nodes
    edges = {("a1", "a2"): 7.0, ("b1", "b2"): 2.0, ("a1", "b1"): 1.5}
    assert abs(quality(edges, [["a1", "a2"], ["b1", "b2"]]) - 0.24376417233560083) < 1e-12


def test_betweenness_of_a_path():
    near = {"a": {"b": 1.0}, "b": {"a": 1.0, "c": 1.0}, "c": {"b": 1.0}}
    assert betweenness(["a", "b", "c"], near) == {("a", "b"): 4.0, ("b", "c"): 4.0}


def test_two_triangles_part_at_the_bridge():
    edges = {(a, b): 1.0 for a, b in ("ab", "ac", "bc", "de", "df", "ef", "cd")}
    found = ladder(list("abcdef"), edges, dict.fromkeys("abcdef", 1), set())
    assert [x["k"] for x in found] == [1, 2]
    assert default_level(found)["groups"] == [tuple("abc"), tuple("def")]
    assert select_level(found, 5)["k"] == 2 and select_level(found, 1)["k"] == 1


def test_small_groups_join_and_hubs_alone_stay():
    edges = {("a", "b"): 1.0, ("b", "c"): 1.0, ("c", "h"): 0.1}
    found = ladder(["a", "b", "c", "h", "x"], edges, {"a": 3, "b": 1, "c": 1, "h": 0, "x": 1}, {"h"})
    assert all(sum(n in g for g in x["groups"]) == 1 for x in found for n in "abchx")
