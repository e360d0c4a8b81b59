"""Golden values of the library's operators, recreated as small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seamline.model import RELATION
from seamline.operators import compare, cooc, graph, merge, relations as rel
from seamline.operators.components import connected_components
from seamline.plans import sinks
from seamline.sources import files


def relation(child, parent, col="id", rule="NO ACTION", nn=False, source="physical", nullable="", name=None):
    name = name or f"{child}.{col}"
    return (name, child, [col], None, parent, rule, nn, nullable, [(source, "", name, rule, nullable)])


def table(spark, *rows):
    return spark.createDataFrame(list(rows), RELATION)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols or ("a", "b")) for r in df.collect())


def test_two_triangles(spark):
    r = table(spark, *[relation(x, y) for x, y in ("ab", "bc", "ca", "de", "ef", "fd", "cd")])
    e = graph.bundle_edges(r)
    b = graph.bridges(e)
    assert pairs(b) == [("c", "d")]
    assert pairs(graph.blocks(e, b), "node", "block") == [(x, "a") for x in "abc"] + [(x, "d") for x in "def"]
    assert pairs(graph.bridge_report(b, graph.blocks(e, b)), "a", "b", "weight", "size_a", "size_b") == [("c", "d", 1.0, 3, 3)]


def test_parallel_relations_are_one_edge(spark):
    e = graph.bundle_edges(table(spark, relation("order", "user", "user_id", nn=True), relation("order", "user", "editor_id", "SET NULL"), relation("category", "category")))
    assert pairs(e, "a", "b", "weight", "n_relations") == [("order", "user", 3.0, 2)]


def test_contraction(spark):
    e = graph.bundle_edges(table(spark, relation("line_item", "order", rule="CASCADE"), relation("shipment", "order"), relation("shipment", "line_item")))
    g = graph.cascade_groups(e)
    assert pairs(g, "node", "representative") == [("line_item", "line_item"), ("order", "line_item")]
    assert pairs(graph.contract(e, g), "a", "b", "n_relations") == [("line_item", "shipment", 2)]


def test_hub_star_and_seams(spark):
    e = graph.bundle_edges(table(spark, *[relation(f"t{i}", "users") for i in range(7)]))
    assert pairs(graph.hubs(e, 6), "node", "degree") == [("users", 7)] and graph.without(e, graph.hubs(e, 6)).count() == 0
    assert pairs(graph.near_hubs(e, 8), "node", "degree") == [("users", 7)]
    k4 = graph.bundle_edges(table(spark, *[relation(x, y, nn=(x + y) != "cd") for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")]))
    b = graph.bridges(k4)
    assert b.count() == 0 and pairs(graph.thin_seams(k4, b, 1)) == [("c", "d")]


@pytest.mark.parametrize(("start", "want"), [(149, [149, 74, 37, 18, 9]), (16, [16, 8]), (6, [6]), (3, [3]), (1000, [1000, 500, 250, 125, 62, 31])])
def test_hub_scan_thresholds(start, want):
    assert graph.hub_scan_thresholds(start) == want


def test_components_against_brute_force(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200 + i, 200) for i in range(1, 90)] + [(None, 3), (5, 5)]
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            both = up.get(a, {a}) | up.get(b, {b})
            up.update(dict.fromkeys(both, both))
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {n: min(s) for n, s in up.items()}


def test_sessions_and_npmi(spark):
    log = ["BEGIN", "BEGIN", "INSERT INTO orders VALUES (1)", "COMMIT", "UPDATE alone SET x = 1", "BEGIN", "INSERT INTO orders VALUES (1)", "ROLLBACK", "BEGIN", "REPLACE INTO `s`.`Items` VALUES (1)", "INSERT IGNORE INTO orders VALUES (2)", "COMMIT", "BEGIN", "DELETE FROM x"]
    tx = cooc.sessionise(spark.createDataFrame([("1", i, s) for i, s in enumerate(log)], "thread string, seq long, sql string"))
    assert sorted(r["table"] for r in tx.collect()) == ["items", "orders", "orders"]
    assert pairs(cooc.pairs(tx), "a", "b", "count", "total") == [("items", "orders", 1, 1)]
    lines = spark.createDataFrame([(1, "# note"), (2, "a, b"), (3, "a b"), (4, "c"), (5, "c\td,d")], "seq long, line string")
    got = {(r["a"], r["b"]): r for r in cooc.pairs(cooc.read_log(lines)).collect()}
    assert got["a", "b"]["count"] == 2 and got["a", "b"]["total"] == 3 and abs(got["a", "b"]["npmi"] - 1) < 1e-12


def test_cooc_hub(spark):
    tx = spark.createDataFrame([(str(i), t) for i in range(5) for t in ("log", f"t{i}")], "tx string, table string")
    p = cooc.pairs(tx)
    none = p.select("a", "b").limit(0)
    assert pairs(cooc.cooc_hubs(p, none, 5), "node", "degree") == [("log", 5)]
    assert all(r["suppressed"] for r in cooc.report(p, none, none, 5).collect())


def test_merge_and_views(spark):
    physical = table(spark, relation("tbl_comment", "tbl_post", "post_id", "CASCADE", True))
    logical = table(spark, relation("comment", "post", "post_id", source="code", nullable="unknown"), relation("post", "user", "author_id", source="code"), relation("post_tag", "tag", source="code"))
    tables = spark.createDataFrame([(f"tbl_{x}",) for x in ("audit", "comment", "post", "user")], "table string")
    wanted = logical.select(F.explode(F.array("child_table", "parent_table")).alias("name"))
    assert merge.infer_prefix(wanted, tables) == "tbl_"
    both = merge.merge_relations(physical, merge.rename_ends(logical, merge.resolve_names(wanted, tables, "tbl_")))
    got = {(r["child_table"], r["parent_table"]): r for r in rel.weighted(both).collect()}
    assert set(got) == {("tbl_comment", "tbl_post"), ("tbl_post", "tbl_user"), ("post_tag", "tag")}
    first = got["tbl_comment", "tbl_post"]
    assert (first["weight"], first["delete_rule"], [e["source"] for e in first["evidences"]]) == (3.0, "CASCADE", ["physical", "code"])
    assert [rel.project(both, v).count() for v in ("physical", "logical", "combined")] == [1, 3, 3]
    said = {r["child_table"]: r for r in rel.weighted(rel.project(both, "logical")).collect()}
    assert (said["tbl_comment"]["weight"], said["tbl_comment"]["reason"]) == (1.0, "logical_unknown_provisional")


def test_name_case_and_single_prefix(spark):
    one = spark.createDataFrame([("order_item",), ("orders",)], "table string")
    assert merge.infer_prefix(spark.createDataFrame([("item",)], "name string"), one) is None
    both = rel.unite(table(spark, relation("post", "user", "Author_ID", name="x"), relation("post", "user", "author_id", source="code", name="y")))
    assert both.count() == 1 and len(both.first()["evidences"]) == 2


def test_bundle(spark):
    t = spark.createDataFrame([(x,) for x in ("customers", "customers_version", "orders", "orders_version", "ghost_version")], "table string")
    rules = [("suffix", "_version")]
    m = rel.bundle_map(t, rules)
    assert pairs(m, "from_table", "to_table") == [("customers_version", "customers"), ("orders_version", "orders")]
    assert pairs(rel.bundle_orphans(t, rules), "table") == [("ghost_version",)]
    r = table(spark, relation("orders", "customers", "customer_id"), relation("orders_version", "customers", "customer_id"), relation("orders_version", "orders", "item_id"))
    got = rel.rename_tables(r, m)
    assert pairs(got, "child_table", "parent_table") == [("orders", "customers")]


@pytest.mark.parametrize(("a", "b", "want"), [("0011", "0011", 1), ("0011", "7733", 1), ("0011", "0012", 4 / 7), ("0011", "0101", -0.5), ("0123", "0123", 1), ("0000", "0000", 1), ("0000", "0011", 0), ("0", "0", None)])
def test_adjusted_rand(spark, a, b, want):
    got = compare.adjusted_rand(spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string"), "a", "b").first()
    assert got["ari"] is None if want is None else abs(got["ari"] - want) < 1e-12


def test_matching_and_moves(spark):
    rows = [("o1", "orders", "all", True, True), ("o2", "orders", "all", True, True), ("o3", "orders", "all", True, True), ("p1", "posts", "all", True, True), ("p2", "posts", "all", True, True), ("c", None, "all", True, True), ("z", "posts", None, True, False)]
    df = spark.createDataFrame(rows, "t string, a string, b string, seen_a boolean, seen_b boolean")
    m = compare.match_communities(df, "a", "b")
    assert pairs(m, "a", "b", "overlap") == [("orders", "all", 3)]
    assert pairs(compare.moves(df, m, "t", "a", "b"), "t", "kind") == [("c", "isolated_in_a"), ("p1", "reassigned"), ("p2", "reassigned"), ("z", "unobserved_in_b")]


def test_files(spark, tmp_path):
    p = tmp_path / "r.tsv"
    p.write_text("# note\nchild\tcolumn\tparent\npost\tuser_id, org_id\tuser\n\nb\tc\td # end\n")
    got = files.relations_tsv(spark, str(p)).collect()
    assert [(r["line_no"], r["child"], r["columns"], r["parent"]) for r in got] == [(3, "post", ["user_id", "org_id"], "user"), (5, "b", ["c"], "d")]
    p.write_text("a\tb\n")
    with pytest.raises(ValueError, match=":1:"):
        files.relations_tsv(spark, str(p))
    p.write_text("suffix _v # x\nprefix old_\n")
    assert files.bundle_rules(spark, str(p)) == [("suffix", "_v"), ("prefix", "old_")]
    p.write_text('{"a": 1.5}')
    assert pairs(files.criticality(spark, str(p)), "table", "criticality") == [("a", 1.5)]
    files.dump_schema(["b", "a"], table(spark, relation("a", "b", nn=True)), str(p), "s")
    back = files.schema_json(spark, str(p))
    assert [r["table"] for r in back["tables"].collect()] == ["a", "b"] and back["relations"].first()["evidences"][0]["nullable"] == "false"
    p.write_text("{}")
    with pytest.raises(ValueError, match="no schema"):
        files.schema_json(spark, str(p))


def test_reports(spark):
    e = graph.bundle_edges(table(spark, relation("a-b", "c"), relation("c", "d")))
    b = graph.cut_levels(graph.bridges(e), e.limit(0))
    assert sinks.mermaid(e, b) == 'graph LR\n  a_b["a-b"] -.- c["c"]\n  c["c"] -.- d["d"]\n'
    assert "--" not in sinks.d2(e, b, 1).replace("a-b", "") and "stroke-dash" in sinks.d2(e, b, 0)
    assert json.loads(sinks.to_json({"edges": e}))["edges"][0]["weight"] == 1.0
    assert "<script" not in sinks.page("t", {"edges": e}) and "## edges" in sinks.text("t", {"edges": e})
    assert pairs(sinks.contract_ddl(b, table(spark, relation("a-b", "c"), relation("c", "d", source="code")), "postgres"), "ddl") == [("-- c -> d (c.id) is declared in code only",), ('ALTER TABLE "a-b" DROP CONSTRAINT "a-b.id";',)]
