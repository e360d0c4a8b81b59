import json

from seamline.plans import analysis
from tests.test_operators import pairs, relation, table


def tables(spark, names):
    return spark.createDataFrame([(x,) for x in names.split()], "table string")


def test_fixture_of_a_shop(spark):
    # the order of steps: hubs go first, then cascades are contracted, then bridges are found
    r = table(
        spark, relation("order_items", "orders", "order_id", "CASCADE", True), relation("orders", "customers", "customer_id", nn=True), relation("customers", "regions", "region_id"),
        relation("invoices", "orders", "order_id"), relation("pair_refs", "pairs", "pair_id"),
    )
    a = analysis.analyze(analysis.Dataset(tables(spark, "order_items orders customers regions invoices pair_refs pairs logs"), r))
    assert a.threshold == 6 and a.hubs.count() == 0
    assert pairs(a.isolated, "table") == [("logs",)] and pairs(a.groups, "node", "representative") == [("order_items", "order_items"), ("orders", "order_items")]
    assert pairs(a.bridges, "a", "b", "weight", "level") == [("customers", "order_items", 2.0, 2), ("customers", "regions", 1.0, 1), ("invoices", "order_items", 1.0, 1), ("pair_refs", "pairs", 1.0, 1)]
    assert sorted(x for g in json.loads(a.levels.where("is_default").first()["groups"]) for x in g) == ["customers", "invoices", "order_items", "pair_refs", "pairs", "regions"]
    pair, totals, worse = analysis.regressed(a, a)
    assert not worse and pair.count() == totals.count() == 0


def test_hub_contract_and_scan(spark):
    r = table(spark, *[relation(f"t{i}", "users", "user_id", nn=i == 0) for i in range(7)], relation("t0", "t1"))
    data = analysis.Dataset(tables(spark, "users " + " ".join(f"t{i}" for i in range(7))), r)
    a = analysis.analyze(data, hub=6)
    assert pairs(a.hubs, "node", "degree") == [("users", 7)]
    assert ("t0", "users", 1, 0, 1, 2) in pairs(a.contracts, "unit", "hub", "to_hub", "from_hub", "not_null", "level")
    scan = {x["threshold"]: x["hubs"] for x in analysis.hub_scan(data, 12).collect()}
    assert scan == {12: 0, 6: 1}


def test_views_share_hubs_and_groups(spark):
    r = table(spark, relation("a", "b", rule="CASCADE"), relation("c", "a", source="code", nullable="true"), relation("d", "c", source="code", nullable="true"))
    scope = spark.createDataFrame([(t, True, True) for t in "abcd"], "table string, in_physical boolean, in_logical boolean")
    out = analysis.compare_views(analysis.Dataset(tables(spark, "a b c d"), r), scope)
    assert {(x["child"], x["class"]) for x in out["edge_diff"].collect()} == {("a", "physical_only"), ("c", "logical_only"), ("d", "logical_only")}
    assert out["coverage"].first()["fk_tables"] == 2
    agree = {(x["view_a"], x["view_b"]): x for x in out["agreement"].collect()}
    assert len(agree) == 3 and agree["logical", "combined"]["ari"] == 1.0
