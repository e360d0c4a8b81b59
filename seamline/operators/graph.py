"""The graph of relations: bundled edges, hubs, contraction, bridges, blocks and what hangs on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seamline.operators.components import connected_components
from seamline.operators.relations import weighted


def bundle_edges(relations: DataFrame) -> DataFrame:
    """(a, b, weight, max_weight, n_relations, has_cascade, all_not_null_any): one edge for each unordered pair of different tables."""
    w = weighted(relations).where("child_table <> parent_table")
    return w.groupBy(F.least("child_table", "parent_table").alias("a"), F.greatest("child_table", "parent_table").alias("b")).agg(
        F.sum("weight").alias("weight"), F.max("weight").alias("max_weight"), F.count(F.lit(1)).alias("n_relations"),
        F.bool_or(F.col("delete_rule") == "CASCADE").alias("has_cascade"), F.bool_or("all_not_null").alias("any_not_null"),
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """(node): both ends of each edge, repeats included."""
    return edges.select(F.explode(F.array("a", "b")).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): neighbours of each node; edges are distinct pairs."""
    return endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hub_threshold(nodes: Column) -> Column:
    """15 % of the nodes with an edge, 6 at least."""
    return F.greatest(F.lit(6).cast("long"), F.floor(nodes * 15 / 100).cast("long"))


def hubs(edges: DataFrame, threshold: int | None = None) -> DataFrame:
    """(node, degree, threshold) of the nodes from the threshold on; None: the threshold for the number of nodes."""
    deg = degrees(edges)
    if threshold is None:
        limit = deg.agg(hub_threshold(F.count(F.lit(1))).alias("threshold"))
        return deg.join(F.broadcast(limit), F.col("degree") >= F.col("threshold"))  # one row
    return deg.where(F.col("degree") >= threshold).withColumn("threshold", F.lit(threshold).cast("long"))


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges that touch none of nodes (node)."""
    out = edges
    for end in ("a", "b"):
        out = out.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return out.select(edges.columns)


def near_hubs(edges: DataFrame, threshold: int, top: int = 10) -> DataFrame:
    """(node, degree) just under the threshold: from a third of it, 6 at least; the first top by degree."""
    return degrees(edges).where((F.col("degree") >= max(6, threshold // 3)) & (F.col("degree") < threshold)).orderBy(F.desc("degree"), "node").limit(top)


def cascade_groups(edges: DataFrame) -> DataFrame:
    """(node, representative) of every table in a component over cascading edges; the representative is the least."""
    found = connected_components(edges.where("has_cascade"), "a", "b")
    return found.select("node", F.col("component").alias("representative"))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges between representatives, bundled again; edges within a group go."""
    out = edges
    for end in ("a", "b"):
        at = groups.select(F.col("node").alias(f"__{end}"), F.col("representative").alias("__rep"))
        out = out.join(at, F.col(end) == F.col(f"__{end}"), "left").withColumn(end, F.coalesce("__rep", end)).drop(f"__{end}", "__rep")
    pairs = out.where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("max_weight").alias("max_weight"), F.sum("n_relations").alias("n_relations"), F.bool_or("has_cascade").alias("has_cascade"), F.bool_or("any_not_null").alias("any_not_null"))


def _bridges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bridges of one component by depth-first low links, without recursion."""
    near: dict[str, list[tuple[str, int]]] = {}
    pairs = sorted(zip(pdf["a"], pdf["b"], strict=True))
    for k, (a, b) in enumerate(pairs):
        near.setdefault(a, []).append((b, k))
        near.setdefault(b, []).append((a, k))
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    out = []
    for start in sorted(near):
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        path = [(start, -1, iter(near[start]))]
        while path:
            node, by, rest = path[-1]
            for other, k in rest:
                if k == by:
                    continue
                if other in seen:
                    low[node] = min(low[node], seen[other])
                else:
                    seen[other] = low[other] = len(seen)
                    path.append((other, k, iter(near[other])))
                    break
            else:
                path.pop()
                if path:
                    up = path[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > seen[up]:
                        out.append(pairs[by])
    return pd.DataFrame(out, columns=["a", "b"])


def bridges(edges: DataFrame) -> DataFrame:
    """The edges whose removal parts their component, each component in a task of its own."""
    parts = connected_components(edges, "a", "b").select(F.col("node").alias("a"), "component")
    found = edges.select("a", "b").join(parts, "a").groupBy("component").applyInPandas(lambda pdf: _bridges(pdf), "a string, b string")
    return edges.join(found, ["a", "b"], "left_semi")


def blocks(edges: DataFrame, bridge: DataFrame) -> DataFrame:
    """(node, block): every end of an edge and the least table of its two-edge-connected block."""
    rest = connected_components(edges.join(bridge.select("a", "b"), ["a", "b"], "left_anti"), "a", "b")
    return endpoints(edges).distinct().join(rest, "node", "left").select("node", F.coalesce("component", "node").alias("block"))


def cut_levels(bridge: DataFrame, raised: DataFrame) -> DataFrame:
    """bridge with level: 2 where a relation is not null, else 1; one more, 3 at most, for the pairs in raised (a, b): strong suspects and pairs written together."""
    up = raised.select("a", "b").distinct().withColumn("__up", F.lit(1))
    return bridge.join(up, ["a", "b"], "left").withColumn("level", F.least(F.lit(3), F.when(F.col("any_not_null"), 2).otherwise(1) + F.coalesce("__up", F.lit(0)))).drop("__up")


def bridge_report(bridge: DataFrame, block: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """bridge with size_a and size_b: the tables of the blocks at its ends, by weight. sizes: (node, tables) of contracted nodes; others count one."""
    each = block if sizes is None else block.join(sizes, "node", "left")
    of = each.groupBy("block").agg(F.sum(F.coalesce("tables", F.lit(1)) if sizes is not None else F.lit(1)).alias("size"))
    sized = block.join(of, "block").select("node", "size")
    out = bridge
    for end in ("a", "b"):
        out = out.join(sized.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}")), end)
    return out.orderBy("weight", "a", "b")


def thin_seams(edges: DataFrame, bridge: DataFrame, n: int = 5) -> DataFrame:
    """The n lightest edges that are no bridges."""
    return edges.join(bridge.select("a", "b"), ["a", "b"], "left_anti").orderBy("weight", "a", "b").limit(n)


def isolated(tables: DataFrame, relations: DataFrame, cross: DataFrame | None = None) -> DataFrame:
    """(table) in no relation, not even with itself or to another schema."""
    used = relations.select(F.explode(F.array("child_table", "parent_table")).alias("table"))
    if cross is not None:
        used = used.union(cross.select("child_table"))
    return tables.select("table").distinct().join(used, "table", "left_anti")


def islands(tables: DataFrame, block: DataFrame, alone: DataFrame, hub: DataFrame, groups: DataFrame) -> DataFrame:
    """(table) left of the tables in no block, not isolated and no hub; a contracted group shows as its representative."""
    rep = groups.select(F.col("node").alias("table"), "representative")
    named = tables.select("table").join(rep, "table", "left").select("table", F.coalesce("representative", "table").alias("node"))
    left = named.join(alone, "table", "left_anti").join(hub.select(F.col("node").alias("table")), "table", "left_anti").join(block, "node", "left_anti")
    return left.select(F.col("node").alias("table")).distinct()


def hub_contracts(relations: DataFrame, hub: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, hub, to_hub, from_hub, not_null, level) of the relations with a hub at exactly one end. units: (node, unit) of the other tables."""
    h = hub.select(F.col("node").alias("h"))
    r = relations.where("child_table <> parent_table").select("child_table", "parent_table", "all_not_null")
    r = r.join(h.withColumn("c", F.lit(True)), r["child_table"] == F.col("h"), "left").drop("h").join(h.withColumn("p", F.lit(True)), r["parent_table"] == F.col("h"), "left").drop("h")
    one = r.where(F.col("c").isNotNull() != F.col("p").isNotNull())
    end = one.select(F.when(F.col("c"), F.col("child_table")).otherwise(F.col("parent_table")).alias("hub"), F.when(F.col("c"), F.col("parent_table")).otherwise(F.col("child_table")).alias("node"), F.col("p").isNotNull().alias("to"), "all_not_null")
    named = end.join(units, "node", "left").withColumn("unit", F.coalesce("unit", "node"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return named.groupBy("unit", "hub").agg(count(F.col("to")).alias("to_hub"), count(~F.col("to")).alias("from_hub"), count(F.col("all_not_null")).alias("not_null"), F.max(F.when(F.col("all_not_null"), 2).otherwise(1)).alias("level"))


def hub_scan_thresholds(start: int) -> list[int]:
    """start halved down to 6, in six steps at most; a start under 6 alone."""
    out = [start]
    while len(out) < 6 and out[-1] // 2 >= 6:
        out.append(out[-1] // 2)
    return out
