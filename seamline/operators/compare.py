"""Comparison: edge classes, coverage, communities, baselines and candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seamline.operators.relations import has_source, relation_key

THIN = 0.5


def presence(seen: Column, scope: Column) -> Column:
    """present; absent only where the source read both ends; else unobserved."""
    return F.when(seen, "present").when(scope, "absent").otherwise("unobserved")


def edge_class(physical: Column, logical: Column, observed: Column) -> Column:
    """Fixed truth table over the three presences; anything else is undetermined."""
    p, q, o = physical, logical, observed
    return (
        F.when((p == "present") & (q == "present"), "both").when((p == "present") & (q == "absent"), "physical_only").when((p == "absent") & (q == "present"), "logical_only")
        .when((p == "absent") & (q == "absent") & (o == "present"), "observed_only").otherwise("undetermined")
    )


def diff_edges(relations: DataFrame, scope: DataFrame, observed: DataFrame, hubs: DataFrame, log_read: bool = True) -> DataFrame:
    """(a, b, physical, logical, observed, class, count, npmi, at_hub) of every relation, and of every observed pair that no relation covers.

    scope: (table, in_physical, in_logical). A relation's absence from the catalog needs its child in the catalog; from
    the declarations, both ends declared. A pair known by co-occurrence alone needs both ends on each side. Where a log was read, a
    pair that is not in observed is absent there; without one it is unobserved.
    """
    ends = relations.select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent"), has_source(True).alias("p"), has_source(False).alias("q"))
    seen = observed.select("a", "b", "count", "npmi")
    declared = ends.withColumns({"a": F.least("child", "parent"), "b": F.greatest("child", "parent")}).join(seen, ["a", "b"], "left")
    loose = seen.join(declared.select("a", "b").distinct(), ["a", "b"], "left_anti").select(F.col("a").alias("child"), F.col("b").alias("parent"), F.lit(False).alias("p"), F.lit(False).alias("q"), "a", "b", "count", "npmi", F.lit(True).alias("only"))
    both = declared.withColumn("only", F.lit(False)).unionByName(loose)
    for end in ("child", "parent"):
        both = both.join(scope.select(F.col("table").alias(end), F.col("in_physical").alias(f"{end}_p"), F.col("in_logical").alias(f"{end}_q")), end, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    in_p = F.when(F.col("only"), yes("child_p") & yes("parent_p")).otherwise(yes("child_p"))
    out = both.select("*", presence(F.col("p"), in_p).alias("physical"), presence(F.col("q"), yes("child_q") & yes("parent_q")).alias("logical"), presence(F.col("count").isNotNull(), F.lit(log_read)).alias("observed"))
    h = hubs.select(F.col("node"))
    for end in ("a", "b"):
        out = out.join(h.select(F.col("node").alias(end)).withColumn(f"{end}_hub", F.lit(True)), end, "left")
    return out.select("child", "parent", "physical", "logical", "observed", edge_class(F.col("physical"), F.col("logical"), F.col("observed")).alias("class"), "count", "npmi", (yes("a_hub") | yes("b_hub")).alias("at_hub"))


def class_counts(diff: DataFrame) -> DataFrame:
    """(at_hub, class, n) of diff_edges()'s rows."""
    return diff.groupBy("at_hub", "class").agg(F.count(F.lit(1)).alias("n"))


def coverage(relations: DataFrame, scope: DataFrame) -> DataFrame:
    """One row: tables in the catalog, those with an enforced relation and their share, relations by evidence, declarations and duplicate ones. No catalog gives a null share."""
    fk = relations.where(has_source(True)).select(F.explode(F.array("child_table", "parent_table")).alias("table")).distinct().withColumn("fk", F.lit(True))
    t = scope.where("in_physical").join(fk, "table", "left").agg(F.count(F.lit(1)).alias("db_tables"), F.count("fk").alias("fk_tables"))
    said = F.size(F.filter("evidences", lambda e: e["source"] != "physical"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    r = relations.agg(n(has_source(True)).alias("physical"), n(has_source(False)).alias("declared"), n(has_source(True) & has_source(False)).alias("both"), F.coalesce(F.sum(said), F.lit(0)).cast("long").alias("declarations"))
    return t.crossJoin(r).select("*", (F.col("declarations") - F.col("declared")).alias("duplicates"), (F.col("fk_tables") / F.nullif("db_tables", F.lit(0))).alias("fk_rate"))


def group_coverage(groups: DataFrame, relations: DataFrame, scope: DataFrame) -> DataFrame:
    """(group, db_tables, fk_tables, rate, thin) of groups (group, table): below_average under half the share of all, not_in_db without a table there."""
    fk = relations.where(has_source(True)).select(F.explode(F.array("child_table", "parent_table")).alias("table")).distinct().withColumn("fk", F.lit(True))
    each = groups.join(scope.where("in_physical").select("table").withColumn("db", F.lit(True)), "table", "left").join(fk, "table", "left")
    by = each.groupBy("group").agg(F.count("db").alias("db_tables"), F.count(F.when(F.col("db"), F.col("fk"))).alias("fk_tables"))
    overall = coverage(relations, scope).select(F.col("fk_rate").alias("overall"))
    rated = by.withColumn("rate", F.col("fk_tables") / F.nullif("db_tables", F.lit(0))).crossJoin(F.broadcast(overall))
    return rated.select("group", "db_tables", "fk_tables", "rate", F.when(F.col("overall").isNull(), "").when(F.col("db_tables") == 0, "not_in_db").when(F.col("rate") < F.col("overall") * THIN, "below_average").otherwise("").alias("thin"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two labelings of the same rows, counted in integers; null under two rows, 1 where chance agrees as much as can be.

    Labels are counted map-side; the three sums come from the contingency table, so a label with most of the rows is one
    row of it.
    """
    two = lambda n: n * (n - 1) / 2
    cell = labels.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cell.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name))
    s = cell.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("ij")).crossJoin(side("x", "sa")).crossJoin(side("y", "sb"))
    s = s.withColumns({"e": F.try_divide(F.col("sa") * F.col("sb"), two(F.col("n"))), "m": (F.col("sa") + F.col("sb")) / 2})
    return s.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, None).when(F.col("m") == F.col("e"), 1.0).otherwise((F.col("ij") - F.col("e")) / (F.col("m") - F.col("e"))).alias("ari"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    out, left, right = [], set(), set()
    for n, x, y in sorted(zip(-pdf["overlap"], pdf["a"], pdf["b"], strict=True)):
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            out.append((x, y, -n))
    return pd.DataFrame(out, columns=["a", "b", "overlap"])


def match_communities(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, overlap): communities of two labelings matched one to one, the largest overlap first, then by name. The input of the matching is one row for each pair of communities that share a table."""
    cell = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("overlap"))
    return cell.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: _greedy(pdf), "a string, b string, overlap long")


def glue(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(group, kind, n, cooc_only): how many links of each kind (u, v, kind) hold the units of a group (group, unit) together; cooc_only where it has two units at least and no kind but observed pairs."""
    at = lambda end: groups.select(F.col("unit").alias(end), F.col("group").alias(f"g{end}"))
    inside = links.select("u", "v", "kind").distinct().join(at("u"), "u").join(at("v"), "v").where("gu = gv")
    n = inside.groupBy(F.col("gu").alias("group"), "kind").agg(F.count(F.lit(1)).alias("n"))
    seen = n.groupBy("group").agg(F.bool_and(F.col("kind") == "observed").alias("alone"))
    return n.join(seen, "group").join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("units")), "group").select("group", "kind", "n", (F.col("alone") & (F.col("units") >= 2)).alias("cooc_only"))


def moves(labels: DataFrame, match: DataFrame, table: str, a: str, b: str) -> DataFrame:
    """(table, kind) of the tables that are elsewhere in b: reassigned, or isolated or unobserved on the side where they have no label. labels also has seen_a and seen_b."""
    m = match.select(F.col("a").alias("__a"), F.col("b").alias("__to"))
    x = labels.withColumns({"__x": F.col(a).cast("string"), "__y": F.col(b).cast("string")}).join(m, F.col("__x") == F.col("__a"), "left")
    kind = (
        F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull() & ~F.col("__y").eqNullSafe(F.col("__to")), "reassigned")
        .when(F.col("__x").isNotNull() & F.col("__y").isNull(), F.when(F.col("seen_b"), "isolated_in_b").otherwise("unobserved_in_b"))
        .when(F.col("__x").isNull() & F.col("__y").isNotNull(), F.when(F.col("seen_a"), "isolated_in_a").otherwise("unobserved_in_a"))
    )
    return x.select(F.col(table), kind.alias("kind")).where("kind IS NOT NULL")


def cut_edges(edges_a: DataFrame, edges_b: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, state_a, state_b) of edges that a labeling cuts: cut, internal or absent on each side; an edge cut on neither is left out. labels: (table, la, lb)."""
    mark = lambda edges, name: edges.select("a", "b", F.lit(True).alias(name))
    both = mark(edges_a, "in_a").join(mark(edges_b, "in_b"), ["a", "b"], "full_outer")
    for end in ("a", "b"):  # labels grow with the tables: merged, as a broadcast of them would be whole in every task
        at = labels.select(F.col("table").alias(end), F.col("la").alias(f"la_{end}"), F.col("lb").alias(f"lb_{end}"))
        both = both.join(at.hint("merge"), end)
    state = lambda there, label: F.when(F.col(there).isNull(), "absent").when(F.col(f"{label}_a") == F.col(f"{label}_b"), "internal").otherwise("cut")
    out = both.select("a", "b", state("in_a", "la").alias("state_a"), state("in_b", "lb").alias("state_b"))
    return out.where((F.col("state_a") == "cut") | (F.col("state_b") == "cut"))


def baseline_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(child, parent, change): pairs added and removed; an added pair is a regression, a removed one is only told."""
    return now.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(now).withColumn("change", F.lit("removed")))


def hub_totals(contracts: DataFrame) -> DataFrame:
    """(hub, total): relations at each hub, to and from it."""
    return contracts.groupBy("hub").agg(F.sum(F.col("to_hub") + F.col("from_hub")).alias("total"))


def baseline_hub_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(hub, total_before, total_now, regressed) of the hubs whose totals differ."""
    out = before.select("hub", F.col("total").alias("total_before")).join(now.select("hub", F.col("total").alias("total_now")), "hub", "full_outer").fillna(0, ["total_before", "total_now"])
    return out.where("total_before <> total_now").withColumn("regressed", F.col("total_now") > F.col("total_before"))


def evidence_counts(relations: DataFrame) -> DataFrame:
    """(kind, n): relations with both kinds of evidence, or one."""
    kind = F.when(has_source(True) & has_source(False), "both").when(has_source(True), "physical").otherwise("logical")
    return relations.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def table_churn(churn: DataFrame, file_tables: DataFrame) -> DataFrame:
    """(table, churn, files) from commits of paths (path, n) and the files of models (file, table); a file is a path or ends in / and a path.

    A path's own suffixes at each / are joined on equality, so no pair of unrelated names is compared.
    """
    parts = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = file_tables.select("file", "table", F.explode(tails).alias("path")).join(churn, "path", "left")
    of = ends.groupBy("file", "table").agg(F.sum("n").alias("n"))
    return of.groupBy("table").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("churn"), F.count(F.lit(1)).alias("files"))


def rank_candidates(units: DataFrame, bridge_ends: DataFrame, churn: DataFrame, criticality: DataFrame) -> DataFrame:
    """(unit, tables, bridges, churn, criticality) in order: measured first, fewest bridges, most churn, least criticality, name. units: (unit, table); bridge_ends: (unit). churn is null where no file maps to the unit."""
    each = units.join(churn, "table", "left").join(criticality, "table", "left")
    by = each.groupBy("unit").agg(F.count(F.lit(1)).alias("tables"), F.sum("churn").alias("churn"), F.coalesce(F.max("criticality"), F.lit(0.0)).alias("criticality"))
    cut = bridge_ends.groupBy("unit").agg(F.count(F.lit(1)).alias("bridges"))
    out = by.join(cut, "unit", "left").select("unit", "tables", F.coalesce("bridges", F.lit(0)).alias("bridges"), "churn", "criticality")
    return out.orderBy(F.col("churn").isNull(), "bridges", F.desc("churn"), "criticality", "unit")
