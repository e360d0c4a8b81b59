"""Relations: composite keys, evidence, weights, views and table bundling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seamline.model import PHYSICAL, VIEWS
from seamline.operators.components import connected_components


def fold_keys(columns: DataFrame) -> DataFrame:
    """One relation for each (child_table, constraint) of catalog rows (constraint, child_table, ordinal, column, not_null, parent_schema, parent_table, delete_rule); parent_schema is null for the own schema."""
    out = columns.groupBy("child_table", "constraint").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda s: s["column"]).alias("child_columns"),
        F.bool_and("not_null").alias("all_not_null"),
        *[F.min(c).alias(c) for c in ("parent_schema", "parent_table", "delete_rule")],
    )
    return stamp_physical(out.select("constraint", "child_table", "child_columns", "parent_schema", "parent_table", "delete_rule", "all_not_null"))


def stamp_physical(relations: DataFrame) -> DataFrame:
    """relations with the evidence of a catalog: nullable from the columns themselves."""
    nullable = F.when(F.col("all_not_null"), F.lit("false")).otherwise(F.lit("true"))
    seen = F.struct(F.lit(PHYSICAL).alias("source"), F.lit("").alias("origin"), F.col("constraint"), F.col("delete_rule"), nullable.alias("nullable"))
    return relations.withColumn("nullable", F.lit("")).withColumn("evidences", F.array(seen))


def split_schemas(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations within the schema, and those to another schema."""
    return relations.where(F.col("parent_schema").isNull()), relations.where(F.col("parent_schema").isNotNull())


def pg_delete_rule(c: Column) -> Column:
    """The rule for a catalog's one-letter code."""
    # pg_constraint.confdeltype.
    return F.when(c == "c", "CASCADE").when(c == "n", "SET NULL").when(c == "r", "RESTRICT").when(c == "d", "SET DEFAULT").otherwise("NO ACTION")


def has_source(physical: bool) -> Column:
    return F.exists("evidences", lambda e: (e["source"] == PHYSICAL) == F.lit(physical))


def enforced() -> Column:
    """Seen in a catalog; a relation without any evidence is taken as one."""
    return has_source(True) | (F.size("evidences") == 0)


def nullability() -> Column:
    """true, false or unknown: what was said, else what the key's columns show."""
    return F.when(F.col("nullable") != "", F.col("nullable")).when(F.col("all_not_null"), "false").otherwise("true")


def weighted(relations: DataFrame) -> DataFrame:
    """relations with weight (3 cascade, 2 not null, 1 else) and reason; relations without catalog evidence have a logical_ reason."""
    cascade = F.col("delete_rule") == "CASCADE"
    weight = F.when(cascade, 3.0).when(F.col("all_not_null"), 2.0).otherwise(1.0)
    reason = F.when(cascade, "cascade").when(F.col("all_not_null"), "not_null").when(nullability() == "unknown", "unknown_provisional").otherwise("nullable")
    logical = (F.size("evidences") > 0) & ~has_source(True)
    return relations.withColumns({"weight": weight, "reason": F.when(logical, F.concat(F.lit("logical_"), reason)).otherwise(reason)})


def relation_key() -> Column:
    """What makes two relations the same: child, columns without case, parent."""
    return F.struct(F.col("child_table").alias("child"), F.lower(F.array_join("child_columns", ",")).alias("columns"), F.col("parent_table").alias("parent"))


def project(relations: DataFrame, view: str) -> DataFrame:
    """The physical, logical or combined view.

    The logical view knows only what was declared: catalog evidence is dropped, and the rule, constraint and
    nullability are those of the first declaration left, CASCADE if any declares it.
    """
    if view not in VIEWS:
        raise ValueError(f"view must be one of {', '.join(VIEWS)}")
    if view == "combined":
        return relations
    if view == "physical":
        return relations.where(enforced())
    said = relations.withColumn("evidences", F.filter("evidences", lambda e: e["source"] != PHYSICAL)).where(F.size("evidences") > 0)
    first = F.col("evidences")[0]
    rule = F.when(F.exists("evidences", lambda e: e["delete_rule"] == "CASCADE"), "CASCADE").otherwise(first["delete_rule"])
    return said.withColumns({"constraint": first["constraint"], "delete_rule": rule, "nullable": first["nullable"], "all_not_null": first["nullable"] == "false"})


def rename_tables(relations: DataFrame, rename: DataFrame) -> DataFrame:
    """relations with tables renamed by (from_table, to_table): those that come to point to their own table go, and equal ones are merged with their distinct evidence."""
    out = relations
    for c in ("child_table", "parent_table"):
        at = rename.select(F.col("from_table").alias(f"__{c}"), F.col("to_table").alias("__to"))
        out = out.join(at, F.col(c) == F.col(f"__{c}"), "left").withColumn(f"__new_{c}", F.coalesce("__to", c)).drop(f"__{c}", "__to")
    moved = (F.col("__new_child_table") != F.col("child_table")) | (F.col("__new_parent_table") != F.col("parent_table"))
    out = out.where(~(moved & (F.col("__new_child_table") == F.col("__new_parent_table"))))
    out = out.withColumns({"child_table": F.col("__new_child_table"), "parent_table": F.col("__new_parent_table")}).drop("__new_child_table", "__new_parent_table")
    return unite(out)


def unite(relations: DataFrame) -> DataFrame:
    """One row for each relation key: the attributes of the first in order of constraint, and the evidence of all, once for each source and origin."""
    names = [c for c in ("constraint", "child_table", "child_columns", "parent_schema", "parent_table", "delete_rule", "all_not_null", "nullable") if c in relations.columns]
    rows = relations.withColumn("__key", relation_key()).groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("constraint", F.struct(*names).alias("row"), "evidences"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["evidences"]))
    once = F.filter(F.transform(flat, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: ~F.exists(F.slice(flat, F.lit(1), x["i"]), lambda y: (y["source"] == x["e"]["source"]) & (y["origin"] == x["e"]["origin"])))
    return rows.select(F.col("all")[0]["row"].alias("r"), F.transform(once, lambda x: x["e"]).alias("evidences")).select("r.*", "evidences")


def bundle_map(tables: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(from_table, to_table) for each table that the first rule with an existing base folds into it, chains folded to their end.

    rules: (suffix or prefix, value) in order; a table longer than the value alone has a base. The rules are few and
    given by the caller, so each table is expanded by them and the bases are looked up by an equi-join.
    """
    if not rules:
        return tables.select(F.col("table").alias("from_table"), F.col("table").alias("to_table")).limit(0)
    t = F.col("table")
    bases = [F.struct(F.lit(i).alias("rule"), F.when((F.length(t) > len(v)) & (F.endswith(t, F.lit(v)) if k == "suffix" else F.startswith(t, F.lit(v))), F.expr(f"substring(table, 1, length(table) - {len(v)})") if k == "suffix" else F.expr(f"substring(table, {len(v) + 1})")).alias("base")) for i, (k, v) in enumerate(rules)]
    tried = tables.select("table", F.explode(F.array(*bases)).alias("b")).select("table", "b.*").where("base IS NOT NULL")
    hit = tried.join(tables.select(F.col("table").alias("base")).distinct(), "base").groupBy("table").agg(F.min_by("base", "rule").alias("to"))
    roots = connected_components(hit, "table", "to")  # a fold only shortens a name, so each chain is a tree whose root folds no further
    ends = roots.join(hit, roots["node"] == hit["table"], "left_anti").select(F.col("component"), F.col("node").alias("to_table"))
    return roots.join(hit.select("table"), roots["node"] == F.col("table")).join(ends, "component").select(F.col("table").alias("from_table"), "to_table")


def bundle_orphans(tables: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(table) that some rule fits but that no rule's base exists for."""
    fits = reduce(lambda x, y: x | y, [(F.length("table") > len(v)) & (F.endswith("table", F.lit(v)) if k == "suffix" else F.startswith("table", F.lit(v))) for k, v in rules], F.lit(False))
    return tables.where(fits).join(bundle_map(tables, rules).select(F.col("from_table").alias("table")), "table", "left_anti").select("table")
