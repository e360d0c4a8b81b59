"""Merging catalog and declared relations: table names first, then relation keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seamline.model import EVIDENCE, RELATION
from seamline.operators.relations import relation_key, unite


def resolve_names(wanted: DataFrame, tables: DataFrame, prefix: str | None = None) -> DataFrame:
    """(name, table): each wanted name (name) as a catalog table: exact, else the one that differs in case alone, else with the inferred prefix. table is null where none is."""
    t = tables.select("table").distinct()
    low = t.groupBy(F.lower("table").alias("low")).agg(F.min("table").alias("one"), F.count(F.lit(1)).alias("n")).where("n = 1").select("low", "one")
    out = wanted.select("name").distinct().join(t.select(F.col("table").alias("exact")), F.col("name") == F.col("exact"), "left")
    out = out.join(low.withColumnRenamed("one", "folded"), F.lower("name") == F.col("low"), "left").drop("low")
    third = F.lit(None).cast("string")
    if prefix:
        out = out.join(low.withColumnRenamed("one", "prefixed"), F.lower(F.concat(F.lit(prefix), F.col("name"))) == F.col("low"), "left").drop("low")
        third = F.col("prefixed")
    return out.select("name", F.coalesce("exact", "folded", third).alias("table"))


def prefix_votes(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """(prefix, n): names that each prefix ending in _ would turn into a table, most first.

    Each table is expanded by its own places after a _, and the rests are joined to the names on equality: no theta join.
    """
    rests = tables.select(F.lower("table").alias("low")).distinct().select("low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i")).where("substring(low, i, 1) = '_' AND i < length(low)")
    split = rests.select(F.expr("substring(low, 1, i)").alias("prefix"), F.expr("substring(low, i + 1)").alias("rest"))
    missing = wanted.select("name").distinct().join(resolve_names(wanted, tables).where("table IS NOT NULL"), "name", "left_anti").select(F.lower("name").alias("rest"))
    return missing.distinct().join(split, "rest").groupBy("prefix").agg(F.countDistinct("rest").alias("n")).orderBy(F.desc("n"), "prefix")


def infer_prefix(wanted: DataFrame, tables: DataFrame) -> str | None:
    """The prefix most names need: two at least, and over half of the unresolved ones."""
    top = prefix_votes(wanted, tables).first()
    missing = resolve_names(wanted, tables).where("table IS NULL").count()
    return top["prefix"] if top and top["n"] >= 2 and top["n"] * 2 > missing else None


def rename_ends(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations whose tables are replaced by names (name, table) where one is known."""
    out = relations
    for c in ("child_table", "parent_table"):
        out = out.join(names.select(F.col("name").alias("__n"), F.col("table").alias("__t")), F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__t", c)).drop("__n", "__t")
    return out


def merge_relations(physical: DataFrame, logical: DataFrame) -> DataFrame:
    """The relations of both by key: a catalog's attributes win, evidence is appended, weights are not added.

    Catalog relations of an equal key stay apart and the declared evidence goes to the first by constraint; declared
    relations alone are kept.
    """
    key = F.to_json(relation_key())
    p = physical.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("constraint")))
    q = unite(logical).withColumn("__key", key)
    both = p.join(q.select(F.col("__key").alias("__k"), F.col("evidences").alias("__more")), (F.col("__key") == F.col("__k")) & (F.col("__n") == 1), "left")
    kept = both.withColumn("evidences", F.concat("evidences", F.coalesce("__more", F.array().cast(physical.schema["evidences"].dataType)))).select(physical.columns)
    return kept.unionByName(q.join(p.select("__key").distinct(), "__key", "left_anti").select(physical.columns))


def families(tables: DataFrame, names: DataFrame) -> DataFrame:
    """(table, vertex): tables of a family, a declared pattern (prefix, suffix) around a number without regard to case. A table of several patterns is of none.

    Each table is expanded by its runs of digits and the parts around one are joined on equality.
    """
    low = F.lower("table")
    spots = tables.select("table", low.alias("low")).distinct().select("table", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i"))
    cut = spots.select("table", F.expr("substring(low, 1, i - 1)").alias("p"), F.regexp_extract(F.expr("substring(low, i)"), "^([0-9]+)(.*)$", 1).alias("digits"), F.regexp_extract(F.expr("substring(low, i)"), "^([0-9]+)(.*)$", 2).alias("s")).where("digits <> '' AND NOT p RLIKE '[0-9]$'")
    hit = cut.join(names.select(F.lower("prefix").alias("p"), F.lower("suffix").alias("s"), F.concat("prefix", F.lit("*"), "suffix").alias("vertex")), ["p", "s"])
    return hit.groupBy("table").agg(F.min("vertex").alias("vertex"), F.countDistinct("vertex").alias("n")).where("n = 1").select("table", "vertex")


def family_vertices(tables: DataFrame, declared: DataFrame, prefix: str | None = None) -> DataFrame:
    """(name, table): catalog tables of the families among declared tables (table, with one * for a number), by their vertex.

    A family is looked for by its own name and with the inferred prefix; one found both ways is left alone, and so is a
    catalog table that a declared table without * names itself.
    """
    star = declared.where("table LIKE '%*%' AND table NOT LIKE '%*%*%'").select("table", F.substring_index("table", "*", 1).alias("prefix"), F.substring_index("table", "*", -1).alias("suffix")).distinct()
    ways = star.select("table", "prefix", "suffix")
    if prefix:
        ways = ways.unionByName(star.select("table", F.concat(F.lit(prefix), "prefix").alias("prefix"), "suffix"))
    ways = ways.withColumn("vertex", F.concat("prefix", F.lit("*"), "suffix"))
    free = tables.join(declared.select(F.lower("table").alias("__low")).distinct(), F.lower("table") == F.col("__low"), "left_anti")
    hit = families(free, ways.select("prefix", "suffix").distinct()).withColumnRenamed("table", "name").join(ways.select("vertex", "table"), "vertex")
    once = hit.groupBy("table").agg(F.countDistinct("vertex").alias("n")).where("n = 1").select("table")
    return hit.join(once, "table").select("name", "table")


def metadata_relations(listed: DataFrame, tables: DataFrame, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Declared relations of a list (line_no, child, columns, parent) and its rows that name an unknown table.

    A name is a table, else the class (class, table) that it is without regard to case, if it is the only one.
    """
    known = tables.select(F.col("table").alias("name"), "table").distinct()
    names = listed.select(F.explode(F.array("child", "parent")).alias("name")).distinct()
    out = names.join(known, "name", "left")
    if classes is not None:
        one = classes.groupBy(F.lower("class").alias("low")).agg(F.min("table").alias("of_class"), F.countDistinct("table").alias("n")).where("n = 1").select("low", "of_class")
        out = out.join(one, F.lower("name") == F.col("low"), "left").select("name", F.coalesce("table", "of_class").alias("table"))
    at = lambda c: out.select(F.col("name").alias(c), F.col("table").alias(f"{c}_table"))
    both = listed.join(at("child"), "child", "left").join(at("parent"), "parent", "left")
    label = F.concat(F.lit("metadata:"), F.col("line_no").cast("string"))
    said = F.struct(F.lit("metadata").alias("source"), label.alias("origin"), label.alias("constraint"), F.lit("NO ACTION").alias("delete_rule"), F.lit("unknown").alias("nullable")).cast(EVIDENCE)
    typed = both.where("child_table IS NOT NULL AND parent_table IS NOT NULL").select("child_table", F.col("columns").alias("child_columns"), "parent_table", label.alias("constraint"), F.lit("NO ACTION").alias("delete_rule"), F.lit("unknown").alias("nullable"), F.lit(False).alias("all_not_null"), F.lit(None).cast("string").alias("parent_schema"), F.array(said).alias("evidences"))
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in RELATION]), both.where("child_table IS NULL OR parent_table IS NULL").select(listed.columns)
