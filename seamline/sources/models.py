"""Relations declared in source trees of object-relational models.

Files are read and scanned for raw SQL by Spark; all files of a tree are then resolved together, as a class may be
declared far from its parents and partners. Trees are independent, so many are resolved side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.functions.rawsql import read_tables, written_tables
from seamline.model import EVIDENCE, RELATION

FOUND = "tree string, kind string, a string, b string, columns array<string>, label string, origin string, delete_rule string, nullable string, strong boolean"


@dataclass
class Source:
    """A file of a tree: its path in it, its text, and the tables that raw SQL in it names."""

    path: str
    text: str
    writes: list[str] = field(default_factory=list)
    reads: list[str] = field(default_factory=list)


@dataclass
class Found:
    """What a tree declares: tables, relations (a: child, b: parent), suspects (a: from, b: to) and notes; a table has its class as b."""

    rows: list[dict] = field(default_factory=list)

    def table(self, name: str, model: str, origin: str) -> None:
        self.rows.append({"kind": "table", "a": name, "b": model, "origin": origin})

    def relation(self, child: str, columns: list[str], parent: str, label: str, origin: str, nullable: str = "unknown", cascade: bool = False) -> None:
        self.rows.append({"kind": "relation", "a": child, "columns": columns, "b": parent, "label": label, "origin": origin, "nullable": nullable, "delete_rule": "CASCADE" if cascade else "NO ACTION"})

    def suspect(self, source: str, target: str, strong: bool, why: str) -> None:
        self.rows.append({"kind": "suspect", "a": source, "b": target, "strong": strong, "label": why})

    def note(self, text: str) -> None:
        self.rows.append({"kind": "note", "label": text})


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(tree, path, text, writes, reads) of the files under root whose path in it matches pattern."""
    whole = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    at = F.substring_index("file", root.rstrip("/") + "/", -1)
    return whole.select(F.lit(root).alias("tree"), at.alias("path"), "text").where(F.col("path").rlike(pattern)).select("*", written_tables(F.col("text")).alias("writes"), read_tables(F.col("text")).alias("reads"))


def resolve(sources: DataFrame, read: Callable[[list[Source]], Found]) -> DataFrame:
    """What read finds in each tree. A tree's model files are one group; its size is that of a code base."""
    import pandas as pd

    columns = [c.split()[0] for c in FOUND.split(", ")]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = read([Source(r.path, r.text, list(r.writes), list(r.reads)) for r in pdf.sort_values("path").itertuples()])
        return pd.DataFrame([[key[0], *[row.get(c) for c in columns[1:]]] for row in found.rows], columns=columns)

    return sources.groupBy("tree").applyInPandas(lambda key, pdf: one(key, pdf), FOUND)


def frames(found: DataFrame, source: str) -> dict[str, DataFrame]:
    """tables, relations (one for each child, columns and parent, with all its evidence), suspects, notes, and the table of each class and file.

    A relation cascades if any declaration does; of nullabilities a stated one goes before unknown, and false before true.
    """
    rel = found.where("kind = 'relation'")
    evidence = F.struct(F.lit(source).alias("source"), F.col("origin"), F.col("label").alias("constraint"), F.col("delete_rule"), F.col("nullable")).cast(EVIDENCE)
    said = F.collect_set("nullable")
    merged = rel.groupBy(F.col("a").alias("child_table"), F.col("columns").alias("child_columns"), F.col("b").alias("parent_table")).agg(
        F.min("label").alias("constraint"), F.when(F.bool_or(F.col("delete_rule") == "CASCADE"), "CASCADE").otherwise("NO ACTION").alias("delete_rule"),
        F.when(F.array_contains(said, "false"), "false").when(F.array_contains(said, "true"), "true").otherwise("unknown").alias("nullable"),
        F.array_sort(F.collect_set(evidence)).alias("evidences"),
    )
    typed = merged.withColumns({"parent_schema": F.lit(None).cast("string"), "all_not_null": F.col("nullable") == "false"})
    ends = rel.select(F.explode(F.array("a", "b")).alias("table"))
    return {
        "tables": found.where("kind = 'table'").select(F.col("a").alias("table")).union(ends).distinct(),
        "classes": found.where("kind = 'table'").select(F.col("b").alias("class"), F.col("a").alias("table")).distinct(),
        "files": found.where("kind = 'table'").select(F.regexp_replace("origin", ":[0-9]+$", "").alias("file"), F.col("a").alias("table")).distinct(),
        "relations": typed.select(*[F.col(f.name).cast(f.dataType) for f in RELATION]),
        "suspects": found.where("kind = 'suspect'").select(F.col("a").alias("from_table"), F.col("b").alias("to_table"), "strong", F.col("label").alias("why")).distinct(),
        "notes": found.where("kind = 'note'").select(F.col("label").alias("note")).distinct(),
    }
