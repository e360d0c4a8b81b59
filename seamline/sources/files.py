"""Readers of schema dumps, relation lists, rules, logs and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seamline.model import SCHEMA_DUMP
from seamline.operators.relations import split_schemas, stamp_physical


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a text file's lines, 1 first: a log or a list is read whole, so its lines are numbered in their order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("seq", "line")).select((F.col("seq") + 1).alias("seq"), "line")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a log's lines in order, read in splits: seq is the file, where its split begins, and a number that ascends within the split. Files of a folder are in order of their names."""
    seq = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(seq.alias("seq"), F.col("value").alias("line"))


def schema_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """tables, relations and cross_relations of a schema dump; unknown fields are ignored, a dump without a schema name is an error."""
    dump = spark.read.schema(SCHEMA_DUMP).json(path, multiLine=True)
    head = dump.select("schema").first()
    if head is None or not head["schema"]:
        raise ValueError(f"{path} has no schema")
    stamp = lambda c: stamp_physical(dump.select(F.explode(c).alias("f")).select("f.*"))
    return {"tables": dump.select(F.explode("tables").alias("table")).orderBy("table"), "relations": split_schemas(stamp("fks"))[0], "cross_relations": stamp("cross_schema_fks")}


def dump_schema(tables: list[str], relations: DataFrame, path: str, schema: str, dialect: str = "") -> None:
    """Write a schema dump that schema_json reads. Metadata is small; it is gathered to one document."""
    import json

    keep = ["constraint", "child_table", "child_columns", "parent_schema", "parent_table", "delete_rule", "all_not_null"]
    rows = [r.asDict() for r in relations.select(keep).orderBy("child_table", "constraint").collect()]
    own, cross = ([{k: v for k, v in r.items() if v is not None} for r in rows if bool(r["parent_schema"]) == far] for far in (False, True))
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema": schema, "dialect": dialect, "tables": sorted(tables), "fks": own, "cross_schema_fks": cross}, f, indent=2, ensure_ascii=False)
        f.write("\n")


def relations_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, child, columns, parent) of lines of three tab-separated cells; # starts a comment, columns are comma-separated, a header may come first. Other lines and empty cells are errors."""
    rows = numbered(spark, path).select("seq", F.regexp_replace("line", "#.*$", "").alias("line")).where(F.trim(F.regexp_replace("line", "\t", " ")) != "")
    cells = rows.select("seq", F.transform(F.split("line", "\t"), lambda x: F.trim(x)).alias("c"))
    bad = cells.where((F.size("c") != 3) | F.exists("c", lambda x: x == "")).orderBy("seq").first()
    if bad:
        raise ValueError(f"{path}:{bad['seq']}: three tab-separated cells are needed")
    first = cells.agg(F.min("seq")).first()[0]
    header = (F.col("seq") == F.lit(first)) & F.lower(F.col("c")[0]).isin("child", "child_table") & F.lower(F.col("c")[2]).isin("parent", "parent_table")
    return cells.where(~header).select(F.col("seq").alias("line_no"), F.col("c")[0].alias("child"), F.transform(F.split(F.col("c")[1], ","), lambda x: F.trim(x)).alias("columns"), F.col("c")[2].alias("parent"))


def bundle_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(suffix or prefix, value) in order; # starts a comment. Other lines, or none, are errors. A rule list is written by hand, so it is gathered."""
    out = []
    for r in numbered(spark, path).orderBy("seq").collect():
        parts = r["line"].split("#")[0].split()
        if parts and (len(parts) != 2 or parts[0] not in ("suffix", "prefix")):
            raise ValueError(f"{path}:{r['seq']}: 'suffix value' or 'prefix value' is needed")
        out += [tuple(parts)] if parts else []
    if not out:
        raise ValueError(f"{path} has no rule")
    return out


def criticality(spark: SparkSession, path: str) -> DataFrame:
    """(table, criticality) of a JSON object from table to number."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))).alias("table", "criticality"))


def churn(lines: DataFrame) -> DataFrame:
    """(path, n): commits of each path by its present name, from (seq, line) of a name-status log, newest first.

    A rename (R) counts on its new path, and what came before it (later lines) on the old path counts there too. The
    fold follows the lines' order; a log of one repository is one group.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        now: dict[str, str] = {}
        counts: dict[str, int] = {}
        for line in pdf.sort_values("seq")["line"]:
            cells = line.split("\t")
            if len(cells) == 3 and cells[0][:1] in "RC":
                new = now.get(cells[2], cells[2])
                counts[new] = counts.get(new, 0) + 1
                if cells[0][0] == "R":
                    now[cells[1]] = new
            elif len(cells) == 2:
                at = now.get(cells[1], cells[1])
                counts[at] = counts.get(at, 0) + 1
        return pd.DataFrame({"path": list(counts), "n": list(counts.values())})

    return lines.groupBy(F.lit(1).alias("log")).applyInPandas(lambda pdf: fold(pdf), "path string, n long")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, line) of a repository's name-status log, newest first, with renames."""
    import subprocess

    log = subprocess.run(["git", "-C", folder, "log", "-M", "--name-status", "--pretty=format:"], check=True, capture_output=True, text=True).stdout
    return spark.createDataFrame([(i, line) for i, line in enumerate(log.splitlines()) if line], "seq long, line string")


def catalog_jdbc(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """Catalog rows for relations.fold_keys, of the current schema; joins and filters run in the database, which is Postgres for postgres:// and postgresql:// addresses and MySQL else."""
    text = POSTGRES_KEYS if url.removeprefix("jdbc:").startswith(("postgres://", "postgresql://")) else MYSQL_KEYS
    return spark.read.format("jdbc").options(url=url, query=text, **options).load()


def catalog_tables(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """(table) of the current schema's tables; views are left out."""
    own = "current_schema()" if url.removeprefix("jdbc:").startswith(("postgres://", "postgresql://")) else "DATABASE()"
    text = f"""SELECT table_name AS "table" FROM information_schema.tables WHERE table_schema = {own} AND table_type = 'BASE TABLE'"""
    return spark.read.format("jdbc").options(url=url, query=text, **options).load()


# The catalogs' own tables and columns.
MYSQL_KEYS = """SELECT k.constraint_name AS "constraint", k.table_name AS child_table, k.ordinal_position AS ordinal, k.column_name AS "column", c.is_nullable = 'NO' AS not_null,
NULLIF(k.referenced_table_schema, DATABASE()) AS parent_schema, k.referenced_table_name AS parent_table, r.delete_rule
FROM information_schema.key_column_usage k JOIN information_schema.referential_constraints r ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name AND r.table_name = k.table_name
JOIN information_schema.columns c ON c.table_schema = k.table_schema AND c.table_name = k.table_name AND c.column_name = k.column_name
WHERE k.table_schema = DATABASE() AND k.referenced_table_name IS NOT NULL"""
POSTGRES_KEYS = """SELECT o.conname AS "constraint", t.relname AS child_table, u.n AS ordinal, a.attname AS "column", a.attnotnull AS not_null,
NULLIF(q.nspname, current_schema()) AS parent_schema, p.relname AS parent_table, CASE o.confdeltype WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'r' THEN 'RESTRICT' WHEN 'd' THEN 'SET DEFAULT' ELSE 'NO ACTION' END AS delete_rule
FROM pg_constraint o JOIN pg_class t ON t.oid = o.conrelid JOIN pg_class p ON p.oid = o.confrelid JOIN pg_namespace s ON s.oid = t.relnamespace JOIN pg_namespace q ON q.oid = p.relnamespace
CROSS JOIN LATERAL unnest(o.conkey) WITH ORDINALITY AS u(col, n) JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = u.col
WHERE o.contype = 'f' AND s.nspname = current_schema()"""
