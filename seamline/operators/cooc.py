"""Co-occurrence: tables written in the same transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.model import OBSERVED_NPMI
from seamline.shared import stage

# The line formats of the two servers' statement logs, and write statements.
MYSQL = r"^\S+\s+(\d+)\s+(Query|Execute|Prepare|Connect|Quit|Init)\b\s*(.*)$"
POSTGRES = r"\[(\d+)\].*?(?:LOG|STATEMENT):\s+(?:statement|execute [^:]*):\s*(.*)$"
WRITE = r"""(?i)^\s*(?:(?:INSERT(?:\s+IGNORE)?|REPLACE)\s+INTO|UPDATE(?:\s+IGNORE)?|DELETE\s+FROM)\s+[`"]?(?:[\w$]+[`"]?\.[`"]?)?([\w$]+)"""


def write_target(sql: Column) -> Column:
    """The lower-cased table that a statement writes, else null."""
    return F.lower(F.nullif(F.regexp_extract(sql, WRITE, 1), F.lit("")))


def statements(log: DataFrame) -> DataFrame:
    """(thread, seq, command, sql) of a server log's lines (seq, line); a command that is no statement has null sql. Other lines continue the last statement and are left out."""
    my = lambda k: F.regexp_extract("line", MYSQL, k)
    pg = lambda k: F.regexp_extract("line", POSTGRES, k)
    row = F.when(my(1) != "", F.struct(my(1).alias("thread"), F.when(my(2).isin("Query", "Execute"), my(3)).alias("sql"))).when(pg(1) != "", F.struct(pg(1).alias("thread"), pg(2).alias("sql")))
    return log.select("seq", row.alias("r")).where("r IS NOT NULL").select("r.thread", "seq", "r.sql")


def sessionise(statement: DataFrame) -> DataFrame:
    """(tx, table) of committed transactions, from (thread, seq, sql) in order of seq within a thread.

    BEGIN and START TRANSACTION open one and drop an open one; COMMIT closes it; ROLLBACK and any command without sql
    drop it; writes outside one and transactions left open don't count. A thread is an ordered window; threads are dealt
    to tasks by key.
    """
    s = F.upper(F.trim("sql"))
    kind = F.when(F.col("sql").isNull(), "drop").when(s.rlike(r"^(BEGIN|START\s+TRANSACTION)\b"), "begin").when(s.rlike(r"^COMMIT\b"), "commit").when(s.rlike(r"^ROLLBACK\b"), "drop").otherwise("other")
    order = Window.partitionBy("thread").orderBy("seq")
    marked = statement.select("thread", "seq", kind.alias("kind"), write_target(F.col("sql")).alias("table"))
    turns = marked.withColumn("turn", F.sum(F.when(F.col("kind").isin("begin", "commit", "drop"), 1).otherwise(0)).over(order))
    within = turns.where((F.col("kind") == "other") & F.col("table").isNotNull()).select("thread", "turn", "table").distinct()
    ends = turns.where("kind IN ('begin', 'commit', 'drop')").select("thread", "turn", "kind")
    opened = ends.where("kind = 'begin'").select("thread", "turn")
    closed = ends.where("kind = 'commit'").select("thread", (F.col("turn") - 1).alias("turn"))
    done = within.join(opened.join(closed, ["thread", "turn"]), ["thread", "turn"])
    return done.select(F.concat_ws(":", "thread", "turn").alias("tx"), "table")


def neutral(lines: DataFrame) -> DataFrame:
    """(tx, table) of lines (seq, line) that each list the tables of a transaction; # starts a comment line."""
    named = F.filter(F.split(F.lower("line"), r"[, \t]+"), lambda t: t != "")
    return lines.where(~F.ltrim("line").startswith("#")).select(F.col("seq").cast("string").alias("tx"), F.explode(F.array_distinct(named)).alias("table"))


def read_log(lines: DataFrame) -> DataFrame:
    """(tx, table) of lines (seq, line), in the format they show: a server's if any line is of one, else neutral."""
    found = statements(lines)
    return sessionise(found) if not found.isEmpty() else neutral(lines)


def counted(tx_tables: DataFrame) -> DataFrame:
    """(tx, tables): the distinct tables of each transaction with two at least; others don't count anywhere."""
    return tx_tables.groupBy("tx").agg(F.array_sort(F.collect_set("table")).alias("tables")).where(F.size("tables") >= 2)


def pairs(tx_tables: DataFrame, rename: DataFrame | None = None) -> DataFrame:
    """(a, b, count, n_a, n_b, total, npmi) of the pairs a < b written together.

    A transaction's pairs, its tables and itself are counted in one pass over its own sorted list, summed map-side; there
    is no join of the transactions with themselves, and what is written and joined after has the size of a schema.

    rename: (from_table, to_table) of tables counted under another's name afterwards, as a bundle does: counts of
    pairs and of tables are added, pairs within a name go, and the total stays. A transaction that writes both a table
    and its shadow counts twice for the name.
    """
    up = F.expr("""concat(flatten(transform(tables, (x, i) -> transform(slice(tables, i + 2, size(tables)), y -> struct(x as a, y as b)))),
        transform(tables, x -> struct(x as a, cast(null as string) as b)), array(struct(cast(null as string) as a, cast(null as string) as b)))""")
    counts = stage(counted(tx_tables).select(F.explode(up).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("count")), "pair-counts")
    if rename is not None:
        counts = rename_counts(counts, rename)
    both, single = counts.where("b IS NOT NULL"), counts.where("a IS NOT NULL AND b IS NULL").select(F.col("a").alias("table"), F.col("count").alias("n"))
    total = counts.where("a IS NULL").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    out = both.join(single.select(F.col("table").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("table").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(total))
    return out.withColumn("npmi", npmi("n_a", "n_b", "count", "total")).select("a", "b", "count", "n_a", "n_b", "total", "npmi")


def table_counts(tx_tables: DataFrame) -> DataFrame:
    """(table, n): counted transactions that write each table."""
    return counted(tx_tables).select(F.explode("tables").alias("table")).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def npmi(n_a: str, n_b: str, n_ab: str, total: str) -> Column:
    """ln(p_ab / (p_a p_b)) / -ln p_ab; 0 without observations, 1 where a count is missing or every transaction has both."""
    a, b, ab, t = (F.col(c).cast("double") for c in (n_a, n_b, n_ab, total))
    return F.when((t == 0) | (ab == 0), F.lit(0.0)).when((a == 0) | (b == 0) | (ab >= t), F.lit(1.0)).otherwise(F.log(ab * t / (a * b)) / -F.log(ab / t))


def observed(pair: DataFrame, least: float = OBSERVED_NPMI) -> DataFrame:
    """The pairs from least NPMI on: those that count as observed."""
    return pair.where(F.col("npmi") >= least)


def contract_pairs(pair: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, count, npmi) between representatives: counts added, the highest NPMI, 0 at least."""
    out = pair
    for end in ("a", "b"):
        at = groups.select(F.col("node").alias(f"__{end}"), F.col("representative").alias("__rep"))
        out = out.join(at, F.col(end) == F.col(f"__{end}"), "left").withColumn(end, F.coalesce("__rep", end)).drop(f"__{end}", "__rep")
    out = out.where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return out.groupBy("a", "b").agg(F.sum("count").alias("count"), F.greatest(F.max("npmi"), F.lit(0.0)).alias("npmi"))


def rename_counts(counts: DataFrame, rename: DataFrame) -> DataFrame:
    """Counts (a, b, count) under the names of (from_table, to_table): those that meet are added, pairs within a name go. A null b is the count of a alone, nulls of both the total."""
    out = counts
    for end in ("a", "b"):
        out = out.join(rename.select(F.col("from_table").alias("__from"), F.col("to_table").alias("__to")), F.col(end) == F.col("__from"), "left").withColumn(end, F.coalesce("__to", end)).drop("__from", "__to")
    a, b = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b")), F.when(F.col("b").isNull(), F.col("b")).otherwise(F.greatest("a", "b"))
    return out.where("b IS NULL OR a <> b").select(a.alias("a"), b.alias("b"), "count").groupBy("a", "b").agg(F.sum("count").alias("count"))


def cooc_hubs(pair: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """(node, degree) of the tables written together with threshold or more others that no relation links them to."""
    loose = pair.select("a", "b").join(edges.select("a", "b"), ["a", "b"], "left_anti")
    return loose.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= threshold)


def report(pair: DataFrame, edges: DataFrame, bridge: DataFrame, threshold: int) -> DataFrame:
    """pair with has_fk, is_bridge and suppressed (an end is a co-occurrence hub, and no relation backs the pair)."""
    flag = lambda df, name: df.select("a", "b").distinct().withColumn(name, F.lit(True))
    out = pair.join(flag(edges, "has_fk"), ["a", "b"], "left").join(flag(bridge, "is_bridge"), ["a", "b"], "left")
    hub = cooc_hubs(pair, edges, threshold).select("node")
    for end in ("a", "b"):
        out = out.join(hub.select(F.col("node").alias(end)).withColumn(f"__{end}", F.lit(True)), end, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(*pair.columns, yes("has_fk").alias("has_fk"), yes("is_bridge").alias("is_bridge"), (~yes("has_fk") & (yes("__a") | yes("__b"))).alias("suppressed"))
