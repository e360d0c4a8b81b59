"""Relations, pairs and transactions drawn from the driver's tables, as inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The tables' own relations (child, column, parent, its key, rule).
CATALOG = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "CASCADE"), ("lineitem", "l_partkey", "part", "p_partkey", "NO ACTION"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "NO ACTION"),
    ("orders", "o_custkey", "customer", "c_custkey", "NO ACTION"), ("customer", "c_nationkey", "nation", "n_nationkey", "NO ACTION"), ("supplier", "s_nationkey", "nation", "n_nationkey", "NO ACTION"),
    ("nation", "n_regionkey", "region", "r_regionkey", "NO ACTION"), ("labels", "doc_id", "documents", "doc_id", "NO ACTION"),
]
TOP = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table) of every Parquet table in the folder: a file or a folder of parts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return spark.createDataFrame([(n.removesuffix(".parquet"),) for n in names if n.endswith(".parquet")], "table string")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' relations, with not-null and enforced measured on the rows."""
    out = None
    for child, col, parent, key, rule in CATALOG:
        c = table(spark, sf_dir, child).select(F.col(col).alias("k"))
        p = table(spark, sf_dir, parent).select(F.col(key).alias("k")).distinct().withColumn("there", F.lit(True))
        one = c.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(p, "k", "left").agg(
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(F.when(F.col("k").isNotNull() & F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        )
        row = one.select(
            F.lit(f"{child}.{col}").alias("constraint"), F.lit(child).alias("child_table"), F.array(F.lit(col)).alias("child_columns"), F.lit(None).cast("string").alias("parent_schema"), F.lit(parent).alias("parent_table"), F.lit(rule).alias("delete_rule"),
            (F.col("nulls") == 0).alias("all_not_null"), F.lit("").alias("nullable"),
            F.array(F.struct(F.when(F.col("orphans") == 0, "physical").otherwise("observed").alias("source"), F.lit("").alias("origin"), F.lit(f"{child}.{col}").alias("constraint"), F.lit(rule).alias("delete_rule"), F.lit("").alias("nullable"))).alias("evidences"),
        )
        out = row if out is None else out.union(row)
    return out


def trade(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """(a, b, cnt, revenue): lines between customers and suppliers of two nations, a < b by name."""
    o = table(spark, sf_dir, "orders")
    if year:  # a range, so that the scan is pruned
        o = o.where((F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cn"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("sn"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    each = lines.join(s, lines["l_suppkey"] == s["s_suppkey"]).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return each.where("cn <> sn").groupBy(F.least("cn", "sn").alias("a"), F.greatest("cn", "sn").alias("b")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("cents").alias("revenue"))


def trade_relations(spark: SparkSession, sf_dir: str, by: str = "cnt", year: int | None = None, top: int = TOP) -> DataFrame:
    """The top pairs as relations: of rank r, every fourth cascades, every other is not null and every third else unknown."""
    best = trade(spark, sf_dir, year).orderBy(F.desc(by), "a", "b").limit(top)
    ranked = best.select("a", "b", "cnt", F.row_number().over(_by(by)).alias("r"))
    rule, known = F.when(F.col("r") % 4 == 0, "CASCADE").otherwise("NO ACTION"), F.when(F.col("r") % 3 == 0, "unknown").otherwise("")
    ev = F.struct(F.lit("physical").alias("source"), F.lit("").alias("origin"), F.concat_ws("-", "a", "b").alias("constraint"), rule.alias("delete_rule"), known.alias("nullable"))
    return ranked.select(
        F.concat_ws("-", "a", "b").alias("constraint"), F.col("a").alias("child_table"), F.array(F.lit("id")).alias("child_columns"), F.lit(None).cast("string").alias("parent_schema"), F.col("b").alias("parent_table"), rule.alias("delete_rule"),
        (F.col("r") % 2 == 0).alias("all_not_null"), known.alias("nullable"), F.array(ev).alias("evidences"), "r", "cnt",
    )


def _by(by: str):
    from pyspark.sql import Window

    return Window.orderBy(F.desc(by), "a", "b")  # over the top rows alone


def purchases(spark: SparkSession, sf_dir: str, least: int = 50, below: int | None = None) -> DataFrame:
    """Every large line as a relation of the customer to the part: cascading where it was returned, not null where it is final. Nodes grow with the customers and parts."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least)
    if below:
        lines = lines.where(F.col("l_quantity") < below)
    each = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rule = F.when(F.col("l_returnflag") == "R", "CASCADE").otherwise("NO ACTION")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    ev = F.struct(F.lit("physical").alias("source"), F.lit("").alias("origin"), name.alias("constraint"), rule.alias("delete_rule"), F.lit("").alias("nullable"))
    return each.select(
        name.alias("constraint"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("child_table"), F.array(F.lit("id")).alias("child_columns"), F.lit(None).cast("string").alias("parent_schema"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("parent_table"), rule.alias("delete_rule"), (F.col("l_linestatus") == "F").alias("all_not_null"), F.lit("").alias("nullable"), F.array(ev).alias("evidences"),
    )


def order_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, table): the nations of the suppliers of each order."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("table"))
    return table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").cast("string").alias("tx"), "table")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread, seq, sql): each user's events as a statement log. signup begins, purchase commits, error rolls back, the rest write the table of their type."""
    kind = F.col("event_type")
    sql = F.when(kind == "signup", "BEGIN").when(kind == "purchase", "COMMIT").when(kind == "error", "ROLLBACK").otherwise(F.concat(F.lit("INSERT INTO "), kind, F.lit(" VALUES (1)")))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread"), F.struct("ts", "event_id").alias("seq"), sql.alias("sql"))


SQL = {
    "trade": """
line AS (SELECT cn.n_name AS cn, sn.n_name AS sn, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, year(o_orderdate) AS y
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey),
trade AS (SELECT least(cn, sn) AS a, greatest(cn, sn) AS b, count(*) AS cnt, CAST(sum(cents) AS BIGINT) AS revenue FROM line WHERE cn <> sn {and_year} GROUP BY 1, 2)""",
    "rel": """
rel{x} AS (SELECT a AS child, b AS parent, r, cnt, CASE WHEN r % 4 = 0 THEN 'CASCADE' ELSE 'NO ACTION' END AS rule, r % 2 = 0 AS nn, CASE WHEN r % 3 = 0 THEN 'unknown' ELSE '' END AS nullable
        FROM (SELECT a, b, cnt, row_number() OVER (ORDER BY {by} DESC, a, b) AS r FROM trade{x}) WHERE r <= 24)""",
    "purchase": """
rel AS (SELECT 'c' || o_custkey AS child, 'p' || l_partkey AS parent, CASE WHEN l_returnflag = 'R' THEN 'CASCADE' ELSE 'NO ACTION' END AS rule, l_linestatus = 'F' AS nn FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50)""",
    "whole": """
core AS (SELECT * FROM edge)""",
    "edge": """
edge AS (SELECT least(child, parent) AS a, greatest(child, parent) AS b, CAST(sum(w) AS DOUBLE) AS weight, CAST(max(w) AS DOUBLE) AS max_weight, count(*) AS n_relations, bool_or(rule = 'CASCADE') AS has_cascade, bool_or(nn) AS any_not_null
         FROM (SELECT *, CASE WHEN rule = 'CASCADE' THEN 3.0 WHEN nn THEN 2.0 ELSE 1.0 END AS w FROM rel) WHERE child <> parent GROUP BY 1, 2)""",
    "deg": """
deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edge UNION ALL SELECT b FROM edge) GROUP BY 1),
hub AS (SELECT node, degree FROM deg WHERE degree >= 6),
kept AS (SELECT * FROM edge WHERE a NOT IN (SELECT node FROM hub) AND b NOT IN (SELECT node FROM hub))""",
    "group": """
clink AS (SELECT a AS u, b AS v FROM kept WHERE has_cascade UNION SELECT b, a FROM kept WHERE has_cascade),
creach(u, v) AS (SELECT u, v FROM clink UNION SELECT c.u, l.v FROM creach c JOIN clink l ON c.v = l.u),
grp AS (SELECT u AS node, least(u, min(v)) AS representative FROM creach GROUP BY u)""",
    "contracted": """
core AS (SELECT least(ra, rb) AS a, greatest(ra, rb) AS b, sum(weight) AS weight, max(max_weight) AS max_weight, CAST(sum(n_relations) AS BIGINT) AS n_relations, bool_or(has_cascade) AS has_cascade, bool_or(any_not_null) AS any_not_null
         FROM (SELECT kept.*, coalesce(x.representative, a) AS ra, coalesce(y.representative, b) AS rb FROM kept LEFT JOIN grp x ON a = x.node LEFT JOIN grp y ON b = y.node) WHERE ra <> rb GROUP BY 1, 2)""",
    "bridge": """
und AS (SELECT a AS u, b AS v, a || '|' || b AS id FROM core UNION ALL SELECT b, a, a || '|' || b FROM core),
walk(skip, node) AS (SELECT a || '|' || b, a FROM core UNION SELECT w.skip, und.v FROM walk w JOIN und ON und.u = w.node AND und.id <> w.skip),
bridge AS (SELECT core.* FROM core WHERE NOT EXISTS (SELECT 1 FROM walk WHERE skip = a || '|' || b AND node = b)),
flow AS (SELECT u, v FROM und WHERE id NOT IN (SELECT a || '|' || b FROM bridge)),
reach(u, v) AS (SELECT u, v FROM flow UNION SELECT r.u, f.v FROM reach r JOIN flow f ON r.v = f.u),
block AS (SELECT n.node, least(n.node, coalesce(min(reach.v), n.node)) AS block FROM (SELECT DISTINCT u AS node FROM und) n LEFT JOIN reach ON reach.u = n.node GROUP BY n.node)""",
    "pair": """
txt AS (SELECT DISTINCT l_orderkey AS tx, n_name AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ctx AS (SELECT * FROM txt WHERE tx IN (SELECT tx FROM txt GROUP BY tx HAVING count(*) >= 2)),
single AS (SELECT t, count(*) AS n FROM ctx GROUP BY t),
pair AS (SELECT x.t AS a, y.t AS b, count(*) AS count FROM ctx x JOIN ctx y ON x.tx = y.tx AND x.t < y.t GROUP BY 1, 2),
scored AS (SELECT p.a, p.b, p.count, sa.n AS n_a, sb.n AS n_b, t.total, CASE WHEN p.count >= t.total THEN 1.0 ELSE ln(CAST(p.count AS DOUBLE) * t.total / (CAST(sa.n AS DOUBLE) * sb.n)) / -ln(CAST(p.count AS DOUBLE) / t.total) END AS npmi
           FROM pair p JOIN single sa ON p.a = sa.t JOIN single sb ON p.b = sb.t, (SELECT count(DISTINCT tx) AS total FROM ctx) t)""",
}


def sql(parts: str, query: str) -> str:
    """A query over the named parts, in order; trade:YEAR:X and rel:BY:X make parts of their own name."""
    out = []
    for p in parts.split():
        name, *args = p.split(":")
        if name == "trade":
            year, x = (args + ["", ""])[:2]
            text = SQL["trade"].format(and_year=f"AND y = {year}" if year else "")
            if x:  # a second one beside the first
                text = text[text.index("trade AS") :].replace("trade AS", f"trade{x} AS")
            out.append(text)
        elif name == "rel":
            by, x = (args + ["cnt", ""])[:2] if args else ("cnt", "")
            out.append(SQL["rel"].format(by=by, x=x))
        else:
            out.append(SQL[name])
    return "WITH RECURSIVE " + ",".join(out) + "\n" + query
