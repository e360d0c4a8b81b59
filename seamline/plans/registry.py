"""The library's own queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.operators import compare, cooc, graph, merge, partition, relations as rel
from seamline.operators.components import connected_components
from seamline.functions import inflect as names, rawsql
from seamline.plans import analysis, sinks, substrate as sub
from seamline.sources import files, models, rails, yii
from seamline.plans.substrate import sql
from seamline.shared import shared_dir, stage

_Q: dict[str, tuple[Callable, str | None]] = {}


def query(oracle: str | None = None):
    def add(f):
        _Q[f.__name__] = (f, oracle)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _Q.items() if s}


def _pairs(*names: str) -> list:
    return [F.round(c, 6).alias(c) if c in ("weight", "npmi", "max_weight", "modularity") else F.col(c) for c in names]


EDGE = "a, b, weight, max_weight, n_relations, has_cascade, any_not_null"
E_ = EDGE.split(", ")


class Graph:
    """The graph of the trade relations, step by step."""

    def __init__(self, spark: SparkSession, sf_dir: str, by: str = "cnt", year: int | None = None) -> None:
        self.relations = stage(sub.trade_relations(spark, sf_dir, by, year), "relations")  # few rows, read many times
        self.edges = graph.bundle_edges(self.relations)
        self.hubs = graph.hubs(self.edges, 6)
        self.kept = graph.without(self.edges, self.hubs)

    @cached_property
    def groups(self) -> DataFrame:
        return graph.cascade_groups(self.kept)

    @cached_property
    def core(self) -> DataFrame:
        return stage(graph.contract(self.kept, self.groups), "core")

    @cached_property
    def bridges(self) -> DataFrame:
        return stage(graph.bridges(self.core), "bridges")

    @cached_property
    def blocks(self) -> DataFrame:
        return stage(graph.blocks(self.core, self.bridges), "blocks")


# -- relations and edges -------------------------------------------------------------------------------------------

_MEASURED = " UNION ALL ".join(
    f"SELECT '{c}' AS child_table, '{k}' AS child_columns, '{p}' AS parent_table, '{r}' AS delete_rule, count(*) FILTER (c.{k} IS NULL) = 0 AS all_not_null, count(*) FILTER (c.{k} IS NOT NULL AND p.{pk} IS NULL) = 0 AS enforced FROM {c} c LEFT JOIN (SELECT DISTINCT {pk} FROM {p}) p ON c.{k} = p.{pk}"
    for c, k, p, pk, r in sub.CATALOG
)


@query(f"SELECT *, CAST(CASE WHEN delete_rule = 'CASCADE' THEN 3 WHEN all_not_null THEN 2 ELSE 1 END AS DOUBLE) AS weight, CASE WHEN enforced THEN '' ELSE 'logical_' END || CASE WHEN delete_rule = 'CASCADE' THEN 'cascade' WHEN all_not_null THEN 'not_null' ELSE 'nullable' END AS reason FROM ({_MEASURED})")
def fk_scan_measured(spark, sf_dir):
    return rel.weighted(sub.catalog(spark, sf_dir)).select("child_table", F.array_join("child_columns", ",").alias("child_columns"), "parent_table", "delete_rule", "all_not_null", rel.enforced().alias("enforced"), "weight", "reason")


@query(f"SELECT least(child_table, parent_table) AS a, greatest(child_table, parent_table) AS b, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS n_relations, bool_or(delete_rule = 'CASCADE') AS has_cascade FROM (SELECT *, CASE WHEN delete_rule = 'CASCADE' THEN 3 WHEN all_not_null THEN 2 ELSE 1 END AS w FROM ({_MEASURED})) GROUP BY 1, 2")
def edge_report(spark, sf_dir):
    return graph.bundle_edges(sub.catalog(spark, sf_dir)).select("a", "b", "weight", "n_relations", "has_cascade")


@query("SELECT table_name AS \"table\" FROM information_schema.tables WHERE table_schema = 'main' EXCEPT SELECT unnest([child_table, parent_table]) FROM (" + _MEASURED + ")")
def isolated_tables(spark, sf_dir):
    return graph.isolated(sub.tables(spark, sf_dir), sub.catalog(spark, sf_dir))


@query(sql("trade rel", "SELECT child AS child_table, parent AS parent_table, CAST(CASE WHEN rule = 'CASCADE' THEN 3 WHEN nn THEN 2 ELSE 1 END AS DOUBLE) AS weight, CASE WHEN rule = 'CASCADE' THEN 'cascade' WHEN nn THEN 'not_null' WHEN nullable = 'unknown' THEN 'unknown_provisional' ELSE 'nullable' END AS reason FROM rel"))
def relation_weights(spark, sf_dir):
    return rel.weighted(sub.trade_relations(spark, sf_dir)).select("child_table", "parent_table", "weight", "reason")


@query(sql("trade rel edge", f"SELECT {EDGE} FROM edge"))
def edge_bundle(spark, sf_dir):
    return Graph(spark, sf_dir).edges.select(E_)


@query(sql("trade rel edge deg", "SELECT node, degree FROM deg"))
def node_degree(spark, sf_dir):
    return graph.degrees(Graph(spark, sf_dir).edges)


@query(sql("trade rel edge deg", "SELECT node, degree, t AS threshold FROM deg, (SELECT greatest(6, CAST(floor(count(*) * 15 / 100) AS BIGINT)) AS t FROM deg) WHERE degree >= t"))
def hub_detect(spark, sf_dir):
    return graph.hubs(Graph(spark, sf_dir).edges)


@query(sql("trade rel edge deg", f"SELECT {EDGE} FROM kept"))
def hub_remove(spark, sf_dir):
    return Graph(spark, sf_dir).kept.select(E_)


@query(sql("trade rel edge deg", "SELECT node, degree FROM deg WHERE degree >= 6 AND degree < 18 ORDER BY degree DESC, node LIMIT 10"))
def near_hubs(spark, sf_dir):
    return graph.near_hubs(Graph(spark, sf_dir).edges, 18)


@query(sql("trade rel edge deg group", "SELECT node, representative FROM grp").replace("FROM kept WHERE has_cascade", "FROM edge WHERE has_cascade"))
def cascade_components(spark, sf_dir):
    return graph.cascade_groups(Graph(spark, sf_dir).edges)


@query(sql("trade rel edge deg group contracted", f"SELECT {EDGE} FROM core"))
def contract_edges(spark, sf_dir):
    return Graph(spark, sf_dir).core.select(E_)


_CORE = "trade rel edge deg group contracted bridge"


@query(sql(_CORE, f"SELECT {EDGE} FROM bridge"))
def bridges(spark, sf_dir):
    return Graph(spark, sf_dir).bridges.select(E_)


@query(sql(_CORE, "SELECT node, block FROM block"))
def blocks(spark, sf_dir):
    return Graph(spark, sf_dir).blocks


@query(sql(_CORE, "SELECT bridge.a, bridge.b, weight, x.n AS size_a, y.n AS size_b FROM bridge JOIN block p ON bridge.a = p.node JOIN block q ON bridge.b = q.node JOIN (SELECT block, CAST(sum(coalesce(t, 1)) AS BIGINT) AS n FROM block LEFT JOIN (SELECT representative, count(*) AS t FROM grp GROUP BY 1) ON node = representative GROUP BY 1) x ON p.block = x.block JOIN (SELECT block, CAST(sum(coalesce(t, 1)) AS BIGINT) AS n FROM block LEFT JOIN (SELECT representative, count(*) AS t FROM grp GROUP BY 1) ON node = representative GROUP BY 1) y ON q.block = y.block"))
def bridge_report(spark, sf_dir):
    g = Graph(spark, sf_dir)
    sizes = g.groups.groupBy(F.col("representative").alias("node")).agg(F.count(F.lit(1)).alias("tables"))
    return graph.bridge_report(g.bridges, g.blocks, sizes).select("a", "b", "weight", "size_a", "size_b")


@query(sql(_CORE + " pair", "SELECT bridge.a, bridge.b, least(3, CASE WHEN any_not_null THEN 2 ELSE 1 END + CASE WHEN EXISTS (SELECT 1 FROM scored s WHERE s.a = bridge.a AND s.b = bridge.b) THEN 1 ELSE 0 END) AS level FROM bridge"))
def cut_level(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.cut_levels(g.bridges, cooc.pairs(sub.order_nations(spark, sf_dir))).select("a", "b", "level")


@query(sql(_CORE, "SELECT a, b, weight FROM core WHERE NOT EXISTS (SELECT 1 FROM bridge x WHERE x.a = core.a AND x.b = core.b) ORDER BY weight, a, b LIMIT 5"))
def thin_seams(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.thin_seams(g.core, g.bridges).select("a", "b", "weight")


@query(sql(_CORE, """, h AS (SELECT CASE WHEN c.node IS NOT NULL THEN child ELSE parent END AS hub, CASE WHEN c.node IS NOT NULL THEN parent ELSE child END AS node, p.node IS NOT NULL AS toh, nn
FROM rel LEFT JOIN hub c ON child = c.node LEFT JOIN hub p ON parent = p.node WHERE (c.node IS NULL) <> (p.node IS NULL)),
u AS (SELECT h.*, coalesce(block.block, grp.representative, h.node) AS unit FROM h LEFT JOIN grp ON h.node = grp.node LEFT JOIN block ON block.node = coalesce(grp.representative, h.node))
SELECT unit, hub, count(*) FILTER (toh) AS to_hub, count(*) FILTER (NOT toh) AS from_hub, count(*) FILTER (nn) AS not_null, max(CASE WHEN nn THEN 2 ELSE 1 END) AS level FROM u GROUP BY 1, 2""".replace("\n", " ", 0)))
def hub_contracts(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.hub_contracts(g.relations, g.hubs, units_of(g))


def units_of(g: Graph) -> DataFrame:
    """(node, unit) of every table that is no hub: its representative's block, else its representative, else itself."""
    nodes = graph.endpoints(g.edges).distinct().join(g.hubs.select("node"), "node", "left_anti")
    rep = nodes.join(g.groups, "node", "left").select("node", F.coalesce("representative", "node").alias("rep"))
    return rep.join(g.blocks.select(F.col("node").alias("rep"), "block"), "rep", "left").select("node", F.coalesce("block", "rep").alias("unit"))


@query(sql(_CORE, "SELECT DISTINCT coalesce(representative, d.node) AS \"table\" FROM deg d LEFT JOIN grp ON d.node = grp.node WHERE d.node NOT IN (SELECT node FROM hub) AND coalesce(representative, d.node) NOT IN (SELECT node FROM block)"))
def islands(spark, sf_dir):
    g = Graph(spark, sf_dir)
    nodes = graph.endpoints(g.edges).distinct().select(F.col("node").alias("table"))
    return graph.islands(nodes, g.blocks, graph.isolated(nodes, g.relations), g.hubs, g.groups)


# -- co-occurrence -------------------------------------------------------------------------------------------------

_ROUNDED = "a, b, count, n_a, n_b, total, round(npmi, 6) AS npmi"


@query(sql("pair", f"SELECT {_ROUNDED} FROM scored"))
def cooc_pairs(spark, sf_dir):
    return cooc.pairs(sub.order_nations(spark, sf_dir)).select(_pairs("a", "b", "count", "n_a", "n_b", "total", "npmi"))


@query(sql("pair", "SELECT t AS \"table\", n FROM single"))
def cooc_table_tx(spark, sf_dir):
    return cooc.table_counts(sub.order_nations(spark, sf_dir))


@query(sql("pair", f"SELECT {_ROUNDED} FROM scored WHERE npmi >= 0.02"))
def cooc_observed(spark, sf_dir):
    return cooc.observed(cooc.pairs(sub.order_nations(spark, sf_dir)), 0.02).select(_pairs("a", "b", "count", "n_a", "n_b", "total", "npmi"))


@query(sql("pair trade rel edge", "SELECT node, count(*) AS degree FROM (SELECT unnest([s.a, s.b]) AS node FROM scored s WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.a = s.a AND edge.b = s.b)) GROUP BY 1 HAVING count(*) >= 20"))
def cooc_hub(spark, sf_dir):
    return cooc.cooc_hubs(cooc.pairs(sub.order_nations(spark, sf_dir)), Graph(spark, sf_dir).edges, 20)


@query(sql(_CORE + " pair", """SELECT s.a, s.b, s.count, round(s.npmi, 6) AS npmi, EXISTS (SELECT 1 FROM edge WHERE edge.a = s.a AND edge.b = s.b) AS has_fk, EXISTS (SELECT 1 FROM bridge WHERE bridge.a = s.a AND bridge.b = s.b) AS is_bridge,
NOT EXISTS (SELECT 1 FROM edge WHERE edge.a = s.a AND edge.b = s.b) AND EXISTS (SELECT 1 FROM (SELECT node FROM (SELECT unnest([q.a, q.b]) AS node FROM scored q WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.a = q.a AND edge.b = q.b)) GROUP BY 1 HAVING count(*) >= 22) h WHERE h.node IN (s.a, s.b)) AS suppressed FROM scored s"""))
def cooc_report(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return cooc.report(cooc.pairs(sub.order_nations(spark, sf_dir)), g.edges, g.bridges, 22).select(_pairs("a", "b", "count", "npmi", "has_fk", "is_bridge", "suppressed"))


_TX = """
WITH e AS (SELECT user_id AS thread, ts, event_id, event_type AS k, sum(CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events),
o AS (SELECT thread, turn FROM e WHERE k = 'signup'), c AS (SELECT thread, turn - 1 AS turn FROM e WHERE k = 'purchase')
SELECT DISTINCT e.thread || ':' || CAST(e.turn AS BIGINT) AS tx, k AS "table" FROM e JOIN o USING (thread, turn) JOIN c USING (thread, turn) WHERE k NOT IN ('signup', 'purchase', 'error')
"""


@query(_TX)
def tx_sessionize(spark, sf_dir):
    return cooc.sessionise(sub.event_log(spark, sf_dir))


# -- merging and comparison ----------------------------------------------------------------------------------------

VIEWS_SQL = sql("trade rel trade::2 rel:revenue:2 pair", """, p AS (SELECT least(child, parent) AS a, greatest(child, parent) AS b FROM rel), q AS (SELECT least(child, parent) AS a, greatest(child, parent) AS b FROM rel2),
o AS (SELECT a, b, count, npmi FROM scored WHERE npmi >= 0.02), tp AS (SELECT a AS t FROM p UNION SELECT b FROM p), tq AS (SELECT a AS t FROM q UNION SELECT b FROM q),
u AS (SELECT a, b, p.a IS NOT NULL AS x, q.a IS NOT NULL AS y FROM p FULL JOIN q USING (a, b)),
j AS (SELECT u.a, u.b, x, y, count, npmi, FALSE AS lone FROM u LEFT JOIN o ON u.a = o.a AND u.b = o.b UNION ALL SELECT a, b, FALSE, FALSE, count, npmi, TRUE FROM o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.a = o.a AND u.b = o.b)),
hb AS (SELECT node FROM (SELECT unnest([a, b]) AS node FROM p) GROUP BY 1 HAVING count(*) >= 6),
s AS (SELECT j.*, a IN (SELECT t FROM tp) AS ap, b IN (SELECT t FROM tp) AS bp, a IN (SELECT t FROM tq) AND b IN (SELECT t FROM tq) AS inq FROM j),
d AS (SELECT a, b, CASE WHEN x THEN 'present' WHEN CASE WHEN lone THEN ap AND bp ELSE ap END THEN 'absent' ELSE 'unobserved' END AS physical, CASE WHEN y THEN 'present' WHEN inq THEN 'absent' ELSE 'unobserved' END AS logical, CASE WHEN count IS NULL THEN 'absent' ELSE 'present' END AS observed, count, npmi, a IN (SELECT node FROM hb) OR b IN (SELECT node FROM hb) AS at_hub FROM s),
diff AS (SELECT *, CASE WHEN physical = 'present' AND logical = 'present' THEN 'both' WHEN physical = 'present' AND logical = 'absent' THEN 'physical_only' WHEN physical = 'absent' AND logical = 'present' THEN 'logical_only' WHEN physical = 'absent' AND logical = 'absent' AND observed = 'present' THEN 'observed_only' ELSE 'undetermined' END AS class FROM d) """)


def merged_views(spark, sf_dir):
    """The top pairs by lines as the catalog's relations, those by revenue as declared ones, merged; and which tables either side saw."""
    p = stage(sub.trade_relations(spark, sf_dir).drop("r", "cnt"), "physical")
    q = stage(sub.trade_relations(spark, sf_dir, "revenue").drop("r", "cnt"), "logical")
    said = q.withColumn("evidences", F.transform("evidences", lambda e: e.withField("source", F.lit("declared"))))
    both = stage(merge.merge_relations(p, said), "merged")
    ends = lambda r, c: r.select(F.explode(F.array("child_table", "parent_table")).alias("table")).distinct().withColumn(c, F.lit(True))
    scope = stage(ends(p, "in_physical").join(ends(said, "in_logical"), "table", "full_outer").fillna(False), "scope")
    return p, said, both, scope


def _diff(spark, sf_dir):
    p, _, both, scope = merged_views(spark, sf_dir)
    return compare.diff_edges(both, scope, cooc.observed(cooc.pairs(sub.order_nations(spark, sf_dir)), 0.02), graph.hubs(graph.bundle_edges(p), 6))


@query(VIEWS_SQL + "SELECT a AS child, b AS parent, physical, logical, observed, class, count, round(npmi, 6) AS npmi, at_hub FROM diff")
def edge_diff(spark, sf_dir):
    return _diff(spark, sf_dir).withColumn("npmi", F.round("npmi", 6))


@query(VIEWS_SQL + "SELECT at_hub, class, count(*) AS n FROM diff GROUP BY 1, 2")
def edge_diff_counts(spark, sf_dir):
    return compare.class_counts(_diff(spark, sf_dir))


@query(VIEWS_SQL + "SELECT (SELECT count(*) FROM tp) AS db_tables, (SELECT count(*) FROM tp) AS fk_tables, count(*) FILTER (x) AS physical, count(*) FILTER (y) AS declared, count(*) FILTER (x AND y) AS both, count(*) FILTER (y) AS declarations, CAST(0 AS BIGINT) AS duplicates, 1.0::DOUBLE AS fk_rate FROM u")
def coverage(spark, sf_dir):
    _, _, both, scope = merged_views(spark, sf_dir)
    return compare.coverage(both, scope)


@query(VIEWS_SQL + "SELECT CASE WHEN x AND y THEN 'both' WHEN x THEN 'physical' ELSE 'logical' END AS kind, count(*) AS n FROM u GROUP BY 1")
def evidence_counts(spark, sf_dir):
    return compare.evidence_counts(merged_views(spark, sf_dir)[2])


@query(VIEWS_SQL + "SELECT a AS child_table, b AS parent_table, CASE WHEN x AND y THEN 2 ELSE 1 END AS n_evidence FROM u")
def relation_merge(spark, sf_dir):
    return merged_views(spark, sf_dir)[2].select("child_table", "parent_table", F.size("evidences").alias("n_evidence"))


@query(VIEWS_SQL + "SELECT v, a AS child_table, b AS parent_table FROM (SELECT 'physical' AS v, a, b FROM u WHERE x UNION ALL SELECT 'logical', a, b FROM u WHERE y UNION ALL SELECT 'combined', a, b FROM u)")
def view_projection(spark, sf_dir):
    both = merged_views(spark, sf_dir)[2]
    out = [rel.project(both, v).select(F.lit(v).alias("v"), "child_table", "parent_table") for v in rel.VIEWS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(VIEWS_SQL + ", g AS (SELECT r_name AS \"group\", n_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT \"group\", count(tp.t) AS db_tables, count(tp.t) AS fk_tables, CASE WHEN count(tp.t) > 0 THEN 1.0::DOUBLE END AS rate, CASE WHEN count(tp.t) = 0 THEN 'not_in_db' ELSE '' END AS thin FROM g LEFT JOIN tp ON g.t = tp.t GROUP BY 1")
def group_coverage(spark, sf_dir):
    _, _, both, scope = merged_views(spark, sf_dir)
    r = sub.table(spark, sf_dir, "region")
    groups = sub.table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("group"), F.col("n_name").alias("table"))
    return compare.group_coverage(groups, both, scope)


_ARI = """
WITH l AS ({labels}), c AS (SELECT x, y, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS ij FROM c),
a AS (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY x)), b AS (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT '{name}' AS name, CAST(n AS BIGINT) AS n, round((ij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari FROM s, a, b"""


@query("SELECT * FROM (" + _ARI.format(labels="SELECT lang AS x, source AS y FROM documents", name="lang_source") + ") UNION ALL SELECT * FROM (" + _ARI.format(labels="SELECT quality AS x, toxic AS y FROM labels", name="quality_toxic") + ")")
def ari(spark, sf_dir):
    one = lambda t, a, b: compare.adjusted_rand(sub.table(spark, sf_dir, t), a, b).select(F.lit(f"{a}_{b}").alias("name"), "n", F.round("ari", 6).alias("ari"))
    return one("documents", "lang", "source").unionByName(one("labels", "quality", "toxic"))


@query()
def community_match(spark, sf_dir):
    return compare.match_communities(sub.table(spark, sf_dir, "documents"), "lang", "source")


_SNAP = sql("trade:1995 rel trade:1996:2 rel:cnt:2", "").rstrip()


@query(_SNAP + " SELECT child, parent, change FROM (SELECT child, parent, 'added' AS change FROM rel2 EXCEPT SELECT child, parent, 'added' FROM rel) UNION ALL (SELECT child, parent, 'removed' FROM rel EXCEPT SELECT child, parent, 'removed' FROM rel2)")
def baseline_diff(spark, sf_dir):
    before, now = (stage(sub.trade_relations(spark, sf_dir, year=y).select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent")), "snap") for y in (1995, 1996))
    return compare.baseline_diff(before, now)


@query(_SNAP + ", h AS (SELECT node, count(*) AS total FROM (SELECT unnest([child, parent]) AS node FROM rel) GROUP BY 1), h2 AS (SELECT node, count(*) AS total FROM (SELECT unnest([child, parent]) AS node FROM rel2) GROUP BY 1) SELECT node AS hub, coalesce(h.total, 0) AS total_before, coalesce(h2.total, 0) AS total_now, coalesce(h2.total, 0) > coalesce(h.total, 0) AS regressed FROM h FULL JOIN h2 USING (node) WHERE coalesce(h.total, 0) <> coalesce(h2.total, 0)")
def baseline_hub_delta(spark, sf_dir):
    total = lambda y: sub.trade_relations(spark, sf_dir, year=y).select(F.explode(F.array("child_table", "parent_table")).alias("hub")).groupBy("hub").agg(F.count(F.lit(1)).alias("total"))
    return compare.baseline_hub_delta(total(1995), total(1996))


@query(sql(_CORE, """, s AS (SELECT DISTINCT coalesce(b.block, g.representative, d.node) AS unit, d.node FROM deg d LEFT JOIN grp g ON d.node = g.node LEFT JOIN block b ON b.node = coalesce(g.representative, d.node) WHERE d.node NOT IN (SELECT node FROM hub)),
k AS (SELECT unit, count(*) AS bridges FROM (SELECT unnest([a, b]) AS node FROM bridge) e JOIN block ON block.node = e.node JOIN (SELECT DISTINCT unit FROM s) ON unit = block.block GROUP BY 1),
c AS (SELECT n_name AS node, count(*) AS churn FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1)
SELECT s.unit, count(*) AS tables, coalesce(max(k.bridges), 0) AS bridges, CAST(sum(churn) AS BIGINT) AS churn, CAST(max(n_regionkey) AS DOUBLE) AS criticality FROM s JOIN nation ON s.node = n_name LEFT JOIN c ON c.node = s.node LEFT JOIN k ON k.unit = s.unit GROUP BY 1"""))
def candidate_rank(spark, sf_dir):
    g = Graph(spark, sf_dir)
    n = sub.table(spark, sf_dir, "nation")
    churn = sub.table(spark, sf_dir, "customer").where("c_acctbal < 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("table")).agg(F.count(F.lit(1)).alias("churn"))
    ends = g.bridges.select(F.explode(F.array("a", "b")).alias("node")).join(g.blocks, "node").select(F.col("block").alias("unit"))
    return compare.rank_candidates(units_of(g).select("unit", F.col("node").alias("table")), ends, churn, n.select(F.col("n_name").alias("table"), F.col("n_regionkey").cast("double").alias("criticality")))


# -- partition -----------------------------------------------------------------------------------------------------


def _partition(spark, sf_dir):
    g = Graph(spark, sf_dir)
    units = stage(units_of(g), "units")
    return g, units, stage(partition.partition_graph(g.bridges, units, graph.hub_contracts(g.relations, g.hubs, units), g.hubs), "partition")


_UNIT = """, un AS (SELECT d.node, coalesce(b.block, g.representative, d.node) AS unit FROM deg d LEFT JOIN grp g ON d.node = g.node LEFT JOIN block b ON b.node = coalesce(g.representative, d.node) WHERE d.node NOT IN (SELECT node FROM hub)),
con AS (SELECT coalesce(x.unit, y.unit) AS unit, CASE WHEN x.unit IS NULL THEN child ELSE parent END AS hub, count(*) AS n FROM rel LEFT JOIN un x ON child = x.node LEFT JOIN un y ON parent = y.node WHERE (x.unit IS NULL) <> (y.unit IS NULL) GROUP BY 1, 2),
pe AS (SELECT least(x.unit, y.unit) AS u, greatest(x.unit, y.unit) AS v, weight FROM bridge JOIN un x ON a = x.node JOIN un y ON b = y.node WHERE x.unit <> y.unit UNION ALL SELECT least(unit, con.hub), greatest(unit, con.hub), 3.0 * n / degree FROM con JOIN hub ON con.hub = hub.node),
pg AS (SELECT u, v, sum(weight) AS weight FROM pe GROUP BY 1, 2) """


@query(sql(_CORE, _UNIT + "SELECT u, v, round(CAST(weight AS DOUBLE), 6) AS weight FROM pg"))
def partition_graph(spark, sf_dir):
    return _partition(spark, sf_dir)[2].select(_pairs("u", "v", "weight"))


@query(sql(_CORE, _UNIT + """, lab AS (SELECT n_name AS node, n_regionkey AS c FROM nation), e AS (SELECT x.c AS cu, y.c AS cv, CAST(weight AS DOUBLE) AS w FROM pg JOIN lab x ON u = x.node JOIN lab y ON v = y.node),
t AS (SELECT c, sum(w) AS tot FROM (SELECT cu AS c, w FROM e UNION ALL SELECT cv, w FROM e) GROUP BY 1), i AS (SELECT cu AS c, sum(w) AS w FROM e WHERE cu = cv GROUP BY 1)
SELECT round(sum(coalesce(i.w, 0) / m - power(tot / (2 * m), 2)), 6) AS modularity FROM t LEFT JOIN i USING (c), (SELECT sum(CAST(weight AS DOUBLE)) AS m FROM pg)"""))
def modularity(spark, sf_dir):
    labels = sub.table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("community"))
    return partition.modularity(_partition(spark, sf_dir)[2], labels).select(F.round("q", 6).alias("modularity"))


@query()
def partition_levels(spark, sf_dir):
    g, units, edges = _partition(spark, sf_dir)
    nodes = units.groupBy(F.col("unit").alias("node")).agg(F.count(F.lit(1)).alias("size")).withColumn("is_hub", F.lit(False)).unionByName(g.hubs.select("node", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_hub")))
    one = F.lit("combined").alias("view")
    return partition.levels(edges.select(one, "*"), nodes.select(one, "*"))


# -- names, sources and sinks --------------------------------------------------------------------------------------

_PLURAL = "CASE WHEN w = 'medium' THEN 'media' WHEN regexp_matches(w, '[^aeiou]y$') THEN regexp_replace(w, 'y$', 'ies') WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' ELSE w || 's' END"


@query(f"""WITH x AS (SELECT DISTINCT p_name AS w FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT lower(p_type) FROM part),
y AS (SELECT w, array_to_string(list_transform(string_split(w, ' '), lambda p: upper(p[1]) || p[2:]), '') AS word FROM x) SELECT word, replace({_PLURAL}, ' ', '_') AS tableized, word AS back FROM y""")
def inflect(spark, sf_dir):
    part = sub.table(spark, sf_dir, "part")
    texts = part.select(F.col("p_name").alias("w")).union(sub.table(spark, sf_dir, "customer").select(F.lower("c_mktsegment"))).union(part.select(F.lower("p_type"))).distinct()
    w = texts.select(F.array_join(F.transform(F.split("w", " "), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "").alias("word")).withColumn("tableized", names.tableize(F.col("word")))
    return w.withColumn("back", names.classify(F.col("tableized")))


@query("SELECT s_suppkey AS id, 'log_' || s_nationkey || ',tmp_' || s_suppkey AS written, 'nation_' || s_nationkey AS read FROM supplier")
def raw_sql_tables(spark, sf_dir):
    text = F.format_string('q("INSERT INTO `Log_%1$d` VALUES (1)"); $c->from("nation_%1$d"); // update the docs\nDELETE FROM tmp_%2$d /* FROM c */', "s_nationkey", "s_suppkey")
    src = sub.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("src"))
    return src.select("id", F.array_join(rawsql.written_tables(F.col("src")), ",").alias("written"), F.array_join(rawsql.read_tables(F.col("src")), ",").alias("read"))


@query("SELECT 'item' || s_suppkey || '_version' AS from_table, 'item' || s_suppkey AS to_table FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'item' || s_suppkey || '_version_version', 'item' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'old_item' || s_suppkey, 'item' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0")
def shadow_bundle(spark, sf_dir):
    made = [("item%d", 1), ("item%d_version", 2), ("item%d_version_version", 4), ("old_item%d", 5), ("ghost%d_version", 7)]
    each = F.filter(F.array(*[F.when(F.col("s_suppkey") % n == 0, F.format_string(text, "s_suppkey")) for text, n in made]), lambda t: t.isNotNull())
    return rel.bundle_map(sub.table(spark, sf_dir, "supplier").select(F.explode(each).alias("table")), [("suffix", "_version"), ("prefix", "old_")])


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'tbl_' ELSE '' END || lower(n_name) AS \"table\" FROM nation UNION ALL SELECT r_name, NULL FROM region")
def name_resolve(spark, sf_dir):
    n = sub.table(spark, sf_dir, "nation")
    t = n.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "tbl_").otherwise(""), F.lower("n_name")).alias("table"))
    wanted = n.select(F.col("n_name").alias("name")).union(sub.table(spark, sf_dir, "region").select("r_name"))
    return merge.resolve_names(wanted, t, merge.infer_prefix(wanted, t))


@query("SELECT 'resp_' || c_custkey AS \"table\", 'resp_*' AS vertex FROM customer")
def family_bundle(spark, sf_dir):
    names = F.array(F.format_string("resp_%d", "c_custkey"), F.format_string("old_resp_%d_2024", "c_custkey"), F.lit("resp_log"))
    t = sub.table(spark, sf_dir, "customer").select(F.explode(names).alias("table")).distinct()
    return merge.families(t, spark.createDataFrame([("resp_", "")], "prefix string, suffix string"))


@query(sql(_CORE, "SELECT a, b, 'ALTER TABLE `' || child || '` DROP FOREIGN KEY `' || child || '-' || parent || '`;' AS ddl FROM bridge JOIN rel ON least(child, parent) = a AND greatest(child, parent) = b"))
def contract_ddl(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return sinks.contract_ddl(g.bridges, g.relations)


def _commits(spark, sf_dir) -> DataFrame:
    """A name-status log, newest first: a commit for each customer to its nation's file, which was moved between customers 99 and 100."""
    n = sub.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    each = sub.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    changed = each.select((-2 * F.col("c_custkey")).cast("long").alias("seq"), F.concat(F.when(F.col("c_custkey") >= 100, "M\tapp/models/").otherwise("M\tlib/"), "n_name", F.lit(".rb")).alias("line"))
    return changed.unionByName(n.select(F.lit(-199).cast("long").alias("seq"), F.format_string("R100\tlib/%1$s.rb\tapp/models/%1$s.rb", "n_name").alias("line")))


@query("SELECT 'app/models/' || n_name || '.rb' AS path, count(c_custkey) + 1 AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def churn_alias(spark, sf_dir):
    return files.churn(_commits(spark, sf_dir))


@query("SELECT lower(n_name) AS \"table\", count(c_custkey) + 1 AS churn, CAST(1 AS BIGINT) AS files FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT lower(r_name), 0, 1 FROM region")
def table_churn(spark, sf_dir):
    own = lambda t, name: sub.table(spark, sf_dir, t).select(F.concat(F.when(F.col(f"{t[0]}_{t}key") % 2 == 0, "app/models/").otherwise("shop/app/models/"), name, F.lit(".rb")).alias("file"), F.lower(name).alias("table"))
    return compare.table_churn(files.churn(_commits(spark, sf_dir)), own("nation", "n_name").union(own("region", "r_name")))


@query(_TX)
def txlog_parse(spark, sf_dir):
    path = f"{shared_dir(spark)}/seamline-log-{uuid.uuid4().hex}"
    line = F.format_string("2024-01-01T00:00:00Z %s Query %s", "thread", "sql")
    sub.event_log(spark, sf_dir).orderBy("seq").select(line.alias("value")).write.text(path)  # parts are named in the order of their rows
    return cooc.read_log(files.log_lines(spark, path))


def _trees(spark, sf_dir, vendor: str, nation: str, region: str, more: str, cascade: str, suffix: str, extra: dict[str, str], read) -> dict[str, DataFrame]:
    """What is found in one source tree for each region: a class for the region, for each of its nations and for each of their suppliers."""
    n = sub.table(spark, sf_dir, "nation")
    s = sub.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    tree = F.col("n_regionkey").cast("string").alias("tree")
    path = lambda name, key: F.format_string(suffix, F.lit(name), key).alias("path")
    lines = s.where("s_suppkey % 3 = 0").groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.format_string(cascade, "s_suppkey"))), "\n").alias("lines"))
    fill = lambda text, *cols: F.format_string(text, *cols).alias("text")
    src = s.select(tree, path("vendor", "s_suppkey"), fill(vendor, "s_suppkey", "n_nationkey", F.when(F.col("s_acctbal") < 0, ", optional: true").otherwise(""), F.when(F.col("s_suppkey") % 5 == 0, F.format_string(more, "n_regionkey")).otherwise("")))
    src = src.union(n.join(lines, "n_nationkey", "left").select(tree, path("nation", "n_nationkey"), fill(nation, "n_nationkey", "n_regionkey", F.coalesce("lines", F.lit("")))))
    src = src.union(n.select("n_regionkey").distinct().select(tree, path("region", "n_regionkey"), fill(region, "n_regionkey")))
    for name, text in extra.items():
        src = src.union(n.select("n_regionkey").distinct().select(tree, F.lit(name), F.lit(text)))
    src = src.select("*", rawsql.written_tables(F.col("text")).alias("writes"), rawsql.read_tables(F.col("text")).alias("reads"))
    return models.frames(models.resolve(src, read), "models")


def _rails(spark, sf_dir) -> dict[str, DataFrame]:
    return _trees(
        spark, sf_dir, "class Vendor%1$d < ApplicationRecord\n  belongs_to :nation%2$d%3$s\n%4$send", "class Nation%1$d < ApplicationRecord\n  belongs_to :region%2$d\n%3$s\nend", "class Region%d < ApplicationRecord\nend",
        "  after_save :count\n  def count = Region%d.touch_all\n", "  has_many :vendor%ds, dependent: :destroy", "app/models/%s%d.rb", {}, rails.read,
    )


def _yii(spark, sf_dir) -> dict[str, DataFrame]:
    return _trees(
        spark, sf_dir, "<?php class Vendor%1$d extends CActiveRecord {\n function tableName() { return '{{vendor%1$d}}'; }\n function relations() { return array('n' => array(self::BELONGS_TO, 'Nation%2$d', 'nationkey')); } /* %3$s */\n%4$s}",
        "<?php class Nation%1$d extends CActiveRecord {\n function tableName() { return 'nation%1$d'; }\n function relations() { return ['r' => [self::BELONGS_TO, 'Region%2$d', 'regionkey'],\n%3$s]; }\n}",
        "<?php class Region%1$d extends CActiveRecord {\n function tableName() { return 'region%1$d'; }\n}", " function afterDelete() { Region%d::model()->deleteAll(); }\n", " 'v%1$d' => [self::HAS_MANY, 'Vendor%1$d', 'nationkey'],",
        "protected/models/%s%d.php", {"protected/config/main.php": "<?php return array('tablePrefix' => 't_');"}, yii.read,
    )


def _declared(found: dict[str, DataFrame]) -> DataFrame:
    return found["relations"].select("child_table", F.array_join("child_columns", ",").alias("child_columns"), "parent_table", "delete_rule", "nullable", F.size("evidences").alias("n_evidence"))


@query("""SELECT 'vendor' || s_suppkey || 's' AS child_table, 'nation' || s_nationkey || '_id' AS child_columns, 'nation' || s_nationkey || 's' AS parent_table, CASE WHEN s_suppkey % 3 = 0 THEN 'CASCADE' ELSE 'NO ACTION' END AS delete_rule,
CASE WHEN s_acctbal < 0 THEN 'true' ELSE 'false' END AS nullable, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n_evidence FROM supplier
UNION ALL SELECT 'nation' || n_nationkey || 's', 'region' || n_regionkey || '_id', 'region' || n_regionkey || 's', 'NO ACTION', 'false', 1 FROM nation""")
def rails_relations(spark, sf_dir):
    return _declared(_rails(spark, sf_dir))


@query("SELECT 'vendor' || s_suppkey || 's' AS from_table, 'region' || n_regionkey || 's' AS to_table, true AS strong, 'mention' AS why FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0")
def rails_suspects(spark, sf_dir):
    return _rails(spark, sf_dir)["suspects"]


@query("""SELECT 't_vendor' || s_suppkey AS child_table, 'nationkey' AS child_columns, 'nation' || s_nationkey AS parent_table, 'NO ACTION' AS delete_rule, 'unknown' AS nullable, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n_evidence FROM supplier
UNION ALL SELECT 'nation' || n_nationkey, 'regionkey', 'region' || n_regionkey, 'NO ACTION', 'unknown', 1 FROM nation""")
def yii1_relations(spark, sf_dir):
    return _declared(_yii(spark, sf_dir))


@query("SELECT 't_vendor' || s_suppkey AS from_table, 'region' || n_regionkey AS to_table, true AS strong, unnest(['manual cascade', 'mention']) AS why FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0")
def yii1_suspects(spark, sf_dir):
    return _yii(spark, sf_dir)["suspects"]


# -- a graph of thousands of nodes -----------------------------------------------------------------------------------

_BOUGHT = "purchase edge whole bridge"


@query(sql("purchase edge", f"SELECT {EDGE} FROM edge"))
def purchase_edges(spark, sf_dir):
    return graph.bundle_edges(sub.purchases(spark, sf_dir)).select(E_)


@query(sql("purchase edge deg", "SELECT node, degree FROM deg"))
def purchase_degree(spark, sf_dir):
    return graph.degrees(graph.bundle_edges(sub.purchases(spark, sf_dir)))


@query(sql("purchase edge", ", link AS (SELECT a AS u, b AS v FROM edge UNION SELECT b, a FROM edge), reached(u, v) AS (SELECT u, u FROM link UNION SELECT r.u, l.v FROM reached r JOIN link l ON r.v = l.u) SELECT u AS node, min(v) AS component FROM reached GROUP BY u"))
def purchase_components(spark, sf_dir):
    return connected_components(graph.bundle_edges(sub.purchases(spark, sf_dir)), "a", "b", finish_edges=1000)


@query(sql(_BOUGHT, f"SELECT {EDGE} FROM bridge"))
def purchase_bridges(spark, sf_dir):
    return graph.bridges(stage(graph.bundle_edges(sub.purchases(spark, sf_dir)), "edges")).select(E_)


@query(sql(_BOUGHT, "SELECT node, block FROM block"))
def purchase_blocks(spark, sf_dir):
    edges = stage(graph.bundle_edges(sub.purchases(spark, sf_dir)), "edges")
    return graph.blocks(edges, graph.bridges(edges))


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b, l_quantity >= 50 AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49),
l AS (SELECT 'c' || c_custkey AS t, c_nationkey % 5 AS la, c_nationkey % 3 AS lb FROM customer UNION ALL SELECT 'p' || p_partkey, p_size % 5, p_size % 3 FROM part),
s AS (SELECT a, b, max(CASE WHEN first THEN CASE WHEN x.la = y.la THEN 'internal' ELSE 'cut' END END) AS sa, max(CASE WHEN NOT first THEN CASE WHEN x.lb = y.lb THEN 'internal' ELSE 'cut' END END) AS sb FROM e JOIN l x ON a = x.t JOIN l y ON b = y.t GROUP BY a, b)
SELECT a, b, coalesce(sa, 'absent') AS state_a, coalesce(sb, 'absent') AS state_b FROM s WHERE sa = 'cut' OR sb = 'cut'""")
def cut_edge_diff(spark, sf_dir):
    own = lambda t, mark, key, by: sub.table(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("table"), (F.col(by) % 5).alias("la"), (F.col(by) % 3).alias("lb"))
    labels = own("customer", "c", "c_custkey", "c_nationkey").union(own("part", "p", "p_partkey", "p_size"))
    one, two = (graph.bundle_edges(sub.purchases(spark, sf_dir, *q)) for q in ((50, None), (49, 50)))
    return compare.cut_edges(one, two, labels)


@query()
def hub_scan(spark, sf_dir):
    r = stage(sub.trade_relations(spark, sf_dir).drop("r", "cnt"), "relations")
    tables = r.select(F.explode(F.array("child_table", "parent_table")).alias("table")).distinct()
    return analysis.hub_scan(analysis.Dataset(tables, r), 12)
