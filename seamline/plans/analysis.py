"""A whole analysis of a dataset's relations, the sweep of hub thresholds, and the comparison of views under common conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from seamline.model import OBSERVED_NPMI, VIEWS
from seamline.operators import compare, cooc, graph, merge, partition, relations as rel
from seamline.shared import stage


@dataclass
class Dataset:
    """tables (table), relations, and what else is known: relations to other schemas, suspects, transactions (tx, table)."""

    tables: DataFrame
    relations: DataFrame
    cross: DataFrame | None = None
    suspects: DataFrame | None = None
    tx_tables: DataFrame | None = None
    #: (from_table, to_table) of bundled tables, for the counts of transactions.
    rename: DataFrame | None = None


@dataclass
class Conditions:
    """Hubs (node, degree) and cascade groups (node, representative) that several views share, so that their results can be compared."""

    hubs: DataFrame
    groups: DataFrame
    threshold: int


@dataclass
class Analysis:
    threshold: int
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def conditions(self) -> Conditions:
        return Conditions(self.hubs, self.groups, self.threshold)


def analyze(data: Dataset, hub: int | None = None, fixed: Conditions | None = None, use_observed: bool = False) -> Analysis:
    """Hubs out first, then cascades contracted, then bridges, blocks, levels, islands, contracts, co-occurrence, seams and the partition.

    hub: the threshold; None: 15 % of the nodes with an edge, 6 at least. fixed: another analysis's hubs and groups. The
    frames are written between steps, as each is read by several.
    """
    relations = stage(data.relations, "relations")
    edges = stage(graph.bundle_edges(relations), "edges")
    if fixed:
        hubs, threshold = fixed.hubs, fixed.threshold
    else:
        threshold = hub or max(6, graph.degrees(edges).count() * 15 // 100)
        hubs = stage(graph.hubs(edges, threshold), "hubs")
    kept = graph.without(edges, hubs)
    groups = fixed.groups if fixed else stage(graph.cascade_groups(kept), "groups")
    core = stage(graph.contract(kept, groups), "core")
    bridge = stage(graph.bridges(core), "bridges")
    blocks = stage(graph.blocks(core, bridge), "blocks")
    alone = stage(_isolated(data, relations, groups), "isolated")
    rep = data.tables.join(hubs.select(F.col("node").alias("table")), "table", "left_anti").join(groups, F.col("table") == groups["node"], "left").select(F.col("table").alias("node"), F.coalesce("representative", "table").alias("rep"))
    units = stage(rep.join(alone.select(F.col("table").alias("node")), "node", "left_anti").join(blocks.select(F.col("node").alias("rep"), "block"), "rep", "left").select("node", F.coalesce("block", "rep").alias("unit")), "units")
    sizes = groups.groupBy(F.col("representative").alias("node")).agg(F.count(F.lit(1)).alias("tables"))
    contracts = stage(graph.hub_contracts(relations, hubs, units), "contracts")
    none = core.select("a", "b").limit(0)
    raised, pairs, report, observed = none, None, None, None
    strong = None
    if data.suspects is not None:
        strong = data.suspects.where("strong").select("from_table", "to_table")
        ends = strong.select(F.least("from_table", "to_table").alias("a"), F.greatest("from_table", "to_table").alias("b"))
        raised = raised.unionByName(_folded(ends, groups))
    if data.tx_tables is not None:
        pairs = stage(cooc.contract_pairs(cooc.pairs(data.tx_tables, data.rename), groups), "pairs")
        raised = raised.unionByName(pairs.select("a", "b"))
        report = cooc.report(pairs, core, bridge, threshold)
        observed = report.where(~F.col("has_fk") & ~F.col("suppressed") & (F.col("npmi") >= OBSERVED_NPMI)) if use_observed else None
    leveled = graph.cut_levels(bridge, raised)
    typed = stage(partition.typed_links(bridge, units, contracts, hubs, strong, observed), "typed-links")
    links = stage(typed.groupBy("u", "v").agg(F.sum("weight").alias("weight")), "links")
    nodes = units.groupBy(F.col("unit").alias("node")).agg(F.count(F.lit(1)).alias("size")).withColumn("is_hub", F.lit(False)).unionByName(hubs.select("node", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_hub")))
    view = F.lit("all").alias("view")
    levels = stage(partition.levels(links.select(view, "*"), nodes.select(view, "*")).drop("key"), "levels")
    near = graph.near_hubs(edges, threshold)
    frames = {
        "edges": edges, "hubs": hubs, "groups": groups, "core": core, "bridges": graph.bridge_report(leveled, blocks, sizes), "blocks": blocks, "isolated": alone, "units": units, "contracts": contracts,
        "islands": graph.islands(data.tables, blocks, alone, hubs, groups), "seams": graph.thin_seams(core, bridge), "near_hubs": near, "links": links, "levels": levels,
        "pairs": relations.where("child_table <> parent_table").select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent")).distinct(), "cross": _cross(data),
        "glue": compare.glue(_groups(levels), typed), "warnings": _warnings(graph.degrees(edges), groups, units, levels, near, threshold),
    }
    return Analysis(threshold, frames | ({"cooc": report} if report is not None else {}))


def _isolated(data: Dataset, relations: DataFrame, groups: DataFrame) -> DataFrame:
    """Tables in no relation; a group given from outside is one vertex, present if any member is."""
    alone = graph.isolated(data.tables, relations, data.cross)
    inside = groups.select(F.col("node").alias("table"), "representative")
    present = inside.join(alone, "table", "left_anti").select("representative").distinct()
    return alone.join(inside.join(present, "representative").select("table"), "table", "left_anti")


def _cross(data: Dataset) -> DataFrame:
    """(child, parent): tables and what they refer to in other schemas, as schema.table."""
    if data.cross is None:
        return data.tables.select(F.col("table").alias("child"), F.col("table").alias("parent")).limit(0)
    return data.cross.select(F.col("child_table").alias("child"), F.concat_ws(".", "parent_schema", "parent_table").alias("parent")).distinct()


def _groups(levels: DataFrame) -> DataFrame:
    """(group, unit) of the default level."""
    return levels.where("is_default").select(F.posexplode(F.from_json("groups", "array<array<string>>")).alias("group", "g")).select((F.col("group") + 1).alias("group"), F.explode("g").alias("unit"))


def _warnings(degrees: DataFrame, groups: DataFrame, units: DataFrame, levels: DataFrame, near: DataFrame, threshold: int) -> DataFrame:
    """(kind, subject, n, of): cascade groups of over a quarter of the tables with an edge, whose cascades may be a hub's cleaning rather than parts of one whole; and, where the largest group has over half of the tables, the nodes just under the hub threshold that may hold it together."""
    all_ = degrees.agg(F.count(F.lit(1)).alias("of"))
    large = groups.groupBy(F.col("representative").alias("subject")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(all_)).where("n * 4 > of").select(F.lit("cascade_bloat").alias("kind"), "subject", "n", "of")
    sized = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).join(_groups(levels), "unit").groupBy("group").agg(F.sum("n").alias("n"))
    most = sized.agg(F.max("n").alias("largest"), F.sum("n").alias("all")).where("largest * 2 > all").select(F.lit(True).alias("glued"))
    close = near.crossJoin(F.broadcast(most)).select(F.lit("near_hub").alias("kind"), F.col("node").alias("subject"), F.col("degree").alias("n"), F.lit(threshold).cast("long").alias("of"))
    return large.unionByName(close)


def _folded(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    out = pairs
    for end in ("a", "b"):
        at = groups.select(F.col("node").alias(f"__{end}"), F.col("representative").alias("__rep"))
        out = out.join(at, F.col(end) == F.col(f"__{end}"), "left").withColumn(end, F.coalesce("__rep", end)).drop(f"__{end}", "__rep")
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_scan(data: Dataset, start: int) -> DataFrame:
    """(threshold, hubs, best_q, best_k, largest, tables) for thresholds halved from start; each is one analysis of a schema."""
    out = None
    for t in graph.hub_scan_thresholds(start):
        a = analyze(data, hub=t)
        best = a.levels.where("is_default").select(F.col("q").alias("best_q"), F.col("k").alias("best_k"), F.explode(F.from_json("groups", "array<array<string>>")).alias("g"))
        size = a.units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
        each = best.select("best_q", "best_k", "g", F.explode("g").alias("unit")).join(size, "unit", "left").groupBy("best_q", "best_k", "g").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        row = each.groupBy("best_q", "best_k").agg(F.max("n").alias("largest"), F.sum("n").alias("tables")).select(F.lit(t).alias("threshold"), F.lit(a.hubs.count()).alias("hubs"), "best_q", "best_k", "largest", "tables")
        out = row if out is None else out.unionByName(row)
    return out


def communities(a: Analysis) -> DataFrame:
    """(table, community) of the default level: each table of its units, and hubs of their own groups."""
    g = a.levels.where("is_default").select(F.posexplode(F.from_json("groups", "array<array<string>>")).alias("community", "g")).select("community", F.explode("g").alias("unit"))
    return a.units.join(g, "unit").select(F.col("node").alias("table"), F.concat(F.lit("g"), F.col("community")).alias("community"))


def compare_views(data: Dataset, scope: DataFrame, hub: int | None = None, use_observed: bool = False) -> dict[str, DataFrame]:
    """The three views under the combined view's hubs, threshold and groups: edge classes, coverage, coverage by the combined communities, and of each two views the agreement of their communities, the tables that move and the edges that one of them cuts.

    Suspects count in all views but the physical one, transactions in all; use_observed weighs by observed pairs. Tables
    without a community on one side are singletons there; ari_connected leaves them out.
    """
    common = analyze(data, hub, use_observed=use_observed)
    views = {v: analyze(Dataset(data.tables, rel.project(data.relations, v), data.cross if v != "logical" else None, data.suspects if v != "physical" else None, data.tx_tables, data.rename), fixed=common.conditions, use_observed=use_observed) for v in VIEWS}
    of = {v: stage(communities(a), "communities") for v, a in views.items()}
    observed = cooc.observed(cooc.pairs(data.tx_tables, data.rename)) if data.tx_tables is not None else common.core.select("a", "b", F.lit(0).alias("count"), F.lit(0.0).alias("npmi")).limit(0)
    diff = compare.diff_edges(data.relations, scope, observed, common.hubs, data.tx_tables is not None)
    vertices = data.tables.join(common.hubs.select(F.col("node").alias("table")), "table", "left_anti")
    agree = moved = cut = None
    seen = {"physical": F.col("in_physical"), "logical": F.col("in_logical"), "combined": F.col("in_physical") | F.col("in_logical")}
    for x, y in (("physical", "logical"), ("physical", "combined"), ("logical", "combined")):
        both = vertices.join(of[x].withColumnRenamed("community", "x"), "table", "left").join(of[y].withColumnRenamed("community", "y"), "table", "left")
        own = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\0"), F.col("table")))
        whole = compare.adjusted_rand(both.select(own("x").alias("x"), own("y").alias("y")), "x", "y")
        near = compare.adjusted_rand(both.where("x IS NOT NULL AND y IS NOT NULL"), "x", "y").select(F.col("n").alias("n_connected"), F.col("ari").alias("ari_connected"))
        row = whole.crossJoin(near).select(F.lit(x).alias("view_a"), F.lit(y).alias("view_b"), "n", "ari", "n_connected", "ari_connected")
        agree = row if agree is None else agree.unionByName(row)
        sides = both.join(scope.select("table", seen[x].alias("seen_a"), seen[y].alias("seen_b")), "table", "left")
        named = lambda df: df.select(F.lit(x).alias("view_a"), F.lit(y).alias("view_b"), "*")  # noqa: E731, B023
        move = named(compare.moves(sides, compare.match_communities(both, "x", "y"), "table", "x", "y"))
        edge = named(compare.cut_edges(views[x].core, views[y].core, both.select("table", F.col("x").alias("la"), F.col("y").alias("lb"))))
        moved, cut = (move, edge) if moved is None else (moved.unionByName(move), cut.unionByName(edge))
    groups = of["combined"].select(F.col("community").alias("group"), "table")
    return {"edge_diff": diff, "edge_classes": compare.class_counts(diff), "coverage": compare.coverage(data.relations, scope), "group_coverage": compare.group_coverage(groups, data.relations, scope), "agreement": agree, "moves": moved, "cut_edges": cut}


def regressed(before: Analysis, now: Analysis) -> tuple[DataFrame, DataFrame, bool]:
    """Pairs of child and parent added and removed, those to other schemas too; hub totals changed; and whether any pair was added or any total rose."""
    pairs = compare.baseline_diff(*[a.pairs.unionByName(a.cross) for a in (before, now)])
    totals = compare.baseline_hub_delta(compare.hub_totals(before.contracts), compare.hub_totals(now.contracts))
    return pairs, totals, not pairs.where("change = 'added'").isEmpty() or not totals.where("regressed").isEmpty()


def merge_datasets(physical: Dataset, logical: Dataset) -> Dataset:
    """A catalog's dataset and a declared one as one: declared names become catalog names (exact, by case, by the prefix that most need), families become one vertex, and relations are merged by key."""
    names = logical.tables.select(F.col("table").alias("name")).distinct()
    prefix = merge.infer_prefix(names, physical.tables)
    vertex = stage(merge.family_vertices(physical.tables, logical.tables, prefix), "families")
    found = stage(merge.resolve_names(names, physical.tables, prefix).where("table IS NOT NULL"), "names")
    renamed = lambda t, by: t.join(by.select(F.col("name").alias("__n"), F.col("table").alias("__t")), F.col("table") == F.col("__n"), "left").select(F.coalesce("__t", "table").alias("table"))
    own = merge.rename_ends(physical.relations, vertex)
    suspects = logical.suspects
    if suspects is not None:
        for c in ("from_table", "to_table"):
            suspects = suspects.join(found.select(F.col("name").alias("__n"), F.col("table").alias("__t")), F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__t", c)).drop("__n", "__t")
    return Dataset(
        renamed(physical.tables, vertex).union(renamed(logical.tables, found)).distinct(),
        merge.merge_relations(own, merge.rename_ends(logical.relations, found)), physical.cross, suspects, logical.tx_tables if physical.tx_tables is None else physical.tx_tables, physical.rename,
    )
