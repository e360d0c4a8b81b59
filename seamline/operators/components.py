"""Connected components of an edge table, by hooking to neighbours of random priority and contracting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seamline.shared import stage

#: Edges that one task finishes alone: a few megabytes. A contracted graph of no more has its rounds saved.
FINISH_EDGES = 20_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node of its component.

    Each round draws a priority for every node (a hash of node and round), hooks every node to its neighbour of the
    least priority if that is below its own, doubles the hooks once, and replaces the edges by those between different
    ends. Whatever the order of the names, at least half of the nodes with an edge are expected to hook, so the graph
    falls geometrically and rounds grow with the logarithm of its nodes, for chains, stars and dense graphs alike. Once no
    more than finish_edges are left, one task unites their ends, in Python; with finish_edges 0 the rounds go on until no
    edge is left, in DataFrame functions alone. Then the rounds are read backwards, from the smallest,
    so each node is joined once.

    Every exchange is a partial aggregate or a join that AQE can split, so a node with most of the edges does not end in
    one task; a round's tables are written to the shared folder. Nulls, self loops and repeated edges have no effect; no
    edges give no rows.
    """
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    live = stage(ends.select(*pair("u", "v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while live.count() > finish_edges:
        chance = lambda c, n=len(rounds): F.xxhash64(F.lit(n), c)
        both = live.union(live.select("v", "u"))
        best = both.groupBy("u").agg(F.min(chance(F.col("v"))).alias("chance"), F.min_by("v", chance(F.col("v"))).alias("v"))
        hook = stage(best.select(F.col("u").alias("node"), F.when(F.col("chance") < chance(F.col("u")), F.col("v")).otherwise(F.col("u")).alias("up")), "hook")
        top = hook.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        jump = stage(hook.join(top, hook["up"] == top["mid"]).select("node", F.col("top").alias("up")), "jump")
        rounds.append(jump)
        ju, jv = jump.select(F.col("node").alias("u"), F.col("up").alias("pu")), jump.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        live = stage(live.join(ju, "u").join(jv, "v").where("pu <> pv").select(*pair("pu", "pv")).distinct(), "edges")
    labels = _united(live) if finish_edges else live.select(F.col("u").alias("node"), F.col("u").alias("root"))
    for jump in reversed(rounds):
        of = labels.select(F.col("node").alias("mid"), "root")
        labels = stage(jump.join(of, jump["up"] == of["mid"], "left").select("node", F.coalesce("root", "up").alias("root")), "labels")
    if not rounds:
        return labels.select("node", F.col("root").alias("component"))
    least = stage(labels.groupBy("root").agg(F.min("node").alias("component")), "least-nodes")  # written, so that the join can split a large component
    return labels.join(least, "root").select("node", "component")


def _united(edges: DataFrame) -> DataFrame:
    """(node, root) of the ends of a bounded number of edges (u, v), in one task; a root is the least node reached."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x, to_arrow_type(kind)) for x in (list(up), [root(x) for x in up])], names=["node", "root"])

    return stage(edges.coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, root {kind.simpleString()}"), "labels")
