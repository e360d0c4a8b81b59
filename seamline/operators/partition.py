"""The partition of units: its weighted graph, modularity and the ladder of communities."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

EPS, SMALL = 1e-9, 3


def partition_graph(bridge: DataFrame, units: DataFrame, contracts: DataFrame, hubs: DataFrame, suspects: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """(u, v, weight): links between units and hubs.

    bridge: (a, b, weight); units: (node, unit); contracts: (unit, hub, to_hub, from_hub); hubs: (node, degree).
    suspects: strong ones (from_table, to_table), 1 once for each unit pair. observed: (a, b, npmi) without a relation,
    2 npmi each. A hub contract weighs 3 (to + from) / degree. Ends without a unit are skipped.
    """
    return typed_links(bridge, units, contracts, hubs, suspects, observed).groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def typed_links(bridge: DataFrame, units: DataFrame, contracts: DataFrame, hubs: DataFrame, suspects: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """(u, v, weight, kind) of what partition_graph() adds up: kind is relation, suspect, observed or hub_contract."""
    def ends(df, a, b, w):
        x, y = units.select(F.col("node").alias("__x"), F.col("unit").alias("u")), units.select(F.col("node").alias("__y"), F.col("unit").alias("v"))
        return df.select(F.col(a).alias("__a"), F.col(b).alias("__b"), w.alias("weight")).join(x, F.col("__a") == F.col("__x")).join(y, F.col("__b") == F.col("__y")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")

    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    out = kind(ends(bridge, "a", "b", F.col("weight")), "relation")
    if suspects is not None:
        out = out.unionByName(kind(ends(suspects, "from_table", "to_table", F.lit(1.0)).distinct(), "suspect"))
    if observed is not None:
        out = out.unionByName(kind(ends(observed, "a", "b", 2 * F.col("npmi")), "observed"))
    hub = contracts.join(hubs.select(F.col("node").alias("hub"), "degree"), "hub").select(F.least("unit", "hub").alias("u"), F.greatest("unit", "hub").alias("v"), (3.0 * (F.col("to_hub") + F.col("from_hub")) / F.col("degree")).alias("weight"))
    return out.unionByName(kind(hub, "hub_contract"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, q: over edges (u, v, weight) and labels (node, community); 0 without edges."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c{end}"))
    e = edges.join(at("u"), "u").join(at("v"), "v")
    inside = e.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("weight").alias("w_in"))
    total = e.select(F.explode(F.array("cu", "cv")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("tot"))
    m = edges.agg(F.sum("weight").alias("m"))
    by = total.join(inside, "c", "left").crossJoin(F.broadcast(m))
    return by.agg(F.coalesce(F.sum(F.coalesce("w_in", F.lit(0.0)) / F.col("m") - F.pow(F.col("tot") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))


def betweenness(nodes: list[str], near: dict[str, dict[str, float]]) -> dict[tuple[str, str], float]:
    """Shortest-path betweenness of the edges between nodes, each ordered source counted; an edge is 1 / weight long."""
    out: dict[tuple[str, str], float] = defaultdict(float)
    for s in nodes:
        dist, ways, before, order, heap, done = {s: 0.0}, {s: 1.0}, defaultdict(list), [], [(0.0, s)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            order.append(x)
            for y, w in sorted(near[x].items()):
                new = d + 1 / w
                old = dist.get(y)
                if old is None or new < old - 1e-12:
                    dist[y], ways[y], before[y] = new, ways[x], [x]
                    heapq.heappush(heap, (new, y))
                elif abs(new - old) <= 1e-12 and y not in done:
                    ways[y] += ways[x]
                    before[y].append(x)
        flow: dict[str, float] = defaultdict(float)
        for y in reversed(order):
            for x in before[y]:
                c = ways[x] / ways[y] * (1 + flow[y])
                out[min(x, y), max(x, y)] += c
                flow[x] += c
    return out


def components(nodes, near) -> list[list[str]]:
    out, seen = [], set()
    for n in sorted(nodes):
        if n not in seen:
            seen.add(n)
            part, todo = [], [n]
            while todo:
                x = todo.pop()
                part.append(x)
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            out.append(sorted(part))
    return out


def quality(edges: dict[tuple[str, str], float], parts: list[list[str]]) -> float:
    m = sum(w for _, w in sorted(edges.items()))
    if not m:
        return 0.0
    of = {n: k for k, p in enumerate(parts) for n in p}
    inside, total = [0.0] * len(parts), [0.0] * len(parts)
    for (u, v), w in sorted(edges.items()):
        total[of[u]] += w
        total[of[v]] += w
        if of[u] == of[v]:
            inside[of[u]] += w
    return sum(i / m - (t / (2 * m)) ** 2 for i, t in zip(inside, total, strict=True))


def absorb(parts: list[list[str]], edges: dict, size: dict[str, int], hubs: set[str]) -> list[list[str]]:
    """Communities of under three tables join the one they weigh most to, of near ties the one with more tables, without any the largest; smallest first. Those of hubs alone are left."""
    parts = [list(p) for p in parts]
    while True:
        count = {k: sum(size[n] for n in p if n not in hubs) for k, p in enumerate(parts) if any(n not in hubs for n in p)}
        small = sorted((t, k) for k, t in count.items() if t < SMALL)
        if not small or len(parts) < 2:
            return parts
        _, k = small[0]
        of = {n: i for i, p in enumerate(parts) for n in p}
        gain: dict[int, float] = defaultdict(float)
        for (u, v), w in sorted(edges.items()):
            if (of[u] == k) != (of[v] == k):
                gain[of[v] if of[u] == k else of[u]] += w
        best = None
        for i in sorted(gain):
            if best is None or gain[i] > gain[best] + EPS or abs(gain[i] - gain[best]) <= EPS and count.get(i, 0) > count.get(best, 0):
                best = i
        if best is None:
            rest = [i for i in sorted(count) if i != k]
            if not rest:
                return parts
            best = max(rest, key=lambda i: (count[i], -i))
        parts[best] = sorted(parts[best] + parts[k])
        del parts[k]


def ladder(nodes: list[str], edges: dict[tuple[str, str], float], size: dict[str, int], hubs: set[str]) -> list[dict]:
    """Levels by number of groups: for each K the best modularity among the snapshots of Girvan-Newman, small groups absorbed.

    The edge of most betweenness goes, near ties the first by name; only the components it was in are counted anew.
    """
    near: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for (u, v), w in edges.items():
        near[u][v] = near[v][u] = w
    parts, left = components(nodes, near), dict(edges)
    shots, between = [parts], betweenness(nodes, near)
    while left:
        best, most = None, float("-inf")
        for e in sorted(left):
            if between.get(e, 0.0) > most + EPS:
                best, most = e, between.get(e, 0.0)
        u, v = best
        del left[best], near[u][v], near[v][u]
        new = components(nodes, near)
        if len(new) > len(parts):
            shots.append(new)
        parts = new
        touched = sorted({n for p in parts if u in p or v in p for n in p})
        inside = set(touched)
        for e in [e for e in between if e[0] in inside and e[1] in inside or e == best]:
            del between[e]
        between.update(betweenness(touched, near))
    levels: dict[int, dict] = {}
    seen = set()
    for shot in shots:
        groups = sorted(tuple(sorted(p)) for p in absorb(shot, edges, size, hubs))
        if tuple(groups) in seen:
            continue
        seen.add(tuple(groups))
        q = quality(edges, [list(g) for g in groups])
        k = sum(any(n not in hubs for n in g) for g in groups)
        if k not in levels or q > levels[k]["q"] + EPS:
            levels[k] = {"k": k, "q": q, "groups": groups}
    return [levels[k] for k in sorted(levels)]


def default_level(levels: list[dict]) -> dict:
    """The level of most modularity, of near ties the one with more groups."""
    best = levels[0]
    for x in levels[1:]:
        if x["q"] >= best["q"] - EPS:
            best = x if x["q"] > best["q"] + EPS or x["k"] > best["k"] else best
    return best


def select_level(levels: list[dict], n: int) -> dict:
    """The level whose K is nearest to n; then the better modularity, then the smaller K."""
    return min(levels, key=lambda x: (abs(x["k"] - n), -round(x["q"] / EPS), x["k"]))


def levels(edges: DataFrame, nodes: DataFrame, by: str = "view") -> DataFrame:
    """(by, k, q, is_default, groups) of each graph: edges (by, u, v, weight), nodes (by, node, size, is_hub); groups is JSON, sorted.

    A graph is one schema's units, a few thousand at most; graphs (views, thresholds) are dealt to tasks by key.
    """
    def run(key, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        size, hubs = dict(zip(n["node"], n["size"].astype(int), strict=True)), set(n["node"][n["is_hub"]])
        found = ladder(sorted(size), {(u, v): float(w) for u, v, w in zip(e["u"], e["v"], e["weight"], strict=True)}, size, hubs) if size else []
        best = default_level(found) if found else None
        return pd.DataFrame([(str(key[0]), x["k"], x["q"], x is best, json.dumps(x["groups"])) for x in found], columns=["key", "k", "q", "is_default", "groups"])

    return edges.groupBy(by).cogroup(nodes.groupBy(by)).applyInPandas(run, "key string, k long, q double, is_default boolean, groups string")
