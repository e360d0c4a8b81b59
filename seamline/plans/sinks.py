"""Reports of small result tables as text, graph scripts, JSON and DDL."""

from __future__ import annotations

import html
import json
import math
import re

from pyspark.sql import DataFrame, functions as F


def contract_ddl(bridge: DataFrame, relations: DataFrame, dialect: str = "mysql") -> DataFrame:
    """(a, b, ddl): statements that drop the relations of each edge to cut; a relation that is only declared has a comment instead."""
    if dialect not in ("mysql", "postgres", "static"):
        raise ValueError("dialect must be mysql, postgres or static")
    quote, drop = ('"', "CONSTRAINT") if dialect == "postgres" else ("`", "FOREIGN KEY")
    q = lambda c: F.concat(F.lit(quote), c, F.lit(quote))
    physical = F.exists("evidences", lambda e: e["source"] == "physical") & F.lit(dialect != "static")
    ddl = F.when(physical, F.concat(F.lit("ALTER TABLE "), q(F.col("child_table")), F.lit(f" DROP {drop} "), q(F.col("constraint")), F.lit(";")))
    note = F.concat(F.lit("-- "), F.col("child_table"), F.lit(" -> "), F.col("parent_table"), F.lit(" ("), F.col("constraint"), F.lit(") is declared in code only"))
    ends = relations.withColumns({"a": F.least("child_table", "parent_table"), "b": F.greatest("child_table", "parent_table")})
    return ends.join(bridge.select("a", "b"), ["a", "b"]).select("a", "b", F.coalesce(ddl, note).alias("ddl"))


def identifier(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def _rows(df: DataFrame, *order: str) -> list:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]  # reports are of a schema's size


def mermaid(edges: DataFrame, bridge: DataFrame) -> str:
    """A graph with the bridges dotted."""
    cut = {(r["a"], r["b"]) for r in _rows(bridge, "a", "b")}
    lines = [f'  {identifier(r["a"])}["{r["a"]}"] {"-.-" if (r["a"], r["b"]) in cut else "---"} {identifier(r["b"])}["{r["b"]}"]' for r in _rows(edges, "a", "b")]
    return "\n".join(["graph LR", *lines]) + "\n"


def d2(edges: DataFrame, bridge: DataFrame, level: int = 0) -> str:
    """A D2 script; bridges (with level) at or under the cut level are left out, the others dashed."""
    cut = {(r["a"], r["b"]): r["level"] for r in _rows(bridge, "a", "b")}
    quote = lambda s: json.dumps(s, ensure_ascii=False)
    rows, out = _rows(edges, "a", "b"), []
    for name in sorted({x for r in rows for x in (r["a"], r["b"])}):
        out.append(quote(name))
    for r in rows:
        at = cut.get((r["a"], r["b"]))
        if at is None or at > level:
            out.append(f"{quote(r['a'])} -- {quote(r['b'])}" + ("" if at is None else ": {style.stroke-dash: 4}"))
    return "\n".join(out) + "\n"


def text(title: str, tables: dict[str, DataFrame], most: int = 10) -> str:
    """Sections of rows, the first most of each."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        out += ["", f"## {name}", *["  ".join(f"{k}={v}" for k, v in r.items()) for r in rows[:most]], *(["..."] if len(rows) > most else ([] if rows else ["none"]))]
    return "\n".join(out) + "\n"


def page(title: str, tables: dict[str, DataFrame]) -> str:
    """The same as one HTML page without scripts or outside references."""
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}" for v in r) for r in df.collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(out) + "\n"


def to_json(tables: dict[str, DataFrame]) -> str:
    return json.dumps({k: [r.asDict(recursive=True) for r in df.collect()] for k, df in tables.items()}, indent=2, ensure_ascii=False, sort_keys=True) + "\n"


def d2_partition(groups: DataFrame, links: DataFrame, contracts: DataFrame) -> str:
    """A D2 script with a container for each group (group, unit), the links between groups, and each group's contract per hub: accesses added, the highest level."""
    quote = lambda s: json.dumps(str(s), ensure_ascii=False)
    members = _rows(groups, "group", "unit")
    of, out = {r["unit"]: r["group"] for r in members}, []
    for g in sorted({r["group"] for r in members}):
        out += [f"{quote(g)}: {{", *[f"  {quote(r['unit'])}" for r in members if r["group"] == g], "}"]
    place = lambda u: f"{quote(of[u])}.{quote(u)}" if u in of else quote(u)
    for r in _rows(links.where("u <> v"), "u", "v"):
        if of.get(r["u"]) != of.get(r["v"]):
            out.append(f"{place(r['u'])} -- {place(r['v'])}: {r['weight']:.2f}")
    per = contracts.join(groups, "unit").groupBy("group", "hub").agg(F.sum(F.col("to_hub") + F.col("from_hub")).alias("n"), F.max("level").alias("level"))
    out += [f"{quote(r['group'])} -> {quote(r['hub'])}: {r['n']} (level {r['level']})" for r in _rows(per, "group", "hub")]
    return "\n".join(out) + "\n"


def svg(edges: DataFrame, bridge: DataFrame, level: int = 0, size: int = 900) -> str:
    """A picture of the graph on a circle, the nodes in the order of a walk from the best linked so that neighbours are near; bridges dashed, those at or under the cut level left out."""
    cut = {(r["a"], r["b"]): r["level"] for r in _rows(bridge, "a", "b")}
    drawn = [(r["a"], r["b"]) for r in _rows(edges, "a", "b") if cut.get((r["a"], r["b"]), level + 1) > level]
    near: dict[str, list[str]] = {x: [] for r in _rows(edges, "a", "b") for x in (r["a"], r["b"])}
    for a, b in drawn:
        near[a].append(b)
        near[b].append(a)
    order: dict[str, int] = {}
    for start in sorted(near, key=lambda x: (-len(near[x]), x)):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in order:
                order[x] = len(order)
                todo += sorted(near[x], reverse=True)
    mid, radius = size / 2, size * 0.38
    turn = lambda x: 2 * math.pi * order[x] / max(len(order), 1)
    at = {x: (mid + radius * math.cos(turn(x)), mid + radius * math.sin(turn(x))) for x in order}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}" font-family="sans-serif" font-size="11">']
    for a, b in drawn:
        dash = ' stroke-dasharray="5 4"' if (a, b) in cut else ""
        out.append(f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#888"{dash}/>')
    for x, (px, py) in at.items():
        side, shift = ("start", 7) if px >= mid else ("end", -7)
        out.append(f'<circle cx="{px:.1f}" cy="{py:.1f}" r="4"/><text x="{px + shift:.1f}" y="{py + 4:.1f}" text-anchor="{side}">{html.escape(x)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"
