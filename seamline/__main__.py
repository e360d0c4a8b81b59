"""The command line: one dataset, or a catalog's and a source tree's together, to one report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.model import VIEWS
from seamline.operators import compare, cooc, merge, partition, relations as rel
from seamline.plans import analysis, sinks
from seamline.sources import files, rails, yii

VERSION = "0.1.0"
#: What is written in place of a cut relation, by level; --patterns replaces some.
PATTERNS = {1: "eventual consistency: outbox and events, or a read replica", 2: "synchronous command with a pending state and idempotency key, or an existence API", 3: "as 2, and implicit couplings to be taken apart first"}
REGRESSED = 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seamline", description=__doc__)
    add = p.add_argument
    for name, text in {
        "--dsn": "catalog by JDBC address", "--schema-json": "schema dump", "--rails": "Rails source tree", "--yii1": "Yii 1 source tree", "--relations": "listed relations (TSV)", "--bundle": "bundle rules",
        "--cooc": "transaction log", "--baseline": "earlier --json output", "--churn": "folder of a git repository", "--criticality": "JSON of table to number", "--patterns": "JSON of level to text",
        "--dump-schema": "file to write the schema dump to", "--out": "file to write to instead of the output",
    }.items():
        add(name, help=text)
    add("--graph", choices=VIEWS, default="combined")
    add("--emit-contract", choices=("mysql", "postgres", "static"))
    for name, text in {"--hub": "hub threshold", "--services": "number of groups wanted", "--cut-level": "bridges up to this level are cut in pictures"}.items():
        add(name, type=int, help=text)
    form = p.add_mutually_exclusive_group()
    for name in ("--json", "--html", "--mermaid", "--d2", "--d2-partition", "--svg", "--hub-scan", "--compare-graphs"):
        form.add_argument(name, action="store_true")
    add("--cooc-weight", action=argparse.BooleanOptionalAction, default=True, help="co-occurrence counts in the partition")
    add("--show-evidence", action="store_true")
    add("--version", action="version", version=VERSION)
    return p


def check(p: argparse.ArgumentParser, o: argparse.Namespace) -> None:
    physical, logical = o.dsn or o.schema_json, o.rails or o.yii1
    if o.dsn and o.schema_json or o.rails and o.yii1:
        p.error("one catalog and one source tree at most")
    if not physical and not logical:
        p.error("a source is needed")
    if o.compare_graphs and not (physical and logical):
        p.error("--compare-graphs needs a catalog and a source tree")
    if o.churn and not logical:
        p.error("--churn needs a source tree")
    if o.dump_schema and not physical:
        p.error("--dump-schema needs a catalog")


def load(spark: SparkSession, o: argparse.Namespace) -> tuple[analysis.Dataset, DataFrame, dict[str, DataFrame]]:
    """The dataset, the scope (table, in_physical, in_logical) and the source tree's frames."""
    none = spark.createDataFrame([], "table string")
    physical = logical = None
    tree: dict[str, DataFrame] = {}
    if o.schema_json:
        dump = files.schema_json(spark, o.schema_json)
        physical = analysis.Dataset(dump["tables"], dump["relations"], dump["cross_relations"])
    elif o.dsn:
        own, cross = rel.split_schemas(rel.stamp_physical(rel.fold_keys(files.catalog_jdbc(spark, o.dsn))))
        physical = analysis.Dataset(files.catalog_tables(spark, o.dsn), own, cross)
    if o.rails or o.yii1:
        tree = rails.rails(spark, o.rails) if o.rails else yii.yii1(spark, o.yii1)
        declared = tree["relations"]
        if o.relations:
            new, unknown = merge.metadata_relations(files.relations_tsv(spark, o.relations), tree["tables"], tree["classes"])
            declared = declared.unionByName(new)
            for r in unknown.collect():  # lines of a list written by hand
                print(f"{o.relations}:{r['line_no']}: unknown table", file=sys.stderr)
        logical = analysis.Dataset(tree["tables"], rel.unite(declared), suspects=tree["suspects"].select("from_table", "to_table", "strong"))
    data = analysis.merge_datasets(physical, logical) if physical and logical else physical or logical
    if o.cooc:
        data.tx_tables = cooc.read_log(files.log_lines(spark, o.cooc))
    if o.bundle:
        rename = rel.bundle_map(data.tables, files.bundle_rules(spark, o.bundle))
        data.relations = rel.rename_tables(data.relations, rename)
        data.tables = data.tables.join(rename.select(F.col("from_table").alias("table")), "table", "left_anti")
        if data.tx_tables is not None:
            data.rename = rename
    yes = lambda d, c: (d.tables if d else none).select("table", F.lit(True).alias(c)).distinct()
    has = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    scope = data.tables.join(yes(physical, "in_physical"), "table", "left").join(yes(logical, "in_logical"), "table", "left").select("table", has("in_physical"), has("in_logical"))
    return data, scope, tree


def run(spark: SparkSession, o: argparse.Namespace) -> tuple[str, int]:
    """The report and the exit code."""
    data, scope, tree = load(spark, o)
    if o.dump_schema:
        files.dump_schema([r["table"] for r in data.tables.collect()], data.relations if data.cross is None else data.relations.unionByName(data.cross), o.dump_schema, "schema", "postgres" if "postgres" in (o.dsn or "").split("//")[0] else "mysql" if o.dsn else "")
    if o.compare_graphs:
        found = analysis.compare_views(data, scope, o.hub, o.cooc_weight)
        return sinks.text("comparison of views", found, 50), 0
    if o.graph != "combined":
        data.relations = rel.project(data.relations, o.graph)
        data.suspects, data.cross = (None if o.graph == "physical" else data.suspects), (None if o.graph == "logical" else data.cross)
    if o.hub_scan:
        return sinks.text("hub thresholds", {"scan": analysis.hub_scan(data, o.hub or max(6, data.tables.count() * 15 // 100))}, 10), 0
    a = analysis.analyze(data, o.hub, use_observed=o.cooc_weight)
    if o.emit_contract:
        return "\n".join(r["ddl"] for r in sinks.contract_ddl(a.bridges, data.relations, o.emit_contract).orderBy("a", "b", "ddl").collect()) + "\n", 0
    if o.mermaid:
        return sinks.mermaid(a.core, a.bridges), 0
    if o.d2 or o.svg:
        return (sinks.d2 if o.d2 else sinks.svg)(a.core, a.bridges, o.cut_level or 0), 0
    if o.d2_partition:
        return sinks.d2_partition(groups(spark, a, o.services), a.links, a.contracts), 0
    text = PATTERNS | ({int(k): v for k, v in json.load(open(o.patterns, encoding="utf-8")).items() if k.isdigit()} if o.patterns else {})
    pairs = F.create_map(*[F.lit(x) for kv in text.items() for x in kv])
    frames = dict(a.frames) | {"bridges": a.bridges.withColumn("pattern", F.try_element_at(pairs, F.col("level").cast("int"))), "groups_chosen": groups(spark, a, o.services)}
    if tree:
        frames["notes"] = tree["notes"]
    if o.show_evidence:
        frames["evidence"] = data.relations.select("child_table", "child_columns", "parent_table", F.to_json("evidences").alias("evidences"))
    if o.churn or o.criticality:
        churn = compare.table_churn(files.churn(files.history(spark, o.churn)), tree["files"]).select("table", "churn") if o.churn else spark.createDataFrame([], "table string, churn long")
        value = files.criticality(spark, o.criticality) if o.criticality else spark.createDataFrame([], "table string, criticality double")
        frames["candidates"] = compare.rank_candidates(a.units.select("unit", F.col("node").alias("table")), a.bridges.select(F.explode(F.array("a", "b")).alias("node")).join(a.units, "node").select("unit"), churn, value)
    code = 0
    if o.baseline:
        with open(o.baseline, encoding="utf-8") as f:
            old = json.load(f)
        before = analysis.Analysis(0, {k: spark.createDataFrame([tuple(r[c] for c in a.frames[k].columns) for r in old.get(k, [])], a.frames[k].schema) for k in ("pairs", "cross", "contracts")})
        frames["pairs_changed"], frames["hub_totals"], worse = analysis.regressed(before, a)
        code = REGRESSED if worse else 0
    if o.json:
        return sinks.to_json(frames), code
    return (sinks.page if o.html else sinks.text)("relations", frames), code


def groups(spark: SparkSession, a: analysis.Analysis, services: int | None) -> DataFrame:
    """(group, unit) of the default level, or of the one whose number of groups is nearest to services. The levels are a schema's."""
    rows = [r.asDict() for r in a.levels.collect()]
    if not rows:
        return spark.createDataFrame([], "group string, unit string")
    best = partition.select_level(rows, services) if services else next(r for r in rows if r["is_default"])
    return spark.createDataFrame([(f"group {i}", u) for i, g in enumerate(json.loads(best["groups"]), 1) for u in g], "group string, unit string")


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: a file cannot be read or is malformed, 2: wrong use, 3: worse than the baseline."""
    p = parser()
    o = p.parse_args(argv)
    check(p, o)
    spark = SparkSession.builder.appName("seamline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        report, code = run(spark, o)
        if o.out:
            with open(o.out, "w", encoding="utf-8") as f:
                f.write(report)
        else:
            print(report, end="")
    except (OSError, ValueError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 1
    return code


if __name__ == "__main__":
    sys.exit(main())
