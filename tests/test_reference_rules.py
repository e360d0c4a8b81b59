"""Rules of logs, bundles, presences, churn, warnings, glue and baselines on cases where they differ from near guesses."""

from pyspark.sql import functions as F

from seamline.operators import compare, cooc
from seamline.plans import analysis
from seamline.sources import files
from tests.test_analysis import tables
from tests.test_operators import pairs, relation, table


def log(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "seq long, line string")


def test_other_commands_leave_a_transaction_open(spark):
    lines = ["t 7 Query BEGIN", "t 7 Query INSERT INTO a$b VALUES (1)", "t 7 Close stmt ", "t 7 Statistics ", "t 7 Ping ", "t 7 Query UPDATE `s`.`c` SET x = 1", "t 7 Query UPDATE 'd' SET x = 1", "t 7 Query COMMIT"]
    lines += ["t 8 Query BEGIN", "t 8 Query DELETE FROM gone", "t 8 Init DB shop", "t 8 Query COMMIT"]
    assert pairs(cooc.read_log(log(spark, *lines)), "tx", "table") == [("7:1", "a$b"), ("7:1", "c")]


def test_logs_are_read_in_splits(spark, tmp_path):
    for part in range(3):
        rows = [f"t {k % 5} Query {s}" for k in range(part * 40, part * 40 + 40) for s in ("BEGIN", f"INSERT INTO x{k} VALUES (1)", f"INSERT INTO y{k} VALUES (1)", "COMMIT")]
        (tmp_path / f"part-{part}").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = cooc.pairs(cooc.read_log(files.log_lines(spark, str(tmp_path))))
        assert pairs(got, "a", "b", "count", "total") == sorted((f"x{k}", f"y{k}", 1, 120) for k in range(120))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_renamed_counts_are_added(spark):
    tx = [(str(i), t) for i, ts in enumerate([("c", "o"), ("c", "o"), ("c", "o_v"), ("c", "o_v"), ("c", "o_v"), ("o", "o_v"), ("c", "o", "o_v")]) for t in ts]
    rename = spark.createDataFrame([("o_v", "o")], "from_table string, to_table string")
    got = cooc.pairs(spark.createDataFrame(tx, "tx string, table string"), rename).collect()
    assert [(r["a"], r["b"], r["count"], r["n_a"], r["n_b"], r["total"]) for r in got] == [("c", "o", 7, 6, 9, 7)]


def test_a_pair_that_a_log_lacks_is_absent(spark):
    scope = spark.createDataFrame([("a", True, True), ("b", True, True)], "table string, in_physical boolean, in_logical boolean")
    none = spark.createDataFrame([], "a string, b string, count long, npmi double")
    hubs = spark.createDataFrame([], "node string")
    for read, want in ((True, "absent"), (False, "unobserved")):
        assert compare.diff_edges(table(spark, relation("a", "b")), scope, none, hubs, read).first()["observed"] == want


def test_churn_of_files_below_the_repository(spark):
    churn = spark.createDataFrame([("app/customer.rb", 2), ("customer.rb", 1), ("x/app/customer.rb", 4), ("orders.rb", 5)], "path string, n long")
    of = spark.createDataFrame([("app/customer.rb", "customer"), ("app/none.rb", "none"), ("app/myorders.rb", "orders")], "file string, table string")
    assert pairs(compare.table_churn(churn, of), "table", "churn", "files") == [("customer", 3, 1), ("none", 0, 1), ("orders", 0, 1)]


def test_warnings_of_bloat_and_near_hubs(spark):
    names = "big " + " ".join(f"t{i}" for i in range(8))
    star = [relation(f"t{i}", "big", "big_id") for i in range(8)]
    a = analysis.analyze(analysis.Dataset(tables(spark, names), table(spark, *star)), hub=9)
    assert pairs(a.warnings, "kind", "subject", "n", "of") == [("near_hub", "big", 8, 9)]
    a = analysis.analyze(analysis.Dataset(tables(spark, "a b c d"), table(spark, relation("a", "b", rule="CASCADE"), relation("c", "d"))))
    assert ("cascade_bloat", "a", 2, 4) in pairs(a.warnings, "kind", "subject", "n", "of")


def test_glue_tells_what_holds_a_group(spark):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e")], "group int, unit string")
    links = spark.createDataFrame([("a", "b", "relation"), ("a", "b", "observed"), ("c", "d", "observed"), ("b", "c", "relation")], "u string, v string, kind string")
    assert pairs(compare.glue(groups, links), "group", "kind", "n", "cooc_only") == [(1, "observed", 1, False), (1, "relation", 1, False), (2, "observed", 1, True)]


def test_a_new_relation_to_another_schema_is_a_regression(spark):
    r = table(spark, relation("a", "b"))
    far = table(spark, relation("a", "x")).withColumn("parent_schema", F.lit("other"))
    before, now = (analysis.analyze(analysis.Dataset(tables(spark, "a b"), r, cross)) for cross in (None, far))
    found, _, worse = analysis.regressed(before, now)
    assert worse and pairs(found, "child", "parent", "change") == [("a", "other.x", "added")]
    assert not analysis.regressed(now, before)[2]


def test_moves_and_cut_edges_are_part_of_the_comparison(spark):
    r = table(spark, relation("a", "b"), relation("b", "c", source="code"), relation("c", "d"))
    scope = spark.createDataFrame([(t, True, True) for t in "abcd"], "table string, in_physical boolean, in_logical boolean")
    out = analysis.compare_views(analysis.Dataset(tables(spark, "a b c d"), r), scope)
    moved = {(x["view_a"], x["view_b"], x["table"], x["kind"]) for x in out["moves"].collect()}
    assert ("physical", "logical", "a", "isolated_in_b") in moved and ("physical", "logical", "d", "isolated_in_b") in moved
    assert set(out["cut_edges"].columns) == {"view_a", "view_b", "a", "b", "state_a", "state_b"}
