from seamline.plans import analysis
from tests.test_analysis import tables
from tests.test_operators import relation, table


def test_views_keep_suspects_and_transactions(spark, monkeypatch):
    seen, whole = [], analysis.analyze

    def spy(data, *args, **more):
        seen.append((data.suspects is not None, data.tx_tables is not None, more.get("use_observed")))
        return whole(data, *args, **more)

    monkeypatch.setattr(analysis, "analyze", spy)
    suspects = spark.createDataFrame([("c", "d", True)], "from_table string, to_table string, strong boolean")
    tx = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "c")], "tx string, table string")
    scope = spark.createDataFrame([(t, True, True) for t in "abcd"], "table string, in_physical boolean, in_logical boolean")
    data = analysis.Dataset(tables(spark, "a b c d"), table(spark, relation("a", "b"), relation("c", "a", source="code")), suspects=suspects, tx_tables=tx)
    analysis.compare_views(data, scope, use_observed=True)
    by_view = dict(zip(analysis.VIEWS, seen[1:], strict=True))
    assert by_view == {v: (v != "physical", True, True) for v in analysis.VIEWS}
