"""Cut edges of two graphs under two labelings."""

from seamline.operators import compare


def test_cut_edges_do_not_broadcast_the_labels(spark):
    """Labels grow with the tables, so they are merged however small they look; edges at a table without a row of labels are left out, an empty label is no other's."""
    labels = spark.createDataFrame([("p", 1, 1), ("q", 1, 2), ("r", 2, 2), ("s", None, 2)], "table string, la int, lb int")
    one = spark.createDataFrame([("p", "q", 1.0), ("p", "r", 1.0), ("q", "s", 1.0), ("p", "z", 1.0)], "a string, b string, weight double")
    two = spark.createDataFrame([("p", "q", 1.0), ("q", "r", 1.0), ("r", "s", 1.0), ("q", "s", 1.0), ("p", "s", 1.0)], "a string, b string, weight double")
    out = compare.cut_edges(one, two, labels)
    assert sorted(map(tuple, out.collect())) == [("p", "q", "internal", "cut"), ("p", "r", "cut", "absent"), ("p", "s", "absent", "cut"), ("q", "s", "cut", "internal")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
