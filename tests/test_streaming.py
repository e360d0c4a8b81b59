"""The stream of transactions against the batch form."""

from __future__ import annotations

from seamline.operators import cooc
from seamline.streaming import txlog

LOG = ["7 Query BEGIN", "7 Query INSERT INTO a VALUES (1)", "9 Query BEGIN", "9 Query UPDATE x SET y = 1", "7 Execute DELETE FROM s.b", "7 Query COMMIT", "9 Quit ", "9 Query COMMIT", "7 Query UPDATE lone SET x = 1", "7 Query BEGIN", "7 Query UPDATE c SET x = 1", "7 Query commit"]


def test_transactions_over_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01T00:00:00Z {line}") for i, line in enumerate(LOG)]
    for k, at in enumerate((0, 4, 8)):  # a file is a batch; a transaction goes on over two
        spark.createDataFrame(rows[at : at + 4], "seq long, line string").coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("seq long, line string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = txlog.transactions(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("tx", "table").collect()}
    want = {tuple(r) for r in cooc.sessionise(cooc.statements(spark.createDataFrame(rows, "seq long, line string"))).collect()}
    by_tx = lambda found: sorted(sorted(t for x, t in found if x == tx) for tx in {x for x, _ in found})
    assert by_tx(got) == by_tx(want) == [["a", "b"], ["c"]]
