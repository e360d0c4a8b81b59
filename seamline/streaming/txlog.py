"""Transactions of a server's statement log as it is written."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from seamline.operators.cooc import statements, write_target


def transactions(log: DataFrame) -> DataFrame:
    """(tx, table) of committed transactions of a stream of lines (seq, line), by the rules of cooc.sessionise.

    The state of a thread is whether a transaction is open, its number and the tables it has written: of the size of one
    transaction. It is kept until the thread's next line, so a batch may end within a transaction. A thread's lines must
    come in the order of seq over the batches; within one they are sorted. Rows are emitted when the transaction commits.
    """
    import pandas as pd

    s = F.upper(F.trim("sql"))
    kind = F.when(F.col("sql").isNull(), "drop").when(s.rlike(r"^(BEGIN|START\s+TRANSACTION)\b"), "begin").when(s.rlike(r"^COMMIT\b"), "commit").when(s.rlike(r"^ROLLBACK\b"), "drop").otherwise("other")
    marked = statements(log).select("thread", "seq", kind.alias("kind"), write_target(F.col("sql")).alias("table"))

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, is_open, tables = state.get if state.exists else (0, False, [])
        tables, done = set(tables), []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if row.kind != "other":
                if row.kind == "commit" and is_open:
                    done += [(f"{key[0]}:{turn}", t) for t in sorted(tables)]
                turn, is_open, tables = turn + 1, row.kind == "begin", set()
            elif is_open and isinstance(row.table, str):
                tables.add(row.table)
        state.update((turn, is_open, sorted(tables)))
        yield pd.DataFrame(done, columns=["tx", "table"])

    return marked.groupBy("thread").applyInPandasWithState(
        lambda key, parts, state: fold(key, parts, state), "tx string, table string", "turn long, is_open boolean, tables array<string>", "append", "NoTimeout"
    )
