"""Bounded samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About rows rows of df, never more, chosen by hashes: all of them where there are no more.

    One count gives the share of the key's hash values to read; of the rows there, those with the least hashes of all
    their columns are taken. Nothing but those hashes, rows of them at most, reaches the driver, and the choice is the
    same for any partitioning: rows that tie at its edge are equal. Where few keys have most of the rows, all are ranked.
    """
    n = df.count()
    if n <= rows:
        return df
    rank = F.xxhash64(*df.columns)
    edge = min(int((1 << 63) * (1.1 * rows / n * 2 - 1)), (1 << 63) - 1)
    for near in (df.where(F.xxhash64(key) <= F.lit(edge)), df):
        least = [r[0] for r in near.select(rank.alias("h")).orderBy("h").limit(rows).collect()]
        if len(least) > rows // 2:
            break
    return near.where(rank <= F.lit(least[-1])).limit(rows)
