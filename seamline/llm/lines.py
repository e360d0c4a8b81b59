"""Line dedup by site-relative frequency."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.shared import stage

#: Boilerplate lines up to this many are sent to every task (about 50 bytes each); beyond it they are joined.
BROADCAST_LINES = 200_000
#: Part of a host's pages over which a line is boilerplate. Line frequencies fall without a gap (13 %, 4.8 %, 4.4 %, ...); below a
#: hundredth, on hosts of 500 pages and more, come lines that repeat by being quoted, not by standing in a page's frame.
RATIO = 0.01


def _digest(line):
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 3) -> DataFrame:
    """(host, line): MD5 of each line that over ratio of a host's pages, and min_pages at least, contain.

    A page is a distinct text of its host: copies count once, so that a page copied often is not emptied as boilerplate
    (dropping copies is the work of other operators). A line counts once a page, without its leading and trailing spaces;
    blank lines are no lines. A null host is the host ''; a null text is no page. Counts cover all pages. Copies are
    joined by host, page and line before lines are counted, and both are summed map-side, so a frequent line or host is a
    few rows per task.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    pages = docs.where(F.col(text_col).isNotNull()).select(host, F.unhex(F.md5(text_col)).alias("page"), F.col(text_col).alias("text"))
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    seen = pages.select("host", "page", F.explode(F.array_distinct(F.transform(lines, _digest))).alias("line")).distinct()
    counts = stage(seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages), "line-counts")
    return counts.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 3, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines and n_dropped (lines of the text before, lines dropped).

    Every row stays, with an empty text if all its lines go; a null text stays null with zero lines; other columns are
    carried, except that n_lines and n_dropped are replaced. While the boilerplate set is at most broadcast_lines it is
    sent to the tasks and the texts are not shuffled; a larger set is joined to the lines of each page.
    """
    found = stage(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    if found.limit(broadcast_lines + 1).count() > broadcast_lines:
        return _by_join(docs, found, host_col, text_col)
    sent: dict[str, set[bytes]] = defaultdict(set)
    for host, line in found.collect():
        sent[host].add(bytes(line))
    held = docs.sparkSession.sparkContext.broadcast(dict(sent))

    def make():
        of = held.value

        def one(host, text):
            if text is None:
                return None, 0, 0
            lines, bad = text.split("\n"), of.get("" if host is None else str(host))
            if not bad:
                return text, len(lines), 0
            kept = [x for x in lines if not (y := x.strip(" ")) or hashlib.md5(y.encode()).digest() not in bad]
            return "\n".join(kept), len(lines), len(lines) - len(kept)

        return lambda hosts, texts: tuple(zip(*map(one, hosts, texts), strict=True))

    made = [("__text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]
    wide = append(docs.withColumn("__host", F.col(host_col).cast("string")), ["__host", text_col], made, make)
    return wide.select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _by_join(docs: DataFrame, found: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """The same by a join on host and line; a page's own boilerplate is gathered by its host and text's digest, so equal pages share it."""
    page = docs.withColumn("__host", F.coalesce(F.col(host_col).cast("string"), F.lit(""))).withColumn("__page", F.sha2(text_col, 256))
    lines = page.select("__host", "__page", F.explode(F.array_distinct(F.transform(F.split(text_col, "\n"), _digest))).alias("__line"))
    hits = lines.distinct().join(found, (F.col("__host") == found["host"]) & (F.col("__line") == found["line"])).groupBy("__host", "__page").agg(F.collect_set("__line").alias("__bad"))
    both = page.join(stage(hits, "boilerplate-by-page"), ["__host", "__page"], "left")
    kept = F.when(F.col("__bad").isNull(), F.split(text_col, "\n")).otherwise(F.filter(F.split(text_col, "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains("__bad", _digest(x))))
    n = F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long")
    full = both.withColumn("__kept", kept).withColumn("__n", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n))
    return full.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.col("__n").alias("n_lines"), F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("__n") - F.size("__kept")).alias("n_dropped"),
    )
