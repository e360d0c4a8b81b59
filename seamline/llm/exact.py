"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.shared import stage

CHUNKS = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("sha", T.BinaryType())]))


def _gear():
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh32_intdigest(bytes([i])) for i in range(256)], dtype=np.uint32)


def boundaries(data: bytes, gear, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of data. A chunk ends where the top bits of a rolling sum of 16 bytes are zero, from least to most bytes long."""
    import numpy as np

    n = len(data)
    if n <= least:
        return [n] if n else []
    h = gear[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # sums of 2, 4, 8 and 16 bytes, each half shifted past the other
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    ends, start = [], 0
    for p in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while p - start > most:
            start += most
            ends.append(start)
        if p - start >= least:
            ends.append(p)
            start = p
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def with_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text_sha256 (of the text, A-Z lower-cased) and chunks: 64-bit key and SHA-256 of each chunk, in order."""

    def make():
        from xxhash import xxh64_intdigest

        gear = _gear()

        def one(text):
            data = (text or "").encode().lower()
            out, start = [], 0
            for end in boundaries(data, gear):
                piece = data[start:end]
                key = xxh64_intdigest(piece)
                out.append((key - (1 << 64) if key >> 63 else key, hashlib.sha256(piece).digest()))
                start = end
            return hashlib.sha256(data).hexdigest(), [{"key": k, "sha": s} for k, s in out]

        return lambda texts: tuple(zip(*map(one, texts), strict=True))

    return append(docs, [text_col], [("text_sha256", T.StringType()), ("chunks", CHUNKS)], make)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): a row for each row of docs.

    Texts are equal when identical after lower-casing A-Z. The texts are read once and never shuffled: each becomes
    a recipe, the ordered identifiers of its chunks. A chunk's identifier is its 64-bit key once a count over the
    corpus has verified that one SHA-256 alone has that key; chunks of a key with several take the SHA-256 with it.
    Groups are counted map-side, so a text with a third of all rows is a few rows per task. The row with the greatest
    id stays, of repeated ids the first; a null id is below all others. Null counts as empty; empty texts are equal.
    """
    read = with_chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text")
    rows = stage(read.select(F.monotonically_increasing_id().alias("rid"), "id", "text_sha256", "chunks"), "recipes")
    pairs = rows.select(F.explode("chunks").alias("c")).select("c.key", "c.sha")
    clash = stage(pairs.groupBy("key", "sha").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n")).where("n > 1").select("key"), "clashes")
    name = F.col("c.key").cast("string")
    if clash.isEmpty():
        listed = rows.select("rid", "id", "text_sha256", F.transform("chunks", lambda c: c["key"]).alias("recipe"))
    else:
        pieces = rows.select("rid", F.posexplode("chunks").alias("pos", "c"))
        marked = pieces.join(clash.select("key", F.lit(True).alias("hit")), F.col("c.key") == F.col("key"), "left")
        ident = F.when(F.col("hit"), F.concat_ws(":", name, F.hex("c.sha"))).otherwise(name)
        lists = marked.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", ident.alias("ident")))), lambda s: s["ident"]).alias("recipe"))
        listed = stage(rows.select("rid", "id", "text_sha256").join(lists, "rid", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<string>"))), "named-recipes")
    first = F.struct(F.col("id"), (-F.col("rid")).alias("at"))
    groups = stage(listed.groupBy("recipe").agg(F.max(first).alias("best"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return listed.join(groups, "recipe").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("best.at")).alias("kept"), "text_sha256"
    )
