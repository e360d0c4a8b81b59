"""SimHash near-duplicates: BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.operators.components import connected_components
from seamline.shared import stage

MASK = (1 << 64) - 1


def shingle_hashes(text: str | None, width: int):
    """A 64-bit hash of each of a text's word shingles, in order; none for null and for texts without words."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return np.array([], dtype="<u8")
    plain, k = b" ".join(words), min(width, len(words))
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return np.array([h(plain[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], dtype="<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer; 0 for null and for texts without words."""
    return print_of(shingle_hashes(text, width))


def print_of(hashes) -> int:
    """The SimHash of hashes; 0 for none."""
    import numpy as np

    if not len(hashes):
        return 0
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """docs and the fingerprint of each text as a signed 64-bit integer, in one pass without a shuffle."""

    def make():
        def fn(texts):
            return ([f - (1 << 64) if (f := fingerprint(t, width)) >> 63 else f for t in texts],)

        return fn

    return append(docs, [text_col], [(out, T.LongType())], make)


class BKTree:
    """Values under the Hamming distance; a child is keyed by its distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.kids.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ x).bit_count()
            below = self.kids[at].setdefault(d, new)
            if below == new:
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the values at most radius from x. By the triangle inequality only edges from d-radius to d+radius can lead to one."""
        found, todo = [], [0] if self.values else []
        values, kids = self.values, self.kids
        while todo:
            at = todo.pop()
            d = (values[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            if k := kids[at]:
                low, high = d - radius, d + radius
                todo += [c for e, c in k.items() if low <= e <= high]
        return found


def _spanning(fps: list[tuple[int, bool, bool]], radius: int) -> list[tuple[int, int]]:
    """Links that span the components of one work unit: each (fingerprint, in the tree?, a query?). One that is both meets those before it; the rest of the queries meet the whole tree."""
    fps = sorted(fps, key=lambda f: not f[1])
    if not fps[0][1]:
        return []
    tree, up = BKTree(), list(range(len(fps)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (x, in_tree, query) in enumerate(fps):
        if query:
            for j in tree.within(x, radius):
                up[root(i)] = root(j)
        if in_tree:
            tree.add(x)
    return [(fps[i][0], fps[root(i)][0]) for i in range(len(fps)) if root(i) != i]


def links(prints: DataFrame, radius: int = 3, blocks: int = 4, shard_limit: int = 4096) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints (one column, fp) at most radius bits apart.

    Of the parts that the bits are cut in, one at least differs in radius // blocks bits at most: none or one. The
    shards are the values of each part. A fingerprint is in the tree of its own value, and queries that one and, where
    one bit may differ, each value with one of its set bits cleared; of two values one bit apart, one is so reached
    from the other. A shard of over shard_limit fingerprints is cut in parts by hash, and the tree of each part (of
    bounded size) is sent to each part of the queries instead of broadcasting all trees, so no task holds more than two
    parts at a time and no pair is missed. A unit emits at most one link for each of its fingerprints.
    """
    if not 0 < blocks <= 64 or radius // blocks > 1:
        raise ValueError("radius must be under twice the number of blocks")
    cut = [64 * i // blocks for i in range(blocks + 1)]
    value = F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cut, cut[1:], strict=False)])
    keyed = prints.select("fp", F.posexplode(value).alias("block", "own"))
    probe = keyed.withColumns({"value": F.col("own"), "home": F.lit(True)})
    if radius >= blocks:
        bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(b - a for a, b in zip(cut, cut[1:], strict=False)) - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k).bitwiseAND(F.col("own"))), lambda x: x != 0)
        near = keyed.select("fp", "block", "own", F.explode(F.transform(bits, lambda x: F.col("own") - x)).alias("value"), F.lit(False).alias("home"))
        probe = probe.unionByName(near)
    hot = stage(keyed.groupBy("block", F.col("own").alias("value")).count().where(F.col("count") > shard_limit), "hot-shards")
    parts = F.coalesce(F.ceil(F.col("count") / shard_limit), F.lit(1)).cast("int")
    own = probe.join(hot, ["block", "value"], "left").select("fp", "block", "value", "home", parts.alias("parts")).withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    first = "part" if radius < blocks else "0"  # without probes beside the home shard, the tree of a part meets its own and the later parts' queries alone
    units = own.select("fp", "block", "value", F.explode(F.expr(f"""
        concat(
            if(home, transform(sequence({first}, parts - 1), o -> struct(part as i, o as j, true as in_tree, o = part as query)), array()),
            transform(filter(sequence(0, parts - 1), o -> not home or o < part), o -> struct(o as i, part as j, false as in_tree, true as query)))
    """)).alias("u")).select("fp", "block", "value", "u.*")
    dealt = units.repartition("block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j").select(F.concat_ws(",", "block", "value", "i", "j").alias("unit"), "fp", "in_tree", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([_signed(v[k]) for v in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for unit, fp, in_tree, query in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if unit != now:
                    if len(held) > 1:
                        found += _spanning(held, radius)
                    now, held = unit, []
                held.append((fp & MASK, in_tree, query))
            yield out(found)
        if len(held) > 1:
            yield out(_spanning(held, radius))

    return dealt.mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, blocks: int = 4, shard_limit: int = 4096) -> DataFrame:
    """(id, fingerprint, component_id): a row for each row of docs.

    fingerprint: 16 hex digits. component_id: the least id reachable over fingerprints at most radius bits apart.
    Null and empty texts have the fingerprint zero and are linked like others; a null id is kept and is never a
    component's id unless the component has no other. Repeated rows are kept, each with its component. No rows give no
    rows; other columns are not read.
    """
    rows = stage(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", width).select("id", "fp"), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    parts = connected_components(links(distinct.select("fp"), radius, blocks, shard_limit), "a", "b")
    member = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = stage(member, "members")
    least = stage(member.groupBy("component").agg(F.min("least").alias("component_id")), "least-ids")  # written, so that a component with many members is split by the join
    class_of = stage(member.join(least, "component").select("fp", "component_id"), "classes")
    return rows.join(class_of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
