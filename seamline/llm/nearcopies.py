"""Near copies by exact five-word Jaccard: SimHash BK-trees and MinHash bands find candidates, shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.llm.simhash import _signed, links, print_of, shingle_hashes
from seamline.operators.components import connected_components
from seamline.shared import stage

WIDTH, SIMILAR = 5, (4, 5)
#: Bands and the MinHash values of each: of pairs at exactly 0.8 about 3 in a million share no band, of those above fewer.
BANDS, ROWS = 24, 4
#: Shingle sets, and shingles, that a part of a candidate component holds; a task compares two parts.
PART_SETS, PART_SHINGLES = 2048, 1_000_000
#: Ids of candidates up to this many are sent to every task, and the texts stay where they are; beyond it they are joined.
BROADCAST_IDS = 500_000


def shingle_set(text: str | None):
    """The distinct hashes of a text's five-word shingles, sorted; of a shorter text its words as one shingle, of none no hash."""
    import numpy as np

    return np.unique(shingle_hashes(text, WIDTH))


def _constants():
    import numpy as np

    rnd = np.random.default_rng(42)
    return rnd.integers(0, 1 << 64, BANDS * ROWS, dtype="<u8"), rnd.integers(0, 1 << 64, BANDS * ROWS, dtype="<u8") | np.uint64(1)


def bands(hashes, constants) -> list[int]:
    """A signed 64-bit key for each band of a set's MinHash values."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    mix, odd = constants
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype="<u8")
    for i in range(0, len(hashes), 2048):
        v = (hashes[i : i + 2048, None] ^ mix) * odd
        np.minimum(least, (v ^ v >> np.uint64(32)).min(axis=0), out=least)
    return [_signed(h(least[k : k + ROWS].tobytes(), k)) for k in range(0, BANDS * ROWS, ROWS)]


def _key(hashes) -> int:
    from xxhash import xxh64_intdigest as h

    return _signed(h(hashes.tobytes(), 7))


def similar(a: set, b: set) -> bool:
    """Jaccard of at least 0.8, in integers; equal sets, empty ones too, are similar."""
    num, den = SIMILAR
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(a & b)
    return both * den >= (len(a) + len(b) - both) * num


def _verified(unit: list[tuple[int, bool, bytes]]) -> list[tuple[int, int]]:
    """Pairs at 0.8 or more that span the components of one unit: members of the first part meet those before them, the others the whole first part; pairs already connected are not compared."""
    import numpy as np

    groups: list[list[tuple[int, set]]] = []
    out = []
    for key, first, raw in sorted(unit, key=lambda u: (not u[1], u[0])):
        own, hit, rest = set(np.frombuffer(raw, "<u8").tolist()), [], []
        for g in groups:
            near = next((k for k, s in g if similar(own, s)), None)
            if near is None:
                rest.append(g)
            else:
                out.append((key, near))
                hit.append(g)
        if first:
            groups = [*rest, [x for g in hit for x in g] + [(key, own)]]
        elif len(hit) > 1:
            groups = [*rest, [x for g in hit for x in g]]
    return out


def _candidates(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b): keys of sets linked over a band's least key, or by the BK-trees over five-word fingerprints."""
    each = sets.select("key", F.explode("bands").alias("band"))
    shared = stage(each.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least"), "bands")
    found = each.join(shared, "band").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    by_print = stage(sets.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    same = sets.select("key", "fp").join(by_print, "fp").where("key <> least").select("key", "least")
    near = links(by_print.select("fp"), radius)
    for end in ("a", "b"):
        near = near.join(by_print.select(F.col("fp").alias(end), F.col("least").alias(f"k{end}")), end)
    return found.union(same).union(near.select("ka", "kb"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 7, part_sets: int = PART_SETS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, component_id): a row for each row of docs; components of the texts whose five-word shingles are similar, with their least id.

    Every pair inside a candidate component is compared by its whole shingle sets unless others connect it already, so
    all links are at 0.8 or more. Equal sets are one (by a 64-bit hash). A candidate component beyond a part's bounds is
    cut in parts by hash, and each two parts are a unit. Only the sets of candidates are shuffled, once for each part.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        constants = _constants()

        def fn(texts):
            import numpy as np

            hashes = [shingle_hashes(t, WIDTH) for t in texts]
            sets = [np.unique(x) for x in hashes]
            return [_key(s) for s in sets], [_signed(print_of(x)) for x in hashes], [len(s) for s in sets], [bands(s, constants) for s in sets]

        return fn

    made = [("key", T.LongType()), ("fp", T.LongType()), ("n", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    rows = stage(append(text, ["text"], made, make).select("id", "key", "fp", "n", "bands"), "shingle-sets")
    sets = stage(rows.groupBy("key").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct-sets")
    parts = connected_components(_candidates(sets, radius), "a", "b")
    member = stage(parts.select(F.col("node").alias("key"), F.col("component").alias("home")).join(sets.select("key", "n"), "key"), "candidates")
    sizes = stage(member.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part_sets), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts")), "candidate-sizes")
    placed = stage(member.join(sizes, "home").select("key", "home", "parts", F.expr("cast(pmod(xxhash64(key), parts) as int)").alias("part")), "placed")
    ids = stage(rows.join(placed, "key").select("id").distinct(), "candidate-ids")
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    use = text.alias("t").join((F.broadcast(ids) if few else ids).alias("i"), F.col("t.id").eqNullSafe(F.col("i.id")), "left_semi")

    def whole():
        def fn(texts):
            made = [shingle_set(t) for t in texts]
            return [_key(s) for s in made], [s.tobytes() for s in made]

        return fn

    full = append(use, ["text"], [("key", T.LongType()), ("raw", T.BinaryType())], whole).select("key", "raw")
    full = stage(full.join(placed, "key").dropDuplicates(["key"]), "candidate-sets")
    units = full.select("key", "home", "raw", F.explode(F.expr("transform(sequence(0, parts - 1), o -> struct(least(o, part) as i, greatest(o, part) as j, part <= o as first))")).alias("u")).select("home", "u.*", "key", "raw")
    dealt = units.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j").select(F.concat_ws(",", "home", "i", "j").alias("unit"), "key", "first", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([v[k] for v in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for unit, key, first, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if unit != now:
                    found += _verified(held) if len(held) > 1 else []
                    now, held = unit, []
                held.append((key, first, raw))
            yield out(found)
        yield out(_verified(held) if len(held) > 1 else [])

    verified = connected_components(dealt.mapInArrow(run, "a long, b long"), "a", "b")
    of = sets.join(verified.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    of = stage(of, "members")
    least = stage(of.groupBy("component").agg(F.min("least").alias("component_id")), "least-ids")
    class_of = stage(of.join(least, "component").select("key", "component_id"), "classes")
    return rows.select("id", "key").join(class_of, "key").select(F.col("id").alias(id_col), "component_id")
