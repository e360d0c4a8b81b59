"""Benchmark decontamination by a prefix-filtered set join of word windows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append

WINDOW = 8
#: Benchmark text, in characters, that one block of items has about: some 350,000 windows, an index of about 150 MB in the driver and in a task.
BLOCK_CHARS = 2_000_000
#: A-Z to a-z; ASCII that is neither letter nor digit to a space. Bytes of other characters are word characters.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and all non-ASCII characters; null has none."""
    return (text or "").encode().translate(TABLE).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def rarity(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> Counter:
    """How often each word of a bounded vocabulary occurs in all of docs."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocab, counts = held.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(w for w in words_of(text) if w in vocab)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    part = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return Counter({bytes(r["word"]): r["n"] for r in part.groupBy("word").agg(F.sum("n").alias("n")).collect()})


def prefix_index(items: list[tuple[str, str | None]], count: Counter, width: int = WINDOW) -> dict:
    """{rarest word: {(its place in the window, words of the window): {window: item ids}}}.

    Containment must be whole, so the necessary prefix of a window, ordered by rarity, is its first word.
    """
    out: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, text in items:
        for win in windows_of(words_of(text), width):
            place = min(range(len(win)), key=lambda k: (count[win[k]], win[k], k))
            out[win[place]][place, len(win)][b" ".join(win)].add(item)
    return {w: {k: {t: sorted(s) for t, s in v.items()} for k, v in x.items()} for w, x in out.items()}


def find(words: list[bytes], index: dict) -> tuple[list[list[int]], set[str]]:
    """Merged [start, end) spans of words that are hit, and the items found."""
    spans, items, n = [], set(), len(words)
    for i, w in enumerate(words):
        if (places := index.get(w)) is not None:
            for (place, width), wanted in places.items():
                start = i - place
                if start >= 0 and start + width <= n:  # positional and length bounds
                    got = wanted.get(b" ".join(words[start : start + width]))
                    if got is not None:
                        spans.append((start, start + width))
                        items.update(got)
    return merged(spans), items


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


SPANS = T.ArrayType(T.ArrayType(T.LongType()))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, hit_spans ([start, end) of words in any occurrence of a window) and items (ids found, sorted as strings).

    A window is width consecutive words of an item; an item of fewer words, but not none, is one window. The benchmark
    is taken in blocks of about block_chars characters (whole items, dealt by hash), each an index sent to all tasks;
    the blocks' passes are chained over the same rows, so the texts are never shuffled. Null and empty texts have no
    words and are never hit; a null item_id is no item; repeated rows are scored each; other columns are carried,
    except those of the three names, which are replaced.
    """
    spark = docs.sparkSession
    bench = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    chars = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out = docs
    for k in range(blocks):
        items = [tuple(r) for r in bench.where(F.expr(f"pmod(xxhash64(item), {blocks})") == k).collect()]
        vocabulary = {w for _, t in items for w in words_of(t)}
        index = spark.sparkContext.broadcast(prefix_index(items, rarity(docs, text_col, vocabulary) if vocabulary else Counter(), width))

        def make(index=index, more=k > 0):
            def one(text, spans=None, found=None):
                words = words_of(text)
                new, items = find(words, index.value)
                if more:
                    new, items = merged([*map(tuple, spans), *map(tuple, new)]), items | set(found)
                return len(words), new, sorted(items)

            return lambda *cols: tuple(zip(*map(one, *cols), strict=True))

        fields = [("n_words", T.LongType()), ("hit_spans", SPANS), ("items", T.ArrayType(T.StringType()))]
        out = append(out, [text_col, "hit_spans", "items"][: 3 if k else 1], fields, make)
    return out


def summary(found: DataFrame, id_col: str = "doc_id", least_items: int = 2) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of contamination()'s rows."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    n = F.size("items").cast("long")
    return found.select(id_col, "n_words", hit.alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))
