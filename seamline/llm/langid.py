"""Language identification by known words, backing off to character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.llm.sample import bounded_sample
from seamline.shared import stage

#: Runs of letters and other numerals than digits; the numerals are taken out after.
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows the model is fitted on, chosen by hashes, and units (words and n-grams, by language) that the driver takes, the most frequent: together the bound on what reaches the driver.
TRAIN_ROWS, UNITS = 4000, 400_000
ORDERS = (5, 4, 3, 2, 1)
REMEMBERED = 400_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (the categories L); null has none."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, min_count: int = 3, units_bound: int = UNITS) -> dict:
    """Counts of words and n-grams by language, from at most rows labelled texts chosen by hash of their id.

    Units seen under min_count times in the sample are left to the backoff, except single characters, and so are those
    past the units_bound most frequent. Counted on the executors; the driver gets the counts. No labelled rows give a model without languages.
    """
    labelled = train.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = bounded_sample(labelled, "id", rows).where(F.col("text").isNotNull()).select("text", "lang")

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, k in Counter(words_of(text)).items():
                    counts[lang, 0, word] += k
                    for n in ORDERS:
                        for g in grams(word, n):
                            counts[lang, n, g] += k
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "n", "unit", "k"])

    counted = stage(sample.repartition(8).mapInArrow(run, "lang string, n int, unit string, k long").groupBy("n", "unit", "lang").agg(F.sum("k").alias("k")), "language-counts")
    often = counted.where((F.col("k") >= min_count) | (F.col("n") == 1))
    known = often if often.count() <= units_bound else often.orderBy(F.desc("k"), "n", "unit", "lang").limit(units_bound)
    units: dict[int, dict[str, dict[str, int]]] = {n: defaultdict(dict) for n in (0, *ORDERS)}
    totals: Counter = Counter({(r["lang"], r["n"]): r["k"] for r in counted.groupBy("lang", "n").agg(F.sum("k").alias("k")).collect()})
    langs = sorted({lang for lang, _ in totals})
    place = {x: i for i, x in enumerate(langs)}
    for n, unit, lang, k in known.toLocalIterator():
        units[n][unit][place[lang]] = k
    return {"langs": langs, "totals": {n: [totals[x, n] for x in langs] for n in units}, "units": {n: {u: tuple(c.items()) for u, c in d.items()} for n, d in units.items()}}


class Scorer:
    """Log-probabilities of words under each language of a fitted model."""

    def __init__(self, model: dict) -> None:
        self.model, self.langs = model, model["langs"]
        #: What a unit that a language never had is taken for: half a count.
        self.floor = {n: [math.log(0.5 / (t + 1)) for t in ts] for n, ts in model["totals"].items()}
        self.known: dict[str, int] = {}
        self.rows: list[list[float]] = []

    def unit(self, n: int, unit: str) -> list[float] | None:
        got = self.model["units"][n].get(unit)
        if got is None:
            return None
        out, totals = list(self.floor[n]), self.model["totals"][n]
        for i, k in got:
            out[i] = math.log(k / (totals[i] + 1))
        return out

    def word(self, word: str) -> list[float]:
        """A known word by its frequencies; else the longest known n-grams at each place, mean over them, less for shorter ones."""
        if (got := self.unit(0, word)) is not None:
            return got
        marked, i, parts = f"^{word}$", 0, []
        while i < len(marked):
            for n in ORDERS:
                if i + n <= len(marked) and (got := self.unit(n, marked[i : i + n])) is not None:
                    parts.append(got)
                    i += n
                    break
            else:
                i += 1  # a character no language had says nothing
        return [sum(p[k] for p in parts) / len(parts) for k in range(len(self.langs))] if parts else [0.0] * len(self.langs)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np

        langs, scores = [], []
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.rows.clear()
        known, rows = self.known, self.rows
        listed = []
        for t in texts:
            ids = []
            for w in words_of(t):
                at = known.get(w)
                if at is None:
                    at = known[w] = len(rows)
                    rows.append(self.word(w))
                ids.append(at)
            listed.append(ids)
        table = np.array(rows) if rows else np.zeros((1, max(1, len(self.langs))))
        for ids in listed:
            if not ids or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = table[np.array(ids)].sum(axis=0)
            best = int(total.argmax())  # of equal ones, the first by name
            gap = np.exp(np.minimum(total - total[best], 0) / math.sqrt(len(ids)))
            langs.append(self.langs[best])
            scores.append(float(1 / gap.sum()))
        return langs, scores


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). Null texts and texts without a letter are `und` with score 0; so is all without a fitted language."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, [text_col], [("lang_pred", T.StringType()), ("score", T.DoubleType())], lambda: Scorer(held.value).predict)
