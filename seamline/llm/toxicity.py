"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs, in numpy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.llm.decontaminate import words_of
from seamline.llm.sample import bounded_sample

#: Words of a window and from one window's start to the next: any passage of up to STRIDE + 1 words is whole in some window.
WINDOW, STRIDE = 32, 16
#: Labelled rows the network is fitted on, chosen by hash of their id: the bound on what reaches the driver. Their texts are whole.
TRAIN_ROWS = 4000
#: Sizes: state of one direction, word and character parts of an input, words and character n-grams with an embedding of their own.
HIDDEN, WORD_DIM, CHAR_DIM, VOCABULARY, GRAMS = 8, 8, 8, 4096, 1 << 14
#: Bytes of the n-grams at a word's start (its mark counts), and of those further in.
STARTS, INNER = (3, 11), (3, 5)
#: Training: steps, windows of each label in a batch, steps from one choice of windows to the next, the standard errors by which log-odds are drawn to zero, the embeddings' share of the rate.
STEPS, BATCH, EVERY, SHRINK, SLOW = 300, 32, 60, 1.5, 0.1
REMEMBERED = 200_000
#: Windows in one matrix product: few enough that the library does not split it over threads.
CHUNK = 1024
THRESHOLD = 0.7


def grams_of(word: bytes) -> list[bytes]:
    """All of a word's character n-grams, in bytes: those of its start with a mark in front."""
    marked = b"^" + word
    out = [marked[:n] for n in range(STARTS[0], min(len(marked), STARTS[1]) + 1)]
    return out + [word[i : i + n] for i in range(1, len(word)) for n in range(INNER[0], INNER[1] + 1) if i + n <= len(word)]


def window_starts(n: int) -> range:
    """Starts of the windows that together hold all of n words; a text without words has one empty window."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    import numpy as np

    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """GRUs in both directions over a window's words, attention over their states, one logistic output. A text's score is its highest window's."""

    def __init__(self, vocabulary: list[bytes], grams: list[bytes] = (), seed: int = 7) -> None:
        import numpy as np

        rng, h, x = np.random.default_rng(seed), HIDDEN, WORD_DIM + CHAR_DIM
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        self.grams = {g: i + 1 for i, g in enumerate(grams)}  # 0: no known n-gram
        init = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": init(len(vocabulary) + 1, WORD_DIM, scale=0.01), "char": init(len(self.grams) + 1, CHAR_DIM, scale=0.01),
            "att": init(2 * h, scale=0.3), "out": init(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32),
        }
        for d in "fb":
            self.p |= {f"in_{d}": init(x, 3 * h, scale=x**-0.5), f"rec_{d}": init(h, 3 * h, scale=h**-0.5), f"b_{d}": np.zeros(3 * h, np.float32)}

    def slots(self, words: list[bytes]):
        """(rows of the word embedding, rows of the n-gram embedding of all words in a row, where each word's begin).

        A word's n-grams are the longest known one at each place; a word without any has the row 0.
        """
        import numpy as np

        known, flat, offsets = self.grams.get, [], []
        for w in words:
            offsets.append(len(flat))
            marked, found = b"^" + w, {}
            for n in range(min(len(marked), STARTS[1]), STARTS[0] - 1, -1):
                if k := known(marked[:n]):
                    found[k] = None
                    break
            for i in range(1, len(w) - INNER[0] + 1):
                for n in range(min(len(w) - i, INNER[1]), INNER[0] - 1, -1):
                    if k := known(w[i : i + n]):
                        found[k] = None
                        break
            flat += found or (0,)
        return np.array([self.index.get(w, 0) for w in words], np.int64), np.array(flat, np.int64), np.array(offsets, np.int64)

    def inputs(self, slots):
        """A word's own embedding beside the greatest of its n-grams' in each dimension: a convolution over its characters with max pooling, the filters' answers being looked up."""
        import numpy as np

        own, flat, offsets = slots
        if not len(own):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][own], np.maximum.reduceat(self.p["char"][flat], offsets)], axis=1)

    def gates(self, x):
        """What the inputs add to the gates of both directions: all of a word's part that does not depend on its place."""
        import numpy as np

        w = np.concatenate([self.p["in_f"], self.p["in_b"]], axis=1)
        b = np.concatenate([self.p["b_f"], self.p["b_b"]])
        return np.concatenate([x[i : i + CHUNK // 4] @ w + b for i in range(0, max(1, len(x)), CHUNK // 4)])

    def forward(self, table, ids, lengths, tape: bool = False):
        """Logits of windows: ids (windows, places) are rows of table; places from a window's length on are padding, left out of states and attention."""
        import numpy as np

        n, t, h = *ids.shape, HIDDEN
        states, kept = np.zeros((t, n, 2 * h), np.float32), []
        for d, name in enumerate("fb"):
            s = np.zeros((n, h), np.float32)
            rec = self.p[f"rec_{name}"]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                a = table[ids[:, i], 3 * h * d : 3 * h * (d + 1)]
                r = s @ rec
                zr = _sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
                z, g = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + g * r[:, 2 * h :])
                on = (i < lengths)[:, None]
                new = np.where(on, s + z * (c - s), s)
                if tape:
                    kept.append((d, i, s, z, g, c, r[:, 2 * h :], on))
                s = new
                states[i, :, d * h : (d + 1) * h] = new
        e = states @ self.p["att"]
        e[np.arange(t)[:, None] >= lengths[None, :]] = -1e9
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        w *= lengths > 0
        pooled = np.einsum("tn,tnh->nh", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, states, w, pooled, kept) if tape else logit

    def logits(self, table, ids, lengths):
        """Logits of any number of windows, those of like length together."""
        import numpy as np

        out = np.zeros(len(ids), np.float32)
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), CHUNK):
            part = order[i : i + CHUNK]
            out[part] = self.forward(table, ids[part, : max(1, int(lengths[part].max()))], lengths[part])
        return out

    def gradients(self, slots, ids, lengths, target):
        """Gradients of the mean cross-entropy of windows; ids are places in slots."""
        import numpy as np

        p, h, n = self.p, HIDDEN, len(ids)
        own, flat, offsets = slots
        x = self.inputs(slots)
        table = self.gates(x)
        logit, states, w, pooled, kept = self.forward(table, ids, lengths, tape=True)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - target) / n).astype(np.float32)
        grad["bias"][0], grad["out"] = dl.sum(), pooled.T @ dl
        dpool = dl[:, None] * p["out"]
        dw = np.einsum("tnh,nh->tn", states, dpool)
        de = w * (dw - (w * dw).sum(axis=0))
        grad["att"] = np.einsum("tn,tnh->h", de, states)
        ds = w[:, :, None] * dpool[None] + de[:, :, None] * p["att"]
        dtable = np.zeros_like(table)
        carry = {0: np.zeros((n, h), np.float32), 1: np.zeros((n, h), np.float32)}
        for d, i, s, z, g, c, rc, on in reversed(kept):
            name = "fb"[d]
            total = carry[d] + ds[i, :, d * h : (d + 1) * h]
            live = total * on
            dc = live * z * (1 - c * c)
            dz = live * (c - s) * z * (1 - z)
            dg = dc * rc * g * (1 - g)
            da = np.concatenate([dz, dg, dc], axis=1)
            dr = np.concatenate([dz, dg, dc * g], axis=1)
            grad[f"rec_{name}"] += s.T @ dr
            carry[d] = np.where(on, live * (1 - z), total) + dr @ p[f"rec_{name}"].T
            np.add.at(dtable, (ids[:, i], slice(3 * h * d, 3 * h * (d + 1))), da)
        dx = np.zeros_like(x)
        for d, name in enumerate("fb"):
            part = dtable[:, 3 * h * d : 3 * h * (d + 1)]
            grad[f"in_{name}"], grad[f"b_{name}"] = x.T @ part, part.sum(axis=0)
            dx += part @ p[f"in_{name}"].T
        np.add.at(grad["word"], own, dx[:, :WORD_DIM])
        times = np.diff(np.append(offsets, len(flat)))
        chosen = p["char"][flat] == np.repeat(x[:, WORD_DIM:], times, axis=0)  # the n-gram that was the greatest takes the gradient
        np.add.at(grad["char"], flat, chosen * np.repeat(dx[:, WORD_DIM:], times, axis=0))
        return grad


class Texts:
    """Texts as word numbers: the distinct words, and all windows of all texts."""

    def __init__(self, docs: list[list[bytes]]) -> None:
        import numpy as np

        place: dict[bytes, int] = {}
        rows, lengths, owner, self.sets = [], [], [], []
        for k, words in enumerate(docs):
            at = np.array([place.setdefault(w, len(place)) for w in words], np.int32)
            self.sets.append(np.unique(at))
            for s in window_starts(len(at)):
                part = at[s : s + WINDOW]
                rows.append(np.pad(part, (0, WINDOW - len(part))))
                lengths.append(len(part))
                owner.append(k)
        self.words = list(place)
        self.ids = np.array(rows, np.int32).reshape(-1, WINDOW)
        self.lengths, self.owner = np.array(lengths, np.int64), np.array(owner, np.int64)


def log_odds(texts: Texts, labels, units_of: Callable[[bytes], list[bytes]], most: int) -> dict[bytes, float]:
    """{unit: log-odds of the labels of the texts that hold it}, drawn to zero by SHRINK standard errors; at most most units, the farthest from zero first.

    Units in under a 500th of the texts, or under three, are left out, and so are those that come to zero.
    """
    import numpy as np

    unit: dict[bytes, int] = {}
    flat, offsets = [], [0]
    for w in texts.words:
        flat += [unit.setdefault(u, len(unit)) for u in dict.fromkeys(units_of(w))]
        offsets.append(len(flat))
    flat, offsets = np.array(flat, np.int64), np.array(offsets, np.int64)
    df = np.zeros((2, len(unit)))
    for at, y in zip(texts.sets, labels, strict=True):
        n = offsets[at + 1] - offsets[at]
        places = np.repeat(offsets[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        df[y][np.unique(flat[places])] += 1
    n = [(labels == y).sum() + 1 for y in (0, 1)]
    raw = np.log((df[1] + 0.5) / n[1]) - np.log((df[0] + 0.5) / n[0])
    value = np.sign(raw) * np.maximum(0, np.abs(raw) - SHRINK * np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5)))
    both, names = df.sum(axis=0), list(unit)
    kept = [int(i) for i in np.flatnonzero((both >= max(3, len(texts.sets) // 500)) & (value != 0))]
    kept.sort(key=lambda i: (-abs(value[i]), -both[i], names[i]))
    return {names[i]: float(value[i]) for i in kept[:most]}


def train(texts: list[list[bytes]], labels: list[int], steps: int = STEPS, rate: float = 0.02, decay: float = 0.01, seed: int = 7) -> Network:
    """Fit on texts with 0/1 labels by Adam with decayed weights; without texts of both labels the network stays as it begins.

    The first dimension of the embeddings starts from log-odds(). They learn at a tenth of the rate, or a few hundred
    labels would be learnt by heart. A text's highest window stands for it, as in scoring, at first by the greatest sum of
    log-odds and after each EVERY steps by the network. Half of a batch is of texts labelled 1; of those labelled 0,
    half are their highest windows and half any. The weights are the mean of the last third of the steps. No text is set apart: nothing is chosen by its labels' loss.
    """
    import numpy as np

    rng, held, y = np.random.default_rng(seed), Texts(texts), np.array(labels, np.int64)
    words, grams = log_odds(held, y, lambda w: [w], VOCABULARY), log_odds(held, y, grams_of, GRAMS)
    net = Network(list(words), list(grams), seed)
    net.p["word"][1:, 0] = np.array(list(words.values()), np.float32) / 2
    net.p["char"][1:, 0] = np.array(list(grams.values()), np.float32) / 2
    of = [np.flatnonzero(y[held.owner] == k) for k in (0, 1)]
    if not all(map(len, of)):
        return net
    own, flat, offsets = slots = net.slots(held.words)
    sizes = np.diff(np.append(offsets, len(flat)))
    logit = np.where(np.arange(WINDOW) < held.lengths[:, None], net.inputs(slots)[:, [0, WORD_DIM]].sum(axis=1)[held.ids], -9).max(axis=1) if held.words else np.zeros(len(held.ids))
    m, v, mean = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(3))
    for step in range(1, steps + 1):
        if step % EVERY == 1:
            if step > 1:
                logit = net.logits(net.gates(net.inputs(slots)), held.ids, held.lengths)
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, held.owner, logit)
            best = [w[logit[w] == top[held.owner[w]]] for w in of]
        pick = np.concatenate([rng.choice(best[1], BATCH), rng.choice(best[0], BATCH // 2), rng.choice(of[0], BATCH // 2)])
        used, back = np.unique(held.ids[pick], return_inverse=True)
        n = sizes[used] if len(own) else np.zeros(0, np.int64)
        at = np.cumsum(n) - n
        part = (own[used], flat[np.repeat(offsets[used] - at, n) + np.arange(n.sum())], at) if len(own) else net.slots([b""])
        grad = net.gradients(part, back.reshape(len(pick), WINDOW), held.lengths[pick], y[held.owner[pick]].astype(np.float32))
        slow = rate * min(1, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] -= (SLOW if k in ("word", "char") else 1) * slow * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-4) + decay * net.p[k])
        if step > steps * 2 // 3:
            for k, x in net.p.items():
                mean[k] += x / (steps - steps * 2 // 3)
    net.p = mean
    return net


class Scorer:
    """Scores batches of texts; remembers the gates of the words it has met, up to a bound."""

    def __init__(self, net: Network) -> None:
        import numpy as np

        self.net, self.known = net, {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> list[float]:
        return self.score_words(map(words_of, texts))

    def score_words(self, texts) -> list[float]:
        out: list[float] = []
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(held[-1])
            if size > 200_000:
                out += self._score(held)
                held, size = [], 0
        return out + self._score(held) if held else out

    def _score(self, docs: list[list[bytes]]) -> list[float]:
        import numpy as np

        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        known, new, flat, sizes = self.known, [], [], []
        for words in docs:
            for w in words:
                at = known.get(w)
                if at is None:
                    at = known[w] = len(known)
                    new.append(w)
                flat.append(at)
            sizes.append(len(words))
        if new:
            self.table = np.concatenate([self.table, self.net.gates(self.net.inputs(self.net.slots(new)))])
        table = self.table if len(self.table) else np.zeros((1, 6 * HIDDEN), np.float32)
        flat = np.array(flat + [0] * WINDOW, np.int64)
        starts, lengths, owner, base = [], [], [], 0
        for k, n in enumerate(sizes):
            for s in window_starts(n):
                starts.append(base + s)
                lengths.append(min(WINDOW, n - s))
                owner.append(k)
            base += n
        starts, lengths = np.array(starts), np.array(lengths)
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, np.array(owner), self.net.logits(table, flat[starts[:, None] + np.arange(WINDOW)], lengths))
        return _sigmoid(best).tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, steps: int = STEPS) -> Network:
    """A network fitted on the driver on the texts of at most rows labels (id, 0 or 1; others are left out), chosen by hash of their id.

    The chosen labels, a bounded table, are sent to the tasks, so texts without one are read and not moved. Texts are
    whole. Of several labels of an id the highest counts, of several texts the one of the least hash; null ids, labels
    and texts are left out. Without both labels the network stays as it begins.
    """
    use = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    pick = bounded_sample(use, "id", rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id")

    def words():
        return lambda texts: ([b" ".join(words_of(t)) for t in texts],)

    each = append(texts, ["text"], [("words", T.BinaryType())], words).groupBy("id").agg(F.min(F.struct(F.xxhash64("words"), "words", "label")).alias("t"))
    got = sorted((bytes(r["words"]), r["label"]) for r in each.select("t.words", "t.label").collect())
    return train([w.split() for w, _ in got], [y for _, y in got], steps)


def with_score(docs: DataFrame, net: Network, text_col: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the score (0 to 1, the highest over all overlapping windows of the whole text) and predicted (1 from threshold on).

    Null and empty texts are one empty window: the score of no evidence. A pass without a shuffle; repeated rows are
    scored alike; other columns are carried, those of the two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(held.value)

        def fn(texts):
            s = scorer.score(texts)
            return s, [int(x >= threshold) for x in s]

        return fn

    return append(docs, [text_col], [(score, T.DoubleType()), (predicted, T.IntegerType())], make)
