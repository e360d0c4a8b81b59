"""Byte-level BPE by an index of pair occurrences over all words of a batch."""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import re
import sys
from array import array

from pyspark.sql import DataFrame, types as T

from seamline.llm.arrow import append

# Characters (hexadecimal, first or first-last) that Unicode has made letters or numbers since version 16, which the library's tables stop at; there they are neither.
NEWER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F
12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96
1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
#: What the split and the merges here rest on; a file that asks for anything else is refused.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Characters of texts whose unseen words are encoded together, about: bounds the pair lists.
BATCH_CHARS = 1_500_000
#: Words a task remembers before it forgets them all: bounds memory, has no effect on results.
REMEMBERED = 300_000


def split_pattern(letter: str = r"\p{L}", number: str = r"\p{N}") -> str:
    """The split of byte-level BPE before the merges (fixed value of the published format)."""
    return rf"""'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where printable in Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Encoder:
    """Encodes and decodes as the tokenizers library does for a byte-level BPE file without normaliser."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        model, symbols = spec["model"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.vocab: dict[str, int] = model["vocab"]
        self.first = [self.vocab[c] for c in symbols]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.vocab.items()} | {i: s.encode() for s, i in added.items()}
        self.added = {s: array("I", [i]).tobytes() for s, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        newer = "".join("-".join(f"\\U{x:0>8}" for x in r.split("-")) for r in NEWER.split())
        self.maybe, self.newer = re.compile("[\u0558-\U0003fc3f]").search, regex.compile(f"[{newer}]").search
        self.usual = regex.compile(split_pattern()).findall
        self.careful = regex.compile(split_pattern(rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"), regex.V1).findall
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _check(spec: dict) -> None:
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec.get("normalizer") is None and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        odd = [t["content"] for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
        if not plain or odd or any(spec["model"].get(k, v) != v for k, v in MODEL.items()):
            raise ValueError(f"only a plain byte-level BPE file can be read; added tokens with options: {odd}")

    def find(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        return (self.careful if self.maybe(text) and self.newer(text) else self.usual)(text)

    def learn(self, words: set[str]) -> None:
        """Encode the words together. Every pair has the list of all its positions; pairs are merged in ascending rank, and a merge changes the lists of the pairs beside it."""
        first, merge = self.first, self.merge
        ids: list[int] = []
        spans = []
        for w in words:
            start = len(ids)
            ids += [first[b] for b in w.encode()]
            spans.append((w, start, len(ids)))
            ids.append(-1)  # no pair crosses words
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        at: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
            if (places := at.get(pair)) is not None:
                places.append(i)
            elif pair in merge:
                at[pair] = [i]
        heap = [(merge[p][0], p) for p in at]
        heapq.heapify(heap)
        push = heapq.heappush
        while heap:
            pair = heapq.heappop(heap)[1]
            places = at.pop(pair)
            a, b = pair
            made = merge[pair][1]
            places.sort()
            for i in places:
                if ids[i] != a:
                    continue  # merged into something else since it was listed
                j = right[i]
                if j >= n or ids[j] != b:
                    continue
                ids[i], ids[j] = made, -2
                right[i] = k = right[j]
                if k < n:
                    left[k] = i
                    new = (made, ids[k])
                    if (found := at.get(new)) is not None:
                        found.append(i)
                    elif new in merge:
                        at[new] = [i]
                        push(heap, (merge[new][0], new))
                if (h := left[i]) >= 0:
                    new = (ids[h], made)
                    if (found := at.get(new)) is not None:
                        found.append(h)
                    elif new in merge:
                        at[new] = [h]
                        push(heap, (merge[new][0], new))
        known = self.known
        for w, start, end in spans:
            known[w] = array("I", [x for x in ids[start:end] if x >= 0]).tobytes()

    def words(self, text: str) -> list:
        """The text's words; an added token is a one-element tuple."""
        if self.split_added is None or not any(s in text for s in self.added):
            return self.find(text)
        out: list = []
        for i, part in enumerate(self.split_added.split(text)):
            out += [(part,)] if i % 2 else self.find(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as packed little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out, known, held, size = [], self.known, [], 0

        def flush() -> None:
            new = {w for ws in held for w in ws if w not in known and isinstance(w, str)}
            if new:
                self.learn(new)
            for ws in held:
                out.append(b"".join([known[w] if isinstance(w, str) else self.added[w[0]] for w in ws]))
            held.clear()

        for t in texts:
            held.append(self.words(t))
            size += len(t)
            if size > BATCH_CHARS:
                flush()
                size = 0
        flush()
        return out

    def decode(self, packed: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids_of(packed)]).decode("utf-8", errors="replace")


def ids_of(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str | None) -> Encoder:
    """The process's tables of a vocabulary with an empty memory of words, which ends with the task."""
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    own = copy.copy(_LOADED[path])
    own.known = {}
    return own


_LOADED: dict[str, Encoder] = {}


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with the ids (array of integers) of each text. path: the vocabulary file on every executor; None: the public byte_bpe_50k.json.

    Null counts as empty and has no ids. The pass has no shuffle; a batch's unseen words are encoded together.
    """

    def make():
        enc = _encoder(path)
        return lambda texts: ([ids_of(p).tolist() for p in enc.encode_batch([t or "" for t in texts])],)

    return append(docs, [text_col], [(ids, T.ArrayType(T.LongType()))], make)


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None, text: str = "text") -> DataFrame:
    """docs with the text of each list of ids; a null list gives null, ids outside the vocabulary raise KeyError."""

    def make():
        enc = _encoder(path)
        return lambda lists: ([None if x is None else enc.decode(array("I", x).tobytes()) for x in lists],)

    return append(docs, [ids_col], [(text, T.StringType())], make)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again in one pass, for each row of docs, repeated ones too."""

    def make():
        enc = _encoder(path)

        def fn(texts):
            packed = enc.encode_batch([t or "" for t in texts])
            return (
                [len(p) // 4 for p in packed],
                [hashlib.sha256(p if sys.byteorder == "little" else ids_of(p).tobytes()).hexdigest() for p in packed],
                [hashlib.sha256(enc.decode(p).encode()).hexdigest() for p in packed],
            )

        return fn

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append(docs.select(id_col, text_col), [text_col], fields, make).drop(text_col)
