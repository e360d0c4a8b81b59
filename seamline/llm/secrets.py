"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F, types as T

from seamline.llm.arrow import append
from seamline.shared import stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy, so a maximal run; shorter runs fail anyway
#: A long mixed string is a candidate that only its ownership can tell from an example.
MIXED = re.compile(r"[A-Za-z0-9_+/-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "mixed")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base matches, sorted: leftmost and not overlapping within a kind; those too short are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):  # what ASCII case alone can make; others only cost a search
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def mixed_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long strings with lower-case and upper-case letters and digits that touch no base span."""
    out = []
    for m in MIXED.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("hash", T.BinaryType())]))


def candidates(docs: DataFrame, text_col: str = "text", out: str = "spans", copy: str = "copy") -> DataFrame:
    """docs with the spans of all candidates, and the text's digest where it has any; a value is known by its SHA-256 alone from here on."""

    def make():
        def one(text):
            text = text or ""
            base = base_spans(text)
            return [{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).digest()} for s, k, e, v in sorted(base + mixed_spans(text, base))]

        def fn(texts):
            spans = [one(t) for t in texts]
            return spans, [hashlib.md5(t.encode()).hexdigest() if s else None for t, s in zip(texts, spans, strict=True)]

        return fn

    return append(docs, [text_col], [(out, SPAN), (copy, T.StringType())], make)


def ownership(spans: DataFrame, repo_col: str = "repo", owner_col: str = "owner", max_owners: int = 1, max_repos: int = 20) -> DataFrame:
    """(hash, n_repos, n_owners, live) of rows (hash, repo, owner): live if at most max_owners owners and max_repos repositories have it.

    Pairs are made distinct map-side before the counts, so a widely copied example is a few rows per task. A null
    owner or repository counts as one of its own.
    """
    each = spans.select("hash", F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("o"))
    repos = each.select("hash", "r").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = each.select("hash", "o").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", max_owners: int = 1, max_repos: int = 20) -> DataFrame:
    """(id, spans): for each row of docs its spans (start, kind, end, hash, n_repos, n_owners, live), by start and kind.

    repo_col: where the repository is named; None: each distinct text is one, so exact copies within an owner count once.

    Base spans all stay; a mixed string is a span only where its ownership is that of a live credential, so widely
    copied examples add none. Only the candidates are shuffled, never the texts. Null counts as empty; repeated rows
    are scanned each, but a repository and an owner count once.
    """
    use = docs.select(F.col(id_col).alias("id"), (F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")).alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    rows = stage(candidates(use, "text").drop("text").withColumn("rid", F.monotonically_increasing_id()), "candidates")
    each = rows.select("rid", F.col("repo" if repo_col else "copy").alias("repo"), "owner", F.explode("spans").alias("s")).select("rid", "repo", "owner", "s.*")
    judged = stage(ownership(each.select("hash", "repo", "owner"), max_owners=max_owners, max_repos=max_repos), "ownership")
    marked = each.join(judged, "hash").where((F.col("kind") < 3) | F.col("live"))
    lists = marked.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_repos", "n_owners", "live"))).alias("spans"))
    return rows.select("rid", "id").join(lists, "rid", "left").select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example): spans joined as kind:start:end; n_live and n_example count the base spans."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    number = lambda f: F.size(F.filter(base, f)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  a second parameter would be the index
    return found.select(
        id_col, *[number(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"),
        number(lambda s: s["live"]).alias("n_live"), number(lambda s: ~s["live"]).alias("n_example"),
    )
