"""The corpus operators as queries over the tables of a folder, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.llm import bpe, decontaminate, exact, langid, licenses, lines, secrets, simhash, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id):
    """crc32 of the id as text, modulo 3; rows with 1 are held out of training."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with its fingerprint and component; null and empty texts have fingerprint zero."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of pages judged; null addresses and those without :// have empty host and path."""
    return urls.judge(_table(spark, sf_dir, "pages")).drop("component")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents scored; null and empty texts too. A null doc_id is not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, training_labels(labels))
    return toxicity.with_score(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels of documents that are not held out."""
    return labels.where(fold(F.col("doc_id")) != 1).select("doc_id", "toxic")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents without its source's boilerplate lines; a null text stays null."""
    return lines.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with its hits; a null text has no words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with its spans; a null text is empty."""
    return secrets.summary(secrets.scan(_table(spark, sf_dir, "documents")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with its language; `und` where the text is null or has no letter. A null doc_id is not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.coalesce(fold(F.col("doc_id")) != 1, F.lit(True))))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with its sentences and licences; a null text has none."""
    return licenses.recognise(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with the row that stays; a null text is empty."""
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with the digests of its tokens; a null text is empty."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_toxicity, op4_line_dedup, op5_decontaminate, op6_secrets, op7_language, op8_licenses, op9_exact_dedup, op10_bpe)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = """
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM documents),
total AS (SELECT host, count(DISTINCT text) AS pages FROM pages GROUP BY host),
line AS (SELECT r, host, text, x.pos, x.line FROM (SELECT r, host, text, unnest(list_transform(string_split(text, chr(10)), lambda l, i: {'pos': i, 'line': l})) AS x FROM pages WHERE text IS NOT NULL)),
frequent AS (SELECT host, trim(line) AS key, count(DISTINCT text) AS n FROM line WHERE trim(line) <> '' GROUP BY 1, 2),
boiler AS (SELECT host, key FROM frequent JOIN total USING (host) WHERE n >= 3 AND n > CAST(0.01 AS DOUBLE) * pages),
marked AS (SELECT line.r, line.pos, line.line, boiler.key IS NOT NULL AS bad FROM line LEFT JOIN boiler ON line.host = boiler.host AND trim(line.line) = boiler.key),
joined AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped FROM marked GROUP BY r)
SELECT doc_id, joined.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM pages LEFT JOIN joined USING (r)
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP5 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8 + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, i, place.k, item FROM place JOIN win ON place.win = win.win AND place.k = win.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP9 = f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _op8() -> str:
    texts = [(t, name) for name, ts in licenses.SENTENCES.items() for t in ts]
    rules = ", ".join(f"CASE WHEN contains(chain, ',{','.join(seq)},') THEN '{name}' END" for name, seq in licenses.RULES)
    return rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_LOWER.format("coalesce(text, '')")}, '([.!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents),
ids AS (SELECT doc_id, len(s) AS n_sentences, list_filter(list_transform(s, lambda x: {_quoted(n for _, n in texts)}[list_position({_quoted(t for t, _ in texts)}, x)]), lambda x: x IS NOT NULL) AS ids FROM s),
c AS (SELECT doc_id, n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids FROM ids),
h AS (SELECT doc_id, n_sentences, sentence_ids, list_filter([{rules.replace("chain", "',' || sentence_ids || ','")}], lambda x: x IS NOT NULL) AS hits FROM c),
d AS (SELECT *, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS once FROM h)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids, coalesce(array_to_string(once, ','), '') AS licenses, once[1] AS license FROM d
"""


def _op2() -> str:
    """The same classes by a recursive closure over the links; RE2 has no lookahead, so a tag is found first and tested then."""
    host = lambda url: _LOWER.format(f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')")
    path = lambda url: f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = lambda url: f"coalesce(regexp_extract({url}, '(?s)^[^#?]*([?][^#]*)', 1), '')"
    at = lambda url: f"CASE {path(url)} WHEN '' THEN '/' ELSE {path(url)} END"
    key = lambda url: f"{host(url)} || {at(url)} || {query(url)}"

    def rule(h: str, p: str, part: int) -> str:
        longest = sorted(urls.RULES, key=lambda r: (len(r[1] + r[2]), r[1], r[2]), reverse=True)
        return "CASE " + " ".join(f"WHEN ({h} = '{rh}' OR ends_with({h}, '.{rh}')) AND starts_with({p}, '{rp}') THEN '{verdict if part else rh + rp}'" for verdict, rh, rp in longest) + " END"

    def every(tag: str, marked: str, value: str) -> str:
        return f"list_transform(list_filter(regexp_extract_all(html, '(?i)<{tag}\\b[^>]*'), lambda x: regexp_matches(x, '{marked}') AND regexp_matches(x, '{value}')), lambda x: regexp_extract(x, '{value}', 1))"

    def no_dots(p: str) -> str:
        step = "CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN done[1 : greatest(len(done) - 1, 1)] ELSE done || x END"
        return f"array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]), lambda done, x: {step}), '/') || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END"

    def resolved(name: str, source: str, href: str, url: str, carried: str) -> str:
        """CTEs that end in one of carried and dst, the absolute form of href."""
        return f"""{name}_a AS (SELECT *, replace({href}, '&amp;', '&') AS ref FROM {source}),
{name}_b AS (SELECT *, regexp_extract(ref, '(?s)^([^?#]*)', 1) AS named, regexp_extract(ref, '(?s)^[^?#]*(.*)$', 1) AS rest FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN starts_with(named, '/') THEN named ELSE regexp_replace({at(url)}, '[^/]*$', '') || named END AS merged FROM {name}_b),
{name} AS (SELECT {carried}, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(ref, '//') THEN 'http:' || ref
    ELSE 'http://' || {host(url)} || CASE named WHEN '' THEN {at(url)} || CASE WHEN starts_with(rest, '?') THEN '' ELSE {query(url)} END ELSE {no_dots("merged")} END || rest END AS dst FROM {name}_c)"""

    gap = r"""\s*=\s*["'']?"""
    canonical = every("link", rf"(?i)\brel{gap}canonical\b", rf"""(?i)^[^>]*\bhref{gap}([^"''\s>]+)""")
    refresh = every("meta", rf"(?i)\bhttp-equiv{gap}refresh\b", r"""(?i)^[^>]*\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*([^"''\s>]+)""")
    base = rf"""(?i)<base\b[^>]*\bhref{gap}([^"''\s>]+)"""
    own = rule("regexp_extract(other, '(?s)^([^/?#]*)', 1)", "regexp_extract(other, '(?s)^[^/?#]*([^?]*)', 1)", 1)
    return f"""
WITH RECURSIVE page AS (SELECT page_id, url, html, {host("url")} AS host, {path("url")} AS path FROM pages),
marked AS (SELECT url, html, nullif(regexp_extract(html, '{base}', 1), '') AS base FROM page WHERE contains(url, '://') AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
{resolved("based", "marked", "base", "url", "url, html")},
said AS (SELECT url, coalesce(dst, url) AS here, unnest({canonical} || {refresh}) AS href FROM based),
{resolved("target", "said", "href", "here", "url")},
link AS (SELECT {key("url")} AS src, {key("dst")} AS dst FROM target WHERE dst IS NOT NULL),
edge AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link),
reach AS (SELECT src AS key, src AS other FROM edge UNION SELECT reach.key, edge.dst FROM reach JOIN edge ON reach.other = edge.src),
vote AS (SELECT key, {own} AS own FROM reach),
class AS (SELECT key, CASE WHEN coalesce(bool_or(own = 'block'), false) AND NOT coalesce(bool_or(own = 'allow'), false) THEN 'block' ELSE 'allow' END AS verdict FROM vote GROUP BY key),
judged AS (SELECT page_id, host, path, {rule("host", "path", 0)} AS rule, {rule("host", "path", 1)} AS own, CASE WHEN contains(url, '://') THEN {key("url")} END AS key FROM page)
SELECT page_id, host, path, rule, coalesce(own, class.verdict, 'allow') AS verdict FROM judged LEFT JOIN class USING (key)
"""


ORACLE_SQL = {"op2_url_filter": _op2(), "op4_line_dedup": _OP4, "op5_decontaminate": _OP5, "op8_licenses": _op8(), "op9_exact_dedup": _OP9}
