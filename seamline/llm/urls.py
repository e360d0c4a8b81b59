"""URL filters over classes of redirects and canonical links, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline.llm.arrow import lower_ascii
from seamline.operators.components import connected_components
from seamline.shared import stage

#: (verdict, host, path): production rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Where a page names its canonical address or sends its reader on: group 1 is the address.
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""
BASE = r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty for null and without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end, as it is; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=None, part: int = 0) -> Column:
    """The longest rule that fits a host and path, as host and path in one string (part 0) or its verdict (part 1); null if none does."""
    out = F.lit(None).cast("string")
    for verdict, rh, rp in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        out = F.when(fits, F.lit(verdict if part else rh + rp)).otherwise(out)
    return out


def query(url: Column) -> Column:
    """The query with its question mark, up to a hash or the end; empty for null and without one."""
    return F.coalesce(F.regexp_extract(url, "(?s)^[^#?]*(\\?[^#]*)", 1), F.lit(""))


def no_dots(p: Column) -> Column:
    """A path that starts with a slash, without its . and .. segments."""
    first = F.array(F.lit(""))
    kept = F.aggregate(
        F.slice(F.split(p, "/"), 2, F.size(F.split(p, "/"))), first,
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    end = F.when(F.regexp_like(p, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(p, F.lit("/.")), F.concat(F.array_join(kept, "/"), end)).otherwise(p)


def resolve(href: Column, url: Column) -> Column:
    """The absolute form of an address that stands on the page url; null for other schemes (mailto:, javascript:).

    &amp; is read as &; an empty path means the page's own, an empty query with it the page's own query.
    """
    to = F.replace(href, F.lit("&amp;"), F.lit("&"))
    at = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    named, rest = F.regexp_extract(to, "(?s)^([^?#]*)", 1), F.regexp_extract(to, "(?s)^[^?#]*(.*)$", 1)
    own = F.concat(at, F.when(F.startswith(rest, F.lit("?")), F.lit("")).otherwise(query(url)), rest)
    beside = F.concat(no_dots(F.when(F.startswith(named, F.lit("/")), named).otherwise(F.concat(F.regexp_replace(at, "[^/]*$", ""), named))), rest)
    return (
        F.when(F.regexp_like(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), to)
        .when(F.regexp_like(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to))
        .otherwise(F.concat(F.lit("http://"), host(url), F.when(named == "", own).otherwise(beside)))
    )


def alias_key(url: Column) -> Column:
    """What counts as the same address: host, path and query, whatever the scheme and fragment."""
    return F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), query(url))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): each page's address and every canonical or refresh address it names, as alias keys.

    Addresses are resolved against the page's first base address, if it has one, else against its own. A null html names none.
    """
    marked = pages.where(F.col(url_col).contains("://") & (F.lower(html_col).contains("canonical") | F.lower(html_col).contains("refresh")))
    found = F.concat(*[F.regexp_extract_all(html_col, F.lit(x), F.lit(1)) for x in (CANONICAL, REFRESH)])
    base = F.nullif(F.regexp_extract(html_col, BASE, 1), F.lit(""))
    url = F.col("url")
    each = marked.select(F.col(url_col).alias("url"), base.alias("base"), F.explode(found).alias("href"))
    each = each.select("url", F.coalesce(resolve(F.col("base"), url), url).alias("at"), "href")
    each = each.select("url", resolve(F.col("href"), F.col("at")).alias("to")).where("to IS NOT NULL")
    return each.select(alias_key(url).alias("src"), alias_key(F.col("to")).alias("dst"))


def classes(links: DataFrame, rules=None) -> DataFrame:
    """(key, component, class_verdict) of every address with a link: block where some member's own rule blocks it and no member's own rule allows it."""
    parts = connected_components(links, "src", "dst", finish_edges=0)  # no Python on this path
    own = rule(F.regexp_extract("node", "(?s)^([^/?#]*)", 1), F.regexp_extract("node", "(?s)^[^/?#]*([^?]*)", 1), rules, 1)
    judged = stage(parts.withColumn("own", own), "members")
    votes = judged.groupBy("component").agg(F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocks"), F.bool_or(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allows"))
    verdict = F.when(F.col("blocks") & ~F.col("allows"), F.lit("block")).otherwise(F.lit("allow"))
    return stage(judged.join(votes.select("component", verdict.alias("class_verdict")), "component").select(F.col("node").alias("key"), "component", "class_verdict"), "verdicts")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, rules=None) -> DataFrame:
    """(id, host, path, rule, verdict, component): a row for each row of pages.

    A page's own rule decides. Without one, it is blocked if its class of aliases, the connected component over
    canonical links, refreshes and redirects (src, dst addresses), has a blocked member and no allowed one: an explicit
    allow takes precedence. Else it is allowed. Null addresses and those without :// have empty host and path, fit no
    rule, and are aliases of nothing. Repeated rows are judged each. The html is read once, for the links alone.
    """
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.where(F.col("src").contains("://") & F.col("dst").contains("://")).select(alias_key(F.col("src")), alias_key(F.col("dst"))))
    verdicts = classes(links, rules)
    each = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    each = each.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.when(F.col("url").contains("://"), alias_key(F.col("url"))).alias("key"))
    each = each.withColumns({"rule": rule(F.col("host"), F.col("path"), rules), "own": rule(F.col("host"), F.col("path"), rules, 1)})
    return each.join(verdicts, "key", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", "class_verdict", F.lit("allow")).alias("verdict"), "component")
