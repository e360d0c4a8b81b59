"""Tables that raw SQL in source text writes and reads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Statements and command-builder calls that name a table, possibly quoted or in {{ }}.
WRITE = r"""(?i)\b(?:INSERT(?:\s+IGNORE)?\s+INTO|UPDATE|DELETE\s+FROM|REPLACE\s+INTO)\s+[`"']?\{?\{?[a-zA-Z0-9_$]+"""
BUILDER_WRITE = r"""->\s*(?:insert|update|delete)\(\s*['"]\{?\{?([a-zA-Z0-9_$]+)\}?\}?['"]"""
READ = r"""(?i)\b(?:DELETE\s+)?(?:FROM|JOIN)\s+[`"']?\{?\{?[a-zA-Z0-9_$]+"""
BUILDER_READ = r"""->\s*(?:from|join|leftJoin|rightJoin)\(\s*['"]\{?\{?([a-zA-Z0-9_$]+)"""
COMMENTS = r"(?s)/\*.*?\*/|(?m)//[^\n]*$|(?m)^\s*#[^\n]*$"


def _names(found: Column) -> Column:
    return F.transform(found, lambda m: F.lower(F.regexp_extract(m, r"([a-zA-Z0-9_$]+)$", 1)))


def _sorted(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def written_tables(source: Column) -> Column:
    """Lower-cased, distinct and sorted. UPDATE is also an English word, so it needs a quote, a brace or an underscore in the name."""
    found = F.filter(F.regexp_extract_all(source, F.lit(WRITE), 0), lambda m: ~m.rlike("(?i)^update") | m.rlike("""[`"'{]|_"""))
    return _sorted(_names(found), F.transform(F.regexp_extract_all(source, F.lit(BUILDER_WRITE), 1), F.lower))


def read_tables(source: Column) -> Column:
    """Those of FROM and JOIN outside comments; DELETE FROM is no read."""
    text = F.regexp_replace(source, COMMENTS, " ")
    found = F.filter(F.regexp_extract_all(text, F.lit(READ), 0), lambda m: ~m.rlike("(?i)^delete"))
    return _sorted(_names(found), F.transform(F.regexp_extract_all(text, F.lit(BUILDER_READ), 1), F.lower))
