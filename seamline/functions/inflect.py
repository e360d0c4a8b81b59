"""English table names from class names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Irregular singular and plural forms.
IRREGULAR = {"person": "people", "child": "children", "man": "men", "woman": "women", "mouse": "mice", "foot": "feet", "tooth": "teeth", "goose": "geese", "datum": "data", "medium": "media"}


def _looked_up(word: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, word), otherwise)


def pluralize(word: Column) -> Column:
    rule = F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    return _looked_up(word, IRREGULAR, rule)


def singularize(word: Column) -> Column:
    """The singular; endings -ss, -us and -is are no plurals."""
    rule = F.when(word.rlike(".ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ch|sh|x|z|s)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("s$") & ~word.rlike("(ss|us|is)$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return _looked_up(word, {p: s for s, p in IRREGULAR.items()}, rule)


def underscore(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<=.)([A-Z])", "_$1"))


def _last(name: Column, change) -> Column:
    head = F.regexp_extract(name, "^(.*_)?([^_]*)$", 1)
    return F.concat(head, change(F.regexp_extract(name, "^(.*_)?([^_]*)$", 2)))


def tableize(name: Column) -> Column:
    """OrderItem -> order_items."""
    return _last(underscore(name), pluralize)


def classify(name: Column) -> Column:
    """order_items -> OrderItem."""
    return F.array_join(F.transform(F.split(_last(name, singularize), "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def demodulize(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)
