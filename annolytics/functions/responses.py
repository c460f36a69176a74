"""Tolerant reading of model answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def parsed_json(raw: Column) -> Column:
    """Variant of the whole text, else of the part from the first { to the last
    }, else from the first [ to the last ]; null when nothing parses."""
    text = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n"))
    return F.coalesce(
        F.try_parse_json(F.nullif(text, F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))),
    )


def _field(item: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_variant_get(item, f"$.{n}", "string"), F.lit("")) for n in names))


def numbered_items(raw: Column) -> Column:
    """Texts of lines such as '1. text', '2) text' or '3: text'."""
    return F.regexp_extract_all(raw, F.lit(r"(?m)^[ \t]*[0-9]+[.):][ \t]*(\S(?:.*\S)?)[ \t]*$"), 1)


def response_parts(raw: Column) -> Column:
    """Struct of ``by_id`` (map or null) and ``by_place`` (array).

    Objects with an id, under "translations", give the map; any other object
    gives its text members; arrays, and arrays of plain texts under
    "translations", go by place; so do numbered lines when there is no JSON.
    """
    def of(value: Column) -> Column:
        listed = F.try_variant_get(value, "$.translations", "array<variant>")
        plain = F.forall(listed, lambda i: ~F.schema_of_variant(i).startswith("OBJECT"))
        named = F.filter(
            F.transform(listed, lambda i: F.struct(
                _field(i, "id", "region_id").alias("key"),
                _field(i, "translation", "translated", "text").alias("value"))),
            lambda e: e["key"].isNotNull() & e["value"].isNotNull())
        is_object = F.schema_of_variant(value).startswith("OBJECT")
        members = F.map_filter(
            F.when(is_object, F.try_variant_get(value, "$", "map<string,variant>")),
            lambda k, v: (k != "translations") & (F.schema_of_variant(v) == "STRING"))
        texts = F.transform(F.map_entries(members), lambda e: F.struct(
            e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
        pairs = F.when(listed.isNotNull() & ~plain, named).when(listed.isNull() & (F.size(texts) > 0), texts)
        places = F.coalesce(
            F.try_variant_get(value, "$", "array<string>"),
            F.when(plain & (F.size(listed) > 0), F.transform(listed, lambda i: F.try_variant_get(i, "$", "string"))),
            numbered_items(raw),
        )
        return F.struct(pairs.alias("pairs"), places.cast(_STRINGS).alias("by_place"))

    return F.element_at(F.transform(F.array(parsed_json(raw)), of), 1)


def aligned_translations(parts: Column, ids: Column) -> Column:
    """One text per id, '' where the answer has none. A repeated id keeps its last text."""
    def by_id(key: Column) -> Column:
        hits = F.filter(parts["pairs"], lambda p: p["key"] == key)
        return F.try_element_at(hits, F.lit(-1))["value"]

    return F.transform(ids, lambda key, i: F.coalesce(
        F.when(parts["pairs"].isNotNull(), by_id(key)).otherwise(F.get(parts["by_place"], i)), F.lit("")))
