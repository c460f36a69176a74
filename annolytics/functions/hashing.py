"""Keys, slugs and fingerprints as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_text(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def region_id(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Id from geometry: 'region_' and ten hex digits of md5('x:y:w:h')."""
    raw = F.concat_ws(":", *(c.cast("string") for c in (x, y, width, height)))
    return F.concat(F.lit("region_"), F.substring(md5_text(raw), 1, 10))


def box_signature(x: Column, y: Column, width: Column, height: Column, vertical: Column, forced: Column) -> Column:
    """Digest of geometry and orientation; equal boxes give equal digests."""
    raw = F.concat_ws(
        ":", *(c.cast("string") for c in (x, y, width, height)),
        F.coalesce(vertical, F.lit(False)).cast("string"), F.coalesce(forced, F.lit("")),
    )
    return md5_text(raw)


def safe_component(text: Column, default: str) -> Column:
    """Letters, digits, dot, dash and underscore only, without outer dots or underscores."""
    cleaned = F.btrim(F.regexp_replace(F.btrim(text), "[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lit(default))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def panel_slug(path: Column) -> Column:
    """Readable stem and eight hex digits of the md5 of the whole path."""
    stem = safe_component(file_stem(file_name(path)), "panel")
    return F.concat(stem, F.lit("-"), F.substring(md5_text(path), 1, 8))


def lookup_key(text: Column, reading: Column) -> Column:
    """Cache key of a word: the text, and its reading when there is one."""
    word, hint = F.btrim(text), F.btrim(F.coalesce(reading, F.lit("")))
    return F.when(F.length(hint) > 0, F.concat_ws("::", word, hint)).otherwise(word)


def options_digest(options: dict[str, Column]) -> Column:
    """Digest of named options, in name order; callers fill defaults first."""
    parts = F.struct(*(options[name].alias(name) for name in sorted(options)))
    return md5_text(F.to_json(parts, {"ignoreNullFields": "false"}))


def _hex_number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def bag_digest(row: Column) -> Column:
    """Digest of a group of row texts, as one aggregate.

    Each row's md5 gives two 60-bit numbers, and the group's digest is the md5
    of the row count and the two sums (an additive multiset hash). Sums combine
    on the map side, so a hot group is never gathered; put the position into
    ``row`` when order matters.
    """
    digest = md5_text(row)
    summed = [F.sum(_hex_number(digest, start)).cast("string") for start in (1, 16)]
    return md5_text(F.concat_ws(":", F.count(row).cast("string"), *summed))
