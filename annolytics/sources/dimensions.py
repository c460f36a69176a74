"""Small tables the caller brings: glossaries, grammar, signs, source catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

WORD_NOTES = "word string, label string, notes array<string>, tags array<string>"
CATALOG = "source_id string, name string, dataset string, url string, license string, version string"


def glossary(spark: SparkSession, glosses: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(glosses.items()), "word string, gloss string")


def word_notes(spark: SparkSession, notes: Mapping[str, Mapping]) -> DataFrame:
    """Grammar or sign table from word -> {label, glosses, tags}."""
    rows = [(w, n.get("label"), list(n.get("glosses", [])), list(n.get("tags", []))) for w, n in notes.items()]
    return spark.createDataFrame(rows, WORD_NOTES)


def source_catalog(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Catalog of data sources and their licences."""
    names = [part.split()[0] for part in CATALOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CATALOG)
