"""Catalogs of media files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.functions.hashing import file_name
from annolytics.plans.skew import ordered_index

# Media suffixes.
MEDIA_SUFFIXES = ("jpg", "jpeg", "png")
MEDIA_GLOB = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def media_files(spark: SparkSession, root: str, glob: str = MEDIA_GLOB) -> DataFrame:
    """path, filename and size of the files below one root. File contents are
    not selected, so the source does not read them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", file_name(F.col("path")).alias("filename"), F.col("length").alias("size"))


def listed_media(listing: DataFrame, suffixes: Iterable[str] = MEDIA_SUFFIXES) -> DataFrame:
    """path, filename and size of those rows of a listing (path, size) whose file
    name has one of the suffixes, in upper or lower case. Null paths are dropped."""
    named = listing.select("path", file_name(F.col("path")).alias("filename"), "size")
    ending = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return named.where(ending.isin(*suffixes))


def media_catalog(spark: SparkSession, roots: Mapping[str, str], glob: str = MEDIA_GLOB) -> DataFrame:
    """Files of several roots (kind -> folder), tagged with their kind."""
    parts = [media_files(spark, root, glob).withColumn("kind", F.lit(kind)) for kind, root in roots.items()]
    catalog = parts[0]
    for part in parts[1:]:
        catalog = catalog.unionByName(part)
    return catalog


def sorted_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("filename", "kind", "path")


def union_catalogs(originals: DataFrame, uploads: DataFrame) -> DataFrame:
    """Both catalogs; ``shown`` marks the one file a lookup by name finds: the
    original before an upload, then the lowest path, of files with one path the
    smallest by the other columns. Files without a name share a null one."""
    both = originals.withColumn("kind", F.lit("original")).unionByName(uploads.withColumn("kind", F.lit("uploaded")))
    rest = [c for c in both.columns if c not in ("filename", "kind", "path")]
    # Null paths come last.
    order = ["kind", F.col("path").asc_nulls_last(), *rest]
    return ordered_index(both, ["filename"], order, "_place").withColumn("shown", F.col("_place") == 1).drop("_place")


# Files a recogniser model folder needs.
REQUIRED_FILES = (
    "config.json", "preprocessor_config.json", "pytorch_model.bin",
    "special_tokens_map.json", "tokenizer_config.json", "vocab.txt",
)


def missing_required_files(required: DataFrame, catalog: DataFrame) -> DataFrame:
    """Required names that are absent from the catalog or empty."""
    present = catalog.where(F.col("size") > 0).select("filename").distinct()
    return required.select("filename").join(present, "filename", "left_anti")


def required_files(spark: SparkSession, names: Iterable[str] = REQUIRED_FILES) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "filename string")
