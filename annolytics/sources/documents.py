"""JSON state documents: reading with defaults, and replacing one panel's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version tag of a state document.
STATE_VERSION = "ocr-stepwise-state-v1"

BOX = ("region_id string, x int, y int, width int, height int, vertical boolean, font_size int, "
       "angle int, source string, computed boolean, forced_orientation string")
STATE_SCHEMA = (
    f"version string, boxes array<struct<{BOX.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, "
    "overrides map<string,string>, detection array<string>"
)
PROGRESS_SCHEMA = "words map<string,struct<seen:int,correct:int>>, panels_completed array<string>"


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing or null columns filled in."""
    return df.withColumns({
        name: F.coalesce(F.col(name), value) if name in df.columns else value
        for name, value in defaults.items()
    })


def read_documents(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """One row per JSON file. A corrupt file becomes a row of defaults, with
    ``corrupt`` true."""
    typed = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    raw = (
        spark.read.schema(typed).option("mode", "PERMISSIVE").option("multiLine", "true")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )
    return with_defaults(raw, defaults).withColumn("corrupt", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def parse_documents(df: DataFrame, column: str, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """The same for JSON held in a column: parsed fields, defaults, ``corrupt``."""
    typed = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = df.withColumn("_doc", F.from_json(F.col(column), typed, options))
    fields = [f.name for f in typed if f.name != "_corrupt_record"]
    flat = parsed.select(*df.columns, *(F.col(f"_doc.{f}").alias(f) for f in fields),
                         F.coalesce(F.col("_doc._corrupt_record").isNotNull() | F.col("_doc").isNull(), F.lit(True)).alias("corrupt"))
    return with_defaults(flat, defaults)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, STATE_SCHEMA, {
        "version": F.lit(STATE_VERSION),
        "boxes": F.array().cast(T.StructType.fromDDL(STATE_SCHEMA)["boxes"].dataType),
        "overrides": F.create_map().cast("map<string,string>"),
        "detection": F.array().cast("array<string>"),
    })


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, PROGRESS_SCHEMA, {
        "words": F.create_map().cast("map<string,struct<seen:int,correct:int>>"),
        "panels_completed": F.array().cast("array<string>"),
    })


def write_stage(df: DataFrame, path: str, key: str = "panel_id") -> None:
    """Replace the artifacts of the panels in ``df``; other panels stay. The
    commit protocol makes each panel's change all or nothing."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key).parquet(path)
    )


def trace_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Trace rows from JSON text: known fields as columns, all others in a map."""
    known = {"scan_id": "string", "stage": "string", "status": "string", "message": "string",
             "ts": "double", "elapsed_ms": "bigint"}
    everything = F.from_json(F.col(column), "map<string,string>")
    return df.withColumn("_all", everything).select(
        *(c for c in df.columns if c != column),
        *(F.try_element_at("_all", F.lit(n)).try_cast(t).alias(n) for n, t in known.items()),
        F.map_filter("_all", lambda k, _v: ~k.isin(*known)).alias("extras"))
