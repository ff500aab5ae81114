"""Table sinks.  Parquet is the default; CSV stays for exchange with other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# Fixed value: rows of an XML file, some tens of megabytes.
XML_RECORDS = 50_000


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header in every part file; list columns are written as JSON text."""
    flat = [
        F.to_json(field.name).alias(field.name) if isinstance(field.dataType, ArrayType) else F.col(f"`{field.name}`")
        for field in df.schema.fields
    ]
    writer = df.select(*flat).write.mode("append" if append else "overwrite")
    writer.option("header", True).option("escape", '"').csv(path)


def write_xml(df: DataFrame, path: str, root: str, row: str, records: int = XML_RECORDS) -> None:
    """XML in files of at most ``records`` rows: a file cannot be split, so one task reads all of it."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).option("maxRecordsPerFile", records).save(path)


def write_transitions(df: DataFrame, path: str, buckets: int = 64) -> dict[str, int]:
    """Transitions in folders by user hash; returns their number, the terminals and the vector widths.

    The rebalance hint lets adaptive execution size the files: small buckets
    are joined, and the bucket of a very active user is split over many tasks.
    The counts are taken while the rows pass by, without a second run.
    """
    shape = Observation("transitions")
    counted = df.observe(
        shape,
        F.count("*").alias("transitions"),
        F.coalesce(F.sum("terminal"), F.lit(0)).cast("long").alias("terminals"),
        F.coalesce(F.max(F.size("observation")), F.lit(0)).alias("observation_width"),
        F.coalesce(F.max(F.size("action")), F.lit(0)).alias("action_width"),
    )
    keyed = counted.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    keyed.hint("rebalance", "user_bucket").write.mode("overwrite").partitionBy("user_bucket").parquet(path)
    return shape.get
