"""Preparation of the four downloaded tables: filter, drop incomplete rows, project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludomill.sources import schemas
from ludomill.sources.readers import quoted, read_csv


def keep_columns(df: DataFrame, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Rows with no missing value in ``required``, cut to ``columns`` in their order."""
    complete = df.na.drop("any", subset=[f"`{name}`" for name in required]) if required else df
    return complete.select(*[quoted(name) for name in columns])


def load_static_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of ``schemas.STATIC_TABLES`` from its CSV file.

    The play-time table also holds add-ons and bundles; only rows of type
    ``game`` are kept.
    """
    columns = schemas.STATIC_TABLES[table]
    if table == "hltb":
        rows = read_csv(spark, path, {**columns, "type": "string"}).filter(F.col("type") == "game")
    else:
        # Descriptions hold line breaks inside cells.
        rows = read_csv(spark, path, columns, multi_line=table in ("metacritic", "rawg"))
    return keep_columns(rows, list(columns), schemas.STATIC_REQUIRED[table])
