"""Scans of landed files: CSV, XML and JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludomill.sources import schemas

# Cell texts that count as missing in the CSV files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def quoted(name: str) -> Column:
    """A column whose name may hold dots, slashes or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def known_text(value: Column) -> Column:
    """Null for every spelling of a missing cell."""
    return F.when(~value.isin(MISSING_TEXTS), value)


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], multi_line: bool = False) -> DataFrame:
    """The named columns of CSV files with a header, typed, missing cells as null.

    Columns are found by header name, cells that do not fit their type become
    null.  ``multi_line`` is for files with line breaks inside cells; such files
    cannot be split, so land them in many pieces.
    """
    cells = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return cells.select(*[known_text(quoted(name)).try_cast(kind).alias(name) for name, kind in columns.items()])


def listed_cell(cell: Column | str) -> Column:
    """A list written as text, such as ``['PC', "Director's Cut"]``, back as an array."""
    text = F.col(cell) if isinstance(cell, str) else cell
    pattern = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|None"""
    items = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def unquote(item: Column) -> Column:
        inner = F.substring(item, F.lit(2), F.length(item) - 2)
        return F.when(item != "None", F.regexp_replace(inner, r"\\(.)", "$1"))

    return F.transform(items, unquote)


def read_xml_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Feed A: every ``<review>`` at any depth; a missing score is 0."""
    rows = spark.read.format("xml").option("rowTag", "review").schema(schemas.XML_REVIEW).load(path)
    return rows.select(
        "authors",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("game.name").alias("game_name"),
        "publish_date",
    )


def read_xml_games(spark: SparkSession, path: str) -> DataFrame:
    """Every ``<game>`` at any depth as a raw record for ``normalise.xml_game``."""
    return spark.read.format("xml").option("rowTag", "game").schema(schemas.XML_GAME).load(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed payloads, one row per (source, query, fetch)."""
    return spark.read.schema(schemas.LANDED).parquet(path)
