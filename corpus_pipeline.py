"""Documents to packed training batches: quality, near copies, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.  Nulls, empty tables, repeated
rows and more columns are handled as the operators state.  Rows that repeat an id
and a text count as one document in the second stage; different texts never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludomill.llm import jaccard, mixing, packing, pii, quality
from ludomill.llm.words import WORD
from ludomill.session import settle

# Near copies share this percentage of the runs of so many words; op6 has its own bar.
NEAR_PERCENT = 80
NEAR_WIDTH = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are close to a language reference."""
    return quality.judge(docs, prefix="_rule_").filter("_rule_kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; texts without words all stay.

    Of texts of one set and id the one with the least hash stays, of equal ones the first by source and language.
    """
    found = jaccard.firsts(docs, NEAR_PERCENT, NEAR_WIDTH).select(F.col("rep").alias("_near_rep"), F.col("hash").alias("_near_hash"))
    wordless = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    rep = F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard._NONE))
    rows = docs.filter(~wordless).withColumns({"_near_rep": rep, "_near_hash": F.xxhash64("text")})
    rows = rows.join(found, ["_near_rep", "_near_hash"], "left_semi")
    # Rows that repeat an id and a text; different texts are never one group.
    first = F.min_by(F.struct(*docs.columns), F.struct("source", "lang")).alias("_near_row")
    rows = rows.groupBy("_near_rep", "_near_hash", F.col("text").alias("_near_text")).agg(first).select("_near_row.*")
    return docs.filter(wordless).unionByName(rows)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data, plain or disguised, replaced by its kind; n_chars follows."""
    return pii.find(docs, redacted=True, spans=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

# Divergences, disguises and best boundaries are not SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
