"""Mix sources to target weights by systematic sampling.

Every source gets a share of the words by its weight, up to ``most`` times what
it has; what is above goes to the others by weight.  Within a source each
document is expected ``target / source_size`` times.  The expectations are
summed along the source's documents, a fixed offset per source is added, and a
document is emitted once for each whole number its interval crosses.  Documents
run in the order of their size, so the words taken stay within about one
document of the target.

Ranks within a source never need one task per source: a source is cut by size,
each size by a salt of 12 bits, and offsets are summed over these cells.

Nulls: a null text has size 0, a null source is a source of its own (last), a
null id sorts as the empty text, rows of one id by a hash of their text.  Empty tables give empty results.  Repeated
rows are documents of their own.  Other columns are carried along; helper
columns are named ``_mix_*`` and are gone from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludomill.llm.words import WORD
from ludomill.session import settle

WEIGHTS = (5, 2, 1)
_CELL = ["_mix_key", "_mix_size", "_mix_salt"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets of sources from rows (_mix_key, source_size); one row per source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("_mix_key").startswith("n"), "_mix_key")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    ratio = Window.orderBy("_mix_ratio", "_mix_key")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = ratio.rowsBetween(0, Window.unboundedFollowing)
    # With the sources that fill up first left at their caps, the level of the rest is highest at the right cut.
    return (
        sizes.withColumn("_mix_weight", weight)
        .withColumn("_mix_ratio", F.col("source_size") * F.lit(float(most)) / F.col("_mix_weight"))
        .withColumn("_mix_all", F.sum("source_size").over(everything))
        .withColumn("_mix_below", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_mix_rest", F.sum("_mix_weight").over(onward))
        .withColumn(
            "_mix_level", (F.col("_mix_all") * F.lit(share) - F.col("_mix_below") * F.lit(float(most))) / F.col("_mix_rest")
        )
        .withColumn("_mix_level", F.max("_mix_level").over(everything))
        .select(
            "_mix_key",
            "source_size",
            F.least(F.col("source_size") * F.lit(float(most)), F.col("_mix_weight") * F.col("_mix_level")).alias("target"),
        )
    )


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """``docs`` with _mix_size, _mix_total, _mix_target and _mix_copies."""
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = (
        docs.withColumn("_mix_key", F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("n")))
        .withColumn("_mix_size", n_words(F.col("text")))
        .withColumn("_mix_name", name)
        .withColumn("_mix_salt", F.substring("_mix_name", 1, 3))
    )
    cells = settle(rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_mix_n")))
    by_size = cells.groupBy("_mix_key", "_mix_size").agg(F.sum("_mix_n").alias("_mix_n"))
    ahead = Window.partitionBy("_mix_key").orderBy("_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    sources = by_size.groupBy("_mix_key").agg(F.sum(F.col("_mix_size") * F.col("_mix_n")).alias("source_size"))
    by_size = by_size.select(
        "_mix_key", "_mix_size", F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)).alias("_mix_smaller")
    ).join(source_targets(sources, weights, share, most), "_mix_key")
    within = Window.partitionBy("_mix_key", "_mix_size").orderBy("_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(within), F.lit(0)))
        .join(by_size, ["_mix_key", "_mix_size"])
        .select(
            *_CELL,
            F.col("source_size").alias("_mix_total"),
            F.col("target").alias("_mix_target"),
            (F.col("_mix_before") + F.col("_mix_smaller")).alias("_mix_before"),
        )
    )
    # Different texts without an id, or with one, have an order of their own, so reruns agree.
    place = F.row_number().over(Window.partitionBy(*_CELL).orderBy("_mix_name", "doc_id", F.xxhash64("text")))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_mix_key")).cast("binary")), 1, 8), 16, 10)
    start = unit.cast("double") / F.lit(4294967296.0)
    each = F.when(F.col("_mix_total") > 0, F.col("_mix_target") / F.col("_mix_total")).otherwise(F.lit(0.0))
    to = F.col("_mix_before") + F.col("_mix_place")
    return (
        rows.withColumn("_mix_place", place)
        .join(offsets, _CELL)
        .withColumn("_mix_copies", F.floor(to * each + start) - F.floor((to - 1) * each + start))
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the row).

    Columns of these names are replaced.
    """
    added = {"size": "_mix_size", "source_size": "_mix_total", "target": "_mix_target", "copies": "_mix_copies"}
    columns = [c for c in docs.columns if c not in added]
    return _mixed(docs, weights, share, most, seed).select(*columns, *[F.col(c).alias(n) for n, c in added.items()])


def take(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    mixed = _mixed(docs, weights, share, most, seed).filter("_mix_copies > 0")
    mixed = mixed.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return mixed.select(*docs.columns)
