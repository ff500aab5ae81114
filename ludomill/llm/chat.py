"""Collapse logged snapshots of conversations, then render what is left.

A log often holds a conversation several times, each a turn or two longer.  Every
turn gets a hash of all turns up to it; a conversation whose last hash is the hash
of some longer conversation at the same place is a prefix of it and goes.  Equal
conversations keep the smallest id.

The prefix hash of a turn is the exclusive or of two salted 64-bit hashes of
(place, role, text) over the turns so far, so it can be summed over blocks of
``BLOCK`` turn numbers: a conversation with a third of all turns is many tasks.  For
the same reason a conversation is rendered in parts, one per block.

Only built-in functions.  Nulls: a null role or text is the empty text in the
rendering and differs from it in the hash; null turns come first; rows with a
null conv_id are one conversation.  Turns with the same number are ordered by
role and text.  Repeated rows are turns of their own.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludomill.session import settle

BLOCK = 256
_NONE = -(1 << 63)


def _keyed(turns: DataFrame) -> DataFrame:
    turn = F.col("turn").cast("long")
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"),
        F.coalesce(F.floor(turn / BLOCK), F.lit(_NONE)).alias("block"),
        turn.alias("turn"),
        "role",
        "text",
    )


def _or_mark(column: str) -> Column:
    """Nulls apart from every text."""
    return F.coalesce(F.concat(F.lit("a"), F.col(column)), F.lit("n"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, block, place (from 1), n_turns, a, b: the hash of the turns up to each turn."""
    rows = _keyed(turns).select(
        "conv",
        "block",
        "turn",
        "role",
        F.xxhash64(F.lit("one"), _or_mark("role"), _or_mark("text")).alias("h1"),
        F.xxhash64(_or_mark("text"), F.lit("two"), _or_mark("role")).alias("h2"),
    )
    cell = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    whole = Window.partitionBy("conv")
    ahead = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))).select(
        "conv",
        "block",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("n_turns"),
    )
    placed = (
        rows.withColumn("place", F.row_number().over(cell))
        .join(counts, ["conv", "block"])
        .withColumn("place", F.col("place") + F.col("before"))
        .select(
            "conv",
            "block",
            "place",
            "n_turns",
            F.xxhash64("place", "h1").alias("a"),
            F.xxhash64("h2", "place").alias("b"),
        )
    )
    placed = settle(placed)
    blocks = placed.groupBy("conv", "block").agg(F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"))
    blocks = blocks.select(
        "conv",
        "block",
        F.coalesce(F.bit_xor("a0").over(ahead), F.lit(0)).alias("a0"),
        F.coalesce(F.bit_xor("b0").over(ahead), F.lit(0)).alias("b0"),
    )
    so_far = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("a", F.bit_xor("a").over(so_far))
        .withColumn("b", F.bit_xor("b").over(so_far))
        .join(blocks, ["conv", "block"])
        .select(
            "conv",
            "block",
            "place",
            "n_turns",
            F.col("a").bitwiseXOR(F.col("a0")).alias("a"),
            F.col("b").bitwiseXOR(F.col("b0")).alias("b"),
        )
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv, block and copies of the conversations that no longer one begins with."""
    hashes = settle(prefix_hashes(turns))
    whole = hashes.filter("place = n_turns").groupBy("n_turns", "a", "b")
    whole = whole.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    begun = hashes.filter("place < n_turns").select(F.col("place").alias("n_turns"), "a", "b").distinct()
    kept = whole.join(begun, ["n_turns", "a", "b"], "left_anti").select("conv", "copies")
    return hashes.groupBy("conv", "block").agg(F.min("place").alias("first")).join(kept, "conv")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, part, first_turn (its place), n_turns, copies, rendered: maximal conversations as training text."""
    kept = maximal(turns)
    part = F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1
    kept = kept.withColumn("part", part)
    rows = (
        _keyed(turns)
        .withColumn("x", F.struct("turn", "role", "text"))
        .groupBy("conv", "block")
        .agg(F.array_sort(F.collect_list("x")).alias("xs"))
    )
    pieces = F.transform(
        "xs",
        lambda x: F.concat(
            F.lit(start), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(end + "\n")
        ),
    )
    return kept.join(rows, ["conv", "block"]).select(
        F.nullif("conv", F.lit(_NONE)).alias("conv_id"),
        F.col("part").cast("long").alias("part"),
        F.col("first").cast("long").alias("first_turn"),
        F.size("xs").cast("long").alias("n_turns"),
        "copies",
        F.array_join(pieces, "").alias("rendered"),
    )
