"""Item vectors: collaborative factors, description vectors and title vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludomill.operators.company import mean_vectors, word_rows, word_vectors
from ludomill.operators.ordered import in_chunks, last_per_key, totals_before
from ludomill.session import settle

# Fixed values.
FACTORS = 32
WORD_WIDTH = 128
SENTENCE_WORDS = 1000

# Histories have fewer kinds of company than language; what is above chance counts in full.
TITLE_SHIFT = 1.0

# Subspace iteration: further columns kept beside the wanted ones, and rounds.
EXTRA = 8
ROUNDS = 5


def _sum_product(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Sum of rating x vector per ``key``, one column a dimension so that partial sums meet before the shuffle."""
    sums = [F.sum(F.col("rating") * F.get("vector", F.lit(i))).alias(f"_s{i}") for i in range(width)]
    return rows.groupBy(key).agg(*sums).select(key, F.array(*[f"_s{i}" for i in range(width)]).alias("vector"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of ``vector`` with itself: width x width numbers, whatever the rows."""

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            part = np.stack(batch["vector"].to_numpy()) if len(batch) else np.zeros((0, width))
            total += part.T @ part
        yield pd.DataFrame({"cell": np.arange(width * width), "value": total.ravel()})

    cells = rows.select("vector").mapInPandas(partial, "cell long, value double").groupBy("cell").agg(F.sum("value"))
    out = np.zeros(width * width)
    for cell, value in cells.collect():
        out[cell] = value
    return out.reshape(width, width)


def _rotated(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """``vector`` times a small matrix."""

    def turn(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "vector": list(np.stack(batch["vector"].to_numpy()) @ matrix)})

    return rows.select(key, "vector").mapInPandas(turn, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


def _root(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes vectors with this Gram matrix orthonormal; directions without length are left out."""
    lengths, axes = np.linalg.eigh(gram)
    kept = lengths > max(lengths.max(), 0.0) * 1e-12
    return axes[:, kept] / np.sqrt(lengths[kept])


def item_factors(
    ratings: DataFrame, count: int = FACTORS, scaled: bool = False, rounds: int = ROUNDS
) -> tuple[DataFrame, list[float]]:
    """Right singular vectors of the user x item matrix, one vector per item, and the singular values.

    ``ratings``: user_id, game_id, rating, one row per pair; absent pairs are
    zeros.  Subspace iteration over the long table: a round is two joins with
    sums and one orthonormalisation; the vectors stay a table and only matrices
    of (count + EXTRA) squared numbers come to the driver.  The start is a hash
    of the item, so runs agree.  Each factor is signed so that its largest entry
    is positive.
    """
    known = settle(ratings.na.drop("any", subset=["user_id", "game_id", "rating"]).select(
        "user_id", "game_id", F.col("rating").cast("double").alias("rating")))
    width = count + EXTRA
    start = [F.pmod(F.xxhash64("game_id", F.lit(i)), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1 for i in range(width)]
    items = settle(known.select("game_id").distinct().select("game_id", F.array(*start).alias("vector")))

    def orthonormal(rows: DataFrame) -> tuple[DataFrame, int]:
        turn = _root(_gram(rows, width))
        return settle(_rotated(rows, "game_id", turn)), turn.shape[1]

    def users(rows: DataFrame) -> DataFrame:
        return settle(_sum_product(known.join(rows, "game_id"), "user_id", width))

    items, width = orthonormal(items)
    if not width:
        return items, []
    seen = users(items)
    for _ in range(rounds):
        items, width = orthonormal(settle(_sum_product(known.join(seen, "user_id"), "game_id", width)))
        seen = users(items)
    # The axes of what the matrix makes of the subspace are the singular vectors within it.
    lengths, axes = np.linalg.eigh(_gram(seen, width))
    best = np.argsort(-lengths)[: min(count, width)]
    values = np.sqrt(np.maximum(lengths[best], 0.0))
    factors = settle(_rotated(items, "game_id", axes[:, best]))
    ends = [F.struct(F.min(F.get("vector", F.lit(i))), F.max(F.get("vector", F.lit(i)))) for i in range(len(best))]
    signs = np.array([-1.0 if -low > high else 1.0 for low, high in factors.agg(*ends).first()])
    return _rotated(factors, "game_id", np.diag(signs * (values if scaled else 1.0))), values.tolist()


def attach_vectors(games: DataFrame, vectors: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    """Games with their vector; games without one are dropped unless ``keep_missing``.

    Several games may share a key and so a vector; of several vectors of a key the largest counts.
    """
    return games.join(last_per_key(vectors, [key], ["vector"]), key, "left" if keep_missing else "inner")


def words(text: Column | str) -> Column:
    """Lower-case words of a text."""
    body = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def description_vectors(texts: DataFrame, key: str, text: str, width: int = WORD_WIDTH) -> DataFrame:
    """``key, vector, n_words``: the mean word vector of each whole text, learned from the same texts."""
    tokenised = settle(texts.select(key, F.coalesce(words(text), F.array().cast("array<string>")).alias("words")))
    rows, turn = word_rows(tokenised, width)
    return mean_vectors(tokenised, rows, key, width, turn=turn)


def play_sentences(reviews: DataFrame) -> DataFrame:
    """Each user's games in time order, cut every ``SENTENCE_WORDS`` games.

    The training cuts sentences at that length anyway, so a very active user
    need not be collected into one row.
    """
    history = reviews.select("user_id", "game_id", "ts", "review_id").na.drop("any", subset=["user_id", "game_id"])
    order = ["ts", "review_id"]
    placed = totals_before(in_chunks(history, ["user_id", *order]), ["user_id"], order, {"place": F.lit(1)})
    part = F.floor(F.col("place") / SENTENCE_WORDS).alias("part")
    games = F.array_sort(F.collect_list(F.struct("place", F.col("game_id").cast("string").alias("game"))))
    grouped = placed.groupBy("user_id", part).agg(games.alias("games"))
    return grouped.select("user_id", "part", F.transform("games", lambda g: g["game"]).alias("words"))


def title_vectors(reviews: DataFrame, width: int = WORD_WIDTH) -> DataFrame:
    """One vector per game from the company it keeps in play histories: ``game_id, vector``.

    A game that keeps no company beyond chance has a vector of zeros.
    """
    vectors = word_vectors(settle(play_sentences(reviews).select("words")), width, shift=TITLE_SHIFT)
    games = reviews.na.drop("any", subset=["user_id", "game_id"]).select("game_id").distinct()
    found = games.withColumn("word", F.col("game_id").cast("string")).join(vectors, "word", "left")
    return found.select("game_id", F.coalesce("vector", F.array_repeat(F.lit(0.0), width)).alias("vector"))
