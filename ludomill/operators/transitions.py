"""(state, action, reward, terminal) rows out of ordered user histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludomill.functions import scalars as S
from ludomill.operators.ordered import LAST, chunk_count, in_chunks, last_per_key, means_before
from ludomill.operators.reviews import one_review_per_pair
from ludomill.session import settle

# Ids of games that may be sent to every task: 8 MB of numbers.
BROADCAST_IDS = 1 << 20


def transitions(
    reviews: DataFrame,
    games: DataFrame,
    width: int,
    terminal: str = "reference",
    repeats: str = "all",
    ordered_by_time: bool = True,
    games_order: Sequence[str] = ("vector",),
) -> DataFrame:
    """One row per review of a known game, in user and time order.

    ``reviews``: review_id, user_id, game_id, rating, ts.  ``games``: game_id,
    vector (``width`` doubles); the vector is the action.  The observation is
    the mean of the user's earlier action vectors, zeros at first.

    ``terminal="reference"`` marks the user's last review even before unknown
    games are left out, so a user who ends on an unknown game has no terminal
    row; ``"last_kept"`` marks the last row that is left.  ``repeats`` says what
    to do with several reviews of one game: keep ``all``, or join by ``max`` or
    ``mean``.  Without time order the review id orders a history.  Of several rows
    of a game the last by ``games_order`` counts.
    """
    if terminal not in ("reference", "last_kept"):
        raise ValueError(f"unknown terminal mode {terminal!r}")
    order = ["ts", "review_id"] if ordered_by_time else ["review_id"]
    narrow = reviews.select("review_id", "user_id", "game_id", "rating", *order[:-1]).filter("user_id is not null")
    history = one_review_per_pair(narrow, repeats, order)
    if terminal == "last_kept":
        history = history.join(games.select("game_id"), "game_id", "left_semi")

    # Narrow rows are cut into chunks; of the wide vectors only those of reviewed games are looked at.
    chunked = in_chunks(history, ["user_id", *order], chunk_count(history, width))
    reviewed = settle(chunked.select("game_id").distinct())
    if reviewed.count() <= BROADCAST_IDS:
        reviewed = F.broadcast(reviewed)
    known = settle(unique_vectors(games.join(reviewed, "game_id", "left_semi"), games_order))
    scanned = means_before(chunked, known, "game_id", ["user_id"], order, width)
    return scanned.select(
        "user_id",
        (F.col("_seen") + 1).cast("int").alias("step"),
        "review_id",
        F.col("_mean").alias("observation"),
        F.col("_own").alias("action"),
        S.scaled_reward("rating").cast("float").alias("reward"),
        F.col(LAST).cast("float").alias("terminal"),
    )


def unique_vectors(games: DataFrame, order: Sequence[str]) -> DataFrame:
    """One vector per game: of repeated ids the last by ``order`` counts, as in an overwriting lookup."""
    return last_per_key(games, ["game_id"], list(order)).select("game_id", "vector")


def dataset_shape(rows: DataFrame) -> DataFrame:
    """Number of transitions, users and terminals, and the widths of the vectors."""
    return rows.agg(
        F.count("*").alias("transitions"),
        F.count_distinct("user_id").alias("users"),
        F.sum("terminal").cast("long").alias("terminals"),
        F.max(F.size("observation")).alias("observation_width"),
        F.max(F.size("action")).alias("action_width"),
    )
