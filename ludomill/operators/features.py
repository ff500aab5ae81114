"""Encoders, scalers and the item feature vector."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludomill.functions import scalars as S

# The parts of the item vector and their widths, 324 in all.
VECTOR_PARTS = {
    "title": 128,
    "description": 128,
    "genres": 20,
    "year": 1,
    "platform": 10,
    "hours": 3,
    "critics": 1,
    "users": 1,
    "collaborative": 32,
}


def clean_labels(labels: Column | str) -> Column:
    """A bag of labels as a set without nulls and empty texts."""
    bag = F.col(labels) if isinstance(labels, str) else labels
    return F.array_distinct(F.filter(F.coalesce(bag, S.no_texts()), lambda x: x.isNotNull() & (x != "")))


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """Number of rows per label."""
    return df.select(F.explode(clean_labels(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, labels: str) -> list[str]:
    """All distinct labels in sorted order, for use as vector positions.

    A vector needs its width before the job starts, so the labels come to the
    driver: as many as the vector is wide, none left out.  ``multi_hot_rows`` is
    the form for labels that make no vector.
    """
    return sorted(row.label for row in label_counts(df, labels).select("label").collect())


def frequent_labels(df: DataFrame, labels: str, count: int) -> list[str]:
    """The ``count`` most frequent labels, equals in label order."""
    top = label_counts(df, labels).orderBy(F.desc("n"), "label").limit(count)
    return [row.label for row in top.collect()]


def multi_hot_rows(df: DataFrame, key: str, labels: str) -> DataFrame:
    """The ones of a multi-hot encoding in long form, for vocabularies of any size."""
    return df.select(key, F.explode(clean_labels(labels)).alias("label"))


def scaled_to_unit(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """``column`` min-max scaled to 0..1; a constant column becomes 0.5.

    The bounds are one scalar subquery: no extra join, no driver round trip.
    """
    bounds = df.select(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    value, low, high = F.col(column).cast("double"), bounds["low"], bounds["high"]
    scaled = F.when(value.isNotNull(), F.coalesce(F.try_divide(value - low, high - low), F.lit(0.5)))
    return df.withColumn(name or column, scaled)


def scaled_to_signed(df: DataFrame, vector: str, width: int, name: str) -> DataFrame:
    """Each dimension of ``vector`` min-max scaled to -1..1; constant dimensions become 0."""
    spans = [F.struct(F.min(F.get(vector, F.lit(i))), F.max(F.get(vector, F.lit(i)))) for i in range(width)]
    # One row with one (low, high) pair per dimension.
    bounds = df.select(F.array(*[s.cast("struct<low:double,high:double>") for s in spans])).scalar()
    # The subquery has to be a column of its own before a lambda may read it.
    bounded = df.withColumn("_bounds", bounds)
    scaled = F.zip_with(
        vector,
        "_bounds",
        lambda x, b: F.coalesce(F.try_divide(2 * (x - b["low"]), b["high"] - b["low"]) - 1, F.lit(0.0)),
    )
    return bounded.withColumn(name, scaled).drop("_bounds")


def platform_vector(games: DataFrame, platforms: str = "platforms", count: int = 10) -> tuple[Column, list[str]]:
    """Vector over the most frequent platforms: several ones if a game runs on several."""
    names = frequent_labels(games, platforms, count)
    return S.multi_hot(clean_labels(platforms), names), names


def hours_vector(main: str = "main_story", extra: str = "main_extra", full: str = "completionist") -> Column:
    """Three saturating play times; unknown hours are 0."""
    return F.array(*[S.saturating_hours(F.coalesce(F.col(c), F.lit(0.0))) for c in (main, extra, full)])


def _padded(vector: Column, width: int, name: str) -> Column:
    """Zeros for a missing part and behind a short one; a longer one is an error."""
    zeros = F.array_repeat(F.lit(0.0), width)
    known = F.coalesce(vector.cast("array<double>"), zeros)
    wrong = F.raise_error(F.lit(f"part {name} is wider than {width}")).cast("array<double>")
    return F.when(F.size(known) > width, wrong).otherwise(F.slice(F.concat(known, zeros), 1, width))


def game_features(
    games: DataFrame,
    title_vectors: DataFrame,
    text_vectors: DataFrame,
    item_vectors: DataFrame,
    user_scores: DataFrame,
) -> DataFrame:
    """The item vector: every part of ``VECTOR_PARTS`` in order, missing parts as zeros.

    ``games`` has ``game_id`` and the columns of the game master table; the
    vectors are ``game_id, vector``; ``user_scores`` is ``game_id, user_score``.
    """
    genres = frequent_labels(games, "genres", VECTOR_PARTS["genres"])
    platforms, _ = platform_vector(games, count=VECTOR_PARTS["platform"])
    rows = games.withColumn("_year", S.release_year("release"))
    rows = rows.join(user_scores.select("game_id", "user_score"), "game_id", "left")
    for column in ("_year", "metacritic_rating", "user_score"):
        rows = scaled_to_unit(rows, column, f"_unit_{column}")
    for mark, vectors in (("_title", title_vectors), ("_text", text_vectors), ("_item", item_vectors)):
        rows = rows.join(vectors.select("game_id", F.col("vector").alias(mark)), "game_id", "left")
    parts: Mapping[str, Column] = {
        "title": F.col("_title"),
        "description": F.col("_text"),
        "genres": S.multi_hot(clean_labels("genres"), genres),
        "year": F.array(F.coalesce("_unit__year", F.lit(0.0))),
        "platform": platforms,
        "hours": hours_vector(),
        "critics": F.array(F.coalesce("_unit_metacritic_rating", F.lit(0.0))),
        "users": F.array(F.coalesce("_unit_user_score", F.lit(0.0))),
        "collaborative": F.col("_item"),
    }
    vector = F.concat(*[_padded(parts[name], width, name) for name, width in VECTOR_PARTS.items()])
    return rows.select("game_id", vector.alias("vector"))


def part_range(name: str) -> tuple[int, int]:
    """First position and width of a part within the item vector."""
    start = 0
    for part, width in VECTOR_PARTS.items():
        if part == name:
            return start, width
        start += width
    raise KeyError(name)
