"""The jobs a user runs: review corpus, game table, embeddings, transitions, recommendations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludomill.functions import scalars as S
from ludomill.operators import embeddings as E
from ludomill.operators import evaluate as V
from ludomill.operators import features as Z
from ludomill.operators import normalise as N
from ludomill.operators import resolve as R
from ludomill.operators import reviews as C
from ludomill.operators import transitions as M
from ludomill.sources import readers, sinks


def review_corpus(spark: SparkSession, xml_path: str, summaries: DataFrame, pages: DataFrame, out: str) -> None:
    """Landed feeds to one review table.

    ``summaries``: slug, payload.  ``pages``: author, page, payload.
    """
    feed_a = readers.read_xml_reviews(spark, xml_path)
    feed_b = C.profile_reviews(pages, C.summary_authors(summaries))
    sinks.write_table(C.union_feeds(feed_a, feed_b), out)


def landed_sources(landed: DataFrame) -> Mapping[str, DataFrame]:
    """Normalised hits of all five catalogues from one table of landed payloads.

    Detail objects and game pages are landed under ``rawg_detail`` and
    ``metacritic_page`` with their id or slug as ``query_name``.
    """
    details = N.latest_payloads(landed, "rawg_detail").select(F.col("query_name").cast("long").alias("id"), "payload")
    pages = N.latest_payloads(landed, "metacritic_page").select(F.col("query_name").alias("slug"), "payload")
    return {
        "gamespot": N.xml_game_hits(N.latest_payloads(landed, "gamespot")),
        "rawg": N.rawg_hits(N.latest_payloads(landed, "rawg"), details),
        "igdb": N.igdb_hits(N.latest_payloads(landed, "igdb")),
        "hltb": N.hltb_hits(N.latest_payloads(landed, "hltb")),
        "metacritic": N.metacritic_hits(N.latest_payloads(landed, "metacritic"), pages),
    }


def game_master(reviews: DataFrame, landed: DataFrame, out: str) -> None:
    """Reviewed titles and landed payloads to the game master table."""
    sinks.write_table(R.game_table(reviews, landed_sources(landed)), out)


def more_games(reviews: DataFrame, landed: DataFrame, saved: DataFrame, out: str) -> None:
    """Records for the titles that have none yet, appended; saved ids stay and new ones go on from the largest."""
    sinks.write_table(R.game_table(reviews, landed_sources(landed), saved), out, append=True)


def item_embeddings(reviews: DataFrame, games: DataFrame, out: str) -> None:
    """Games with their collaborative vector; games without enough history are left out.

    ``reviews``: user_id, game_id, rating.
    """
    vectors, _ = E.item_factors(C.user_item_ratings(reviews))
    sinks.write_table(E.attach_vectors(games, vectors.withColumn("vector", S.as_floats("vector")), "game_id"), out)


def item_features(reviews: DataFrame, games: DataFrame, out: str) -> None:
    """The 324-wide item vectors.  ``games``: game_id and the columns of the game master table."""
    described = games.withColumn("_text", F.concat_ws(" ", "description", F.array_join(Z.clean_labels("keywords"), " ")))
    texts = E.description_vectors(described, "game_id", "_text")
    factors, _ = E.item_factors(C.user_item_ratings(reviews))
    features = Z.game_features(games, E.title_vectors(reviews), texts, factors, C.game_scores(reviews))
    sinks.write_table(features.withColumn("vector", S.as_floats("vector")), out)


def genre_transitions(reviews: DataFrame, games: DataFrame, out: str) -> list[str]:
    """Transitions whose actions are genre vectors; returns the genres in vector order.

    ``games``: game_id, genres.
    """
    genres = Z.vocabulary(games, "genres")
    vectors = games.select("game_id", S.multi_hot("genres", genres).alias("vector"))
    sinks.write_transitions(M.transitions(reviews, vectors, len(genres)), out)
    return genres


def feature_transitions(reviews: DataFrame, features: DataFrame, out: str) -> None:
    """Transitions whose actions are the full item vectors."""
    sinks.write_transitions(M.transitions(reviews, features, sum(Z.VECTOR_PARTS.values())), out)


def recommendations(reviews: DataFrame, games: DataFrame, width: int, count: int = V.TOP) -> DataFrame:
    """Best unplayed games per user, by likeness to the mean vector of the games they liked.

    ``games``: game_id, vector, already cut to what the user filters allow.
    """
    liked = reviews.filter(S.ternary_reward("rating") > 0).join(games, "game_id")
    states = V.mean_vector(liked, ["user_id"], "vector", width)
    played = reviews.select(F.col("user_id").alias("query_id"), F.col("game_id").alias("item_id"))
    queries = states.withColumnRenamed("user_id", "query_id")
    return V.best_items(queries, games.withColumnRenamed("game_id", "item_id"), count, excluded=played)
