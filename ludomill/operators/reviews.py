"""The review corpus: two feeds, cleaned and put under one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludomill.operators.ordered import first_per_key, last_per_key
from ludomill.sources import schemas

FEED_A_NAMES = {"authors": "author", "publish_date": "date"}


def union_feeds(feed_a: DataFrame, feed_b: DataFrame) -> DataFrame:
    """Feed A renamed, then feed B without repeated rows; columns only B has are null for A."""
    return feed_a.withColumnsRenamed(FEED_A_NAMES).unionByName(feed_b.distinct(), allowMissingColumns=True)


def repeated_rows(df: DataFrame) -> DataFrame:
    """Every fully repeated row with the number of copies beyond the first."""
    counted = df.groupBy(*df.columns).agg((F.count("*") - 1).alias("extra_copies"))
    return counted.filter("extra_copies > 0")


def repeat_report(df: DataFrame, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """How many rows are repeats of an earlier one, and the first few of them."""
    repeats = repeated_rows(df)
    total = repeats.agg(F.coalesce(F.sum("extra_copies"), F.lit(0)).alias("duplicate_rows"))
    return total, repeats.orderBy(*df.columns).limit(sample)


def active_authors(reviews: DataFrame, at_least: int = 3, author: str = "author") -> DataFrame:
    """Authors with a name and enough reviews, with their count."""
    named = reviews.filter(F.col(author).isNotNull() & (F.col(author).cast("string") != ""))
    return named.groupBy(author).agg(F.count("*").alias("total_results")).filter(F.col("total_results") >= at_least)


def keep_active(reviews: DataFrame, at_least: int = 3, author: str = "author") -> DataFrame:
    """The reviews of active authors.

    A count and a semi join instead of a count window, so that no author's
    reviews have to meet in one task.
    """
    return reviews.join(active_authors(reviews, at_least, author), author, "left_semi")


def first_seen(reviews: DataFrame, author: str, order: list[str]) -> DataFrame:
    """Each author once, with the first row it was seen in."""
    return first_per_key(reviews.filter(F.col(author).isNotNull()), [author], order)


def summary_authors(summaries: DataFrame) -> DataFrame:
    """Distinct named authors in the positive, negative and neutral lists of review summaries.

    ``summaries``: slug, payload.  A summary without data adds nothing.
    """
    item = F.from_json("payload", schemas.REVIEW_SUMMARY)["data"]["item"]
    parts = summaries.select(item.alias("item")).filter("item is not null")
    lists = [F.coalesce(F.col(f"item.{kind}"), F.array()) for kind in ("positive", "negative", "neutral")]
    authors = parts.select(F.explode(F.concat(*lists)).alias("review")).select("review.author")
    return authors.filter("author is not null and author <> ''").distinct()


def profile_reviews(pages: DataFrame, authors: DataFrame, at_least: int = 3) -> DataFrame:
    """Feed B: the reviews on the landed profile pages of ``authors`` who have enough of them.

    ``pages``: author, page, payload.  The threshold reads the total that the
    profile itself states.
    """
    data = F.from_json("payload", schemas.PROFILE_PAGE)["data"]
    wanted = pages.join(authors.select("author"), "author", "left_semi").select(data.alias("data"))
    items = wanted.filter(F.col("data.totalResults") >= at_least).select(F.explode("data.items").alias("item"))
    return items.select(
        F.col("item.author").alias("author"),
        F.col("item.score").alias("score"),
        F.col("item.reviewedProduct.title").alias("game_name"),
        F.col("item.date").alias("date"),
        F.col("item.reviewedProduct.type").alias("type"),
        F.col("item.platform").alias("platform"),
    )


def page_gaps(pages: DataFrame) -> DataFrame:
    """Profiles whose landed pages do not hold as many different items as they state."""
    data = F.from_json("payload", schemas.PROFILE_PAGE)["data"]
    rows = pages.select("author", data["totalResults"].alias("total"), F.explode_outer(data["items"]).alias("item"))
    summed = rows.groupBy("author").agg(
        F.max("total").alias("total_results"), F.count_distinct(F.to_json("item")).alias("landed")
    )
    return summed.filter("landed <> total_results")


def user_item_ratings(reviews: DataFrame, how: str = "mean") -> DataFrame:
    """The user x item table in long form: one row per pair, ``how`` joins repeats.

    Users, items or ratings that are missing take no part.
    """
    measure = {"mean": F.avg, "max": F.max}[how]
    known = reviews.na.drop("any", subset=["user_id", "game_id", "rating"])
    return known.groupBy("user_id", "game_id").agg(measure("rating").alias("rating"))


def one_review_per_pair(reviews: DataFrame, how: str = "all", order: Sequence[str] = ("ts", "review_id")) -> DataFrame:
    """Reviews with repeats of a (user, game) pair kept (``all``) or joined.

    ``max`` keeps the best-rated review (the latest of equals), ``mean`` the
    latest one with the mean rating.
    """
    if how == "all":
        return reviews
    keys = ["user_id", "game_id"]
    if how == "max":
        return last_per_key(reviews.filter("rating is not null"), keys, ["rating", *order])
    kept = [c for c in reviews.columns if c not in (*keys, "rating")]
    latest = F.max_by(F.struct(*kept), F.struct(*order)).alias("_row")
    return reviews.groupBy(*keys).agg(F.avg("rating").alias("rating"), latest).select(*keys, "rating", "_row.*")


def game_scores(reviews: DataFrame) -> DataFrame:
    """Mean public score and number of reviews per game."""
    return reviews.groupBy("game_id").agg(F.avg("rating").alias("user_score"), F.count("rating").alias("n_reviews"))
