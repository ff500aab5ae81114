"""Every operator as a query over the given tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludomill.functions import scalars as S
from ludomill.functions import text as X
from ludomill.operators import company as W
from ludomill.operators import embeddings as E
from ludomill.operators import evaluate as V
from ludomill.operators import features as Z
from ludomill.operators import normalise as N
from ludomill.operators import resolve as R
from ludomill.operators import reviews as C
from ludomill.operators import transitions as M
from ludomill.operators.ordered import dense_title_ids, with_position
from ludomill.operators.static_tables import keep_columns
from ludomill.plans import jobs
from ludomill.plans import tables as T
from ludomill.session import fresh_folder, settle
from ludomill.sources import readers, sinks
from ludomill.streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(value: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def joined(value: Column | str) -> Column:
    return F.array_join(value, "|")


# --- review corpus ---------------------------------------------------------


@query
def review_project_dropna(spark, folder):
    lines = T.table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R")
    gaps = lines.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("l_discount", "l_tax")})
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"]
    return keep_columns(gaps, columns, ["l_discount", "l_tax"])


@query
def review_union(spark, folder):
    return C.union_feeds(T.feed_a(spark, folder), T.feed_b(spark, folder))


@query
def review_duplicates(spark, folder):
    return C.repeat_report(T.feed_b(spark, folder))[0]


@query
def duplicate_sample(spark, folder):
    return C.repeat_report(T.feed_b(spark, folder))[1]


@query
def review_concat_lists(spark, folder):
    """One review summary per event, with its author in one of three lists."""
    rows = T.event_reviews(spark, folder)
    author = F.array(F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author")))
    item = F.struct(
        F.when(F.col("rating") > 5, author).alias("positive"),
        F.when(F.col("rating") < 1, author).alias("negative"),
        F.when(F.col("event_type") == "view", F.array(F.struct(F.lit("").alias("author")))).alias("neutral"),
    )
    payload = F.to_json(F.struct(F.struct(item.alias("item")).alias("data")))
    return C.summary_authors(rows.select(F.col("game_id").alias("slug"), payload.alias("payload")))


@query
def profile_pages(spark, folder):
    """Profile pages of up to 20 reviews, landed per user, read back as feed B."""
    pages = _profile_pages(spark, folder)
    authors = pages.select("author").distinct()
    return C.profile_reviews(pages, authors)


@query
def page_completeness(spark, folder):
    """Profiles with a page missing: views are taken as not landed."""
    pages = _profile_pages(spark, folder, drop_type="view")
    # Pages land twice: what is counted are different items.
    return C.page_gaps(pages.union(pages.withColumn("page", F.col("page") + 1000)))


def _profile_pages(spark: SparkSession, folder: str, drop_type: str | None = None) -> DataFrame:
    rows = T.event_reviews(spark, folder).drop("ts")
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    placed = with_position(rows, ["user_id"], ["review_id"], "place").join(totals, "user_id")
    if drop_type:
        placed = placed.filter(F.col("event_type") != drop_type)
    author = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    product = F.struct(F.col("game_id").cast("string").alias("title"), F.lit("game-title").alias("type"))
    item = F.struct(
        author.alias("author"),
        F.col("rating").alias("score"),
        F.col("review_id").cast("string").alias("date"),
        F.col("event_type").alias("platform"),
        product.alias("reviewedProduct"),
    )
    page = F.floor(F.col("place") / 20).alias("page")
    grouped = placed.groupBy(author.alias("author"), page, "total").agg(F.collect_list(item).alias("items"))
    data = F.struct(F.col("total").alias("totalResults"), "items")
    return grouped.select("author", "page", F.to_json(F.struct(data.alias("data"))).alias("payload"))


@query
def active_users(spark, folder):
    return C.active_authors(T.order_reviews(spark, folder), 3, "user_id")


@query
def active_user_reviews(spark, folder):
    return C.keep_active(T.order_reviews(spark, folder), 3, "user_id").select("review_id", "user_id", "game_id")


@query
def first_seen_author(spark, folder):
    rows = T.event_reviews(spark, folder).select("user_id", "review_id", "game_id", "event_type")
    return C.first_seen(rows, "user_id", ["review_id"])


@query
def rating_mean(spark, folder):
    means = C.user_item_ratings(T.event_reviews(spark, folder), "mean")
    return means.select("user_id", "game_id", rounded("rating").alias("rating"))


@query
def rating_max(spark, folder):
    return C.user_item_ratings(T.order_reviews(spark, folder), "max")


@query
def one_review_per_game(spark, folder):
    rows = T.event_reviews(spark, folder)
    return C.one_review_per_pair(rows, "max").select("user_id", "game_id", "review_id", "rating")


@query
def game_scores(spark, folder):
    scores = C.game_scores(T.order_reviews(spark, folder))
    unit = Z.scaled_to_unit(scores, "user_score", "unit_score")
    return unit.select("game_id", "n_reviews", rounded("user_score").alias("user_score"), rounded("unit_score").alias("unit_score"))


# --- titles and matching ---------------------------------------------------


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return T.table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("game_name"))


@query
def title_ids(spark, folder):
    return dense_title_ids(_titles(spark, folder))


@query
def titles_from_offset(spark, folder):
    return dense_title_ids(_titles(spark, folder), start=100)


@query
def more_titles(spark, folder):
    """Titles from h on are saved; the earlier ones come later and get the ids that follow."""
    titles = _titles(spark, folder)
    saved = settle(dense_title_ids(titles.filter(F.col("game_name") >= "h")))
    return saved.unionByName(R.new_title_ids(titles, saved))


@query
def resume_pending(spark, folder):
    done = T.table(spark, folder, "part").filter(F.col("p_type") == "ECONOMY")
    saved = done.select(F.concat_ws(" ", "p_name", "p_brand").alias("query_name"))
    return R.pending_titles(_titles(spark, folder), saved)


@query
def title_ratio(spark, folder):
    parts = T.looked_up(spark, folder)
    other = F.concat_ws(" ", "p_type", "p_brand", F.translate("p_name", "io", "10"))
    return parts.select("p_partkey", X.name_percent(F.col("query_name"), other).alias("percent"))


@query
def normalised_titles(spark, folder):
    """Supplier and part names with punctuation and sequel numerals."""
    parts = T.table(spark, folder, "part")
    raw = F.concat(F.initcap("p_name"), F.lit(" IV: "), F.col("p_brand"), F.lit("'s "), F.col("p_type"))
    return parts.select(
        "p_partkey",
        X.normal_title(raw).alias("title"),
        X.sorted_words(X.normal_title(raw)).alias("sorted_title"),
        X.word_order_free_percent("p_name", F.concat_ws(" ", F.split("p_name", " ")[1], F.split("p_name", " ")[0])).alias("percent"),
    )


@query
def release_close(spark, folder):
    orders = T.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = T.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    ordered = S.iso_from_datetime(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    shipped = F.when(F.col("l_quantity") > 5, S.iso_from_datetime(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))).otherwise("")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        ordered.alias("order_day"), shipped.alias("ship_day"),
        S.close_release(ordered, shipped).alias("close"),
        S.iso_from_year((F.col("l_quantity") + 1900).cast("int")).alias("year_day"),
    )


def _sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows = T.looked_up(spark, folder)
    return {
        "gamespot": N.xml_game_hits(T.xml_payloads(rows)),
        "rawg": N.rawg_hits(*T.rawg_payloads(rows)),
        "igdb": N.igdb_hits(T.igdb_payloads(rows)),
        "hltb": N.hltb_hits(T.hltb_payloads(rows)),
        "metacritic": N.metacritic_hits(*T.metacritic_payloads(rows)),
    }


def _lookup_titles(spark: SparkSession, folder: str) -> DataFrame:
    return T.looked_up(spark, folder).select(F.col("query_name").alias("game_name"))


@query
def accepted_hits(spark, folder):
    verified = R.verify_hits(_lookup_titles(spark, folder), _sources(spark, folder))
    names = [F.coalesce(f"{s}.name", F.lit("")).alias(f"{s}_name") for s in (R.ANCHOR, *R.OTHERS)]
    return verified.select("game_name", F.coalesce("gamespot.release", F.lit("")).alias("anchor_release"), *names)


@query
def golden_record(spark, folder):
    records = R.game_table(_lookup_titles(spark, folder), _sources(spark, folder))
    lists = ("platforms", "cover_url", "developers", "publishers", "language_supports", "genres", "keywords")
    plain = [c for c in records.columns if c not in lists and not c.endswith("rating")]
    return records.select(
        *plain,
        *[rounded(c).alias(c) for c in records.columns if c.endswith("rating")],
        *[joined(c).alias(c) for c in lists],
        F.size("keywords").alias("n_keywords"),
        F.size("cover_url").alias("n_covers"),
    )


@query
def best_slug(spark, folder):
    return N.best_slug(T.metacritic_payloads(T.looked_up(spark, folder))[0])


@query
def rawg_records(spark, folder):
    return _flat(N.rawg_hits(*T.rawg_payloads(T.looked_up(spark, folder))), "esrb_rating")


@query
def igdb_records(spark, folder):
    hits = N.igdb_hits(T.igdb_payloads(T.looked_up(spark, folder)))
    return _flat(hits, "game_type", "game_modes", "player_perspectives", "themes")


@query
def hltb_records(spark, folder):
    return _flat(N.hltb_hits(T.hltb_payloads(T.looked_up(spark, folder)), 2), "game_type")


@query
def metacritic_records(spark, folder):
    return _flat(N.metacritic_hits(*T.metacritic_payloads(T.looked_up(spark, folder)), 3))


@query
def xml_game_records(spark, folder):
    return _flat(N.xml_game_hits(T.xml_payloads(T.looked_up(spark, folder))), "themes")


def _flat(hits: DataFrame, *extras: str) -> DataFrame:
    """Hits as plain columns; lists become text, with their length where nulls may hide."""
    columns = [*list(N.HIT_FIELDS)[:19], *extras]
    out = []
    for name in columns:
        value = F.col(f"game.{name}")
        if N.HIT_FIELDS[name].startswith("array"):
            value = joined(value)
        elif N.HIT_FIELDS[name] == "double":
            value = rounded(value)
        out.append(value.alias(name))
    return hits.select("query_name", "pos", *out, F.size("game.cover_url").alias("n_covers"))


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as a second catalogue writes them, with a release day."""
    spelled = F.when(F.col("p_size") <= 10, F.col("query_name"))
    spelled = spelled.when(F.col("p_size") <= 20, F.initcap("query_name"))
    spelled = spelled.when(F.col("p_size") <= 30, F.translate("query_name", "io", "10"))
    spelled = spelled.otherwise(F.concat(F.lit("the "), F.col("query_name")))
    day = F.concat((F.col("p_size") + 1980).cast("string"), F.lit("-05-05"))
    return T.looked_up(spark, folder).select(
        F.col("p_partkey").alias("entry_id"), spelled.alias("name"), day.alias("release")
    )


def _dated_titles(spark: SparkSession, folder: str) -> DataFrame:
    """As many distinct titles as parts, each with the year of its catalogue entry as anchor."""
    day = F.concat((F.col("p_size") + 1980).cast("string"), F.lit("-01-01"))
    return T.looked_up(spark, folder).select(F.col("query_name").alias("game_name"), day.alias("anchor_release"))


@query
def anchor_catalogue_match(spark, folder):
    return R.match_anchor_catalogue(_dated_titles(spark, folder), _catalogue(spark, folder))


@query
def catalogue_matches(spark, folder):
    return R.match_catalogue(_dated_titles(spark, folder), _catalogue(spark, folder))


@query
def catalogue_best_match(spark, folder):
    return R.best_matches(_dated_titles(spark, folder), _catalogue(spark, folder))


def _two_catalogues(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts as two catalogues spell them: entry_id, title, developer, release_year."""
    parts = T.looked_up(spark, folder)
    year = (F.col("p_size") + 1980).alias("release_year")
    key = F.col("p_partkey") * 2
    left = parts.select(key.alias("entry_id"), F.col("query_name").alias("title"), F.col("p_type").alias("developer"), year)
    name = F.split("query_name", " ")
    end = F.when(F.col("p_size") > 25, "").otherwise(" II")
    title = F.concat(name[1], F.lit(", "), F.upper(name[0]), F.lit(" "), name[2], end)
    right = parts.select((key + 1).alias("entry_id"), title.alias("title"), F.initcap("p_type").alias("developer"), year)
    return left, right


@query
def tiered_match(spark, folder):
    return R.tiered_matches(*_two_catalogues(spark, folder))


@query
def game_entities(spark, folder):
    """One id for what two catalogues tell of a game, whatever the chain of titles between them."""
    left, right = _two_catalogues(spark, folder)
    return R.game_entities(left.union(right))


# --- features --------------------------------------------------------------


@query
def genre_vocab(spark, folder):
    return Z.label_counts(T.games(spark, folder), "genres")


@query
def genre_multihot(spark, folder):
    games = T.games(spark, folder)
    terms = Z.vocabulary(games, "genres")
    encoded = games.select("game_id", S.multi_hot("genres", terms).alias("v"))
    return encoded.select("game_id", F.posexplode("v").alias("dim", "value"))


@query
def genre_multihot_rows(spark, folder):
    return Z.multi_hot_rows(T.games(spark, folder), "game_id", "genres")


@query
def platform_onehot(spark, folder):
    games = T.games(spark, folder).withColumn("platforms", F.array("platform"))
    names = Z.frequent_labels(games, "platforms", Z.VECTOR_PARTS["platform"])
    encoded = games.select("game_id", S.one_hot("platform", names).alias("v"))
    return encoded.select("game_id", F.posexplode("v").alias("dim", "value"))


@query
def playtime_tanh(spark, folder):
    games = T.games(spark, folder)
    return games.select("game_id", rounded(S.saturating_hours("hours")).alias("main"))


@query
def minmax_scaled(spark, folder):
    games = Z.scaled_to_unit(T.games(spark, folder), "critic", "unit_critic")
    games = Z.scaled_to_unit(games, "release_year", "unit_year")
    return games.select("game_id", rounded("unit_critic").alias("unit_critic"), rounded("unit_year").alias("unit_year"))


@query
def rewards(spark, folder):
    rows = T.event_reviews(spark, folder).join(T.catalogued_games(spark, folder), "game_id")
    base = S.scaled_reward("rating")
    return rows.select(
        "review_id",
        rounded(base).alias("reward"),
        S.ternary_reward("rating").alias("ternary"),
        rounded(S.playtime_reward(base, F.col("rating") * 10, F.col("hours"), 0.5)).alias("with_bonus"),
    )


# --- embeddings ------------------------------------------------------------


@query
def item_svd(spark, folder):
    """With as many factors as games, a game's scaled entries hold all its ratings."""
    ratings = C.user_item_ratings(T.event_reviews(spark, folder))
    games = ratings.select("game_id").distinct().count()
    vectors, _ = E.item_factors(ratings, games, scaled=True, rounds=1)
    named = E.attach_vectors(T.games(spark, folder).select("game_id", "title"), vectors, "game_id")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return named.select("game_id", "title", F.round(squares, 4).alias("squares"))


@query
def item_factor_shape(spark, folder):
    """The default factors: orthonormal over the games, so that their squares add up to the width."""
    vectors, values = E.item_factors(C.user_item_ratings(T.event_reviews(spark, folder)))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    falling = all(a >= b for a, b in zip(values, values[1:]))
    return vectors.agg(
        F.count("*").alias("games"),
        F.max(F.size("vector")).alias("width"),
        F.round(F.sum(squares), 4).alias("squares"),
        F.lit(falling).alias("falling"),
    )


@query
def embedding_table(spark, folder):
    """Games with their vector through the embedding job and back; games nobody rated are left out."""
    path = fresh_folder(spark, "embeddings")
    jobs.item_embeddings(T.event_reviews(spark, folder), T.games(spark, folder).select("game_id", "title"), path)
    return spark.read.parquet(path).select("game_id", "title", F.size("vector").alias("width"))


@query
def description_word2vec(spark, folder):
    docs = T.table(spark, folder, "documents")
    vectors = E.description_vectors(docs, "doc_id", "text")
    # What is asked of a vector, and 128 bits that tell it from others: vectors are too wide to be dealt out again.
    same = F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))
    facts = vectors.select(
        "doc_id", F.size("vector").alias("width"), "n_words", F.exists("vector", F.isnan).alias("has_nan"), same.alias("same")
    )
    rows = facts.join(docs.select("doc_id", F.xxhash64("text").alias("body")), "doc_id")
    # Equal texts have equal vectors.
    kinds = rows.groupBy("body").agg(F.count_distinct("same").alias("vectors"))
    return rows.join(kinds, "body").select("doc_id", "width", "n_words", "vectors", "has_nan")


@query
def title_item2vec(spark, folder):
    vectors = E.title_vectors(T.event_reviews(spark, folder))
    return vectors.select("game_id", F.size("vector").alias("width"), F.exists("vector", F.isnan).alias("has_nan"))


def _title_company(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    sentences = settle(E.play_sentences(T.event_reviews(spark, folder)).select("words"))
    contexts = W.frequent_words(sentences, W.CONTEXTS)
    return settle(W.company_counts(sentences, contexts)), contexts


@query
def title_company(spark, folder):
    """How often two games stand near each other in a play history."""
    counts, contexts = _title_company(spark, folder)
    names = spark.createDataFrame(list(enumerate(contexts)), "place int, context string")
    return counts.join(F.broadcast(names), "place").select("word", "context", "times")


@query
def title_information(spark, folder):
    """How much more often than by chance."""
    counts, contexts = _title_company(spark, folder)
    names = spark.createDataFrame(list(enumerate(contexts)), "place int, context string")
    cells = W.information(counts, E.TITLE_SHIFT).join(F.broadcast(names), "place")
    return cells.select("word", "context", rounded("value", 6).alias("value"))


@query
def title_factors(spark, folder):
    """All factors of that matrix: they solve their equation, are orthonormal, and their squares add up to those of its entries."""
    counts, contexts = _title_company(spark, folder)
    rows = settle(W.matrix_rows(W.information(counts, E.TITLE_SHIFT)))
    values, vectors, residual = W.leading_factors(rows, len(contexts), len(contexts))
    square = float(abs(vectors.T @ vectors - np.eye(len(values))).max())
    return spark.range(1).select(
        F.lit(len(contexts)).alias("contexts"),
        F.lit(residual < 1e-9).alias("solved"),
        F.lit(square < 1e-9).alias("orthonormal"),
        F.round(F.lit(float((values**2).sum())), 3).alias("squares"),
    )


@query
def word_company(spark, folder):
    """Per frequent word of the documents: the words within five places of it, and how often."""
    tokenised = settle(T.table(spark, folder, "documents").select(F.coalesce(E.words("text"), F.array().cast("array<string>")).alias("words")))
    contexts = W.frequent_words(tokenised, W.CONTEXTS)
    counts = W.company_counts(tokenised, contexts).groupBy("place").agg(F.count("*").alias("words"), F.sum("times").alias("times"))
    names = spark.createDataFrame(list(enumerate(contexts)), "place int, context string")
    return counts.join(F.broadcast(names), "place").select("context", "words", "times")


@query
def play_sentences(spark, folder):
    sentences = E.play_sentences(T.event_reviews(spark, folder))
    return sentences.select("user_id", "part", joined("words").alias("games"))


@query
def feature_vector(spark, folder):
    reviews = T.event_reviews(spark, folder)
    games = _feature_games(spark, folder)
    titles = E.title_vectors(reviews)
    texts = E.description_vectors(games, "game_id", "description")
    factors, _ = E.item_factors(C.user_item_ratings(reviews))
    vectors = Z.game_features(games, titles, texts, factors, C.game_scores(reviews))
    return vectors.select("game_id", F.size("vector").alias("width"), F.exists("vector", F.isnan).alias("has_nan"))


@query
def feature_vector_fixed_parts(spark, folder):
    """The parts of the item vector that are not learned."""
    reviews = T.event_reviews(spark, folder)
    none = spark.createDataFrame([], "game_id long, vector array<double>")
    vectors = Z.game_features(_feature_games(spark, folder), none, none, none, C.game_scores(reviews))
    fixed = [n for n in Z.VECTOR_PARTS if n not in ("title", "description", "collaborative")]
    first, _ = Z.part_range(fixed[0])
    width = sum(Z.VECTOR_PARTS[n] for n in fixed)
    rows = vectors.select("game_id", F.posexplode(F.slice("vector", first + 1, width)).alias("dim", "value"))
    return rows.select("game_id", "dim", rounded("value").alias("value"))


def _feature_games(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with the columns of the game master table that features read."""
    return T.games(spark, folder).select(
        "game_id",
        "genres",
        F.array("platform").alias("platforms"),
        F.concat(F.col("release_year").cast("string"), F.lit("-01-01")).alias("release"),
        F.col("critic").alias("metacritic_rating"),
        F.col("hours").alias("main_story"),
        (F.col("hours") * 1.5).alias("main_extra"),
        (F.col("hours") * 2).alias("completionist"),
        F.concat_ws(" ", "title", "developer").alias("description"),
    )


# --- transitions -----------------------------------------------------------


def _action_games(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    games = T.catalogued_games(spark, folder)
    terms = Z.vocabulary(games, "genres")
    return games.select("game_id", S.multi_hot("genres", terms).alias("vector")), terms


def _long_form(rows: DataFrame, terms: list[str]) -> DataFrame:
    cells = F.arrays_zip(
        F.array(*[F.lit(t) for t in terms]).alias("dim"), F.col("observation"), F.col("action")
    )
    flat = rows.select("user_id", "step", "review_id", "reward", "terminal", F.explode(cells).alias("c"))
    return flat.select(
        "user_id",
        "step",
        "review_id",
        F.col("c.dim").alias("dim"),
        rounded(F.col("c.observation").cast("double"), 5).alias("obs"),
        F.col("c.action").cast("double").alias("action"),
        rounded(F.col("reward").cast("double"), 5).alias("reward"),
        F.col("terminal").cast("int").alias("terminal"),
    )


@query
def mdp_transitions(spark, folder):
    games, terms = _action_games(spark, folder)
    return _long_form(M.transitions(T.event_reviews(spark, folder), games, len(terms)), terms)


@query
def mdp_wide(spark, folder):
    """Transitions over vectors as wide as the item vectors, summed up per step."""
    width = sum(Z.VECTOR_PARTS.values())
    cells = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.col("hours") + i)
    games = T.catalogued_games(spark, folder).select("game_id", cells.alias("vector"))
    rows = M.transitions(T.event_reviews(spark, folder), games, width)
    # Whole numbers again, whatever the mean's single precision.
    earlier = F.transform("observation", lambda x: F.round(x.cast("double") * (F.col("step") - 1)).cast("long"))
    return rows.select(
        "user_id",
        "step",
        "review_id",
        F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x).alias("earlier_sum"),
        F.size("observation").alias("width"),
        F.col("terminal").cast("int").alias("terminal"),
    )


@query
def mdp_last_kept(spark, folder):
    games, terms = _action_games(spark, folder)
    rows = M.transitions(T.event_reviews(spark, folder), games, len(terms), terminal="last_kept", repeats="max")
    return rows.select("user_id", "step", "review_id", F.col("terminal").cast("int").alias("terminal"))


@query
def mdp_untimed(spark, folder):
    games, terms = _action_games(spark, folder)
    rows = M.transitions(T.event_reviews(spark, folder).drop("ts"), games, len(terms), ordered_by_time=False)
    return rows.select("user_id", "step", "review_id", F.col("terminal").cast("int").alias("terminal"))


@query
def mdp_repeated_games(spark, folder):
    """Every game twice, once without any genre: the fuller vector counts and no review is doubled."""
    games, terms = _action_games(spark, folder)
    blank = games.select("game_id", F.array_repeat(F.lit(0.0), len(terms)).alias("vector"))
    rows = M.transitions(T.event_reviews(spark, folder), games.unionByName(blank), len(terms))
    filled = F.aggregate("action", F.lit(0.0), lambda a, x: a + x).cast("int").alias("genres")
    return rows.select("user_id", "step", "review_id", filled, F.col("terminal").cast("int").alias("terminal"))


@query
def mdp_shape(spark, folder):
    games, terms = _action_games(spark, folder)
    return M.dataset_shape(M.transitions(T.order_reviews(spark, folder), games, len(terms)))


@query
def mdp_written(spark, folder):
    """Transitions through the partitioned sink and back."""
    games, terms = _action_games(spark, folder)
    path = fresh_folder(spark, "transitions")
    sinks.write_transitions(M.transitions(T.event_reviews(spark, folder), games, len(terms)), path)
    back = spark.read.parquet(path)
    return back.groupBy("user_id").agg(
        F.count("*").alias("steps"), F.max("step").alias("last_step"), F.sum("terminal").cast("long").alias("terminals")
    )


# --- evaluation and recommendation -----------------------------------------


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    known = T.catalogued_games(spark, folder).select("game_id", "hours", "critic")
    rows = T.order_reviews(spark, folder).join(known, "game_id")
    return rows.withColumn("reward", S.scaled_reward("rating"))


@query
def reward_model(spark, folder):
    model = V.fit_reward_on(_logged(spark, folder), ["hours"])
    return spark.range(1).select(
        F.round(F.lit(float(model.coefficients[0])), 6).alias("slope"), F.round(F.lit(model.intercept), 6).alias("intercept")
    )


@query
def reward_model_states(spark, folder):
    """The reward model on whole states and actions: at the least squares its mean is that of the rewards."""
    games, terms = _action_games(spark, folder)
    rows = settle(M.transitions(T.event_reviews(spark, folder), games, len(terms)))
    inputs = settle(V.reward_inputs(rows, len(terms)).select("features", "reward"))
    model = V.fit_reward(inputs)
    gap = V.normal_residual(model, inputs, 2 * len(terms)).select("gap").scalar()
    return V.policy_value(model, inputs).select(
        F.round("direct_value", 4).alias("direct_value"), (gap < 1e-3).alias("least_squares")
    )


@query
def action_scaling(spark, folder):
    games, terms = _action_games(spark, folder)
    scaled = Z.scaled_to_signed(games, "vector", len(terms), "scaled")
    return scaled.select("game_id", F.posexplode("scaled").alias("dim", "value"))


def _critic_policy(spark: SparkSession, folder: str) -> DataFrame:
    """A policy that picks games in proportion to their critics' score."""
    games = T.catalogued_games(spark, folder).select("game_id", "critic")
    total = games.select(F.sum("critic")).scalar()
    return games.select("game_id", (F.col("critic") / total).alias("probability"))


@query
def ips_value(spark, folder):
    values = V.propensity_value(_logged(spark, folder), _critic_policy(spark, folder))
    return values.select(rounded("ips_value", 6).alias("ips_value"), rounded("snips_value", 6).alias("snips_value"))


@query
def direct_value(spark, folder):
    values = V.direct_value(_logged(spark, folder), _critic_policy(spark, folder))
    return values.select(rounded("direct_value", 6).alias("direct_value"))


@query
def state_policies(spark, folder):
    """Values of the greedy and of the critics' policy over states: has the user played a game of a large publisher before?"""
    large = F.when(F.col("platform") == "LARGE", 1.0).otherwise(0.0)
    games = settle(T.catalogued_games(spark, folder).select("game_id", F.array(large).alias("vector")))
    rows = M.transitions(T.event_reviews(spark, folder), games, 1)
    known = F.array(F.when(F.get("observation", F.lit(0)) > 0, 1.0).otherwise(0.0))
    rows = settle(rows.select(known.alias("observation"), "action", "reward"))
    model = V.fit_interactions(rows)
    greedy = V.greedy_value(model, rows, games).select(F.lit("greedy").alias("policy"), "direct_value")
    critics = V.state_value(model, rows, games, _critic_policy(spark, folder)).select(F.lit("critics").alias("policy"), "direct_value")
    return greedy.union(critics).select("policy", rounded("direct_value", 5).alias("direct_value"))


@query
def logged_policy(spark, folder):
    shares = V.frequency_policy(_logged(spark, folder))
    return shares.select("game_id", rounded("probability").alias("probability"))


@query
def candidates_topk(spark, folder):
    rows = T.table(spark, folder, "embeddings")
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = items.withColumnRenamed("item_id", "query_id")
    itself = items.select(F.col("item_id").alias("query_id"), "item_id")
    found = V.best_items(queries, items, 5, excluded=itself)
    return found.select("query_id", "rank", "item_id", rounded("score", 6).alias("score"))


@query
def cold_start(spark, folder):
    games, terms = _action_games(spark, folder)
    answers = T.event_reviews(spark, folder).filter(F.col("event_type") == "signup")
    states = V.cold_start_states(answers, games, len(terms))
    rows = states.select("user_id", F.posexplode("vector").alias("dim", "value"))
    return rows.select("user_id", "dim", rounded("value").alias("value"))


@query
def top_recommendations(spark, folder):
    """Five best unplayed games per user by the match of their words with the liked ones."""
    games, terms = _action_games(spark, folder)
    reviews = T.event_reviews(spark, folder)
    liked = reviews.filter(F.col("rating") > 5)
    states = V.mean_vector(liked.join(games, "game_id"), ["user_id"], "vector", len(terms))
    played = reviews.select(F.col("user_id").alias("query_id"), F.col("game_id").alias("item_id"))
    queries = states.withColumnRenamed("user_id", "query_id")
    found = V.best_items(queries, games.withColumnRenamed("game_id", "item_id"), 5, measure="dot", excluded=played)
    return found.select("query_id", "rank", "item_id", rounded("score", 6).alias("score"))


@query
def recommendation_filters(spark, folder):
    games = T.games(spark, folder).select(
        "game_id",
        "genres",
        "release_year",
        F.array("platform").alias("platforms"),
        F.array("developer").alias("developers"),
        # Titles of an even number can be played alone or together, the others together only.
        F.when(F.col("game_id") % 2 == 0, F.array(F.lit("Single player"), F.lit("Multiplayer")))
        .otherwise(F.array(F.lit("Multiplayer")))
        .alias("game_modes"),
    )
    kept = V.matching_games(games, 2000, ["LARGE", "SMALL"], ["blue", "hot"], "Brand#2", "Single player")
    return kept.select("game_id", "release_year")


@query
def unplayed_games(spark, folder):
    """Games each customer ordered but no event user of the same number played."""
    ordered = T.order_reviews(spark, folder).select("user_id", "game_id").distinct()
    return V.unplayed(ordered, T.event_reviews(spark, folder))


# --- sources and sinks -----------------------------------------------------


@query
def csv_round_trip(spark, folder):
    """Parts through a CSV file with missing cells, list cells and awkward texts, and back."""
    gap = F.when(F.col("p_type") == "SMALL", F.lit("N/A")).otherwise(F.col("p_size").cast("string"))
    listed = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', \"it's "), F.col("p_name"), F.lit("\", None]"))
    rows = T.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.col("p_name"), F.lit(', "'), F.col("p_type"), F.lit('"')).alias("Game/Name"),
        gap.alias("size"),
        listed.alias("tags"),
    )
    path = fresh_folder(spark, "csv")
    sinks.write_csv(rows, path)
    back = readers.read_csv(spark, path, {"Game/Name": "string", "size": "double", "id": "long", "tags": "string"})
    tags = readers.listed_cell("tags")
    return back.select(
        "id", F.col("Game/Name").alias("name"), "size", F.size(tags).alias("n_tags"), joined(tags).alias("tags")
    )


@query
def parquet_append(spark, folder):
    """Two feeds written one after the other into one table."""
    path = fresh_folder(spark, "appended")
    names = ["author", "score", "game_name", "date"]
    sinks.write_table(T.feed_a(spark, folder).withColumnsRenamed(C.FEED_A_NAMES).select(*names), path)
    sinks.write_table(T.feed_b(spark, folder).select(*names), path, append=True)
    return spark.read.parquet(path).groupBy("game_name").agg(F.count("*").alias("n"), rounded(F.sum("score"), 4).alias("score"))


@query
def xml_review_scan(spark, folder):
    """Order reviews written as an XML feed and scanned again; low scores are left out of the file."""
    rows = T.feed_a(spark, folder).select(
        "authors",
        F.when(F.col("score") >= 1, F.col("score")).alias("score"),
        F.struct(F.col("game_name").alias("name")).alias("game"),
        "publish_date",
    )
    path = fresh_folder(spark, "xml")
    sinks.write_xml(rows, path, "response", "review")
    return readers.read_xml_reviews(spark, path)


@query
def xml_game_scan(spark, folder):
    """Parts written as XML documents with games two levels down, scanned for games at any depth."""
    word = F.split("p_name", " ")
    game = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("query_name").alias("name"),
        F.array(F.struct(F.col("p_brand").alias("name"))).alias("theme"),
        F.array(F.struct(word[0].alias("name")), F.struct(word[1].alias("name"))).alias("genre"),
        F.when(F.col("p_type") != "SMALL", F.lit("deck")).alias("description"),
        F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-03-01 12:00:00")).alias("release_date"),
    )
    path = fresh_folder(spark, "xml-games")
    rows = T.looked_up(spark, folder).select(F.struct(game.alias("game")).alias("results"))
    sinks.write_xml(rows, path, "pages", "response")
    games = readers.read_xml_games(spark, path).select(N.xml_game_record(F.struct("*")).alias("g"))
    return games.select(
        "g.id", "g.name", "g.release", "g.description", joined("g.genres").alias("genres"), joined("g.themes").alias("themes")
    )


@query
def latest_payloads(spark, folder):
    """Landed rows with several fetches per title: the newest counts."""
    landed = T.table(spark, folder, "lineitem").select(
        F.lit("rawg").alias("source"),
        F.col("l_partkey").cast("string").alias("query_name"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("fetched_at"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("payload"),
    )
    return N.latest_payloads(landed, "rawg")


# --- incremental -----------------------------------------------------------

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.landed_stream(spark, folder, EVENTS, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_dedupe(spark, folder):
    """Three restarts: the middle third of the events, all but the oldest, all of them; late ones count, repeated ones do not."""
    events = T.table(spark, folder, "events")
    low, high = events.select(F.percentile_approx("ts", [1 / 3, 2 / 3])).first()[0]
    base = fresh_folder(spark, "stream-dedupe")
    landing, table = os.path.join(base, "landing"), os.path.join(base, "table")
    for rows in (events.filter((F.col("ts") > low) & (F.col("ts") <= high)), events.filter(F.col("ts") > low), events):
        rows.write.mode("append").option("maxRecordsPerFile", 1_000_000).parquet(landing)
        stream = I.landed_stream(spark, landing, EVENTS)
        I.unseen_run(stream, table, os.path.join(base, "checkpoint"), ["event_id"], ["ts"]).awaitTermination()
    return spark.read.parquet(table).select("event_id", "user_id", "event_type", "value")


@query
def stream_append(spark, folder):
    """Events landed in several files, appended to a review table a file at a time."""
    landing = fresh_folder(spark, "landing")
    T.table(spark, folder, "events").repartition(4, "user_id").write.parquet(landing)
    stream = I.landed_stream(spark, landing, EVENTS, files_per_batch=1)
    table = I.drained(stream.select("event_id", "user_id", "value"), "stream-append")
    return table.groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query
def feedback_upsert(spark, folder):
    """Events as feedback: the newest per user and game stays, over three runs into one table."""
    base = fresh_folder(spark, "feedback")
    table = os.path.join(base, "table")
    game = F.get_json_object("props", "$.k").cast("long").alias("game_id")
    for version in range(3):
        events = _event_stream(spark, folder).filter(F.col("event_id") % 3 == F.lit((version + 1) % 3))
        plays = events.select("user_id", game, "event_id", "value")
        run = I.feedback_run(
            plays, table, os.path.join(base, f"run-{version}"), ["user_id", "game_id"], ["event_id"], 8, version
        )
        run.awaitTermination()
    schema = "user_id long, game_id long, event_id long, value double"
    return I.read_feedback(spark, table, schema).select("user_id", "game_id", "event_id", "value")
