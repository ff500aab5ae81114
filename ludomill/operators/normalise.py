"""Landed payloads of five catalogues as hits in one common shape.

Every normaliser returns ``query_name, pos, game``: the title that was looked
up, the place of the hit in the answer (0 is best) and the record as a struct
with the columns of ``schemas.GAMES`` and ``schemas.GAME_EXTRAS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludomill.functions import scalars as S
from ludomill.functions.text import block_similarity
from ludomill.operators.ordered import last_per_key, top_per_key
from ludomill.sources import schemas

HIT_FIELDS = dict(part.split() for part in f"{schemas.GAMES}, {schemas.GAME_EXTRAS}".split(","))


def _default(kind: str) -> Column:
    """How a field of this type spells "unknown"."""
    if kind.startswith("array"):
        return S.no_texts()
    return F.lit("") if kind == "string" else F.expr(f"cast(0 as {kind})")


def game_record(known: dict[str, Column]) -> Column:
    """A full record from the known fields; the others hold their "unknown" value."""
    fields = []
    for name, kind in HIT_FIELDS.items():
        value = known[name].cast(kind) if name in known else _default(kind)
        fields.append(value.alias(name))
    return F.struct(*fields)


def latest_payloads(landed: DataFrame, source: str) -> DataFrame:
    """The newest payload of one source per looked-up title."""
    rows = landed.filter(F.col("source") == source).select("query_name", "fetched_at", "payload")
    return last_per_key(rows, ["query_name"], ["fetched_at"]).select("query_name", "payload")


def rawg_record(g: Column) -> Column:
    return game_record(
        {
            "id": g["id"],
            "name": g["name"],
            "release": g["released"],
            "rawg_rating": S.per_scale(g["rating"], 5),
            "metacritic_rating": S.per_scale(g["metacritic"], 100),
            "main_story": g["playtime"],
            "platforms": S.pluck_present(g["platforms"], "platform", "name"),
            "genres": S.pluck(g["genres"], "name"),
            "keywords": S.pluck(g["tags"], "name"),
            "esrb_rating": F.when(g["esrb_rating"].isNotNull(), g["esrb_rating"]["name"]).otherwise(""),
            "developers": S.pluck(g["developers"], "name"),
            "publishers": S.pluck(g["publishers"], "name"),
            "description": g["description_raw"],
        }
    )


def igdb_record(g: Column) -> Column:
    return game_record(
        {
            "id": g["id"],
            "name": g["name"],
            "game_modes": S.pluck(g["game_modes"], "name"),
            "game_type": g["game_type"]["type"],
            "keywords": S.pluck(g["keywords"], "name"),
            "language_supports": S.pluck(g["language_supports"], "language", "name"),
            "platforms": S.pluck(g["platforms"], "name"),
            "player_perspectives": S.pluck(g["player_perspectives"], "name"),
            "themes": S.pluck(g["themes"], "name"),
            "igdb_rating": S.per_scale(g["rating"], 100),
            "release": S.iso_from_epoch(g["first_release_date"]),
            "genres": S.pluck(g["genres"], "name"),
            "cover_url": F.array(g["cover"]["url"]),
            "description": g["summary"],
        }
    )


def hltb_record(g: Column) -> Column:
    return game_record(
        {
            "name": g["game_name"],
            "game_type": g["game_type"],
            "hltb_rating": S.per_scale(g["review_score"], 100),
            "platforms": g["profile_platforms"],
            "release": S.iso_from_year(g["release_world"]),
            "main_story": g["main_story"],
            "main_extra": g["main_extra"],
            "completionist": g["completionist"],
        }
    )


def xml_game_record(g: Column) -> Column:
    return game_record(
        {
            "id": F.coalesce(g["id"], F.lit(0)),
            "name": g["name"],
            "themes": S.pluck(g["theme"], "name"),
            "release": S.iso_from_datetime(g["release_date"]),
            "genres": S.pluck(g["genre"], "name"),
            "cover_url": F.array(g["image"]["original"]),
            "description": g["description"],
        }
    )


def metacritic_record(components: Column) -> Column:
    about = F.try_element_at(components, F.lit(1))["data"]["item"]
    critics = F.try_element_at(components, F.lit(7))["data"]["item"]
    users = F.try_element_at(components, F.lit(9))["data"]["item"]
    companies = about["production"]["companies"]
    return game_record(
        {
            "name": about["title"],
            "release": F.coalesce(about["releaseDate"], F.lit("")),
            "developers": S.pluck_role(companies, "typeName", "Developer", "name"),
            "publishers": S.pluck_role(companies, "typeName", "Publisher", "name"),
            "genres": S.pluck(about["genres"], "name"),
            "platforms": S.pluck(about["platforms"], "name"),
            "metacritic_rating": S.score_ratio(critics["score"], critics["max"]),
            "user_rating": S.score_ratio(users["score"], users["max"]),
        }
    )


def complete_page(components: Column) -> Column:
    """True for a game page with its data at the three places that are read."""
    there = [F.try_element_at(components, F.lit(place))["data"].isNotNull() for place in (1, 7, 9)]
    return F.coalesce((F.size(components) >= 9) & there[0] & there[1] & there[2], F.lit(False))


def rawg_hits(searches: DataFrame, details: DataFrame, count: int = 1) -> DataFrame:
    """First ``count`` search results, each with its detail payload.

    ``searches``: query_name, payload.  ``details``: id, payload.
    """
    results = F.from_json("payload", schemas.RAWG_SEARCH)["results"]
    wanted = searches.select("query_name", F.posexplode(F.slice(results, 1, count)).alias("pos", "result"))
    wanted = wanted.select("query_name", "pos", F.col("result.id").alias("id"))
    found = details.select("id", F.from_json("payload", schemas.RAWG_DETAIL).alias("g"))
    # Both sides grow with the titles, and a parsed record is much larger than the estimate says.
    return wanted.join(found.hint("merge"), "id").select("query_name", "pos", rawg_record(F.col("g")).alias("game"))


def igdb_hits(searches: DataFrame, count: int = 1) -> DataFrame:
    games = F.slice(F.from_json("payload", schemas.IGDB_GAMES), 1, count)
    rows = searches.select("query_name", F.posexplode(games).alias("pos", "g"))
    return rows.select("query_name", "pos", igdb_record(F.col("g")).alias("game"))


def hltb_hits(searches: DataFrame, count: int = 1) -> DataFrame:
    """Top ``count`` results by the source's own similarity; ties keep their order.

    One answer holds a few dozen results at most, so each is ordered in place.
    """
    games = F.from_json("payload", schemas.HLTB_GAMES)
    keyed = F.transform(games, lambda g, place: F.struct((-g["similarity"]).alias("s"), place.alias("p"), g.alias("g")))
    ordered = F.slice(F.array_sort(keyed), 1, count)
    rows = searches.select("query_name", F.posexplode(ordered).alias("pos", "hit"))
    return rows.select("query_name", "pos", hltb_record(F.col("hit.g")).alias("game"))


def xml_game_hits(searches: DataFrame, count: int = 1) -> DataFrame:
    """First ``count`` games of each answer, at any depth."""
    texts = F.regexp_extract_all("payload", F.lit(r"(?s)(<game(?:\s[^>]*)?>.*?</game>)"))
    rows = searches.select("query_name", F.posexplode(F.slice(texts, 1, count)).alias("pos", "text"))
    rows = rows.select("query_name", "pos", F.from_xml("text", schemas.XML_GAME).alias("g"))
    return rows.select("query_name", "pos", xml_game_record(F.col("g")).alias("game"))


def title_candidates(searches: DataFrame) -> DataFrame:
    """Results of kind ``game-title`` of the answers that hold data."""
    data = F.from_json("payload", schemas.METACRITIC_SEARCH)["data"]
    rows = searches.select("query_name", data.alias("data")).filter("data is not null")
    items = rows.select("query_name", F.posexplode("data.items").alias("pos", "item"))
    titles = items.filter(F.col("item.type") == "game-title")
    return titles.select("query_name", "pos", F.col("item.title").alias("title"), F.col("item.slug").alias("slug"))


def metacritic_hits(searches: DataFrame, pages: DataFrame, count: int = 1) -> DataFrame:
    """Top ``count`` results by title similarity among those with a complete page.

    ``searches``: query_name, payload.  ``pages``: slug, payload.
    """
    parsed = pages.select("slug", F.from_json("payload", schemas.METACRITIC_PAGE)["components"].alias("components"))
    usable = parsed.filter(complete_page(F.col("components")))
    # Scored after the join: results without a usable page need no score.
    scored = title_candidates(searches).join(usable.hint("merge"), "slug").withColumn("similarity", block_similarity("title", "query_name"))
    best = top_per_key(scored, ["query_name"], [F.desc("similarity"), F.asc("pos")], count)
    return best.select(
        "query_name", (F.col("rank") - 1).alias("pos"), metacritic_record(F.col("components")).alias("game")
    )


def best_slug(searches: DataFrame) -> DataFrame:
    """The slug whose title is most alike the query; the first wins ties, a similarity of 0 never matches."""
    rows = title_candidates(searches).withColumn("similarity", block_similarity("title", "query_name"))
    scored = rows.filter("similarity > 0")
    best = F.min_by("slug", F.struct(-F.col("similarity"), F.col("pos"))).alias("slug")
    return scored.groupBy("query_name").agg(best)
