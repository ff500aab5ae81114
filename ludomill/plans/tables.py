"""The star-schema tables seen as reviews, games and catalogue payloads.

Users are event users or customers, games are parts, ratings come from event
values or quantities.  Payloads are built from the part table by Spark, one
answer per looked-up title, in the shapes the catalogues send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """review_id, user_id, game_id, rating 0..10, ts, event_type."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("review_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("game_id"),
        F.least(F.col("value") / 10.0, F.lit(10.0)).alias("rating"),
        "ts",
        "event_type",
    )


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The larger review table: customers rate the parts they ordered."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, folder, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        # One number per line: order and line numbers alone repeat.
        (
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
        ).alias("review_id"),
        "user_id",
        F.col("l_partkey").alias("game_id"),
        (F.col("l_quantity") / 5.0).alias("rating"),
        F.col("l_shipdate").alias("ts"),
    )


def games(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a game."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("game_id"),
        F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("genres"),
        F.col("p_type").alias("platform"),
        F.col("p_brand").alias("developer"),
        F.col("p_size").cast("double").alias("hours"),
        ((F.col("p_retailprice") - 900) / 100).alias("critic"),
        (F.lit(1970) + F.col("p_size")).alias("release_year"),
    )


def catalogued_games(spark: SparkSession, folder: str) -> DataFrame:
    """Games with metadata: promotional ones have none, so some reviews are of unknown games."""
    return games(spark, folder).filter(F.col("platform") != "PROMO")


def feed_a(spark: SparkSession, folder: str) -> DataFrame:
    """authors, score, game_name, publish_date."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("game_id"), "p_name")
    rows = order_reviews(spark, folder).join(customers, "user_id").join(names, "game_id")
    return rows.select(
        F.col("c_name").alias("authors"),
        F.col("rating").alias("score"),
        F.col("p_name").alias("game_name"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("publish_date"),
    )


def feed_b(spark: SparkSession, folder: str) -> DataFrame:
    """author, score, game_name, date, type, platform; whole scores and months, so that rows repeat."""
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("game_id"), "p_name", "p_type")
    return event_reviews(spark, folder).join(names, "game_id").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.floor("rating").cast("double").alias("score"),
        F.col("p_name").alias("game_name"),
        F.date_format("ts", "yyyy-MM").alias("date"),
        F.col("event_type").alias("type"),
        F.col("p_type").alias("platform"),
    )


def looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """One title per part: query_name and the part's columns."""
    parts = table(spark, folder, "part")
    return parts.withColumn("query_name", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))


def _day(year: Column, tail: str) -> Column:
    return F.concat(year.cast("string"), F.lit(tail))


def _named(*names: Column) -> Column:
    return F.array(*[F.struct(n.alias("name")) for n in names])


def _search(rows: DataFrame, payload: Column) -> DataFrame:
    return rows.select("query_name", payload.alias("payload"))


def rawg_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search answers and detail objects."""
    size = F.col("p_size")
    search = F.struct(F.array(F.struct(F.col("p_partkey").alias("id"))).alias("results"))
    late = F.when(F.col("p_type") == "LARGE", 2).otherwise(1)
    detail = F.struct(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "query_name", "p_type").alias("name"),
        _day(size + 1990 + late, "-01-15").alias("released"),
        (size / 10.0).alias("rating"),
        (size * 2).alias("metacritic"),
        size.alias("playtime"),
        F.array(F.struct(F.struct(F.col("p_type").alias("name")).alias("platform"))).alias("platforms"),
        _named(F.split("p_name", " ")[0]).alias("genres"),
        _named(F.col("p_brand"), F.lit("tagged")).alias("tags"),
        F.when(F.col("p_type") != "SMALL", F.struct(F.lit("Teen").alias("name"))).alias("esrb_rating"),
        _named(F.col("p_brand")).alias("developers"),
        _named(F.concat(F.lit("pub "), F.col("p_brand"))).alias("publishers"),
        F.concat(F.lit("about "), F.col("query_name")).alias("description_raw"),
    )
    details = rows.select(F.col("p_partkey").alias("id"), F.to_json(detail).alias("payload"))
    return _search(rows, F.to_json(search)), details


def igdb_payloads(rows: DataFrame) -> DataFrame:
    game = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("query_name").alias("name"),
        _named(F.lit("Single player")).alias("game_modes"),
        F.struct(F.lit("Main Game").alias("type")).alias("game_type"),
        F.when(F.col("p_type") != "MEDIUM", _named(F.col("p_brand"))).alias("keywords"),
        F.array(F.struct(F.struct(F.lit("English").alias("name")).alias("language"))).alias("language_supports"),
        F.when(F.col("p_type") != "LARGE", _named(F.col("p_type"), F.lit("PC"))).alias("platforms"),
        _named(F.lit("Side view")).alias("player_perspectives"),
        _named(F.split("p_name", " ")[1]).alias("themes"),
        F.when(F.col("p_size") > 10, F.col("p_size") * 2.0).alias("rating"),
        F.when(F.col("p_type") != "PROMO", F.col("p_partkey") * 864000).alias("first_release_date"),
        _named(F.split("p_name", " ")[0]).alias("genres"),
        F.when(F.col("p_type") != "SMALL", F.struct(F.concat(F.lit("i/"), F.col("p_partkey")).alias("url"))).alias("cover"),
        F.concat(F.lit("sum "), F.col("query_name")).alias("summary"),
    )
    return _search(rows, F.to_json(F.array(game)))


def hltb_payloads(rows: DataFrame) -> DataFrame:
    """Two results each, the better one last."""
    size = F.col("p_size")

    def result(name: Column, similarity: float) -> Column:
        return F.struct(
            name.alias("game_name"),
            F.lit("game").alias("game_type"),
            (size * 2.0).alias("review_score"),
            F.array(F.col("p_type")).alias("profile_platforms"),
            (size + 1900).alias("release_world"),
            (size * 1.0).alias("main_story"),
            (size * 1.5).alias("main_extra"),
            (size * 2.0).alias("completionist"),
            F.lit(similarity).alias("similarity"),
        )

    answer = F.array(result(F.lit("something else"), 0.2), result(F.translate("query_name", "io", "10"), 0.8))
    return _search(rows, F.to_json(answer))


def xml_payloads(rows: DataFrame) -> DataFrame:
    """Anchor answers; small parts get an unrelated first hit, SMALL ones no description, LARGE ones a deeper game."""
    deep = F.col("p_type") == "LARGE"
    first = F.concat(F.upper(F.left("query_name", F.lit(1))), F.substr("query_name", F.lit(2)))
    name = F.when(F.col("p_size") <= 5, F.lit("unrelated hit 0123456789")).otherwise(first)
    about = F.concat(F.lit("<description>deck "), F.col("query_name"), F.lit("</description>"))
    text = F.concat(
        F.lit("<response><number_of_total_results>1</number_of_total_results><results>"),
        F.when(deep, F.lit("<page><section>")).otherwise(F.lit("")),
        F.lit("<game><id>"),
        F.col("p_partkey").cast("string"),
        F.lit("</id><name>"),
        name,
        F.lit("</name>"),
        F.when(F.col("p_type") == "SMALL", F.lit("")).otherwise(about),
        F.lit("<release_date>"),
        _day(F.col("p_size") + 1990, "-03-01 12:00:00"),
        F.lit("</release_date><theme><name>"),
        F.col("p_brand"),
        F.lit("</name></theme><genre><name>"),
        F.split("p_name", " ")[0],
        F.lit("</name></genre><genre><name>"),
        F.split("p_name", " ")[1],
        F.lit("</name></genre><image><original>g/"),
        F.col("p_partkey").cast("string"),
        F.lit("</original></image></game>"),
        F.when(deep, F.lit("</section></page>")).otherwise(F.lit("")),
        F.lit("</results></response>"),
    )
    return _search(rows, text)


def metacritic_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search answers (a person, a remake and the game itself) and game pages."""
    slug = F.concat(F.lit("s-"), F.col("p_partkey").cast("string"))

    def item(kind: str, title: Column, target: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), title.alias("title"), target.alias("slug"))

    items = F.array(
        item("person", F.col("query_name"), F.lit("nobody")),
        item("game-title", F.concat(F.col("query_name"), F.lit(" remade for all")), F.lit("missing-page")),
        item("game-title", F.concat_ws(" ", "query_name", "p_brand"), slug),
    )
    search = F.to_json(F.struct(F.struct(items.alias("items")).alias("data")))

    about = F.to_json(
        F.struct(
            F.concat_ws(" ", "query_name", "p_brand").alias("title"),
            _day(F.col("p_size") + 1991, "-06-01").alias("releaseDate"),
            F.struct(
                F.array(
                    F.struct(F.lit("Developer").alias("typeName"), F.concat(F.lit("dev "), F.col("p_brand")).alias("name")),
                    F.struct(F.lit("Publisher").alias("typeName"), F.concat(F.lit("pub "), F.col("p_type")).alias("name")),
                ).alias("companies")
            ).alias("production"),
            _named(F.col("p_type")).alias("genres"),
            _named(F.lit("Console")).alias("platforms"),
        )
    )

    def score(value: Column, top: int) -> Column:
        return F.to_json(F.struct(value.alias("score"), F.lit(top).alias("max")))

    empty = F.lit("{}")
    critics = score(F.when(F.col("p_type") != "SMALL", F.col("p_size") * 2), 100)
    users = score(F.col("p_size") / 5.0, 10)
    holders = [F.concat(F.lit('{"data":{"item":'), c, F.lit("}}")) for c in (about, critics, users)]
    places = [holders[0], *[empty] * 5, holders[1], empty, holders[2]]
    page = F.concat(F.lit('{"components":['), F.concat_ws(",", *places), F.lit("]}"))
    # MEDIUM parts have a page that breaks off before the user score.
    short = F.concat(F.lit('{"components":['), F.concat_ws(",", *places[:8]), F.lit("]}"))
    pages = rows.select(slug.alias("slug"), F.when(F.col("p_type") == "MEDIUM", short).otherwise(page).alias("payload"))
    return _search(rows, search), pages
