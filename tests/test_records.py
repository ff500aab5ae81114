"""Scalar rules, payload shapes and golden records on hand-made cases."""

import json

from pyspark.sql import functions as F

from ludomill.functions import scalars as S
from ludomill.operators import normalise as N
from ludomill.operators import resolve as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_unknown_values_are_skipped(spark):
    nan, none = F.lit(float("nan")), F.lit(None)
    row = one(
        spark,
        text=S.first_text(none.cast("string"), F.lit(""), F.lit("x"), F.lit("y")),
        no_text=S.first_text(F.lit("")),
        number=S.first_positive(nan, F.lit(-1.0), F.lit(0.0), none.cast("double"), F.lit(2.0)),
        no_number=S.first_positive(nan),
        lists=S.first_list(F.expr("cast(array() as array<string>)"), F.array(F.lit("a"))),
        bag=S.bag_concat(F.array(F.lit("a"), F.lit("")), none.cast("array<string>"), F.array(F.lit("a"), none)),
    )
    assert (row.text, row.no_text, row.number, row.no_number) == ("x", "", 2.0, 0.0)
    assert row.lists == ["a"] and row.bag == ["a", "", "a", None]


def test_scales_and_days(spark):
    row = one(
        spark,
        rating=S.per_scale(F.lit(4.0), 5),
        unknown=S.per_scale(F.lit(None), 5),
        no_score=S.score_ratio(F.lit(None), F.lit(10)),
        no_top=S.score_ratio(F.lit(0.5), F.lit(None)),
        zero_top=S.score_ratio(F.lit(0.5), F.lit(0)),
        day=S.iso_from_datetime(F.lit("2025-04-24 12:00:00")),
        bad_day=S.iso_from_datetime(F.lit("soon")),
        y1920=S.iso_from_year(F.lit(1920)),
        y1921=S.iso_from_year(F.lit(1921)),
        epoch=S.iso_from_epoch(F.lit(86399)),
        before=S.iso_from_epoch(F.lit(-1)),
        no_epoch=S.iso_from_epoch(F.lit(None)),
    )
    assert (row.rating, row.unknown, row.no_score, row.no_top, row.zero_top) == (0.8, 0.0, 0.0, 0.5, 0.0)
    assert (row.day, row.bad_day, row.y1920, row.y1921) == ("2025-04-24", "", "", "1921-01-01")
    assert (row.epoch, row.before, row.no_epoch) == ("1970-01-01", "1969-12-31", "")


def test_close_release(spark):
    cases = [("2000-01-01", "2001-12-31", True), ("2000-01-01", "2002-01-01", False), ("", "2000-01-01", False),
             (None, "2000-01-01", False), ("2000-13-01", "2000-01-01", False), ("2000-1-5", "2000-01-01", True)]
    frame = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert frame.filter(S.close_release("a", "b") != F.col("want")).count() == 0


def test_rewards(spark):
    row = one(
        spark,
        scaled=S.scaled_reward(F.lit(8.0)),
        neutral=S.ternary_reward(F.lit(5.0)),
        bonus=S.playtime_reward(F.lit(1.0), F.lit(10.0), F.lit(0.0), 0.5),
        none=S.playtime_reward(F.lit(-0.2), F.lit(10.0), F.lit(5.0), 0.5),
    )
    assert (row.scaled, row.neutral, row.bonus, row.none) == (0.6, 0.0, 1.0, -0.2)


def payloads(spark, rows, key="query_name"):
    return spark.createDataFrame([(k, p if isinstance(p, str) else json.dumps(p)) for k, p in rows], f"{key} string, payload string")


def test_sparse_payloads(spark):
    search = payloads(spark, [("q", {"results": [{"id": 7}, {"id": 8}]}), ("none", {"results": []}), ("bad", "oops")])
    detail = {"id": 7, "name": "Q", "platforms": [{"platform": None}, {"platform": {"name": "PC"}}]}
    details = spark.createDataFrame([(7, json.dumps(detail))], "id long, payload string")
    (row,) = N.rawg_hits(search, details).collect()
    assert row.game.platforms == ["PC"] and row.game.genres == [] and row.game.rawg_rating == 0.0
    assert row.game.esrb_rating == "" and row.game.main_story is None

    (row,) = N.igdb_hits(payloads(spark, [("q", [{"id": 1, "name": "Q"}, {"id": 2, "name": "R"}])])).collect()
    assert row.game.cover_url == [None] and row.game.release == "" and row.game.keywords == []

    xml = "<response><results><game><id>3</id><name>Q</name><release_date>x</release_date></game></results></response>"
    (row,) = N.xml_game_hits(payloads(spark, [("q", xml)])).collect()
    assert row.game.id == 3 and row.game.release == "" and row.game.cover_url == [None] and row.game.themes == []


def test_pages_need_nine_components(spark):
    def page(count):
        parts = [{"data": {"item": {}}} for _ in range(count)]
        parts[0]["data"]["item"] = {"title": f"game {count}"}
        return {"components": parts}

    pages = payloads(spark, [(f"s{n}", page(n)) for n in (7, 8, 9)], "slug")
    items = [{"type": "game-title", "title": f"game {n}", "slug": f"s{n}"} for n in (7, 8, 9)]
    search = payloads(spark, [("game 9", {"data": {"items": items}}), ("error", {"message": "none"})])
    (row,) = N.metacritic_hits(search, pages, 3).collect()
    assert row.game.name == "game 9" and row.game.metacritic_rating == 0.0 and row.pos == 0


def test_first_of_equal_titles_wins_and_zero_never_matches(spark):
    items = [{"type": "game-title", "title": t, "slug": s} for t, s in (("abd", "first"), ("abe", "second"), ("zzz", "never"))]
    search = payloads(spark, [("abc", {"data": {"items": items}}), ("q", {"data": {"items": items[2:]}})])
    assert [tuple(r) for r in N.best_slug(search).collect()] == [("abc", "first")]


def test_a_title_no_source_knows_still_has_a_record(spark):
    empty = spark.createDataFrame([], "query_name string, payload string")
    details = spark.createDataFrame([], "id long, payload string")
    pages = spark.createDataFrame([], "slug string, payload string")
    sources = {"gamespot": N.xml_game_hits(empty), "rawg": N.rawg_hits(empty, details), "igdb": N.igdb_hits(empty),
               "hltb": N.hltb_hits(empty), "metacritic": N.metacritic_hits(empty, pages)}
    titles = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "game_name string")
    rows = {r.game_name: r for r in R.game_table(titles, sources).collect()}
    assert {k: r.id for k, r in rows.items()} == {"a": 0, "b": 1}
    record = rows["a"].asDict()
    assert record["name"] == "" and record["main_story"] == 0.0 and record["genres"] == [] and record["keywords"] == [""]
