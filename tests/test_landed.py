"""Files, sinks, sessions and incremental runs."""

import os

import pytest
from pyspark.sql import functions as F

from ludomill import session as J
from ludomill.operators import reviews as C
from ludomill.operators.static_tables import load_static_table
from ludomill.plans import jobs
from ludomill.sources import readers, sinks
from ludomill.streaming import incremental as I

PLAYS = "user_id long, game_id long, at long, rating double"


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('name,other,size,tags\n"a, ""b""",1,N/A,"[\'PC\', ""it\'s"", None]"\nNone,2,3.5,[]\nc,3,many,"[\'x\\\'y\']"\n')
    rows = readers.read_csv(spark, str(path), {"size": "double", "name": "string", "tags": "string"})
    found = rows.withColumn("tags", readers.listed_cell("tags")).collect()
    assert [tuple(r) for r in found] == [(None, 'a, "b"', ["PC", "it's", None]), (3.5, None, []), (None, "c", ["x'y"])]


def test_static_tables(spark, tmp_path):
    path = tmp_path / "hltb.csv"
    path.write_text(
        "id,type,name,platform,genres,developer,publisher,release_year,main_story,main_plus_sides,completionist\n"
        "1,game,a,PC,g,d,p,1999,1,2,3\n2,dlc,b,PC,g,d,p,1999,1,2,3\n3,game,c,PC,g,d,p,1999,1,,3\n"
    )
    rows = load_static_table(spark, str(path), "hltb")
    assert rows.columns[0] == "name" and "type" not in rows.columns
    assert [r.name for r in rows.collect()] == ["a"]
    path = tmp_path / "reviews.csv"
    path.write_text('Review Title,Gaming Console name,x,Time Since Review,Rating/10\nt,PC,0,"2 days",7\nu,PC,0,1 day,\n')
    assert [tuple(r) for r in load_static_table(spark, str(path), "reviews").collect()] == [("t", "PC", "2 days", 7.0)]
    path = tmp_path / "metacritic.csv"
    path.write_text('title,releaseDate,genres,description,platforms,metascore,userscore,developer,publisher\n'
                    'a,2000,g,"two\nlines",PC,90,8.1,d,p\nb,2000,g,x,PC,tbd,8.1,d,p\n')  # fmt: skip
    (row,) = load_static_table(spark, str(path), "metacritic").collect()
    assert row.description == "two\nlines" and row.metascore == 90.0


def test_xml_reviews_at_any_depth(spark, tmp_path):
    (tmp_path / "page.xml").write_text(
        "<response><status>1</status><results><review><authors>Ann</authors><score>7.5</score>"
        "<game><id>1</id><name>A</name></game><publish_date>2020-01-01 00:00:00</publish_date></review>"
        "<deep><review><authors>Bob</authors><game><name>B</name></game></review></deep></results></response>"
    )
    rows = sorted(tuple(r) for r in readers.read_xml_reviews(spark, str(tmp_path)).collect())
    assert rows == [("Ann", 7.5, "A", "2020-01-01 00:00:00"), ("Bob", 0.0, "B", None)]


def test_feeds(spark):
    a = spark.createDataFrame([("x", 1.0, "g", "d"), ("x", 1.0, "g", "d")], "authors string, score double, game_name string, publish_date string")
    b = spark.createDataFrame(
        [("y", 1.0, "g", None, "t", "p"), ("y", 1.0, "g", None, "t", "p"), ("y", 2.0, "g", None, "t", "p")],
        "author string, score double, game_name string, date string, type string, platform string",
    )
    merged = C.union_feeds(a, b)
    assert merged.columns == ["author", "score", "game_name", "date", "type", "platform"]
    assert merged.count() == 4
    total, sample = C.repeat_report(b)
    assert total.first().duplicate_rows == 1 and sample.count() == 1
    assert C.repeat_report(a.limit(1))[0].first().duplicate_rows == 0


def test_transitions_in_user_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    one = F.array(F.lit(1.0))
    rows = spark.range(100).select(
        (F.col("id") % 7).alias("user_id"), one.alias("observation"), one.alias("action"), (F.col("id") > 92).cast("float").alias("terminal")
    )
    shape = sinks.write_transitions(rows, path, buckets=4)
    assert shape == {"transitions": 100, "terminals": 7, "observation_width": 1, "action_width": 1}
    back = spark.read.parquet(path)
    assert back.count() == 100
    assert back.groupBy("user_id").agg(F.count_distinct("user_bucket").alias("n")).filter("n > 1").count() == 0


def test_shared_folder_prefers_the_setting(spark, tmp_path, monkeypatch):
    class Context:
        master = "yarn"

        def __init__(self):
            self.folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, settings):
            self.sparkContext = Context()
            self.conf = settings

    assert J.shared_folder(Session({"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        J.shared_folder(Session({}))
    first, second = J.fresh_folder(spark, "x"), J.fresh_folder(spark, "x")
    assert first != second and first.startswith(J.shared_folder(spark))


def test_replayed_files_add_nothing(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, ts timestamp"
    rows = spark.range(50).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    for _ in range(3):
        rows.coalesce(1).write.mode("append").parquet(landing)
        stream = I.landed_stream(spark, landing, schema, files_per_batch=1)
        I.unseen_run(stream, table, checkpoint, ["id"], ["ts"]).awaitTermination()
    assert spark.read.parquet(table).count() == 50


def test_late_rows_and_old_keys(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, ts timestamp"

    def land(low, high, base):
        rows = spark.range(low, high).select("id", F.timestamp_seconds(F.col("id") * 86_400 + base).alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(landing)
        stream = I.landed_stream(spark, landing, schema, files_per_batch=1)
        I.unseen_run(stream, table, checkpoint, ["id"], ["ts"]).awaitTermination()

    land(500, 560, 1_700_000_000)
    land(0, 50, 1_000_000_000)  # never seen, decades late
    land(500, 560, 1_900_000_000)  # seen long ago
    assert spark.read.parquet(table).count() == 110


def test_keys_are_state_and_not_read_from_the_table(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, ts long, body string"

    def land(rows, checkpoint=checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = I.landed_stream(spark, landing, schema, files_per_batch=1)
        I.unseen_run(stream, table, checkpoint, ["id"], ["ts"]).awaitTermination()

    def state():
        return sorted((r.id is None, r.id or 0, r.body) for r in spark.read.parquet(table).collect())

    # The first row of a key by time; a missing key is a key.
    land([(1, 5, "b"), (1, 3, "a"), (2, 9, "c"), (None, 1, "n"), (None, 2, "o")])
    assert state() == [(False, 1, "a"), (False, 2, "c"), (True, 0, "n")]
    # With the table gone the keys are still known: no batch reads it.
    os.rename(table, f"{table}-elsewhere")
    land([(1, 0, "z"), (3, 1, "d"), (None, 0, "z")])
    assert state() == [(False, 3, "d")]
    # A new checkpoint is filled from the table, which now lacks the rows that were moved.
    land([(4, 1, "e"), (3, 1, "z")], f"{checkpoint}-new")
    assert [b for _, i, b in state() if i == 3] == ["d"]
    assert {b for _, _, b in state()} == {"a", "c", "d", "e", "n"}


def test_settled_tables_can_be_dropped(spark):
    rows = J.settle(spark.range(5))
    folder = J.shared_folder(spark).removeprefix("file:")
    assert rows.count() == 5 and any(n.startswith("settled-") for n in os.listdir(folder))
    J.drop_settled(spark)
    assert not any(n.startswith("settled-") for n in os.listdir(folder))


def plays(spark, rows):
    return spark.createDataFrame(rows, PLAYS)


def test_feedback_survives_a_half_done_batch(spark, tmp_path):
    path = str(tmp_path / "feedback")
    keys, order = ["user_id", "game_id"], ["at"]

    def state():
        return sorted((r.user_id, r.game_id, r.rating) for r in I.read_feedback(spark, path, PLAYS).collect())

    I.apply_feedback(plays(spark, [(1, 1, 1, 5.0), (2, 1, 1, 6.0), (1, 1, 2, 7.0)]), 0, path, keys, order, 4)
    assert state() == [(1, 1, 7.0), (2, 1, 6.0)]
    batch = plays(spark, [(1, 1, 1, 0.0), (2, 1, 9, 1.0), (3, 3, 1, 2.0)])
    for _ in range(2):  # the second time is the replay after a crash
        I.apply_feedback(batch, 1, path, keys, order, 4)
        assert state() == [(1, 1, 7.0), (2, 1, 1.0), (3, 3, 2.0)]
    I.apply_feedback(plays(spark, []), 2, path, keys, order, 4)
    assert len(state()) == 3
    for version in range(3, 7):
        I.apply_feedback(batch, version, path, keys, order, 4)
        assert len(state()) == 3
    kept = [len(os.listdir(os.path.join(path, b))) for b in os.listdir(path) if b.startswith("bucket=")]
    assert max(kept) <= 2


def test_review_job_end_to_end(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "1.xml").write_text(
        "<response><review><authors>Ann</authors><score>8</score><game><name>A</name></game></review></response>"
    )
    summaries = spark.createDataFrame(
        [("a", '{"data":{"item":{"positive":[{"author":"Bob"},{"author":""}],"neutral":[{"author":"Cy"}]}}}'), ("b", "{}")],
        "slug string, payload string",
    )
    item = '{"author":"%s","score":9,"date":"d","platform":"PC","reviewedProduct":{"title":"A","type":"game-title"}}'
    page = '{"data":{"totalResults":%d,"items":[%s]}}'
    pages = spark.createDataFrame(
        [("Bob", 0, page % (3, ",".join(item.replace('"d"', f'"d{i}"') % "Bob" for i in range(3)))), ("Cy", 0, page % (2, item % "Cy")), ("Dan", 0, page % (9, item % "Dan"))],
        "author string, page long, payload string",
    )
    out = str(tmp_path / "reviews")
    jobs.review_corpus(spark, str(tmp_path / "xml"), summaries, pages, out)
    rows = sorted((r.author, r.score, r.type) for r in spark.read.parquet(out).collect())
    assert rows == [("Ann", 8.0, None), *[("Bob", 9.0, "game-title")] * 3]
    assert sorted(r.author for r in C.page_gaps(pages).collect()) == ["Cy", "Dan"]
    repeated = spark.createDataFrame([("Bob", 0, page % (3, ",".join([item % "Bob"] * 3)))], "author string, page long, payload string")
    assert [r.landed for r in C.page_gaps(repeated).collect()] == [1]
    assert os.path.exists(out)


def test_game_jobs_end_to_end(spark, tmp_path, folder):
    from ludomill.plans import tables as T

    parts = T.looked_up(spark, folder).filter("p_partkey < 30")
    searches, details = T.rawg_payloads(parts)
    found, pages = T.metacritic_payloads(parts)

    def land(frame, source, name="query_name", at="2024-01-01"):
        return frame.select(
            F.lit(source).alias("source"), F.col(name).cast("string").alias("query_name"),
            F.lit(at).cast("timestamp").alias("fetched_at"), "payload",
        )

    old = T.igdb_payloads(parts).withColumn("payload", F.lit("[]"))
    landed = land(searches, "rawg").union(land(details, "rawg_detail", "id")).union(land(found, "metacritic"))
    landed = landed.union(land(pages, "metacritic_page", "slug")).union(land(T.igdb_payloads(parts), "igdb"))
    landed = landed.union(land(old, "igdb", at="2023-01-01")).union(land(T.hltb_payloads(parts), "hltb"))
    landed = landed.union(land(T.xml_payloads(parts), "gamespot"))
    titles = parts.select(F.col("query_name").alias("game_name"), "p_partkey")
    out = str(tmp_path / "games")
    jobs.game_master(titles.filter("p_partkey < 10"), landed, out)
    first = spark.read.parquet(out)
    assert first.count() == 10 and first.filter("name = ''").count() == 0
    jobs.more_games(titles, landed, J.settle(first), out)
    games = spark.read.parquet(out)
    assert games.count() == 30 and games.select("game_name").distinct().count() == 30
    assert sorted(r.id for r in games.select("id").collect()) == list(range(30))
    kept = {r.game_name: r.id for r in games.collect()}
    assert all(kept[r.game_name] < 10 for r in titles.filter("p_partkey < 10").collect())

    reviews = T.event_reviews(spark, folder)
    keyed = games.withColumn("game_id", F.element_at(F.split("game_name", " "), -1).cast("long")).drop("id")
    jobs.item_features(reviews, keyed, str(tmp_path / "features"))
    features = spark.read.parquet(str(tmp_path / "features"))
    assert {len(r.vector) for r in features.select("vector").collect()} == {324}
    jobs.item_embeddings(reviews, keyed.select("game_id", "name"), str(tmp_path / "embedded"))
    assert spark.read.parquet(str(tmp_path / "embedded")).count() == 30
    genres = jobs.genre_transitions(reviews, keyed.select("game_id", "genres"), str(tmp_path / "steps"))
    steps = spark.read.parquet(str(tmp_path / "steps"))
    assert steps.count() == reviews.filter("game_id < 30").count()
    assert len(steps.first().observation) == len(genres)
    jobs.feature_transitions(reviews, features, str(tmp_path / "wide"))
    assert len(spark.read.parquet(str(tmp_path / "wide")).first().action) == 324
    best = jobs.recommendations(reviews, features, 324)
    assert best.join(reviews, (best.query_id == reviews.user_id) & (best.item_id == reviews.game_id)).count() == 0


def test_unseen_run_under_a_session_with_another_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    base = J.fresh_folder(spark, "plain-store")
    landing, table = os.path.join(base, "landing"), os.path.join(base, "table")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        for keys in ((1, 2), (2, 3)):
            spark.createDataFrame([(k, 1) for k in keys], "k long, at long").coalesce(1).write.mode("append").parquet(landing)
            stream = I.landed_stream(spark, landing, "k long, at long", files_per_batch=1)
            I.unseen_run(stream, table, os.path.join(base, "checkpoint"), ["k"], ["at"]).awaitTermination()
        assert spark.conf.get(name).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(name, before)
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_keys_of_a_stream_are_not_handed_to_python_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "_PICK_ROWS", 3)
    landing, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "a long, b string, at double, body string"
    rows = [(1, "x", 2.0, "late"), (1, "x", 1.0, "first"), (1, None, 3.0, "n"), (1, None, None, "none"), (None, "x", 1.0, "k"), (2, "x", 5.0, "y")]
    known = [(2, "x", 0.0, "known"), (None, None, 0.0, "nulls")]
    spark.createDataFrame(known, schema).withColumn("batch", F.lit("0")).write.partitionBy("batch").parquet(table)
    spark.createDataFrame([*rows, *rows, (None, None, 1.0, "z")], schema).repartition(3).write.parquet(landing)
    stream = I.landed_stream(spark, landing, schema)
    plan = I.unseen(stream, ["a", "b"], ["at"])._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan
    I.unseen_run(stream, table, str(tmp_path / "state"), ["a", "b"], ["at"]).awaitTermination()
    assert sorted(r.body for r in spark.read.parquet(table).collect()) == ["first", "k", "known", "none", "nulls"]
