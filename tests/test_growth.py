"""Steps whose memory, disk or time must not grow faster than their tables."""

from __future__ import annotations

import time
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from ludomill.functions.text import percent_alike
from ludomill.operators import alike as A
from ludomill.operators import evaluate as V
from ludomill.operators import normalise as N
from ludomill.operators import resolve as R
from ludomill.operators.transitions import transitions
from ludomill.plans import tables as T
from ludomill.session import fresh_folder, settle
from ludomill.sources import readers, sinks


@contextmanager
def set_to(spark, name, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def parts(spark, count):
    """A part table in a folder of its own: small as a file, with rows that become wide records."""
    folder = fresh_folder(spark, "parts")
    rows = spark.range(count).select(
        F.col("id").alias("p_partkey"),
        F.lit("blue ring").alias("p_name"),
        F.concat(F.lit("Brand#"), F.col("id") % 20).alias("p_brand"),
        F.element_at(F.array(*[F.lit(x) for x in ("LARGE", "SMALL", "ECONOMY")]), (F.col("id") % 3 + 1).cast("int")).alias("p_type"),
        (F.col("id") % 50 + 1).cast("int").alias("p_size"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return T.looked_up(spark, folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sources(rows):
    return {
        "gamespot": N.xml_game_hits(T.xml_payloads(rows)),
        "rawg": N.rawg_hits(*T.rawg_payloads(rows)),
        "igdb": N.igdb_hits(T.igdb_payloads(rows)),
        "hltb": N.hltb_hits(T.hltb_payloads(rows)),
        "metacritic": N.metacritic_hits(*T.metacritic_payloads(rows)),
    }


def test_accepted_hits_send_no_source_to_every_task(spark):
    rows = parts(spark, 300)
    verified = R.verify_hits(rows.select(F.col("query_name").alias("game_name")), sources(rows))
    assert "BroadcastHashJoin" not in plan(verified)
    assert verified.count() == 300


def test_golden_records_are_not_sent_to_every_task(spark):
    rows = parts(spark, 3000)
    # A record takes about a kilobyte; chunk totals need one megabyte whatever their rows.
    with set_to(spark, "spark.sql.maxBroadcastTableSize", "2m"):
        table = R.game_table(rows.select(F.col("query_name").alias("game_name")), sources(rows))
        assert table.filter("name <> ''").count() == 3000


def test_metacritic_pages_are_not_sent_to_every_task(spark):
    hits = N.metacritic_hits(*T.metacritic_payloads(parts(spark, 300)), 3)
    assert "BroadcastHashJoin" not in plan(hits)
    assert hits.count() == 300


def test_game_vectors_are_not_sent_to_every_task(spark):
    folder = fresh_folder(spark, "vectors")
    vector = F.array_repeat(F.col("id").cast("double"), 324).alias("vector")
    spark.range(16000).select(F.col("id").alias("game_id"), vector).coalesce(1).write.parquet(folder)
    reviews = spark.range(16000).select(
        F.col("id").alias("review_id"), (F.col("id") % 7).alias("user_id"), F.col("id").alias("game_id"),
        F.lit(5.0).alias("rating"), F.col("id").alias("ts"),
    )
    with set_to(spark, "spark.sql.maxBroadcastTableSize", "33m"):
        rows = transitions(reviews, spark.read.parquet(folder), 324)
        assert rows.agg(F.sum(F.get("action", F.lit(323)))).first()[0] == sum(range(16000))


def test_xml_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    path = str(tmp_path / "xml")
    rows = spark.range(25).coalesce(1).select("id", F.concat(F.lit("game "), F.col("id")).alias("name"))
    sinks.write_xml(rows, path, "response", "game", records=10)
    assert len(list((tmp_path / "xml").glob("part-*"))) == 3
    assert sorted(r.id for r in readers.read_xml_games(spark, path).collect()) == list(range(25))


def test_bounds_and_pairs_of_the_search_are_handed_on_in_parts(spark, monkeypatch):
    numbers = np.random.default_rng(5).normal(size=(3000, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(numbers)], "item_id long, vector array<double>")
    queries = items.filter("item_id < 300").withColumnRenamed("item_id", "query_id").coalesce(1)
    blocks = V._Blocks(items, "dot", 8)
    sizes = []
    monkeypatch.setattr(type(queries), "mapInPandas", lambda df, function, schema: sizes.extend(len(p) for p in function([df.toPandas()])) or df)
    blocks.visits(queries.withColumn("least", F.lit(None).cast("double")), 0, None, 6)
    assert sum(sizes) > 50_000 and max(sizes) <= V.PAIR_ROWS


def test_links_connect_as_all_accepted_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(A, "LINK_BLOCK", 16)
    random = np.random.default_rng(3)
    words = ["ring", "bolt", "blue", "cold"]
    rows = [
        (i, int(random.integers(2)), f"{words[random.integers(4)]} {words[random.integers(4)]} {random.integers(10**4)}", f"{words[random.integers(4)]}s")
        for i in range(120)
    ]
    frame = spark.createDataFrame(rows, "node int, year int, text string, note string")
    links = [tuple(r) for r in A.similar_links(frame, 90, 70, ["year"]).collect()]

    def classes(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    whole = []
    for a, year, text, note in rows:
        for b, other_year, other, other_note in rows[:a]:
            score = percent_alike(text, other)
            if year == other_year and (score > 90 or (score >= 70 and percent_alike(note, other_note) > 90)):
                whole.append((a, b))
    assert set(links) <= {pair for a, b in whole for pair in ((a, b), (b, a))}
    assert classes(links) == classes(whole)
    # Blocks of a year meet in pairs, and each hands on fewer links than it has nodes.
    assert len(links) < len(whole)


def numbered(spark, rows):
    """Titles that differ in their numbers, and a catalogue that spells half of them its own way."""
    stems = ["hot bolt", "large ring", "blue anvil", "new plate", "small rod", "gutsy vase", "old clock", "wide chair"]
    names = [(f"{stems[i % 8]} {i * 37}", i % 3 + 2000) for i in range(rows)] + [("nothing of the sort", 2001), ("", 2001), (None, 2001)]
    titles = spark.createDataFrame([(n, f"{y}-01-01") for n, y in names], "game_name string, anchor_release string")
    spelled = [(i, n and (f"the {n}" if i % 2 else n[::-1] if i % 16 == 6 else n), f"{y + 1}-05-05") for i, (n, y) in enumerate(names[:-3])]
    return titles, spark.createDataFrame([*spelled, (-1, None, None)], "entry_id long, name string, release string"), names, spelled


def best_by_hand(names, spelled, accepted):
    best = {}
    for name, year in names:
        found = [(-p, e, s, r) for e, s, r in spelled if name and (p := percent_alike(name, s)) > 65 and accepted(p, year, r)]
        if found:
            best[name] = min(found)
    return {(n, e, s, r, -p) for n, (p, e, s, r) in best.items()}


def met_pairs(monkeypatch):
    """Counts the pairs of texts that are dealt to the same blocks."""
    counted, old = [], A._met_blocks

    def count(left, right, on, *more):
        if on:
            sizes = [s.groupBy(*on).agg(F.count("*").alias(n)) for s, n in ((left, "a"), (right, "b"))]
            counted.append(sizes[0].join(sizes[1], list(on)).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0])
        else:
            counted.append(left.count() * right.count())
        return old(left, right, on, *more)

    monkeypatch.setattr(A, "_met_blocks", count)
    return counted


def test_anchor_match_scores_near_classes_only(spark, monkeypatch):
    titles, catalogue, names, spelled = numbered(spark, 800)
    counted = met_pairs(monkeypatch)
    found = {tuple(r) for r in R.match_anchor_catalogue(titles, catalogue).collect()}
    assert found == best_by_hand(names, spelled, lambda *_: True)
    assert sum(counted) < 0.5 * 800 * 800


def close(year, release):
    return abs(year - int(release[:4])) <= 1


def test_titles_with_a_near_name_are_not_looked_for_in_their_years(spark, monkeypatch):
    titles, catalogue, names, spelled = numbered(spark, 400)
    asked, old = [], R.most_similar
    monkeypatch.setattr(R, "most_similar", lambda left, *more, **on: asked.append(left.select("text").distinct().count()) or old(left, *more, **on))
    found = {tuple(r) for r in R.best_matches(titles, catalogue).collect()}
    assert found == best_by_hand(names, spelled, lambda p, year, release: p > 90 or close(year, release))
    assert asked[0] < 300 and asked[0] > asked[1]


def test_entries_come_along_with_their_pairs(spark):
    titles, catalogue, names, spelled = numbered(spark, 200)
    left = spark.createDataFrame([("hot bolt 12", 1)], "text string, year int")
    right = spark.createDataFrame([("hot bolt 13", 1, 7), ("hot bolt 13", 1, 8), ("hot bolt 13", 2, 9)], "text string, year int, entry_id int")
    assert sorted(r.entry_id for r in A.similar_pairs(left, right, 66, on=["year"], kept=["entry_id"]).collect()) == [7, 8]
    found = [tuple(r) for r in R.match_catalogue(titles, catalogue).collect()]
    whole = [(n, e, s, r, percent_alike(n, s)) for n, y in names if n for e, s, r in spelled]
    years = dict(names)
    assert sorted(found) == sorted(w for w in whole if w[4] > 90 or (w[4] > 65 and close(years[w[0]], w[3])))


def test_similar_titles_meet_below_near_developers_only(spark, monkeypatch):
    stems = ["hot bolt", "large ring", "blue anvil", "new plate"]
    houses = ["north wind games", "north winds games", "old mill", "", None, "red fox", "blue moon", "far shore"]
    rows = [(f"{stems[i % 4]} {i * 37}", houses[i // 4 % 8], 2000 + i % 2) for i in range(400)]
    left = spark.createDataFrame(rows, "title string, developer string, release_year int")
    right = spark.createDataFrame([(f"{t} b" if i % 3 else t, d, y) for i, (t, d, y) in enumerate(rows)], left.schema)
    counted = met_pairs(monkeypatch)
    found = {(r.year, r.left_text, r.right_text, r.percent, r.left_developer, r.right_developer, r.developer_percent, r.tier)
             for r in R.tiered_matches(left, right).collect()}

    def ordered_words(text):
        return text and " ".join(sorted(text.split()))

    ordered = [(ordered_words(t), ordered_words(d), y) for t, d, y in rows]
    others = [(ordered_words(f"{t} b" if i % 3 else t), ordered_words(d), y) for i, (t, d, y) in enumerate(rows)]
    whole = set()
    for t, d, y in ordered:
        for u, e, z in others:
            score = percent_alike(t, u) if y == z else 0
            if score >= 70:
                alike = percent_alike(d, e)
                if score > 90 or alike > 90:
                    whole.add((y, t, u, score, d, e, alike, "title" if score > 90 else "developer"))
    assert found == whole and {w[7] for w in whole} == {"title", "developer"}
    assert sum(counted) < 0.7 * 2 * 200 * 200


def bytes_written(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def test_transitions_write_a_vector_once_a_chunk(spark):
    random = np.random.default_rng(7)
    vectors = [(g, [None if g == 3 and i == 5 else float(x) for i, x in enumerate(random.normal(size=324))]) for g in range(4)]
    games = spark.createDataFrame(vectors, "game_id long, vector array<double>")
    rows = [(i, i % 3 % 2, [0, 1, 2, 3, 9, None][int(random.integers(6))], float(i % 10), i // 3) for i in range(4000)]
    reviews = spark.createDataFrame(rows, "review_id long, user_id long, game_id long, rating double, ts long")
    before = bytes_written(spark)
    got = {r.review_id: r for r in transitions(reviews, games, 324).collect()}
    assert bytes_written(spark) - before < 1 << 20
    known, sums, seen, last = dict(vectors), {}, {}, {}
    numbers = {g: np.array([np.nan if x is None else x for x in v]) for g, v in vectors}
    for review, user, game, _, _ in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        last[user] = review
        assert (review in got) == (game in known)
        if game in known:
            n, total = seen.get(user, 0), sums.get(user, np.zeros(324))
            assert got[review].step == n + 1 and got[review].action == [None if x is None else float(np.float32(x)) for x in known[game]]
            np.testing.assert_allclose(got[review].observation, total / max(n, 1), rtol=1e-5, atol=1e-6)
            seen[user], sums[user] = n + 1, total + numbers[game]
    assert {r.review_id for r in got.values() if r.terminal} == {r for r in last.values() if r in got}


def test_settled_tables_leave_no_shuffle_files(spark):
    context = spark.sparkContext._jsc.sc()
    before = context.env().blockManager().diskBlockManager().getAllFiles().size()
    settle(spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they are deleted beside the next steps
        if context.env().blockManager().diskBlockManager().getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert context.env().blockManager().diskBlockManager().getAllFiles().size() <= before


def test_search_writes_a_row_a_query_however_many_blocks_it_asks(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_PAIRS", 1 << 16)
    numbers = np.random.default_rng(11).normal(size=(1500, 32))
    numbers[700:720] = numbers[3]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(numbers)], "item_id long, vector array<double>")
    queries = items.withColumnRenamed("item_id", "query_id")
    itself = queries.select("query_id", F.col("query_id").alias("item_id"))
    before, visits = bytes_written(spark), []
    found = {(r.query_id, r["rank"], r.item_id) for r in V.best_items(queries, items, 5, excluded=itself, block_rows=8, visits=visits).collect()}
    # Most blocks of most queries are in question, and a pair of them would hold 256 bytes of vector.
    assert sum(visits) > 1500 * 90 and bytes_written(spark) - before < 8 << 20
    unit = numbers / np.linalg.norm(numbers, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 6)
    np.fill_diagonal(scores, -np.inf)
    assert found == {(q, k + 1, int(i)) for q in range(1500) for k, i in enumerate(np.argsort(-scores[q], kind="stable")[:5])}


def test_nodes_of_one_component_do_not_meet_again(spark, monkeypatch):
    monkeypatch.setattr(A, "LINK_BLOCK", 64)
    rows = [(i, 2000 + i % 2, f"{10_000 + i} bolt hot", "steel") for i in range(600)]
    rows += [(1000, 2001, "nothing of the sort", "steel"), (1001, 2001, "10007 bolt hot", "tin"), (1, 2003, "lone", "")]
    frame = spark.createDataFrame(rows, "node int, year int, text string, note string")
    asked, old = [], A._met_links
    monkeypatch.setattr(A, "_met_links", lambda rows, *more: asked.append(rows) or old(rows, *more))
    roots = {r.node: r.root for r in A.similar_groups(frame, 90, 70, ["year"]).collect()}
    assert roots == {**{i: i % 2 for i in range(600)}, 1000: 1000, 1001: 1}
    # Speakers only, and then the one year that holds more than one component, whose large one does not meet itself.
    assert asked[0].count() < 60
    assert {r.year for r in asked[1].select("year").distinct().collect()} == {2001}
    assert asked[1].filter("_first < 0").count() < 64 and asked[1].filter("_first >= 0 and _own >= _first and _own < _end").count() > 290


def test_pairs_leave_a_task_in_parts_and_texts_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 16)
    dealt, old = [], A._streamed
    monkeypatch.setattr(A, "_streamed", lambda left, right, *more: dealt.extend((left, right)) or old(left, right, *more))
    texts = [f"hot bolt {i * 7}" for i in range(70)]
    left = spark.createDataFrame([(t, y) for t in texts for y in (1, 2)], "text string, year int")
    right = spark.createDataFrame([(f"{t} b", y, i) for i, t in enumerate(texts) for y in (2, 3)], "text string, year int, entry_id int")
    found = A.similar_pairs(left, right, 80, on=["year"], kept=["entry_id"])
    want = {(2, t, f"{u} b", p, i) for t in texts for i, u in enumerate(texts) if (p := percent_alike(t, f"{u} b")) >= 80}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 1000 and set(got) == want
    assert [d.count() for d in dealt] == [70, 70]
