"""Ordered operators and transitions, also with one user holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from ludomill.functions import scalars as S
from ludomill.operators import embeddings as E
from ludomill.operators import features as Z
from ludomill.operators.ordered import CHUNK, dense_title_ids, in_chunks, top_per_key, with_position
from ludomill.operators.transitions import dataset_shape, transitions, unique_vectors

GAMES = [(101, ["Action", "RPG"]), (102, ["Strategy"]), (103, ["Action", "Souls-like"]), (104, ["RPG", "Turn-Based"])]
REVIEWS = [(0, 1, 101, 8.0, 100), (1, 1, 102, 4.0, 101), (2, 1, 103, 9.0, 102), (3, 2, 101, 7.0, 200), (4, 2, 104, 10.0, 201)]
SCHEMA = "review_id long, user_id long, game_id long, rating double, ts long"


def vectors(spark):
    games = spark.createDataFrame(GAMES, "game_id long, genres array<string>")
    terms = Z.vocabulary(games, "genres")
    assert terms == ["Action", "RPG", "Souls-like", "Strategy", "Turn-Based"]
    return games.select("game_id", S.multi_hot("genres", terms).alias("vector"))


def outcome(rows):
    found = sorted(rows.collect(), key=lambda r: (r.user_id, r.step))
    return [
        (r.user_id, r.review_id, r.observation, r.action, round(r.reward, 6), r.terminal) for r in found
    ]


def test_known_transitions(spark):
    rows = transitions(spark.createDataFrame(REVIEWS, SCHEMA), vectors(spark), 5)
    assert outcome(rows) == [
        (1, 0, [0, 0, 0, 0, 0], [1, 1, 0, 0, 0], 0.6, 0),
        (1, 1, [1, 1, 0, 0, 0], [0, 0, 0, 1, 0], -0.2, 0),
        (1, 2, [0.5, 0.5, 0, 0.5, 0], [1, 0, 1, 0, 0], 0.8, 1),
        (2, 3, [0, 0, 0, 0, 0], [1, 1, 0, 0, 0], 0.4, 0),
        (2, 4, [1, 1, 0, 0, 0], [0, 1, 0, 0, 1], 1.0, 1),
    ]
    assert tuple(dataset_shape(rows).first()) == (5, 2, 2, 5, 5)


def test_last_review_of_an_unknown_game(spark):
    reviews = spark.createDataFrame([(0, 3, 101, 6.0, 1), (1, 3, 999, 9.0, 2), (2, None, 101, 1.0, 3)], SCHEMA)
    (row,) = outcome(transitions(reviews, vectors(spark), 5))
    assert row == (3, 0, [0, 0, 0, 0, 0], [1, 1, 0, 0, 0], 0.2, 0)
    (row,) = outcome(transitions(reviews, vectors(spark), 5, terminal="last_kept"))
    assert row[-1] == 1
    with pytest.raises(ValueError):
        transitions(reviews, vectors(spark), 5, terminal="never")


def test_repeated_games_do_not_multiply(spark):
    once = outcome(transitions(spark.createDataFrame(REVIEWS, SCHEMA), vectors(spark), 5))
    twice = vectors(spark).union(spark.createDataFrame([(101, [0.0] * 5), (102, [0.0] * 5)], "game_id long, vector array<double>"))
    assert outcome(transitions(spark.createDataFrame(REVIEWS, SCHEMA), twice, 5)) == once


def test_a_user_with_most_rows_at_one_time(spark):
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.8 else rng.randint(2, 20), rng.choice([101, 102, 103, 104, 999]), 6.0, rng.choice([7, 7, 7, 8])) for i in range(3000)]
    reviews = spark.createDataFrame(rows, SCHEMA)
    chunked = in_chunks(reviews, ["user_id", "ts", "review_id"])
    assert chunked.filter("user_id = 1").select(CHUNK).distinct().count() > 4
    sizes = [r["count"] for r in chunked.groupBy(CHUNK).count().collect()]
    assert max(sizes) < 1000

    labels = dict(GAMES)
    terms = sorted({x for _, xs in GAMES for x in xs})
    expected = []
    for user in sorted({r[1] for r in rows}):
        seen, total = 0, [0] * 5
        history = sorted((r for r in rows if r[1] == user), key=lambda r: (r[4], r[0]))
        for place, (review, _, game, _, _) in enumerate(history):
            if game in labels:
                hot = [float(t in labels[game]) for t in terms]
                expected.append((user, review, [t / seen if seen else 0.0 for t in total], hot, place == len(history) - 1))
                seen, total = seen + 1, [a + b for a, b in zip(total, hot)]
    found = outcome(transitions(reviews, vectors(spark), 5))
    assert len(found) == len(expected)
    for got, want in zip(found, expected):
        assert got[:2] == want[:2] and got[3] == want[3] and got[5] == want[4]
        assert got[2] == pytest.approx(want[2], abs=1e-6)


@pytest.mark.parametrize(("repeats", "kept"), [("all", [0, 1, 2]), ("max", [0, 2]), ("mean", [1, 2])])
def test_repeated_reviews(spark, repeats, kept):
    reviews = spark.createDataFrame([(0, 1, 101, 9.0, 1), (1, 1, 101, 3.0, 2), (2, 1, 102, 5.0, 3)], SCHEMA)
    found = outcome(transitions(reviews, vectors(spark), 5, repeats=repeats))
    assert [r[1] for r in found] == kept
    if repeats == "mean":
        assert found[0][4] == 0.2


def test_last_vector_of_a_repeated_game_counts(spark):
    games = spark.createDataFrame([(1, 0, [0.0]), (1, 1, [1.0]), (2, 0, [2.0])], "game_id long, place int, vector array<double>")
    assert {r.game_id: r.vector for r in unique_vectors(games, ["place"]).collect()} == {1: [1.0], 2: [2.0]}


def test_positions(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "k int, v int")
    assert with_position(rows, ["k"], ["v"], "p").filter("p <> floor(v / 3)").count() == 0
    assert with_position(rows, [], ["v"], "p").filter("p <> v").count() == 0
    titles = spark.createDataFrame([(t,) for t in ["b", "Z", "é", "a", None, "b"]], "game_name string")
    assert sorted(tuple(r) for r in dense_title_ids(titles).collect()) == [(0, "Z"), (1, "a"), (2, "b"), (3, "é")]
    best = top_per_key(rows, ["k"], [F.desc("v")], 2).collect()
    assert sorted((r.k, r.v) for r in best) == [(0, 495), (0, 498), (1, 496), (1, 499), (2, 494), (2, 497)]


def test_long_histories_become_several_sentences(spark, monkeypatch):
    monkeypatch.setattr(E, "SENTENCE_WORDS", 10)
    reviews = spark.range(25).select(
        F.col("id").alias("review_id"), F.lit(1).alias("user_id"), F.col("id").alias("game_id"), (100 - F.col("id")).alias("ts")
    )
    rows = sorted(E.play_sentences(reviews).collect(), key=lambda r: r.part)
    assert [len(r.words) for r in rows] == [10, 10, 5]
    assert [int(w) for r in rows for w in r.words] == list(range(24, -1, -1))
