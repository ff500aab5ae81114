"""Vectors, evaluation and the blocked search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludomill.operators import embeddings as E
from ludomill.operators import evaluate as V
from ludomill.operators import features as Z


def ratings(spark, rows=40, items=12, seed=1):
    rng = np.random.default_rng(seed)
    matrix = np.where(rng.random((rows, items)) < 0.5, rng.integers(1, 11, (rows, items)), 0).astype(float)
    cells = [(u, i * 10, float(matrix[u, i])) for u in range(rows) for i in range(items) if matrix[u, i]]
    return matrix, spark.createDataFrame(cells, "user_id long, game_id long, rating double")


def test_item_factors_are_the_right_singular_vectors(spark):
    matrix, frame = ratings(spark)
    table, values = E.item_factors(frame, 4)
    _, expected, right = np.linalg.svd(matrix, full_matrices=False)
    assert values == pytest.approx(expected[:4], rel=1e-6)
    found = np.array([r.vector for r in table.orderBy("game_id").collect()])
    assert found.shape == (12, 4)
    assert found.T @ found == pytest.approx(np.eye(4), abs=1e-6)
    assert np.abs(np.diag(found.T @ right[:4].T)) == pytest.approx(np.ones(4), abs=1e-6)
    assert (found[np.abs(found).argmax(axis=0), range(4)] > 0).all()
    scaled, _ = E.item_factors(frame, 4, scaled=True)
    again = np.array([r.vector for r in scaled.orderBy("game_id").collect()])
    assert again == pytest.approx(found * values, abs=1e-6)


def test_leading_factors_of_a_larger_matrix(spark):
    rng = np.random.default_rng(8)
    matrix = (rng.random((60, 3)) @ np.diag([9.0, 4.0, 2.0]) @ rng.random((3, 40)) + 0.01 * rng.random((60, 40))).round(3)
    cells = [(u, i, float(matrix[u, i])) for u in range(60) for i in range(40)]
    table, values = E.item_factors(spark.createDataFrame(cells, "user_id long, game_id long, rating double"), 3)
    assert values == pytest.approx(np.linalg.svd(matrix)[1][:3], rel=1e-6)
    assert E.item_factors(spark.createDataFrame([], "user_id long, game_id long, rating double"))[1] == []


def test_games_played_together_lie_closer(spark):
    rng = np.random.default_rng(5)
    rows = [
        (u, int(rng.integers(0, 10)) + 100 * (u % 2), t, u * 40 + t) for u in range(120) for t in range(40)
    ]
    reviews = spark.createDataFrame(rows, "user_id long, game_id long, ts long, review_id long")
    vectors = {r.game_id: np.array(r.vector) for r in E.title_vectors(reviews, width=16).collect()}
    unit = {g: v / np.linalg.norm(v) for g, v in vectors.items()}
    near = np.mean([unit[a] @ unit[b] for a in range(10) for b in range(10) if a != b])
    far = np.mean([unit[a] @ unit[100 + b] for a in range(10) for b in range(10)])
    assert len(vectors) == 20 and near > far + 0.1


def test_games_share_a_vector_and_lose_rows_without(spark):
    vectors = spark.createDataFrame([("a", [1.0])], "title string, vector array<double>")
    games = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "game_id long, title string")
    assert E.attach_vectors(games, vectors, "title").count() == 2
    assert E.attach_vectors(games, vectors, "title", keep_missing=True).count() == 3


@pytest.mark.parametrize("measure", ["cosine", "dot"])
@pytest.mark.parametrize("block", [7, 8192])
def test_best_items_in_blocks(spark, monkeypatch, measure, block):
    monkeypatch.setattr(V, "QUERY_FACTOR", 2)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 6)), rng.normal(size=(30, 6))
    b[5] = b[4]
    b[6] = 0
    queries = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(a)], "query_id long, vector array<double>"
    )
    barred = [(i, x) for i in range(40) if i % 2 for x in (i % 30, 99)]
    excluded = spark.createDataFrame(barred, "query_id long, item_id long")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "item_id long, vector array<double>")
    scores = a @ b.T
    if measure == "cosine":
        length = np.linalg.norm(b, axis=1)
        scores = scores / np.linalg.norm(a, axis=1)[:, None] / np.where(length > 0, length, 1)
    expected = set()
    for q in range(40):
        allowed = [i for i in range(30) if not (q % 2 and i == q % 30)]
        best = sorted(allowed, key=lambda i: (-round(scores[q, i], 6), i))[:4]
        expected |= {(q, rank + 1, i) for rank, i in enumerate(best)}
    found = V.best_items(queries, items, 4, measure, excluded=excluded, block_rows=block).collect()
    assert {(r.query_id, r.rank, r.item_id) for r in found} == expected


@pytest.mark.parametrize("measure", ["cosine", "dot"])
def test_few_blocks_are_visited(spark, measure):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12)) * 4
    items = np.concatenate([c + rng.normal(size=(50, 12)) * 0.05 for c in centres])
    asked = centres[rng.integers(40, size=60)] + rng.normal(size=(60, 12)) * 0.05
    tables = [
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} long, vector array<double>")
        for rows, name in ((asked, "query_id"), (items, "item_id"))
    ]
    visits = []
    found = V.best_items(*tables, 5, measure, block_rows=50, visits=visits).collect()
    scores = asked @ items.T
    if measure == "cosine":
        scores = scores / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(items, axis=1)
    expected = {(q, k + 1, i) for q in range(60) for k, i in enumerate(sorted(range(2000), key=lambda i: (-round(scores[q, i], 6), i))[:5])}
    assert {(r.query_id, r.rank, r.item_id) for r in found} == expected
    assert sum(visits) < 0.5 * 60 * 40


def test_search_without_items_or_queries(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    none = spark.createDataFrame([], "item_id long, vector array<double>")
    assert V.best_items(some, none).collect() == []
    assert V.best_items(none.withColumnRenamed("item_id", "query_id"), some.withColumnRenamed("query_id", "item_id")).collect() == []


def test_reward_model_recovers_a_plane(spark):
    rng = np.random.default_rng(0)
    rows = [(s.tolist(), a.tolist(), float(1 + 2 * s[0] - a[1])) for s, a in zip(rng.random((200, 2)), rng.random((200, 2)))]
    frame = spark.createDataFrame(rows, "observation array<float>, action array<float>, reward double")
    inputs = V.reward_inputs(frame, 2)
    model = V.fit_reward(inputs)
    gap = model.transform(inputs).select(F.max(F.abs(F.col("predicted_reward") - F.col("reward"))).alias("g")).first().g
    assert gap < 1e-5
    mean = np.mean([r[2] for r in rows])
    assert V.policy_value(model, inputs).first().direct_value == pytest.approx(mean, abs=1e-6)


def test_policies_over_states(spark):
    rng = np.random.default_rng(4)
    cross = np.array([[1.0, -2.0], [0.5, 0.0], [-1.0, 3.0]])

    def reward(s, a):
        return 0.3 + s @ [1.0, 0.0, -0.5] + a @ [0.2, -0.1] + s @ cross @ a

    states, acts = rng.random((300, 3)), rng.random((300, 2))
    rows = [(s.tolist(), a.tolist(), float(reward(s, a))) for s, a in zip(states, acts)] + [(None, [0.0, 0.0], 1.0)]
    frame = spark.createDataFrame(rows, "observation array<double>, action array<double>, reward double").repartition(3)
    model = V.fit_interactions(frame)
    assert np.allclose(model.cross, cross) and np.allclose(model.action, [0.2, -0.1]) and model.constant == pytest.approx(0.3)
    games = rng.random((40, 2))
    games[7] = games[3]
    actions = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(games)], "game_id long, vector array<double>")
    some = spark.createDataFrame([(s.tolist(),) for s in np.concatenate([states[:50], states[:9]])], "observation array<double>")
    chosen = {tuple(r.state): r for r in V.greedy_policy(model, some, actions).collect()}
    assert len(chosen) == 50 and sum(r.n for r in chosen.values()) == 59
    for s in states[:50]:
        scores = [reward(s, g) for g in games]
        best = min(range(40), key=lambda i: (-round(scores[i] - reward(s, np.zeros(2)), 6), i))
        assert chosen[tuple(s)].game_id == best and chosen[tuple(s)].value == pytest.approx(max(scores), abs=2e-6)
    asked = np.concatenate([states[:50], states[:9]])
    value = V.greedy_value(model, some, actions).first().direct_value
    assert value == pytest.approx(np.mean([max(reward(s, g) for g in games) for s in asked]), abs=2e-6)
    shares = rng.random(40)
    shares /= shares.sum()
    policy = spark.createDataFrame([(i, float(p)) for i, p in enumerate(shares)], "game_id long, probability double")
    value = V.state_value(model, some, actions, policy).first().direct_value
    assert value == pytest.approx(np.mean([sum(p * reward(s, g) for p, g in zip(shares, games)) for s in asked]))


def test_products_that_depend_on_each_other(spark):
    rows = [([float(i % 2)], [float(i % 2)], float(i % 2)) for i in range(8)]
    model = V.fit_interactions(spark.createDataFrame(rows, "observation array<double>, action array<double>, reward double"))
    assert model.constant + model.state[0] + model.action[0] + model.cross[0, 0] == pytest.approx(1) and model.constant == pytest.approx(0, abs=1e-9)


def test_the_logging_policy_has_the_logged_value(spark):
    log = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, -1.0), (3, 0.5)], "game_id long, reward double")
    policy = V.frequency_policy(log)
    row = V.propensity_value(log, policy).first()
    assert row.ips_value == pytest.approx(0.125) and row.snips_value == pytest.approx(0.125)
    assert V.direct_value(log, policy).first().direct_value == pytest.approx(0.125)
    only = spark.createDataFrame([(3, 1.0)], "game_id long, probability double")
    row = V.propensity_value(log, only).first()
    assert row.ips_value == pytest.approx(0.5) and row.snips_value == pytest.approx(0.5)


def test_scalers(spark):
    frame = spark.createDataFrame([(1, 5.0, None, [0.0, 2.0]), (1, 7.0, 3.0, [1.0, 2.0])], "a int, b double, c double, v array<double>")
    scaled = Z.scaled_to_unit(Z.scaled_to_unit(Z.scaled_to_unit(frame, "a", "ua"), "b"), "c", "uc")
    assert sorted((r.ua, r.b) for r in scaled.collect()) == [(0.5, 0.0), (0.5, 1.0)]
    assert {r.uc for r in scaled.collect()} == {None, 0.5}
    assert sorted(r.s for r in Z.scaled_to_signed(frame, "v", 2, "s").collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_a_vocabulary_is_never_cut(spark):
    frame = spark.createDataFrame([(["b", "a", None, "", "a"],)], "g array<string>")
    assert Z.vocabulary(frame, "g") == ["a", "b"]
    assert sum(Z.VECTOR_PARTS.values()) == 324 and Z.part_range("year") == (276, 1)


def test_filters(spark):
    games = spark.createDataFrame(
        [(1, 2001, ["PC"], ["RPG"], ["x"], ["Single player"]), (2, 1999, ["PC"], ["RPG"], ["y"], [])],
        "game_id long, release_year int, platforms array<string>, genres array<string>, developers array<string>, game_modes array<string>",
    )
    kept = V.matching_games(games, 2000, ["PC"], ["RPG", "Puzzle"], "x", "Single player")
    assert [r.game_id for r in kept.collect()] == [1]
    assert V.matching_games(games).count() == 2
