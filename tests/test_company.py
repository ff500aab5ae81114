"""Vectors of words from counted company, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludomill.operators import company as W
from ludomill.operators import embeddings as E
from ludomill.session import fresh_folder


def bytes_written(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, "x")).getParent()
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(folder).getLength() if files.exists(folder) else 0


def sentences(rng, n=60, vocabulary=30):
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = [rng.choices([f"w{i}" for i in range(vocabulary)], weights, k=rng.randrange(25)) for _ in range(n)]
    return out + [[], ["alone"], ["w0", "w0", "w0"], [f"rare{i}" if i % 2 else "w1" for i in range(12)]]


def plain_counts(rows, contexts, window):
    out = Counter()
    for words in rows:
        for i, word in enumerate(words):
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                if i != j and words[j] in contexts:
                    out[word, words[j]] += 1
    return out


def plain_information(counts, shift):
    words, places, total = Counter(), Counter(), sum(counts.values())
    for (w, c), n in counts.items():
        words[w] += n
        places[c] += n
    cells = {(w, c): math.log(n * total / (words[w] * places[c])) - math.log(shift) for (w, c), n in counts.items()}
    return {k: v for k, v in cells.items() if v > 0}


@pytest.fixture(scope="module")
def rows():
    return sentences(random.Random(6))


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(99, None)], "id long, words array<string>").repartition(3).cache()


@pytest.mark.parametrize("window, contexts, tokens", [(1, 5, 1 << 18), (5, 100, 40), (30, 8, 7)])
def test_counts_and_information(spark, monkeypatch, rows, table, window, contexts, tokens):
    monkeypatch.setattr(W, "_TOKENS", tokens)
    known = W.frequent_words(table, contexts)
    times = Counter(w for r in rows for w in r)
    assert known == sorted(times, key=lambda w: (-times[w], w))[:contexts]
    counts = W.company_counts(table, known, window).cache()
    truth = plain_counts(rows, set(known), window)
    assert {(r.word, known[r.place]): r.times for r in counts.collect()} == truth
    cells = {(r.word, known[r.place]): r.value for r in W.information(counts, 2).collect()}
    want = plain_information(truth, 2)
    assert cells.keys() == want.keys() and all(math.isclose(cells[k], want[k], abs_tol=1e-9) for k in want)


def test_words_are_dealt_out_with_all_their_company(spark, monkeypatch):
    """A row for each word of a slice, not one for each pair of a word and a context; words go on from batch to batch."""
    rng = random.Random(14)
    rows = [rng.choices([f"w{i}" for i in range(20)], k=50) for _ in range(40)]
    known = [f"w{i}" for i in range(20)]
    monkeypatch.setattr(W, "_TOKENS", 500)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    counts = W.company_counts(spark.createDataFrame([(r,) for r in rows], "words array<string>").coalesce(2), known)
    try:
        spark.conf.set(name, "7")
        got = counts.collect()
    finally:
        spark.conf.set(name, before)
    assert {(r.word, known[r.place]): r.times for r in got} == plain_counts(rows, set(known), W.WINDOW)
    assert len(got) == 400
    stages = counts._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()
    dealt = sum(stages.apply(i).shuffle().metrics().apply("shuffleRecordsWritten").value() for i in range(stages.size()))
    # At most 20 words in each of the 6 slices of up to 7 sentences.
    assert 20 <= dealt <= 120


def test_vectors_are_the_leading_factors(spark, monkeypatch, rows, table):
    monkeypatch.setattr(W, "_ENTRIES", 16)
    monkeypatch.setattr(W, "_ROWS", 4)
    known = W.frequent_words(table, 20)
    cells = W.information(W.company_counts(table, known), 1.2).cache()
    matrix = W.matrix_rows(cells).cache()
    words = [r.word for r in matrix.select("word").collect()]
    dense = np.zeros((len(words), len(known)))
    for r in cells.collect():
        dense[words.index(r.word), r.place] = r.value
    values, vectors, residual = W.leading_factors(matrix, len(known), 6)
    true = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(values, true[:6]) and residual < 1e-12 and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-9)
    got = {r.word: np.array(r.vector) for r in W.row_vectors(matrix, values, vectors, 9).collect()}
    for i, word in enumerate(words):
        assert np.allclose(np.abs(got[word][:6]), np.abs(dense[i] @ vectors / np.sqrt(values))) and not got[word][6:].any()
    # Products of vectors are what the leading factors hold of the matrix.
    ours = np.stack([got[w] for w in words])
    left, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(ours @ ours.T, (left[:, :6] * s[:6]) @ left[:, :6].T, atol=1e-8)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_means_of_texts(spark, rows, table, head):
    vectors = {w: [float(len(w)), float(hash(w) % 7)] for r in rows for w in r if w != "w2"}
    frame = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    got = {r.id: r for r in W.mean_vectors(table, frame, "id", 2, head).collect()}
    assert len(got) == len(rows) + 1
    for i, words in enumerate(rows):
        mean = np.mean([vectors.get(w, [0, 0]) for w in words], axis=0) if words else [0, 0]
        assert got[i].n_words == len(words) and np.allclose(got[i].vector, mean)
    assert got[99].n_words == 0


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "id long, words array<string>")
    assert W.word_vectors(none, 4).collect() == []
    lone = spark.createDataFrame([(1, ["a"]), (2, None)], "id long, words array<string>")
    assert W.word_vectors(lone, 4).collect() == []
    assert [r.vector for r in W.mean_vectors(lone, W.word_vectors(lone, 4), "id", 4).collect()] == [[0.0] * 4] * 2


def test_games_have_vectors_of_their_own(spark):
    rng = random.Random(9)
    plays = []
    for user in range(120):
        taste = user % 3
        for k in range(rng.randrange(4, 30)):
            plays.append((user, 100 * taste + int(rng.paretovariate(0.7)) % 40, k, len(plays)))
    reviews = spark.createDataFrame(plays, "user_id long, game_id long, ts long, review_id long")
    rows = E.title_vectors(reviews, 16).collect()
    assert sorted(r.game_id for r in rows) == sorted({p[1] for p in plays})
    vectors = {r.game_id: np.array(r.vector) for r in rows if any(r.vector)}
    kinds = {tuple(np.round(v, 9)) for v in vectors.values()}
    assert len(vectors) > 60 and len(kinds) == len(vectors)
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    same = [cosine(vectors[a], vectors[b]) for a in vectors for b in vectors if a < b and a // 100 == b // 100]
    other = [cosine(vectors[a], vectors[b]) for a in vectors for b in vectors if a // 100 < b // 100]
    assert np.mean(same) > np.mean(other) + 0.1 and abs(np.mean(other)) < 0.05


def test_vectors_of_rare_words_are_not_written(spark):
    rng = random.Random(21)
    texts = [" ".join(w for k in range(60) for w in (f"w{rng.randrange(30)}", f"own{i}x{k}")) for i in range(300)]
    texts += [texts[0], texts[1], "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    before = bytes_written(spark)
    got = {r.id: r for r in E.description_vectors(frame, "id", "text").collect()}
    # 18,000 words with 128 numbers each would take 18 MB.
    assert bytes_written(spark) - before < 6 << 20
    assert got[300].vector == got[0].vector and got[301].vector == got[1].vector and got[302].n_words == got[303].n_words == 0
    words = frame.select("id", E.words("text").alias("words")).cache()
    plain = {r.word: np.array(r.vector) for r in W.word_vectors(words, 128).collect()}
    want = [np.mean([plain.get(w, np.zeros(128)) for w in t.split()], axis=0) for t in texts[:2]]
    assert np.allclose([got[i].vector for i in (0, 1)], want, atol=1e-5)


def test_words_out_of_the_head_are_joined_in_rounds(spark, rows, table, monkeypatch):
    monkeypatch.setattr(W, "ROUND_PAIRS", 20)
    monkeypatch.setattr(W, "_ROWS", 3)
    matrix, turn = W.word_rows(table, 6, contexts=20, shift=1.0)
    matrix = matrix.cache()
    plain = {r.word: sum(v * turn[p] for p, v in zip(r.places, r["values"])) for r in matrix.collect()}
    got = {r.id: r for r in W.mean_vectors(table, matrix, "id", 6, 2, turn=turn).collect()}
    assert len(got) == len(rows) + 1
    for i, words in enumerate(rows):
        mean = np.mean([plain.get(w, np.zeros(6)) for w in words], axis=0) if words else np.zeros(6)
        assert got[i].n_words == len(words) and np.allclose(got[i].vector, mean, atol=1e-5)
