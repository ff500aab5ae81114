"""Source divergence, embedding whitening and license scans against brute force."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_operators import SCHEMA, awkward

from ludomill.llm import divergence, licenses, whitening
from ludomill.llm.licenses import PASSAGES, PLAIN


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# 11


def plain_audit(rows, least, top):
    """rows: (text, lang, source)."""
    by_lang, by_group, frequency = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        seen = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))
        by_lang.setdefault(lang, Counter()).update(seen)
        by_group.setdefault(lang, {}).setdefault(source, Counter()).update(seen)
        frequency.setdefault(lang, Counter()).update(seen.keys())
    out = set()
    for lang, groups in by_group.items():
        kept = [t for t, n in frequency[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        q, p = shares(by_lang[lang]), {s: shares(c) for s, c in groups.items()}
        for source in groups:
            pairs = [(sum(far(p[source][t], p[o][t]) for t in kept), o) for o in groups if o != source]
            words = [(far(p[source][t], q[t]), t) for t in kept if groups[source][t] and p[source][t] > q[t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", words, top)):
                for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last]):
                    out.add((lang, source, part, item, value, i + 1))
    return out


@pytest.mark.parametrize("least", [1, 2, 5, 1000])
def test_divergence_is_exact(docs, least):
    rows = [(r[1], r[2], r[3]) for r in awkward()]
    got = [tuple(r) for r in divergence.audit(docs, least, 10).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(rows, least, 10)


def test_divergence_of_ties_and_hot_groups(spark, monkeypatch):
    rows = [("b a c", "en", "hot")] * 300 + [("B,a;c" * 3, "en", "x"), ("", "en", "none"), (None, None, None), ("b-a", "en", "y"), ("ß É", "fr", "hot")]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "text string, lang string, source string, term string, value int").repartition(5)
    monkeypatch.setattr(divergence, "HELD", 2)
    assert {tuple(r) for r in divergence.audit(table, 1, 2).collect()} == plain_audit(rows, 1, 2)


def test_divergence_of_an_empty_table(nothing):
    assert divergence.audit(nothing).collect() == []


def test_terms_cross_blocks(monkeypatch):
    text = "Älpha beta1gamma\n" * 50 + "x" * 100 + " ŁÓDŹ"
    whole = divergence.terms_of(text.encode())
    assert whole == Counter(w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))
    for block in (1, 3, 17, 64):
        monkeypatch.setattr(divergence, "BLOCK", block)
        assert divergence.terms_of(text.encode()) == whole


def test_shares_do_not_overflow(spark):
    times, total, kept = 10**13, 3 * 10**13 + 1, 10**6
    row = spark.createDataFrame([(times, total, kept)], "a long, b long, c long").select(divergence.share("a", "b", "c").alias("p")).first()
    assert row.p == 1 + 10**9 * (times + 2) // (total + 2 * kept)


# 12


def whitening_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, rows[9][1])] * 3  # repeated rows, a null id, one vector under two ids
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, [])]
    return rows


def usable(rows, width):
    return [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]


def whitening_truth(rows, width=6):
    rows = usable(rows, width)
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in rows]
    fit = np.array(sorted(set(x)), float)
    n, sums = len(fit), [sum(int(r[k]) for r in set(x)) for k in range(width)]
    centred = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    far = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return rows, np.array(x, float) - np.array(sums) / n, n, far, values[::-1], vectors[:, ::-1]


def test_whitening_against_eigenvectors(spark):
    rows, centred, n, far, values, vectors = whitening_truth(whitening_rows())
    table = spark.createDataFrame([(i, v, "z") for i, v in whitening_rows()], "vec_id long, embedding array<float>, n string").repartition(4)
    got = whitening.whiten(table).collect()
    assert len(got) == 4 * len(rows)
    assert {r.n for r in got} == {n}
    assert sorted(r.deviation for r in got) == sorted(far * 4)
    assert max(r.identity_error for r in got) < 1e-9
    ids = [i for i, _ in rows]
    for k in range(4):
        white = centred @ vectors[:, k] / math.sqrt(values[k])
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.whitened) for r in got if r.component == k + 1))
        theirs = [sorted((i is None, i or 0, float(s * w)) for i, w in zip(ids, white)) for s in (1, -1)]
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(mine, t)) for t in theirs)
        share = {r.explained for r in got if r.component == k + 1}
        assert len(share) == 1 and math.isclose(share.pop(), values[k] / values.sum(), rel_tol=1e-9)


def test_whitening_of_low_rank_huge_and_missing(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert sorted((r.vec_id, r.component) for r in line) == [(i, 1) for i in range(9)]
    assert all(math.isclose(r.explained, 1) for r in line)
    far = whitening.whiten(spark.createDataFrame([(i, [float(i) * 1e15, 1.0, 2.0 * i]) for i in range(9)], schema)).collect()
    assert all(r.deviation is None for r in far) and far


@pytest.mark.parametrize("width, complete", [(30, 128), (30, 0), (200, 128)])
def test_bidiagonalisation_finds_equal_values(width, complete):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((400, width)))
    turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
    x = q * np.concatenate([[9.0] * 5, np.linspace(5, 1, width - 5)]) @ turn
    values, vectors = whitening.bidiagonalise(lambda p: x.T @ (x @ p), width, 4, complete)
    assert np.allclose(values, 9, rtol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12)
    assert np.abs(x.T @ (x @ vectors.T) - 81 * vectors.T).max() < 1e-10


def test_bidiagonalisation_stops_when_converged():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 300)) * 0.9 ** np.arange(300)
    calls = []
    values, _ = whitening.bidiagonalise(lambda p: calls.append(1) or x.T @ (x @ p), 300, 4)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-11)
    assert len(calls) < 150


# 13


def license_texts():
    bodies = {}
    for label, text, _ in PASSAGES:
        bodies.setdefault(label, text)
    mit, bsd = bodies["mit"], bodies["bsd"]
    filler = "lorem ipsum dolor " * 40
    return [
        (1, mit, {"mit"}),
        (2, filler + mit.upper().replace(" ", "\n") + filler, {"mit"}),
        (3, mit.replace("copy modify merge", "copy, quietly modify; merge"), {"mit"}),  # a word more in between
        (4, mit.replace("hereby granted", "hereby refused"), set()),  # a key phrase is missing
        (5, " ".join(reversed(mit.split())), set()),
        (6, f"{bsd} {filler} {bodies['zlib']} MIT License and MIT License", {"bsd", "zlib", "mit"}),
        (7, "Released under the MIT License.", {"mit"}),
        (8, "Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        (9, "Licensed under the Apache License, Version 2.0", {"apache"}),
        (10, bodies["lgpl"], {"lgpl", "gpl"}),
        (11, "mit_license mit1license mit-license", {"mit"}),
        (12, "permission software copies conditions warranty " * 30, set()),
        (13, "license " * 3000, set()),
        (14, "general public " * 500 + "license", {"gpl"}),
        (None, "MIT license", {"mit"}),
        (None, "MIT license", {"mit"}),
        (15, None, set()),
        (16, "", set()),
        *[(20 + i, text, {label}) for i, (label, text, _) in enumerate(PASSAGES) if label not in ("lgpl", "agpl", "gpl")],
    ]


def plain_phrases(text):
    found = re.findall(licenses.WORD, lowered(text))
    places = []
    for phrase, label in PLAIN:
        p = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(p)] == p]
    return len(found), places


def checked(got, rows):
    assert len(got) == len(rows)
    facts = Counter()
    for doc_id, text, _ in rows:
        n, places = plain_phrases(text)
        starts = [i for i, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        facts[(doc_id, n, len(starts), min(starts, default=None), max(starts, default=None), labels)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == facts


@pytest.mark.parametrize("piece", [licenses.PIECE, 40])
def test_licenses(spark, monkeypatch, piece):
    monkeypatch.setattr(licenses, "PIECE", piece)
    rows = license_texts()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, row string, n int").repartition(3)
    got = licenses.licenses(table).collect()
    checked(got, rows)
    wanted = {i: labels for i, _, labels in rows}
    for r in got:
        assert set(filter(None, r.labels.split(","))) == wanted[r.doc_id], (r.doc_id, r.labels)
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_license_scan_of_awkward_texts(docs, nothing):
    checked(licenses.licenses(docs).collect(), [(r[0], r[1], None) for r in awkward()])
    assert licenses.licenses(nothing).collect() == []


def test_license_scan_agrees_with_sql(spark):
    rows = license_texts()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    connection = duckdb.connect()
    connection.register("documents", documents)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    theirs = connection.execute(f"select {', '.join(names)} from ({licenses.SQL})").fetchall()
    got = licenses.licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).select(names).collect()
    assert Counter(map(tuple, got)) == Counter(theirs)


def test_license_plan_stays_in_the_engine(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    whole = licenses.licenses(docs)._jdf.queryExecution().toString()
    for word in ("Python", "Arrow", "Pandas"):
        assert word not in plan and word not in whole
