"""The pipeline against brute force, stage by stage, and its registration."""

import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import COMMON_EN, SCHEMA, awkward, jaccard_truth, rows_that_share_ids, words  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from ludomill.llm import mixing, packing, pii, quality  # noqa: E402


def corpus():
    """Prose in English words with copies, near copies, personal data and junk, beside the awkward rows."""
    rng = random.Random(21)
    common = COMMON_EN
    names = ["".join(rng.choice("aeiounrst") for _ in range(7)) for _ in range(900)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(names) for _ in range(rng.randrange(60, 300)))
        if i % 7 == 0:
            text += " write to jane (at) corp [dot] org or 10.1.2.3 now"
        if i % 9 == 0:
            text = " ".join(w + "$$$%%%" for w in text.split())
        rows.append((1000 + i, text, "en", f"s{i % 3}", len(text), None, None, None))
    rows += [(2000 + i, *rows[i][1:]) for i in range(10)]
    rows += [(3000 + i, f"again {rows[i][1]}", *rows[i][2:]) for i in range(10)]
    return rows + awkward()


@pytest.fixture(scope="module")
def folder_of_rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder_of_rows):
    docs = spark.read.parquet(f"{folder_of_rows}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good, one, hidden, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    key = lambda r: tuple(map(str, r))

    kept = good(spark, docs, folder_of_rows)
    assert kept.columns == columns
    verdicts = {key(r[: len(columns)]): r["_rule_kept"] for r in quality.judge(docs, prefix="_rule_").collect()}
    rows = kept.collect()
    assert sorted(map(key, rows)) == sorted(k for r in corpus() if verdicts[k := key(r)])
    assert not any("$$$" in r.text for r in rows) and len({r.doc_id for r in rows if 1000 <= r.doc_id < 2000}) >= 50

    kept = spark.createDataFrame(rows, SCHEMA)
    singles = one(spark, kept, folder_of_rows)
    truth = {i for i, _, c in jaccard_truth(rows) if i == c}
    unique = singles.collect()
    assert sorted(r.doc_id for r in unique) == sorted(truth) and singles.columns == columns
    assert {key(r) for r in unique} <= {key(r) for r in rows}
    assert not any(2000 <= r.doc_id < 4000 for r in unique)

    clean = hidden(spark, spark.createDataFrame(unique, SCHEMA), folder_of_rows)
    wanted = {r.doc_id: pii.redact(r.text, pii.all_spans(r.text)[1]) for r in unique}
    seen = clean.collect()
    assert {r.doc_id: r.text for r in seen} == wanted and clean.columns == columns
    assert all(r.n_chars == len(r.text) for r in seen) and any("[EMAIL]" in r.text for r in seen)

    clean = spark.createDataFrame(seen, SCHEMA)
    taken = mixed(spark, clean, folder_of_rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in taken.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert taken.columns == columns

    out = packed(spark, taken, folder_of_rows).collect()
    assert sum(r.n_words for r in out) == sum(len(words(r.text)) for r in taken.collect())
    ends = packing.best_boundaries(*zip(*sorted(Counter(r.n_words for r in out).items())), packing.BUCKETS)
    assert all(r.bucket == next(e for e in ends if e >= r.n_words) for r in out)

    whole = corpus_pipeline.run(spark, folder_of_rows).collect()
    assert sorted(map(key, whole)) == sorted(map(key, out))


def test_near_copies_share_four_fifths_of_five_words(spark):
    rng = random.Random(31)
    text = [f"w{rng.randrange(10**6)}" for _ in range(50)]
    # 41 of 51 five-word runs are shared, 45 of 51 three-word runs; a second change leaves 36 of 56.
    once = [*text[:20], "changed", *text[21:]]
    rows = [(i, " ".join(t), "en", "a", None, None, None, None) for i, t in ((1, text), (2, once), (3, text[::-1]))]
    rows.append((4, " ".join([*text[:20], "other", *text[21:30], "more", *text[31:]]), *rows[0][2:]))
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
    assert {i for i, _, c in jaccard_truth(rows, 80, 5) if i == c} == {1, 3, 4}


def test_one_of_each_without_ids_of_their_own(spark):
    rows = [(i, t, "en", "a", None, None, None, None) for i, t in rows_that_share_ids()]
    rows += [(5, " ", "en", "a", None, None, None, None), (None, None, "en", "a", None, None, None, None)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    # Of each pair the first or, with the smaller id, the second; the clean texts; the wordless ones.
    wanted = [rows[i][:2] for i in (0, 2, 4, 6, 9, 11, 13, 14, 15, 16, 17, 18, 20, 21)]
    key = lambda r: tuple(map(str, r))
    assert sorted((key((r.doc_id, r.text)) for r in kept.collect())) == sorted(map(key, wanted))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_one_query():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
