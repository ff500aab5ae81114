"""The operators against brute force, on texts that hold the awkward cases."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ludomill.llm import chat, fingerprints, jaccard, langid, mixing, packing, pii, quality, substrings, token_counts
from ludomill.llm.grouped import whole_groups
from ludomill.llm.words import WORD, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string, kept string"


def words(text):
    return re.findall(WORD, text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, near copies, clashing columns."""
    rng = random.Random(7)
    long = prose(rng, 6000, 10**6)
    base = prose(rng, 120, 10**6).split()
    texts = [
        None, "", " \t\n", "a", "One two", "one TWO", long, "Ünï cödé ß 漢字 😀 x y", "x y z\nx y z\nx y z\n\n",
        "a b c", "A" * 5000, "1" * 3000 + " " + "+1 " * 50, *[" ".join(base)] * 3,
    ]
    for k in (1, 2, 3, 4, 30):
        texts.append(" ".join(["other", *base[k:]]))
    shared = prose(rng, 50, 10**6)
    texts += [f"{prose(rng, 60, 10**6)} {shared} {prose(rng, 30 + i, 10**6)}" for i in range(6)]
    texts += [prose(rng, rng.randrange(40, 200)) for _ in range(30)]
    rows = []
    for i, text in enumerate(texts):
        lang = [None, "en", "de", "fr"][i % 4]
        source = [None, "a", "b", "B", "ä"][i % 5]
        rows.append((i * 3, text, lang, source, None if text is None else len(text), "s", "b", None if i % 2 else "k"))
    rows += rows[12:14]  # repeated rows
    rows.append((None, "a row without an id", "en", "a", 19, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def every_operator():
    return {
        "tokens": lambda d: token_counts.limit_table(token_counts.length_histogram(d)),
        "fingerprint": fingerprints.fingerprint,
        "edited": fingerprints.against_edited,
        "quality": quality.judge,
        "packing": packing.pack,
        "jaccard": jaccard.similar,
        "pii": lambda d: pii.find(d, redacted=True),
        "mix": mixing.mix,
        "take": mixing.take,
        "substrings": substrings.dedup,
        "language": lambda d: langid.predict(d, langid.learn(d)),
    }


@pytest.mark.parametrize("name", sorted(every_operator()))
def test_empty_tables_give_empty_results(nothing, name):
    out = every_operator()[name](nothing)
    assert out.collect() == []
    assert len(set(out.columns)) == len(out.columns)


def test_words_match_the_pattern():
    texts = [r[1] for r in awkward()]
    got = Words(pa.array(texts, pa.large_string()))
    assert np.diff(got.bounds).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for text, a, b in zip(texts, got.bounds, got.bounds[1:]):
        for word, value in zip(words(text), got.hashes[a:b].tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    sliced = Words(pa.array(["zz zz", *texts], pa.large_string()).slice(1))
    assert (sliced.hashes == got.hashes).all()


def test_words_cross_blocks(monkeypatch):
    import ludomill.llm.words as module

    texts = ["alpha beta gamma", None, "delta", "epsilon " * 9]
    whole = Words(pa.array(texts, pa.large_string()))
    monkeypatch.setattr(module, "BLOCK", 7)
    parts = Words(pa.array(texts, pa.large_string()))
    assert (whole.hashes == parts.hashes).all() and (whole.bounds == parts.bounds).all()


# 1


def test_token_limits(docs):
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    lengths = [len(encode(r[1])) if r[1] else 0 for r in awkward()]
    rows = token_counts.limit_table(token_counts.length_histogram(docs)).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in lengths}
    for r in rows:
        assert r.docs_within == sum(n <= r.n_tokens for n in lengths)
        assert r.tokens_within == sum(n for n in lengths if n <= r.n_tokens)
        assert r.docs_beyond == len(lengths) - r.docs_within
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert math.isclose(r.quantile, r.docs_within / len(lengths))
    asked = token_counts.answers(token_counts.length_histogram(docs), [0, 7, 100, 10**6]).collect()
    assert [r.truncated_total for r in asked] == [sum(min(n, k) for n in lengths) for k in (0, 7, 100, 10**6)]


def test_long_texts_are_encoded_in_parts_alike(monkeypatch):
    encoder = token_counts.encoding(token_counts.VOCABULARY)
    texts = ["It's 12 apples,\n and  more <|endoftext|> 漢字 " * 4000, "漢字かな。" * 30000, "a1b22, c" * 20000, "é²3 x½\u0301y" * 9000]
    for text in texts:
        assert token_counts.encoded_length(text, encoder) == len(encoder.encode_ordinary(text))
    rng = random.Random(4)
    signs = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t ", "1", "²", "é", "漢", "'s", "'", ".", "_", "\u0301", "\xa0", "\x1c", "\u2028", "Ⅷ", "😀"]
    for part, run in ((1, 2), (3, 4), (7, 3)):
        monkeypatch.setattr(token_counts, "PART", part)
        monkeypatch.setattr(token_counts, "RUN", run)
        monkeypatch.setattr(token_counts, "_RUN", re.compile(f"[{token_counts._BLANK}]{{{run},}}"))
        for _ in range(400):
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40)))
            assert token_counts.encoded_length(text, encoder) == len(encoder.encode_ordinary(text)), repr(text)


@pytest.mark.parametrize("sign", [" ", "\n", "\t \n", "x", "1", ".", "漢"])
def test_a_million_of_one_sign(spark, sign):
    encoder = token_counts.encoding(token_counts.VOCABULARY)
    text = f"word{sign * 1_000_000}end"
    assert token_counts.encoded_length(text, encoder) > 100
    if sign == " ":
        rows = spark.createDataFrame([(text,), (sign * 1_000_000,)], "text string")
        got = sorted(r.n_tokens for r in token_counts.length_histogram(rows).collect())
        whole = len(encoder._encode_single_piece(sign * 1_000_000))
        assert got[-1] >= whole and got[0] == whole


# 2


def shingle_likeness(a, b, k=5):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_edited(docs):
    rows = sorted(awkward(), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    got = {}
    for r in fingerprints.against_edited(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    prints = {}
    for i, row in enumerate(rows):
        text, after = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        same = [r for r in got[row[0]] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert same, row[0]
        assert same[0].n_chars == len(text)
        assert prints.setdefault(tuple(words(text)), same[0].fingerprint) == same[0].fingerprint
        assert abs(same[0].near_edited - shingle_likeness(text, edited)) < 0.17
        assert abs(same[0].near_next - shingle_likeness(text, after)) < 0.17


def test_next_document_crosses_ranges(spark):
    ids = [5, 7, 100_000, 10**12, -3, 600, 1023, 1024]
    rows = [(i, f"text number {i} " * 5) for i in ids]
    out = fingerprints.against_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]
        assert [r.edited_sha256 for r in out if r.doc_id == i] == [hashlib.sha256(edited.encode()).hexdigest()]


def test_likeness_has_no_bias():
    rng = random.Random(3)
    errors = []
    for _ in range(40):
        a = [f"a{rng.randrange(10**9)}" for _ in range(300)]
        b = a[:200] + [f"b{rng.randrange(10**9)}" for _ in range(100)]
        low, some = fingerprints.signatures(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
        value = fingerprints.likeness(low[:1], low[1:], some[:1], some[1:])[0]
        errors.append(value - shingle_likeness(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.02


# 3


def snapshots():
    rng = random.Random(5)
    rows = []
    for conv in range(20):
        start = rng.choice([0, 3])
        base = conv % 4
        for turn in range(rng.randrange(1, 9)):
            text = None if (base, turn) == (2, 1) else f"turn {turn} of {base}" if conv < 12 else f"own {conv} {turn}"
            rows.append((conv * 10, start + turn * 2, "user" if turn % 2 == 0 else None, text, "x"))
    rows += [(500, t, "user", f"long {t}", None) for t in range(700)]
    rows += [(501, t, "user", f"long {t}", None) for t in range(300)]
    rows += [(None, 0, "user", "no id", None), (600, None, "user", "no turn", None), (600, 1, "user", "b", None)]
    rows += [(601, 1, "user", "twice", None)] * 2
    return rows


def test_maximal_conversations(spark):
    rows = snapshots()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(4)
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or "", role, text))
    seqs = {c: tuple(x[4:] for x in sorted(v, key=lambda x: x[:4])) for c, v in convs.items()}
    rank = lambda c: -1 if c is None else c
    kept = {
        c: s
        for c, s in seqs.items()
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        and not any(o == s and rank(d) < rank(c) for d, o in seqs.items())
    }
    got = {}
    for r in chat.render(table).orderBy("conv_id", "part").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(kept)
    for c, parts in got.items():
        text = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in kept[c])
        assert "".join(p.rendered for p in parts) == text
        assert sum(p.n_turns for p in parts) == len(kept[c])
        assert {p.copies for p in parts} == {sum(s == kept[c] for s in seqs.values())}
        assert [p.part for p in parts] == list(range(len(parts)))
    assert len(got[500]) == 3
    plan = chat.render(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.render(table.limit(0)).collect() == []


# 4


def test_base_counts(docs):
    got = {(r.doc_id, r.text): r for r in quality.judge(docs).collect()}
    for row in awkward():
        text = row[1] or ""
        w = words(text)
        r = got[(row[0], row[1])]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 1000 else set()
        lines = [x for x in text.split("\n") if words(x)]
        assert r.n_words == len(w)
        assert r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept is True)


def test_divergence_is_jensen_shannon():
    p, q = np.array([3, 1, 0]), np.array([[0.5, 0.25, 0.25], [0.75, 0.25, 0.0]])
    assert quality.divergence(p, q) == 0.0
    m = (p / 4 + q[0]) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert math.isclose(quality.divergence(p, q[:1]), math.sqrt((kl(p / 4) + kl(q[0])) / 2))


COMMON_EN = "the of and to in a is that for it with as was on be by at this are or from have an not what".split()


def spoken(rng, common, names, n=200):
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(names) for _ in range(n))


def test_prose_stays_and_symbols_go(spark):
    rng = random.Random(11)
    names = ["".join(rng.choice("aeiounrst") for _ in range(7)) for _ in range(500)]
    clean = [spoken(rng, COMMON_EN, names) for _ in range(40)]
    junk = [" ".join(rng.choice(names) + "$$$%%%" for _ in range(200)) for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(40)) and not any(got[i] for i in range(40, 43))


def test_languages_come_from_the_table(spark):
    """A fifth language, one without Latin letters, a rare one and texts without a language all stay; junk among them goes."""
    rng = random.Random(12)
    alphabets = {"en": "aeiounrst", "pl": "aęiłoszwy", "ru": "аеионтслвр", "th": "กขคงจชซญ"}
    rows, clean = [], set()
    for lang, letters in alphabets.items():
        name = lambda k: "".join(rng.choice(letters) for _ in range(k))  # noqa: B023, E731
        common, names = [name(3) for _ in range(25)], [name(7) for _ in range(500)]
        for _ in range(60):
            clean.add(len(rows))
            rows.append((len(rows), spoken(rng, common, names), lang))
        for label in (None, "rare"):
            clean.add(len(rows))
            rows.append((len(rows), spoken(rng, common, names), label))
        for _ in range(2):
            rows.append((len(rows), " ".join(f"{rng.randrange(10**6)}#|$%" for _ in range(200)), lang))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i for i, kept in got.items() if kept} == clean


def plain_verdicts(rows, common=quality.COMMON_WORDS, least=quality.LEAST_DOCS):
    """(text, lang) -> (char distance, word distance, kept), by dictionaries."""
    marks = set(".,;:!?\"'()-#*$%&|<>")

    def base(text):
        w = words(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    def tokens(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text if c not in marks)
        return Counter(words(low))

    def kind(c):
        b = ord(c)
        if b > 127:
            return 7 + (b > 0x7FF) + (b > 0xFFFF)
        groups = [c.isascii() and c.islower(), c.isupper(), c.isdigit(), c in " \t\n\r\x0b\x0c", c in ".,;:!?\"'()-", c in "#*$%&|<>"]
        return next((i for i, g in enumerate(groups) if g), 6)

    def share(counts):
        total = max(sum(counts.values()), 1)
        return {k: round(n * 1e6 / total) for k, n in counts.items()}

    langs = {}
    for text, lang in rows:
        if lang is not None and text is not None and not base(text):
            langs.setdefault(lang, []).append(text)
    langs = {lang: texts for lang, texts in langs.items() if len(texts) >= least}
    char_refs, word_refs, slots = {}, {}, set()
    for lang, texts in langs.items():
        chars, shares, seen, full = Counter(), Counter(), Counter(), 0
        for t in texts:
            chars.update(share(Counter(map(kind, t))))
            shares.update(share(tokens(t)))
            seen.update(tokens(t).keys())
            full += 10**6 if tokens(t) else 0
        char_refs[lang], word_refs[lang] = chars, (shares, full)
        slots |= set(sorted(seen, key=lambda w: (-seen[w], w.encode()))[:common])

    def distance(counts, reference):
        p, q = sum(counts.values()), sum(reference.values())
        total = 0.0
        for k in counts.keys() | reference.keys():
            x, y = counts.get(k, 0) / p, reference.get(k, 0) / q
            total += sum(z * math.log2(2 * z / (x + y)) for z in (x, y) if z > 0) / 2
        return math.sqrt(max(total, 0))

    def folded(counts, total):
        kept = {w: n for w, n in counts.items() if w in slots}
        return {**kept, None: max(total - sum(kept.values()), 0)}

    out = {}
    for text, lang in rows:
        by_char = by_word = 0.0
        if lang in langs:
            chars, found = Counter(map(kind, text or "")), tokens(text or "")
            if chars.total() >= quality.MIN_CHARS:
                by_char = min(distance(chars, char_refs[x]) for x in langs)
            if found.total() >= quality.MIN_WORDS:
                mine = folded(found, found.total())
                by_word = min(distance(mine, folded(*word_refs[x])) for x in langs)
        kept = not base(text) and by_char <= quality.MAX_CHAR_DISTANCE and by_word <= quality.MAX_WORD_DISTANCE
        out[(text, lang)] = (by_char, by_word, kept)
    return out


def test_verdicts_against_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(r[0], r[1], r[2]) for r in awkward() if len(r[1] or "") < 20000]
    table = table.union(spark.createDataFrame(odd, table.schema))
    rows = [(r.text, r.lang) for r in table.collect()]
    truth = plain_verdicts(rows)
    judged = quality.judge(table).collect()
    assert len(judged) == len(rows) and any(v[1] for v in truth.values()) and not all(v[2] for v in truth.values())
    for r in judged:
        by_char, by_word, kept = truth[(r.text, r.lang)]
        assert math.isclose(r.char_distance, by_char, abs_tol=1e-6) and math.isclose(r.word_distance, by_word, abs_tol=1e-6)
        assert r.kept == kept


def test_windows_of_long_texts(monkeypatch):
    rng = random.Random(14)
    for n in (3, 10, 80):
        for _ in range(60):
            w = [b"abcdefg"[i : i + 1] * (i % 2 + 1) for i in (rng.randrange(7) for _ in range(n))]
            monkeypatch.setattr(quality, "LONG", 10**9)
            short = quality.repeated_words(w)
            monkeypatch.setattr(quality, "LONG", 2)
            assert quality.repeated_words(w) == short


# 5


def padding(lengths, counts, ends):
    return sum(n * (next(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))


def test_boundaries_are_best():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        for buckets in (1, 2, 3, 12):
            ends = packing.best_boundaries(lengths, counts, buckets)
            assert len(ends) <= buckets and ends[-1] == lengths[-1]
            best = min(
                padding(lengths, counts, [*c, lengths[-1]])
                for k in range(min(buckets, len(lengths)))
                for c in itertools.combinations(lengths[:-1], k)
            )
            assert padding(lengths, counts, ends) == best


def test_batches_hold_their_budget(docs):
    out = packing.pack(docs, limit=100, buckets=4, budget=450, shard_rows=8).collect()
    texts = {}
    for r in out:
        assert 0 < r.n_words <= r.bucket <= 100 and r.n_words == len(words(r.text)) and r.n_chars == len(r.text)
        texts.setdefault(r.doc_id, []).append(r)
    sizes = {}
    for row in awkward():
        sizes.setdefault(row[0], []).append(len(words(row[1])))
    for doc_id, pieces in texts.items():
        assert sum(r.n_words for r in pieces) == sum(sizes[doc_id])
    for row in awkward():
        if [r[0] for r in awkward()].count(row[0]) == 1 and words(row[1]):
            assert "".join(r.text for r in sorted(texts[row[0]], key=lambda r: r.piece)) == row[1]
    batches = {}
    for r in out:
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= 450
        if (bucket, batch + 1) in batches:
            assert len(slots) == 450 // bucket


def test_pieces_keep_their_white_space(spark):
    rng = random.Random(5)
    for limit in (1, 2, 5, 40):
        for _ in range(200):
            text = "".join(rng.choice(["a", "bc", " ", "\n", "\t\n ", "é", "漢", "\xa0"]) for _ in range(rng.randrange(60)))
            pieces = packing.text_pieces(text.encode(), limit)
            assert b"".join(p for _, p in pieces).decode() == (text if words(text) else "")
            assert [n for n, _ in pieces] == [len(words(p.decode())) for _, p in pieces]
            assert all(n == limit for n, _ in pieces[:-1]) and all(0 < n <= limit for n, _ in pieces)
    text = "\n".join(f"line\t{i} of  prose\n" for i in range(5000)) + "\n"
    rows = spark.createDataFrame([(1, text, len(text)), (1, text[::-1], len(text))], "doc_id long, text string, n_chars long")
    out = packing.pack(rows, limit=8192).collect()
    ends = {r.n_chars: r.text for r in out}
    assert len(out) == 6 and sum(len(t) == n for n, t in ends.items()) == len(ends)
    for whole in (text, text[::-1]):
        parts = sorted((r for r in out if r.text in whole), key=lambda r: (r.piece, r.n_chars))
        assert "".join(r.text for r in parts) == whole


def test_packing_of_a_very_long_text_is_bounded():
    data = b"word " * 4_000_000
    tracemalloc.start()
    pieces = packing.text_pieces(data, packing.LIMIT)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in pieces) == 4_000_000 and most < 200e6


def test_packing_reruns_agree_without_ids(spark):
    rows = [(None, f"word{i} two three", None) for i in range(200)] + [(None, "same text here", "a")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(str, packing.pack(table.repartition(n), budget=30, shard_rows=50).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


# 6


def jaccard_truth(rows, percent=90, k=3):
    def grams(text):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [grams(r[1]) for r in rows]
    ids = [-1 if r[0] is None else r[0] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 10**9), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("group", [1, 4, 64])
def test_components(docs, group):
    got = jaccard.similar(docs, group=group).collect()
    value = lambda x: -1 if x is None else x
    assert sorted((value(r.doc_id), r.n_shingles, value(r.component_id)) for r in got) == jaccard_truth(awkward())


def test_bitmaps_bound_the_overlap():
    rng = random.Random(12)
    texts = [prose(rng, n, 10**6) for n in (3, 900, 1100, 1100, 5000)]
    texts[3] = texts[2][:4000] + " tail " + texts[2][5000:]
    sets = jaccard.Sets(pa.array(texts, pa.large_string()), 3)
    maps = jaccard.bitmaps(sets)
    assert [len(m) * 8 for m in maps] == [2048, 2048, 4096, 2048, 16384]
    for i, j in itertools.permutations(range(5), 2):
        size = min(len(maps[i]), len(maps[j]))
        missing = np.bitwise_count(jaccard.folded(maps[i], size) & ~jaccard.folded(maps[j], size)).sum()
        own = [set(sets.tokens[sets.bounds[k] : sets.bounds[k + 1]].tolist()) for k in (i, j)]
        assert len(own[0] & own[1]) <= len(own[0]) - missing


def test_chains_of_edits(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for family in range(3):
        text = prose(rng, 150, 10**6).split()
        for step in range(60):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "OPENED", 5)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), group=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_truth(rows)


def rows_that_share_ids():
    """Pairs of near copies in which one text has no id, or the id of others, beside clean texts without an id."""
    rng = random.Random(13)
    rows = []
    for here, there in ((None, 7), (None, 9), (5, 11), (5, 12), (-4, None), (30, 20), (5, 3)):
        text = prose(rng, 120, 10**6)
        rows += [(here, text), (there, f"{text} end")]
    return rows + [(None, prose(rng, 120, 10**6)) for _ in range(4)] + [(5, prose(rng, 120, 10**6)), rows[0]]


@pytest.mark.parametrize("group", [1, 64])
def test_texts_that_share_an_id_stay_apart(spark, group):
    rows = rows_that_share_ids()
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group=group).collect()
    value = lambda x: -1 if x is None else x
    # The counterpart writes a missing id as -1; here it is below all others.
    shifted = [(None if i is None else i + 10, t) for i, t in rows]
    truth = sorted((i if i < 0 else i - 10, n, c if c < 0 else c - 10) for i, n, c in jaccard_truth(shifted))
    assert sorted((value(r.doc_id), r.n_shingles, value(r.component_id)) for r in got) == truth
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 5)}
    assert by_id == {7: None, 9: None, 11: 5, 12: 5, -4: None, 30: 20, 20: 20, 3: 3}


def test_groups_cross_batches():
    rng = random.Random(8)
    keys = sorted(rng.randrange(40) for _ in range(300))
    batches, at = [], 0
    while at < len(keys):
        size = rng.randrange(0, 12)
        batches.append(pa.RecordBatch.from_pydict({"k": pa.array(keys[at : at + size], pa.int64())}))
        at += size
    groups = []
    for batch, starts in whole_groups(iter(batches), ["k"]):
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            groups.append(batch.column("k").to_pylist()[a:b])
    assert groups == [list(g) for _, g in itertools.groupby(keys)]


# 7

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_truth(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(d):
        odd = sum(map(int, d[-1::-2]))
        return (odd + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_plain_spans_match_the_patterns():
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "@", ".", "-", " ", "+", "1", "23", "255", "256", "007", "(", ")", "4111111111111111", "é", "x@y.z", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.plain_spans(text) == plain_truth(text), text


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("write to john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
        ("mail jane at corp dot example dot org", "email", "jane at corp dot example dot org"),
        ("call plus four nine one seven two three four five six seven eight nine today", "phone",
         "plus four nine one seven two three four five six seven eight nine"),
        ("jоhn@exаmple.com is new", "email", "jоhn@exаmple.com"),
        ("bei ｊane＠corp．com", "email", "ｊane＠corp．com"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
        ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card four one one one one one one one one one one one one one one one end", "card",
         "four" + " one" * 15),
        ("٤111 1111 1111 1111", "card", "٤111 1111 1111 1111"),
    ],
)
def test_disguises(text, kind, piece):
    plain, every = pii.all_spans(text)
    assert set(plain) <= set(every)
    assert (kind, text.index(piece), text.index(piece) + len(piece)) in every
    assert piece not in pii.redact(text, every)


@pytest.mark.parametrize(
    "text", ["look at the dot", "we met at noon. One two three go", "Zürich ist schön", "at dot com", "null eins (at) home", "x [dot] y"]
)
def test_clean_texts_have_no_spans(text):
    assert pii.all_spans(text) == ([], [])


def test_letters_that_match_others_whatever_their_case():
    for text in ("eins zwei drei ſechs", "five four SİX", "pluſ one two", "one dot ſix"):
        assert pii.all_spans(text) == ([], [])
    call = "pluſ vier neun eins ſieben zwei dreı vİer fünf ſechs sieben"
    assert pii.all_spans(f"ruf {call} an")[1] == [("phone", 4, 4 + len(call))]
    letters = sorted(set("".join(pii._DIGITS)))
    every = "".join(map(chr, range(0x80, 0x30000)))
    for a in letters:
        for c in re.findall(a, every, re.IGNORECASE):
            for word in pii._DIGITS:
                pii.rewrite(f"one two three {word.replace(a, c)}")


def test_long_runs_are_quick():
    for text in ("a" * 200_000, "1" * 100_000 + ".", "+1 " * 60_000, "a@" * 60_000, "1." * 60_000, "one " * 40_000):
        pii.all_spans(text)


def test_redaction_keeps_rows(docs):
    rows = pii.find(docs, redacted=True, spans=False)
    assert rows.columns == docs.columns and rows.count() == docs.count()


# 8


def test_mix(docs):
    rows = awkward()
    size = lambda r: len(words(r[1]))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    totals = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    targets, free, left = {}, set(sources), 1.5 * sum(totals.values())
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * totals[s]}
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * totals[s]
            left -= targets[s]
        free -= over
    targets |= {s: weights[s] * level for s in free}
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.size == len(words(r.text)) and r.source_size == totals[r.source]
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in sources:
        assert abs(taken[s] - targets[s]) <= 2 * max(size(r) for r in rows if r[3] == s)
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, out))
    assert mixing.take(docs).count() == sum(r.copies for r in out)


# 9


def removal_truth(rows, window):
    seqs = [words(r[1]) for r in rows]
    starts = {}
    for d, w in enumerate(seqs):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(seqs, gone)]


@pytest.mark.parametrize(("shard", "levels"), [(1024, 4), (2, 0), (2, 2)])
def test_repeated_windows_go(spark, docs, monkeypatch, shard, levels):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "LEVELS", levels)
    rng = random.Random(4)
    rows = [r[:2] for r in awkward()]
    period = prose(rng, 12, 10**6)
    common = prose(rng, 45, 10**6).split()
    rows += [(900, " ".join([period] * 9)), (901, "x y " * 60)]
    rows += [(910 + i, " ".join([prose(rng, 20, 10**6), *common[i:], prose(rng, 20, 10**6)])) for i in range(12)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    key = lambda x: tuple(map(str, x))
    mine = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key)
    truth = sorted(((r[0], *t) for r, t in zip(rows, removal_truth(rows, 35))), key=key)
    assert mine == truth


def test_spans_stay_with_their_text(spark):
    """Texts without an id whose hashes agree in the low 24 bits, one with a repeated passage and one without."""
    rng = random.Random(14)
    shared, own = prose(rng, 40, 10**6), prose(rng, 50, 10**6)
    tried = [f"{text} {i}" for text in (shared, own) for i in range(8000)]
    hashed = spark.createDataFrame([(t,) for t in tried], "text string").select("text", F.xxhash64("text").alias("h")).collect()
    low = {r.h & 0xFFFFFF: r.text for r in hashed if r.text.startswith(shared)}
    alike = next((low[r.h & 0xFFFFFF], r.text) for r in hashed if r.text.startswith(own) and r.h & 0xFFFFFF in low)
    rows = [(None, alike[0]), (None, alike[1]), (1, shared)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    truth = [(r[0], *t) for r, t in zip(rows, removal_truth(rows, 35))]
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got} == set(truth)
    assert (None, 51, 0, alike[1]) in truth


def test_automaton_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 4))]
        times = [rng.randrange(1, 3) for _ in sequences]
        found = substrings.repeated_spans(sequences, times, 3)
        counts = {}
        for s, n in zip(sequences, times):
            for i in range(len(s) - 2):
                counts[tuple(s[i : i + 3])] = counts.get(tuple(s[i : i + 3]), 0) + n
        for s, spans in zip(sequences, found):
            want = {i + j for i in range(len(s) - 2) if counts[tuple(s[i : i + 3])] > 1 for j in range(3)}
            assert {i for a, b in spans for i in range(a, b)} == want


# 10


def test_language_of_held_out_texts(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").withColumn("held_out", langid.held_out())
    filters = langid.learn(table.filter("not held_out"))
    rows = langid.predict(table.filter("held_out"), filters).collect()
    assert filters.languages == ["de", "en", "es", "fr"]
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_texts_without_letters(docs):
    rows = langid.predict(docs, langid.learn(docs)).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert letters or r.score == 0.0


def test_filters_miss_nothing_and_know_their_chance():
    rng = np.random.default_rng(0)
    sets = {f"l{i:02}": rng.integers(0, 2**63, 5000).astype(np.uint64) for i in range(11)}
    filters = langid.Filters(sorted(sets), sets)
    own = filters.scores(np.zeros(5000, np.int64), sets["l09"], 1)[0]
    assert own[9] == 1.0 and own.argmax() == 9
    strange = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    assert np.abs(filters.scores(np.zeros(len(strange), np.int64), strange, 1)).max() < 0.01


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "abc def ghi" if i % 2 else "xyz uvw rst", "p" if i % 2 else "q") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(table.filter("lang = 'p'"))
    assert filters.languages == ["p"]
    marks = table.select(langid.held_out().alias("h"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect()
    assert all(m.h == (m.c % 4 == 2) for m in marks)
