"""Quality rules: simple counts, then the divergence from language references.

Two histograms per text, character classes and common words, are compared with
the references of all languages by the Jensen-Shannon distance (base 2, 0
to 1); a text is kept if it is close to one language in both.  Short texts have
noisy histograms, so a distance only counts from a least number of characters or
words on.

References come from the table itself.  Every language with ``LEAST_DOCS`` texts that pass
the base rules has one (the ``LANGUAGES`` with most texts if there are more): the
mean histograms of these texts, summed as whole millionths so that reruns agree.  Its
common words are the ``COMMON_WORDS`` that stand in most of its texts.  One pass over the texts
adds up sparse rows (language, word, texts, share) and settles all of it; what comes to the
driver is bounded by these three numbers.

Nulls: a null text has no words and fails the base rules.  A text without a language, or of one
without a reference, is judged by the base rules alone, for there is nothing to compare it with.
With no reference at all (an empty table) no distance counts.  Repeated rows count each.  Other columns are
carried along.  Of a very long text a task holds the words and, from ``LONG`` words on, whole numbers for its
three-word windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludomill.session import settle

COMMON_WORDS = 40
LEAST_DOCS = 20
LANGUAGES = 200
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.33
LONG = 4096
# Sums of a task before they are handed on.
HELD = 1 << 18

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b".,;:!?\"'()-"
# Classes of characters by their first byte: lower, upper, digit, space, mark, symbol, other ASCII, 2, 3, 4 bytes.
N_CLASSES = 10
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(_SPACES)], _CLASS[list(_MARKS)], _CLASS[list(_SYMBOLS)] = 3, 4, 5
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = N_CLASSES, 7, 8, 9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand in the text twice or more."""
    if len(words) > LONG:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        _, place, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        marks = np.zeros(len(words) + 1, np.int64)
        twice = np.flatnonzero(times[place] > 1)
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + 3, -1)
        return int((np.cumsum(marks) > 0).sum())
    repeated = 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) < len(grams):
        times = Counter(grams)
        until = 0
        for at, gram in enumerate(grams):
            if times[gram] > 1:
                repeated += at + 3 - max(at, until)
                until = at + 3
    return repeated


def base_counts(text: str | None, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    spaces = len(data) - len(data.translate(None, _SPACES))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    return len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def char_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def word_counts(data: bytes) -> Counter:
    """Words without marks, in lower case (A-Z)."""
    return Counter(data.lower().translate(None, _MARKS + _SYMBOLS).split())


@dataclass
class References:
    """Languages, the slots of all their common words, and a row per language of character classes and of words.

    The last word slot is every other word.
    """

    languages: list[str]
    slots: dict[bytes, int]
    chars: np.ndarray
    words: np.ndarray

    def histogram(self, counts: Counter) -> np.ndarray:
        out = np.zeros(len(self.slots) + 1, np.int64)
        for word in counts.keys() & self.slots.keys():
            out[self.slots[word]] = counts[word]
        out[-1] = counts.total() - out.sum()
        return out


def divergence(counts: np.ndarray, references: np.ndarray) -> float:
    """Least Jensen-Shannon distance of a histogram to the rows of ``references`` (0 without either)."""
    total = counts.sum()
    if not total or not len(references):
        return 0.0
    p = counts / total
    middle = (p + references) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0.0).sum(1)
        right = np.where(references > 0, references * np.log2(references / middle), 0.0).sum(1)
    return float(np.sqrt(np.maximum((left + right) / 2, 0.0)).min())


# Kinds of sums: a word's texts and share, a character class's share, all texts and shares of a language.
_WORD, _CHAR, _ALL = 0, 1, 2


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind, word, texts, share over the texts of a task that pass the base rules; shares in millionths of a text."""
    texts: dict[tuple, int] = Counter()
    shares: dict[tuple, int] = Counter()

    def rows() -> pa.RecordBatch:
        columns = list(zip(*texts)) if texts else [[], [], []]
        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())]
        counts = [pa.array(list(texts.values()), pa.int64()), pa.array([shares[k] for k in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays + counts, names=["lang", "kind", "word", "texts", "share"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
            data = text.as_py()
            words = data.split()
            if base_failed(len(words), repeated_words(words)):
                continue
            chars, counts = char_counts(data), word_counts(data)
            total, all_chars = max(counts.total(), 1), max(int(chars.sum()), 1)
            found = [((lang, _WORD, w), round(n * 1_000_000 / total)) for w, n in counts.items()]
            found += [((lang, _CHAR, str(c).encode()), round(n * 1_000_000 / all_chars)) for c, n in enumerate(chars.tolist()) if n]
            found.append(((lang, _ALL, b""), 1_000_000 if counts else 0))
            for key, share in found:
                texts[key] += 1
                shares[key] += share
            if len(texts) > HELD:
                yield rows()
                texts.clear()
                shares.clear()
    yield rows()


def learn(docs: DataFrame, common_words: int = COMMON_WORDS, least_docs: int = LEAST_DOCS) -> References:
    """References of the languages of ``docs`` (text, lang)."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").na.drop("any")
    found = rows.mapInArrow(_sums, "lang string, kind int, word binary, texts long, share long")
    found = settle(found.groupBy("lang", "kind", "word").agg(F.sum("texts").alias("texts"), F.sum("share").alias("share")))
    most = found.filter((F.col("kind") == _ALL) & (F.col("texts") >= least_docs)).orderBy(F.desc("texts"), "lang").limit(LANGUAGES)
    totals = {r.lang: r for r in most.collect()}
    languages = sorted(totals)
    known = found.filter(F.col("lang").isin(languages))
    by_texts = Window.partitionBy("lang").orderBy(F.desc("texts"), "word")
    top = known.filter(F.col("kind") == _WORD).withColumn("place", F.row_number().over(by_texts))
    words = sorted({bytes(r.word) for r in top.filter(F.col("place") <= common_words).select("word").collect()})
    slots = {w: i for i, w in enumerate(words)}
    chars, shares = np.zeros((len(languages), N_CLASSES)), np.zeros((len(languages), len(words) + 1))
    row = {lang: i for i, lang in enumerate(languages)}
    # Bounded by the languages and their common words.
    wanted = known.filter((F.col("kind") == _CHAR) | ((F.col("kind") == _WORD) & F.col("word").isin([bytearray(w) for w in words])))
    for r in wanted.collect():
        if r.kind == _CHAR:
            chars[row[r.lang], int(bytes(r.word))] = r.share
        else:
            shares[row[r.lang], slots[bytes(r.word)]] = r.share
    for lang, i in row.items():
        shares[i, -1] = max(totals[lang].share - shares[i].sum(), 0)
    part = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1.0)
    return References(languages, slots, part(chars), part(shares))


def judge(
    docs: DataFrame,
    references: References | None = None,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with the base counts, base_failed, char_distance, word_distance and kept.

    ``prefix`` goes before these names; columns that have them are replaced.  A distance that does not count is 0.
    """
    known = learn(docs) if references is None else references
    languages = set(known.languages)
    added = [(c, "long") for c in COUNTS] + [
        ("base_failed", "boolean"), ("char_distance", "double"), ("word_distance", "double"), ("kept", "boolean"),
    ]
    added = [(prefix + name, kind) for name, kind in added]
    names = [name for name, _ in added]
    columns = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added])

    def verdict(text: str | None, lang: str | None) -> tuple:
        data = (text or "").encode()
        counts = base_counts(text, data, data.split())
        failed = base_failed(counts[0], counts[4])
        by_char = by_word = 0.0
        if lang in languages:
            chars, words = char_counts(data), word_counts(data)
            by_char = divergence(chars, known.chars) if chars.sum() >= min_chars else 0.0
            by_word = divergence(known.histogram(words), known.words) if words.total() >= min_words else 0.0
        kept = not failed and by_char <= max_char_distance and by_word <= max_word_distance
        return (*counts, failed, by_char, by_word, kept)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").cast(pa.string()).to_pylist()
            rows = [verdict(t.as_py(), lang) for t, lang in zip(batch.column("text"), langs)]
            values = list(zip(*rows)) if rows else [[] for _ in added]
            kinds_of = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [batch.column(c) for c in columns] + [pa.array(v, k) for v, k in zip(values, kinds_of)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    return docs.mapInArrow(apply, schema)
