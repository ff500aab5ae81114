"""Language of texts by bit-sliced Bloom filters of character n-grams.

All languages share one table of ``m`` rows with one bit per language.  An n-gram
of a language sets the language's bit in the rows of its ``HASHES`` positions, so
one look at these rows, joined by AND, returns every language that has the
n-gram.  A text's n-grams are counted per language, the counts are corrected for
the filter's false positives, and the largest decides (ties: the smaller name).

A language has an n-gram if the n-gram makes up ``MIN_SHARE`` of its n-grams, so a
filter has at most 1 / MIN_SHARE of them whatever the corpus; that bounds what
comes to the driver and what is broadcast.

Nulls: null texts and texts without a letter are ``und`` with score 0; rows with a
null language teach nothing.  If nothing was learned every text is ``und``.
Repeated rows count each.  Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludomill.llm.words import mix, text_parts
from ludomill.session import settle

WIDTH = 4
MIN_SHARE = 1e-5
HASHES = 3
BITS_PER_GRAM = 16
# Distinct n-grams a task holds before it hands them on.
HELD = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every n-gram, and which texts have a letter.

    Letters in lower case; every run of other characters is one blank, and blanks surround a text.
    """
    data = "\0".join(" " + (t or "").lower().replace("\0", " ") + "  " for t in texts) + "\0"
    points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
    end = points == 0
    letter = _letters()[points]
    owner = np.cumsum(end) - end
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    blank = ~letter & ~end
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[np.flatnonzero(end) - 1] = True  # a text ends in two blanks, so that one letter makes an n-gram
    points = np.where(blank, np.uint32(32), points)[keep]
    owner = owner[keep]
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), has
    hashes = np.zeros(n, np.uint64)
    for j in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + mix(points[j : j + n].astype(np.uint64) + np.uint64(j + 1))
    inside = (owner[:n] == owner[width - 1 :]) & has[owner[:n]]
    return owner[:n][inside], mix(hashes[inside]), has


class Filters:
    """The languages' filters in one table of rows of bits."""

    def __init__(self, languages: list[str], masks: dict[str, np.ndarray], bits_per_gram: int = BITS_PER_GRAM):
        self.languages = languages
        most = max([len(g) for g in masks.values()], default=1)
        self.size = 1 << max(10, int(most * bits_per_gram - 1).bit_length())
        self.table = np.zeros((max(1, -(-len(languages) // 8)), self.size), np.uint8)
        for i, language in enumerate(languages):
            for at in self._places(masks[language]):
                np.bitwise_or.at(self.table[i // 8], at, np.uint8(1 << (i % 8)))
        fill = [((self.table[i // 8] >> np.uint8(i % 8)) & 1).mean() for i in range(len(languages))]
        self.chance = np.array(fill) ** HASHES

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((hashes + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64)

    def scores(self, owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Corrected share of each text's n-grams that each language has; one row per text."""
        total = np.bincount(owner, minlength=n)
        out = np.zeros((n, len(self.languages)))
        places = list(self._places(hashes))
        for group in range(len(self.table)):
            rows = self.table[group][places[0]]
            for at in places[1:]:
                rows &= self.table[group][at]
            for i in range(group * 8, min(group * 8 + 8, len(self.languages))):
                hits = np.bincount(owner[(rows >> np.uint8(i % 8)) & 1 == 1], minlength=n)
                share = hits / np.maximum(total, 1)
                out[:, i] = np.clip((share - self.chance[i]) / (1 - self.chance[i]), 0.0, 1.0)
        return out


def learn(docs: DataFrame, width: int = WIDTH, min_share: float = MIN_SHARE) -> Filters:
    """Filters from all rows of ``docs`` (text, lang) that name a language."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, (keys, times) in held.items():
                for at in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_pydict({
                        "lang": [lang] * len(keys[at : at + 100_000]),
                        "gram": keys[at : at + 100_000].view(np.int64),
                        "n": times[at : at + 100_000],
                    })
            held.clear()

        for batch in batches:
            for lo, hi in text_parts(batch.column("text")):
                langs = np.array(batch.column("lang").slice(lo, hi - lo).to_pylist(), object)
                owner, hashes, _ = grams(batch.column("text").slice(lo, hi - lo).to_pylist(), width)
                for lang in set(langs.tolist()):
                    keys, times = np.unique(hashes[(langs == lang)[owner]], return_counts=True)
                    if lang in held:
                        keys = np.concatenate([held[lang][0], keys])
                        times = np.concatenate([held[lang][1], times])
                        order = np.argsort(keys, kind="stable")
                        keys, times = keys[order], times[order]
                        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
                        keys, times = (keys[first], np.add.reduceat(times, first)) if len(keys) else (keys, times)
                    held[lang] = keys, times
                if sum(len(k) for k, _ in held.values()) > HELD:
                    yield from given()
        yield from given()

    rows = docs.filter("lang is not null and text is not null").select("text", "lang")
    found = rows.mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = settle(found)
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = found.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * min_share)
    sets = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in
            frequent.groupBy("lang").agg(F.collect_list("gram").alias("grams")).toLocalIterator()}
    return Filters(sorted(sets), sets)


def predict(docs: DataFrame, filters: Filters, width: int = WIDTH) -> DataFrame:
    """``docs`` with lang_pred and score."""
    known = docs.sparkSession.sparkContext.broadcast(filters)
    names = ["lang_pred", "score"]
    columns = [c for c in docs.columns if c not in names]
    schema = T.StructType(
        [docs.schema[c] for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = known.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for lo, hi in text_parts(batch.column("text")):
                owner, hashes, has = grams(batch.column("text").slice(lo, hi - lo).to_pylist(), width)
                if not filters.languages:
                    langs += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                found = filters.scores(owner, hashes, hi - lo)
                best = found.argmax(1)
                langs += [filters.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
                scores += np.where(has, found[np.arange(hi - lo), best], 0.0).tolist()
            arrays = [batch.column(c) for c in columns] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    return docs.mapInArrow(apply, schema)


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
