"""Vectors of words from the company they keep.

1. *Counts.*  How often a context stands within ``WINDOW`` places of a word, over all sentences.  Every word has
   a row; contexts are the ``CONTEXTS`` most frequent words, so a row has at most that many entries.
2. *Information.*  ln(n_wc N / (n_w n_c)) - ln(``SHIFT``) where that is positive, with the sums over the table of counts.
3. *Factors.*  The leading right singular vectors of the matrix of words x contexts, from M'M: contexts x contexts
   numbers, whatever the words, added up in one pass over the rows, which never leave their task.
4. *Vectors.*  A word's row times the factors, over the root of the singular value.  They stay a table.

A text's vector is the mean of its words' vectors.  Vectors of the ``HEAD`` most frequent words, which make up
nearly all text, go to every task (a bounded table).  Of the other words the rows of the matrix are joined, which are short
for a rare word, and turned into a vector once they are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludomill.session import settle

WINDOW = 5
CONTEXTS = 1024
SHIFT = 5
HEAD = 1 << 16
# Pairs of a text and a word out of the head that are dealt out at a time, in no more rounds than that.
ROUND_PAIRS = 1 << 22
ROUNDS = 16
# Words worked on at a time, and rows and entries of the matrix.
_TOKENS = 1 << 20
_ROWS = 1 << 11
_ENTRIES = 1 << 15


def frequent_words(sentences: DataFrame, count: int) -> list[str]:
    """The ``count`` most frequent words of ``words`` arrays, then by code point."""
    found = sentences.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in found.orderBy(F.desc("n"), "word").limit(count).collect()]


def _slices(words: pa.Array, most: int) -> Iterator[pa.Array]:
    sizes = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > at and held + size > most:
            yield words.slice(at, row - at)
            at, held = row, 0
        held += size
    if at < len(sizes):
        yield words.slice(at)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _lines(words: pa.Array, cells: np.ndarray, times: np.ndarray, width: int, kind: np.dtype) -> pa.RecordBatch:
    """word, entries: a row for each word; ``cells`` (place in ``words`` * width + place of the context) are sorted."""
    # What does not fit into an entry gets further ones.
    most = np.iinfo(kind["times"]).max
    parts = -(-times // most)
    cells, ends = np.repeat(cells, parts), np.cumsum(parts) - 1
    entries = np.empty(len(cells), kind)
    entries["place"], entries["times"] = cells % width, most
    entries["times"][ends] = times - (parts - 1) * most
    own = cells // width
    starts = _starts(own)
    offsets = (np.append(starts, len(cells)) * kind.itemsize).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])
    return pa.RecordBatch.from_arrays([words.take(pa.array(own[starts])), lines], names=["word", "entries"])


def company_counts(sentences: DataFrame, contexts: list[str], window: int = WINDOW) -> DataFrame:
    """word, place (of the context in ``contexts``), times; ``sentences``: words (array of text)."""
    return _company(sentences, contexts, window, _cells, "word string, place int, times long")


def company_rows(sentences: DataFrame, contexts: list[str], window: int = WINDOW) -> DataFrame:
    """:func:`company_counts` with a row for each word: word, places (rising), times."""
    return _company(sentences, contexts, window, _cell_lists, "word string, places array<int>, times array<long>")


def _company(sentences: DataFrame, contexts: list[str], window: int, as_rows: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What ``as_rows`` makes of the words of a batch, their cells and the times of these.

    A slice of the sentences gives one row for each of its words, with an entry of few bytes for each context.  They are dealt
    out and sorted by word, and a task adds up those of a word as they come by, so that it holds a batch of them at a time.
    """
    width = max(len(contexts), 1)
    kind = np.dtype([("place", np.min_scalar_type(width)), ("times", np.uint8)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.column("words"), _TOKENS):
                tokens = part.flatten().dictionary_encode()
                if not len(tokens):
                    continue
                whole = np.uint32 if len(tokens.dictionary) * width < 1 << 32 else np.int64
                places = pa.compute.index_in(tokens.dictionary, value_set=pa.array(contexts, tokens.dictionary.type))
                codes = tokens.indices.to_numpy(zero_copy_only=False)
                place = places.fill_null(-1).to_numpy(zero_copy_only=False)[codes]
                codes = codes.astype(whole) * whole(width)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                cells, end = np.empty(2 * window * len(codes), whole), 0
                for d in range(1, min(window, len(codes) - 1) + 1):
                    same = owner[:-d] == owner[d:]
                    for word, context in ((codes[:-d], place[d:]), (codes[d:], place[:-d])):
                        good = same & (context >= 0)
                        found = word[good] + context[good].astype(whole)
                        cells[end : end + len(found)] = found
                        end += len(found)
                cells = cells[:end]
                cells.sort()
                starts = _starts(cells)
                yield _lines(tokens.dictionary, cells[starts].astype(np.int64), np.diff(starts, append=end), width, kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").dictionary_encode()
            sizes = pa.compute.binary_length(batch.column("entries")).to_numpy(zero_copy_only=False) // kind.itemsize
            entries = np.frombuffer(b"".join(batch.column("entries").to_pylist()), kind)
            cells = np.repeat(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes) * width + entries["place"]
            times = entries["times"].astype(np.int64)
            # The last word may have gone on in this batch.
            if held is not None and held[0][0].equals(words.dictionary[0]):
                cells, times = np.append(held[1], cells), np.append(held[2], times)
            elif held is not None:
                yield as_rows(*held, width)
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            starts = _starts(cells)
            cells, times = cells[starts], np.add.reduceat(times[order], starts)
            last = len(words.dictionary) - 1
            cut = np.searchsorted(cells, last * width)
            held = words.dictionary.slice(last), cells[cut:] - last * width, times[cut:]
            yield as_rows(words.dictionary, cells[:cut], times[:cut], width)
        if held is not None:
            yield as_rows(*held, width)

    lines = sentences.select("words").mapInArrow(pairs, "word string, entries binary")
    dealt = lines.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(add, schema)


def _cells(words: pa.Array, cells: np.ndarray, times: np.ndarray, width: int) -> pa.RecordBatch:
    """word, place, times: a row for each cell."""
    columns = [words.take(pa.array(cells // width)), pa.array((cells % width).astype(np.int32)), pa.array(times)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "place", "times"])


def _cell_lists(words: pa.Array, cells: np.ndarray, times: np.ndarray, width: int) -> pa.RecordBatch:
    """word, places, times: a row for each word."""
    own = cells // width
    starts = _starts(own)
    ends = pa.array(np.append(starts, len(cells)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cells % width).astype(np.int32), times)]
    return pa.RecordBatch.from_arrays([words.take(pa.array(own[starts])), *lists], names=["word", "places", "times"])


def information(counts: DataFrame, shift: float = SHIFT) -> DataFrame:
    """word, place, value: how much more often than by chance, above ln(shift)."""
    words = counts.groupBy("word").agg(F.sum("times").alias("of_word"))
    places = counts.groupBy("place").agg(F.sum("times").alias("of_place"))
    total = F.lit(float(counts.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first().n))
    # As many rows as contexts.
    joined = counts.join(words, "word").join(F.broadcast(places), "place")
    ratio = F.col("times").cast("double") * total / (F.col("of_word").cast("double") * F.col("of_place"))
    return joined.select("word", "place", (F.log(ratio) - F.log(F.lit(float(shift)))).alias("value")).filter("value > 0")


def information_rows(rows: DataFrame, height: int, shift: float = SHIFT) -> DataFrame:
    """:func:`information` and :func:`matrix_rows` of :func:`company_rows`, each row by itself: word, places, values.

    The rows hold all of a word already, so only the sums of the ``height`` contexts are gathered.
    """
    cells = rows.select(F.explode(F.arrays_zip("places", "times")).alias("c"))
    of_place = np.zeros(max(height, 1))
    for place, n in cells.groupBy("c.places").agg(F.sum("c.times")).collect():
        of_place[place] = n
    total = of_place.sum()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("places").value_lengths().to_numpy(zero_copy_only=False)
            places = batch.column("places").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            of_word = np.bincount(own, times, len(sizes))
            values = np.log(times * total / (of_word[own] * of_place[places])) - np.log(float(shift))
            kept = values > 0
            held = np.bincount(own[kept], minlength=len(sizes))
            some = np.flatnonzero(held)
            ends = pa.array(np.append(0, np.cumsum(held[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept])) for x in (places, values)]
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(some)), *lists], names=["word", "places", "values"])

    return rows.mapInArrow(weigh, "word string, places array<int>, values array<double>")


def matrix_rows(cells: DataFrame) -> DataFrame:
    """word, places, values: a row of the matrix each; no longer than there are contexts."""
    return cells.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("c")).select(
        "word", F.col("c.place").alias("places"), F.col("c.value").alias("values")
    )


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end, and row (from the first), place and value of the entries of some rows."""
    lists = batch.column("places")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    places = lists.flatten().to_numpy(zero_copy_only=False)
    values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(ends, before + _ENTRIES, side="right")))
        part = slice(before, ends[end - 1])
        yield at, end, np.repeat(np.arange(end - at), sizes[at:end]), places[part], values[part]
        at = end


def _times_block(n: int, rows: np.ndarray, places: np.ndarray, values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The rows of the matrix times ``block``; the entries are in the order of their rows."""
    out = np.zeros((n, block.shape[1]))
    if len(rows):
        starts = np.flatnonzero(np.append(True, np.diff(rows) > 0))
        out[rows[starts]] = np.add.reduceat(block[places] * values[:, None], starts)
    return out


def gram(rows: DataFrame, height: int) -> np.ndarray:
    """M'M in one pass over the rows of M (places, values)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, height))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                sizes = part.column("places").value_lengths().to_numpy(zero_copy_only=False)
                dense = np.zeros((part.num_rows, height))
                places = part.column("places").flatten().to_numpy(zero_copy_only=False)
                dense[np.repeat(np.arange(part.num_rows), sizes), places] = part.column("values").flatten().to_numpy(zero_copy_only=False)
                total += dense.T @ dense
        used = np.flatnonzero(total.any(1))
        lines = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), height).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), lines], names=["place", "line"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lines = batch.column("line").flatten().to_numpy(zero_copy_only=False).reshape(-1, height)
            for place, line in zip(batch.column("place").to_pylist(), lines):
                sums[place] = sums[place] + line if place in sums else line
        lines = pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), lines], names=["place", "line"])

    # The lines of one context are added in one task; as many rows as contexts come back.
    partial = rows.select("places", "values").mapInArrow(add, "place long, line array<double>")
    out = np.zeros((height, height))
    for row in partial.repartition("place").mapInArrow(merge, "place long, line array<double>").collect():
        out[row.place] = row.line
    return out


def leading_factors(rows: DataFrame, height: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Singular values (falling) and right vectors (as columns) of the matrix, and the largest residual of M'M among them.

    The residual is |M'M v - s^2 v| over the largest s^2.  ``height``: number of contexts.  Values of 0 have no vector.
    """
    product = gram(rows, height)
    values, vectors = np.linalg.eigh(product)
    best = np.argsort(-values, kind="stable")[:count]
    values, vectors = values[best], vectors[:, best]
    kept = values > max(values[0], 0.0) * 1e-12
    values, vectors = values[kept], vectors[:, kept]
    apart = np.linalg.norm(product @ vectors - vectors * values, axis=0)
    return np.sqrt(values), vectors, float(apart.max() / values[0]) if len(values) else 0.0


def turned(values: np.ndarray, vectors: np.ndarray, width: int) -> np.ndarray:
    """What makes vectors of the rows: the factors over the root of the singular value, filled up with zeros to ``width``."""
    turn = np.zeros((len(vectors), width))
    turn[:, : len(values)] = vectors / np.sqrt(values)
    # Signs do not matter to what follows; the largest entry of a factor is positive so that runs agree.
    return turn * np.where(turn[np.abs(turn).argmax(0), np.arange(width)] < 0, -1.0, 1.0)


def row_vectors(rows: DataFrame, values: np.ndarray, vectors: np.ndarray, width: int) -> DataFrame:
    """word, vector: the rows times the factors over the root of the singular value, filled up with zeros to ``width``."""
    return _turned_rows(rows, turned(values, vectors, width))


def _turned_rows(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    width = turn.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, own, places, entries in _entries(batch):
                image = _times_block(end - at, own, places, entries, turn)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(image.ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("word").slice(at, end - at), lists], names=["word", "vector"])

    return rows.mapInArrow(project, "word string, vector array<double>")


def word_rows(
    sentences: DataFrame, width: int, contexts: int = CONTEXTS, window: int = WINDOW, shift: float = SHIFT
) -> tuple[DataFrame, np.ndarray]:
    """word, places, values of every word that keeps more than chance company, and the matrix that makes vectors of these rows."""
    known = frequent_words(sentences, contexts)
    rows = information_rows(settle(company_rows(sentences, known, window)), len(known), shift)
    if rows.isEmpty():
        return rows, np.zeros((max(len(known), 1), width))
    values, vectors, _ = leading_factors(rows, len(known), width)
    return rows, turned(values, vectors, width)


def word_vectors(
    sentences: DataFrame, width: int, contexts: int = CONTEXTS, window: int = WINDOW, shift: float = SHIFT
) -> DataFrame:
    """word, vector of every word that keeps more than chance company; ``sentences``: words (array of text)."""
    rows, turn = word_rows(sentences, width, contexts, window, shift)
    return _turned_rows(rows, turn)


_ENTRY = np.dtype([("place", np.uint16), ("value", np.float32)])


def _packed(vectors: DataFrame, width: int, turn: np.ndarray | None) -> DataFrame:
    """word, cells, image: a row of the matrix as few bytes a cell or, where that is less, its vector in single precision."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                if turn is None:
                    images = rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
                    cells, lines = [None] * len(images), [x.tobytes() for x in images]
                else:
                    cells, lines = [], []
                    for begin, end, own, places, values in _entries(rows):
                        images = _times_block(end - begin, own, places, values, turn).astype(np.float32)
                        entries = np.empty(len(places), _ENTRY)
                        entries["place"], entries["value"] = places, values
                        ends = np.searchsorted(own, np.arange(end - begin + 1)).tolist()
                        for i, (low, high) in enumerate(zip(ends, ends[1:])):
                            short = (high - low) * _ENTRY.itemsize < images[i].nbytes
                            cells.append(entries[low:high].tobytes() if short else None)
                            lines.append(None if short else images[i].tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("word"), pa.array(cells, pa.binary()), pa.array(lines, pa.binary())], names=["word", "cells", "image"])

    return vectors.mapInArrow(pack, "word string, cells binary, image binary")


def mean_vectors(texts: DataFrame, vectors: DataFrame, key: str, width: int, head: int = HEAD, turn: np.ndarray | None = None) -> DataFrame:
    """key, vector: the mean over the words of each text; words without a vector count as zeros.

    ``texts``: key (one row each), words.  ``vectors``: word, vector or, with ``turn``, rows of the matrix (word, places, values),
    whose vectors are the rows times ``turn``.  Words are few kinds in most places, so the vectors of the
    ``head`` most frequent words are sent to the tasks and only the others are joined: of a row as few bytes as it takes,
    for the texts in as many rounds as it takes that few pairs of a text and a word are dealt out at a time.
    """
    spark = texts.sparkSession
    known = frequent_words(texts, head)
    # At most ``head`` rows.
    top = vectors.join(F.broadcast(spark.createDataFrame([(w,) for w in known], "word string")), "word")
    place = {w: i for i, w in enumerate(known)}
    table = np.zeros((len(known), width), np.float32)
    for word, cells, image in _packed(top, width, turn).toLocalIterator():
        if image is None:
            entries = np.frombuffer(cells, _ENTRY)
            table[place[word]] = entries["value"].astype(np.float64) @ turn[entries["place"]]
        else:
            table[place[word]] = np.frombuffer(image, np.float32)
    shared = spark.sparkContext.broadcast((table, place))
    kind = texts.schema[key].dataType.simpleString()
    names = (key, "total", "n_words", "word", "times")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors_of, place_of = shared.value
        for batch in batches:
            rows = []
            for row, words in enumerate(batch.column("words")):
                counts = Counter(words.as_py() or [])
                inside = [(place_of[w], n) for w, n in counts.items() if w in place_of]
                at, n = np.array([p for p, _ in inside], np.int64), np.array([c for _, c in inside], np.float64)
                total = n @ vectors_of[at].astype(np.float64) if len(at) else np.zeros(width)
                key_of = batch.column(key)[row].as_py()
                rows.append((key_of, total.astype(np.float32).tobytes(), counts.total(), None, None))
                rows += [(key_of, None, None, w, c) for w, c in counts.items() if w not in place_of]
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema=schema)

    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(key, types[kind]), ("total", pa.binary()), ("n_words", pa.int64()), ("word", pa.string()), ("times", pa.int32())])
    found = settle(texts.select(key, "words").mapInArrow(split, f"{key} {kind}, total binary, n_words long, word string, times int"))
    whole = found.filter("word is null").select(key, "word", "times", F.lit(None).cast("binary").alias("cells"), F.col("total").alias("image"), "n_words")
    pairs = found.filter(F.col("word").isNotNull() & F.col(key).isNotNull()).select(key, "word", "times")
    rounds = min(max(-(-pairs.count() // ROUND_PAIRS), 1), ROUNDS)
    packed = _packed(vectors, width, turn)
    means = _text_means(key, types[kind], width, turn)
    done = []
    for i in range(rounds):
        now = F.coalesce(F.pmod(F.xxhash64(key), F.lit(rounds)), F.lit(0)) == i
        # The estimate takes a row for a few bytes.
        met = pairs.filter(now).join(packed.hint("merge"), "word").select(key, "word", "times", "cells", "image", F.lit(None).cast("long").alias("n_words"))
        dealt = whole.filter(now).union(met).repartition(key).sortWithinPartitions(key, F.asc_nulls_first("word"))
        done.append(settle(dealt.mapInArrow(means, f"{key} {kind}, vector array<double>, n_words int")))
    return reduce(DataFrame.unionByName, done)


def _text_means(key: str, kind: pa.DataType, width: int, turn: np.ndarray | None):
    """Of each text first its rows with a sum (``image``) and its number of words, then its words (rising) with ``cells`` or ``image``."""

    def mean(rows: pa.Table) -> pa.RecordBatch:
        """Whole texts only, so that equal texts are added up in the same way."""
        keys = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        text = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        count, heads = int(text[-1]) + 1, rows.column("n_words").is_valid().to_numpy()
        times = rows.column("times").fill_null(1).to_numpy().astype(np.float64)
        sums = np.zeros((count, width))
        for column, kind_of in (("image", None), ("cells", _ENTRY)):
            has = rows.column(column).is_valid().to_numpy() & ~heads
            own, data = text[has], b"".join(rows.column(column).filter(pa.array(has)).to_pylist())
            if not len(own):
                continue
            if kind_of is None:
                weighed = np.frombuffer(data, np.float32).reshape(-1, width).astype(np.float64) * times[has][:, None]
                starts = _starts(own)
                sums[own[starts]] += np.add.reduceat(weighed, starts)
            else:
                entries = np.frombuffer(data, kind_of)
                sizes = pa.compute.binary_length(rows.column(column).filter(pa.array(has))).to_numpy() // kind_of.itemsize
                weighed = entries["value"].astype(np.float64) * np.repeat(times[has], sizes)
                own, line = np.unique(own, return_inverse=True)
                contexts = np.bincount(np.repeat(line, sizes) * len(turn) + entries["place"], weighed, len(own) * len(turn))
                for i, one in zip(own.tolist(), contexts.reshape(-1, len(turn))):
                    used = np.flatnonzero(one)
                    sums[i] += one[used] @ turn[used]
        at = np.flatnonzero(heads)
        total = np.frombuffer(b"".join(rows.column("image").filter(pa.array(heads)).to_pylist()), np.float32).reshape(-1, width) + sums[text[at]]
        n = rows.column("n_words").filter(pa.array(heads)).to_numpy()
        lists = pa.FixedSizeListArray.from_arrays(pa.array((total / np.maximum(n, 1)[:, None]).ravel()), width).cast(pa.list_(pa.float64()))
        columns = [rows.column(key).combine_chunks().take(pa.array(at)), lists, pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "vector", "n_words"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                keys = part.column(key)
                last = keys[-1]
                same = 1
                while same < len(keys) and keys[-1 - same] == last:
                    same += 1
                goes_on = same == len(keys) and held and held[-1].column(key)[-1] == last
                if same < len(keys) or not goes_on:
                    ended = [*held, part.slice(0, len(keys) - same)]
                    if any(len(x) for x in ended):
                        yield mean(pa.Table.from_batches(ended))
                    held = []
                held.append(part.slice(len(keys) - same))
        if held:
            yield mean(pa.Table.from_batches(held))

    return means
