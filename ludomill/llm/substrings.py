"""Remove word runs that occur elsewhere, found by suffix automata of reference shards.

Every window of ``window`` words has an anchor: the five-word run in it with the
least hash (the first of equals).  Equal windows have equal anchors at equal places,
and the windows of one anchor are a contiguous passage of the text, so passages that
share an anchor are the only ones that can share a window, and each window belongs
to one passage.  Passages whose anchor occurs once go.  The others are the
reference; those of one anchor are a shard, with equal passages kept once and
counted.  A suffix automaton of the shard gives, at every word of a passage, the
longest run ending there that occurs at least twice (the matching statistic of
the passage against everything that could match it); runs of ``window`` words and
more are removed.  Shards go to the tasks by their anchor instead of being
broadcast: broadcasting all shards to all texts would grow with the square of the
corpus.

A shard with more than ``SHARD`` different passages (a run that a large part of all
texts shares, each with its own surroundings) is not one automaton.  Its passages are
parted again by a second anchor under another hash, which most often lies in the
surroundings and occurs once, and so on for ``LEVELS`` rounds.  What is still crowded
then is decided by hashing and counting its windows in Spark, which is exact as well.

Nulls have no words.  Repeated rows are texts of their own, so all they share is
removed from each.  Empty tables give empty results.  Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludomill.llm.words import _BACK, _BASE, Words, _powers, mix, text_parts
from ludomill.session import settle

WINDOW = 35
ANCHOR = 5
SHARD = 1024
LEVELS = 4
_NONE = -(1 << 63)
# A passage's place in one number: 7 bits of its length beyond the window, 32 of its first word.


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` consecutive values, the first of equals."""
    places, length = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while length * 2 <= width:
        places = better(places[: len(places) - length], places[length:])
        length *= 2
    if width > length:
        gap = width - length
        places = better(places[: len(places) - gap], places[gap:])
    return places


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end) of word hashes."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    powers = _powers(_BASE, max(len(hashes), 1 << 20))
    np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
    back = _powers(_BACK, max(len(hashes), 1 << 20))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def passages(bounds: np.ndarray, hashes: np.ndarray, window: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Per passage: its text, anchor hash, content hash, first word within the text, length in words."""
    counts = np.diff(bounds)
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    n_runs = len(hashes) - ANCHOR + 1
    runs = mix(run_hashes(hashes, np.arange(n_runs), np.arange(n_runs) + ANCHOR) ^ np.uint64(salt))
    anchors = _least(runs, window - ANCHOR + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(anchors))
    whole = starts + window <= bounds[1:][owner[: len(anchors)]]
    starts, anchors = starts[whole], anchors[whole]
    if not len(starts):
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    lo, hi = starts[at], starts[last] + window
    texts = owner[lo]
    content = mix(run_hashes(hashes, lo, hi) + (anchors[at] - lo).astype(np.uint64))
    return texts, runs[anchors[at]], content, lo - bounds[texts], hi - lo


class Automaton:
    """Suffix automaton of several sequences, each with a number of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.times = [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.times.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` for the shorter strings that reach it from ``p``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], times: int) -> list[int]:
        """States of the sequence's prefixes."""
        last, states = 0, []
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                state = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = state
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = state
            self.times[last] += times
            states.append(last)
        return states

    def longest_repeated(self) -> list[int]:
        """For every state the length of its longest suffix that occurs at least twice."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        times = list(self.times)
        for state in order:
            times[self.link[state]] += times[state]
        longest = [0] * len(self.link)
        for state in reversed(order):
            longest[state] = self.length[state] if times[state] > 1 else longest[self.link[state]]
        return longest


def repeated_spans(sequences: list[list[int]], times: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Per sequence the maximal spans covered by runs of ``window`` or more words that occur twice among all."""
    automaton = Automaton()
    states = [automaton.add(s, n) for s, n in zip(sequences, times)]
    longest = automaton.longest_repeated()
    out = []
    for own in states:
        spans: list[tuple[int, int]] = []
        for end, state in enumerate(own, 1):
            length = longest[state]
            if length >= window:
                begin = end - length
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, end))
        out.append(spans)
    return out


def _located(docs: DataFrame, window: int) -> DataFrame:
    """anchor, content, key, uid, at: all passages of all texts; key (id) and uid (hash) tell a text."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_parts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column("text"))
                texts, anchors, content, first, length = passages(words.bounds, words.hashes, window)
                uid = np.asarray(part.column("uid").to_numpy(zero_copy_only=False))[texts]
                ids = np.asarray(part.column("key").to_numpy(zero_copy_only=False))[texts]
                at = ((length - window) << 32) | first
                columns = [anchors.view(np.int64), content.view(np.int64), ids, uid, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["anchor", "content", "key", "uid", "at"]
                )

    return docs.mapInArrow(locate, "anchor long, content long, key long, uid long, at long")


def _words_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted`` (key, uid, list of anchor, content, n, at) with the word hashes of each passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_parts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column("text"))
                out: dict[str, list] = {"anchor": [], "content": [], "n": [], "words": []}
                for i, listed in enumerate(part.column("xs").to_pylist()):
                    for x in listed:
                        first = int(words.bounds[i]) + (x["at"] & 0xFFFFFFFF)
                        length = ((x["at"] >> 32) & 0x7F) + window
                        out["anchor"].append(x["anchor"])
                        out["content"].append(x["content"])
                        out["n"].append(x["n"])
                        out["words"].append(words.hashes[first : first + length].tobytes())
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema(
                        [("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("words", pa.binary())]
                    ),
                )

    # Rows that repeat a document would give its passages twice.
    texts = docs.join(wanted, ["key", "uid"]).select("text", "xs")
    rows = texts.mapInArrow(cut, "anchor long, content long, n long, words binary")
    return rows.dropDuplicates(["anchor", "content"])


_SPAN = "anchor long, content long, begin long, end long"
_SPAN_SCHEMA = pa.schema([(c, pa.int64()) for c in ("anchor", "content", "begin", "end")])


def _by_automata(shards: DataFrame, window: int) -> DataFrame:
    """Spans of the passages of each anchor; rows of one anchor come together."""

    def spans(anchor: int, rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        sequences = [np.frombuffer(w, np.uint64).tolist() for _, _, w in rows]
        found = repeated_spans(sequences, [n for _, n, _ in rows], window)
        return [(anchor, content, a, b) for (content, _, _), own in zip(rows, found) for a, b in own]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        current = None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("anchor", "content", "n", "words")]
            for anchor, *row in zip(*columns):
                if anchor != current:
                    if held:
                        out += spans(current, held)
                    current, held = anchor, []
                held.append(tuple(row))
            yield _batch(out)
        if held:
            yield _batch(spans(current, held))

    def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SPAN_SCHEMA)

    return shards.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(stream, _SPAN)


def _by_windows(passages: DataFrame, window: int) -> DataFrame:
    """Spans of passages of crowded anchors: their windows are counted one by one."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*r, np.frombuffer(w, np.uint64)) for *r, w in zip(
                *[batch.column(c).to_pylist() for c in ("anchor", "content", "n", "words")])]
            for at in range(0, len(rows), 1000):
                part = rows[at : at + 1000]
                sizes = np.array([len(w) for *_, w in part])
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                every = sizes - window + 1
                offset = np.arange(every.sum()) - np.repeat(np.cumsum(every) - every, every)
                starts = np.repeat(first, every) + offset
                hashes = run_hashes(np.concatenate([w for *_, w in part]), starts, starts + window)
                columns = [np.repeat(np.array([r[i] for r in part], np.int64), every) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*columns, hashes.view(np.int64), offset)],
                    names=["anchor", "content", "n", "hash", "begin"],
                )

    rows = passages.mapInArrow(explode, "anchor long, content long, n long, hash long, begin long")
    often = rows.groupBy("anchor", "hash").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor", "hash")
    return rows.join(often, ["anchor", "hash"]).select("anchor", "content", "begin", (F.col("begin") + window).alias("end"))


def _parted(crowded: DataFrame, window: int, salt: int) -> DataFrame:
    """Sub-passages of crowded anchors: anchor, content, n, begin, sub, piece (its content), words."""
    schema = pa.schema(
        [(c, pa.int64()) for c in ("anchor", "content", "n", "begin", "sub", "piece")] + [("words", pa.binary())]
    )

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                words = rows.column("words").to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(w) // 8 for w in words])]).astype(np.int64)
                hashes = np.frombuffer(b"".join(words), np.uint64)
                owner, anchors, pieces, first, length = passages(bounds, hashes, window, salt)
                own = [rows.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("anchor", "content", "n")]
                subs = mix(own[0].view(np.uint64) + anchors * np.uint64(3))
                starts = bounds[owner] + first
                cut = [hashes[a : a + k].tobytes() for a, k in zip(starts.tolist(), length.tolist())]
                columns = [*own, first, subs.view(np.int64), pieces.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns], pa.array(cut, pa.binary())], schema=schema
                )

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'words' else 'long'}" for f in schema)
    return crowded.mapInArrow(part, kinds)


def _spans_of(words: DataFrame, window: int, level: int = 1) -> DataFrame:
    """Repeated spans of distinct passages (anchor, content, n, words)."""
    crowd = words.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    words = settle(words.join(crowd, "anchor"))
    spans = _by_automata(words.filter(F.col("kinds") <= SHARD).drop("kinds"), window)
    crowded = words.filter(F.col("kinds") > SHARD).drop("kinds")
    if crowded.isEmpty():
        return spans
    if level > LEVELS:
        return spans.union(_by_windows(crowded, window))
    parts = settle(_parted(crowded, window, 0x9E3779B97F4A7C15 * level & (1 << 64) - 1))
    shared = parts.groupBy("sub").agg(F.sum("n").alias("times")).filter("times > 1").select("sub")
    parts = settle(parts.join(settle(shared), "sub", "left_semi"))
    pieces = parts.groupBy(F.col("sub").alias("anchor"), F.col("piece").alias("content")).agg(
        F.sum("n").alias("n"), F.first("words").alias("words")
    )
    inner = settle(_spans_of(pieces, window, level + 1))
    inner = inner.select(
        F.col("anchor").alias("sub"), F.col("content").alias("piece"), F.col("begin").alias("a"), F.col("end").alias("b")
    )
    placed = parts.join(inner, ["sub", "piece"])
    return spans.union(
        placed.select("anchor", "content", (F.col("begin") + F.col("a")).alias("begin"), (F.col("begin") + F.col("b")).alias("end"))
    )


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with removed: word spans (begin, end) to take out, not in order, may overlap; null if none."""
    keyed = docs.withColumn("_sub_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))).withColumn(
        "_sub_uid", F.xxhash64("text")
    )
    texts = keyed.select(F.col("_sub_key").alias("key"), F.col("_sub_uid").alias("uid"), "text")
    located = _located(texts, window)
    shared = settle(located.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    found = settle(located.join(shared, "anchor", "left_semi"))
    least = F.min(F.struct("key", "uid", "at")).alias("x")
    kinds = settle(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), least))
    crowd = settle(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")))
    length = F.shiftright("x.at", 32).bitwiseAND(0x7F) + window
    kinds = kinds.join(crowd, "anchor")
    # The only passage of its anchor, in several places, is repeated as a whole.
    alone = kinds.filter("kinds = 1").select("anchor", "content", F.lit(0).cast("long").alias("begin"), length.alias("end"))
    listed = F.collect_list(F.struct("anchor", "content", "n", F.col("x.at").alias("at"))).alias("xs")
    several = kinds.filter("kinds > 1")
    wanted = several.groupBy(F.col("x.key").alias("key"), F.col("x.uid").alias("uid")).agg(listed)
    words = settle(_words_of(texts, wanted, window))
    spans = settle(alone.union(_spans_of(words, window)).distinct())
    first = F.col("at").bitwiseAND(0xFFFFFFFF)
    placed = found.join(spans, ["anchor", "content"]).select(
        F.col("key").alias("_sub_key"),
        F.col("uid").alias("_sub_uid"),
        F.struct((first + F.col("begin")).alias("begin"), (first + F.col("end")).alias("end")).alias("span"),
    )
    per_text = placed.groupBy("_sub_key", "_sub_uid").agg(F.collect_set("span").alias("removed"))
    return keyed.join(per_text, ["_sub_key", "_sub_uid"], "left").select(
        *[c for c in docs.columns if c != "removed"], "removed"
    )


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words left, joined by one space."""
    found = removed_spans(docs, window)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "removed")]
    schema = T.StructType(
        [docs.schema[c] for c in columns]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("removed")):
                words = (text.as_py() or "").encode().split()
                keep = np.ones(len(words), bool)
                for span in spans.as_py() or []:
                    keep[span["begin"] : span["end"]] = False
                totals.append(len(words))
                gone.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep) if k]).decode())
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_words", "n_removed", "kept"])

    return found.mapInArrow(apply, schema)
