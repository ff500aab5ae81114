"""One-permutation MinHash fingerprints of documents.

Every five-word shingle is hashed once.  The top bits choose one of ``BINS`` bins,
each bin keeps its least hash, an empty bin borrows from a bin chosen by a hash of
(bin, attempt) until that one is filled (optimal densification), and the lowest
``BITS`` bits of each bin, hashed with its number, are packed.  Likeness is the share of equal bins,
corrected for bins that agree by chance.

A text of fewer than five words is one shingle.  Null, empty and blank texts have
the empty fingerprint, which is like itself (1) and unlike all others (0).
Equal texts have equal fingerprints, whatever else is in the table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludomill.llm.words import Words, mix, text_parts
from ludomill.session import settle

WIDTH = 5
BINS = 512
BITS = 4
# Ids per range that one task links in order; ranges are joined by their ends.
RANGE_BITS = 9
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(texts: pa.Array, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin, one row per text, and whether the text has a shingle; ``bins`` is a power of two."""
    n = len(texts)
    owner, hashes = Words(texts).shingles(width)
    least = np.full(n * bins, _EMPTY, np.uint64)
    np.minimum.at(least, owner * bins + (hashes >> np.uint64(65 - bins.bit_length())).astype(np.int64), hashes)
    least = least.reshape(n, bins)
    filled = least != _EMPTY
    some = filled.any(1)
    rows, holes = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        seed = mix(holes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))
        donors = (seed & np.uint64(bins - 1)).astype(np.int64)
        hit = filled[rows, donors]
        least[rows[hit], holes[hit]] = least[rows[hit], donors[hit]]
        rows, holes = rows[~hit], holes[~hit]
    # Bins that borrowed from one another would agree by chance together; hashed with their number they do not.
    least = mix(least + np.arange(bins, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (least & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints as text: base64 of the packed low bits."""
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    rows = np.packbits(planes, axis=1)
    return [base64.b64encode(r.tobytes()).decode() if s else "" for r, s in zip(rows, some)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the rows of two sets of signatures."""
    chance = 0.5**bits
    equal = (a == b).mean(1)
    value = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, value, np.where(some_a | some_b, 0.0, 1.0))


def fingerprint(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` with a column fingerprint."""

    @F.pandas_udf("string")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            column = pa.Array.from_pandas(texts, type=pa.large_string())
            out: list[str] = []
            for lo, hi in text_parts(column):
                out += packed(*signatures(column.slice(lo, hi - lo), width, bins, bits), bits)
            yield pd.Series(out, dtype="object")

    return docs.withColumn("fingerprint", values("text"))


def linked(docs: DataFrame) -> DataFrame:
    """Rows (range, own, key, doc_id, text): per range of ids its documents by falling id, then the one that follows.

    After the last document follows the first.  Only the ends of ranges are
    ordered globally: first within 2^10 ranges each, then these groups, which are
    one in 524,288 ids.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.shiftright(key, RANGE_BITS).alias("range"), key.alias("key"), "doc_id", "text")
    ends = rows.groupBy("range").agg(F.max("key").alias("end")).withColumn("group", F.shiftright("range", 10))
    groups = ends.groupBy("group").agg(F.max("end").alias("end"))
    order = Window.orderBy("group")
    groups = groups.select("group", F.lag("end").over(order).alias("below"), F.max("end").over(Window.partitionBy()).alias("top"))
    within = Window.partitionBy("group").orderBy("range")
    ends = (
        ends.withColumn("before", F.lag("end").over(within))
        .join(groups, "group")
        .select(F.col("range").alias("to"), F.coalesce("before", "below", "top").alias("key"))
    )
    # Written, the ends have a known size: as long as they are few the texts are not shuffled to meet them.
    following = rows.join(settle(ends), "key").select(F.col("to").alias("range"), F.lit(False).alias("own"), "key", "doc_id", "text")
    own = rows.select("range", F.lit(True).alias("own"), "key", "doc_id", "text")
    return own.union(following)


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def against_edited(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each text beside its edited form (its last third replaced by the head of the next text) and the next text."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before this part: range, own, doc_id, text, signature, has shingles
        for batch in batches:
            for lo, hi in text_parts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column("text").to_pylist()]
                low, some = signatures(pa.array(texts, pa.large_string()), width, bins, bits)
                ranges, own, ids = (part.column(c).to_pylist() for c in ("range", "own", "doc_id"))
                if held is not None:
                    ranges, own, ids, texts = (
                        [held[0], *ranges], [held[1], *own], [held[2], *ids], [held[3], *texts],
                    )
                    low, some = np.concatenate([held[4], low]), np.concatenate([held[5], some])
                held = (ranges[-1], own[-1], ids[-1], texts[-1], low[-1:], some[-1:])
                at = [i for i in range(len(texts) - 1) if own[i] and ranges[i] == ranges[i + 1]]
                if not at:
                    continue
                edited = []
                for i in at:
                    cut = len(texts[i]) // 3
                    edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
                new, new_some = signatures(pa.array(edited, pa.large_string()), width, bins, bits)
                here, there = np.array(at), np.array(at) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], pa.int64()),
                        pa.array([len(texts[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array(packed(low[here], some[here], bits)),
                        pa.array(packed(new, new_some, bits)),
                        pa.array(likeness(low[here], new, some[here], new_some, bits)),
                        pa.array(likeness(low[here], low[there], some[here], some[there], bits)),
                    ],
                    schema=schema,
                )

    rows = linked(docs).repartition("range")
    rows = rows.sortWithinPartitions("range", F.col("own").desc(), F.col("key").desc(), F.col("text").asc_nulls_first())
    return rows.drop("key").mapInArrow(compare, _OUT)
