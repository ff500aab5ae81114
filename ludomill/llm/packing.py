"""Length buckets of least padding and token-budget batches within them.

The lengths of all documents form one histogram.  Documents longer than
``limit`` are cut into pieces of ``limit`` words, so the histogram has at most
``limit`` rows and dynamic programming over it runs on the driver whatever the
number of documents: the best ``buckets`` boundaries are those whose padding
(boundary minus length, summed over all pieces) is least.  Cost differences obey
the quadrangle inequality, so each layer is solved by halving.

A batch holds floor(budget / boundary) pieces of one bucket.  Pieces are numbered
within a bucket over shards of about ``shard_rows`` rows, so that no bucket is
one task.

A piece is cut from the text as it stands: it begins with the first letter of its first
word (the first piece with the text) and ends where the next one begins, so joined
pieces are the text, white space and all.  A text is read once, in bytes; of a very long one
only the places of its words are held beside it.

Nulls and empty texts have no words and take no place in a batch.  An empty
table gives an empty result.  Repeated rows are packed each.  Other columns are
carried along; ``n_chars`` of a cut text becomes that of the piece.  Rows are ordered by id, piece and
a hash of all their columns, so reruns agree for rows without an id too.  Helper columns are named ``_pack_*``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludomill.session import settle

LIMIT = 8192
BUCKETS = 16
BUDGET = 65536
SHARD_ROWS = 8192


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` ranges of ascending ``lengths`` with the least total padding."""
    n = len(lengths)
    if n == 0:
        return []
    size = np.asarray(lengths, np.float64)
    total = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    words = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64) * size)])

    def cost(lo, hi):
        """Padding of lengths lo..hi-1 padded to length hi-1."""
        return size[hi - 1] * (total[hi] - total[lo]) - (words[hi] - words[lo])

    best = np.concatenate([[0.0], cost(0, np.arange(1, n + 1))])
    cuts = []
    for _ in range(min(buckets, n) - 1):
        now, cut = best.copy(), np.full(n + 1, -1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            options = np.arange(first, min(last, mid - 1) + 1)
            values = best[options] + cost(options, mid)
            at = int(np.argmin(values))
            if values[at] < now[mid]:
                now[mid], cut[mid] = values[at], options[at]
            found = int(options[at])
            todo += [(lo, mid - 1, first, found), (mid + 1, hi, found, last)]
        cuts.append(cut)
        best = now
    ends, at = [], n
    for cut in reversed(cuts):
        ends.append(lengths[at - 1])
        if cut[at] < 0:  # one bucket less does as well here
            ends.pop()
            continue
        at = int(cut[at])
    if at > 0:
        ends.append(lengths[at - 1])
    return sorted(ends)


_SPACES = b" \t\n\r\x0b\x0c"
_SPACE = np.isin(np.arange(256), list(_SPACES))


def text_pieces(data: bytes, limit: int) -> list[tuple[int, bytes]]:
    """Words and bytes of each piece of a text of at most ``limit`` words."""
    if len(data) < 2 * limit:  # too short for more words
        n = len(data.split())
        return [(n, data)] if n else []
    word = ~_SPACE[np.frombuffer(data, np.uint8)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return []
    cuts = [0, *starts[limit::limit].tolist(), len(data)]
    return [(min(limit, len(starts) - i * limit), data[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def cut_pieces(docs: DataFrame, limit: int, with_text: bool) -> DataFrame:
    """The columns of ``docs`` with _pack_piece and _pack_length, a row per piece; ``text`` is that of the piece or left out."""
    columns = [c for c in docs.columns if with_text or c != "text"]
    fields = [docs.schema[c] for c in columns] + [T.StructField("_pack_piece", T.LongType()), T.StructField("_pack_length", T.LongType())]
    counted = with_text and "n_chars" in columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, lengths, texts, chars = [], [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.large_binary())):
                found = text_pieces(text.as_py() or b"", limit)
                for piece, (n, data) in enumerate(found):
                    rows.append(row)
                    pieces.append(piece)
                    lengths.append(n)
                    if with_text:
                        texts.append(data)
                        # Bytes that do not go on with a character are characters.
                        chars.append(None if len(found) == 1 else int((np.frombuffer(data, np.uint8) & 0xC0 != 0x80).sum()))
            out = {c: batch.column(c).take(pa.array(rows, pa.int64())) for c in columns}
            if with_text:
                out["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            if counted:
                out["n_chars"] = pa.compute.coalesce(pa.array(chars, pa.int64()).cast(out["n_chars"].type), out["n_chars"])
            out["_pack_piece"], out["_pack_length"] = pa.array(pieces, pa.int64()), pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(cut, T.StructType(fields))


def pack(
    docs: DataFrame, limit: int = LIMIT, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS,
    with_text: bool = True,
) -> DataFrame:
    """Pieces of documents with bucket, batch and slot; ``with_text`` cuts long texts to their piece, else there is no text.

    Columns: those of ``docs``, then piece, n_words, bucket (its boundary), batch (numbered within the bucket) and slot, which
    replace columns of these names.
    """
    pieces = settle(cut_pieces(docs, limit, with_text).withColumn("_pack_hash", F.xxhash64(*[F.col(c) for c in docs.columns if with_text or c != "text"])))
    histogram = pieces.groupBy("_pack_length").agg(F.count(F.lit(1)).alias("n")).orderBy("_pack_length").collect()
    ends = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    rows, at = [], 0
    for end in ends:
        n = 0
        while at < len(histogram) and histogram[at][0] <= end:
            n += histogram[at][1]
            at += 1
        rows.append((end, -(-n // shard_rows)))
    bucket, shards = F.lit(limit), F.lit(1)
    for end, count in reversed(rows):
        below = F.col("_pack_length") <= end
        bucket, shards = F.when(below, F.lit(end)).otherwise(bucket), F.when(below, F.lit(count)).otherwise(shards)
    keys = ["_pack_bucket", "_pack_shard"]
    placed = pieces.withColumn("_pack_bucket", bucket).withColumn(
        "_pack_shard", F.pmod(F.xxhash64("_pack_hash", "_pack_piece"), shards).cast("int")
    )
    counts = settle(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pack_n")))
    ahead = Window.partitionBy("_pack_bucket").orderBy("_pack_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_pack_n").over(ahead), F.lit(0)).alias("_pack_before"))
    order = Window.partitionBy(*keys).orderBy("doc_id", "_pack_piece", "_pack_length", "_pack_hash")
    place = F.col("_pack_before") + F.col("_pack_place") - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_pack_bucket")))
    out = placed.withColumn("_pack_place", F.row_number().over(order)).join(starts, keys)
    added = ("piece", "n_words", "bucket", "batch", "slot")
    return out.select(
        *[c for c in docs.columns if c not in added and (with_text or c != "text")],
        F.col("_pack_piece").cast("long").alias("piece"),
        F.col("_pack_length").cast("long").alias("n_words"),
        F.col("_pack_bucket").cast("long").alias("bucket"),
        F.floor(place / each).alias("batch"),
        (place % each).alias("slot"),
    )
