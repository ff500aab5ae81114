"""Ordered operators that do not put a whole key into one task.

A plain window over a key runs that key in a single task.  Here the rows are
range-partitioned by (key, order) into chunks of even size, so that a key with
a third of all rows covers many chunks; each chunk is scanned by itself, and
the totals of earlier chunks, one short row per (key, chunk), are added on.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludomill.session import settle

CHUNK = "_chunk"
LAST = "_last"
BEFORE = "_before_"
CHUNK_TOTAL = "_total_"
IN_CHUNK = "_in_chunk_"

# Numbers in the vectors that a chunk of rows with a vector each may need, and rows scanned at a time.
CHUNK_CELLS = 1 << 24
_SCAN_ROWS = 2048
# What the lines of a chunk are, in their order.
_OFFSETS, _VECTORS, _ROWS = range(3)


def in_chunks(df: DataFrame, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Number the even, contiguous stretches of the order over all rows.

    The result is settled, since a second sampling of the range exchange could
    draw other borders.  Narrow ``df`` first; wide columns are better joined on
    afterwards.
    """
    count = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(count, *order).withColumn(CHUNK, F.spark_partition_id()))


def _crossing(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that lie in more than one chunk: fewer than there are chunks, for each border cuts one key."""
    spans = chunked.groupBy(*keys).agg(F.min(CHUNK).alias("_low"), F.max(CHUNK).alias("_high"))
    return spans.filter("_low < _high").select(*keys)


def totals_before(
    chunked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Sum of each ``totals`` expression over the earlier rows of the same key.

    ``chunked`` comes from :func:`in_chunks` over ``[*keys, *order]``, possibly
    with columns joined on.  Keys must not be null.  Adds ``LAST``, true on the
    last row of each key.  Sums over no rows are 0.
    """
    names = list(totals)
    group = [*keys, CHUNK]
    valued = chunked.withColumns({CHUNK_TOTAL + n: totals[n] for n in names})

    scan = Window.partitionBy(*group).orderBy(*order)
    earlier = scan.rowsBetween(Window.unboundedPreceding, -1)
    inside = valued.withColumns(
        {
            **{IN_CHUNK + n: F.coalesce(F.sum(CHUNK_TOTAL + n).over(earlier), F.lit(0)) for n in names},
            LAST: F.lead(F.lit(1)).over(scan).isNull(),
        }
    ).drop(*[CHUNK_TOTAL + n for n in names])

    # Only keys that cross a border need anything from other chunks.
    cut = valued.join(_crossing(chunked, keys), list(keys), "left_semi") if keys else valued
    per_chunk = cut.groupBy(*group).agg(*[F.sum(CHUNK_TOTAL + n).alias(CHUNK_TOTAL + n) for n in names])
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier_chunks = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *group,
        *[F.sum(CHUNK_TOTAL + n).over(earlier_chunks).alias(BEFORE + n) for n in names],
        F.lead(F.lit(1)).over(over_chunks).isNull().alias("_last_chunk"),
    )
    joined = inside.join(offsets, group, "left")
    last = F.col(LAST) & F.coalesce("_last_chunk", F.lit(True))
    sums = {n: F.col(IN_CHUNK + n) + F.coalesce(BEFORE + n, F.lit(0)) for n in names}
    helpers = [mark + n for n in names for mark in (IN_CHUNK, BEFORE)]
    return joined.withColumns({**sums, LAST: last}).drop(CHUNK, "_last_chunk", *helpers)


def _running(width: int, out: str):
    """A scan of sorted rows with ``_group`` and ``_values``.

    Adds the sum of ``_values`` over the group's earlier rows as ``out`` and
    ``_end``, true on the group's last row.  Batches wait for the next one,
    which tells whether their last row ends its group.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, waiting = None, np.zeros(width), None

        def finished(ends_group: bool) -> pa.RecordBatch:
            names, columns, ends = waiting
            ends[-1] = ends_group
            return pa.RecordBatch.from_arrays([*columns, pa.array(ends)], names=[*names, "_end"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            labels = np.asarray(batch.column("_group").to_pylist(), dtype=object)
            values = batch.column("_values").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            changes = np.append(labels[1:] != labels[:-1], True)
            if waiting is not None:
                yield finished(labels[0] != group)
            before = np.empty_like(values)
            stops = np.flatnonzero(changes) + 1
            for start, stop in zip([0, *stops[:-1]], stops):
                if labels[start] != group:
                    group, total = labels[start], np.zeros(width)
                sums = total + np.cumsum(values[start:stop], axis=0)
                before[start], before[start + 1 : stop] = total, sums[:-1]
                total = sums[-1]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(labels) + 1, dtype="int32") * width), pa.array(before.ravel())
            )
            kept = [name for name in batch.schema.names if name not in ("_group", "_values")]
            waiting = [*kept, out], [*[batch.column(n) for n in kept], lists], changes
        if waiting is not None:
            yield finished(True)

    return scan


def _scanned(rows: DataFrame, within: Sequence[str], order: Sequence[str], width: int, out: str) -> DataFrame:
    """Run the scan over each ``within`` group of ``rows`` in ``order``."""
    labelled = rows.withColumn("_group", F.concat_ws(",", *[F.col(k).cast("string") for k in within]))
    placed = labelled.repartition(*within).sortWithinPartitions(*within, *order)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_values"]
    return placed.mapInArrow(_running(width, out), ", ".join([*kept, f"{out} array<double>", "_end boolean"]))


class _Chunk:
    """What the rows of one chunk need: the vectors of its games, and what earlier chunks hold of the keys that begin there."""

    def __init__(self, width: int) -> None:
        self.width, self.waiting, self.offsets = width, [], {}

    def add(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == _OFFSETS:
            values = rows.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width + 1)
            ends = rows.column("_end").to_pylist()
            self.offsets.update(zip(rows.column("_group").to_pylist(), zip(values, ends)))
        else:
            self.waiting.append(rows.filter(rows.column("_vector").is_valid()))

    def build(self) -> None:
        if self.waiting is not None:
            table = pa.Table.from_batches(self.waiting) if self.waiting else None
            self.ids = table.column("_item").combine_chunks() if table else None
            self.lists = table.column("_vector").combine_chunks() if table else None
            self.matrix = self.lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width) if table else None
            self.waiting = None

    def places(self, items: pa.Array) -> np.ndarray:
        """Where the vector of each item lies, or -1."""
        if self.ids is None:
            return np.full(len(items), -1)
        found = pa.compute.index_in(items, value_set=self.ids, skip_nulls=True)
        return np.where(items.is_null(), -1, found.fill_null(-1).to_numpy(zero_copy_only=False))


def _chunk_scan(width: int, kept: Sequence[str], totals: bool):
    """A scan of whole chunks, each with what :class:`_Chunk` needs first, then its rows in their order.

    Yields either the sum of the vectors of each ``_group`` of a chunk and the number of rows that have one
    (``totals``), or the rows that have a vector, with the mean over the group's earlier rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, group, total, waiting = None, _Chunk(width), None, np.zeros(width + 1), None

        def finished(ends_group: bool) -> pa.RecordBatch:
            columns, ends, has, out = waiting
            if totals:
                return pa.RecordBatch.from_arrays([*columns, _lists([total])], names=[*kept, "_values"])
            ends[-1] = ends_group & ends[-1]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ends[has]), *out], names=[*kept, LAST, "_seen", "_mean", "_own"])

        for batch in batches:
            numbers, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (CHUNK, "_kind"))
            changes = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            starts = [0, *changes.tolist()] if len(numbers) else []
            for start, stop in zip(starts, [*starts[1:], len(numbers)]):
                if numbers[start] != number:
                    if waiting is not None:
                        yield finished(True)
                    number, chunk, group, waiting = numbers[start], _Chunk(width), None, None
                if kinds[start] != _ROWS:
                    chunk.add(kinds[start], batch.slice(start, stop - start))
                    continue
                chunk.build()
                for at in range(start, stop, _SCAN_ROWS):
                    rows = batch.slice(at, min(_SCAN_ROWS, stop - at))
                    labels = np.asarray(rows.column("_group").to_pylist(), dtype=object)
                    place = chunk.places(rows.column("_item"))
                    has = place >= 0
                    values = np.zeros((len(labels), width + 1))
                    if has.any():
                        values[has, :width], values[has, width] = chunk.matrix[place[has]], 1.0
                    ends = np.append(labels[1:] != labels[:-1], True)
                    if waiting is not None and (not totals or labels[0] != group):
                        yield finished(labels[0] != group)
                    before, last = np.empty_like(values), ends.copy()
                    begun = 0
                    for end in (np.flatnonzero(ends) + 1).tolist():
                        if labels[begun] != group:
                            group, total = labels[begun], np.zeros(width + 1)
                        sums = total + np.cumsum(values[begun:end], axis=0)
                        before[begun], before[begun + 1 : end] = total, sums[:-1]
                        total = sums[-1]
                        if totals:
                            waiting = [rows.column(c).slice(begun, 1) for c in kept], None, None, None
                            if end < len(labels):
                                yield finished(True)
                        elif group in chunk.offsets:
                            earlier, ends_key = chunk.offsets[group]
                            before[begun:end] += earlier
                            last[end - 1] = ends_key
                        begun = end
                    if totals:
                        continue
                    before, own = before[has], pa.array(place[has])
                    seen = before[:, width]
                    mean = np.divide(before[:, :width], seen[:, None], out=np.zeros((len(seen), width)), where=seen[:, None] > 0)
                    lists = chunk.lists.take(own) if len(own) else pa.array([], pa.list_(pa.float64()))
                    out = [pa.array(seen.astype(np.int64)), _lists(mean.astype(np.float32)), lists.cast(pa.list_(pa.float32()), safe=False)]
                    waiting = [rows.column(c).filter(pa.array(has)) for c in kept], last, has, out
        if waiting is not None:
            yield finished(True)

    return scan


def _lists(rows: np.ndarray | list[np.ndarray]) -> pa.ListArray:
    values = np.asarray(rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype="int32") * values.shape[1]), pa.array(values.ravel()))


def chunk_count(df: DataFrame, width: int) -> int:
    """Chunks for :func:`means_before`: as many as there are shuffle partitions, or more, so that what a chunk holds is bounded."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * width // CHUNK_CELLS))


def means_before(
    chunked: DataFrame, vectors: DataFrame, item: str, keys: Sequence[str], order: Sequence[str], width: int
) -> DataFrame:
    """The rows whose ``item`` has a vector, with the mean over the vectors of the key's earlier rows.

    ``chunked`` comes from :func:`in_chunks` over ``[*keys, *order]``; ``vectors``: ``item`` (one row each), vector.
    Adds ``_seen`` (earlier rows with a vector), ``_mean`` (zeros at first) and ``_own`` in single precision, and ``LAST``,
    which looks at rows without a vector too.

    Wide rows are not dealt out: a chunk gets the vector of each of its items once and looks it up.  The chunks are scanned
    twice, for what keys that lie in several chunks add up to, and for the rows.
    """
    narrow = [c for c in chunked.columns if c != CHUNK]
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])

    def lines(rows: DataFrame, kind: int, **values: Column) -> DataFrame:
        own = {"_kind": F.lit(kind), "_group": F.lit(None).cast("string"), "_vector": F.lit(None).cast("array<double>"),
               "_end": F.lit(None).cast("boolean"), "_item": F.lit(None).cast(chunked.schema[item].dataType)} | values
        rest = [F.col(c) if kind == _ROWS else F.lit(None).cast(chunked.schema[c].dataType).alias(c) for c in narrow]
        return rows.select(CHUNK, *rest, *[v.alias(n) for n, v in own.items()])

    def scanned(rows: DataFrame, kept: Sequence[str], totals: bool, schema: str, *more: DataFrame) -> DataFrame:
        wanted = rows.select(CHUNK, item).distinct().join(vectors.hint("merge"), item)
        whole = lines(rows, _ROWS, _group=key, _item=F.col(item))
        for part in (lines(wanted, _VECTORS, _item=F.col(item), _vector=F.col("vector").cast("array<double>")), *more):
            whole = whole.union(part)
        dealt = whole.repartition(CHUNK).sortWithinPartitions(CHUNK, "_kind", *keys, *order)
        types = [f"`{c}` {chunked.schema[c].dataType.simpleString()}" for c in kept]
        return dealt.mapInArrow(_chunk_scan(width, kept, totals), ", ".join([*types, schema]))

    crossing = chunked.join(_crossing(chunked, keys), list(keys), "left_semi").select(*chunked.columns)
    per_chunk = settle(scanned(crossing, [*keys, CHUNK], True, "_values array<double>"))
    offsets = _scanned(per_chunk, keys, [CHUNK], width + 1, "_before")
    offsets = lines(offsets, _OFFSETS, _group=key, _vector=F.col("_before"), _end=F.col("_end"))
    schema = f"{LAST} boolean, _seen long, _mean array<float>, _own array<float>"
    return scanned(chunked, narrow, False, schema, offsets)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position within each key, or over the whole frame if there are no keys."""
    chunked = in_chunks(df, [*keys, *order])
    return totals_before(chunked, keys, order, {name: F.lit(1)}).drop(LAST)


def dense_title_ids(titles: DataFrame, title: str = "game_name", start: int = 0) -> DataFrame:
    """Distinct titles in code-point order with a dense id from 0; ``start`` leaves out the first ones."""
    distinct = titles.select(title).filter(F.col(title).isNotNull()).distinct()
    numbered = with_position(distinct, [], [title], "id").select("id", title)
    return numbered.filter(F.col("id") >= start) if start else numbered


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by ``order``; what a lookup that overwrites repeats would keep."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, rank: str = "rank") -> DataFrame:
    """The first ``count`` rows of each key; Spark limits each group before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= count)
