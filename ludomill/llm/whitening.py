"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c becomes x = floor(256 c).  The fit list is each distinct x once: n rows, sums S.
With X the centred fit list, the bidiagonalisation alternates the products X v and X' u.  A left
vector u is as long as the table, so it is never stored: it is X p for a short vector p, which
the driver keeps.  One pass over the blocks of the fit list makes t = X p and then X' t, block
by block.  Inner products of left vectors are p' (X' t), so full reorthogonalisation of both
sides takes no further pass and only vectors of the width of an embedding leave a task.

Up to ``COMPLETE`` dimensions the bidiagonal matrix is made whole, with new random directions
where an invariant space ends, so equal variances are all found.  Above it the steps end when the
leading values have converged and a further random direction brings no larger one.

Rows whose vector is null or holds a null or a number that is not finite are left out, and so are
vectors of another length than most have (the longer of equally frequent ones).  Repeated rows and
null ids stay rows of their own; other columns are not read.  A component needs a deviation above
rounding, so tables of low rank have fewer than four; an empty table has no rows.  Entries beyond 64 bits
count as the largest, a ``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludomill.session import settle

COMPONENTS = 4
COMPLETE = 128
# Rows of the fit list in one block.
ROWS = 4096
_TINY = np.finfo(float).eps


def whole_numbers(table: DataFrame, column: str) -> DataFrame:
    """vec_id, x for the rows that can be used."""
    usable = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = table.filter(F.col(column).isNotNull() & usable)
    return rows.select("vec_id", F.transform(column, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """Each distinct x once, in blocks of 64-bit numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            parts = [x[i : i + ROWS] for i in range(0, len(x), ROWS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["n", "block"]
            )

    return rows.select("x").distinct().mapInArrow(pack, "n long, block binary")


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column("block"):
            yield np.frombuffer(block.as_py(), np.int64).reshape(-1, width)


def totals(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and S, exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches, width):
            # Halves of the numbers, so that no sum of a block leaves 64 bits.
            halves = [pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *halves], names=["place", "high", "low"])

    sums = blocks.select("block").mapInArrow(add, "place long, high long, low long").groupBy("place")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    got = {r.place: (int(r.high) << 32) + int(r.low) for r in sums.agg(*exact).collect()}
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return n, [got.get(i, 0) for i in range(width)]


def _summed(blocks: DataFrame, work, width: int, size: int) -> np.ndarray:
    """The sum over all blocks of the ``size`` numbers ``work`` makes of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for x in _each(batches, width):
            out += work(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["place", "value"])

    found = blocks.select("block").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in found.collect():
        out[row.place] = row.value
    return out


def _clear(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - basis.T @ (basis @ vector)
    return vector


def _run(product, width: int, wanted: int, whole: bool, known: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of X, falling, and right vectors, all orthogonal to ``known``: every one, or until ``wanted`` have converged."""
    right, short, back = np.zeros((0, width)), np.zeros((0, width)), np.zeros((0, width))
    diagonal, beside = [], []  # beside[k] stands right of diagonal[k]
    most = width - len(known)

    def direction() -> np.ndarray:
        v = random.standard_normal(width)
        for _ in range(2):
            v = _clear(_clear(v, known), right)
            v /= np.linalg.norm(v)
        return v

    v = direction()
    while True:
        p = v - beside[-1] * short[-1] if beside else v
        right = np.vstack([right, v])
        s = _clear(product(p), known)
        for _ in range(2):  # against all left vectors: u_j' X p = p_j' X' X p
            h = short @ s
            p, s = p - short.T @ h, s - back.T @ h
        alpha = float(np.sqrt(max(p @ s, 0.0)))
        scale = max([alpha, *diagonal, *beside])
        flat = alpha <= _TINY * scale * width
        diagonal.append(0.0 if flat else alpha)
        short = np.vstack([short, np.zeros(width) if flat else p / alpha])
        back = np.vstack([back, np.zeros(width) if flat else s / alpha])
        v = _clear(_clear(back[-1] - diagonal[-1] * right[-1], known), right)
        beta = float(np.linalg.norm(v))
        left, values, turned = np.linalg.svd(np.diag(diagonal) + np.diag(beside, 1))
        k = len(diagonal)
        if k == most or (not whole and k >= wanted and (beta * np.abs(left[-1, :wanted]) <= 4 * _TINY * scale).all()):
            return values, turned @ right
        # An invariant space is complete: go on in a new direction, without a link.
        ended = beta <= _TINY * scale * width
        v = direction() if ended else v / beta
        beside.append(0.0 if ended else beta)


def bidiagonalise(product, width: int, wanted: int, complete: int = COMPLETE) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values of X, falling, and their right vectors as rows; ``product(p)`` is X' X p."""
    random = np.random.default_rng(0)
    whole = width <= complete
    values, vectors = np.zeros(0), np.zeros((0, width))
    while len(vectors) < width:
        # A run finds one vector of equal values; another one, apart from those known, finds the next.
        more, turned = _run(product, width, wanted, whole, vectors, random)
        top = more[: wanted if not whole else None]
        last = len(values) >= wanted and top[0] <= np.sort(values)[-wanted]
        values, vectors = np.append(values, top), np.vstack([vectors, turned[: len(top)]])
        if whole or last:
            break
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > values.max() * _TINY * width * 16]
    return values[order], vectors[order]


def whiten(table: DataFrame, column: str = "embedding", components: int = COMPONENTS, complete: int = COMPLETE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; see the top of this module."""
    rows = whole_numbers(table, column)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths.width if lengths else 0
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.filter(F.size("x") == width)
    blocks = settle(blocks_of(rows, width)) if width else None
    n, sums = totals(blocks, width) if width else (0, [])
    mean = np.array([s / n for s in sums]) if n else np.zeros(0)
    spread = float(_summed(blocks, lambda x: np.array([((x - mean) ** 2).sum()]), width, 1)[0]) if n else 0.0
    if spread <= 0:
        return table.sparkSession.createDataFrame([], schema)

    def product(p: np.ndarray) -> np.ndarray:
        def both(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ p)

        return _summed(blocks, both, width, width)

    values, vectors = bidiagonalise(product, width, components, complete)
    deviations = values / np.sqrt(n)
    explained = values**2 / spread
    turn = vectors.T / deviations
    k = len(values)
    seen = _summed(blocks, lambda x: (lambda y: np.append(y.T @ y, y.sum(axis=0)))((x - mean) @ turn), width, k * k + k)
    means = seen[k * k :] / n
    error = float(np.abs(seen[: k * k].reshape(k, k) / n - np.outer(means, means) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(sums, object)
        reach = max(abs(s) for s in sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width)
            largest = max(abs(int(x.max())), abs(int(x.min())))
            if width * (n * largest + reach) ** 2 < 1 << 62:
                far = ((n * x - whole.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = [d if d < 1 << 63 else None for d in ((n * x.astype(object) - whole) ** 2).sum(axis=1).tolist()]
            white = (x - mean) @ turn
            again = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(batch.num_rows * k, n, np.int64)),
                    pa.array(far, pa.int64()).take(again),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                    pa.array(np.full(batch.num_rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
