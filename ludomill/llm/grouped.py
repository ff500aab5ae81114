"""Rows of one key together, streamed: what a grouped function does without a frame per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end with a group, and where their groups begin.  The rows are sorted by ``keys`` (whole numbers)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = bool(held) and all(batch.column(k)[0].as_py() == held[-1].column(k)[-1].as_py() for k in keys)
        changes = np.zeros(batch.num_rows, bool)
        changes[0] = not same
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(changes)
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        if held or last:
            done = _joined([*held, batch.slice(0, last)] if last else held)
            before = sum(h.num_rows for h in held)
            begins = starts[:-1] + before
            yield done, np.concatenate([[0], begins[begins > 0]]).astype(np.int64)
        held = [batch.slice(last)]
    if held:
        yield _joined(held), np.zeros(1, np.int64)
