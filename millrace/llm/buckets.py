"""Walking sorted rows bucket by bucket inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def buckets(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows sorted by their first column, the bucket, as arrays: whole buckets of at most ``small`` rows, or a part of a larger bucket with the bucket's first row.

    What is held is a batch and the bucket that goes on in the next one.
    """

    def whole(part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        begins = np.flatnonzero(np.r_[True, part[0, 1:] != part[0, :-1]])
        sizes = np.diff(np.r_[begins, part.shape[1]])
        for begin, n in zip(begins[sizes > small], sizes[sizes > small], strict=True):
            yield part[:, begin : begin + n], part[:, begin]
        rest = part[:, np.repeat(sizes <= small, sizes)]
        if rest.shape[1]:
            yield rest, None

    held, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        part = fresh if held is None else np.concatenate([held, fresh], 1)
        if head is not None:
            on = part[0] == head[0]
            if on.any():
                yield part[:, on], head
            part = part[:, ~on]
        last = int(np.searchsorted(part[0], part[0, -1])) if part.shape[1] else 0
        if part.shape[1]:
            head = None
            if last:
                yield from whole(part[:, :last])
        held = part[:, last:]
        if held.shape[1] > small:
            head = held[:, 0]
            yield held, head
            held = held[:, :0]
    if held is not None and held.shape[1]:
        yield from whole(held)
