"""Ranges of pairs of numbers for tasks, cut from a sample, so that what is ordered is computed once.

A range partitioner runs its input twice, the first time for a sample. Where a sample is at hand, rows find their
task by its cuts. Cuts only balance the tasks: any cuts give an order over tasks, and equal first numbers may lie
on both sides of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MOST = 1 << 18  # rows of a sample


def share(rows: int, tasks: int) -> float:
    """The share of some rows that makes a sample of about 256 for a task, at most MOST in all."""
    return min(1.0, min(MOST, 256 * tasks) / max(1, rows))


def cuts(sample: pa.Table, tasks: int) -> np.ndarray:
    """Pairs that cut the order of a sample's two columns into about equal parts."""
    found = np.stack([np.asarray(sample[k]).astype(np.int64) for k in range(2)], 1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[np.arange(1, tasks) * len(found) // tasks] if len(found) else found


def task_of(first: np.ndarray, second: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many cuts lie at or before each pair."""
    low, high = np.searchsorted(cut[:, 0], first, side="left"), np.searchsorted(cut[:, 0], first, side="right")
    out = low.copy()
    for k in np.flatnonzero(low < high).tolist():  # pairs whose first number has a cut
        out[k] += np.searchsorted(cut[low[k] : high[k], 1], second[k], side="right")
    return out.astype(np.int32)
