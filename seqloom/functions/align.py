"""Pairwise alignment kernels for Arrow batches: small numpy helpers, and the Spark operators
that run them over pairs of columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


def _reach(r: int, c: int, banded: bool) -> int:
    return max(r, c) // 4 if banded and r > 11 and c > 11 else max(r, c)


def _next_row(up: np.ndarray, row: np.ndarray, i: int, a: np.ndarray, b: np.ndarray, matrix: np.ndarray, gap: int, reach: int, slope: np.ndarray) -> None:
    """Fills row i of a table (given as zeros) from the one above. A run of gaps is a running maximum."""
    lo, hi = max(1, i - reach), min(len(b), i + reach)
    if lo > hi:
        return
    y = np.empty(hi - lo + 2, np.int32)
    y[0] = slope[lo - 1]
    y[1:] = np.maximum(up[lo - 1 : hi] + matrix[a[i - 1], b[lo - 1 : hi]], up[lo : hi + 1] + gap) + slope[lo : hi + 1]
    row[lo : hi + 1] = np.maximum.accumulate(y)[1:] - slope[lo : hi + 1]


def global_table(a: np.ndarray, b: np.ndarray, matrix: np.ndarray, gap: int, banded: bool) -> np.ndarray:
    """Scores of all prefixes; the borders are 0, so gaps at the start are free. Cells further
    than a quarter of the longer side from the diagonal stay 0 if banded and neither side has
    ten or fewer residues. One numpy step per row."""
    r, c = len(a) + 1, len(b) + 1
    table, slope = np.zeros((r, c), np.int32), -gap * np.arange(c, dtype=np.int32)
    for i in range(1, r):
        _next_row(table[i - 1], table[i], i, a, b, matrix, gap, _reach(r, c, banded), slope)
    return table


def _trace(table: np.ndarray, first: int, i: int, j: int, a: str, b: str, matrix: np.ndarray, gap: int, out: list) -> tuple[int, int]:
    """Steps back from (i, j) to row `first`, that of the table's first row, or to column 0."""
    x, y = bytes_of(a), bytes_of(b)
    while i > first and j:
        k = i - first
        diagonal, up, left = table[k - 1, j - 1] + matrix[x[i - 1], y[j - 1]], table[k - 1, j] + gap, table[k, j - 1] + gap
        step = (1, 1) if diagonal > max(up, left) else (1, 0) if up > left else (0, 1)
        i, j = i - step[0], j - step[1]
        out.append((a[i] if step[0] else "-", b[j] if step[1] else "-"))
    return i, j


def _joined(a: str, b: str, i: int, j: int, out: list) -> tuple[str, str]:
    rows = [(ch, "-") for ch in a[:i]] + [("-", ch) for ch in b[:j]] + out[::-1]
    return "".join(p for p, _ in rows), "".join(q for _, q in rows)


def global_align(a: str, b: str, matrix: np.ndarray, gap: int = -4, banded: bool = True) -> tuple[str, str]:
    """Both texts with gaps. Ties: a diagonal step must beat both gaps, a gap in b the one in a."""
    out: list = []
    i, j = _trace(global_table(bytes_of(a), bytes_of(b), matrix, gap, banded), 0, len(a), len(b), a, b, matrix, gap, out)
    return _joined(a, b, i, j, out)


def align_whole(a: str, b: str, matrix: np.ndarray, gap: int = -4, banded: bool = True, block: int = 4_000) -> tuple[str, str]:
    """The same as global_align. For texts of more than `block` residues only some rows of the
    table are kept, about the root of their number; those between two of them are made again
    on the way back, so that what is held stays small at twice the time."""
    if max(len(a), len(b)) <= block:
        return global_align(a, b, matrix, gap, banded)
    x, y, r, c = bytes_of(a), bytes_of(b), len(a) + 1, len(b) + 1
    every, reach, slope = math.isqrt(r) + 1, _reach(r, c, banded), -gap * np.arange(c, dtype=np.int32)
    kept = [np.zeros(c, np.int32)]
    above = kept[0]
    for i in range(1, r):
        row = np.zeros(c, np.int32)
        _next_row(above, row, i, x, y, matrix, gap, reach, slope)
        above = row
        if i % every == 0:
            kept.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        first = (i - 1) // every * every
        table = np.zeros((i - first + 1, c), np.int32)
        table[0] = kept[first // every]
        for k in range(first + 1, i + 1):
            _next_row(table[k - first - 1], table[k - first], k, x, y, matrix, gap, reach, slope)
        i, j = _trace(table, first, i, j, a, b, matrix, gap, out)
    return _joined(a, b, i, j, out)


def percent(a: np.ndarray, b: np.ndarray) -> int:
    return 100 * int((a == b).sum()) // len(a) if len(a) else 0


#: Residues that ungapped growth looks at before it looks further.
_LOOK = 4_096


def ungapped_growth(a: np.ndarray, b: np.ndarray, window: int, k: int, identity: int) -> int:
    """How far two texts side by side grow together: from one run of k equal residues to the
    first end of another at most `window` positions on, provided that what is skipped between
    them reaches the identity (whole percent, rounded down).

    Ends of runs and mismatches are found for a stretch at once; skipped parts are told by
    differences of running counts."""
    n, taken = min(len(a), len(b)), 0
    while n - taken >= k:
        same = a[taken : min(n, taken + _LOOK)] == b[taken : min(n, taken + _LOOK)]
        size, last = len(same), taken + _LOOK >= n
        count = np.concatenate([[0], np.cumsum(same)])
        ends = np.flatnonzero(count[k:] - count[:-k] == k) + k
        apart = np.append(np.flatnonzero(~same), size)
        at = 0
        while last or at < size - window:
            run = int(apart[np.searchsorted(apart, at)]) - at
            if run >= k and window >= k:
                at += run // k * k
                continue
            near = ends[np.searchsorted(ends, at + k) : np.searchsorted(ends, at + window, "right")]
            skipped = near - k - at
            fine = (skipped == 0) | (100 * (count[near - k] - count[at]) // np.maximum(skipped, 1) >= identity)
            if not fine.any():
                return taken + at
            at += int(near[np.argmax(fine)]) - at
        taken += at
        if last:
            break
    return taken


def pieces_of(p: str, q: str) -> list[tuple[int, int, int]]:
    """(from in a, from in b, length) of the columns of an alignment without a gap."""
    x, y = bytes_of(p) != 45, bytes_of(q) != 45
    both = np.concatenate([[False], x & y, [False]]).astype(np.int8)
    first, last = np.flatnonzero(np.diff(both) == 1), np.flatnonzero(np.diff(both) == -1)
    i, j = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return [(int(i[f]), int(j[f]), int(e - f)) for f, e in zip(first, last)]


def gapped_growth(a: str, b: str, matrix: np.ndarray, gapped: int = 25, ungapped: int = 10, k: int = 4, identity: int = 60, gap: int = -4) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(residues of a, residues of b, pieces without a gap) of the starts that match: ungapped
    growth in turn with a global alignment of the next `gapped` residues of both, until one
    text ends or an alignment misses the identity."""
    x, y, i, j = bytes_of(a), bytes_of(b), 0, 0
    pieces: list[tuple[int, int, int]] = []

    def add(u: int, v: int, n: int) -> None:
        if pieces and pieces[-1][0] + pieces[-1][2] == u and pieces[-1][1] + pieces[-1][2] == v:
            u, v, n = pieces[-1][0], pieces[-1][1], pieces.pop()[2] + n
        if n:
            pieces.append((u, v, n))

    while True:
        n = ungapped_growth(x[i:], y[j:], ungapped, k, identity)
        add(i, j, n)
        i, j = i + n, j + n
        if i == len(a) or j == len(b):
            return i, j, pieces
        p, q = global_align(a[i : i + gapped], b[j : j + gapped], matrix, gap)
        if percent(bytes_of(p), bytes_of(q)) < identity:
            return i, j, pieces
        for u, v, n in pieces_of(p, q):
            add(i + u, j + v, n)
        i, j = i + len(p) - p.count("-"), j + len(q) - q.count("-")


def xdrop(a: str, i: int, b: str, j: int, k: int, matrix: np.ndarray, drop: int = 12) -> tuple[int, int, int, int]:
    """Half-open ranges of both texts around a seed of k, grown to the right and then to the
    left from the best score so far, each until it has fallen by more than `drop`."""
    x, y = bytes_of(a), bytes_of(b)

    def best(p: np.ndarray, q: np.ndarray) -> int:
        n = min(len(p), len(q))
        score = np.cumsum(matrix[p[:n], q[:n]])
        top = np.maximum(np.maximum.accumulate(score), 0) if n else score
        fallen = np.flatnonzero(top - score > drop)
        score = score[: fallen[0]] if len(fallen) else score
        return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0

    right, left = best(x[i + k :], y[j + k :]), best(x[:i][::-1], y[:j][::-1])
    return i - left, i + k + right, j - left, j + k + right


def align_pairs(df: DataFrame, a: str, b: str, matrix: np.ndarray, gap: int = -4, banded: bool = True) -> DataFrame:
    """The rows with aligned_a and aligned_b; null texts count as empty."""
    names = [*df.columns, "aligned_a", "aligned_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            done = [align_whole(p or "", q or "", matrix, gap, banded) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in done], pa.string()), pa.array([q for _, q in done], pa.string())], names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", aligned_a STRING, aligned_b STRING")
