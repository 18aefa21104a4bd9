"""Minimizers of residue texts, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Residues that one numpy pass takes: many short texts, or a long one.
_CHUNK = 500_000


def _hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-mer of a text of at least k residues."""
    part, power, step, have, h = text.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15), 1, 0, None
    n = len(text) - k + 1
    with np.errstate(over="ignore"):
        while step <= k:  # hashes of 1, 2, 4 ... residues; those in k's binary form are joined
            if k & step:
                h = part[:n].copy() if h is None else h * power + part[have : have + n]
                have += step
            part = part[:-step] * power + part[step:]
            power, step = power * power, step * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _lowest(h: np.ndarray, wide: int) -> np.ndarray:
    """Place of the smallest value (leftmost on ties) of each window, by doubling its width."""
    value, at, have = h, np.arange(len(h)), 1
    while have < wide:
        step = min(have, wide - have)
        left = value[:-step] <= value[step:]
        value, at, have = np.where(left, value[:-step], value[step:]), np.where(left, at[:-step], at[step:]), have + step
    return at


def batch_minimizers(texts: list[bytes], k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the smallest k-mer hash (leftmost on ties) of each run of
    `span` residues of each text. Equal runs choose the same one, wherever they stand."""
    got = [_chunk_minimizers(texts, lo, hi, k, span) for lo, hi in chunks(texts)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip((none, none, none), *got))


def chunks(texts: list) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _chunk_minimizers(texts: list[bytes], lo: int, hi: int, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts[lo:hi]])
    joined = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
    if len(joined) < span:
        return (np.zeros(0, np.int64),) * 3
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = _hashes(joined, k)
    at = _lowest(h, span - k + 1)
    begin = np.arange(len(at))
    at = np.unique(at[begin + span <= starts[owner[begin] + 1]])  # windows within one text
    return owner[at] + lo, at - starts[owner[at]], h[at].view(np.int64)


def variety(texts: list[bytes], owner: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Different letters in the k-mers at `pos` of the texts `owner`."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    seen = np.sort(joined[(starts[owner] + pos)[:, None] + np.arange(k)], axis=1)
    return 1 + (seen[:, 1:] != seen[:, :-1]).sum(axis=1)


def minimizers(text: bytes, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one text's minimizers."""
    return batch_minimizers([text], k, span)[1:]
