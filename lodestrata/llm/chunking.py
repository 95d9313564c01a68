"""Content-defined chunks: cuts where a rolling gear hash of the last 32 bytes has its low bits zero."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Bytes that the hash looks back; a cut is a function of these bytes alone.
WINDOW = 32
LEAST, MOST, MASK_BITS = 512, 16384, 11

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte of a uint8 array: the sum of gear[b] << age over the last 32 bytes, by five doublings."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h[k:] += older
    return h


def cut_points(data: np.ndarray, ends: np.ndarray, least: int = LEAST, most: int = MOST, mask_bits: int = MASK_BITS) -> list[list[int]]:
    """For payloads that lie one after another in `data` and stop at `ends`: the offsets, in each payload, where its chunks end.

    A chunk has at least `least` (> 32, so that no hash reaches into another payload) and at most `most` bytes, but for a
    payload's last, which may be shorter. An empty payload has one empty chunk.
    """
    if least <= WINDOW:
        raise ValueError("a chunk must be longer than the hash's window")
    low = np.uint32((1 << mask_bits) - 1)
    marks = np.flatnonzero((gear_hash(data) & low) == 0) + 1
    out, start = [], 0
    first = np.searchsorted(marks, np.concatenate(([0], ends[:-1])), side="right")
    last = np.searchsorted(marks, ends, side="left")
    for end, i, j in zip(ends.tolist(), first.tolist(), last.tolist(), strict=True):
        cuts, at, size = [], 0, end - start
        if size > least:
            for mark in (marks[i:j] - start).tolist():
                while mark - at > most:
                    at += most
                    cuts.append(at)
                if mark - at >= least:
                    at = mark
                    cuts.append(at)
            while size - at > most:
                at += most
                cuts.append(at)
        if at < size or not cuts:
            cuts.append(size)
        out.append(cuts)
        start = end
    return out
