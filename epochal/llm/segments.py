"""Windows that occur more than once, brought together by content.

The windows of fixed length that start in a sequence are cut into segments: runs of starts whose windows have the same least
hash (their anchor) among all short grams inside. Equal windows have equal anchors wherever they lie, so only segments of one
anchor need to be compared, and no sequence is ever compared with all others. Sequences are texts as bytes or as hashed words.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambled form of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` (a power of two) symbols."""
    h = mix(symbols.astype(np.uint64) + _MULTIPLIER)
    width, factor = 1, _MULTIPLIER
    while width < gram:
        with np.errstate(over="ignore"):
            h = h[: len(h) - width] * factor + h[width:]
            factor = factor * factor
        width *= 2
    return mix(h)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` numbers, from running minima inside blocks of that width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: Places below which two equal grams of one window are told apart by the low bits of their keys.
_PLACES = np.uint64(0xFFF)
#: Starts of a segment beyond which it is cut, so that texts of one letter become bounded pieces too.
PIECE = 1024


def cut(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, end of starts (exclusive) and anchor of each segment of many sequences laid end to end, and the place of its
    anchor's gram from the first start; -1 if the gram is there more than once: only then can two windows of one segment be
    equal. ``offsets`` are where the sequences begin, and the end."""
    if len(symbols) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    hashes = gram_hashes(symbols, gram) & ~_PLACES
    place = np.arange(len(hashes), dtype=np.uint64) & _PLACES
    reach = window - gram + 1
    left = sliding_minimum(hashes | place, reach)  # the leftmost of the least, then the rightmost
    right = sliding_minimum(hashes | (_PLACES - place), reach) if reach > 1 else hashes | (_PLACES - place)
    anchor = left & ~_PLACES
    whole = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)] - np.arange(len(anchor)) >= window
    change = np.append(True, (anchor[1:] != anchor[:-1]) | ~whole[:-1])
    first = np.flatnonzero(whole & change)
    end = np.flatnonzero(whole & np.append(change[1:] | ~whole[1:], True)) + 1
    pieces = -(-(end - first) // PIECE)
    of = np.repeat(np.arange(len(first)), pieces)
    a = first[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    b = np.minimum(a + PIECE, end[of])
    low = left[a] & _PLACES
    once = low == _PLACES - (right[b - 1] & _PLACES)
    place = np.where(once, (low.astype(np.int64) - a) & int(_PLACES), -1)
    return a, b, anchor[a].view(np.int64), place
