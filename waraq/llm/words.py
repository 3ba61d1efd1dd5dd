"""Hashes of all words of a batch of texts at once, from the concatenated UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from waraq.llm.textops import splitmix

BLOCK = 1 << 19
_RATIO = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64))

#: Bytes that are part of a word: ASCII letters and digits, and everything beyond ASCII.
WORD_BYTES = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
#: Bytes that are not ASCII white space.
SOLID_BYTES = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def _power_table(n: int, ratio: int) -> np.ndarray:
    """ratio**0 .. ratio**n modulo 2**64."""
    if ratio not in _powers or len(_powers[ratio]) <= n:
        with np.errstate(over="ignore"):
            base = np.full(max(n, BLOCK) + 1, np.uint64(ratio))
            base[0] = 1
            _powers[ratio] = np.multiply.accumulate(base)
    return _powers[ratio]


def word_spans(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes that does not cross a row's boundary."""
    n = len(data)
    mark = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = mark.copy()
    start[1:] &= ~mark[:-1] | first[1:n]
    stop = mark.copy()
    stop[:-1] &= ~mark[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their byte starts, and the rows' offsets into both.

    A word's hash is a polynomial over its bytes, read off prefix sums modulo 2**64 and mixed. The prefix sums are made
    in blocks that end between words, so the memory beside the text is bounded except for a single huge word.
    """
    starts, ends = word_spans(data, inside, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = np.zeros(len(starts), np.uint64)
    inverse = pow(_RATIO, -1, 1 << 64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            origin = starts[at]
            end = max(at + 1, int(np.searchsorted(ends, origin + BLOCK, side="right")))
            piece = data[origin : ends[end - 1]]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[piece] * _power_table(len(piece), _RATIO)[: len(piece)], out=sums[1:])
            s, e = starts[at:end] - origin, ends[at:end] - origin
            out[at:end] = (sums[e] - sums[s]) * _power_table(len(piece), inverse)[s]
            at = end
    return splitmix(out), starts, np.searchsorted(starts, offsets)
