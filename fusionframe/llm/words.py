"""Words of many texts at once: spans and 64-bit hashes, by numpy over the joined bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.multiply.accumulate(np.full(1024, np.uint64(0x9E3779B97F4A7C15)))
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(sizes: list[int], most: int = PIECE):
    """Ranges of consecutive rows of about `most` bytes together; a longer row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def joined_words(texts: list[bytes]):
    """(bytes, word starts, word ends, word hashes, first word of each text) of texts joined by newlines.

    Words are runs of bytes other than space and \\x09-\\x0D.
    The hash serves partitioning and sieving only: equal words have equal hashes.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    first_byte = np.cumsum(lengths) - lengths
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of whole words, so that temporary arrays stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        n, lo, hi = lengths[at:to], starts[at], ends[to - 1]
        letters = data[lo:hi][~space[lo:hi]].astype(np.uint64)
        begin = first_byte[at:to] - first_byte[at]
        within = np.arange(len(letters)) - np.repeat(begin, n)
        hashes[at:to] = mix(np.add.reduceat((letters + np.uint64(1)) * _POWER[within & 1023], begin) + n.astype(np.uint64))
        at = to
    heads = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return data, starts, ends, hashes, np.searchsorted(starts, heads)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive words; empty where there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
