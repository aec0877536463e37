"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Separators of plain words: everything in ASCII but letters and digits.
PLAIN = np.ones(256, dtype=bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = False
#: Bytes hashed at once; a slice ends between two words.
SLICE = 1 << 21
_POWERS = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        full = np.full(max(n, 64), _PRIME, dtype=np.uint64)
        full[0] = 1
        _POWERS = np.multiply.accumulate(full)
    return _POWERS


def _words(data: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice of lower-cased bytes."""
    inside = ~gaps[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    return starts, mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def words_of(data: bytes, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts (byte offsets) and hashes of all words of `data`; A-Z and a-z are the same."""
    flat = np.frombuffer(data, dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(flat):
        end = at + SLICE
        if end < len(flat):  # on to the next space
            while end < len(flat) and not (gap := np.flatnonzero(gaps[flat[end : end + 65536]])).size:
                end += 65536
            end = min(len(flat), end + int(gap[0])) if end < len(flat) else len(flat)
        s, h = _words(_LOWER[flat[at:end]], gaps)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of k words.

    A text with fewer words has its whole sequence as one shingle; without words, or null, it has none.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= SLICE:
            yield from _sets(group, k)
            group, size = [], 0
    yield from _sets(group, k)


def _sets(group: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not group:
        return
    starts, hashes = words_of(b"\n".join(group))
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in group])))
    bounds = np.searchsorted(starts, edges)
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64)) for i in range(k)]
    n = len(hashes) - k + 1
    shingles = np.zeros(max(n, 0), dtype=np.uint64)
    for i, factor in enumerate(factors):
        shingles += hashes[i : i + len(shingles)] * factor
    shingles = mixed(shingles)
    for low, high in zip(bounds, bounds[1:]):
        if high - low >= k:
            found = np.sort(shingles[low : high - k + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif high > low:
            short = np.uint64(int(high - low))
            for h, factor in zip(hashes[low:high], factors):
                short = np.uint64((int(short) + int(h) * int(factor)) & 0xFFFFFFFFFFFFFFFF)
            yield mixed(np.array([short], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
