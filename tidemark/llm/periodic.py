"""Periodic runs of words: aligned power-of-two blocks searched across their document, seeds extended both ways.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, TIMES * q) that no neighbouring word
extends. For b <= q < 2b such a run holds an aligned block of b words (it begins at a multiple of b) together with its copy q words
further on. So at each scale b the aligned blocks are keys of an Aho-Corasick automaton over word numbers, the automaton is run over
the document, and an occurrence at a distance d with b <= d < 2b from the aligned block seeds the pair (block, d), which is
extended word by word to both sides while words d apart agree. Each occurrence has one aligned block at such a distance, so
there are at most n seeds at a scale and n log n in all; one automaton of at most n words is alive at a time.

A document is one row, so runs never cross documents and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: A run's least length: in words, and in periods.
LEAST, TIMES = 6, 4
FOUND = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of anything but ASCII space and the controls 9 to 13, which is what splitting bytes does."""
    return text.split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number in order of first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def _candidates(ids: np.ndarray, times: int) -> dict[int, np.ndarray]:
    """By scale b, the aligned places whose block may come again at a distance in [b, 2b).

    The pairs of words at its beginning, in its middle and at its end must each come again at such a distance; all scales are looked up
    at once among the sorted places of pairs.
    """
    # three equal words stand in every run of period 1
    n, found, b = len(ids), {1: np.flatnonzero((ids[:-2] == ids[1:-1]) & (ids[1:-1] == ids[2:]))}, 2
    starts, scales = [], []
    while times * b <= n:
        starts.append(np.arange(0, n - 2 * b + 1, b))
        scales.append(b)
        b *= 2
    if not scales:
        return found
    scale = np.repeat(np.array(scales), [len(s) for s in starts])
    start = np.concatenate(starts)
    pair = ids[:-1] * (ids.max() + 1) + ids[1:]
    order = np.argsort(pair, kind="stable")
    grouped = pair[order]
    rank = np.empty(n - 1, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], grouped[1:] != grouped[:-1])))
    places = rank[order] * n + order
    for offset in (lambda b: 0, lambda b: b - 2, lambda b: (b - 2) // 2):
        at = start + offset(scale)
        base = rank[at] * n
        near = places[np.minimum(np.searchsorted(places, base + at + scale), n - 2)] - base  # where the pair comes again
        fits = (near >= at + scale) & (near < np.minimum(at + 2 * scale, n))
        start, scale = start[fits], scale[fits]
    return found | {b: start[scale == b] for b in scales}


def _agree_right(ids: np.ndarray, x: int, d: int) -> int:
    """The first place from x on where the word d further differs."""
    last, size = len(ids) - d, 32
    while x < last:
        end = min(x + size, last)
        if (other := ids[x:end] != ids[x + d : end + d]).any():
            return x + int(other.argmax())
        x, size = end, size * 4
    return last


def _agree_left(ids: np.ndarray, x: int, d: int) -> int:
    """The first of the places up to x that all agree with the words d further."""
    size = 32
    while x > 0:
        low = max(x - size, 0)
        if (other := (ids[low:x] != ids[low + d : x + d])[::-1]).any():
            return x - int(other.argmax())
        x, size = low, size * 4
    return 0


def _seeds(ids: np.ndarray, text: tuple[int, ...], starts: np.ndarray, b: int) -> np.ndarray:
    """Rows (distance, start): aligned blocks and their occurrences at distances in [b, 2b), in order."""
    names: dict[tuple[int, ...], int] = {}
    block = np.full(len(ids) // b + 1, -1, dtype=np.int64)  # the key that each aligned place has
    for p in starts.tolist():
        block[p // b] = names.setdefault(text[p : p + b], len(names))
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, name in names.items():
        machine.add_word(key, name)
    machine.make_automaton()
    hits = np.array(list(machine.iter(text)), dtype=np.int64).reshape(-1, 2)
    x, name = hits[:, 0] - (b - 1), hits[:, 1]
    aligned = x // b - 1  # the one aligned block that begins b to 2b - 1 words before x
    fits = (aligned >= 0) & (block[np.maximum(aligned, 0)] == name)
    p = aligned[fits] * b
    d = x[fits] - p
    order = np.lexsort((p, d))
    return np.stack([d[order], p[order]], axis=1)


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. `times` is 3 or more: below, a run need not hold an aligned block."""
    if times < 3:
        raise ValueError("a run needs three periods or more to hold an aligned block and its copy")
    n = len(ids)
    if n < max(least, times):
        return []
    found: set[tuple[int, int, int]] = set()
    spans: set[tuple[int, int]] = set()
    reach = np.zeros(n, dtype=np.int64)  # the furthest end of a run of a smaller scale that holds a place
    text = None
    for b, starts in _candidates(ids, times).items():
        # within a run of a smaller period that goes on so far, every seed is a multiple of that period
        starts = starts[reach[starts] < np.minimum(starts + 3 * b - 1, n)]
        if len(starts):
            text = text or tuple(ids.tolist())
            new, last, upto = [], 0, 0
            for d, p in _seeds(ids, text, starts, b).tolist():
                if (d == last and p < upto) or reach[p] >= p + d + b:
                    continue  # in the stretch just extended, or in a run whose period divides d
                last, low, upto = d, _agree_left(ids, p, d), _agree_right(ids, p + b, d)
                length = upto - low + d
                # a stretch of the same place and length from a smaller scale has a period that divides d
                if length >= max(least, times * d) and (low, length) not in spans:
                    new.append((low, length, d))
            for low, length, d in new:
                found.add((low, length, d))
                spans.add((low, length))
                np.maximum(reach[low : low + length], low + length, out=reach[low : low + length])
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def periodic_runs(documents: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`documents` with `runs` (array of start, length, period in words, by start, then period) and `collapsed` (the text's words
    joined by one space, each run reduced to its first period) in place of columns of these names.

    Null and empty texts have no runs and collapse to ''. A text is searched whole, however long. Every row stays, repeated
    rows and ids too, each judged alone; an empty table gives no rows.
    """

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            runs, kept = [], []
            for text in texts:
                words = words_of(text.encode("utf-8", "surrogatepass"))
                own = find_runs(numbered(words), least, times)
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in own])
                kept.append(collapsed(words, own).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"runs": runs, "collapsed": kept})

    rest = [c for c in documents.columns if c not in ("runs", "collapsed")]
    found = documents.select(*rest, search(text_of(text_col)).alias("_found"))
    return found.select(*rest, "_found.runs", "_found.collapsed")
