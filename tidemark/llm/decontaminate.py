"""Benchmark decontamination: edit distance of words, found by CGK embeddings and bit-sampling LSH, then verified.

A text contains an item of n words if some passage is at most e = floor(0.2 n) word edits from it. Such a passage keeps
runs of q words of the item, at least m - e q of its m runs (each edit breaks q of them). So an item is looked up by
its rarest runs only: as many as leave no passage out that shares `need` (one or two) of them. A run that very
many items share is thus hardly ever looked up.

1. `_items`, `_runs_of`: a benchmark as tables of words and of runs to look up; whatever its size, the driver gets a bit filter of
   at most FILTER bits of it.
2. One pass over the documents: runs that the filter knows are hits, and the words around them are segments. Other
   documents leave nothing.
3. Hits and runs are joined by hash; keys of very many hits are salted. A segment and an item that share enough runs give
   item-sized windows, one for each offset.
4. A window and its item are embedded by the same random walks: at each step the current word is written down and a random bit of
   (step, word) says whether to go on to the next one. Few edits leave most coordinates equal. Each walk is sampled at PICKS
   coordinates; a window that agrees with its item on all samples of some walk is a candidate, and its edit distance
   is computed exactly. Long items are embedded in pieces, of which one has no more than its share of the edits: walks that
   part at an edit meet again sooner in a short piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, release, salted_join, stored
from tidemark.llm.shingles import PLAIN, SLICE, mixed, words_of

#: Words of 5 that may be edited (1 in 5: a similarity of 0.8).
SHARE = 5
#: Sampled coordinates of a walk and number of walks; words of a piece: recall above 0.97 at the largest distance (see tests).
PICKS, REPEATS, PIECE = 2, 48, 64
#: Longest run of words that is looked up; most bits of the filter; walks of windows embedded at once.
RUN, FILTER, WALKS = 4, 1 << 28, 1 << 17
#: Bytes of the filter that one task sets.
PART = 1 << 16


def _runs(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words that begin at each word but the last q - 1."""
    out = np.zeros(max(len(hashes) - q + 1, 0), dtype=np.uint64)
    for i in range(q):
        out += hashes[i : i + len(out)] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64))
    return mixed(out + np.uint64(q))


def plan(n: int) -> tuple[int, int, int, int]:
    """For an item of n words: edits, words of a run, runs looked up, and how many of these a passage must share."""
    e = n // SHARE
    q = min(RUN, -(-(n - e) // (e + 1)))
    runs = n - q + 1
    kept = max(runs - e * q, 1)
    need = min(2, kept)
    return e, q, runs - kept + need, need


def pieces(n: int) -> tuple[int, int]:
    """Number and words of the pieces of an item of n words."""
    k = max(1, n // PIECE)
    return k, n // k


def embed(words: np.ndarray, length: int) -> np.ndarray:
    """Sampled coordinates of the walks over each row of `words` (rows of `length` words): rows x walks keys."""
    steps, walks = 3 * length, REPEATS
    rng = np.random.default_rng(length)
    odd = rng.integers(0, 1 << 63, (steps, walks), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # a walk ends after about 2 * length steps; later coordinates are padding and tell nothing
    picked = np.sort(np.argsort(rng.random((2 * length, walks)), axis=0)[:PICKS], axis=0)
    padded = np.concatenate([words, np.zeros((len(words), 1), dtype=np.uint64)], axis=1)
    at, rows = np.zeros((len(words), walks), dtype=np.int64), np.arange(len(words))[:, None]
    keys = np.broadcast_to(np.arange(walks, dtype=np.uint64), at.shape).copy()
    for step in range(int(picked.max()) + 1):
        now = padded[rows, at]
        chosen = (picked == step).any(axis=0)
        if chosen.any():
            keys[:, chosen] = mixed(keys[:, chosen] * np.uint64(0x9E3779B97F4A7C15) + now[:, chosen])
        at = np.minimum(at + ((now * odd[step]) >> np.uint64(63)).astype(np.int64), length)
    return keys


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least number of word edits between the item and any passage of the text, and where that passage ends."""
    n = items.shape[1]
    ramp = np.arange(n + 1)
    row = np.broadcast_to(ramp, (len(items), n + 1)).copy()
    best, end = row[:, n].copy(), np.zeros(len(items), dtype=np.int64)
    for t in range(texts.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(row[:, :-1] + (items != texts[:, t : t + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        better = row[:, n] < best
        best[better], end[better] = row[better, n], t + 1
    return best, end


def _words(text: str | None) -> np.ndarray:
    return words_of((text or "").encode("utf-8", "surrogatepass"), PLAIN)[1]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """no, item, n, words: a row for each distinct item and text that has words; no is unique."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            words = [_words(t) for t in batch.column(1).to_pylist()]
            some = np.flatnonzero([len(w) for w in words])
            columns = [pa.array(some + number), batch.column(0).take(pa.array(some)), pa.array([len(words[i]) for i in some], pa.int32()), pa.array([words[i].tobytes() for i in some], pa.binary())]
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["no", "item", "n", "words"])

    distinct = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).dropDuplicates()
    return stored(distinct.mapInArrow(run, f"no long, item {kind}, n int, words binary"), "items")


def _runs_of(items: DataFrame) -> DataFrame:
    """key, place, no, n, need, q: the runs by which items are looked up, the rarest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, n, words in zip(*(batch.column(c).to_pylist() for c in ("no", "n", "words"))):
                _, q, most, need = plan(n)
                keys = _runs(np.frombuffer(words, dtype=np.uint64), q).view(np.int64)
                fixed = [pa.array(np.full(len(keys), v, dtype=t)) for v, t in ((no, np.int64), (n, np.int32), (need, np.int32), (most, np.int32), (q, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys), dtype=np.int32)), *fixed], names=["key", "place", "no", "n", "need", "most", "q"])

    every = stored(items.select("no", "n", "words").mapInArrow(run, "key long, place int, no long, n int, need int, most int, q int"), "runs")
    common = stored(every.groupBy("key").agg(F.count("*").alias("copies")), "copies")
    # an item's runs are as many as its words
    ranked = every.join(common, "key").groupBy("no", "n", "need", "most", "q").agg(F.sort_array(F.collect_list(F.struct("copies", "place", "key"))).alias("r"))
    rare = ranked.select("no", "n", "need", "q", F.explode(F.slice("r", F.lit(1), F.col("most"))).alias("r"))
    out = stored(rare.select("r.key", "r.place", "no", "n", "need", "q"), "rare")
    release(every)
    release(common)
    return out


def _bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a filter of a power of two of bits."""
    mask = np.uint64(bits - 1)
    return keys & mask, (keys >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask


def _filter(runs: DataFrame) -> np.ndarray:
    """The bits of all keys as bytes; 64 bits or more for each key while they are no more than FILTER.

    Tasks set the bits of blocks of PART bytes; the driver gets a block a row, FILTER bits in all at most.
    """
    count = runs.count()
    bits = min(FILTER, max(1 << 16, 1 << (64 * count).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // (8 * PART)).astype(np.int32)), pa.array((at % (8 * PART)).astype(np.int32))], names=["part", "at"])

    def block(rows: pa.Table) -> pa.Table:
        flags = np.zeros(8 * PART, dtype=bool)
        flags[rows["at"].to_numpy()] = True
        return pa.table([pa.array([rows["part"][0].as_py()], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    blocks = runs.select("key").mapInArrow(places, "part int, at int").groupBy("part").applyInArrow(block, "part int, bits binary").toArrow()
    out = np.zeros(max(bits >> 3, PART), dtype=np.uint8)
    for k, content in zip(blocks["part"].to_pylist(), blocks["bits"]):
        out[k * PART : (k + 1) * PART] = np.frombuffer(content.as_buffer(), dtype=np.uint8)
    return out[: bits >> 3]


def _known(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter may hold."""
    first, second = _bits(keys, len(known) << 3)
    maybe = np.flatnonzero(known[(first >> np.uint64(3)).astype(np.int64)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
    second = second[maybe]
    return maybe[(known[(second >> np.uint64(3)).astype(np.int64)] >> (second & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def hits(hashes: np.ndarray, bounds: np.ndarray, known: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, places (in all words) and keys of the runs that the filter may hold; text i has the words bounds[i]:bounds[i + 1]."""
    found = []
    for q in lengths:
        runs = _runs(hashes, q)
        at = _known(runs, known)
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + q <= bounds[text + 1]
        found.append((text[inside], at[inside], runs[at][inside]))
    text, at, keys = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((at, text))
    return text[order], at[order], keys[order]


def _segments(texts: list[str | None], known: np.ndarray, lengths: list[int], reach: int) -> list[tuple]:
    """(text, first word, words, keys, places) of the stretches of texts around hits, `reach` words to each side; places count from the first word."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts, hashes = words_of(b"\n".join(encoded), PLAIN)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in encoded]))))
    text, at, keys = hits(hashes, bounds, known, lengths)
    if not len(at):
        return []
    low, high = np.maximum(at - reach, bounds[text]), np.minimum(at + RUN + reach, bounds[text + 1])
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (low[1:] > high[:-1]))))
    ends = [*new[1:], len(at)]
    return [(int(text[a]), int(low[a] - bounds[text[a]]), hashes[low[a] : high[b - 1]].tobytes(), keys[a:b].view(np.int64), (at[a:b] - low[a]).astype(np.int32)) for a, b in zip(new, ends)]


def contaminations(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, distance, item_words, first_word, last_word): the best passage of each item in each row of `documents`.

    Words: runs of letters and digits, A-Z and a-z alike. Items of fewer than five words must occur exactly; items and texts
    that are null or have no words match nothing; items may be equal, then each is found. Repeated rows and ids each give
    their rows; ties go to the first passage; an empty table on either side gives no rows; other columns are not read. A
    text is read whole, however long; only stretches around runs of the benchmark go on. Words of a passage are
    counted from 0; `first_word` supposes a passage as long as its item.
    """
    id_type, item_type = documents.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = _items(benchmark, item_col, item_text)
    longest = items.agg(F.max("n")).head()[0]
    if longest is None:
        return documents.sparkSession.createDataFrame([], f"{id_col} {id_type}, {item_col} {item_type}, distance long, item_words long, first_word long, last_word long")
    runs = _runs_of(items)
    known, lengths = _filter(runs), sorted(r.q for r in runs.select("q").distinct().collect())  # at most RUN lengths
    reach = longest + longest // SHARE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, low, size = batch.column(1), 0, 0
            for i in range(len(texts)):
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size >= SLICE or i == len(texts) - 1:
                    found = _segments(texts.slice(low, i + 1 - low).to_pylist(), known, lengths, reach)
                    own = np.array([f[0] for f in found], dtype=np.int64) + low
                    columns = [pa.array(np.arange(number, number + len(found))), pa.array(own + row), batch.column(0).take(pa.array(own))]
                    columns += [pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.list_(pa.int64())), pa.array([f[4] for f in found], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["seg", "row", "id", "first", "words", "keys", "places"])
                    number += len(found)
                    low, size = i + 1, 0
            row += batch.num_rows

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    found = stored(rows.mapInArrow(scan, f"seg long, row long, id {id_type}, first int, words binary, keys array<long>, places array<int>"), "segments")
    hit = stored(found.select("seg", F.explode(F.arrays_zip("keys", "places")).alias("h")).select("seg", F.col("h.keys").alias("key"), F.col("h.places").alias("at")), "hits")
    met = salted_join(hit, runs.select("key", "place", "no", "n", "need"), ["key"], F.col("seg"), hot=HOT)
    # an item's offsets in a segment: as many as the segment has words, at most
    pairs = met.groupBy("seg", "no", "n", "need").agg(F.count_distinct("place").alias("shared"), F.collect_set(F.col("at") - F.col("place")).alias("offsets")).where("shared >= need")
    asked = pairs.groupBy("seg").agg(F.collect_list(F.struct("no", "n", F.sort_array("offsets").alias("offsets"))).alias("asked"))
    near = _windows(found.select("seg", "row", "id", "first", "words").join(asked, "seg"), id_type)
    verified = salted_join(near, items.select("no", "item", F.col("words").alias("item_words")), ["no"], F.col("seg"), hot=HOT)
    columns = ["row", "id", "item", "no", "first", "words", "starts", "item_words"]
    schema = f"row long, id {id_type}, item {item_type}, no long, distance long, n long, first_word long, last_word long"
    checked = verified.select(*columns).mapInArrow(_verified, schema)
    best = checked.groupBy("row", "no").agg(F.min(F.struct("distance", "last_word", "first_word", "n")).alias("b"), F.first("id").alias("id"), F.first("item").alias("item"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.distance", F.col("b.n").alias("item_words"), "b.first_word", "b.last_word")


def _windows(segments: DataFrame, id_type: str) -> DataFrame:
    """The words around each cluster of an item's offsets in a segment, cut out: seg, row, id, first, words, no, starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg, row, first, data, asked = (batch.column(c)[i].as_py() for c in ("seg", "row", "first", "words", "asked"))
                words, parts = np.frombuffer(data, dtype=np.uint64), []
                for a in asked:
                    at, n, e = np.array(a["offsets"], dtype=np.int64), a["n"], a["n"] // SHARE
                    for group in np.split(at, np.flatnonzero(np.diff(at) > n + 2 * e) + 1):
                        low, high = max(int(group[0]) - e, 0), min(int(group[-1]) + n + e, len(words))
                        parts.append((first + low, words[low:high].tobytes(), a["no"], (group - low).astype(np.int32)))
                fixed = [pa.array([v] * len(parts), pa.int64()) for v in (seg, row)]
                own = batch.column("id").take(pa.array([i] * len(parts), pa.int64()))
                yield pa.RecordBatch.from_arrays([*fixed, own, *(pa.array([x[k] for x in parts], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int32()))))], names=["seg", "row", "id", "first", "words", "no", "starts"])

    return stored(segments.mapInArrow(cut, f"seg long, row long, id {id_type}, first int, words binary, no long, starts array<int>"), "windows")


def _cut(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Rows of n words from each start; places outside hold a number that no word has."""
    at = starts[:, None] + np.arange(n)
    out = words[np.clip(at, 0, len(words) - 1)]
    out[(at < 0) | (at >= len(words))] = 1
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [np.frombuffer(w, dtype=np.uint64) for w in batch.column("item_words").to_pylist()]
        texts = [np.frombuffer(w, dtype=np.uint64) for w in batch.column("words").to_pylist()]
        starts = [np.array(s, dtype=np.int64) for s in batch.column("starts").to_pylist()]
        rows: list[tuple[int, int, int, int]] = []
        for n in sorted({len(w) for w in items}):
            own = [i for i, w in enumerate(items) if len(w) == n]
            index = np.repeat(own, [len(starts[i]) for i in own])
            at = np.concatenate([starts[i] for i in own])
            step = max(1, WALKS // (REPEATS * pieces(n)[0]))
            for low in range(0, len(index), step):
                rows += _near(index[low : low + step], at[low : low + step], items, texts, n)
        first = batch.column("first").to_pylist()
        own = pa.array([r[0] for r in rows], pa.int64())
        columns = [batch.column(c).take(own) for c in ("row", "id", "item", "no")]
        numbers = [(d, len(items[i]), max(first[i] + end - len(items[i]), 0), first[i] + end) for i, _, d, end in rows]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in numbers], pa.int64()) for k in range(4))], names=["row", "id", "item", "no", "distance", "n", "first_word", "last_word"])


def _near(index: np.ndarray, at: np.ndarray, items: list[np.ndarray], texts: list[np.ndarray], n: int) -> list[tuple[int, int, int, int]]:
    """(row, start, distance, end) of the windows at `at` of texts[index] that are near their items, all of n words."""
    e = n // SHARE
    unique, which = np.unique(index, return_inverse=True)
    wanted = np.stack([items[i] for i in unique])
    order = np.concatenate([np.flatnonzero(which == k) for k in range(len(unique))])
    count, size = pieces(n)
    close = np.zeros(len(order), dtype=bool)
    for low in range(0, count * size, size):
        windows = np.concatenate([_cut(texts[i], at[which == k] + low, size) for k, i in enumerate(unique)])
        close |= (embed(windows, size) == embed(wanted[:, low : low + size], size)[which[order]]).any(axis=1)
    chosen = order[close]
    if not len(chosen):
        return []
    around = np.concatenate([_cut(texts[index[j]], at[j : j + 1] - e, n + 2 * e) for j in chosen])
    d, end = distances(wanted[which[chosen]], around)
    return [(int(index[j]), int(at[j]), int(dist), int(at[j] - e + stop)) for j, dist, stop in zip(chosen, d, end) if dist <= e]

