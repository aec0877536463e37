"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that occurs elsewhere, by external induced sorting.

The same sort also finds passages, runs of PASSAGE words or more that another document has too: a text's words become a string
of numbers, one a word (a hash), which goes through the same steps beside the text's own bytes, as a unit of its own.

Suffixes are sorted only where they can matter, in the manner of induced sorting: a sample of suffixes first, the others from it.

1. Sample. Of the SEED-byte strings in each LENGTH-byte window the one with the least hash is the window's anchor, so equal
   windows have their anchors at equal places, and about one position in 140 is an anchor. An anchor's windows
   are consecutive: those that begin `first` to `last` bytes into the text.
2. Name. Anchors are named by their seed; a seed that occurs once ends there. If all that an anchor's windows cover occurs
   again around another anchor of the name, all these windows repeat, and nothing needs to be sorted. Equal surroundings
   are counted before anything is joined, so copies are one row however many there are.
3. Sort. The other anchors (one for each different surrounding) bring the bytes around them. Spark's external sort deals them out
   by name, SHARD at a time: the suffixes that begin at anchors are sorted, with the lengths of common prefixes of neighbours.
4. Induce. The suffixes one byte further left are ordered by that byte and, where it is equal, by the order just found; a
   common prefix is one longer than the least of those between the two suffixes before. Byte by byte this gives the order
   and common prefixes of all suffixes in the anchors' windows; a window repeats if a neighbour shares LENGTH bytes.

What would not fit a shard (more than LARGE surroundings of one name) is counted window by window instead, by aggregation.
Tables between the steps are files in the shared folder; whole texts are shuffled twice, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, stored, text_of
from tidemark.llm.shingles import mixed, words_of

LENGTH, SEED = 400, 128
#: Words of the shortest passage, and of its seeds.
PASSAGE, PASSAGE_SEED = 51, 16
#: Windows hashed at once; suffixes sorted at once; surroundings of one name above which windows are counted.
SLICE, SHARD, LARGE = 1 << 18, 20_000, 20_000
#: A key with more than one in HOT of all rows is dealt to SALTS tasks; there are fewer than HOT such keys.
HOT, SALTS = 1000, 64
_BASE = 0x9E3779B97F4A7C15
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_PLACE = np.uint64((1 << 24) - 1)
#: Keeps names of words apart from names of bytes.
_MARK = np.uint64(1 << 40)
#: What a text is a string of, by unit: bytes, hashes of words.
LETTERS = (np.dtype(np.uint8), np.dtype("<u4"))
#: `unit` 0: the text's bytes, 1: its words; places are counted in these. d1, d2: digest of the text; `row` names a row of the input.
ANCHORS = "unit int, row long, d1 long, d2 long, at int, first int, last int, seed long, around long"
AROUND = "unit int, d1 long, d2 long, at int, first int, last int, seed long, lo long, hi long, bytes binary"
SPANS = "d1 long, d2 long, unit int, low int, high int"


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _INVERSES = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if n > len(_POWERS):
        _POWERS, _INVERSES = _geometric(_BASE, n), _geometric(pow(_BASE, -1, 1 << 64), n)
    return _POWERS, _INVERSES


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive keys."""
    n = len(keys)
    blocks = np.concatenate([keys, np.full(-n % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes] | list[np.ndarray], length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """Rows (text, at, first, last, seed hash, surroundings hash) of the anchors of all texts, as a structured array.

    A text: bytes, or an array of hashes of words.
    """
    out, group, size = [], [], 0
    for number, text in enumerate(texts):
        letters = np.frombuffer(text, dtype=LETTERS[0]) if isinstance(text, bytes) else text
        # a long text is cut into pieces that share length - 1 letters: every window is in one piece
        for low in range(0, max(len(letters) - length + 1, 0), SLICE):
            piece = letters[low : low + SLICE + length - 1]
            group.append((number, low, piece))
            size += len(piece)
            if size >= SLICE:
                out.append(_anchors(group, length, seed))
                group, size = [], 0
    if group:
        out.append(_anchors(group, length, seed))
    return np.concatenate(out) if out else np.zeros(0, dtype=_ROW)


_ROW = np.dtype([("text", np.int64), ("at", np.int64), ("first", np.int64), ("last", np.int64), ("seed", np.uint64), ("around", np.uint64)])


def _anchors(group: list[tuple[int, int, np.ndarray]], length: int, seed: int) -> np.ndarray:
    data = np.concatenate([g[2] for g in group])
    values = _TABLE[data] if data.dtype == LETTERS[0] else mixed(data.astype(np.uint64) + _MARK)
    n, w = len(data), length - seed + 1
    powers, inverses = _tables(max(n, 2 * SLICE) + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers[:n], out=sums[1:])
    seeds = mixed((sums[seed:] - sums[:-seed]) * inverses[: n - seed + 1])
    keys = (seeds & ~_PLACE) | np.arange(n - seed + 1, dtype=np.uint64)
    where = (_least(keys, w) & _PLACE).astype(np.int64)
    ends = np.cumsum([len(g[2]) for g in group])
    begins = ends - [len(g[2]) for g in group]
    piece = np.repeat(np.arange(len(group)), ends - begins)[: len(where)]
    inside = np.flatnonzero(np.arange(len(where)) + length <= ends[piece])
    where, piece = where[inside], piece[inside]
    new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (piece[1:] != piece[:-1]))))
    first, last = inside[new], inside[np.concatenate((new[1:] - 1, [len(inside) - 1]))]
    at, of = where[new], piece[new]
    around = (sums[last + length] - sums[first]) * inverses[first]
    rows = np.zeros(len(new), dtype=_ROW)
    shift = np.array([g[1] for g in group])[of] - begins[of]
    rows["text"], rows["at"], rows["first"], rows["last"] = np.array([g[0] for g in group])[of], at + shift, first + shift, last + shift
    rows["seed"], rows["around"] = seeds[at], mixed(around + mixed(((last - first) << 20 | (at - first)).astype(np.uint64)))
    return rows


def words_in(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text, A-Z lower-cased, as 32-bit hashes."""
    out, group, size = [], [], 0
    for number, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= SLICE or number == len(texts) - 1:
            starts, hashes = words_of(b"\n".join(group))
            bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in group]))))
            letters = hashes.astype(LETTERS[1])
            out += [letters[a:b] for a, b in zip(bounds, bounds[1:])]
            group, size = [], 0
    return out


def repeated(seeds: np.ndarray, around: list[bytes], left: np.ndarray, right: np.ndarray, length: int = LENGTH, letter: np.dtype = LETTERS[0], owners: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Induced sorting of one shard: rows (number, near, far), all runs of windows, near to far letters left of an anchor, that repeat.

    `around`: the letters that an anchor's windows cover; the anchor is `left` letters in, its windows begin `right` to
    `left` letters left of it. Only anchors of equal seeds are compared. `owners`: least and largest row that has each
    surrounding; if given, a window repeats only if two rows have it.
    """
    n = len(around)
    size = letter.itemsize
    order = np.array(sorted(range(n), key=lambda i: (seeds[i], around[i][left[i] * size :])), dtype=np.int64)
    width = max(len(around[i]) // size - int(left[i]) for i in range(n))
    ahead = np.zeros((n, width), dtype=letter)
    behind = np.zeros((n, int(left.max()) + 1), dtype=letter)
    have = np.zeros(n, dtype=np.int64)
    for row, i in enumerate(order):
        b = np.frombuffer(around[i], dtype=letter)
        have[row] = len(b) - left[i]
        ahead[row, : have[row]] = b[left[i] :]
        behind[row, : left[i]] = b[: left[i]][::-1]
    # from here rows are numbered in the order of the suffixes that begin at anchors
    far, near = left[order], right[order]
    lo, hi = (o[order] for o in owners) if owners else (None, None)
    differ = ahead[1:] != ahead[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(have[1:], have[:-1]))
    lcp = np.concatenate(([0], np.where(seeds[order[1:]] == seeds[order[:-1]], common, -1)))
    lcp[0] = -1
    group = np.cumsum(lcp < 0)
    rows, marks = np.arange(n), np.zeros((n, behind.shape[1]), dtype=bool)
    for d in range(behind.shape[1]):
        # suffixes d bytes left of anchors, in order; lcp: bytes that one shares with the suffix before, -1 where another class begins
        enough = lcp >= length
        hit = enough | np.concatenate((enough[1:], [False]))
        if owners:  # classes of equal windows, each from one row that shares no more with the row before
            heads = np.flatnonzero(~enough)
            several = np.minimum.reduceat(lo[rows], heads) < np.maximum.reduceat(hi[rows], heads)
            hit &= several[np.cumsum(~enough) - 1]
        marks[rows[hit], d] = True
        keep = far[rows] > d
        key = (group << 8 * size) + behind[rows, d]
        new = np.argsort(key, kind="stable")
        new = new[keep[new]]
        if not len(new):
            break
        same = key[new][1:] == key[new][:-1]
        ranges = np.stack([new[:-1][same] + 1, new[1:][same] + 1], axis=1).ravel()
        fresh = np.full(len(new), -1, dtype=np.int64)
        if len(ranges):
            fresh[1:][same] = np.minimum.reduceat(np.append(lcp, length), ranges)[::2] + 1
        alone = (fresh < 0) & np.concatenate((fresh[1:] < 0, [True]))
        # a suffix alone in its class has no equal further left either
        rows, lcp = rows[new][~alone], fresh[~alone]
        if not len(rows):
            break
        group = np.cumsum(lcp < 0)
    marks &= (np.arange(marks.shape[1]) >= near[:, None]) & (np.arange(marks.shape[1]) <= far[:, None])
    flat = np.zeros((n, marks.shape[1] + 2), dtype=np.int8)
    flat[:, 1:-1] = marks
    edges = np.diff(flat, axis=1)
    row, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return np.stack([order[row], begin, end - 1], axis=1)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of a column, one row at least."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, SLICE + (size[low - 1] if low else 0), "right")))
        yield batch.slice(low, high - low)
        low = high


def _packed(documents: DataFrame) -> DataFrame:
    """The columns with the text, the last one, compressed as `packed`, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in _slices(whole, whole.num_columns - 1):
                texts = [pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "packed"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema.fields[:-1])
    return documents.mapInArrow(run, f"{kept}, packed binary")


def _having(rows: DataFrame, keys: DataFrame, on: list[str], row: str) -> DataFrame:
    """The rows whose key is in `keys`, a written table with `n`, the rows of each key; hot keys are salted by the column `row`."""
    hot = F.col("n") * HOT > (keys.agg(F.sum("n").alias("n")).head().n or 0)
    few = F.broadcast(keys.where(hot).select(*on, F.lit(True).alias("hot")))  # fewer than HOT rows, since n adds up to no more than all
    salted = rows.join(few, on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.col(row), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    each = keys.select(*on, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(each, [*on, "salt"], "left_semi").select(rows.columns)


def _digest(text: Column) -> tuple[Column, Column]:
    hexed = F.sha2(text, 256)
    return tuple(F.conv(F.substring(hexed, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "d1"), (17, "d2")))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Bounds of the lists of structs of numbers in a column, and all their fields end to end; null is an empty list."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return np.concatenate(([0], ends)).astype(np.int64), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def repeated_spans(texts: DataFrame, length: int = LENGTH, seed: int = SEED, large: int = LARGE, passage: int = PASSAGE) -> DataFrame:
    """(d1, d2, unit, low, high): ranges of texts; they may overlap.

    Unit 0: bytes that strings of `length` bytes cover which occur elsewhere. Unit 1: words that runs of `passage` words
    cover which another row has. `texts`: d1, d2, text, a row for each document: a text that two rows have occurs twice.
    """
    lengths, seeds = (length, passage), (seed, min(PASSAGE_SEED, passage))
    shortest = min(length, 2 * passage - 1)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for unit in (0, 1):
                rows = anchors(words_in(data) if unit else data, lengths[unit], seeds[unit])
                own = pa.array(rows["text"])
                ints = [pa.array(rows[c].astype(np.int32)) for c in ("at", "first", "last")]
                hashes = [pa.array(rows[c].view(np.int64)) for c in ("seed", "around")]
                columns = [pa.array(np.full(len(rows), unit, dtype=np.int32)), pa.array(rows["text"] + number), *(batch.column(c).take(own) for c in (0, 1)), *ints, *hashes]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "row", "d1", "d2", "at", "first", "last", "seed", "around"])
            number += batch.num_rows

    known = texts.where(F.length(F.encode("text", "utf-8")) >= shortest).select("d1", "d2", "text")
    found = stored(known.mapInArrow(sample, ANCHORS), "anchors")
    names = stored(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "names")
    shared = stored(_having(found, names, ["seed"], "row"), "shared")
    # one row for each surrounding; `first` takes all columns from the same anchor
    one = [F.first(c).alias(c) for c in ("unit", "d1", "d2", "at", "first", "last")]
    sets = stored(shared.groupBy("seed", "around").agg(F.count("*").alias("copies"), *one, F.min("row").alias("lo"), F.max("row").alias("hi")), "sets")
    twice = stored(sets.where("copies > 1 AND (unit = 0 OR lo < hi)").select("seed", "around", F.col("copies").alias("n")), "twice")
    wide = F.when(F.col("unit") == 0, lengths[0]).otherwise(lengths[1])
    again = _having(shared, twice, ["seed", "around"], "row").select("d1", "d2", "unit", F.col("first").alias("low"), (F.col("last") + wide).alias("high"))
    # one anchor for each surrounding asks whether parts of it occur in others of its name
    several = stored(sets.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "several")
    single = _having(sets, several, ["seed"], "lo")
    asked = stored(single.groupBy("d1", "d2").agg(F.collect_list(F.struct("unit", "at", "first", "last", "seed", "lo", "hi")).alias("anchors")), "asked")
    packed = _packed(known).dropDuplicates(["d1", "d2"])

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            bounds, fields = _lists(batch.column(3))
            for i, packed in enumerate(batch.column(2).to_pylist()):
                text, words = unpack(packed), None
                for low in range(bounds[i], bounds[i + 1], 4096):
                    some = {c: v[low : min(low + 4096, bounds[i + 1])] for c, v in fields.items()}
                    around = []
                    for unit, first, last in zip(some["unit"].tolist(), some["first"].tolist(), some["last"].tolist()):
                        if unit and words is None:
                            words = words_in([text])[0].tobytes()
                        size = LETTERS[unit].itemsize
                        around.append((words if unit else text)[first * size : (last + lengths[unit]) * size])
                    digest = [pa.repeat(batch.column(c)[i], len(around)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(some["unit"]), *digest, *(pa.array(some[c]) for c in ("at", "first", "last", "seed", "lo", "hi")), pa.array(around, pa.binary())], names=["unit", "d1", "d2", "at", "first", "last", "seed", "lo", "hi", "bytes"])

    around = stored(packed.join(asked, ["d1", "d2"]).select("d1", "d2", "packed", "anchors").mapInArrow(surroundings, AROUND), "around")
    too_large = stored(several.where(F.col("n") > large).select("seed"), "large")
    some_large = too_large.limit(1).count() > 0
    fitting = around.join(too_large, "seed", "left_anti") if some_large else around

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SHARD:
                whole = pa.Table.from_batches(held)
                names = whole.column("seed").to_numpy()
                ends = np.flatnonzero(names != names[-1])  # the last name may go on in the next batch
                if len(ends):
                    yield from _induced(whole.slice(0, ends[-1] + 1), lengths)
                    rest = whole.slice(ends[-1] + 1)
                    held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if rows:
            yield from _induced(pa.Table.from_batches(held), lengths)

    parts = [again, fitting.repartition("seed").sortWithinPartitions("unit", "seed").mapInArrow(induce, SPANS)]
    if some_large:
        parts.append(_counted_windows(around.join(too_large, "seed", "left_semi"), lengths))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = stored(out.distinct(), "spans")
    for t in (found, names, shared, sets, twice, several, asked, around):
        release(t)
    return out


def _induced(table: pa.Table, lengths: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Shards of whole names of one unit; a name with more than SHARD surroundings is a shard of its own."""
    seeds, units = table.column("seed").to_numpy(), table.column("unit").to_numpy()
    cuts = np.concatenate((np.flatnonzero((seeds[1:] != seeds[:-1]) | (units[1:] != units[:-1])) + 1, [len(seeds)]))
    low = 0
    for end in cuts:
        if end - low >= SHARD or end == len(seeds) or units[end] != units[end - 1]:
            part, unit = table.slice(low, end - low), int(units[low])
            at, first, last = (part.column(c).to_numpy().astype(np.int64) for c in ("at", "first", "last"))
            owners = (part.column("lo").to_numpy(), part.column("hi").to_numpy()) if unit else None
            runs = repeated(seeds[low:end], part.column("bytes").to_pylist(), at - first, at - last, lengths[unit], LETTERS[unit], owners)
            own = runs[:, 0]
            begin, stop = at[own] - runs[:, 2], at[own] - runs[:, 1] + lengths[unit]
            d1, d2 = (pa.array(part.column(c).to_numpy()[own]) for c in ("d1", "d2"))
            yield pa.RecordBatch.from_arrays([d1, d2, pa.array(np.full(len(own), unit, dtype=np.int32)), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["d1", "d2", "unit", "low", "high"])
            low = end


def _counted_windows(around: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """The same for names with too many surroundings: every window is a row, and equal ones are counted."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                unit, d1, d2, first, last, lo, hi, data = (batch.column(c)[i].as_py() for c in ("unit", "d1", "d2", "first", "last", "lo", "hi", "bytes"))
                n, size = last - first + 1, LETTERS[unit].itemsize
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[j * size : (j + lengths[unit]) * size]) for j in range(n)), dtype=np.int64).reshape(n, 2)
                values = {"unit": pa.array([unit] * n, pa.int32())} | {k: pa.array([v] * n, pa.int64()) for k, v in (("d1", d1), ("d2", d2), ("lo", lo), ("hi", hi))}
                values |= {"low": pa.array(range(first, first + n), pa.int32()), "w1": pa.array(halves[:, 0].copy()), "w2": pa.array(halves[:, 1].copy())}
                yield pa.RecordBatch.from_pydict(values)

    rows = stored(around.mapInArrow(windows, "unit int, d1 long, d2 long, lo long, hi long, low int, w1 long, w2 long"), "windows")
    counted = rows.groupBy("unit", "w1", "w2").agg(F.count("*").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    twice = stored(counted.where("n > 1 AND (unit = 0 OR least < most)").select("unit", "w1", "w2", "n"), "equal")
    high = F.col("low") + F.when(F.col("unit") == 0, lengths[0]).otherwise(lengths[1])
    return _having(rows, twice, ["unit", "w1", "w2"], "lo").select("d1", "d2", "unit", "low", high.cast("int").alias("high"))


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of ranges; ranges that touch are one run."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
    return low[new], reach[np.concatenate((new[1:] - 1, [len(low) - 1]))]


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, large: int = LARGE, passage: int = PASSAGE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256, n_shared_words, n_passages) for every row; `kept`: the bytes that remain.

    Every byte covered by a string of `length` bytes that starts anywhere else too, in the same text or another, is removed, all
    judged on the input. `n_shared_words`: words covered by runs of `passage` words that another row has too, A-Z and a-z
    alike, whatever stands between words; `n_passages`: their maximal runs; nothing is removed for them. Texts are
    UTF-8 bytes; null is empty; texts shorter than `length` stay whole; repeated rows are occurrences of their own
    (and so are removed if long enough); ids may be null or repeated; an empty table gives no rows; other columns are
    not read. A text may be as long as a row can be: it is cut into slices for hashing, and only it is in memory.
    """
    text = text_of(text_col)
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text")).select("id", *_digest(F.col("text")), "text")
    spans = repeated_spans(rows.select("d1", "d2", "text"), length, seed, large, passage)
    # `spans` holds each range once, and a text has few: its list is bounded by the text's length
    listed = stored(spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("unit", "low", "high")).alias("spans")), "listed")
    id_type = documents.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            bounds, fields = _lists(batch.column(2))
            numbers, kept = np.zeros((batch.num_rows, 5), dtype=np.int64), []
            for i, packed in enumerate(batch.column(1).to_pylist()):
                data = unpack(packed)
                numbers[i, 0] = len(data)
                own = slice(bounds[i], bounds[i + 1])
                for unit in (0, 1) if bounds[i] < bounds[i + 1] else ():
                    if (mine := fields["unit"][own] == unit).any():
                        begins, ends = _runs(fields["low"][own][mine], fields["high"][own][mine])
                        numbers[i, 1 + 2 * unit : 3 + 2 * unit] = (ends - begins).sum(), len(begins)
                        if not unit:
                            edges = [0, *np.stack([begins, ends], axis=1).ravel().tolist(), len(data)]
                            data = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(numbers[:, k]) for k in range(5)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "n_shared_words", "n_passages", "kept"])

    joined = _packed(rows).join(listed, ["d1", "d2"], "left").select("id", "packed", "spans")
    done = joined.mapInArrow(cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, n_shared_words long, n_passages long, kept binary")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words", "n_passages")
