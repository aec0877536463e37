"""N-gram Jaccard join with adaptive multi-match prefixes.

1. `profiles` reads every text once: its shingle set's size, a 128-bit key of the set (equal sets are one node from
   here on), a parity bitmap, and counts of all shingles in a sketch of fixed size.
2. Shingles are ordered by frequency class (rare first, by the sketch), then hash. With overlap o = ceil(t n), a set's prefix
   has n - o + l shingles, and two sets that link share min(l, l') of them. A set takes a larger l where its prefix holds
   frequent shingles, which would cost many candidates.
3. Within each prefix shingle every node is first compared with two hubs: that of the group and, as large groups are cut
   into salted groups, that of its salted group. A hub is the node whose shingles are the most frequent, in a group of near copies the
   text that the others were made from. That is linear in a group's size and joins most copies to components. Then pairs of different
   components in a group, and only those, are counted, and those that share enough prefix shingles are verified. Links
   within a component change nothing, so none is needed.
4. Candidates are cut by size and by the bitmaps (their Hamming distance is at most the symmetric difference: no link is
   lost) and then verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import release, salted_join, stored
from tidemark.llm.components import connected
from tidemark.llm.shingles import mixed, shingle_sets

#: Counters of the frequency sketch (a power of two), and the parts it is sent in.
COUNTERS, PARTS = 1 << 23, 64
#: Least bits of the parity bitmap, which has a bit for each shingle, rounded up to a power of two; the largest l.
BITMAP, MOST = 512, 8
#: Longs of the folded bitmap that prefix rows carry.
FOLD = 4
NODE = "node binary"


def _key(found: np.ndarray) -> bytes:
    """A key of a set: two sums over its elements."""
    salted = np.uint64(0x5851F42D4C957F2D)
    return np.array([mixed(found).sum(dtype=np.uint64), mixed(found + salted).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def _parity(found: np.ndarray) -> list[int]:
    width = max(BITMAP, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _folded(bitmap: list[int]) -> list[int]:
    """The bitmap folded to FOLD longs; its distances are at most those of the bitmap."""
    return np.bitwise_xor.reduce(np.array(bitmap, dtype=np.int64).reshape(-1, FOLD), axis=0).tolist()


def profiles(documents: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (id, n, node, bitmap) and of sketches (part, counts), told apart by `part`; the key of an empty set is null."""
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n long, node binary, bitmap array<long>, folded array<long>, part int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint32)
        target = None
        for batch in batches:
            ids = batch.column(0)
            n, nodes, bitmaps, all_found, held = [], [], [], [], 0
            for found in shingle_sets(batch.column(1).to_pylist(), k):
                n.append(len(found))
                nodes.append(_key(found) if len(found) else None)
                bitmaps.append(_parity(found) if len(found) else None)
                all_found.append(found)
                held += len(found)
                if held > COUNTERS // 16:
                    _count(counts, all_found)
                    all_found, held = [], 0
            _count(counts, all_found)
            target = pa.schema([("id", ids.type), ("n", pa.int64()), ("node", pa.binary()), ("bitmap", pa.list_(pa.int64())), ("folded", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
            rows = len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bitmaps, pa.list_(pa.int64())), pa.array([b and _folded(b) for b in bitmaps], pa.list_(pa.int64())), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=target)
        if target is not None:
            pack = zstandard.ZstdCompressor(level=1).compress
            blobs = [pack(part.tobytes()) for part in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, target.field(0).type), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.list_(pa.int64())), pa.nulls(PARTS, pa.list_(pa.int64())), pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], schema=target)

    return documents.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _count(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds the shingles of sets to the counters; only counters that occur are touched, so no second array of counters is made."""
    if sets:
        at, n = np.unique((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.uint32), return_counts=True)
        counts[at] += n.astype(np.uint32)


def sketch_classes(profile: DataFrame) -> bytes:
    """The frequency class of each counter, one byte each: 0 for what chance puts into a counter, then one more for each doubling.

    Always COUNTERS bytes, whatever the input's size, and all that the driver sees of the sketch. A counter holds the sum of its
    shingles' frequencies, so no shingle is thought rarer than it is beyond the mean count of a counter.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = unpack(blob)
                counts = np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 * COUNTERS // PARTS else np.uint64).astype(np.uint64)
                sums[part] = sums[part] + counts if part in sums else counts
        pack = zstandard.ZstdCompressor(level=1).compress
        columns = [pa.array(list(sums), pa.int32()), pa.array([pack(v.tobytes()) for v in sums.values()], pa.binary()), pa.array([int(v.sum()) for v in sums.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "counts", "total"])

    kinds = "part int, counts binary, total long"
    blobs = profile.where("part IS NOT NULL").select("part", "counts")
    summed = stored(blobs.mapInArrow(added, kinds).select("part", "counts").repartition(PARTS, "part").mapInArrow(added, kinds), "sketch")
    mean = (summed.agg(F.sum("total").alias("total")).head().total or 0) / COUNTERS
    usual = mean + 3 * mean**0.5 + 4

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found = []
            for blob in batch.column(1).to_pylist():
                counts = np.frombuffer(unpack(blob), dtype=np.uint64).astype(float)
                found.append(np.where(counts < usual, 0, np.clip(1 + np.floor(np.log2(np.maximum(counts / usual, 1))), 1, 60)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["part", "classes"])

    classes = bytearray(COUNTERS)
    for row in summed.select("part", "counts").mapInArrow(classed, "part int, classes binary").collect():
        low = row.part * (COUNTERS // PARTS)
        classes[low : low + COUNTERS // PARTS] = row.classes
    release(summed)
    return bytes(classes)


def prefix_rows(documents: DataFrame, k: int, tenths: int, classes: bytes, text_col: str = "text") -> DataFrame:
    """token, salt, frequent, node, n, l, at, far: the prefix shingles of every set and their places, once for each set and task.

    `far` is least for sets whose shingles are frequent throughout: in a group of near copies, the one the others were made from.
    """
    schema = "token long, salt int, frequent int, node binary, n int, l int, at int, far int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes, dtype=np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            tokens, salts, frequents, nodes, sizes, ls, counts, fars = [], [], [], [], [], [], [], []
            held = 0
            for found in shingle_sets(batch.column(0).to_pylist(), k):
                n = len(found)
                if not n or (node := _key(found)) in seen:
                    continue
                seen.add(node)
                of = table[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort(of, kind="stable")
                shortest = n - (tenths * n + 9) // 10 + 1
                l = int(min(MOST, 1 + np.count_nonzero(of[order[:shortest]]), n - shortest + 1))
                chosen = order[: shortest + l - 1]
                tokens.append(found[chosen])
                frequents.append(of[chosen])
                salts.append(np.where(of[chosen] > 0, int.from_bytes(node[:4], "little") & ((1 << np.minimum(of[chosen].astype(np.int64), 20)) - 1), 0))
                nodes.append(node)
                sizes.append(n)
                ls.append(l)
                counts.append(len(chosen))
                fars.append(60_000 - int(1000 * of.mean()))
                held += len(chosen)
                if held > 200_000:
                    yield _prefix_batch(tokens, salts, frequents, nodes, sizes, ls, counts, fars)
                    tokens, salts, frequents, nodes, sizes, ls, counts, fars, held = [], [], [], [], [], [], [], [], 0
            if held:
                yield _prefix_batch(tokens, salts, frequents, nodes, sizes, ls, counts, fars)

    return documents.select(F.col(text_col).cast("string")).mapInArrow(run, schema)


def _prefix_batch(tokens, salts, frequents, nodes, sizes, ls, counts, fars) -> pa.RecordBatch:
    times = np.repeat(np.arange(len(nodes)), counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(tokens).view(np.int64)),
            pa.array(np.concatenate(salts).astype(np.int32)),
            pa.array(np.concatenate(frequents).astype(np.int32)),
            pa.array(nodes, pa.binary()).take(pa.array(times)),
            pa.array(np.array(sizes, dtype=np.int32)[times]),
            pa.array(np.array(ls, dtype=np.int32)[times]),
            pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])),
            pa.array(np.array(fars, dtype=np.int32)[times]),
        ],
        names=["token", "salt", "frequent", "node", "n", "l", "at", "far"],
    )


def _apart(x: Column, y: Column) -> Column:
    """Hamming distance of two bitmaps. The wider of two is folded once: sizes that may link need no more."""
    half = lambda v: F.floor(F.size(v) / 2).cast("int")
    both = lambda p, q: F.zip_with(p, q, lambda a, b: a.bitwiseXOR(b))
    folded = lambda v, other: F.when(F.size(v) > F.size(other), both(F.slice(v, F.lit(1), half(v)), F.slice(v, half(v) + 1, half(v)))).otherwise(v)
    return F.aggregate(both(folded(x, y), folded(y, x)), F.lit(0), lambda total, v: total + F.bit_count(v))


def _verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, k: int, tenths: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets link; sets are made again from the texts of the pairs' documents only."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep").alias("id"))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id").select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1).to_pylist(), k))
            # a repeated id may bring texts of other sets
            own = [i for i, (node, s) in enumerate(zip(batch.column(0).to_pylist(), found)) if len(s) and _key(s) == node]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array([found[i].tobytes() for i in own], pa.binary())], names=["node", "shingles"])

    made = texts.mapInArrow(sets, "node binary, shingles binary").dropDuplicates(["node"])
    made = stored(made, "sets")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(10 * common >= tenths * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    left, right = made.select(F.col("node").alias("a"), F.col("shingles").alias("left")), made.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    result = stored(joined.mapInArrow(linked, "a binary, b binary"), "edges")
    release(made)
    release(pairs)
    return result


def jaccard_components(documents: DataFrame, k: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id reachable over links of Jaccard similarity >= tenths / 10.

    Shingles are k words, lower-cased in A-Z; a text of fewer words is one shingle. Texts without words and null
    texts have no shingles and link with nothing; each is its own component. Equal texts are linked. Repeated ids stay
    rows of their own. A row with a null id has the smallest id of its component; texts of which no row has an id are
    linked with equal texts only, and their component is null. An empty table gives no rows; other columns are not read.
    """
    profile = stored(profiles(documents, k, id_col, text_col), "profiles")
    rows = profile.where("part IS NULL").select("id", "n", "node", "bitmap", "folded")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("folded").alias("folded")), "nodes")
    classes = sketch_classes(profile)
    own = Window.partitionBy("token", "salt").orderBy("far", "node")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prefix = prefix_rows(documents, k, tenths, classes, text_col)
    prefix = prefix.select("*", F.first("node").over(own).alias("hub"), F.first("far").over(own).alias("hub_far"), F.last("node").over(whole).alias("last"), F.lag("node").over(own).alias("before"))
    # one row a node and shingle (texts of several tasks have several); shingles of one node only are done
    prefix = prefix.where((F.col("before").isNull() | (F.col("before") != F.col("node"))) & ((F.col("hub") != F.col("last")) | (F.col("frequent") > 0)))
    shared = stored(prefix.select("token", "frequent", "node", "n", "l", "at", "hub", "hub_far"), "shared")

    top = shared.where("frequent > 0").groupBy("token").agg(F.min_by("hub", F.struct("hub_far", "hub")).alias("top"))
    stars = shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(shared.where("frequent > 0").join(top, "token").select(F.col("top").alias("a"), F.col("node").alias("b")))
    stars = stars.where("a <> b").distinct()
    near = _near(stars, nodes, tenths)
    # the two likeliest hubs of each node; what they leave apart is compared below
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))).where("k <= 2").select("a", "b")
    edges = _verified(best, nodes, documents, k, tenths, id_col, text_col)
    labels = connected(edges)

    folds = [f"f{i}" for i in range(FOLD)]
    marks = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("part"), *(F.col("folded")[i].alias(f) for i, f in enumerate(folds)))
    placed = shared.join(marks, "node").select("token", "node", "n", "l", "at", "part", *folds)
    apart = placed.groupBy("token").agg(F.min("part").alias("main"), F.max("part").alias("other")).where("main <> other").select("token", "main")
    placed = stored(placed.join(apart, "token"), "placed")
    x, y = placed.where("part <> main").alias("x"), placed.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part"))
    once = (F.col("y.part") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    sizes = F.lit(10) * F.least("x.n", "y.n") >= tenths * F.greatest("x.n", "y.n")
    # a pair's own prefixes: n - o + l shingles with o = ceil(t (n + m) / (1 + t)), shorter than any partner needs
    both = F.col("x.n") + F.col("y.n")
    overlap = F.floor((both * tenths + (9 + tenths)) / (10 + tenths))
    early = (F.col("x.at") < F.col("x.n") - overlap + F.least("x.l", "y.l")) & (F.col("y.at") < F.col("y.n") - overlap + F.least("x.l", "y.l"))
    differ = sum((F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))) for f in folds), F.lit(0))
    alike = (10 + tenths) * differ <= (10 - tenths) * both
    pairs = x.join(y, same & once & sizes & early & alike).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.l", "y.l").alias("least"))
    counted = pairs.groupBy("a", "b", "least").agg(F.count("*").alias("matches")).where("matches >= least")
    rest = stored(_near(counted.select("a", "b"), nodes, tenths), "rest")
    # the likeliest partners of each node first; most of the others are of one component then
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("apart", "a", "b"))
    edges = edges.unionByName(_verified(rest.withColumns({"i": rank("a"), "j": rank("b")}).where("i <= 2 OR j <= 2").select("a", "b"), nodes, documents, k, tenths, id_col, text_col))
    labels = connected(edges)
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab"]
    left = rest.join(ends[0], "a", "left").join(ends[1], "b", "left").where("NOT of_a <=> of_b OR of_a IS NULL").select("a", "b")
    more = _verified(left, nodes, documents, k, tenths, id_col, text_col)
    labels = connected(edges.unionByName(more))

    smallest = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = smallest.join(smallest.groupBy("label").agg(F.min("rep").alias("component")), "label").select("node", "component")
    # copies of one text are one key, as many as they are
    out = salted_join(rows.select("id", "n", "node"), stored(smallest, "smallest"), ["node"], F.xxhash64("id"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _near(pairs: DataFrame, nodes: DataFrame, tenths: int) -> DataFrame:
    """pairs (a, b) that sizes and bitmaps allow, with `apart`, the bitmaps' distance: |x ^ y| <= (n + m)(1 - t) / (1 + t)."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("bits_b"))
    sizes = F.lit(10) * F.least("n_a", "n_b") >= tenths * F.greatest("n_a", "n_b")
    joined = pairs.join(left, "a").join(right, "b").where(sizes).withColumn("apart", _apart(F.col("bits_a"), F.col("bits_b")))
    return joined.where((10 + tenths) * F.col("apart") <= (10 - tenths) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "apart")
