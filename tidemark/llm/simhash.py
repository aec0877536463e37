"""Document fingerprints: SimHash over weighted terms, and permuted block tables for the search; native expressions only.

A term is a pair of neighbouring words (the word itself in a text of one word); its weight is the number of times it
occurs. Each occurrence votes on 128 bits. Votes of two bits share one long (32 bits each, enough for
2^31 terms of a text), so 64 sums hold all; they are summed where the text is and only then shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, salted_join, stored, text_of

LANES = 0x0000000100000001
#: Rows that share a bucket of the order, about.
BUCKET = 1024


def terms(text: Column) -> Column:
    """Array of 64-bit hashes, one for each occurrence of a term."""
    words = F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))
    # a one-element array binds `words`, so that the text is split once
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(w)))


def fingerprints(rows: DataFrame, text_terms: str, keys: list[str]) -> DataFrame:
    """`keys` with `fp`, a fingerprint as array of two longs. `keys` must name a row; rows without terms get zeros."""
    long = rows.select(*keys, F.explode_outer(text_terms).alias("term"))
    words = {"a": F.col("term"), "b": F.xxhash64("term", F.lit(1))}
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(LANES))).alias(f"{k}{i}") for k, h in words.items() for i in range(32)]
    votes = long.groupBy(*keys).agg(F.count("term").alias("n"), *sums)
    wins = lambda c: ((F.coalesce(c, F.lit(0)) * 2 > F.col("n")) & (F.col("n") > 0)).cast("long")
    bits = lambda k: [F.shiftleft(wins(F.col(f"{k}{i}").bitwiseAND(F.lit(0xFFFFFFFF))), i) for i in range(32)] + [F.shiftleft(wins(F.shiftrightunsigned(f"{k}{i}", 32)), 32 + i) for i in range(32)]
    joined = lambda parts: F.aggregate(F.array(*parts), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    return votes.select(*keys, F.array(joined(bits("a")), joined(bits("b"))).alias("fp"))


def distance(x: Column, y: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(x[0].bitwiseXOR(y[0])) + F.bit_count(x[1].bitwiseXOR(y[1]))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - distance(x, y) / F.lit(128.0)


def as_hex(fp: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fp[0]), 16, "0"), F.lpad(F.hex(fp[1]), 16, "0")))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs (left, right) of distinct fingerprints `fp` at most `radius` bits apart, left < right, with `bits`.

    The 128 bits are cut into `blocks` > `radius` blocks. Two fingerprints within the radius agree on some
    `blocks - radius` of them, so there is a table for each such choice, keyed by these blocks; equal keys are
    compared in full. Equal fingerprints are one row here, so groups of copies make no pairs.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    distinct = prints.select("fp").where(F.col("fp").isNotNull()).distinct()
    bits = F.concat(*(F.lpad(F.bin(F.col("fp")[i]), 64, "0") for i in range(2)))
    edges = [128 * i // blocks for i in range(blocks + 1)]
    block = [F.substring(bits, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    tables = [F.xxhash64(F.lit(k), *(block[i] for i in chosen)) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("key"))
    left, right = keyed.select("key", F.col("fp").alias("left")), keyed.select("key", F.col("fp").alias("right"))
    found = left.join(right, "key").where(F.col("left") < F.col("right")).withColumn("bits", distance(F.col("left"), F.col("right")))
    return found.where(F.col("bits") <= radius).select("left", "right", "bits").distinct()


def following(keys: DataFrame, bound: int) -> DataFrame:
    """`k` with `next`, the next larger key of a table of distinct longs below `bound`; null after the last.

    Keys are grouped by their upper part, level by level, so that no window holds more than about BUCKET * 4 rows.
    """
    if bound <= 4 * BUCKET:
        return keys.select("k", F.lead("k").over(Window.orderBy("k")).alias("next"))
    upper = keys.withColumn("upper", F.col("k").bitwiseAND(F.lit(-BUCKET)) / BUCKET).withColumn("upper", F.col("upper").cast("long"))
    heads = upper.groupBy("upper").agg(F.min("k").alias("head"))
    above = following(heads.select(F.col("upper").alias("k")), bound // BUCKET + 1).withColumnRenamed("next", "above")
    heads = heads.withColumnRenamed("upper", "above")
    joined = upper.withColumn("own", F.lead("k").over(Window.partitionBy("upper").orderBy("k"))).join(above.withColumnRenamed("k", "upper"), "upper", "left").join(heads, "above", "left")
    return joined.select("k", F.coalesce("own", "head").alias("next"))


def with_next_text(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """bucket, row (both together name a row), id, text, next_text, next_bucket, next_row: each row and its successor.

    The order is by id (null last), then text; after the last row comes the first. The order is cut into buckets by the
    id's value, about BUCKET rows each if the ids are spread evenly; unevenly spread ids make uneven
    buckets, which Spark's window spills. Only heads of buckets cross between them. Rows are shuffled once.
    """
    span = documents.agg(F.min(id_col).cast("long").alias("low"), F.max(id_col).cast("long").alias("high"), F.count("*").alias("n")).head()
    low, high = span.low or 0, span.high or 0
    width = max(1, (high - low + 1) * BUCKET // max(span.n, 1))
    last = (high - low) // width + 1
    bucket = F.coalesce(F.floor((F.col(id_col).cast("long") - low) / F.lit(width)), F.lit(last)).cast("long")
    rows = documents.select(F.col(id_col).alias("id"), text_of().alias("text"), bucket.alias("bucket"))
    order = Window.partitionBy("bucket").orderBy(F.col("id").asc_nulls_last(), "text")
    ranked = rows.select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("own_next"), F.lead(F.lit(True)).over(order).alias("has_next"))
    heads = ranked.where("row = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head"))
    buckets = rows.select(F.col("bucket").alias("k")).distinct()
    order_of = following(buckets, last + 1)
    first = F.lit(0 if span.low is not None else last).cast("long")  # the smallest id's bucket, or that of null ids alone
    order_of = order_of.select(F.col("k").alias("bucket"), F.coalesce(F.col("next"), first).alias("next_bucket"))
    ends = order_of.join(heads, "next_bucket").select("bucket", "next_bucket", "head")
    joined = ranked.join(ends, "bucket")
    inner = F.col("has_next").isNotNull()
    return joined.select(
        "bucket", "row", "id", "text",
        F.when(inner, F.col("own_next")).otherwise(F.col("head")).alias("next_text"),
        F.when(inner, F.col("bucket")).otherwise(F.col("next_bucket")).alias("next_bucket"),
        F.when(inner, F.col("row") + 1).otherwise(F.lit(1)).alias("next_row"),
    )


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses; one row per document.

    The edited text has its last half (rounded down, in code points) replaced by as many code points, or all, of the
    next document's beginning. Null texts are empty; texts without words have a fingerprint of zeros;
    repeated rows and ids are rows of their own; an empty table gives no rows; other columns are not read.
    `n_near`: other distinct fingerprints within `radius` bits.
    """
    rows = with_next_text(documents, id_col)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)"))
    rows = rows.select("bucket", "row", "id", "next_bucket", "next_row", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "row", "id", "next_bucket", "next_row", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    both = both.select(*keys, F.col("v.which").alias("which"), terms(F.col("v.t")).alias("terms"))
    prints = stored(fingerprints(both, "terms", [*keys, "which"]), "prints")
    own, after = prints.where("which = 0"), prints.where("which = 1").select("bucket", "row", F.col("fp").alias("edited_fp"))
    nexts = own.select(F.col("bucket").alias("next_bucket"), F.col("row").alias("next_row"), F.col("fp").alias("next_fp"))
    pairs = near_pairs(own, radius)
    near = stored(pairs.select(F.explode(F.array("left", "right")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_near")), "near")
    # copies and empty texts share a fingerprint: such keys are salted
    own = salted_join(own, near, ["fp"], F.col("bucket") + F.col("row"), "left")
    joined = own.join(after, ["bucket", "row"]).join(nexts, ["next_bucket", "next_row"])
    return joined.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
