"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Each document gets a rate r = min(cap, exp(lambda * size)): the rates closest to 1 in relative entropy that give every
source its target tokens with no document above `cap` copies. The dual is one convex function of lambda per source;
Newton's steps, kept inside a bracket, solve it. Every step is an aggregation over (source, size) counts, which
lose nothing and are far fewer than documents. The rates are then rounded: floor(r) copies and one more
where a hash of the document lies below the fraction, with the threshold of each source shifted until the words
taken meet the target to within about one document; a copy more and a copy less, chosen among all pairs of sizes,
close what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SALTS, WORD, release, stored, text_of

#: Newton steps at most, and the relative gap at which they end.
STEPS, GAP = 60, 1e-9
#: Bins of each of the searches for a source's threshold shift.
BINS, SEARCHES = 1024, 3
#: Exchanges of copies for each source.
EXCHANGES = 2


def words_in(text: Column) -> Column:
    """Number of words: places where a word begins."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target of each source (one row each; the number of sources is that of a mix, not of rows).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; together they get all words. A target stops at `cap` times
    its source, and the rest is shared again by weight: target = min(cap * size, weight * level), where `level`
    is found from running sums over the sources ordered by the level at which they are full.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full_at", "source").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / F.sum("weight").over(after))
    # the first source, in this order, that isn't full at the level its predecessors leave sets the level
    level = level.withColumn("found", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    return level.select("source", "source_size", F.least(cap * F.col("source_size"), F.col("weight") * F.coalesce("found", "full_at")).alias("target"))


def balancing_rates(counts: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, lam (null: all rates are the cap), scale; rate of a document = least(cap, exp(lam * size / scale)).

    `counts`: source, size, n. Sources with no words need no rate and are left out.
    """
    scale = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.where("source_size > 0").join(scale, targets.source.eqNullSafe(scale.source)).select(targets.source, "source_size", "target", "scale")
    state = state.withColumns({"full": F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), "lam": F.lit(0.0), "low": F.lit(-50.0), "high": F.lit(50.0), "gap": F.lit(1.0)})
    state = stored(state, "balance")
    for _ in range(STEPS):
        s = state.alias("s")
        joined = counts.join(s, F.col("s.source").eqNullSafe(counts.source) & ~F.col("s.full")).select("s.*", "size", "n")
        c = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * c, F.lit(50.0)))
        value, slope = F.col("n") * F.col("size") * F.least(raw, F.lit(cap)), F.when(raw < cap, F.col("n") * F.col("size") * c * raw).otherwise(0.0)
        keys = ["source", "source_size", "target", "scale", "full", "lam", "low", "high"]
        step = joined.groupBy(*keys).agg(F.sum(value).alias("value"), F.sum(slope).alias("slope"))
        over = F.col("value") > F.col("target")
        step = step.withColumns({"gap": F.abs(F.col("value") - F.col("target")) / F.col("target"), "low": F.when(over, F.col("low")).otherwise(F.col("lam")), "high": F.when(over, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") + F.try_divide(F.col("target") - F.col("value"), F.col("slope"))
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        moved = F.when(F.col("gap") <= GAP, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        step = step.withColumn("lam", moved).select(state.columns)
        state = stored(step.unionByName(state.where("full")), "balance")
        if (state.where("not full").agg(F.max("gap").alias("gap")).head().gap or 0.0) <= GAP:
            break
    return state.select("source", "source_size", "target", "scale", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def mix(documents: DataFrame, id_col: str = "doc_id", cap: float = 3.0) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, copies, taken (= copies * size).

    Size: words of the text; null texts have none and are never taken. Null is a source of its own, the last. Repeated
    rows and ids, null ids too, stay rows of their own, each rounded by a draw of its own; which of the rows alike in source, id
    and size gets the larger count is left open. No document has more than `cap` copies; the same input gives the same
    mix. Other columns are not read.
    """
    docs = documents.select(F.col(id_col), F.col("source").cast("string").alias("source"), words_in(text_of()).alias("size"))
    return mix_sizes(stored(docs, "sizes"), id_col, cap)


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """`docs` with `_row` (a key) and `_number`: null for an id that its source has once, else 0, 1, ... among rows alike in source, id and size.

    Rows alike are numbered within SALTS parts, which are then put one after the other, so no group of copies is one task.
    """
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    same = ["source", id_col]
    often = keyed.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").alias("o")
    # Spark's adaptive joins split a hot id here: only the side of single ids must stay whole
    repeated = keyed.alias("k").join(often, F.expr(" AND ".join(f"k.`{c}` <=> o.`{c}`" for c in same)), "left_semi")
    part = repeated.select("_row", *same, "size", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("_part"))
    part = stored(part, "repeated")
    if part.limit(1).count() == 0:
        return keyed.withColumn("_number", F.lit(None).cast("long"))
    own = [*same, "size", "_part"]
    before = Window.partitionBy(*same, "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("f")
    within = part.withColumn("_k", F.row_number().over(Window.partitionBy(*own).orderBy("_row")) - 1).alias("w")
    numbers = within.join(offsets, F.expr(" AND ".join(f"w.`{c}` <=> f.`{c}`" for c in own))).select("w._row", (F.col("_k") + F.col("_before")).alias("_number"))
    return stored(keyed.join(numbers, "_row", "left"), "numbered")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", cap: float = 3.0) -> DataFrame:
    """`mix` for a table that already holds id, source, size."""
    docs = _numbered(docs.select(id_col, "source", "size"), id_col)
    counts = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = stored(source_targets(docs, cap), "targets")
    rates = balancing_rates(stored(counts, "counts"), targets, cap)
    t, r = targets.alias("t"), rates.alias("r")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("r.lam").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("r.lam") * F.col("size") / F.col("r.scale"), F.lit(50.0)))))
    # targets and rates hold a row per source; Spark broadcasts them while they are small
    rated = docs.join(t, docs.source.eqNullSafe(F.col("t.source")), "left").join(r, docs.source.eqNullSafe(F.col("r.source")), "left")
    rated = rated.select("_row", "_number", docs[id_col], docs.source, "size", F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"), rate.alias("rate"))
    name = F.col(id_col).cast("string")
    own = F.when(F.col("_number").isNull(), F.xxhash64(name, F.lit(3))).otherwise(F.xxhash64(name, F.lit(3), "size", "_number"))
    draw = own.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    # a document gets its extra copy where `switch`, in (-1, 1), lies below its source's shift
    rated = rated.withColumns({"base": F.floor("rate"), "switch": draw - (F.col("rate") - F.floor("rate"))})
    shifts = _shifts(rated)
    s = shifts.alias("s")
    extra = (F.col("rate") > F.floor("rate")) & (F.col("switch") < F.coalesce(F.col("s.shift"), F.lit(0.0)))
    out = rated.join(s, rated.source.eqNullSafe(F.col("s.source")), "left").withColumn("copies", (F.col("base") + F.when(extra, 1).otherwise(0)).cast("long"))
    out = stored(out.select("_row", rated[id_col].alias("id"), rated.source, "size", "source_size", "target", "rate", "copies"), "copies")
    for _ in range(EXCHANGES):
        changed = out.join(_exchanges(out, cap), "_row", "left")
        before, out = out, stored(changed.select(*out.columns[:-1], (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")), "copies")
        release(before)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _exchanges(out: DataFrame, cap: float) -> DataFrame:
    """_row, change: per source a copy to add (1) and one to leave out (-1), or one of these, that bring it nearest its target.

    Only sizes that occur take part, one row for each size, told by its key, as ids may repeat; where none helps, nothing changes. For
    each size to leave out, the nearest sizes to add are its neighbours in one order of both, so no pairs are made.
    """
    missing = out.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    missing = stored(missing.where("missing <> 0"), "missing")
    row = F.struct("id", "copies", "_row")  # rows alike but for their key are interchangeable
    sizes = out.where("size > 0").groupBy("source", "size").agg(F.min(F.when(F.col("copies") + 1 <= cap, row)).alias("more"), F.min(F.when(F.col("copies") >= 1, row)).alias("less"))
    each = stored(sizes, "sizes").alias("z").join(missing.alias("m"), F.col("z.source").eqNullSafe(F.col("m.source"))).select("m.*", "size", "more", "less")
    none = missing.select("*", F.lit(0).cast("long").alias("size"), F.lit(None).cast(dict(sizes.dtypes)["more"]).alias("more"), F.lit(None).cast(dict(sizes.dtypes)["less"]).alias("less"))
    added = each.where("more IS NOT NULL").unionByName(none).select("source", "missing", F.col("size").cast("double").alias("at"), F.struct("size", F.col("more").alias("id")).alias("add"), F.lit(None).cast(f"struct<size:bigint,id:{dict(sizes.dtypes)['less']}>").alias("drop"))
    dropped = each.where("less IS NOT NULL").unionByName(none).select("source", "missing", (F.col("size") + F.col("missing")).alias("at"), F.lit(None).cast(f"struct<size:bigint,id:{dict(sizes.dtypes)['more']}>").alias("add"), F.struct("size", F.col("less").alias("id")).alias("drop"))
    # both frames begin at the first row, so each is one pass over the sizes of a source; a frame to the last row is read anew for every row
    below, above = (F.last("add", ignorenulls=True).over(Window.partitionBy("source").orderBy(o).rangeBetween(Window.unboundedPreceding, 0)) for o in (F.asc("at"), F.desc("at")))
    near = added.unionByName(dropped).select("source", "missing", "drop", F.array(below, above).alias("both")).select("source", "missing", "drop", F.explode("both").alias("add")).where("drop IS NOT NULL AND add IS NOT NULL")
    near = near.withColumn("gap", F.abs(F.col("missing") - F.col("add.size") + F.col("drop.size"))).where(F.col("gap") < F.abs("missing"))
    best = near.groupBy("source").agg(F.min(F.struct("gap", "add", "drop")).alias("best"))
    both = best.select(F.explode(F.array(F.struct(F.col("best.add.id._row").alias("_row"), F.lit(1).cast("long").alias("change")), F.struct(F.col("best.drop.id._row").alias("_row"), F.lit(-1).cast("long").alias("change")))).alias("c"))
    return both.select("c._row", "c.change").where("_row IS NOT NULL").groupBy("_row").agg(F.sum("change").alias("change"))


def _shifts(rated: DataFrame) -> DataFrame:
    """source, shift: words of documents with `switch` below it, and of all whole copies, come nearest the target."""
    loose = F.col("rate") > F.floor("rate")
    state = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("want"))
    state = stored(state.withColumns({"low": F.lit(-1.0), "width": F.lit(2.0), "words": F.lit(0).cast("long")}), "shift")
    for _ in range(SEARCHES):
        s = state.alias("s")
        rows = rated.where(loose).join(s, rated.source.eqNullSafe(F.col("s.source"))).where((F.col("switch") >= F.col("low")) & (F.col("switch") < F.col("low") + F.col("width")))
        bins = rows.groupBy("s.source", "want", F.floor((F.col("switch") - F.col("low")) / F.col("width") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("words").over(upto))
        # the bin in which the target is crossed is searched again; those below it are taken whole
        below = F.max(F.when(F.col("upto") <= F.col("want"), F.col("upto")))
        crossed = F.min(F.when(F.col("upto") > F.col("want"), F.struct("bin", "words")))
        found = bins.groupBy("source").agg(below.alias("below"), crossed.alias("crossed")).alias("f")
        narrow = F.col("width") / BINS
        state = state.alias("s").join(found, F.col("f.source").eqNullSafe(F.col("s.source")), "left").select(
            "s.source",
            (F.col("want") - F.coalesce("below", F.lit(0))).alias("want"),
            F.when(F.col("crossed").isNull(), F.col("low") + F.col("width")).otherwise(F.col("low") + narrow * F.col("crossed.bin")).alias("low"),
            F.when(F.col("crossed").isNull(), F.lit(0.0)).otherwise(narrow).alias("width"),
            F.coalesce("crossed.words", F.lit(0)).cast("long").alias("words"),
        )
        state = stored(state, "shift")
    return state.select("source", F.when(F.col("words") < 2 * F.col("want"), F.col("low") + F.col("width")).otherwise(F.col("low")).alias("shift"))
