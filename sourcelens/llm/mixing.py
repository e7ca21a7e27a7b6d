"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k's point is k times the golden ratio modulo 1, in 30-bit fixed point; it falls into one source's interval of the
cumulative target weights. Slots are ranked per source, and a source's r-th slot takes its r-th block: the source's
documents, in a shuffled order that only depends on identifiers and a seed, laid end to end and cut into blocks of
equal tokens. Ranks beyond the last block begin a second pass, so a document is taken at most twice. A block has at most
a fixed share of its source's own size and target, and sources with smaller blocks get as many more slots; so each
source's error is a small share of its target, however large the others are.

Ranks and positions are prefix sums in two levels: inside buckets of a few thousand rows, and over the buckets. No
source is sorted in one task, however large. The only tables that are not dealt by such a bucket have a row for each
source and bucket. Everything is DataFrame functions, and reruns give the same rows.

Sources are ordered by code point, null last as a source of its own. Null and empty texts have no tokens and are never
taken. Rows that repeat an identifier are documents of their own. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, written

WEIGHTS = (3, 1, 2)
EPOCHS = 2
#: The golden ratio's fraction in 30 bits; odd, so 2**30 slots visit every point once.
POINTS, STEP = 1 << 30, 663608941
#: Blocks in the whole corpus, as the size of a block is chosen, and its least and most tokens; a source has at least OWN_BLOCKS of them, smaller ones if need be.
BLOCKS, LEAST, MOST, OWN_BLOCKS = 65536, 16, 65536, 256
BUCKET_ROWS, CELLS = 1024, 1024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shares(sizes: DataFrame, amount: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size) -> also weight, target and cum, the targets before this one.

    min(most * size, level * weight), with the level at which the targets add up to amount times all sizes: in the
    order of size / weight the sources before some rank are at their limit, and level is what is left over by weight.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    cap = F.col("source_size") * most
    ranked = sizes.withColumn("i", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") - 1) % n + 1).cast("bigint"))
    filling = Window.orderBy(cap / F.col("weight"), "i")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    ratio = cap / F.col("weight")
    full = (
        ranked.withColumn("left_over", total * F.lit(amount) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_over") / F.col("heavy"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(ratio.alias("ratio"), "i", "level"))).over(every)["level"])
    )
    target = F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("level") * F.col("weight")))
    return full.withColumn("target", target).select("i", "source", "source_size", "weight", "target", F.coalesce(F.sum(target).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cum"), F.sum(target).over(every).alias("total"))


def scheduled(sources: DataFrame, size: int) -> DataFrame:
    """sources with their own block_size, at most size, and need: the target by as much more as its blocks are smaller."""
    by_i = Window.orderBy("i")
    own = F.floor(F.least(F.col("source_size").cast("double"), F.col("target")) / OWN_BLOCKS)
    out = sources.withColumn("block_size", F.greatest(F.lit(1), F.least(F.lit(size), own)).cast("bigint"))
    out = out.withColumn("need", F.col("target") * (F.lit(float(size)) / F.col("block_size")))
    out = out.withColumn("needs", F.coalesce(F.sum("need").over(by_i.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return written(out.withColumn("all_needs", F.sum("need").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def plan(docs: DataFrame, amount: float = 1.5, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, DataFrame]:
    """documents (a row each, key i, bucket, ordinal), sources, and takes: slot, epoch, block and a document's words in it."""
    spark = docs.sparkSession
    own = columns(docs, id=id_col, text=text_col, source=source_col)
    mark = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 15), 16, 10)
    own = written(own.select("id", "source", n_words(F.col("text")).alias("size"), mark.cast("bigint").alias("h")))
    sizes = written(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    sources = written(shares(sizes.select("source", "source_size"), amount, weights))
    words, rows = (int(x or 0) for x in sizes.agg(F.sum("source_size"), F.sum("docs")).first())
    size = max(LEAST, min(MOST, words // blocks))
    sources = scheduled(sources, size)
    more = sources.agg(F.sum(F.col("need") - F.col("target"))).first()[0] or 0
    slots = -(-int(amount * words + more) // size)

    # Places: buckets are ranges of the hash, so the order over buckets and inside them is the hash's order.
    buckets = max(1, rows // BUCKET_ROWS)
    placed = own.join(sources.select("i", "block_size", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("bucket", F.shiftright(F.shiftright("h", 28) * F.lit(buckets), 32))
    heads = placed.groupBy("i", "bucket").agg(F.sum("size").alias("in_bucket"))
    heads = heads.withColumn("head", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("i", "bucket").orderBy("h", "id", "size")
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("ordinal", F.row_number().over(inside))
    placed = placed.join(heads.select("i", "bucket", "head"), ["i", "bucket"]).withColumn("place", F.col("head") + F.col("inside"))
    placed = written(placed.select("id", "source", "i", "size", "block_size", "bucket", "ordinal", "place"))

    # Slots: points, the source whose interval holds the point, and the rank among the source's slots.
    point = (F.col("slot") % POINTS) * F.lit(STEP) % POINTS
    lo, hi = (F.round(F.try_divide(x, F.col("all_needs")) * F.lit(POINTS)).cast("bigint") for x in (F.col("needs"), F.col("needs") + F.col("need")))
    wide = sources.select("i", "source_size", "block_size", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    cell = POINTS // CELLS
    wide = wide.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    schedule = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / (16 * BUCKET_ROWS)).alias("run")).withColumn("point", point)
    schedule = schedule.withColumn("cell", F.floor(F.col("point") / cell)).join(wide, "cell").where("lo <= point and point < hi")
    counts = schedule.groupBy("i", "run").agg(F.count("*").alias("n"))
    counts = counts.withColumn("head", F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = schedule.withColumn("r", F.row_number().over(Window.partitionBy("i", "run").orderBy("slot")) - 1)
    ranked = ranked.join(counts.select("i", "run", "head"), ["i", "run"]).withColumn("rank", F.col("head") + F.col("r"))
    per_source = F.ceil(F.col("source_size") / F.col("block_size"))
    ranked = ranked.select("slot", "i", F.floor(F.col("rank") / per_source).alias("epoch"), (F.col("rank") % per_source).alias("block")).where(F.col("epoch") < EPOCHS)

    # Blocks: each document's words in each block that it reaches into.
    first, last = F.floor(F.col("place") / F.col("block_size")), F.floor((F.col("place") + F.col("size") - 1) / F.col("block_size"))
    reach = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("place"), F.col("block") * F.col("block_size"))
    until = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * F.col("block_size"))
    reach = reach.select("i", "block", "id", "bucket", "ordinal", (begin - F.col("place")).alias("start"), (until - begin).alias("words"))
    return {"documents": placed, "sources": sources, "takes": ranked.join(reach, ["i", "block"])}


def mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """A row per document: id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    parts = plan(docs, id_col=id_col, **how)
    taken = parts["takes"].groupBy("i", "bucket", "ordinal").agg(F.sum("words").alias("taken"))
    sources = parts["sources"].select("i", "source_size", "target")
    out = parts["documents"].join(taken, ["i", "bucket", "ordinal"], "left").join(sources, "i")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
