"""Mixing sources to target weights through hash-threshold histograms (native: SQL functions only).

A row's place on the hash line decides whether the mix takes it: of each source, the rows
below one threshold. The threshold is found without sorting. Word counts are summed by
source and hash bucket, the budget is laid over the buckets, and only the one bucket that
the budget ends in is split again, ten bits at a time. A larger budget always takes a
superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.protocol import positions

from .common import checkpoint, word_count

#: Hash bits of one histogram and number of nested histograms.
BITS, LEVELS = 10, 3
#: No document is taken more often than this.
MOST_COPIES = 3
#: Sources whose plan is broadcast, at most (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def place(doc_id: Column, text: Column) -> Column:
    """A row's place on the hash line, 0 to 2^30 - 1. Equal rows share a place."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - BITS * LEVELS)


def _targets(sizes: DataFrame) -> DataFrame:
    """Sources with weights 1, 2, 3, repeating by code point (null last), and their water-filled targets.

    The level that the excess rises to is found as the rule says it: sources above their cap are closed,
    the rest is shared among the others, until none is above. Each round is one sum over the sources."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(totals, F.asc_nulls_last("source"), name="nth")
    rows = checkpoint(ranked.select("source", "source_size", (F.col("nth") % 3 + 1).alias("w"), (F.col("source_size") * MOST_COPIES).cast("double").alias("cap")))
    everything, level, closed = rows.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).head(), 0.0, -1
    if everything["w"]:
        level = everything["n"] / everything["w"]
        while True:
            full = F.col("cap") < F.col("w") * F.lit(level)
            r = rows.agg(F.count_if(full).alias("closed"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w")).head()
            if r["closed"] == closed or not r["w"]:
                break
            closed, level = r["closed"], (everything["n"] - r["cap"]) / r["w"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(float(level))).alias("target"))


def mix_plan(sizes: DataFrame) -> DataFrame:
    """Per source: ``source_size``, ``target``, whole ``copies`` of every row, and the ``threshold``
    below which a row is taken once more. ``sizes`` has source, size and place.

    A null source is one of the sources; one without words has target 0; equal places stay together; no rows
    give no plan."""
    targets = _targets(sizes)
    small = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda df: df
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = targets.withColumn("copies", whole).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = left.select("source", "source_size", "target", "copies", F.lit(0).cast("long").alias("threshold"), "left")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        cut = plan.select(F.col("source").alias("s"), F.col("threshold").alias("t"), "left")
        here = sizes.select("source", "size", F.shiftright("place", shift).alias("bucket"))
        inside = F.shiftright("bucket", BITS) == F.shiftright("t", shift + BITS)
        bucket = here.join(small(cut), F.col("source").eqNullSafe(F.col("s")) & inside)
        sums = bucket.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(upto))
        #: the first bucket that the budget does not cover whole
        ends = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "left")).alias("e"))
        ends = ends.select(F.col("source").alias("s"), F.shiftleft("e.bucket", shift).alias("at"), (F.col("e.left") - F.col("e.upto") + F.col("e.size")).alias("rest"), F.col("e.size").alias("in_it"))
        joined = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        at = F.coalesce("at", F.lit(1 << (BITS * LEVELS)).cast("long"))
        if level == LEVELS:  # the last bucket goes to the nearer side
            at = at + F.when(F.col("rest") * 2 > F.col("in_it"), 1).otherwise(0)
        plan = checkpoint(joined.select("source", "source_size", "target", "copies", at.alias("threshold"), F.coalesce("rest", F.lit(0.0)).alias("left")))
    return plan.drop("left")


def _with_plan(rows: DataFrame, plan: DataFrame, key: Column) -> DataFrame:
    """Join each row to its source's plan; a plan of bounded size is broadcast, so no row moves."""
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("source").eqNullSafe(key))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))


def taken_copies(place_: Column, copies: Column, threshold: Column) -> Column:
    """Whole copies, and one more below the threshold; never more than ``MOST_COPIES``, also for a row without
    words, whose place the threshold of a source at its cap may pass."""
    return F.least(copies + F.when(place_ < threshold, 1).otherwise(0), F.lit(MOST_COPIES))


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null text counts as no words, a null source is a source of its own (the last), equal rows
    are taken or left together, and an empty table gives no rows."""
    sizes = checkpoint(sized(docs))
    plan = mix_plan(sizes).withColumnRenamed("source", "s")
    joined = _with_plan(sizes, plan, F.col("s"))
    taken = F.col("size") * taken_copies(F.col("place"), F.col("copies"), F.col("threshold"))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with their own columns.

    Null texts count no words, a null source is a source of its own, equal rows are taken equally often, a
    document without words is taken three times at most, and an empty table gives no rows."""
    sizes = checkpoint(sized(docs).select("source", "size", "place"))
    plan = mix_plan(sizes).select(F.col("source").alias("s"), "copies", "threshold")
    # the documents' columns travel packed, so no name of theirs can clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", place(F.col("doc_id"), F.col("text")).alias("place"))
    times = taken_copies(F.col("place"), F.col("copies"), F.col("threshold")).cast("int")
    taken = _with_plan(packed, plan, F.col("s")).select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return taken.select("row.*")
