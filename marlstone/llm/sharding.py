"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups are differenced in chunks: each chunk starts with one partial partition per group
(all its bytes in one shard, the others empty) and repeatedly combines the two partial
partitions of largest spread in opposite order. Each chunk leaves one partial partition of
small spread; those of all chunks are differenced again in the same way.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, local, ship, spread_join

#: Groups in a chunk, on average, and chunks at most (the driver gets one row per chunk).
CHUNK, MOST_CHUNKS = 20_000, 65_536
#: Rows numbered by one task.
SLOT_ROWS = 500_000


def difference(parts: list[tuple[int, ...]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions (tuples of shard sums).

    Returns the sums of the combined partition and, for each input part, the shard that each
    of its places went to. Ties go by the order of the input."""
    n = len(parts[0])
    heap, children = [], []

    def push(sums, slots):
        order = sorted(range(n), key=lambda i: sums[i])
        sums, slots = [sums[i] for i in order], [slots[i] for i in order]
        heapq.heappush(heap, (sums[0] - sums[-1], len(children), sums, slots))
        children.append(None)

    #: a slot is the node that it stands for: (leaf, place), or a pair of slots
    for k, part in enumerate(parts):
        push(list(part), [(k, place) for place in range(n)])
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        push([a[i] + b[n - 1 - i] for i in range(n)], [[x[i], y[n - 1 - i]] for i in range(n)])
    _, _, sums, slots = heap[0]
    moved = [[0] * n for _ in parts]
    for shard, slot in enumerate(slots):
        todo = [slot]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                moved[node[0]][node[1]] = shard
            else:
                todo += node
    return sums, moved


def _chunk_kernel(n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "k1", "k2"], ascending=[False, True, True], ignore_index=True)
        sums, moved = difference([(int(b),) + (0,) * (n_shards - 1) for b in pdf["bytes"]])
        out = pdf[["chunk", "k1", "k2", "rows"]].assign(place=[m[0] for m in moved])
        return out.assign(sums=[sums if i == 0 else None for i in range(len(out))])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a 128-bit key of the text (null has a key of its own)."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text.isNull(), text).alias("k1"),
        F.xxhash64(F.lit(2), F.octet_length(text), text).alias("k2"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    The groups are dealt by a hash into chunks of about ``CHUNK`` groups at any size of the table; a table of
    fewer has one. Each chunk is differenced, then the chunks' partial partitions. Equal texts, and all null texts, stay in one shard; a null text has size 1. Slots count
    from 0 within a shard without gaps. An empty table gives no rows."""
    ship(docs.sparkSession)
    rows = keyed(docs)
    groups = checkpoint(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    n_groups = groups.count()
    chunks = min(MOST_CHUNKS, max(1, round(n_groups / CHUNK)))
    schema = "chunk int, k1 long, k2 long, rows long, place int, sums array<long>"
    chunked = groups.withColumn("chunk", F.pmod(F.xxhash64("k1"), F.lit(chunks)).cast("int"))
    placed = checkpoint(chunked.groupBy("chunk").applyInPandas(_chunk_kernel(n_shards), schema))
    partial = placed.where("sums is not null").select("chunk", "sums").orderBy("chunk").collect()  # one row per chunk
    moved = difference([tuple(r["sums"]) for r in partial])[1] if partial else []
    spark = docs.sparkSession
    moves = local(spark, [(r["chunk"], m) for r, m in zip(partial, moved, strict=True)], "chunk int, moved array<int>")
    homes = placed.join(F.broadcast(moves), "chunk").select("k1", "k2", "rows", F.element_at("moved", F.col("place") + 1).alias("shard"))
    total = groups.agg(F.sum("rows")).head()[0] or 0
    sharded = spread_join(rows, homes, ["k1", "k2"], "rows", total, "doc_id").select("doc_id", "size", "text_crc32", "shard")
    return numbered(sharded, n_groups)


def numbered(sharded: DataFrame, n_hint: int) -> DataFrame:
    """Add law, slot and grown_shard. Slots come from row numbers in hash buckets of a shard and the
    counts of the buckets before, so no task holds a whole shard."""
    sharded = checkpoint(sharded)
    buckets = max(8, sharded.count() // SLOT_ROWS)
    spread = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(buckets)))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    slotted = spread.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
