"""Shared pieces: table access, checkpoints, word splitting, packed exchanges."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marlstone import ship
from marlstone.storage import checkpoint, shared_dir  # noqa: F401  (for the modules beside)

#: Words are separated by these ASCII characters and by nothing else; bytes.split() uses the same set.
WHITESPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is scanned; one that would leave half of the cores idle is dealt to all of them."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


#: A key that more than one in so many rows has is hot; fewer keys than that can be hot at once.
HOT = 1000


def arrow(df: DataFrame, kernel, schema: str) -> DataFrame:
    """``mapInArrow`` on workers that have this package, wherever the frame comes from. A task gives its memory
    back at its end."""
    ship(df.sparkSession)

    def run(batches):
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(run, schema)


#: Bytes of a batch that a kernel takes up at once, about.
PORTION = 4 << 20


def portions(batches):
    """The same rows in batches of about ``PORTION`` bytes: a kernel's copies of long texts, and the buffers that the
    JVM takes for what comes back, do not grow with a batch, of which Spark bounds the rows only."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, n * PORTION // max(batch.nbytes, PORTION))
        for a in range(0, max(n, 1), step):
            yield batch.slice(a, step)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The driver's rows as a table. They go as Arrow; a plain list would be passed through Python workers of the
    executors, in a second set that stays there."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind), schema)


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], n: str, total: int, spread: str) -> DataFrame:
    """``rows`` left-joined to ``side``, which has one row for each key and the number ``n`` of rows that
    have it; ``total`` is the sum of ``n``.

    The side's rows of hot keys, fewer than ``HOT`` by that definition, are broadcast; the rows that they
    match are dealt by a hash of ``spread`` through the shuffle that serves all other keys, so that no task
    gets all rows of one key."""
    values = [c for c in side.columns if c not in (*on, n)]
    packed = side.select(*on, F.col(n).alias("__n"), F.struct(*values).alias("__side"))
    is_hot = F.col("__n") > max(1.0, total / HOT)
    hot = packed.where(is_hot).select(*on, F.col("__side").alias("__hot"))
    cold = packed.where(~is_hot).select(*on, F.lit(0).alias("__salt"), F.col("__side").alias("__cold"))
    flagged = rows.join(F.broadcast(hot), on, "left")
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 16)))
    both = flagged.withColumn("__salt", salt.cast("int")).join(cold, [*on, "__salt"], "left")
    found = F.coalesce("__hot", "__cold")
    return both.select(*rows.columns, *(found[v].alias(v) for v in values))


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reaches."""
    store, where = _at(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in any store that Spark reaches."""
    store, where = _at(spark, path)
    store.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    parts = F.split(text, WHITESPACE, -1)
    n = F.size(parts)
    blank_start = (F.element_at(parts, 1) == "").cast("long")
    blank_end = ((F.element_at(parts, -1) == "") & (n > 1)).cast("long")
    return F.coalesce(n.cast("long") - blank_start - blank_end, F.lit(0).cast("long"))


def _binary(column: pa.Array) -> pa.Array:
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def column_bytes(column: pa.Array) -> list:
    """Bytes of each row of a string or binary column; None for null."""
    return _binary(column).to_pylist()


def each_bytes(column: pa.Array):
    """The same, one at a time: long texts are not copied all at once."""
    return (x.as_py() for x in _binary(column))


def give_back() -> None:
    """Return freed memory to the system; Python workers live on between tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, filled on demand and emptied when it grows past ``most``."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_S = [np.uint64(k) for k in (30, 27, 31)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _S[0])) * _MIX2
    h = (h ^ (h >> _S[1])) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> _S[2])


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, seed, np.uint64)
        for j in range(k):
            out = out * _MIX + h[j : j + n]
            out ^= out >> _S[1]
        return mix(out)


def blobs(arrays: list) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
