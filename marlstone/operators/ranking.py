"""Deterministic rankings and top-k, cosine search in blocks, and rules for choosing one row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of a search, queries in a block, and scores that a task holds at once.
BLOCK, QUERY_BLOCK, SCORES = 16_384, 4096, 1 << 22


def rank_scores(scored: DataFrame, by: list[str], k: int | None = None, score: str = "score", item: str = "track_id", ties: Column | None = None) -> DataFrame:
    """Adds rank: score descending, then id in code-point order (or ``ties``). Cut to ``k`` if given."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), ties if ties is not None else F.asc(item))
    ranked = scored.withColumn("rank", F.row_number().over(window))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of each group, the first in the given order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Strict unit vector: a zero norm is an error."""
    n = norm(v)
    return F.when(n == 0, F.raise_error(F.lit("zero vector")).cast("array<double>")).otherwise(F.transform(v, lambda x: x / n))


def safe_unit(v: Column, least: float = 1e-8) -> Column:
    """The vector itself where its norm is below ``least``."""
    n = norm(v)
    return F.when(n < least, v).otherwise(F.transform(v, lambda x: x / n))


def _pack(batches):
    """The vectors of each block as one row: ids, groups and a matrix of unit rows."""
    held: dict[int, list] = {}
    for batch in batches:
        for block, name, group, vec in zip(*(batch.column(c).to_pylist() for c in ("block", "track_id", "grp")), batch.column("vec"), strict=True):
            held.setdefault(block, []).append((name, group, np.asarray(vec.values.to_numpy(zero_copy_only=False), np.float64)))
    for block, rows in held.items():
        matrix = np.array([r[2] for r in rows])
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(pa.string())), pa.array([[r[1] for r in rows]], pa.list_(pa.string())), pa.array([matrix.tobytes()], pa.binary())], names=["block", "ids", "grps", "matrix"])


def _best(k: int, ids: list, grps: list, queries: np.ndarray, names: list, own_grps: list, matrix: np.ndarray, tie: Callable):
    """(query, name, score) of the best k names of one block for each query of another; nothing scores itself or,
    where groups are given, anything of its own group."""
    order = np.array(sorted(range(len(names)), key=lambda i: tie(names[i])), np.int64)
    names, matrix = [names[i] for i in order], matrix[order]
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    same = [(q, i) for q, name in enumerate(ids) for i in places.get(name, ())]
    code = {g: i for i, g in enumerate(dict.fromkeys([*grps, *own_grps]))} if grps[0] is not None else None
    at_q, at_v = (np.array([code[g] for g in x]) for x in (grps, [own_grps[i] for i in order])) if code else (None, None)
    step = max(1, SCORES // len(ids))
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(names), step):
        scores = np.round(queries @ matrix[a : a + step].T, 9)
        if code:
            scores[at_q[:, None] == at_v[None, a : a + step]] = -np.inf
        for q, i in same:
            if a <= i < a + step:
                scores[q, i - a] = -np.inf
        least = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
        q, i = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        kept.append((q, i + a, scores[q, i]))
    q, i, score = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((i, -score, q))
    q, i, score = q[order], i[order], score[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return [ids[x] for x in q[top].tolist()], [names[x] for x in i[top].tolist()], score[top]


def _search(k: int, tie: Callable):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {f.name: batch.column(n)[r].as_py() for n, f in enumerate(batch.schema)}
                queries, matrix = (np.frombuffer(row[m], np.float64).reshape(len(row[i]), -1) for m, i in (("q_matrix", "q_ids"), ("matrix", "ids")))
                q, names, score = _best(k, row["q_ids"], row["q_grps"], queries, row["ids"], row["grps"], matrix, tie)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["query_id", "track_id", "score"])

    return run


def blocked_cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, blocks: int | None = None, tie: Callable = str, ties: Column | None = None, apart: str | None = None) -> DataFrame:
    """Top k by cosine of each query among ``vectors`` (track_id, vec), the query itself left out, and with
    ``apart`` all that has the query's value of that column. Equal scores (to nine digits) go by id, or by
    ``tie`` of the id and the same rule as a column, ``ties``.

    Queries and vectors are packed into blocks of bounded size on the executors, every block of queries meets
    every block of vectors in a task of its own, and only the best k of each meeting are merged: no vector
    passes through the driver and no pair table is made. An empty side gives no rows."""
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    v_blocks = max(1, -(-n // BLOCK), min(cores, n // 1000))
    q_blocks = blocks or max(1, -(-m // QUERY_BLOCK))

    def packed(df: DataFrame, count: int, seed: int) -> DataFrame:
        grp = F.col(apart).cast("string") if apart else F.lit(None).cast("string")
        rows = df.select("track_id", grp.alias("grp"), "vec", F.pmod(F.xxhash64(F.lit(seed), "track_id"), F.lit(count)).cast("int").alias("block"))
        return rows.repartition(count, "block").mapInArrow(_pack, "block int, ids array<string>, grps array<string>, matrix binary")

    q = packed(queries, q_blocks, 1).select("block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "grps", "matrix")))
    q = q.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))).withColumnRenamed("block", "q_block")
    v = packed(vectors, v_blocks, 2).withColumnRenamed("block", "v_block")
    v = v.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    met = q.repartition(v_blocks * q_blocks, "v_block", "q_block").join(v.hint("shuffle_hash"), ["v_block", "q_block"])
    found = met.select("q_ids", "q_grps", "q_matrix", "ids", "grps", "matrix").mapInArrow(_search(k, tie), "query_id string, track_id string, score double")
    return rank_scores(found, ["query_id"], k, ties=ties)


def pair_scores(vectors: DataFrame, score: Column, ordered: bool = True) -> DataFrame:
    """Scores of all pairs (a, b) of a small table, a < b if ``ordered``, else a <> b.

    For analyses whose result is the pair table; searches use ``blocked_cosine_topk``."""
    a = vectors.select(*(F.col(c).alias(f"a_{c}") for c in vectors.columns))
    b = vectors.select(*(F.col(c).alias(f"b_{c}") for c in vectors.columns))
    on = F.col("a_track_id") < F.col("b_track_id") if ordered else F.col("a_track_id") != F.col("b_track_id")
    return a.join(b, on).withColumn("score", score)
