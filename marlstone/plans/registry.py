"""Queries by name, each with the DuckDB SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Inventory lines that each query stands for.
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name], COVERS[name] = f, covers
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return add


#: Common table expressions of the oracles.
TRACKS = "tracks as (select p_partkey::varchar track_id, p_name title, p_brand artist, p_type genre, p_size::double duration, p_retailprice price from part)"
INTER = "inter as (select o_custkey::varchar user_id, l_partkey::varchar track_id, max(l_quantity)/50 score, min(l_shipdate) ts from orders join lineitem on o_orderkey=l_orderkey group by o_custkey, l_partkey)"
RATED = INTER + ", rated as (select *, greatest(1, least(5, floor(1+4*score)::int)) rating from inter)"
USERS = "users as (select c_custkey::varchar user_id, c_mktsegment grp, n_name nation, r_name region, c_acctbal balance from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey)"
SPLIT = (
    INTER
    + """, numbered as (select *, row_number() over (partition by user_id order by sha256('42:' || user_id || ':' || track_id), track_id) rn,
  count(*) over (partition by user_id) n from inter),
 split as (select user_id, track_id, score, ts, case when rn <= floor(0.15*n) then 'test' when rn <= 2*floor(0.15*n) then 'validation' else 'train' end split
  from numbered where floor(0.15*n) >= 1)"""
)
VECTORS = "vectors as (select vec_id::varchar track_id, embedding::double[] vec, label::varchar genre from embeddings)"
UNIT = VECTORS + ", unit as (select track_id, genre, list_transform(vec, lambda x: x/sqrt(list_sum(list_transform(vec, lambda y: y*y)))) u from vectors)"
COSINE = UNIT + ", scored as (select a.track_id query_id, b.track_id track_id, a.genre query_genre, b.genre genre, round(list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1]*p[2])), 9) score from unit a join unit b on a.track_id<>b.track_id)"
RANKED = COSINE + ", ranked as (select *, row_number() over (partition by query_id order by score desc, track_id) rank from scored), top10 as (select * from ranked where rank<=10)"
