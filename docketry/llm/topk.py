"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors turn into integers. Candidates are packed into blocks; within a block each
component has a posting list of the rows where it is not zero. A query row walks
its own non-zero components, scatters weight times posting into a dense array of
scores, and selects by partition; the selections of all blocks merge per query.
Blocks of queries and of candidates are dealt into the tiles of a grid: each tile holds
some queries and some candidates, both bounded in bytes, meets them block by block and
gives back the best of each query. Nothing is broadcast and no rows are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.runtime import partitions, table

#: Queries in a block, candidates in a block, bytes of either that a tile should hold.
QUERY_ROWS, CANDIDATE_ROWS, TILE = 1024, 4096, 64 << 20


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    n = np.asarray(col.value_lengths(), np.int64)
    flat = np.asarray(col.flatten(), np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


PACKED = "ids binary, tags binary, vectors binary, width int, deal long"


def _pack(rows: int):
    """Ids and vectors of a partition in blocks; ``tags`` number rows, ``deal`` blocks, over all partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, block, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m, n = _matrix(part.column(1)), part.num_rows
                datas = [np.asarray(part.column(0), np.int64), np.arange(row, row + n) + (partition << 40), m]
                packed = [pa.array([x.tobytes()], pa.binary()) for x in datas]
                yield pa.RecordBatch.from_arrays([*packed, pa.array([m.shape[1]], pa.int32()), pa.array([partition * 7919 + block], pa.int64())], ["ids", "tags", "vectors", "width", "deal"])
                block, row = block + 1, row + n

    return pack


def _unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.int64).reshape(len(i), width)


def block_topk(q_ids, tags, q, ids, m, k: int) -> tuple[np.ndarray, ...]:
    """Query, its tag, candidate and score of the k best rows of one block for each query, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    postings = []
    for t in range(m.shape[1]):
        rows = np.flatnonzero(m[:, t])
        postings.append((slice(None) if len(rows) == len(ids) else rows, m[rows, t].copy()))
    out_q, out_t, out_v, out_s = [], [], [], []
    scores = np.zeros(len(ids), np.int64)
    for own, tag, row in zip(q_ids, tags, q):
        scores[:] = 0
        for t in np.flatnonzero(row[: len(postings)]):
            rows, values = postings[t]
            scores[rows] += row[t] * values
        there = np.flatnonzero(ids != own)
        s = scores[there]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s > least)
            keep = np.concatenate([keep, np.flatnonzero(s == least)[: k - len(keep)]])
            there, s = there[keep], s[keep]
        out_q.append(np.full(len(there), own))
        out_t.append(np.full(len(there), tag))
        out_v.append(ids[there])
        out_s.append(s)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_t, out_v, out_s))


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query among the selections of several blocks."""
    q, tag, v, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((v, -score, tag))
    t = tag[order]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))[: len(t)]
    nth = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
    order = order[nth < k]
    return q[order], tag[order], v[order], score[order]


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products.

    Components turn into floor(scale * x). A row whose id is null, whose vector is
    null or which holds a null, NaN or infinite component takes no part. Every other
    row is a candidate, rows that repeat an id too, and each may take a rank; only
    rows of the query's own id are none. Query rows that repeat an id are answered
    each. With fewer than k candidates a query gets all. Vectors of unequal length are
    compared as if zeros followed. An empty table gives an empty result; columns
    besides id and vector are ignored.
    """
    spark = vectors.sparkSession
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
        .select("id", "q", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))
    )
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    across = max(1, -(-size.q * size.width * 8 // TILE))
    down = max(partitions(spark), -(-size.n * size.width * 8 // TILE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod("deal", F.lit(n)).cast("int")
    q_tiles = rows.where("q").select("id", "v").mapInArrow(_pack(QUERY_ROWS), PACKED).select("*", deal(across).alias("s"), every(down).alias("r"))
    c_tiles = rows.select("id", "v").mapInArrow(_pack(CANDIDATE_ROWS), PACKED).select("*", deal(down).alias("r"), every(across).alias("s"))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found, columns = [], ["query_id", "tag", "vec_id", "score"]
        for q in queries.to_pylist():
            ids, matrix = _unpack(q["ids"], q["vectors"], q["width"])
            tags = np.frombuffer(q["tags"], np.int64)
            each = [block_topk(ids, tags, matrix, *_unpack(c["ids"], c["vectors"], c["width"]), k) for c in candidates.to_pylist()]
            if each:
                found.append(_best(each, k))
        merged = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in merged], columns)

    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return (
        q_tiles.groupBy("s", "r")
        .cogroup(c_tiles.groupBy("s", "r"))
        .applyInArrow(search, "query_id long, tag long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op8_exact_topk": op8_exact_topk}
ORACLE = {
    "op8_exact_topk": """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
s as (
  select q.n as tag, q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by tag order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""
}
