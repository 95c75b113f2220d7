"""Exact top-k by inner product: the threshold algorithm over sorted lists.

Vectors are cut into blocks. A block holds, for each dimension, the order of its
rows by that component (the sorted lists). A query reads all lists from the end
that its own component prefers, deeper and deeper; rows that turn up get their
whole score (random access), and the bound at a depth is the score of a vector
made of the components there. It stops as soon as the bound is below its kth
best score, which it carries from block to block.

Every query block meets every candidate block of its vectors' length. Candidate
blocks are dealt over groups and query blocks are copied to each group, so the
search is as many tasks as there are groups, also where all vectors have one
length. A task keeps k rows of each of its queries, and a last small ranking
joins the tasks' results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block: 64 components make 0.8 and 0.5 MB.
BLOCK, QUERIES = 4096, 1024
NULL_ID = np.iinfo(np.int64).max
#: Products up to here are exact as doubles.
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no component null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def blocks(rows: DataFrame, size: int, lists: bool) -> DataFrame:
    """Rows (id, row, v) as blocks of vectors of one length: dims, n and the arrays as bytes."""

    def pack(part: list[tuple], dims: int) -> pa.RecordBatch:
        ids, own, values = (np.array(x, np.int64) for x in zip(*part))
        values = values.reshape(len(part), dims)
        order = np.argsort(values, axis=0, kind="stable").astype(np.int16).T if lists else np.empty(0, np.int16)
        cols = [pa.array([dims], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, own, values, order))]
        return pa.RecordBatch.from_arrays(cols, names=["dims", "ids", "rows", "v", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            ids = batch.column("id").fill_null(int(NULL_ID)).to_pylist()
            for row in zip(ids, batch.column("row").to_pylist(), batch.column("v").to_pylist()):
                mine = held.setdefault(len(row[2]), [])
                mine.append(row)
                if len(mine) == size:
                    yield pack(mine, len(row[2]))
                    mine.clear()
        for dims, mine in held.items():
            if mine:
                yield pack(mine, dims)

    return rows.mapInArrow(run, "dims int, ids binary, rows binary, v binary, lists binary")


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids, rows = scores[some], ids[some], rows[some]
    order = np.lexsort((rows, ids, -scores))[:k]
    return scores[order], ids[order], rows[order]


def threshold(query: np.ndarray, own: int, vectors: np.ndarray, lists: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, so_far: tuple) -> tuple:
    """The k best of so_far and a block, for one query."""
    n, dims = vectors.shape
    used = np.flatnonzero(query)
    weights = query[used]
    seen = np.zeros(n, bool)
    top, depth = so_far, 0
    while depth < n:
        # the bound of what lies at this depth or deeper, from the ends that the query prefers
        place = np.where(weights > 0, lists[used, n - 1 - depth], lists[used, depth])
        bound = int((weights * vectors[place, used]).sum())
        if len(top[0]) == k and bound < top[0][-1]:
            break
        step = min(n, max(2 * k, 4 * depth))
        ends = [lists[used[weights > 0], n - step : n - depth], lists[used[weights < 0], depth:step]]
        new = np.zeros(n, bool)
        for x in ends:
            new[x.ravel()] = True
        if step == n:
            new[:] = True
        new &= ~seen
        seen |= new
        at = np.flatnonzero(new & (rows != own))
        if len(at):
            scores = vectors[at] @ query
            top = best(*(np.concatenate(x) for x in zip(top, (scores, ids[at], rows[at]))), k)
        depth = step
    return top


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, query_row, vec_id and score of the k best of each query in each task's pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = tuple(np.empty(0, np.int64) for _ in range(3))
        top: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dims = r["dims"]
                q_ids, q_rows, ids, rows = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_rows", "ids", "rows"))
                queries, vectors = (np.frombuffer(r[c], np.int64).reshape(len(n), dims) for c, n in (("q_v", q_ids), ("v", ids)))
                lists = np.frombuffer(r["lists"], np.int16).reshape(dims, len(ids))
                most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
                if most < EXACT:  # products of doubles are exact then, and faster
                    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
                for q, i, row in zip(queries, q_ids.tolist(), q_rows.tolist()):
                    top[i, row] = threshold(q, row, vectors, lists, ids, rows, k, top.get((i, row), nothing))
        found = [(i, row, v, s) for (i, row), (scores, ids, _) in top.items() for v, s in zip(ids.tolist(), scores.tolist())]
        for at in range(0, len(found), 20_000):
            i, row, v, s = zip(*found[at : at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(row, pa.int64()), pa.array([None if x == NULL_ID else x for x in v], pa.int64()), pa.array([int(x) for x in s], pa.int64())], names=["query_id", "query_row", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, query_row bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row for which is_query holds.

    A component x counts as floor(scale * x), the score is the integer inner
    product; ties go to the smaller id. Vectors that are null, or hold a null or
    non-finite component, take no part, and vectors meet those of their own
    length only; those without components are of one length, with score 0.
    Repeated rows are candidates for each other, a row never for itself; a null
    id ranks last among ties, and an empty table gives an empty one. Other
    columns are not read. groups: how many groups candidate blocks are dealt
    over, the number of shuffle partitions by default.
    """
    groups = groups or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.withColumn("_row", F.monotonically_increasing_id()).filter(usable(F.col(vector)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col("_row").alias("row"), whole.alias("v"), is_query.alias("q"))
    queries = blocks(rows.filter("q").select("id", "row", "v"), QUERIES, False).select("dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("v").alias("q_v"))
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = blocks(rows.select("id", "row", "v"), BLOCK, True).withColumn("g", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int"))
    # a stated query set against all rows, in blocks; a given number of partitions is not merged into fewer tasks
    pairs = found.repartition(groups, "dims", "g").join(queries.repartition(groups, "dims", "g"), ["dims", "g"])
    each = searched(pairs.drop("g"), k)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
