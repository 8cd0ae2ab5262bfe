"""Approximate nearest neighbours by cosine with a forest of sorted hash strings.

Vectors are dealt to shards of bounded size. In a shard every tree is a sorted array of hash
strings, one bit per random hyperplane, so that all vectors with the same first bits are one
run of the array. A query goes down each tree to its longest matching prefix, and then up all
trees together, one bit at a time, until the runs hold enough candidates; those are scored
exactly. Shards that see all queries, in blocks, lose nothing by being apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.llm.tables import groups_in_order, join_groups
from tallywire.plans.sizes import settled

TREES, BITS = 48, 32
SHARD = 8192  # vectors of a shard, about
QUERIES = 8192  # queries of a block, about
# Candidates a query asks of a shard, as a share of its vectors, and at least so many.
REACH, LEAST = 0.6, 2048


class Forest:
    """Sorted arrays of hash strings over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, seed: int = 7) -> None:
        dims = vectors.shape[1]
        rng = np.random.default_rng([seed, dims])
        self.planes = rng.standard_normal((dims, TREES * BITS)).astype(np.float32)
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, one row per tree."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = np.empty((TREES, len(vectors)), dtype=np.uint32)
        for lo in range(0, len(vectors), 2048):
            signs = unit[lo : lo + 2048].astype(np.float32) @ self.planes > 0
            packed = np.packbits(signs, axis=1).view(">u4")
            out[:, lo : lo + 2048] = packed.T
        return out

    def runs(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the run of entries that share ``depth`` first bits."""
        low = np.empty(codes.shape, dtype=np.int64)
        high = np.empty(codes.shape, dtype=np.int64)
        rest = BITS - depth
        first = (codes.astype(np.uint64) >> np.uint64(rest)) << np.uint64(rest)
        last = first + np.uint64((1 << rest) - 1)
        for t in range(TREES):
            low[t] = np.searchsorted(self.sorted[t], first[t].astype(np.uint32), "left")
            high[t] = np.searchsorted(self.sorted[t], last[t].astype(np.uint32), "right")
        return low, high

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Rows for each query, from the lowest depth at which all trees have enough."""
        codes = self.codes(queries)
        low = np.zeros(codes.shape, dtype=np.int64)
        high = np.full(codes.shape, self.sorted.shape[1])
        wait = np.ones(codes.shape[1], dtype=bool)
        for depth in range(BITS, 0, -1):
            at = np.flatnonzero(wait)
            if not len(at):
                break
            lo, hi = self.runs(codes[:, at], depth)
            found = (hi - lo).sum(axis=0) >= enough
            done = at[found]
            low[:, done], high[:, done] = lo[:, found], hi[:, found]
            wait[done] = False
        mark = np.zeros(self.sorted.shape[1], dtype=bool)
        for i in range(codes.shape[1]):
            mark[:] = False
            for t in range(TREES):
                mark[self.order[t, low[t, i] : high[t, i]]] = True
            yield np.flatnonzero(mark)


def nearest_in_shard(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the ids and cosines of the k nearest candidates; ties to smaller ids."""
    forest = Forest(vectors)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    # Runs of several trees overlap, so they must hold more entries than rows are wanted.
    rows = max(LEAST, math.ceil(REACH * len(vectors)))
    for i, found in enumerate(forest.candidates(queries, rows)):
        q = queries[i]
        score = (vectors[found] @ q) / (norms[found] * np.sqrt(q @ q))
        if len(found) > k:
            least = -np.partition(-score, k - 1)[k - 1]
            found, score = found[score >= least], score[score >= least]
        order = np.lexsort((ids[found], -score))[:k]
        yield int(query_ids[i]), ids[found[order]], score[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy()
    return flat.astype(np.float64).reshape(len(column), -1)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for group in groups_in_order(batches, ["dims", "shard", "block"]):
        is_query = np.array(group.column("is_query").to_pylist(), dtype=bool)
        ids = group.column("class").to_numpy()
        vectors = _matrix(group.column("vector"))
        if is_query.all() or not is_query.any():
            continue
        rows = [[], [], []]
        for query, near, score in nearest_in_shard(
            ids[~is_query], vectors[~is_query], ids[is_query], vectors[is_query], k
        ):
            rows[0].append(np.full(len(near), query))
            rows[1].append(near)
            rows[2].append(score)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(r)) for r in rows], ["query", "class", "score"]
        )


def nearest(
    table: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the ``k`` nearest found for each query row.

    ``is_query`` is a condition on ``vec_id``; the candidates of a query are all other rows.
    The score is the cosine in double precision; ties go to the smaller id. Rows without id,
    and vectors that are null, empty, zero or hold a null or a number that is not finite, take
    no part; vectors of different lengths are never compared. Of rows that repeat an id the
    one with the smallest vector counts. A query without candidates has no rows.

    Equal vectors are one class with its k + 1 smallest ids, which is all a query can return,
    so a vector that a third of all rows share is searched once.
    """
    values = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), values.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.filter(fine & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.withColumns(
        {
            "v1": F.xxhash64("vector"),
            "v2": F.xxhash64(F.reverse("vector"), F.lit(1)),
            "dims": F.size("vector"),
            "is_query": is_query,
        }
    )
    rows = settled(rows, "vectors")
    name = ["v1", "v2", "dims"]
    order = Window.partitionBy(*name).orderBy("vec_id")
    # Spark takes the first rows of each class in every task before it shuffles them.
    firsts = rows.select(*name, "vec_id").withColumn("nth", F.row_number().over(order))
    firsts = firsts.filter(F.col("nth") <= k + 1)
    sizes = rows.groupBy(*name).agg(
        F.min("vec_id").alias("class"),
        F.count("*").alias("held"),
        F.max("is_query").alias("is_query"),
    )
    sizes = settled(sizes, "vector-classes")
    members = firsts.join(sizes.drop("is_query"), name).select("class", "vec_id")
    members = settled(members, "firsts")

    total = sizes.agg(F.count("*"), F.sum(F.col("is_query").cast("int"))).first()
    shards = max(1, math.ceil(total[0] / SHARD))
    blocks = max(1, math.ceil((total[1] or 0) / QUERIES))
    asked = sizes.select(F.col("class").alias("vec_id"), F.col("is_query").alias("asked"))
    reps = rows.join(asked, "vec_id")
    reps = reps.select(F.col("vec_id").alias("class"), "dims", "vector", "asked")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one(n: int):
        return F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")

    columns = ["dims", "shard", "block", "is_query", "class", "vector"]
    held = reps.withColumns({"shard": one(shards), "is_query": F.lit(False)})
    held = held.withColumn("block", every(blocks)).select(*columns)
    asked = reps.filter("asked").withColumns({"block": one(blocks), "is_query": F.lit(True)})
    asked = asked.withColumn("shard", every(shards)).select(*columns)
    key = ["dims", "shard", "block"]
    both = held.union(asked).repartition(*key).sortWithinPartitions(*key, "is_query", "class")
    found = both.mapInArrow(
        lambda b: _search(b, k + 1), "query bigint, class bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    ids = found.select("query", "class", "score").join(members, "class")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    lists = ids.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near")
    )
    # Back from classes to the queries of each.
    per_class = sizes.select(*name, "held", F.col("class").alias("query")).join(lists, "query")
    queries = rows.filter("is_query").select(*name, F.col("vec_id").alias("query_id"))
    queries = join_groups(queries, settled(per_class, "near"), name, "held", "query_id")
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    rows = queries.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
    return rows.select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("x.vec_id").alias("vec_id"),
        F.col("x.score").alias("score"),
    )
