"""Exact search for the largest inner products with an index of pivots and distances.

One more component, the root of what a vector's squared length lacks of the largest, puts all
vectors on one sphere, where the largest inner product is the smallest distance. Each vector is
keyed by its nearest pivot and its distance to it. By the triangle inequality a query that is
at distance d from a pivot is at least \\|d - r\\| from every vector at distance r, which bounds
the inner product. Sorted by distance, the vectors of a pivot are rings; a query visits rings
from its own distance outward and inward and stops when no ring left can hold a better one.

Products of integers are exact. Bounds are floating-point numbers, widened by far more than
their error, so they never exclude a result or a tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.llm.tables import groups_in_order, join_groups
from tallywire.plans.sizes import settled

PIVOTS = 32  # per length of vectors
SEEDS = 2048  # vectors that give queries a first lower bound
SHARD = 32_768  # vectors a task holds, about
SHARDS = 1 << 18  # beyond about so many, shards grow; their limits go to every task
BINS = 4096  # of the distances to a pivot, to cut its vectors by
RING = 512  # vectors
QUERIES = 1 << 16  # queries of a block
AT_ONCE = 1 << 21  # products of a step
EXACT = float(2**53)
LARGEST = 2**63 - 1
SLACK = 1e-6  # of squared lengths


def scaled(vector: Column, by: int = 256) -> Column:
    """Components times ``by``, rounded down, as doubles that hold whole numbers."""

    def floor(x: Column) -> Column:
        y = x * float(by)
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector.cast("array<double>"), floor)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, exactly; those beyond 64 bits count as the ends of that range.

    Floating-point numbers hold them exactly while no sum can pass 2^53, and integers beyond.
    """
    dims = queries.shape[1]
    if dims * np.abs(queries).max() * np.abs(vectors).max() < EXACT:
        return queries @ vectors.T
    whole = [[int(x) for x in v] for v in vectors]
    out = np.empty((len(queries), len(vectors)), dtype=np.int64)
    for i, q in enumerate(queries):
        q = [int(x) for x in q]
        for j, v in enumerate(whole):
            score = sum(a * b for a, b in zip(q, v, strict=True))
            out[i, j] = min(max(score, -LARGEST - 1), LARGEST)
    return out


class Sphere:
    """The space in which distances are taken: vectors with their lacking component."""

    def __init__(self, most: float, pivots: np.ndarray) -> None:
        self.most = most  # the largest squared length
        self.pivots = self.lifted(pivots)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        lack = self.most - np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(lack, 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From each lifted point to each pivot, by differences, which keeps small ones right."""
        out = np.empty((len(points), len(self.pivots)))
        for j, pivot in enumerate(self.pivots):
            away = points - pivot
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", away, away))
        return out

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return self.distances(np.column_stack([queries, np.zeros(len(queries))]))

    def bound(self, lengths: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The largest product of queries of squared ``lengths`` with vectors ``gap`` away."""
        reach = lengths + self.most
        return (reach - gap * gap) / 2 + SLACK * reach + 1


class Best:
    """The k best of what queries have met, by score and then the smaller id."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.at = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)
        self.least = floor.copy()  # a lower bound of each query's k-th best

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates that are not below the bound of their query."""
        self.at = np.concatenate([self.at, at])
        self.score = np.concatenate([self.score, score])
        self.id = np.concatenate([self.id, ids])
        order = np.lexsort((self.id, ~self.score, self.at))
        at = self.at[order]
        first = np.searchsorted(at, at, "left")
        nth = np.arange(len(at)) - first
        keep = order[nth < self.k]
        last = order[nth == self.k - 1]
        self.least[self.at[last]] = np.maximum(self.least[self.at[last]], self.score[last])
        self.at, self.score, self.id = self.at[keep], self.score[keep], self.id[keep]


def search_shard(
    sphere: Sphere,
    pivot: int,
    ids: np.ndarray,
    vectors: np.ndarray,
    radii: np.ndarray,
    queries: np.ndarray,
    floor: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of one pivot's vectors, sorted by distance, for queries: (query, id, score).

    Entries below ``floor``, a lower bound of each query's k-th best, may be left out. The
    last value is the number of products.
    """
    cuts = np.arange(0, len(ids), RING)
    ends = np.minimum(cuts + RING, len(ids)) - 1
    low, high = radii[cuts], radii[ends]
    lengths = np.einsum("ij,ij->i", queries, queries)
    home = sphere.of_queries(queries)[:, pivot, None]
    gap = np.maximum(np.maximum(low - home, home - high), 0)
    order = np.argsort(gap, axis=1, kind="stable")
    best = Best(k, floor)
    going = np.arange(len(queries))
    done = 0
    for step in range(len(cuts)):
        ring = order[going, step]
        top = sphere.bound(lengths[going], gap[going, ring])
        stop = top < best.least[going]  # false for what is not a number
        going, ring = going[~stop], ring[~stop]
        if not len(going):
            break
        met = []
        for r in np.unique(ring):
            part = slice(cuts[r], ends[r] + 1)
            every = going[ring == r]
            for lo in range(0, len(every), AT_ONCE // RING):
                asked = every[lo : lo + AT_ONCE // RING]
                score = products(queries[asked], vectors[part])
                done += score.size
                at, column = np.nonzero(score >= best.least[asked, None])
                hit = score[at, column].astype(np.int64)
                met.append((asked[at], hit, ids[part][column]))
        best.add(*[np.concatenate(c) for c in zip(*met, strict=True)])
    return best.at, best.id, best.score, done


def _matrix(column) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]).to_numpy()
    return flat.astype(np.float64).reshape(len(column), -1)


def _keyed(batches: Iterator[pa.RecordBatch], spheres: dict) -> Iterator[pa.RecordBatch]:
    """Vectors (dims, class, vector, asked) with their nearest pivot and distance."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            sphere = spheres[int(d)]
            away = sphere.distances(sphere.lifted(_matrix(part.column("vector"))))
            pivot = np.argmin(away, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array(pivot.astype(np.int32)),
                    pa.array(away[np.arange(len(pivot)), pivot]),
                ],
                [*part.schema.names, "pivot", "radius"],
            )


def _routed(
    batches: Iterator[pa.RecordBatch], spheres: dict, limits: dict, seeds: dict, k: int
) -> Iterator[pa.RecordBatch]:
    """Each query once per shard that may hold one of its k best, with a lower bound."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            rows = batch.filter(pa.array(dims == d))
            sphere, (pivot, shard, low, high) = spheres[int(d)], limits[int(d)]
            step = max(1, AT_ONCE // max(len(pivot), len(seeds[int(d)])))
            for lo in range(0, rows.num_rows, step):
                part = rows.slice(lo, step)
                queries = _matrix(part.column("vector"))
                floor = np.full(len(queries), -LARGEST - 1)
                if len(seeds[int(d)]) >= k:
                    known = products(queries, seeds[int(d)])
                    floor = np.partition(known, -k, axis=1)[:, -k].astype(np.int64)
                home = sphere.of_queries(queries)[:, pivot]
                gap = np.maximum(np.maximum(low - home, home - high), 0)
                lengths = np.einsum("ij,ij->i", queries, queries)
                out = sphere.bound(lengths[:, None], gap) < floor[:, None]
                at, where = np.nonzero(~out)
                chosen = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        chosen.column("dims"),
                        pa.array(pivot[where].astype(np.int32)),
                        pa.array(shard[where].astype(np.int32)),
                        chosen.column("class"),
                        chosen.column("vector"),
                        pa.array(floor[at]),
                    ],
                    ["dims", "pivot", "slice", "class", "vector", "least"],
                )


FOUND = "query bigint, class bigint, score bigint"


def _searched(batches: Iterator[pa.RecordBatch], spheres: dict, k: int) -> Iterator[pa.RecordBatch]:
    """Search shards, whose vectors come first, in the order of their distances."""
    for group in groups_in_order(batches, ["dims", "pivot", "slice", "block"]):
        is_query = group.column("is_query").to_numpy(zero_copy_only=False)
        if is_query.all() or not is_query.any():
            continue
        held, asked = group.filter(pa.array(~is_query)), group.filter(pa.array(is_query))
        at, ids, score, _ = search_shard(
            spheres[group.column("dims")[0].as_py()],
            group.column("pivot")[0].as_py(),
            held.column("class").to_numpy(),
            _matrix(held.column("vector")),
            held.column("radius").to_numpy(),
            _matrix(asked.column("vector")),
            asked.column("least").to_numpy(),
            k,
        )
        query = asked.column("class").to_numpy()[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids), pa.array(score)], ["query", "class", "score"]
        )


def _spheres(classes: DataFrame) -> tuple[dict, dict]:
    """Per length of vectors the sphere with its pivots, and the seeds.

    Both are picked by a hash of the id, at most PIVOTS and SEEDS of them; they decide what is
    skipped and never what is found.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    most = classes.groupBy("dims").agg(F.max(square).alias("most")).collect()
    some = Window.partitionBy("dims").orderBy(F.xxhash64("class"), "class")
    picked = classes.withColumn("nth", F.row_number().over(some)).filter(F.col("nth") <= SEEDS)
    vectors: dict = {row.dims: [] for row in most}
    for row in picked.select("dims", "vector").orderBy("dims", "nth").collect():
        vectors[row.dims].append(row.vector)
    seeds = {dims: np.array(v, dtype=np.float64) for dims, v in vectors.items()}
    return {r.dims: Sphere(r.most, seeds[r.dims][:PIVOTS]) for r in most}, seeds


def top_products(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the ``k`` largest inner products for each query row.

    Vectors are scaled to whole numbers (see scaled), and products are theirs, exactly; one
    beyond 64 bits counts as the end of that range. ``is_query`` is a condition on ``vec_id``;
    the candidates of a query are all other rows; ties go to the smaller id. Rows without id,
    and vectors that are null, empty or hold a null or a number that is not finite (or is not
    after scaling) take no part; a vector of zeros does. Vectors of different lengths are
    never compared. Of rows that repeat an id the one with the smallest vector counts. A query
    without candidates has no rows.

    Equal vectors are one class with its k + 1 smallest ids, which is all a query can return,
    so a vector that a third of all rows share is searched once. A pivot with more vectors
    than a shard holds is cut into several by distance.
    """
    rows = table.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        scaled(F.col(vector_col), scale).alias("vector"),
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.withColumns({"is_query": is_query, "dims": F.size("vector")})
    rows = settled(rows, "whole-vectors")

    # Classes of equal vectors, known by their smallest id.
    members = Window.partitionBy("vector").orderBy("vec_id")
    firsts = rows.select("vec_id", "vector").withColumn("nth", F.row_number().over(members))
    firsts = firsts.filter(F.col("nth") <= k + 1)
    classes = rows.groupBy("vector", "dims").agg(
        F.min("vec_id").alias("class"),
        F.count("*").alias("held"),
        F.max("is_query").alias("asked"),
    )
    classes = settled(classes, "whole-classes")
    firsts = firsts.join(classes.select("vector", "class"), "vector").select("class", "vec_id")
    firsts = settled(firsts, "class-members")

    spheres, seeds = _spheres(classes)
    index = classes.select("dims", "class", "vector", "asked").mapInArrow(
        lambda batches: _keyed(batches, spheres),
        "dims int, class bigint, vector array<double>, asked boolean, pivot int, radius double",
    )
    index = settled(index, "pivot-index")
    index, limits = _sliced(index)
    slices = {
        d: tuple(np.array([r[c] for r in limits if r.dims == d]) for c in LIMITS) for d in spheres
    }
    queries = index.filter("asked").select("dims", "class", "vector")
    routed = queries.mapInArrow(
        lambda batches: _routed(batches, spheres, slices, seeds, k + 1),
        "dims int, pivot int, slice int, class bigint, vector array<double>, least bigint",
    )
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    block = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    columns = ["dims", "pivot", "slice", "block", "is_query", "radius", "class", "vector", "least"]
    asked = routed.withColumns(
        {"block": block, "is_query": F.lit(True), "radius": F.lit(0.0)}
    ).select(*columns)
    held = index.withColumns(
        {
            "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
            "is_query": F.lit(False),
            "least": F.lit(0).cast("bigint"),
        }
    ).select(*columns)
    key = columns[:4]
    both = held.union(asked).repartition(*key)
    both = both.sortWithinPartitions(*key, "is_query", "radius", "class")
    found = both.mapInArrow(lambda batches: _searched(batches, spheres, k + 1), FOUND)
    found = settled(found, "best-of-shards")

    nearest = _first(found, "class", k + 1).join(firsts, "class")
    nearest = _first(nearest.select("query", "vec_id", "score"), "vec_id", k + 1)
    lists = nearest.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near")
    )
    lists = classes.select("vector", "held", F.col("class").alias("query")).join(lists, "query")
    # Back from classes to their queries.
    asking = rows.filter("is_query").select("vector", F.col("vec_id").alias("query_id"))
    asking = join_groups(asking, settled(lists, "lists"), ["vector"], "held", "query_id")
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    out = asking.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "one"))
    return out.select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("one.vec_id"), F.col("one.score")
    )


LIMITS = ["pivot", "slice", "low", "high"]


def _sliced(index: DataFrame) -> tuple[DataFrame, list]:
    """``index`` with the ``slice`` of its pivot, and the limits of all slices.

    The distances to a pivot are counted in BINS bins of one width. Slices are runs of bins
    with about SHARD vectors; a bin that holds more is dealt to several slices by a hash.
    """
    pivot = ["dims", "pivot"]
    reach = index.groupBy(*pivot).agg(F.min("radius").alias("from"), F.max("radius").alias("to"))
    share = F.try_divide(F.col("radius") - F.col("from"), F.col("to") - F.col("from"))
    number = F.least(F.coalesce(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    # One row per pivot, and at most BINS below.
    index = index.join(F.broadcast(reach), pivot).withColumn("bin", number).drop("from", "to")
    counts = index.groupBy(*pivot, "bin").agg(F.count("*").alias("held"))
    counts = counts.orderBy(*pivot, "bin").collect()
    size = max(SHARD, math.ceil(sum(r.held for r in counts) / SHARDS))
    cuts, last = [], None
    for row in counts:
        if (row.dims, row.pivot) != last:
            last, free, room = (row.dims, row.pivot), 0, 0
        parts = max(1, math.ceil(row.held / size))
        if parts > 1:
            first, free, room = free, free + parts, 0
        else:
            if row.held > room:
                open_slice, free, room = free, free + 1, size
            first, room = open_slice, room - row.held
        cuts.append((row.dims, row.pivot, row.bin, first, parts))
    schema = "dims int, pivot int, bin int, first int, parts int"
    cuts = index.sparkSession.createDataFrame(cuts, schema)
    index = index.join(F.broadcast(cuts), [*pivot, "bin"])
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    index = index.withColumn("slice", F.col("first") + part).drop("bin", "first", "parts")
    limits = index.groupBy(*pivot, "slice").agg(
        F.min("radius").alias("low"), F.max("radius").alias("high")
    )
    return index, limits.collect()


def _first(rows: DataFrame, tie: str, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), tie)
    return rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
