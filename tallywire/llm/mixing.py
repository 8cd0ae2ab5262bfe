"""Mixing sources to target weights by Pfair scheduling.

A source with ``a`` of ``q`` parts of the mix is due one block every q / a slots: its block k
is released at slot floor(k q / a) and must be placed before slot ceil((k + 1) q / a). One
block fills one slot, and of the released blocks the one with the earliest deadline goes
first. That keeps every source less than one block away from its share at every slot. The
schedule repeats after q slots, so one period of it places every block by arithmetic.

When a source has no blocks left, the others go on with the parts they have, of a smaller
whole. So every document is placed, once, and shares are exact for the sources that remain.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.llm.tables import unused
from tallywire.plans.sizes import settled

PARTS = 1000  # parts that weights are rounded to
# Documents of a source are numbered in this many runs, so a large source is many tasks.
RUN_DIGITS = 3  # leading hex digits of a document's hash: 4,096 runs


def whole_parts(weights: dict, parts: int = PARTS) -> dict:
    """Weights as whole parts, one at least; what rounding leaves goes to the largest rests."""
    total = sum(weights.values())
    exact = {s: parts * w / total for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))
    for s in rest[: max(0, parts - sum(out.values()))]:
        out[s] += 1
    return out


def period(parts: dict) -> dict:
    """The slots of each source in one period, earliest deadline first; ties by name."""
    q = sum(parts.values())
    slots: dict = {s: [] for s in parts}
    waiting = [(0, str(s), s) for s in parts]  # (release, name, source) of the next block
    heapq.heapify(waiting)
    ready: list = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, name, s = heapq.heappop(waiting)
            k, a = len(slots[s]), parts[s]
            heapq.heappush(ready, (-(-(k + 1) * q // a), name, s))
        _, name, s = heapq.heappop(ready)
        slots[s].append(slot)
        k = len(slots[s])
        if k < parts[s]:
            heapq.heappush(waiting, (k * q // parts[s], name, s))
    return slots


def phases(parts: dict, blocks: dict) -> list[tuple]:
    """Rows (source, first block, blocks, first slot, parts, whole, slots), phase by phase.

    A phase ends when a source has placed its last block. There are as many phases as sources
    at most, and all rows together name as many slots as phases times parts.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    begin, rows = 0, []
    while left:
        mine = {s: parts[s] for s in left}
        shared = math.gcd(*mine.values())
        mine = {s: a // shared for s, a in mine.items()}
        q = sum(mine.values())
        slots = period(mine)
        length = min(
            (n - 1) // mine[s] * q + slots[s][(n - 1) % mine[s]] + 1 for s, n in left.items()
        )
        for s in list(left):
            n = length // q * mine[s] + sum(x < length % q for x in slots[s])
            rows.append((s, done[s], n, begin, mine[s], q, slots[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        begin += length
    return rows


PHASES = pa.schema(
    [
        ("of_source", pa.string()),
        ("first_block", pa.int64()),
        ("blocks", pa.int64()),
        ("first_slot", pa.int64()),
        ("parts", pa.int64()),
        ("whole", pa.int64()),
        ("slots", pa.list_(pa.int64())),
    ]
)


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    power: float = 0.7,
    block: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, parts, whole, block, slot, position.

    ``weights`` maps sources to target weights; a source it does not name gets the smallest
    of them. Without it a source weighs its number of documents to the ``power``. ``slot`` is
    where the schedule puts the document's block of ``block`` documents, and ``position``
    orders all documents. Documents of a source follow each other by the MD5 of their id.

    Every document is placed once: a null source is a source of its own, rows that repeat an
    id are placed one after the other, and rows without id come last in their source. There
    is one weight per source, so the table of sources is brought to the driver; documents are
    numbered within runs of a source, of which even a large one has thousands. No rows give
    no rows.
    """
    spark = docs.sparkSession
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keys = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.when(F.col(id_col).isNull(), F.lit("z"))
        .otherwise(F.substring(md5, 1, RUN_DIGITS))
        .alias("run"),
        md5.alias("md5"),
    )
    keys = settled(keys, "mix-keys")
    # One number for both: each run's rows, and the rows in the source's runs before it.
    runs = keys.groupBy("source", "run").agg(F.count("*").alias("n"))
    runs = settled(runs, "mix-runs")
    per_source = runs.groupBy("source").agg(F.sum("n").alias("n"))
    sizes = {r["source"]: r["n"] for r in per_source.collect()}
    if weights is None:
        weights = {s: n**power for s, n in sizes.items()}
    least = min(weights.values(), default=1)
    parts = whole_parts({s: weights.get(s, least) for s in sizes}) if sizes else {}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    # A list of rows would go through Python workers, which every executor then keeps.
    rows = [dict(zip(PHASES.names, r, strict=True)) for r in phases(parts, blocks)]
    table = spark.createDataFrame(pa.Table.from_pylist(rows, PHASES))

    upto = "sum(n) OVER (PARTITION BY source ORDER BY run) - n"
    before = runs.select(
        F.col("source").alias("in_source"),
        F.col("run").alias("in_run"),
        F.expr(upto).alias("before"),
    )
    place = "row_number() OVER (PARTITION BY source, run ORDER BY md5, doc_id) - 1"
    rows = keys.select("doc_id", "source", "run", F.expr(place).cast("bigint").alias("place"))
    same = (F.col("source").eqNullSafe(F.col("in_source"))) & (F.col("run") == F.col("in_run"))
    # At most 4,097 runs for each source.
    rows = rows.join(F.broadcast(before), same)
    rows = rows.withColumn("number", F.col("before") + F.col("place"))
    rows = rows.withColumn("block", F.floor(F.col("number") / block))
    at = F.col("block") - F.col("first_block")
    rows = rows.join(
        F.broadcast(table),
        F.col("source").eqNullSafe(F.col("of_source")) & (at >= 0) & (at < F.col("blocks")),
    )
    parts_, whole = F.col("parts"), F.col("whole")
    slot = (
        F.col("first_slot")
        + F.floor(at / parts_) * whole
        + F.col("slots")[F.pmod(at, parts_).cast("int")]
    )
    return rows.select(
        "doc_id",
        "source",
        "parts",
        "whole",
        "block",
        slot.alias("slot"),
        (slot * block + F.pmod(F.col("number"), F.lit(block))).alias("position"),
    )


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, unchanged, laid out by their position in the mix.

    Rows that repeat an id, and rows without id, lie where the first of them does.
    """
    the_id, place = unused("_doc_id", docs), unused("_position", docs)
    order = mix_sources(docs, **how).groupBy("doc_id").agg(F.min("position").alias(place))
    order = order.withColumnRenamed("doc_id", the_id)
    rows = docs.join(order, docs["doc_id"].eqNullSafe(order[the_id]))
    rows = rows.repartitionByRange(place).sortWithinPartitions(place)
    return rows.select(*[docs[c] for c in docs.columns])
