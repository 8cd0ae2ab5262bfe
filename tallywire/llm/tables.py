"""Joins and groups that one very large group cannot break."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups above this share of all rows are broadcast; there are fewer than this many.
HOT_SHARE = 1000


# A side of at most this many short rows is sent to every executor whole.
BROADCAST_ROWS = 500_000


def broadcast_if_small(side: DataFrame) -> DataFrame:
    """Mark a written side for broadcast if it is small; else leave the join to be shuffled."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def by_value(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` in any task, also where this library is not installed.

    A broadcast names classes by the module they are from, which executors may not have; so
    the object travels as bytes that hold its classes, too.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    read: dict = {}

    def get():
        if "value" not in read:
            read["value"] = pickle.loads(held.value)
        return read["value"]

    return get


def unused(name: str, *tables: DataFrame) -> str:
    """A name for a helper column that no column of ``tables`` has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, spread: str
) -> DataFrame:
    """Left join of rows to one row per group, where few groups may hold most rows.

    ``size`` is the column of ``groups`` with the rows of the group. Groups of more than a
    thousandth of all rows (fewer than a thousand groups) are broadcast; their rows are then
    spread by ``spread`` in the shuffled join with the other groups.
    """
    keys = list(keys)
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    values = [c for c in groups.columns if c not in keys]
    packed = F.struct(*[F.col(v) for v in values])
    hot = groups.filter(is_hot).select(*keys, packed.alias("_hot"))
    cold = groups.filter(~is_hot).select(*keys, F.lit(0).alias("_salt"), packed.alias("_cold"))
    found = rows.join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1
    )
    found = found.withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    one = F.coalesce("_hot", "_cold")
    return found.select(*rows.columns, *[one[v].alias(v) for v in values])


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of rows that come sorted by ``keys``, whole, one at a time."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        names = list(zip(*[table.column(k).to_pylist() for k in keys], strict=True))
        lo = 0
        for i in range(1, len(names) + 1):
            if i < len(names) and names[i] == names[lo]:
                continue
            part = table.slice(lo, i - lo)
            if held and held_key != names[lo]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            held_key = names[lo]
            lo = i
    if held:
        yield pa.concat_tables(held)
