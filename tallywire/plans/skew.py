"""Plan shapes that keep one very busy key from landing in one task.

Most keys are small and one hash shuffle handles them. A key that holds a large share of the
rows is found by counting, and its rows are split by archive position: rows
of one split are consecutive in the archive, so an ordered computation can run inside each
split and carry its state over from the splits before it. Results never depend on which keys
are split, only the spread of the work does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows one key may hold before it is split.
HOT_ROWS = 4_000_000
# A split of a hot key covers 2**SPLIT_BITS consecutive archive positions.
SPLIT_BITS = 20

WHOLE = -1  # the split number of a key that is not split


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_hashes(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """The hashes of all keys with more than ``hot_rows`` rows.

    Rows are counted exactly, combined before the shuffle. This runs a job over the key columns
    when the operator is called, so that the plan for ordinary data needs none of what hot keys
    need. At most one number per ``hot_rows`` rows comes back.
    """
    counts = rows.groupBy(key_hash(keys).alias("h")).count()
    return sorted(r[0] for r in counts.filter(F.col("count") > hot_rows).select("h").collect())


def is_hot(hot: Sequence[int], keys: Sequence[str]) -> Column:
    return key_hash(keys).isin(*hot) if hot else F.lit(False)


def with_split(
    rows: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    hot_rows: int = HOT_ROWS,
    bits: int = SPLIT_BITS,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """Add ``split``: WHOLE for ordinary keys, a run of archive positions for hot ones.

    Also tells whether there are hot keys at all. They are looked for in ``counted`` where
    the keys can be had more cheaply than from ``rows``.
    """
    hot = hot_hashes(rows if counted is None else counted, keys, hot_rows)
    whole = F.lit(WHOLE).cast("bigint")
    split = F.when(is_hot(hot, keys), F.shiftright(F.col(pos), bits)).otherwise(whole)
    return rows.withColumn("split", split if hot else whole), bool(hot)


def carry_states(
    rows: DataFrame,
    keys: Sequence[str],
    summary: Sequence[Column],
    running: dict[str, Column],
) -> DataFrame:
    """What the other splits of a key add up to, one row per (key, split).

    ``summary`` aggregates one split; ``running`` names window expressions over those
    aggregates, to be evaluated with ``before()`` or ``after()``. Only split keys are in it.
    """
    split_rows = rows.filter(F.col("split") != WHOLE)
    per_split = split_rows.groupBy(*keys, "split").agg(*summary)
    return per_split.select(*keys, "split", *[c.alias(n) for n, c in running.items()])


def before(keys: Sequence[str]):
    """All splits of the key in front of this one."""
    return (
        Window.partitionBy(*keys)
        .orderBy("split")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def after(keys: Sequence[str]):
    """All splits of the key behind this one, the nearest last.

    Walking backwards keeps the frame a growing one; a frame that shrinks from the front is
    worked out anew for every row.
    """
    return (
        Window.partitionBy(*keys)
        .orderBy(F.col("split").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salt_by: str = "pos",
    hot_rows: int = HOT_ROWS,
    salts: int = 256,
    at_most: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (few rows per key), spreading hot keys over ``salts`` tasks.

    ``at_most`` is how many rows there are, where that is known; few rows have no hot key.
    """
    few = at_most is not None and at_most <= hot_rows
    hot = [] if few else hot_hashes(rows, keys, hot_rows)
    if not hot:
        return rows.join(lookup, list(keys), how)
    salt = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", F.when(is_hot(hot, keys), salt).otherwise(F.lit(0)))
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    right = lookup.withColumn(
        "_salt", F.explode(F.when(is_hot(hot, keys), all_salts).otherwise(F.array(F.lit(0))))
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
