"""Totals, breakdown and event counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.labels import share
from tallywire.functions.taxonomy import GROUPS, is_lifecycle, is_message

MAX_BINS = 4096
MIN_BIN_MS = 100
MAX_SERIES = 8


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def totals(df: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Events, unreadable records, peers, kinds and the time span.

    Rows are counted per (kind, peer) first; the exact distinct counts work on that.
    """
    peer = F.when(is_message() | is_lifecycle(), F.col("peer_id"))
    per_peer = df.groupBy("event_group", "kind", peer.alias("peer_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high")
    )
    errors = F.lit(0).cast("bigint")
    if bad is not None:
        errors = bad.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_peer.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count_distinct("peer_id").alias("peers"),
        F.count_distinct("event_group", "kind").alias("kinds"),
        F.min("low").alias("first_ts"),
        F.max("high").alias("last_ts"),
        F.coalesce(F.max("high") - F.min("low"), F.lit(0)).alias("duration_ms"),
    ).withColumn("decode_errors", errors)


def kind_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category", "event_group", "kind", "label").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def breakdown(df: DataFrame) -> DataFrame:
    """Count and share of every kind, most frequent first."""
    counts = kind_counts(df)
    total = counts.agg(F.sum("cnt").alias("n")).scalar()
    return counts.withColumn("share", share(F.col("cnt"), total)).orderBy(
        F.desc("cnt"), "event_group", "kind"
    )


def category_rollup(df: DataFrame) -> DataFrame:
    """Counts of categories, groups and kinds, each level with its sums."""
    return kind_counts(df).rollup("category", "event_group", "kind").agg(F.sum("cnt").alias("cnt"))


def groups_present(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("event_group")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "event_group")
    )


def grid(df: DataFrame) -> DataFrame:
    """One row: where the bins start, how wide they are and how many there are.

    The width is the smallest 100 * 2**k ms that needs at most 4096 bins.
    """
    whole = _div(F.col("high") - F.col("start_ms"), F.lit(MIN_BIN_MS))
    doublings = F.greatest(F.length(F.bin(whole)) - F.length(F.bin(F.lit(MAX_BINS - 1))), F.lit(0))
    width = F.call_function("shiftleft", F.lit(MIN_BIN_MS).cast("bigint"), doublings)
    return (
        df.agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
        .withColumn("start_ms", F.col("low") - F.pmod("low", F.lit(MIN_BIN_MS)))
        .withColumn("bin_ms", width)
        .withColumn("bins", _div(F.col("high") - F.col("start_ms"), F.col("bin_ms")) + 1)
        .select("start_ms", "bin_ms", F.col("bins").cast("bigint"))
    )


def _grid(df: DataFrame, max_bins: int | None) -> Column:
    """The grid as one struct, with whole bins merged so that at most ``max_bins`` remain."""
    found = grid(df)
    if max_bins is not None:
        found = merged(found, max_bins)
    return found.select(F.struct("start_ms", "bin_ms", "bins").alias("g")).scalar()


def merged(found: DataFrame, max_bins: int) -> DataFrame:
    if max_bins < 1:
        return found.filter(F.lit(False))
    merge = F.ceil(F.col("bins") / F.lit(max_bins)).cast("bigint")
    return found.select(
        "start_ms",
        (F.col("bin_ms") * merge).alias("bin_ms"),
        F.ceil(F.col("bins") / merge).cast("bigint").alias("bins"),
    )


def _binned(df: DataFrame, g: Column, by: list[str]) -> DataFrame:
    bin_no = _div(F.col("ts_ms") - g["start_ms"], g["bin_ms"])
    return (
        df.filter(g.isNotNull())
        .groupBy(bin_no.alias("bin"), *by)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumns({"bin_start_ms": g["start_ms"] + F.col("bin") * g["bin_ms"]})
    )


def timeline(df: DataFrame, by: str = "kind", max_bins: int | None = None) -> DataFrame:
    """Event counts per bin and ``by``; no event is left out, whatever order they came in."""
    keys = ["event_group", "kind"] if by == "kind" else [by]
    counts = _binned(df, _grid(df, max_bins), keys)
    return counts.select("bin_start_ms", *keys, "cnt")


def downsample(tl: DataFrame, found: DataFrame, max_bins: int, by: list[str]) -> DataFrame:
    """Merge the bins of a finished timeline, a whole number of them at a time."""
    g = merged(found, max_bins).select(F.struct("start_ms", "bin_ms").alias("g")).scalar()
    bin_no = _div(F.col("bin_start_ms") - g["start_ms"], g["bin_ms"])
    start = g["start_ms"] + bin_no * g["bin_ms"]
    return (
        tl.filter(g.isNotNull())
        .groupBy(start.alias("bin_start_ms"), *by)
        .agg(F.sum("cnt").alias("cnt"))
    )


def timeline_groups(df: DataFrame, max_bins: int) -> DataFrame:
    """Counts of all 8 groups in every bin, zeros included."""
    g = _grid(df, max_bins)
    counts = _binned(df, g, ["event_group"]).select("bin", "event_group", "cnt")
    order = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(x).alias("name")) for i, x in enumerate(GROUPS)])
    slots = (
        df.sparkSession.range(1)
        .select(g.alias("g"))
        .filter("g is not null")
        .select("g", F.explode(F.sequence(F.lit(0), F.col("g.bins") - 1)).alias("bin"))
        .select("g", "bin", F.explode(order).alias("group"))
        .select(
            "bin",
            (F.col("g.start_ms") + F.col("bin") * F.col("g.bin_ms")).alias("bin_start_ms"),
            F.col("group.n").alias("group_no"),
            F.col("group.name").alias("event_group"),
        )
    )
    return slots.join(counts, ["bin", "event_group"], "left").select(
        "bin_start_ms", "group_no", "event_group", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def timeline_group(df: DataFrame, group: str, max_bins: int) -> DataFrame:
    """One group by kind: the 8 busiest kinds, the rest summed as ``other (n)``.

    The bins are those of the whole archive.
    """
    g = _grid(df, max_bins)
    inside = df.filter(F.col("event_group") == group)
    counts = inside.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    others = counts.agg(F.count(F.lit(1)) - MAX_SERIES).scalar()
    top = counts.orderBy(F.desc("total"), "kind").limit(MAX_SERIES).select("kind").withColumn(
        "named", F.lit(True)
    )
    series = F.when(F.col("named"), F.col("kind")).otherwise(
        F.concat(F.lit("other ("), others.cast("string"), F.lit(")"))
    )
    return (
        _binned(inside, g, ["kind"])
        .join(F.broadcast(top), "kind", "left")  # MAX_SERIES rows
        .groupBy("bin_start_ms", series.alias("series"))
        .agg(F.sum("cnt").alias("cnt"))
    )


def ticks(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of kinds per tick of MIN_BIN_MS and ``by``, with the first and last time in it.

    Every grid starts at a tick and has bins of whole ticks, so any timeline can be made of them.
    """
    tick = F.col("ts_ms") - F.pmod("ts_ms", F.lit(MIN_BIN_MS))
    return df.groupBy(*by, tick.alias("bin_start_ms"), "category", "event_group", "kind", "label").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high")
    )


def timeline_of_ticks(tl: DataFrame, by: str = "kind", max_bins: int | None = None) -> DataFrame:
    """``timeline`` from ticks, of which a kind may have several at one time."""
    keys = ["event_group", "kind"] if by == "kind" else [by]
    found = grid(tl.select(F.explode(F.array("low", "high")).alias("ts_ms")))
    # A grid has MAX_BINS bins at most: with as many allowed none are merged.
    return downsample(tl, found, MAX_BINS + 1 if max_bins is None else max_bins, keys)
