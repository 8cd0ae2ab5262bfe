"""Searching and paging events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.taxonomy import is_lifecycle, is_message, row_size
from tallywire.operators.peers import last_addresses
from tallywire.plans import skew
from tallywire.plans.sizes import settled, small_enough
from tallywire.sources.archive import POSITION_BITS

# Rows are counted per run of 2**RUN_BITS archive positions to find a page.
RUN_BITS = 20
# Up to this many rows a page, its runs and its peers are sent to every task.
MAX_BROADCAST_PAGE = 100_000


def search_events(
    df: DataFrame,
    *,
    kinds: Sequence[str] = (),
    groups: Sequence[str] = (),
    peer_ids: Sequence[int] = (),
    time_from: int | None = None,
    time_to: int | None = None,
    text: str = "",
    peers: DataFrame | None = None,
) -> DataFrame:
    """Events that meet every given condition; what is not given does not constrain.

    An event's kind may be in ``kinds`` or its group in ``groups``; both time limits are
    inclusive. ``text`` is looked for in the kind and in the peer's last known address, which
    ``peers`` (peer_id, addr) supplies; without it the addresses come from ``df``.
    """
    out = df
    if kinds or groups:
        out = out.filter(F.col("kind").isin(*kinds) | F.col("event_group").isin(*groups))
    if peer_ids:
        out = out.filter(_attributed() & F.col("peer_id").isin(*peer_ids))
    if time_from is not None:
        out = out.filter(F.col("ts_ms") >= time_from)
    if time_to is not None:
        out = out.filter(F.col("ts_ms") <= time_to)
    if text:
        out = _matching(out, text.lower(), last_addresses(df) if peers is None else peers)
    return out


def _attributed() -> Column:
    return is_message() | is_lifecycle()


def _matching(df: DataFrame, needle: str, peers: DataFrame) -> DataFrame:
    by_address = settled(
        peers.filter(F.contains(F.lower("addr"), F.lit(needle))).select(
            "peer_id", F.lit(True).alias("_at_address")
        ),
        "matching-peers",
    )
    if small_enough(by_address):
        marked = df.join(F.broadcast(by_address), "peer_id", "left")
    else:
        marked = skew.salted_join(df, by_address, ["peer_id"], "left")
    in_kind = F.contains(F.lower("kind"), F.lit(needle))
    at_address = F.coalesce("_at_address", F.lit(False)) & _attributed()
    return marked.filter(in_kind | at_address).drop("_at_address").select(*df.columns)


def page(df: DataFrame, offset: int, limit: int, bits: int = RUN_BITS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in archive order, with ``row_index`` from 0.

    Counting rows per run of positions tells which runs hold the page, so only those are
    sorted, however deep the page lies.
    """
    counts = df.groupBy(*_run(bits)).agg(F.count(F.lit(1)).alias("n"))
    return _cut(df, _of_page(counts, offset, limit), offset, limit, bits)


def seek_index(df: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """Rows of every kind per file and run of positions.

    Written once, it serves every page of the archive: of all events, and of kinds and groups.
    """
    return df.groupBy(*_run(bits), "event_group", "kind").agg(F.count(F.lit(1)).alias("n"))


def seek(
    df: DataFrame,
    index: DataFrame,
    offset: int,
    limit: int,
    *,
    kinds: Sequence[str] = (),
    groups: Sequence[str] = (),
    bits: int = RUN_BITS,
) -> DataFrame:
    """``page`` of the events ``df`` by their stored ``seek_index``, made with the same ``bits``.

    Events are neither counted nor read but for the runs that hold the page: the bounds of
    their positions are looked up in the index, a short job, and pushed down to the scan.
    """
    counts = search_events(index, kinds=kinds, groups=groups).groupBy("file_no", "run")
    runs = _of_page(counts.agg(F.sum("n").alias("n")), offset, limit)
    ends = runs.agg(F.min("run").alias("first"), F.max("run").alias("last")).first()
    first, last = (0, -1) if ends.first is None else (ends.first, ends.last)
    near = df.filter((F.col("pos") >= first << bits) & (F.col("pos") < last + 1 << bits))
    return _cut(search_events(near, kinds=kinds, groups=groups), runs, offset, limit, bits)


def _run(bits: int) -> list[Column]:
    if bits > POSITION_BITS:
        raise ValueError(f"a run lies within a file: at most {POSITION_BITS} bits")
    run = F.shiftright(F.col("pos"), bits)
    return [F.shiftright(F.col("pos"), POSITION_BITS).alias("file_no"), run.alias("run")]


def _of_page(counts: DataFrame, offset: int, limit: int) -> DataFrame:
    """(run, start) of the runs that hold a page; ``counts`` has one row per file and run.

    The one window without a partition sees a row per file. Runs are summed up within theirs.
    """
    ahead = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file_no").agg(F.sum("n").alias("in_file"))
    files = files.select(
        "file_no", "in_file", F.coalesce(F.sum("in_file").over(ahead), F.lit(0)).alias("file_start")
    )
    # Files without a row of the page go before their runs are looked at.
    files = files.filter(
        (F.col("file_start") < offset + limit)
        & (F.col("file_start") + F.col("in_file") > offset)
    )
    within = Window.partitionBy("file_no").orderBy("run")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("file_start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    runs = counts.join(files, "file_no").withColumn("start", start)
    held = (F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)
    return runs.filter(held).select("run", "start")


def _cut(df: DataFrame, runs: DataFrame, offset: int, limit: int, bits: int) -> DataFrame:
    # Every run left holds a row of the page, so there are at most ``limit`` of them.
    small = F.broadcast(runs) if limit <= MAX_BROADCAST_PAGE else runs
    place = F.row_number().over(Window.partitionBy("run").orderBy("pos")) - 1
    return (
        df.withColumn("run", F.shiftright(F.col("pos"), bits))
        .join(small, "run")
        .withColumn("row_index", F.col("start") + place)
        .filter((F.col("row_index") >= offset) & (F.col("row_index") < offset + limit))
        .drop("run", "start")
    )


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def _shown(df: DataFrame) -> DataFrame:
    extra = [c for c in ("row_index", "detail", "keys") if c in df.columns]
    return df.select(
        "pos",
        "ts_ms",
        "category",
        "event_group",
        "kind",
        "label",
        F.when(_attributed(), F.col("peer_id")).alias("peer_id"),
        "inbound",
        row_size().alias("size"),
        *extra,
    )


def event_rows(df: DataFrame, peers: DataFrame) -> DataFrame:
    """Events as rows to show, with the peer's last known address."""
    known = peers.select("peer_id", "addr")
    return skew.salted_join(_shown(df), known, ["peer_id"], "left")


def page_rows(df: DataFrame, cut: DataFrame, limit: int) -> DataFrame:
    """A page ``cut`` out of the events ``df``, as rows to show.

    Addresses are looked up for the page's own peers only.
    """
    shown = settled(_shown(cut), "page")
    mine = shown.select("peer_id").distinct()
    small = F.broadcast(mine) if limit <= MAX_BROADCAST_PAGE else mine
    known = last_addresses(df.join(small, "peer_id", "left_semi"))
    return shown.join(known, "peer_id", "left")
