"""Activity rasters: entities by columns of time, split by direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.taxonomy import is_lifecycle, is_message, row_size
from tallywire.operators.peers import lifecycle_counts, recent_lifecycle

# Up to this many chosen rows are sent to every task as they are.
SMALL = 10_000


def checked(number: int, what: str) -> int:
    if number < 1:
        raise ValueError(f"{what} must be at least 1, not {number}")
    return number


def column_of(ts: Column, start: Column, span: Column, columns: int) -> Column:
    """The column of a time: floor((ts - start) * columns / span), the end in the last one."""
    offset = F.greatest(ts - start, F.lit(0)) * F.lit(columns)
    col = F.call_function("div", offset, span)
    return F.least(col, F.lit(columns - 1).cast("bigint")).cast("int")


def activity_window(df: DataFrame, time_from: int | None, time_to: int | None) -> Column:
    """(start, end) of the raster, by default the span of the archive."""
    lit = lambda v: F.lit(v).cast("bigint")
    if time_from is not None and time_to is not None:
        return F.struct(lit(time_from).alias("start"), lit(time_to).alias("end"))
    found = df.agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    start = F.coalesce(lit(time_from), "low", lit(0))
    end = F.coalesce(lit(time_to), "high", lit(0))
    return found.select(F.struct(start.alias("start"), end.alias("end")).alias("w")).scalar()


def worth_a_row(peers: DataFrame, window: Column, min_duration_ms: int = 0) -> DataFrame:
    """Peers seen inside the window that lasted long enough; none for an empty window."""
    return peers.filter(
        (window["end"] > window["start"])
        & (F.col("duration_ms") >= min_duration_ms)
        & (F.col("last_seen") >= window["start"])
        & (F.col("first_seen") <= window["end"])
    )


def activity_rows(
    peers: DataFrame, window: Column, max_rows: int, min_duration_ms: int = 0, sort: str = "firstSeen"
) -> DataFrame:
    """The peers that get a row: the busiest, or the earliest seen."""
    first = F.col("events").desc() if sort == "events" else F.col("first_seen").asc()
    return (
        worth_a_row(peers, window, min_duration_ms)
        .orderBy(first, F.col("peer_id").asc())
        .limit(max_rows)
    )


def peer_activity(
    df: DataFrame,
    peers: DataFrame,
    *,
    columns: int,
    max_rows: int,
    min_duration_ms: int = 0,
    sort: str = "firstSeen",
    weight: str = "count",
    time_from: int | None = None,
    time_to: int | None = None,
) -> DataFrame:
    """Non-empty cells (peer_id, col, inbound, value); value counts messages or their bytes."""
    checked(columns, "columns")
    window = activity_window(df, time_from, time_to)
    rows = activity_rows(peers, window, max_rows, min_duration_ms, sort).select("peer_id")
    if max_rows <= SMALL:
        rows = F.broadcast(rows)
    value = F.sum(row_size()) if weight == "bytes" else F.count(F.lit(1))
    start, span = window["start"], window["end"] - window["start"]
    cells = (
        df.filter(is_message())
        .filter((F.col("ts_ms") >= window["start"]) & (F.col("ts_ms") <= window["end"]))
        .join(rows, "peer_id", "left_semi")
        .groupBy("peer_id", column_of(F.col("ts_ms"), start, span, columns).alias("col"), "inbound")
        .agg(value.alias("value"))
    )
    # A message of 0 bytes leaves its cell empty.
    return cells.filter(F.col("value") > 0)


def activity_summary(
    df: DataFrame, peers: DataFrame, cells: DataFrame, *, columns: int, max_rows: int,
    min_duration_ms: int = 0, time_from: int | None = None, time_to: int | None = None,
) -> DataFrame:
    """One row: the window, the column width, candidates, rows shown and the highest cell."""
    checked(columns, "columns")
    window = activity_window(df, time_from, time_to)
    candidates = worth_a_row(peers, window, min_duration_ms).agg(F.count(F.lit(1)).alias("peers"))
    peak = cells.agg(F.coalesce(F.max("value"), F.lit(0)).alias("peak")).scalar()
    span = F.when(window["end"] > window["start"], window["end"] - window["start"]).otherwise(0)
    return candidates.select(
        window["start"].alias("start_ms"),
        window["end"].alias("end_ms"),
        F.lit(columns).alias("columns"),
        (span.cast("double") / F.lit(columns)).alias("bin_ms"),
        "peers",
        F.least("peers", F.lit(max_rows).cast("bigint")).alias("shown"),
        peak.alias("peak"),
    )


def _own_span(mine: DataFrame) -> Column:
    """(start, span) of one peer's own events; a single instant still spans 1 ms."""
    from tallywire.operators.peers import of_peers

    seen = of_peers(mine).agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    span = F.greatest(F.col("b") - F.col("a"), F.lit(1).cast("bigint"))
    return seen.select(F.struct(F.col("a").alias("start"), span.alias("span")).alias("w")).scalar()


def peer_raster(df: DataFrame, peer_id: int, columns: int, rows: int) -> DataFrame:
    """Cells of one peer: its busiest commands by columns of its own time."""
    checked(columns, "columns")
    mine = df.filter(F.col("peer_id") == peer_id)
    messages = mine.filter(is_message())
    w = _own_span(mine)
    busiest = (
        messages.groupBy("kind")
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "kind")
        .limit(checked(rows, "rows"))
    )
    busiest = F.broadcast(busiest) if rows <= SMALL else busiest
    col = column_of(F.col("ts_ms"), w["start"], w["span"], columns)
    return (
        messages.groupBy("kind", col.alias("col"), "inbound")
        .agg(F.count(F.lit(1)).alias("value"))
        .join(busiest, "kind")
        .select("kind", "total", "col", "inbound", "value")
    )


def peer_raster_summary(df: DataFrame, peer_id: int, columns: int, cells: DataFrame) -> DataFrame:
    """One row: the span, the column width, the commands before the cap and the highest cell."""
    checked(columns, "columns")
    mine = df.filter(F.col("peer_id") == peer_id)
    w = _own_span(mine)
    peak = cells.agg(F.coalesce(F.max("value"), F.lit(0)).alias("peak")).scalar()
    inbound = is_message() & F.col("inbound")
    per_kind = (
        mine.groupBy(F.when(is_message(), F.col("kind")).alias("command"))
        .agg(
            F.count_if(inbound).alias("i"),
            F.count_if(is_message() & ~F.col("inbound")).alias("o"),
            F.max("ts_ms").alias("end_ms"),
        )
    )
    return per_kind.agg(
        F.count("command").alias("commands"),
        F.sum("i").alias("messages_in"),
        F.sum("o").alias("messages_out"),
        F.max("end_ms").alias("end_ms"),
    ).select(
        w["start"].alias("start_ms"),
        "end_ms",
        F.lit(columns).alias("columns"),
        (w["span"].cast("double") / F.lit(columns)).alias("bin_ms"),
        "commands",
        "messages_in",
        "messages_out",
        peak.alias("peak"),
    )


def raster_marks(
    df: DataFrame,
    columns: int,
    *,
    time_from: int | None = None,
    time_to: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """The lifecycle events of every peer on the columns of the activity raster.

    All inside the window, or with ``last`` those among each peer's last so many; ``complete``
    says whether that keeps all lifecycle events of the peer.
    """
    window = activity_window(df, time_from, time_to)
    start, end = window["start"], window["end"]
    return _marks(df, start, end, end - start, columns, last)


def peer_marks(df: DataFrame, peer_id: int, columns: int, last: int | None = None) -> DataFrame:
    """The lifecycle events of one peer, all or the last ones, on the columns of its raster."""
    mine = df.filter(F.col("peer_id") == peer_id)
    w = _own_span(mine)
    return _marks(mine, w["start"], w["start"] + w["span"], w["span"], columns, last)


def _marks(
    df: DataFrame, start: Column, end: Column, span: Column, columns: int, last: int | None
) -> DataFrame:

    checked(columns, "columns")
    inside = (F.col("ts_ms") >= start) & (F.col("ts_ms") <= end) & (span > 0)
    if last is None:
        marks, complete = df.filter(is_lifecycle()), F.lit(True)
    else:
        totals = lifecycle_counts(df).select("peer_id", "lifecycle_events")
        marks = recent_lifecycle(df, last).join(totals, "peer_id")
        complete = F.col("lifecycle_events") <= last
    return marks.filter(inside).select(
        "peer_id",
        "pos",
        column_of(F.col("ts_ms"), start, span, columns).alias("col"),
        "kind",
        "ts_ms",
        complete.alias("complete"),
    )


IDENTITY = [
    "addr", "conn_type", "first_seen", "last_seen", "events", "messages_in", "messages_out",
    "bytes_in", "bytes_out",
]


def peer_activity_rows(
    df: DataFrame,
    peers: DataFrame,
    *,
    columns: int,
    max_rows: int,
    min_duration_ms: int = 0,
    sort: str = "firstSeen",
    weight: str = "count",
    time_from: int | None = None,
    time_to: int | None = None,
) -> DataFrame:
    """The raster's rows in order: rank, who the peer is, its cells and its marks.

    ``cells_in`` and ``cells_out`` are lists ``[col, value, ...]`` of the two directions and
    ``marks`` one of (col, kind); all are empty for a peer that shows nothing in the window.
    """
    window = activity_window(df, time_from, time_to)
    chosen = activity_rows(peers, window, max_rows, min_duration_ms, sort)
    first = F.col("events").desc() if sort == "events" else F.col("first_seen").asc()
    order = Window.orderBy(first, F.col("peer_id").asc())  # over max_rows rows
    chosen = chosen.select("peer_id", *IDENTITY, F.row_number().over(order).alias("rank"))
    few = F.broadcast(chosen.select("peer_id")) if max_rows <= SMALL else chosen.select("peer_id")
    options = {"time_from": time_from, "time_to": time_to}
    cells = peer_activity(
        df, peers, columns=columns, max_rows=max_rows, min_duration_ms=min_duration_ms,
        sort=sort, weight=weight, **options,
    )
    lists = sparse_rows(cells, ["peer_id", "inbound"]).groupBy("peer_id").agg(
        F.any_value(F.when(F.col("inbound"), F.col("cells")), True).alias("cells_in"),
        F.any_value(F.when(~F.col("inbound"), F.col("cells")), True).alias("cells_out"),
    )
    marks = raster_marks(df, columns, **options).join(few, "peer_id", "left_semi")
    marks = marks.groupBy("peer_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "col", "kind"))).alias("marks")
    )
    rows = chosen.join(lists, "peer_id", "left").join(marks, "peer_id", "left")
    none = F.array().cast("array<bigint>")
    unplaced = F.transform("marks", lambda m: F.struct(m["col"].alias("col"), m["kind"].alias("kind")))
    return rows.select(
        "rank",
        "peer_id",
        *IDENTITY,
        F.coalesce("cells_in", none).alias("cells_in"),
        F.coalesce("cells_out", none).alias("cells_out"),
        F.coalesce(unplaced, F.array().cast("array<struct<col:int,kind:string>>")).alias("marks"),
    )


def sparse_rows(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells as one list ``[col, value, col, value, ...]`` per row, a pair per column at most."""
    pair = F.array(F.col("col").cast("bigint"), F.col("value"))
    return cells.groupBy(*by).agg(F.flatten(F.array_sort(F.collect_list(pair))).alias("cells"))
