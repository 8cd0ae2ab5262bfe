import random

import pytest
from pyspark.sql import functions as F

from tallywire.operators import timeline

from . import wire


def loaded(spark):
    rows = [wire.message(1000 + 10 * i, i % 5, "inv", i % 2 == 0) for i in range(100)]
    return wire.archive(spark, rows + [wire.opened(1000 + 100 * i, i % 5) for i in range(10)])


def test_totals_and_breakdown(spark):
    df = loaded(spark)
    totals = wire.one(timeline.totals(df))
    assert (totals.events, totals.peers, totals.kinds, totals.decode_errors) == (110, 5, 2, 0)
    assert (totals.first_ts, totals.last_ts, totals.duration_ms) == (1000, 1990, 990)
    parts = timeline.breakdown(df).collect()
    assert [(r.kind, r.cnt) for r in parts] == [("inv", 100), ("inbound", 10)]
    assert abs(sum(r.share for r in parts) - 100) < 1e-9
    assert [r.event_group for r in timeline.groups_present(df).collect()] == ["message", "connection"]
    empty = df.filter(F.lit(False))
    nothing = wire.one(timeline.totals(empty))
    assert (nothing.events, nothing.first_ts, nothing.duration_ms) == (0, None, 0)
    assert timeline.breakdown(empty).count() == 0


def stamped(spark, stamps):
    rows = [(i, t, "message", f"k{i % 3}") for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, "pos long, ts_ms long, event_group string, kind string")


@pytest.mark.parametrize(
    "stamps",
    [
        [1050], [1050, 950, 5000, 3],
        [1_700_000_000_000 + 977 * i for i in range(900)],
        [0, 1_700_000_000_000], [99, 409_599], [100, 409_700],
    ],
)
def test_grid(spark, stamps):
    draw = random.Random(1)
    draw.shuffle(stamps)
    df = stamped(spark, stamps)
    g = wire.one(timeline.grid(df))
    assert g.start_ms == min(stamps) // 100 * 100
    width = 100
    while (max(stamps) - g.start_ms) // width + 1 > 4096:
        width *= 2
    assert (g.bin_ms, g.bins) == (width, (max(stamps) - g.start_ms) // width + 1)
    counts = {}
    for i, t in enumerate(stamps):
        at = (g.start_ms + (t - g.start_ms) // width * width, f"k{i % 3}")
        counts[at] = counts.get(at, 0) + 1
    got = {(r.bin_start_ms, r.kind): r.cnt for r in timeline.timeline(df).collect()}
    assert got == counts


@pytest.mark.parametrize("bins", [1, 7, 500])
def test_downsampling_keeps_every_event(spark, bins):
    df = loaded(spark)
    groups = timeline.timeline_groups(df, bins).collect()
    assert sum(r.cnt for r in groups) == 110
    starts = sorted({r.bin_start_ms for r in groups})
    assert len(starts) <= bins and len(groups) == 8 * len(starts)
    whole = timeline.timeline(df)
    less = timeline.downsample(whole, timeline.grid(df), bins, ["event_group"])
    assert {(r.bin_start_ms, r.event_group): r.cnt for r in less.collect()} == {
        (r.bin_start_ms, r.event_group): r.cnt for r in groups if r.cnt
    }


def test_no_bins_and_no_events(spark):
    df = loaded(spark)
    assert timeline.timeline_groups(df, 0).count() == 0
    empty = df.filter(F.lit(False))
    assert timeline.timeline_groups(empty, 10).count() == 0
    assert timeline.timeline(empty).count() == 0


def test_kinds_past_the_eighth_are_folded(spark):
    rows = [wire.message(1000 + n, 1, f"c{k:02}", True) for k in range(20) for n in range(40 - k)]
    rows.append(wire.opened(1, 1))
    got = timeline.timeline_group(wire.archive(spark, rows), "message", 10).collect()
    sums = {}
    for r in got:
        sums[r.series] = sums.get(r.series, 0) + r.cnt
    assert set(sums) == {f"c{k:02}" for k in range(8)} | {"other (12)"}
    assert sum(sums.values()) == len(rows) - 1
    few = timeline.timeline_group(wire.archive(spark, rows), "connection", 10).collect()
    assert [(r.series, r.cnt) for r in few] == [("inbound", 1)]
