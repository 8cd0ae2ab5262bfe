import random

import pytest

from tallywire.operators.peers import peer_table
from tallywire.operators.search import (
    event_rows,
    page,
    page_rows,
    search_events,
    seek,
    seek_index,
    total,
)
from tallywire.sources.archive import POSITION_BITS

from . import wire
from .test_timeline import loaded


@pytest.fixture(scope="module")
def df(spark):
    return loaded(spark).cache()


@pytest.mark.parametrize(
    "conditions, n",
    [
        (dict(), 110),
        (dict(kinds=["inv"]), 100),
        (dict(groups=["connection"]), 10),
        (dict(kinds=["inv"], groups=["connection"]), 110),
        (dict(peer_ids=[0]), 22),
        (dict(peer_ids=[0, 1]), 44),
        (dict(groups=["message"], peer_ids=[1]), 20),
        (dict(peer_ids=[999]), 0),
        (dict(time_from=1000, time_to=1100), 13),
        (dict(time_from=1990), 1),
        (dict(text="INV"), 100),
        (dict(text="10.0.0.3:"), 22),
        (dict(text="inbound", peer_ids=[2]), 2),
        (dict(text="nothing"), 0),
    ],
)
def test_conditions(df, conditions, n):
    assert wire.one(total(search_events(df, **conditions))).total == n


def test_text_looks_at_the_last_known_address(spark):
    rows = [
        wire.message(1, 1, "ping", True), dict(wire.message(2, 1, "ping", True), addr="203.0.113.9:1"),
        wire.misbehaving(3, 1, "x"), wire.armless(4),
    ]
    events = wire.archive(spark, rows)
    assert search_events(events, text="203.0.113").count() == 3
    assert search_events(events, text="10.0.0.1").count() == 0
    assert search_events(events, text="(UNK").count() == 1


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_pages_cover_everything_once(df, bits):
    found = search_events(df, kinds=["inv"])
    seen = []
    for offset in range(0, 120, 30):
        rows = page(found, offset, 30, bits=bits).orderBy("row_index").collect()
        assert [r.row_index for r in rows] == list(range(offset, min(offset + 30, 100)))
        seen += [r.pos for r in rows]
    assert seen == list(range(100))
    assert page(found, 500, 10, bits=bits).count() == 0


@pytest.mark.parametrize("bits", [3])
def test_pages_by_a_stored_index(spark, bits, tmp_path):
    """Events of several files, with gaps; every page is that of a count of all rows."""
    draw = random.Random(bits)
    places = sorted({(draw.choice([0, 1, 5, 6]) << POSITION_BITS) + draw.randrange(60) for _ in range(200)})
    rows = [(pos, draw.choice(["inv", "tx"]), draw.choice(["message", "other", None])) for pos in places]
    events = spark.createDataFrame(rows, "pos long, kind string, event_group string").repartition(3)
    seek_index(events, bits).write.parquet(str(tmp_path / "index"))
    events.write.parquet(str(tmp_path / "events"))
    index = spark.read.parquet(str(tmp_path / "index"))
    events = spark.read.parquet(str(tmp_path / "events"))
    for more in [{}, {"kinds": ["tx"]}, {"groups": ["other"], "kinds": ["inv"]}, {"kinds": ["none"]}]:
        kinds, groups = more.get("kinds", []), more.get("groups", [])
        want = [r[0] for r in rows if not more or r[1] in kinds or r[2] in groups]
        for offset in (0, 7, 55, len(want) - 1, len(want)):
            cut = seek(events, index, max(offset, 0), 12, bits=bits, **more).orderBy("pos")
            assert [(r.row_index, r.pos) for r in cut.collect()] == [
                (offset + i, p) for i, p in enumerate(want[max(offset, 0) : max(offset, 0) + 12])
            ]


def scanned(plan):
    """(columns, rows read) of every scan of a plan that has been run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scanned(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scanned(plan.plan())
    if name == "FileSourceScanExec":
        return [(plan.output().toString(), plan.metrics().apply("numOutputRows").value())]
    inner = plan.children()
    return [found for i in range(inner.size()) for found in scanned(inner.apply(i))]


def test_a_page_reads_its_own_runs_alone(spark, tmp_path):
    spark.range(0, 4000, 1, 8).selectExpr(
        "id AS pos", "'inv' AS kind", "'message' AS event_group"
    ).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    seek_index(events, 6).write.parquet(str(tmp_path / "index"))
    cut = seek(events, spark.read.parquet(str(tmp_path / "index")), 3000, 10, bits=6)
    assert sorted(r.pos for r in cut.collect()) == list(range(3000, 3010))
    # Of eight files of 500 rows the two that hold the run are read.
    read = [n for names, n in scanned(cut._jdf.queryExecution().executedPlan()) if "event_group" in names]
    assert max(read) <= 1000
    with pytest.raises(ValueError, match="within a file"):
        seek_index(events, POSITION_BITS + 1)


@pytest.mark.parametrize("whole", [True, False])
def test_rows(df, whole):
    cut = page(df, 99, 2)
    found = event_rows(cut, peer_table(df)) if whole else page_rows(df, cut, 2)
    rows = found.orderBy("pos").collect()
    assert [(r.kind, r.label, r.peer_id, r.addr, r.inbound, r.size) for r in rows] == [
        ("inv", "inv", 4, "10.0.0.4:8333", False, 40),
        ("inbound", "connection inbound", 0, "10.0.0.0:8333", None, 0),
    ]
