"""The store of tallies against full reads of the same files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallywire.functions.taxonomy import classify
from tallywire.operators import peers, timeline
from tallywire.session import shared_folder
from tallywire.sources import archive as source
from tallywire.sources.tallies import TallyStore

from . import wire


def events_of(draw, hour, n):
    """Events of a few peers within an hour, some of them at two addresses."""
    rows = []
    for _ in range(n):
        ts = hour * 3_600_000 + draw.randrange(3_600_000)
        peer = draw.randrange(6)
        addr = f"192.0.2.{peer + draw.randrange(2)}:8333"
        what = draw.random()
        if what < 0.6:
            kind = draw.choice(["ping", "inv"])
            rows.append(dict(wire.message(ts, peer, kind, draw.random() < 0.5, draw.randrange(90)), addr=addr))
        elif what < 0.8:
            begun = ts // 1000 - draw.randrange(900)
            rows.append(dict(wire.ended(ts, peer, "inbound", begun, evicted=what < 0.7), addr=addr))
        elif what < 0.9:
            rows.append(dict(wire.opened(ts, peer), addr=addr))
        else:
            rows.append(wire.misbehaving(ts, peer, "x"))
    return rows


def write(folder, hour, rows, extra=()):
    lines = [json.dumps(dict({k: v for k, v in r.items() if v is not None}, record_no=n)) for n, r in enumerate(rows)]
    name = f"node.a.b.20240101-{hour:02d}0000-000.json"
    (folder / name).write_text("\n".join([*lines, *extra]) + "\n")


def rows_of(df):
    return sorted(map(repr, (tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())))


def assert_same(spark, store, path):
    raw = source.read_raw(spark, path, "json")
    good, bad = source.quarantine(raw)
    files = source.list_files(spark, path)
    whole = classify(source.with_archive_order(good, files)).cache()
    assert rows_of(store.totals()) == rows_of(timeline.totals(whole, bad))
    assert rows_of(store.breakdown()) == rows_of(timeline.breakdown(whole))
    for bins in (None, 7):
        assert rows_of(store.timeline(max_bins=bins)) == rows_of(timeline.timeline(whole, max_bins=bins))
    by_group = timeline.timeline(whole, by="event_group")
    assert rows_of(store.timeline(by="event_group")) == rows_of(by_group)
    assert rows_of(store.peer_table()) == rows_of(peers.peer_table(whole))
    for ending in ("all", "closed", "evicted"):
        want = peers.connection_durations(whole, ending)
        assert rows_of(store.connection_durations(ending)) == rows_of(want)
    whole.unpersist()


def test_store_equals_a_full_read(spark, tmp_path):
    """Files arrive late, grow and hold damaged records; each is read when it is new alone."""
    draw = random.Random(5)
    store = TallyStore(spark, shared_folder(spark, "tallies"))
    early, later = events_of(draw, 1, 40), events_of(draw, 3, 60)
    write(tmp_path, 3, later[:25], ['{"ts_ms": 17, "ar'])
    write(tmp_path, 4, events_of(draw, 4, 30))
    assert store.update(str(tmp_path), "json") == 2
    assert store.update(str(tmp_path), "json") == 0
    assert_same(spark, store, str(tmp_path))
    # One that belongs before them, one that has grown, and one without any event.
    write(tmp_path, 1, early)
    write(tmp_path, 3, later, ['{"ts_ms": 17, "ar', "{"])
    (tmp_path / "node.a.b.20240101-050000-000.json").write_text("{broken\n")
    assert store.update(str(tmp_path), "json") == 3
    assert store.files().count() == 4
    assert_same(spark, store, str(tmp_path))


def test_a_batch_that_was_cut_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    folder = shared_folder(spark, "tallies")
    store = TallyStore(spark, folder)
    write(tmp_path, 1, events_of(draw, 1, 20))
    store.update(str(tmp_path), "json")
    want = rows_of(store.totals())
    write(tmp_path, 2, events_of(draw, 2, 20))

    def fail(df, by):
        return df.select(*by, F.raise_error(F.lit("lost")).alias("x"))

    with monkeypatch.context() as broken:
        broken.setattr(peers, "duration_tallies", fail)
        with pytest.raises(Exception, match="lost"):
            store.update(str(tmp_path), "json")
    assert len([f for f in os.listdir(f"{folder}/ticks") if f.startswith("batch=")]) == 2
    assert rows_of(store.totals()) == want
    # A new session's store goes on from the folder.
    again = TallyStore(spark, folder)
    assert again.update(str(tmp_path), "json") == 1
    assert_same(spark, again, str(tmp_path))


def test_reads_only_what_is_new(spark, tmp_path):
    """Content of a stored file is not looked at again: it may even be gone."""
    draw = random.Random(7)
    store = TallyStore(spark, shared_folder(spark, "tallies"))
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir(), new.mkdir()
    write(old, 1, events_of(draw, 1, 10))
    write(new, 2, events_of(draw, 2, 15))
    store.update(str(old), "json")
    assert store.update(str(new), "json") == 1
    assert store.totals().first().events == 25
    assert_same(spark, store, [str(old), str(new)])


def test_nothing_stored(spark, tmp_path):
    store = TallyStore(spark, shared_folder(spark, "tallies"))
    assert store.files().count() == 0
    with pytest.raises(ValueError, match="no files have been added"):
        store.totals()
    (tmp_path / "node.a.b.20240101-000000-000.json").write_text("\n")
    store.update(str(tmp_path), "json")
    first = store.totals().first()
    assert (first.events, first.peers, first.first_ts) == (0, 0, None)
    assert store.timeline().count() == store.peer_table().count() == 0
    assert store.connection_durations().count() == store.breakdown().count() == 0


def test_ticks_at_edges(spark):
    """Times before 1970, on both sides of a tick, and a span that needs wider bins."""
    times = [-250, -1, 0, 99, 100, 101, 409_599, 409_600, 5_000_000]
    rows = spark.createDataFrame(
        [(t, "c", "message", "k", "l") for t in times],
        "ts_ms long, category string, event_group string, kind string, label string",
    )
    for part in (rows, rows.filter("ts_ms < 409500"), rows.filter("ts_ms < 0")):
        for bins in (None, 1, 3, 5000):
            got = timeline.timeline_of_ticks(timeline.ticks(part, []), max_bins=bins)
            assert rows_of(got) == rows_of(timeline.timeline(part, max_bins=bins))
