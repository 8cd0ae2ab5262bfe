import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallywire.operators.pairing import pair_by_timing
from tallywire.operators.peers import peer_table
from tallywire.operators.relay import relay_race
from tallywire.operators.rules import Rule
from tallywire.session import shared_folder
from tallywire.streaming.aggregates import stream_peers, stream_timeline
from tallywire.sources.archive import list_files, read_events
from tallywire.streaming.ordered import run_ordered
from tallywire.streaming.pairing import PairingStep
from tallywire.streaming.race import RaceStep, stream_known_items
from tallywire.streaming.run import (
    run_appending,
    run_updating,
    stream_events,
    stream_table,
    with_event_time,
)

from . import brute, wire
from .test_relay import random_race

RULES = (
    Rule("ping", ("pong",), window_ms=60_000),
    Rule("inv", ("getdata",), optional=True, window_ms=30_000),
    Rule("getdata", ("tx", "notfound"), multi=True, window_ms=90_000),
    Rule("getblocktxn", ("blocktxn", "notfound"), window_ms=60_000),
)


def in_files(df, spark, parts, order="pos"):
    """Write a table as files of consecutive rows, one after the other."""
    folder = shared_folder(spark, "input")
    n = df.count()
    edge = [df.orderBy(order).offset(n * i // parts).limit(1).first()[order] for i in range(parts)]
    for i, low in enumerate(edge):
        part = df.filter(F.col(order) >= low)
        if i + 1 < parts:
            part = part.filter(F.col(order) < edge[i + 1])
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def talk(seed=1, n=300):
    draw = random.Random(seed)
    commands = sorted({r.request for r in RULES} | {c for r in RULES for c in r.replies})
    ts, out = 1_700_000_000_000, []
    for _ in range(n):
        ts += draw.choice([10, 500, 9000])
        out.append(wire.message(ts, draw.randrange(3), draw.choice(commands), draw.random() < 0.5))
    return out


def arriving(df, spark, parts, order, folder=None, at="pos"):
    """Write a table as ``parts`` files of consecutive rows that arrive in the given ``order``."""
    folder = folder or shared_folder(spark, "input")
    places = sorted(r[0] for r in df.select(at).collect())
    edges = [places[len(places) * i // parts] for i in range(parts)] + [places[-1] + 1]
    for i in order:
        part = df.filter((F.col(at) >= edges[i]) & (F.col(at) < edges[i + 1]))
        path = f"{folder}/node.{20240101 + i}-000000-000.parquet"
        part.coalesce(1).write.parquet(path)
        stamp = 1_700_000_000 + len(os.listdir(folder))
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (stamp, stamp))
    return folder


# Ten files, two a batch: each comes at most two places from where it belongs.
SHUFFLED = [1, 0, 2, 4, 3, 6, 5, 7, 9, 8]


def files_stream(spark, folder, schema, per_batch=2):
    return stream_table(spark, f"{folder}/*/", schema, per_batch)


def events_stream(spark, rows, parts=4):
    df = wire.archive(spark, rows)
    folder = in_files(df, spark, parts)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return with_event_time(stream, "5 seconds")


PAIRS = ["rule", "peer_id", "inbound", "request_pos", "reply_pos", "elapsed_ms", "first_reply"]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_of_files_out_of_order(spark, seed):
    """Busy peers are split in every batch, and the second archive's clock runs backwards."""
    rows = talk(seed, 400)
    if seed == 2:
        draw = random.Random(5)
        rows = [r | {"ts_ms": r["ts_ms"] - draw.choice([0, 0, 900])} for r in rows]
    messages = [(i, r["ts_ms"], r["peer_id"], r["command"], r["inbound"]) for i, r in enumerate(rows)]
    ties, fates = brute.pair(messages, RULES)
    whole = wire.archive(spark, rows)
    folder = arriving(whole, spark, 10, SHUFFLED)
    span = max(r["ts_ms"] for r in rows) - rows[0]["ts_ms"]
    step = PairingStep(RULES, hot_rows=20, bits=3)
    run = run_ordered(
        files_stream(spark, folder, whole.schema), step, "pairs", delay_ms=span // 3, skew_ms=1000
    )
    assert run.last_batch() == 4 and run.late().count() == 0
    got = run.drained().cache()
    assert wire.rows(got.filter("event = 'tie'"), *PAIRS) == sorted(ties, key=repr)
    assert wire.rows(pair_by_timing(whole, RULES), *PAIRS) == sorted(ties, key=repr)
    said = {(r.rule, r.request_pos): r.fate for r in got.filter("event = 'fate'").collect()}
    assert len(said) == got.filter("event = 'fate'").count()
    end = max(m[1] for m in messages)
    when = {m[0]: m[1] for m in messages}
    for key, fate in fates.items():
        assert said.get(key, fate) == fate
        assert key in said or end - when[key[1]] <= RULES[key[0]].window_ms
    # What is committed is never taken back, and a good part is committed early.
    early = wire.rows(run.table().filter("event = 'tie'"), *PAIRS)
    assert set(early) <= set(ties) and len(early) > len(ties) // 3


def test_pairing_goes_on_after_a_restart(spark):
    rows = talk(3, 300)
    whole = wire.archive(spark, rows)
    span = rows[-1]["ts_ms"] - rows[0]["ts_ms"]
    folder, place = shared_folder(spark, "input"), shared_folder(spark, "pairs")
    want = wire.rows(pair_by_timing(whole, RULES), *PAIRS)
    for order in ([1, 0, 2], [4, 3], [5]):
        arriving(whole, spark, 6, order, folder)
        stream = files_stream(spark, folder, whole.schema, 1)
        run = run_ordered(stream, PairingStep(RULES), "pairs", span // 2, folder=place)
    assert run.last_batch() == 5
    assert wire.rows(run.drained().filter("event = 'tie'"), *PAIRS) == want
    # A batch that is run again changes nothing.
    seen = wire.rows(run.table())
    batch = files_stream_batch(spark, folder, whole.schema, 5)
    run.on_batch(batch, 5)
    assert wire.rows(run.table()) == seen


def files_stream_batch(spark, folder, schema, i):
    return spark.read.schema(schema).parquet(f"{folder}/node.{20240101 + i}-000000-000.parquet")


def test_race_of_files_out_of_order(spark):
    columns = "item long, pos long, item_no long, ts_ms long, peer_id long, delivery boolean, size long"
    for seed in (1, 2):  # the times of the first run backwards by up to 0.8 s
        df = spark.createDataFrame(random_race(seed, hot=True), columns)
        folder = arriving(df, spark, 10, SHUFFLED)
        step = RaceStep(10**9, hot_rows=10, bits=4)
        stream = files_stream(spark, folder, columns)
        run = run_ordered(stream, step, "race", delay_ms=1700, skew_ms=800)
        want = wire.rows(relay_race(df).select(*run.table().columns))
        assert run.last_batch() == 4 and run.late().count() == 0
        assert wire.rows(run.drained()) == want
        early = wire.rows(run.table())
        assert set(early) <= set(want) and len(early) > len(want) // 3


def test_rows_behind_the_frontier_are_counted(spark):
    columns = "item long, pos long, item_no long, ts_ms long, peer_id long, delivery boolean, size long"
    df = spark.createDataFrame(random_race(2, hot=False), columns)
    folder = arriving(df, spark, 5, [1, 2, 3, 4, 0])
    stream = files_stream(spark, folder, columns, 1)
    run = run_ordered(stream, RaceStep(10**9), "race", delay_ms=0)
    assert run.late().count() == 100
    rest = df.filter(F.col("pos") >= 200)
    assert wire.rows(run.drained()) == wire.rows(relay_race(rest).select(*run.table().columns))


def test_items_are_forgotten(spark):
    columns = "item long, pos long, item_no long, ts_ms long, peer_id long, delivery boolean, size long"
    rows = [(1, i, 0, 1000 * i, 1, False, None) for i in (0, 1, 50, 51, 99)]
    df = spark.createDataFrame(rows, columns)
    folder = arriving(df, spark, 5, range(5))
    stream = files_stream(spark, folder, columns, 1)
    run = run_ordered(stream, RaceStep(20_000), "race", delay_ms=0)
    got = {r.pos: r.first for r in run.drained().collect()}
    assert got == {0: True, 1: False, 50: True, 51: False, 99: True}


def test_a_raw_archive_as_a_stream(spark):
    """Files get their places from their names; a reread of all files agrees."""
    rows = talk(4, 300)
    df = wire.archive(spark, rows).select("pos", *[f.name for f in wire.WIRE_EVENTS.fields])
    raw = df.withColumn("record_no", F.lit(None).cast("bigint"))
    folder = arriving(raw, spark, 10, SHUFFLED)
    span = rows[-1]["ts_ms"] - rows[0]["ts_ms"]
    flat = shared_folder(spark, "flat")
    os.makedirs(flat)
    for i, n in enumerate(SHUFFLED):
        inside = f"{folder}/node.{20240101 + n}-000000-000.parquet"
        part = next(f for f in os.listdir(inside) if f.endswith(".parquet"))
        os.link(f"{inside}/{part}", f"{flat}/node.{20240101 + n}-000000-000.parquet")
        os.utime(f"{flat}/node.{20240101 + n}-000000-000.parquet", (1_700_000_000 + i,) * 2)
    events = stream_events(spark, f"{flat}/", files_per_trigger=2)
    run = run_ordered(
        events, PairingStep(RULES), "raw", span // 3, numbered=True
    )
    assert run.last_batch() == 4 and run.late().count() == 0
    whole = read_events(spark, flat)
    assert list_files(spark, flat).count() == 10
    want = wire.rows(pair_by_timing(whole, RULES), *PAIRS)
    assert wire.rows(run.drained().filter("event = 'tie'"), *PAIRS) == want
    names = [r.file_name for r in run.ledger().orderBy("file_no").collect()]
    assert names == sorted(names)
    # A file from before all others is late as a whole, and no number changes.
    numbers = {r.file_name: r.file_no for r in run.ledger().collect()}
    first = wire.archive(spark, talk(9, 20)).select("pos", *[f.name for f in wire.WIRE_EVENTS.fields])
    odd = f"{flat}/node.20230101-000000-000.parquet"
    first.coalesce(1).write.parquet(f"{folder}-odd")
    part = next(f for f in os.listdir(f"{folder}-odd") if f.endswith(".parquet"))
    os.link(f"{folder}-odd/{part}", odd)
    again = stream_events(spark, f"{flat}/", files_per_trigger=2)
    run = run_ordered(
        again, PairingStep(RULES), "raw", span // 3, folder=run.folder, numbered=True
    )
    assert run.late().count() == 20
    now = {r.file_name: r.file_no for r in run.ledger().collect()}
    assert now.pop("node.20230101-000000-000.parquet") is None and now == numbers
    assert wire.rows(run.drained().filter("event = 'tie'"), *PAIRS) == want


def test_json_lines_as_a_stream(spark):
    rows = [{k: v for k, v in r.items() if v is not None} for r in talk(6, 60)]
    folder = shared_folder(spark, "lines")
    os.makedirs(folder)
    for n in (1, 0):
        with open(f"{folder}/node.2024010{n + 1}-000000-000.events", "w") as f:
            part = rows[30 * n : 30 * n + 30]
            f.writelines(json.dumps(r | {"record_no": i}) + "\n" for i, r in enumerate(part))
            f.write("not a record\n")
    events = stream_events(spark, f"{folder}/", "json", files_per_trigger=1)
    run = run_ordered(events, PairingStep(RULES), "lines", 10**9, numbered=True)
    want = wire.rows(pair_by_timing(read_events(spark, folder, "json"), RULES), *PAIRS)
    assert want and wire.rows(run.drained().filter("event = 'tie'"), *PAIRS) == want


def test_peers_and_timeline_over_many_batches(spark):
    rows = talk(2) + [wire.opened(1_700_000_000_000 + 10**7, 1)]
    # The last word on type, network and address comes from different events.
    rows += [wire.opened(1_700_000_000_000 + 10**7, 2) | {"network": 2, "conn_type": "feeler"}]
    rows += [wire.message(1_700_000_000_000 + 10**7, 2, "ping", True) | {"conn_type": None}]
    rows += [wire.misbehaving(1_700_000_000_000 + 10**7, n, "x") for n in (2, 77)]
    whole = wire.archive(spark, rows)
    got = run_updating(spark, stream_peers(events_stream(spark, rows)), "peers", ["peer_id"])
    assert set(got.columns) == set(peer_table(whole).columns)
    assert wire.rows(got) == wire.rows(peer_table(whole), *got.columns)
    counts = stream_timeline(events_stream(spark, rows), 60_000)
    keys = ["bin_start_ms", "event_group", "kind"]
    lines = run_updating(spark, counts, "lines", keys)
    want = whole.groupBy(
        F.expr("ts_ms div 60000 * 60000").alias("bin_start_ms"), "event_group", "kind"
    ).agg(F.count(F.lit(1)).alias("cnt"))
    assert wire.rows(lines, *keys, "cnt") == wire.rows(want, *keys, "cnt")


def test_known_items(spark):
    columns = "item long, pos long, item_no long, ts_ms long, peer_id long, delivery boolean, size long"
    df = spark.createDataFrame(random_race(2, hot=True), columns)
    folder = in_files(df, spark, 3)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)
    items = run_appending(spark, stream_known_items(with_event_time(stream, "1 hour")), "items")
    assert sorted(r.item for r in items.collect()) == sorted({r.item for r in df.collect()})
