import random

import pytest

from tallywire.operators.keyed import conversation, keyed_ties, pair_by_key
from tallywire.operators.rules import WIRE_RULES, Rule
from tallywire.streaming.keyed import KeyedStep
from tallywire.streaming.ordered import run_ordered

from . import brute, wire
from .test_streaming import SHUFFLED, arriving, files_stream

SHOP = (
    Rule("order", ("parcel", "refusal"), multi=True, window_ms=1000),
    Rule("question", ("answer", "refusal"), window_ms=500),
    Rule("parcel", ("thanks",), optional=True, window_ms=200),
)
COLUMNS = (
    "pos long, ts_ms long, peer_id long, event_group string, kind string, inbound boolean, "
    "keys array<binary>"
)


def turns(spark, rows):
    """(peer, command, inbound, ms, keys)"""
    full = [
        (i, ms, p, "message", c, d, [k.to_bytes(8, "little") for k in keys])
        for i, (p, c, d, ms, keys) in enumerate(rows)
    ]
    return spark.createDataFrame(full, COLUMNS)


def ties(spark, rows, rules=SHOP):
    found = pair_by_key(turns(spark, rows), rules).collect()
    return sorted((r.request_pos, r.reply_pos, r.by_key) for r in found)


def test_rules_of_queues(spark):
    rows = [
        (1, "order", True, 0, [3, 4]),  # 0
        (1, "order", True, 10, [4]),  # 1
        (1, "parcel", False, 20, [4]),  # 2: the older of the two that want 4
        (1, "parcel", False, 30, [4]),  # 3: the other one
        (1, "parcel", False, 40, [4]),  # 4: nobody is left
        (1, "parcel", False, 50, [3]),  # 5
        (2, "question", False, 0, [7]),  # 6
        (2, "answer", True, 5, [7]),  # 7
        (2, "answer", True, 6, [7]),  # 8: answered already
        (3, "question", False, 0, [7]),  # 9
        (3, "answer", False, 5, [7]),  # 10: wrong way
        (3, "answer", True, 900, [7]),  # 11: too late
        (4, "order", True, 0, [9]),  # 12
        (4, "question", True, 100, [8]),  # 13
        (4, "refusal", False, 200, [8, 9]),  # 14: both, the older gets it
        (5, "question", True, 0, []),  # 15
        (5, "answer", False, 100, [6]),  # 16: by order, for nothing was named
        (5, "question", True, 200, [6]),  # 17
        (5, "answer", False, 300, []),  # 18: names nothing, so it cannot be meant
    ]
    want = [(0, 2), (1, 3), (0, 5), (6, 7), (12, 14)]
    assert ties(spark, rows) == sorted([(a, b, True) for a, b in want] + [(15, 16, False)])


def test_a_silence_starts_queues_anew(spark):
    rows = [(1, "question", True, 0, [1]), (1, "question", True, 600, [1]), (1, "answer", False, 650, [1])]
    assert ties(spark, rows) == [(1, 2, True)]


def test_edges_of_former_pages_do_not_matter(spark):
    rows = [(1, "order", True, i, [i]) for i in range(700)]
    rows += [(1, "parcel", False, 800, [i]) for i in range(700)]
    assert ties(spark, rows) == [(i, 700 + i, True) for i in range(700)]


@pytest.mark.parametrize(("seed", "rules"), [(1, SHOP), (2, WIRE_RULES)])
def test_equals_queues_gone_through_one_by_one(spark, seed, rules):
    draw = random.Random(seed)
    commands = sorted({r.request for r in rules} | {c for r in rules for c in r.replies})
    rows, ms = [], 0
    for _ in range(900):
        ms += draw.choice([0, 5, 40, 90, 400 if seed == 1 else 60_000])
        keys = draw.sample(range(6), draw.choice([0, 1, 1, 3]))
        rows.append((draw.randrange(3), draw.choice(commands), draw.random() < 0.5, ms - draw.choice([0, 0, 20]), keys))
    want = brute.keyed([(i, t, p, c, d, set(k)) for i, (p, c, d, t, k) in enumerate(rows)], rules)
    names = ("request_pos", "reply_pos", "rule", "elapsed_ms")
    got = keyed_ties(turns(spark, rows), rules)
    assert wire.rows(got, *names) == sorted(want, key=repr)
    for hot_rows, bits in ((0, 2), (0, 5), (60, 4)):
        split = keyed_ties(turns(spark, rows), rules, hot_rows, bits)
        assert wire.rows(split, *names) == sorted(want, key=repr)
    names = ("request_pos", "reply_pos", "rule", "by_key", "elapsed_ms")
    whole = wire.rows(pair_by_key(turns(spark, rows), rules), *names)
    assert wire.rows(pair_by_key(turns(spark, rows), rules, 0, 3), *names) == whole


@pytest.mark.parametrize("seed", [3, 4])
def test_one_key_in_all_messages(spark, seed):
    """One queue holds everything; its splits begin and end inside runs, and before silences."""
    draw = random.Random(seed)
    rows, ms = [], 0
    for _ in range(600):
        ms += draw.choice([1, 5, 20, 20, 450 if draw.random() < 0.3 else 90])
        asks = draw.random() < (0.5 if seed == 3 else 0.65)
        rows.append((1, "question" if asks else "answer", asks, ms, [1]))
    want = brute.keyed([(i, t, p, c, d, set(k)) for i, (p, c, d, t, k) in enumerate(rows)], SHOP)
    names = ("request_pos", "reply_pos", "rule", "elapsed_ms")
    for bits in (0, 1, 3, 6, 12):
        got = keyed_ties(turns(spark, rows), SHOP, 0, bits)
        assert wire.rows(got, *names) == sorted(want, key=repr)


def test_conversation(spark):
    rows = [
        wire.naming(2000, 5, "getdata", False, 37, [0x1C]),
        wire.naming(2300, 5, "getdata", False, 37, [0x2D]),
        wire.tx(2700, 5, 0x2D, 300),
        wire.message(2750, 6, "getaddr", True),
        wire.tx(2900, 5, 0x1C, 300),
        wire.message(3000, 6, "addr", False),
    ]
    events = wire.archive(spark, rows)
    found = conversation(events, events, 0, 10).orderBy("row").collect()
    assert [(r.request_row, r.elapsed_ms) for r in found] == [
        (None, None), (None, None), (1, 400), (None, None), (0, 900), (3, 250),
    ]
    assert found[0].detail == "1x wtx"
    # On a page that begins after the request, the reply still says what it answers.
    late = conversation(events, events, 3, 10).orderBy("row").collect()
    assert [(r.request_row, r.elapsed_ms) for r in late] == [(None, None), (None, 900), (0, 250)]
    assert late[1].request_pos == found[0].pos


def test_nothing(spark):
    assert ties(spark, [(1, "hello", True, 0, [1])]) == []


@pytest.mark.parametrize("seed", [1, 5])
def test_stream_of_files_out_of_order(spark, seed):
    """The same ties as over the whole archive, with waiting requests carried over batches."""
    draw = random.Random(seed)
    commands = sorted({r.request for r in SHOP} | {c for r in SHOP for c in r.replies})
    rows, ms = [], 0
    for _ in range(500):
        ms += draw.choice([0, 5, 40, 90, 400])
        keys = draw.sample(range(5), draw.choice([0, 1, 1, 3]))
        rows.append((draw.randrange(3), draw.choice(commands), draw.random() < 0.5, ms, keys))
    df = turns(spark, rows)
    folder = arriving(df, spark, 10, SHUFFLED)
    step = KeyedStep(SHOP, **({"hot_rows": 10, "bits": 3} if seed == 1 else {}))
    run = run_ordered(files_stream(spark, folder, df.schema), step, "keyed", ms // 3)
    assert run.last_batch() == 4 and run.late().count() == 0
    names = ("request_pos", "reply_pos", "rule", "by_key", "elapsed_ms")
    want = wire.rows(pair_by_key(df, SHOP), *names)
    assert wire.rows(run.drained(), *names) == want
    early = wire.rows(run.table(), *names)
    assert set(early) <= set(want) and len(early) > len(want) // 3
