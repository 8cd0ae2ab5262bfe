import hashlib
from fractions import Fraction

from tallywire.llm.mixing import in_mixed_order, mix_sources, period, whole_parts

from . import cases


def docs(spark, pairs):
    return spark.createDataFrame(
        [(i, f"t{i}", s, 1, 2) for i, s in pairs], "doc_id long, text string, source string, run int, n int"
    )


PAIRS = [(i, "big") for i in range(300)] + [(1000 + i, "mid") for i in range(90)]
PAIRS += [(2000 + i, "tiny") for i in range(7)] + [(3000, None)]
WEIGHTS = {"big": 5, "mid": 3, "tiny": 1.5, None: 0.5}


def brute(pairs, parts):
    """Slot after slot: of all sources the released block with the earliest deadline."""
    queues = {}
    for i, s in sorted(pairs, key=lambda p: (hashlib.md5(str(p[0]).encode()).hexdigest(), p[0])):
        queues.setdefault(s, []).append(i)
    out, begin, placed = [], 0, dict.fromkeys(queues, 0)
    while any(queues.values()):
        live = [s for s in queues if queues[s]]
        q = sum(parts[s] for s in live)
        slot = len(out) - begin
        ready = []
        for s in live:
            k, share = placed[s], Fraction(parts[s], q)
            if k / share // 1 <= slot:
                ready.append((-(-(k + 1) / share // 1), str(s), s))
        s = min(ready)[2]
        out.append(queues[s].pop(0))
        placed[s] += 1
        if not queues[s]:
            begin, placed = len(out), dict.fromkeys(queues, 0)
    return out


def test_against_a_schedule_slot_by_slot(spark):
    got = mix_sources(docs(spark, PAIRS).repartition(5), weights=WEIGHTS).collect()
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(PAIRS)))
    assert [r.doc_id for r in got] == brute(PAIRS, whole_parts(WEIGHTS))


def test_less_than_a_block_away(spark):
    got = sorted(mix_sources(docs(spark, PAIRS), weights=WEIGHTS).collect(), key=lambda r: r.slot)
    seen = dict.fromkeys(WEIGHTS, 0)
    for r in got:
        seen[r.source] += 1
        if any(seen[s] == sum(x == s for _, x in PAIRS) for s in seen):
            break  # the first source has run out
        for s, n in seen.items():
            assert abs(n - (r.slot + 1) * Fraction(whole_parts(WEIGHTS)[s], 1000)) < 1


def test_period():
    parts = whole_parts({"a": 0.37, "b": 0.33, "c": 0.2999, "d": 0.0001})
    slots = period(parts)
    q = sum(parts.values())
    assert sorted(x for s in slots.values() for x in s) == list(range(q)) and q == 1000
    for s, a in parts.items():
        for k, slot in enumerate(slots[s]):
            assert k * q // a <= slot < -(-(k + 1) * q // a)


def test_blocks(spark):
    got = mix_sources(docs(spark, PAIRS), weights=WEIGHTS, block=4).collect()
    assert len({r.position for r in got}) == len(PAIRS)
    assert all(r.position // 4 == r.slot for r in got)


def test_layout_and_awkward_rows(spark):
    pairs = [*PAIRS, (None, "big"), (None, None), (5, "big"), (5, "mid")]
    rows = docs(spark, pairs)
    assert mix_sources(rows).count() == len(pairs)
    mixed = in_mixed_order(rows)
    assert mixed.columns == rows.columns
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, rows.collect()))
    once = docs(spark, PAIRS)
    order = sorted(mix_sources(once).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in in_mixed_order(once).collect()] == [r.doc_id for r in order]


def test_the_schedule_takes_no_python_worker(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "doc_id long, source string")
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "of_source" in plan and "ExistingRDD" not in plan


def test_empty(spark):
    assert mix_sources(cases.empty(spark)).count() == 0
    assert in_mixed_order(cases.empty(spark)).count() == 0
