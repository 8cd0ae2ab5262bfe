import hashlib
import random

from tallywire.llm.exact_dedup import CuckooIndex, exact_dedup, without_copies

from . import cases


def brute(pairs):
    groups = {}
    for at, (i, t) in enumerate(pairs):
        groups.setdefault(cases.lower(t), []).append((i is not None, i or 0, at, i))
    out = []
    for text, held in groups.items():
        best = max(held)
        for row in held:
            out.append((row[3], best[3], len(held), hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, pairs):
    got = exact_dedup(cases.docs(spark, pairs).repartition(3)).collect()
    assert sorted(map(repr, brute(pairs))) == sorted(
        repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got
    )
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({cases.lower(t) for _, t in pairs})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_awkward(spark):
    check(spark, cases.AWKWARD)


def test_hot_group(spark):
    rng = random.Random(2)
    pairs = [(i, rng.choice(["same", "Same", cases.prose(rng, 3)])) for i in range(600)]
    check(spark, pairs)


def test_empty(spark):
    assert exact_dedup(cases.empty(spark)).count() == 0


def test_rows_that_stay(spark):
    docs = cases.docs(spark, cases.AWKWARD)
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    texts = [cases.lower(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({cases.lower(t) for _, t in cases.AWKWARD})


def test_index_against_a_dict():
    rng, index, live = random.Random(3), CuckooIndex(1), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    # Some share both buckets and the mark, and differ only in what is verified.
    keys += [keys[0][:10] + rng.randbytes(22) for _ in range(6)]
    for step in range(20_000):
        key = rng.choice(keys)
        assert index.get(key) == live.get(key)
        if key in live and rng.random() < 0.5:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            index.insert(key, step)
            live[key] = step
        assert len(index) == len(live)
    assert dict(index.items()) == live
    assert index.mask > 0  # it had to grow
    assert not index.delete(b"?" * 32)
