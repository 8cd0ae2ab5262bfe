import random

import pytest

from tallywire.llm import signature_join as sj
from tallywire.llm.components import components
from tallywire.llm.signature_join import near_duplicates, one_of_each

from . import cases


def shingles(text, width):
    w = cases.words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(pairs, width, share):
    sets = [(i, shingles(t, width)) for i, t in pairs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (ia, sa) in enumerate(sets):
        for b, (ib, sb) in enumerate(sets[:a]):
            if sa and sb and None not in (ia, ib):
                if 100 * len(sa & sb) >= share * len(sa | sb):
                    up[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[root(a)] = min(i, low.get(root(a), i))
    return [(i, len(s), None if i is None else low[root(a)]) for a, (i, s) in enumerate(sets)]


def check(spark, pairs, width, share):
    got = near_duplicates(cases.docs(spark, pairs).repartition(3), width=width, share=share)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(pairs, width, share)))


def families(rng, count, most):
    """Documents and changed copies of them, some just above and some just below the line."""
    pairs = []
    for _ in range(count):
        base = cases.prose(rng, rng.choice([1, 2, 4, 9, 12, 40, 90, 200])).split()
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(copy))
                change = rng.choice(["put", "cut", "add"])
                copy[at : at + (change != "add")] = [] if change == "cut" else [cases.prose(rng, 1)]
                copy = copy or ["a"]
            pairs.append((len(pairs) * 3 + 1, " ".join(copy)))
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize(("width", "share"), [(3, 90), (5, 80)])
def test_random_families(spark, width, share):
    check(spark, families(random.Random(width), 60, 6), width, share)


def test_awkward(spark):
    check(spark, cases.AWKWARD, 3, 90)


def test_large_family_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sj, "CHUNK", 8)
    rng = random.Random(5)
    pairs = families(rng, 1, 1) + families(random.Random(6), 2, 150)
    check(spark, pairs, 3, 90)


def test_chain(spark):
    """Each document is near the next one only; ids run against the chain."""
    base = cases.prose(random.Random(1), 60, "abcdefghijklm").split()
    pairs = []
    for i in range(40):
        base[i % 60] = f"new{i}"
        pairs.append((1000 - i, " ".join(base)))
    check(spark, pairs, 1, 90)


def test_empty(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_one_of_each(spark):
    pairs = families(random.Random(8), 30, 4)
    docs = cases.docs(spark, pairs)
    kept = one_of_each(docs, width=3, share=90)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute(pairs, 3, 90)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(300)] + [(5000, 400 + i) for i in range(200)]
    links += [(1, None), (None, None), (7, 7), (9, 8), (900, 901), (901, 900), (900, 901)]
    rng.shuffle(links)
    got = {(r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {(i, 0) for i in range(301)} | {(400 + i, 400) for i in range(200)}
    assert got == want | {(5000, 400), (900, 900), (901, 900)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
