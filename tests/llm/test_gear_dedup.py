import random

import numpy as np

from tallywire.llm import gear_dedup as gd
from tallywire.llm.gear_dedup import repeated_spans, without_spans

from . import cases


def chunk_texts(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = gd.chunk_ends(data, np.array([0, len(data)]))[0]
    return [text.encode()[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def brute(pairs, least):
    """Spans from the chunks of each text, chunk by chunk."""
    first: dict = {}
    for i, t in pairs:
        for c in chunk_texts(t or ""):
            first[c] = min(i, first.get(c, i))
    out = []
    for i, t in pairs:
        at, run = 0, None
        for c in [*chunk_texts(t or ""), None]:
            if c is not None and first[c] < i:
                run = run or [i, at, 0, 0, first[c]]
                run[2:] = [run[2] + len(c), run[3] + 1, min(run[4], first[c])]
            else:
                if run and run[2] >= least:
                    out.append(tuple(run))
                run = None
            at += len(c or b"")
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [cases.prose(rng, 55, "abcdefghijklmnopqrsté") for _ in range(4)]
    pairs, has = [], {}
    for i in range(120):
        parts = [cases.prose(rng, rng.randint(1, 60), "abcdefghijklmnopqrsté")]
        for s, p in enumerate(shared):
            if rng.random() < 0.15:
                parts += [p, cases.prose(rng, rng.randint(1, 30), "abcdefghijklmnopqrsté")]
                has.setdefault(s, []).append(i)
        pairs.append((i, " ".join(parts)))
    return pairs, has, shared


def test_against_brute_force(spark):
    pairs, has, _ = passages(1)
    got = repeated_spans(cases.docs(spark, pairs).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(pairs, gd.SPAN_BYTES))
    # Every later holder of a passage is found, and nobody else.
    assert {r.doc_id for r in got} == {i for held in has.values() for i in sorted(held)[1:]}


def test_cut_texts(spark):
    pairs, has, shared = passages(2)
    kept = {r.doc_id: r.text for r in without_spans(cases.docs(spark, pairs)).collect()}
    assert len(kept) == len(pairs)
    for s, held in has.items():
        assert [i for i in held if shared[s] in kept[i]] == [min(held)]


def test_chunks_line_up_again():
    rng = random.Random(3)
    text = cases.prose(rng, 400)
    one, two = chunk_texts(text), chunk_texts("inserted, here " + text)
    assert b"".join(two).decode() == "inserted, here " + text
    assert len(set(one) - set(two)) <= 3
    assert all(gd.SHORTEST <= len(c) <= gd.LONGEST for c in one[:-1])
    assert chunk_texts("é" * 500)[0].decode()


def test_awkward(spark):
    pairs = [(i, t) for i, t in cases.AWKWARD]
    got = sorted(tuple(r) for r in repeated_spans(cases.docs(spark, pairs)).collect())
    want = sorted(brute([(i, t) for i, t in pairs if i is not None], gd.SPAN_BYTES))
    assert got == want and {r[0] for r in got} == {11}
    assert repeated_spans(cases.empty(spark)).count() == 0
    assert without_spans(cases.empty(spark)).count() == 0
