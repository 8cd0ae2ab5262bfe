import random

import numpy as np
import pyarrow as pa

from tallywire.llm import words as w

from . import cases


def test_words_of_whole_texts(monkeypatch):
    monkeypatch.setattr(w, "RUN_BYTES", 300)
    rng = random.Random(1)
    texts = [t for _, t in cases.AWKWARD] + [
        cases.prose(rng, rng.randint(0, 30), "aB é\t\n\x0b1") for _ in range(200)
    ]
    array = pa.array([None, *texts, "x"]).slice(1, len(texts))
    seen: dict = {}
    count = 0
    for run in w.Reader().runs(array):
        for i in range(run.lo, run.hi):
            a, b = run.first[i - run.lo : i - run.lo + 2]
            got = [bytes(run.data[s:e]).decode() for s, e in zip(run.starts[a:b], run.ends[a:b], strict=True)]
            assert got == cases.words(texts[i])
            for word, h in zip(got, run.hashes[a:b], strict=True):
                assert seen.setdefault(word, h) == h
            count += 1
    assert count == len(texts) and len(set(seen.values())) == len(seen)


def test_mix_is_one_to_one():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(w.mix(x))) == len(x)


def test_within():
    assert w.within(np.array([2, 0, 3])).tolist() == [0, 1, 0, 1, 2]
    assert w.within(np.array([], dtype=int)).tolist() == []
