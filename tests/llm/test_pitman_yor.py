import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywire.llm import pitman_yor as py
from tallywire.llm.pitman_yor import language_scores

from . import cases


def learn(column="doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(7)) != 2


def brute(pairs):
    counts = collections.Counter()
    for i, t in pairs:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*cases.words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in pairs:
        tokens = [*cases.words(t), "\n"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)))
    return out


def check(spark, pairs):
    rows = language_scores(cases.docs(spark, pairs).repartition(3), learn()).collect()
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(pairs)))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    return rows


def text(rng, n):
    """Words that follow each other in a pattern, so that contexts tell something."""
    at, out = rng.randrange(40), []
    for _ in range(n):
        at = (at * 7 + rng.randrange(3)) % 40 if rng.random() < 0.9 else rng.randrange(40)
        out.append(f"w{at}")
    return " ".join(out)


def test_scores(spark):
    rng = random.Random(1)
    rows = check(spark, [(i, text(rng, rng.randint(0, 80))) for i in range(400)])
    unseen = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in unseen) > 0.7 * sum(r.base_score for r in unseen)


def test_awkward(spark):
    check(spark, cases.AWKWARD)
    check(spark, [(i, None) for i in range(30)])


def test_nothing_to_learn_from(spark):
    assert language_scores(cases.empty(spark), learn()).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = check(spark, [(held, "a b")])
    assert rows[0].score == 0 and rows[0].base_score == 0


def test_rare_words_are_contexts(spark):
    """However long the input is, a word that was seen a few times tells what follows it."""
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    pairs = [f"rare{k} next{k}" for k in range(20)]
    swapped = [f"rare{k} next{(k + 1) % 20}" for k in range(20)]
    taught = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2][:61]
    rows = [(i, pairs[at % 20]) for at, i in enumerate(taught[:60])]
    rows += [(taught[60], "filler " * 400_000)]
    rows += [(held[0], " ".join(pairs)), (held[1], " ".join(swapped))]
    scores = {r.doc_id: r.score for r in check(spark, rows)}
    assert scores[held[0]] > scores[held[1]] + 20


def test_numbers_of_contexts_are_only_a_code(spark, monkeypatch):
    """Contexts with and without a number give the same scores but for the samples drawn."""
    rng = random.Random(3)
    rows = [(i, text(rng, 60)) for i in range(300)]
    found = []
    for most in (1000, 20, 0):
        monkeypatch.setattr(py, "CODED", most)
        found.append({r.doc_id: r.score for r in check(spark, rows)})
    for other in found[1:]:
        assert sum(other.values()) == pytest.approx(sum(found[0].values()), rel=0.01)
        assert all(other[i] == pytest.approx(found[0][i], rel=0.05) for i in other)


def test_probabilities_add_up_after_contexts_without_a_number(spark, monkeypatch):
    monkeypatch.setattr(py, "CODED", 20)
    rng = random.Random(2)
    docs = spark.createDataFrame(
        [(i, True, text(rng, 30)) for i in range(120)], "doc_id long, learn boolean, text string"
    )
    counts = py.word_counts(docs)
    vocab = py.vocabulary(counts, 3)
    asked = py.asked_rows(docs, vocab)
    rows = py.total_rows(docs, vocab, py.told_rows(asked, counts, vocab)).collect()
    names = "kind long, id long, x0 double, x1 double, x2 double"
    totals = spark.createDataFrame(rows, names)
    vocab = py.with_totals(vocab, totals)
    blobs = py._dealt(docs, vocab, py.told_rows(asked, counts, vocab, totals), True).collect()
    words = np.array([r.word for r in counts.collect()], dtype=np.int64).view(py.U)
    rare = words[py.found_in(vocab.contexts, words) < 0]
    assert len(rare) and len(vocab.contexts)
    shards: dict = {}
    for b in blobs:
        shards.setdefault(b[0], []).append(tuple(b[1:]))
    held = {}
    for shard, found in shards.items():
        word, context, _ = py.undealt(found)
        known = py.told(found)
        held[shard] = py.seat(vocab, shard, word, context, known), known
    contexts = vocab.context_of(np.concatenate([rare[::4], vocab.contexts[:2]]))
    for context in contexts:
        total = 0.0
        for w in [*words, py.U(12345)]:
            at = int(vocab.shard_of(np.array([w]), np.array([context]))[0])
            s, known = held[at]
            key = np.array([w >> py.U(16)])
            if context < 0 and py.found_in(known.context, np.array([context]))[0] < 0:
                # Nobody asked this shard's part for the context, so its totals are elsewhere.
                known = next(k for _, k in held.values() if context in k.context)
            total += py.predictive(vocab, s, key, np.array([context]), known)[0]
        assert total == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("hot", [1e-3, 0.05, 2.0])
def test_probabilities_add_up(spark, monkeypatch, hot):
    """Over all words and one unknown, after any context; also with words dealt by context."""
    monkeypatch.setattr(py, "HOT_SHARE", hot)
    rng = random.Random(2)
    rows = [(i, True, text(rng, 30)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, learn boolean, text string")
    counts = py.word_counts(docs)
    vocab = py.with_totals(v := py.vocabulary(counts, 3), py.total_rows(docs, v))
    words = np.array([r.word for r in counts.collect()], dtype=np.int64).view(py.U)
    shards: dict = {}
    for _, _, t in rows:
        tokens = [*py.Reader().runs(py.pa.array([t]))][0]
        word, before, at = py.tokens_of(tokens)
        context = vocab.context_of(before)
        for w, c in zip(word, context, strict=True):
            shards.setdefault(place(vocab, w, c), []).append((w >> py.U(16), c))
    seatings = {
        s: py.seat(vocab, s, np.array([w for w, _ in sorted(h)], py.U), np.array([c for _, c in sorted(h)]))
        for s, h in shards.items()
    }
    unknown = py.U(12345)
    for context in [*range(0, len(vocab.contexts), 7), -1]:
        total = 0.0
        for w in [*words, unknown]:
            s = seatings.get(place(vocab, w, context))
            chance = py.predictive(vocab, s, np.array([w >> py.U(16)]), np.array([context]))
            total += chance[0]
        assert total == pytest.approx(1, abs=1e-9)


def place(vocab, word, context):
    """The shard of a token, as it is dealt."""
    by = word
    if py.found_in(vocab.hot, np.array([word]))[0] >= 0:
        by = np.array([context if context >= 0 else -1]).astype(py.U)
        by = py.mix(np.array([word]) ^ py.mix(by))[0]
    return int(by % py.U(vocab.shards))


def test_tables_are_drawn_from_the_conditional():
    """Against seatings counted one by one."""
    c, mass, base, d = 5, 2.5, 0.3, 0.6
    weight = np.zeros(c + 1)
    for labels in itertools.product(range(c), repeat=c):
        sizes, w, t = [], 1.0, 0
        for label in labels:
            if label == len(sizes):
                w *= (mass + d * t) * base
                sizes.append(1)
                t += 1
            elif label < len(sizes):
                w *= sizes[label] - d
                sizes[label] += 1
            else:
                w = 0.0
                break
        weight[t] += w
    rng = np.random.default_rng(1)
    n = 60_000
    got = py.draw_tables(
        rng, py.stirling(d, 8), np.full(n, c), np.full(n, mass), np.full(n, base), d
    )
    assert np.bincount(got, minlength=c + 1) / n == pytest.approx(weight / weight.sum(), abs=0.01)
    # With many customers the limit is close to what the numbers themselves give.
    many = np.full(4000, 900), np.full(4000, 2.0), np.full(4000, 0.4)
    limit = py.draw_tables(rng, py.stirling(d, 8), *many, d)
    whole = py.draw_tables(rng, py.stirling(d, 900), *many, d)
    assert limit.mean() == pytest.approx(whole.mean(), rel=0.1)
    assert limit.std() == pytest.approx(whole.std(), rel=0.2)
