import random

import numpy as np
import pyarrow as pa
import pytest

from tallywire.llm import toxicity as tx
from tallywire.llm.toxicity import held_out, toxicity, toxicity_model, train, without_toxic
from tallywire.llm.words import SIGNS, Reader

from . import cases


def corpus(n, seed):
    """Toxic texts have one of a few words, or a new word that begins like them."""
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = cases.prose(rng, rng.randint(3, 120), "abcdefghij").split()
        bad = i % 3 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            new = "zuxw" + cases.prose(rng, 1)
            words.insert(rng.randint(0, len(words)), rng.choice(["krumt", "Krumt!", new]))
        texts.append(" ".join(words))
        toxic.append(bad)
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model():
    return train(*corpus(600, 1))


def scores(model, texts):
    runs = Reader(SIGNS).runs(pa.array(texts, pa.string()))
    return np.concatenate([model.scores(run) for run in runs])


def test_unseen_texts(model):
    texts, toxic = corpus(600, 2)
    found = scores(model, texts)
    assert np.mean((found >= tx.MARGIN) == toxic) > 0.95
    assert found[toxic].mean() > found[~toxic].mean() + 0.5


def test_a_late_window_counts(model):
    clean = cases.prose(random.Random(3), 5000, "abcdefghij")
    low, high = scores(model, [clean, clean + " krumt " + clean[:50]])
    assert high > tx.MARGIN > low


def test_awkward(spark, model):
    got = toxicity(cases.docs(spark, cases.AWKWARD), model).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in cases.AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert next(r for r in got if r.doc_id == 1).score < 0.01
    assert toxicity(cases.empty(spark), model).count() == 0


def test_rows_that_stay(spark, model):
    pairs = [(1, "krumt " * 5), (2, "a b c"), (3, None), (2, "a b c"), (None, "krumt krumt")]
    docs = cases.docs(spark, pairs)
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]


def test_only_labels_that_are_not_held_out_are_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tx, "train", lambda texts, toxic, prior: seen.append((texts, toxic, prior)))
    docs = cases.docs(spark, [(i, f"t{i}") for i in range(60)] + [(0, "t0")])
    labels = [(i, i % 2, i % 4) for i in range(60)] + [(None, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxicity_model(docs, labels)
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).collect()
    texts, toxic, prior = seen[0]
    assert sorted(texts) == sorted(f"t{r.doc_id}" for r in rows)
    assert dict(zip(texts, toxic, strict=True)) == {f"t{r.doc_id}": r.toxic == 1 for r in rows}
    assert prior == np.mean([r.toxic for r in rows])


def test_without_both_classes(spark):
    for texts, toxic in (([], []), (["a"], [True]), (["", " "], [True, False])):
        model = train(texts, np.array(toxic, dtype=bool))
        assert set(scores(model, ["a b", None])) == {0.5}


def test_gradients():
    """Every weight's gradient against a difference quotient."""
    rng = np.random.default_rng(1)
    words = Reader(SIGNS).words(np.frombuffer(b"ab cd ab efg hi cd ab", np.uint8), np.array([0, 21]), 0)
    lexicon = tx.Lexicon(words, np.sort(words.hashes[:2]))
    net = tx.Network(2, rng)
    net.w = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.w.items()}
    index = tx.indexes(np.array([0, 3]), np.array([7, 4]), lexicon.index)
    label = np.array([1.0, 0.0])

    def loss():
        logit = net.run(net.gates(net.inputs(lexicon)), index).astype(np.float64)
        p = tx.sigmoid(logit)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    grad = net.gradients(net.inputs(lexicon), index, label)
    for k, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = net.w[k][at]
        net.w[k][at] = kept + 1e-2
        up = loss()
        net.w[k][at] = kept - 1e-2
        down = loss()
        net.w[k][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4), k


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 47, 48, 49, 200):
        start, length, text = tx.windows(np.array([0, 0, n, n]))
        assert set(text) == {1} and (start + length).max() == n and start.min() == 0
        covered = np.zeros(n, int)
        for s, k in zip(start, length, strict=True):
            covered[s : s + k] += 1
        assert covered.min() >= 1
