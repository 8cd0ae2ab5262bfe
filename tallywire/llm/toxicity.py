"""Toxicity of whole texts by a recurrent network over overlapping windows of words.

A word enters as the embedding of the word, if it is a known one, beside the mean embedding
of its character trigrams, so that new forms of a word are read too. Gated recurrent units
run over a window in both directions, attention weighs their states, and a text scores as
its worst window does. The network is trained in numpy on a bounded sample of labelled
documents; a label says that some window of a text is toxic, so training goes on with the
windows that look worst so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.tables import by_value
from tallywire.llm.words import SIGNS, Reader, Words, mix, within

U = np.uint64
WIDTH, STRIDE = 32, 16  # words of a window, and from one window to the next
HIDDEN, EMBED = 8, 16
TRIGRAMS = 8192
KNOWN_IN = 20  # documents of the sample a known word is in, at least
SAMPLE = 1500  # labelled documents of each class that are learnt from, at most
SAMPLE_CHARS = 20_000  # of a document that is learnt from, at most
EPOCHS, PLAIN_EPOCHS, BATCH, BLOCK = 6, 2, 256, 2048
PER_DOC = 8  # windows of a document in an epoch
RATE, DECAY = 0.01, 0.02
APART = 4  # one of so many documents of the sample sets the scale of scores, unseen before
MARGIN = 0.7  # score from which a document is predicted toxic


# --- windows and features ---


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window; texts without words have none.

    Windows start every STRIDE words, and the last one ends with the text.
    """
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = within(count) * STRIDE
    at = np.minimum(at, np.maximum(n[text] - WIDTH, 0))
    return first[text] + at, np.minimum(n[text], WIDTH), text


def trigrams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of some words, around each of their bytes, and how many each has."""
    lengths = words.ends[which] - words.starts[which]
    place = within(lengths)
    at = np.repeat(words.starts[which], lengths) + place
    last = place == np.repeat(lengths - 1, lengths)
    data, end = words.data, len(words.data) - 1
    before = np.where(place == 0, 256, data[np.maximum(at - 1, 0)])
    after = np.where(last, 256, data[np.minimum(at + 1, end)])
    code = (before.astype(U) * U(257) + data[at]) * U(257) + after.astype(U)
    return (mix(code) % U(TRIGRAMS)).astype(np.int64), lengths


def words_of(texts: list[str]) -> Words:
    """The words of all texts as one run."""
    runs = list(Reader(SIGNS).runs(pa.array(texts, pa.string())))
    shift = np.cumsum([0] + [len(r.data) for r in runs])
    count = np.cumsum([0] + [len(r.starts) for r in runs])
    firsts = [r.first[:-1] + c for r, c in zip(runs, count, strict=False)]
    return Words(
        np.concatenate([r.data for r in runs]),
        np.concatenate([r.starts + s for r, s in zip(runs, shift, strict=False)]),
        np.concatenate([r.ends + s for r, s in zip(runs, shift, strict=False)]),
        np.concatenate([r.hashes for r in runs]),
        np.concatenate([*firsts, count[-1:]]),
        0,
        len(texts),
    )


class Lexicon:
    """Distinct words of a run: where the known ones are in the table, and their trigrams."""

    def __init__(self, words: Words, known: np.ndarray) -> None:
        self.hashes, one, self.index = np.unique(
            words.hashes, return_index=True, return_inverse=True
        )
        self.tri, self.lengths = trigrams(words, one)
        at = np.searchsorted(known, self.hashes)
        at[at == len(known)] = 0
        hit = known[at] == self.hashes if len(known) else np.zeros(len(at), dtype=bool)
        self.known = np.where(hit, at + 1, 0)  # row 0 stands for all other words


def indexes(start: np.ndarray, length: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Word numbers of windows, WIDTH each; places after the end of a window are -1."""
    place = np.arange(WIDTH)
    at = np.minimum(start[:, None] + place, max(len(index) - 1, 0))
    return np.where(place < length[:, None], index[at], -1)


# --- network ---


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights as a dict of float32 arrays; [0] runs forwards and [1] backwards."""

    def __init__(self, words: int, rng: np.random.Generator) -> None:
        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN
        self.w = {
            "word": normal(words + 1, EMBED, scale=0.1),
            "tri": normal(TRIGRAMS, EMBED, scale=0.1),
            "into": normal(2, 2 * EMBED, 3 * h, scale=(2 * EMBED) ** -0.5),
            "bias": np.zeros((2, 1, 3 * h), np.float32),
            "round": normal(2, h, 3 * h, scale=h**-0.5),
            "inner": np.zeros((2, 1, h), np.float32),
            "look": normal(2 * h, scale=h**-0.5),
            "out": normal(2 * h, scale=h**-0.5),
            "base": np.zeros(1, np.float32),
        }
        self.w["word"][0] = 0

    def inputs(self, lexicon: Lexicon, which: np.ndarray | None = None) -> np.ndarray:
        """Input rows of words: the word's embedding, and the mean of its trigrams'."""
        ends = np.cumsum(lexicon.lengths)
        begins = ends - lexicon.lengths
        if which is None:
            tri, lengths, known = lexicon.tri, lexicon.lengths, lexicon.known
        else:
            lengths, known = lexicon.lengths[which], lexicon.known[which]
            tri = lexicon.tri[np.repeat(begins[which], lengths) + within(lengths)]
        begins = np.cumsum(lengths) - lengths
        mean = np.add.reduceat(self.w["tri"][tri], begins, axis=0) / lengths[:, None]
        self.last = tri, lengths, known
        return np.concatenate([self.w["word"][known], mean.astype(np.float32)], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates of both directions; the last row is for no word."""
        g = x @ self.w["into"] + self.w["bias"]
        return np.concatenate([g, np.zeros_like(g[:, :1])], axis=1)

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what going backwards needs."""
        h, w = HIDDEN, self.w
        state = np.zeros((2, len(index), h), np.float32)
        states = np.empty((len(index), WIDTH, 2 * h), np.float32)
        there = index >= 0
        whole = bool(there.all())
        kept = []
        for t in range(WIDTH):
            back = WIDTH - 1 - t
            g = np.stack([gates[0][index[:, t]], gates[1][index[:, back]]])
            own = state @ w["round"]
            zr = sigmoid(g[..., : 2 * h] + own[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            inner = own[..., 2 * h :] + w["inner"]
            new = np.tanh(g[..., 2 * h :] + r * inner)
            after = new + z * (state - new)
            mask = None
            if not whole:
                mask = np.stack([there[:, t], there[:, back]])[..., None]
                after = np.where(mask, after, state)
            if keep:
                kept.append((state, z, r, new, inner, mask))
            state = after
            states[:, t, :h] = state[0]
            states[:, back, h:] = state[1]
        look = states @ w["look"]
        if not whole:
            look = np.where(there, look, -1e9)
        look = np.exp(look - look.max(axis=1, keepdims=True))
        look /= look.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", look, states)
        logit = pooled @ w["out"] + w["base"]
        return (logit, (kept, states, look, pooled)) if keep else logit

    def logits(self, gates: np.ndarray, start, length, index) -> np.ndarray:
        """Logits of many windows, short ones apart, a block at a time."""
        out = np.empty(len(start), np.float32)
        for some in (np.flatnonzero(length == WIDTH), np.flatnonzero(length < WIDTH)):
            for lo in range(0, len(some), BLOCK):
                at = some[lo : lo + BLOCK]
                out[at] = self.run(gates, indexes(start[at], length[at], index))
        return out

    def gradients(self, x: np.ndarray, index: np.ndarray, label: np.ndarray) -> dict:
        h, w = HIDDEN, self.w
        gates = self.gates(x)
        logit, (kept, states, look, pooled) = self.run(gates, index, keep=True)
        d_logit = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        grad = {"out": pooled.T @ d_logit, "base": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_look = np.einsum("bth,bh->bt", states, d_pooled)
        d_look = look * (d_look - (look * d_look).sum(axis=1, keepdims=True))
        grad["look"] = np.einsum("bt,bth->h", d_look, states)
        d_states = look[..., None] * d_pooled[:, None] + d_look[..., None] * w["look"]
        d_ins = np.empty((2, len(index), WIDTH, 3 * h), np.float32)
        grad["round"] = np.zeros_like(w["round"])
        grad["inner"] = np.zeros_like(w["inner"])
        d = np.zeros((2, len(index), h), np.float32)
        for t in range(WIDTH - 1, -1, -1):
            back = WIDTH - 1 - t
            state, z, r, new, inner, mask = kept[t]
            d[0] += d_states[:, t, :h]
            d[1] += d_states[:, back, h:]
            d_after = d if mask is None else np.where(mask, d, 0)
            d_new = d_after * (1 - z) * (1 - new * new)
            d_z = d_after * (state - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r], axis=2)
            grad["round"] += state.transpose(0, 2, 1) @ d_own
            grad["inner"] += d_own[..., 2 * h :].sum(axis=1, keepdims=True)
            d_in = np.concatenate([d_z, d_r, d_new], axis=2)
            d_ins[0, :, t], d_ins[1, :, back] = d_in
            passed = d_after * z if mask is None else np.where(mask, d * z, d)
            d = passed + d_own @ w["round"].transpose(0, 2, 1)
        there = index >= 0
        d_gates = np.stack([summed(index[there], d[there], len(x)) for d in d_ins])
        grad["bias"] = d_gates.sum(axis=1, keepdims=True)
        grad["into"] = x.T @ d_gates
        d_x = (d_gates @ w["into"].transpose(0, 2, 1)).sum(axis=0)
        tri, lengths, known = self.last
        grad["word"] = summed(known, d_x[:, :EMBED], len(w["word"]))
        grad["word"][0] = 0
        d_tri = np.repeat(d_x[:, EMBED:] / lengths[:, None], lengths, axis=0)
        grad["tri"] = summed(tri, d_tri, TRIGRAMS)
        return grad


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by number."""
    columns = [np.bincount(at, c, minlength=n) for c in rows.T]
    return np.stack(columns, axis=1).astype(np.float32)


class Adam:
    def __init__(self, weights: dict) -> None:
        self.w = weights
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = 0

    def step(self, grad: dict, rate: float) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m = self.m[k] / (1 - 0.9**self.t)
            v = self.v[k] / (1 - 0.99**self.t)
            self.w[k] -= (rate * (m / (np.sqrt(v) + 1e-6) + DECAY * self.w[k])).astype(np.float32)


# --- training ---


class Model:
    """A trained network, its known words, and the scale of its scores."""

    def __init__(self, network: Network | None, known: np.ndarray, scale: float, shift: float):
        self.network, self.known, self.scale, self.shift = network, known, scale, shift

    def scores(self, words: Words) -> np.ndarray:
        """A score for each text of a run: that of its worst window."""
        worst = np.full(words.hi - words.lo, -np.inf)
        if self.network is not None and len(words.hashes):
            lexicon = Lexicon(words, self.known)
            gates = self.network.gates(self.network.inputs(lexicon))
            start, length, text = windows(words.first)
            np.maximum.at(worst, text, self.network.logits(gates, start, length, lexicon.index))
        low = -8.0 if self.network is not None else 0.0
        logit = np.where(np.isfinite(worst), self.scale * worst + self.shift, low)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(
    texts: list[str], toxic: np.ndarray, prior: float | None = None, seed: int = 1
) -> Model:
    """Fit a model; without texts of both classes every score is one half.

    ``prior`` is the share of toxic documents that scores are meant for, if the sample's is
    another. One of APART texts only sets the scale, unless that leaves a class out.
    """
    nothing = np.empty(0, dtype=U)
    if not (toxic.any() and (~toxic).any()):
        return Model(None, nothing, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    words = words_of(texts)
    pairs = np.unique(np.stack([words.hashes, words.text_of.astype(U)]), axis=1)
    known, held = np.unique(pairs[0], return_counts=True)
    known = known[held >= KNOWN_IN]
    lexicon = Lexicon(words, known)
    network = Network(len(known), rng)
    adam = Adam(network.w)
    start, length, text = windows(words.first)
    if not len(start):
        return Model(None, nothing, 1.0, 0.0)
    apart = np.arange(len(texts)) % APART == 0
    if toxic[apart].sum() < 8 or (~toxic[apart]).sum() < 8:
        apart[:] = False
    bad, learnt = toxic[text], ~apart[text]
    per_doc = np.bincount(text, minlength=len(texts))

    def some(score: np.ndarray, most: int) -> np.ndarray:
        """The windows of each text with the highest scores, ``most`` at the most."""
        order = np.lexsort((-score, text))
        order = order[within(per_doc) < most]
        return order[learnt[order]]

    # At least some hundred steps, also for a small sample.
    rounds = max(1, min(8, 24_000 // len(start)))
    for epoch in range(EPOCHS * rounds):
        chance = rng.random(len(start))
        if epoch < PLAIN_EPOCHS * rounds:
            use = some(chance, PER_DOC)
        else:
            gates = network.gates(network.inputs(lexicon))
            score = network.logits(gates, start, length, lexicon.index)
            good = ~bad
            top, top2 = some(score, 1), some(score, PER_DOC // 2)
            use = np.concatenate(
                [top[bad[top]], top2[good[top2]], (r := some(chance, PER_DOC // 2))[good[r]]]
            )
            use = np.concatenate([use, np.flatnonzero(bad & learnt & (score > 2))])
        use = rng.permutation(np.unique(use))
        rate = RATE * (1 - epoch / (EPOCHS * rounds + 1))
        for lo in range(0, len(use), BATCH):
            at = use[lo : lo + BATCH]
            index = indexes(start[at], length[at], lexicon.index)
            which, index2 = np.unique(index, return_inverse=True)
            index2 = index2.reshape(index.shape)
            if which[0] < 0:
                which, index2 = which[1:], index2 - 1
            x = network.inputs(lexicon, which)
            drop = rng.random(len(which)) < 0.3  # read some known words by their letters alone
            x[drop, :EMBED] = 0
            label = np.where(bad[at], 1.0, 0.0).astype(np.float32)
            grad = network.gradients(x, index2, label)
            adam.step(grad, rate)
    gates = network.gates(network.inputs(lexicon))
    score = network.logits(gates, start, length, lexicon.index)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, text, score)
    fit = apart if apart.any() else ~apart
    prior = toxic.mean() if prior is None else prior
    scale, shift = calibrated(worst[fit], toxic[fit], prior)
    network.last = None
    return Model(network, known, scale, shift)


def calibrated(worst: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression on the texts that have windows.

    Classes weigh as ``prior`` has it; targets are smoothed, so that separable scores stay
    finite.
    """
    use = np.isfinite(worst)
    x, y = worst[use], toxic[use]
    n1, n0 = max(1, y.sum()), max(1, (~y).sum())
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y, prior / n1, (1 - prior) / n0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - target) * x), np.sum(weight * (p - target))])
        q = weight * p * (1 - p)
        hess = np.array([[np.sum(q * x * x), np.sum(q * x)], [np.sum(q * x), np.sum(q)]])
        step = np.linalg.solve(hess + 1e-4 * np.eye(2), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


# --- operator ---


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label may only be used to test: a third of all."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def toxicity_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """A model from SAMPLE documents of each class, chosen by the hash of their id.

    Only labels 0 and 1 of documents that are not held out count, and only texts of up to
    SAMPLE_CHARS characters, so what the driver gets is bounded.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("id"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = [
        rows.filter(F.col("toxic") == c).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        for c in (0, 1)
    ]
    chosen = chosen[0].union(chosen[1])  # at most 2 * SAMPLE rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.filter(F.col("id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    sample = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id", "toxic"]).collect()
    sample.sort(key=lambda r: (r["id"], r["toxic"]))
    toxic = np.array([r["toxic"] == 1 for r in sample], bool)
    return train([r["text"] for r in sample], toxic, prior)


def toxicity_score(model: Model, docs: DataFrame) -> Callable[[Column | str], Column]:
    """A function from a column of texts to a column of scores."""
    held = by_value(docs.sparkSession, model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(SIGNS)
        for texts in batches:
            runs = [held().scores(run) for run in reader.runs(texts)]
            yield pa.array(np.concatenate([*runs, np.empty(0)]))

    return score


def toxicity(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, score, predicted.

    The score is that of the text's worst window of WIDTH words; every word is in one, and
    most are in two. A text without words, or null, is as good as certainly clean. Rows that
    repeat or lack a doc_id are scored like any other. No rows give no rows.
    """
    score = toxicity_score(model, docs)
    scored = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        score(F.col(text_col).cast("string")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= MARGIN).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return docs.filter(toxicity_score(model, docs)(docs[text_col].cast("string")) < MARGIN)
