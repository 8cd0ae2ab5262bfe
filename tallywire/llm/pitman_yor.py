"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word is the context of a restaurant whose dishes are the words that follow it. All these
restaurants share one parent, over single words. A customer of a context is a token of the
training documents; a table opened for a dish sends one customer to the parent, whose own base
is uniform over the words and one unknown.

Seating is sampled by blocked Gibbs: given everything else, how many tables a dish with ``c``
customers has in a restaurant is drawn from its exact conditional, by generalised Stirling
numbers, and the predictive probabilities of several samples are averaged. Words are dealt to
shards, so that all restaurants' tables for a word are in one task; a word with more than a
thousandth of all tokens is dealt on by context. Within a sweep a task takes totals over all
words from its own share of them. A first job adds the samples' tables up, and a second one
draws the same samples again and scores with the exact totals, so probabilities add up to 1.

Frequent contexts travel as short numbers and their totals are broadcast. The others travel as
their hash; which of them a shard meets is asked for by context, and their totals are sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.llm.tables import by_value
from tallywire.llm.words import Reader, mix, signed
from tallywire.plans.sizes import settled

U = np.uint64
DISCOUNT, STRENGTH = 0.8, 1.0  # of context restaurants
TOP_DISCOUNT, TOP_STRENGTH = 0.8, 1.0  # of the parent
BURN_IN, SAMPLES = 2, 3
CODED = (1 << 16) - 2  # contexts that have a number, the most frequent ones
HOT_SHARE = 1e-3  # of training tokens from which a word is dealt on by context
EXACT = 1024  # customers of a dish up to which Stirling numbers are used as they are
HELD = 2_000_000  # tokens a task gathers before it deals them
END = int(mix(np.array([0x454E44], dtype=U))[0])  # the end of a text, as a word
KEY_BITS = 48
KEY = U((1 << KEY_BITS) - 1)
SIGN = U(1 << 63)


# --- tokens ---


def tokens_of(run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts, each text with its END; the word before each; the text.

    What stands before a text's first word is an END, too.
    """
    n = np.diff(run.first)
    total = len(run.hashes) + len(n)
    ends = np.cumsum(n + 1) - 1
    word = np.empty(total, dtype=U)
    is_end = np.zeros(total, dtype=bool)
    is_end[ends] = True
    word[is_end] = U(END)
    word[~is_end] = run.hashes
    text = np.repeat(np.arange(len(n)), n + 1)
    before = np.empty(total, dtype=U)
    before[1:] = word[:-1]
    first = np.zeros(total, dtype=bool)
    first[ends - n] = True
    before[first] = U(END)
    return word, before, text


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of the training tokens: word, n. Columns of ``docs``: doc_id, learn, text."""

    def read(batches):
        reader, held, n = Reader(), [], 0

        def out():
            word, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(word)), pa.array(count)], ["word", "n"]
            )

        for batch in batches:
            learn = np.array(batch.column(1).to_pylist(), dtype=bool)
            for run in reader.runs(batch.column(2)):
                word, _, text = tokens_of(run)
                held.append(word[learn[run.lo : run.hi][text]])
                n += len(held[-1])
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    rows = docs.mapInArrow(read, "word bigint, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals of the training tokens, frequent contexts, and hot words; bounded in size."""

    tokens: int
    words: int
    contexts: np.ndarray  # word numbers, sorted
    context_n: np.ndarray
    hot: np.ndarray  # word numbers, sorted
    hot_n: np.ndarray
    shards: int
    # Exact totals of each sample, known after the first job.
    tables: np.ndarray | None = None  # (SAMPLES, contexts)
    top_customers: np.ndarray | None = None
    top_tables: np.ndarray | None = None
    hot_customers: np.ndarray | None = None  # (SAMPLES, hot)
    hot_top: np.ndarray | None = None

    def context_of(self, word: np.ndarray) -> np.ndarray:
        """Numbers of frequent contexts; of others the hash, with the sign that makes it negative."""
        return np.where(
            (at := found_in(self.contexts, word)) >= 0, at, (word | SIGN).view(np.int64)
        )

    def shard_of(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        place = word
        if len(self.hot):
            hot = found_in(self.hot, word) >= 0
            place = np.where(hot, mix(word ^ mix(context.astype(U))), word)
        return place % U(self.shards)


def found_in(sorted_words: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where words are in a sorted array, or -1."""
    if not len(sorted_words):
        return np.full(len(word), -1)
    at = np.searchsorted(sorted_words, word)
    at[at == len(sorted_words)] = 0
    return np.where(sorted_words[at] == word, at, -1)


def vocabulary(counts: DataFrame, shards: int) -> Vocabulary:
    """What tasks need of all counts: those of at most CODED words."""
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 64)
    lowest, room = 1 << 20, CODED
    for at, held in sorted(counts.groupBy(level).count().collect(), reverse=True):
        if held > room:
            break
        lowest, room = at, room - held
    rows = counts.filter(level >= lowest).collect()
    word = np.array([r["word"] for r in rows], dtype=np.int64).view(U)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    hot = n >= HOT_SHARE * tokens
    return Vocabulary(tokens, words, word, n, word[hot], n[hot], shards)


# --- dealing tokens to shards ---


class Dealer:
    """Packs tokens by shard: words once each, and per token its context and text."""

    def __init__(self, vocab: Vocabulary, with_texts: bool) -> None:
        self.vocab, self.with_texts = vocab, with_texts
        self.held: list[tuple] = []
        self.ids: list[pa.Array] = []
        self.n, self.base, self.texts = 0, 0, 0

    def add(self, word, context, text, learn, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """``text`` counts from 0 in this run, whose texts have ``ids``."""
        self.held.append((word, context, (self.texts + text) * 2 + learn))
        self.ids.append(ids)
        self.texts += len(ids)
        self.n += len(word)
        if self.n >= HELD:
            yield from self.deal()

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        word, context, text = (np.concatenate(x) for x in zip(*self.held, strict=True))
        shard = self.vocab.shard_of(word, context)
        key = (shard << U(KEY_BITS)) | (word >> U(64 - KEY_BITS))
        order = np.argsort(key, kind="stable")
        key, context, text = key[order], context[order], text[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(new)
        kinds = key[begins]
        counts = np.diff(np.append(begins, len(key))).astype(np.uint32)
        shard = (kinds >> U(KEY_BITS)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        coded = narrowed(np.maximum(context + 1, 0))
        text = narrowed(text) if self.with_texts else None
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = slice(begins[lo], begins[hi] if hi < len(begins) else len(key))
            rows.append(
                (
                    int(shard[lo]),
                    self.base,
                    (kinds[lo:hi] & KEY).tobytes(),
                    narrowed(counts[lo:hi]).tobytes(),
                    coded[at].tobytes(),
                    (few := context[at])[few < 0].tobytes(),
                    text[at].tobytes() if self.with_texts else b"",
                )
            )
        if self.with_texts:
            # The ids of the texts go along, to shards below zero.
            ids = pa.concat_arrays(self.ids)
            known = np.array(ids.is_valid().to_pylist(), dtype=np.uint8).tobytes()
            raw = ids.fill_null(0).to_numpy().astype(np.int64).tobytes()
            rows.append((-1 - self.base % 1_000_003, self.base, raw, known, b"", b"", b""))
        names = ["shard", "base", "words", "counts", "contexts", "rare", "texts"]
        types = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )
        self.base += self.texts
        self.held, self.ids, self.n, self.texts = [], [], 0, 0


DEALT = (
    "shard bigint, base bigint, words binary, counts binary, contexts binary, rare binary, "
    "texts binary"
)
TOLD = -1  # base of rows that bring a shard the totals of contexts


def narrowed(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64)
    return x.astype(next(k for k in kinds if most <= np.iinfo(k).max))


def widened(raw: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // n]
    return np.frombuffer(raw, dtype=kind).astype(np.int64)


def undealt(blobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Words (without shard), contexts and texts (twice the number, and whether learnt)."""
    words, contexts, texts = [], [], []
    blobs = sorted((b for b in blobs if b[0] != TOLD), key=lambda b: b[0])
    for base, word, count, context, rare, text in blobs:
        word = np.frombuffer(word, dtype=U)
        count = widened(count, len(word))
        n = int(count.sum())
        words.append(np.repeat(word, count))
        contexts.append(widened(context, n) - 1)
        contexts[-1][contexts[-1] < 0] = np.frombuffer(rare, dtype=np.int64)
        if text:
            texts.append(widened(text, n) + 2 * base)
    if not words:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    both = np.concatenate(words), np.concatenate(contexts)
    return (*both, np.concatenate(texts) if texts else None)


def by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """Blobs of each shard, in an order that does not depend on how they arrived."""
    shards: dict[int, list[tuple]] = {}
    for batch in batches:
        for shard, *blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            shards.setdefault(shard, []).append(tuple(blob))
    return shards


# --- totals of contexts that are not broadcast ---


@dataclass
class Totals:
    """Training tokens after contexts, and tables of each sample; contexts sorted."""

    context: np.ndarray
    n: np.ndarray
    tables: np.ndarray  # (SAMPLES, contexts)

    def of(self, vocab: Vocabulary, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and tables of any contexts; none where nothing was learnt."""
        n = np.zeros(len(context), dtype=np.int64)
        tables = np.zeros((SAMPLES, len(context)))
        coded = np.flatnonzero((context >= 0) & (len(vocab.contexts) > 0))
        n[coded] = vocab.context_n[context[coded]]
        if vocab.tables is not None:
            tables[:, coded] = vocab.tables[:, context[coded]]
        at = found_in(self.context, context)
        known = np.flatnonzero(at >= 0)
        n[known] = self.n[at[known]]
        tables[:, known] = self.tables[:, at[known]]
        return n, tables


NOTHING = Totals(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((SAMPLES, 0)))
PARTS = "part bigint, kind int, contexts binary, held binary"


def told(blobs: list[tuple]) -> Totals:
    """What the rows that were sent to a shard say."""
    found = [b for b in blobs if b[0] == TOLD]
    if not found:
        return NOTHING
    context = [np.frombuffer(b[1], dtype=np.int64) for b in found]
    n = [widened(b[2], len(c)) for b, c in zip(found, context, strict=True)]
    tables = [
        widened(b[3], SAMPLES * len(c)).reshape(SAMPLES, -1)
        if b[3]
        else np.zeros((SAMPLES, len(c)), dtype=np.int64)
        for b, c in zip(found, context, strict=True)
    ]
    context = np.concatenate(context)
    order = np.argsort(context)
    return Totals(
        context[order], np.concatenate(n)[order], np.concatenate(tables, axis=1)[:, order]
    )


def part_of(context: np.ndarray, shards: int) -> np.ndarray:
    return (mix(context.view(U)) % U(shards)).astype(np.int64)


def _parted(kind: int, shards: int, context: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the contexts, with what is held of them (rows of ``held``)."""
    part = part_of(context, shards)
    order = np.argsort(part, kind="stable")
    part, context, held = part[order], context[order], held[:, order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    rows = [
        (int(part[lo]), kind, context[lo:hi].tobytes(), narrowed(held[:, lo:hi]).tobytes())
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)
        if hi > lo
    ]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        ["part", "kind", "contexts", "held"],
    )


def asked_rows(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Which contexts without a number a shard meets, by parts of the contexts."""
    held_vocab = by_value(docs.sparkSession, vocab)

    def ask(batches):
        vocab = held_vocab()
        reader, held, n = Reader(), [], 0

        def out():
            context, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            new = first_of(context, shard)
            return _parted(0, vocab.shards, context[new], shard[None, new])

        for batch in batches:
            for run in reader.runs(batch.column(2)):
                word, before, _ = tokens_of(run)
                context = vocab.context_of(before)
                rare = context < 0
                word, context = word[rare], context[rare]
                held.append((context, vocab.shard_of(word, context).astype(np.int64)))
                n += len(word)
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return docs.mapInArrow(ask, PARTS)


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Where the distinct rows are, sorted by the last column, then the one before."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= np.diff(column[order]) != 0
    return order[new]


def told_rows(
    asked: DataFrame, counts: DataFrame, vocab: Vocabulary, totals: DataFrame | None = None
) -> DataFrame:
    """Totals of the contexts without a number, as rows for the shards that asked for them.

    ``counts`` has the training tokens, ``totals`` the tables of each sample, if known.
    """
    shards, contexts = vocab.shards, vocab.contexts

    def count(batches):
        for batch in batches:
            word = batch.column(0).to_numpy().view(U)
            rare = found_in(contexts, word) < 0
            yield _parted(
                1, shards, (word[rare] | SIGN).view(np.int64), batch.column(1).to_numpy()[None, rare]
            )

    def table(batches):
        for batch in batches:
            held = np.stack([c.to_numpy() for c in batch.columns[1:]]).astype(np.int64)
            yield _parted(2, shards, batch.column(0).to_numpy(), held)

    rows = asked.unionAll(counts.select("word", "n").mapInArrow(count, PARTS))
    if totals is not None:
        tables = totals.filter("kind = 4").select("id", *[f"x{s}" for s in range(SAMPLES)])
        rows = rows.unionAll(tables.mapInArrow(table, PARTS))

    def tell(batches):
        # All parts of a task together, so that a shard gets one row from each task.
        asked, counted, seated = found = [], [], []
        for batch in batches:
            for kind, *held in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                found[kind].append(held)
        if asked and counted:
            context, shard = _gathered(asked, 1)
            new = first_of(context, shard[0])
            context, shard = context[new], shard[0][new]
            of, n = _gathered(counted, 1)
            order = np.argsort(of)
            at = found_in(of[order], context)
            context, shard = context[at >= 0], shard[at >= 0]
            n = n[0][order][at[at >= 0]]
            tables = np.zeros((SAMPLES, len(context)), dtype=np.int64)
            if seated:
                of, x = _gathered(seated, SAMPLES)
                order = np.argsort(of)
                at = found_in(of[order], context)
                tables = np.where(at >= 0, x[:, order][:, at], 0)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            rows = [
                (
                    int(shard[lo]),
                    TOLD,
                    context[lo:hi].tobytes(),
                    narrowed(n[lo:hi]).tobytes(),
                    narrowed(tables[:, lo:hi]).tobytes() if seated else b"",
                    b"",
                    b"",
                )
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)
                if hi > lo
            ]
            if rows:
                names = ["shard", "base", "words", "counts", "contexts", "rare", "texts"]
                types = [pa.int64(), pa.int64()] + [pa.binary()] * 5
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                )

    return rows.repartition(-(-shards // 2), "part").mapInArrow(tell, DEALT)


def _gathered(rows: list, height: int) -> tuple[np.ndarray, np.ndarray]:
    context = [np.frombuffer(c, dtype=np.int64) for c, _ in rows]
    held = [
        widened(h, height * len(c)).reshape(height, -1)
        for c, (_, h) in zip(context, rows, strict=True)
    ]
    return np.concatenate(context), np.concatenate(held, axis=1)


# --- seating ---


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t), c and t up to ``most``."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(1, most + 1)
    for c in range(most):
        factor = c - discount * t
        stay = table[c, 1:] + np.log(np.where(factor > 0, factor, 1))
        stay = np.where(factor > 0, stay, -np.inf)
        table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


def draw_tables(
    rng: np.random.Generator,
    table: np.ndarray,
    customers: np.ndarray,
    mass: np.ndarray,
    base: np.ndarray,
    discount: float,
) -> np.ndarray:
    """Tables of each dish: ``customers`` of it, given that the other dishes' tables and the
    strength make ``mass``, and its probability ``base`` in the parent.

    Up to EXACT customers the conditional is used as it is. With more, the Stirling numbers
    take the form they have for many customers, which makes it a negative binomial.
    """
    out = np.minimum(customers, 1)
    exact = len(table) - 1
    base = np.clip(base, 1e-300, 1 - 1e-9)
    order = np.flatnonzero((customers > 1) & (customers <= exact))
    order = order[np.argsort(customers[order], kind="stable")]
    size = customers[order]
    cuts = np.concatenate([np.flatnonzero(np.diff(size, prepend=-1)), [len(size)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        c = int(size[lo])
        step = max(1, 1_000_000 // c)
        for begin in range(lo, hi, step):
            at = order[begin : min(hi, begin + step)]
            open_ = np.log(mass[at, None] + discount * np.arange(c)) + np.log(base[at, None])
            weight = table[c, 1 : c + 1] + np.cumsum(open_, axis=1)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            pick = rng.random(len(at)) * weight[:, -1]
            out[at] = 1 + (weight < pick[:, None]).sum(axis=1)
    large = np.flatnonzero(customers > exact)
    more = rng.negative_binomial(mass[large] / discount + 1, 1 - base[large])
    out[large] = np.minimum(1 + more, customers[large])
    return out


@dataclass
class Seating:
    """Samples for a shard: tables of pairs, and the parent's customers and tables of words."""

    words: np.ndarray
    contexts: np.ndarray  # that words of the shard come after, sorted
    word_of: np.ndarray  # of each pair
    context: np.ndarray  # of each pair, where it is among the contexts
    count: np.ndarray  # of each pair
    tables: np.ndarray  # (SAMPLES, pairs)
    customers: np.ndarray  # (SAMPLES, words)
    top: np.ndarray  # (SAMPLES, words)
    hot: np.ndarray  # where a word is among the hot ones, or -1


def seat(
    vocab: Vocabulary, shard: int, word: np.ndarray, context: np.ndarray, known: Totals = NOTHING
) -> Seating:
    """Sample the seating of a shard's training tokens. The same tokens give the same samples.

    ``known`` has the training tokens after contexts that have no number.
    """
    rng = np.random.default_rng([11, shard])
    words, at = np.unique(word, return_inverse=True)
    hot = found_in(vocab.hot >> U(64 - KEY_BITS), words)
    contexts, context_at = np.unique(context, return_inverse=True)
    context_n, _ = known.of(vocab, contexts)
    pair, count = np.unique(at * (len(contexts) + 1) + context_at, return_counts=True)
    word_of, of = pair // (len(contexts) + 1), pair % (len(contexts) + 1)
    n = np.bincount(at, minlength=len(words))
    base = 1 / (vocab.words + 1)
    low, top_table = stirling(DISCOUNT, EXACT), stirling(TOP_DISCOUNT, EXACT)
    tables = np.minimum(count, 1)
    top = np.minimum(n, 1)
    cold = hot < 0
    # What a hot word weighs in the parent is only known after the first job.
    expected = np.where(cold, 0, vocab.hot_n[hot] if len(vocab.hot) else 0) / max(1, vocab.tokens)
    scale = context_n / np.maximum(np.bincount(of, count, len(contexts)), 1)
    kept = []
    for sweep in range(BURN_IN + SAMPLES):
        customers = np.bincount(word_of, tables, len(words)).astype(np.int64)
        share = customers[cold].sum() / max(1, n[cold].sum())
        all_customers = max(1.0, share * vocab.tokens)
        all_tables = all_customers * top[cold].sum() / max(1, customers[cold].sum())
        mass = np.maximum(TOP_STRENGTH + TOP_DISCOUNT * (all_tables - top), TOP_STRENGTH)
        top = draw_tables(rng, top_table, customers, mass, np.full(len(words), base), TOP_DISCOUNT)
        chance = customers - TOP_DISCOUNT * top + (TOP_STRENGTH + TOP_DISCOUNT * all_tables) * base
        chance = np.where(cold, chance / (TOP_STRENGTH + all_customers), expected)
        chance = np.maximum(chance, 1e-300)
        here = np.bincount(of, tables, len(contexts))
        mass = STRENGTH + DISCOUNT * np.maximum(here[of] * scale[of] - tables, 0)
        tables = draw_tables(rng, low, count, mass, chance[word_of], DISCOUNT)
        if sweep >= BURN_IN:
            # The parent's customers are this sample's tables; it is seated for them.
            customers = np.bincount(word_of, tables, len(words)).astype(np.int64)
            mass = np.maximum(TOP_STRENGTH + TOP_DISCOUNT * (all_tables - top), TOP_STRENGTH)
            flat = np.full(len(words), base)
            top = draw_tables(rng, top_table, customers, mass, flat, TOP_DISCOUNT)
            kept.append((tables, customers, top))
    samples = (np.stack(x) for x in zip(*kept, strict=True))
    return Seating(words, contexts, word_of, of, count, *samples, hot)


IDS = 4096  # contexts whose sums travel together


def total_rows(docs: DataFrame, vocab: Vocabulary, known: DataFrame | None = None) -> DataFrame:
    """Sums over all shards of each sample: kind, id, x0, x1, ...

    Kind 0: tables of a context; 1 and 2: customers and tables of the parent, hot words apart;
    3: the parent's customers of a hot word; 4: tables of a context without a number. A shard
    sends a row for each kind and run of IDS, or part of the contexts. ``known`` has told_rows.
    """
    names = [f"x{s}" for s in range(SAMPLES)]
    dealt = _dealt(docs, vocab, known, learn_only=True)

    def add(batches):
        for shard, blobs in by_shard(batches).items():
            word, context, _ = undealt(blobs)
            if not len(word):
                continue
            s = seat(vocab, shard, word, context, told(blobs))
            cold = s.hot < 0
            here = np.stack([np.bincount(s.context, t, len(s.contexts)) for t in s.tables])
            coded = s.contexts >= 0
            sums = np.zeros((SAMPLES, len(vocab.contexts)))
            sums[:, s.contexts[coded]] = here[:, coded]
            parts = [(0, s.contexts[coded], sums)]
            for kind, x in ((1, s.customers), (2, s.top)):
                parts.append((kind, np.zeros(1, int), x[:, cold].sum(axis=1, keepdims=True)))
            hot = np.zeros((SAMPLES, len(vocab.hot)))
            hot[:, s.hot[~cold]] = s.customers[:, ~cold]
            parts.append((3, np.unique(s.hot[~cold]), hot))
            rows = []
            for kind, ids, x in parts:
                for run in np.unique(ids // IDS):
                    at = ids[ids // IDS == run]
                    held = x[:, at].astype(np.float64)
                    rows.append((kind, int(run), at.astype(np.int64).tobytes(), held.tobytes()))
            rare, here = s.contexts[~coded], here[:, ~coded].astype(np.int64)
            parted = _parted(4, vocab.shards, rare, here).to_pylist()
            rows += [(4, r["part"], r["contexts"], r["held"]) for r in parted]
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "run", "ids", "sums"])

    def merge(batches):
        held: dict = {}
        rare: dict = {}
        for batch in batches:
            for kind, run, ids, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 4:
                    rare.setdefault(run, []).append((ids, x))
                    continue
                total = held.setdefault((kind, run), np.zeros((SAMPLES, IDS)))
                seen = held.setdefault((kind, run, "seen"), np.zeros(IDS, dtype=bool))
                at = np.frombuffer(ids, dtype=np.int64) % IDS
                total[:, at] += np.frombuffer(x).reshape(SAMPLES, -1)
                seen[at] = True
        while rare:
            context, x = _gathered(rare.popitem()[1], SAMPLES)
            context, at = np.unique(context, return_inverse=True)
            total = [np.bincount(at, y, len(context)) for y in x]
            columns = [np.full(len(context), 4), context, *total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "id", *names])
        for key, total in held.items():
            if len(key) == 2:
                at = np.flatnonzero(held[(*key, "seen")])
                columns = [np.full(len(at), key[0]), key[1] * IDS + at, *total[:, at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["kind", "id", *names]
                )

    sums = dealt.mapInArrow(add, "kind bigint, run bigint, ids binary, sums binary")
    schema = "kind bigint, id bigint, " + ", ".join(f"{x} double" for x in names)
    return sums.repartition("kind", "run").mapInArrow(merge, schema)


def with_totals(vocab: Vocabulary, totals: DataFrame) -> Vocabulary:
    """The vocabulary with exact totals; rows collected are one per number and hot word."""
    tables = np.zeros((SAMPLES, len(vocab.contexts)))
    sums = np.zeros((3, SAMPLES))
    hot = np.zeros((SAMPLES, len(vocab.hot)))
    for kind, id_, *x in totals.filter("kind < 4").collect():
        if kind == 0:
            tables[:, id_] = x
        elif kind == 3:
            hot[:, id_] = x
        else:
            sums[kind] = x
    vocab.tables, vocab.hot_customers = tables, hot
    vocab.hot_top = np.zeros_like(hot)
    rng, table = np.random.default_rng(12), stirling(TOP_DISCOUNT, EXACT)
    flat = np.full(len(vocab.hot), 1 / (vocab.words + 1))
    for s in range(SAMPLES):
        mass = np.full(len(vocab.hot), TOP_STRENGTH + TOP_DISCOUNT * sums[2, s])
        vocab.hot_top[s] = draw_tables(rng, table, hot[s].astype(int), mass, flat, TOP_DISCOUNT)
    vocab.top_customers = sums[1] + hot.sum(axis=1)
    vocab.top_tables = sums[2] + vocab.hot_top.sum(axis=1)
    return vocab


def predictive(
    vocab: Vocabulary,
    s: Seating,
    word: np.ndarray,
    context: np.ndarray,
    known: Totals = NOTHING,
):
    """Averaged probabilities of tokens; ``known`` has totals of contexts without a number."""
    at = found_in(s.words, word)
    seen = at >= 0
    base = 1 / (vocab.words + 1)
    width = len(s.contexts) + 1
    context, of = np.unique(context, return_inverse=True)
    context_n, context_tables = known.of(vocab, context)
    local = found_in(s.contexts, context)[of]
    pair = found_in(s.word_of * width + s.context, np.where(seen, at, 0) * width + local)
    pair = np.where(seen & (local >= 0), pair, -1)
    total = np.zeros(len(word))
    hot_at = found_in(vocab.hot >> U(64 - KEY_BITS), word)
    for i in range(SAMPLES):
        customers, tables = s.customers[i], s.top[i]
        rest = (TOP_STRENGTH + TOP_DISCOUNT * vocab.top_tables[i]) * base
        all_ = TOP_STRENGTH + vocab.top_customers[i]
        top = (np.append(customers - TOP_DISCOUNT * tables, 0) + rest) / all_
        chance = top[at]  # -1, a word without customers, is the last entry
        if len(vocab.hot):
            # A hot word's customers are in many shards, and may not be in this one.
            own = vocab.hot_customers[i] - TOP_DISCOUNT * vocab.hot_top[i]
            chance = np.where(hot_at >= 0, (own[hot_at] + rest) / all_, chance)
        mass = STRENGTH + DISCOUNT * context_tables[i]
        own = np.append(s.count - DISCOUNT * s.tables[i], 0)[pair]
        total += (own + mass[of] * chance) / (STRENGTH + context_n[of])
    return total / SAMPLES


# --- operator ---


def _dealt(
    docs: DataFrame, vocab: Vocabulary, known: DataFrame | None, learn_only: bool
) -> DataFrame:
    held = by_value(docs.sparkSession, vocab)

    def read(batches):
        from pyspark import TaskContext

        reader, dealer = Reader(), Dealer(held(), with_texts=not learn_only)
        dealer.base = TaskContext.get().partitionId() << 33
        for batch in batches:
            learn = np.array(batch.column(1).to_pylist(), dtype=bool)
            for run in reader.runs(batch.column(2)):
                word, before, text = tokens_of(run)
                learnt = learn[run.lo : run.hi]
                if learn_only:
                    use = learnt[text]
                    word, before, text = word[use], before[use], text[use]
                context = held().context_of(before)
                ids = batch.column(0).slice(run.lo, run.hi - run.lo)
                yield from dealer.add(word, context, text, learnt[text], ids)
        yield from dealer.deal()

    rows = docs.mapInArrow(read, DEALT)
    rows = rows if known is None else rows.unionAll(known)
    return rows.repartition(-(-vocab.shards // 2), "shard")


def _scores(docs: DataFrame, vocab: Vocabulary, known: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_tokens, n_known, base_score, score.

    A shard sends a row for each run of texts that a task dealt, with the texts' sums.
    """
    held = by_value(docs.sparkSession, vocab)
    dealt = _dealt(docs, vocab, known, learn_only=False)
    names = ["base", "ids", "known", "texts", "counts", "sums"]

    def score(batches):
        vocab = held()
        shards = by_shard(batches)
        for shard in sorted(shards):
            rows = []
            blobs = shards.pop(shard)
            if shard < 0:
                rows = [(b[0], b[1], b[2], b"", b"", b"") for b in blobs]
            else:
                word, context, text = undealt(blobs)
                totals, bases = told(blobs), np.array(sorted({b[0] for b in blobs} - {TOLD}))
                del blobs
                learnt = text % 2 > 0
                s = seat(vocab, shard, word[learnt], context[learnt], totals)
                chance = predictive(vocab, s, word, context, totals)
                n = np.bincount(found_in(s.words, word[learnt]), minlength=len(s.words))
                count = np.append(n, 0)[found_in(s.words, word)]
                hot_at = found_in(vocab.hot >> U(64 - KEY_BITS), word)
                if len(vocab.hot):
                    count = np.where(hot_at >= 0, vocab.hot_n[hot_at], count)
                base_chance = (count + 1) / (vocab.tokens + vocab.words + 1)
                text, of = np.unique(text >> 1, return_inverse=True)
                counts = np.stack([np.bincount(of, x, len(text)) for x in (None, count > 0)])
                logs = (np.log10(base_chance), np.log10(chance))
                sums = np.stack([np.bincount(of, x, len(text)) for x in logs])
                ends = np.append(np.searchsorted(text, bases[1:]), len(text))
                begin = 0
                for base, end in zip(bases.tolist(), ends.tolist(), strict=True):
                    at = slice(begin, end)
                    rows.append(
                        (
                            base,
                            b"",
                            b"",
                            (text[at] - base).astype(np.uint32).tobytes(),
                            counts[:, at].astype(np.uint32).tobytes(),
                            sums[:, at].tobytes(),
                        )
                    )
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows, strict=True)], names
            )

    def merge(batches):
        runs: dict[int, list] = {}
        for batch in batches:
            for base, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                runs.setdefault(base, []).append(rest)
        for parts in runs.values():
            raw, known = next((p[0], p[1]) for p in parts if p[0])
            n = len(known)
            counts, sums = np.zeros((2, n), dtype=np.int64), np.zeros((2, n))
            for _, _, texts, c, x in sorted(parts):
                at = np.frombuffer(texts, dtype=np.uint32)
                counts[:, at] += np.frombuffer(c, dtype=np.uint32).reshape(2, -1)
                sums[:, at] += np.frombuffer(x).reshape(2, -1)
            valid = np.frombuffer(known, dtype=np.uint8) > 0
            ids = pa.array(np.frombuffer(raw, dtype=np.int64), mask=~valid)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(x) for x in (*counts, *sums)]],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    sent = dealt.mapInArrow(
        score,
        "base bigint, ids binary, known binary, texts binary, counts binary, sums binary",
    )
    return sent.repartition("base").mapInArrow(
        merge,
        "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double",
    )


def language_scores(
    docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score,
    perplexity.

    ``learn`` is a condition on ``doc_id`` that tells which documents the model learns from.
    A text's tokens are its words, A-Z lower-cased, and one end; a null text has the end
    alone. ``n_known`` counts tokens that the training documents have, ``train_tokens`` all
    of theirs. ``base_score`` is the log10 probability under their counts with one added to
    each, ``score`` that of the model. Rows that repeat or lack a doc_id are scored one by
    one. Without training documents every token is unknown and has probability 1. No rows
    give no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    rows = rows.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    # Two shards to a partition: a task seats one after the other.
    shards = 2 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = settled(word_counts(rows), "word-counts")
    vocab = vocabulary(counts, min(shards, 1 << 15))
    asked = settled(asked_rows(rows, vocab), "contexts-asked")
    totals = total_rows(rows, vocab, told_rows(asked, counts, vocab))
    totals = settled(totals, "seating-totals")
    vocab = with_totals(vocab, totals)
    sums = _scores(rows, vocab, told_rows(asked, counts, vocab, totals))
    per_token = -F.col("score") / F.col("n_tokens")
    return sums.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), per_token).alias("perplexity"),
    )
