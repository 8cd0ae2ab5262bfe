import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywire.llm import packing
from tallywire.llm.packing import WordIds, merge_left, pack

from . import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


ODD = [
    "Don't we'll 'S 123 ab12cd",
    "x y  z　q",
    "İstanbul ŒUVRE ñandú ÿ Ÿ ŉ ĳ ×÷",
    "日本語 テスト",
    "éclair",
    "a\x1cb\x85c",
    "_a_ $5.00 !!'s",
    "ΑΣ ας",
    "🙂🙂 a🙂b",
    "ﬁn ½ ²",
    "<|endoftext|> <|startoftext|>x",
]


def test_ids_word_by_word(whole):
    ids = WordIds(PATH)
    rng = random.Random(1)
    for text in ODD + [cases.prose(rng, 50, "aeéèçñßöüABÉ'.,1 ") for _ in range(200)]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert ids.of(text.encode()) == struct.pack(f"<{len(want)}I", *want), text


MARKED = [
    "a <|endoftext|> b",
    "a<|endoftext|>b <|startoftext|><|endoftext|>",
    "<|ENDOFTEXT|> <|endoftext| > <|end",
    "don't<|startoftext|>Don't é<|endoftext|>日本 \n<|endoftext|>",
    *ODD,
]


def test_added_tokens_are_as_the_tokenizer_has_them(spark):
    """Against a tokenizer as it is read from its file."""
    plain = Tokenizer.from_file(PATH)
    assert plain.encode(MARKED[0], add_special_tokens=False).ids == [320, 49407, 321]
    ids = WordIds(PATH, added=True)
    for text in MARKED:
        want = plain.encode(text, add_special_tokens=False).ids
        assert ids.of(text.encode()) == struct.pack(f"<{len(want)}I", *want), text
    check(spark, plain, list(enumerate(MARKED)))


def check(spark, whole, pairs, size=64, most=4):
    docs = cases.docs(spark, pairs).repartition(3)
    rows = pack(docs, PATH, size=size, open_windows=most).withColumn("crc", F.crc32("ids")).collect()
    want = sorted(
        repr((i, [*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in pairs
    )
    # Pieces put together give every document again, also where an id repeats.
    by_doc: dict = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0 and r.crc == zlib.crc32(r.ids)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    if len({i for i, _ in pairs}) == len(pairs):
        got = []
        for (i, n), held in by_doc.items():
            held.sort(key=lambda r: r.start)
            ids = b"".join(r.ids for r in held)
            assert [r.start for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
            assert len(ids) == 4 * n
            got.append(repr((i, list(struct.unpack(f"<{n}I", ids)))))
        assert sorted(got) == want
    assert sum(r.length for r in rows) == sum(
        len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs
    )
    return sequences


def test_round_trip(spark, whole):
    rng = random.Random(4)
    pairs = [(i, cases.prose(rng, rng.randint(0, 60))) for i in range(300)]
    sequences = check(spark, whole, pairs)
    lengths = [sum(r.length for r in held) for held in sequences.values()]
    padding = sum(64 - n for n in lengths if n & (n - 1))
    assert padding < 0.1 * sum(lengths)


def test_awkward(spark, whole):
    check(spark, whole, cases.AWKWARD, size=2048)


def test_empty(spark):
    assert pack(cases.empty(spark), PATH).count() == 0


def test_batches_end_by_bytes():
    rows = [(i, 0, 2048, 2048, bytes(8192), i, 0, 0) for i in range(900)]
    batches = list(packing._batches(rows))
    assert max(b.nbytes for b in batches) < 2 << 20
    assert [i for b in batches for i in b.column(0).to_pylist()] == list(range(900))


def test_leftovers_are_cut_to_powers_of_two():
    pieces = [(i, 0, n, n, bytes(4 * n)) for i, n in enumerate([3, 5, 30, 7, 64, 20])]
    done = merge_left(pieces, 64)
    lengths = [sum(p[2] for p in held) for held in done]
    assert sum(lengths) == 129
    assert all(n <= 64 and (n >= 57 or n & (n - 1) == 0) for n in lengths)
