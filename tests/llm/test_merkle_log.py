"""Trees of digests against a tree built level by level, and proofs by folding them."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallywire.llm import merkle_log as merkle

from . import cases


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def path_of(levels, place):
    found = []
    for level in levels[:-1]:
        first = place - place % 8
        found += [d for i, d in enumerate(level[first : first + 8], first) if i != place]
        place //= 8
    return found


def raised(digest, levels, place):
    """The root if a leaf were another."""
    for level in levels[:-1]:
        first = place - place % 8
        run = level[first : first + 8]
        run[place - first] = digest
        digest, place = h(*run), place // 8
    return digest


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to what must come out for each."""

    def leaf(*values):
        values = [None if v is None else str(v) for v in values]
        return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])

    trees = {}
    for i, source, lang, n, text in rows:
        shown = digest = leaf(i, source, lang, n, text)
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            shown = leaf(i, source, lang, n, None if text is None else cases.lower(text))
        trees.setdefault(lang, []).append((i is not None, i or 0, digest, shown))
    names = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    built = {lang: levels_of([r[2] for r in sorted(trees[lang])]) for lang in names}
    top = levels_of([built[lang][-1][0] for lang in names])
    out = []
    for at, lang in enumerate(names):
        for place, (known, i, digest, shown) in enumerate(sorted(trees[lang])):
            path = path_of(built[lang], place) + path_of(top, at)
            folded = raised(raised(shown, built[lang], place), top, at)
            root = top[-1][0]
            out.append(
                (i if known else None, digest, built[lang][-1][0], root, "".join(path), folded)
            )
    return sorted(out, key=str)


def manifest(docs):
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.merkle_manifest(docs, [*others, F.col("text")], [*others, lowered], tampered)


def found(docs):
    rows = manifest(docs).proofs().collect()
    names = ("leaf", "subroot", "root", "path", "folded")
    return sorted(((r.id, *[bytes(r[n]).hex() for n in names]) for r in rows), key=str)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, 7, "x", -1) for i, s, lang, n, t in rows], cases.DOCS)


def awkward():
    langs = [None, "", "=", "en", "é", "e\U0001f642"]
    rows = [(i, None, langs[k % 6], k, t) for k, (i, t) in enumerate(cases.AWKWARD)]
    return rows + [(99, "s", "alone", None, None), (99, "s", "alone", None, None)]


def test_awkward_rows(spark):
    assert found(docs_of(spark, awkward())) == brute(awkward())


@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (64, 65, 7), (513, 512, 3), (1100, 1)])
def test_sizes(spark, sizes):
    """Trees below, at and above what one builder holds."""
    rng = random.Random(sum(sizes))
    rows = [(rng.randint(0, 400), "s", f"l{k}", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert found(docs_of(spark, rows).repartition(7)) == brute(rows)


def test_many_trees(spark):
    """More trees than one builder holds."""
    rows = [(i, None, f"lang {i % 600}", None, "x") for i in range(900)]
    assert found(docs_of(spark, rows)) == brute(rows)


def test_no_rows(spark):
    empty = manifest(cases.empty(spark))
    assert empty.root is None and empty.proofs().count() == 0 and empty.entries().count() == 0


@pytest.mark.parametrize("leaves", [*range(1, 75), 511, 512])
def test_closed_form_of_positions(leaves):
    """Every node of a log stands where its level and place say."""
    levels = merkle.height(leaves)
    log = merkle.PostorderLog(levels)
    digests = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(leaves)]
    for digest in digests:
        log.append(digest)
    held = log.close()
    want = levels_of([d.hex() for d in digests])
    seen = set()
    for level, nodes in enumerate(want):
        for place, node in enumerate(nodes):
            at = merkle.position(level, place, leaves, levels)
            seen.add(at)
            assert held[32 * at : 32 * at + 32].hex() == node
    assert seen == set(range(len(held) // 32))


def test_entries_are_the_log(spark):
    """Positions are gapless, and an inner node stands after its children."""
    rows = [(i, None, "a" if i % 10 else "b", None, f"{i}") for i in range(1500)]
    made = manifest(docs_of(spark, rows))
    for tree, n in (("=a", 1350), ("=b", 150)):
        log = made.entries().filter(F.col("tree") == tree).orderBy("position").collect()
        assert [r.position for r in log] == list(range(len(log)))
        nodes = {(r.level, r.place): (r.position, bytes(r.digest)) for r in log}
        assert len([r for r in log if r.level == 0]) == n
        for (level, place), (at, digest) in nodes.items():
            if level:
                under = [nodes.get((level - 1, 8 * place + j)) for j in range(8)]
                under = [u for u in under if u is not None]
                assert all(p < at for p, _ in under)
                assert digest == merkle.digest_of([d for _, d in under])
        root = max(nodes.values())[1]
        assert root in {bytes(r.subroot) for r in made.proofs().select("subroot").collect()}


def test_a_wrong_path_does_not_verify():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    log = merkle.PostorderLog(2)
    for leaf in leaves:
        log.append(leaf)
    held = log.close()
    path = merkle.siblings(held, 9, 20, 2)
    assert merkle.fold(leaves[9], path, [(9, 20)]) == held[-32:]
    assert merkle.fold(leaves[8], path, [(9, 20)]) != held[-32:]
    assert merkle.fold(leaves[9], path[:-1] + b"x", [(9, 20)]) != held[-32:]
    with pytest.raises(ValueError, match="path"):
        merkle.fold(leaves[9], path + bytes(32), [(9, 20)])
