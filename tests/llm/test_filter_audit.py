"""The audit of filters against a walk through every order, document by document."""

import itertools
import random
import re

import pytest

from tallywire.llm import filter_audit as audit

from . import cases

LABELS = "doc_id long, quality int, toxic int, source string, text string, mask int"


def failed(rows):
    """Per row (doc_id, text, source): the letters it fails."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        out.append(
            {
                letter
                for letter, bad in {
                    "A": len(words) < 50,
                    "B": 100 * len(set(words)) < 65 * len(words),
                    "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                    "D": bool(re.search("[#$%&*|]", t)),
                    "E": i is not None and i > first[t],
                }.items()
                if bad
            }
        )
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    marked = [(i, s or "", f) for (i, _, s), f in zip(rows, failed(rows), strict=True)]
    out = {}
    for part in {s for _, s, _ in marked}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            here, gone = [m for m in marked if m[1] == part], []
            for step, letter in enumerate(order, 1):
                cut = [m for m in here if letter in m[2]]
                out[part, "".join(order), step] = [
                    len(here) - len(cut),
                    len(cut),
                    sum(letter in m[2] for m in gone),
                    sum(m[2] == {letter} for m in marked if m[1] == part),
                    sum(m[0] in good for m in cut),
                    sum(m[0] in toxic for m in cut),
                ]
                shapley[letter] += len(cut)
                here = [m for m in here if letter not in m[2]]
                gone += cut
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[letter])
    return out


def found(df):
    metrics = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r.part, r.filter_order, r.step): [r[m] for m in metrics] for r in df.collect()}


def both(spark, rows, labels):
    docs = spark.createDataFrame(
        [(i, t, None, s, None, 7, "x", -1) for i, t, s in rows], cases.DOCS
    )
    marks = spark.createDataFrame([(*m, "x", "y", 5) for m in labels], LABELS)
    return found(audit.filter_audit(docs, marks)), brute(rows, labels)


def test_random_documents(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        text = cases.prose(rng, rng.choice([3, 49, 50, 80]), rng.choice(["ab", "abcdefgh", "aBcdé"]))
        texts.append(text + rng.choice(["", "", "#", " | "]))
    texts += rng.choices(texts, k=60)
    rows = [(i, t, rng.choice(["a", "a", "b", "", None])) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)]
    labels += [(3, 1, 0), (3, 0, 1), (None, 1, 1), (1000, 1, 1)]
    got, want = both(spark, rows, labels)
    assert got == want


def test_awkward_documents(spark):
    rows = [(i, t, None if n % 3 else "s") for n, (i, t) in enumerate(cases.AWKWARD)]
    rows += [(20, " ".join(map(str, range(50))), "s"), (21, "A" + "b" * 19, "s"), (22, "A" * 3, "s")]
    got, want = both(spark, rows, [(6, 1, 1), (None, 1, 1)])
    assert got == want


def test_no_rows(spark):
    marks = spark.createDataFrame([], LABELS)
    assert audit.filter_audit(cases.empty(spark), marks).count() == 0
    docs = cases.docs(spark, [(1, "a")])
    assert audit.filter_audit(docs, marks).count() == 600


def test_one_text_holds_a_third(spark):
    """Copies fail the fifth filter wherever they lie, and stay one cell per part."""
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", "hot" if i % 2 else "s") for i in range(900)]
    docs = spark.createDataFrame(
        [(i, t, None, s, None, 7, "x", -1) for i, t, s in rows], cases.DOCS
    )
    cells = audit.mask_cells(
        audit.failed_filters(docs.repartition(16)), spark.createDataFrame([], LABELS)
    ).collect()
    assert {(c.part, c["mask"]): c.docs for c in cells} == {
        ("s", 1): 301, ("s", 17): 149, ("hot", 1): 300, ("hot", 17): 150
    }


def test_recursion_takes_each_sequence_once(spark):
    rows = audit.walk(spark, "XYZ").collect()
    assert len({(r.prefix, r["mask"]) for r in rows}) == len(rows) == (3 + 6 + 6) * 8
    assert all(r.keeps + r.removes + r.late <= 1 for r in rows)
    assert all(len(r.prefix) == len(set(r.prefix)) == r.step for r in rows)


@pytest.mark.parametrize("letters", ["A", "AB"])
def test_fewer_filters(spark, letters):
    cells = spark.createDataFrame(
        [("p", 1, 4, 2, 1), ("p", 0, 3, 0, 0)], "part string, mask int, docs long, good long, toxic long"
    )
    rows = found(audit.audit_orders(cells, letters))
    assert len(rows) == {"A": 1, "AB": 4}[letters]
    assert rows["p", letters, 1] == [3, 4, 0, 4, 2, 1, 4 * len(rows) // len(letters)]
