import itertools
import math
import re
from collections import Counter

import pytest

from tallywire.llm import url_rules
from tallywire.llm.queries import URL_RULES
from tallywire.llm.url_rules import NaiveBayes, Segmenter, url_verdicts, word_counts

URLS = [
    "http://a.com/",
    "http://a.com",
    "HTTP://WWW.Example.COM/en/x?y#z",
    "http://www.example.com/EN/x",
    "http://m.www.example.com/en/",
    "http://example.com/en/",
    "http://badexample.com/en/1",
    "http://x.net/es/1",
    "http://net/fr/",
    "http://xnet/fr/",
    "http://x.net/fr",
    "http://x.org?q=/en/",
    "no scheme.com/en/",
    "a://b://c.com/x",
    "://x.com/",
    "http://a.com/\nx",
    "http:///path",
    "",
    None,
    "http://über.net/es/ü",
    "http://" + "long" * 5000 + ".com/" + "x/" * 5000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def frame(spark, urls):
    rows = [(i, u, "<p>the cat sat</p>", "h", "p", "r") for i, u in enumerate(urls)]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, host string, path string, found string"
    )


def test_hosts_paths_and_rules(spark):
    got = url_verdicts(frame(spark, URLS).repartition(3), URL_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.log_odds > 0 else "allow"))


def test_classifier_against_counts(spark):
    urls = [f"http://s{i % 7}.com/x{i % 5}" for i in range(40)]
    urls += [f"http://s{i % 4}.net/es/x{i % 3}" for i in range(30)] + ["http://s1.org/es/x1/new"]
    rows = url_verdicts(frame(spark, urls), URL_RULES).collect()
    counts, totals, docs = {}, Counter(), Counter()
    for r in rows:
        if r.rule:
            docs[r.verdict] += 1
            for t in r.tokens:
                counts.setdefault(r.verdict, Counter())[t] += 1
                totals[r.verdict] += 1
    size = len(set(counts["allow"]) | set(counts["block"])) + 1
    for r in rows:
        odds = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        for t in r.tokens:
            for sign, v in ((1, "block"), (-1, "allow")):
                odds += sign * math.log((counts[v][t] + 1) / (totals[v] + size))
        assert r.log_odds == pytest.approx(odds)


def naive_bayes(rows):
    counts, docs = {"allow": Counter(), "block": Counter()}, Counter()
    for r in rows:
        if r.rule:
            docs[r.verdict] += 1
            counts[r.verdict].update(r.tokens)
    totals = {v: sum(c.values()) for v, c in counts.items()}
    size = len(set(counts["allow"]) | set(counts["block"])) + 1
    for r in rows:
        odds = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        for t, n in Counter(r.tokens).items():
            for sign, v in ((n, "block"), (-n, "allow")):
                odds += sign * math.log((counts[v][t] + 1) / (totals[v] + size))
        yield pytest.approx(odds)


@pytest.mark.parametrize("sent", [url_rules.TOKENS_SENT, 0])
def test_rare_tokens_and_repeated_rows_count(spark, monkeypatch, sent):
    """Tokens seen once among hundreds of thousands, sent to tasks or joined."""
    monkeypatch.setattr(url_rules, "TOKENS_SENT", sent)
    monkeypatch.setattr(url_rules, "HOSTS_SENT", sent)
    urls = ["http://a.com/" + "x/" * 300_000, "http://b.net/es/rare/1", "http://b.org/rare"]
    urls += ["http://b.org/rare", "http://1.org", "http://b٣c.org/", None, ""]
    rows = url_verdicts(frame(spark, urls), URL_RULES).collect()
    assert len(rows) == len(urls)
    assert [r.log_odds for r in rows] == list(naive_bayes(rows))


def test_rare_words_split_names(spark):
    words = [("the", 10**9), ("quagmire", 1000), ("zeppelin", 1000)]
    words = spark.createDataFrame(words, "word string, n long")
    urls = ["http://quagmirezeppelin.thequagmire9.org/", "http://thezeppelin.com/a"]
    rows = url_verdicts(frame(spark, urls), URL_RULES, words).collect()
    assert {r.page_id: " ".join(r.tokens) for r in rows} == {
        0: "h:quagmire h:zeppelin h:the h:quagmire h:# h:org",
        1: "h:the h:zeppelin h:com p:a",
    }


def test_segments_against_all_splits():
    counts = {"the": 50, "cat": 9, "sat": 7, "on": 20, "them": 4, "at": 12, "he": 9, "c": 1}
    cutter = Segmenter(counts, sum(counts.values()))
    for name in ("thecatsat", "themat", "onthecat", "zzcat", "q", "hehehe"):
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            parts = re.findall(r"[^|]+", "".join(c + "|" * b for c, b in zip(name, (*cuts, 0), strict=True)))
            splits.append((sum(cutter._cost(p) for p in parts), len(parts), parts))
        best = min(splits)
        assert sum(map(cutter._cost, cutter.split(name))) == pytest.approx(best[0])
    assert cutter.split("thecatsat") == ["the", "cat", "sat"]
    assert cutter.tokens("thecat.x1", "/On/23") == ["h:the", "h:cat", "h:x", "h:#", "p:on", "p:#"]


def test_words_of_texts(spark):
    rows = [(1, "<b class=x>The THE</b>cat"), (2, None), (3, ""), (1, "é cat")]
    got = word_counts(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert {r.word: r.n for r in got} == {"the": 2, "cat": 2}


def test_empty(spark):
    assert url_verdicts(frame(spark, []), URL_RULES).count() == 0
    rows = url_verdicts(frame(spark, [None, "http://x.org/"]), URL_RULES).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"]
    assert NaiveBayes({}, {}).score(["a"]) == 0
