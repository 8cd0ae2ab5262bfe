"""Verdicts on URLs by host and path rules, and by a classifier where no rule fits.

The classifier reads words. Host names run words together, so their labels are split by the
most probable sequence of words of a unigram model (Viterbi). Words of the host and tokens of
the path then go into a multinomial naive Bayes model, which learns from the URLs that rules
decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.tables import by_value
from tallywire.plans.sizes import settled, small_enough
from tallywire.plans.skew import salted_join

TOKENS_SENT = 200_000  # tokens up to which all their weights go to every task
HOSTS_SENT = 100_000  # rows by host or label up to which a table goes to every task
LONGEST = 24  # letters of a word
HELD = 300_000  # words a task counts before it hands them on
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: str | Column) -> Column:
    """From the first :// up to the next /, ?, # or the end, A-Z lower-cased; else empty."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def url_path(url: str | Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest of the rules (verdict, host/path) that fit, as a struct, or null.

    A rule fits its host and all subdomains, where the path starts as the rule's does. Rules
    of the same length cannot both fit, unless they are the same rule.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = (host == rule_host) | host.endswith("." + rule_host)
        fits &= path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


# --- words ---


def word_counts(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """Counts of the a-z words of whole texts, markup left out: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, words = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z]+")

        def out(counts: Counter) -> pa.RecordBatch:
            keys = pa.array([w.decode() for w in counts], pa.string())
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(counts.values(), pa.int64())], ["word", "n"]
            )

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(words.findall(tags.sub(b" ", (text.as_py() or b"").lower())))
                if len(counts) >= HELD:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    rows = pages.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Segmenter:
    """Splits names into the most probable sequence of words."""

    def __init__(self, counts: dict, total: int) -> None:
        kept = {w: n for w, n in counts.items() if len(w) <= LONGEST}
        self.total = math.log(max(total, 1) + 1)
        self.cost = {w: self.total - math.log(n) for w, n in kept.items()}
        self.known: dict[str, list[str]] = {}

    def _cost(self, word: str) -> float:
        # A word nobody has seen gets less likely with every letter.
        cost = self.cost.get(word)
        return self.total + math.log(10) * (len(word) - 1) if cost is None else cost

    def split(self, name: str) -> list[str]:
        """Words of a run of letters, by Viterbi; fewer words on equal terms."""
        if name not in self.known:
            best: list[tuple] = [(0.0, 0, 0)]
            for end in range(1, len(name) + 1):
                best.append(
                    min(
                        (best[at][0] + self._cost(name[at:end]), best[at][1] + 1, at)
                        for at in range(max(0, end - LONGEST), end)
                    )
                )
            words, end = [], len(name)
            while end:
                at = best[end][2]
                words.append(name[at:end])
                end = at
            if len(self.known) > HELD:
                self.known.clear()
            self.known[name] = words[::-1]
        return self.known[name]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host's labels, and the path's runs of letters; numbers count as #."""
        found = []
        for part in host_parts(host):
            found += ["h:#"] if part.isdigit() else ["h:" + w for w in self.split(part)]
        return found + path_tokens(path)


def host_parts(host: str) -> list[str]:
    """Runs of letters and of digits of the labels."""
    return [p for label in host.split(".") for p in re.findall(r"[^\W\d_]+|\d+", label)]


def path_tokens(path: str) -> list[str]:
    parts = re.findall(r"[^\W\d_]+|\d+", path)
    return ["p:#" if part.isdigit() else "p:" + part.lower() for part in parts]


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, salt_by: str) -> DataFrame:
    """A left join to one row per key: a short table is sent, a long one is shuffled."""
    if small_enough(lookup, HOSTS_SENT):
        return rows.join(F.broadcast(lookup), key, "left")
    return salted_join(rows, lookup, [key], "left", salt_by)


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """Most probable words of distinct names: name, words.

    Each name meets the counts of those words (word, n) that it has in it, whatever their
    number is in all.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    names = settled(names.withColumn("id", F.monotonically_increasing_id()), "names")
    most = names.agg(F.sum(LONGEST * F.length("name"))).first()[0] or 0

    @F.arrow_udf("array<string>")
    def pieces(batch: pa.Array) -> pa.Array:
        found = [
            list({n[i : i + k] for i in range(len(n)) for k in range(1, LONGEST + 1)})
            for n in batch.to_pylist()
        ]
        return pa.array(found, pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def split(batch: pa.Array, known: pa.Array) -> pa.Array:
        found = [
            Segmenter({k["word"]: k["n"] for k in ks or ()}, total).split(n)
            for n, ks in zip(batch.to_pylist(), known.to_pylist(), strict=True)
        ]
        return pa.array(found, pa.list_(pa.string()))

    inside = names.select("id", F.explode(pieces("name")).alias("word"))
    counts = words.filter(F.length("word") <= LONGEST).select("word", "n")
    known = salted_join(inside, counts, ["word"], "inner", salt_by="id", at_most=most)
    known = known.groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return names.join(known, "id", "left").select("name", split("name", "known").alias("words"))


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens of distinct hosts: host, host_tokens."""

    @F.arrow_udf("array<string>")
    def parts(batch: pa.Array) -> pa.Array:
        return pa.array([host_parts(h) for h in batch.to_pylist()], pa.list_(pa.string()))

    rows = settled(hosts.select("host", F.posexplode(parts("host")).alias("at", "name")), "hosts")
    # Digits alone are not split; what Python takes for digits has no letter.
    names = rows.filter(F.col("name").rlike("[^0-9]")).select("name").distinct()
    found = looked_up(rows, settled(split_names(names, words), "split-names"), "name", "host")

    @F.arrow_udf("array<string>")
    def labelled(batch: pa.Array, split: pa.Array) -> pa.Array:
        found = [
            ["h:#"] if n.isdigit() else ["h:" + w for w in ws]
            for n, ws in zip(batch.to_pylist(), split.to_pylist(), strict=True)
        ]
        return pa.array(found, pa.list_(pa.string()))

    found = found.select("host", "at", labelled("name", "words").alias("tokens"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "tokens")))
    tokens = F.flatten(F.transform(in_order, lambda x: x["tokens"]))
    return settled(found.groupBy("host").agg(tokens.alias("host_tokens")), "host-tokens")


# --- classifier ---


class NaiveBayes:
    """Multinomial naive Bayes with one added to every count, for two verdicts."""

    def __init__(self, counts: dict, rows: dict) -> None:
        """``counts`` by (token, verdict), ``rows`` by verdict."""
        self.tokens = {t for t, _ in counts}
        total = Counter()
        for (_, verdict), n in counts.items():
            total[verdict] += n
        size = len(self.tokens) + 1  # one for all unseen
        everything = sum(rows.values())

        def weight(token, verdict):
            return math.log((counts.get((token, verdict), 0) + 1) / (total[verdict] + size))

        self.lift = {t: weight(t, "block") - weight(t, "allow") for t in self.tokens}
        self.other = weight(None, "block") - weight(None, "allow")
        prior = [(rows.get(v, 0) + 1) / (everything + 2) for v in ("block", "allow")]
        self.prior = math.log(prior[0]) - math.log(prior[1])

    def score(self, tokens: list[str]) -> float:
        """Log odds of a block."""
        return self.prior + sum(self.lift.get(t, self.other) for t in tokens)


def with_log_odds(rows: DataFrame, per_token: DataFrame, judged: dict) -> DataFrame:
    """Log odds of a block by naive Bayes over all tokens (token, n, blocked).

    Many tokens are not sent to tasks; weights are joined to the tokens of rows and added up.
    """
    if small_enough(per_token, TOKENS_SENT):
        counts = {}
        for token, n, blocked in per_token.collect():
            counts[token, "block"], counts[token, "allow"] = blocked, n - blocked
        model = by_value(rows.sparkSession, NaiveBayes(counts, judged))

        @F.arrow_udf("double")
        def log_odds(batch: pa.Array) -> pa.Array:
            return pa.array([model().score(t) for t in batch.to_pylist()], pa.float64())

        return rows.withColumn("log_odds", log_odds("tokens"))
    n, blocked, size = per_token.agg(F.sum("n"), F.sum("blocked"), F.count("*") + 1).first()
    over = math.log(n - blocked + size) - math.log(blocked + size)
    blocks, allows = F.col("blocked") + 1, F.col("n") - F.col("blocked") + 1
    lifts = per_token.select("token", (F.log(blocks) - F.log(allows) + over).alias("lift"))
    prior = NaiveBayes({}, judged).prior
    each = rows.select("row", F.explode("tokens").alias("token"))
    each = each.groupBy("row", "token").agg(F.count("*").alias("times"))
    each = salted_join(each, lifts, ["token"], "left", salt_by="row")
    lift = F.col("times") * F.coalesce("lift", F.lit(over))
    sums = each.groupBy("row").agg(F.sum(lift).alias("sum"))
    odds = F.lit(prior) + F.coalesce("sum", F.lit(0.0))
    return rows.join(sums, "row", "left").withColumn("log_odds", odds)


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    words: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, log_odds, tokens.

    ``rules`` are pairs (allow or block, host/path). Where none fits, ``rule`` is null and the
    verdict is the classifier's: block if its odds are above even. Words for splitting hosts
    are counted in the pages' texts, unless given as ``words`` (word, n). A null URL, or one
    without ://, has an empty host and path, and is judged by the prior alone. Rows that repeat
    or lack an id are judged like any other; no rows give no rows.
    """
    words = settled(word_counts(pages, text_col) if words is None else words, "words")
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col).cast("string")).alias("host"),
        url_path(F.col(url_col).cast("string")).alias("path"),
    )
    rows = rows.withColumn("found", matching_rule(rules, F.col("host"), F.col("path")))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    rows = looked_up(rows, host_tokens(rows.select("host").distinct(), words), "host", "row")

    @F.arrow_udf("array<string>")
    def tokens(paths: pa.Array) -> pa.Array:
        return pa.array([path_tokens(p) for p in paths.to_pylist()], pa.list_(pa.string()))

    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("host_tokens", none), tokens("path"))
    rows = settled(rows.withColumn("tokens", both).drop("host_tokens"), "url-tokens")

    learnt = rows.filter("found IS NOT NULL").withColumn("by", F.col("found.verdict"))
    per_token = learnt.select(F.explode("tokens").alias("token"), "by").groupBy("token").agg(
        F.count("*").alias("n"), F.count_if(F.col("by") == "block").alias("blocked")
    )
    judged = {r["by"]: r["count"] for r in learnt.groupBy("by").count().collect()}
    rows = with_log_odds(rows, settled(per_token, "tokens"), judged)
    guess = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), guess).alias("verdict"),
        "log_odds",
        "tokens",
    )
