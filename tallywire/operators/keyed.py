"""Pairing by the keys messages name, over the whole archive, and conversations.

A reply that names a key answers the request that asked for it. For every peer, rule, direction
and key, requests and replies form a queue: a reply takes the oldest request still waiting, and
one that finds none is stray. That needs no stepping: with requests counted +1 and replies -1,
a reply is stray where the running sum falls to a new low, and the n-th reply that is not stray
takes the n-th request. A queue starts anew when nothing happened on it for longer than the
rule's window, and what is older than the window when its reply comes is not tied.

A reply may name keys of several requests; it goes to the oldest of them, by time, then rule,
then position. A request under a rule with a single reply keeps the first of its replies.

Requests that name nothing are paired by order and timing with the replies that no key ties.

A queue that one peer fills by repeating one key is split by position; the running sums, the
lowest of them and the last time are all that has to be carried from split to split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.payload import detail_text, named_keys
from tallywire.functions.taxonomy import is_message
from tallywire.operators import pairing
from tallywire.operators.rules import WIRE_RULES, Rule
from tallywire.operators.search import page, page_rows
from tallywire.plans import skew

# All that can meet in a tie is of one peer and one direction of requests.
SIDE = ["peer_id", "asked_inbound"]
QUEUE = [*SIDE, "rule", "key"]


def queue_rows(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per message, rule it plays a part in, and key it names."""
    parts: dict[str, list] = {}
    for n, r in enumerate(rules):
        parts.setdefault(r.request, []).append((n, True, r))
        for command in r.replies:
            parts.setdefault(command, []).append((n, False, r))
    role = None
    for command, found in sorted(parts.items()):
        value = F.array(
            *[
                F.struct(
                    F.lit(n).alias("rule"),
                    F.lit(asks).alias("asks"),
                    F.lit(r.multi).alias("multi"),
                    F.lit(r.window_ms).cast("bigint").alias("window_ms"),
                )
                for n, asks, r in found
            ]
        )
        test = F.col("kind") == command
        role = F.when(test, value) if role is None else role.when(test, value)
    named = messages.filter(is_message() & F.col("kind").isin(*sorted(parts)))
    rows = named.select("peer_id", "pos", "ts_ms", "inbound", "keys", F.explode(role).alias("r"))
    return rows.select(
        "peer_id",
        "r.*",
        F.when(F.col("r.asks"), F.col("inbound")).otherwise(~F.col("inbound")).alias(
            "asked_inbound"
        ),
        "pos",
        "ts_ms",
        F.explode("keys").alias("key"),
    ).withColumns(
        {"sign": F.when(F.col("asks"), 1).otherwise(-1), "taken": F.lit(False)}
    ).drop("asks")


def in_queues(rows: DataFrame, split: bool) -> DataFrame:
    """Number the rows of every queue: ``run`` and ``nth``, null for a stray reply.

    ``sign`` is 1 for a request and -1 for a reply, and 0 for a mere sign of life. Queues may
    be split by position; then each split is gone through by itself, and what the splits in
    front of it amount to is added to the run that it begins in.
    """
    here = [*QUEUE, "split"]
    in_split = Window.partitionBy(*here).orderBy("pos")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(in_split) > F.col("window_ms")
    rows = rows.withColumn("fresh", F.when(gap, 1).otherwise(0))
    rows = rows.withColumn("turn", F.sum("fresh").over(in_split))
    so_far = Window.partitionBy(*here, "turn").orderBy("pos")
    is_ask, is_reply = F.col("sign") == 1, F.col("sign") == -1
    rows = rows.withColumns(
        {
            "level": F.sum("sign").over(so_far),
            "asked": F.count_if(is_ask).over(so_far),
            "replied": F.count_if(is_reply).over(so_far),
        }
    )
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "low": F.min("level").over(so_far.rowsBetween(Window.unboundedPreceding, 0)),
            "low_before": F.min("level").over(earlier),
        }
    )
    run = F.struct("split", "turn")
    if split:
        front = _in_front(rows)
        rows = rows.join(front, here, "left")
        goes_on = (F.col("turn") == 0) & F.col("front.run").isNotNull()

        def with_front(name: str, own):
            return F.when(goes_on, own + F.col(f"front.{name}")).otherwise(own)

        level = F.col("front.asked") - F.col("front.replied")
        lowest = F.least(F.col("front.low"), F.lit(0))
        rows = rows.withColumns(
            {
                "asked": with_front("asked", F.col("asked")),
                "replied": with_front("replied", F.col("replied")),
                "low": F.when(goes_on, F.least(lowest, F.col("low") + level)).otherwise(
                    F.col("low")
                ),
                "low_before": F.when(
                    goes_on, F.least(lowest, F.col("low_before") + level)
                ).otherwise(F.col("low_before")),
            }
        )
        run = F.when(goes_on, F.col("front.run")).otherwise(run)
    strays, before = (
        F.greatest(-F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in ("low", "low_before")
    )
    nth = F.when(is_ask, F.col("asked")).when(
        is_reply & (strays == before), F.col("replied") - strays
    )
    rows = rows.withColumns({"nth": nth, "run": run})
    return rows.drop("fresh", "turn", "level", "asked", "replied", "low", "low_before", "front")


def _in_front(rows: DataFrame) -> DataFrame:
    """Per split of a queue what its first run amounts to in front of it, as ``front``.

    A split is summed up by its last run; if that is its only one and no silence lies before
    it, the run goes on from the split in front. So the sums of a chain of such splits add
    up, and their lowest levels are lowered by the level they started from. One row per split.
    """
    at = F.col("pos")
    last_turn = F.max("turn").over(Window.partitionBy(*QUEUE, "split"))
    parts = (
        rows.filter(F.col("split") != skew.WHOLE)
        .withColumn("is_last", F.col("turn") == last_turn)
        .groupBy(*QUEUE, "split", "window_ms")
        .agg(
            F.max("turn").alias("turns"),
            F.min_by("ts_ms", at).alias("first_ts"),
            F.max_by("ts_ms", at).alias("last_ts"),
            F.count_if(F.col("is_last") & (F.col("sign") == 1)).alias("asked"),
            F.count_if(F.col("is_last") & (F.col("sign") == -1)).alias("replied"),
            F.min(F.when(F.col("is_last"), F.col("level"))).alias("low"),
        )
    )
    queue = Window.partitionBy(*QUEUE).orderBy("split")
    silence = F.col("first_ts") - F.lag("last_ts").over(queue) > F.col("window_ms")
    parts = parts.withColumn("cut", F.coalesce(silence, F.lit(True)))
    begins = F.col("cut") | (F.col("turns") > 0)
    parts = parts.withColumn("chain", F.sum(F.when(begins, 1).otherwise(0)).over(queue))
    chain = Window.partitionBy(*QUEUE, "chain").orderBy("split")
    parts = parts.withColumns(
        {
            "start": F.first(F.struct("split", F.col("turns").alias("turn"))).over(chain),
            "asked": F.sum("asked").over(chain),
            "replied": F.sum("replied").over(chain),
            "below": F.coalesce(
                F.sum(F.col("asked") - F.col("replied")).over(
                    chain.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        }
    )
    parts = parts.withColumn("low", F.min(F.col("low") + F.col("below")).over(chain))
    amounts = F.struct("asked", "replied", "low", F.col("start").alias("run"))
    front = F.when(~F.col("cut"), F.lag(amounts).over(queue))
    return parts.select(*QUEUE, "split", front.alias("front"))


def met_in_queues(rows: DataFrame) -> DataFrame:
    """The requests of all queues with the replies that took them, if any."""

    def of(sign: int, column: str):
        return F.max(F.when(F.col("sign") == sign, F.col(column)))

    return (
        rows.filter(F.col("nth").isNotNull())
        .groupBy(*QUEUE, "run", "nth", "multi", "window_ms")
        .agg(
            of(1, "pos").alias("request_pos"),
            of(1, "ts_ms").alias("request_ts"),
            F.max("taken").alias("taken"),
            of(-1, "pos").alias("reply_pos"),
            of(-1, "ts_ms").alias("reply_ts"),
        )
    )


def chosen(met: DataFrame) -> DataFrame:
    """One request for every reply, and one reply for a request that may have no more."""
    elapsed = F.greatest(F.col("reply_ts") - F.col("request_ts"), F.lit(0))
    met = met.filter("request_pos IS NOT NULL AND reply_pos IS NOT NULL")
    met = met.withColumn("elapsed_ms", elapsed).filter("elapsed_ms <= window_ms")
    oldest = Window.partitionBy(*SIDE, "reply_pos").orderBy("request_ts", "rule", "request_pos")
    met = met.withColumn("choice", F.row_number().over(oldest)).filter("choice = 1")
    first = Window.partitionBy(*SIDE, "request_pos", "rule").orderBy("reply_pos")
    met = met.withColumn("turn", F.row_number().over(first))
    met = met.filter("multi OR (turn = 1 AND NOT taken)")
    return met.select(*SIDE, "request_pos", "reply_pos", "rule", "elapsed_ms")


def has_busy_peer(messages: DataFrame, rules: Sequence[Rule], hot_rows: int) -> bool:
    """Whether any peer may have more parts and keys than one task should hold.

    One job that counts per peer and direction, combined before the shuffle.
    """
    parts = max(
        sum((c == r.request) + (c in r.replies) for r in rules)
        for c in {r.request for r in rules} | {c for r in rules for c in r.replies}
    )
    most = messages.filter(is_message()).groupBy("peer_id", "inbound").agg(
        F.sum(F.greatest(F.size("keys"), F.lit(1))).alias("n")
    )
    return not most.filter(F.col("n") * parts > hot_rows).isEmpty()


def lined_up(
    rows: DataFrame,
    busy: bool,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
) -> DataFrame:
    """The rows of all queues, numbered."""
    if busy:
        rows, split = skew.with_split(rows, QUEUE, hot_rows=hot_rows, bits=bits)
    else:
        # All queues, choices and turns below find their rows together already.
        rows = rows.repartition(*SIDE).withColumn("split", F.lit(skew.WHOLE).cast("bigint"))
        split = False
    return in_queues(rows, split)


def keyed_ties(
    messages: DataFrame,
    rules: Sequence[Rule] = WIRE_RULES,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
) -> DataFrame:
    """Replies tied to requests by what they name: request_pos, reply_pos, rule, elapsed_ms."""
    busy = has_busy_peer(messages, rules, hot_rows)
    ties = chosen(met_in_queues(lined_up(queue_rows(messages, rules), busy, hot_rows, bits)))
    return ties.select("request_pos", "reply_pos", "rule", "elapsed_ms")


def nameless_turns(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The parts of messages in pairing by timing: requests that name nothing, and replies."""
    named = messages.withColumn("named", F.coalesce(F.size("keys") > 0, F.lit(False)))
    turns = pairing.conversation_rows(named, rules, keep=["named"])
    return turns.filter(~(F.col("asks") & F.col("named"))).drop("named")


def untied(turns: DataFrame, ties: DataFrame, busy: bool) -> DataFrame:
    """The turns without the replies that a key has tied.

    If no peer is busy, ties are laid among the turns of their side, which have to come
    together anyway, instead of being joined to them.
    """
    tied = ties.select(*SIDE, F.col("reply_pos").alias("pos")).distinct()
    if busy:
        return turns.join(tied.select("pos"), "pos", "left_anti")
    tied = tied.withColumn("tied", F.lit(True))
    both = turns.withColumn("tied", F.lit(False)).unionByName(tied, allowMissingColumns=True)
    both = both.repartition(*SIDE)
    told = F.max("tied").over(Window.partitionBy(*SIDE, "pos"))
    both = both.withColumn("told", told).filter(F.col("asks") | ~F.col("told"))
    return both.filter(~F.col("tied")).drop("tied", "told")


def pair_by_key(
    messages: DataFrame,
    rules: Sequence[Rule] = WIRE_RULES,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
) -> DataFrame:
    """All ties of the archive: request_pos, reply_pos, rule, by_key, elapsed_ms.

    ``messages`` has a ``keys`` column. Rows are shuffled once for each of the two forms,
    unless some peer is busy; then queues and conversations are split by position.
    """
    rules = tuple(rules)
    busy = has_busy_peer(messages, rules, hot_rows)
    ties = chosen(met_in_queues(lined_up(queue_rows(messages, rules), busy, hot_rows, bits)))
    turns = untied(nameless_turns(messages, rules), ties, busy)
    if busy:
        turns, split = skew.with_split(turns, pairing.KEYS, hot_rows=hot_rows, bits=bits)
    else:
        turns, split = turns.withColumn("split", F.lit(skew.WHOLE).cast("bigint")), False
    by_time = pairing.paired_turns(turns, rules, split).filter(~F.col("asks"))
    by_time = by_time.select(
        "request_pos",
        F.col("pos").alias("reply_pos"),
        pairing.rule_number(rules).alias("rule"),
        F.lit(False).alias("by_key"),
        "elapsed_ms",
    )
    names = by_time.columns
    return ties.withColumn("by_key", F.lit(True)).select(*names).union(by_time)


def conversation(
    df: DataFrame,
    found: DataFrame,
    offset: int,
    limit: int,
    rules: Sequence[Rule] = WIRE_RULES,
) -> DataFrame:
    """A page of ``found``, a search in ``df``, with what each message carried and answers.

    ``request_pos`` is the request a row answers, wherever it is in ``df``, and ``request_row``
    its place on the page, from 0, if it is on it. Only messages of the page's peers are paired.
    """
    cut = page(found, offset, limit)
    if "keys" not in cut.columns:
        cut = cut.withColumn("keys", named_keys())
    if "detail" not in cut.columns:
        cut = cut.withColumn("detail", detail_text())
    rows = page_rows(df, cut, limit).withColumn("row", F.col("row_index") - offset)
    talk = df if "keys" in df.columns else df.withColumn("keys", named_keys())
    mine = rows.filter("peer_id IS NOT NULL").select("peer_id").distinct()
    ties = pair_by_key(talk.join(mine, "peer_id", "left_semi"), rules)
    answers = ties.select(F.col("reply_pos").alias("pos"), "request_pos", "elapsed_ms")
    place = rows.select(F.col("pos").alias("request_pos"), F.col("row").alias("request_row"))
    rows = rows.drop("row_index").join(answers, "pos", "left")
    return rows.join(place, "request_pos", "left")
