"""Pairing requests with the replies they most likely caused, by order and timing.

A request stays open until a newer one of its kind on the same peer and in the same direction
replaces it. A reply goes to the open request of the other direction that is not older than
its rule's window. A single-reply request is closed by its first reply.

Where two rules share a reply command (``notfound`` answers ``getdata`` and ``getblocktxn``)
the older request gets it. That choice needs no stepping through the messages: the open
multi-reply request of a moment is simply the last one sent, and a single-reply request is
taken by the first reply that would prefer it, since later ones find it closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.buckets import log2_bucket
from tallywire.functions.taxonomy import is_message
from tallywire.operators.distribution import folded, percentile, tally, unfolded
from tallywire.operators.rules import WIRE_RULES, Rule, contests, rules_frame
from tallywire.plans import skew

# Messages of one conversation: a peer, a contest of rules, the direction of the requests.
KEYS = ["peer_id", "contest", "asked_inbound"]


def _roles(rules: Sequence[Rule]) -> tuple[Column, list[str]]:
    """What each command can be: (contest, asks, answers single, answers multi, is multi)."""
    roles: dict[str, list[tuple]] = {}
    for n, contest in enumerate(contests(rules)):
        members = [m for m in (contest.single, contest.multi) if m is not None]
        for m in members:
            roles.setdefault(rules[m].request, []).append((n, True, rules[m].multi, False, False))
        for reply in sorted({r for m in members for r in rules[m].replies}):
            single = contest.single is not None and reply in rules[contest.single].replies
            multi = contest.multi is not None and reply in rules[contest.multi].replies
            roles.setdefault(reply, []).append((n, False, False, single, multi))
    out = None
    for command, found in sorted(roles.items()):
        value = F.array(
            *[
                F.struct(
                    F.lit(n).alias("contest"),
                    F.lit(asks).alias("asks"),
                    F.lit(of_multi).alias("of_multi"),
                    F.lit(single).alias("to_single"),
                    F.lit(multi).alias("to_multi"),
                )
                for n, asks, of_multi, single, multi in found
            ]
        )
        test = F.col("kind") == command
        out = F.when(test, value) if out is None else out.when(test, value)
    return out, sorted(roles)


def _by_contest(rules: Sequence[Rule], pick) -> Column:
    """A per-contest constant, looked up by contest number."""
    values = [F.lit(pick(c)) for c in contests(rules)]
    return F.element_at(F.array(*values), F.col("contest") + 1)


def conversation_rows(
    messages: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per message and part it plays, as request or as possible reply."""
    roles, commands = _roles(rules)
    return (
        messages.filter(is_message() & F.col("kind").isin(*commands))
        .select("peer_id", "pos", "ts_ms", "inbound", *keep, F.explode(roles).alias("role"))
        .select(
            "peer_id",
            F.col("role.contest").alias("contest"),
            F.when(F.col("role.asks"), F.col("inbound")).otherwise(~F.col("inbound")).alias(
                "asked_inbound"
            ),
            "pos",
            "ts_ms",
            F.col("role.asks").alias("asks"),
            F.col("role.of_multi").alias("of_multi"),
            F.col("role.to_single").alias("to_single"),
            F.col("role.to_multi").alias("to_multi"),
            *keep,
        )
    )


def with_open_requests(rows: DataFrame, split: bool) -> DataFrame:
    """Add the latest request of each sort before a row, and the next one after it."""
    in_split = Window.partitionBy(*KEYS, "split").orderBy("pos")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    sorts = {"s": F.col("asks") & ~F.col("of_multi"), "m": F.col("asks") & F.col("of_multi")}
    tests = {"s": "asks AND NOT of_multi", "m": "asks AND of_multi"}
    summary, running, local = [], {}, {}
    for x, asked in sorts.items():
        at = F.when(asked, F.col("pos"))
        request = F.when(asked, F.struct("pos", "ts_ms"))
        local[f"{x}_open"] = F.last(request, ignorenulls=True).over(earlier)
        local[f"{x}_next"] = F.expr(
            f"lead(CASE WHEN {tests[x]} THEN ts_ms END) IGNORE NULLS "
            f"OVER (PARTITION BY {', '.join(KEYS)}, split ORDER BY pos)"
        )
        summary += [
            F.max(at).alias(f"{x}_last_pos"),
            F.max_by("ts_ms", at).alias(f"{x}_last_ts"),
            F.min_by("ts_ms", at).alias(f"{x}_first_ts"),
        ]
        held = F.struct(F.col(f"{x}_last_pos").alias("pos"), F.col(f"{x}_last_ts").alias("ts_ms"))
        held = F.when(F.col(f"{x}_last_pos").isNotNull(), held)
        running[f"{x}_open_before"] = F.last(held, ignorenulls=True).over(skew.before(KEYS))
        running[f"{x}_next_after"] = F.last(f"{x}_first_ts", ignorenulls=True).over(skew.after(KEYS))
    out = rows.withColumns(local)
    if split:
        states = skew.carry_states(rows, KEYS, summary, running)
        out = out.join(states, [*KEYS, "split"], "left").withColumns(
            {f"{x}_open": F.coalesce(f"{x}_open", f"{x}_open_before") for x in sorts}
            | {f"{x}_next": F.coalesce(f"{x}_next", f"{x}_next_after") for x in sorts}
        )
    final = {}
    for x in sorts:
        final |= {f"{x}_pos": F.col(f"{x}_open.pos"), f"{x}_ts": F.col(f"{x}_open.ts_ms")}
        final |= {f"{x}_next_ts": F.col(f"{x}_next")}
    return out.select(*rows.columns, *[c.alias(n) for n, c in final.items()])


def _with_claims(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Mark the requests a reply could answer, and whether it prefers the single one."""
    window = {
        "s": _by_contest(rules, lambda c: -1 if c.single is None else rules[c.single].window_ms),
        "m": _by_contest(rules, lambda c: -1 if c.multi is None else rules[c.multi].window_ms),
    }
    ahead = _by_contest(
        rules, lambda c: c.single is not None and (c.multi is None or c.single < c.multi)
    )

    def fits(x: str, answers: str) -> Column:
        waited = F.greatest(F.col("ts_ms") - F.col(f"{x}_ts"), F.lit(0))
        fit = F.col(answers) & F.col(f"{x}_pos").isNotNull() & (waited <= window[x])
        return F.coalesce(~F.col("asks") & fit, F.lit(False))

    older = (F.col("s_ts") < F.col("m_ts")) | ((F.col("s_ts") == F.col("m_ts")) & ahead)
    return rows.withColumns(
        {"fits_s": fits("s", "to_single"), "fits_m": fits("m", "to_multi")}
    ).withColumn("prefers_s", F.col("fits_s") & (~F.col("fits_m") | older))


def _with_earlier(
    rows: DataFrame, claim: str, at: str, name: str, split: bool
) -> DataFrame:
    """Add whether an earlier row has ``claim`` set for the same request ``at``.

    Inside a split this is a window. Of the requests from before a split only the last one
    can still be open, and requests are claimed in the order they were sent, so all that a
    split needs to know is the latest request claimed in front of it.
    """
    so_far = (
        Window.partitionBy(*KEYS, "split", at)
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumn(name, F.coalesce(F.bool_or(claim).over(so_far), F.lit(False)))
    if not split:
        return out
    states = skew.carry_states(
        rows.filter(F.col(claim)),
        KEYS,
        [F.max(at).alias("latest")],
        {"_claimed": F.max("latest").over(skew.before(KEYS))},
    )
    return (
        out.join(states, [*KEYS, "split"], "left")
        .withColumn(name, F.col(name) | F.coalesce(F.col("_claimed") == F.col(at), F.lit(False)))
        .drop("_claimed")
    )


def paired_rows(
    messages: DataFrame,
    rules: Sequence[Rule],
    hot_rows: int,
    bits: int,
    keep: Sequence[str] = (),
    plays: Column | None = None,
) -> tuple[DataFrame, bool]:
    """Every request and possible reply in one table, with the request a reply is tied to.

    ``of_multi`` tells the sort of the request meant, ``request_pos`` and ``request_ts``
    which one it is: a request's own place, or the request a reply is tied to. Replies tied
    to none are left out. Also tells whether any key was split.
    """
    rows = conversation_rows(messages, rules, keep)
    if plays is not None:
        rows = rows.filter(plays).drop(*keep)
    rows, split = skew.with_split(rows, KEYS, hot_rows=hot_rows, bits=bits)
    return paired_turns(rows, rules, split), split


def paired_turns(rows: DataFrame, rules: Sequence[Rule], split: bool) -> DataFrame:
    """The same from the parts that messages play, with their split."""
    rows = _with_claims(with_open_requests(rows, split), rules)
    takes = F.lit(False)
    if any(c.single is not None for c in contests(rules)):
        # The first reply to prefer a single-reply request closes it for the others.
        rows = _with_earlier(rows, "prefers_s", "s_pos", "closed", split)
        takes = F.col("prefers_s") & ~F.col("closed")
    multi = F.when(F.col("asks"), F.col("of_multi")).otherwise(~takes)
    pos = F.when(takes, F.col("s_pos")).when(F.col("fits_m"), F.col("m_pos"))
    ts = F.when(takes, F.col("s_ts")).when(F.col("fits_m"), F.col("m_ts"))
    next_ts = F.when(F.col("of_multi"), F.col("m_next_ts")).otherwise(F.col("s_next_ts"))
    paired = rows.select(
        *KEYS,
        "split",
        "asks",
        multi.alias("of_multi"),
        F.when(F.col("asks"), F.col("pos")).otherwise(pos).alias("request_pos"),
        F.when(F.col("asks"), F.col("ts_ms")).otherwise(ts).alias("request_ts"),
        F.when(F.col("asks"), next_ts).alias("next_ts"),
        "pos",
        F.when(~F.col("asks"), F.greatest(F.col("ts_ms") - ts, F.lit(0))).alias("elapsed_ms"),
    )
    return paired.filter(F.col("request_pos").isNotNull())


def rule_number(rules: Sequence[Rule]) -> Column:
    single = _by_contest(rules, lambda c: -1 if c.single is None else c.single)
    multi = _by_contest(rules, lambda c: -1 if c.multi is None else c.multi)
    return F.when(F.col("of_multi"), multi).otherwise(single)


def with_first_replies(rows: DataFrame, split: bool) -> DataFrame:
    """Add to the paired rows whether their request has had a reply before, as ``again``."""
    # A single-reply request has one reply, which is its first.
    rows = rows.withColumn("one_of_many", ~F.col("asks") & F.col("of_multi"))
    marked = _with_earlier(rows, "one_of_many", "request_pos", "again", split)
    return marked.drop("one_of_many")


def pair_by_timing(
    messages: DataFrame,
    rules: Sequence[Rule] = WIRE_RULES,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
    keep: Sequence[str] = (),
    plays: Column | None = None,
) -> DataFrame:
    """Every tied reply with its request, over the whole archive.

    ``inbound`` is the reply's direction. ``first_reply`` marks the reply that made the
    request an answered one. ``plays`` tells, from ``asks`` and the columns ``keep`` of a
    message, which of its parts count.
    """
    rows, split = paired_rows(messages, rules, hot_rows, bits, keep, plays)
    marked = with_first_replies(rows, split)
    return marked.filter(~F.col("asks")).select(
        rule_number(rules).alias("rule"),
        "peer_id",
        (~F.col("asked_inbound")).alias("inbound"),
        "request_pos",
        F.col("pos").alias("reply_pos"),
        "elapsed_ms",
        (~F.col("again")).alias("first_reply"),
    )


def with_replies(rows: DataFrame, split: bool, bits: int) -> DataFrame:
    """Add to the paired rows how many replies their request has.

    A request and its replies are in one split, or the replies are in later ones; then they
    are counted there, at most one carried request of each sort per split.
    """
    request = [*KEYS, "of_multi", "request_pos"]
    here = Window.partitionBy(*KEYS, "split", "of_multi", "request_pos")
    out = rows.withColumn("replies", F.count_if(~F.col("asks")).over(here))
    if not split:
        return out
    carried_over = F.col("request_pos") < F.shiftleft(F.col("split"), bits)
    later = (
        rows.filter((F.col("split") != skew.WHOLE) & ~F.col("asks") & carried_over)
        .groupBy(*request)
        .agg(F.count(F.lit(1)).alias("_later"))
    )
    total = F.col("replies") + F.coalesce("_later", F.lit(0))
    return out.join(later, request, "left").withColumn("replies", total).drop("_later")


def fate(rules: Sequence[Rule], end: Column) -> Column:
    """What became of a request, from a paired row that is one."""
    optional = F.element_at(F.array(*[F.lit(r.optional) for r in rules]), F.col("rule") + 1)
    window = F.element_at(F.array(*[F.lit(r.window_ms) for r in rules]), F.col("rule") + 1)
    asked = F.col("request_ts")
    waited_out = F.greatest(end - asked, F.lit(0)) > window
    replaced_after = F.greatest(F.col("next_ts") - asked, F.lit(0)) > window
    silent = (
        F.when(F.col("next_ts").isNull(), waited_out)
        .when(F.col("of_multi"), replaced_after)
        .otherwise(F.lit(True))
    )
    return (
        F.when(F.col("replies") > 0, "answered")
        .when(~optional & silent & F.col("asked_inbound"), "unanswered_by_us")
        .when(~optional & silent, "unanswered_by_peers")
        .otherwise("undetermined")
    )


def archive_end(events: DataFrame) -> Column:
    return events.agg(F.max("ts_ms").alias("end")).scalar()


def request_fate(
    events: DataFrame,
    rules: Sequence[Rule] = WIRE_RULES,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
) -> DataFrame:
    """What became of every request: answered, unanswered (by whom) or undetermined.

    A request still inside its window when the archive ends, or replaced inside it where
    several replies are allowed, is undetermined, and so is an ignored announcement.
    """
    rows, split = paired_rows(events, rules, hot_rows, bits)
    return (
        with_replies(rows, split, bits)
        .filter("asks")
        .withColumn("rule", rule_number(rules))
        .select(
            "rule",
            "peer_id",
            F.col("asked_inbound").alias("inbound"),
            "request_pos",
            F.col("request_ts").alias("ts_ms"),
            "replies",
            fate(rules, archive_end(events)).alias("fate"),
        )
    )


FATES = ["answered", "unanswered_by_peers", "unanswered_by_us", "undetermined"]


def exchange_report(
    events: DataFrame,
    rules: Sequence[Rule] = WIRE_RULES,
    hot_rows: int = skew.HOT_ROWS,
    bits: int = skew.SPLIT_BITS,
) -> DataFrame:
    """Per rule: how its requests fared, and how long the answers of either side took.

    ``peer_*`` times replies that came in, ``our_*`` replies this node sent.
    """
    rows, split = paired_rows(events, rules, hot_rows, bits)
    rows = with_replies(rows, split, bits).withColumn("rule", rule_number(rules))
    asks = F.col("asks")
    side = F.when(F.col("asked_inbound"), "our").otherwise("peer")
    # Requests are counted by fate and replies by side and bucket, in one pass.
    both = rows.groupBy(
        "rule",
        F.when(asks, fate(rules, archive_end(events))).alias("fate"),
        F.when(~asks, side).alias("side"),
        log2_bucket(F.col("elapsed_ms")).alias("bucket"),
    ).agg(
        F.count_if(asks).alias("requests"),
        *[c.alias(n) for n, c in tally("elapsed_ms").items()],
    )
    out = both.groupBy("rule").agg(
        F.sum("requests").alias("opened"),
        *[
            F.coalesce(F.sum(F.when(F.col("fate") == f, F.col("requests"))), F.lit(0)).alias(f)
            for f in FATES
        ],
        *folded(F.col("side") == "peer", "peer_"),
        *folded(F.col("side") == "our", "our_"),
    )
    out = unfolded(out, "peer_", "our_").withColumns(
        {
            f"{side}_p{q}_ms": percentile(q / 100, f"{side}_")
            for side in ("peer", "our")
            for q in (50, 90, 99)
        }
    )
    names = rules_frame(events.sparkSession, rules).select("rule", "request", "replies", "optional")
    return (
        out.withColumn("unanswered", F.col("unanswered_by_peers") + F.col("unanswered_by_us"))
        .join(F.broadcast(names), "rule")  # one row per rule
    )


def replies_captured(events: DataFrame, rules: Sequence[Rule] = WIRE_RULES) -> DataFrame:
    """Per rule: whether any command that answers it is in the archive at all."""
    seen = events.filter(F.col("event_group") == "message").select(F.col("kind").alias("reply")).distinct()
    wanted = rules_frame(events.sparkSession, rules).select(
        "rule", "request", F.explode("replies").alias("reply")
    )
    found = wanted.join(seen.withColumn("hit", F.lit(True)), "reply", "left")
    return found.groupBy("rule", "request").agg(
        F.bool_or(F.coalesce("hit", F.lit(False))).alias("replies_captured")
    )


def unanswered_is_meaningful(report: DataFrame, captured: DataFrame) -> DataFrame:
    """One row: False where a rule has unanswered requests but its replies were never captured."""
    both = report.join(captured.select("rule", "replies_captured"), "rule")
    fine = (F.col("unanswered") == 0) | F.col("replies_captured")
    return both.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("unanswered_meaningful"))
