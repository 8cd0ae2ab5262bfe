"""Which commands answer which requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SECOND = 1_000
MINUTE = 60 * SECOND


@dataclass(frozen=True)
class Rule:
    """A request, the commands that answer it, and how long it may wait.

    ``multi``: more than one message may answer one request. ``optional``: silence is normal,
    so the request is never counted as unanswered.
    """

    request: str
    replies: tuple[str, ...]
    multi: bool = False
    optional: bool = False
    window_ms: int = 2 * MINUTE


# The request and reply commands of the wire protocol and their time limits.
WIRE_RULES = (
    Rule("version", ("verack",)),
    Rule("ping", ("pong",), window_ms=20 * MINUTE),
    Rule("getaddr", ("addr", "addrv2"), multi=True, window_ms=3 * MINUTE),
    Rule("inv", ("getdata",), optional=True, window_ms=30 * SECOND),
    Rule(
        "getdata",
        ("tx", "block", "merkleblock", "cmpctblock", "notfound"),
        multi=True,
        window_ms=10 * MINUTE,
    ),
    Rule("getheaders", ("headers",)),
    Rule("getblocks", ("inv",)),
    Rule("cmpctblock", ("getblocktxn",), optional=True),
    Rule("getblocktxn", ("blocktxn", "notfound")),
    Rule("mempool", ("inv",), multi=True),
    Rule("getcfilters", ("cfilter",), multi=True),
    Rule("getcfheaders", ("cfheaders",)),
    Rule("getcfcheckpt", ("cfcheckpt",)),
)


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = WIRE_RULES) -> DataFrame:
    rows = [
        (n, r.request, list(r.replies), r.multi, r.optional, r.window_ms)
        for n, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows,
        "rule int, request string, replies array<string>, multi boolean, optional boolean, "
        "window_ms bigint",
    )


@dataclass(frozen=True)
class Contest:
    """Rules that share a reply command, decided together: at most one of each sort."""

    single: int | None
    multi: int | None


def contests(rules: Sequence[Rule]) -> list[Contest]:
    """Group rules by shared replies.

    Pairing handles one single-reply and one multi-reply rule competing for a command, which
    is all the wire protocol has; anything beyond that is refused.
    """
    names = [r.request for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("a request may have one rule only")
    groups: list[set[int]] = []
    for n, rule in enumerate(rules):
        joined = {n}
        apart = []
        for group in groups:
            shares = any(set(rules[m].replies) & set(rule.replies) for m in group)
            if shares:
                joined |= group
            else:
                apart.append(group)
        groups = [*apart, joined]
    out = []
    for group in sorted(groups, key=min):
        single = [n for n in sorted(group) if not rules[n].multi]
        multi = [n for n in sorted(group) if rules[n].multi]
        if len(single) > 1 or len(multi) > 1:
            raise ValueError(
                "two rules of the same sort share a reply: "
                + ", ".join(rules[n].request for n in sorted(group))
            )
        out.append(Contest(single[0] if single else None, multi[0] if multi else None))
    return out
