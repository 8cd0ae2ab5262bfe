"""Requests and replies paired as they arrive, and silence once a window has passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.operators import pairing
from tallywire.operators.pairing import KEYS
from tallywire.operators.rules import WIRE_RULES, Rule
from tallywire.plans import skew
from tallywire.plans.sizes import settled

COLUMNS = ["peer_id", "pos", "ts_ms", "event_group", "kind", "inbound"]
TURN = [*KEYS, "pos", "ts_ms", "asks", "of_multi", "to_single", "to_multi"]
OUT = [
    "event", "rule", "peer_id", "inbound", "request_pos", "reply_pos", "elapsed_ms",
    "first_reply", "fate",
]


class PairingStep:
    """Ties of released messages, and fates of requests as soon as they are certain.

    What is kept are the requests still open, at most two per peer, contest and direction, as
    rows in their old places. One that has had a reply is followed by a stand-in for it:
    places are doubled, and the odd ones are for these. The first reply is reported as a tie
    and as the fate of its request; a request is reported as silent when its window has
    passed or another takes its place; until then nothing is said about it.
    """

    columns = COLUMNS

    def __init__(
        self,
        rules: Sequence[Rule] = WIRE_RULES,
        hot_rows: int = skew.HOT_ROWS,
        bits: int = skew.SPLIT_BITS,
    ) -> None:
        self.rules, self.hot_rows, self.bits = tuple(rules), hot_rows, bits + 1

    def run(self, ready: DataFrame, kept: DataFrame | None, now: int):
        return self.of_turns(pairing.conversation_rows(ready, self.rules), kept, now)

    def of_turns(self, turns: DataFrame, kept: DataFrame | None, now: int):
        rows = turns.withColumn("pos", F.col("pos") * 2).select(*TURN)
        if kept is not None:
            rows = rows.unionByName(kept)
        rows, split = skew.with_split(rows, KEYS, hot_rows=self.hot_rows, bits=self.bits)
        met = pairing.paired_turns(rows, self.rules, split)
        met = pairing.with_first_replies(met, split)
        met = pairing.with_replies(met, split, self.bits)
        met = met.withColumn("rule", pairing.rule_number(self.rules))
        met = settled(met, "paired")
        return self._results(met, now), self._open(met, now)

    def _waited_out(self, now: int):
        window = F.element_at(
            F.array(*[F.lit(r.window_ms).cast("bigint") for r in self.rules]), F.col("rule") + 1
        )
        return F.lit(now) - F.col("request_ts") > window

    def _results(self, met: DataFrame, now: int) -> DataFrame:
        nothing = F.lit(None)
        stand_in = ~F.col("asks") & (F.col("pos") % 2 == 1)
        ties = met.filter(~F.col("asks") & ~stand_in).select(
            F.lit("tie").alias("event"),
            "rule",
            "peer_id",
            (~F.col("asked_inbound")).alias("inbound"),
            F.expr("request_pos div 2").alias("request_pos"),
            F.expr("pos div 2").alias("reply_pos"),
            "elapsed_ms",
            (~F.col("again")).alias("first_reply"),
            nothing.cast("string").alias("fate"),
        )
        key = [*KEYS, "of_multi", "request_pos"]
        said = met.filter(stand_in).select(*key)
        certain = (F.col("replies") > 0) | F.col("next_ts").isNotNull() | self._waited_out(now)
        fates = met.filter(F.col("asks") & certain).join(said, key, "left_anti")
        fates = fates.select(
            F.lit("fate").alias("event"),
            "rule",
            "peer_id",
            F.col("asked_inbound").alias("inbound"),
            F.expr("request_pos div 2").alias("request_pos"),
            nothing.cast("bigint").alias("reply_pos"),
            nothing.cast("bigint").alias("elapsed_ms"),
            nothing.cast("boolean").alias("first_reply"),
            pairing.fate(self.rules, F.lit(now)).alias("fate"),
        )
        return ties.union(fates).select(*OUT)

    def _open(self, met: DataFrame, now: int) -> DataFrame:
        latest = F.col("asks") & F.col("next_ts").isNull() & ~self._waited_out(now)
        takes_more = F.col("of_multi") | (F.col("replies") == 0)
        live = met.filter(latest & takes_more)
        turn = [F.col(k) for k in KEYS]

        def rows(of, place, asks, of_multi, to_multi):
            return of.select(
                *turn,
                place.alias("pos"),
                F.col("request_ts").alias("ts_ms"),
                F.lit(asks).alias("asks"),
                of_multi.alias("of_multi"),
                F.lit(False).alias("to_single"),
                F.lit(to_multi).alias("to_multi"),
            )

        requests = rows(live, F.col("request_pos"), True, F.col("of_multi"), False)
        replied = live.filter("replies > 0")
        stand_ins = rows(replied, F.col("request_pos") + 1, False, F.lit(False), True)
        return requests.union(stand_ins).select(*TURN)
