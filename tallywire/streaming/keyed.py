"""Replies paired with the requests whose keys they name, as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.operators import keyed
from tallywire.operators.keyed import QUEUE
from tallywire.operators.rules import WIRE_RULES, Rule
from tallywire.plans import skew
from tallywire.plans.sizes import settled
from tallywire.streaming.pairing import COLUMNS, TURN, PairingStep

WAITING = [*QUEUE, "multi", "window_ms", "pos", "ts_ms", "sign", "taken"]


class KeyedStep:
    """All ties of released messages, by key and, for those that name nothing, by timing.

    What is kept of a queue are the requests that wait in it, and a sign of life at the time
    of its last row; a queue that has been silent for longer than its window is forgotten.
    What is kept for timing is PairingStep's.
    """

    columns = [*COLUMNS, "keys"]

    def __init__(
        self,
        rules: Sequence[Rule] = WIRE_RULES,
        hot_rows: int = skew.HOT_ROWS,
        bits: int = skew.SPLIT_BITS,
    ) -> None:
        self.rules, self.hot_rows, self.bits = tuple(rules), hot_rows, bits
        self.timing = PairingStep(rules, hot_rows, bits)

    def run(self, ready: DataFrame, kept: DataFrame | None, now: int):
        busy = keyed.has_busy_peer(ready, self.rules, self.hot_rows)
        rows = keyed.queue_rows(ready, self.rules)
        turns_kept = None
        if kept is not None:
            rows = rows.unionByName(kept.filter("form = 'key'").select(*WAITING))
            turns_kept = kept.filter("form = 'time'").select(*TURN)
        rows = settled(keyed.lined_up(rows, busy, self.hot_rows, self.bits), "queues")
        met = keyed.met_in_queues(rows)
        ties = settled(keyed.chosen(met), "ties")
        turns = keyed.untied(keyed.nameless_turns(ready, self.rules), ties, busy)
        timed, turns = self.timing.of_turns(turns, turns_kept, now)
        names = ["request_pos", "reply_pos", "rule", "by_key", "elapsed_ms"]
        out = ties.withColumn("by_key", F.lit(True)).select(*names)
        timed = timed.filter("event = 'tie'").withColumn("by_key", F.lit(False))
        waiting = self._waiting(rows, met, ties, now).withColumn("form", F.lit("key"))
        turns = turns.withColumn("form", F.lit("time"))
        return out.union(timed.select(*names)), waiting.unionByName(turns, allowMissingColumns=True)

    def _waiting(self, rows: DataFrame, met: DataFrame, ties: DataFrame, now: int) -> DataFrame:
        last = rows.groupBy(*QUEUE).agg(
            F.max_by("run", "pos").alias("run"),
            F.max_by("ts_ms", "pos").alias("last_ts"),
            F.max("pos").alias("last_pos"),
        )
        requests = met.filter("reply_pos IS NULL").join(last, [*QUEUE, "run"])
        requests = requests.filter(F.lit(now) - F.col("last_ts") <= F.col("window_ms"))
        tied = ties.select("request_pos", "rule", F.lit(True).alias("tied")).distinct()
        requests = requests.join(tied, ["request_pos", "rule"], "left")
        taken = F.col("taken") | F.coalesce("tied", F.lit(False))
        rows = requests.select(
            *QUEUE,
            "multi",
            "window_ms",
            F.col("request_pos").alias("pos"),
            F.col("request_ts").alias("ts_ms"),
            F.lit(1).alias("sign"),
            taken.alias("taken"),
        )
        signs = requests.select(
            *QUEUE,
            "multi",
            "window_ms",
            F.col("last_pos").alias("pos"),
            F.col("last_ts").alias("ts_ms"),
            F.lit(0).alias("sign"),
            F.lit(False).alias("taken"),
        )
        return rows.union(signs.distinct()).select(*WAITING)
