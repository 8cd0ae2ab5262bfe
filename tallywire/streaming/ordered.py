"""Streams whose results are those of the archive in its order, however files arrive.

Rows of a batch wait in a table until the watermark has passed them and all rows before them.
Then they are released, in the order of their positions, to a step: a batch operator over the
released rows and the rows it kept from earlier steps. So nothing has a second, slower form for
streams, windows and splits of busy keys included, and no Python runs.

Every batch writes its own versions of all tables, the clock last, and reads those of the batch
before it. A batch that is run again, after a failure or a restart, overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.plans.sizes import broadcast_if_small
from tallywire.session import shared_folder
from tallywire.sources.archive import POSITION_BITS, file_name_of, number_files

FILE = ["file_path", "record_no"]


class Step(Protocol):
    """A batch operator that can go on where it stopped."""

    columns: Sequence[str]  # of the stream's rows, ``pos`` and ``ts_ms`` among them

    def run(
        self, ready: DataFrame, kept: DataFrame | None, now: int
    ) -> tuple[DataFrame, DataFrame]:
        """Results of the released rows, and the rows to keep for the next step.

        No row still to come is older than ``now``, in ms, or stands before a released one.
        """


@dataclass(frozen=True)
class Clock:
    """What one batch left behind: rows before ``frontier`` are released for good."""

    watermark: int = -(2**62)
    frontier: int = 0
    now: int = -(2**62)


class OrderedRun:
    """The tables of one ordered stream below a folder, and the work of a batch.

    ``delay_ms``: how long after the newest row older ones may still arrive. ``skew_ms``: how
    far time may run backwards along the archive. Rows that arrive behind the frontier are
    kept apart and counted, see ``late``. With ``numbered`` rows have no ``pos`` yet but a
    ``file_path`` and ``record_no``, and a ledger of files gives them one: files are numbered
    in archive order among those not yet begun, and a number is final once a row of the file
    is released. A late file that belongs before it is late as a whole.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        step: Step,
        delay_ms: int,
        skew_ms: int = 0,
        numbered: bool = False,
    ) -> None:
        self.spark, self.folder, self.step = spark, folder, step
        self.delay_ms, self.skew_ms, self.numbered = delay_ms, skew_ms, numbered

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch_id={batch_id}"

    def _write(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch_id))
        return self._read(table, batch_id)

    def _read(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self._path(table, batch_id))

    def _clock(self, batch_id: int) -> Clock:
        if batch_id < 0:
            return Clock()
        return Clock(**self._read("clock", batch_id).first().asDict())

    def last_batch(self) -> int:
        """The last batch that is complete, or -1."""
        try:
            found = self.spark.read.parquet(f"{self.folder}/clock").agg(F.max("batch_id")).first()
        except AnalysisException:  # no batch has been run
            return -1
        return found[0]

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """What ``foreachBatch`` calls."""
        before = self._clock(batch_id - 1)
        names = [c for c in self.step.columns if c != "pos"]
        fresh = batch.select(*names, *(FILE if self.numbered else ["pos"]))
        if batch_id > 0:
            waiting = self._read("arrived", batch_id - 1).filter(~F.col("late"))
            waiting = waiting.filter(F.col("pos") >= before.frontier).drop("late")
            if self.numbered:
                waiting = waiting.drop("pos")
            fresh = waiting.unionByName(fresh)
        if self.numbered:
            fresh = self._with_position(fresh, before, batch_id)
        late = F.col("pos").isNull() | (F.col("pos") < before.frontier)
        arrived = self._write(fresh.withColumn("late", late), "arrived", batch_id)
        clock = self._advanced(arrived, before)
        ready = arrived.filter(~F.col("late") & (F.col("pos") < clock.frontier))
        kept = self._read("kept", batch_id - 1) if batch_id > 0 else None
        out, kept = self.step.run(ready.select(*self.step.columns), kept, clock.now)
        self._write(out, "out", batch_id)
        self._write(kept, "kept", batch_id)
        line = self.spark.createDataFrame(
            [(clock.watermark, clock.frontier, clock.now)],
            "watermark bigint, frontier bigint, now bigint",
        )
        self._write(line.coalesce(1), "clock", batch_id)

    def _advanced(self, arrived: DataFrame, before: Clock) -> Clock:
        rows = arrived.filter(~F.col("late"))
        newest, last = rows.agg(F.max("ts_ms"), F.max("pos")).first()
        if newest is None:
            return before
        watermark = max(before.watermark, newest - self.delay_ms)
        open_row = F.col("ts_ms") + self.skew_ms >= watermark
        first = rows.agg(F.min(F.when(open_row, F.col("pos")))).first()[0]
        if first is not None:
            # No further than the last row released: an older file may still fill the gap.
            last = rows.filter(F.col("pos") < first).agg(F.max("pos")).first()[0]
        frontier = before.frontier if last is None else last + 1
        oldest = rows.filter(F.col("pos") >= frontier).agg(F.min("ts_ms")).first()[0]
        now = watermark if oldest is None else min(watermark, oldest)
        return Clock(watermark, frontier, max(before.now, now))

    def _with_position(self, rows: DataFrame, before: Clock, batch_id: int) -> DataFrame:
        """``pos`` by the ledger of files; null for rows of files that came too late."""
        paths = rows.select("file_path").distinct()
        files = paths.withColumn("file_name", file_name_of(F.col("file_path")))
        begun = None
        if batch_id > 0:
            ledger = self._read("ledger", batch_id - 1)
            begun = ledger.filter(
                F.col("file_no").isNull()
                | (F.shiftleft("file_no", POSITION_BITS) < before.frontier)
            )
            files = files.join(broadcast_if_small(begun.select("file_path")), "file_path", "left_anti")
        files = number_files(files)
        if begun is not None:
            # One row per file; the last of those begun is the one all others must follow.
            key = F.struct(
                F.col("file_ts").isNotNull().alias("timed"), "file_ts", "file_name", "file_path"
            )
            final = begun.filter("file_no IS NOT NULL")
            last = final.agg(F.max_by(key, "file_no").alias("last"), F.max("file_no").alias("top"))
            found = last.first()
            if found.top is not None:
                limit = F.lit(found.top + 1).cast("bigint")
                types = ["boolean", "bigint", "string", "string"]
                pairs = zip(found.last, types, strict=True)
                after = key > F.struct(*[F.lit(v).cast(t) for v, t in pairs])
                ahead = files.agg(F.count_if(~after)).first()[0]
                number = F.when(after, F.col("file_no") - F.lit(ahead) + limit)
                files = files.withColumn("file_no", number)
            files = begun.unionByName(files.select(*begun.columns))
        ledger = self._write(files, "ledger", batch_id)
        numbers = broadcast_if_small(ledger.select("file_path", "file_no"))
        pos = F.shiftleft("file_no", POSITION_BITS) + F.col("record_no")
        return rows.join(numbers, "file_path").withColumn("pos", pos).drop("file_no")

    def table(self) -> DataFrame:
        """All results so far."""
        out = self.spark.read.parquet(f"{self.folder}/out")
        return out.filter(F.col("batch_id") <= self.last_batch()).drop("batch_id")

    def late(self) -> DataFrame:
        """The rows that came behind the frontier and count nowhere."""
        rows = self.spark.read.parquet(f"{self.folder}/arrived")
        return rows.filter(F.col("late") & (F.col("batch_id") <= self.last_batch()))

    def ledger(self) -> DataFrame:
        """The files of a numbered stream; ``file_no`` is null for one that came too late."""
        return self._read("ledger", self.last_batch())

    def drained(self) -> DataFrame:
        """All results if nothing else were to come; nothing is committed."""
        last = self.last_batch()
        clock = self._clock(last)
        rows = self._read("arrived", last).filter(~F.col("late"))
        rows = rows.filter(F.col("pos") >= clock.frontier)
        newest = rows.agg(F.max("ts_ms")).first()[0]
        now = clock.now if newest is None else max(clock.now, newest)
        rest, _ = self.step.run(rows.select(*self.step.columns), self._read("kept", last), now)
        return self.table().unionByName(rest)


def run_ordered(
    stream: DataFrame,
    step: Step,
    name: str,
    delay_ms: int,
    skew_ms: int = 0,
    folder: str | None = None,
    numbered: bool = False,
) -> OrderedRun:
    """Run a stream to the end of the present input. Given a ``folder``, go on in it."""
    spark = stream.sparkSession
    run = OrderedRun(
        spark, folder or shared_folder(spark, name), step, delay_ms, skew_ms, numbered
    )
    query = (
        stream.writeStream.option("checkpointLocation", f"{run.folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(run.on_batch)
        .start()
    )
    query.awaitTermination()
    return run
