"""Tallies of an archive kept per file, so that a new file costs only itself.

A store is a folder of tables with rows per file: counts of kinds per tick, what peers did, and
how long connections lasted. Files are added in batches. Every batch writes folders of its own
and last its entries in the ledger of files, and rows count only where the ledger's latest entry
of their file names their batch. So a batch that was cut off counts for nothing, a file that is
added again replaces itself, and files may come in any order: positions are kept within the
file, and files are numbered when a question is asked.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.labels import share
from tallywire.functions.taxonomy import classify
from tallywire.operators import peers, timeline
from tallywire.schema import WIRE_EVENTS
from tallywire.sources import archive as source

FILE = "file_path"


class TallyStore:
    """The store below ``folder``, which every executor can reach.

    It answers as the operators over all events of its files do. A store without files has
    no events. Two writers at a time leave the files of both; of a file that both add, the
    rows of one count.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def files(self) -> DataFrame:
        """file_path, size_bytes, decode_errors and batch of every file, by its latest entry."""
        try:
            entries = self.spark.read.parquet(f"{self.folder}/ledger")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            columns = "file_path string, size_bytes bigint, decode_errors bigint, batch string"
            return self.spark.createDataFrame([], columns)
        newest = F.max_by(F.struct("size_bytes", "decode_errors", "batch"), "batch")
        return entries.groupBy(FILE).agg(newest.alias("e")).select(FILE, "e.*")

    def pending(self, files: DataFrame) -> DataFrame:
        """Those of ``files`` (file_path, size_bytes) not yet in the store with this size."""
        known = self.files().select(FILE, "size_bytes")
        return files.join(known, [FILE, "size_bytes"], "left_anti")

    def update(self, path: str | list[str], fmt: str = "parquet", schema=WIRE_EVENTS) -> int:
        """Add the files below ``path`` that are new or have grown; how many there were.

        Their paths come to the driver, because a reader is given them.
        """
        new = self.pending(source.list_files(self.spark, path)).select(FILE, "size_bytes").collect()
        if new:
            raw = source.read_raw(self.spark, [r[FILE] for r in new], fmt, schema)
            good, bad = source.quarantine(raw)
            listed = self.spark.createDataFrame(new, f"{FILE} string, size_bytes bigint")
            self.add(classify(good), listed, bad)
        return len(new)

    def add(self, events: DataFrame, files: DataFrame, bad: DataFrame | None = None) -> None:
        """Add classified events (file_path, record_no) that are all of ``files``."""
        last = self.files().agg(F.max(F.substring("batch", 2, 8).cast("int"))).first()[0]
        batch = f"b{(last or 0) + 1:08d}-{uuid.uuid4().hex}"
        own = events.withColumn("pos", F.col("record_no"))
        for name, rows in (
            ("ticks", timeline.ticks(own, [FILE])),
            ("peers", peers.peer_parts(own, [FILE])),
            ("durations", peers.duration_tallies(own, [FILE])),
        ):
            rows.write.parquet(f"{self.folder}/{name}/batch={batch}")
        entries = files.select(FILE, "size_bytes").distinct()
        if bad is None:
            entries = entries.withColumn("decode_errors", F.lit(0).cast("bigint"))
        else:
            errors = bad.groupBy(FILE).agg(F.count(F.lit(1)).alias("decode_errors"))
            entries = entries.join(errors, FILE, "left").fillna(0, ["decode_errors"])
        entries.write.parquet(f"{self.folder}/ledger/batch={batch}")

    def _rows(self, name: str) -> DataFrame:
        """The rows of a table that count."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            raise ValueError(f"no files have been added below {self.folder}") from error
        return rows.join(self.files().select(FILE, "batch"), [FILE, "batch"])

    def totals(self) -> DataFrame:
        """As ``timeline.totals``, with the unreadable records of the files."""
        seen = self._rows("peers").agg(F.count_distinct("peer_id").alias("n")).scalar()
        errors = self.files().agg(F.coalesce(F.sum("decode_errors"), F.lit(0)).alias("n")).scalar()
        return (
            self._rows("ticks")
            .groupBy("event_group", "kind")
            .agg(F.sum("cnt").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
                F.count_distinct("event_group", "kind").alias("kinds"),
                F.min("low").alias("first_ts"),
                F.max("high").alias("last_ts"),
                F.coalesce(F.max("high") - F.min("low"), F.lit(0)).alias("duration_ms"),
            )
            .withColumns({"peers": seen, "decode_errors": errors})
            .select("events", "peers", "kinds", "first_ts", "last_ts", "duration_ms", "decode_errors")
        )

    def breakdown(self) -> DataFrame:
        """As ``timeline.breakdown``."""
        kinds = self._rows("ticks").groupBy("category", "event_group", "kind", "label")
        counts = kinds.agg(F.sum("cnt").alias("cnt"))
        total = counts.agg(F.sum("cnt").alias("n")).scalar()
        return counts.withColumn("share", share(F.col("cnt"), total)).orderBy(
            F.desc("cnt"), "event_group", "kind"
        )

    def timeline(self, by: str = "kind", max_bins: int | None = None) -> DataFrame:
        """As ``timeline.timeline``: the grid widens as files come, whatever their order."""
        return timeline.timeline_of_ticks(self._rows("ticks"), by, max_bins)

    def peer_table(self) -> DataFrame:
        """As ``peers.peer_table``; positions are those of all files now in the store."""
        names = self.files().select(FILE, source.file_name_of(F.col(FILE)).alias("file_name"))
        numbered = source.number_files(names).select(FILE, "file_no")
        base = F.shiftleft("file_no", source.POSITION_BITS)
        parts = self._rows("peers").join(numbered, FILE)
        placed = parts.withColumns({c: F.col(c) + base for c in peers.POSITIONS})
        return peers.merged_peers(placed)

    def connection_durations(self, ending: str = "all") -> DataFrame:
        """As ``peers.connection_durations``."""
        return peers.merged_durations(self._rows("durations"), ending)
