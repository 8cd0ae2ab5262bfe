"""Reading events as a stream, and running a stream over what is there now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.taxonomy import classify
from tallywire.schema import WIRE_EVENTS
from tallywire.session import shared_folder
from tallywire.sources.archive import CORRUPT, file_path, parse_lines, quarantine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# How much a batch reads. It bounds what one key's rows of a batch can come to in a
# stateful operator, however busy the key is.
BYTES_PER_TRIGGER = 1 << 30


def _limited(reader, files_per_trigger: int | None):
    if files_per_trigger:
        return reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A Parquet table as a stream of its files. ``path`` may be a folder or a file."""
    reader = _limited(spark.readStream.schema(schema), files_per_trigger)
    # The star lets a single file stand where a folder is expected.
    return reader.parquet(path if path.endswith("/") else f"{path}*")


def stream_raw(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = WIRE_EVENTS,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The files of an archive as a stream of records, as ``read_raw`` gives them.

    Every record has the path of its file and its number in it, but no place in the archive
    yet: that takes the files before it (see ``OrderedRun``).
    """
    if fmt == "json":
        reader = _limited(spark.readStream, files_per_trigger)
        lines = reader.text(path).select("value", file_path()).filter(F.trim("value") != "")
        return parse_lines(lines, schema)
    raw = stream_table(spark, path, schema, files_per_trigger)
    raw = raw.select("*", file_path(), F.col("_metadata.row_index").alias("_row"))
    own = F.coalesce("record_no", "_row") if "record_no" in schema.names else F.col("_row")
    raw = raw.withColumn("record_no", own).drop("_row")
    return raw.withColumn(CORRUPT, F.lit(None).cast("string"))


def stream_events(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = WIRE_EVENTS,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The readable events of an archive as its files arrive, classified, not yet numbered."""
    good, _ = quarantine(stream_raw(spark, path, fmt, schema, files_per_trigger))
    return classify(good)


def with_event_time(df: DataFrame, delay: str) -> DataFrame:
    """Add ``ts`` and let rows come up to ``delay`` late.

    Later ones are dropped by stateful operators; the query's progress counts them in
    ``numRowsDroppedByWatermark``.
    """
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def run_appending(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to the end of the present input and read its table."""
    folder = shared_folder(spark, name)
    spark.conf.set(PROVIDER, ROCKSDB)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{folder}/table")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_updating(
    spark: SparkSession, stream: DataFrame, name: str, keys: Sequence[str]
) -> DataFrame:
    """Run an update-mode stream and read the latest row of every key.

    Every batch writes its changed rows to a folder of its own and overwrites it when run
    again, so a repeated batch changes nothing.
    """
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    versioned = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return latest(spark.read.schema(versioned).parquet(f"{folder}/table"), keys)


def latest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch_id").alias("v")
    )
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
