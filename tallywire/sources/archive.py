"""Reading archives of decoded events, and writing results."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.taxonomy import classify
from tallywire.plans.sizes import broadcast_if_small
from tallywire.schema import WIRE_EVENTS

CORRUPT = "_corrupt_record"
# Archive position = file number * 2**POSITION_BITS + record number.
POSITION_BITS = 36
PROBE_BYTES = 128 << 20  # files up to this size are probed whole; a task holds one or two
PIECE = 1 << 14  # bytes decompressed at once, so that little is held however well they pack
PROBED = r"\.(gz|bz2|zst)$"  # codecs, by the ends of names, that are gone through
UNPROBED = r"\.(deflate|lz4|snappy)$"
# What a failed read names when it is not the file's content that is to blame.
NO_DAMAGE = ("FILE_NOT_EXIST", "AccessControlException", "BlockMissingException", "OutOfMemory")
# Rotated files carry their time in the name: <base>.YYYYMMDD-HHMMSS-mmm.<ext>[.<codec>].
# It is matched from the right because the base may hold dots.
NAME_TIME = r"\.(\d{8}-\d{6}-\d{3})\.[^.]+(\.[^.]+)?$"


def file_time_ms(name: Column) -> Column:
    """The rotation time in a file name in ms; NULL where the name has none."""
    stamp = F.regexp_extract(name, NAME_TIME, 1)
    # The text is UTC whatever the session's zone is, so the parts are turned into days and ms.
    day = F.when(stamp != "", F.to_date(F.substring(stamp, 1, 8), "yyyyMMdd"))
    part = lambda start, n: F.substring(stamp, start, n).try_cast("bigint")
    of_day = ((part(10, 2) * 60 + part(12, 2)) * 60 + part(14, 2)) * 1000 + part(17, 3)
    return F.unix_date(day).cast("bigint") * 86_400_000 + of_day


def file_path() -> Column:
    """What every file is known by. Spark encodes special characters in it, everywhere alike."""
    return F.col("_metadata.file_path").alias("file_path")


def file_name_of(path: Column) -> Column:
    """The name of a file as people know it."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType = WIRE_EVENTS,
) -> DataFrame:
    """All files of an archive as one table, with the path of the file each row came from.

    JSON lines may be compressed (``.zst``, ``.gz``); rows that are neither an event nor a
    header arrive with their text in ``_corrupt_record``. A file that cannot be read to its
    end gives the rows before the damage; ``damaged_files`` finds it and the file summary
    says so. Parquet rows without a record number get their place in the file.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if fmt == "json":
        lines = reader.text(path).select("value", file_path()).filter(F.trim("value") != "")
        return parse_lines(lines, schema)
    raw = reader.schema(schema).format(fmt).load(path).select("*", file_path(), F.col("_metadata"))
    if fmt == "parquet" and "record_no" in schema.names:
        own = F.coalesce("record_no", "_metadata.row_index")
        raw = raw.withColumn("record_no", own)
    return raw.drop("_metadata").withColumn(CORRUPT, F.lit(None).cast("string"))


def parse_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON text rows into columns, keeping the text of rows that are no whole record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(value, with_corrupt(schema), options)
    keep = [c for c in lines.columns if c != value]
    rows = lines.select(*keep, value, parsed.alias("r")).select(*keep, value, "r.*")
    whole = is_event(rows) | is_header(rows)
    text = F.when(~whole, F.coalesce(CORRUPT, value))
    return rows.withColumn(CORRUPT, text).drop(value)


def is_event(raw: DataFrame) -> Column:
    """Whether a record has what every event has: a time, and its number in the file."""
    return raw[CORRUPT].isNull() & raw["ts_ms"].isNotNull() & raw["record_no"].isNotNull()


def is_header(raw: DataFrame) -> Column:
    """Whether a record says when its file was begun."""
    if "created_s" not in raw.columns:
        return F.lit(False)
    return raw[CORRUPT].isNull() & raw["ts_ms"].isNull() & raw["created_s"].isNotNull()


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into events and bad records: all that are neither an event nor a header."""
    good = raw.filter(is_event(raw)).drop(CORRUPT, "created_s", "low_data")
    return good, raw.filter(~(is_event(raw) | is_header(raw)))


def file_headers(raw: DataFrame) -> DataFrame:
    """What the header records say: when each file was begun, and whether payloads were left out."""
    return raw.filter(is_header(raw)).groupBy("file_path").agg(
        F.min("created_s").alias("created_s"), F.bool_or("low_data").alias("low_data")
    )


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Paths, names and sizes of the files of an archive; their content is not read."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(
        file_path(),
        file_name_of(F.col("_metadata.file_path")).alias("file_name"),
        F.col("_metadata.file_size").alias("size_bytes"),
    )


def damaged_files(
    spark: SparkSession,
    path: str | list[str],
    fmt: str,
    files: DataFrame,
    probe_bytes: int = PROBE_BYTES,
) -> DataFrame:
    """The paths of the files that cannot be read to their end; empty files are sound.

    Files of at most ``probe_bytes`` are gone through where they are read, a row for each
    damaged one. Larger files, and those of other codecs than gzip, zstd and bzip2, are read
    without leniency: all at once, and only if that fails halves of their list. Any failure
    but a file's own content is an error.
    """
    if fmt not in ("json", "parquet"):
        probed = files.limit(0)
    elif fmt == "json":
        probed = files.filter(~F.col("file_path").rlike(UNPROBED))
    else:
        probed = files
    probed = probed.filter(F.col("size_bytes") <= probe_bytes).select("file_path")
    content = (
        spark.read.format("binaryFile")
        .load(path)
        # Without codec, lines of text have no end that could be missing.
        .filter((F.col("length") <= probe_bytes) & (F.col("length") > 0))
        .filter(F.col("path").rlike(PROBED) if fmt == "json" else F.lit(True))
        .select(file_path(), "content")
    )

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.columns
            found = [
                name.as_py()
                for name, data in zip(paths, contents)
                if not _sound(name.as_py(), data.as_buffer(), fmt)
            ]
            yield pa.record_batch([pa.array(found, pa.string())], ["file_path"])

    others = files.join(probed, "file_path", "left_anti").select("file_path")
    found = _unreadable(spark, path, fmt, [r[0] for r in others.collect()])
    rest = spark.createDataFrame([(f,) for f in found], "file_path string")
    if fmt not in ("json", "parquet"):
        return rest
    return content.mapInArrow(broken, "file_path string").unionByName(rest)


def _sound(path: str, data: pa.Buffer, fmt: str) -> bool:
    """Whether a file's bytes can be decoded to their end, a piece at a time."""
    try:
        if fmt == "parquet":
            opened = pq.ParquetFile(pa.BufferReader(data))
            for _ in opened.iter_batches(batch_size=4096):
                pass
            return True
        start = {
            ".gz": lambda: zlib.decompressobj(wbits=31),
            ".bz2": bz2.BZ2Decompressor,
            ".zst": lambda: zstandard.ZstdDecompressor().decompressobj(),
        }[path[path.rindex(".") :]]
        view, at, stream = memoryview(data), 0, start()
        # A file may be several streams, one after the other.
        while at < len(view):
            if stream.eof:
                stream = start()
            piece = view[at : at + PIECE]
            stream.decompress(bytes(piece))
            at += len(piece) - len(stream.unused_data)
        return stream.eof
    except (pa.ArrowException, OSError, EOFError, ValueError, zlib.error, zstandard.ZstdError):
        return False


def _unreadable(spark: SparkSession, path: str | list[str], fmt: str, paths: list[str]) -> list:
    """Those of the files that Spark itself cannot read to their end."""
    read = spark.read.option("ignoreCorruptFiles", "false")

    def fails(some: list[str]) -> bool:
        rows = read.text(path) if fmt == "json" else read.format(fmt).load(path)
        rows = rows.filter(F.col("_metadata.file_path").isin(some))
        try:
            # Every value is read; nothing but one number per task comes back.
            rows.agg(F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}))")).collect()
        except (PySparkException, Py4JJavaError) as error:
            if not is_damage(str(error)):
                raise
            return True
        return False

    if not paths or not fails(paths):
        return []
    if len(paths) == 1:
        return paths
    half = len(paths) // 2
    return _unreadable(spark, path, fmt, paths[:half]) + _unreadable(spark, path, fmt, paths[half:])


def is_damage(message: str) -> bool:
    """Whether a failed read tells of a file's content, not of a store, a right or an executor."""
    return "FAILED_READ_FILE" in message and not any(x in message for x in NO_DAMAGE)


def number_files(files: DataFrame) -> DataFrame:
    """Files in archive order: by the time in the name, then by name, then by path.

    The window runs over the file list alone, one short row per rotated file.
    """
    timed = files.withColumn("file_ts", file_time_ms(F.col("file_name")))
    order = Window.orderBy(F.col("file_ts").asc_nulls_first(), "file_name", "file_path")
    return timed.withColumn("file_no", F.row_number().over(order).cast("bigint") - 1)


def with_archive_order(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Add ``file_name``, ``file_ts`` and ``pos``, the position of an event in the archive.

    Files are known by their path, so folders may hold files of the same name. An event of a
    file that is not in ``files`` is an error when it is read.
    """
    if files is None:
        files = df.select("file_path").distinct()
        files = files.withColumn("file_name", file_name_of(F.col("file_path")))
    numbered = number_files(files.select("file_path", "file_name"))
    lost = F.raise_error(F.concat(F.lit("not in the list of files: "), "file_path"))
    base = F.shiftleft(F.coalesce("file_no", lost.cast("bigint")), POSITION_BITS)
    # One row per file; the events stay where they are unless there are very many files.
    numbered = broadcast_if_small(numbered)
    joined = df.join(numbered, "file_path", "left").withColumn("pos", base + F.col("record_no"))
    return joined.drop("file_no")


def with_record_no(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """A Parquet table numbered by the row's place in its file, for one without numbers."""
    df = spark.read.options(**options).parquet(path)
    own = [c for c in df.columns if c not in ("file_path", "file_name", "record_no")]
    return df.select(
        *own,
        file_path(),
        file_name_of(F.col("_metadata.file_path")).alias("file_name"),
        F.col("_metadata.row_index").alias("record_no"),
    )


def read_events(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType = WIRE_EVENTS,
) -> DataFrame:
    """The readable events of an archive, classified and in archive order."""
    good, _ = quarantine(read_raw(spark, path, fmt, schema))
    return classify(with_archive_order(good, list_files(spark, path)))


def file_summary(
    good: DataFrame, bad: DataFrame, files: DataFrame, damaged: DataFrame | None = None
) -> DataFrame:
    """Events and bad records per file; a file with no readable row is in it too.

    ``damaged`` has the paths of files that were not read to their end.
    """
    counted = (
        good.select("file_path", F.lit(0).alias("bad"))
        .unionByName(bad.select("file_path", F.lit(1).alias("bad")))
        .groupBy("file_path")
        .agg(
            F.count_if(F.col("bad") == 0).alias("events"),
            F.count_if(F.col("bad") == 1).alias("decode_errors"),
        )
    )
    rows = files.join(counted, "file_path", "left")
    cut = F.lit(False)
    if damaged is not None:
        rows = rows.join(damaged.withColumn("cut", F.lit(True)), "file_path", "left")
        cut = F.col("cut")
    return rows.select(
        *files.columns,
        F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("decode_errors", F.lit(0)).alias("decode_errors"),
        F.when(cut, "not readable to its end")
        .when(F.coalesce("events", F.lit(0)) == 0, "no readable event")
        .alias("error"),
    )


def strip_payloads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop raw payloads; also give how many events lost bytes, and how many bytes.

    A block loses its transactions whole, ids included; other messages keep the ids.
    """
    def raw_bytes(name: str) -> Column:
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("bigint")

    def in_list(size) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.coalesce(F.aggregate("txs", zero, lambda n, t: n + size(t)), zero)

    def length(value: Column) -> Column:
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")

    kind = F.col("kind")
    on_message = F.col("event_group") == "message"
    dropped = F.when(
        on_message,
        F.when(kind == "tx", raw_bytes("raw"))
        .when(
            kind == "block",
            in_list(lambda t: length(t["raw"]) + length(t["txid"]) + length(t["wtxid"])),
        )
        .when(kind.isin("blocktxn", "cmpctblock"), in_list(lambda t: length(t["raw"])))
        .otherwise(raw_bytes("payload")),
    ).otherwise(0)
    kept_txs = F.when(kind == "block", F.lit(None)).otherwise(
        F.transform("txs", lambda t: t.dropFields("raw"))
    )
    stripped = df.withColumn("txs", kept_txs).drop("raw", "payload")
    stats = df.select(dropped.alias("n")).agg(
        F.count_if(F.col("n") > 0).alias("stripped_events"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("stripped_bytes"),
    )
    return stripped, stats


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def result_json(df: DataFrame) -> DataFrame:
    """Every row of a result as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
