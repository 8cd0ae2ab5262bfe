"""Repeated passages across documents by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where some of its bits are zero, so
boundaries depend on the last few bytes alone and chunks line up again soon after text is
inserted or removed. Chunks are compared by digest. A run of chunks that an earlier document
(one with a smaller doc_id) has, too, is a repeated span if it is long enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.llm.tables import join_groups
from tallywire.llm.words import Reader, buffer_of, lists, mix, signed, spans
from tallywire.plans.sizes import settled

WINDOW_STEPS = 5  # the rolling window has 2**5 bytes
CUT_BITS = 4  # a cut every 2**4 bytes, on average
SHORTEST, LONGEST = 16, 64  # bytes of a chunk
SPAN_BYTES = 64  # of a span, at least

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the window asks for a cut, between characters."""
    rolled = GEAR[data]
    for step in range(WINDOW_STEPS):
        width = 1 << step
        back = np.zeros_like(rolled)
        back[width:] = rolled[:-width] if width < len(rolled) else 0
        rolled = rolled + (back << np.uint32(width))
    # The top bits depend on the whole window; a shift per byte leaves the low ones to the last.
    cut = rolled >> np.uint32(32 - CUT_BITS) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(cut) + 1


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, all but the last at least SHORTEST bytes apart.

    Cuts are not taken in a text's first bytes, where the window would reach out of it.
    """
    cuts = boundaries(data)
    at = np.searchsorted(cuts, offsets)
    out = []
    for lo, hi, first, last in zip(offsets[:-1], offsets[1:], at[:-1], at[1:], strict=True):
        ends, start = [], int(lo)
        for cut in cuts[first:last].tolist():
            while cut - start > LONGEST:
                start = _before(data, start + LONGEST)
                ends.append(start)
            if cut - start >= SHORTEST and cut - lo >= 1 << WINDOW_STEPS:
                ends.append(cut)
                start = cut
        while hi - start > LONGEST:
            start = _before(data, start + LONGEST)
            ends.append(start)
        if hi > start:
            ends.append(int(hi))
        out.append(ends)
    return out


def _before(data: np.ndarray, at: int) -> int:
    """The start of the character at a place."""
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row, doc_id, and lengths (in bytes) and 64-bit digests of the text's chunks.

    A digest alone proves nothing at a large scale, but a span takes several in a row.
    """

    def read(batches):
        reader = Reader()
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for lo, hi in spans(offsets):
                run = data[offsets[lo] : offsets[hi]]
                bounds = offsets[lo : hi + 1] - offsets[lo]
                per_text = chunk_ends(run, bounds)
                held = np.array([len(e) for e in per_text], dtype=np.int64)
                ends = np.array([e for text in per_text for e in text], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
                digests = reader.hashes(run, starts, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(lo, hi - lo),
                        batch.column(0).slice(lo, hi - lo),
                        lists((ends - starts).astype(np.int32), held),
                        lists(signed(digests), held),
                    ],
                    ["row", "doc_id", "lengths", "digests"],
                )

    rows = docs.select(
        F.col(id_col).cast("bigint"),
        F.col(text_col).cast("string"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.mapInArrow(
        read, "row bigint, doc_id bigint, lengths array<int>, digests array<bigint>"
    )


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span_bytes: int = SPAN_BYTES,
) -> DataFrame:
    """Rows doc_id, start, length, chunks, first_doc_id: spans that an earlier document has.

    ``start`` and ``length`` count bytes of the text in UTF-8; ``first_doc_id`` is the smallest
    doc_id that has a chunk of the span. What repeats within one document only is left alone,
    and so is a text of fewer than ``span_bytes`` bytes. Rows without doc_id take no part; rows
    that repeat a doc_id are one document to the others, each with spans of its own.
    """
    found = settled(chunks(docs.filter(F.col(id_col).isNotNull()), id_col, text_col), "chunks")
    each = found.select("row", "doc_id", F.posexplode("digests").alias("nth", "digest"))
    several = each.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc_id"),
        F.max("doc_id").alias("last"),
        F.count("*").alias("held"),
    )
    several = settled(several.filter("last > first_doc_id").drop("last"), "repeated")
    hits = join_groups(each, several, ["digest"], "held", "row")
    hits = hits.filter("first_doc_id < doc_id")
    # The hits of a document are a run as long as their numbers go up with their count.
    by = Window.partitionBy("row").orderBy("nth")
    runs = hits.withColumn("run", F.col("nth") - F.row_number().over(by))
    runs = runs.groupBy("row", "run").agg(
        F.min("nth").alias("nth"),
        F.count("*").alias("chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    rows = runs.join(found.select("row", "doc_id", "lengths"), "row")

    def total(at, n):
        return F.aggregate(F.slice("lengths", at, n), F.lit(0).cast("bigint"), lambda a, x: a + x)

    one = F.lit(1)
    rows = rows.select(
        "doc_id",
        total(one, F.col("nth")).alias("start"),
        total(F.col("nth") + 1, F.col("chunks").cast("int")).alias("length"),
        "chunks",
        "first_doc_id",
    )
    return rows.filter(F.col("length") >= span_bytes)


def without_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """Rows doc_id, text, with repeated spans cut out; rows that repeat a doc_id lose the
    spans of each other, so ids should be unique here."""
    held = repeated_spans(docs, id_col, text_col, **how).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans")
    )

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), spans_.to_pylist(), strict=True):
            if text is not None and gone:
                raw, kept, at = text.encode(), [], 0
                for span in gone:
                    kept.append(raw[at : span["start"]])
                    at = max(at, span["start"] + span["length"])
                text = b"".join([*kept, raw[at:]]).decode(errors="ignore")
            out.append(text)
        return pa.array(out, pa.string())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(held, "doc_id", "left").select("doc_id", cut("text", "spans").alias("text"))
