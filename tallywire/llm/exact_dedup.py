"""Exact deduplication over an index of live digests in a cuckoo filter.

A cuckoo filter keeps a 16-bit mark of every live digest in one of two buckets of four slots.
A mark that fits is only a hint: the digest kept beside it, in the same bucket, decides. An
insertion that finds both buckets full moves older marks to their other bucket; when that goes
on too long the filter is full, and is rebuilt at twice the size from the digests it keeps.
Deleting a digest empties its slot.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.llm.tables import broadcast_if_small, join_groups, unused
from tallywire.plans.sizes import settled

SLOTS = 4
MOVES = 200  # moves after which the filter counts as full
# Digests one task collapses before it hands them on; bounds its memory.
LIVE = 400_000


class CuckooIndex:
    """Live digests with a value each; digests are bytes of at least 10."""

    def __init__(self, buckets: int = 256) -> None:
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1  # a power of two
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.kept: list = [None] * (SLOTS * buckets)
        self.live = 0

    def __len__(self) -> int:
        return self.live

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _slot(self, digest: bytes) -> int:
        """The slot of a live digest, or -1."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.kept[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        slot = self._slot(digest)
        return None if slot < 0 else self.kept[slot][1]

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.marks[slot], self.kept[slot] = 0, None
        self.live -= 1
        return True

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        entry = (digest, value)
        mark, bucket, two = self._places(digest)
        for choice in (bucket, two):
            if self._put(choice, mark, entry):
                return
        for move in range(MOVES):
            slot = bucket * SLOTS + (mark + move) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.kept[slot], entry = entry, self.kept[slot]
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, entry):
                return
        entries = [e for e in self.kept if e is not None] + [entry]
        self._clear(2 * (self.mask + 1))
        for kept in entries:
            self.insert(*kept)

    def _put(self, bucket: int, mark: int, entry: tuple) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.marks[slot]:
                self.marks[slot], self.kept[slot] = mark, entry
                self.live += 1
                return True
        return False

    def items(self) -> Iterator[tuple]:
        return (e for e in self.kept if e is not None)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``sha`` of the text with A-Z lower-cased, and a number ``row``."""
    schema = "doc_id bigint, sha binary"

    def read(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            shas = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.binary())], ["doc_id", "sha"]
            )

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    shas = rows.mapInArrow(read, schema)
    return shas.withColumn("row", F.monotonically_increasing_id())


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sha, doc_id, row, size) to one per digest: the largest doc_id, the sum of sizes.

    A digest that is live is taken out and put back with the larger doc_id; ties go to the
    larger row number, and a row without doc_id is below all others.
    """
    index = CuckooIndex()

    def out() -> pa.RecordBatch:
        kept = list(index.items())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in kept], pa.binary()),
                pa.array([v[0][1] if v[0][0] else None for _, v in kept], pa.int64()),
                pa.array([v[0][2] for _, v in kept], pa.int64()),
                pa.array([v[1] for _, v in kept], pa.int64()),
            ],
            ["sha", "doc_id", "row", "size"],
        )

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for sha, doc_id, row, size in zip(*columns, strict=True):
            best = (doc_id is not None, doc_id or 0, row)
            held = index.get(sha)
            if held is not None:
                index.delete(sha)
                best, size = max(held[0], best), held[1] + size
            index.insert(sha, (best, size))
        if len(index) >= LIVE:
            yield out()
            index = CuckooIndex()
    if len(index):
        yield out()


def exact_groups(rows: DataFrame) -> DataFrame:
    """Groups of equal ``sha`` with two rows or more: ``keep_id``, ``keep_row``, ``group_size``.

    Every task first collapses its own rows, so that a group, however large, sends one row
    per task and LIVE digests. A task that meets more than LIVE digests hands on several rows
    of a digest; the sum after it is exact.
    """
    schema = "sha binary, doc_id bigint, row bigint, size bigint"
    start = rows.select("sha", "doc_id", "row", F.lit(1).cast("bigint").alias("size"))
    local = start.mapInArrow(_collapse, schema)
    merged = local.repartition(F.col("sha")).mapInArrow(_collapse, schema)
    best = F.max(F.struct("doc_id", "row"))
    groups = merged.groupBy("sha").agg(best.alias("best"), F.sum("size").alias("group_size"))
    return groups.filter("group_size > 1").select(
        "sha",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
        "group_size",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; a null text is empty. Of equal texts
    the one with the largest doc_id is kept, and exactly one row of every group: of rows that
    repeat a doc_id any one. A row without doc_id is kept only if its group has no other.
    No rows give no rows.
    """
    rows = settled(digests(docs, id_col, text_col), "digests")
    groups = settled(exact_groups(rows), "exact-groups")
    found = join_groups(rows, groups, ["sha"], "group_size", "row")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns.

    Where rows repeat a doc_id, one row of each of their kept texts stays.
    """
    found = exact_dedup(docs, id_col, text_col)
    kept = found.groupBy("doc_id", "text_sha256").agg(
        F.count("*").alias("n"), F.max("kept").alias("kept")
    )
    kept = kept.groupBy("doc_id").agg(
        F.sum("n").alias("n"), F.expr("collect_list(text_sha256) FILTER (WHERE kept)").alias("shas")
    )
    kept = settled(kept.filter("size(shas) > 0"), "kept")
    the_id, the_sha = unused("_id", docs), unused("_sha", docs)
    once = kept.filter("n = 1").select(F.col("doc_id").alias(the_id))
    often = kept.filter("n > 1")
    often = often.select(F.col("doc_id").alias(the_id), F.explode("shas").alias(the_sha))
    same_id = docs[id_col].eqNullSafe(F.col(the_id))
    single = docs.join(broadcast_if_small(once), same_id, "left_semi")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), upper, upper.lower())
    rest = docs.join(broadcast_if_small(often), same_id).filter(F.sha2(text, 256) == F.col(the_sha))
    rest = rest.dropDuplicates([the_id, the_sha]).select(*[docs[c] for c in docs.columns])
    return single.union(rest)
