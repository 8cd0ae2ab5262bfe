"""A manifest of a table as hash trees kept in postorder logs, and proofs out of them.

Every group of rows is a tree whose runs of eight nodes become one node of the level above; the
roots of the groups are the leaves of one more tree. Aligned builders, one per run of 8^3
nodes, append nodes to a log in the order in which they are completed, children before their
parent and the root last, so a builder holds no more than one open run per level. Where a node
stands in such a log follows from the sizes of the subtrees before it, without a search, and
that is how the siblings of a proof are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.llm.tables import groups_in_order
from tallywire.plans.sizes import broadcast_if_small, settled

FAN = 8
LEVELS = 3  # of one builder
CHUNK = FAN**LEVELS
DIGEST = 32


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // FAN)
        levels += 1
    return levels


def position(level: int, place: int, leaves: int, levels: int) -> int:
    """Where node ``place`` of ``level`` stands in the log of a tree.

    The node covers the leaves up to ``end``. Of each level up to its own, all nodes up to
    ``end`` are complete by then, itself the last of them; of each level above it those before
    the one that is still open.
    """
    end = min((place + 1) * FAN**level, leaves)
    done = sum(-(-end // FAN**k) for k in range(levels + 1))
    return done - (levels - level) - 1


def digest_of(children: Sequence[bytes]) -> bytes:
    """A node: the hash of its children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class PostorderLog:
    """Digests of a tree in the order of their completion; leaves come in one by one."""

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.log = bytearray()
        self.open: list[list[bytes]] = [[] for _ in range(levels)]

    def append(self, digest: bytes, level: int = 0) -> None:
        self.log += digest
        if level < self.levels:
            self.open[level].append(digest)
            if len(self.open[level]) == FAN:
                self._complete(level)

    def _complete(self, level: int) -> None:
        children, self.open[level] = self.open[level], []
        self.append(digest_of(children), level + 1)

    def close(self) -> bytes:
        """The whole log, after the runs that came to fewer than eight."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return bytes(self.log)


def siblings(log: bytes, place: int, leaves: int, levels: int) -> bytes:
    """The other members of the runs that lead from a leaf to the root of a log, bottom up."""
    found = bytearray()
    for level in range(levels):
        nodes = -(-leaves // FAN**level)
        first = place - place % FAN
        for other in range(first, min(first + FAN, nodes)):
            if other != place:
                at = DIGEST * position(level, other, leaves, levels)
                found += log[at : at + DIGEST]
        place //= FAN
    return bytes(found)


def fold(digest: bytes, path: bytes, places: Sequence[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings lead to, up trees of (place, leaves) each."""
    at = 0
    for place, leaves in places:
        while leaves > 1:
            first = place - place % FAN
            left, others = place - first, min(FAN, leaves - first) - 1
            run = [path[at + DIGEST * i : at + DIGEST * (i + 1)] for i in range(others)]
            digest = digest_of([*run[:left], digest, *run[left:]])
            at += DIGEST * others
            place, leaves = place // FAN, -(-leaves // FAN)
    if at != len(path):
        raise ValueError("the path does not fit the tree")
    return digest


# One row per run of CHUNK nodes: ``size`` nodes in the tree at the builder's lowest level, the
# log of this run, and what belongs to its leaves.
LOG = "tree string, size bigint, chunk bigint, log binary, ids array<bigint>, shown array<binary>"


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups_in_order(batches, ["tree", "chunk"]):
        size = group.column("size")[0].as_py()
        builder = PostorderLog(LEVELS if size > CHUNK else height(size))
        for digest in group.column("digest").to_pylist():
            builder.append(digest)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group.column("tree")[0].as_py()], pa.string()),
                pa.array([size], pa.int64()),
                pa.array([group.column("chunk")[0].as_py()], pa.int64()),
                pa.array([builder.close()], pa.binary()),
                pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([group.column("shown").to_pylist()], pa.list_(pa.binary())),
            ],
            ["tree", "size", "chunk", "log", "ids", "shown"],
        )


def _root(log: str = "log") -> Column:
    """The last digest of a log."""
    return F.expr(f"substring({log}, -{DIGEST}, {DIGEST})")


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """The logs of trees, one table per round of builders, from the leaves up.

    ``nodes``: tree, place, size (leaves of the tree), digest, id and shown.
    """
    logs = []
    while True:
        rows = nodes.withColumn("chunk", F.floor(F.col("place") / CHUNK))
        rows = rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "place")
        logs.append(settled(rows.mapInArrow(_append, LOG), "merkle-log"))
        nodes = logs[-1].filter(F.col("size") > CHUNK)
        if nodes.isEmpty():
            return logs
        nodes = nodes.select(
            "tree",
            F.col("chunk").alias("place"),
            F.ceil(F.col("size") / CHUNK).alias("size"),
            _root().alias("digest"),
            F.lit(None).cast("bigint").alias("id"),
            F.lit(None).cast("binary").alias("shown"),
        )


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` in their tree, from 0 in the given order, and its ``size``.

    Sorted by ranges, so that a tree may hold any share of the rows, and written; a row's place
    is the rows of its tree in earlier ranges and before it in its own.
    """
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    lined = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    lined = lined.withColumns(
        {"range": F.spark_partition_id(), "line": F.monotonically_increasing_id()}
    )
    lined = settled(lined, "lined-up")
    runs = lined.groupBy("tree", "range").agg(
        F.count("*").alias("held"), F.min("line").alias("first")
    )
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree",
        "range",
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(tree).alias("size"),
    )
    runs = broadcast_if_small(settled(runs, "ranges"))
    placed = lined.join(runs, ["tree", "range"])
    return placed.withColumn("place", F.col("line") + F.col("shift")).drop(
        "range", "line", "shift"
    )


# What a node finds above itself: the siblings on its way up, and its tree's place among trees.
ABOVE = "path binary, subroot binary, tree_place bigint, trees bigint"
ABOVE_NAMES = ["path", "subroot", "tree_place", "trees"]


def _each_path(batch: pa.RecordBatch) -> Iterator[tuple[dict, int, bytes, bytes]]:
    """Per leaf of the logs: its log's row, place in the log, digest and path to the top."""
    for row in batch.to_pylist():
        log, whole = row["log"], row["size"] <= CHUNK
        leaves = min(CHUNK, row["size"] - row["chunk"] * CHUNK)
        levels = height(row["size"]) if whole else LEVELS
        for place in range(leaves):
            at = DIGEST * position(0, place, leaves, levels)
            path = siblings(log, place, leaves, levels) + row["path"]
            yield row, place, log[at : at + DIGEST], path


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the nodes of a round, for the logs of the round below."""
    schema = pa.schema(
        [
            ("tree", pa.string()),
            ("chunk", pa.int64()),
            ("path", pa.binary()),
            ("subroot", pa.binary()),
            ("tree_place", pa.int64()),
            ("trees", pa.int64()),
        ]
    )
    for batch in batches:
        for i in range(batch.num_rows):  # one log at a time
            rows = [
                {**row, "chunk": row["chunk"] * CHUNK + place, "path": path}
                for row, place, _, path in _each_path(batch.slice(i, 1))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)


PROOFS = (
    "id bigint, leaf binary, subroot binary, root binary, path binary, place bigint, "
    "leaves bigint, tree_place bigint, trees bigint, folded binary"
)


def _proofs(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PROOFS.split(", ")]
    binary, whole = pa.binary(), pa.int64()
    kinds = [whole, binary, binary, binary, binary, whole, whole, whole, whole, binary]
    for batch in batches:
        for i in range(batch.num_rows):
            out: list[list] = [[] for _ in names]
            for row, place, leaf, path in _each_path(batch.slice(i, 1)):
                trees = row["tree_place"], row["trees"]
                tree = row["chunk"] * CHUNK + place, row["size"]
                shown = row["shown"][place]
                folded = fold(leaf if shown is None else shown, path, [tree, trees])
                values = row["ids"][place], leaf, row["subroot"], root, path, *tree, *trees, folded
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)


@dataclass
class Manifest:
    """Trees over the rows of a table, as logs in the shared folder.

    ``logs`` has one table per round of builders; ``crown`` the same for the tree over trees.
    """

    logs: list[DataFrame]
    crown: list[DataFrame]
    trees: DataFrame  # tree, place, size, digest: the leaves of the crown

    @property
    def root(self) -> bytes | None:
        """The digest of the whole table; None if it has no rows."""
        last = self.crown[-1].select(_root().alias("root")).first()
        return None if last is None else bytes(last.root)

    def entries(self) -> DataFrame:
        """The log of every tree: tree, position, level, place, digest."""
        rounds = []
        for i, log in enumerate(self.logs):

            def read(batches, lowest=i * LEVELS):
                return _entries(batches, lowest)

            # Trees of several rounds know their leaves from the first.
            sizes = self.logs[0].filter("chunk = 0").select("tree", F.col("size").alias("leaves"))
            rows = log.select("tree", "size", "chunk", "log").join(sizes, "tree")
            rounds.append(
                rows.mapInArrow(
                    read,
                    "tree string, position bigint, level int, place bigint, digest binary",
                )
            )
        found = rounds[0]
        for more in rounds[1:]:
            found = found.union(more)
        return found

    def proofs(self) -> DataFrame:
        """One row per leaf: its ``id``, ``leaf``, the ``path`` of siblings up to ``root``, where
        it stands, and ``folded``, the root that what is shown (the leaf, unless another was
        given) and the path lead to. A path is the digests one after the other, bottom up and
        left to right.
        """
        top = self.trees.select("tree", F.col("digest").alias("subroot"), "place", "size")
        top = top.withColumns({"tree_place": F.col("place"), "trees": F.col("size")})
        above = None
        for log in reversed(self.crown):
            whole = log.filter(F.col("size") <= CHUNK)
            whole = whole.withColumns(
                {
                    "path": F.lit(b""),
                    "subroot": F.lit(None).cast("binary"),
                    "tree_place": F.lit(0).cast("bigint"),
                    "trees": F.lit(1).cast("bigint"),
                }
            )
            above = _with_above(log, whole, above).mapInArrow(
                _paths, f"tree string, chunk bigint, {ABOVE}"
            )
        top = top.drop("size").join(above.select(F.col("chunk").alias("place"), "path"), "place")
        crowns = settled(top.select("tree", *ABOVE_NAMES), "crowns")
        above = None
        for log in reversed(self.logs):
            whole = log.filter(F.col("size") <= CHUNK).join(crowns, "tree")
            rows = _with_above(log, whole, above)
            if log is not self.logs[0]:
                above = rows.mapInArrow(_paths, f"tree string, chunk bigint, {ABOVE}")
                above = settled(above, "paths")
        root = self.root
        return rows.mapInArrow(lambda batches: _proofs(batches, root), PROOFS)


def _with_above(log: DataFrame, whole: DataFrame, above: DataFrame | None) -> DataFrame:
    """The logs of a round with what is above them: whole trees, and parts of larger ones."""
    columns = [*log.columns, *ABOVE_NAMES]
    if above is None:
        return whole.select(*columns)
    parts = log.filter(F.col("size") > CHUNK).join(above, ["tree", "chunk"])
    return whole.select(*columns).union(parts.select(*columns))


def _entries(batches: Iterator[pa.RecordBatch], lowest: int) -> Iterator[pa.RecordBatch]:
    names = ["tree", "position", "level", "place", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for row in batch.to_pylist():
            leaves = min(CHUNK, row["size"] - row["chunk"] * CHUNK)
            levels = height(row["size"]) if row["size"] <= CHUNK else LEVELS
            out: list[list] = [[] for _ in names]
            # A higher round's lowest nodes are in the log of the round below.
            for level in range(1 if lowest else 0, levels + 1):
                for place in range(-(-leaves // FAN**level)):
                    at = DIGEST * position(level, place, leaves, levels)
                    node = row["chunk"] * FAN ** (LEVELS - level) + place
                    where = position(lowest + level, node, row["leaves"], height(row["leaves"]))
                    values = row["tree"], where, lowest + level, node, row["log"][at : at + DIGEST]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def record(fields: Sequence[Column]) -> Column:
    """Fields as one text: each "-" if null, else its length in bytes, ":" and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        stated = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(stated, F.lit("-")))
    return F.concat(*parts)


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[Column],
    shown: Sequence[Column] | None = None,
    show_if: Column | None = None,
    id_col: str = "doc_id",
    tree_col: str = "lang",
) -> Manifest:
    """Build the trees of a table: a leaf is the SHA-256 of the row's ``fields`` (see record).

    Rows with one value of ``tree_col`` are a tree, its leaves in the order of the id; rows
    without id come first, and rows that repeat one are in the order of their digests. The
    tree over the trees is in the order of that value, as UTF-8 bytes, null first. A tree of
    one leaf is that leaf. ``shown`` are the fields that a reader of the rows in ``show_if``
    holds instead, to be checked by the proofs. No rows give no trees and no root.
    """

    def leaf(of: Sequence[Column]) -> Column:
        return F.unhex(F.sha2(record(of), 256))

    key = F.col(tree_col).cast("string")
    other = F.lit(None).cast("binary")
    if shown is not None:
        other = F.when(F.lit(True) if show_if is None else show_if, leaf(shown))
    leaves = docs.select(
        # A null sorts before every value, the empty one too.
        F.coalesce(F.concat(F.lit("="), key), F.lit("")).alias("tree"),
        F.col(id_col).cast("bigint").alias("id"),
        leaf(fields).alias("digest"),
        other.alias("shown"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = settled(leaves, "leaves")
    # The row number splits rows that agree in all else over ranges.
    logs = _grown(_placed(leaves, ["id", "digest", "row"]).drop("row"))
    roots = None
    for log in logs:
        done = log.filter(F.col("size") <= CHUNK).select("tree", _root().alias("digest"))
        roots = done if roots is None else roots.union(done)
    nothing = F.lit(None)
    ranked = _placed(roots.withColumnsRenamed({"tree": "name"}).withColumn("tree", F.lit("")), ["name"])
    ranked = settled(ranked, "subroots")
    crown = _grown(
        ranked.select(
            "tree",
            "place",
            "size",
            "digest",
            nothing.cast("bigint").alias("id"),
            nothing.cast("binary").alias("shown"),
        )
    )
    trees = ranked.select(F.col("name").alias("tree"), "place", "size", "digest")
    return Manifest(logs, crown, trees)
