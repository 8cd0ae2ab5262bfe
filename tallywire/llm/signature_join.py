"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Documents with the same set of shingles form a class; links are sought between classes.

*Blocks.* If two sets link, their sizes are within the threshold of each other and at most
`d` shingles are in one of them only. Sizes fall into levels; a level serves pairs whose
smaller set is in it. For each level that a set belongs to, its shingles are dealt into parts
by hash, and a part has a key made of all its shingles. Small sets are dealt into more than
`d` parts, so sets that link agree on one for certain. Of large sets only parts of several
shingles count, and so many that 24 of them are expected to agree at the threshold: the hash
being random, none does with a probability of about 1e-10. Sets that link so meet in a block
of a key, and sets that only share a passage hardly ever do.

*Signature trees.* The sets of a task are the leaves of a tree, or of two that meet. A node
holds the OR of its sets' bitmaps, the range of their sizes and the most shingles that share a
bit with another in one set. Two nodes are descended together; a pair of nodes is left alone
when their sizes do not fit, when even the bits they have in common would not make the overlap
that a link needs, or when all their sets are already in one component.

Sets that share blocks, directly or through others, are a family. A small family is compared
in one task. Of a large one two blocks of each set are cut into chunks at random first, which
joins groups of near copies up, chunk by chunk; then the sets outside the largest component are
compared with all others, in pairs of chunks, through the family as a whole or block by block,
whichever sends fewer sets. Copies are one class all along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.components import components
from tallywire.llm.tables import broadcast_if_small, groups_in_order, join_groups, unused
from tallywire.llm.words import Reader, Words, mix, signed
from tallywire.plans.sizes import settled

U = np.uint64
CHUNK = 256  # sets in one tree
LEAF = 4  # children of a node
BITS = 4096  # of a bitmap


# --- sets of shingles ---


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted, and how many each text has.

    A text with fewer words than ``width`` has its whole sequence as one shingle, and a text
    without words has none.
    """
    n = np.diff(words.first)
    h = words.hashes
    text_of = words.text_of
    shingle = np.zeros(len(h), dtype=U)
    short = np.repeat(n < width, n)
    place = np.arange(len(h)) - words.first[:-1][text_of]
    full = place <= np.repeat(n - width, n)
    padded = np.concatenate([h, np.zeros(width, dtype=U)])
    left = np.repeat(n, n) - place
    for j in range(width):
        here = padded[j : j + len(h)] if j else h
        here = np.where(j < left, here, U(0))
        shingle = mix(shingle * U(0x2545F4914F6CDD1D) + here + U(j + 1))
    use = full | (short & (place == 0))
    shingle, text_of = shingle[use], text_of[use]
    order = np.lexsort((shingle, text_of))
    shingle, text_of = shingle[order], text_of[order]
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text_of[1:] != text_of[:-1])
    return shingle[new], np.bincount(text_of[new], minlength=len(n))


# Parts that linking sets share are expected to be at least so many, where parts are chosen so
# that none is left out for certain; then they miss a link with a probability of about 1e-10.
EXPECTED = 24
PART_SIZES = range(8, 2, -1)  # shingles a part must have, the most first


class Levels:
    """Levels of sizes, and how the sets of each are cut, for a threshold of ``share`` percent.

    ``parts`` counts the parts, ``least`` the shingles that a part needs for a key. Where sets
    are too small for that, ``least`` is 0 and there are more parts than shingles can differ:
    then at least ``spare + 1`` parts agree, so empty ones matter only to a set that has more
    than ``spare`` of them.
    """

    def __init__(self, share: int) -> None:
        self.share = share
        self.low, self.parts, self.least, self.spare = [1], [], [], []

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            low = self.low[-1]
            top = low * 100 // self.share
            self.low.append(top + 1)
            # |A| + |B| - 2 |A and B| is at most this share of |A| + |B| for sets that link.
            differ = (top + top * 100 // self.share) * (100 - self.share) // (100 + self.share)
            parts, least = self._random(differ, 2 * low * self.share / (100 + self.share))
            if not parts and differ:
                parts = differ + 1
                few = 2 * differ + 4
                while parts < few and parts - differ <= 2 + 1.5 * parts * np.exp(-low / parts):
                    parts += 1
            self.parts.append(parts)
            self.least.append(least)
            self.spare.append(parts - differ - 1)

    def _random(self, differ: int, common: float) -> tuple[int, int]:
        """Parts and shingles a part needs, so that EXPECTED parts with them agree; or (0, 0)."""
        k = np.arange(EXPECTED, max(EXPECTED, 2 * differ) + 1, dtype=float)
        agree = k * np.exp(-differ / k)
        mean = common / k
        term, below = np.exp(-mean), [np.zeros_like(k)]
        for j in range(1, max(PART_SIZES) + 1):
            below.append(below[-1] + term)
            term = term * mean / j
        for least in PART_SIZES:
            enough = np.flatnonzero(agree * (1 - below[least]) >= EXPECTED)
            if len(enough):
                return int(k[enough[0]]), least
        return 0, 0

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The level of each size."""
        self._grow(int(sizes.max(initial=1)))
        return np.searchsorted(self.low, sizes, side="right") - 1


def part_keys(
    sets: np.ndarray, sizes: np.ndarray, levels: Levels
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and the sets they are of: for each set's own level, then for the one below.

    A level of no parts needs no keys, for there only equal sets link.
    """
    level = levels.of(sizes)
    parts, least, spare = (np.array(x) for x in (levels.parts, levels.least, levels.spare))
    tops = np.array(levels.low[1:]) - 1
    set_of = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(sets ^ U(0x6A09E667F3BCC909))
    for down in (0, 1):
        at = np.maximum(level - down, 0)
        k = np.where((level >= down) & (sizes > 0), parts[at], 0)
        if down:
            k = np.where(sizes * levels.share <= tops[at] * 100, k, 0)
        base = np.concatenate([[0], np.cumsum(k)])
        use = k[set_of] > 0
        part = ((sets[use] >> U(32)) * k[set_of[use]].astype(U)) >> U(32)
        slot = base[set_of[use]] + part.astype(np.int64)
        sums, held = np.zeros(base[-1], dtype=U), np.bincount(slot, minlength=base[-1])
        if len(slot):
            begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            sums[slot[begins]] = np.add.reduceat(spread[use], begins)
        owner = np.repeat(np.arange(len(sizes)), k)
        number = np.arange(base[-1]) - base[owner]
        empty = np.bincount(owner[held == 0], minlength=len(sizes))
        many_empty = (least[at] == 0) & (empty > spare[at])
        keep = (held >= np.maximum(least[at], 1)[owner]) | ((held == 0) & many_empty[owner])
        salt = mix(at[owner].astype(U) * U(1 << 32) + number.astype(U) + U(1))
        yield mix(sums + salt)[keep], owner[keep]


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n, and a 128-bit digest (d1, d2) of its set of n shingles."""

    def read(batches):
        reader = Reader()
        for batch in batches:
            for run in reader.runs(batch.column(1)):
                sets, sizes = shingle_sets(run, width)
                ids = batch.column(0).slice(run.lo, run.hi - run.lo)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes.astype(np.int64)), *_digest(sets, sizes)],
                    ["doc_id", "n", "d1", "d2"],
                )

    return docs.mapInArrow(read, "doc_id bigint, n bigint, d1 bigint, d2 bigint")


def _digest(sets: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    some = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[some]
    out = []
    for salt in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1):
        d = np.zeros(len(sizes), dtype=U)
        if len(some):
            d[some] = np.add.reduceat(mix(sets ^ U(salt)), begins)
        out.append(pa.array(signed(d)))
    return out


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """Of rows (doc_id, text, family, large): id, family, large, and the text's shingles as
    sorted 64-bit numbers, one after the other."""

    def read(batches):
        reader = Reader()
        for batch in batches:
            for run in reader.runs(batch.column(1)):
                sets, sizes = shingle_sets(run, width)
                ends = np.cumsum(sizes)
                raw = [sets[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
                kept = [batch.column(i).slice(run.lo, run.hi - run.lo) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(raw, pa.binary())], ["id", "family", "large", "set"]
                )

    rows = docs.select("doc_id", "text", "family", "large")
    return rows.mapInArrow(read, "id bigint, family bigint, large boolean, set binary")


# --- signature trees ---


class Tree:
    """Sets in nodes of up to LEAF children; level 0 has the sets themselves."""

    def __init__(self, sets: list[np.ndarray], parts: np.ndarray) -> None:
        sizes = np.array([len(s) for s in sets])
        # Similar sets share their smallest hash most of the time, so they come to lie together.
        least = np.array([s[0] for s in sets])
        order = np.lexsort((sizes, least))
        self.sets = [sets[i] for i in order]
        self.order = order
        bits = np.zeros((len(sets), BITS // 8), dtype=np.uint8)
        for i, s in enumerate(self.sets):
            row = np.zeros(BITS, dtype=np.uint8)
            row[(s % U(BITS)).astype(np.int64)] = 1
            bits[i] = np.packbits(row)
        maps = bits.view(U)
        sizes, parts = sizes[order], parts[order]
        extra = sizes - np.bitwise_count(maps).sum(axis=1)
        # Per level: bitmaps, smallest and largest size, most shared bits, and the component
        # of all its sets, or -1 where there are several.
        self.levels = [(maps, sizes, sizes, extra, parts)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, extra, parts = self.levels[-1]
            at = np.arange(0, len(maps), LEAF)
            least = np.minimum.reduceat(parts, at)
            same = least == np.maximum.reduceat(parts, at)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(extra, at),
                    np.where(same, least, -1),
                )
            )


def candidates(a: Tree, b: Tree, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, by their place in the trees, that descending both trees leaves over.

    Both trees must have the same height; the lower one is given levels of one node.
    """
    height = max(len(a.levels), len(b.levels))
    x = y = np.zeros(1, dtype=np.int64)
    for level in range(height - 1, -1, -1):
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        if level < height - 1:
            x, y = _children(x, y, a, b, level)
        if a is b:
            x, y = x[x <= y], y[x <= y]
        low, high = np.maximum(la[1][x], lb[1][y]), np.minimum(la[2][x], lb[2][y])
        fits = high * 100 >= low * share
        fits &= (la[4][x] < 0) | (la[4][x] != lb[4][y])
        x, y = x[fits], y[fits]
        need = (la[1][x] + lb[1][y]) * share
        keep = np.empty(len(x), dtype=bool)
        for lo in range(0, len(x), 4096):
            at = slice(lo, lo + 4096)
            common = np.bitwise_count(la[0][x[at]] & lb[0][y[at]]).sum(axis=1, dtype=np.int64)
            most = common + np.minimum(la[3][x[at]], lb[3][y[at]])
            keep[at] = most * (100 + share) >= need[at]
        x, y = x[keep], y[keep]
    return (x[x < y], y[x < y]) if a is b else (x, y)


def _children(x, y, a: Tree, b: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children, one level down, of pairs of nodes."""

    def below(nodes, tree):
        if level + 1 >= len(tree.levels):
            return nodes, nodes + 1
        return nodes * LEAF, np.minimum(nodes * LEAF + LEAF, len(tree.levels[level][0]))

    (xl, xh), (yl, yh) = below(x, a), below(y, b)
    across = yh - yl
    each = (xh - xl) * across
    ends = np.cumsum(each)
    k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each)
    width = np.repeat(across, each)
    return np.repeat(xl, each) + k // width, np.repeat(yl, each) + k % width


class Union:
    """Components among a few numbered sets; they start from known ones."""

    def __init__(self, parts: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(p, i) for i, p in enumerate(parts)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int(np.count_nonzero(a[at] == b))
    return 100 * common >= share * (len(a) + len(b) - common)


def tree_links(group: pa.Table, share: int) -> list[tuple[int, int]]:
    """Links that join up the sets of a group: within it, or between its two sides.

    Rows: id, part (its component so far), side, set. Sets of one component are not compared,
    nor are two that earlier links of this group have put into one.
    """
    ids, parts, sides, sets = (group.column(c).to_pylist() for c in ("id", "part", "side", "set"))
    sets = [np.frombuffer(s, dtype=U) for s in sets]
    number = {p: i for i, p in enumerate(dict.fromkeys(parts))}
    part = np.array([number[p] for p in parts])
    at = [[i for i, s in enumerate(sides) if s == side] for side in (0, 1)]
    if not at[0] or not (at[1] or len(at[0]) > 1):
        return []
    trees = [Tree([sets[i] for i in rows], part[rows]) if rows else None for rows in at]
    a = trees[0]
    b = trees[1] or a
    rows_a, rows_b = at[0], at[1] or at[0]
    x, y = candidates(a, b, share)
    union, found = Union(parts), []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = rows_a[a.order[i]], rows_b[b.order[j]]
        if union.root(p) != union.root(q) and linked(sets[p], sets[q], share):
            union.join(p, q)
            found.append((ids[p], ids[q]))
    return found


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components, as links of each id with the lowest of its component."""
    ids = sorted({i for link in links for i in link})
    at = {i: k for k, i in enumerate(ids)}
    union = Union(list(range(len(ids))))
    for a, b in links:
        union.join(at[a], at[b])
    return [(i, ids[union.root(k)]) for k, i in enumerate(ids) if union.root(k) != k]


def with_sets(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Tasks (block, task, side, id, part) with the ``set`` of each id.

    The tasks of an id are put together first, so a set meets one row and is copied after.
    """
    each = tasks.groupBy("id", "part").agg(
        F.collect_list(F.struct("block", "task", "side")).alias("tasks")
    )
    met = each.join(sets, "id").select("id", "part", "set", F.explode("tasks").alias("t"))
    return met.select("t.*", "id", "part", "set")


def _links(rows: DataFrame, share: int) -> DataFrame:
    """Links among sets (block, task, side, id, part, set) of one (block, task) each.

    The links of a task join its sets up in all ways that they can be, but not by all links.
    """
    rows = rows.select("block", "task", "side", "id", "part", "set")
    rows = rows.repartition("block", "task").sortWithinPartitions("block", "task", "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["block", "task"]):
            if links := tree_links(group, share):
                # Each at the lowest of its component, as it will be if the task has it whole.
                a, b = zip(*stars(links), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
                )

    return rows.mapInArrow(compare, "a bigint, b bigint")


# --- blocks ---


class Dealer:
    """Deals (key, id) rows of a task to shards by key, packed into a few bytes each.

    A block is named by its shard and 47 bits of its key. Of rows of the same block in one
    task only the first goes to the shard, marked; the others are members already and pass by.
    So a shard gets a row per block and task at most, however large the block is.
    """

    HELD = 2_000_000  # rows a task gathers before it deals them

    def __init__(self, shards: int) -> None:
        self.shards, self.keys, self.ids, self.n = shards, [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.ids.append(ids)
        self.n += len(keys)
        if self.n >= self.HELD:
            yield from self.deal()

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids, self.n = [], [], 0
        block = ((keys % U(self.shards)) << U(47)) | (keys >> U(17))
        order = np.argsort(block, kind="stable")
        block, ids = block[order], ids[order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = block[1:] != block[:-1]
        begins = np.flatnonzero(new)
        several = np.diff(np.append(begins, len(block))) > 1
        first, first_id = block[begins], ids[begins]
        shard = (first >> U(47)).astype(np.int64)
        order = np.lexsort((first_id, shard))
        first, first_id, several, shard = (x[order] for x in (first, first_id, several, shard))
        cuts = np.flatnonzero(np.diff(shard)) + 1
        rows = []
        for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            part, held = first[lo:hi], first_id[lo:hi]
            steps = np.diff(held, prepend=held[:1])
            narrow = steps.max() < 1 << 16
            rows.append(
                (
                    int(shard[lo]),
                    int(held[0]),
                    (part & U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    ((part >> U(32)) & U(0x7FFF) | several[lo:hi].astype(U) << U(15))
                    .astype(np.uint16)
                    .tobytes(),
                    (steps.astype(np.uint16) if narrow else steps).tobytes(),
                )
            )
        again = np.flatnonzero(~new)
        for lo in range(0, len(again), 100_000):
            at = again[lo : lo + 100_000]
            spread = -1 - int(block[at[0]] % U(1 << 30))
            rows.append((spread, 0, block[at].tobytes(), b"", ids[at].tobytes()))
        names = ["shard", "base", "low", "high", "steps"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (block, id) of blocks with several, from what was dealt to this task."""

    def out(blocks, ids):
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(blocks)), pa.array(ids)], ["block", "id"]
        )

    blocks, ids, marks = [], [], []
    for batch in batches:
        for shard, base, low, high, steps in zip(
            *[batch.column(i).to_pylist() for i in range(5)], strict=True
        ):
            if shard < 0:
                yield out(np.frombuffer(low, dtype=U), np.frombuffer(steps, dtype=np.int64))
                continue
            high = np.frombuffer(high, dtype=np.uint16).astype(U)
            steps = np.frombuffer(steps, np.uint16 if len(steps) == 2 * len(high) else np.int64)
            blocks.append(
                (U(shard) << U(47))
                | ((high & U(0x7FFF)) << U(32))
                | np.frombuffer(low, dtype=np.uint32).astype(U)
            )
            ids.append(base + np.cumsum(steps.astype(np.int64)))
            marks.append(high >> U(15) > 0)
    if blocks:
        block, id_, mark = (np.concatenate(x) for x in (blocks, ids, marks))
        order = np.argsort(block, kind="stable")
        block, id_, mark = block[order], id_[order], mark[order]
        use = mark.copy()
        same = block[1:] == block[:-1]
        use[1:] |= same
        use[:-1] |= same
        for lo in range(0, int(use.sum()), 100_000):
            at = np.flatnonzero(use)[lo : lo + 100_000]
            yield out(block[at], id_[at])


def shared_blocks(docs: DataFrame, width: int, share: int) -> DataFrame:
    """Members (block, id) of the blocks that several of the documents are in."""
    shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        reader, levels, dealer = Reader(), Levels(share), Dealer(min(shards, 1 << 16))
        for batch in batches:
            for run in reader.runs(batch.column(1)):
                ids = batch.column(0).slice(run.lo, run.hi - run.lo).to_numpy()
                for keys, owner in part_keys(*shingle_sets(run, width), levels):
                    yield from dealer.add(keys, ids[owner])
        yield from dealer.deal()

    dealt = docs.mapInArrow(
        read, "shard bigint, base bigint, low binary, high binary, steps binary"
    )
    return dealt.repartition("shard").mapInArrow(_gather, "block bigint, id bigint")


def _chunk(parts: Column, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.greatest(parts, F.lit(1)).cast("bigint"))


def _mixed_chunks(large: DataFrame) -> DataFrame:
    """Two blocks of each member of a large family, cut into chunks at random.

    Near copies share most of their keys, so they share the lowest and the highest; chunks of
    one are mixed anew in the other.
    """
    ends = F.array_distinct(F.array(F.array_min("blocks"), F.array_max("blocks")))
    rows = large.select("id", F.explode(ends).alias("block"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("held"))
    return rows.join(sizes.filter("held > 1"), "block").select(
        "block",
        _chunk(F.ceil(F.col("held") / CHUNK), "block", "id").alias("task"),
        F.lit(0).alias("side"),
        "id",
        F.col("id").alias("part"),
    )


def _open(members: DataFrame) -> DataFrame:
    """Groups, of members (grp, id, part), that have several parts.

    Only members outside the largest part, ``top``, can add links: with each other and with it.
    ``cost`` is how many sets that takes to be sent. Groups of the same members count once.
    """
    tally = members.groupBy("grp", "part").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("x")
    )
    groups = tally.groupBy("grp").agg(
        F.count("*").alias("parts"),
        F.sum("n").alias("held"),
        F.max(F.struct("n", "part")).alias("top"),
        F.expr("bit_xor(x)").alias("x"),
    )
    groups = groups.filter("parts > 1").groupBy("held", "x", "top").agg(F.min("grp").alias("grp"))
    main, rest = F.col("top.n"), F.col("held") - F.col("top.n")
    mains, rests = F.ceil(main / CHUNK), F.ceil(rest / CHUNK)
    return groups.select(
        "grp",
        F.col("top.part").alias("top"),
        mains.alias("mains"),
        rests.alias("rests"),
        (main * rests + rest * (mains + rests)).alias("cost"),
    )


def _rest_tasks(members: DataFrame) -> DataFrame:
    """Tasks for what may still link in large families, of members (family, id, part, blocks).

    A family is gone through as a whole, or block by block if that sends fewer sets.
    """
    whole = members.select(F.col("family").alias("grp"), "id", "part")
    open_families = settled(_open(whole), "open-families")
    is_open = open_families.select(F.col("grp").alias("family"), F.lit(True).alias("open"))
    inside = settled(members.join(broadcast_if_small(is_open), "family", "left"), "told-members")
    by_block = inside.filter("open").select(
        "family", "id", "part", F.explode("blocks").alias("grp")
    )
    by_block = settled(by_block, "open-members")
    of_family = by_block.select("grp", "family").distinct()
    open_blocks = settled(_open(by_block).join(of_family, "grp"), "open-blocks")
    costs = open_blocks.groupBy("family").agg(F.sum("cost").alias("by_block"))
    choice = open_families.join(costs.withColumnRenamed("family", "grp"), "grp", "left")
    cheaper = F.coalesce(F.col("by_block") < F.col("cost"), F.col("by_block").isNull())
    choice = settled(choice.withColumn("cut", cheaper), "ways")
    cut = choice.filter("cut").select(F.col("grp").alias("family"))
    rows = whole.join(choice.filter("NOT cut").drop("by_block", "cut", "cost"), "grp")
    block_rows = by_block.drop("family").join(
        open_blocks.join(cut, "family", "left_semi").drop("family", "cost"), "grp"
    )
    return _pair_tasks(rows.unionByName(block_rows))


def _pair_tasks(rows: DataFrame) -> DataFrame:
    """Members dealt to the pairs of chunks of a group that can add a link.

    Chunk r of the rest meets chunk m of the main part, every other chunk of the rest, and
    itself.
    """
    rest, main = _chunk(F.col("rests"), "id"), _chunk(F.col("mains"), "id")
    m, r = F.col("mains"), F.col("rests")

    def upto(n):
        return F.sequence(F.lit(0).cast("bigint"), n - 1)

    def pair(i, j):
        return m * r + F.least(i, j) * r + F.greatest(i, j)

    def task(number, side):
        return F.struct(number.alias("task"), side.alias("side"))

    to_rests = F.transform(upto(r), lambda i: task(i * m + main, F.lit(1)))
    to_mains = F.transform(upto(m), lambda i: task(rest * m + i, F.lit(0)))
    to_others = F.transform(
        upto(r), lambda i: task(pair(rest, i), F.when(rest <= i, 0).otherwise(1))
    )
    in_main = F.col("part") == F.col("top")
    tasks = F.when(in_main, to_rests).otherwise(F.concat(to_mains, to_others))
    return rows.withColumn("t", F.explode(tasks)).select(
        F.col("grp").alias("block"),
        F.col("t.task").alias("task"),
        F.col("t.side").alias("side"),
        "id",
        "part",
    )


# --- the join ---


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    share: int = 80,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when their sets of ``width``-word shingles have a Jaccard similarity of
    ``share`` percent or more; ``component_id`` is the smallest doc_id that links reach, the
    document's own included. A text without words, or null, has no shingles and links with
    nothing. A row without doc_id has no component. Rows that repeat a doc_id each get the
    component of their own text. No rows give no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    seen = settled(profiles(rows, width), "profiles")
    digest = ["n", "d1", "d2"]
    classes = settled(
        seen.filter("n > 0 AND doc_id IS NOT NULL")
        .groupBy(*digest)
        .agg(F.min("doc_id").alias("id"), F.count("*").alias("size")),
        "classes",
    )

    reps = broadcast_if_small(classes.select(F.col("id").alias("doc_id")))
    blocks = settled(shared_blocks(rows.join(reps, "doc_id", "left_semi"), width, share), "blocks")
    lowest = blocks.groupBy("block").agg(F.min("id").alias("low"))
    family = components(blocks.join(lowest, "block"), "id", "low").toDF("id", "family")
    family = settled(family, "families")
    held = family.groupBy("family").agg(F.count("*").alias("held"))
    held = settled(held.filter(F.col("held") > CHUNK).coalesce(1), "large-families")
    sized = family.join(broadcast_if_small(held), "family", "left").select(
        F.col("id").alias("doc_id"), "family", F.col("held").isNotNull().alias("large")
    )
    sized = settled(sized, "sized-families")
    sets = settled(set_rows(rows.join(broadcast_if_small(sized), "doc_id"), width), "sets")

    # A small family is one task, which has its components whole: (id, lowest) as links.
    one = {"block": F.col("family"), "task": F.lit(0), "side": F.lit(0), "part": F.col("id")}
    whole = _links(sets.filter("NOT large").withColumns(one), share)
    whole = whole.toDF("id", "component_id")
    if not held.isEmpty():
        sets = sets.filter("large").select("id", "set")
        # Every set with a row for all its blocks, of which it has a bounded number.
        of_each = blocks.groupBy("id").agg(F.collect_list("block").alias("blocks"))
        sized = sized.withColumnRenamed("doc_id", "id")
        of_each = settled(of_each.join(sized, "id"), "blocks-of-sets")
        large = of_each.filter("large").select("id", "family", "blocks")
        first = settled(_links(with_sets(_mixed_chunks(large), sets), share), "first-links")
        part = settled(components(first).toDF("id", "part"), "first-components")
        members = large.join(broadcast_if_small(part), "id", "left").select(
            "family", "id", F.coalesce("part", "id").alias("part"), "blocks"
        )
        more = _links(with_sets(_rest_tasks(settled(members, "members")), sets), share)
        whole = whole.union(components(first.union(settled(more, "more-links"))))
    whole = settled(whole, "components")
    named = classes.join(whole, "id", "left").select(
        *digest, "size", F.coalesce("component_id", "id").alias("component_id")
    )
    found = join_groups(seen.select("doc_id", *digest), named, digest, "size", "doc_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias(
            "component_id"
        ),
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Of every component of near duplicates the row with the smallest doc_id, whole.

    Rows without doc_id stay. Rows that share a doc_id stay or go together.
    """
    found = near_duplicates(docs, **how).filter("doc_id IS NULL OR doc_id = component_id")
    the_id = unused("_id", docs)
    kept = settled(found.select(F.col("doc_id").alias(the_id)).distinct(), "kept")
    id_col = docs[how.get("id_col", "doc_id")]
    return docs.join(broadcast_if_small(kept), id_col.eqNullSafe(F.col(the_id)), "left_semi")
