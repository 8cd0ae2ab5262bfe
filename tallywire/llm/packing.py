"""Packing documents into token sequences, online and with bounded space.

Every task keeps a fixed number of open windows. A document goes to the window in which it
leaves the least room. When it fits none, the fullest window is emitted and a new one opened.
What is longer than a window is cut into whole windows first. What is open when a task's rows
end is merged with what other tasks left.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.llm.tables import groups_in_order
from tallywire.plans.sizes import settled

WINDOW = 2048
OPEN = 64  # open windows of a task
FLUSH = 1 << 20  # bytes of ids of a batch
MERGED = 8  # tasks whose leftovers are merged together
FULL = 0.9  # a merged window below this share gives its pieces away to be cut
WORDS = 800_000  # words whose ids a task remembers
END = 1
ROW_BYTES = 64  # of the numbers beside the ids

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, "
    "sequence_id bigint, offset bigint, task bigint"
)

# Characters for which words can be split here: printable ASCII and Latin letters that have
# one composed and one lower-case form.
_PLAIN = "[!-~À-ÖØ-öø-įı-ſ]+"


class WordIds(dict):
    """Token ids, as little-endian 32-bit numbers, of words between white space.

    Added tokens in a text are split as any other text is, unless ``added`` is set: then they
    are their own ids, as the tokenizer has it when nothing is set.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import json
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        steps = known["pre_tokenizer"]["pretokenizers"]
        # Words that may hold an added token go through the tokenizer itself.
        marks = [re.escape(t["content"]) for t in known["added_tokens"]] if added else []
        self.marked = re.compile("|".join(marks) or "(?!)", re.I).search
        # The file's own pattern, with its classes written out for plain characters.
        letters = "a-zß-öø-ſ"
        pattern = steps[0]["pattern"]["Regex"]
        pattern = pattern.replace("\\p{L}", letters).replace("\\p{N}", "0-9")
        self.split = re.compile(pattern).findall
        self.plain = re.compile(_PLAIN).fullmatch
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {
            c: visible.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x180) if c != 0xF7
        }

        self.parts: dict[str, bytes] = {}  # of plain words: letters without signs around them

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain(text) and not self.marked(text):
            text = text.lower()
            if text.isalpha():
                found = self.parts.get(text) or self._part(text)
            else:
                found = b"".join([self.parts.get(p) or self._part(p) for p in self.split(text)])
        else:
            found = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= WORDS:
            self.clear()
            self.parts.clear()
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        seen = part if part.isascii() else part.translate(self.visible)
        found = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        self.parts[part] = found
        return found

    def of(self, text: bytes) -> bytes:
        """Ids of a text. White space parts tokens, so words can be looked up one by one."""
        return b"".join(map(self.__getitem__, text.split()))


class Windows:
    """Open windows of a task, sorted by the room they have left."""

    def __init__(self, most: int, size: int) -> None:
        self.most, self.size = most, size
        self.open: list[tuple[int, int, list]] = []  # (room, number, pieces)
        self.number = 0

    def place(self, piece: tuple) -> list | None:
        """Put a piece (..., length at 2) away; the pieces of a window that had to go, if any."""
        need, gone = piece[2], None
        at = bisect.bisect_left(self.open, (need,))
        if at < len(self.open):
            room, number, pieces = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                gone = self.open.pop(0)[2]
            room, number, pieces = self.size, self.number, []
            self.number += 1
        pieces.append(piece)
        if room == need:
            # Two windows may be full at once only if one was emitted for the other.
            if gone is None:
                return pieces
            bisect.insort(self.open, (0, number, pieces))
            return gone
        bisect.insort(self.open, (room - need, number, pieces))
        return gone


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "task"]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end when their ids take FLUSH bytes, so that a task holds little."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4]) + ROW_BYTES
        if size >= FLUSH:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _laid(pieces: list[tuple], sequence: int | None, task: int) -> Iterator[tuple]:
    """Rows of a sequence; a piece is (doc_id, start, length, doc_tokens, ids)."""
    offset = 0
    for piece in pieces:
        yield (*piece, sequence, offset, task)
        offset += piece[2]


def _pack_task(batches, path: str, size: int, most: int):
    from pyspark import TaskContext

    yield from _batches(_packed_rows(batches, TaskContext.get().partitionId(), path, size, most))


def _packed_rows(batches, task: int, path: str, size: int, most: int) -> Iterator[tuple]:
    ids_of = WordIds(path, added=True)
    windows, count = Windows(most, size), 0
    end = END.to_bytes(4, "little")
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            ids = ids_of.of(text.as_py() or b"") + end
            n = len(ids) // 4
            for start in range(0, n, size):
                length = min(size, n - start)
                part = ids[4 * start : 4 * (start + length)]
                piece = (doc_id, start, length, n, part)
                full = [piece] if length == size else windows.place(piece)
                if full:
                    yield from _laid(full, (task << 32) + count, task)
                    count += 1
    for _, _, pieces in windows.open:
        yield from _laid(pieces, None, task)


def merge_left(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """Sequences of leftover pieces: best fit from the longest down, then cuts.

    What still leaves more than a tenth of a window empty is cut to fill windows to the last
    place; the end of that becomes sequences whose lengths are powers of two, which need no
    padding.
    """
    windows = Windows(len(pieces) + 1, size)
    done = []
    for piece in sorted(pieces, key=lambda p: -p[2]):
        if full := windows.place(piece):
            done.append(full)
    thin = []
    for room, _, held in windows.open:
        if size - room >= FULL * size:
            done.append(held)
        else:
            thin += held
    total = sum(p[2] for p in thin)
    lengths = [size] * (total // size)
    lengths += [1 << b for b in range(size.bit_length(), -1, -1) if (total % size) >> b & 1]
    for length in lengths:
        held = []
        while length:
            doc_id, start, n, doc_tokens, ids = thin.pop()
            take = min(n, length)
            held.append((doc_id, start, take, doc_tokens, ids[: 4 * take]))
            if take < n:
                thin.append((doc_id, start + take, n - take, doc_tokens, ids[4 * take :]))
            length -= take
        done.append(held)
    return done


def _merge_tasks(batches, size: int):
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]
    for group in groups_in_order(batches, ["merged"]):
        merged = group.column("merged")[0].as_py()
        pieces = list(zip(*[group.column(n).to_pylist() for n in names], strict=True))
        done = enumerate(merge_left(pieces, size))
        first = (1 << 62) + (merged << 32)
        yield from _batches(r for n, held in done for r in _laid(held, first + n, -1))


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = WINDOW,
    open_windows: int = OPEN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that executors can read. A document is the
    ids of its text, with no special tokens added to it, and END; a null text is empty. ``start`` counts
    the document's ids before the piece, ``ids`` holds the piece's as little-endian 32-bit
    numbers, and pieces of a sequence lie one after the other from ``offset`` 0. A sequence
    holds at most ``size`` ids and is padded to that, unless its length is a power of two.

    Every row is packed on its own, also those that repeat a doc_id or have none. A task holds
    ``open_windows`` windows and one document; leftovers of MERGED tasks are merged together.
    No rows give no sequences.
    """
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    packed = rows.mapInArrow(lambda b: _pack_task(b, tokenizer, size, open_windows), PIECES)
    packed = settled(packed, "packed")
    merged = F.floor(F.col("task") / MERGED).alias("merged")
    left = packed.filter("sequence_id IS NULL").select("*", merged)
    left = left.repartition("merged").sortWithinPartitions("merged", "task", "doc_id", "start")
    left = left.mapInArrow(lambda b: _merge_tasks(b, size), PIECES)
    return packed.filter("sequence_id IS NOT NULL").union(left).drop("task")
