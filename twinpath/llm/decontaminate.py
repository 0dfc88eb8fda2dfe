"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space is collapsed. An item of
`n` characters may differ from a stretch of a document by `n * ERROR_RATE`
edits. It is split into one piece more than that, so that any such stretch holds
one piece unchanged, about where the item has it. One automaton finds all
pieces of all items in one pass over a document; around each hit, Myers'
bit-parallel distance tells the fewest edits between the item and a stretch.

Items are the stated query set. They are read in blocks of bounded size, and
the documents pass each block without a shuffle or a join. A block is broadcast
when it has been read, so the driver holds one at a time, and a task builds the
automaton of one block only: `matches` scans the documents anew for each block,
`clean` writes what is left between two blocks.

Defined cases: null and empty items match nothing; items too short for two
pieces of `LEAST_PIECE` characters must occur unchanged and as whole words; null
and empty documents hold no item; repeated items and rows are matched as often
as they come; null ids pass through; an empty table gives an empty result;
further columns are not read by `matches` and kept by `clean`.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, slices, text_of

ERROR_RATE = 0.08
LEAST_PIECE = 8
#: Characters of benchmark items that one pass over the documents looks for: about 150 MB of automaton in a worker.
BLOCK_CHARS = 2_000_000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float) -> int:
    """Edits that an item of this length may differ by."""
    return max(0, min(int(length * error_rate), length // LEAST_PIECE - 1))


class Item:
    """An item, its budget, and for Myers' algorithm where each character stands in it."""

    def __init__(self, item_id: int, text: str, error_rate: float) -> None:
        self.id, self.text = item_id, text
        self.budget = budget(len(text), error_rate)

    @functools.cached_property
    def places(self) -> dict[str, int]:
        found: dict[str, int] = defaultdict(int)
        for i, c in enumerate(self.text):
            found[c] |= 1 << i
        return found

    def whole_words(self, text: str, start: int) -> bool:
        """Whether text[start:] begins with the item as whole words: no letter or digit goes on at its ends."""
        end = start + len(self.text)
        inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
        return not inside(start) and not inside(end)

    def pieces(self) -> Iterator[tuple[int, str]]:
        n = self.budget + 1
        edges = [len(self.text) * i // n for i in range(n + 1)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield a, self.text[a:b]

    def best(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """(edits, end) of the stretch within text[start:end] that differs least, if within the budget."""
        length, places = len(self.text), self.places
        ones, high = (1 << length) - 1, 1 << (length - 1)
        up, down, score, found = ones, 0, length, None
        most = self.budget
        for i in range(start, end):
            match = places.get(text[i], 0)
            zero = (((match & up) + up) ^ up) | match | down
            up_right = down | ~(zero | up) & ones
            down_right = up & zero
            if up_right & high:
                score += 1
            elif down_right & high:
                score -= 1
                if score <= most:
                    found, most = (score, i + 1), score - 1
            elif score - (end - i) > most:
                break
            up_right = up_right << 1 & ones
            down_right = down_right << 1 & ones
            up = down_right | ~(zero | up_right) & ones
            down = up_right & zero
        return found


class Finder:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = [Item(item_id, text, error_rate) for item_id, text in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in enumerate(self.items):
            for offset, piece in item.pieces():
                pieces[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, edits, end in the normalised text): the best stretch for each item that has one."""
        windows: dict[int, list[list[int]]] = defaultdict(list)
        whole: dict[int, int] = {}
        for last, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                item = self.items[number]
                if not item.budget:  # the piece is the item
                    if number not in whole and item.whole_words(text, last + 1 - length):
                        whole[number] = last + 1
                    continue
                start = max(0, last + 1 - length - offset - item.budget)
                end = min(len(text), start + len(item.text) + 2 * item.budget + 1)
                mine = windows[number]
                if mine and start <= mine[-1][1] - len(item.text):
                    mine[-1] = [min(mine[-1][0], start), max(mine[-1][1], end)]
                else:
                    mine.append([start, end])
        found = [(number, 0, end) for number, end in whole.items()]
        for number, mine in windows.items():
            hits = [hit for start, end in mine if (hit := self.items[number].best(text, start, end))]
            if hits:
                found.append((number, *min(hits)))
        return sorted(found)


FOUND = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("budget", T.IntegerType()), T.StructField("item_chars", T.IntegerType()), T.StructField("end", T.IntegerType())])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[Broadcast]:
    """The normalised items, broadcast in blocks of bounded size; the driver holds one partition and one block at a time."""
    block, size = [], 0
    share = benchmark.sparkSession.sparkContext.broadcast
    for row in benchmark.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).toLocalIterator():
        text = normalised(row["text"])
        if text:
            block.append((row["id"], text))
            size += len(text)
            if size >= chars:
                yield share(block)
                block, size = [], 0
    if block:
        yield share(block)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, distance, budget, item_chars, end) for each document and item that it holds."""
    narrow = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    item_field = T.StructField(item_col, benchmark.schema[item_col].dataType)
    schema = T.StructType([narrow.schema[id_col], item_field, *FOUND.fields])

    def scan(items: Broadcast) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items.value, error_rate)
            for batch in slices(batches):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for number, edits, end in finder.matches(normalised(text)):
                        item = finder.items[number]
                        rows.append((doc_id, item.id, edits, item.budget, len(item.text), end))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [batch.schema.field(0).type, None, pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        return bounded(narrow).mapInArrow(kernel, schema)

    parts = [scan(block) for block in blocks(benchmark, item_col, item_text_col, block_chars)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, items: Broadcast) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items.value, error_rate)
            for batch in slices(batches):
                yield batch.filter(pa.array([not t or not finder.matches(normalised(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        return bounded(rows).mapInArrow(kernel, rows.schema)

    for number, block in enumerate(blocks(benchmark, item_col, item_text_col, block_chars)):
        docs = without(cut(docs) if number else docs, block)
    return docs
