"""SimHash near-duplicate groups by pigeonring filtering.

A fingerprint has one bit for each of 64 places; it is set if more than half of
the shingle hashes set it. Two texts are linked when their fingerprints differ
in at most `max_bits` places, and a group is a connected component of links.

How the links are found without comparing all pairs:

* equal fingerprints are one class from the start, so copies never meet;
* the 64 places form a ring of `segments` arcs. By the pigeonring principle two
  fingerprints within `max_bits` have an arc from which every chain of `l`
  consecutive arcs differs in at most `l * max_bits / segments` places. The
  arcs at the head of that chain, whose budget is below one, must be equal:
  they are the join key. The longer chains prune what the key lets through,
  and only then comes the full Hamming check;
* a key that more than `bucket_limit` classes share is not paired. Its members
  emit themselves with few places changed and meet at the common neighbour:
  everything there is linked to one of them. This is exact as well, and its
  rows grow with the members, not with their square;
* components come from alternating large-star and small-star rounds, each cut
  by a checkpoint that replaces the one before; nothing is gathered on the
  driver but two sums a round;
* rows meet what is known of their key (a bucket's size, a hub's least
  neighbour, a fingerprint's group) by `common.joined`, so a key that a third of
  all rows have isn't one task's work.

Defined cases: a null text is the empty text; a text without words has the
fingerprint 0 and is linked like any other; fewer words than a shingle make one
shingle of all of them; repeated rows are returned as often as they come; null
ids are fingerprinted and linked, yet can't name a group (a group of null ids
only has a null component); an empty table gives an empty result; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, dropped, joined, slices, text_of

SEED = 42
BITS = 64
#: Shingles hashed, and bytes split into words, at a time: bounds memory on very long texts.
BLOCK = 1 << 16
PIECE = 1 << 20


def words_of(text: bytes) -> Iterator[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, cut at ASCII white space."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        piece = text[start:end]
        cut_at = max(piece.rfind(b) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut_at <= 0:  # a word longer than a piece, at its start or behind a blank: take all the rest
            break
        yield from piece[:cut_at].lower().split()
        start += cut_at
    yield from text[start:].lower().split()


def shingles_of(text: bytes, size: int) -> Iterator[bytes]:
    if len(text) <= PIECE:
        words = text.lower().split()
        if len(words) >= size:
            return map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))
        return iter([b" ".join(words)] if words else [])
    return _rolling(words_of(text), size)


def _rolling(words: Iterator[bytes], size: int) -> Iterator[bytes]:
    window = list(islice(words, size))
    if window:
        yield b" ".join(window)
    for word in words:
        window = [*window[1:], word]
        yield b" ".join(window)


def fingerprint(text: bytes, size: int) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    shingles = shingles_of(text, size)
    votes, total = np.zeros(BITS, dtype=np.int64), 0
    while True:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, BLOCK), repeat(SEED)), dtype="<u8")
        if not len(hashes):
            break
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits((2 * votes > total).astype(np.uint8), bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """(id, fingerprint as a signed long) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(x, shingle_words) for x in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "fingerprint"])

    narrow = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    schema = T.StructType([narrow.schema[id_col], T.StructField("fingerprint", T.LongType())])
    return bounded(narrow).mapInArrow(kernel, schema)


class Ring:
    """The arcs of the ring, the join masks and the budgets of its chains."""

    def __init__(self, segments: int, max_bits: int) -> None:
        self.segments, self.max_bits = segments, max_bits
        edges = [BITS * i // segments for i in range(segments + 1)]
        self.arcs = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(segments)]
        self.budgets = [length * max_bits // segments for length in range(1, segments + 1)]
        self.head = sum(b == 0 for b in self.budgets)
        if not self.head:
            raise ValueError("more segments than bits are needed, else no arc must be equal")

    def chain(self, start: int, length: int) -> int:
        mask = 0
        for i in range(length):
            mask |= self.arcs[(start + i) % self.segments]
        return mask

    def masks(self) -> list[int]:
        return [self.chain(start, self.head) for start in range(self.segments)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _within_chains(ring: Ring, start: Column, difference: Column) -> Column:
    """Every chain from `start` stays within its budget; the last one is the whole ring."""
    passes = F.lit(True)
    for length in range(ring.head + 1, ring.segments + 1):
        masks = F.array(*[F.lit(_signed(ring.chain(s, length))) for s in range(ring.segments)])
        passes &= F.bit_count(difference.bitwiseAND(F.element_at(masks, start + 1))) <= ring.budgets[length - 1]
    return passes


def links(classes: DataFrame, max_bits: int, segments: int = 7, bucket_limit: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose transitive closure is that of all links.

    Buckets of at most `bucket_limit` classes give every link among them;
    larger ones give stars through common neighbours, which connect the same.
    """
    ring = Ring(segments, max_bits)
    keys = F.array(*[F.struct(F.lit(r).alias("start"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for r, m in enumerate(ring.masks())])
    rows = classes.select("fingerprint", F.explode(keys).alias("k")).select("k.start", "k.key", "fingerprint")
    sizes = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("members"))
    shared = joined(rows, sizes.filter("members > 1"), ["start", "key"], "members", classes.count() * segments)

    small = shared.filter(F.col("members") <= bucket_limit).groupBy("start", "key").agg(F.array_sort(F.collect_list("fingerprint")).alias("all"))
    first = small.select("start", "all", F.posexplode("all").alias("place", "a"))
    pairs = first.select("start", "a", F.explode(F.slice("all", F.col("place") + 2, bucket_limit)).alias("b"))
    close = pairs.filter(_within_chains(ring, F.col("start"), F.col("a").bitwiseXOR(F.col("b")))).select("a", "b")

    near, far = max_bits // 2, max_bits - max_bits // 2
    changes = []
    for r, mask in enumerate(ring.masks()):
        free = [i for i in range(BITS) if not mask >> i & 1]
        for n in range(far + 1):
            changes += [(r, _signed(sum(1 << i for i in places)), n) for places in combinations(free, n)]
    spark = classes.sparkSession
    # a table of constants: `segments` times the ways to change a few of the free places
    table = F.broadcast(spark.createDataFrame(changes, "start int, change bigint, changed int"))
    spread = shared.filter(F.col("members") > bucket_limit).join(table, "start")
    meeting = spread.withColumn("at", F.col("fingerprint").bitwiseXOR(F.col("change")))
    # at most one member for each way to change a place meets at a neighbour
    stars = meeting.groupBy("start", "key", "at").agg(F.min(F.when(F.col("changed") <= near, F.col("fingerprint"))).alias("a"), F.collect_set("fingerprint").alias("all"))
    spokes = stars.filter(F.col("a").isNotNull() & (F.size("all") > 1)).select("a", F.explode("all").alias("b")).filter("a <> b")
    return close.unionByName(spokes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of an edge; the root is the smallest node of its component.

    Alternating large-star and small-star rounds end in stars after a number of
    rounds that grows with the logarithm of the nodes.
    """
    current = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        seen = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(seen)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined(both, least, ["u"], "n", 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, lower, ["u"], "n", 2 * seen[0])
        last, current = current, cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        dropped(last)
    raise RuntimeError("the components did not settle")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 3, segments: int | None = None, bucket_limit: int = 64) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the smallest id of its group."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words))
    classes = classes_of(prints, id_col)
    return named(prints, classes, links(classes, max_bits, segments or 3 * max_bits + 1, bucket_limit), id_col)


def classes_of(prints: DataFrame, id_col: str) -> DataFrame:
    """(fingerprint, least_id, rows) of each distinct fingerprint."""
    return cut(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("rows")))


def named(prints: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """prints and the component_id that the edges between their fingerprints give."""
    roots = components(edges)
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    labels = joined(rooted, least, ["root"], "classes", n_classes).select("fingerprint", "component_id", "rows")
    return joined(prints, labels, ["fingerprint"], "rows", n_rows).select(id_col, "fingerprint", "component_id")


def hexadecimal(column: str) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
