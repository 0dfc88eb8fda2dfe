"""Groups of near copies: texts whose word shingles have a Jaccard similarity of `least` or more.

SimHash links come first (`simhash.links`); at a similarity of 0.8 fingerprints
of 64 bits differ in 8 to 10 places, sometimes in 17, which no join key covers.
The candidates for the rest come from MinHash: `BANDS` keys of `ROWS` minima
each. Two texts of similarity 0.8 share none of 20 keys of 3 minima with a
probability of (1 - 0.8^3)^20, below 1e-6, and more similar ones with a lower
one. Every candidate pair is verified on its shingle sets.

* Texts with equal shingle sets are one class, so copies never meet.
* A key of at most `pair_limit` classes pairs its members as rows, if their
  sizes allow the similarity.
* The classes of any other key are compared with its leader, the one whose
  text's hash is least, which is mostly the same one in all keys that a family
  of near copies shares. Those similar to it are connected through it, so no two
  of them are compared. Every other class is compared with all classes of the
  key: both are dealt into blocks of bounded size, and each pair of blocks is
  compared by one matrix product. What is similar there is connected to the
  least fingerprint that it reaches, which gives the same components by few
  edges. So the work grows with a family of near copies, and with the square of
  those only that share a key without being similar.

Defined cases are those of `simhash`; a text without words has no keys and is
linked by its fingerprint alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import HOT, bounded, cut, joined, slices, text_of

BANDS, ROWS = 20, 3
#: Classes and shingles that a block holds, and shingles that minima are taken over at a time.
BLOCK, BLOCK_SHINGLES, PART = 256, 1 << 19, 1 << 12
_RANDOM = np.random.default_rng(simhash.SEED)
FLIPS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, simhash.SEED) for s in simhash.shingles_of(text, size)), dtype="<u8"))


def keys_of(hashes: np.ndarray) -> list[int]:
    """The MinHash keys of a set, signed; an empty set has none."""
    if not len(hashes):
        return []
    least = np.min([((hashes[i : i + PART] ^ FLIPS) * FACTORS).min(axis=1) for i in range(0, len(hashes), PART)], axis=0).astype("<u8")
    found = [xxhash.xxh64_intdigest(least[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)]
    return np.array(found, dtype="<u8").view("<i8").tolist()


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether two packed sets have a Jaccard similarity of `least` or more."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def similar_of(left: list[bytes], right: list[bytes], least: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) of all similar pairs of two lists of packed sets, by a matrix product over the hashes that both hold."""
    a, b = ([np.frombuffer(x, "<u8") for x in side] for side in (left, right))
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    both = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(shared), PART):
        part = shared[start : start + PART]
        both += np.matmul(*(m if i == 0 else m.T for i, m in enumerate(np.array([np.isin(part, x, assume_unique=True) for x in side], np.float32) for side in (a, b))))
    sizes = np.add.outer([len(x) for x in a], [len(x) for x in b])
    for i, j in np.argwhere(both >= least * (sizes - both)):
        yield int(i), int(j)


def stars(edges: Iterator[tuple[int, int]]) -> set[tuple[int, int]]:
    """Edges from every node to the least of its component."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while (above := root.setdefault(node, node)) != node:
            root[node] = root[above]
            node = above
        return node

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(r, node) for node in list(root) if (r := find(node)) != node}


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, text_key, row_key, fingerprint, same, size, keys) of each row; same is a digest of the shingle set."""
    narrow = keyed_texts(docs, id_col, text_col)
    schema = T.StructType([narrow.schema[id_col], *(T.StructField(n, T.LongType()) for n in ("text_key", "row_key", "fingerprint", "same", "size")), T.StructField("keys", T.ArrayType(T.LongType()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sets = [shingle_set(x, shingle_words) for x in texts]
            prints = np.array([simhash.fingerprint(x, shingle_words) for x in texts], dtype="<u8").view("<i8")
            same = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], dtype="<u8").view("<i8")
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(prints), pa.array(same), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(keys_of, sets)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return bounded(narrow).mapInArrow(kernel, schema)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, text_key, row_key): hashes of the text, and of the id and the text."""
    texts = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    return texts.withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64(id_col, "text"))


def packed_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(text_key, packed) of the texts whose row keys are wanted: by these, copies of a text don't meet in one task."""
    narrow = keyed_texts(docs, id_col, text_col).join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"]).select("text_key", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, shingle_words).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["text_key", "packed"])

    return bounded(narrow).mapInArrow(kernel, "text_key long, packed binary")


def links(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle_words: int, least: float, pair_limit: int) -> DataFrame:
    """Edges (a, b) between the fingerprints of texts whose shingle sets are similar."""
    least_text = F.min(F.struct("text_key", "row_key", "fingerprint", "size", "keys")).alias("c")
    classes = cut(found.groupBy("same").agg(least_text, F.count(F.lit(1)).alias("rows"), (F.min("fingerprint") != F.max("fingerprint")).alias("several")).select("same", "rows", "several", "c.*"))
    # equal shingle sets whose fingerprints differ, for repeats count in these
    several = classes.filter("several").select("same", "rows", F.col("fingerprint").alias("b"))
    copies = joined(found.select("same", F.col("fingerprint").alias("a")), several, ["same"], "rows", found.count()).select("a", "b").filter("a <> b")

    rows = classes.select(F.explode("keys").alias("key"), "text_key", "row_key", "fingerprint", "size")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles")).filter("members > 1")
    shared = cut(rows.join(sizes, "key"))  # nothing needs this join's partitioning, so a hot key's rows may be split at run time
    sets = cut(packed_sets(docs, shared.select("row_key").distinct(), id_col, text_col, shingle_words))

    members = F.array_sort(F.collect_list(F.struct("text_key", "fingerprint", "size")))
    small = shared.filter(F.col("members") <= pair_limit).groupBy("key").agg(members.alias("all"))
    first = small.select("all", F.posexplode("all").alias("place", "a"))
    pairs = first.select("a", F.explode(F.slice("all", F.col("place") + 2, pair_limit)).alias("b"))
    fit = F.least("a.size", "b.size") >= F.lit(least) * F.greatest("a.size", "b.size")
    pairs = pairs.filter(fit & (F.col("a.fingerprint") != F.col("b.fingerprint"))).distinct()
    pairs = pairs.select(F.col("a.text_key").alias("x"), F.col("b.text_key").alias("y"), F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))
    side = lambda name, out: sets.select(F.col("text_key").alias(name), F.col("packed").alias(out))
    close = verified(pairs.join(side("x", "left"), "x").join(side("y", "right"), "y"), least).select("a", "b")

    hot = shared.filter(F.col("members") > pair_limit).select("key", "text_key", "fingerprint", "members", "shingles")
    leaders = hot.groupBy("key").agg(F.min(F.struct(F.xxhash64("text_key").alias("hash"), F.col("text_key").alias("x"), F.col("fingerprint").alias("a"))).alias("l"), F.count(F.lit(1)).alias("n")).select("key", "l.x", "l.a", "n")
    n_hot = hot.count()
    led = cut(joined(hot, leaders, ["key"], "n", n_hot).drop("n"))
    met = led.filter("x <> text_key").select("x", "a", F.col("text_key").alias("y"), F.col("fingerprint").alias("b")).distinct()
    # a leader may have a third of all members: its set is copied to as many places as they are dealt to, HOT more than leaders in all
    weights = met.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("places", F.ceil(F.col("n") * HOT / F.lit(max(n_hot, 1))))
    placed = joined(met, weights, ["x"], "n", n_hot).withColumn("place", F.pmod(F.xxhash64("y"), F.col("places")))
    copied = weights.select("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("places") - 1)).alias("place")).join(side("x", "left"), "x")
    attached = cut(verified(placed.join(side("y", "right"), "y").join(copied, ["x", "place"]), least))

    met_leader = attached.select("x", F.col("y").alias("text_key"), F.lit(True).alias("met"))
    flagged = led.join(met_leader, ["x", "text_key"], "left").withColumn("apart", (F.col("x") != F.col("text_key")) & F.col("met").isNull()).drop("met")
    open_keys = flagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("apart").alias("any")).filter("any").drop("any")
    todo = joined(flagged, open_keys, ["key"], "n", n_hot)
    # a power of two, so that keys of about the same texts make about the same blocks and stars
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)))).cast("bigint")
    dealt = todo.withColumn("block", F.pmod(F.xxhash64("text_key"), F.greatest(blocks, F.lit(1)))).join(sets, "text_key")
    held = dealt.groupBy("key", "apart", "block").agg(F.collect_list(F.struct("fingerprint", "packed")).alias("held"))
    held = cut(held.select("key", "apart", "block", F.col("held.fingerprint").alias("prints"), F.col("held.packed").alias("sets")))
    other = held.select("key", F.col("apart").alias("other_apart"), F.col("block").alias("other"), F.col("prints").alias("others"), F.col("sets").alias("theirs"))
    crossing = held.filter("apart").join(other, "key").filter("not other_apart or block <= other").select("prints", "sets", "others", "theirs")

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints, left, others, right = (batch.column(i)[0].as_py() for i in range(4))
            edges = stars((prints[i], others[j]) for i, j in similar_of(left, right, least))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in range(2)], names=["a", "b"])

    wide = bounded(crossing).mapInArrow(crossed, "a long, b long")
    found = copies.unionByName(close).unionByName(attached.select("a", "b")).unionByName(wide)
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """(x, y, a, b) of the pairs (x, y, a, b, left, right) whose packed sets are similar."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yes = [similar(x, y, least) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["x", "y", "a", "b"]).filter(pa.array(yes, pa.bool_()))

    return bounded(pairs.select("x", "y", "a", "b", "left", "right")).mapInArrow(each, "x long, y long, a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 2, least: float = 0.8, bucket_limit: int = 64, pair_limit: int = 8) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the smallest id of its group."""
    found = cut(sketches(docs, id_col, text_col, shingle_words))
    classes = simhash.classes_of(found, id_col)
    similar_texts = cut(links(docs, found, id_col, text_col, shingle_words, least, pair_limit))
    edges = cut(simhash.links(classes, max_bits, 3 * max_bits + 1, bucket_limit).unionByName(similar_texts))
    return simhash.named(found.select(id_col, "fingerprint"), classes, edges, id_col)
