"""Merkle trees of documents over sections, paragraphs and leaves, in Spark expressions only.

Sections are parted by empty lines, paragraphs by line ends, and leaves are runs
of up to four words with their blanks, counted anew in each paragraph. All three
cuts can be undone, and each node is the SHA-256 of the nodes below it, so equal
roots mean equal texts.

Likeness is the Dice coefficient of the two trees' sets of leaf nodes, each with
its root as one more member, and so 1 only for equal texts.

Differing nodes locate an edit from the top: sections whose node the other tree
lacks are opened, and in them the paragraphs whose node the other's opened
sections lack have changed, wherever they stand, so that one paragraph put in is
one change. Where only the order, the repeats or the sections' bounds differ,
all paragraphs of the opened sections, or of those between the common beginning
and end, are named.

Defined cases: a null text is the empty text; equal texts, the empty one
included, have the likeness 1; rows of equal ids follow each other in the order
of their texts, and null ids come first; with one row only, that row is its own
successor; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shuffle_partitions, text_of, with_order_bucket

#: Up to four runs of up to 32 other characters with the blanks around them, or blanks alone.
LEAF = r"[ \t\x0B\f\r]*(?:[^ \t\x0B\f\r]{1,32}[ \t\x0B\f\r]*){1,4}|[ \t\x0B\f\r]+"


def node(kind: str, below: Column) -> Column:
    """The node over an array of nodes, 64 hex digits."""
    return F.sha2(F.concat(F.lit(kind), F.array_join(below, "")), 256)


def tree(text: Column) -> Column:
    """struct(sections: array of struct(node, paragraphs: array of nodes), leaves: array of distinct nodes)."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    paragraphs = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))

    def over(paragraphs: Column) -> Column:
        nodes = F.transform(paragraphs, lambda s: F.transform(s, lambda p: node("p", p)))
        sections = F.transform(nodes, lambda s: F.struct(node("s", s).alias("node"), s.alias("paragraphs")))
        return F.struct(sections.alias("sections"), F.array_distinct(F.flatten(F.flatten(paragraphs))).alias("leaves"))

    return let(paragraphs, over)


def root(sections: Column) -> Column:
    """The root over the nodes of the sections, 64 hex digits."""
    return node("r", sections["node"])


def likeness(leaves_a: Column, root_a: Column, leaves_b: Column, root_b: Column) -> Column:
    """Dice coefficient of the two sets of leaves and root, from 0 to 1."""
    common = F.size(F.array_intersect(leaves_a, leaves_b)) + (root_a == root_b).cast("int")
    return 2.0 * common / (F.size(leaves_a) + F.size(leaves_b) + 2)


def lacking(x: Column, y: Column) -> Column:
    """The elements of x whose `node` no element of y has; those nodes are dealt into about as many buckets as a bucket holds."""
    bucket = lambda n, count: F.pmod(F.xxhash64(n), count).cast("int")

    def among(only: Column) -> Column:
        def within(count: Column) -> Column:
            dealt = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: F.filter(only, lambda n: bucket(n, count) == k))
            return let(dealt, lambda table: F.filter(x, lambda e: F.array_contains(F.get(table, bucket(e["node"], count)), e["node"])))

        return let(F.greatest(F.ceil(F.sqrt(F.size(only))), F.lit(1)), within)

    return let(F.array_except(x["node"], y["node"]), among)


def between(x: Column, y: Column) -> Column:
    """The elements of x behind the beginning, and before the end, that x and y have in common."""

    def common(p: Column, q: Column) -> Column:
        place = F.array_position(F.zip_with(p, q, lambda a, b: a.eqNullSafe(b)), False)
        return F.when(place == 0, F.size(p)).otherwise(place - 1).cast("int")

    front = common(x["node"], y["node"])
    back = lambda f: F.least(common(F.reverse(x["node"]), F.reverse(y["node"])), F.least(F.size(x), F.size(y)) - f)
    return let(front, lambda f: F.slice(x, f + 1, F.size(x) - f - back(f)))


def differences(a: Column, b: Column) -> Column:
    """struct(removed, added): arrays of struct(section, paragraph), from 0, that an edit took from a and put into b."""
    numbered = lambda sections: F.transform(sections, lambda s, i: F.struct(s["node"].alias("node"), s["paragraphs"].alias("paragraphs"), i.alias("section")))
    opened = lambda sections: F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p, j: F.struct(p.alias("node"), s["section"].alias("section"), j.alias("paragraph")))))
    places = lambda found: F.transform(found, lambda e: F.struct(e["section"], e["paragraph"]))
    pair = lambda x, y: F.struct(x.alias("removed"), y.alias("added"))
    none = lambda p: F.size(p["removed"]) + F.size(p["added"]) == 0

    def of_sections(s: Column) -> Column:
        new = pair(lacking(s["removed"], s["added"]), lacking(s["added"], s["removed"]))
        shown = let(new, lambda n: F.when(none(n), pair(between(s["removed"], s["added"]), between(s["added"], s["removed"]))).otherwise(n))
        return let(shown, lambda n: let(pair(opened(n["removed"]), opened(n["added"])), of_paragraphs))

    def of_paragraphs(p: Column) -> Column:
        new = pair(lacking(p["removed"], p["added"]), lacking(p["added"], p["removed"]))
        shown = let(new, lambda n: F.when(none(n), p).otherwise(n))
        return let(shown, lambda n: pair(places(n["removed"]), places(n["added"])))

    return let(pair(numbered(a), numbered(b)), of_sections)


def fingerprints(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns {prefix}fingerprint, {prefix}sections and {prefix}leaves of a text column."""
    made = docs.withColumn(f"{prefix}tree", tree(text_of(text_col)))
    made = made.withColumn(f"{prefix}sections", F.col(f"{prefix}tree.sections")).withColumn(f"{prefix}leaves", F.col(f"{prefix}tree.leaves")).drop(f"{prefix}tree")
    return made.withColumn(f"{prefix}fingerprint", root(F.col(f"{prefix}sections")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, text, next_text): the text of the following id, after the last that of the first.

    One shuffle of the texts: rows go to buckets of the order, and the first row
    of each bucket goes, as a sentinel, to the end of the bucket before as well.
    The driver sees one id for each bucket.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    placed = with_order_bucket(narrow, "id", buckets or 8 * shuffle_partitions(spark))
    firsts = sorted(placed.groupBy("bucket").agg(F.min("id").alias("id")).collect(), key=lambda r: r["bucket"])
    moves = [(row["bucket"], row["id"], firsts[i - 1]["bucket"]) for i, row in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(moves, "own int, first bigint, before int"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("sentinel"))
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("sentinel"))))
    rows = placed.join(table, (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("first")), "left").select("id", "text", F.explode(copies).alias("at")).select("id", "text", "at.*")
    order = Window.partitionBy("bucket").orderBy("sentinel", F.col("id").asc_nulls_first(), "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).filter("not sentinel").select(F.col("id").alias(id_col), "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points, rounded down, replaced by as many of the following text's first."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(following, F.lit(1), quarter))
