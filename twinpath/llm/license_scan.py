"""License scans by diagonal voting.

All rolling word pairs of a text are hashed, exploded with their positions and
joined to the positions of the same pairs in the templates. A pair at word `p`
of the text and `t` of a template votes for the diagonal `p - t`; a template
copied without a change has all its votes on one diagonal, and a word put in or
left out moves the rest to a neighbouring one. Neighbouring diagonals are
merged, and the merged span is verified: enough of the template's pairs, in a
span about as long as the stretch of the template that it covers.

The base phrases are templates as well, which only a full diagonal confirms.
The hashes have 64 bits and the templates some hundred pairs, so that a chance
hit is expected once in about 10^16 words.

Words are runs of ASCII letters and digits and of all characters above ASCII,
with A-Z lower-cased.

Defined cases: a null text is the empty text, with no words and no labels;
repeated rows and ties are scanned row by row; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

SEED = 42
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Wordings of well-known public licenses and notices, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under cc by 4 0", "cc-by-4.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl-3.0"),
    ("under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation", "gfdl-1.3"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2.0"),
    ("licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "eupl-1.2"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0-1.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-conditions"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "bsl-1.0"),
]

#: A diagonal of a template counts with so many votes, neighbours merge up to so many words apart, and a span needs such a share of the template's pairs.
LEAST_VOTES, APART, LEAST_COVER = 2, 3, 0.6


def pair_hash(first: str, second: str) -> int:
    """Spark's xxhash64 of two strings: the hash of the first is the seed of the second."""
    value = xxhash.xxh64_intdigest(second.encode(), xxhash.xxh64_intdigest(first.encode(), SEED))
    return value - (1 << 64) if value >> 63 else value


def template_table(spark: SparkSession) -> DataFrame:
    """(hash, template, at, pairs, label, base) for each pair of each phrase and template: constants."""
    rows = []
    for number, (text, label, base) in enumerate([*((t, x, True) for t, x in PHRASES), *((t, x, False) for t, x in TEMPLATES)]):
        words = text.split()
        rows += [(pair_hash(a, b), number, at, len(words) - 1, label, base) for at, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return spark.createDataFrame(rows, "hash bigint, template int, at int, pairs int, label string, base boolean")


def words(text: Column) -> Column:
    # KELVIN SIGN is the one character above ASCII that lower() turns into an ASCII letter
    lowered = F.lower(F.replace(text, F.lit("K"), F.lit("Å")))
    return F.filter(F.split(lowered, WORD_GAP), lambda w: w != "")


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, place, template, at, pairs, label, base): every vote, and at place -1 one row for each document."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(text_of(text_col)).alias("words")).withColumn("n_words", F.size("words").cast("bigint"))
    last = F.greatest(F.col("n_words") - 1, F.lit(0)).cast("int")
    hashes = F.zip_with(F.slice("words", F.lit(1), last), F.slice("words", F.lit(2), last), lambda a, b: F.xxhash64(a, b))
    exploded = split.select("row", "id", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), hashes)).alias("place", "hash"))
    joined = exploded.withColumn("place", F.col("place") - 1).join(F.broadcast(template_table(docs.sparkSession)), "hash", "left").drop("hash")
    return joined.filter("template is not null or place = -1")


def spans(found: DataFrame) -> DataFrame:
    """(row, id, n_words, template, label, base, verified, first, last, cover): merged diagonals, and the rows without a template as they are.

    One pass in one partitioning: what is no candidate carries verified = false.
    """
    keys = ["row", "id", "n_words", "template", "label", "base", "pairs"]
    placed = found.repartition("row").withColumn("diagonal", F.col("place") - F.col("at"))
    diagonals = placed.groupBy(*keys, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))
    diagonals = diagonals.filter(F.col("template").isNull() | F.col("base") | (F.col("votes") >= F.least(F.lit(LEAST_VOTES), F.col("pairs"))))
    order = Window.partitionBy("row", "template").orderBy("lo", "diagonal")
    apart = F.col("base") | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > APART) | (F.col("lo") > F.lag("hi").over(order) + 1 + APART)
    numbered = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(order))
    merged = numbered.groupBy(*keys, "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"))
    cover = F.least(F.col("votes") / F.col("pairs"), F.lit(1.0))
    as_long = F.abs((F.col("hi") - F.col("lo")) - (F.col("to_at") - F.col("from_at"))) <= 2 * APART
    verified = F.when(F.col("base"), F.col("votes") == F.col("pairs")).otherwise((cover >= LEAST_COVER) & as_long)
    return merged.select("row", "id", "n_words", "template", "label", "base", F.coalesce(verified, F.lit(False)).alias("verified"), F.col("lo").cast("bigint").alias("first"), (F.col("hi") + 1).cast("bigint").alias("last"), cover.alias("cover"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans) of each row."""
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    base = F.col("verified") & F.col("base")
    return (
        spans(votes(docs, id_col, text_col))
        .groupBy("row", F.col("id").alias(id_col), "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("verified"), F.col("cover"))), F.lit(0.0)).alias("score"),
            F.count(F.when(F.col("verified"), 1)).alias("n_spans"),
        )
        .drop("row")
    )
