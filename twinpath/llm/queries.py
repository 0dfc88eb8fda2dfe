"""The contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, license_scan, merkle, oracles, pii, quality, sentencepiece_codec, simhash, token_planes
from .common import read

#: Names of the public tokenizer files that the queries take; the folder is a parameter.
BYTE_BPE, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`: counts, a digest of the base spans, and all spans."""
    found = pii.find(read(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = of(*pii.BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of `benchmark`, with the edits between them."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "title", "text", F.length("text").cast("bigint").alias("n_chars"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), "n_tables")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    mark = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)], "conv_id bigint, turn bigint, role string, text string")
    made = chat.formatted(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    back = made.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of `documents`, of an edited text each, and their likenesses."""
    rows = merkle.with_next(read(spark, sf_dir, "documents")).withColumn("edited", merkle.edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")
    for prefix, column in (("", "text"), ("edited_", "edited"), ("next_", "next_text")):
        rows = merkle.fingerprints(rows, column, prefix).drop(column)
    near = lambda other: merkle.likeness(F.col("leaves"), F.col("fingerprint"), F.col(f"{other}_leaves"), F.col(f"{other}_fingerprint"))
    rows = rows.withColumn("changed", merkle.differences(F.col("sections"), F.col("edited_sections")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
        F.size("changed.removed").cast("bigint").alias("n_removed_paragraphs"),
        F.size("changed.added").cast("bigint").alias("n_added_paragraphs"),
        F.get("changed.added", F.lit(0))["section"].cast("bigint").alias("first_added_section"),
        F.get("changed.added", F.lit(0))["paragraph"].cast("bigint").alias("first_added_paragraph"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of `documents` under a SentencePiece model, decoded again, parity verified for each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, tokenizer_path(PIECE_MODEL), keep_ids=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text of `documents`, by rules learned from the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` as ids in plane files, read back from them."""
    path = token_planes.new_path(spark, "tokens")
    token_planes.write(read(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE), END_ID)
    found = token_planes.read_documents(spark, path)
    return found.withColumnRenamed("id", "doc_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every text of `documents`."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of `documents`: 3-word shingles, at most 2 differing bits."""
    found = simhash.groups(read(spark, sf_dir, "documents"), shingle_words=3, max_bits=2, segments=7)
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_decontaminate": op2_decontaminate,
        "op3_html": op3_html,
        "op4_chat": op4_chat,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_merkle": op6_merkle,
        "op7_simhash": op7_simhash,
        "op8_quality": op8_quality,
        "op9_token_planes": op9_token_planes,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    """The same rows in DuckDB SQL. The others hold hashes, checksums, models or searches that SQL lacks; tests hold them against brute force."""
    return {"op4_chat": oracles.OP4_CHAT, "op6_merkle": oracles.OP6_MERKLE, "op10_licenses": oracles.OP10_LICENSES}
