"""The corpus pipeline over `documents`: each stage is written as Parquet and reread by the next.

The stages, in order: drop what the quality classifier rejects, keep one
document of each group of near copies (SimHash, and shingle Jaccard from 0.8),
drop documents that hold benchmark items, redact personal data, and encode with
a SentencePiece model. All but the last return the columns of their input.

Defined cases: null texts count as empty ones and stay null; of rows that agree
in id and text, near-dedup keeps the one whose other columns are least as JSON;
rows with null ids stay there, for no group can name them; without n_chars, none
is made; a stage over an empty table returns an empty one; further columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinpath.llm import decontaminate, near_copies, pii, quality, sentencepiece_codec
from twinpath.llm.common import read
from twinpath.llm.queries import PIECE_MODEL, tokenizer_path
from twinpath.llm.token_planes import new_path

#: Shingles of five words. Fingerprints link at 62 of 64 equal bits; texts of a shingle Jaccard of 0.8 mostly differ
#: in more and are found by MinHash keys and verified.
SHINGLE_WORDS, MAX_BITS, LEAST_JACCARD = 5, 2, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that aren't held out, doesn't reject."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs.withColumn("_row", F.struct("*")), model).filter("predicted = 1").select("_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; of repeated rows, one."""
    found = near_copies.groups(docs, shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS, least=LEAST_JACCARD)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("_others"))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_others", others).withColumn("_first", first).filter("_first = 1").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, near matches included."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind; n_chars follows."""
    made = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return made
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids, with the check that these give the text back and agree with the model's own library."""
    return sentencepiece_codec.encode(docs, tokenizer_path(PIECE_MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The stages hold a fitted model, approximate matching and a tokenizer: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over `documents`; the result of each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
