"""The pipeline against brute force on a small corpus, and its stages on odd rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from twinpath.llm import decontaminate, near_copies, pii, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]


def test_run_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    first = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_stage(spark, docs, tables).collect()}
    prints = {i: simhash.fingerprint((t or "").encode(), corpus_pipeline.SHINGLE_WORDS) for i, t in first.items()}
    sets = {i: set(near_copies.shingle_set((t or "").encode(), corpus_pipeline.SHINGLE_WORDS).tolist()) for i, t in first.items()}
    alike = lambda i, j: len(sets[i] & sets[j]) >= corpus_pipeline.LEAST_JACCARD * len(sets[i] | sets[j]) > 0
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.MAX_BITS or alike(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {i for i in ids if find(i) == i}
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept -= {i for i in kept if any(x in decontaminate.normalised(first[i]) for x in items)}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert set(rows) == kept and all(r["parity"] and r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in rows.values())
    assert all(r["n_chars"] == len(pii.redacted(first[i], pii.spans(first[i]))) for i, r in rows.items())


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_their_columns_on_odd_rows(spark, tables, stage):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "Some quite normal words, and some more of them.", "en", "s", 47), (None, None, None, None, None), (7, "x" * 5000, "en", "s", 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = corpus_pipeline.STAGES[stage][1](spark, docs, tables)
    assert made.columns == COLUMNS and made.count() <= len(rows)
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), tables).count() == 0
