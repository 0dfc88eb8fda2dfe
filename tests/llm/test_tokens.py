"""Tokenizers: parity with whole-text encoding, exact round trips of the files."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from twinpath.llm import queries, token_planes, word_cache
from twinpath.llm.sentencepiece_codec import Codec, Model, encode

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a b c", "▁x y", "<s> </s> <unk> x", "日本語 テスト 🎉", "\t\tx  y\n\n z", "it's we'll", "x" * 300, "a" * 70 + " b", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b c", "<|endoftext| > <|endoftext|"]


def texts():
    rng = random.Random(5)
    parts = ["ab", "le", "thon", " ", " ", "  ", "\n", "1", "'s", "é", "!!", ".", ",", "\x1c", "\x85", " ", "ß", "日", "###", "🎉"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_byte_bpe_equals_whole_texts():
    path = queries.tokenizer_path(queries.BYTE_BPE)
    plain = tokenizers.Tokenizer.from_file(path)
    found = token_planes.encoder(path).batch(pa.array(texts()))
    assert [x.tolist() for x in found] == [e.ids for e in plain.encode_batch(texts(), add_special_tokens=False)]


def test_sentencepiece_parity_and_decoding():
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = Codec(path, 1, True)
    ids = codec.encode(pa.array(texts()))
    assert [x.tolist() for x in ids] == processor.encode(texts()) and codec.differing == 0
    assert codec.decode(ids) == processor.decode([x.tolist() for x in ids])


def test_model_file():
    model = Model(queries.tokenizer_path(queries.PIECE_MODEL))
    assert len(model.pieces) == 32_000 and model.byte_fallback and [p[0] for p in model.pieces[:3]] == ["<unk>", "<s>", "</s>"]


def test_words_are_forgotten_in_generations():
    calls = []
    memory = word_cache.Remembered(lambda words: calls.append(len(words)) or [w.encode() for w in words], most=8)
    for _ in range(3):
        assert memory(["a", "b", "c" * 100]) == [b"a", b"b", b"c" * 100]
    assert calls == [3, 1, 1]
    for i in range(20):
        memory([str(i)])
    assert len(memory.known) + len(memory.older) <= 12


@pytest.mark.parametrize("bits", [8, 1])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert np.array_equal(token_planes.unpacked(token_planes.packed(ids, bits)), ids)


def test_crc_of_joined_strings():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 3000))
        assert token_planes.crc_combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize(("block", "bits"), [(5, 8), (64, 1), (1 << 16, 8)])
def test_files_give_the_ids_back(spark, tmp_path, block, bits):
    rows = [(5, "e f g"), (3, None), (1, "word " * 40 + "end"), (2, ""), (4, "x y"), (4, "x y"), (None, "first of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", pa_lit())
    path = queries.tokenizer_path(queries.BYTE_BPE)
    token_planes.write(docs, str(tmp_path / "t"), path, 2, block_ids=block, bits=bits, shards=3)
    found = sorted(tuple(r) for r in token_planes.read_documents(spark, str(tmp_path / "t")).select("start", "n_tokens", "ids_crc32").collect())
    plain, start, expected = tokenizers.Tokenizer.from_file(path), 0, []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected


def pa_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_planes.write(docs, str(tmp_path / "t"), queries.tokenizer_path(queries.BYTE_BPE), 2)
    assert token_planes.read_documents(spark, str(tmp_path / "t")).count() == 0


def test_query_against_brute_force(spark, tables):
    plain, start = tokenizers.Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE)), 0
    rows = {r["doc_id"]: r for r in queries.op9_token_planes(spark, tables).collect()}
    for d in spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = rows.pop(d["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_query_on_texts_with_strings_of_added_tokens(spark, tmp_path):
    rows = [(7, "hello <|endoftext|> world"), (2, None), (3, "<|endoftext|>"), (11, "plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain, start = tokenizers.Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE)), 0
    found = {r["doc_id"]: r for r in queries.op9_token_planes(spark, str(tmp_path)).collect()}
    for doc_id, text in sorted(rows):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sentencepiece_rows(spark, tables):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9)], "doc_id long, text string, n_tokens int")
    rows = encode(docs, queries.tokenizer_path(queries.PIECE_MODEL)).collect()
    assert sorted((r["doc_id"], r["n_tokens"] > 0, r["parity"], r["decodes"]) for r in rows) == [(1, False, True, True), (2, False, True, True), (3, True, True, True), (3, True, True, True)]
    assert all(r["parity"] and r["decodes"] for r in queries.op5_sentencepiece(spark, tables).collect())


def test_a_differing_word_marks_its_own_texts_in_every_batch():
    codec = Codec(queries.tokenizer_path(queries.PIECE_MODEL), 1, True)
    real = codec.processor

    class Planted:
        def encode(self, texts, num_threads):
            return [[i + 1 for i in ids] if "planted" in t.split(" ") else ids for t, ids in zip(texts, real.encode(texts), strict=True)]

    codec.processor = Planted()
    batches = [["good planted", "good other", " planted"], ["planted again", "good again", "it"], ["good other"]]
    found = [codec.verified(pa.array(b)) for b in batches]
    assert [same for _, same in found] == [[False, True, False], [False, True, True], [True]]
    assert [[x.tolist() for x in ids] for ids, _ in found] == [real.encode(b) for b in batches]


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def message(*found: tuple[int, int | float | bytes]) -> bytes:
    """A protobuf message of integers, floats and byte strings."""
    parts = []
    for number, value in found:
        if isinstance(value, float):
            parts.append(varint(number << 3 | 5) + struct.pack("<f", value))
        elif isinstance(value, int):
            parts.append(varint(number << 3) + varint(value))
        else:
            parts.append(varint(number << 3 | 2) + varint(len(value)) + value)
    return b"".join(parts)


def unigram_model(path, byte_fallback: bool, remove_extra: bool) -> str:
    """A unigram model written by hand: letters, some words and, with byte fallback, all bytes."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", -12.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁th", "he", "in", "ing", "▁an", "er", "▁cat", "cat", "s", "▁sing", "sing", "▁▁", "日本"]
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz.,é" if c not in words]
    pieces += [(w, -3.0 - 0.37 * i, 1) for i, w in enumerate(words)] + [(c, -6.0 - 0.11 * i, 1) for i, c in enumerate(letters)]
    body = [(1, message((1, p.encode()), (2, score), (3, kind))) for p, score, kind in pieces]
    trainer = message((3, 1), (35, int(byte_fallback)))
    normalizer = message((1, b"identity"), (3, 1), (4, int(remove_extra)), (5, 1))
    path.write_bytes(message(*body, (2, trainer), (3, normalizer)))
    return str(path)


@pytest.mark.parametrize("remove_extra", [True, False])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models_are_rebuilt(spark, tmp_path, byte_fallback, remove_extra):
    path = unigram_model(tmp_path / "unigram.model", byte_fallback, remove_extra)
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    made = ["", "the cat sings", "the  cats", " the singer ", "thing.", "日本 é", "xyz Q", "🎉 cat"] + ["".join(rng.choice(["the", "cat", "s", "ing", " ", "  ", "é", "z", "日本", "Q", "."]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    codec = Codec(path, 1, True)
    ids, same = codec.verified(pa.array(made))
    assert [x.tolist() for x in ids] == processor.encode(made) and all(same) and codec.differing == 0
    rows = encode(spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string"), path).collect()
    assert all(r["parity"] for r in rows)
    if byte_fallback and not remove_extra:
        assert all(r["decodes"] for r in rows)
