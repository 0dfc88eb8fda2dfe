"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores or
merges, and byte fallback are rebuilt in the tokenizers library, for unigram and
for BPE models. Batches are encoded and decoded on the library's own threads.
Parity with the sentencepiece library is verified for each text, by its words
where they are independent, or not at all.

Defined cases: a null text is the empty text, which has no ids; repeated rows
are encoded as often as they come; null ids pass through; an empty table gives
an empty result; further columns are kept by `encode`.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded
from .word_cache import TEXTS, TOGETHER, Parted, Remembered, WordEncoder, byte_slices, packed, released

MARK = "▁"
#: Kinds of pieces, kinds of models and field numbers of the public protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, WHITESPACE_AS_SUFFIX, BYTE_FALLBACK = 3, 24, 35
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5

#: No model's id: behind the ids of a word or text for which the two libraries differ.
DIFFERS = 0xFFFFFFFF


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; values stay undecoded."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"wire type {kind} in a model")
                size = varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == PIECES:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normalizer = dict(fields(value))
        self.kind = trainer.get(MODEL_TYPE, UNIGRAM)
        self.byte_fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.charsmap = normalizer.get(CHARSMAP, b"")
        self.dummy_prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.remove_extra = bool(normalizer.get(REMOVE_EXTRA, 1))
        if trainer.get(WHITESPACE_AS_SUFFIX, 0) or not normalizer.get(ESCAPE, 1) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("this kind of model isn't rebuilt here")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first; of one piece, by the scores of its parts' ids."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((-self.pieces[i][1], i, left, right))
        return [(self.pieces[a][0], self.pieces[b][0]) for _, _, a, b in sorted(found)]

    def words_independent(self) -> bool:
        """No piece has a mark behind another character, and the normaliser leaves white space as it is."""
        plain = self.kind == BPE and self.byte_fallback and self.dummy_prefix and not self.charsmap and not self.remove_extra
        return plain and not any(kind == USER_DEFINED or re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces)


def rebuilt(model: Model):
    """The model as a Tokenizer of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED])
    return tokenizer


class Codec:
    """Encodes and decodes batches as the model's own library does.

    With `verify`, whatever goes to the tokenizers library, whole texts or new
    words, goes to the sentencepiece library too, and the ids are compared. The
    verdict stays with the word: ids that differ end in `DIFFERS`, and a text is
    verified if none of its words does, whenever they were learned. `differing`
    counts the texts and words found to differ.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        model = Model(path)
        self.tokenizer, self.threads, self.differing, self.processor = rebuilt(model), threads, 0, None
        if verify:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        learn = None
        if model.words_independent():
            self.parted = Parted(self.ours, [1 if kind == BYTE else len(p.encode()) for p, _, kind in model.pieces], len(MARK.encode()), "")
            learn = Remembered(self.learned)
        # a mark in the text itself, and a space at an end or beside another, may go with either side; the empty text gets no mark
        self.words = WordEncoder(self.whole, learn, f"{MARK}|^ | ( |$)|^$")

    def ours(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def theirs(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=self.threads)

    def whole(self, texts: list[str]) -> list[list[int]]:
        ids = self.ours(texts)
        if self.processor:
            for mine, other in zip(ids, self.theirs(texts), strict=True):
                if mine != other:
                    mine.append(DIFFERS)
                    self.differing += 1
        return ids

    def learned(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, with its verdict."""
        size = TOGETHER * TEXTS
        return [ids for i in range(0, len(words), size) for ids in self.verdicts(words[i : i + size])]

    def verdicts(self, words: list[str]) -> list[bytes]:
        found = self.parted(words)
        if not self.processor:
            return found
        lots = range(0, len(words), TOGETHER)
        for i, other in zip(lots, self.theirs([" ".join(words[i : i + TOGETHER]) for i in lots]), strict=True):
            lot = range(i, min(i + TOGETHER, len(words)))
            if b"".join(found[i : i + TOGETHER]) == packed(other):
                continue
            alone = self.theirs([words[k] for k in lot])
            # if no word differs by itself, any of them may
            for k in [k for k, ids in zip(lot, alone, strict=True) if found[k] != packed(ids)] or lot:
                found[k] += packed([DIFFERS])
                self.differing += 1
        return found

    def forget(self) -> None:
        """Lets go of the words learned; the model stays."""
        if isinstance(self.words.learn, Remembered):
            self.words.learn.forget()
        released()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls."""
        return self.verified(texts)[0]

    def verified(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether none of its words differs."""
        ids = self.words.batch(texts)
        same = [not (x == DIFFERS).any() for x in ids]
        return [x if yes else x[x != DIFFERS] for x, yes in zip(ids, same, strict=True)], same

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [text for i in range(0, len(ids), 64) for text in self.tokenizer.decode_batch([x.tolist() for x in ids[i : i + 64]], skip_special_tokens=False)]


@functools.cache  # a worker keeps it from task to task
def codec(path: str, threads: int, verify: bool) -> Codec:
    return Codec(path, threads, verify)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", verify: bool = True, threads: int = 2, keep_ids: bool = True) -> DataFrame:
    """docs without the text, and n_tokens, ids_crc32, decodes (the ids give the text back), parity and ids.

    parity: the sentencepiece library gave the same ids for every word of the
    text, or for the whole text where it was encoded whole; null if it wasn't to
    be asked.
    """
    at = docs.columns.index(text_col)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decodes", T.BooleanType()), T.StructField("parity", T.BooleanType())]
    if keep_ids:
        made.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    kept = [f for i, f in enumerate(docs.schema.fields) if i != at and f.name not in {m.name for m in made}]
    schema = T.StructType([*kept, *made])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path, threads, verify)
        for batch in (part for whole in batches for part in byte_slices(whole, at)):
            texts = batch.column(at).fill_null("")
            ids, same = coder.verified(texts)
            decoded = pa.array(coder.decode(ids), pa.string())
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pc.equal(texts, decoded), pa.array(same if verify else [None] * len(ids), pa.bool_())]
            if keep_ids:
                columns.append(pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        coder.forget()  # the worker's next task may be another operator's

    return bounded(docs).mapInArrow(kernel, schema)
