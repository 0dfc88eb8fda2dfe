"""Encoding with the tokenizers library, word by distinct word.

Where it is certain that a tokenizer never joins what stands before a single
space and what follows it, the ids of a text are those of its words, each with
the space before it, one after the other. A batch of texts is cut into words and
reduced to distinct ones by Arrow, only those not known yet go to the library,
and the ids are put together by index. A worker remembers what it has learned;
texts in which words are not certain to be independent go to the library whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words, and parts of words, that a worker remembers, and the longest that it does.
MOST_WORDS, MOST_PARTS, LONGEST = 200_000, 800_000, 64
#: Bytes of text, and texts, that are encoded at a time.
BATCH_BYTES, BATCH_ROWS = 3 << 20, 4096

Whole = Callable[[list[str]], list[list[int]]]
Learn = Callable[[list[str]], list[bytes]]
#: White space of any kind, in the syntax of RE2.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def byte_slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes in a text column; a text larger than that is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start >= BATCH_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def released() -> None:
    """Gives memory that is free back to the system: a worker lives on while others' tasks need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


class WordEncoder:
    """Ids of texts.

    whole: ids of each text, from the library. learn: packed ids of each word
    with its space, or None if the words of this tokenizer are never
    independent. dependent: finds texts that must go whole, in RE2's syntax.
    first: packed ids of words without a space before them; None if the first
    word of a text has one too.
    """

    def __init__(self, whole: Whole, learn: Learn | None, dependent: str, first: Learn | None = None) -> None:
        self.whole, self.learn, self.dependent, self.first = whole, learn, dependent, first

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls, as unsigned 32-bit integers."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        alone = np.ones(len(texts), bool) if self.learn is None else pc.match_substring_regex(texts, self.dependent).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(alone)
        if len(places):
            for i, ids in zip(places, self.whole(texts.take(pa.array(places)).to_pylist()), strict=True):
                out[i] = np.asarray(ids, "<u4")
        rest = np.flatnonzero(~alone)
        if not len(rest):
            return out
        lists = pc.split_pattern(texts.take(pa.array(rest)) if len(places) else texts, " ")
        edges = lists.offsets.to_numpy()
        words = lists.flatten()
        coded = words.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        table = self.learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if self.first:
            number[edges[:-1]] = len(table) + np.arange(len(rest))
            table = table + self.first(words.take(pa.array(edges[:-1])).to_pylist())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        known = np.frombuffer(b"".join(table), "<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.cumsum(each)
        ids = known[np.repeat((starts[number] - (ends - each)).astype(np.int32), each) + np.arange(ends[-1], dtype=np.int32)]
        stops = ends[edges[1:] - 1]
        for i, a, b in zip(rest.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[i] = ids[a:b]
        return out


#: Words that make a text to learn from, for long texts take BPE longer; and texts that the library encodes at a time, for what it gives is large.
TOGETHER, TEXTS = 256, 32


class Parted:
    """Learns words by encoding some as one text, whose ids are parted by the bytes that each stands for."""

    def __init__(self, whole: Whole, lengths: list[int], space: int, lead: str) -> None:
        self.whole, self.lengths, self.space, self.lead = whole, np.array(lengths, dtype=np.int64), space, lead

    def __call__(self, words: list[str]) -> list[bytes]:
        size = TOGETHER * TEXTS
        return [ids for i in range(0, len(words), size) for ids in self.part(words[i : i + size])]

    def part(self, words: list[str]) -> list[bytes]:
        texts = [self.lead + " ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.frombuffer(b"".join(map(packed, self.whole(texts))), dtype="<u4")
        ends = np.cumsum(self.lengths[ids])
        word_ends = np.cumsum([self.space + len(w.encode()) for w in words])
        cuts = np.searchsorted(ends, word_ends) + 1
        if len(ids) != cuts[-1] or not np.array_equal(ends[cuts - 1], word_ends):
            raise ValueError("a token joins two words")
        data, edges = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class Remembered:
    """Learns words once, and again when they have not come for long: two generations, of which the older goes."""

    def __init__(self, learn: Learn, most: int = MOST_WORDS) -> None:
        self.learn, self.most, self.known, self.older = learn, most // 2, {}, {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if missing:
            ids = list(map(self.older.get, missing))
            unknown = [w for w, x in zip(missing, ids, strict=True) if x is None]
            if unknown:
                new = iter(self.learn(unknown))
                ids = [next(new) if x is None else x for x in ids]
            self.known.update(zip(missing, ids, strict=True))
            if max(map(len, missing)) > LONGEST:
                for w in missing:
                    if len(w) > LONGEST:
                        del self.known[w]
            others = iter(ids)
            found = [next(others) if x is None else x for x in found]
        return found


#: Fixed value: the pattern that byte-level BPE cuts texts with.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class all versions of Unicode agree on.
SETTLED = re.compile("[\n -~¡-ɏ]*")
#: Marks that may follow a word and then make a part of their own.
MARKS = ".,!?;:#$%&*|)"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: visible ones as themselves, the others as the letters from 256 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteParts:
    """Learns words of byte-level BPE part by part: parts repeat more often than words with their punctuation.

    A word of letters and marks behind them is cut without the pattern, which
    would give the same two parts.
    """

    def __init__(self, tokenizer, other: Learn) -> None:
        self.tokenize, self.other, self.letters = tokenizer.model.tokenize, other, byte_letters()
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = packed([t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))])
            if len(part) <= LONGEST:
                self.parts[part] = found
        return found

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > MOST_PARTS:
            self.parts.clear()
        get, part, settled = self.parts.get, self.part, SETTLED.fullmatch
        made, odd = [], []
        for w in words:
            stem = w.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or settled(stem)):
                word = f" {stem}"
                ids = get(word) or part(word)
                made.append(ids + part(w[len(stem) :]) if len(stem) < len(w) else ids)
            elif settled(w):
                made.append(b"".join([part(p) for p in PARTS.findall(f" {w}")]))
            else:
                odd.append(w)
                made.append(None)
        if odd:
            others = iter(self.other(odd))
            made = [next(others) if ids is None else ids for ids in made]
        return made
