"""HEVC elementary streams and raw frames as tables.

Files are read by ranges of bounded size, many tasks to a file. Each range gives
the units that begin in it, with the first bytes of their payloads; what depends
on the units before, such as order counts, is computed for each stream from these
heads alone. Pictures are not decoded. After the public H.265 standard.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

START = re.compile(rb"\x00\x00\x01")
#: Types of network units.
SPS, PPS, PREFIX_SEI, SUFFIX_SEI, IDR, IRAP = 33, 34, 39, 40, (19, 20), range(16, 24)
SLICES = {0: "B", 1: "P", 2: "I"}
SEI_NAMES = {0: "buffering_period", 1: "pic_timing", 4: "user_data_registered", 5: "user_data_unregistered", 136: "time_code"}
#: Bytes of a file that a task reads; bytes of a slice's head, whose fields that are read have at most 154 bits; and zeros looked for before a start code at a time.
RANGE, SLICE_HEAD, LOOK = 64 << 20, 64, 1 << 12


class Bits:
    """Reads bits of a payload, the first of a byte first."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, count: int) -> int:
        if count > self.left:
            raise ValueError("read past the end")
        self.left -= count
        return self.value >> self.left & ((1 << count) - 1)

    def ue(self) -> int:
        """An unsigned Exp-Golomb code."""
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("no Exp-Golomb code")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        """A signed Exp-Golomb code: 0, 1, -1, 2, -2 and so on."""
        code = self.ue()
        return (code + 1) // 2 if code % 2 else -(code // 2)


def unescaped(payload: bytes) -> bytes:
    """Without the bytes that keep a payload from looking like a start code."""
    return re.sub(rb"\x00\x00\x03", b"\x00\x00", payload)


def units(uri: str, start: int, stop: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(place of the start code, zeros just before it, head of the payload) of each unit that begins in a range of a file.

    The head of a slice is short, that of any other unit whole.
    """
    before = max(0, start - LOOK)
    data = files.read(uri, before, min(length, stop + 2 + LOOK))
    for m in START.finditer(data):
        at = m.start() + before
        if not start <= at < stop:
            continue
        zeros = m.start() - len(data[: m.start()].rstrip(b"\0"))
        lowest = before
        while zeros == at - lowest and lowest > 0:  # all that is at hand is zeros
            lowest = max(0, lowest - LOOK)
            zeros = at - lowest - len(files.read(uri, lowest, at).rstrip(b"\0"))
        begin, most = m.start() + 3, SLICE_HEAD
        while True:
            head = data[begin : begin + most + 3]
            following = START.search(head)
            head = head[: following.start()].rstrip(b"\0") if following else head[:most]
            if following or begin + most >= len(data) and before + len(data) >= length:
                break
            if head and head[0] >> 1 & 63 < 32:
                break
            most *= 2
            if begin + most + 3 > len(data):
                data += files.read(uri, before + len(data), min(length, before + begin + most + 3))
        yield at, zeros, head


def sei_name(head: bytes) -> str:
    """The name of the first message of a supplemental unit."""
    payload = unescaped(head[2:])
    full = len(payload) - len(payload.lstrip(b"\xff"))
    if full >= len(payload):
        return "unknown"
    kind = 255 * full + payload[full]
    return SEI_NAMES.get(kind, f"type_{kind}")


def sequence_set(payload: bytes) -> dict[str, int]:
    """Raster, cropping, depths and the size of order counts."""
    bits = Bits(payload)
    bits.u(4)
    layers = bits.u(3)
    bits.u(1)
    bits.u(96)  # profile, tier and level of the whole
    present = [(bits.u(1), bits.u(1)) for _ in range(layers)]
    if layers:
        bits.u(2 * (8 - layers))
    for profile, level in present:
        bits.u(88 * profile + 8 * level)
    bits.ue()
    chroma = bits.ue()
    separate = bits.u(1) if chroma == 3 else 0
    width, height = bits.ue(), bits.ue()
    left, right, top, bottom = (bits.ue() for _ in range(4)) if bits.u(1) else (0, 0, 0, 0)
    luma, colour, order = bits.ue() + 8, bits.ue() + 8, bits.ue() + 4
    across, down = {1: (2, 2), 2: (2, 1)}.get(chroma, (1, 1))
    return {"width": width, "height": height, "display_width": width - across * (left + right), "display_height": height - down * (top + bottom), "chroma": chroma, "separate": separate, "luma_depth": luma, "chroma_depth": colour, "order_bits": order}


def picture_set(payload: bytes) -> dict[str, int]:
    """What a slice header's layout depends on."""
    bits = Bits(payload)
    bits.ue()
    bits.ue()
    bits.u(1)
    return {"output_flag": bits.u(1), "extra": bits.u(3)}


def order_count(lsb: int, previous: int, size: int) -> int:
    """The whole order count: its low bits, and the high ones that bring it nearest to the previous."""
    high, low = previous // size * size, previous % size
    if lsb < low and low - lsb >= size // 2:
        high += size
    elif lsb > low and lsb - low > size // 2:
        high -= size
    return high + lsb


PICTURES = "path string, decode_index long, byte_offset long, byte_size long, nal_type int, slice_type string, poc long, is_idr boolean, width int, height int"


def scanned(path: str, found: Iterable[tuple[int, int, bytes]]) -> Iterator[tuple]:
    """One row for each picture of a stream, from its units (place, size, head) in order."""
    sps: dict[str, int] = {}
    pps: dict[str, int] = {"output_flag": 0, "extra": 0}
    index = previous = 0
    current: list | None = None
    for start, size, head in found:
        kind = head[0] >> 1 & 63
        payload = unescaped(head[2:])
        if kind == SPS:
            sps = sequence_set(payload)
        elif kind == PPS:
            pps = picture_set(payload)
        elif kind < 32 and sps:
            bits = Bits(payload)
            if bits.u(1):
                if current:
                    yield tuple(current)
                if kind in IRAP:
                    bits.u(1)
                bits.ue()
                bits.u(pps["extra"])
                slice_type = SLICES[bits.ue()]
                bits.u(pps["output_flag"] + 2 * sps["separate"])
                previous = 0 if kind in IDR else order_count(bits.u(sps["order_bits"]), previous, 1 << sps["order_bits"])
                current = [path, index, start, 0, kind, slice_type, previous, kind in IDR, sps["display_width"], sps["display_height"]]
                index += 1
            if current:
                current[3] += size
    if current:
        yield tuple(current)


def unit_rows(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, byte_offset, byte_size, head) of each unit of each stream; the zeros before a start code belong to no unit."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame([(row.path, row.length, *u) for u in units(row.path, row.start, row.stop, row.length)], columns=["path", "length", "byte_offset", "zeros", "head"])

    found = files.ranges(files.listed(spark, path), size).mapInPandas(parse, "path string, length long, byte_offset long, zeros long, head binary")
    # a start code may have a third zero: the unit before ends where the zeros begin, the last one with its file
    following = Window.partitionBy("path").orderBy("byte_offset")
    end = F.coalesce(F.lead(F.col("byte_offset") - F.col("zeros")).over(following), F.col("length"))
    return found.filter(F.length("head") > 1).select("path", "byte_offset", (end - F.col("byte_offset")).alias("byte_size"), "head")


def pictures(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, decode_index, byte_offset, byte_size, nal_type, slice_type, poc, is_idr, width, height) of each picture of each stream."""
    columns = [c.split()[0] for c in PICTURES.split(", ")]

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("byte_offset")
        return pd.DataFrame(list(scanned(pdf["path"].iloc[0], zip(ordered["byte_offset"], ordered["byte_size"], map(bytes, ordered["head"]), strict=True))), columns=columns)

    return unit_rows(spark, path, size).groupBy("path").applyInPandas(parse, PICTURES)


def unit_counts(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, nal_type, message, units, bytes) of each stream; message names the first one of supplemental units."""
    name = F.pandas_udf(lambda heads: heads.map(lambda head: sei_name(bytes(head))), "string")
    rows = unit_rows(spark, path, size).withColumn("nal_type", F.shiftright(F.conv(F.hex(F.substring("head", 1, 1)), 16, 10).cast("int"), 1).bitwiseAND(F.lit(63)))
    named = rows.withColumn("message", F.when(F.col("nal_type").isin(PREFIX_SEI, SUFFIX_SEI), name("head")))
    return named.groupBy("path", "nal_type", "message").agg(F.count(F.lit(1)).alias("units"), F.sum("byte_size").alias("bytes"))


def grey_frames(spark: SparkSession, path: str, width: int, height: int, stop_after: int | None = None, capacity: int | None = None, at_a_time: int = 16) -> DataFrame:
    """(path, ordinal, grey: array of the luma of each pixel) of files of raw RGB frames; a file of more than `capacity` frames is refused."""
    from ..functions.images import LUMA

    size = 3 * width * height

    def grey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if row.length % size:
                    raise ValueError(f"{row.path} ends within a frame")
                if capacity is not None and row.length > capacity * size:
                    raise ValueError(f"{row.path} holds more than {capacity} frames")
                data = np.frombuffer(files.read(row.path, row.start, row.stop), np.uint8).reshape(-1, height * width, 3)
                yield pd.DataFrame({"path": row.path, "ordinal": row.start // size + np.arange(len(data)), "grey": list(data.astype(float) @ np.asarray(LUMA))})

    return _frame_ranges(spark, path, size, stop_after, at_a_time).mapInPandas(grey, "path string, ordinal long, grey array<double>")


def _frame_ranges(spark: SparkSession, path: str, size: int, stop_after: int | None, at_a_time: int) -> DataFrame:
    cut = files.ranges(files.listed(spark, path), at_a_time * size)
    if stop_after is None:
        return cut
    return cut.filter(F.col("start") < stop_after * size).withColumn("stop", F.least("stop", F.lit(stop_after * size)))


def raw_frames(spark: SparkSession, path: str, width: int, height: int, stop_after: int | None = None, at_a_time: int = 16) -> DataFrame:
    """(path, ordinal, mean_luma, p99_luma) of files of raw RGB frames, a few frames at a time; a file must hold whole frames."""
    from ..functions.images import luma

    size = 3 * width * height

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if row.length % size:
                    raise ValueError(f"{row.path} ends within a frame")
                data = np.frombuffer(files.read(row.path, row.start, row.stop), np.uint8).reshape(-1, height, width, 3)
                rows = [(row.path, row.start // size + i, *luma(image)) for i, image in enumerate(data)]
                yield pd.DataFrame(rows, columns=["path", "ordinal", "mean_luma", "p99_luma"])

    return _frame_ranges(spark, path, size, stop_after, at_a_time).mapInPandas(measure, "path string, ordinal long, mean_luma double, p99_luma double")
