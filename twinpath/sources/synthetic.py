"""Elementary streams for queries: headers by the standard, pictures without content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: a group of pictures, an intra picture and then fours in the order of their references.
GROUP = 32


class Writer:
    """Bits of a payload, the first of a byte first."""

    def __init__(self) -> None:
        self.bits: list[str] = []

    def u(self, value: int, count: int) -> Writer:
        if count:
            self.bits.append(format(value, f"0{count}b"))
        return self

    def ue(self, *values: int) -> Writer:
        for value in values:
            code = format(value + 1, "b")
            self.bits.append("0" * (len(code) - 1) + code)
        return self

    def unit(self, kind: int) -> bytes:
        """The unit behind a start code of four bytes, escaped where it would look like one."""
        text = "".join(self.bits) + "1"
        text += "0" * (-len(text) % 8)
        raw = int(text, 2).to_bytes(len(text) // 8, "big")
        return b"\0\0\0\1" + bytes([kind << 1, 1]) + re.sub(rb"\0\0(?=[\0-\3])", b"\0\0\3", raw)


def sequence_unit(width: int, height: int, crop_bottom: int) -> bytes:
    head = Writer().u(0, 4).u(0, 3).u(1, 1).u(0, 96)
    return head.ue(0, 1, width, height).u(1, 1).ue(0, 0, 0, crop_bottom).ue(0, 0, 4).unit(33)


def picture_unit() -> bytes:
    return Writer().ue(0, 0).u(0, 1).u(0, 1).u(0, 3).unit(34)


def message_unit(kind: int) -> bytes:
    head = Writer()
    while kind >= 255:
        head.u(255, 8)
        kind -= 255
    return head.u(kind, 8).u(1, 8).u(0x80, 8).unit(39)


def slice_of(index: int) -> tuple[int, int, int]:
    """(unit type, slice type, order count) of a picture by its place in decoding order."""
    place = index % GROUP
    if place == 0:
        return 19, 2, 0
    step = (place - 1) % 4
    return 1, 1 if step == 0 else 0, (place - 1) // 4 * 4 + (4, 2, 1, 3)[step]


def slice_unit(index: int) -> bytes:
    kind, slice_type, order = slice_of(index)
    head = Writer().u(1, 1)
    if kind == 19:
        head.u(0, 1)
    head.ue(0, slice_type)
    if kind != 19:
        head.u(order, 8)
    for _ in range(3 + index % 5):
        head.u(0x55, 8)
    return head.unit(kind)


def stream(pictures: int) -> bytes:
    """A stream of 1440 by 1080; each group begins with its message."""
    parts = [sequence_unit(1440, 1088, 4), picture_unit()]
    for i in range(pictures):
        if i % GROUP == 0:
            parts.append(message_unit((1, 5, 300)[i // GROUP % 3]))
        parts.append(slice_unit(i))
    return b"".join(parts)


def streams(counts: DataFrame, name: str, pictures: str) -> DataFrame:
    """(name, content) of a stream for each row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [stream(n) for n in batch["pictures"]]})

    return counts.selectExpr(f"{name} AS name", f"{pictures} AS pictures").mapInPandas(each, "name string, content binary")
