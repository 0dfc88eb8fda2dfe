"""Choosing frames of a route to label: by stratum, apart from frames that were shown before and from each other."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .dynamic import farthest_first

#: Frames between a chosen one and a blocked one, another chosen one, and another of the same occlusion; how far from a kink a frame may be drawn; how much a blocked bin is widened.
APART_BLOCKED, APART, APART_OCCLUSION, KINK_RADIUS, WIDER = 10, 10, 5, 12, 30
#: The strata in the order in which they are filled; what one can't place goes to the last.
ORDER = ("occlusion", "dark", "kink", "corridor")


@dataclass
class Route:
    """What is known of one camera's route: [start, end), blocked frames, occlusions (first, last), dark stretches of run B (start, end), partners (a, b), kinks (frame, increment, dark)."""

    start: int
    end: int
    blocked: list[int] = field(default_factory=list)
    occlusions: list[tuple[int, int]] = field(default_factory=list)
    dark: list[tuple[int, int]] = field(default_factory=list)
    partners: list[tuple[int, int]] = field(default_factory=list)
    kinks: list[tuple[int, int, bool]] = field(default_factory=list)


class Picker:
    """Takes frames one after the other; each takes its surroundings from those after it."""

    def __init__(self, route: Route, rng: np.random.Generator | None) -> None:
        self.route, self.rng = route, rng
        self.frames = np.arange(route.start, max(route.end, route.start))
        self.open = np.ones(len(self.frames), dtype=bool)
        for b in route.blocked:
            self.open &= np.abs(self.frames - b) >= APART_BLOCKED
        #: (frame, stratum, low, high, source): low and high bound where it was looked for.
        self.chosen: list[tuple[int, str, int, int, int | None]] = []

    def pool(self, low: int, high: int, stratum: str) -> np.ndarray:
        """The frames from low to high that may be taken."""
        allowed = self.open & (self.frames >= low) & (self.frames <= high)
        for frame, other, *_ in self.chosen:
            allowed &= np.abs(self.frames - frame) >= (APART_OCCLUSION if stratum == other == "occlusion" else APART)
        return self.frames[allowed]

    def nearest(self, target: float, low: int, high: int, stratum: str, source: int | None = None) -> bool:
        """Takes the frame nearest to the target, the earlier of two; False where none is left."""
        pool = self.pool(low, high, stratum)
        if len(pool):
            self.chosen.append((int(pool[np.argmin(np.abs(pool - target))]), stratum, low, high, source))
        return bool(len(pool))

    def drawn(self, low: int, high: int, stratum: str, source: int | None = None) -> bool:
        """Takes a seeded draw; without a generator, the frame nearest to the middle."""
        if self.rng is None:
            return self.nearest((low + high) / 2, low, high, stratum, source)
        pool = self.pool(low, high, stratum)
        if len(pool):
            self.chosen.append((int(self.rng.choice(pool)), stratum, low, high, source))
        return bool(len(pool))

    def occlusion(self, count: int) -> int:
        """Spreads targets evenly over the free part of the first occlusion."""
        for first, last in self.route.occlusions[:1]:
            free = self.frames[self.open & (self.frames >= first) & (self.frames <= last)]
            if len(free):
                low, high = int(free[0]), int(free[-1])
                return sum(self.nearest(low + (high - low) * (slot + 0.5) / count, low, high, "occlusion", first) for slot in range(count))
        return 0

    def dark(self, count: int) -> int:
        """Deals the targets to the dark stretches that partners reach, the longest first, one each in turn."""
        reached = []
        for start, end in sorted(self.route.dark, key=lambda s: (s[0] - s[1], s[0])):
            frames = [a for a, b in self.route.partners if start <= b <= end]
            if frames:
                reached.append((start, min(frames), max(frames)))
        placed = 0
        for i, (start, low, high) in enumerate(reached):
            wanted = count // len(reached) + (i < count % len(reached))
            placed += sum(self.nearest(low + (high - low) * (slot + 0.5) / wanted, low, high, "dark", start) for slot in range(wanted))
        return placed

    def kink(self, count: int) -> int:
        """Draws frames about kinks, lit ones before dark ones, each far from those before it."""
        placed = 0
        order = [k for dark in (False, True) for k in farthest_first(np.array([f for f, _, d in self.route.kinks if d == dark], dtype=np.int64))]
        for k in order:
            if placed == count:
                break
            placed += self.drawn(k - KINK_RADIUS, k + KINK_RADIUS, "kink", k)
        return placed

    def corridor(self, count: int) -> int:
        """One frame in each of so many equal parts of the route, looked for in wider ones where they are full."""
        placed, length = 0, self.route.end - self.route.start
        for i in range(count):
            low, high = self.route.start + i * length // count, self.route.start + (i + 1) * length // count - 1
            target = low + (0.5 if self.rng is None else float(self.rng.uniform(0.2, 0.8))) * (high - low)
            placed += self.nearest(target, low, high, "corridor") or self.nearest(target, low - WIDER, high + WIDER, "corridor")
        return placed


def label_set(route: Route, wanted: dict[str, int], seed: int | None) -> tuple[list[tuple[int, str, int, int, int | None]], list[tuple[str, int, int]]]:
    """(chosen frames by frame, (stratum, planned, placed) of every stratum that fell short).

    What a stratum can't place moves to the corridor. Without a seed nothing is
    drawn: the middle is taken.
    """
    picker = Picker(route, None if seed is None else np.random.default_rng(seed))
    short, moved = [], 0
    for stratum in ORDER:
        planned = wanted.get(stratum, 0) + (moved if stratum == "corridor" else 0)
        placed = getattr(picker, stratum)(planned) if planned else 0
        if placed < planned:
            short.append((stratum, planned, placed))
            moved += planned - placed
    return sorted(picker.chosen), short
