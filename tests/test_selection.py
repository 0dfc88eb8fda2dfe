"""Label sets: distances, strata and what falls short."""

from __future__ import annotations

import numpy as np
import pytest

from twinpath.functions import selection
from twinpath.functions.selection import Picker, Route, label_set


def route(**more):
    return Route(20, 420, blocked=[100, 203], occlusions=[(300, 340)], dark=[(50, 60), (150, 190)], partners=[(a, a + 3) for a in range(20, 420, 2)], kinks=[(f, 7, f % 2 == 0) for f in (80, 81, 222, 225, 377)], **more)


@pytest.mark.parametrize("seed", [None, *range(20)])
def test_frames_keep_their_distances(seed):
    chosen, short = label_set(route(), {"occlusion": 3, "dark": 4, "kink": 4, "corridor": 6}, seed)
    frames = [c[0] for c in chosen]
    assert frames == sorted(frames) and all(20 <= f < 420 for f in frames)
    assert all(abs(f - b) >= 10 for f in frames for b in (100, 203))
    for i, (f, stratum, *_) in enumerate(chosen):
        for g, other, *_ in chosen[:i]:
            assert abs(f - g) >= (5 if stratum == other == "occlusion" else 10)
    assert len(chosen) + sum(planned - placed for stratum, planned, placed in short if stratum == "corridor") == 17
    again = label_set(route(), {"occlusion": 3, "dark": 4, "kink": 4, "corridor": 6}, seed)
    assert again == (chosen, short)


def test_a_stratum_that_falls_short_moves_to_the_corridor():
    chosen, short = label_set(Route(0, 200, kinks=[(50, 6, False)]), {"kink": 4, "corridor": 2}, 1)
    assert ("kink", 4, 1) in short
    assert sum(c[1] == "corridor" for c in chosen) == 5


def test_lit_kinks_come_before_dark_ones():
    picker = Picker(route(), None)
    assert picker.kink(2) == 2
    assert {c[4] % 2 for c in picker.chosen} == {1}


def test_nearest_takes_the_earlier_of_two():
    picker = Picker(Route(0, 100), None)
    assert picker.nearest(10.5, 0, 99, "corridor") and picker.chosen[0][0] == 10
    assert not picker.nearest(10, 5, 15, "corridor")
    assert picker.pool(0, 30, "corridor").tolist() == [0, *range(20, 31)]


def test_dark_frames_go_to_the_longest_stretches_first():
    picker = Picker(route(), None)
    assert picker.dark(3) == 3
    assert sorted(c[4] for c in picker.chosen) == [50, 150, 150]


def test_against_a_plain_search():
    """Each pick is the admissible frame nearest to its target."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        r = Route(0, 150, blocked=[int(x) for x in rng.integers(0, 150, 3)])
        picker, taken = Picker(r, None), []
        for _ in range(6):
            target = float(rng.uniform(0, 150))
            free = [f for f in range(150) if all(abs(f - b) >= selection.APART_BLOCKED for b in r.blocked) and all(abs(f - t) >= selection.APART for t in taken)]
            assert picker.nearest(target, 0, 149, "corridor") == bool(free)
            if free:
                taken.append(min(free, key=lambda f: (abs(f - target), f)))
        assert [c[0] for c in picker.chosen] == taken
