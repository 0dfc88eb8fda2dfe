"""NumPy kernels for small grey images and matched points; decoding and feature extraction are other tools' work."""

from __future__ import annotations

import numpy as np

#: Weights of red, green and blue in luma.
LUMA = (0.2126, 0.7152, 0.0722)


def luma(image: np.ndarray) -> tuple[float, float]:
    """Mean and 99th percentile of an RGB image's luma."""
    y = image.astype(float) @ np.asarray(LUMA)
    return float(y.mean()), float(np.percentile(y, 99))


def gradient(image: np.ndarray) -> np.ndarray:
    dy, dx = np.gradient(image.astype(float))
    return np.hypot(dx, dy)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dy, dx) of b against a by phase correlation, with a parabola through the peak."""
    spectrum = np.fft.fft2(b - b.mean()) * np.conj(np.fft.fft2(a - a.mean()))
    surface = np.fft.ifft2(spectrum / np.maximum(np.abs(spectrum), 1e-12)).real
    peak = np.unravel_index(int(surface.argmax()), surface.shape)
    shift = []
    for axis, size in enumerate(surface.shape):
        before, after = list(peak), list(peak)
        before[axis], after[axis] = (peak[axis] - 1) % size, (peak[axis] + 1) % size
        left, mid, right = surface[tuple(before)], surface[peak], surface[tuple(after)]
        bend = left - 2 * mid + right
        place = peak[axis] + (0.5 * (left - right) / bend if abs(bend) > 1e-12 else 0.0)
        shift.append(float(place - size if place > size / 2 else place))
    return shift[0], shift[1]


def labelled(mask: np.ndarray) -> np.ndarray:
    """Connected components by edges, numbered from 1, by flooding from seeds."""
    labels, number = np.zeros(mask.shape, dtype=np.int32), 0
    for seed in zip(*np.nonzero(mask), strict=True):
        if labels[seed]:
            continue
        number += 1
        todo = [seed]
        labels[seed] = number
        while todo:
            y, x = todo.pop()
            for at in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not labels[at]:
                    labels[at] = number
                    todo.append(at)
    return labels


def opened(mask: np.ndarray) -> np.ndarray:
    """A binary opening by a cross of three."""

    def spread(m: np.ndarray, outside: bool, combine) -> np.ndarray:
        padded = np.pad(m, 1, constant_values=outside)
        return combine.reduce([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])

    return spread(spread(mask, True, np.logical_and), False, np.logical_or)


def static_mask(stack: np.ndarray, still: float, bright: float, least: int) -> np.ndarray:
    """Pixels of a stack (frames, rows, columns) that hardly change or never get bright, opened, without small components."""
    candidate = opened((stack.std(axis=0) < still) | (stack.max(axis=0) < bright))
    labels = labelled(candidate)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    return sizes[labels] >= least


def sky(median: np.ndarray, bright: float, smooth: float) -> np.ndarray:
    """Bright, smooth components that touch the top."""
    labels = labelled((median >= bright) & (gradient(median) <= smooth))
    top = np.unique(labels[0])
    return np.isin(labels, top[top > 0])


def mutual_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.8) -> np.ndarray:
    """(i, j) of unit descriptors that are each other's nearest, clearly nearer than the next."""
    if len(a) < 2 or len(b) < 2:
        return np.zeros((0, 2), dtype=int)
    distance = np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))
    order = np.argsort(distance, axis=1, kind="stable")
    rows = np.arange(len(a))
    best, second = distance[rows, order[:, 0]], distance[rows, order[:, 1]]
    back = np.argmin(distance, axis=0)
    keep = (best < ratio * second) & (back[order[:, 0]] == rows)
    return np.stack([rows[keep], order[keep, 0]], axis=1)


def homography(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The projective maps from p to q (…, matches, 2) by least squares; NaN where there is none."""
    (x, y), (u, v) = (np.moveaxis(m, -1, 0) for m in (p, q))
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)], -2)
    _, s, vt = np.linalg.svd(rows.reshape(*x.shape[:-1], -1, 9))
    return np.where(s[..., 7, None, None] > 1e-9, vt[..., -1, :].reshape(*x.shape[:-1], 3, 3), np.nan)


def fundamental(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The epipolar maps between p and q (…, matches, 2) by eight or more matches, centred and scaled for the fit; NaN where there is none."""

    def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = m.mean(axis=-2, keepdims=True)
        spread = np.sqrt(((m - middle) ** 2).sum(axis=-1).mean(axis=-1) / 2)
        fine = spread > 1e-12
        size = np.where(fine, spread, 1.0)
        t = np.zeros((*size.shape, 3, 3))
        t[..., 0, 0] = t[..., 1, 1] = 1 / size
        t[..., :2, 2] = -middle[..., 0, :] / size[..., None]
        t[..., 2, 2] = 1
        return (m - middle) / size[..., None, None], t, fine

    (a, ta, fine_a), (b, tb, fine_b) = scaled(p), scaled(q)
    (x, y), (u, v) = (np.moveaxis(m, -1, 0) for m in (a, b))
    rows = np.stack([u * x, u * y, u, v * x, v * y, v, x, y, np.ones_like(x)], axis=-1)
    left, s, right = np.linalg.svd(np.linalg.svd(rows)[2][..., -1, :].reshape(*x.shape[:-1], 3, 3))
    s[..., 2] = 0  # every epipolar map has rank two
    found = np.swapaxes(tb, -1, -2) @ (left * s[..., None, :]) @ right @ ta
    return np.where((fine_a & fine_b)[..., None, None], found, np.nan)


def _with_one(p: np.ndarray) -> np.ndarray:
    return np.column_stack([p, np.ones(len(p))])


def mapping_errors(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pixels between q and where projective maps (…, 3, 3) send p."""
    mapped = _with_one(p) @ np.swapaxes(h, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.linalg.norm(mapped[..., :2] / mapped[..., 2:] - q, axis=-1)


def epipolar_errors(f: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sampson's distance of matches from epipolar maps (…, 3, 3)."""
    a, b = _with_one(p), _with_one(q)
    right, left = a @ np.swapaxes(f, -1, -2), b @ f
    slope = np.sqrt(right[..., 0] ** 2 + right[..., 1] ** 2 + left[..., 0] ** 2 + left[..., 1] ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.abs((b * right).sum(axis=-1)) / slope


#: The models of a pair of images with the matches that one takes and the pixels that a match may be off.
MODELS = ((fundamental, epipolar_errors, 8, 1.5), (homography, mapping_errors, 4, 3.0))


#: Samples that are fitted and compared with all matches at a time.
TOGETHER = 50


def agreeing(p: np.ndarray, q: np.ndarray, trials: int = 750, seed: int = 42, models: tuple = MODELS) -> np.ndarray:
    """Matches that agree with the better of the models, each the best of seeded samples; the first of equals."""
    best = np.zeros(len(p), dtype=bool)
    for fit, errors, size, pixels in models:
        if len(p) < size:
            continue
        rng = np.random.default_rng(seed)
        picks = np.array([rng.choice(len(p), size, replace=False) for _ in range(trials)])
        for part in np.array_split(picks, max(1, -(-trials // TOGETHER))):
            inside = errors(fit(p[part], q[part]), p, q) <= pixels
            counts = inside.sum(axis=1)
            if len(counts) and counts.max() > best.sum():
                best = inside[int(np.argmax(counts))]
    return best
