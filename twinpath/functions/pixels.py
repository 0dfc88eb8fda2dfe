"""Small images as flat arrays, row after row, in Spark expressions: no image leaves the JVM.

Every function takes the raster as Python integers, so the plan holds plain
index arithmetic. Work grows with the pixels times the size of a filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import doubles, dot

#: Weights of red, green and blue in luma, and of the older grey used for gradients.
LUMA, GREY = (0.2126, 0.7152, 0.0722), (0.299, 0.587, 0.114)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def image(rows: int, columns: int, pixel: Callable[[Column, Column], Column]) -> Column:
    """The image whose pixel at (row, column) is given."""
    places = F.sequence(F.lit(0), F.lit(rows * columns - 1))
    return F.transform(places, lambda i: pixel(F.floor(i / columns).cast("int"), (i % columns).cast("int")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def average(values: Column) -> Column:
    return total(values) / F.size(values)


def quantile(values: Column, share: float) -> Column:
    """The quantile of an array between its order statistics."""
    return let(F.array_sort(doubles(values)), lambda v: let((F.size(v) - 1) * F.lit(share), lambda p: F.get(v, F.floor(p).cast("int")) + (p - F.floor(p)) * (F.get(v, F.ceil(p).cast("int")) - F.get(v, F.floor(p).cast("int")))))


def luma_of(rgb: Column) -> Column:
    """struct(mean, p99) of the luma of interleaved red, green and blue."""
    pixel = lambda i: sum((F.get(rgb, i * 3 + k) * w for k, w in enumerate(LUMA)), F.lit(0.0))
    y = F.transform(F.sequence(F.lit(0), (F.size(rgb) / 3 - 1).cast("int")), pixel)
    return let(y, lambda v: F.struct(average(v).alias("mean"), quantile(v, 0.99).alias("p99")))


def gradient(pixels: Column, rows: int, columns: int) -> Column:
    """Magnitude of the gradient: half differences of the neighbours, whole ones at the border."""

    def slope(line: Column, size: int, value: Callable[[Column], Column]) -> Column:
        low, high = F.greatest(line - 1, F.lit(0)), F.least(line + 1, F.lit(size - 1))
        return (value(high) - value(low)) / F.greatest(high - low, F.lit(1))

    at = lambda r, c: F.get(pixels, r * columns + c)
    return image(rows, columns, lambda r, c: F.sqrt(F.pow(slope(c, columns, lambda x: at(r, x)), F.lit(2.0)) + F.pow(slope(r, rows, lambda y: at(y, c)), F.lit(2.0))))


def inner_gradient(pixels: Column, rows: int, columns: int) -> Column:
    """Magnitude of the whole differences of the neighbours, 0 across the border."""
    across = lambda r, c: F.when((c > 0) & (c < columns - 1), F.get(pixels, r * columns + c + 1) - F.get(pixels, F.greatest(r * columns + c - 1, F.lit(0)))).otherwise(F.lit(0.0))
    down = lambda r, c: F.when((r > 0) & (r < rows - 1), F.get(pixels, (r + 1) * columns + c) - F.get(pixels, F.greatest((r - 1) * columns + c, F.lit(0)))).otherwise(F.lit(0.0))
    return image(rows, columns, lambda r, c: F.sqrt(F.pow(across(r, c), F.lit(2.0)) + F.pow(down(r, c), F.lit(2.0))))


def mirrored(place: Column, size: int) -> Column:
    """A place beyond the border as its mirror image: the border pixel comes twice."""
    inside = F.pmod(place, F.lit(2 * size))
    return F.when(inside < size, inside).otherwise(2 * size - 1 - inside)


def filtered(pixels: Column, rows: int, columns: int, weights: list[float], down: bool) -> Column:
    """A centred filter along one axis, over mirrored borders."""
    reach = len(weights) // 2

    def pixel(r: Column, c: Column) -> Column:
        found = F.lit(0.0)
        for k, w in enumerate(weights):
            place = mirrored(r + (k - reach), rows) * columns + c if down else r * columns + mirrored(c + (k - reach), columns)
            found = found + F.get(pixels, place) * w
        return found

    return image(rows, columns, pixel)


def bell(sigma: float) -> list[float]:
    """The weights of a Gaussian, cut at four sigmas."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def edges(pixels: Column, rows: int, columns: int, sigma: float = 0.8) -> Column:
    """Magnitude of Sobel's derivatives of the smoothed image."""
    step = lambda p, weights, down: filtered(p, rows, columns, weights, down)
    difference, soft = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]

    def magnitude(smooth: Column) -> Column:
        across = let(step(smooth, difference, False), lambda p: step(p, soft, True))
        down = let(step(smooth, difference, True), lambda p: step(p, soft, False))
        return F.zip_with(across, down, lambda x, y: F.sqrt(x * x + y * y))

    return let(let(step(doubles(pixels), bell(sigma), True), lambda p: step(p, bell(sigma), False)), magnitude)


def cropped(pixels: Column, rows: int, columns: int, top: int, bottom: int, side: int) -> Column:
    return image(rows - top - bottom, columns - 2 * side, lambda r, c: F.get(pixels, (r + top) * columns + c + side))


def moved(pixels: Column, rows: int, columns: int, dx: Column, dy: Column) -> Column:
    """The image moved by whole pixels, 0 where nothing comes from."""

    def pixel(r: Column, c: Column) -> Column:
        y, x = r - dy, c - dx
        inside = (y >= 0) & (y < rows) & (x >= 0) & (x < columns)
        return F.when(inside, F.get(pixels, F.greatest(y, F.lit(0)) * columns + F.greatest(x, F.lit(0)))).otherwise(F.lit(0.0))

    return image(rows, columns, pixel)


def pooled(pixels: Column, rows: int, columns: int, grid_rows: int, grid_columns: int) -> Column:
    """Means of the cells of a grid, whose lines are rounded down."""

    def cell(r: Column, c: Column) -> Column:
        line = lambda i, size, parts: F.floor(i * size / parts).cast("int")
        ys = F.sequence(line(r, rows, grid_rows), line(r + 1, rows, grid_rows) - 1)
        xs = F.sequence(line(c, columns, grid_columns), line(c + 1, columns, grid_columns) - 1)
        return average(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.get(pixels, y * columns + x)))))

    return image(grid_rows, grid_columns, cell)


def structure(pixels: Column, rows: int, columns: int, grid_rows: int = 12, grid_columns: int = 16) -> Column:
    """Mean gradients on a grid, their mean removed, of unit length unless they are flat."""

    def unit(cells: Column) -> Column:
        centred = let(average(cells), lambda m: F.transform(cells, lambda x: x - m))
        return let(centred, lambda v: let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 1e-6, x / n).otherwise(x))))

    return let(let(gradient(pixels, rows, columns), lambda g: pooled(g, rows, columns, grid_rows, grid_columns)), unit)


def resized(mask: Column, rows: int, columns: int, new_rows: int, new_columns: int) -> Column:
    """A mask of booleans at another size: between the nearest centres, then from one half on."""

    def place(i: Column, size: int, new: int) -> Column:
        return F.greatest(F.least((i + 0.5) * size / new - 0.5, F.lit(float(size - 1))), F.lit(0.0))

    def pixel(r: Column, c: Column) -> Column:
        y, x = place(r, rows, new_rows), place(c, columns, new_columns)
        y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
        at = lambda i, j: F.get(mask, F.least(i, F.lit(rows - 1)) * columns + F.least(j, F.lit(columns - 1))).cast("int")
        top = at(y0, x0) * (1 - (x - x0)) + at(y0, x0 + 1) * (x - x0)
        low = at(y0 + 1, x0) * (1 - (x - x0)) + at(y0 + 1, x0 + 1) * (x - x0)
        return top * (1 - (y - y0)) + low * (y - y0) >= 0.5

    return image(new_rows, new_columns, pixel)


def shared(a: Column, b: Column) -> Column:
    """Pixels that two masks of one raster share."""
    return F.zip_with(a, b, lambda x, y: x & y)


def nearest(mask: Column, rows: int, columns: int, new_rows: int, new_columns: int) -> Column:
    """A mask at another size, each pixel from the one that lies under its centre."""
    line = lambda i, size, new: F.floor((i + 0.5) * size / new).cast("int")
    return image(new_rows, new_columns, lambda r, c: F.get(mask, line(r, rows, new_rows) * columns + line(c, columns, new_columns)))


def standardised(pixels: Column) -> Column:
    """Mean 0 and deviation 1."""

    def scaled(v: Column) -> Column:
        return let(F.greatest(F.sqrt(dot(v, v) / F.size(v)), F.lit(1e-6)), lambda sd: F.transform(v, lambda x: x / sd))

    return let(let(average(pixels), lambda m: F.transform(pixels, lambda x: x - m)), scaled)


def yaw(a: Column, b: Column, rows: int, columns: int, reach: int = 140, margin: int = 110, least: float = 4.0) -> Column:
    """struct(shift, peak, sharpness, at_boundary, reliable): the circular shift of b's columns that correlates best with a.

    Correlated are the columns at least `margin` from the border; the sharpness
    is the peak's height above the median score, in deviations.
    """
    inner = columns - 2 * margin

    def score(shift: Column, x: Column, y: Column) -> Column:
        product = lambda r, c: F.get(x, r * columns + c + margin) * F.get(y, r * columns + F.pmod(c + margin - shift, F.lit(columns)))
        return average(image(rows, inner, product))

    def judged(scores: Column) -> Column:
        place = F.array_position(scores, F.array_max(scores)).cast("int") - 1
        deviation = let(average(scores), lambda m: F.sqrt(average(F.transform(scores, lambda s: (s - m) * (s - m)))))
        sharpness = (F.array_max(scores) - quantile(scores, 0.5)) / F.greatest(deviation, F.lit(1e-9))
        boundary = place.isin(0, 2 * reach)
        return F.struct((place - reach).alias("shift"), F.array_max(scores).alias("peak"), sharpness.alias("sharpness"), boundary.alias("at_boundary"), ((sharpness >= least) & ~boundary).alias("reliable"))

    both = F.struct(standardised(a).alias("a"), standardised(b).alias("b"))
    return let(both, lambda p: let(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda s: score(s, p["a"], p["b"])), judged))


def changed(previous: Column, current: Column, threshold: float) -> Column:
    """Pixels whose change differs from the median change by more than a threshold."""
    delta = F.zip_with(doubles(current), doubles(previous), lambda x, y: x - y)
    return let(delta, lambda d: let(quantile(d, 0.5), lambda m: F.transform(d, lambda x: F.abs(x - m) > threshold)))


def coverage(mask: Column, rows: int, columns: int, tile_rows: int = 3, tile_columns: int = 4, least: float = 0.035) -> Column:
    """The share of tiles in which at least such a share of pixels is set."""
    shares = pooled(F.transform(mask, lambda x: x.cast("double")), rows, columns, tile_rows, tile_columns)
    return F.size(F.filter(shares, lambda s: s >= least)) / F.lit(float(tile_rows * tile_columns))
