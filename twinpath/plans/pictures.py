"""Queries over small images, made of the vectors as eight by eight pixels, and over matched points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels, vectors
from ..operators import geometry, matches
from ..operators import pictures as pic
from ..sources import adapter
from ..sources.adapter import PAIR, with_sql
from .catalog import query

KEYS = ["recording", "run"]
SIZE = 8
P = "recording, camera"


def each(body: str, n: int = 64) -> str:
    """A list in SQL: body for i from 0."""
    return f"list_transform(range({n}), lambda i: {body})"


def at(row: str, column: str, values: str = "v", width: int = 8) -> str:
    return f"{values}[CAST(({row}) * {width} + ({column}) + 1 AS BIGINT)]"


def _mirrored(place: str) -> str:
    return f"CASE WHEN (({place}) + 16) % 16 < 8 THEN (({place}) + 16) % 16 ELSE 15 - (({place}) + 16) % 16 END"


def _filtered(values: str, weights: list[float], down: bool) -> str:
    """The filter of `pixels.filtered`."""
    reach = len(weights) // 2
    terms = []
    for k, w in enumerate(weights):
        place = (_mirrored(f"i // 8 + {k - reach}"), "i % 8") if down else ("i // 8", _mirrored(f"i % 8 + {k - reach}"))
        terms.append(f"{at(*place, values)} * {w!r}")
    return each(" + ".join(terms))


BELL, STEP, SOFT = pixels.bell(0.8), [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]


@query(
    with_sql("descriptors").rstrip()
    + f""",
smooth AS (SELECT recording, run, ordinal, {_filtered("v", BELL, False)} AS v FROM (SELECT recording, run, ordinal, {_filtered("v", BELL, True)} AS v FROM descriptors)),
steps AS (SELECT recording, run, ordinal, {_filtered("v", STEP, False)} AS x, {_filtered("v", STEP, True)} AS y FROM smooth),
derived AS (SELECT recording, run, ordinal, {_filtered("x", SOFT, True)} AS x, {_filtered("y", SOFT, False)} AS y FROM steps)
SELECT recording, run, ordinal, round(list_sum(e), 5) AS total, round(list_max(e), 5) AS most FROM (SELECT recording, run, ordinal, {each("sqrt(x[i + 1] * x[i + 1] + y[i + 1] * y[i + 1])")} AS e FROM derived)"""
)
def edge_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the smoothed images: their sum and their greatest."""
    d = adapter.descriptors(spark, sf_dir).withColumn("e", pixels.edges(F.col("v"), SIZE, SIZE))
    return d.select(*KEYS, "ordinal", F.round(pixels.total(F.col("e")), 5).alias("total"), F.round(F.array_max("e"), 5).alias("most"))


_SLOPE_X = f"({at('i // 8', 'least(i % 8 + 1, 7)')} - {at('i // 8', 'greatest(i % 8 - 1, 0)')}) / (least(i % 8 + 1, 7) - greatest(i % 8 - 1, 0))"
_SLOPE_Y = f"({at('least(i // 8 + 1, 7)', 'i % 8')} - {at('greatest(i // 8 - 1, 0)', 'i % 8')}) / (least(i // 8 + 1, 7) - greatest(i // 8 - 1, 0))"


@query(
    with_sql("descriptors").rstrip()
    + f""",
slopes AS (SELECT recording, run, ordinal, {each(f"sqrt(pow({_SLOPE_X}, 2.0) + pow({_SLOPE_Y}, 2.0))")} AS v FROM descriptors),
cells AS (SELECT recording, run, ordinal, {each(f"({at('i // 4 * 2', 'i % 4 * 2')} + {at('i // 4 * 2', 'i % 4 * 2 + 1')} + {at('i // 4 * 2 + 1', 'i % 4 * 2')} + {at('i // 4 * 2 + 1', 'i % 4 * 2 + 1')}) / 4", 16)} AS c FROM slopes),
centred AS (SELECT recording, run, ordinal, list_transform(c, lambda x: x - list_avg(c)) AS c FROM cells)
SELECT recording, run, ordinal, unnest(range(16)) AS cell, round(unnest(list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))), 6) AS value FROM centred"""
)
def structure_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient structure on a grid of four by four."""
    d = adapter.descriptors(spark, sf_dir)
    return d.select(*KEYS, "ordinal", F.posexplode(pixels.structure(F.col("v"), SIZE, SIZE, 4, 4)).alias("cell", "value")).select(*KEYS, "ordinal", F.col("cell").cast("bigint").alias("cell"), F.round("value", 6).alias("value"))


@query(
    with_sql("descriptors").rstrip()
    + f""",
flat AS (SELECT recording, run, unnest(range(64)) AS i, unnest(v) AS x FROM descriptors),
refs AS (SELECT recording, run, list(mean ORDER BY i) AS mean, list(median ORDER BY i) AS median FROM (SELECT recording, run, i, avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM flat GROUP BY ALL) GROUP BY ALL),
removed AS (SELECT recording, run, ordinal, {each(f"{at('i // 4 + 2', 'i % 4 + 2')} / ({at('i // 4 + 2', 'i % 4 + 2', 'mean')} + 1.0)", 20)} AS m, {each(f"{at('i // 4 + 2', 'i % 4 + 2')} - {at('i // 4 + 2', 'i % 4 + 2', 'median')}", 20)} AS d FROM descriptors JOIN refs USING (recording, run))
SELECT recording, run, ordinal, round(list_sum(m), 6) AS divided, round(list_sum(d), 6) AS subtracted FROM removed"""
)
def static_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without what stands still, cut to the part that is analysed."""
    d = adapter.descriptors(spark, sf_dir)
    refs = pic.reference(d, KEYS, "v", "mean").withColumnRenamed("reference", "mean").join(pic.reference(d, KEYS, "v", "median").withColumnRenamed("reference", "median"), KEYS)
    left = lambda mode: F.round(pixels.total(pixels.cropped(vectors.remove_static(F.col("v"), F.col(mode), mode), SIZE, SIZE, 2, 1, 2)), 6)
    return d.join(refs, KEYS).select(*KEYS, "ordinal", left("mean").alias("divided"), left("median").alias("subtracted"))


@query(
    with_sql("descriptors")
    + f"""SELECT recording, run, ordinal, round(list_sum(m), 6) AS total, round(m[1], 6) AS corner, round(m[64], 6) AS opposite FROM (SELECT recording, run, ordinal,
{each("CASE WHEN i // 8 - dy BETWEEN 0 AND 7 AND i % 8 - dx BETWEEN 0 AND 7 THEN v[CAST((i // 8 - dy) * 8 + i % 8 - dx + 1 AS BIGINT)] ELSE 0.0 END")} AS m FROM (SELECT *, ordinal % 5 - 2 AS dx, ordinal % 3 - 1 AS dy FROM descriptors))"""
)
def moved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images moved by whole pixels."""
    d = adapter.descriptors(spark, sf_dir)
    m = d.select(*KEYS, "ordinal", pixels.moved(F.col("v"), SIZE, SIZE, (F.col("ordinal") % 5 - 2).cast("int"), (F.col("ordinal") % 3 - 1).cast("int")).alias("m"))
    return m.select(*KEYS, "ordinal", F.round(pixels.total(F.col("m")), 6).alias("total"), F.round(F.get("m", F.lit(0)), 6).alias("corner"), F.round(F.get("m", F.lit(63)), 6).alias("opposite"))


_GX = f"CASE WHEN i % 4 BETWEEN 1 AND 2 THEN {at('i // 4', 'i % 4 + 1', 's', 4)} - {at('i // 4', 'greatest(i % 4 - 1, 0)', 's', 4)} ELSE 0.0 END"
_GY = f"CASE WHEN i // 4 BETWEEN 1 AND 2 THEN {at('least(i // 4 + 1, 3)', 'i % 4', 's', 4)} - {at('greatest(i // 4 - 1, 0)', 'i % 4', 's', 4)} ELSE 0.0 END"


@query(
    with_sql("descriptors").rstrip()
    + f""",
small AS (SELECT recording, run, ordinal, {each(f"({at('i // 4 * 2', 'i % 4 * 2')} + {at('i // 4 * 2', 'i % 4 * 2 + 1')} + {at('i // 4 * 2 + 1', 'i % 4 * 2')} + {at('i // 4 * 2 + 1', 'i % 4 * 2 + 1')}) / 4", 16)} AS s FROM descriptors)
SELECT recording, run, ordinal, round(list_sum(g), 6) AS total, round(list_max(g), 6) AS most FROM (SELECT recording, run, ordinal, {each(f"sqrt(pow({_GX}, 2.0) + pow({_GY}, 2.0))", 16)} AS g FROM small)"""
)
def gradient_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of the images at half their size."""
    g = pixels.let(pixels.pooled(F.col("v"), SIZE, SIZE, 4, 4), lambda s: pixels.inner_gradient(s, 4, 4))
    d = adapter.descriptors(spark, sf_dir).select(*KEYS, "ordinal", g.alias("g"))
    return d.select(*KEYS, "ordinal", F.round(pixels.total(F.col("g")), 6).alias("total"), F.round(F.array_max("g"), 6).alias("most"))


def _bilinear(new: int) -> str:
    """The resizing of `pixels.resized` of eight by eight booleans in m."""
    y, x = (f"greatest(least(({i} + 0.5) * 8 / {new} - 0.5, 7.0), 0.0)" for i in (f"(i // {new})", f"(i % {new})"))
    px = lambda r, c: f"CAST(m[CAST(least({r}, 7) * 8 + least({c}, 7) + 1 AS BIGINT)] AS INTEGER)"
    y0, x0 = f"floor({y})", f"floor({x})"
    top = f"{px(y0, x0)} * (1 - ({x} - {x0})) + {px(y0, f'{x0} + 1')} * ({x} - {x0})"
    low = f"{px(f'{y0} + 1', x0)} * (1 - ({x} - {x0})) + {px(f'{y0} + 1', f'{x0} + 1')} * ({x} - {x0})"
    return each(f"({top}) * (1 - ({y} - {y0})) + ({low}) * ({y} - {y0}) >= 0.5", new * new)


_COUNT = "len(list_filter({0}, lambda x: x))"


@query(
    with_sql("descriptors").rstrip()
    + f""",
masks AS (SELECT recording, run, ordinal, list_transform(v, lambda x: x > 0.02) AS m FROM descriptors),
sized AS (SELECT recording, run, ordinal, m, {_bilinear(5)} AS small, {_bilinear(12)} AS large, {each("m[CAST(floor((i // 16 + 0.5) / 2) * 8 + floor((i % 16 + 0.5) / 2) + 1 AS BIGINT)]", 256)} AS near FROM masks),
pairs AS (SELECT a.recording, a.ordinal, a.small, a.large, {each("a.near[i + 1] AND b.near[i + 1]", 256)} AS shared FROM sized a JOIN sized b ON a.recording = b.recording AND a.ordinal = b.ordinal AND a.run = 'runA' AND b.run = 'runB')
SELECT recording, ordinal, {_COUNT.format("small")} AS small, {_COUNT.format("large")} AS large, {_COUNT.format("shared")} AS shared FROM pairs"""
)
def shared_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks at other sizes, and the pixels that both runs' masks share."""
    d = adapter.descriptors(spark, sf_dir).select("recording", "run", "ordinal", F.transform("v", lambda x: x > 0.02).alias("m"))
    sized = d.select("recording", "run", "ordinal", pixels.resized(F.col("m"), SIZE, SIZE, 5, 5).alias("small"), pixels.resized(F.col("m"), SIZE, SIZE, 12, 12).alias("large"), pixels.nearest(F.col("m"), SIZE, SIZE, 16, 16).alias("near"))
    other = sized.filter("run = 'runB'").select("recording", "ordinal", F.col("near").alias("other"))
    count = lambda m: F.size(F.filter(m, lambda x: x)).cast("bigint")
    joined = sized.filter("run = 'runA'").join(other, ["recording", "ordinal"])
    return joined.select("recording", "ordinal", count(F.col("small")).alias("small"), count(F.col("large")).alias("large"), count(pixels.shared(F.col("near"), F.col("other"))).alias("shared"))


_UNIT = "list_transform({0}, lambda x: (x - list_avg({0})) / greatest(list_aggregate({0}, 'stddev_pop'), 0.000001))"


@query(
    with_sql("descriptors").rstrip()
    + f""",
pairs AS (SELECT a.recording, a.ordinal, {_UNIT.format("a.v")} AS a, {_UNIT.format("b.v")} AS b FROM descriptors a JOIN descriptors b ON a.recording = b.recording AND a.ordinal = b.ordinal AND a.run = 'runA' AND b.run = 'runB'),
scores AS (SELECT recording, ordinal, list_transform(range(-3, 4), lambda s: list_avg(list_transform(range(32), lambda i: a[CAST(i // 4 * 8 + i % 4 + 3 AS BIGINT)] * b[CAST(i // 4 * 8 + (i % 4 + 2 - s + 8) % 8 + 1 AS BIGINT)]))) AS c FROM pairs),
judged AS (SELECT *, list_position(c, list_max(c)) - 1 AS place, (list_max(c) - list_aggregate(c, 'median')) / greatest(list_aggregate(c, 'stddev_pop'), 0.000000001) AS sharpness FROM scores)
SELECT recording, ordinal, CAST(place - 3 AS BIGINT) AS shift, round(list_max(c), 6) AS peak, round(sharpness, 5) AS sharpness, place IN (0, 6) AS at_boundary, sharpness >= 1.5 AND place NOT IN (0, 6) AS reliable FROM judged"""
)
def ego_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circular shift between the two runs' images, and whether its peak stands out."""
    d = adapter.descriptors(spark, sf_dir)
    side = lambda run, name: d.filter(F.col("run") == run).select("recording", "ordinal", F.col("v").alias(name))
    found = side("runA", "a").join(side("runB", "b"), ["recording", "ordinal"]).select("recording", "ordinal", pixels.yaw(F.col("a"), F.col("b"), SIZE, SIZE, 3, 2, 1.5).alias("y"))
    return found.select("recording", "ordinal", F.col("y.shift").cast("bigint").alias("shift"), F.round("y.peak", 6).alias("peak"), F.round("y.sharpness", 5).alias("sharpness"), "y.at_boundary", "y.reliable")


_TILE = "list_avg(list_transform(list_filter(range(64), lambda p: p // 8 >= (i // 4) * 8 // 3 AND p // 8 < (i // 4 + 1) * 8 // 3 AND p % 8 >= (i % 4) * 2 AND p % 8 < (i % 4 + 1) * 2), lambda p: CASE WHEN m[p + 1] THEN 1.0 ELSE 0.0 END))"


@query(
    with_sql("descriptors").rstrip()
    + f""",
deltas AS (SELECT recording, run, ordinal, list_transform(range(64), lambda i: v[i + 1] - w[i + 1]) AS d FROM (SELECT *, lag(v) OVER (PARTITION BY recording, run ORDER BY ordinal) AS w FROM descriptors) WHERE w IS NOT NULL),
masks AS (SELECT recording, run, ordinal, list_transform(d, lambda x: abs(x - list_aggregate(d, 'median')) > 0.15) AS m FROM deltas),
shares AS (SELECT recording, run, ordinal, len(list_filter(m, lambda x: x)) / 64.0 AS changed, len(list_filter({each(_TILE, 12)}, lambda s: s >= 0.4)) / 12.0 AS tiles FROM masks),
gathered AS (SELECT recording, run, list(changed ORDER BY ordinal) AS all_changed FROM shares GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY recording, run ORDER BY ordinal) AS n FROM shares JOIN gathered USING (recording, run))
SELECT recording, run, ordinal, round(changed, 6) AS changed_fraction, round(tiles, 6) AS tile_coverage, round(list_aggregate(list_transform(range(-2, 3), lambda k: all_changed[CAST(greatest(1, least(len(all_changed), n + k)) AS BIGINT)]), 'median'), 6) AS smoothed_changed FROM numbered"""
)
def motion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in each image against the one before it, and its running median."""
    made = pic.motion_rows(adapter.descriptors(spark, sf_dir), KEYS, "ordinal", "v", SIZE, SIZE, 0.15, 0.4, 5)
    return made.select(*KEYS, "ordinal", *[F.round(c, 6).alias(c) for c in ("changed_fraction", "tile_coverage", "smoothed_changed")])


@query()
def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the edges of each image moved against the one before it, and the running median of how far."""
    return pic.phase_rows(adapter.descriptors(spark, sf_dir), KEYS, "recording long, run string", "ordinal", "v", SIZE, SIZE, 5)


@query(
    with_sql("descriptors")
    + """SELECT recording, run, ordinal, round(list_avg(y), 6) AS mean, round(list_aggregate(y, 'quantile_cont', 0.99), 6) AS p99 FROM (SELECT recording, run, ordinal, list_transform(range(21), lambda i: (v[i * 3 + 1] * 0.2126 + v[i * 3 + 2] * 0.7152 + v[i * 3 + 3] * 0.0722) * 255) AS y FROM descriptors)"""
)
def frame_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 99th percentile of the luma of each image."""
    d = adapter.descriptors(spark, sf_dir).select(*KEYS, "ordinal", pixels.luma_of(F.transform(F.slice("v", 1, 63), lambda x: x * 255)).alias("y"))
    return d.select(*KEYS, "ordinal", F.round("y.mean", 6).alias("mean"), F.round("y.p99", 6).alias("p99"))


# -- matched points


@query(
    with_sql("descriptors").rstrip()
    + """,
pairs AS (SELECT a.recording, a.ordinal // 10 AS block, a.ordinal AS i, b.ordinal AS j, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS d FROM descriptors a JOIN descriptors b ON a.recording = b.recording AND a.ordinal // 10 = b.ordinal // 10 AND a.run = 'runA' AND b.run = 'runB'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY recording, i ORDER BY d, j) AS r, lead(d) OVER (PARTITION BY recording, i ORDER BY d, j) AS next, row_number() OVER (PARTITION BY recording, j ORDER BY d, i) AS back FROM pairs)
SELECT recording, block, i, j, CAST(i * 7 AS DOUBLE) AS ax, CAST(j * 5 AS DOUBLE) AS bx FROM ranked WHERE r = 1 AND back = 1 AND d < 0.97 * next"""
)
def matched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two images that are each other's nearest, clearly nearer than the next."""
    d = adapter.descriptors(spark, sf_dir)
    rows = d.selectExpr("recording", "ordinal div 10 AS block", "run", "ordinal AS number", "ordinal * CASE run WHEN 'runA' THEN 7 ELSE 5 END AS x", "ordinal AS y", "v")
    return geometry.matched(rows, ["recording", "block"], "recording long, block long", 0.97).select("recording", "block", "i", "j", "ax", "bx")

MEASURED = f"""measured AS (SELECT {P}, a, b, count(*) AS matches, CASE WHEN count(*) >= 15 THEN quantile_cont(bx - ax, 0.5) END AS dx, CASE WHEN count(*) >= 15 THEN quantile_cont("by" - ay, 0.5) END AS dy FROM matched GROUP BY ALL)
"""
MEASURED_SQL = with_sql("matched").rstrip() + ",\n" + MEASURED


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.displacements(adapter.matched(spark, sf_dir), [*PAIR, "a", "b"])


@query(MEASURED_SQL + f"SELECT {P}, a, b, matches, round(dx, 4) AS dx, round(dy, 4) AS dy FROM measured")
def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median displacement of the matched points of each pair of frames."""
    return measured(spark, sf_dir).select(*PAIR, "a", "b", "matches", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query(
    MEASURED_SQL.rstrip()
    + f""",
rates AS (SELECT * FROM (SELECT DISTINCT {P}, a FROM matched) LEFT JOIN (SELECT {P}, a, abs(dx) AS r FROM measured WHERE b = a + 1) USING ({P}, a)),
placed AS (SELECT *, last_value(CASE WHEN r IS NOT NULL THEN a END IGNORE NULLS) OVER back AS fa, last_value(r IGNORE NULLS) OVER back AS ra, first_value(CASE WHEN r IS NOT NULL THEN a END IGNORE NULLS) OVER ahead AS fb, first_value(r IGNORE NULLS) OVER ahead AS rb FROM rates
  WINDOW back AS (PARTITION BY {P} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY {P} ORDER BY a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {P}, a, round(coalesce(r, ra + (a - fa) / CAST(fb - fa AS DOUBLE) * (rb - ra), ra, rb), 4) AS rate, r IS NULL AS interpolated FROM placed"""
)
def sweep_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by which the scene sweeps from frame to frame, gaps filled."""
    found = measured(spark, sf_dir)
    made = matches.sweep_rates(found.filter("b = a + 1"), adapter.matched(spark, sf_dir), PAIR, "a")
    return made.select(*PAIR, "a", F.round("rate", 4).alias("rate"), "interpolated")


OFFSETS = f"""pairs AS (SELECT DISTINCT {P}, a, a + a % 3 - 1 AS b FROM matched),
offsets AS (SELECT p.*, m.matches, m.dx, m.dy, (h.dx - l.dx) / 6 AS dx_per_frame FROM pairs p LEFT JOIN measured m USING ({P}, a, b) LEFT JOIN measured l ON l.recording = p.recording AND l.camera = p.camera AND l.a = p.a AND l.b = p.b - 3 LEFT JOIN measured h ON h.recording = p.recording AND h.camera = p.camera AND h.a = p.a AND h.b = p.b + 3)
"""
OFFSETS_SQL = MEASURED_SQL.rstrip() + ",\n" + OFFSETS


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = adapter.matched(spark, sf_dir).select(*PAIR, "a").distinct().withColumn("b", F.col("a") + F.col("a") % 3 - 1)
    return matches.at_partners(pairs, measured(spark, sf_dir), PAIR, "a", "b")


@query(OFFSETS_SQL + f"SELECT {P}, a, b, coalesce(matches, 0) AS matches, round(dx, 2) AS dx_at_label, round(dx_per_frame, 3) AS dx_per_frame FROM offsets")
def label_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement at each labelled pair, and the local rate from the frames around it."""
    return offsets(spark, sf_dir).select(*PAIR, "a", "b", F.coalesce("matches", F.lit(0)).alias("matches"), F.round("dx", 2).alias("dx_at_label"), F.round("dx_per_frame", 3).alias("dx_per_frame"))


CONVENTION = f"""middle AS (SELECT {P}, quantile_cont(dx, 0.5) AS mx, quantile_cont(dy, 0.5) AS my FROM offsets GROUP BY ALL),
convention AS (SELECT {P}, count(*) AS sampled, count(dx) AS measured, quantile_cont(dx, 0.5) AS dx, quantile_cont(dy, 0.5) AS dy, 1.4826 * quantile_cont(abs(dx - mx), 0.5) AS dx_mad, 1.4826 * quantile_cont(abs(dy - my), 0.5) AS dy_mad, CASE WHEN count(dx) > 3 THEN 1000 * regr_slope(dx, a) END AS trend, quantile_cont(dx_per_frame, 0.5) AS sweep FROM offsets JOIN middle USING ({P}) GROUP BY ALL)
"""


@query(OFFSETS_SQL.rstrip() + ",\n" + CONVENTION + f"SELECT {P}, sampled, measured, round(dx, 4) AS dx, round(dy, 4) AS dy, round(dx_mad, 4) AS dx_mad, round(dy_mad, 4) AS dy_mad, round(trend, 3) AS trend, round(sweep, 4) AS sweep FROM convention")
def matcher_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all sampled pairs say of the displacement: median, spread, trend and sweep."""
    made = matches.convention(offsets(spark, sf_dir), PAIR, "a")
    return made.select(*PAIR, "sampled", "measured", *[F.round(c, 3 if c == "trend" else 4).alias(c) for c in ("dx", "dy", "dx_mad", "dy_mad", "trend", "sweep")])


@query(
    OFFSETS_SQL.rstrip() + ",\n" + CONVENTION.rstrip()
    + f""",
moved AS (SELECT {P}, a, b - CAST(round_even(dx / 4.5, 0) AS BIGINT) AS b FROM pairs JOIN (SELECT {P}, dx FROM convention) USING ({P}) WHERE a % 5 > 0)
SELECT {P}, count(m.dx) AS measured, round(quantile_cont(m.dx, 0.5), 4) AS dx FROM moved JOIN measured m USING ({P}, a, b) GROUP BY ALL"""
)
def convention_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement left at corrected partners."""
    found = offsets(spark, sf_dir)
    shift = matches.convention(found, PAIR, "a").select(*PAIR, F.rint(F.col("dx") / 4.5).cast("bigint").alias("_frames"))
    corrected = found.select(*PAIR, "a", "b").join(shift, PAIR).withColumn("b", F.when(F.col("a") % 5 > 0, F.col("b") - F.col("_frames")))
    return matches.rechecked(corrected, measured(spark, sf_dir), PAIR, "a", "b").withColumn("dx", F.round("dx", 4))


@query(OFFSETS_SQL.rstrip() + ",\n" + CONVENTION + f"SELECT {P}, CAST(-round_even(dx / 896 * 960, 0) AS BIGINT) AS dx_px, CAST(-round_even(dy / 672 * 720, 0) AS BIGINT) AS dy_px FROM convention")
def pose_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move at the page's raster that undoes the measured displacement."""
    made = matches.convention(offsets(spark, sf_dir), PAIR, "a")
    return matches.compensation(made, (896, 672), (960, 720)).select(*PAIR, "dx_px", "dy_px")
