"""Queries of sequential rules, beside recursive SQL that walks the same steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dynamic
from ..operators import closure as close
from ..operators import kernels, probe, selection
from ..operators import sequences as seq
from ..operators import similarity as sim
from ..sources import adapter
from ..sources.adapter import PAIR, with_sql
from .catalog import query
from .sequences import P, kinks
from .similarities import MUTUAL, SELF_SQL, side

PAIR_SCHEMA = "recording long, camera string"


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


# -- label sets

ROUTES = f"""routes AS (SELECT {P}, 20 AS start, n_a - 20 AS "end", list_transform(range(0, n_a // 53 + 1), lambda k: k * 53) AS blocked FROM lengths WHERE n_a > 60),
opened AS (SELECT {P}, start, "end", list_filter(range(start, "end"), lambda x: len(list_filter(blocked, lambda b: abs(x - b) < 10)) = 0) AS free FROM routes)
"""


def walked(slots: str, apart: int, fallback: bool = False) -> str:
    """Takes the nearest free frame for each slot (keys, n, target, low, high) in turn; fallback: a wider second look."""

    def nearest(low: str, high: str) -> str:
        return f"list_sort(list_transform(list_filter(free, lambda x: x >= {low} AND x <= {high} AND len(list_filter(picks, lambda p: abs(x - p) < {apart})) = 0), lambda x: {{'d': abs(x - target), 'x': x}}))[1].x"

    pick = f"coalesce({nearest('low', 'high')}, {nearest('low - 30', 'high + 30')})" if fallback else nearest("low", "high")
    return f"""slots AS ({slots}),
walk AS (SELECT {P}, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS picks FROM opened
  UNION ALL SELECT {P}, n, list_concat(picks, list_filter([{pick}], lambda z: z IS NOT NULL)) FROM (SELECT w.{P.replace(", ", ", w.")}, s.n, w.picks, s.target, s.low, s.high, o.free FROM walk w JOIN slots s ON s.recording = w.recording AND s.camera = w.camera AND s.n = w.n + 1 JOIN opened o ON o.recording = w.recording AND o.camera = w.camera)),
last AS (SELECT {P}, arg_max(picks, n) AS picks FROM walk GROUP BY ALL)
SELECT {P}, unnest(range(len(picks))) AS number, unnest(list_sort(picks)) AS "runA_frame" FROM last"""


def route_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each route: bounds, frames shown before, an occlusion, dark stretches with their partners, kinks."""
    m = adapter.mapping(spark, sf_dir)
    bounds = m.groupBy(*PAIR).agg(F.first("n_a").alias("n_a")).filter("n_a > 60")
    dark = seq.islands(adapter.flags(spark, sf_dir).filter("run = 'runB' AND flag = 'too_dark'"), PAIR, "ordinal", 3)
    rows = [
        selection.facts(bounds, PAIR, "route", F.lit(20), F.col("n_a") - 20),
        selection.facts(bounds.select(*PAIR, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_a"), F.lit(53).cast("bigint"))).alias("x")), PAIR, "blocked", "x"),
        selection.facts(bounds, PAIR, "occlusion", F.lit(60), F.lit(120)),
        selection.facts(dark, PAIR, "dark", "start", "end"),
        selection.facts(m.filter("runB_frame IS NOT NULL"), PAIR, "partner", "runA_frame", "runB_frame"),
        selection.facts(kinks(spark, sf_dir, 6), PAIR, "kink", "runA_frame", "increment", F.col("dark_a") | F.col("dark_b")),
    ]
    found = rows[0]
    for other in rows[1:]:
        found = found.unionByName(other)
    return found


def picked(spark: SparkSession, sf_dir: str, stratum: str, count: int) -> DataFrame:
    """The frames of one stratum, without those that the corridor takes in its place."""
    found = selection.label_sets(route_facts(spark, sf_dir), PAIR, PAIR_SCHEMA, {stratum: count}).filter((F.col("stratum") == stratum) & F.col("runA_frame").isNotNull())
    number = F.row_number().over(Window.partitionBy(*PAIR).orderBy("runA_frame")) - 1
    return found.select(*PAIR, number.cast("bigint").alias("number"), "runA_frame")


@query(
    recursive(with_sql("lengths")).rstrip() + ",\n" + ROUTES.rstrip() + ",\n"
    + walked(f"SELECT {P}, s + 1 AS n, low, high, low + (high - low) * (s + 0.5) / 4 AS target FROM (SELECT {P}, list_min(f) AS low, list_max(f) AS high, unnest(range(4)) AS s FROM (SELECT {P}, list_filter(free, lambda x: x >= 60 AND x <= 120) AS f FROM opened) WHERE len(f) > 0)", 5)
)
def occlusion_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames spread over the free part of an occlusion."""
    return picked(spark, sf_dir, "occlusion", 4)


@query(
    recursive(with_sql("lengths", "flags", "mapping")).rstrip() + ",\n" + ROUTES.rstrip()
    + f""",
islands AS (SELECT {P}, min(ordinal) AS start, max(ordinal) AS "end" FROM (SELECT *, ordinal - row_number() OVER (PARTITION BY {P} ORDER BY ordinal) AS g FROM flags WHERE run = 'runB' AND flag = 'too_dark') GROUP BY {P}, g HAVING count(*) >= 3),
reached AS (SELECT {P}, start, low, high, row_number() OVER (PARTITION BY {P} ORDER BY start - "end", start) - 1 AS i, count(*) OVER (PARTITION BY {P}) AS k FROM (SELECT m.{P.replace(", ", ", m.")}, i.start, i."end", min(m.runA_frame) AS low, max(m.runA_frame) AS high FROM mapping m JOIN islands i ON i.recording = m.recording AND i.camera = m.camera AND m.runB_frame BETWEEN i.start AND i."end" GROUP BY ALL)),
dealt AS (SELECT *, 5 // k + CASE WHEN i < 5 % k THEN 1 ELSE 0 END AS wanted FROM reached),
"""
    + walked(f"SELECT {P}, row_number() OVER (PARTITION BY {P} ORDER BY i, slot) AS n, low, high, low + (high - low) * (slot + 0.5) / wanted AS target FROM (SELECT *, unnest(range(wanted)) AS slot FROM dealt)", 10)
)
def dark_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose partners lie in dark stretches, the longest first."""
    return picked(spark, sf_dir, "dark", 5)


@query(
    recursive(with_sql("lengths")).rstrip() + ",\n" + ROUTES.rstrip() + ",\n"
    + walked(f"SELECT {P}, i + 1 AS n, low, high, low + 0.5 * (high - low) AS target FROM (SELECT {P}, i, start + i * (\"end\" - start) // 7 AS low, start + (i + 1) * (\"end\" - start) // 7 - 1 AS high FROM (SELECT *, unnest(range(7)) AS i FROM opened))", 10, True)
)
def corridor_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame from each of seven equal parts of a route."""
    return picked(spark, sf_dir, "corridor", 7)


@query()
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole label sets, drawn with a seed: every stratum, and what fell short of it."""
    return selection.label_sets(route_facts(spark, sf_dir), PAIR, PAIR_SCHEMA, {"occlusion": 3, "dark": 4, "kink": 8, "corridor": 9}, 20260902)


@query(
    recursive(with_sql("lengths")).rstrip() + ",\n" + ROUTES.rstrip() + ",\n"
    + walked(f"SELECT {P}, i + 1 AS n, low, high, low + 0.5 * (high - low) AS target FROM (SELECT {P}, i, start + i * (\"end\" - start) // 7 AS low, start + (i + 1) * (\"end\" - start) // 7 - 1 AS high FROM (SELECT *, unnest(range(7)) AS i FROM opened))", 10, True).replace(f'SELECT {P}, unnest(range(len(picks))) AS number, unnest(list_sort(picks)) AS "runA_frame" FROM last', "")
    + f"""SELECT {P}, recording || '_' || camera || '_v3_' || lpad(CAST(number AS VARCHAR), 2, '0') AS query_id, f AS "runA_frame", 'corridor' AS stratum, CAST(round_even(CAST(f - 20 AS DOUBLE) / (n_a - 40) * (n_b - 1), 0) AS BIGINT) AS linear_prior, of_stratum
FROM (SELECT {P}, unnest(range(len(picks))) AS number, unnest(list_sort(picks)) AS f, len(picks) AS of_stratum FROM last) JOIN lengths USING ({P})"""
)
def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label set as named queries with the prior of a constant pace."""
    chosen = selection.label_sets(route_facts(spark, sf_dir), PAIR, PAIR_SCHEMA, {"corridor": 7})
    routes = adapter.mapping(spark, sf_dir).groupBy(*PAIR).agg(F.lit(20).alias("a_start"), (F.first("n_a") - 20).alias("a_end"), F.lit(0).alias("b_start"), (F.first("n_b") - 1).alias("b_end"))
    return selection.assembled(chosen, routes, PAIR, "v3")


# -- revisits

VECTORS_B = "others AS (SELECT a.recording, a.ordinal AS a, b.ordinal AS b, round(list_dot_product(a.v, b.v), 6) AS s FROM descriptors a JOIN descriptors b ON a.recording = b.recording AND a.run = 'runB' AND b.run = 'runB' AND a.ordinal <> b.ordinal)\n"


def mutual_of(pairs: str, name: str) -> str:
    return MUTUAL.replace("FROM pairs", f"FROM {pairs}").replace("far AS", f"{name}_far AS").replace("FROM far", f"FROM {name}_far").replace("mutual AS", f"{name} AS")


CONFIRMED = f"""{VECTORS_B.rstrip()},
{mutual_of("pairs", "mine").rstrip()},
{mutual_of("others", "theirs").rstrip()},
confirmed AS (SELECT m.recording, m.a, m.b, m.s FROM mine m WHERE EXISTS (SELECT 1 FROM theirs t WHERE t.recording = m.recording AND abs(t.a - m.a) <= 6 AND abs(t.b - m.b) <= 6))
"""


def thinned(pairs: str, apart: int, most: int) -> str:
    """(recording, a, b, s): the best pairs, each apart from those before it at one end."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY s DESC, a, b) AS n FROM {pairs}),
thin AS (SELECT DISTINCT recording, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a BIGINT, b BIGINT, s DOUBLE)[]) AS taken FROM ranked
  UNION ALL SELECT t.recording, r.n, CASE WHEN len(taken) < {most} AND len(list_filter(taken, lambda x: abs(x.a - r.a) < {apart} AND abs(x.b - r.b) < {apart})) = 0 THEN list_append(taken, {{'a': r.a, 'b': r.b, 's': r.s}}) ELSE taken END FROM thin t JOIN ranked r ON r.recording = t.recording AND r.n = t.n + 1),
thinned AS (SELECT recording, unnest(taken, recursive := true) FROM (SELECT recording, arg_max(taken, n) AS taken FROM thin GROUP BY recording))
"""


def confirmed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, theirs = (sim.mutual(side(spark, sf_dir, run), ["recording"], "recording long", 5, 20, 0.1) for run in ("runA", "runB"))
    return close.confirmed(mine.select("recording", "a", "b", "s"), theirs, ["recording"], 6)


@query(SELF_SQL.rstrip() + ",\n" + CONFIRMED + "SELECT recording, a, b, s FROM confirmed")
def confirmed_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distant look-alikes of one set of vectors that another one confirms."""
    return confirmed_pairs(spark, sf_dir)


@query(recursive(SELF_SQL).rstrip() + ",\nfar AS (SELECT * FROM pairs WHERE b - a >= 20 AND s >= 0.1),\n" + thinned("far", 15, 40) + "SELECT recording, a, b, s FROM thinned")
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distant look-alikes of run A, thinned greedily."""
    return kernels.thinned(sim.alike(side(spark, sf_dir, "runA"), ["recording"], "recording long", 20, 0.1), ["recording"], "recording long", 15, 40)


PARTNER = "CASE WHEN {0} % 11 <> 5 THEN least(99, {0} * 49 // 50 + {0} % 3) END"


@query(
    recursive(SELF_SQL).rstrip() + ",\n" + CONFIRMED.rstrip() + ",\n" + thinned("confirmed", 6, 40).rstrip()
    + f""",
ends AS (SELECT *, {PARTNER.format("a")} AS partner_a, {PARTNER.format("b")} AS partner_b FROM thinned),
judged AS (SELECT e.*, abs(partner_a - partner_b) AS gap, CASE WHEN partner_a IS NULL OR partner_b IS NULL THEN NULL WHEN abs(partner_a - partner_b) < 20 THEN 1 ELSE (SELECT count(*) FROM others o WHERE o.recording = e.recording AND o.a = e.partner_a AND abs(o.b - o.a) >= 20 AND o.s > (SELECT s FROM others x WHERE x.recording = e.recording AND x.a = e.partner_a AND x.b = e.partner_b)) + 1 END AS rank FROM ends e)
SELECT recording, a, b, s, partner_a, partner_b, gap, rank, CASE WHEN gap IS NULL THEN 'not_both_mapped' WHEN gap <= 12 OR rank <= 10 THEN 'consistent' ELSE 'INCONSISTENT' END AS verdict FROM judged"""
)
def endpoint_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether confirmed revisits are mapped to one place."""
    d = adapter.descriptors(spark, sf_dir)
    m = d.filter("run = 'runA'").selectExpr("recording", "ordinal AS runA_frame", "CASE WHEN ordinal % 11 <> 5 THEN least(99, ordinal * 49 div 50 + ordinal % 3) END AS runB_frame")
    return close.closure(confirmed_pairs(spark, sf_dir), m, d.filter("run = 'runB'").select("recording", "ordinal", "v"), ["recording"], "recording long", 6, 40, 20, 12, 10)


# -- refinement

SIGNALS = f"""signals AS (SELECT {P}, list(luma ORDER BY ordinal) FILTER (run = 'runA') AS a, list(luma ORDER BY ordinal) FILTER (run = 'runB') AS b FROM frames GROUP BY ALL HAVING count(*) FILTER (run = 'runA') > 0 AND count(*) FILTER (run = 'runB') > 0)
"""
CENTRE = "CAST(round_even({0} * (len(b) - 1) / CAST(greatest(len(a) - 1, 1) AS DOUBLE), 0) AS BIGINT)"
SCORED = "list_sort(list_transform(range(greatest({0}, 0), least({1}, len(b) - 1) + 1), lambda x: {{'s': abs(a[{2} + 1] - b[x + 1]), 'x': x}}))"


@query(
    recursive(with_sql("frames")).rstrip() + ",\n" + SIGNALS.rstrip()
    + f""",
walk AS (SELECT {P}, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS floor_ FROM signals
  UNION ALL SELECT {P}, i, coalesce({SCORED.format("greatest(centre - 8, floor_)", "centre + 8", "i")}[1].x, floor_) FROM (SELECT w.{P.replace(", ", ", w.")}, w.i + 1 AS i, w.floor_, s.a, s.b, {CENTRE.format("(w.i + 1)")} AS centre FROM walk w JOIN signals s ON s.recording = w.recording AND s.camera = w.camera WHERE w.i + 1 < len(s.a)))
SELECT {P}, i AS "runA_frame", floor_ AS "runB_frame" FROM walk WHERE i >= 0"""
)
def ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement behind a non-decreasing floor."""
    return kernels.refined(adapter.frames(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma", "ratchet")


@query(
    recursive(with_sql("labels_v")).rstrip()
    + f""",
values_ AS (SELECT {P}, list_sort(list(DISTINCT runA_frame)) AS v FROM labels_v GROUP BY ALL),
walk AS (SELECT {P}, CAST(0 AS BIGINT) AS number, pick, list_transform(v, lambda x: abs(x - pick)) AS distance FROM (SELECT *, list_sort(list_transform(v, lambda x: {{'d': abs(2 * x - v[1] - v[-1]), 'x': x}}))[1].x AS pick FROM values_)
  UNION ALL SELECT {P}, number, pick, list_transform(range(len(v)), lambda i: least(distance[i + 1], abs(v[i + 1] - pick))) FROM (SELECT w.{P.replace(", ", ", w.")}, w.number + 1 AS number, w.distance, s.v, s.v[list_position(w.distance, list_max(w.distance))] AS pick FROM walk w JOIN values_ s ON s.recording = w.recording AND s.camera = w.camera WHERE list_max(w.distance) > 0))
SELECT {P}, number, pick AS "runA_frame" FROM walk"""
)
def farthest_point_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled frames, each farthest from those before it."""
    return kernels.farthest_first(adapter.labels(spark, sf_dir), PAIR, PAIR_SCHEMA, "runA_frame")


REPLAY = f"""{SIGNALS.rstrip()},
asked AS (SELECT m.{P.replace(", ", ", m.")}, runA_frame AS f, runB_frame AS submitted, row_number() OVER (PARTITION BY {P} ORDER BY runA_frame) AS n FROM mapping m JOIN signals USING ({P}) WHERE runB_frame IS NOT NULL AND runA_frame >= 40 AND runA_frame < 100),
begun AS (SELECT {P}, coalesce((SELECT runB_frame FROM mapping m WHERE m.recording = q.recording AND m.camera = q.camera AND m.runA_frame = q.f - 1), -1) AS last FROM asked q WHERE n = 1),
walk AS (SELECT {P}, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS coarse, CAST(NULL AS BIGINT) AS submitted, last AS replayed, CAST(NULL AS BIGINT) AS free, CAST(NULL AS DOUBLE) AS score_at_pick, CAST(NULL AS DOUBLE) AS score_at_free, CAST(NULL AS BIGINT) AS admissible, CAST(NULL AS BIGINT) AS candidates FROM begun
  UNION ALL SELECT {P}, n, f, centre, submitted, pick, all_[1].x, -list_filter(all_, lambda c: c.x = pick)[1].s, -all_[1].s, admissible, len(all_)
  FROM (SELECT *, coalesce(list_filter(all_, lambda c: c.x >= replayed)[1].x, greatest(centre, replayed)) AS pick, len(list_filter(all_, lambda c: c.x >= replayed)) AS admissible FROM (SELECT *, {SCORED.format("centre - 8", "centre + 8", "f")} AS all_ FROM
    (SELECT q.*, w.replayed, s.a, s.b, {CENTRE.format("q.f")} AS centre FROM walk w JOIN asked q ON q.recording = w.recording AND q.camera = w.camera AND q.n = w.n + 1 JOIN signals s ON s.recording = w.recording AND s.camera = w.camera)))),
replay AS (SELECT {P}, f AS "runA_frame", coarse, submitted, replayed, free, score_at_pick, score_at_free, admissible, candidates FROM walk WHERE n > 0)
"""
REPLAY_SQL = recursive(with_sql("frames", "mapping")).rstrip() + ",\n" + REPLAY


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.replayed(adapter.frames(spark, sf_dir), adapter.mapping(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma", 40, 100)


@query(REPLAY_SQL + "SELECT * REPLACE (round(score_at_pick, 6) AS score_at_pick, round(score_at_free, 6) AS score_at_free) FROM replay")
def mechanism_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refinement of a window replayed, beside what it would pick freely."""
    found = replay(spark, sf_dir)
    nan = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c)
    return found.select(*[nan(c) if c.startswith("score") else F.col(c) for c in found.columns])


@query(
    REPLAY_SQL.rstrip()
    + f""",
steps AS (SELECT *, runA_frame - lag(runA_frame) OVER w = 1 AS next, coarse - lag(coarse) OVER w AS c, submitted - lag(submitted) OVER w AS s, free - lag(free) OVER w AS u FROM replay WINDOW w AS (PARTITION BY {P} ORDER BY runA_frame))
SELECT {P}, count(*) AS frames, count(*) FILTER (replayed = submitted) AS matching, count(*) FILTER (replayed <> free) AS forced, count(*) FILTER (free < submitted) AS behind, quantile_cont(submitted - free, 0.5) FILTER (free < submitted) AS median_behind, round(quantile_cont(score_at_pick, 0.5) FILTER (free < submitted), 6) AS median_score_at_pick, round(quantile_cont(score_at_free, 0.5) FILTER (free < submitted), 6) AS median_score_at_free, min(admissible) AS least_admissible,
  max(c) FILTER (next) AS largest_coarse_step, max(s) FILTER (next) AS largest_submitted_step, max(u) FILTER (next) AS largest_free_step, count(*) FILTER (next AND c >= 6) AS coarse_jumps, count(*) FILTER (next AND s >= 6) AS submitted_jumps, count(*) FILTER (next AND u >= 6) AS free_jumps, min(submitted - coarse) AS least_residual, max(submitted - coarse) AS most_residual, count(*) FILTER (submitted - coarse >= 8) AS pinned FROM steps GROUP BY ALL"""
)
def mechanism_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replay says of each mapping's jumps."""
    found = replay(spark, sf_dir).withColumn("score_at_pick", F.when(~F.isnan("score_at_pick"), F.col("score_at_pick")))
    made = probe.summary(found, PAIR)
    return made.withColumn("median_score_at_pick", F.round("median_score_at_pick", 6)).withColumn("median_score_at_free", F.round("median_score_at_free", 6))


@query(
    recursive(with_sql("frames", "mapping", "methods")).rstrip() + ",\n" + REPLAY.rstrip()
    + f""",
scored AS (SELECT r.*, m.method, m.predicted, -abs(s.a[r.runA_frame + 1] - s.b[m.predicted + 1]) AS score FROM replay r JOIN methods m USING ({P}, runA_frame) JOIN signals s USING ({P}) WHERE m.predicted IS NOT NULL AND m.predicted BETWEEN 0 AND len(s.b) - 1),
steps AS (SELECT *, CASE WHEN runA_frame - lag(runA_frame) OVER w = 1 THEN predicted - lag(predicted) OVER w END AS step FROM scored WINDOW w AS (PARTITION BY {P}, method ORDER BY runA_frame))
SELECT {P}, method, count(*) AS frames, max(step) AS largest_step, count(*) FILTER (step >= 6) AS jumps, min(predicted - coarse) AS least_residual, max(predicted - coarse) AS most_residual, count(*) FILTER (predicted - coarse >= 8) AS pinned, round(quantile_cont(score, 0.5), 6) AS median_score, round(quantile_cont(score_at_pick, 0.5), 6) AS median_submitted_score, round(quantile_cont(score_at_free, 0.5), 6) AS median_free_score, count(*) FILTER (score >= score_at_pick) AS at_least_submitted, count(*) FILTER (predicted = free) AS equal_free FROM steps GROUP BY ALL"""
)
def other_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other mappings' picks in the window, scored on the same signals."""
    found = replay(spark, sf_dir).withColumn("score_at_pick", F.when(~F.isnan("score_at_pick"), F.col("score_at_pick")))
    made = probe.scored_others(adapter.methods(spark, sf_dir), found, adapter.frames(spark, sf_dir), PAIR, "luma")
    return made.select(*[F.round(c, 6).alias(c) if c.startswith("median") else F.col(c) for c in made.columns])


# -- paths and posteriors

#: Stands for infinity, where sums stay what they are.
FAR = "1e300"


def _soft(x: str) -> str:
    """The strided running mean of `smooth_similarity`, zeros beyond the ends."""
    near = " + ".join(f"(CASE WHEN i + ({d}) BETWEEN 0 AND len({x}) - 1 THEN {x}[i + ({d}) + 1] ELSE 0e0 END) * 0.2" for d in range(-2, 3))
    return f"list_transform(range(0, len({x}), 4), lambda i: {near})"


STRIDED = f"""{SIGNALS.rstrip()},
strided AS (SELECT {P}, {_soft("a")} AS x, {_soft("b")} AS y, len(b) / CAST(len(a) AS DOUBLE) AS slope FROM signals)
"""
MOVES_SQL = "[" + ", ".join(f"{{'r': {r}, 'c': {c}, 'p': {dynamic.SLOPE_WEIGHT} * abs(ln({c}.0 / {r}.0 / slope)) + {dynamic.SKIP_WEIGHT} * {r + c - 2}}}" for r, c in dynamic.MOVES) + "]"


@query(
    recursive(with_sql("frames")).rstrip() + ",\n" + STRIDED.rstrip()
    + f""",
moved AS (SELECT *, {MOVES_SQL} AS moves FROM strided),
walk AS (SELECT {P}, CAST(0 AS BIGINT) AS i, list_transform(range(len(y)), lambda j: CASE WHEN j = 0 THEN 1 - exp(-abs(x[1] - y[1]) / 20) ELSE {FAR} END) AS t1, list_transform(y, lambda z: {FAR}) AS t2, list_transform(y, lambda z: {FAR}) AS t3, [list_transform(y, lambda z: CAST(-1 AS INTEGER))] AS came FROM moved
  UNION ALL SELECT {P}, i, list_transform(best, lambda b: b.t), t1, t2, list_append(came, list_transform(best, lambda b: CAST(b.k AS INTEGER))) FROM (SELECT {P}, i, t1, t2, came, list_transform(reach, lambda o: CASE WHEN list_min(o) >= 1e299 THEN {{'t': {FAR}, 'k': -1}} ELSE {{'t': list_min(o), 'k': list_position(o, list_min(o)) - 1}} END) AS best FROM
    (SELECT w.{P.replace(", ", ", w.")}, w.i + 1 AS i, w.t1, w.t2, w.came, list_transform(range(len(m.y)), lambda j: list_transform(m.moves, lambda v: CASE WHEN j < v.c THEN {FAR} ELSE (CASE v.r WHEN 1 THEN w.t1 WHEN 2 THEN w.t2 ELSE w.t3 END)[j - v.c + 1] + v.r * (1 - exp(-abs(m.x[w.i + 2] - m.y[j + 1]) / 20)) + v.p END)) AS reach
      FROM walk w JOIN moved m ON m.recording = w.recording AND m.camera = w.camera WHERE w.i + 1 < len(m.x)))),
ends AS (SELECT {P}, max(i) AS last, arg_max(t1, i) AS t, arg_max(came, i) AS came FROM walk GROUP BY ALL),
back AS (SELECT {P}, CAST(0 AS BIGINT) AS n, last AS r, CAST(list_position(t, list_min(t)) - 1 AS BIGINT) AS c FROM ends WHERE list_min(t) < 1e299
  UNION ALL SELECT b.{P.replace(", ", ", b.")}, n + 1, r - [{", ".join(str(r) for r, _ in dynamic.MOVES)}][e.came[r + 1][c + 1] + 1], c - [{", ".join(str(c) for _, c in dynamic.MOVES)}][e.came[r + 1][c + 1] + 1] FROM back b JOIN ends e ON e.recording = b.recording AND e.camera = b.camera WHERE e.came[r + 1][c + 1] >= 0)
SELECT {P}, max(n) OVER (PARTITION BY {P}) - n AS position, r * 4 AS "row", c * 4 AS "column" FROM back"""
)
def dtw_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse monotone paths between the two runs."""
    return kernels.dtw(adapter.frames(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma")


_AROUND = f"list_transform(range(17), lambda j: CASE WHEN centre + j - 8 BETWEEN 0 AND len(b) - 1 THEN -abs(a[i + 1] - b[centre + j - 7]) ELSE -{FAR} END)"


@query(
    recursive(with_sql("frames")).rstrip() + ",\n" + SIGNALS.rstrip()
    + f""",
scored AS (SELECT {P}, i, centre, {_AROUND} AS s FROM (SELECT *, {CENTRE.format("i")} AS centre FROM (SELECT *, unnest(range(len(a))) AS i FROM signals))),
walk AS (SELECT {P}, i, centre, s AS total, [list_transform(s, lambda x: CAST(-1 AS INTEGER))] AS back FROM scored WHERE i = 0
  UNION ALL SELECT {P}, i, centre, list_transform(range(17), lambda j: list_max(reach[j + 1]) + s[j + 1]), list_append(back, list_transform(range(17), lambda j: CAST(list_position(reach[j + 1], list_max(reach[j + 1])) - 1 AS INTEGER))) FROM
    (SELECT {P}, i, centre, s, back, list_transform(range(17), lambda j: list_transform(range(17), lambda k: CASE WHEN up + j - k BETWEEN 0 AND {dynamic.MOST_STEP} THEN total[k + 1] - {dynamic.REFINE_WEIGHT} * abs(up + j - k - 1) ELSE -{FAR} END)) AS reach FROM
      (SELECT c.{P.replace(", ", ", c.")}, c.i, c.centre, c.s, w.total, w.back, c.centre - w.centre AS up FROM walk w JOIN scored c ON c.recording = w.recording AND c.camera = w.camera AND c.i = w.i + 1))),
ends AS (SELECT {P}, max(i) AS last, arg_max(total, i) AS total, arg_max(back, i) AS back FROM walk GROUP BY ALL),
traced AS (SELECT {P}, last AS i, CAST(list_position(total, list_max(total)) - 1 AS BIGINT) AS j FROM ends
  UNION ALL SELECT t.{P.replace(", ", ", t.")}, t.i - 1, e.back[t.i + 1][t.j + 1] FROM traced t JOIN ends e ON e.recording = t.recording AND e.camera = t.camera WHERE t.i > 0)
SELECT {P}, i AS "runA_frame", max(centre + j - 8) OVER (PARTITION BY {P} ORDER BY i) AS "runB_frame" FROM traced JOIN scored USING ({P}, i)"""
)
def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement by the best sequence of bounded steps."""
    return kernels.refined(adapter.frames(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma", "sloped")


_TAPS = [w / sum(dynamic.KERNEL) for w in dynamic.KERNEL]


def _stepped(x: str, sign: str) -> str:
    """A list convolved with the steps, forth (-) or back (+)."""
    return f"list_transform(range(len({x})), lambda j: " + " + ".join(f"(CASE WHEN j {sign} {k} BETWEEN 0 AND len({x}) - 1 THEN {x}[j {sign} {k} + 1] ELSE 0e0 END) * {w!r}" for k, w in enumerate(_TAPS)) + ")"


_ZIP = "list_transform(range(len({0})), lambda j: {1})"
LEAVE, RETURN = dynamic.LEAVE, dynamic.RETURN


@query(
    recursive(with_sql("frames")).rstrip() + ",\n" + STRIDED.rstrip()
    + f""",
alike AS (SELECT {P}, i, list_transform(y, lambda z: exp(-abs(x[i + 1] - z) / 20)) AS s FROM (SELECT *, unnest(range(len(x))) AS i FROM strided)),
spread AS (SELECT {P}, i, s, list_aggregate(s, 'median') AS m, list_aggregate(list_transform(s, lambda z: abs(z - list_aggregate(s, 'median'))), 'median') AS d FROM alike),
emitted AS (SELECT {P}, i, e, list_avg(e) AS absent FROM (SELECT {P}, i, list_transform(s, lambda z: exp(greatest(least((z - m) / greatest(1.4826 * d, 0.0001), 8), -8))) AS e FROM spread)),
forth AS (SELECT {P}, i, list_transform(m, lambda z: z / t) AS m, list_transform(g, lambda z: z / t) AS g, t FROM (SELECT *, list_sum(m) + list_sum(g) AS t FROM (SELECT {P}, i, list_transform(e, lambda z: z / len(e) * (1 - {LEAVE})) AS m, list_transform(e, lambda z: absent / len(e) * {LEAVE}) AS g FROM emitted WHERE i = 0))
  UNION ALL SELECT {P}, i, list_transform(m, lambda z: z / t), list_transform(g, lambda z: z / t), t FROM (SELECT *, list_sum(m) + list_sum(g) AS t FROM
    (SELECT {P}, i, {_ZIP.format("e", f"e[j + 1] * ((1 - {LEAVE}) * fm[j + 1] + {RETURN} * fg[j + 1])")} AS m, {_ZIP.format("e", f"absent * ({LEAVE} * fm[j + 1] + (1 - {RETURN}) * fg[j + 1])")} AS g FROM
      (SELECT n.{P.replace(", ", ", n.")}, n.i, n.e, n.absent, {_stepped("f.m", "-")} AS fm, {_stepped("f.g", "-")} AS fg FROM forth f JOIN emitted n ON n.recording = f.recording AND n.camera = f.camera AND n.i = f.i + 1)))),
aft AS (SELECT f.{P.replace(", ", ", f.")}, f.i, list_transform(f.m, lambda z: 1e0) AS bm, list_transform(f.m, lambda z: 1e0) AS bg FROM forth f JOIN (SELECT {P}, max(i) AS i FROM emitted GROUP BY ALL) l ON l.recording = f.recording AND l.camera = f.camera AND l.i = f.i
  UNION ALL SELECT {P}, i - 1, {_ZIP.format("nm", f"((1 - {LEAVE}) * nm[j + 1] + {LEAVE} * ng[j + 1]) / t")}, {_ZIP.format("nm", f"({RETURN} * nm[j + 1] + (1 - {RETURN}) * ng[j + 1]) / t")} FROM
    (SELECT {P}, i, t, {_stepped("em", "+")} AS nm, {_stepped("eg", "+")} AS ng FROM (SELECT b.{P.replace(", ", ", b.")}, b.i, f.t, {_ZIP.format("n.e", "n.e[j + 1] * b.bm[j + 1]")} AS em, list_transform(b.bg, lambda z: n.absent * z) AS eg FROM aft b JOIN emitted n ON n.recording = b.recording AND n.camera = b.camera AND n.i = b.i JOIN forth f ON f.recording = b.recording AND f.camera = b.camera AND f.i = b.i WHERE b.i > 0))),
posted AS (SELECT {P}, i, pm, list_sum(pm) + list_sum(pg) AS t, list_sum(pg) AS gone, list_position(pm, list_max(pm)) - 1 AS peak FROM (SELECT f.{P.replace(", ", ", f.")}, f.i, {_ZIP.format("f.m", "f.m[j + 1] * b.bm[j + 1]")} AS pm, {_ZIP.format("f.m", "f.g[j + 1] * b.bg[j + 1]")} AS pg FROM forth f JOIN aft b ON b.recording = f.recording AND b.camera = f.camera AND b.i = f.i))
SELECT {P}, i * 4 AS "row", peak * 4 AS "column", round("window", 6) AS "window", round(gone / t, 6) AS absent, gone / t <= 0.05 AND "window" >= 0.30 AS accepted FROM (SELECT *, list_sum(list_transform(range(greatest(peak - 2, 0), least(peak + 3, len(pm))), lambda j: pm[j + 1])) / t AS "window" FROM posted)"""
)
def forward_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the alignment, with an absent state."""
    found = kernels.posterior(adapter.frames(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma")
    return found.withColumn("window", F.round("window", 6)).withColumn("absent", F.round("absent", 6))
