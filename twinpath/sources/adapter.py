"""The driver's tables as recordings of one path, and the same views as SQL.

Fifty users make a recording; parity of the event is the run and parity of the
user the camera. The number of recordings grows with the data and the length of
a recording does not, so everything that is ordered within a recording stays a
task's work at any scale.

Each view exists twice: as a DataFrame, and as the text of a common table
expression for the oracle. `with_sql("a", "b")` gives the expressions needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores

USERS = 50
P99_FLOOR = 8.0
STREAM = ["recording", "run", "camera"]
PAIR = ["recording", "camera"]

SQL: dict[str, str] = {}


def with_sql(*names: str) -> str:
    """WITH and the named views, each after those that it reads."""
    done: list[str] = []

    def need(name: str) -> None:
        for other in SQL:
            if other != name and f" {other}" in SQL[name].replace("\n", " ").replace("(", " ").replace(",", " ") and other not in done:
                need(other)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in done) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL["frames"] = f"""SELECT CAST(user_id // {USERS} AS BIGINT) AS recording, CASE WHEN event_id % 2 = 1 THEN 'runB' ELSE 'runA' END AS run,
  CASE WHEN user_id % 2 = 1 THEN 'cam5' ELSE 'cam0' END AS camera,
  row_number() OVER (PARTITION BY user_id // {USERS}, event_id % 2, user_id % 2 ORDER BY ts, event_id) - 1 AS ordinal,
  value AS luma, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS p99, ts, event_type FROM events"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, run, camera, ordinal, luma, p99, ts, event_type)."""
    events = table(spark, sf_dir, "events")
    named = events.select(
        F.floor(F.col("user_id") / USERS).cast("bigint").alias("recording"),
        F.when(F.col("event_id") % 2 == 1, "runB").otherwise("runA").alias("run"),
        F.when(F.col("user_id") % 2 == 1, "cam5").otherwise("cam0").alias("camera"),
        "event_id",
        F.col("value").alias("luma"),
        F.get_json_object("props", "$.k").cast("double").alias("p99"),
        "ts",
        "event_type",
    )
    order = Window.partitionBy(*STREAM).orderBy("ts", "event_id")
    return named.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint")).select(*STREAM, "ordinal", "luma", "p99", "ts", "event_type")


SQL["flags"] = f"SELECT recording, run, camera, ordinal, luma, p99, CASE WHEN luma < 12 OR p99 < {P99_FLOOR} THEN 'too_dark' ELSE 'ok' END AS flag FROM frames"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, run, camera, ordinal, luma, p99, flag)."""
    return frames(spark, sf_dir).select(*STREAM, "ordinal", "luma", "p99", scores.exposure_flag(F.col("luma"), F.col("p99"), p99_floor=P99_FLOOR).alias("flag"))


SQL["lengths"] = "SELECT recording, camera, count(*) FILTER (run = 'runA') AS n_a, count(*) FILTER (run = 'runB') AS n_b FROM frames GROUP BY recording, camera"
SQL["decisions"] = """SELECT f.recording, f.camera, f.ordinal AS runA_frame, n_a, n_b, f.flag,
  LEAST(n_b - 1, GREATEST(0, ((f.ordinal - CASE WHEN f.ordinal % 60 < 5 THEN f.ordinal % 60 ELSE 0 END) * n_b) // (n_a + 60) + 6 * (f.ordinal // 180) + CASE WHEN f.camera = 'cam5' THEN (f.ordinal // 37) % 3 ELSE 0 END)) AS candidate,
  [((f.ordinal * 7 + 3) % 50 - 3) / 50.0, ((f.ordinal * 11 + 5) % 60 - 4) / 60.0, ((f.ordinal * 13 + 1) % 70 - 2) / 70.0, ((f.ordinal * 17 + 7) % 80 - 3) / 80.0] AS margins,
  f.ordinal < 20 OR f.ordinal >= n_a - 20 AS idle, f.ordinal % 12 = 0 AS checked, (f.ordinal * 31) % 100 < 85 AS geometry
  FROM flags f JOIN lengths USING (recording, camera) WHERE f.run = 'runA'"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each frame of run A: its candidate in run B and the evidence for it, by arithmetic on the ordinal."""
    f = flags(spark, sf_dir)
    lengths = f.groupBy(*PAIR).agg(F.count(F.when(F.col("run") == "runA", 1)).alias("n_a"), F.count(F.when(F.col("run") == "runB", 1)).alias("n_b"))
    rows = f.filter("run = 'runA'").join(lengths, PAIR).withColumnRenamed("ordinal", "runA_frame")
    return rows.selectExpr(
        *PAIR, "runA_frame", "n_a", "n_b", "flag",
        """least(n_b - 1, greatest(0, ((runA_frame - CASE WHEN runA_frame % 60 < 5 THEN runA_frame % 60 ELSE 0 END) * n_b) div (n_a + 60) + 6 * (runA_frame div 180) + CASE WHEN camera = 'cam5' THEN (runA_frame div 37) % 3 ELSE 0 END)) AS candidate""",
        """array(((runA_frame * 7 + 3) % 50 - 3) / 50.0D, ((runA_frame * 11 + 5) % 60 - 4) / 60.0D, ((runA_frame * 13 + 1) % 70 - 2) / 70.0D, ((runA_frame * 17 + 7) % 80 - 3) / 80.0D) AS margins""",
        "runA_frame < 20 OR runA_frame >= n_a - 20 AS idle", "runA_frame % 12 = 0 AS checked", "(runA_frame * 31) % 100 < 85 AS geometry",
    )


SQL["mapping"] = """SELECT recording, camera, runA_frame, n_a, n_b, candidate,
  CASE WHEN idle THEN 'idle' WHEN flag = 'too_dark' AND runA_frame % 3 = 0 THEN 'too_dark' WHEN runA_frame % 53 = 0 THEN 'sequence_failed' ELSE 'accepted' END AS status,
  CASE WHEN idle OR (flag = 'too_dark' AND runA_frame % 3 = 0) OR runA_frame % 53 = 0 THEN NULL ELSE candidate END AS runB_frame,
  CASE runA_frame % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.67 WHEN 2 THEN 0.5 ELSE 0.33 END AS confidence FROM decisions"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, camera, runA_frame, n_a, n_b, candidate, status, runB_frame, confidence)."""
    status = "CASE WHEN idle THEN 'idle' WHEN flag = 'too_dark' AND runA_frame % 3 = 0 THEN 'too_dark' WHEN runA_frame % 53 = 0 THEN 'sequence_failed' ELSE 'accepted' END"
    made = decisions(spark, sf_dir).selectExpr(*PAIR, "runA_frame", "n_a", "n_b", "candidate", f"{status} AS status", "CASE runA_frame % 4 WHEN 0 THEN 1.0D WHEN 1 THEN 0.67D WHEN 2 THEN 0.5D ELSE 0.33D END AS confidence")
    return made.withColumn("runB_frame", F.when(F.col("status") == "accepted", F.col("candidate")))


SQL["labels_v"] = """SELECT recording, camera, runA_frame, concat(recording, '-', camera, '-', runA_frame) AS query_id,
  CASE (runA_frame // 10) % 9 WHEN 7 THEN 'no_correspondence' WHEN 8 THEN 'undetermined' ELSE 'match' END AS label,
  CASE (runA_frame // 10) % 4 WHEN 0 THEN 'occlusion' WHEN 1 THEN 'dark' WHEN 2 THEN 'kink' ELSE 'corridor' END AS stratum,
  candidate + (runA_frame * 13) % 7 - 3 AS low, candidate + (runA_frame * 13) % 7 - 3 + runA_frame % 3 AS high,
  candidate + (runA_frame * 13) % 7 - 3 + (runA_frame % 3) // 2 AS preferred FROM decisions WHERE NOT idle"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, camera, runA_frame, query_id, label, stratum, low, high, preferred): closed intervals of right answers."""
    return decisions(spark, sf_dir).filter("NOT idle").selectExpr(
        *PAIR, "runA_frame", "concat(recording, '-', camera, '-', runA_frame) AS query_id",
        "CASE (runA_frame div 10) % 9 WHEN 7 THEN 'no_correspondence' WHEN 8 THEN 'undetermined' ELSE 'match' END AS label",
        "CASE (runA_frame div 10) % 4 WHEN 0 THEN 'occlusion' WHEN 1 THEN 'dark' WHEN 2 THEN 'kink' ELSE 'corridor' END AS stratum",
        "candidate + (runA_frame * 13) % 7 - 3 AS low", "candidate + (runA_frame * 13) % 7 - 3 + runA_frame % 3 AS high",
        "candidate + (runA_frame * 13) % 7 - 3 + (runA_frame % 3) div 2 AS preferred",
    )


SQL["methods"] = """SELECT 'shipped' AS method, recording, camera, runA_frame, runB_frame AS predicted FROM mapping
  UNION ALL SELECT 'ungated', recording, camera, runA_frame, candidate FROM mapping
  UNION ALL SELECT 'prior', recording, camera, runA_frame, CAST(round_even(CAST(runA_frame AS DOUBLE) / (n_a - 1) * (n_b - 1), 0) AS BIGINT) FROM mapping"""


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, recording, camera, runA_frame, predicted): three mappings of the same frames, from one scan."""
    m = mapping(spark, sf_dir)
    prior = scores.linear_prior(F.col("runA_frame"), F.lit(0), F.col("n_a") - 1, F.lit(0), F.col("n_b") - 1)
    each = F.array(*[F.struct(F.lit(n).alias("method"), c.alias("predicted")) for n, c in (("shipped", F.col("runB_frame")), ("ungated", F.col("candidate")), ("prior", prior))])
    return m.select(*PAIR, "runA_frame", F.explode(each).alias("m")).select("m.method", *PAIR, "runA_frame", "m.predicted")


VECTORS = 200
SQL["descriptors"] = f"SELECT vec_id // {VECTORS} AS recording, CASE WHEN vec_id % 2 = 1 THEN 'runB' ELSE 'runA' END AS run, vec_id % {VECTORS} // 2 AS ordinal, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, run, ordinal, v): vectors in two runs; two hundred make a recording, so a block of pairs is bounded."""
    return table(spark, sf_dir, "embeddings").selectExpr(f"vec_id div {VECTORS} AS recording", "CASE WHEN vec_id % 2 = 1 THEN 'runB' ELSE 'runA' END AS run", f"vec_id % {VECTORS} div 2 AS ordinal", "CAST(embedding AS array<double>) AS v")


SQL["matched"] = """SELECT CAST(l_suppkey // 20 AS BIGINT) AS recording, CASE WHEN l_suppkey % 2 = 1 THEN 'cam5' ELSE 'cam0' END AS camera, CAST(l_orderkey % 24 AS BIGINT) AS a, CAST(l_orderkey % 24 + l_partkey % 7 - 3 AS BIGINT) AS b,
  l_extendedprice % 896 AS ax, l_quantity * 13 % 672 AS ay, l_extendedprice % 896 + 4.5 * (l_partkey % 7 - 3) + ((l_linenumber * 5 + l_partkey) % 11 - 5) / 4.0 + (l_orderkey % 24) / 50.0 AS bx, l_quantity * 13 % 672 + ((l_partkey * 3) % 9 - 4) / 2.0 AS "by" FROM lineitem"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, camera, a, b, ax, ay, bx, by): matched points of frame a of run A and frame b of run B; twenty suppliers make a recording."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey div 20 AS recording", "CASE WHEN l_suppkey % 2 = 1 THEN 'cam5' ELSE 'cam0' END AS camera", "l_orderkey % 24 AS a", "l_orderkey % 24 + l_partkey % 7 - 3 AS b",
        "l_extendedprice % 896 AS ax", "l_quantity * 13 % 672 AS ay", "l_extendedprice % 896 + 4.5D * (l_partkey % 7 - 3) + ((l_linenumber * 5 + l_partkey) % 11 - 5) / 4.0D + (l_orderkey % 24) / 50.0D AS bx", "l_quantity * 13 % 672 + ((l_partkey * 3) % 9 - 4) / 2.0D AS by",
    )
