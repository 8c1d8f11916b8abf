"""Track tables derived from the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..settings import Settings
from ..sources.tables import dealt

TRACKS = """
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
           l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn
  FROM lineitem),
s AS (
  SELECT CAST(l_suppkey % 4 + 4 * floor(l_suppkey / 100) AS BIGINT) AS recording_id, l_suppkey AS track_id, rn,
    CASE WHEN rn = 1 THEN 0 WHEN l_partkey % 193 = 0 THEN 9 WHEN l_partkey % 29 = 0 THEN 2 ELSE 1 END AS dt,
    CASE WHEN l_suppkey % 3 = 0 THEN 0
         WHEN l_suppkey % 3 = 1 THEN CAST(l_quantity AS BIGINT) - 25
         ELSE CAST(l_quantity AS BIGINT) - 25
              + CASE WHEN CAST(floor(rn / 90.0) AS BIGINT) % 2 = 0 THEN 60 ELSE -60 END END
      + CASE WHEN l_partkey % 97 = 0 AND l_suppkey % 5 = 0 THEN 900 ELSE 0 END AS sx,
    CASE WHEN l_suppkey % 3 = 0 THEN 0
         WHEN l_suppkey % 3 = 1 THEN l_partkey % 51 - 25
         ELSE l_partkey % 51 - 25
              + CASE WHEN CAST(floor(rn / 60.0) AS BIGINT) % 2 = 0 THEN 60 ELSE -60 END END AS sy,
    CASE WHEN l_partkey % 37 = 0 THEN 0
         ELSE (250 + CAST(round(l_discount * 100) AS BIGINT) * 20) * CASE WHEN l_partkey % 41 = 0 THEN 2 ELSE 1 END END AS w100,
    CASE WHEN l_partkey % 37 = 0 THEN 0
         ELSE 600 + CAST(round(l_tax * 100) AS BIGINT) * 20 + 60 * (l_suppkey % 7) END AS h100,
    CAST(l_partkey % 90 AS DOUBLE) AS degrees_angle
  FROM o)
SELECT recording_id, track_id,
  CAST(sum(dt) OVER c AS BIGINT) AS position_t,
  CAST(1000 + 100 * ((track_id * 37) % 1200) + sum(sx) OVER c AS DOUBLE) / 1e2 AS position_x,
  CAST(1000 + 100 * ((track_id * 53) % 900) + sum(sy) OVER c AS DOUBLE) / 1e2 AS position_y,
  CAST(w100 AS DOUBLE) / 1e2 AS width, CAST(h100 AS DOUBLE) / 1e2 AS height, degrees_angle
FROM s
WINDOW c AS (PARTITION BY track_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

#: Metadata of the recordings that have some; one in five has none.
RECORDINGS = """
SELECT recording_id,
  CASE recording_id % 4 WHEN 0 THEN '191224133700_a' || CAST(recording_id AS VARCHAR(9)) || '_selected data' WHEN 1 THEN '200101000000_b' || CAST(recording_id AS VARCHAR(9))
    WHEN 2 THEN 'sample_c' || CAST(recording_id AS VARCHAR(9)) ELSE '210630235959 d' || CAST(recording_id AS VARCHAR(9)) END AS name,
  CAST(CASE recording_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 29.97 WHEN 3 THEN 25 END AS DOUBLE) AS fps,
  922 AS frame_height, CASE WHEN recording_id % 4 <> 2 THEN 1228 END AS frame_width,
  CAST(CASE recording_id % 4 WHEN 0 THEN 9000 WHEN 1 THEN 700 WHEN 2 THEN 600 ELSE 599 END AS BIGINT) AS frame_count
FROM (SELECT DISTINCT CAST(l_suppkey % 4 + 4 * floor(l_suppkey / 100) AS BIGINT) AS recording_id FROM lineitem) AS r
WHERE recording_id % 5 <> 2
"""

FRAME_STATS = """
SELECT l_suppkey AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
  l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS frame,
  CAST(l_quantity AS DOUBLE) AS grey_mean, CAST(round(l_tax * 100) AS DOUBLE) AS grey_std
FROM lineitem
"""

#: Every branch has rows with these.
SETTINGS = Settings(minimal_length_s=5, limit_length_s=5, max_empty_percent=9, ratio_bounds=(0.30, 0.67))


def _over(spark: SparkSession, sf_dir: str, sql: str, by_track: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=dealt(rows, "l_suppkey") if by_track else rows)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, TRACKS, by_track=True)


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, FRAME_STATS)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, RECORDINGS)


def detections(rows: DataFrame) -> DataFrame:
    """The positions of all tracks without their ids, as detections."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("recording_id", "position_t").orderBy("track_id")
    seen = rows.where("width > 0").withColumn("det_id", F.row_number().over(w).cast("long"))
    return seen.select("recording_id", F.col("position_t").alias("frame"), "det_id", F.col("position_x").alias("x"), F.col("position_y").alias("y"), "width", "height", "degrees_angle")
