"""Reading and writing of track tables, metadata and results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import recorded_at
from ..schemas import KEY, METADATA, TRACKS_CSV

#: Endings that later stages add to a recording's name. Fixed values.
SUFFIXES = ("_list.csv", "_selected_data.csv", "_analysed.csv", "_statistics.csv", "_meta.json")


def base_name(file_name: Column) -> Column:
    """A recording's name: its file's name without a stage suffix or ending."""
    pattern = "(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + r"|\.[^.]*)$"
    return F.regexp_replace(file_name, pattern, "")


def find_files(spark: SparkSession, paths: str | list[str], suffix: str = "_list.csv", recursive: bool = False, modified_after: str | None = None, modified_before: str | None = None):
    """A reader for files by ending, depth and time of modification."""
    reader = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    return reader


def identity(by: str) -> Column:
    """A file's recording: its ``name``, its ``folder`` (of several part files) or its ``path`` (folder and name)."""
    folder, name = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""), base_name(F.col("_metadata.file_name"))
    return F.xxhash64(*{"name": [name], "folder": [folder], "path": [folder, name]}[by])


def read_tracks(spark: SparkSession, paths: str | list[str], suffix: str = "_list.csv", by: str = "name", **which) -> DataFrame:
    """Track tables of many recordings with a fixed schema; NaN becomes NULL, the recording's name comes from the file.

    ``by`` says what tells recordings apart (see ``identity``): names that recur in several folders need ``path``,
    recordings in several part files ``folder``.
    """
    raw = find_files(spark, paths, suffix, **which).schema(TRACKS_CSV).option("header", True).option("enforceSchema", False).csv(paths)
    raw = raw.select(identity(by).alias("recording_id"), base_name(F.col("_metadata.file_name")).alias("name"), "*")
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c, t in raw.dtypes if t == "double"}
    return raw.withColumns(clean).toDF(*[c.lower() for c in raw.columns])


def read_recordings(spark: SparkSession, paths: str | list[str], priority: list[str] | None = None, overrides: dict | None = None, by: str = "name", recursive: bool = False, ending: str = "_meta.json") -> DataFrame:
    """Metadata sidecars, one row per recording: of several places the first in ``priority`` wins, overrides win over all.

    ``by`` says what tells recordings apart, as in ``read_tracks``, so that both have the same ids: with ``folder`` or
    ``path`` a recording's sidecar lies where its tracks lie.
    """
    raw = spark.read.schema(METADATA).option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", recursive).option("multiLine", True).json(paths)
    path = F.col("_metadata.file_path")
    rank = F.coalesce(*[F.when(path.contains(p), F.lit(i)) for i, p in enumerate(priority or [])], F.lit(len(priority or [])))
    raw = raw.select(identity(by).alias("recording_id"), F.struct(rank.alias("rank"), path.alias("path")).alias("at"), F.struct(base_name(F.col("_metadata.file_name")).alias("name"), "fps", "frame_height", "frame_width", "frame_count").alias("m"))
    one = raw.groupBy("recording_id").agg(F.min_by("m", "at").alias("m")).select("recording_id", "m.*")
    for c, v in (overrides or {}).items():
        one = one.withColumn(c, F.coalesce(F.lit(v), F.col(c)).cast(one.schema[c].dataType))
    return one.select("recording_id", "name", recorded_at(F.col("name")).alias("recorded_at"), "fps", "frame_height", "frame_width", "frame_count")


def parse_metadata(json: str | Column) -> Column:
    return F.from_json(json, METADATA)


def classify_stage(path: Column) -> Column:
    """What is left to do for a file: nothing, evaluation, selection or tracking."""
    done = path.contains("_analysed.csv") | path.contains("_statistics.csv") | path.contains("_annotated_output.")
    return F.when(done, "finished").when(path.contains("selected_data.csv"), "evaluate").when(path.contains(".csv"), "select").otherwise("track")


def by_folder(df: DataFrame, folder: str = "recording_id") -> DataFrame:
    """Rows gathered by the column that names their folder: one file each, more for a folder above the advised size.

    Else every task leaves a file in every folder, and their number grows with the square of the table.
    """
    return df.hint("rebalance", folder)


def write_stage(df: DataFrame, path: str, stage: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write a stage's table by recording. ``overwrite`` replaces only the recordings that are written."""
    where = f"{path.rstrip('/')}/{stage}"
    writer = by_folder(df).write.partitionBy("recording_id").mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.option("header", True).csv(where) if fmt == "csv" else writer.format(fmt).save(where))
    return where


def write_bucketed(df: DataFrame, path: str, table: str, buckets: int) -> DataFrame:
    """Store rows of tracks as the catalog's ``table`` below ``path``, bucketed and sorted by recording and track.

    Windows, aggregations and joins by track on the table that is returned need no exchange. A bucket is one file.
    """
    spark, keys = df.sparkSession, [*KEY, "position_t"]
    dealt = df.repartition(buckets, *KEY).sortWithinPartitions(*keys)
    dealt.write.bucketBy(buckets, *KEY).sortBy(*keys).option("path", f"{path.rstrip('/')}/{table}").mode("overwrite").saveAsTable(table)
    return spark.table(table)


def write_version(df: DataFrame, path: str, stage: str, run_id: str) -> None:
    """Write a stage's table as the version ``run_id``, next to earlier ones.

    The version counts once the table is complete and a row that names it has been added to the list of versions, in one
    commit; until then, and if the writing fails, readers see the version before. A version is written once.
    """
    spark, where = df.sparkSession, f"{path.rstrip('/')}/{stage}"
    before = versions(spark, path, stage)
    if not before.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"version {run_id} is there already")
    by_folder(df).write.partitionBy("recording_id").mode("overwrite").parquet(f"{where}/run={run_id}")
    number = before.agg(F.max("number")).first()[0]
    row = spark.createDataFrame([(run_id, 0 if number is None else number + 1)], VERSIONS).withColumn("written_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{where}/versions")


#: Columns of the list of versions.
VERSIONS = "run_id string, number long"


def versions(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """``run_id, number, written_at`` of the versions of a stage; none if nothing has been written."""
    where, schema = f"{path.rstrip('/')}/{stage}", VERSIONS + ", written_at timestamp"
    try:
        return spark.read.schema(schema).parquet(f"{where}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str, stage: str, run_id: str | None = None) -> DataFrame:
    """A stage's table in the version ``run_id``, or in the latest one."""
    known = versions(spark, path, stage)
    found = known.where(F.col("run_id") == run_id) if run_id else known.orderBy(F.desc("number"), F.desc("written_at")).limit(1)
    rows = found.collect()
    if not rows:
        raise ValueError(f"no version {run_id or ''} of {stage}")
    raw = spark.read.parquet(f"{path.rstrip('/')}/{stage}/run={rows[0]['run_id']}")
    return raw.withColumn("recording_id", F.col("recording_id").cast("long"))


def collate_statistics(spark: SparkSession, folder: str, schema: str, pattern: str = "*statistics*.csv") -> DataFrame:
    """The statistics files of a folder as one table, each row with its file's name."""
    raw = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).csv(folder)
    return raw.select("*", base_name(F.col("_metadata.file_name")).alias("file"))
