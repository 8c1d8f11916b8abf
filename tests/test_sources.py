import json

import pytest
from pyspark.sql import functions as F

from kinetrack.sources import files


def test_metadata_first_place_wins_and_overrides(spark, tmp_path):
    for place, fps in (("a", 10), ("b", 20)):
        (tmp_path / place).mkdir()
        (tmp_path / place / "200101000000_x_meta.json").write_text(json.dumps({"fps": fps, "frame_height": None, "free": 1}))
    got = files.read_recordings(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], ["/b/", "/a/"], {"frame_width": 7}).collect()
    assert [(r.name, r.fps, r.frame_height, r.frame_width, str(r.recorded_at)) for r in got] == [("200101000000_x", 20.0, None, 7, "2020-01-01 00:00:00")]


def test_read_tracks_by_suffix_and_nan(spark, tmp_path):
    head = "TRACK_ID,POSITION_T,POSITION_X,POSITION_Y,WIDTH,HEIGHT,DEGREES_ANGLE,ILLUMINATION\n"
    (tmp_path / "r_list.csv").write_text(head + "1,0,1.5,NaN,2,5,0,\n")
    (tmp_path / "r_other.csv").write_text(head)
    got = files.read_tracks(spark, str(tmp_path)).collect()
    assert [(r.name, r.track_id, r.position_x, r.position_y) for r in got] == [("r", 1, 1.5, None)]


def test_stage_by_name(spark):
    names = ["a_analysed.csv", "a_statistics.csv", "a_selected_data.csv", "a_list.csv", "a.avi"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(files.classify_stage(F.col("n"))).collect()
    assert [r[0] for r in got] == ["finished", "finished", "evaluate", "select", "track"]


def test_overwrite_replaces_only_written_recordings(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "recording_id long, v double")
    files.write_stage(df, str(tmp_path), "stats")
    where = files.write_stage(df.where("recording_id = 1").withColumn("v", F.lit(9.0)), str(tmp_path), "stats", mode="overwrite")
    assert sorted((r.recording_id, r.v) for r in spark.read.parquet(where).collect()) == [(1, 9.0), (2, 2.0)]
    files.write_stage(df.select("recording_id", "v"), str(tmp_path), "x_statistics", "csv")


def test_statistics_of_a_folder_are_collated(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, rows in (("a_statistics.csv", "1,2.5\n2,\n"), ("deep/b_statistics.csv", "7,1.0\n"), ("c_list.csv", "9,9.0\n")):
        (tmp_path / name).write_text("track_id,speed_um_s\n" + rows)
    got = files.collate_statistics(spark, str(tmp_path), "track_id long, speed_um_s double").collect()
    assert sorted((r.file, r.track_id, r.speed_um_s) for r in got) == [("a", 1, 2.5), ("a", 2, None), ("b", 7, 1.0)]


def test_files_by_age(spark, tmp_path):
    import os

    for name, when in (("old_list.csv", 1_000_000_000), ("new_list.csv", 1_600_000_000)):
        (tmp_path / name).write_text("v\n1\n")
        os.utime(tmp_path / name, (when, when))
    count = lambda **k: files.find_files(spark, str(tmp_path), **k).option("header", True).csv(str(tmp_path)).count()
    assert count() == 2 and count(modified_after="2010-01-01T00:00:00") == 1 and count(modified_before="2010-01-01T00:00:00") == 1


def test_metadata_text_is_parsed(spark):
    got = spark.createDataFrame([('{"fps": 29.97, "frame_count": 7, "free": 1}',), ("no",), (None,)], "j string").select(files.parse_metadata("j").alias("m")).collect()
    assert (got[0].m.fps, got[0].m.frame_count, got[0].m.frame_width) == (29.97, 7, None) and got[1].m.fps is None and got[2].m is None


def test_what_tells_recordings_apart(spark, tmp_path):
    head = "TRACK_ID,POSITION_T,POSITION_X,POSITION_Y,WIDTH,HEIGHT,DEGREES_ANGLE,ILLUMINATION\n1,0,1,1,2,5,0,\n"
    for name in ("a/r_list.csv", "b/r_list.csv", "b/q_list.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(head)
    ids = {by: files.read_tracks(spark, str(tmp_path), by=by, recursive=True).select("recording_id").distinct().count() for by in ("name", "folder", "path")}
    assert ids == {"name": 2, "folder": 2, "path": 3}


def test_versions_stay_readable(spark, tmp_path):
    from kinetrack.sources import files

    first, second = (spark.createDataFrame([(r, v) for r in range(2)], "recording_id long, v long") for v in (1, 2))
    with pytest.raises(ValueError):
        files.read_version(spark, str(tmp_path), "stats")
    files.write_version(first, str(tmp_path), "stats", "a")
    files.write_version(second, str(tmp_path), "stats", "b")
    value = lambda **k: {x.v for x in files.read_version(spark, str(tmp_path), "stats", **k).collect()}
    assert value() == {2} and value(run_id="a") == {1}
    with pytest.raises(ValueError):
        files.write_version(first, str(tmp_path), "stats", "a")
    # A version that was not completed is not there, and may be written again.
    broken = second.withColumn("v", F.expr("raise_error('stopped')").cast("long"))
    with pytest.raises(Exception, match="stopped"):
        files.write_version(broken, str(tmp_path), "stats", "c")
    assert value() == {2}
    files.write_version(first, str(tmp_path), "stats", "c")
    assert value() == {1} and [x.number for x in files.versions(spark, str(tmp_path), "stats").orderBy("number").collect()] == [0, 1, 2]


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    from kinetrack.streaming import jobs

    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "recording_id long, v double")
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    jobs.write_batches(source, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    jobs.batch_writer(f"{tmp_path}/out")(rows, 0)  # as after a failure between the write and the checkpoint
    assert sorted(tuple(x)[:2] for x in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(map(tuple, rows.collect()))


def test_bucketed_tracks_need_no_exchange(spark, tmp_path):
    from kinetrack.operators import select
    from kinetrack.schemas import KEY

    rows = [(r, i, t, float(t * i), 1.0, 2.0, 5.0, 0.0) for r in range(3) for i in range(7) for t in range(12)]
    df = spark.createDataFrame(rows, "recording_id long, track_id long, position_t long, position_x double, position_y double, width double, height double, degrees_angle double").orderBy(F.rand(1))
    stored = files.write_bucketed(df, f"file://{tmp_path}", "bucketed_tracks", 4)
    try:
        # Windows, sums and a join by track, as the selection has them.
        moved = select.with_speed(select.with_track_area(stored))
        best = moved.groupBy(*KEY).agg(F.max("speed").alias("top"))
        found = moved.join(best, KEY)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Exchange range" not in plan and plan.count("Window") >= 3
        want = select.with_speed(select.with_track_area(df)).join(select.with_speed(select.with_track_area(df)).groupBy(*KEY).agg(F.max("speed").alias("top")), KEY)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))
        assert len(list((tmp_path / "bucketed_tracks").glob("part-*"))) <= 4
    finally:
        spark.sql("DROP TABLE bucketed_tracks")
