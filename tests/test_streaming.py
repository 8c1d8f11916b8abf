import duckdb
from pyspark.sql import functions as F

from kinetrack.plans import queries
from kinetrack.streaming import jobs


def test_a_whole_mean_is_not_cut_to_the_one_below(spark, tmp_path):
    # As doubles in this order the mean of v + 1 + 2 is 5.999999999999999.
    values = [2.93, 5.11, 1.08, 2.88]
    rows = spark.createDataFrame([(1, v, 1.0) for v in values], "recording_id long, grey_mean double, grey_std double").coalesce(1)
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(100)))
    got = jobs.threshold_stream(rows, 2.0).collect()
    assert len(got) == 5 and {r.threshold for r in got} == {6}
    missing = jobs.threshold_stream(rows.withColumn("grey_mean", F.lit(None).cast("double")), 2.0).collect()
    assert {r.threshold for r in missing} == {None}
    # The SQL states the same.
    rows = ", ".join(f"({i}, 1, TIMESTAMP '2024-01-01 00:00:00', {v})" for i, v in enumerate(values))
    sql = f"WITH events(event_id, user_id, ts, value) AS (VALUES {rows}, (9, 2, TIMESTAMP '2024-01-01 01:00:00', 1.0)) {queries.ORACLES['t8_threshold_stream']}"
    assert {r[2] for r in duckdb.sql(sql).fetchall() if r[0] == 1} == {6}
