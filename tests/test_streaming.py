"""Carry-over state, gaps and the sink, over a file stream."""

import pytest

from iqlake.streaming import capture

SCHEMA = "source_id string, n long, value double"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, batches, on_gap="restart"):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in batches:
        write(spark, src, rows)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = capture.write_batches(capture.frames_with_carry(stream, 4, on_gap), out, f"{tmp_path}/check")
    assert q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return sorted((r.source_id, r.frame_start, r.power, r.lost) for r in spark.read.parquet(out).collect())


def test_frames_cross_batches(spark, tmp_path):
    rows = [("a", n, 2.0) for n in range(10)]
    assert run(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]]) == [("a", 0, 4.0, 0), ("a", 4, 4.0, 0)]


def test_a_gap_restarts_the_frame(spark, tmp_path):
    rows = [("a", n, 1.0) for n in [0, 1, 5, 6, 7, 8]]
    assert run(spark, tmp_path, [rows]) == [("a", 5, 1.0, 3)]


def test_late_and_repeated_samples_are_counted(spark, tmp_path):
    rows = [("a", n, 1.0) for n in [0, 1, 2, 2, 3, 4]]
    assert run(spark, tmp_path, [rows, [("a", 1, 9.0), ("a", 5, 1.0), ("a", 6, 1.0), ("a", 7, 1.0)]]) == [("a", 0, 1.0, 0), ("a", 4, 1.0, 0)]
    late = {r.frame_start: r.late for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert late == {0: 1, 4: 1}


def test_a_gap_can_fail_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, [[("a", 0, 1.0), ("a", 2, 1.0)]], "except")
