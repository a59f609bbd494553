"""Sessions, overlapping windows, and export over restarts."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import export
from tidemark.streaming import windows as streaming

SCHEMA = "user string, ts timestamp, value double"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def feed(spark, folder, batches):
    """A stream of one file a batch."""
    (folder / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"w{n}"))
        part = next((folder / f"w{n}").glob("*.parquet"))
        os.utime(part, (time.time() - 100 + n,) * 2)
        part.rename(folder / "in" / f"{n}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_sessions_merge_end_by_watermark_and_drop_late_rows(spark, tmp_path):
    batches = [
        [("a", at(0), 1.0), ("a", at(20), 2.0), ("b", at(5), 9.0), (None, at(5), 4.0), ("a", None, 7.0)],
        [("a", at(10), 5.0)],  # stands between two sessions, and joins them: 0, 10, 20
        [("c", at(200), 1.0)],
        [("e", at(201), 1.0)],  # a watermark bears on late rows from the second batch after it on
        [("a", at(12), 99.0), ("c", at(211), 1.0)],  # later than the watermark; a minute more than the gap
        [("d", at(400), 0.0)],
    ]
    s = streaming.session_states(feed(spark, tmp_path, batches), "ts", "value", 600, keys=["user"])
    streaming.run_available(s, lambda b, n: export.export_batch(b, n, str(tmp_path / "out")), "append", str(tmp_path / "log"))
    start = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = {(r.user, (r.first_us - start) // 60_000_000, (r.last_us - start) // 60_000_000, r.rows, r.maximum) for r in export.exported(spark, str(tmp_path / "out"), s.schema).collect()}
    assert got == {("a", 0, 20, 3, 5.0), ("b", 5, 5, 1, 9.0), (None, 5, 5, 1, 4.0), ("c", 200, 200, 1, 1.0), ("c", 211, 211, 1, 1.0), ("e", 201, 201, 1, 1.0)}


def test_overlapping_windows_hold_each_row_in_every_one(spark, tmp_path):
    s = streaming.window_states(feed(spark, tmp_path, [[("a", at(65), 50.0), ("a", at(95), 1.0)], [("a", at(999), 0.0)]]), "ts", "value", 3600, 30.0, slide=1800)
    streaming.run_available(s, lambda b, n: export.export_batch(b, n, str(tmp_path / "out")), "append", str(tmp_path / "log"))
    first = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp()) // 1800
    got = {(r.window_id - first, r.rows, r.maximum, r.cnt) for r in export.exported(spark, str(tmp_path / "out"), s.schema).collect()}
    assert got == {(1, 1, 50.0, 1), (2, 2, 50.0, 1), (3, 1, 1.0, 0)}


@pytest.mark.parametrize("stop", ["before the mark", "after the mark"])
def test_a_stopped_export_resumes_with_every_row_once(spark, tmp_path, monkeypatch, stop):
    from pyspark.errors import PySparkException

    stream = feed(spark, tmp_path, [[("a", at(n), float(n))] for n in range(4)])
    out, log, real, fails = str(tmp_path / "out"), str(tmp_path / "log"), export.mark, [2]

    def mark(session, folder, batch):
        if stop == "after the mark":
            real(session, folder, batch)
        if batch in fails:
            fails.remove(batch)
            raise RuntimeError("stopped")
        real(session, folder, batch)

    monkeypatch.setattr(export, "mark", mark)
    run = lambda: streaming.run_available(stream, lambda b, n: export.export_batch(b, n, out), "append", log)
    assert export.exported(spark, out, stream.schema).count() == 0
    with pytest.raises(PySparkException):
        run()
    assert export.committed(spark, out) == ([0, 1] if stop == "before the mark" else [0, 1, 2])
    run()
    assert sorted(r.value for r in export.exported(spark, out, stream.schema).collect()) == [0.0, 1.0, 2.0, 3.0]
    # A batch that comes again after its mark is left as it is.
    export.export_batch(spark.createDataFrame([("z", at(0), 99.0)], SCHEMA), 1, out)
    assert export.exported(spark, out, stream.schema).agg(F.max("value")).first()[0] == 3.0
