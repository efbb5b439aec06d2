import datetime as dt
import os

from hunkyard.streaming.queue import running_latest, span_windows

T = dt.datetime(2025, 1, 1)
SPANS = "span_id string, name string, status string, exported_at timestamp"


def run(df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def source(spark, folder, batches):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SPANS).coalesce(1).write.parquet(str(folder / f"{i}"))
        for f in (folder / f"{i}").iterdir():
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    m = dt.timedelta(minutes=1)
    s = source(spark, tmp_path / "in", [[("a", "n", "ok", T), ("b", "n", "error", T + m)], [("c", "n", "ok", T + 600 * m)], [("e", "n", "ok", T + 600 * m)], [("late", "n", "ok", T + 2 * m), ("d", "n", "ok", T + 601 * m)]])
    run(span_windows(s), "span_windows_out", "append", tmp_path / "cp")
    got = {(r.window.start, r.name): (r.spans, r.errors) for r in spark.sql("select * from span_windows_out").collect()}
    assert got[T, "n"] == (2, 1)


def test_redeliveries_are_dropped(spark, tmp_path):
    s = source(spark, tmp_path / "in", [[("a", "n", "ok", T), ("a", "n", "ok", T)], [("a", "n", "ok", T), ("b", "n", "ok", T)]])
    run(running_latest(s, "span_id", "exported_at"), "dedup_out", "append", tmp_path / "cp")
    assert sorted(r.span_id for r in spark.sql("select * from dedup_out").collect()) == ["a", "b"]
