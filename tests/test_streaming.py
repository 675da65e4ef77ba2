"""Structured Streaming jobs equal their batch twins (availableNow)."""

import os
import shutil

from pyspark.sql import functions as F

from lexspark.operators.monitor import window_quality
from lexspark.operators.preprocess import preprocess
from lexspark.streaming import jobs
from tests.conftest import SF0001


def test_stream_documents_equals_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    texts = {"a.txt": "Mr. Smith OPINION see 5 U.S. 137 CONCLUSION ok", "b.txt": "plain text"}
    for n, t in texts.items():
        with open(os.path.join(src, n), "w", encoding="utf-8") as f:
            f.write(t)
    with open(os.path.join(src, "c.txt"), "wb") as f:
        f.write(b"\xff bad")
    with open(os.path.join(src, "d.html"), "w", encoding="utf-8") as f:
        f.write("<p>Decision</p><script>x</script><p>held &amp; done</p>")
    texts["d.html"] = "Decision held & done"
    out = os.path.join(scratch, "out")
    q = jobs.stream_documents(spark, src, out, "en", checkpoint=os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    table = spark.read.parquet(out)
    got = table.where("kind = 'documents'")
    batch = preprocess(spark.createDataFrame(list(texts.items()), "n string, raw string"), "raw", "en")
    g = sorted(r["processed_text"] for r in got.collect())
    b = sorted(r["processed_text"] for r in batch.collect())
    assert g == b
    assert table.where("kind = 'rejects'").count() == 1


def test_a_file_delivered_twice_gives_one_row(spark, scratch):
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    for day, names in (("1", ["a.txt", "b.txt"]), ("2", ["a.txt", "c.txt"])):
        os.makedirs(os.path.join(src, day))
        for n in names:
            with open(os.path.join(src, day, n), "w", encoding="utf-8") as f:
                f.write("same" if n != "b.txt" else "other")
        jobs.stream_documents(spark, f"{src}/*", out, "en", checkpoint=os.path.join(scratch, "ckpt")).awaitTermination(120)
    got = [os.path.basename(r["source_file"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == ["a.txt", "b.txt", "c.txt"]


def test_stream_quality_equals_batch(spark, scratch):
    src = os.path.join(scratch, "events")
    shutil.copytree(os.path.join(SF0001, "events.parquet"), src) if os.path.isdir(
        os.path.join(SF0001, "events.parquet")) else (os.makedirs(src), shutil.copy(
            os.path.join(SF0001, "events.parquet"), src))
    out = os.path.join(scratch, "q")
    ck = os.path.join(scratch, "ck2")
    jobs.run_quality_stream(spark, src, out, checkpoint=ck).awaitTermination(120)
    ev = spark.read.parquet(src)
    last = ev.agg(F.max("ts")).first()[0].timestamp()
    batch = {(r["window_start"], r["event_type"]): r["requests"] for r in window_quality(ev, "ts", "event_type", "value").collect()}

    def seen():
        rows = [((r["window_start"], r["event_type"]), r["requests"]) for r in spark.read.parquet(out).collect()]
        assert len(rows) == len(dict(rows))  # each window once
        return dict(rows)

    closed = seen()  # those whose end the watermark has passed
    assert closed and closed == {k: v for k, v in batch.items() if k[0].timestamp() + 3600 <= last - 3600}
    for _ in range(2):
        jobs.close_quality(spark, ck, out)
        assert seen() == batch


def _event_file(spark, folder, name, rows):
    df = spark.createDataFrame([(i, f"2026-01-01 {t}", 1, "a", v, "") for i, (t, v) in enumerate(rows)], "event_id long, t string, user_id long, event_type string, value double, props string")
    df.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(os.path.join(folder, name))


def test_stream_violations(spark, scratch):
    src, out, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    base = spark.createDataFrame([("value", 1.0, 0.0, 10.0), ("event_id", 1.0, 0.0, 1.0)], "column string, completeness double, min double, max double")
    days = [[("01:10:00", 5.0), ("01:20:00", None), ("02:30:00", 50.0)], [("05:00:00", 1.0)], [("01:30:00", 99.0), ("05:10:00", -1.0)]]  # 01:30 is late by then
    for k, rows in enumerate(days):
        _event_file(spark, src, f"d{k}", rows)
        jobs.run_violations_stream(spark, f"{src}/*", base, out, ["value", "event_id"], checkpoint=ck).awaitTermination(120)
    before = {(r["window_start"].hour, r["column"]) for r in spark.read.parquet(out).collect()}
    assert before == {(1, "value"), (2, "value"), (1, "event_id"), (2, "event_id")}
    jobs.close_violations(spark, ck, out)
    got = {(r["window_start"].hour, r["column"]): (r["rows"], r["completeness"], r["out_of_range"], r["completeness_violation"]) for r in spark.read.parquet(out).collect()}
    assert got[1, "value"] == (2, 0.5, 0, True) and got[2, "value"] == (1, 1.0, 1, False) and got[5, "value"] == (2, 1.0, 1, False)
    assert got[1, "event_id"] == (2, 1.0, 0, False) and len(got) == 6
