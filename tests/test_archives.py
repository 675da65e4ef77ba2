"""The archive source: members, cuts of large archives, broken ones, and the stream."""

import os
import zipfile

import pytest

from lexspark.sources import archives as A


@pytest.fixture()
def folder(spark, scratch):
    A.register(spark)
    for name, members in [("a.zip", {"x.txt": "n", "d.xml": "<a>1</a>", "e.xml": "<a>2</a>"}), ("b.zip", {"y.txt": "no xml"}),
                          ("big.zip", {f"{i:03d}.xml": os.urandom(600).hex() for i in range(60)})]:
        with zipfile.ZipFile(os.path.join(scratch, name), "w", zipfile.ZIP_DEFLATED) as z:
            for m, c in members.items():
                z.writestr(m, c)
    with zipfile.ZipFile(os.path.join(scratch, "c.zip"), "w") as z:
        z.writestr("bad.xml", b"\xff\xfe")
    with open(os.path.join(scratch, "d.zip"), "wb") as f:
        f.write(b"not an archive")
    return scratch


def _rows(df):
    return {(os.path.basename(r["source_file"]), r["member"]): (r["content"], r["error"]) for r in df.collect()}


def test_members(spark, folder):
    df = spark.read.format("archive").option("path", folder).option("partitionBytes", 8000).load()
    assert df.rdd.getNumPartitions() >= 5  # the large archive is cut
    got = _rows(df)
    assert len(got) == 60 + 2 + 3 and got["a.zip", "e.xml"] == ("<a>2</a>", None)
    assert got["b.zip", None][1] == "no XML member"
    assert got["c.zip", "bad.xml"][1].startswith("UnicodeDecodeError") and got["d.zip", None][0] is None and got["d.zip", None][1]
    assert _rows(spark.read.format("archive").option("path", folder).load()) == got
    first = _rows(spark.read.format("archive").option("path", folder).option("members", "first").load())
    assert sorted(k[1] for k in first if k[1]) == ["000.xml", "bad.xml", "d.xml"]
    one = spark.read.format("archive").option("path", os.path.join(folder, "a.zip")).load()
    assert one.count() == 2
    empty = os.path.join(folder, "empty")
    os.makedirs(empty)
    assert spark.read.format("archive").option("path", empty).load().collect() == []


def test_stream_takes_new_archives_once(spark, folder):
    out, ck = os.path.join(folder, "out"), os.path.join(folder, "ck")

    def run():
        s = spark.readStream.format("archive").option("path", folder).load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(120)
        return _rows(spark.read.parquet(out)), spark.read.parquet(out).count()

    rows, n = run()
    assert n == len(rows) == 65
    with zipfile.ZipFile(os.path.join(folder, "new.zip"), "w") as z:
        z.writestr("n.xml", "<n/>")
    os.utime(os.path.join(folder, "new.zip"), ns=(2 ** 62, 2 ** 62))
    rows, n = run()
    assert n == len(rows) == 66 and rows["new.zip", "n.xml"] == ("<n/>", None)


def test_round_trip(spark, scratch):
    rows = [(f"{i % 3}.zip", f"{i}.xml", f"<d>{i} ä</d>") for i in range(50)]
    folder = os.path.join(scratch, "zips")
    A.write_archives(spark.createDataFrame(rows, "archive string, member string, content string"), folder)
    A.register(spark)
    got = spark.read.format("archive").option("path", f"file://{folder}").load().collect()
    assert sorted((os.path.basename(r["source_file"]), r["member"], r["content"]) for r in got) == sorted(rows)


def test_partitions_read_their_part_of_the_directory(scratch):
    """A cut archive's partitions know the entries they need alone, also behind other bytes, between
    members that don't count, and with names that are not ASCII."""
    path = os.path.join(scratch, "big.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(300):
            z.writestr(f"{i:03d}ä.xml" if i % 3 else f"{i:03d}.txt", os.urandom(300).hex())
        z.comment = b"end"
    with zipfile.ZipFile(path) as z:
        want = [(m, z.read(m).decode()) for m in z.namelist() if m.endswith(".xml")]
    behind = os.path.join(scratch, "behind.zip")
    with open(path, "rb") as f, open(behind, "wb") as g:
        g.write(b"#!/bin/sh\n" + f.read())
    for p in (path, behind):
        archives = A._Archives({"path": p, "partitionBytes": "4000"})
        parts = archives.planned(archives.files())
        assert len(parts) > 10 and all(x.parts[0][1] for x in parts)
        opened = [len(archives.open(p, x.parts[0][1]).infolist()) for x in parts]
        assert sum(opened) == 300 and max(opened) < 60
        assert [r[1:] for x in parts for r in archives.rows(x)] == [(*m, None) for m in want]


def test_directory_of_more_entries_than_16_bits_count(scratch):
    path = os.path.join(scratch, "many.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(70_000):
            z.writestr(f"{i}.xml", "x" if i % 1000 == 0 else "")
    archives = A._Archives({"path": path, "partitionBytes": "60"})
    parts = archives.planned(archives.files())
    got = [r for x in parts for r in archives.rows(x)]
    assert len(parts) == 2 and len(got) == 70_000 and not any(r[3] for r in got) and [r[1] for r in got] == [f"{i}.xml" for i in range(70_000)]


def test_batches_of_texts_are_small(spark):
    """Readers and parsers of whole texts take a thousand rows at once, not ten thousand (F5, F10)."""
    from lexspark.sources import markup, readers

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for run in (lambda: readers.expand_archive_rows(spark.createDataFrame([("a", b"")], "path string, content binary")),
                    lambda: markup.parse_decisions(spark.createDataFrame([("a", "<d/>")], "source_file string, xml string"))):
            spark.conf.set(key, "10000")
            run()
            assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
