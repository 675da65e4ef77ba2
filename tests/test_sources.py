"""Sources and sinks: round trips in a fresh scratch folder per test."""

import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from lexspark.sources import markup as MK
from lexspark.sources import readers as RD
from lexspark.sources import sinks as SK


def _write(path, name, data, mode="w"):
    with open(os.path.join(path, name), mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(data)


def test_html_text_rules():
    doc = ('<html><head><title>T &amp; C</title><style>p{x}</style><script>var t="</p>";</script></head>'
           '<body><!-- ad --><p> One <b>two</b></p><p>  </p><br>three<template>hid</template></body></html>')
    assert MK.html_text(doc) == "T & C One two three"


def test_xml_text_and_decisions():
    assert MK.xml_text("<a>x <b> y </b><!-- c --> z</a>") == "x y z"
    doc = ("<dokument><Gericht> BGH </Gericht><Aktenzeichen>2 StR 1/09</Aktenzeichen>"
           "<text>1  Tenor Die Revision wird verworfen.</text></dokument>")
    d = MK.parse_decision(doc)
    assert d["court"] == "BGH" and d["case_number"] == "2 StR 1/09" and d["date"] is None
    # 'dokument' and 'text' both match: the text is taken twice, in list order
    assert d["raw_text"] == "BGH 2 StR 1/09 1  Tenor Die Revision wird verworfen. 1  Tenor Die Revision wird verworfen. "
    assert MK.parse_decision("<broken")["error"].startswith("ParseError")


def test_parse_decisions_native_tail(spark):
    doc = "<root><text>12 Tenor Die Revision wird verworfen. Gründe Sie ist unbegründet.</text></root>"
    df = spark.createDataFrame([("f.xml", doc)], "source_file string, xml string")
    r = MK.parse_decisions(df, "xml").first()
    assert r["full_text"] == "Tenor Die Revision wird verworfen. Gründe Sie ist unbegründet."
    assert r["gruende"] == "Gründe Sie ist unbegründet." and r["tatbestand"] is None


def test_opinions(spark):
    html = ('<div class="opinion x"><h3>Title</h3><span class="date">2020</span>'
            '<div class="opinion-text">Body <i>text</i></div></div><div class="opinion"><h3>Only</h3></div>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = MK.extract_opinions(df).orderBy("ordinal").collect()
    assert [(r["title"], r["text"], r["date"]) for r in rows] == [("Title", "Body text", "2020"), ("Only", None, None)]


def test_process_directory_routes_and_rejects(spark, scratch):
    _write(scratch, "a.txt", "Mr. Smith OPINION body text")
    _write(scratch, "b.html", "<p>Decision</p><script>x</script><p>held</p>")
    _write(scratch, "c.xml", "<d><t>CONCLUSION ok</t></d>")
    _write(scratch, "d.pdf", "ignored")
    _write(scratch, "e.txt", b"bad \xff\xfe bytes", "wb")
    _write(scratch, "f.xml", "<unclosed>")
    good, bad = RD.process_directory(spark, scratch, "en")
    g = {os.path.basename(r["source_file"]): r for r in good.collect()}
    assert sorted(g) == ["a.txt", "b.html", "c.xml"]
    assert g["a.txt"]["header"] == "Mr. [NAME]" and g["b.html"]["body"] == "held"
    assert g["a.txt"]["metadata"]["file_type"] == "txt"
    b = {os.path.basename(r["source_file"]): r["error"] for r in bad.collect()}
    assert sorted(b) == ["e.txt", "f.xml"] and b["e.txt"] == "invalid UTF-8"


def test_read_text_docs(spark, scratch):
    _write(scratch, "x.txt", "line one\nline two")
    r = RD.read_text_docs(spark, scratch).first()
    assert r["raw"] == "line one\nline two" and r["file_type"] == "txt"


def test_read_examples_skips_bad_lines(spark, scratch):
    ex = {"id": "1", "conversations": [{"role": "user", "content": "ü"}], "metadata": {"task": "classification"}}
    _write(scratch, "a.jsonl", json.dumps(ex, ensure_ascii=False) + "\n\n{bad json\n[1]\n")
    good, bad = RD.read_examples(spark, scratch)
    rows = good.collect()
    assert len(rows) == 1 and rows[0]["conversations"][0]["content"] == "ü"
    assert bad.count() == 2


def test_load_examples_caps_lines_before_filters(spark, scratch):
    lines = [json.dumps({"id": str(i), "conversations": [], "metadata": {"task": "a" if i % 2 else "b"}})
             for i in range(10)]
    _write(scratch, "x.jsonl", "\n".join(lines) + "\n")
    out = RD.load_examples(spark, os.path.join(scratch, "x.jsonl"), max_samples=4, task="a").collect()
    assert sorted(r["id"] for r in out) == ["1", "3"]


def test_catalogue_cap_and_link_filter(spark, scratch):
    xml = ("<root><item><gericht>BGH</gericht><link>u1</link></item><item><gericht>X</gericht></item>"
           "<item><aktenzeichen>3</aktenzeichen><link>u3</link></item><item><link>u4</link></item></root>")
    _write(scratch, "cat.xml", xml)
    rows = RD.read_catalogue(spark, os.path.join(scratch, "cat.xml"), max_items=3).collect()
    got = sorted((r["court"], r["date"], r["case_number"], r["link"]) for r in rows)
    assert got == [("BGH", "Unknown", "Unknown", "u1"), ("Unknown", "Unknown", "3", "u3")]


def test_expand_archives(spark, scratch):
    for name, members in [("a.zip", {"x.txt": "n", "d.xml": "<a>1</a>"}), ("b.zip", {"y.txt": "no xml"})]:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for m, c in members.items():
                z.writestr(m, c)
        _write(scratch, name, buf.getvalue(), "wb")
    rows = {os.path.basename(r["source_file"]): r for r in RD.expand_archives(spark, scratch).collect()}
    assert rows["a.zip"]["member"] == "d.xml" and rows["a.zip"]["xml"] == "<a>1</a>"
    assert rows["b.zip"]["error"] == "no XML member"


def test_processed_docs_and_prompts(spark, scratch):
    doc = {"metadata": {"court": "BGH", "date": "20100113", "case_number": "2 ARs 569/09", "link": "u"},
           "full_text": "Tenor x", "sections": {"tenor": "Tenor x"}, "source_file": "f.xml"}
    _write(scratch, "d.json", json.dumps(doc, ensure_ascii=False, indent=2))
    r = RD.read_processed_docs(spark, scratch).first()
    assert r["metadata"]["court"] == "BGH" and r["sections"]["tenor"] == "Tenor x" and r["sections"]["gruende"] is None
    _write(scratch, "p.txt", "  first prompt \nsecond\n")
    assert [x["prompt"] for x in RD.read_prompts(spark, os.path.join(scratch, "p.txt")).collect()] == [
        "first prompt", "second"]


def test_split_sinks_round_trip_and_snapshot(spark, scratch):
    df = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(30)], "id long, split string")
    path = os.path.join(scratch, "splits")
    SK.write_splits(df, path)
    assert RD.read_splits(spark, path, "test").count() == 10
    snap = SK.snapshot(spark, path, "v1")
    assert snap["verified"] and snap["rows"] == 30 and snap["copied"] > 0
    assert SK.snapshot(spark, path, "v2")["copied"] == 0
    spark.createDataFrame([(99, "new")], "id long, split string").write.mode("append").partitionBy("split").parquet(path)
    assert SK.snapshot(spark, path, "v3") == {"version": "v3", "rows": 31, "copied": 1, "verified": True}
    assert [SK.read_snapshot(spark, path, v).count() for v in ("v1", "v2", "v3")] == [30, 30, 31]
    assert sorted(tuple(r) for r in SK.read_snapshot(spark, path, "v1").select("id", "split").collect()) == sorted(tuple(r) for r in df.collect())
    uris = SK.publish(df, os.path.join(scratch, "pub"))
    assert uris["train"].endswith("split=train")
    SK.write_docs(spark.createDataFrame([("/x/a.txt", "t")], "source_file string, t string"),
                  os.path.join(scratch, "docs"))
    assert spark.read.json(os.path.join(scratch, "docs")).first()["doc_key"] == "a.txt.json"
    assert df.select(F.lit(1)).count() == 30


def test_line_numbers_follow_file_order_across_splits(spark, scratch):
    lines = [json.dumps({"id": str(i), "conversations": [], "metadata": {"task": "t"}}) for i in range(3000)]
    _write(scratch, "big.jsonl", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        out = RD.load_examples(spark, os.path.join(scratch, "big.jsonl"), max_samples=1234).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r["id"]) for r in out) == list(range(1234))


def test_a_reader_sees_the_old_version_or_the_new_one(spark, scratch):
    uri = os.path.join(scratch, "pub")
    assert SK.published(spark, uri) is None
    df = spark.createDataFrame([(i, "train") for i in range(5)], "id long, split string")
    SK.publish(df, uri)
    old = SK.published(spark, uri)
    broken = df.withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    try:
        SK.publish(broken, uri)
        raise AssertionError("published")
    except Exception as e:  # noqa: BLE001
        assert "no" in str(e)
    assert SK.published(spark, uri) == old and spark.read.json(old).count() == 5
    SK.publish(df.limit(2), uri)
    assert SK.published(spark, uri) != old
    assert spark.read.json(SK.published(spark, uri)).count() == 2 and spark.read.json(old).count() == 5
    manifest = spark.read.json(old.replace("/data", "/manifest")).collect()
    assert manifest and all(r["file"].startswith("split=train/part-") and len(r["sha256"]) == 64 for r in manifest)
