"""Worst cases: long runs, deep markup, namespaces, absent categories, streams into one output."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from lexspark.functions import patterns as P
from lexspark.functions import text as T
from lexspark.operators import splits as SP
from lexspark.operators.skew import salted_join
from lexspark.sources import markup
from lexspark.streaming import jobs

N = 100_000
RUNS = {"letters": "a" * N, "digits": "7" * N, "courts": "BGH " * (N // 4), "courts_with_keyword": "BGH Urteil " * (N // 11), "dots": "a." * (N // 2),
        "spaces": "x" + " " * N + "x", "at_signs": "a@" * (N // 2), "late_date": "BVerfG " * (N // 7) + "Urteil vom 1.2.2003"}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs_take_linear_time(spark, name):
    df = spark.createDataFrame([(RUNS[name],)], "t string")
    columns = [*(F.size(T.citations("t", lang)) for lang in ("en", "de")), *(F.length(T.anonymize("t", lang)) for lang in ("en", "de")),
               F.length(T.py_strip("t"))]
    for c in columns:
        df.select(c).collect()  # compiled
        began = time.time()
        df.select(c).collect()
        assert time.time() - began < 2


def test_linear_forms_match_the_plain_patterns(spark):
    texts = ["a@b.com.x@y.de", "x12 U.S. 34 U.S. 5", "mail a.b+c@d-e.org, a@b", "12 Main Street 7 F.2d 8", "1 F.Supp.2d 33", "9 Hauptstraße 10  weg",
             "BGH BGH, Urteil vom 1.2.2003 BGH\nBGH Beschluss vom 3.4.2005", "BVerfG Urteil vom\n1.1.2001", "%%a@b.co.uk@c.de"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for lang, cites, rules in (("en", P.CITATIONS_EN, P.ANON_EN), ("de", P.CITATIONS_DE, P.ANON_DE)):
        found = rows.select("t", T.citations("t", lang).alias("c"), T.anonymize("t", lang).alias("m")).collect()
        for r in found:
            want = [m for p in cites for m in re.findall(re.sub(r"\(\?>", "(?:", p), r["t"])]
            masked = r["t"]
            for _, p, new in rules:
                masked = re.sub(p, new, masked)
            assert (r["c"], r["m"]) == (want, masked), r["t"]


def test_deep_pages_are_read(spark):
    page = "<div class='opinion'>" + "<p>" * 5000 + "deep" + "<h3>T</h3>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    r = df.select(markup.html_to_text("html").alias("r")).select("r.*").collect()[0]
    assert (r["value"], r["error"]) == ("deep T", None)
    assert [(x["page_id"], x["title"], x["error"]) for x in markup.extract_opinions(df).collect()] == [(1, "T", None)]


def test_decisions_in_a_namespace():
    doc = "<d xmlns='urn:x'><Gericht> BGH </Gericht><text>one</text><body>two</body><text>three</text></d>"
    r = markup.parse_decision(doc)
    assert (r["court"], r["raw_text"], r["error"]) == ("BGH", "one two ", None)
    assert markup.parse_decision("<d>")["error"].startswith("ParseError") and markup.parse_decision(None)["error"] == "no content"


def test_mix_with_an_absent_category(spark):
    d = spark.range(100).withColumn("c", F.lit("x"))
    assert SP.mix(d, "id", "c", {"x": 0.5, "y": 0.5}).count() == 0
    assert SP.mix(d, "id", "c", {"x": 1.0}).count() == 100


def test_salted_join_is_the_join(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id))) AS k")
    keyed = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = rows.join(keyed, "k", how).select("id", "k", "v").collect()
        assert sorted(salted_join(rows, keyed, "k", ["id"], how).select("id", "k", "v").collect(), key=repr) == sorted(want, key=repr)


def test_streams_with_other_checkpoints_keep_each_others_output(spark, scratch):
    out = os.path.join(scratch, "out")
    for name in ("one", "two"):
        folder = os.path.join(scratch, name)
        os.makedirs(folder)
        with open(os.path.join(folder, f"{name}.txt"), "w") as f:
            f.write(f"text {name}")
        jobs.stream_documents(spark, folder, out).awaitTermination(120)
    found = spark.read.parquet(out).where("kind = 'documents'")
    assert sorted(r["processed_text"] for r in found.collect()) == ["text one", "text two"]
