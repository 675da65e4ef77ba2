"""Filters, projections and profiles on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import filters as FL
from lexspark.operators import profile as PR


@pytest.fixture()
def cases(spark):
    return spark.createDataFrame([
        (1, "BGH 2. Strafsenat", "20120115", "Urteil", "federal", "src1"),
        (2, "BVerfG 1. Senat", "Unknown", "Beschluss", "state", "src2"),
        (3, None, "20161231", None, "federal", "src1"),
        (4, "OLG Köln", "20120301", "Urteil", None, "src3"),
    ], "doc_id long, court string, date string, document_type string, jurisdiction string, source string")


def test_filters(spark, cases):
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(FL.filter_courts(cases, ["BGH", "BVerfG"])) == [1, 2]
    assert ids(FL.filter_years(cases, [2012])) == [1, 4]
    assert ids(FL.filter_doc_types(cases, ["Urteil"])) == [1, 4]
    assert ids(FL.filter_cases(cases, "federal", "2012-01-01", "2016-12-31")) == [1, 3]
    assert ids(FL.filter_authorised(cases, ["src1"])) == [1, 3]
    allow = spark.createDataFrame([("src3",), ("src3",)], "source string")
    assert ids(FL.filter_authorised(cases, allow)) == [4]
    assert ids(FL.take_docs(cases, 2, ["doc_id"])) == [1, 2]


def test_projections(spark, cases):
    d = {r["doc_id"]: r for r in FL.with_decision_date(cases).collect()}
    assert str(d[1]["decision_date"]) == "2012-01-15" and d[2]["decision_date"] is None
    m = {r["doc_id"]: r for r in FL.with_metadata_defaults(cases, ["court", "document_type"], {"language": "de"}).collect()}
    assert m[3]["court"] == "unknown" and m[3]["document_type"] == "unknown" and m[1]["language"] == "de"
    cat = spark.createDataFrame([(1, "BGH X", "u1"), (9, "none", "u9")], "doc_id long, court string, link string")
    mc = {r["doc_id"]: r for r in FL.merge_catalogue(cases, cat, "doc_id", ["court", "link"]).collect()}
    assert mc[1]["court"] == "BGH X" and mc[1]["link"] == "u1" and mc[2]["court"] == "BVerfG 1. Senat"
    assert mc[2]["link"] is None


def test_profiles(spark, cases):
    dist = {r["value"]: (r["count"], r["percent"]) for r in PR.distribution(cases, "document_type").collect()}
    assert dist == {"Urteil": (2, 50.0), "Beschluss": (1, 25.0), "unknown": (1, 25.0)}
    comp = {r["field"]: r["missing"] for r in PR.completeness(cases, ["court", "jurisdiction", "date"]).collect()}
    assert comp == {"court": 1, "jurisdiction": 1, "date": 0}
    a = PR.adequacy(cases, "jurisdiction", 3, 10).first()
    assert (a["examples"], a["groups"], a["verdict"]) == (4, 3, "adequate")
    h = PR.length_histogram(spark.createDataFrame([(float(x),) for x in [0, 1, 2, 10]], "x double"), "x", 5).collect()
    assert sorted((r["bin"], r["count"]) for r in h) == [(0, 2), (1, 1), (4, 1)]
    st = {(r["dimension"], r["value"]): r["count"] for r in PR.catalogue_stats(cases, ["document_type", "jurisdiction"]).collect()}
    assert st[("document_type", "Urteil")] == 2 and st[("jurisdiction", "unknown")] == 1
    s = PR.describe_lengths(cases, F.length("court")).first()
    assert s["count"] == 3 and s["min"] == 8.0


def test_manifest(spark):
    df = spark.createDataFrame([("a", "train", "U"), ("b", "train", None), ("c", "test", "U")],
                               "id string, split string, document_type string")
    m = {r["split"]: r for r in PR.manifest(df, "split", "document_type").collect()}
    assert m["train"]["count"] == 2 and m["train"]["distribution"] == "U:1,unknown:1"
    assert m["test"]["fields"] == ["id", "document_type"]


def test_file_metadata_and_paths(spark):
    df = spark.createDataFrame([("/data/x/2 StR 1_09.xml",), ("/data/y/readme.txt",)], "source_file string")
    out = {r["source_file"]: r for r in FL.with_file_metadata(df, "source_file", "de").collect()}
    assert out["/data/x/2 StR 1_09.xml"]["file_type"] == "xml" and out["/data/y/readme.txt"]["language"] == "de"
    keys = [r["k"] for r in spark.createDataFrame([("2 StR 428/09",)], "c string").select(
        FL.path_key("c").alias("k")).collect()]
    assert keys == ["2 StR 428_09"]
