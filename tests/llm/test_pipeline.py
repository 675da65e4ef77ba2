"""The pipeline: each stage on its own input, and all in a row against the operators by themselves."""

import corpus_pipeline as cp
from lexspark.llm import langid, linededup, mixing, packing, simhash
from lexspark.llm.queries import BYTE_BPE
from tests.llm.conftest import values

SF0001 = "/root/testdata/sf0.001"


def test_stages(docs, no_docs, spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF0001)
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, no_docs, SF0001).collect() == []


def test_language_stage_keeps_what_has_letters(docs, spark, rows):
    kept = cp.language_id(spark, docs, SF0001).count()
    assert kept == sum(any(c.isalpha() for c in r[1] or "") for r in rows)


def test_run(spark):
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns = d.columns
    d = langid.identify(d).filter("lang_pred != 'und'").select(*columns).cache()
    d = linededup.drop_duplicate_lines(d).cache()
    d = simhash.drop_near_duplicates(d).cache()
    d = mixing.mixed(d, mixing.cycled([5, 2, 1]), 1.5, 2.0).cache()
    want = packing.pack(d, BYTE_BPE)
    got = cp.run(spark, SF0001)
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert values(got.select(*keys)) == values(want.select(*keys))
    assert got.count() > 0
    lengths = got.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert all(r["sum(length)"] <= 2048 for r in lengths)
