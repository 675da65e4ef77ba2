"""Plan-shape checks for the scale design (what explain() should show)."""

import re

from pyspark.sql import functions as F

from lexspark.functions import patterns as P
from lexspark.operators import citations as C
from lexspark.operators import evaluate as EV
from lexspark.operators import splits as SP
from lexspark.operators.preprocess import preprocess
from tests.conftest import SF0001


def _docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet").withColumn(
        "language", F.when(F.col("lang") == "de", "de").otherwise("en"))


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normalisation_regex_runs_once(spark):
    from lexspark.functions import text as T
    alone = _optimized(_docs(spark).select(T.normalize("text", F.col("language")))).count(P.WS)
    p = preprocess(_docs(spark), "text", F.col("language"))
    plan = _optimized(p.select("processed_text", "citations"))
    # the normalisation appears once (one CASE branch per language), not once per consumer
    assert plan.count(P.WS) <= alone


def test_preprocess_has_no_shuffle(spark):
    plan = _physical(preprocess(_docs(spark), "text", F.col("language")))
    assert "Exchange" not in plan


def test_exploded_citations_are_not_recomputed_in_a_filter(spark):
    p = preprocess(_docs(spark), "text", F.col("language"), keep_sections=False)
    plan = _optimized(C.citation_edges(p))
    assert plan.count("regexp_extract_all(") == len(P.CITATIONS_EN) + len(P.CITATIONS_DE)


def test_split_ranks_only_inside_hash_buckets(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = _physical(SP.split_dataset(df, "k"))
    # the only row-level window is partitioned by the hash bucket
    row_windows = re.findall(r"row_number\(\) windowspecdefinition\(([^,]+),", plan)
    assert row_windows and all(w.startswith("_b") for w in row_windows)
    assert "BroadcastExchange" in plan  # ≤ 65,536-row offsets table


def test_ngram_scoring_is_one_pass_without_join(spark):
    df = spark.createDataFrame([("1", "summarization", "a b c", "a b")],
                               "id string, task string, reference string, prediction string")
    plan = _physical(EV.score_pairs(df, with_rouge_l=False).where(F.col("task") != "classification"))
    assert plan.count("Generate") == 1 and "Join" not in plan
