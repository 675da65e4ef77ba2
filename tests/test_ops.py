"""Run costs against the published table, monitoring, batch inference."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import cost as CO
from lexspark.operators import infer as INF
from lexspark.operators import monitor as MO


def test_run_costs_reproduce_published_table(spark):
    prices = CO.price_table(spark)
    runs = prices.select("instance_type", "hours")  # one run per type at its estimated hours
    c = {r["instance_type"]: r for r in CO.run_costs(runs, prices).collect()}
    # published / derived values (BASELINE §1-2)
    expect = {"ml.g5.2xlarge": (91.20, 27.60, 60.00, 0.00), "ml.g5.4xlarge": (115.20, 34.40, 40.00, 0.00),
              "ml.g5.8xlarge": (144.00, 43.25, 24.23, 3.06), "ml.g5.12xlarge": (155.52, 46.62, 17.05, 5.26),
              "ml.g5.16xlarge": (172.80, 51.90, 13.86, 7.61), "ml.g5.48xlarge": (276.48, 82.96, 7.11, 11.11)}
    for t, (od, spot, adj, pct) in expect.items():
        r = c[t]
        assert round(r["on_demand_cost"], 2) == od and round(r["spot_cost"], 2) == spot
        assert round(r["adjusted_hours"], 2) == adj and round(r["on_demand_savings_pct"], 2) == pct
    cheapest = CO.cheapest(CO.run_costs(runs, prices), "spot_cost").first()
    assert cheapest["instance_type"] == "ml.g5.2xlarge"  # the cheapest row, not the one the guide picks


def test_baseline_and_drift(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 3.0), (3, "b", None)], "id long, s string, x double")
    b = {r["column"]: r for r in MO.baseline(df).collect()}
    assert b["s"]["completeness"] == pytest.approx(2 / 3) and b["x"]["min"] == 1.0 and b["x"]["max"] == 3.0
    assert b["id"]["distinct"] == 3 and b["s"]["mean"] is None
    same = MO.drift(df, df, "x", 4).first()["psi"]
    assert same == pytest.approx(0.0)
    other = spark.createDataFrame([(9, "z", 3.0)] * 5, "id long, s string, x double")
    assert MO.drift(df, other, "x", 4).first()["psi"] > 1.0


def test_batch_predict_isolates_failures(spark):
    def stub_generator_factory():
        """Deterministic stand-in model for tests: echoes the prompt and answers
        with a fixed classification sentence naming the prompt's length class."""

        def generate(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                if "FAIL" in p:
                    raise ValueError("generation failed")
                cat = "Contract" if len(p) % 2 == 0 else "Criminal"
                out.append(f"{p}Based on my analysis, this document falls under {cat} because stub.<|im_end|>")
            return out

        return generate

    df = spark.createDataFrame([(1, "ok text"), (2, "please FAIL"), (3, "more")], "id long, text string")
    out = {r["id"]: r for r in INF.encode_response(
        INF.batch_predict(df, stub_generator_factory, "text", "classification", "en")).collect()}
    assert out[2]["error"].startswith("ValueError") and out[2]["response"] is None
    assert out[1]["error"] is None and out[1]["response"].startswith("Based on my analysis")
    assert out[2]["body"].startswith('{"error"') and out[3]["body"].startswith('{"response"')
    assert F is not None


def test_recorded_answers(spark):
    asked = spark.createDataFrame([(1, "q <|im_start|>assistant\nno<|im_end|>"), (2, "r"), (3, None)], "id int, text string")
    answers = spark.createDataFrame([(1, "  yes <|im_end|> rest"), (3, "x")], "id int, answer string")
    got = {r["id"]: (r["response"], r["error"]) for r in INF.predict_recorded(asked, answers, ["id"], "text", "summarization").collect()}
    assert got[1] == ("yes", None)
    assert got[2] == (None, "LookupError: no recorded answer")
