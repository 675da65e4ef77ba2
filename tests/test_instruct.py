"""Instruction building: rendering, spans, masks, prompts, requests."""

from pyspark.sql import functions as F

from lexspark.functions import conversation as CV
from lexspark.functions import patterns as P
from lexspark.operators import instruct as I

CONV = "conversations array<struct<role:string,content:string>>"


def _conv(spark, msgs):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in msgs],)], CONV)


def test_render_training_text_uses_first_of_each_role(spark):
    df = _conv(spark, [("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")])
    out = df.select(CV.render_training_text("conversations").alias("t")).first()["t"]
    assert out == ("<|im_start|>system\n<|im_end|>\n<|im_start|>user\nu1<|im_end|>\n"
                   "<|im_start|>assistant\na1<|im_end|>")


def test_render_conversation_skips_other_roles(spark):
    df = _conv(spark, [("system", "s"), ("tool", "x"), ("user", "u"), ("assistant", "a")])
    out = df.select(CV.render_conversation("conversations").alias("t")).first()["t"]
    assert out == ("<|im_start|>system\ns\n<|im_end|>\n<|im_start|>user\nu\n<|im_end|>\n"
                   "<|im_start|>assistant\na\n<|im_end|>\n")


def test_assistant_spans_two_turns_and_unclosed(spark):
    text = ("<|im_start|>user\nq\n<|im_end|>\n<|im_start|>assistant\nA1\n<|im_end|>\n"
            "<|im_start|>assistant\nB22\n<|im_end|>\n<|im_start|>assistant\nnever closed")
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(CV.assistant_contents("t").alias("c"), CV.assistant_spans("t").alias("s")).first()
    assert r["c"] == ["A1\n", "B22\n"]
    spans = [(s["start"], s["end"]) for s in r["s"]]
    assert [text[a:b] for a, b in spans] == ["A1\n", "B22\n"]


def test_no_assistant_gives_no_spans(spark):
    df = spark.createDataFrame([("<|im_start|>user\nq\n<|im_end|>\n",)], "t string")
    r = df.select(CV.assistant_spans("t").alias("s")).first()
    assert r["s"] == []


def test_loss_mask_is_union_of_assistant_turns(spark):
    text = ("<|im_start|>user\nq w\n<|im_end|>\n<|im_start|>assistant\na b\n<|im_end|>\n"
            "<|im_start|>user\nz\n<|im_end|>\n<|im_start|>assistant\nc\n<|im_end|>\n")
    df = spark.createDataFrame([(text,)], "t string").withColumn("tk", CV.whitespace_tokens("t"))
    df = df.withColumn("mk", CV.marker_positions("tk"))
    r = df.select("tk", CV.loss_mask("tk", "mk").alias("m")).first()
    kept = [t for t, m in zip(r["tk"], r["m"]) if m == 1]
    assert kept == ["a", "b", "c"]


def test_extract_response(spark):
    rows = [("p<|im_start|>assistant\n  answer \n<|im_end|>tail",), ("no marker",),
            ("<|im_start|>assistant\nfirst<|im_start|>assistant\nsecond",)]
    df = spark.createDataFrame(rows, "g string")
    out = [r["r"] for r in df.select(CV.extract_response("g").alias("r")).collect()]
    assert out == ["answer", None, "first"]


def test_build_examples_de_truncates_and_defaults(spark):
    df = spark.createDataFrame([(1, "x" * 12001, None)], "doc_id long, text string, court string")
    ex = I.build_examples(I.fan_out_tasks(df), F.col("task"), "de", "text", id_cols=["doc_id"],
                          meta=I.german_metadata(court="court", date=F.lit(None).cast("string"),
                                                 case_number=F.lit("1 StR 2/09"),
                                                 document_type=F.lit(None).cast("string")))
    rows = ex.collect()
    assert len(rows) == 4 and len({r["id"] for r in rows}) == 4
    r = [x for x in rows if x["metadata"]["task"] == "classification"][0]
    user = r["conversations"][1]["content"]
    assert user.endswith("x" * 12000 + "...") and user.startswith(P.TEMPLATES_DE[0][1] + "\n\n")
    assert r["metadata"]["court"] == "unknown" and r["metadata"]["source"] == P.SOURCE_DE


def test_unknown_task_falls_back_but_keeps_requested_task(spark):
    df = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    r = I.build_examples(df, "appeal", "en", "text", id_cols=["doc_id"]).first()
    assert r["conversations"][2]["content"] == P.TEMPLATES_EN[0][2]
    assert r["metadata"]["task"] == "appeal"


def test_fill_template_and_placeholders(spark):
    df = spark.createDataFrame([("Kategorie {category}, weil {reasoning}.",)], "t string")
    m = F.create_map(F.lit("category"), F.lit("Strafrecht"))
    r = df.select(CV.fill_template("t", m).alias("f")).first()["f"]
    assert r == "Kategorie Strafrecht, weil {reasoning}."
    ph = df.select(CV.unfilled_placeholders(F.lit(r)).alias("p")).first()["p"]
    assert ph == ["{reasoning}"]


def test_build_prompt_default_for_statute_and_other_language(spark):
    df = spark.createDataFrame([("T", "statute_interpretation", "de"), ("T", "summarization", "fr")],
                               "text string, task string, lang string")
    out = [r["p"] for r in df.select(I.build_prompt(F.col("text"), F.col("task"), F.col("lang")).alias("p")).collect()]
    assert "Analysiere den folgenden Rechtstext und gib Einblicke." in out[0]
    assert P.SYSTEM_DE in out[0]
    assert "Provide a concise summary" in out[1] and P.SYSTEM_EN in out[1]
    assert out[1].endswith("\n\nT\n<|im_end|>\n<|im_start|>assistant\n")


def test_parse_requests_defaults_and_rejects(spark):
    rows = [('{"text": "a", "temperature": 0.2}', "application/json"), ("{bad", "application/json"),
            ('{"text": "b"}', "text/plain")]
    df = spark.createDataFrame(rows, "body string, ct string")
    out = I.parse_requests(df, "body", "ct").collect()
    assert (out[0]["text"], out[0]["temperature"], out[0]["top_p"], out[0]["max_new_tokens"],
            out[0]["language"], out[0]["error"]) == ("a", 0.2, 0.9, 512, "en", None)
    assert out[1]["error"] == "invalid JSON" and out[1]["text"] == ""
    assert out[2]["error"].startswith("Unsupported content type")


def test_with_tokens_truncates(spark):
    df = spark.createDataFrame([("a b  c\nd",), ("",)], "t string")
    out = I.with_tokens(df, "t", 3).collect()
    assert (out[0]["n_tokens"], out[0]["truncated"], out[0]["tokens"]) == (4, True, ["a", "b", "c"])
    assert out[1]["n_tokens"] == 0


def test_collect_turns_orders_by_turn(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "user", "c")],
                               "conv_id long, turn long, role string, text string")
    conv = I.collect_turns(df).first()["conversations"]
    assert [m["content"] for m in conv] == ["a", "b", "c"]
