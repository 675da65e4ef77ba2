"""Segments of conversations against the rendered texts."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.functions import conversation as CV
from lexspark.operators import segments as S

SPAN = re.compile(CV._SPAN)
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(2)
    odd = ["", None, "  two  spaces\n\n", "<|im_end|>", "x <|im_start|>assistant\ninner<|im_end|> y", "<|im_start|>assistant", "é日本 🙂\t", "a<|im_end|>b<|im_start|>assistant\nz", "\n"]
    rows = [(c, t * (700 if c % 3 == 0 else 1), rng.choice(["system", "user", "assistant", "assistant", "tool"]), rng.choice(odd + ["plain words here", "Answer, yes!"]))
            for c in range(12) for t in range(rng.randrange(1, 12))]
    rows += [(None, 1, "assistant", "no id"), (50, 2, "user", "b"), (50, 2, "user", "a"), (50, None, "assistant", "first")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def texts(turns):
    order = sorted(turns.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.role, r.text is not None, r.text or ""))
    out = {}
    for r in order:
        out[r.conv_id] = out.get(r.conv_id, "") + (f"<|im_start|>{r.role}\n{r.text}\n<|im_end|>\n" if r.role in S.ROLES and r.text is not None else "")
    return out


def test_pieces_lie_in_the_rendered_text(turns, texts):
    rows = S.segments(turns).collect()
    assert len(rows) == turns.count()
    assert all(texts[r.conv_id][r.start:r.end] == r.piece for r in rows)
    ends = {}
    for r in rows:
        ends[r.conv_id] = max(ends.get(r.conv_id, 0), r.end)
    assert ends == {c: len(t) for c, t in texts.items()}


def test_assistant_turns(turns, texts):
    got = sorted(((r.conv_id is None, r.conv_id or 0, r.span_no, r.start, r.end, r.content) for r in S.assistant_turns(S.segments(turns)).collect()))
    want = sorted((c is None, c or 0, k, m.start(1), m.end(1), m[1]) for c, t in texts.items() for k, m in enumerate(SPAN.finditer(t)))
    assert got == want


def test_words_of_regions(spark, turns, texts):
    got = {r.conv_id: (r.n, r.k) for r in S.word_mask(S.segments(turns)).groupBy("conv_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_loss").alias("k")).collect()}
    df = spark.createDataFrame(list(texts.items()), "conv_id long, t string").withColumn("tk", CV.whitespace_tokens("t")).withColumn("mk", CV.marker_positions("tk"))
    want = {r.conv_id: (r.n, r.k) for r in df.select("conv_id", F.size("tk").alias("n"), F.aggregate(CV.loss_mask("tk", "mk"), F.lit(0), lambda a, x: a + x).alias("k")).collect()}
    assert got == want


@pytest.mark.parametrize("max_len", [5, 100000])
def test_subwords_are_those_of_the_whole_text(turns, texts, max_len):
    rows = sorted(S.subword_tokens(S.segments(turns), BPE, max_len).collect(), key=lambda r: (r.token_start, r.n_tokens))
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    for c, text in texts.items():
        enc = tokenizer.encode(text, add_special_tokens=False)
        spans = [m.span(1) for m in SPAN.finditer(text)]
        mask = [int(any(a <= s < b for a, b in spans)) for s, _ in enc.offsets]
        own = [r for r in rows if r.conv_id == c]
        assert [i for r in own for i in r.ids] == enc.ids[:max_len]
        assert [i for r in own for i in r.mask] == mask[:max_len]
        assert sum(r.n_tokens for r in own) == len(enc.ids)


def test_nothing_from_nothing(spark):
    empty = S.segments(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == S.assistant_turns(empty).collect() == S.word_mask(empty).collect() == S.subword_tokens(empty, BPE).collect() == []


def test_a_conversation_of_many_turns(spark):
    many = spark.range(200_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.lit("word").alias("text"))
    turns = S.assistant_turns(S.segments(many))
    last = turns.orderBy(F.desc("span_no")).first()
    assert (last.span_no, turns.count()) == (99_999, 100_000)
    assert last.end == 100_000 * (len("<|im_start|>user\nword\n<|im_end|>\n") + len("<|im_start|>assistant\nword\n<|im_end|>\n")) - len("<|im_end|>\n")
