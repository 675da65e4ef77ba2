import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns of the operators' own that a table may also have.
CLASHING = ["fp", "root", "component_id", "words", "size", "h", "row_hash", "copies", "length", "bucket", "start", "rank", "score",
            "lang_pred", "held_out", "line_no", "text_hash", "first", "cls", "key", "doc_order", "n_words", "labels", "_h", "_n", "_o", "lines"]


def sentence(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(1 + rng.randrange(vocabulary) % 7)) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, repeated lines and passages, a hot source, and what may break an operator."""
    rng = random.Random(3)
    passage = sentence(rng, 60)
    texts = ["\n".join(sentence(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [texts[0]] * 12 + [texts[1]] * 3
    long_ = sentence(rng, 400)
    texts += [long_, long_ + " more", long_ + " " + sentence(rng, 2), "x " + long_]
    texts += [sentence(rng, 10) + " " + passage + " " + sentence(rng, 15) for _ in range(5)]
    texts += [f"{texts[5]}\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY\ncc   by", texts[7] + "\n" + texts[8]]
    texts += [None, "", " \t\n ", ".,!", "a", "a", "Ünï çödé ß 日本語 テキスト 🙂", "  two  spaces\t\ttab \n\n line", "the " * 300, "w" * 5000, sentence(rng, 6000), "<|endoftext|> <s> </s>"]
    sources = ["hot", "hot", "b", None, "a"]
    rows = [(i, t, ["en", "de", None][i % 3], sources[i % 5], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id", None, None, None), (None, None, None, None, None), (17, "another text with id seventeen", "en", "hot", 30)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def values(df) -> list[tuple]:
    """Rows in an order of their own, nulls and all."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
