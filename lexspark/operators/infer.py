"""Batch inference surface (INF-01..03).

Prompt building and response extraction are native columns; only the
model call runs in Python, through ``mapInPandas`` with a caller-supplied
generator factory that is called once per Python worker (the model is
loaded once, not per row). Row order inside each partition is kept and
each row's failure becomes its ``error`` field. Answers that were recorded
before are joined by key instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import patterns as P
from ..functions.conversation import extract_response
from .instruct import build_prompt

GeneratorFactory = Callable[[], Callable[[list[str]], list[str]]]


def predict_recorded(df: DataFrame, answers: DataFrame, keys: list[str], text_col: str = "text", task=None, lang="en") -> DataFrame:
    """INF-01/02 with answers that were given before: ``answers`` (``keys``, answer), a row per prompt
    at most. Output: input columns + prompt, generated, error, response; a prompt without an answer
    keeps its row, with an error. No Python."""
    task_c = F.lit(task) if (task is None or isinstance(task, str)) else task
    d = df.withColumn("prompt", build_prompt(F.col(text_col), task_c.cast("string"), lang))
    given = answers.select(*keys, F.col("answer").alias("_answer"))
    r = d.join(given, keys, "left").withColumn("generated", F.concat("prompt", "_answer", F.lit(P.IM_END)))
    r = r.withColumn("error", F.when(F.col("_answer").isNull(), "LookupError: no recorded answer")).drop("_answer")
    return r.withColumn("response", extract_response(F.substring(F.col("generated"), F.length("prompt") - len(P.ASSISTANT_MARKER) + 1, F.length("generated"))))


def batch_predict(df: DataFrame, generator_factory: GeneratorFactory, text_col: str = "text",
                  task=None, lang="en", batch_size: int = 4, id_col: str | None = None) -> DataFrame:
    """INF-01/02: prompt → generate (batches of ``batch_size``) → extract.
    Output: input columns + prompt, generated, response, error."""
    task_c = F.lit(task) if (task is None or isinstance(task, str)) else task
    d = df.withColumn("prompt", build_prompt(F.col(text_col), task_c.cast("string"), lang))
    schema = TY.StructType(list(d.schema.fields) + [TY.StructField("generated", TY.StringType()),
                                                    TY.StructField("error", TY.StringType())])

    def run(batches):
        gen = generator_factory()
        for b in batches:
            prompts = b["prompt"].tolist()
            generated, errors = [], []
            for i in range(0, len(prompts), batch_size):
                chunk = prompts[i:i + batch_size]
                try:
                    res = gen(chunk)
                    generated += res
                    errors += [None] * len(res)
                except Exception:  # noqa: BLE001 — retry row by row, isolate the failure
                    for p in chunk:
                        try:
                            generated.append(gen([p])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            generated.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            out = b.copy()
            out["generated"] = pd.Series(generated, dtype="object")
            out["error"] = pd.Series(errors, dtype="object")
            yield out

    r = d.mapInPandas(run, schema)
    return r.withColumn("response", extract_response(F.col("generated")))


def encode_response(df: DataFrame, response_col: str = "response", error_col: str = "error") -> DataFrame:
    """INF-03: JSON body {"response": …} or {"error": …}."""
    body = F.when(F.col(error_col).isNotNull(), F.to_json(F.struct(F.col(error_col).alias("error")))).otherwise(
        F.to_json(F.struct(F.col(response_col).alias("response"))))
    return df.withColumn("body", body)
