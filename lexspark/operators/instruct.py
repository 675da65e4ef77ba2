"""Instruction building (INS-01..23): templates, examples, fan-out, prompts,
request parsing.

Template lookups use literal maps (a fixed handful of entries compiled into
the plan), so building examples is a narrow projection; fanning a document
out to every task is an ``explode`` over a literal array, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import conversation as CV
from ..functions import patterns as P
from ..functions import text as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def _templates(lang: str):
    return (P.TEMPLATES_DE, P.TEMPLATE_FALLBACK_DE) if lang == "de" else (P.TEMPLATES_EN, P.TEMPLATE_FALLBACK_EN)


def templates(spark: SparkSession, lang: str = "en") -> DataFrame:
    """INS-01/02: task, instruction, response template."""
    rows, _ = _templates(lang)
    return spark.createDataFrame(rows, "task string, instruction string, response string")


def template_columns(task, lang: str = "en") -> tuple[Column, Column]:
    """(instruction, response) for a task column; unknown task → fallback."""
    rows, fb = _templates(lang)
    fb_row = [r for r in rows if r[0] == fb][0]
    ins = F.coalesce(F.try_element_at(_lit_map([(t, i) for t, i, _ in rows]), _c(task)), F.lit(fb_row[1]))
    res = F.coalesce(F.try_element_at(_lit_map([(t, r) for t, _, r in rows]), _c(task)), F.lit(fb_row[2]))
    return ins, res


def example_id(*cols) -> Column:
    """INS-06: deterministic id = md5 of the '|'-joined key columns."""
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols]))


def build_examples(df: DataFrame, task, lang: str = "en", text_col: str = "text",
                   id_cols: list[str] | None = None, meta: dict | None = None,
                   truncate: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """INS-03/04: system + user(instruction, blank line, text) + assistant
    (template). ``task``: literal task name or a task column. ``meta``:
    metadata field → Column; ``task`` is added (the requested task, even
    when the template fell back). DE: text cut at 12,000 chars + '...'."""
    tcol = F.lit(task) if isinstance(task, str) else _c(task)
    ins, res = template_columns(tcol, lang)
    text = _c(text_col)
    if truncate is None and lang == "de":
        truncate = P.MAX_CHARS_DE
    if truncate:
        text = T.truncate_text(text, truncate)
    system = P.SYSTEM_DE if lang == "de" else P.SYSTEM_EN
    conv = F.array(CV.message("system", F.lit(system)),
                   CV.message("user", F.concat(ins, F.lit("\n\n"), text)),
                   CV.message("assistant", res))
    meta = dict(meta or {})
    meta["task"] = tcol
    md = F.struct(*[v.alias(k) for k, v in meta.items()])
    id_cols = id_cols or []
    return df.select(example_id(*id_cols, tcol).alias("id"), conv.alias("conversations"),
                     md.alias("metadata"), *(keep or []))


def german_metadata(court="court", date="date", case_number="case_number",
                    document_type="document_type") -> dict:
    """D9 metadata with reference defaults (PRJ-01)."""
    unk = F.lit("unknown")
    return {
        "document_type": F.coalesce(_c(document_type), unk),
        "court": F.coalesce(_c(court), unk),
        "date": F.coalesce(_c(date), unk),
        "case_number": F.coalesce(_c(case_number), unk),
        "language": F.lit("de"),
        "source": F.lit(P.SOURCE_DE),
    }


def fan_out_tasks(df: DataFrame, tasks: list[str] | None = None, col: str = "task") -> DataFrame:
    """INS-05: one row per (document, task): explode of a literal array."""
    tasks = tasks or P.TASKS_DE
    return df.withColumn(col, F.explode(F.array(*[F.lit(t) for t in tasks])))


def collect_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """INS-12: long turn table → one ordered conversation array per id.
    The array is the output row itself (one example); its size is that of
    the conversation."""
    g = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list(
        F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("role"),
                 F.col(text_col).alias("content")))).alias("_a"))
    return g.select(conv_col, F.transform("_a", lambda m: F.struct(m["role"].alias("role"),
                                                                   m["content"].alias("content"))
                                          ).alias("conversations"))


def first_of_role_long(turns: DataFrame, roles=("system", "user", "assistant"),
                       conv_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """INS-11 on the long table: first message per role by ``min_by`` —
    constant memory per conversation, partial aggregation map-side."""
    aggs = [F.coalesce(F.min_by(F.when(F.col(role_col) == r, F.col(text_col)),
                                F.when(F.col(role_col) == r, F.col(turn_col))), F.lit("")).alias(r)
            for r in roles]
    return turns.groupBy(conv_col).agg(*aggs)


def render_training_text_long(turns: DataFrame, conv_col: str = "conv_id", **kw) -> DataFrame:
    """INS-09 on the long table, without collecting the conversation."""
    f = first_of_role_long(turns, conv_col=conv_col, **kw)
    text = F.concat(F.lit(f"{P.IM_START}system\n"), F.col("system"),
                    F.lit(f"{P.IM_END}\n{P.IM_START}user\n"), F.col("user"),
                    F.lit(f"{P.IM_END}\n{P.IM_START}assistant\n"), F.col("assistant"), F.lit(P.IM_END))
    return f.select(conv_col, text.alias("text"))


def with_tokens(df: DataFrame, text_col: str, max_len: int = 2048, tokenizer=None) -> DataFrame:
    """INS-15: token count and truncation (default: whitespace tokens).
    ``tokenizer``: optional Column → ARRAY<STRING> function (pluggable)."""
    toks = tokenizer(_c(text_col)) if tokenizer else CV.whitespace_tokens(_c(text_col))
    return (df.withColumn("_tok", toks)
            .withColumn("n_tokens", F.size("_tok"))
            .withColumn("truncated", F.size("_tok") > max_len)
            .withColumn("tokens", F.slice("_tok", 1, max_len)).drop("_tok"))


def build_prompt(text, task, lang) -> Column:
    """INS-16: inference prompt; language other than de → English system
    message and instruction; unknown task (incl. statute_interpretation) →
    default instruction."""
    lc = _c(lang) if not isinstance(lang, str) else F.lit(lang)
    tc = _c(task) if not isinstance(task, str) else F.lit(task)
    eff = F.when(lc == "de", F.lit("de")).otherwise(F.lit("en"))
    table = _lit_map([(f"{t}|{l}", i) for t, l, i in P.PROMPT_INSTRUCTIONS if t is not None])
    default = _lit_map([(l, i) for t, l, i in P.PROMPT_INSTRUCTIONS if t is None])
    ins = F.coalesce(F.try_element_at(table, F.concat_ws("|", tc, eff)), F.try_element_at(default, eff))
    system = F.when(eff == "de", F.lit(P.SYSTEM_DE)).otherwise(F.lit(P.SYSTEM_EN))
    return F.concat(F.lit(f"{P.IM_START}system\n"), system, F.lit(f"\n{P.IM_END}\n{P.IM_START}user\n"),
                    ins, F.lit("\n\n"), _c(text), F.lit(f"\n{P.IM_END}\n{P.IM_START}assistant\n"))


def build_chat_prompt(text) -> Column:
    """INS-17: plain chat prompt with the English system message."""
    return F.concat(F.lit(f"{P.IM_START}system\n{P.SYSTEM_EN}\n{P.IM_END}\n{P.IM_START}user\n"),
                    _c(text), F.lit(f"\n{P.IM_END}\n{P.IM_START}assistant\n"))


# fixed value: outcome-evaluation prefix
EVAL_PROMPT_PREFIX = "Analyze the following legal case and predict the outcome: "


def build_eval_prompt(text) -> Column:
    """INS-18."""
    return F.concat(F.lit(EVAL_PROMPT_PREFIX), _c(text))


REQUEST_SCHEMA = TY.StructType([
    TY.StructField("text", TY.StringType()), TY.StructField("task", TY.StringType()),
    TY.StructField("max_new_tokens", TY.LongType()), TY.StructField("temperature", TY.DoubleType()),
    TY.StructField("top_p", TY.DoubleType()), TY.StructField("language", TY.StringType()),
])


def parse_requests(df: DataFrame, body_col: str = "body", content_type_col: str | None = None) -> DataFrame:
    """INS-19: JSON request → typed fields with handler defaults. Rows with
    another content type or unparsable JSON get ``error`` set (reject frame
    = ``where(error IS NOT NULL)``)."""
    d = P.REQUEST_DEFAULTS
    parsed = F.from_json(_c(body_col), REQUEST_SCHEMA, {"mode": "PERMISSIVE"})
    valid_json = F.try_parse_json(_c(body_col)).isNotNull() if hasattr(F, "try_parse_json") else F.lit(True)
    err = F.when(~valid_json, F.lit("invalid JSON"))
    if content_type_col:
        err = F.when(F.col(content_type_col) != "application/json",
                     F.concat(F.lit("Unsupported content type: "), F.col(content_type_col))).otherwise(err)
    return df.select("*", parsed.alias("_r"), err.alias("error")).select(
        *df.columns,
        F.coalesce("_r.text", F.lit(d["text"])).alias("text"),
        F.col("_r.task").alias("task"),
        F.coalesce("_r.max_new_tokens", F.lit(d["max_new_tokens"])).alias("max_new_tokens"),
        F.coalesce("_r.temperature", F.lit(d["temperature"])).alias("temperature"),
        F.coalesce("_r.top_p", F.lit(d["top_p"])).alias("top_p"),
        F.coalesce("_r.language", F.lit(d["language"])).alias("language"),
        "error")


# fixed values: reasoning response templates (name, assistant text)
REASONING_TEMPLATES = [
    ("step_by_step", "Ich werde diesen Fall Schritt für Schritt analysieren:\n\n{thinking}\n\nBasierend auf dieser Analyse ist meine Schlussfolgerung: {conclusion}"),
    ("case_analysis_cot", "Ich werde diesen Fall Schritt für Schritt analysieren:\n\n1. Identifizierung der rechtlichen Fragen:\n{legal_questions}\n\n2. Analyse der relevanten Fakten:\n{fact_analysis}\n\n3. Anwendung der rechtlichen Grundlagen:\n{legal_basis}\n\n4. Abwägung der Argumente:\n{argument_evaluation}\n\nBasierend auf dieser Analyse ist meine Schlussfolgerung:\n{conclusion}"),
    ("reasoning_section", "Analyse:\n{analysis}\n\nRechtliche Überlegungen:\n{reasoning}\n\nRechtliche Grundlagen:\n{legal_basis}\n\nSchlussfolgerung:\n{conclusion}"),
    ("classification_reasoning", "Dokumentanalyse:\n{document_analysis}\n\nRechtliche Überlegungen:\n{reasoning}\n\nBasierend auf dieser Analyse fällt dieses Dokument in die Kategorie {category}."),
    ("multi_step", "Schritt 1: Identifizierung der rechtlichen Probleme\n{issues}\n\nSchritt 2: Anwendung relevanter Gesetze\n{statutes}\n\nSchritt 3: Berücksichtigung von Präzedenzfällen\n{precedents}\n\nSchritt 4: Schlussfolgerungen\n{conclusions}"),
    ("counterfactual", "Hauptanalyse:\n{main_analysis}\n\nAlternative Betrachtung:\n{alternative_analysis}\n\nAbwägung der Interpretationen:\n{comparison}\n\nSchlussfolgerung:\n{conclusion}"),
    ("legal_test_contract", "Vertragsanalyse nach dem CISG-Framework:\n\n1. Angebot (§§ 14-17 CISG):\n{offer_analysis}\n\n2. Annahme (§§ 18-22 CISG):\n{acceptance_analysis}\n\n3. Vertragsbedingungen (§§ 8, 9 CISG):\n{terms_analysis}\n\n4. Schlussfolgerung zur Vertragsgültigkeit:\n{validity_conclusion}"),
]
# Our default task → reasoning template mapping for INS-22.
DEFAULT_UPGRADE = {"classification": "classification_reasoning", "case_analysis": "case_analysis_cot",
                   "summarization": "reasoning_section", "statute_interpretation": "multi_step"}


def reasoning_templates(spark: SparkSession) -> DataFrame:
    """INS-21."""
    return spark.createDataFrame(REASONING_TEMPLATES, "name string, template string")


def upgrade_templates(df: DataFrame, mapping: dict | None = None, task_col: str = "metadata.task") -> DataFrame:
    """INS-22: swap the assistant content by task for a reasoning template;
    tasks without a mapping keep their content."""
    mapping = mapping or DEFAULT_UPGRADE
    tpl = dict(REASONING_TEMPLATES)
    m = _lit_map([(task, tpl[name]) for task, name in mapping.items()])
    new = F.try_element_at(m, F.col(task_col))
    conv = F.transform("conversations", lambda x: F.when(
        (x["role"] == "assistant") & new.isNotNull(),
        F.struct(x["role"].alias("role"), new.alias("content"))).otherwise(x))
    return df.withColumn("conversations", conv)
