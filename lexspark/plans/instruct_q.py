"""Driver queries for instruction building (INS) over ``legal`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as CV
from ..functions import patterns as P
from ..functions import text as T
from ..functions.arrays import explode_rows
from ..operators import instruct as I
from ..operators import segments as SG
from ..session import read_table
from . import sql_re2 as R
from .legal import legal, with_legal
from .registry import query

q = R.q
NL = "chr(10)"


# ---------------------------------------------------------------- examples

def examples_de(spark, sf_dir):
    """German examples: cleaned text of every German document × 4 tasks."""
    df = legal(spark, sf_dir).where(F.col("language") == "de")
    df = df.withColumn("full_text", T.clean_german("text"))
    df = I.fan_out_tasks(df, P.TASKS_DE)
    return I.build_examples(df, F.col("task"), "de", "full_text", id_cols=["doc_id"],
                            meta=I.german_metadata(), keep=["doc_id"])


EN_TASKS = [t for t, _, _ in P.TEMPLATES_EN]


def examples_en(spark, sf_dir):
    """English examples: normalised text of every English document × 4 tasks."""
    df = legal(spark, sf_dir).where(F.col("language") == "en")
    df = df.withColumn("nt", T.normalize("text", "en"))
    df = I.fan_out_tasks(df, EN_TASKS)
    meta = {"document_type": F.col("document_type"), "jurisdiction": F.col("jurisdiction"),
            "year": F.col("year"), "source": F.col("source")}
    return I.build_examples(df, F.col("task"), "en", "nt", id_cols=["doc_id"], meta=meta, keep=["doc_id"])


def _tpl_case(col: str, rows, idx: int, fallback: str) -> str:
    fb = [r for r in rows if r[0] == fallback][0][idx]
    whens = " ".join(f"WHEN {col} = {q(r[0])} THEN {q(r[idx])}" for r in rows)
    return f"CASE {whens} ELSE {q(fb)} END"


def _sql_examples_de() -> str:
    tasks = ", ".join(q(t) for t in P.TASKS_DE)
    ins = _tpl_case("task", P.TEMPLATES_DE, 1, P.TEMPLATE_FALLBACK_DE)
    res = _tpl_case("task", P.TEMPLATES_DE, 2, P.TEMPLATE_FALLBACK_DE)
    ft = R.clean_german_sql("text")
    tr = f"CASE WHEN length(ft) > 12000 THEN concat(substring(ft, 1, 12000), '...') ELSE ft END"
    return with_legal(f"""
, d AS (SELECT *, {ft} AS ft FROM legal WHERE language = 'de')
, x AS (SELECT *, unnest([{tasks}]) AS task FROM d)
, ex AS (SELECT md5(concat_ws('|', CAST(doc_id AS VARCHAR), task)) AS id, task,
  {q(P.SYSTEM_DE)} AS system, concat({ins}, {NL}, {NL}, {tr}) AS "user", {res} AS assistant,
  coalesce(document_type, 'unknown') AS document_type, coalesce(court, 'unknown') AS court,
  coalesce(date, 'unknown') AS date, coalesce(case_number, 'unknown') AS case_number,
  'de' AS language, {q(P.SOURCE_DE)} AS source FROM x)
""")


def _sql_examples_en() -> str:
    tasks = ", ".join(q(t) for t in EN_TASKS)
    ins = _tpl_case("task", P.TEMPLATES_EN, 1, P.TEMPLATE_FALLBACK_EN)
    res = _tpl_case("task", P.TEMPLATES_EN, 2, P.TEMPLATE_FALLBACK_EN)
    return with_legal(f"""
, d AS (SELECT *, {R.normalize_sql('text', "'en'")} AS nt FROM legal WHERE language = 'en')
, x AS (SELECT *, unnest([{tasks}]) AS task FROM d)
, ex AS (SELECT md5(concat_ws('|', CAST(doc_id AS VARCHAR), task)) AS id, task,
  {q(P.SYSTEM_EN)} AS system, concat({ins}, {NL}, {NL}, nt) AS "user", {res} AS assistant,
  document_type, jurisdiction, year, source FROM x)
""")


def _flat_de(df):
    c = F.col("conversations")
    return df.select("id", F.col("metadata.task").alias("task"),
                     CV.first_of_role(c, "system").alias("system"), CV.first_of_role(c, "user").alias("user"),
                     CV.first_of_role(c, "assistant").alias("assistant"), "metadata.document_type",
                     "metadata.court", "metadata.date", "metadata.case_number", "metadata.language",
                     "metadata.source")


@query("build_examples_de", _sql_examples_de() + 'SELECT * FROM ex')
def build_examples_de(spark, sf_dir):
    return _flat_de(examples_de(spark, sf_dir))


@query("build_examples_en", _sql_examples_en() + 'SELECT id, task, system, md5("user") AS user_md5, '
       'CAST(length("user") AS INTEGER) AS user_length, assistant, document_type, jurisdiction, year, source FROM ex')
def build_examples_en(spark, sf_dir):
    df = examples_en(spark, sf_dir)
    c = F.col("conversations")
    u = CV.first_of_role(c, "user")
    return df.select("id", F.col("metadata.task").alias("task"), CV.first_of_role(c, "system").alias("system"),
                     F.md5(u).alias("user_md5"), F.length(u).alias("user_length"),
                     CV.first_of_role(c, "assistant").alias("assistant"), "metadata.document_type",
                     "metadata.jurisdiction", "metadata.year", "metadata.source")


@query("fan_out_tasks", with_legal(
    "SELECT doc_id, task, " + _tpl_case("task", P.TEMPLATES_DE, 1, P.TEMPLATE_FALLBACK_DE) + " AS instruction "
    "FROM (SELECT doc_id, unnest([" + ", ".join(q(t) for t in P.TASKS_DE) + "]) AS task FROM legal WHERE language = 'de')"))
def fan_out_tasks(spark, sf_dir):
    df = I.fan_out_tasks(legal(spark, sf_dir).where(F.col("language") == "de"), P.TASKS_DE)
    ins, _ = I.template_columns(F.col("task"), "de")
    return df.select("doc_id", "task", ins.alias("instruction"))


@query("unfilled_placeholders", _sql_examples_de()
       + "SELECT id, CAST(len(ph) AS BIGINT) AS n_placeholders, array_to_string(ph, ',') AS placeholders "
       "FROM (SELECT id, regexp_extract_all(assistant, '\\{\\w+\\}', 0) AS ph FROM ex)")
def unfilled_placeholders(spark, sf_dir):
    df = examples_de(spark, sf_dir)
    ph = CV.unfilled_placeholders(CV.first_of_role(F.col("conversations"), "assistant"))
    return df.select("id", F.size(ph).cast("bigint").alias("n_placeholders"),
                     F.array_join(ph, ",").alias("placeholders"))


@query("fill_template", _sql_examples_de()
       + "SELECT id, replace(replace(replace(replace(assistant, '{category}', document_type), "
       "'{reasoning}', court), '{summary}', case_number), '{analysis}', date) AS filled FROM ex")
def fill_template(spark, sf_dir):
    df = examples_de(spark, sf_dir)
    values = F.create_map(F.lit("category"), F.col("metadata.document_type"), F.lit("reasoning"),
                          F.col("metadata.court"), F.lit("summary"), F.col("metadata.case_number"),
                          F.lit("analysis"), F.col("metadata.date"))
    a = CV.first_of_role(F.col("conversations"), "assistant")
    return df.select("id", CV.fill_template(a, values).alias("filled"))


@query("upgrade_templates", _sql_examples_de()
       + "SELECT id, task, CASE " + " ".join(
           f"WHEN task = {q(t)} THEN {q(dict(I.REASONING_TEMPLATES)[n])}" for t, n in I.DEFAULT_UPGRADE.items())
       + " ELSE assistant END AS assistant FROM ex")
def upgrade_templates(spark, sf_dir):
    df = I.upgrade_templates(examples_de(spark, sf_dir))
    return df.select("id", F.col("metadata.task").alias("task"),
                     CV.first_of_role(F.col("conversations"), "assistant").alias("assistant"))


# the reasoning templates that the default mapping leaves out
_OTHER_UPGRADE = dict(zip(("classification", "summarization", "case_analysis"),
                          sorted({n for n, _ in I.REASONING_TEMPLATES} - set(I.DEFAULT_UPGRADE.values()))))


@query("upgrade_templates_other", _sql_examples_de()
       + "SELECT id, task, CASE " + " ".join(
           f"WHEN task = {q(t)} THEN {q(dict(I.REASONING_TEMPLATES)[n])}" for t, n in _OTHER_UPGRADE.items())
       + " ELSE assistant END AS assistant FROM ex")
def upgrade_templates_other(spark, sf_dir):
    df = I.upgrade_templates(examples_de(spark, sf_dir), _OTHER_UPGRADE)
    return df.select("id", F.col("metadata.task").alias("task"),
                     CV.first_of_role(F.col("conversations"), "assistant").alias("assistant"))


# ---------------------------------------------------------------- conversations

_FIRST = ("SELECT conv_id, "
          "coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '') AS system, "
          "coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS \"user\", "
          "coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS assistant "
          "FROM conversations GROUP BY conv_id")


@query("first_of_role", _FIRST)
def first_of_role(spark, sf_dir):
    return I.first_of_role_long(read_table(spark, sf_dir, "conversations"))


@query("render_training_text",
       f"SELECT conv_id, concat('<|im_start|>system', {NL}, system, '<|im_end|>', {NL}, '<|im_start|>user', {NL}, "
       f"\"user\", '<|im_end|>', {NL}, '<|im_start|>assistant', {NL}, assistant, '<|im_end|>') AS text FROM ({_FIRST})")
def render_training_text(spark, sf_dir):
    return I.render_training_text_long(read_table(spark, sf_dir, "conversations"))


_RENDER = (f"SELECT conv_id, string_agg(concat('<|im_start|>', role, {NL}, text, {NL}, '<|im_end|>', {NL}), '' "
           "ORDER BY turn) FILTER (WHERE role IN ('system', 'user', 'assistant')) AS text "
           "FROM conversations GROUP BY conv_id")


def rendered(spark, sf_dir):
    conv = I.collect_turns(read_table(spark, sf_dir, "conversations"))
    return conv.select("conv_id", CV.render_conversation("conversations").alias("text"))


@query("render_conversation", f"SELECT conv_id, coalesce(text, '') AS text FROM ({_RENDER})")
def render_conversation(spark, sf_dir):
    return rendered(spark, sf_dir)


_SPAN_RE2 = r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"


@query("assistant_contents",
       f"SELECT conv_id, CAST(len(c) AS BIGINT) AS n_spans, array_to_string(c, ' ¦ ') AS contents FROM "
       f"(SELECT conv_id, regexp_extract_all(coalesce(text, ''), {q(_SPAN_RE2)}, 1) AS c FROM ({_RENDER}))")
def assistant_contents(spark, sf_dir):
    c = CV.assistant_contents(F.col("text"))
    return rendered(spark, sf_dir).select("conv_id", F.size(c).cast("bigint").alias("n_spans"),
                                          F.array_join(c, " ¦ ").alias("contents"))


@query("assistant_spans",
       f"WITH r AS (SELECT conv_id, coalesce(text, '') AS text FROM ({_RENDER})), "
       f"c AS (SELECT conv_id, text, regexp_extract_all(text, {q(_SPAN_RE2)}, 1) AS cs, "
       f"regexp_split_to_array(text, {q(_SPAN_RE2)}) AS ps FROM r) "
       "SELECT conv_id, CAST(i AS INTEGER) AS span_no, CAST(s AS INTEGER) AS start, CAST(s + length(cs[i + 1]) AS INTEGER) AS \"end\" FROM ("
       "SELECT conv_id, cs, i, list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + "
       f"coalesce(list_sum(list_transform(cs[1:i], lambda x: length(x) + {len(P.ASSISTANT_MARKER) + len(P.IM_END)})), 0) "
       f"+ {len(P.ASSISTANT_MARKER)} AS s FROM (SELECT conv_id, cs, ps, unnest(range(len(cs))) AS i FROM c))")
def assistant_spans(spark, sf_dir):
    """From segments: no conversation is collected."""
    turns = SG.assistant_turns(SG.segments(read_table(spark, sf_dir, "conversations")))
    return turns.select("conv_id", *[F.col(c).cast("int").alias(c) for c in ("span_no", "start", "end")])


_PIECE = (f"SELECT conv_id, turn, role, text, CASE WHEN role IN ('system', 'user', 'assistant') AND text IS NOT NULL "
          f"THEN concat('<|im_start|>', role, {NL}, text, {NL}, '<|im_end|>', {NL}) ELSE '' END AS piece FROM conversations")


@query("conversation_segments",
       f"SELECT conv_id, turn, role, md5(piece) AS piece_md5, CAST(e - length(piece) AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM "
       f"(SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM ({_PIECE}))")
def conversation_segments(spark, sf_dir):
    """Every turn's place in its rendered conversation."""
    s = SG.segments(read_table(spark, sf_dir, "conversations"))
    return s.select("conv_id", "turn", "role", F.md5("piece").alias("piece_md5"), "start", "end")


@query("assistant_turns",
       f"WITH r AS (SELECT conv_id, coalesce(text, '') AS text FROM ({_RENDER})) SELECT conv_id, CAST(i AS BIGINT) AS span_no, c AS content FROM "
       f"(SELECT conv_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM (SELECT conv_id, regexp_extract_all(text, {q(_SPAN_RE2)}, 1) AS cs FROM r))")
def assistant_turns(spark, sf_dir):
    """Contents of all assistant regions, a row each."""
    return SG.assistant_turns(SG.segments(read_table(spark, sf_dir, "conversations"))).select("conv_id", "span_no", "content")


@query("subword_tokens")
def subword_tokens(spark, sf_dir):
    """Sub-word tokens of every segment, cut at 2,048 a conversation, and those that a loss counts."""
    import public_tokenizers

    t = SG.subword_tokens(SG.segments(read_table(spark, sf_dir, "conversations")), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return t.select("conv_id", "turn", "token_start", "n_tokens", F.size("ids").alias("n_kept"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_loss"),
                    F.crc32(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_crc32"))


_WS = q(R.WS)


@query("token_truncate",
       f"SELECT conv_id, CAST(len(tk) AS INTEGER) AS n_tokens, len(tk) > 64 AS truncated, "
       f"array_to_string(tk[1:64], ' ') AS tokens FROM (SELECT conv_id, CASE WHEN t = '' THEN []::VARCHAR[] "
       f"ELSE string_split(t, ' ') END AS tk FROM (SELECT conv_id, trim(regexp_replace(coalesce(text, ''), {_WS}, ' ', 'g')) AS t "
       f"FROM ({_RENDER})))")
def token_truncate(spark, sf_dir):
    df = I.with_tokens(rendered(spark, sf_dir), "text", 64)
    return df.select("conv_id", "n_tokens", "truncated", F.array_join("tokens", " ").alias("tokens"))


def _loss_mask_sql() -> str:
    ws = q(R.WS)
    inside = ("(list_max(list_filter(st, lambda s: s < i)) IS NOT NULL AND (list_max(list_filter(en, lambda e: e < i)) IS NULL "
              "OR list_max(list_filter(en, lambda e: e < i)) < list_max(list_filter(st, lambda s: s < i))))")
    marker = "(contains(tk[i], '<|im_end|>') OR contains(tk[i], '<|im_start|>'))"
    return (f"WITH r AS (SELECT conv_id, coalesce(text, '') AS text FROM ({_RENDER})), "
            f"t AS (SELECT conv_id, CASE WHEN trim(regexp_replace(text, {ws}, ' ', 'g')) = '' THEN []::VARCHAR[] "
            f"ELSE string_split(trim(regexp_replace(text, {ws}, ' ', 'g')), ' ') END AS tk FROM r), "
            "m AS (SELECT conv_id, tk, list_filter(range(1, len(tk) + 1), lambda i: ends_with(tk[i], '<|im_start|>assistant')) AS st, "
            "list_filter(range(1, len(tk) + 1), lambda i: contains(tk[i], '<|im_end|>')) AS en FROM t) "
            "SELECT conv_id, CAST(len(tk) AS INTEGER) AS n_tokens, CAST(coalesce(list_sum(list_transform(range(1, len(tk) + 1), "
            f"lambda i: CASE WHEN {inside} AND NOT {marker} THEN 1 ELSE 0 END)), 0) AS INTEGER) AS n_assistant_tokens FROM m")


@query("loss_mask", _loss_mask_sql())
def loss_mask(spark, sf_dir):
    """From segments: a region ends in the segment in which it begins."""
    words = SG.word_mask(SG.segments(read_table(spark, sf_dir, "conversations")))
    return words.groupBy("conv_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sum("n_loss").cast("int").alias("n_assistant_tokens"))


@query("extract_response",
       f"SELECT conv_id, CASE WHEN a IS NULL THEN NULL ELSE regexp_replace(CASE WHEN contains(a, '<|im_end|>') "
       f"THEN string_split(a, '<|im_end|>')[1] ELSE a END, {q('^' + R.WS + '|' + R.WS + '$')}, '', 'g') END AS response "
       f"FROM (SELECT conv_id, string_split(coalesce(text, ''), '<|im_start|>assistant' || {NL})[2] AS a FROM ({_RENDER}))")
def extract_response(spark, sf_dir):
    return rendered(spark, sf_dir).select("conv_id", CV.extract_response("text").alias("response"))


# ---------------------------------------------------------------- prompts and requests

_PROMPT_TASK = "CASE doc_id % 4 WHEN 0 THEN 'classification' WHEN 1 THEN 'summarization' WHEN 2 THEN 'case_analysis' ELSE 'statute_interpretation' END"


def _prompt_sql() -> str:
    table = " ".join(f"WHEN task = {q(t)} AND eff = {q(l)} THEN {q(i)}"
                     for t, l, i in P.PROMPT_INSTRUCTIONS if t is not None)
    default = " ".join(f"WHEN eff = {q(l)} THEN {q(i)}" for t, l, i in P.PROMPT_INSTRUCTIONS if t is None)
    ins = f"CASE {table} ELSE CASE {default} END END"
    sysm = f"CASE WHEN eff = 'de' THEN {q(P.SYSTEM_DE)} ELSE {q(P.SYSTEM_EN)} END"
    return with_legal(
        f"SELECT doc_id, task, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_length "
        f"FROM (SELECT doc_id, task, concat('<|im_start|>system', {NL}, {sysm}, "
        f"{NL}, '<|im_end|>', {NL}, '<|im_start|>user', {NL}, {ins}, {NL}, {NL}, text, {NL}, '<|im_end|>', {NL}, "
        f"'<|im_start|>assistant', {NL}) AS prompt FROM (SELECT *, {_PROMPT_TASK} AS task, "
        f"CASE WHEN language = 'de' THEN 'de' ELSE 'en' END AS eff FROM legal))")


@query("build_prompt", _prompt_sql())
def build_prompt(spark, sf_dir):
    df = legal(spark, sf_dir).withColumn("task", F.expr(_PROMPT_TASK))
    p = I.build_prompt(F.col("text"), F.col("task"), F.col("language"))
    return df.select("doc_id", "task", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_length"))


@query("build_chat_prompt",
       f"SELECT item_id, concat('<|im_start|>system', {NL}, {q(P.SYSTEM_EN)}, {NL}, '<|im_end|>', {NL}, "
       f"'<|im_start|>user', {NL}, text, {NL}, '<|im_end|>', {NL}, '<|im_start|>assistant', {NL}) AS prompt FROM benchmark")
def build_chat_prompt(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", I.build_chat_prompt("text").alias("prompt"))


@query("build_eval_prompt", f"SELECT item_id, concat({q(I.EVAL_PROMPT_PREFIX)}, text) AS prompt FROM benchmark")
def build_eval_prompt(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", I.build_eval_prompt("text").alias("prompt"))


# Request bodies derived from ``conversations`` (same SQL text in both engines).
_ESC = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
_BODY = ("CASE WHEN conv_id % 10 = 7 THEN '{\"text\": \"brok' ELSE concat('{\"text\": \"', " + _ESC + ", '\"', "
         "CASE WHEN turn % 2 = 0 THEN concat(', \"task\": \"', CASE turn % 3 WHEN 0 THEN 'classification' "
         "WHEN 1 THEN 'summarization' ELSE 'case_analysis' END, '\"') ELSE '' END, "
         "CASE WHEN turn % 4 = 1 THEN ', \"temperature\": 0.2, \"max_new_tokens\": 64' ELSE '' END, "
         "CASE WHEN conv_id % 3 = 0 THEN ', \"language\": \"de\"' ELSE '' END, '}') END")
_CTYPE = "CASE WHEN conv_id % 10 = 5 THEN 'text/plain' ELSE 'application/json' END"


@query("parse_requests",
       f"SELECT conv_id, turn, CASE WHEN ok THEN coalesce(json_extract_string(body, '$.text'), '') ELSE '' END AS text, "
       "CASE WHEN ok THEN json_extract_string(body, '$.task') END AS task, "
       "CASE WHEN ok THEN coalesce(CAST(json_extract_string(body, '$.max_new_tokens') AS BIGINT), 512) ELSE 512 END AS max_new_tokens, "
       "CASE WHEN ok THEN coalesce(CAST(json_extract_string(body, '$.temperature') AS DOUBLE), 0.7) ELSE 0.7 END AS temperature, "
       "CASE WHEN ok THEN coalesce(CAST(json_extract_string(body, '$.top_p') AS DOUBLE), 0.9) ELSE 0.9 END AS top_p, "
       "CASE WHEN ok THEN coalesce(json_extract_string(body, '$.language'), 'en') ELSE 'en' END AS language, "
       "CASE WHEN ctype <> 'application/json' THEN concat('Unsupported content type: ', ctype) "
       "WHEN NOT ok THEN 'invalid JSON' END AS error "
       f"FROM (SELECT conv_id, turn, body, ctype, json_valid(body) AS ok FROM (SELECT conv_id, turn, {_BODY} AS body, "
       f"{_CTYPE} AS ctype FROM conversations))")
def parse_requests(spark, sf_dir):
    df = read_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_BODY} AS body",
                                                               f"{_CTYPE} AS ctype")
    out = I.parse_requests(df, "body", "ctype")
    return out.select("conv_id", "turn", "text", "task", "max_new_tokens", "temperature", "top_p",
                      "language", "error")


_MODEL_OUT = ("CASE turn % 3 WHEN 0 THEN concat('<think>', text, '</think>', chr(10), '<answer>', "
              "text, '</answer>') WHEN 1 THEN concat('<think>', text) ELSE text END")


@query("parse_reasoning",
       "SELECT conv_id, turn, CASE WHEN regexp_matches(o, '(?s)<think>(.*?)</think>') THEN "
       "trim(regexp_extract(o, '(?s)<think>(.*?)</think>', 1)) END AS think, "
       "CASE WHEN regexp_matches(o, '(?s)<answer>(.*?)</answer>') THEN "
       "trim(regexp_extract(o, '(?s)<answer>(.*?)</answer>', 1)) END AS answer, "
       "coalesce(regexp_matches(o, '(?s)^\\s*<think>.*?</think>\\s*<answer>.*?</answer>\\s*$'), false) AS well_formed "
       f"FROM (SELECT conv_id, turn, {_MODEL_OUT} AS o FROM conversations WHERE role = 'assistant')")
def parse_reasoning(spark, sf_dir):
    df = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    df = df.selectExpr("conv_id", "turn", f"{_MODEL_OUT} AS o")
    r = CV.parse_reasoning(F.col("o"))
    return df.select("conv_id", "turn", r["think"].alias("think"), r["answer"].alias("answer"),
                     r["well_formed"].alias("well_formed"))


# ---------------------------------------------------------------- example filters and counts
from ..operators import filters as FL  # noqa: E402
from ..operators import profile as PR  # noqa: E402


@query("filter_task", _sql_examples_de() + "SELECT id, task FROM ex WHERE task = 'summarization'")
def filter_task(spark, sf_dir):
    return FL.filter_task(examples_de(spark, sf_dir), "summarization").select("id", F.col("metadata.task").alias("task"))


@query("filter_language", _sql_examples_de() + "SELECT id, language FROM ex WHERE language = 'de'")
def filter_language(spark, sf_dir):
    return FL.filter_language(examples_de(spark, sf_dir), "de").select(
        "id", F.col("metadata.language").alias("language"))


@query("task_counts", _sql_examples_en() + "SELECT coalesce(task, 'unknown') AS task, CAST(count(*) AS BIGINT) AS count "
       "FROM ex GROUP BY 1")
def task_counts(spark, sf_dir):
    return PR.task_counts(examples_en(spark, sf_dir), "metadata.task")
