"""Driver queries for sources, monitoring, run costs and batch inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost as CO
from ..operators import infer as INF
from ..operators import monitor as MO
from ..session import kept, read_table, scratch_folder, small_batches
from ..sources import markup as MK
from ..sources import readers as RD
from ..sources import sinks as SK
from .instruct_q import _flat_de, _sql_examples_de, examples_de
from .legal import legal, with_legal
from .registry import query
from .sql_re2 import WS


def _files(df, path, content):
    """Rows (path, content as bytes): files that no folder has to list."""
    return df.select(path.alias("path"), F.encode(content, "UTF-8").alias("content"))


# ---------------------------------------------------------------- sources


def _html_text_sql() -> str:
    """RE2 rendering of the text rule for the pages table: drop script /
    style / template blocks, comments and declarations, split at tags, decode
    the entities present in the data (&amp; last), strip, drop empties."""
    from . import sql_re2 as R2
    ws = R2.WS[:-1]
    dec = "x"
    for ent, ch in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'")):
        dec = f"replace({dec}, {R2.q(ent)}, {R2.q(ch)})"
    dec = f"regexp_replace({dec}, '&amp;?', '&', 'g')"  # last, one pass: '&amp' decodes without ';' too
    blocks = (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
              r"|<!--.*?-->|<!.*?>")
    return ("SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(html, "
            f"{R2.q(blocks)}, ' ', 'g'), '<[^>]*>'), lambda x: regexp_replace({dec}, {R2.q('^' + ws + '+|' + ws + '+$')}, "
            "'', 'g')), lambda x: x <> ''), ' ') AS text, CAST(NULL AS VARCHAR) AS error FROM pages")


@query("html_text", _html_text_sql())
def html_text(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    t = MK.html_to_text("html")
    return p.select("page_id", t["value"].alias("text"), t["error"].alias("error"))


_OPINION_HTML = ("concat('<html><body><h1>', url, '</h1>', '<div class=\"opinion main\"><h3>', url, '</h3>', "
                 "'<span class=\"date\">2024-01-', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0'), '</span>', "
                 "'<div class=\"opinion-text\">', html, '</div></div>', "
                 "'<div class=\"opinion\"><h3>Dissent ', CAST(page_id AS STRING), '</h3><div class=\"opinion-text\"><p>', "
                 "url, '</p></div></div></body></html>')")


def _opinions_sql() -> str:
    """The wrapped pages have balanced markup, so the first opinion's text is
    the concatenation of the page's visible text nodes (entities decoded, no
    separator), the second one's is the URL."""
    from . import sql_re2 as R2
    dec = "x"
    for ent, ch in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'")):
        dec = f"replace({dec}, {R2.q(ent)}, {R2.q(ch)})"
    dec = f"regexp_replace({dec}, '&amp;?', '&', 'g')"  # last, one pass: '&amp' decodes without ';' too
    blocks = (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
              r"|<!--.*?-->|<!.*?>")
    direct = (f"array_to_string(list_transform(regexp_split_to_array(regexp_replace(html, {R2.q(blocks)}, '', 'g'), "
              f"'<[^>]*>'), lambda x: {dec}), '')")
    return (f"WITH d AS (SELECT page_id, url, {direct} AS t FROM pages) "
            "SELECT page_id, CAST(0 AS INTEGER) AS ordinal, url AS title, md5(t) AS text_md5, "
            "CAST(length(t) AS INTEGER) AS text_length, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date "
            "FROM d UNION ALL SELECT page_id, CAST(1 AS INTEGER), 'Dissent ' || CAST(page_id AS VARCHAR), md5(url), "
            "CAST(length(url) AS INTEGER), CAST(NULL AS VARCHAR) FROM d")


@query("opinions_from_html", _opinions_sql())
def opinions_from_html(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").selectExpr("page_id", f"{_OPINION_HTML} AS html")
    return MK.extract_opinions(p, "page_id", "html").select(
        "page_id", "ordinal", "title", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"), "date")


def _escape_xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _decision_xml():
    """A decision of the legal view as XML, in a namespace."""
    return F.concat(F.lit("<dokument xmlns='urn:decision'><Gericht>"), _escape_xml(F.coalesce("court", F.lit(""))),
                    F.lit("</Gericht><Datum>"), _escape_xml(F.col("date")), F.lit("</Datum><Aktenzeichen>"),
                    _escape_xml(F.col("case_number")), F.lit("</Aktenzeichen><text>"), _escape_xml(F.col("text")),
                    F.lit("</text></dokument>"))


def _decisions_sql() -> str:
    from . import sql_re2 as R2
    from .legal import with_legal
    full = R2.clean_german_sql("concat(coalesce(court, ''), ' ', date, ' ', case_number, ' ', text, ' ', text)")
    has = ", ".join(f"regexp_matches(full_text, {R2.q(p)}) AS has_{n}" for n, p in R2.SECTIONS_DE)
    return with_legal(
        f", d AS (SELECT doc_id, coalesce(court, '') AS court, date, case_number, {full} AS full_text FROM legal "
        "WHERE language = 'de') SELECT CAST(doc_id AS VARCHAR) AS source_file, court, date, case_number, "
        f"CAST(NULL AS VARCHAR) AS error, md5(full_text) AS full_text_md5, {has} FROM d")


@query("decisions_from_xml", _decisions_sql())
def decisions_from_xml(spark, sf_dir):
    lg = legal(spark, sf_dir).where(F.col("language") == "de")
    d = lg.select(F.col("doc_id").cast("string").alias("source_file"), _decision_xml().alias("xml"))
    out = MK.parse_decisions(d, "xml", "source_file")
    return out.select("source_file", "court", "date", "case_number", "error", F.md5("full_text").alias("full_text_md5"),
                      *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("tatbestand", "gruende", "tenor", "leitsaetze")])


@query("round_trip_jsonl", _sql_examples_de() + "SELECT * FROM ex")
def round_trip_jsonl(spark, sf_dir):
    """Write the German examples as JSONL to the shared scratch folder, read
    them back with the tolerant reader, flatten."""
    path = scratch_folder(spark, "round_trip")
    SK.write_examples(examples_de(spark, sf_dir).drop("doc_id"), path)
    good, _bad = RD.read_examples(spark, path)
    return _flat_de(good)


@query("load_examples_limit", _sql_examples_de()
       + "SELECT id, task FROM (SELECT * FROM ex ORDER BY id LIMIT 300) WHERE task = 'classification'")
def load_examples_limit(spark, sf_dir):
    """SRC-07: examples written as JSONL in id order; the first 300 *lines*
    are read, then the task filter runs (cap before filter)."""
    path = scratch_folder(spark, "load_limit")
    SK.write_examples(examples_de(spark, sf_dir).drop("doc_id").orderBy("id"), path)
    ex = RD.load_examples(spark, path, max_samples=300, task="classification")
    return ex.select("id", F.col("metadata.task").alias("task"))


# ---------------------------------------------------------------- monitoring

@query("hourly_quality",
       "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, "
       "event_type, CAST(count(*) AS BIGINT) AS requests, round(avg(value), 6) AS avg_value, max(value) AS max_value, "
       "CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM events GROUP BY 1, 2, 3")
def hourly_quality(spark, sf_dir):
    r = MO.window_quality(read_table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour")
    return r.withColumn("avg_value", F.round("avg_value", 6))


@query("stream_quality",
       "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, "
       "event_type, CAST(count(*) AS BIGINT) AS requests, round(avg(value), 6) AS avg_value, max(value) AS max_value, "
       "CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM events GROUP BY 1, 2, 3")
def stream_quality(spark, sf_dir):
    """STR-02 as a stream over the events file, all windows closed at its end."""
    from ..streaming.jobs import close_quality, run_quality_stream
    base = scratch_folder(spark, "stream_quality")
    run_quality_stream(spark, sf_dir, f"{base}/out", checkpoint=f"{base}/ckpt", glob="events.parquet").awaitTermination()
    close_quality(spark, f"{base}/ckpt", f"{base}/out")
    return spark.read.parquet(f"{base}/out").drop("epoch_id").withColumn("avg_value", F.round("avg_value", 6))


_BASE_COLS = [("event_id", "bigint", True), ("user_id", "bigint", True), ("event_type", "string", False),
              ("value", "double", True)]


def _baseline_sql(where: str = "") -> str:
    parts = []
    for c, t, num in _BASE_COLS:
        mn = f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        me = f"avg({c})" if num else "CAST(NULL AS DOUBLE)"
        sd = f"stddev_samp({c})" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT CAST(count(*) AS BIGINT) AS rows, '{c}' AS \"column\", '{t}' AS type, "
                     f"round(count({c}) / count(*), 6) AS completeness, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct, "
                     f"{mn} AS min, {mx} AS max, round({me}, 6) AS mean, round({sd}, 6) AS std FROM events {where}")
    return " UNION ALL ".join(parts)


def _round_base(b):
    return b.select("rows", "column", "type", F.round("completeness", 6).alias("completeness"), "distinct", "min",
                    "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("baseline", _baseline_sql())
def baseline(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return _round_base(MO.baseline(ev, [c for c, _, _ in _BASE_COLS], exact=True))


_CUT = "TIMESTAMP '2024-01-01 12:00:00'"


_VIOLATIONS_SQL = (
       f"WITH b AS ({_baseline_sql('WHERE ts < ' + _CUT)}), ev AS (SELECT * FROM events WHERE ts >= {_CUT}), "
       "l AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS ws, c.name AS col, c.x AS x, c.is_null AS is_null FROM ev, "
       "LATERAL (VALUES ('event_id', CAST(event_id AS DOUBLE), event_id IS NULL), ('value', value, value IS NULL)) "
       "AS c(name, x, is_null)) "
       "SELECT l.ws AS window_start, l.ws + INTERVAL 1 hour AS window_end, l.col AS \"column\", CAST(count(*) AS BIGINT) AS rows, "
       "round(sum(CASE WHEN NOT is_null THEN 1 ELSE 0 END) / count(*), 6) AS completeness, "
       "CAST(sum(CASE WHEN x < b.min OR x > b.max THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, "
       "sum(CASE WHEN NOT is_null THEN 1 ELSE 0 END) / count(*) < max(b.completeness) AS completeness_violation "
       "FROM l JOIN b ON b.\"column\" = l.col GROUP BY 1, 2, 3")


@query("violations", _VIOLATIONS_SQL)
def violations(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    cut = F.lit("2024-01-01 12:00:00").cast(ev.schema["ts"].dataType)  # same type as ts: no zone shift
    base = _round_base(MO.baseline(ev.where(F.col("ts") < cut), [c for c, _, _ in _BASE_COLS], exact=True))
    v = MO.violations(ev.where(F.col("ts") >= cut), base, "ts", ["event_id", "value"], "1 hour")
    return v.withColumn("completeness", F.round("completeness", 6))


@query("stream_violations", _VIOLATIONS_SQL)
def stream_violations(spark, sf_dir):
    """MON-02 as a stream over the later events against a kept baseline of the earlier ones."""
    from ..streaming.jobs import close_violations, run_violations_stream
    folder = scratch_folder(spark, "stream_violations")
    ev = read_table(spark, sf_dir, "events")
    cut = F.lit("2024-01-01 12:00:00").cast(ev.schema["ts"].dataType)
    base = kept(_round_base(MO.baseline(ev.where(F.col("ts") < cut), [c for c, _, _ in _BASE_COLS], exact=True)), "baseline")
    ev.where(F.col("ts") >= cut).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    run_violations_stream(spark, f"{folder}/in", base, f"{folder}/out", ["event_id", "value"], checkpoint=f"{folder}/ckpt").awaitTermination()
    close_violations(spark, f"{folder}/ckpt", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").drop("epoch_id").withColumn("completeness", F.round("completeness", 6))


@query("drift_psi",
       f"WITH a AS (SELECT value FROM events WHERE ts < {_CUT}), b AS (SELECT value FROM events WHERE ts >= {_CUT}), "
       "m AS (SELECT min(value) AS lo, max(value) AS hi FROM a), "
       "ba AS (SELECT CAST(CAST(CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((value - lo) / ((hi - lo) / 10)), 0), 9) END AS BIGINT) AS VARCHAR) AS bin FROM a, m WHERE value IS NOT NULL), "
       "bb AS (SELECT CAST(CAST(CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((value - lo) / ((hi - lo) / 10)), 0), 9) END AS BIGINT) AS VARCHAR) AS bin FROM b, m WHERE value IS NOT NULL), "
       "ca AS (SELECT bin, count(*) AS na FROM ba GROUP BY bin), cb AS (SELECT bin, count(*) AS nb FROM bb GROUP BY bin), "
       "j AS (SELECT coalesce(ca.bin, cb.bin) AS bin, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM ca FULL OUTER JOIN cb ON ca.bin = cb.bin), "
       "s AS (SELECT bin, greatest(na / sum(na) OVER (), 1e-6) AS p, greatest(nb / sum(nb) OVER (), 1e-6) AS q FROM j) "
       "SELECT bin, round(p, 6) AS p, round(q, 6) AS q, round((p - q) * ln(p / q), 6) AS term, "
       "round(sum((p - q) * ln(p / q)) OVER (), 6) AS psi FROM s")
def drift_psi(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    cut = F.lit("2024-01-01 12:00:00").cast(ev.schema["ts"].dataType)  # same type as ts: no zone shift
    d = MO.drift(ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut), "value", 10)
    return d.select("bin", *[F.round(c, 6).alias(c) for c in ("p", "q", "term", "psi")])


@query("compare_variants",
       "SELECT variant, CAST(count(*) AS BIGINT) AS rows, round(avg(value), 6) AS avg_value, "
       "CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM (SELECT *, CASE WHEN "
       "(('0x' || substr(md5(concat_ws('|', '42', CAST(user_id AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0) < 0.7 "
       "THEN 'ModelA' ELSE 'ModelB' END AS variant FROM events) GROUP BY variant")
def compare_variants(spark, sf_dir):
    r = MO.compare_variants(read_table(spark, sf_dir, "events"), "user_id", {"ModelA": 0.7, "ModelB": 0.3},
                            {"avg_value": F.round(F.avg("value"), 6), "users": F.countDistinct("user_id")})
    return r


# ---------------------------------------------------------------- run costs

_TYPES = [r[0] for r in CO.INSTANCES]
_TYPE_CASE = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"


def runs(spark, sf_dir):
    """Run log stand-in: one run per order, hours = Σ line quantities / 10."""
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") / 10.0).alias("hours"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TYPE_CASE).alias("instance_type"))
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_orderkey").alias("run_id"),
                                                                 "instance_type", "hours")


def _price_values() -> str:
    rows = ", ".join(f"('{r[0]}', {r[1]}, {r[5]}, {r[6]}, {r[8]}, {r[9]})" for r in CO.INSTANCES)
    return f"p(instance_type, gpus, on_demand, spot, efficiency, improved_efficiency) AS (VALUES {rows})"


_RUNS_SQL = (f"r AS (SELECT o_orderkey AS run_id, {_TYPE_CASE} AS instance_type, h.hours FROM orders JOIN "
             "(SELECT l_orderkey, sum(l_quantity) / 10.0 AS hours FROM lineitem GROUP BY l_orderkey) h ON o_orderkey = h.l_orderkey)")
_COSTS_SQL = (f"WITH {_RUNS_SQL}, {_price_values()}, c AS (SELECT r.*, p.gpus, p.on_demand * hours AS on_demand_cost, "
              "p.spot * hours AS spot_cost, hours * (p.efficiency / p.improved_efficiency) AS adjusted_hours, "
              "p.spot * hours * (p.efficiency / p.improved_efficiency) AS spot_cost_adjusted, "
              "p.on_demand * hours * (p.efficiency / p.improved_efficiency) AS on_demand_cost_adjusted FROM r JOIN p USING (instance_type)) ")


@query("run_costs", _COSTS_SQL + "SELECT instance_type, CAST(count(*) AS BIGINT) AS runs, round(sum(hours), 6) AS hours, "
       "round(sum(on_demand_cost), 6) AS on_demand_cost, round(sum(spot_cost), 6) AS spot_cost, "
       "round(sum(adjusted_hours), 6) AS adjusted_hours, round(sum(spot_cost_adjusted), 6) AS spot_cost_adjusted "
       "FROM c GROUP BY instance_type")
def run_costs(spark, sf_dir):
    c = CO.run_costs(runs(spark, sf_dir), CO.price_table(spark))
    s = CO.cost_summary(c)
    return s.select("instance_type", "runs", *[F.round(x, 6).alias(x) for x in
                                               ("hours", "on_demand_cost", "spot_cost", "adjusted_hours",
                                                "spot_cost_adjusted")])


@query("cost_savings", _COSTS_SQL + "SELECT instance_type, round(avg((on_demand_cost - on_demand_cost_adjusted) / on_demand_cost * 100), 6) "
       "AS on_demand_savings_pct, round(avg((spot_cost - spot_cost_adjusted) / spot_cost * 100), 6) AS spot_savings_pct, "
       "round(avg((1 - spot_cost / on_demand_cost) * 100), 6) AS spot_vs_on_demand_pct, "
       "round(avg(on_demand_cost / hours / gpus), 6) AS price_per_gpu_hour FROM c WHERE hours > 0 GROUP BY instance_type")
def cost_savings(spark, sf_dir):
    c = CO.run_costs(runs(spark, sf_dir).where(F.col("hours") > 0), CO.price_table(spark))
    return c.groupBy("instance_type").agg(
        F.round(F.avg("on_demand_savings_pct"), 6).alias("on_demand_savings_pct"),
        F.round(F.avg("spot_savings_pct"), 6).alias("spot_savings_pct"),
        F.round(F.avg("spot_vs_on_demand_pct"), 6).alias("spot_vs_on_demand_pct"),
        F.round(F.avg("price_per_gpu_hour"), 6).alias("price_per_gpu_hour"))


@query("cheapest_config", _COSTS_SQL + "SELECT instance_type, round(avg(spot_cost_adjusted), 6) AS spot_cost FROM c "
       "GROUP BY instance_type ORDER BY spot_cost, instance_type LIMIT 1")
def cheapest_config(spark, sf_dir):
    c = CO.run_costs(runs(spark, sf_dir), CO.price_table(spark))
    per = c.groupBy("instance_type").agg(F.round(F.avg("spot_cost_adjusted"), 6).alias("spot_cost"))
    return CO.cheapest(per, "spot_cost")


# ---------------------------------------------------------------- batch inference

_STRIP = "'^" + WS + "|" + WS + "$'"
_ANSWERS_SQL = ("WITH u AS (SELECT a.conv_id, a.turn, b.text AS answer FROM conversations a LEFT JOIN conversations b "
                "ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'), "
                f"r AS (SELECT conv_id, turn, regexp_replace(string_split(answer, '<|im_end|>')[1], {_STRIP}, '', 'g') AS response, "
                "CASE WHEN answer IS NULL THEN 'LookupError: no recorded answer' END AS error FROM u) ")
_BODY_SQL = "CASE WHEN error IS NOT NULL THEN to_json({'error': error}) ELSE to_json({'response': response}) END::VARCHAR"


def answered(spark, sf_dir):
    """Every user turn as a prompt, answered by the assistant turn after it."""
    turns = read_table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return INF.encode_response(INF.predict_recorded(asked, answers, ["conv_id", "turn"], "text", "case_analysis", "en"))


@query("batch_predict", _ANSWERS_SQL + f"SELECT conv_id, turn, response, error, {_BODY_SQL} AS body FROM r")
def batch_predict(spark, sf_dir):
    """INF-01..03: prompts, recorded answers, extracted responses and JSON bodies."""
    return answered(spark, sf_dir).select("conv_id", "turn", "response", "error", "body")


@query("batch_predict_stub", _ANSWERS_SQL + "SELECT conv_id, turn, CASE WHEN l = '' THEN 'unknown' ELSE l END AS label, error FROM "
       "(SELECT *, coalesce(regexp_extract(response, 'document falls under ([\\pL\\pN_]+)', 1), '') AS l FROM r)")
def batch_predict_stub(spark, sf_dir):
    """INF-01: labels of the recorded answers."""
    from ..operators.evaluate import extract_label
    return answered(spark, sf_dir).select("conv_id", "turn", extract_label("response").alias("label"), "error")


@query("batch_predict_failures", _ANSWERS_SQL + f"SELECT conv_id, turn, error, {_BODY_SQL} AS error_body FROM r WHERE error IS NOT NULL")
def batch_predict_failures(spark, sf_dir):
    """INF-02: a prompt without an answer becomes its row's error; the others are answered."""
    r = answered(spark, sf_dir).where("error IS NOT NULL")
    return r.select("conv_id", "turn", "error", F.col("body").alias("error_body"))


# ---------------------------------------------------------------- directory batch (SRC-01/04/05)

def _dir_sql(select: str = "SELECT doc_id, 'txt' AS file_type, md5(processed_text) AS processed_md5, "
                           "CAST(len(cits) AS BIGINT) AS n_citations FROM p", docs: str = "", ending: str = " || chr(10)") -> str:
    from . import sql_re2 as R2
    from .legal import with_legal
    from .text_q import _NORM, _masked_cte, _sections_cte
    from ..operators.preprocess import ALL_SECTIONS
    return with_legal(
        f", docs AS (SELECT doc_id, 'en' AS language, text{ending} AS text FROM legal{docs})"
        f", n AS ({_NORM.replace('FROM legal', 'FROM docs')})"
        f", s0 AS ({_sections_cte(False)}), s AS ({_sections_cte(True)}), m AS ({_masked_cte()})"
        f", p AS (SELECT *, {R2.citations_sql('nt', 'language')} AS cits, "
        f"concat_ws(chr(10) || chr(10), {', '.join(ALL_SECTIONS)}) AS processed_text FROM m) " + select)


# the type of a document's file; some files are of no supported type, not UTF-8 or not closed
_EXT = "CASE WHEN doc_id % 50 = 12 THEN 'pdf' WHEN doc_id % 5 = 3 THEN 'html' WHEN doc_id % 5 = 4 THEN 'xml' ELSE 'txt' END"
_REJECT = ("CASE WHEN doc_id % 50 = 12 THEN 'Unsupported file format' WHEN doc_id % 50 = 7 THEN 'invalid UTF-8' "
           "WHEN doc_id % 50 = 24 THEN 'ParseError' END")


@query("process_directory", _dir_sql(
    f"SELECT doc_id, {_EXT} AS file_type, md5(processed_text) AS processed_md5, CAST(len(cits) AS BIGINT) AS n_citations, "
    f"CAST(NULL AS VARCHAR) AS error FROM p UNION ALL SELECT doc_id, {_EXT}, NULL, NULL, {_REJECT} FROM legal "
    f"WHERE {_REJECT} IS NOT NULL", f" WHERE {_REJECT} IS NULL", ""))
def process_directory(spark, sf_dir):
    """The directory batch over rows (path, bytes) made of the legal
    documents: text, HTML and XML files and such as have to be rejected."""
    lg = legal(spark, sf_dir)
    ext, reject, text = F.expr(_EXT), F.expr(_REJECT), F.col("text")
    marked = (F.when(ext == "html", F.concat(F.lit("<html><body><script>no</script><p>"), _escape_xml(text), F.lit("</p></body></html>")))
              .when(reject == "ParseError", F.concat(F.lit("<d><t>"), _escape_xml(text)))
              .when(ext == "xml", F.concat(F.lit("<d><t>"), _escape_xml(text), F.lit("</t></d>"))).otherwise(text))
    content = F.encode(marked, "UTF-8")
    content = F.when(reject == "invalid UTF-8", F.concat(F.unhex(F.lit("FF")), content)).otherwise(content)
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    tagged = RD.tagged_files(lg.select(path.alias("source_file"), content.alias("content")), "en")
    doc_id = F.regexp_extract("source_file", r"/in/(\d+)", 1).cast("bigint").alias("doc_id")
    kind = F.regexp_extract("error", r"^(Unsupported file format|invalid UTF-8|ParseError)", 1)
    good = F.col("error").isNull()
    return tagged.select(doc_id, "file_type", F.when(good, F.md5("processed_text")).alias("processed_md5"),
                         F.when(good, F.size("citations").cast("bigint")).alias("n_citations"), kind.alias("error"))


# ---------------------------------------------------------------- archives (SRC-10)

def _archived_sql() -> str:
    return (f"SELECT concat(source_file, '.zip') AS source_file, * EXCLUDE (source_file) FROM ({_decisions_sql()}) "
            f"WHERE CAST(source_file AS BIGINT) % 20 <> 3")


@query("archive_decisions", "SELECT source_file, court, date, case_number, full_text_md5, error FROM ("
       + _archived_sql() + ") UNION ALL SELECT concat(CAST(doc_id AS VARCHAR), '.zip'), NULL, NULL, NULL, NULL, 'no XML member' "
       "FROM documents WHERE lang = 'de' AND doc_id % 20 = 3")
def archive_decisions(spark, sf_dir):
    """Each German decision in a ZIP of its own (some without an XML member),
    expanded and parsed; archives that can't be read are rejects."""
    import io
    import zipfile

    import pandas as pd

    small_batches(spark)
    lg = legal(spark, sf_dir).where(F.col("language") == "de")

    def zipped(batches):
        for b in batches:
            rows = []
            for doc_id, xml in zip(b["doc_id"], b["xml"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("readme.txt", "no decision")
                    if doc_id % 20 != 3:
                        z.writestr(f"{doc_id}.xml", xml)
                rows.append((f"{doc_id}.zip", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = lg.select("doc_id", _decision_xml().alias("xml")).mapInPandas(zipped, "path string, content binary")
    expanded = RD.expand_archive_rows(files)
    out = MK.parse_decisions(expanded.where("error is null"), "xml", "source_file")
    bad = expanded.where("error is not null")
    columns = ["source_file", "court", "date", "case_number"]
    return out.select(*columns, F.md5("full_text").alias("full_text_md5"), "error").unionByName(bad.select(
        "source_file", *[F.lit(None).cast("string").alias(c) for c in (*columns[1:], "full_text_md5")], "error"))


@query("archive_members", f"SELECT source_file, court, date, case_number, full_text_md5, error FROM ({_decisions_sql()})")
def archive_members(spark, sf_dir):
    """German decisions as members of a few archives, read through the archive source and parsed."""
    from ..sources import archives as AR
    folder = scratch_folder(spark, "archives")
    lg = legal(spark, sf_dir).where(F.col("language") == "de")
    AR.write_archives(lg.select(F.format_string("%d.zip", F.col("doc_id") % 4).alias("archive"), F.format_string("%d.xml", F.col("doc_id")).alias("member"),
                                _decision_xml().alias("content")), folder)
    AR.register(spark)
    members = spark.read.format("archive").option("path", folder).option("partitionBytes", 1 << 16).load()
    out = MK.parse_decisions(members.select(F.regexp_extract("member", r"^(\d+)", 1).alias("source_file"), F.col("content").alias("xml")), "xml", "source_file")
    return out.select("source_file", "court", "date", "case_number", F.md5("full_text").alias("full_text_md5"), "error")


# ---------------------------------------------------------------- catalogue (SRC-09)

_CAT_LINK = "CASE WHEN document_type IS NOT NULL THEN concat('https://example.invalid/', CAST(doc_id AS STRING)) END"


@query("catalogue_items", with_legal(
    "SELECT coalesce(court, 'Unknown') AS court, coalesce(date, 'Unknown') AS date, "
    "coalesce(case_number, 'Unknown') AS case_number, link FROM (SELECT *, " + _CAT_LINK + " AS link FROM legal "
    "ORDER BY doc_id LIMIT 600) WHERE link IS NOT NULL AND link <> ''"))
def catalogue_items(spark, sf_dir):
    """A catalogue written with the XML writer (one <item> per document in id
    order; empty fields are omitted), read back with the item cap counted
    before the link filter."""
    path = scratch_folder(spark, "catalogue")
    items = legal(spark, sf_dir).selectExpr("doc_id", "court AS gericht", "date AS `entsch-datum`",
                                            "case_number AS aktenzeichen", f"{_CAT_LINK} AS link")
    items.orderBy("doc_id").drop("doc_id").write.format("xml").option("rowTag", "item").option(
        "rootTag", "root").save(path)
    return RD.read_catalogue(spark, path, max_items=600)


# ---------------------------------------------------------------- processed documents (SRC-08)

def _processed_docs_sql() -> str:
    from . import sql_re2 as R2
    has = ", ".join(f"regexp_matches(ft, {R2.q(p)}) AS has_{n}" for n, p in R2.SECTIONS_DE)
    return with_legal(
        f", d AS (SELECT doc_id, court, date, case_number, {R2.clean_german_sql('text')} AS ft FROM legal "
        "WHERE language = 'de') SELECT CAST(doc_id AS VARCHAR) AS source_file, court, date, case_number, "
        f"md5(ft) AS full_text_md5, {has} FROM d")


@query("processed_docs", _processed_docs_sql())
def processed_docs(spark, sf_dir):
    """German decisions processed (clean text, sections without fallback), kept
    as rows of (path, JSON document) and read back with the declared schema."""
    from ..functions import text as T
    from ..operators.preprocess import with_sections
    path = scratch_folder(spark, "processed")
    d = legal(spark, sf_dir).where(F.col("language") == "de").withColumn("full_text", T.clean_german("text"))
    d = with_sections(d, "full_text", "de", fallback=False)
    doc = F.struct(F.struct("court", "date", "case_number").alias("metadata"), F.col("full_text"),
                   F.struct("tatbestand", "gruende", "tenor", "leitsaetze").alias("sections"),
                   F.col("doc_id").cast("string").alias("source_file"))
    _files(d, F.concat(F.col("doc_id").cast("string"), F.lit(".json")), F.to_json(doc, {"pretty": "true"})).write.parquet(path)
    r = RD.processed_rows(spark.read.parquet(path))
    return r.select("source_file", "metadata.court", "metadata.date", "metadata.case_number",
                    F.md5("full_text").alias("full_text_md5"),
                    *[F.col(f"sections.{c}").isNotNull().alias(f"has_{c}")
                      for c in ("tatbestand", "gruende", "tenor", "leitsaetze")])


# ---------------------------------------------------------------- prompts file and saved splits (SRC-13/14)

def _prompts_sql() -> str:
    from . import sql_re2 as R2
    ws = R2.WS
    return ("SELECT regexp_replace(line, " + R2.q("^" + ws + "|" + ws + "$") + ", '', 'g') AS prompt FROM "
            "(SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM benchmark)")


@query("prompts_file", _prompts_sql())
def prompts_file(spark, sf_dir):
    """Benchmark passages written as a text file (one row per line group),
    read back as one stripped prompt per line."""
    from ..session import read_table
    path = scratch_folder(spark, "prompts")
    read_table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return RD.read_prompts(spark, path)


@query("saved_splits", _sql_examples_de() + (
    "SELECT id, task FROM (SELECT id, task, CASE WHEN rn <= floor(0.9::DOUBLE * n) THEN 'train' ELSE 'validation' END AS split "
    "FROM (SELECT id, task, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id) AS rn, "
    "count(*) OVER () AS n FROM ex)) WHERE split = 'validation'"))
def saved_splits(spark, sf_dir):
    """German examples split 90/10, saved as parquet partitioned by split,
    and the validation set read back (partition pruning)."""
    from ..operators import splits as SP
    path = scratch_folder(spark, "splits")
    s = SP.split_two_way(examples_de(spark, sf_dir).drop("doc_id"), "id", 0.9)
    SK.write_splits(s, path)
    return RD.read_splits(spark, path, "validation").select("id", F.col("metadata.task").alias("task"))


# ---------------------------------------------------------------- text files, documents and splits as JSON (SRC-01, PRJ-02, SNK-01, SNK-04)

@query("text_files", "SELECT item_id, md5(concat(text, chr(10))) AS raw_md5, 'txt' AS file_type, 'en' AS language FROM benchmark")
def text_files(spark, sf_dir):
    """Benchmark passages as text files, kept as rows of (path, bytes), with file metadata."""
    from ..operators.filters import with_file_metadata
    path = scratch_folder(spark, "text_files")
    _files(read_table(spark, sf_dir, "benchmark"), F.concat(F.col("item_id").cast("string"), F.lit(".txt")), F.concat("text", F.lit("\n"))).write.parquet(path)
    r = with_file_metadata(RD.text_rows(spark.read.parquet(path)), "source_file", "en")
    return r.select(F.regexp_extract("source_file", r"^(\d+)", 1).cast("bigint").alias("item_id"), F.md5("raw").alias("raw_md5"),
                    "file_type", "language")


@query("written_docs", "SELECT concat(CAST(doc_id AS VARCHAR), '.txt.json') AS doc_key, md5(text) AS text_md5, n_chars FROM documents")
def written_docs(spark, sf_dir):
    path = scratch_folder(spark, "written_docs")
    d = read_table(spark, sf_dir, "documents")
    SK.write_docs(d.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), "text", "n_chars"), path)
    back = spark.read.schema("doc_key string, text string, n_chars long").json(path)
    return back.select("doc_key", F.md5("text").alias("text_md5"), "n_chars")


@query("splits_jsonl", _sql_examples_de() + (
    "SELECT id, CASE WHEN rn <= floor(0.9::DOUBLE * n) THEN 'train' ELSE 'validation' END AS split, md5(\"user\") AS user_md5 "
    "FROM (SELECT id, \"user\", row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id) AS rn, "
    "count(*) OVER () AS n FROM ex)"))
def splits_jsonl(spark, sf_dir):
    """German examples split 90/10, as JSON Lines by split, and read back."""
    from ..operators import splits as SP
    path = scratch_folder(spark, "splits_jsonl")
    SK.write_splits_jsonl(SP.split_two_way(examples_de(spark, sf_dir).drop("doc_id"), "id", 0.9), path)
    back = spark.read.schema(RD.EXAMPLE_SCHEMA).json(path)
    return back.select("id", "split", F.md5(F.col("conversations")[1]["content"]).alias("user_md5"))


# ---------------------------------------------------------------- sinks (SNK-02, SNK-08)

@query("task_example_files", _sql_examples_de() + "SELECT id, task, \"user\" AS user_content FROM ex")
def task_example_files(spark, sf_dir):
    """Examples written one JSON record per (document, task), partitioned by
    task, and read back with the example schema (task from the folder)."""
    path = scratch_folder(spark, "task_examples")
    ex = examples_de(spark, sf_dir).drop("doc_id").withColumn("task", F.col("metadata.task"))
    SK.write_task_examples(ex, path)
    back = spark.read.schema(RD.EXAMPLE_SCHEMA).json(path)  # `task` comes back as the partition column
    return back.select("id", "task", F.col("conversations")[1]["content"].alias("user_content"))


@query("snapshot_copy", _sql_examples_de() + "SELECT id, task, system FROM ex")
def snapshot_copy(spark, sf_dir):
    """Examples saved as parquet, snapshotted twice with the row count and
    content hash verified (the second copies no file), and read back."""
    path = scratch_folder(spark, "dataset")
    ex = examples_de(spark, sf_dir).drop("doc_id")
    ex.write.parquet(path)
    for version in ("v1", "v2"):
        snap = SK.snapshot(spark, path, version)
        if not snap["verified"] or (version == "v2" and snap["copied"]):
            raise RuntimeError(f"snapshot verification failed: {snap}")
    back = SK.read_snapshot(spark, path, "v2")
    return back.select("id", F.col("metadata.task").alias("task"), F.col("conversations")[0]["content"].alias("system"))


@query("predictions_file", _ANSWERS_SQL + f"SELECT conv_id, turn, response, error, {_BODY_SQL} AS body FROM r")
def predictions_file(spark, sf_dir):
    """SNK-09: predictions written as JSON Lines and read back."""
    path = scratch_folder(spark, "predictions")
    SK.write_predictions(batch_predict(spark, sf_dir), path)
    return spark.read.schema("conv_id long, turn long, response string, error string, body string").json(path)


@query("published_splits", _sql_examples_de() + (
    "SELECT id, split FROM (SELECT id, CASE WHEN rn <= floor(0.9::DOUBLE * n) THEN 'train' ELSE 'validation' END AS split "
    "FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id) AS rn, "
    "count(*) OVER () AS n FROM ex))"))
def published_splits(spark, sf_dir):
    """SNK-07: splits published under a prefix as JSON Lines; every
    returned split URI is read back."""
    from functools import reduce

    from ..operators import splits as SP
    base = scratch_folder(spark, "published")
    s = SP.split_two_way(examples_de(spark, sf_dir).drop("doc_id"), "id", 0.9)
    uris = SK.publish(s, base, splits=("train", "validation"))
    parts = [spark.read.schema(RD.EXAMPLE_SCHEMA).json(u).select("id", F.lit(k).alias("split")) for k, u in uris.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- stream ingest (STR-01)

@query("stream_ingest", _dir_sql())
def stream_ingest(spark, sf_dir):
    """STR-01: documents as rows of (path, bytes), ingested by the Structured Streaming
    job (availableNow, checkpointed), output read back; equals the batch."""
    from ..streaming.jobs import stream_documents
    base = scratch_folder(spark, "stream")
    docs = _files(legal(spark, sf_dir), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.concat("text", F.lit("\n")))
    docs.withColumnRenamed("path", "source_file").write.parquet(f"{base}/in")
    stream_documents(spark, f"{base}/in", f"{base}/out", "en", checkpoint=f"{base}/ckpt", rows=True).awaitTermination()
    good = spark.read.parquet(f"{base}/out").where("kind = 'documents'")
    doc_id = F.regexp_extract("source_file", r"/in/(\d+)", 1).cast("bigint")
    return good.select(doc_id.alias("doc_id"), "file_type", F.md5("processed_text").alias("processed_md5"),
                       F.size("citations").cast("bigint").alias("n_citations"))
