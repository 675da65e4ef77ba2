"""Driver queries for evaluation (EVL).

Classification pairs: truth from ``labels`` (toxic → Tort, quality 1 →
Contract, else Criminal) written into the English label sentence; the
prediction sentence comes from a rule on ``documents``. Text pairs: each
user turn of ``conversations`` against the next assistant turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import porter as PO
from ..functions import text as T
from ..operators import evaluate as EV
from ..operators import splits as SP
from ..session import read_table
from . import sql_re2 as R
from .legal import legal, with_legal
from .registry import query

q = R.q

_TRUTH = "CASE WHEN toxic = 1 THEN 'Tort' WHEN quality = 1 THEN 'Contract' ELSE 'Criminal' END"
_REF_TEXT = f"concat('Based on my analysis, this document falls under ', {_TRUTH}, ' because quality is ', CAST(quality AS STRING), '.')"
_PRED_TEXT = ("CASE WHEN doc_id % 13 = 0 THEN 'I cannot decide.' ELSE concat('Based on my analysis, this document falls under ', "
              "CASE WHEN n_chars > 3000 THEN 'Contract' WHEN doc_id % 5 = 0 THEN 'Tort' ELSE 'Criminal' END, "
              "' because of its length.') END")


def refs_cls(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").selectExpr("doc_id", f"{_REF_TEXT} AS reference")


def preds_cls(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PRED_TEXT} AS prediction")


def cls_pairs(spark, sf_dir):
    j = EV.matched(preds_cls(spark, sf_dir), refs_cls(spark, sf_dir), "doc_id")
    return j.select("doc_id", EV.extract_label("reference").alias("true_label"),
                    EV.extract_label("prediction").alias("predicted_label"))


_CLS_SQL = (f"cls AS (SELECT l.doc_id, {_REF_TEXT.replace('quality', 'l.quality')} AS reference, {_PRED_TEXT.replace('doc_id', 'd.doc_id')} "
            "AS prediction FROM labels l JOIN documents d ON l.doc_id = d.doc_id), "
            "lab AS (SELECT doc_id, coalesce(regexp_extract(reference, 'document falls under ([\\pL\\pN_]+)', 1), '') AS t0, "
            "coalesce(regexp_extract(prediction, 'document falls under ([\\pL\\pN_]+)', 1), '') AS p0 FROM cls), "
            "lab2 AS (SELECT doc_id, CASE WHEN t0 = '' THEN 'unknown' ELSE t0 END AS true_label, "
            "CASE WHEN p0 = '' THEN 'unknown' ELSE p0 END AS predicted_label FROM lab)")


@query("extract_label", f"WITH {_CLS_SQL} SELECT doc_id, true_label, predicted_label FROM lab2")
def extract_label(spark, sf_dir):
    return cls_pairs(spark, sf_dir)


_DE_TEXT = ("CASE doc_id % 4 WHEN 0 THEN concat('Basierend auf meiner Analyse fällt dieses Dokument in die Kategorie ', source, ', weil ', text) "
            "WHEN 1 THEN concat(text, ' Dieses Dokument fällt in die Kategorie ', lang, '.') ELSE text END")


@query("extract_label_de", f"SELECT doc_id, CASE WHEN l = '' THEN 'unknown' ELSE l END AS label FROM (SELECT doc_id, "
       f"coalesce(regexp_extract({_DE_TEXT}, '(?:Dokument fällt|fällt dieses Dokument) in die Kategorie ([\\pL\\pN_]+)', 1), '') AS l FROM documents)")
def extract_label_de(spark, sf_dir):
    """German label phrases of both word orders in whole texts."""
    return read_table(spark, sf_dir, "documents").select("doc_id", EV.extract_label(F.expr(_DE_TEXT), "de").alias("label"))


@query("accuracy", f"WITH {_CLS_SQL} SELECT round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lab2")
def accuracy(spark, sf_dir):
    return EV.accuracy(cls_pairs(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


_PRF_SQL = (", lc AS (SELECT label, sum(sup) AS support, sum(pr) AS predicted, sum(tp) AS tp FROM ("
            "SELECT true_label AS label, 1 AS sup, 0 AS pr, CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS tp FROM lab2 "
            "UNION ALL SELECT predicted_label, 0, 1, 0 FROM lab2) GROUP BY label), "
            "s AS (SELECT support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, "
            "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM lc), "
            "s2 AS (SELECT support, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM s) ")


@query("weighted_prf", f"WITH {_CLS_SQL} {_PRF_SQL} SELECT round(sum(support * p) / sum(support), 6) AS precision, "
       "round(sum(support * r) / sum(support), 6) AS recall, round(sum(support * f) / sum(support), 6) AS f1 FROM s2")
def weighted_prf(spark, sf_dir):
    r = EV.weighted_prf(cls_pairs(spark, sf_dir))
    return r.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("confusion", f"WITH {_CLS_SQL}, labs AS (SELECT DISTINCT label FROM (SELECT true_label AS label FROM lab2 "
       "UNION SELECT predicted_label FROM lab2)) SELECT a.label AS true_label, b.label AS predicted_label, "
       "CAST(count(l.doc_id) AS BIGINT) AS n FROM labs a CROSS JOIN labs b LEFT JOIN lab2 l ON l.true_label = a.label "
       "AND l.predicted_label = b.label GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return EV.confusion(cls_pairs(spark, sf_dir), dense=True)


@query("align_unmatched", f"SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p.doc_id IS NULL THEN "
       "'missing_prediction' WHEN r.doc_id IS NULL THEN 'missing_reference' ELSE 'matched' END AS status FROM labels r "
       "FULL OUTER JOIN (SELECT doc_id FROM documents) p ON r.doc_id = p.doc_id) GROUP BY status")
def align_unmatched(spark, sf_dir):
    j = EV.align(preds_cls(spark, sf_dir), refs_cls(spark, sf_dir), "doc_id")
    return j.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("batch_mean", f"WITH {_CLS_SQL} SELECT round(avg(acc), 6) AS accuracy, CAST(count(*) AS BIGINT) AS batches FROM ("
       "SELECT b, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS acc FROM (SELECT *, "
       "floor((row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) - 1) / 50) AS b "
       "FROM lab2) GROUP BY b)")
def batch_mean(spark, sf_dir):
    b = SP.with_batch_id(cls_pairs(spark, sf_dir), "doc_id", 50)
    r = EV.batch_mean(b, "batch_id", {"accuracy": F.avg((F.col("true_label") == F.col("predicted_label")).cast("double"))})
    return r.select(F.round("accuracy", 6).alias("accuracy"), F.col("batches").cast("bigint").alias("batches"))


# ---------------------------------------------------------------- text pairs

_TASK = "CASE a.conv_id % 3 WHEN 0 THEN 'summarization' WHEN 1 THEN 'case_analysis' ELSE 'statute_interpretation' END"


def text_pairs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").alias("a")
    a = c.where(F.col("role") == "assistant").alias("b")
    j = u.join(a, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select(F.concat_ws("-", F.col("a.conv_id").cast("string"), F.col("a.turn").cast("string")).alias("id"),
                    F.expr(_TASK).alias("task"), F.col("b.text").alias("reference"), F.col("a.text").alias("prediction"))


_PAIRS_SQL = ("pairs AS (SELECT concat_ws('-', CAST(a.conv_id AS VARCHAR), CAST(a.turn AS VARCHAR)) AS id, "
              f"{_TASK} AS task, b.text AS reference, a.text AS prediction FROM conversations a JOIN conversations b "
              "ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')")


def _tok_rouge(col: str) -> str:
    t = f"trim(regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END"


def _tok_ws(col: str) -> str:
    t = f"trim(regexp_replace(coalesce({col}, ''), {q(R.WS)}, ' ', 'g'))"
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END"


def _grams(tok: str, n: int) -> str:
    return (f"CASE WHEN len({tok}) >= {n} THEN list_transform(range(len({tok}) - {n} + 1), "
            f"lambda i: array_to_string({tok}[i + 1:i + {n}], ' ')) ELSE []::VARCHAR[] END")


def _hits_sql(src: str, tok_fn, ns, tk: str | None = None) -> str:
    """CTE body: (id, n, hits) from table ``src`` with reference/prediction; ``tk``: its own CTEs of tokens."""
    tk = tk or f"tk AS (SELECT id, {tok_fn('reference')} AS tk_r, {tok_fn('prediction')} AS tk_p FROM {src})"
    parts = []
    for n in ns:
        for side, col in (("r", "reference"), ("p", "prediction")):
            parts.append(f"SELECT id, {n} AS n, '{side}' AS side, unnest({_grams('tk_' + side, n)}) AS gram FROM tk")
    grams = " UNION ALL ".join(parts)
    return (f"{tk}, "
            f"g AS ({grams}), "
            "gc AS (SELECT id, n, gram, sum(CASE WHEN side = 'r' THEN 1 ELSE 0 END) AS cr, "
            "sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS cp FROM g GROUP BY id, n, gram), "
            "hits AS (SELECT id, n, sum(least(cr, cp)) AS hits FROM gc GROUP BY id, n)")


def _stemmed_tk(src: str) -> str:
    """Tokens of the pairs, each distinct one stemmed once; the stemmer's steps as a chain of CTEs."""
    last = len(PO.steps())
    chain = [f"p{k + 1} AS (SELECT word, {new} AS w FROM (SELECT *, {suffix} AS s FROM (SELECT word, w, {PO._cv()} AS cv FROM p{k})))" for k, (suffix, new) in enumerate(PO.steps())]
    sides = " UNION ALL ".join(f"SELECT id, '{side}' AS side, unnest(tk_{side}) AS t, generate_subscripts(tk_{side}, 1) AS i FROM raw" for side in "rp")
    return (f"raw AS (SELECT id, {_tok_rouge('reference')} AS tk_r, {_tok_rouge('prediction')} AS tk_p FROM {src}), tokens AS ({sides}), "
            f"p0 AS (SELECT DISTINCT t AS word, t AS w FROM tokens), {', '.join(chain)}, "
            f"stems AS (SELECT word, coalesce({PO.irregular()}, CASE WHEN length(word) < {PO.SHORTEST} THEN word ELSE w END) AS stem FROM p{last}), "
            f"st AS (SELECT id, side, list(CASE WHEN length(t) < {PO.SHORTEST} THEN t ELSE stem END ORDER BY i) AS l FROM tokens JOIN stems ON word = t GROUP BY id, side), "
            "tk AS (SELECT raw.id, coalesce(a.l, []) AS tk_r, coalesce(b.l, []) AS tk_p FROM raw LEFT JOIN st a ON a.id = raw.id AND a.side = 'r' "
            "LEFT JOIN st b ON b.id = raw.id AND b.side = 'p')")


#: Longest common subsequences of ``tk``: a row of the dynamic program for each token of the prediction.
_LCS_SQL = ("dp AS (SELECT id, 0 AS i, j, 0 AS v FROM (SELECT id, unnest(range(0, len(tk_r) + 1)) AS j FROM tk) AS z UNION ALL "
            "SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM (SELECT d.id, d.i + 1 AS i, d.j, greatest(d.v, CASE WHEN d.j > 0 AND tk_r[d.j] = tk_p[d.i + 1] "
            "THEN lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + 1 ELSE 0 END) AS c FROM dp d JOIN tk USING (id) WHERE d.i < len(tk_p)) AS n), "
            "lcs AS (SELECT id, max(v) AS l FROM dp GROUP BY id), "
            "rl AS (SELECT id, CASE WHEN l > 0 THEN 2 * (l / len(tk_p)) * (l / len(tk_r)) / (l / len(tk_p) + l / len(tk_r)) ELSE 0.0 END AS rougeL FROM lcs JOIN tk USING (id))")


def _rouge_sql(src: str, ns=(1, 2), tk: str | None = None) -> str:
    cols = []
    for n in ns:
        h = f"coalesce((SELECT hits FROM hits h WHERE h.id = tk.id AND h.n = {n}), 0)"
        pc = f"greatest(len(tk_p) - {n} + 1, 0)"
        rc = f"greatest(len(tk_r) - {n} + 1, 0)"
        p = f"({h} / greatest({pc}, 1))"
        r = f"({h} / greatest({rc}, 1))"
        cols.append(f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END AS rouge{n}")
    return f"{_hits_sql(src, _tok_rouge, ns, tk)}, rg AS (SELECT id, {', '.join(cols)} FROM tk)"


def _bleu_sql(src: str) -> str:
    ns = (1, 2, 3, 4)
    logs = []
    for n in ns:
        h = f"coalesce((SELECT hits FROM hits h WHERE h.id = tk.id AND h.n = {n}), 0)"
        den = f"CAST(greatest(len(tk_p) - {n} + 1, 1) AS DOUBLE)"
        logs.append(f"ln(CASE WHEN {h} = 0 THEN 0.1 / {den} ELSE {h} / {den} END)")
    h1 = "coalesce((SELECT hits FROM hits h WHERE h.id = tk.id AND h.n = 1), 0)"
    bp = "CASE WHEN len(tk_p) > len(tk_r) THEN 1.0 WHEN len(tk_p) = 0 THEN 0.0 ELSE exp(1 - len(tk_r) / len(tk_p)) END"
    return (f"{_hits_sql(src, _tok_ws, ns)}, bl AS (SELECT id, CASE WHEN {h1} = 0 THEN 0.0 ELSE {bp} * exp(("
            + " + ".join(logs) + ") / 4.0) END AS bleu FROM tk)")


@query("rouge1", f"WITH {_PAIRS_SQL}, {_rouge_sql('pairs', (1,))} SELECT id, round(rouge1, 6) AS rouge1 FROM rg")
def rouge1(spark, sf_dir):
    r = EV.rouge_n(text_pairs(spark, sf_dir), "id", "reference", "prediction", (1,))
    return r.select("id", F.round("rouge1", 6).alias("rouge1"))


@query("rouge2", f"WITH {_PAIRS_SQL}, {_rouge_sql('pairs', (2,))} SELECT id, round(rouge2, 6) AS rouge2 FROM rg")
def rouge2(spark, sf_dir):
    r = EV.rouge_n(text_pairs(spark, sf_dir), "id", "reference", "prediction", (2,))
    return r.select("id", F.round("rouge2", 6).alias("rouge2"))


@query("rouge_stemmed", f"WITH RECURSIVE {_PAIRS_SQL}, {_rouge_sql('pairs', (1, 2), _stemmed_tk('pairs'))}, {_LCS_SQL} "
       "SELECT id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougeL, 6) AS rougeL FROM rg JOIN rl USING (id)")
def rouge_stemmed(spark, sf_dir):
    """ROUGE-1/2/L over stems of tokens longer than 3 letters, all from one pass over the stemmed pairs."""
    r = EV.rouge(text_pairs(spark, sf_dir), "id", "reference", "prediction", stemmer=PO.stem_tokens)
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


@query("stem_dictionary", f"WITH {_PAIRS_SQL}, {_stemmed_tk('pairs')} SELECT word, stem FROM stems")
def stem_dictionary(spark, sf_dir):
    """The stem of every distinct token of the pairs."""
    p = text_pairs(spark, sf_dir).select(F.explode(F.array("reference", "prediction")).alias("t"))
    return PO.stems(p.select(F.explode(EV.rouge_tokens("t")).alias("word")).distinct())


@query("rouge_l", f"WITH RECURSIVE {_PAIRS_SQL}, tk AS (SELECT id, {_tok_rouge('reference')} AS tk_r, {_tok_rouge('prediction')} AS tk_p FROM pairs), {_LCS_SQL} "
       "SELECT id, round(rougeL, 6) AS rougeL FROM rl")
def rouge_l(spark, sf_dir):
    r = EV.rouge_l(text_pairs(spark, sf_dir), "id", "reference", "prediction")
    return r.select("id", F.round("rougeL", 6).alias("rougeL"))


@query("bleu", f"WITH {_PAIRS_SQL}, {_bleu_sql('pairs')} SELECT id, round(bleu, 6) AS bleu FROM bl")
def bleu(spark, sf_dir):
    r = EV.bleu(text_pairs(spark, sf_dir), "id", "reference", "prediction")
    return r.select("id", F.round("bleu", 6).alias("bleu"))


def _all_pairs(spark, sf_dir):
    """Classification pairs (task 'classification') + text pairs."""
    c = EV.matched(preds_cls(spark, sf_dir), refs_cls(spark, sf_dir), "doc_id")
    c = c.select(F.col("doc_id").cast("string").alias("id"), F.lit("classification").alias("task"),
                 "reference", "prediction")
    return c.unionByName(text_pairs(spark, sf_dir))


def _overall_sql(stemmed: bool = False) -> str:
    src = (f"WITH RECURSIVE {_CLS_SQL}, {_PAIRS_SQL}, {_PRF_SQL.lstrip(', ')}, "
           f"{_rouge_sql('pairs', (1, 2), _stemmed_tk('pairs') if stemmed else None)}{f', {_LCS_SQL}' if stemmed else ''}")
    # BLEU over summarization pairs with its own CTE names
    b = _bleu_sql("(SELECT * FROM pairs WHERE task = 'summarization')")
    for a, z in (("tk", "btk"), ("g AS", "bg AS"), ("gc", "bgc"), ("hits", "bhits"), ("FROM g ", "FROM bg ")):
        b = b.replace(a, z)
    b = b.replace("bg AS (", "bg AS (", 1)
    metrics = (
        "SELECT 'classification_accuracy' AS metric, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS value FROM lab2 "
        "UNION ALL SELECT 'classification_precision', sum(support * p) / sum(support) FROM s2 "
        "UNION ALL SELECT 'classification_recall', sum(support * r) / sum(support) FROM s2 "
        "UNION ALL SELECT 'classification_f1', sum(support * f) / sum(support) FROM s2 "
        "UNION ALL SELECT concat(task, '_rouge1'), avg(rouge1) FROM rg JOIN pairs USING (id) GROUP BY task "
        "UNION ALL SELECT concat(task, '_rouge2'), avg(rouge2) FROM rg JOIN pairs USING (id) GROUP BY task "
        "UNION ALL SELECT 'summarization_bleu', avg(bleu) FROM bl")
    if stemmed:
        metrics += " UNION ALL SELECT concat(task, '_rougeL'), avg(rougeL) FROM rl JOIN pairs USING (id) GROUP BY task"
    return f"{src}, {b} SELECT metric, round(value, 6) AS value FROM ({metrics}) WHERE value IS NOT NULL"


@query("overall_metrics", _overall_sql())
def overall_metrics(spark, sf_dir):
    s = EV.score_pairs(_all_pairs(spark, sf_dir), "id", "task", "reference", "prediction", with_rouge_l=False)
    return EV.evaluate_by_task(s).select("metric", F.round("value", 6).alias("value"))


@query("evaluate_by_task", _overall_sql(stemmed=True))
def evaluate_by_task(spark, sf_dir):
    """The reference's dispatch, with its stemmed ROUGE."""
    s = EV.score_pairs(_all_pairs(spark, sf_dir), "id", "task", "reference", "prediction", stemmer=PO.stem_tokens)
    return EV.evaluate_by_task(s).select("metric", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- other metrics

_SCORE = "CAST(n_chars AS DOUBLE) / 1000.0"


@query("auc", f"WITH d AS (SELECT l.quality AS label, {_SCORE} AS score FROM labels l JOIN documents d USING (doc_id)), "
       "a AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg "
       "FROM d GROUP BY score), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING "
       "AND 1 PRECEDING), 0) AS below FROM a) SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc, "
       "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM b")
def auc(spark, sf_dir):
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select(F.col("quality").alias("label"), (F.col("n_chars").cast("double") / 1000.0).alias("score"))
    r = EV.auc(d)
    return r.select(F.round("auc", 6).alias("auc"), "positives", "negatives")


@query("mse", "SELECT round(avg(pow(quality - least(CAST(n_chars AS DOUBLE) / 5000.0, 1.0), 2)), 6) AS mse "
       "FROM labels JOIN documents USING (doc_id)")
def mse(spark, sf_dir):
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.withColumn("p", F.least(F.col("n_chars").cast("double") / 5000.0, F.lit(1.0)))
    return EV.mse(d, "quality", "p").select(F.round("mse", 6).alias("mse"))


@query("throughput", "SELECT event_type AS task, CAST(count(*) AS BIGINT) AS requests, round(avg(value), 6) AS avg_seconds, "
       "round(max(value), 6) AS max_seconds, "
       "round(avg(CASE WHEN value > 0 THEN 256.0 / value END), 6) AS tokens_per_second FROM events GROUP BY event_type")
def throughput(spark, sf_dir):
    r = EV.throughput(read_table(spark, sf_dir, "events"), "event_type", "value")
    return r.select(F.col("event_type").alias("task"), "requests",
                    *[F.round(c, 6).alias(c) for c in ("avg_seconds", "max_seconds", "tokens_per_second")])


_LOG_LINE = ("concat('step ', CAST(event_id AS VARCHAR), ' ', CASE WHEN event_id % 2 = 0 THEN 'train_loss: ' "
             "ELSE 'validation_accuracy: ' END, CAST(value AS VARCHAR))")


@query("log_metrics", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'train:loss' ELSE 'validation:accuracy' END AS metric, "
       "value FROM events WHERE value >= 0")
def log_metrics(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").selectExpr("event_id", f"{_LOG_LINE.replace('VARCHAR', 'STRING')} AS line")
    r = EV.parse_log_metrics(e, "line")
    return r.select("event_id", "metric", "value")


@query("best_checkpoint", "SELECT user_id AS run_id, first(event_id ORDER BY value, event_id) AS best_step, min(value) AS best_loss "
       "FROM events GROUP BY user_id")
def best_checkpoint(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                                                   F.col("value").alias("loss"))
    return EV.best_checkpoint(e, "step", "loss", ["run_id"])


# reward over German legal documents: answer = second half of the normalised text
_OUT = ("CASE WHEN doc_id % 2 = 0 THEN concat('<think>', substring(nt, 1, 300), '</think>', chr(10), '<answer>', "
        "substring(nt, 301), '</answer>') ELSE nt END")


def _reward_sql() -> str:
    cits = R.citations_sql("nt", "'de'")
    ans = ("CASE WHEN regexp_matches(o, '(?s)<answer>(.*?)</answer>') THEN trim(regexp_extract(o, '(?s)<answer>(.*?)</answer>', 1)) END")
    acits = R.citations_sql("ans", "'de'")
    return with_legal(
        f", d AS (SELECT doc_id, {R.normalize_sql('text', chr(39) + 'de' + chr(39))} AS nt FROM legal WHERE language = 'de'), "
        f"o AS (SELECT doc_id, nt, {_OUT} AS o FROM d), a AS (SELECT doc_id, o, {ans} AS ans, list_distinct({cits}) AS rc FROM o), "
        f"b AS (SELECT doc_id, o, list_distinct(coalesce({acits}, []::VARCHAR[])) AS pc, rc FROM a) "
        "SELECT doc_id, coalesce(regexp_matches(o, '(?s)^\\s*<think>.*?</think>\\s*<answer>.*?</answer>\\s*$'), false) AS format_ok, "
        "round(CASE WHEN len(pc) > 0 THEN len(list_intersect(pc, rc)) / len(pc) END, 6) AS citation_precision, "
        "round(CASE WHEN len(rc) > 0 THEN len(list_intersect(pc, rc)) / len(rc) END, 6) AS citation_recall FROM b")


@query("reward", _reward_sql())
def reward(spark, sf_dir):
    d = legal(spark, sf_dir).where(F.col("language") == "de").select("doc_id", T.normalize("text", "de").alias("nt"))
    d = d.withColumn("o", F.expr(_OUT)).withColumn("rc", T.citations(F.col("nt"), "de"))
    r = EV.reward(d, "o", "rc", lambda c: T.citations(c, "de"))
    return r.select("doc_id", "format_ok", F.round("citation_precision", 6).alias("citation_precision"),
                    F.round("citation_recall", 6).alias("citation_recall"))


@query("targets", f"WITH {_CLS_SQL}, m AS (SELECT 'reasoning_accuracy' AS metric, avg(CASE WHEN true_label = predicted_label "
       "THEN 1.0 ELSE 0.0 END) AS value FROM lab2 UNION ALL SELECT 'practice_areas', CAST(count(DISTINCT true_label) AS DOUBLE) FROM lab2 "
       "UNION ALL SELECT 'expert_approval', avg(quality) FROM labels UNION ALL SELECT 'latency_seconds', avg(value) FROM events) "
       "SELECT metric, round(value, 6) AS value, CASE metric WHEN 'reasoning_accuracy' THEN '>' WHEN 'practice_areas' THEN '>=' "
       "WHEN 'expert_approval' THEN '>' ELSE '<=' END AS op, CASE metric WHEN 'reasoning_accuracy' THEN 0.8 WHEN 'practice_areas' "
       "THEN 5.0 WHEN 'expert_approval' THEN 0.75 ELSE 5.0 END::DOUBLE AS target, CASE metric WHEN 'reasoning_accuracy' THEN value > 0.8 "
       "WHEN 'practice_areas' THEN value >= 5.0 WHEN 'expert_approval' THEN value > 0.75 ELSE value <= 5.0 END AS passed FROM m")
def targets(spark, sf_dir):
    acc = EV.accuracy(cls_pairs(spark, sf_dir)).select(F.lit("reasoning_accuracy").alias("metric"),
                                                       F.col("accuracy").alias("value"))
    areas = cls_pairs(spark, sf_dir).agg(F.countDistinct("true_label").cast("double").alias("value")).select(
        F.lit("practice_areas").alias("metric"), "value")
    appr = read_table(spark, sf_dir, "labels").agg(F.avg("quality").alias("value")).select(
        F.lit("expert_approval").alias("metric"), "value")
    lat = read_table(spark, sf_dir, "events").agg(F.avg("value").alias("value")).select(
        F.lit("latency_seconds").alias("metric"), "value")
    m = acc.unionByName(areas).unionByName(appr).unionByName(lat)
    return EV.check_targets(m).select("metric", F.round("value", 6).alias("value"), "op", "target", "passed")


@query("metrics_file", _overall_sql())
def metrics_file(spark, sf_dir):
    """SNK-10: the overall metrics written as JSON and read back."""

    from ..session import scratch_folder
    from ..sources import sinks as SK
    path = scratch_folder(spark, "metrics")
    SK.write_metrics(overall_metrics(spark, sf_dir), path)
    return spark.read.schema("metric string, value double").json(path)
