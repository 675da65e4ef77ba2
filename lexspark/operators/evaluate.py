"""Evaluation (EVL-01..19): labels, classification metrics, ROUGE, BLEU,
AUC, per-task dispatch and metric tables.

Scoring is one plan, never a driver loop: predictions are equi-joined to
references on id, every row is scored, and means come from ``groupBy``.
The tokens of a pair meet by its id and its n-grams are counted where they
are, a few pairs at a time (NumPy in an Arrow UDF), so that n-grams, several
times the text, are never rows that are sorted, spilled or shuffled. The
longest common subsequence (ROUGE-L) is an Arrow-batched pandas UDF with a
bit-parallel LCS (O(m·n/64) per pair, no token cap).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import patterns as P

_WORD = r"[\p{L}\p{N}_]+"  # Python's Unicode \w


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_pattern(lang: str = "en", mode: str = "tolerant") -> str:
    """EVL-01 pattern. DE ``tolerant`` also accepts the word order of the
    German template ("fällt dieses Dokument in die Kategorie")."""
    if lang == "de":
        if mode == "reference":
            return P.LABEL_DE.replace(r"(\w+)", f"({_WORD})")
        return r"(?:Dokument fällt|fällt dieses Dokument) in die Kategorie (" + _WORD + ")"
    return P.LABEL_EN.replace(r"(\w+)", f"({_WORD})")


def extract_label(text, lang: str = "en", mode: str = "tolerant") -> Column:
    """EVL-01: first word after the label phrase (case-sensitive); no
    match (or NULL text) → 'unknown'."""
    t = F.coalesce(_c(text), F.lit(""))
    pat = label_pattern(lang, mode)
    first = F.try_element_at(F.regexp_extract_all(t, F.lit(pat), F.lit(1)), F.lit(1))
    return F.coalesce(first, F.lit("unknown"))


def align(preds: DataFrame, refs: DataFrame, id_col: str = "id") -> DataFrame:
    """EVL-19: full outer equi-join on id with a status column
    ('matched', 'missing_prediction', 'missing_reference')."""
    p = preds.withColumn("_has_p", F.lit(True))
    r = refs.withColumn("_has_r", F.lit(True))
    j = r.join(p, id_col, "full_outer")
    status = (F.when(F.col("_has_p").isNull(), "missing_prediction")
              .when(F.col("_has_r").isNull(), "missing_reference").otherwise("matched"))
    return j.withColumn("status", status).drop("_has_p", "_has_r")


def matched(preds: DataFrame, refs: DataFrame, id_col: str = "id") -> DataFrame:
    """EVL-19 for scoring: pairs present on both sides (inner equi-join on id;
    ``align`` reports the unmatched ones)."""
    return refs.join(preds, id_col, "inner")


# ---------------------------------------------------------------- classification

def accuracy(df: DataFrame, t: str = "true_label", p: str = "predicted_label", by: list[str] | None = None) -> DataFrame:
    """EVL-02."""
    return df.groupBy(*(by or [])).agg(F.avg((F.col(t) == F.col(p)).cast("double")).alias("accuracy"))


def label_counts(df: DataFrame, t: str = "true_label", p: str = "predicted_label",
                 by: list[str] | None = None) -> DataFrame:
    """Per label: support (true count), predicted count, true positives."""
    by = by or []
    pairs = df.groupBy(*by, F.col(t).alias("_t"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("_t").alias("label"), F.col("_n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("_n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("_s"))
    return sides.groupBy(*by, F.col("_s.label").alias("label")).agg(
        F.sum("_s.support").alias("support"), F.sum("_s.predicted").alias("predicted"), F.sum("_s.tp").alias("tp"))


def weighted_prf(df: DataFrame, t: str = "true_label", p: str = "predicted_label",
                 by: list[str] | None = None) -> DataFrame:
    """EVL-03: support-weighted precision, recall, F1 (0/0 = 0), and accuracy
    from the same label counts."""
    by = by or []
    lc = label_counts(df, t, p, by)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    s = lc.select(*by, "support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    agg = s.groupBy(*by).agg(F.sum("support").alias("n"), F.sum(F.col("support") * F.col("p")).alias("wp"),
                             F.sum(F.col("support") * F.col("r")).alias("wr"),
                             F.sum(F.col("support") * F.col("f")).alias("wf"), F.sum("tp").alias("tp"))
    return agg.select(*by, (F.col("wp") / F.col("n")).alias("precision"), (F.col("wr") / F.col("n")).alias("recall"),
                      (F.col("wf") / F.col("n")).alias("f1"), (F.col("tp") / F.col("n")).alias("accuracy"))


def confusion(df: DataFrame, t: str = "true_label", p: str = "predicted_label", dense: bool = False) -> DataFrame:
    """EVL-04: long confusion matrix, the observed cells. ``dense`` adds zero
    cells over the sorted union of labels: a grid of classes² cells, expanded
    from one row with all labels, for the few labels of a classification."""
    pairs = df.groupBy(F.col(t).alias("true_label"), F.col(p).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n"))
    if not dense:
        return pairs.select("true_label", "predicted_label", F.col("n").cast("bigint").alias("n"))
    labels = (pairs.select(F.explode(F.array("true_label", "predicted_label")).alias("label"))
              .agg(F.array_sort(F.collect_set("label")).alias("labels")))
    rows = labels.select(F.explode("labels").alias("true_label"), "labels")
    grid = rows.select("true_label", F.explode("labels").alias("predicted_label"))
    return (grid.join(pairs, ["true_label", "predicted_label"], "left")
            .select("true_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def auc(df: DataFrame, score: str = "score", label: str = "label", buckets: int = 256) -> DataFrame:
    """EVL-11: ROC AUC = P(score⁺ > score⁻) + ½·P(tie) (rank-sum with average
    ranks). Scores are first aggregated to distinct values (a hot value is
    one row); the running count of negatives below each value is computed
    with quantile buckets (cut points from a scalar subquery, ≤ ``buckets``
    rows broadcast) so no single task sorts the whole table."""
    agg = df.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_pos"), F.sum((F.col(label) != 1).cast("long")).alias("_neg"))
    cuts = agg.agg(F.percentile_approx("_s", [i / buckets for i in range(1, buckets)], 10000)).scalar()
    b = agg.withColumn("_cuts", cuts).withColumn("_bk", F.size(F.filter("_cuts", lambda c: c <= F.col("_s")))).drop("_cuts")
    tot = b.groupBy("_bk").agg(F.sum("_neg").alias("_bneg"))
    tot = tot.withColumn("_boff", F.coalesce(F.sum("_bneg").over(
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = b.join(F.broadcast(tot.select("_bk", "_boff")), "_bk")  # ≤ buckets rows
    w = Window.partitionBy("_bk").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_below", F.col("_boff") + F.coalesce(F.sum("_neg").over(w), F.lit(0)))
    contrib = F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg"))
    r = j.agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return r.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
                    .alias("auc"), F.col("_p").alias("positives"), F.col("_n").alias("negatives"))


def mse(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """EVL-12."""
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))


# ---------------------------------------------------------------- text metrics

def rouge_tokens(text) -> Column:
    """rouge tokenizer: lower-case, every run outside [a-z0-9] separates."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^a-z0-9]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def whitespace_tokens(text) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), P.WS, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


_GRAM_TOKENS = 1 << 20  # tokens whose n-grams are counted at once; one row may have more


def _flat_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens of lists (a row) of token lists (its texts), with each token's row and text."""
    texts = texts.cast(pa.large_list(pa.large_list(pa.large_string())))
    inner = texts.flatten()
    per_row = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    per_text = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(inner)), per_text)
    return inner.flatten(), np.repeat(np.arange(len(texts)), per_row)[text], text


def _overlaps(refs: pa.Array, preds: pa.Array, ns) -> list[np.ndarray]:
    """By row, for each n: clipped matches, and n-grams of the references and of the predictions.
    n-grams don't pass from one text of a row to the next."""
    rows = len(refs)
    (r, r_row, r_text), (p, p_row, p_text) = _flat_tokens(refs), _flat_tokens(preds)
    words = pa.concat_arrays([r, p]).dictionary_encode()
    token = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate((r_row, p_row))
    text = np.concatenate((r_text, p_text + (r_text[-1] + 1 if len(r_text) else 0)))
    side = np.repeat([0, 1], [len(r), len(p)])
    distinct = len(words.dictionary) + 1
    at = np.arange(len(token))  # where the n-grams start
    gram = row  # the (n-1)-gram there, numbered within its row
    out = []
    for n in range(1, max(ns) + 1):
        if n > 1:
            within = at + n - 1 < len(token)
            within[within] = text[at[within] + n - 1] == text[at[within]]
            at, gram = at[within], gram[within]
        _, first, gram = np.unique(gram * distinct + token[at + n - 1], return_index=True, return_inverse=True)
        if n in ns:
            counts = [np.bincount(gram[side[at] == k], minlength=len(first)) for k in (0, 1)]
            own = row[at[first]]
            out += [np.bincount(own, x, rows).astype(np.int64) for x in (np.minimum(*counts), *counts)]
    return out


def _gram_counts(specs) -> Column:
    """A struct of the numbers of ``gram_stats`` from lists of token lists, two columns for each spec."""
    fields = [f"{kind}_{x}{n}" for kind, _, _, ns in specs for n in sorted(ns) for x in "hrp"]

    @F.arrow_udf(TY.StructType([TY.StructField(f, TY.LongType()) for f in fields]))
    def run(*columns: pa.Array) -> pa.Array:
        size = sum(len(c.flatten().flatten()) for c in columns)
        step = max(1, len(columns[0]) * _GRAM_TOKENS // max(1, size))
        parts: list[list[np.ndarray]] = [[] for _ in fields]
        for i in range(0, len(columns[0]), step):
            found = [x for k, (_, _, _, ns) in enumerate(specs) for x in _overlaps(columns[2 * k].slice(i, step), columns[2 * k + 1].slice(i, step), ns)]
            for part, x in zip(parts, found, strict=True):
                part.append(x)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in parts], names=fields)

    return run(*[F.col(c) for _, rt, pt, _ in specs for c in (rt, pt)])


def gram_stats(df: DataFrame, keys: list[str], specs) -> DataFrame:
    """Any number of n-gram metrics: ``specs`` = [(kind, ref_tokens_col, pred_tokens_col, ns)]. Per
    key row: ``{kind}_h{n}`` (clipped matches Σ_g min(count_ref, count_pred)), ``{kind}_r{n}`` and
    ``{kind}_p{n}`` (reference / prediction n-gram counts). Rows of equal keys count as one pair of
    several texts; empty texts keep their row. ``keys[0]`` must identify the pair: the pairs
    (text-sized) are shuffled by it once, and that is all that moves."""
    texts = list(dict.fromkeys(c for _, rt, pt, _ in specs for c in (rt, pt)))
    empty = F.array().cast("array<string>")
    met = df.repartition(keys[0]).groupBy(*keys).agg(*[F.collect_list(F.coalesce(c, empty)).alias(c) for c in texts])
    # generated columns: a condition on a number is not traced back into the counting
    return met.select(*keys, _gram_counts(specs).alias("_g")).select(*keys, F.inline(F.array("_g")))


def _f(prec: Column, rec: Column) -> Column:
    return F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))


def _rouge_col(kind: str, n: int) -> Column:
    h = F.col(f"{kind}_h{n}")
    prec = h / F.greatest(F.col(f"{kind}_p{n}"), F.lit(1))
    rec = h / F.greatest(F.col(f"{kind}_r{n}"), F.lit(1))
    return _f(prec, rec)


def _bleu_col(kind: str, epsilon: float = 0.1) -> Column:
    logs = []
    for n in (1, 2, 3, 4):
        h = F.col(f"{kind}_h{n}").cast("double")
        den = F.greatest(F.col(f"{kind}_p{n}"), F.lit(1)).cast("double")
        logs.append(F.log(F.when(h == 0, F.lit(epsilon) / den).otherwise(h / den)))
    c, r = F.col(f"{kind}_p1"), F.col(f"{kind}_r1")  # token counts = unigram counts
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - r / c))
    return F.when(F.col(f"{kind}_h1") == 0, F.lit(0.0)).otherwise(bp * F.exp(sum(logs) / F.lit(4.0)))


def rouge_n(df: DataFrame, id_col: str, ref: str, pred: str, ns=(1, 2), stemmer=None) -> DataFrame:
    """EVL-05/06: ROUGE-N F per pair (columns rouge1, rouge2, …).
    ``stemmer``: optional function DataFrame→DataFrame replacing the token
    arrays by stemmed ones (see ``stem_tokens``)."""
    d = df.select(id_col, rouge_tokens(ref).alias("_rt"), rouge_tokens(pred).alias("_pt"))
    if stemmer is not None:
        d = stemmer(d, ["_rt", "_pt"])
    st = gram_stats(d, [id_col], [("rg", "_rt", "_pt", ns)])
    return st.select(id_col, *[_rouge_col("rg", n).alias(f"rouge{n}") for n in ns])


def bleu(df: DataFrame, id_col: str, ref: str, pred: str, epsilon: float = 0.1) -> DataFrame:
    """EVL-08: sentence BLEU-4, whitespace tokens, brevity penalty,
    smoothing method 1 (ε for zero counts; 0 without any unigram match)."""
    d = df.select(id_col, whitespace_tokens(ref).alias("_rt"), whitespace_tokens(pred).alias("_pt"))
    st = gram_stats(d, [id_col], [("bl", "_rt", "_pt", (1, 2, 3, 4))])
    return st.select(id_col, _bleu_col("bl", epsilon).alias("bleu"))


def _lcs_len(a, b) -> int:
    """Bit-parallel LCS length (Allison–Dix / Hyyrö)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(TY.DoubleType())
def _rouge_l_udf(ref: pd.Series, pred: pd.Series) -> pd.Series:
    out = []
    for r, p in zip(ref, pred):
        r = list(r) if r is not None else []
        p = list(p) if p is not None else []
        if not r or not p:
            out.append(0.0)
            continue
        lcs = _lcs_len(r, p)
        prec, rec = lcs / len(p), lcs / len(r)
        out.append(0.0 if prec + rec == 0 else 2 * prec * rec / (prec + rec))
    return pd.Series(out, dtype="float64")


def rouge_l(df: DataFrame, id_col: str, ref: str, pred: str, stemmer=None) -> DataFrame:
    """EVL-07: ROUGE-L F from the LCS over rouge tokens (Arrow pandas UDF)."""
    d = df.select(id_col, rouge_tokens(ref).alias("_rt"), rouge_tokens(pred).alias("_pt"))
    if stemmer is not None:
        d = stemmer(d, ["_rt", "_pt"])
    return d.select(id_col, _rouge_l_udf("_rt", "_pt").alias("rougeL"))


def rouge(df: DataFrame, id_col: str, ref: str, pred: str, stemmer=None) -> DataFrame:
    """EVL-05..07 together: rouge1, rouge2 and rougeL of each pair; tokens are
    made (and stemmed) once, and the LCS goes with them to the n-gram counts."""
    d = df.select(id_col, rouge_tokens(ref).alias("_rt"), rouge_tokens(pred).alias("_pt"))
    if stemmer is not None:
        d = stemmer(d, ["_rt", "_pt"])
    st = gram_stats(d.withColumn("rougeL", _rouge_l_udf("_rt", "_pt")), [id_col, "rougeL"], [("rg", "_rt", "_pt", (1, 2))])
    return st.select(id_col, _rouge_col("rg", 1).alias("rouge1"), _rouge_col("rg", 2).alias("rouge2"), "rougeL")


# ---------------------------------------------------------------- dispatch

GENERIC_TASKS_METRICS = ["rouge1", "rouge2", "rougeL"]


def score_pairs(df: DataFrame, id_col: str = "id", task_col: str = "task", ref: str = "reference",
                pred: str = "prediction", lang: str | Column = "en", with_rouge_l: bool = True, stemmer=None) -> DataFrame:
    """EVL-09 per row: classification rows get labels; every other task gets
    ROUGE-1/2(/L); summarization also BLEU. ``lang`` may be a column. One plan: the classification
    part is a narrow projection, the text part one n-gram pass (ROUGE and
    BLEU) that also carries the per-row ROUGE-L; the two parts are unioned,
    nothing is joined."""
    def label(text: str) -> Column:
        if isinstance(lang, str):
            return extract_label(F.col(text), lang)
        return F.when(lang == "de", extract_label(F.col(text), "de")).otherwise(extract_label(F.col(text), "en"))

    cls = F.col(task_col) == "classification"
    labels = df.where(cls).select(
        id_col, task_col, label(ref).alias("true_label"), label(pred).alias("predicted_label"),
        *[F.lit(None).cast("double").alias(c) for c in ("rouge1", "rouge2", "rougeL", "bleu")])
    summ = F.col(task_col) == "summarization"
    t = df.where(~cls).select(id_col, task_col, rouge_tokens(ref).alias("_rt"), rouge_tokens(pred).alias("_pt"),
                              F.when(summ, whitespace_tokens(ref)).otherwise(F.array().cast("array<string>")).alias("_bt"),
                              F.when(summ, whitespace_tokens(pred)).otherwise(F.array().cast("array<string>")).alias("_bp"),
                              summ.alias("_summ"))
    if stemmer is not None:
        t = stemmer(t, ["_rt", "_pt"])
    rl = _rouge_l_udf("_rt", "_pt") if with_rouge_l else F.lit(None).cast("double")
    t = t.withColumn("rougeL", rl)
    st = gram_stats(t, [id_col, task_col, "_summ", "rougeL"],
                    [("rg", "_rt", "_pt", (1, 2)), ("bl", "_bt", "_bp", (1, 2, 3, 4))])
    text = st.select(id_col, task_col, F.lit(None).cast("string").alias("true_label"),
                     F.lit(None).cast("string").alias("predicted_label"),
                     _rouge_col("rg", 1).alias("rouge1"), _rouge_col("rg", 2).alias("rouge2"), "rougeL",
                     F.when(F.col("_summ"), _bleu_col("bl")).alias("bleu"))
    return labels.unionByName(text)


def evaluate_by_task(scored: DataFrame, task_col: str = "task") -> DataFrame:
    """EVL-09/10: metric means per task in the long D14 form
    (metric = '<task>_<name>', value). A metric with no rows is absent."""
    cls = scored.where(F.col(task_col) == "classification")
    c_long = weighted_prf(cls, by=[task_col]).unpivot([task_col], ["accuracy", "precision", "recall", "f1"], "name", "value")
    cols = [x for x in ["rouge1", "rouge2", "rougeL", "bleu"] if x in scored.columns]
    g = scored.where(F.col(task_col) != "classification").groupBy(task_col).agg(
        *[F.avg(x).alias(x) for x in cols])
    g_long = g.unpivot([task_col], cols, "name", "value").where(F.col("value").isNotNull())
    both = c_long.unionByName(g_long)
    return both.select(F.concat(F.col(task_col), F.lit("_"), F.col("name")).alias("metric"),
                       F.col("value").cast("double").alias("value"))


def batch_mean(df: DataFrame, batch_col: str, metric_exprs: dict) -> DataFrame:
    """EVL-13: per-batch metric, then the mean over batches (not the global mean)."""
    per = df.groupBy(batch_col).agg(*[e.alias(k) for k, e in metric_exprs.items()])
    return per.agg(*[F.avg(k).alias(k) for k in metric_exprs], F.count(F.lit(1)).alias("batches"))


def check_targets(metrics: DataFrame, targets=None, metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """EVL-14: compare metrics with the product targets (a handful of literal
    rows expressed as a CASE, no join needed)."""
    targets = targets or P.TARGETS
    m = metrics.where(F.col(metric_col).isin([t for t, _, _ in targets]))
    tv = F.lit(None).cast("double")
    op = F.lit(None).cast("string")
    for name, o, v in targets:
        tv = F.when(F.col(metric_col) == name, F.lit(float(v))).otherwise(tv)
        op = F.when(F.col(metric_col) == name, F.lit(o)).otherwise(op)
    val = F.col(value_col)
    passed = (F.when(op == ">", val > tv).when(op == ">=", val >= tv).when(op == "<=", val <= tv)
              .when(op == "<", val < tv))
    return m.select(metric_col, value_col, op.alias("op"), tv.alias("target"), passed.alias("passed"))


def reward(df: DataFrame, output_col: str, ref_cits_col: str, cit_fn) -> DataFrame:
    """EVL-15: format flag from <think>/<answer> and citation precision /
    recall of the answer against the reference citations (distinct sets)."""
    from ..functions.conversation import parse_reasoning
    r = parse_reasoning(F.col(output_col))
    pred = F.array_distinct(F.coalesce(cit_fn(r["answer"]), F.array().cast("array<string>")))
    ref = F.array_distinct(F.coalesce(F.col(ref_cits_col), F.array().cast("array<string>")))
    inter = F.size(F.array_intersect(pred, ref))
    return df.select("*", r["well_formed"].alias("format_ok"),
                     F.when(F.size(pred) > 0, inter / F.size(pred)).alias("citation_precision"),
                     F.when(F.size(ref) > 0, inter / F.size(ref)).alias("citation_recall"))


def throughput(df: DataFrame, task_col: str, seconds_col: str, new_tokens: int = 256) -> DataFrame:
    """EVL-16: requests, mean latency and tokens/s per task (tokens/s =
    new_tokens / seconds, averaged over requests). Constant-size state per
    task (no per-value maps), so a hot task costs no more than others."""
    s = F.col(seconds_col)
    return df.groupBy(task_col).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(s).alias("avg_seconds"), F.max(s).alias("max_seconds"),
        F.avg(F.when(s > 0, F.lit(float(new_tokens)) / s)).alias("tokens_per_second"))


# fixed values: metric definitions parsed from training logs
LOG_METRICS = [("train:loss", r"train_loss: ([0-9\.]+)"),
               ("validation:accuracy", r"validation_accuracy: ([0-9\.]+)")]


def parse_log_metrics(df: DataFrame, line_col: str = "line") -> DataFrame:
    """EVL-17: one row per (line, metric) with the parsed value."""
    parts = [F.struct(F.lit(name).alias("metric"), F.when(
        F.col(line_col).rlike(p), F.regexp_extract(F.col(line_col), p, 1)).alias("raw")) for name, p in LOG_METRICS]
    ex = df.select("*", F.explode(F.array(*parts)).alias("_m")).where(F.col("_m.raw").isNotNull())
    return ex.select(*df.columns, F.col("_m.metric").alias("metric"),
                     F.col("_m.raw").try_cast("double").alias("value"))


def best_checkpoint(df: DataFrame, step_col: str, loss_col: str, by: list[str] | None = None) -> DataFrame:
    """EVL-18: checkpoint with the lowest evaluation loss (min_by; ties → smallest step)."""
    key = F.struct(F.col(loss_col), F.col(step_col))
    return df.groupBy(*(by or [])).agg(F.min(key).alias("_k")).select(
        *(by or []), F.col("_k." + step_col).alias("best_step"), F.col("_k." + loss_col).alias("best_loss"))
