"""Domain vocabulary (AGG-09): court abbreviations, § references and compounds.

Terms of a class are counted in a domain corpus and in a background corpus in
one pass and ranked by keyness (signed log-likelihood ratio). Compounds are
split by what the corpus itself has: a word is one if the geometric mean of
its parts' counts, over the best split, exceeds its own count. The best split
comes from a dynamic program over the distinct words: a join and an
aggregation for each further part, keyed by word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..session import kept, small_batches
from .skew import salted_join

# fixed values: abbreviations of German and European courts
COURTS = ["AG", "ArbG", "BAG", "BayObLG", "BFH", "BGH", "BPatG", "BSG", "BVerfG", "BVerwG", "EGMR", "EuG", "EuGH", "FG", "KG",
          "LAG", "LG", "LSG", "OLG", "OVG", "RG", "SG", "VG", "VGH"]
# fixed values: sounds that link the parts of a German compound
LINKS = ["s", "es", "n", "en", "er"]

TOKEN = r"[\pL\pN]+"
WORD = "[a-zäöüß]+"
#: number and law of a reference; subsections and sentences between them don't count
REFERENCE = r"(?:§{1,2}|Art\.)\s*(\d+[a-z]?)(?:\s*(?:Abs\.|Absatz)\s*\d+)?(?:\s*(?:S\.|Satz)\s*\d+)?\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß]*)"
KINDS = ("court", "reference", "word")
MIN_PART, LEAST_COUNT, LONGEST, MOST_PARTS = 4, 3, 40, 4
MICRO = 1_000_000


def terms_of(text: Column, kind: str) -> Column:
    """The terms of a class in a text, in order: ``court`` (abbreviations as written), ``reference``
    ("§ 12a StGB", "Art. 5 GG") or ``word`` (lower-cased runs of letters)."""
    if kind == "court":
        return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: x.isin(COURTS))
    if kind == "reference":
        return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda x: F.concat(
            F.when(x.startswith("§"), "§ ").otherwise("Art. "), F.regexp_extract(x, REFERENCE, 1), F.lit(" "), F.regexp_extract(x, REFERENCE, 2)))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


_COUNTS = pa.schema([("term", pa.string()), ("term_freq", pa.int64()), ("doc_freq", pa.int64()), ("background_freq", pa.int64())])
_SUMS = [(c, "sum") for c in _COUNTS.names[1:]]
HELD = 1 << 19  # counts of terms that a task holds
#: Latin letters and general punctuation: in such texts Python finds the same tokens and words as Spark, much faster.
_PLAIN = "\\x00-\\u024F\\u2000-\\u206F"
_TOKENS = re.compile("[" + "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] in "LN") + "]+")
_WORDS = re.compile(WORD)


def _own_words(b: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with words and sizes of the plain texts."""
    terms, sizes = b.column("_terms").to_pylist(), b.column("_size").to_pylist()
    for i, t in enumerate(b.column("_plain").to_pylist()):
        if t is not None:
            terms[i], sizes[i] = _WORDS.findall(t.lower()), len(_TOKENS.findall(t))
    return pa.RecordBatch.from_arrays([b.column("_in"), pa.array(terms, pa.list_(pa.string())), pa.array(sizes, pa.int32())], names=["_in", "_terms", "_size"])


def _batch_counts(b: pa.RecordBatch) -> pa.Table:
    """Counts of the terms of a batch, whose rows are documents."""
    inside, lists = b.column("_in").to_numpy(zero_copy_only=False), b.column("_terms")
    row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    mine = inside[row]
    docs = np.unique(row[mine] * n + code[mine]) % n if n else code
    total = b.column("_size").to_numpy().astype(np.int64)
    counts = [[np.bincount(x, minlength=n), own] for x, own in zip((code[mine], docs, code[~mine]), (total[inside].sum(), inside.sum(), total[~inside].sum()))]
    terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    return pa.table([terms, *[pa.array(np.append(*c).astype(np.int64)) for c in counts]], schema=_COUNTS)


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(_batch_counts(_own_words(b) if "_plain" in b.schema.names else b))
        size += held[-1].num_rows
        if size > HELD:
            held = [_summed(held)]
            size = held[0].num_rows
            if size > HELD // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from _summed(held).to_batches()


def _summed(held: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(held).group_by("term", use_threads=False).aggregate(_SUMS)
    return pa.table([sums.column("term"), *[sums.column(f"{c}_sum") for c, _ in _SUMS]], schema=_COUNTS).combine_chunks()


def term_counts(df: DataFrame, id_col: str, text_col: str, domain: Column, kind: str) -> DataFrame:
    """term, term_freq and doc_freq in the domain (rows where ``domain`` holds), background_freq
    elsewhere. The null term counts all words, so that totals come with the same pass.

    A row is a document, whose terms are counted where they are found; rows that share an id (no id
    counts as one) are one document, so their terms meet by id first."""
    small_batches(df.sparkSession)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(domain, F.lit(False)).alias("_in"), t.alias("_text"))
    shared = kept(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_shared")), "shared")
    same = F.col("_id").eqNullSafe(F.col("_shared"))
    total = F.size(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0)))

    alone, terms = rows.join(shared, same, "left_anti"), terms_of(F.col("_text"), kind)
    if kind == "word":
        other = F.col("_text").rlike(f"[^{_PLAIN}]")
        alone = alone.select("_in", F.when(~other, F.col("_text")).alias("_plain"), F.when(other, terms).alias("_terms"), F.when(other, total).alias("_size"))
    else:
        alone = alone.select("_in", terms.alias("_terms"), total.alias("_size"))
    counted = alone.mapInArrow(_task_counts, "term string, term_freq long, doc_freq long, background_freq long")

    found = F.transform(terms_of(F.col("_text"), kind), lambda x: F.struct(x.alias("term"), F.lit(1).alias("n")))
    totals = F.struct(F.lit(None).cast("string").alias("term"), total.alias("n"))
    several = explode_rows(rows.join(shared, same, "left_semi"), F.concat(found, F.array(totals)), "_t", ["_id", "_in"])
    per_doc = several.groupBy("_t.term", "_id", "_in").agg(F.sum("_t.n").alias("n"))
    zero = F.lit(0).cast("long")
    met = per_doc.select("term", F.when(F.col("_in"), F.col("n")).otherwise(zero).alias("term_freq"), F.col("_in").cast("long").alias("doc_freq"),
                         F.when(F.col("_in"), zero).otherwise(F.col("n")).alias("background_freq"))
    return counted.unionByName(met).groupBy("term").agg(*[F.sum(c).alias(c) for c, _ in _SUMS])


def keyness(counts: DataFrame) -> DataFrame:
    """The domain's terms with their log-likelihood ratio against the background: positive where the
    domain has more of its words, negative where it has less."""
    totals = counts.filter("term IS NULL").agg(F.struct(F.sum("term_freq").cast("double").alias("a"), F.sum("background_freq").cast("double").alias("b"))).scalar()
    a, b = F.col("term_freq").cast("double"), F.col("background_freq").cast("double")
    both = (a + b) / (totals["a"] + totals["b"])
    ratio = 2 * (a * F.ln(a / (totals["a"] * both)) + F.when(b > 0, b * F.ln(b / (totals["b"] * both))).otherwise(0.0))
    signed = F.when(a * totals["b"] < b * totals["a"], -ratio).otherwise(ratio)
    return counts.filter("term IS NOT NULL AND term_freq > 0").withColumn("keyness", F.round(signed, 6))


def _best(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("keyness"), F.desc("term_freq"), "term").limit(k)


def key_terms(df: DataFrame, id_col: str, text_col: str, domain: Column, kind: str, k: int = 5000) -> DataFrame:
    """The ``k`` terms of a class with the highest keyness, ties by frequency and term."""
    return _best(keyness(kept(term_counts(df, id_col, text_col, domain, kind), "terms")), k)


def part_edges(words: DataFrame, min_part: int = MIN_PART, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """word, size, i, j, part, n: letters i to j of a word are a word of ``min_part`` letters or more
    that occurs ``least`` times or more, as they are or, but at the end, without a linking sound; of
    several the most frequent, then the longest. ``words``: (word, n), distinct."""
    parts = words.filter((F.length("word") >= min_part) & (F.col("n") >= least)).select(F.col("word").alias("part"), "n")
    long = words.filter(F.length("word").between(2 * min_part, longest)).select("word", F.length("word").alias("size"))
    heads = parts.select(F.substring("part", 1, min_part).alias("_head")).distinct()  # a span none of whose forms can be a part goes before it has ends
    starts = long.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - min_part)).alias("i"))
    starts = salted_join(starts.withColumn("_head", F.col("word").substr(F.col("i") + 1, F.lit(min_part))), heads, "_head", ["word", "i"]).drop("_head")
    spans = (starts.select("*", F.explode(F.sequence(F.col("i") + min_part, F.col("size"))).alias("j")).filter("NOT (i = 0 AND j = size)")
             .withColumn("x", F.col("word").substr(F.col("i") + 1, F.col("j") - F.col("i"))))
    forms = [F.col("x"), *[F.when((F.col("j") < F.col("size")) & F.col("x").endswith(e) & (F.length("x") >= min_part + len(e)), F.col("x").substr(F.lit(1), F.length("x") - len(e))) for e in LINKS]]
    found = salted_join(spans.select("word", "size", "i", "j", F.explode(F.filter(F.array(*forms), lambda f: f.isNotNull())).alias("part")), parts, "part", ["word", "i"])
    return (found.groupBy("word", "size", "i", "j").agg(F.max(F.struct("n", F.length("part").alias("l"), "part")).alias("_e"))
            .select("word", "size", "i", "j", "_e.part", "_e.n"))


def compounds(words: DataFrame, min_part: int = MIN_PART, least: int = LEAST_COUNT, longest: int = LONGEST, most_parts: int = MOST_PARTS) -> DataFrame:
    """word, parts ("a + b"), score: words of ``2 * min_part`` to ``longest`` letters whose best split
    into two to ``most_parts`` parts beats the word itself. The score is the mean log count of the
    parts; it is added up in whole millionths, so that ties are exact: they go to fewer parts, then
    to the first by letters."""
    edges = kept(part_edges(words, min_part, least, longest), "edges")
    log = F.round(F.ln(F.col("n").cast("double")) * MICRO).cast("long")
    common = math.lcm(*range(2, most_parts + 1))  # means over two, three, ... parts as whole numbers
    path = edges.filter("i = 0").select("word", "size", F.col("j").alias("at"), log.alias("score"), F.col("part").alias("parts"))
    whole = None
    for k in range(2, most_parts + 1):
        step = path.filter("at < size").join(edges.select("word", F.col("i").alias("at"), "j", "part", "n"), ["word", "at"])
        path = (step.select("word", "size", F.col("j").alias("at"), (-(F.col("score") + log)).alias("s"), F.concat("parts", F.lit(" + "), "part").alias("parts"))
                .groupBy("word", "size", "at").agg(F.min(F.struct("s", "parts")).alias("_p"))
                .select("word", "size", "at", (-F.col("_p.s")).alias("score"), "_p.parts"))
        done = path.filter("at = size").select("word", (-F.col("score") * (common // k)).alias("s"), F.lit(k).alias("k"), "parts")
        whole = done if whole is None else whole.unionByName(done)
    best = whole.groupBy("word").agg(F.min(F.struct("s", "k", "parts")).alias("_b")).select("word", "_b.parts", (-F.col("_b.s")).alias("score"))
    return best.join(words, "word").filter(F.col("score") > log * common).select("word", "parts", (F.col("score") / (MICRO * common)).alias("score"))


def key_compounds(df: DataFrame, id_col: str, text_col: str, domain: Column, k: int = 5000, **options) -> DataFrame:
    """The ``k`` compounds of the domain with the highest keyness, and their parts."""
    counts = kept(term_counts(df, id_col, text_col, domain, "word"), "words")
    split = compounds(counts.filter("term IS NOT NULL AND term_freq > 0").select(F.col("term").alias("word"), F.col("term_freq").alias("n")), **options)
    return _best(keyness(counts).join(split.withColumnRenamed("word", "term"), "term"), k)
