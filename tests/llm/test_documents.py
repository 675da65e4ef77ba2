"""Operators on documents against brute force, on copies, ties, nulls and texts of all kinds."""

import itertools
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import langid, licences, linededup, mixing, packing, passages, simhash, tokencounts
from lexspark.llm.words import mix, words_of
from tests.llm.conftest import values

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "simhash_drop": lambda d: simhash.drop_near_duplicates(d).select("doc_id", "text"),
    "langid": lambda d: langid.identify(d).select("doc_id", "text", "held_out", "lang_pred", "score"),
    "lines": lambda d: linededup.duplicate_lines(d),
    "lines_drop": lambda d: linededup.drop_duplicate_lines(d).select("doc_id", "text", "n_chars"),
    "mix": lambda d: mixing.mix(d, mixing.cycled([5, 2, 1])).select("doc_id", "source", "size", "source_size", "target"),
    "pack": lambda d: packing.pack(d, BYTE_BPE).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "tokens": lambda d: tokencounts.token_counts(d, PIECE_BPE),
    "licences": lambda d: licences.scan(d),
    "passages": lambda d: passages.repeated_passages(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_docs):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_change_nothing(name, docs, clashing):
    assert values(OPERATORS[name](clashing)) == values(OPERATORS[name](docs))


def test_partitions_change_nothing(docs):
    for name in ("simhash", "lines", "passages", "licences"):
        assert values(OPERATORS[name](docs.coalesce(1))) == values(OPERATORS[name](docs)), name


# ------------------------------------------------------------------ SimHash

def _fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def _classes(prints):
    near = {f: {f} for f in prints}
    for a, b in itertools.combinations(near, 2):
        if (a ^ b).bit_count() <= 4 and near[a] is not near[b]:
            merged = near[a] | near[b]
            for f in merged:
                near[f] = merged
    return near


def test_simhash(docs, rows):
    prints = [(r[0], _fingerprint(r[1])) for r in rows]
    near = _classes({f for _, f in prints})
    want = [(i, format(f, "016x"), min((j for j, g in prints if j is not None and g in near[f]), default=None)) for i, f in prints]
    assert values(simhash.near_duplicates(docs)) == sorted(want, key=repr)


def test_simhash_keeps_one_of_each_class(docs, rows):
    prints = {_fingerprint(r[1]) for r in rows}
    kept = simhash.drop_near_duplicates(docs).collect()
    near = _classes(prints)
    assert len(kept) == len({id(c) for c in near.values()})
    assert {id(near[_fingerprint(r["text"])]) for r in kept} == {id(c) for c in near.values()}
    assert kept[0].asDict().keys() == set(docs.columns)


@pytest.mark.parametrize("bits", [0, 3, 4, 7])
def test_simhash_links_are_all_links(spark, bits):
    rng = np.random.default_rng(bits)
    prints = {0, (1 << 63), (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 25).tolist():
        prints |= {base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    want = {(a, b) for a, b in itertools.permutations(signed, 2) if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_components_of_chains_and_stars(spark):
    from lexspark.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(205, 203), (203, 205), (7, 7), (300, 300)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 203: 203, 205: 203}


# ------------------------------------------------------------------ line dedup

def _lines(rows):
    order, texts = {}, {(r[0], r[1]) for r in rows if r[1]}
    for d, t in texts:
        for k, line in enumerate(t.split("\n")):
            s = frozenset(line.encode().split())
            if s:
                order[(math.inf if d is None else d, t, k)] = s
    return order


def test_line_dedup(docs, rows):
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    lines = {(d, hashes[t], k): s for (d, t, k), s in _lines(rows).items()}
    places = sorted(lines)
    want = []
    for i, p in enumerate(places):
        same = [q for q in places[:i] if lines[q] == lines[p]]
        similar = any(5 * len(lines[q] & lines[p]) >= 4 * len(lines[q] | lines[p]) for q in places[:i])
        first = same[0] if same else p
        want.append((None if p[0] == math.inf else p[0], p[1], p[2], None if first[0] == math.inf else first[0], first[2], similar))
    assert values(linededup.duplicate_lines(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup_of_near_copies(spark, monkeypatch, small):
    """A group of variants of one line, also with lists that are dealt, cut and compared by the second round."""
    if small:
        for name, value in (("SHIFTS", 3), ("RUN_ROWS", 40), ("PART_ROWS", 30)):
            monkeypatch.setattr(linededup, name, value)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(25)]
    texts = []
    for _ in range(150):
        line = [w if rng.random() > 0.12 else f"v{rng.integers(0, 40)}" for w in base]
        texts.append(" ".join(line[:int(rng.integers(15, 26))]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [frozenset(t.split()) for t in texts]
    want = {i for i, s in enumerate(sets) if any(5 * len(s & q) >= 4 * len(s | q) for q in sets[:i])}
    found = linededup.duplicate_lines(d).collect()
    assert len(found) == 150 and {r["doc_id"] for r in found if r["removed"]} == want


def test_line_dedup_drops_lines_and_emptied_documents(spark):
    rows = [(1, "one two three four five\n\nsix seven"), (2, "five four three two one"), (3, "six seven\nnew words here"), (4, ""), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert values(linededup.drop_duplicate_lines(d)) == [(1, rows[0][1]), (3, "new words here"), (4, ""), (5, None)]


# ------------------------------------------------------------------ passages

def test_passages_are_found_and_clean_documents_left(docs, rows):
    found = passages.repeated_passages(docs).collect()
    hit = {r["doc_id"] for r in found}
    shared = defaultdict(set)
    for i, (d, t, *_) in enumerate(rows):
        words = (t or "").split()
        for n in (30, 12):
            for k in range(len(words) - n + 1):
                shared[n, tuple(words[k:k + n])].add((d, t))
    docs_with = {n: {d for (m, _), s in shared.items() if m == n and len(s) > 1 for d, _ in s} for n in (30, 12)}
    planted = [r[0] for r in rows[79:84]]
    assert set(planted) <= hit and docs_with[30] - {None} <= hit <= docs_with[12]
    for r in found:
        assert r["passage_words"] >= 15 and r["n_words"] >= 5
        assert r["removed"] == ((r["doc_id"], r["start_word"]) != (r["first_doc_id"], r["first_start_word"]))


def test_similar_paragraphs_link(spark):
    """Long paragraphs, cut nowhere else, that differ in a word."""
    words = ["same"] * 1 + [f"u{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(["changed" if i == 100 else w for i, w in enumerate(words)]), " ".join(f"z{i}" for i in range(100))]
    found = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {0, 1}


def _uncut(rng, n):
    """Words none of which begins a paragraph, but the first: the hashes that are compared rise."""
    vocabulary = [f"w{i}" for i in rng.choice(10**6, 3000, replace=False)]
    h = next(words_of(pa.array([" ".join(vocabulary)])))[3]
    out, low = [int(rng.integers(3000))], np.uint64(0)
    while len(out) < n:
        pair = mix(h[out[-1:]] * passages._FACTORS[0] + h * passages._FACTORS[1], 5)
        pair[pair <= low] = np.iinfo(np.uint64).max
        out.append(int(pair.argmin()))
        low = pair.min()
    return [vocabulary[i] for i in out]


def _all_components(texts):
    """Root of every paragraph key: all pairs that share a band, by Jaccard."""
    _, _, _, _, key, each, shingle = passages._paragraphs(pa.array(texts))
    sets = dict(zip(key.tolist(), map(frozenset, np.split(shingle, np.cumsum(each)[:-1]))))
    buckets = defaultdict(set)
    for bucket, cls, _ in passages._banded(pa.RecordBatch.from_pydict({"text": texts})):
        for b, c in zip(bucket.tolist(), cls.tolist()):
            buckets[b].add(c)
    near = {k: {k} for k in sets}
    for bucket in buckets.values():
        for a, b in itertools.combinations(bucket, 2):
            if near[a] is not near[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                merged = near[a] | near[b]
                for k in merged:
                    near[k] = merged
    return {k: min(v) for k, v in near.items()}


def test_passages_of_version_chains(spark):
    """Each version lacks the first word of the one before and has a word more: only neighbours are similar."""
    rng = np.random.default_rng(5)
    texts = []
    for length in (20, 30, 40, 60) * 3:
        words = _uncut(rng, 150)
        texts += [" ".join(words[k:k + length]) for k in range(0, 150 - length, 1 + length // 45)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    root = _all_components(texts)
    row, _, first, size, key, _, _ = passages._paragraphs(pa.array(texts))
    assert len(row) == len(texts) and size.min() >= 15
    lowest = {}
    for i, f, k in zip(row.tolist(), first.tolist(), key.tolist()):
        lowest.setdefault(root[k], (i, f))
    counts = Counter(root[k] for k in key.tolist())
    want = {(i, f, *lowest[root[k]], (i, f) != lowest[root[k]]) for i, f, k in zip(row.tolist(), first.tolist(), key.tolist()) if counts[root[k]] > 1}
    assert max(counts.values()) > 50
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = passages.repeated_paragraphs(d).select("doc_id", "start_word", "first_doc_id", "first_start_word", "removed")
    assert {tuple(r) for r in found.collect()} == want


def test_all_words_of_copied_runs_have_rows(spark):
    """Against all runs of 15 words: short passages, their rims, one repeated word, overlapping sources."""
    rng = np.random.default_rng(8)

    def new(n):
        return [f"n{i}" for i in rng.choice(10**9, n)]

    shared = [new(n) for n in (14, 15, 16, 20, 30, 51, 120)]
    texts = [new(9) + shared[k % 7] + new(int(rng.integers(0, 30))) for k in range(28)]
    texts += [new(5) + shared[6][:40] + new(4) + shared[6][30:], ["the"] * 40, new(3) + ["the"] * 25, shared[5] + shared[4], [], shared[1]]
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t) - 14):
            places[tuple(t[k:k + 15])].append((i, k))
    marked, gone = set(), set()
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                words = {(i, k + j) for j in range(15)}
                marked |= words
                gone |= words if (i, k) != min(found) else set()
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    exact = passages.repeated_runs(d).collect()
    assert {(r["doc_id"], r["start_word"] + j) for r in exact for j in range(r["n_words"])} == marked
    assert {(r["doc_id"], r["start_word"] + j) for r in exact if r["removed"] for j in range(r["n_words"])} == gone
    for r in exact:
        f, n = r["first_start_word"], r["n_words"]
        assert texts[r["first_doc_id"]][f:f + n] == texts[r["doc_id"]][r["start_word"]:r["start_word"] + n] and n >= 15
    both = passages.repeated_passages(d).collect()
    assert {(r["doc_id"], r["start_word"] + j) for r in both if r["removed"] for j in range(r["n_words"])} >= gone


def test_joined_runs_are_whole_near_copies(spark):
    """Copies with words changed, put in or left out every 20 words go whole, by an edit distance of
    their own; with half of the words between two runs new they don't."""
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in rng.choice(10**9, 205)]
    new = iter(f"c{i}" for i in rng.choice(10**9, 400))

    def edited(size):
        out = base[:20]
        for k in range(20, 200, 20):
            kind = k // 20 % 3
            put = [next(new) for _ in range(0 if kind == 2 else size)]
            out += put + base[k + (0 if kind == 1 else size):k + 20]
        return out

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    few, many = edited(2), [w for k in range(0, 200, 20) for w in base[k:k + 20] + [next(new) for _ in range(30)]]
    texts = [base, few, many]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    found = [r for r in passages.repeated_passages(d).collect() if r["removed"]]
    gone = {(r["doc_id"], r["start_word"] + j) for r in found for j in range(r["n_words"])}
    assert {w for i, w in gone if i == 1} == set(range(len(few)))
    assert {w for i, w in gone if i == 2} == {i for i, w in enumerate(many) if w in set(base)}
    for r in passages._joined(passages._runs(d, 15, "doc_id", "text"), 0.8).collect():
        a = texts[r["doc_order"]][r["start_word"]:r["start_word"] + r["n_words"]]
        f = texts[r["first_order"]]
        begin = r["start_word"] - r["shift"]
        assert min(distance(a, f[begin:end]) for end in range(begin + 1, len(f) + 1)) <= 0.2 * r["n_words"]


# ------------------------------------------------------------------ mixing

def _targets(sizes, weights, total, most):
    """Water level by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * weights[s]) for s in sizes) < total else (low, mid)
    return {s: min(most * sizes[s], high * weights[s]) for s in sizes}


def test_mixing(docs, rows):
    found = mixing.mix(docs, mixing.cycled([5, 2, 1]), 1.5, 2.0).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    weights = dict(zip(["a", "b", "hot", None], [5, 2, 1, 5]))
    want = _targets(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == sorted((r[0] or -1, len((r[1] or "").encode().split())) for r in rows)
    for s in sizes:
        own = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and own[0]["target"] == pytest.approx(want[s], rel=1e-9)
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 2 * largest
        assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in own)
    again = mixing.mix(docs.repartition(3), mixing.cycled([5, 2, 1]), 1.5, 2.0).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mixing_meets_targets_of_many_documents(spark):
    d = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 50 AS int)) AS text", "if(id % 3 = 0, 'x', concat('s', id % 4)) AS source")
    found = mixing.mix(d, mixing.cycled([5, 2, 1])).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 25 for r in found)
    taken = [{r["doc_id"] for r in mixing.mix(d, mixing.cycled([1]), share=s, most=1.0).filter("copies > 0").collect()} for s in (0.2, 0.5, 0.9)]
    assert taken[0] < taken[1] < taken[2]


def test_mixed_repeats_rows(docs):
    plan = mixing.mix(docs, mixing.cycled([5, 2, 1]))
    want = Counter({r["doc_id"]: r["n"] for r in plan.groupBy("doc_id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()})
    got = Counter(r["doc_id"] for r in mixing.mixed(docs, mixing.cycled([5, 2, 1])).collect())
    assert got == +want


# ------------------------------------------------------------------ packing

def test_packing(docs, rows):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    found = packing.pack(docs, BYTE_BPE, length=512, with_ids=True).collect()
    by_doc = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 512 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
    want = Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((d, len(ids), at, tuple(ids[at:at + 512])) for at in range(0, len(ids), 512))
    assert Counter((d, n, at, tuple(ids)) for (d, n), pieces in by_doc.items() for at, ids in pieces) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 512
    tokens = sum(r["length"] for r in found)
    assert len(sequences) <= math.ceil(tokens / 512) * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1), st.just(64))
def test_patterns_place_every_piece(histogram, size):
    packs = packing.patterns(histogram, size)
    placed = Counter()
    for n, pack in packs:
        assert sum(pack) <= size and n > 0
        for length in pack:
            placed[length] += n
    assert placed == histogram


_MIXED_TEXT = st.lists(st.sampled_from(list(" \t\n\r abTH'.,!é日\x85\xa0 　\x1c_0²🙂ßª") + ["'s", "the", " the", "<|endoftext|>", "<s>", "▁", "ing"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(_MIXED_TEXT, max_size=5))
def test_chunked_ids_are_the_library_ids(texts):
    encoder = _encoder()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def _encoder(kept=[]):
    if not kept:
        kept.append(packing.ChunkEncoder(BYTE_BPE))
    return kept[0]


# ------------------------------------------------------------------ token counts

def _counter(kept=[]):
    if not kept:
        kept.append(tokencounts.PrefixCounter(PIECE_BPE))
    return kept[0]


@settings(max_examples=300, deadline=None)
@given(_MIXED_TEXT, st.integers(0, 8))
def test_prefix_counts_are_the_library_counts(text, limit):
    counter = _counter()
    want = [len(counter.library.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == want and counter.totals([text]) == [want[-1]]
    assert counter.fitting(text, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_token_counts(docs, rows):
    library = _counter().library
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t, *_ in rows]
    assert values(tokencounts.token_counts(docs, PIECE_BPE)) == sorted(want, key=repr)
    limited = docs.select("text", tokencounts.truncated(docs["text"], PIECE_BPE, 7).alias("t"), tokencounts.prefix_counts(docs["text"], PIECE_BPE).alias("n"))
    for r in limited.filter("text is not null").collect():
        assert r["text"].startswith(r["t"]) and r["n"][len(r["t"])] <= 7 and all(n > 7 for n in r["n"][len(r["t"]) + 1:])


# ------------------------------------------------------------------ licences

def test_licences_match_sql(docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    found = licences.scan(docs)
    cur = con.execute(licences.oracle_sql())
    names = [c[0] for c in cur.description]
    assert values(found.select(*names)) == sorted(cur.fetchall(), key=repr)


def test_licence_places(spark):
    rows = [(1, "x MIT\nLicense mit-license; GNU general public LICENSE version 3 cc by sa"), (2, "license mit"), (3, None)]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (4, 1, 11, "cc-by,gpl,mit")
    assert found[1]["labels"] == "cc-by,cc-by-sa,gpl,gpl-3.0,mit"
    assert (found[2]["n_base"], found[2]["first_word"], found[2]["labels"], found[2]["score"]) == (0, None, "", 0.0)
    assert (found[3]["n_words"], found[3]["base_labels"]) == (0, "")


# ------------------------------------------------------------------ language

def test_language_vectors_by_hand():
    """The operator's bundle and cosine, letter by letter."""
    first, second, third = langid._vectors(64, 7)
    text = "Ab c"
    grams = [(0, ord("a"), ord("b")), (ord("a"), ord("b"), 0), (0, ord("c"), 0)]
    want = sum(first[a].astype(int) * second[b] * third[c] for a, b, c in grams)
    codes, n = langid.grams(text)
    assert (n @ langid.gram_vectors(codes, 64, 7)).tolist() == want.tolist()
    assert (first[5] == np.roll(third[5], 2)).all() and (second[5] == np.roll(third[5], 1)).all()


def test_language_held_out(spark):
    rng = np.random.default_rng(1)
    words = {"en": ["the", "and", "of", "ing", "that", "with"], "de": ["der", "und", "sch", "ung", "nicht", "für"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang if i % 7 else None) for i in range(400) for lang in [("en", "de")[i % 2]]]
    d = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 %", "de"), (None, "the und", "fr")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(d).collect()}
    import zlib

    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert all(found[i]["lang_pred"] == ("en", "de")[i % 2] and 0 < found[i]["score"] <= 1 for i in range(400))
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and found[1000]["score"] == 0
    assert found[None]["lang_pred"] in ("en", "de")  # a row without an id teaches nothing
    unlabelled = d.withColumn("lang", d["lang"].substr(10, 1)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.identify(d).filter("held_out and lang is not null")
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count() > 0


def test_licence_texts_are_cut_into_words_once(docs):
    """Neither look at the texts cuts them again (before: each did)."""
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_components_rounds_take_few_partitions(spark, monkeypatch):
    """However many shuffle partitions there are, a round's edges lie in as few as they need."""
    from lexspark.llm import components as C

    links = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 100), (7, 7)]
    want = {(i, i - i % 10) for i in range(40)}
    df = spark.createDataFrame(links, "a long, b long")
    made, plain = [], C.cut
    monkeypatch.setattr(C, "cut", lambda x: made.append(plain(x)) or made[-1])
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert {tuple(r) for r in C.components(df).collect()} == want
        assert len(made) > 2 and all(x.rdd.getNumPartitions() == 1 for x in made[1:])
        monkeypatch.setattr(C, "PART_ROWS", 5)
        assert {tuple(r) for r in C.components(df).collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
