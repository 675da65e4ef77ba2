"""Hierarchical Pitman-Yor language model of whole texts.

A word is a customer in the restaurant of the word before it; every word has a restaurant, and so has
a text's beginning. They share one parent: a table of a context's restaurant is a customer of the
parent, whose base is uniform over the learned words and one share for all others.

Pairs of a word and its context are dealt to owners by the word's hash, but where a frequent word
(one of ``CONTEXTS``, or a text's end) follows another context than these, by the context's, so that
no owner has all contexts of a word like that. What owners share meets once a sweep. Numbers that are
few go through the driver: tables and customers by frequent context, and the parent's customers by
frequent word, whose tables at the parent are drawn there. Tables and customers of all other contexts
are summed by owners of the contexts and come back to the owners of their pairs; the parent's
customers of other words are all with one owner. A sweep seats each dish of each restaurant anew,
customer by customer, given the last seating of everything else (Gibbs, block by dish). The customer-
by-customer draw has the wrong normaliser for dishes that are given, so ``DRAWS`` seatings are drawn
and one taken by its importance weight. Within a sweep dishes see the totals of the sweep before, as
usual in distributed samplers. Predictive probabilities are averaged over the sweeps after burn-in.

Texts ask for their words' probabilities by chunk: a chunk's distinct pairs go to the owners, and
the answers come back to the chunk, so hot words cost each chunk as much as others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .langid import held_out
from .tokens import bytes_in, tokens_of

WORD = ~bytes_in(" ", (9, 13))
END = np.uint64(0xE17D0C5A9B3F2461)  # the hash of a text's end
BEGIN = np.uint64(0x5BC1F7A92E60D38F)  # the hash of what is before a text
CONTEXTS = 4096
RARE = 1 << 13  # contexts from here on are numbered by their places in ``names``
CHUNK = 1 << 21  # words of a chunk; 21 bits number its words, and its texts
OWNED = 1 << 22  # words of the corpus for each owner
PARTS = 4  # of the owners, that answer one after the other
STRENGTH = 1.0
BURN_IN, SAMPLES, DRAWS = 1, 2, 2
_EXACT, _GROWTH = 32, 8  # customers seated one by one; further ones in blocks of an eighth of those seated


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each: all lowest bytes, then all next ones, since the
    higher ones compress well by themselves."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :len(packed) // n] = np.frombuffer(packed, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<i8")


@dataclass
class Pairs:
    """Words, each with the contexts it stands in (merged ones in order of both); counts by pair.
    A context is a frequent one's number, or from ``RARE`` on one of ``names``, sorted hashes."""

    words: np.ndarray
    sizes: np.ndarray  # contexts of each word
    contexts: np.ndarray
    counts: np.ndarray  # of learned occurrences
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    COLUMNS = ("words", "sizes", "contexts", "counts", "names")

    def packed(self) -> list[bytes]:
        return [self.words.tobytes(), _packed(self.sizes), _packed(self.contexts), _packed(self.counts), self.names.tobytes()]

    @staticmethod
    def of(row: dict) -> Pairs:
        words = np.frombuffer(row["words"], np.uint64)
        sizes = _numbers(row["sizes"], len(words))
        return Pairs(words, sizes, _numbers(row["contexts"], n := int(sizes.sum())), _numbers(row["counts"], n), np.frombuffer(row["names"], np.uint64))

    @staticmethod
    def merged(parts: list[Pairs]) -> Pairs:
        words, own = np.unique(np.concatenate([np.repeat(p.words, p.sizes) for p in parts]), return_inverse=True)
        names = np.unique(np.concatenate([p.names for p in parts]))
        code = own.astype(np.int64) << 32 | np.concatenate([p.numbered(names) for p in parts])
        order = np.argsort(code, kind="stable")
        new = np.flatnonzero(np.diff(code[order], prepend=-1))
        kept = code[order][new]
        return Pairs(words, np.bincount(kept >> 32, minlength=len(words)), kept & 0xFFFFFFFF, np.add.reduceat(np.concatenate([p.counts for p in parts])[order], new), names)

    def numbered(self, names: np.ndarray) -> np.ndarray:
        """The contexts by the numbers they have under ``names``, which hold all names here."""
        out = self.contexts.copy()
        rare = np.flatnonzero(out >= RARE)
        out[rare] = RARE + np.searchsorted(names, self.names)[out[rare] - RARE]
        return out

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start) if len(self.sizes) else values[:0]

    def places(self, other: Pairs) -> np.ndarray:
        """Where the pairs of ``other`` are, all of which are here."""
        word = np.searchsorted(self.words, other.words)
        mine = np.repeat(np.arange(len(self.words)), self.sizes) << 32 | self.contexts
        return np.searchsorted(mine, np.repeat(word, other.sizes) << 32 | other.numbered(self.names))


@dataclass
class Totals:
    """What restaurants share: customers and tables by frequent context (last two: no restaurant, and a
    text's beginning), customers and tables of the parent, discounts, distinct learned words, and the
    parent's customers and tables by frequent word."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int
    discount: float
    root_discount: float
    known: int
    dish_customers: np.ndarray | None = None
    dish_tables: np.ndarray | None = None

    @property
    def base(self) -> float:
        return 1.0 / (self.known + 1)

    def within(self, tables: np.ndarray, customers: np.ndarray) -> Totals:
        """With the tables and customers of an owner's ``names`` from ``RARE`` on."""
        def longer(frequent: np.ndarray, rare: np.ndarray) -> np.ndarray:
            return np.concatenate((frequent, np.zeros(RARE - len(frequent), np.int64), rare))

        return replace(self, tables=longer(self.tables, tables), customers=longer(self.customers, customers))


def seated(c: np.ndarray, base: np.ndarray | float, others: np.ndarray | float, discount: float, rng: np.random.Generator, draws: int = DRAWS) -> np.ndarray:
    """The number of tables at which ``c`` customers (1 or more) of a dish sit, for each dish: ``base``
    is the parent's probability of the dish, ``others`` the tables with other dishes."""
    order = np.argsort(-c, kind="stable")
    c = c[order]
    base, others = np.broadcast_to(base, c.shape)[order], np.broadcast_to(others, c.shape)[order]
    tables = np.ones((draws, len(c)), np.int64)
    weight = np.zeros((draws, len(c)))
    here = 1
    falling = -c
    while n := int(np.searchsorted(falling, -here, "left")):  # dishes with customers left come first
        block = 1 if here < _EXACT else here // _GROWTH
        more = np.minimum(block, c[:n] - here)
        t = tables[:, :n]
        new = (STRENGTH + discount * (others[:n] + t)) * base[:n]
        total = new + here + (more - 1) / 2 - discount * t
        opened = rng.random((draws, n)) * total < new if block == 1 else rng.binomial(more, new / total)
        weight[:, :n] += more * np.log(total)
        tables[:, :n] += opened
        here += block
    share = np.exp(weight - weight.max(axis=0))
    pick = (rng.random(len(c)) * share.sum(axis=0) > np.cumsum(share, axis=0)).sum(axis=0)
    out = np.empty(len(c), np.int64)
    out[order] = tables[np.minimum(pick, draws - 1), np.arange(len(c))]
    return out


def _root_customers(p: Pairs, tables: np.ndarray, contexts: int) -> np.ndarray:
    """By word: tables in contexts' restaurants, and customers without one (context ``contexts``)."""
    return p.by_word(np.where(p.contexts == contexts, p.counts, tables))


def parent_probability(customers: np.ndarray, tables: np.ndarray, s: Totals) -> np.ndarray:
    return (customers - s.root_discount * tables + (STRENGTH + s.root_discount * s.root_tables) * s.base) / (STRENGTH + s.root_customers)


def _parent(p: Pairs, tables: np.ndarray, root_tables: np.ndarray, s: Totals, contexts: int, dish: np.ndarray | None) -> np.ndarray:
    """By word; ``dish`` is a frequent word's number and -1 for others."""
    customers = _root_customers(p, tables, contexts)
    if dish is not None:
        customers, root_tables = np.where(dish >= 0, s.dish_customers[dish], customers), np.where(dish >= 0, s.dish_tables[dish], root_tables)
    return parent_probability(customers, root_tables, s)


def probability(p: Pairs, tables: np.ndarray, root_tables: np.ndarray, s: Totals, contexts: int, dish: np.ndarray | None = None) -> np.ndarray:
    """Of every pair's word in its context, under one seating."""
    parent = np.repeat(_parent(p, tables, root_tables, s, contexts, dish), p.sizes)
    u = p.contexts
    own = (p.counts - s.discount * tables + (STRENGTH + s.discount * s.tables[u]) * parent) / (STRENGTH + s.customers[u])
    return np.where(u == contexts, parent, own)


def _sweep(p: Pairs, tables: np.ndarray, root_tables: np.ndarray, s: Totals, contexts: int, rng: np.random.Generator, dish: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    parent = _parent(p, tables, root_tables, s, contexts, dish)
    free = np.flatnonzero((p.counts > 1) & (p.contexts != contexts))  # a lone customer has a table
    out = tables.copy()
    out[free] = seated(p.counts[free], np.repeat(parent, p.sizes)[free], s.tables[p.contexts[free]] - tables[free], s.discount, rng)
    customers = _root_customers(p, out, contexts)
    sat = np.flatnonzero(customers if dish is None else (customers > 0) & (dish < 0))
    root = np.zeros(len(customers), np.int64)
    root[sat] = seated(customers[sat], s.base, s.root_tables - root_tables[sat], s.root_discount, rng)
    return out, root


# ------------------------------------------------------------------ texts

def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all words, each text closed by an end."""
    t = tokens_of(batch.column("text"), WORD)
    n = np.bincount(t.row, minlength=batch.num_rows)
    row = np.repeat(np.arange(batch.num_rows), n + 1)
    h = np.full(len(row), END)
    h[np.arange(len(t.hash)) + t.row] = t.hash
    return row, h


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        held.append(np.unique(_words(batch)[1], return_counts=True))
        if sum(len(x) for x, _ in held) > CHUNK:
            yield out()
            held = []
    if held:
        yield out()


_REQUESTS = ("chunk long, owner int, words binary, sizes binary, contexts binary, counts binary, names binary, posts binary, docs binary, times binary, "
             "ids array<struct<number: long, doc_id: long, held_out: boolean, n_tokens: long>>")


def _found(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in sorted hashes, -1 for those that aren't there."""
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    return np.where(known[at] == h, at, -1) if len(known) else np.full(len(h), -1)


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)


def _dishes(known: np.ndarray) -> np.ndarray:
    """The frequent words: contexts, and a text's end."""
    return np.union1d(known, np.array([END]))


def _requests(known: np.ndarray, number: np.ndarray, owners: int):
    """By chunk and owner, the distinct (word, context) of a chunk, how often each is learned, and
    the texts it stands in; and one row by chunk (owner -1) that lists its texts."""
    contexts = len(known)
    dishes = _dishes(known)

    def chunk(at: int, row: np.ndarray, h: np.ndarray, before: np.ndarray, texts: list[tuple]) -> Iterator[dict]:
        """``texts``: (number, doc_id, held out, learned) from the first row on."""
        low = int(row[0])
        local = row - low
        words, own = np.unique(h, return_inverse=True)
        befores, last = np.unique(before, return_inverse=True)
        learned = np.fromiter((x[3] for x in texts), bool, len(texts))
        code = (own.astype(np.int64) << 21 | last) << 21 | local
        code.sort()
        new = np.flatnonzero(np.diff(code, prepend=-1))
        times, post = np.diff(np.append(new, len(code))), code[new]
        pair, doc = post >> 21, post & (1 << 21) - 1
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        counts = np.add.reduceat(times * learned[doc], first)
        posts = np.diff(np.append(first, len(pair)))
        word, context = pair[first] >> 21, pair[first] & (1 << 21) - 1

        place = _found(known, befores)
        numbers = np.where(befores == BEGIN, contexts + 1, np.where(place >= 0, number[place] if contexts else 0, RARE))
        owner = np.where((_found(dishes, words) >= 0)[word] & (numbers == RARE)[context], _owner(befores, owners)[context], _owner(words, owners)[word])
        narrow = owner.astype(np.uint16 if owners <= 1 << 16 else np.int64)
        order = np.argsort(np.repeat(narrow, posts), kind="stable")
        doc, times = doc[order], times[order]
        order = np.argsort(narrow, kind="stable")
        owner, word, context, counts, posts = owner[order], word[order], context[order], counts[order], posts[order]
        ends = np.cumsum(posts)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=owners))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k, m = int(ends[i] - posts[i]), int(ends[j - 1])
            fresh = np.flatnonzero(np.diff(word[i:j], prepend=-1))
            own = numbers[context[i:j]]
            rare = own == RARE
            names, own_name = np.unique(context[i:j][rare], return_inverse=True)
            own[rare] += own_name
            part = Pairs(words[word[i:j][fresh]], np.diff(np.append(fresh, j - i)), own, counts[i:j], befores[names])
            yield {"chunk": at, "owner": int(owner[i]), **dict(zip(Pairs.COLUMNS, part.packed())), "posts": _packed(posts[i:j]), "docs": _packed(doc[k:m]), "times": _packed(times[k:m]), "ids": None}
        n = np.bincount(local, minlength=len(texts)).tolist()
        ids = [{"number": x[0], "doc_id": x[1], "held_out": x[2], "n_tokens": y} for x, y in zip(texts, n)]
        yield {"chunk": at, "owner": -1, **dict.fromkeys((*Pairs.COLUMNS, "posts", "docs", "times")), "ids": ids}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), *[(c, pa.binary()) for c in (*Pairs.COLUMNS, "posts", "docs", "times")],
                            ("ids", pa.list_(pa.struct([("number", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())])))])
        base = TaskContext.get().partitionId() << 40
        made, seen = 0, 0
        row, h, before = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        texts: list[tuple] = []  # from row ``seen - len(texts)`` of the task on

        def flush(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal made, row, h, before, texts
            first = seen - len(texts)
            own = texts[int(row[0]) - first:int(row[n - 1]) - first + 1]
            for x in chunk(base + made, row[:n], h[:n], before[:n], own):
                yield pa.RecordBatch.from_pylist([x], schema)
            made += 1
            row, h, before = row[n:], h[n:], before[n:]
            texts = texts[(int(row[0]) if len(row) else seen) - first:]

        for batch in batches:
            r, words = _words(batch)
            b = np.concatenate((words[:1], words[:-1]))
            b[np.flatnonzero(np.diff(r, prepend=-1))] = BEGIN
            row, h, before = np.concatenate((row, r + seen)), np.concatenate((h, words)), np.concatenate((before, b))
            held, learned = batch.column("held_out").to_pylist(), batch.column("learned").to_pylist()
            texts += [(base + seen + k, x, held[k], learned[k]) for k, x in enumerate(batch.column("doc_id").to_pylist())]
            seen += batch.num_rows
            while len(row) >= CHUNK:
                yield from flush(CHUNK)
        if len(row):
            yield from flush(len(row))

    return run


# ------------------------------------------------------------------ owners

_STATE = ("owner int, words binary, sizes binary, contexts binary, counts binary, names binary, tables array<binary>, roots array<binary>, "
          "rare array<binary>, shared array<long>")


def _state_rows(owner: int, p: Pairs, tables: list[bytes], roots: list[bytes], rare: list[bytes], shared: np.ndarray) -> pa.Table:
    """``rare``: the tables of the restaurants in ``names`` under earlier seatings that are kept."""
    schema = pa.schema([("owner", pa.int32()), *[(c, pa.binary()) for c in Pairs.COLUMNS], ("tables", pa.list_(pa.binary())), ("roots", pa.list_(pa.binary())),
                        ("rare", pa.list_(pa.binary())), ("shared", pa.list_(pa.int64()))])
    return pa.Table.from_pylist([{"owner": owner, **dict(zip(Pairs.COLUMNS, p.packed())), "tables": tables, "roots": roots, "rare": rare, "shared": shared.tolist()}], schema)


def _shared(p: Pairs, tables: np.ndarray, root: np.ndarray, contexts: int, dish: np.ndarray | None = None, dishes: int = 0) -> np.ndarray:
    """An owner's part of the totals: tables by frequent context, customers by frequent context, the
    parent's customers by frequent word; then, of all other words, the parent's customers and tables
    and distinct learned words; dishes of one and of two customers in contexts and at the parent."""
    customers, learned = _root_customers(p, tables, contexts), p.by_word(p.counts) > 0
    by_dish = np.zeros(dishes)
    if dish is not None:
        frequent = dish >= 0
        by_dish = np.bincount(dish[frequent], customers[frequent], dishes)
        customers, root, learned = customers[~frequent], root[~frequent], learned[~frequent]
    inside = p.counts[p.contexts != contexts]
    often = p.contexts < RARE
    u, n, t = p.contexts[often], p.counts[often], tables[often]
    return np.concatenate((np.bincount(u, np.where(u == contexts, 0, t), contexts + 2), np.bincount(u, n, contexts + 2), by_dish,
                           [customers.sum(), root.sum(), learned.sum(), (inside == 1).sum(), (inside == 2).sum(), (customers == 1).sum(), (customers == 2).sum()])).astype(np.int64)


def _owned(contexts: int, dishes: np.ndarray):
    """An owner's pairs from all chunks; at first each dish has one table in a restaurant."""
    def run(rows: pa.Table) -> pa.Table:
        p = Pairs.merged([Pairs.of(x) for x in rows.to_pylist()])
        tables = (p.counts > 0).astype(np.int64)
        root = (p.by_word(p.counts) > 0).astype(np.int64)
        return _state_rows(rows.column("owner")[0].as_py(), p, [_packed(tables)], [_packed(root)], [], _shared(p, tables, root, contexts, _found(dishes, p.words), len(dishes)))

    return run


_PARTS = "part int, owner int, names binary, tables binary, customers binary"


def _rare_parts(owners: int):
    """Tables and customers that an owner has of the contexts in ``names``, cut by the contexts' owners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("owner", pa.int32()), *[(c, pa.binary()) for c in ("names", "tables", "customers")]])
        for batch in batches:
            for x in batch.to_pylist():
                p = Pairs.of(x)
                rare = p.contexts >= RARE
                u, n = p.contexts[rare] - RARE, len(p.names)
                tables = np.bincount(u, _numbers(x["last"], len(p.counts))[rare], n).astype(np.int64)
                customers = np.bincount(u, p.counts[rare], n).astype(np.int64)
                to = _owner(p.names, owners)
                cuts = np.flatnonzero(np.diff(to, prepend=-1, append=owners))
                rows = [{"part": int(to[a]), "owner": x["owner"], "names": p.names[a:b].tobytes(), "tables": _packed(tables[a:b]), "customers": _packed(customers[a:b])}
                        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield from pa.Table.from_pylist(rows, schema).to_batches()

    return run


def _rare_sums(rows: pa.Table) -> pa.Table:
    """Sums over owners, for each owner that asked, in the order of its names."""
    asked = rows.to_pylist()
    names = [np.frombuffer(x["names"], np.uint64) for x in asked]
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    sums = [np.bincount(back, np.concatenate([_numbers(x[c], len(n)) for x, n in zip(asked, names)])).astype(np.int64)[back] for c in ("tables", "customers")]
    stop = np.cumsum([len(n) for n in names]).tolist()
    out = [{"part": x["part"], "owner": x["owner"], "n": len(n), **{c: _packed(v[b - len(n):b]) for c, v in zip(("tables", "customers"), sums)}} for x, n, b in zip(asked, names, stop)]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("owner", pa.int32()), ("n", pa.int64()), ("tables", pa.binary()), ("customers", pa.binary())]))


def _with_rare(state: DataFrame, owners: int) -> DataFrame:
    """The state, with the totals of the contexts in each owner's ``names`` under the last seating."""
    parts = state.select("owner", *Pairs.COLUMNS, F.element_at("tables", -1).alias("last")).mapInArrow(_rare_parts(owners), _PARTS)
    sums = parts.groupBy("part").applyInArrow(_rare_sums, "part int, owner int, n long, tables binary, customers binary")
    return state.join(sums.groupBy("owner").agg(F.collect_list(F.struct("part", "n", "tables", "customers")).alias("totals")), "owner", "left")


def _rare_totals(totals: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers by name; owners of contexts follow in the order of the hashes."""
    parts = sorted(totals or [], key=lambda t: t["part"])
    return tuple(np.concatenate([np.zeros(0, np.int64), *[_numbers(t[c], t["n"]) for t in parts]]) for c in ("tables", "customers"))


def _swept(s: Totals, contexts: int, dishes: np.ndarray, seed: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x = batch.slice(at, 1).to_pylist()[0]
                p = Pairs.of(x)
                dish, rare = _found(dishes, p.words), _rare_totals(x["totals"])
                rng = np.random.default_rng([seed, x["owner"]])
                tables, root = _sweep(p, _numbers(x["tables"][-1], len(p.counts)), _numbers(x["roots"][-1], len(p.words)), s.within(*rare), contexts, rng, dish)
                before = (x["tables"], x["roots"], [*x["rare"], _packed(rare[0])]) if keep else ([], [], [])
                yield from _state_rows(x["owner"], p, [*before[0], _packed(tables)], [*before[1], _packed(root)], before[2],
                                       _shared(p, tables, root, contexts, dish, len(dishes))).to_batches()

    return run


def _totals(state: DataFrame, contexts: int, dishes: int, before: Totals | None, seed: int) -> Totals:
    """Sums over owners, two numbers a frequent restaurant and one a frequent word, whose tables at the
    parent are drawn here; discounts from the first seating stay."""
    n = 2 * (contexts + 2) + dishes + 7

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n, np.int64)
        for batch in batches:
            out += batch.column(0).flatten().to_numpy().reshape(-1, n).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(out)], names=["k", "x"])

    rows = state.select("shared").mapInArrow(add, "k int, x long").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    x = np.zeros(n, np.int64)
    x[rows.column("k").to_numpy()] = rows.column("x").to_numpy()
    tables, customers, by_dish, rest = x[:contexts + 2], x[contexts + 2:2 * contexts + 4], x[2 * contexts + 4:-7], x[-7:].tolist()
    drawn = (by_dish > 0).astype(np.int64)
    sat = np.flatnonzero(by_dish)
    if before:
        drawn[sat] = seated(by_dish[sat], before.base, before.root_tables - before.dish_tables[sat], before.root_discount, np.random.default_rng(seed))
    root_customers, root_tables = rest[0] + int(by_dish.sum()), rest[1] + int(drawn.sum())
    if before:
        return replace(before, tables=tables, root_customers=root_customers, root_tables=root_tables, dish_customers=by_dish, dish_tables=drawn)

    def discount(one: int, two: int) -> float:
        return min(0.95, max(0.05, one / max(1, one + 2 * two)))

    return Totals(customers, tables, root_customers, root_tables, discount(*rest[3:5]), discount(rest[5] + int((by_dish == 1).sum()), rest[6] + int((by_dish == 2).sum())),
                  rest[2] + len(sat), by_dish, drawn)


def _answers(samples: list[Totals], contexts: int, dishes: np.ndarray, dish_counts: np.ndarray):
    """log10 of the averaged probability of each pair that a chunk asks for, and each word's learned count."""
    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        rows = []
        for x in state.to_pylist():
            p = Pairs.of(x)
            dish, (last, customers) = _found(dishes, p.words), _rare_totals(x["totals"])
            rare = [*[_numbers(r, len(p.names)) for r in x["rare"]], last]
            mean = sum(probability(p, _numbers(t, len(p.counts)), _numbers(r, len(p.words)), s.within(u, customers), contexts, dish)
                       for t, r, u, s in zip(x["tables"], x["roots"], rare, samples, strict=True)) / len(samples)
            logs, counts = np.log10(mean).astype(np.float32), np.where(dish >= 0, dish_counts[dish], p.by_word(p.counts))
            for c in range(asked.num_rows):
                q = asked.slice(c, 1).to_pylist()[0]
                own = Pairs.of({**q, "counts": b""})
                rows.append({"chunk": q["chunk"], "owner": q["owner"], "logs": logs[p.places(own)].tobytes(), "known": _packed(counts[np.searchsorted(p.words, own.words)])})
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("logs", pa.binary()), ("known", pa.binary())]))

    return run


_SCORED = "number long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(n_learned: int, known: int):
    """A chunk's texts with sums over their words."""
    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        told = {x["owner"]: x for x in answers.to_pylist()}
        texts = next(x for x in asked.select(["owner", "ids"]).to_pylist() if x["owner"] < 0)["ids"]
        n = len(texts)
        n_known, base, score = np.zeros(n), np.zeros(n), np.zeros(n)
        for at in range(asked.num_rows):
            x = asked.slice(at, 1).drop_columns("ids").to_pylist()[0]
            if x["owner"] < 0:
                continue
            words = x["n"]
            sizes = _numbers(x["sizes"], words)
            posts = _numbers(x["posts"], int(sizes.sum()))
            doc, times = _numbers(x["docs"], int(posts.sum())), _numbers(x["times"], int(posts.sum()))
            c = _numbers(told[x["owner"]]["known"], words)
            logs = np.frombuffer(told[x["owner"]]["logs"], np.float32).astype(float)
            c = np.repeat(np.repeat(c, sizes), posts)
            n_known += np.bincount(doc, times * (c > 0), n)
            base += np.bincount(doc, times * np.log10((c + 0.1) / (n_learned + 0.1 * (known + 1))), n)
            score += np.bincount(doc, times * np.repeat(logs, posts), n)
        columns = [pa.array([t[k] for t in texts], kind) for k, kind in (("number", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()))]
        return pa.table([*columns, n_known.astype(np.int64), base, score], names=["number", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, folds: int = 10, contexts: int = CONTEXTS, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 7,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Learned are the texts whose id's crc32 isn't divisible by ``folds``; those of a null id are
    scored, neither learned nor held out. A text is its words (A to Z lower-cased) and an end; null
    and empty texts are an end alone. Every word has a restaurant; ``contexts`` only says how many
    frequent ones have their totals shared by all owners. ``base_score`` is that of smoothed word counts, ``score`` the
    log10 probability under the model; words never learned share one probability. Repeated rows have
    rows of their own and are learned as often; an empty table stays empty; further columns are
    ignored. Results repeat with ``seed`` but for the last digits of sums. Words are known by 64-bit
    hashes.
    """
    if contexts + 2 > RARE:
        raise ValueError(f"contexts: at most {RARE - 2}; words beyond them have restaurants all the same")
    small_batches(docs.sparkSession)
    doc_id = F.col(id_col)
    texts = docs.select(doc_id.cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(doc_id, folds).alias("held_out"),
                        (doc_id.isNotNull() & ~held_out(doc_id, folds)).alias("learned"))
    counts = written(texts.filter("learned").select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    known, n_learned = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = n_learned * folds // max(1, folds - 1)
    end = F.col("h") == int(END.view(np.int64))
    rows = counts.orderBy(end.desc(), F.col("n").desc(), "h").limit(contexts + 1).toArrow()
    hashes = rows.column("h").to_numpy().view(np.uint64)
    often = hashes[hashes != END]
    order = np.argsort(often)
    n_contexts = len(often)
    dishes = _dishes(often)
    dish_counts = np.zeros(len(dishes), np.int64)
    dish_counts[_found(dishes, hashes)] = rows.column("n").to_numpy()
    owners = max(1, -(-total // OWNED))

    requests = written(texts.mapInArrow(_requests(often[order], order, owners), _REQUESTS), "requests")
    asked = requests.filter("owner >= 0").select("chunk", "owner", *Pairs.COLUMNS)
    state = written(asked.drop("chunk").groupBy("owner").applyInArrow(_owned(n_contexts, dishes), _STATE), "seating")
    totals = _totals(state, n_contexts, len(dishes), None, seed)
    kept = []
    for sweep in range(burn_in + samples):
        last, state = state, written(_with_rare(state, owners).mapInArrow(_swept(totals, n_contexts, dishes, seed + sweep, sweep > burn_in), _STATE), "seating")
        discard(last)
        totals = _totals(state, n_contexts, len(dishes), totals, seed + sweep)
        if sweep >= burn_in:
            kept.append(totals)
    # in parts, so that no shuffle holds all requests
    told = [written(asked.drop("counts").filter(F.pmod("owner", F.lit(PARTS)) == part).groupBy("owner")
                    .cogroup(_with_rare(state, owners).filter(F.pmod("owner", F.lit(PARTS)) == part).groupBy("owner"))
                    .applyInArrow(_answers(kept, n_contexts, dishes, dish_counts), "chunk long, owner int, logs binary, known binary"), "answers") for part in range(PARTS)]
    discard(state)
    answers = reduce(DataFrame.unionByName, told)
    sums = (requests.select("chunk", "owner", F.expr("length(words) div 8").alias("n"), "sizes", "posts", "docs", "times", "ids").groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(_scored(n_learned, known), _SCORED))
    return (sums.groupBy("number").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                       F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_learned).cast("long").alias("train_tokens"), "base_score", "score"))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, texts, tokens, base_perplexity and perplexity, each over all tokens of a fold."""
    def of(c: str):
        return F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), of("base_score").alias("base_perplexity"), of("score").alias("perplexity"))
