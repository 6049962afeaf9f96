"""Operator 8: language-model scores of a hierarchical Pitman-Yor model.

Dishes are all training words, the end of a text, and one outcome for words
that training texts don't have. A context restaurant for each preceding word
has the root restaurant as its parent, whose base is uniform. Seating is
sampled by Gibbs: all customers of a dish leave their restaurant and sit down
again at once, the number of their tables drawn from its exact conditional
given everybody else's tables. A round is one sweep over the shards' contexts
and one over the root, reseated by the tables that all shards opened; the
chain goes on from round to round. Predictive probabilities are averaged over
the last rounds.

Nothing that grows with the corpus is gathered in one place. Context
restaurants are sharded by context and the root by word: a round sends each
shard's opened tables to its words' shards, and the root's tables of those
words back. A shard's cells (context, word), its tables after each round and
its scores are files in the shared folder, so rounds move messages alone.
Documents' cells are looked up in the shards of their contexts.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common

#: Cells (context, word) with at least this share of the training tokens are scored where the texts are read; there are as many at most.
HOT_CELLS = 4096
#: Tokens a shard should hold, about.
SHARD_TOKENS = 6_000_000
ROUNDS, BURN_IN = 5, 2
#: A restaurant's dishes sit down again in so many turns, one dish a turn in restaurants of as many dishes or fewer.
TURNS = 8
#: Dishes with more customers than this are seated customer by customer instead of from the exact conditional.
EXACT = 256
STRENGTH = 1.0
SEED = 8
END = common.hash_strings(pa.array(["\n"], pa.large_string()))[0]
BEGIN = common.hash_strings(pa.array(["\t"], pa.large_string()))[0]
POSTINGS = pa.schema([("shard", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("keys", "spans", "texts", "times", "known", "base", "score")]])
POSTINGS_SQL = "shard int, slice bigint, kind int, keys binary, spans binary, texts binary, times binary, known binary, base binary, score binary"
INFO, CELL = 0, 1


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers [c, t]: the weight of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        out[c + 1, 1 : c + 2] = out[c, : c + 1]
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c, :c], out[c, 1 : c + 1] + np.log(c - discount * t))
    return out


class Seating:
    """Dishes with their customers, in the order that they are reseated in."""

    def __init__(self, customers: np.ndarray, turn: np.ndarray, discount: float, weights: np.ndarray):
        """turn: when each dish is reseated; weights: log_stirling(discount)."""
        self.customers, self.discount, self.weights = customers, discount, weights
        some = np.flatnonzero(customers > 1)
        size = np.minimum(customers[some], EXACT + 1)
        order = np.lexsort((size, turn[some]))
        self.at, size, turn = some[order], size[order], turn[some][order]
        first = heads(turn, size)
        #: (turn, customers, begin, end) of the dishes that are alike
        self.groups = list(zip(turn[first].tolist(), size[first].tolist(), first.tolist(), [*first[1:].tolist(), len(size)][: len(first)], strict=True))

    def first(self) -> np.ndarray:
        return np.minimum(self.customers, 1).astype(np.int64)

    def sweep(self, rng: np.random.Generator, tables: np.ndarray, others, parent: np.ndarray) -> None:
        """Reseats all dishes in place. others(rows): tables of all the other dishes in the rows' restaurants as they now are; parent: the dishes' odds in the parent."""
        now, of = -1, np.zeros(0)
        for turn, c, begin, end in self.groups:
            rows = self.at[begin:end]
            if turn != now:
                now, upto = turn, next((g[2] for g in self.groups if g[0] > turn and g[2] >= end), len(self.at))
                start, of = begin, others(self.at[begin:upto])
            beside = of[begin - start : end - start]
            if c > EXACT:
                tables[rows] = self.one_by_one(rng, self.customers[rows], beside, parent[rows])
                continue
            # t tables weigh S[c, t] * product over i < t of (strength + discount * (others + i)) * parent
            for k in range(0, len(rows), max(1, 2_000_000 // c)):
                part = slice(k, k + max(1, 2_000_000 // c))
                steps = STRENGTH + self.discount * (beside[part, None] + np.arange(c))
                steps *= parent[rows[part], None]
                log = np.cumsum(np.log(steps), axis=1) + self.weights[c, 1 : c + 1]
                upto_ = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
                tables[rows[part]] = 1 + (upto_ < rng.random(len(log))[:, None] * upto_[:, -1:]).sum(axis=1)

    def one_by_one(self, rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Tables after the customers sat down in turn, each seeing the tables opened before; beyond EXACT customers in groups of an eighth of those seated."""
        tables = np.ones(len(customers), np.int64)
        at, j = np.arange(len(customers)), 1
        while len(at):
            group = 1 if j <= EXACT else j // 8
            t, room = tables[at], np.minimum(customers[at] - j, group)
            opens = (STRENGTH + self.discount * (others[at] + t)) * parent[at]
            p = opens / (opens + np.maximum(j - self.discount * t, 1e-9))
            tables[at] += (rng.random(len(at)) < p) if group == 1 else rng.binomial(room, p)
            j += group
            at = at[customers[at] > j]
        return tables


class Words:
    """What is known of the training words as a whole."""

    def __init__(self, total: int, types: int):
        self.total, self.types = total, types

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in doc_ids], bool)


def tokens_of(part: pa.RecordBatch):
    """(index, hashes of the distinct words, each text's offsets) of the texts' words."""
    words, ends = common.lower_words(part.column(1))
    index, hashes = common.word_ids(words)
    return index, hashes, ends


def successions(index: np.ndarray, end: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, preceding word and word of every token, text by text: `end` is the number of a text's end, end + 1 that of its beginning."""
    size = np.diff(ends) + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    dish = np.full(int(upto[-1]), end, np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    inner = np.ones(len(dish), bool)
    inner[upto[1:] - 1] = False
    dish[inner] = index
    before = np.empty_like(dish)
    before[1:] = dish[:-1]
    before[upto[:-1]] = end + 1
    return doc, before, dish


def cells_of(index: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct cells' keys, contexts and words, and (text, cell's place) of every token, ends included, text by text."""
    names = np.append(hashes, np.array([END, BEGIN], np.uint64))
    doc, before, dish = successions(index, len(hashes), ends)
    pairs, place = distinct(before * len(names) + dish)
    contexts, words = names[pairs // len(names)], names[pairs % len(names)]
    return cell_keys(contexts, words), contexts, words, doc, place


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse; where number and place fit 63 bits they are sorted as one, which takes a tenth of sorting places by numbers."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    both = np.sort(x << bits | np.arange(len(x)))
    x, at = both >> bits, both & ((1 << bits) - 1)
    first = heads(x)
    place = np.empty(len(x), np.int64)
    place[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    return x[first], place


class Cells(NamedTuple):
    """Cells (context, word) and their training counts; c and w are places in contexts and words."""

    contexts: np.ndarray
    words: np.ndarray
    c: np.ndarray
    w: np.ndarray
    counts: np.ndarray


def counted(index: np.ndarray, hashes: np.ndarray, ends: np.ndarray, train: np.ndarray) -> Cells:
    """A slice's cells; those of held-out texts alone count 0."""
    n = len(hashes) + 2
    doc, before, dish = successions(index, n - 2, ends)
    both = np.sort((before * n + dish) << 1 | train[doc])
    first = heads(both >> 1)
    cells = both[first] >> 1
    names = np.append(hashes, np.array([END, BEGIN], np.uint64))
    return Cells(names, names, cells // n, cells % n, np.add.reduceat(both & 1, first) if len(first) else cells)


def cell_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit hashes of (context, word)."""
    with np.errstate(over="ignore"):
        return common.mix64(common.mix64(contexts + np.uint64(0x9E3779B97F4A7C15)) + words)


def sharded(keys: np.ndarray, shards: int) -> np.ndarray:
    return (common.mix64(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def merged(lists: list[Cells]) -> Cells:
    """The distinct cells of the lists with their summed counts, sorted by context and word; contexts and words are sorted, and none is without a cell.

    Places and count are sorted as one number where they fit 63 bits: that
    takes a tenth of sorting the rows by two columns.
    """
    if not lists:
        return Cells(np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    contexts, words = (sorted_set(np.concatenate([getattr(x, name) for x in lists])) for name in ("contexts", "words"))
    wide, most = max(1, len(words).bit_length()), max(int(x.counts.max(initial=0)) for x in lists).bit_length()
    packed = len(contexts).bit_length() + wide + most <= 63
    keys = []
    for x in lists:
        key = spots(contexts, x.contexts)[x.c] << wide | spots(words, x.words)[x.w]
        keys.append(key << most | x.counts.astype(np.int64) if packed else key)
    keys = np.concatenate(keys)
    if packed:
        keys.sort()
        keys, counts = keys >> most, keys & ((1 << most) - 1)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate([x.counts for x in lists]).astype(np.int64)[order]
    first = heads(keys)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    return pruned(Cells(contexts, words, keys >> wide, keys & ((1 << wide) - 1), counts))


def sorted_set(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting: its hash table takes twenty times as long."""
    x = np.sort(x)
    return x[heads(x)]


def spots(among: np.ndarray, names: np.ndarray) -> np.ndarray:
    """np.searchsorted of names in any order; in ascending order they are found several times as fast."""
    order, out = np.argsort(names), np.empty(len(names), np.int64)
    out[order] = np.searchsorted(among, names[order])
    return out


def pruned(x: Cells) -> Cells:
    """The same cells with only the contexts and words that they have."""
    def used(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        has = np.zeros(len(names), bool)
        has[places] = True
        return names[has], (np.cumsum(has) - 1)[places]

    (contexts, c), (words, w) = used(x.contexts, x.c), used(x.words, x.w)
    return Cells(contexts, words, c, w, x.counts)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


CELLS = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("contexts", "spans", "words", "dishes", "counts")]])
CELLS_SQL = "shard int, contexts binary, spans binary, words binary, dishes binary, counts binary"
#: What is told of a shard: its training tokens, and its cells with one and with two of them.
SHARDS_SQL = "shard int, tokens bigint, once bigint, twice bigint"


def cell_counts(docs: DataFrame, shards: int, files: common.ArrayFiles) -> DataFrame:
    """A row for each shard, whose file gets the cells of all texts with their training counts, 0 for held-out ones alone.

    All cells of a context are in one shard: contexts are distinct, spans their
    numbers of cells; dishes are places in the shard's distinct, sorted words.
    """
    def arrays(x: Cells) -> dict[str, np.ndarray]:
        return {"contexts": x.contexts, "spans": np.bincount(x.c, minlength=len(x.contexts)).astype(np.uint32), "words": x.words, "dishes": x.w.astype(np.uint32), "counts": x.counts.astype(np.uint32)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def put():
            every = merged(held)
            where = sharded(every.contexts, shards)[every.c]
            for k in range(shards):
                own = np.flatnonzero(where == k)
                if len(own):
                    x = arrays(pruned(every._replace(c=every.c[own], w=every.w[own], counts=every.counts[own])))
                    yield pa.RecordBatch.from_pydict({"shard": [k]} | {name: [a.tobytes()] for name, a in x.items()}, CELLS)

        for batch in batches:
            train = ~held_out(batch.column(0).to_pylist())
            at = 0
            for part in common.slices(batch):
                held.append(counted(*tokens_of(part), train[at : at + part.num_rows]))
                at += part.num_rows
                size += len(held[-1].c)
                if size > 3_000_000:
                    held = [merged(held)]
                    size = len(held[0].c)
                    if size > 2_000_000:
                        yield from put()
                        held, size = [], 0
        yield from put()

    def add(group: pa.Table) -> pa.Table:
        lists = []
        for contexts, spans, words, dishes, counts in zip(*(group.column(name).to_pylist() for name in CELLS.names[1:]), strict=True):
            spans = np.frombuffer(spans, np.uint32)
            lists.append(Cells(np.frombuffer(contexts, np.uint64), np.frombuffer(words, np.uint64), np.repeat(np.arange(len(spans)), spans), np.frombuffer(dishes, np.uint32), np.frombuffer(counts, np.uint32)))
        shard = group.column("shard")[0].as_py()
        x = merged(lists)
        del lists
        files.write(f"cells-{shard}", **arrays(x))
        out = pa.Table.from_pydict({"shard": pa.array([shard], pa.int32()), "tokens": [int(x.counts.sum())], "once": [int((x.counts == 1).sum())], "twice": [int((x.counts == 2).sum())]})
        del x
        common.give_back()
        return out

    return common.stored(docs.mapInArrow(count, CELLS_SQL).groupBy("shard").applyInArrow(add, SHARDS_SQL), "lm-shards")


ASKED = pa.schema([("shard", pa.int32()), ("asker", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "shard int, asker int, words binary, counts binary"
#: round -1 holds the words' training counts as tables; shard -1 holds sums: the root's customers, its tables, and its words with customers.
REPLY = pa.schema([("shard", pa.int32()), ("round", pa.int32()), ("by", pa.int32()), ("tables", pa.binary()), ("own", pa.binary()), ("sums", pa.list_(pa.int64()))])
REPLY_SQL = "shard int, round int, by int, tables binary, own binary, sums array<bigint>"


def asked(shard: int, words: np.ndarray, counts: np.ndarray, shards: int, named: bool) -> Iterator[dict]:
    """A shard's counts of its words for the shards of the root; the words themselves only if named."""
    where = sharded(words, shards)
    for k in range(shards):
        own = where == k
        if own.any():
            yield {"shard": k, "asker": shard, "words": words[own].tobytes() if named else b"", "counts": counts[own].astype(np.uint32).tobytes()}


def root_words(known: DataFrame, shards: int, files: common.ArrayFiles) -> DataFrame:
    """shard, words, counts, askers, spots: the words of the root's shards, and each asking shard's words as places among them."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                cells = files.read(f"cells-{shard}")
                sums = np.bincount(cells["dishes"], weights=cells["counts"], minlength=len(cells["words"]))
                for row in asked(shard, cells["words"], sums, shards, True):
                    yield pa.RecordBatch.from_pylist([row], ASKED)

    def add(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["asker"])
        lists = [np.frombuffer(r["words"], np.uint64) for r in rows]
        words = sorted_set(np.concatenate(lists))
        counts, spots = np.zeros(len(words), np.int64), [np.searchsorted(words, x) for x in lists]
        for r, at in zip(rows, spots, strict=True):
            counts[at] += np.frombuffer(r["counts"], np.uint32)
        return pa.Table.from_pydict({"shard": [rows[0]["shard"]], "counts": [counts.tobytes()], "askers": [[r["asker"] for r in rows]], "spots": [[x.astype(np.uint32).tobytes() for x in spots]]}, ROOT)

    return common.stored(known.select("shard").repartition(shards, "shard").mapInArrow(ask, ASKED_SQL).groupBy("shard").applyInArrow(add, ROOT_SQL), "lm-words")


ROOT = pa.schema([("shard", pa.int32()), ("counts", pa.binary()), ("askers", pa.list_(pa.int32())), ("spots", pa.list_(pa.binary()))])
ROOT_SQL = "shard int, counts binary, askers array<int>, spots array<binary>"


def replies(shard: int, round_: int, tables: np.ndarray, own: np.ndarray, askers: list, spots: list) -> list[dict]:
    out = [{"shard": -1, "round": round_, "by": shard, "tables": b"", "own": b"", "sums": [int(tables.sum()), int(own.sum()), int((tables > 0).sum())]}]
    for asker, at in zip(askers, spots, strict=True):
        at = np.frombuffer(at, np.uint32)
        out.append({"shard": asker, "round": round_, "by": shard, "tables": tables[at].astype(np.uint32).tobytes(), "own": own[at].astype(np.uint32).tobytes(), "sums": []})
    return out


class Restaurants:
    """A shard's context restaurants: cells sorted by context, their customers and tables."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shard: int, discount: float, bits: int = 16):
        self.counts, self.discount, self.shard = counts.astype(np.int64), discount, shard
        self.dish = keys & ((1 << bits) - 1)
        self.first = heads(keys >> bits)
        spans = np.diff(np.append(self.first, len(keys)))
        self.of = np.repeat(np.arange(len(self.first)), spans)
        self.customers = np.add.reduceat(self.counts, self.first) if len(keys) else np.zeros(0, np.int64)
        turn = (np.arange(len(keys)) - np.repeat(self.first, spans)) % TURNS
        self.seating = Seating(self.counts, turn, discount, log_stirling(discount))

    def opened(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=tables, minlength=len(self.first))

    def sweep(self, tables: np.ndarray, round_: int, root: np.ndarray) -> np.ndarray:
        """Tables of the cells after the round's sweep, given those before it and the root; the same whenever it is asked."""
        rng, tables = np.random.default_rng([SEED, self.shard, round_]), tables.copy()
        self.seating.sweep(rng, tables, lambda rows: self.opened(tables)[self.of[rows]] - tables[rows], root[self.dish])
        return tables

    def chain(self, roots: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tables of the cells and of the restaurants after each round, given the root before it."""
        tables = self.seating.first()
        for k, root in enumerate(roots):
            tables = self.sweep(tables, k, root)
            yield tables, self.opened(tables)

    def predict(self, root: np.ndarray, tables: np.ndarray, opened: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells' probabilities, and each restaurant's weight of its parent. after: the root that the tables led to."""
        room = STRENGTH + self.customers
        back = (STRENGTH + self.discount * opened) / room
        return (self.counts - self.discount * tables) / room[self.of] + back[self.of] * after[self.dish], back


def root_tables(tables: np.ndarray, discount: float, round_: int, n: int, shard: int = 0, elsewhere: float = 0.0) -> np.ndarray:
    """Tables of a shard's dishes in the root: its customers are the tables below. elsewhere: the root's tables in other shards."""
    rng = np.random.default_rng([SEED, 1 << 20, round_, shard])
    seating = Seating(tables, np.arange(len(tables)) % TURNS, discount, log_stirling(discount))
    own = seating.first()
    seating.sweep(rng, own, lambda rows: elsewhere + own.sum() - own[rows], np.full(len(tables), 1 / n))
    return own


def root_chances(tables: np.ndarray, own: np.ndarray, customers: int, opened: int, n: int, discount: float) -> np.ndarray:
    """The root's predictive probabilities; its base is uniform over n dishes."""
    room = STRENGTH + customers
    return (tables - discount * own) / room + (STRENGTH + discount * opened) / room / n


def reseat_root(tables: np.ndarray, discount: float, round_: int) -> np.ndarray:
    """The probabilities of a root that lies in one shard."""
    own = root_tables(tables, discount, round_, len(tables))
    return root_chances(tables, own, tables.sum(), own.sum(), len(tables), discount)


def discount_of(once: int, twice: int) -> float:
    """The usual estimate from how many cells have one and two customers."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def restaurants_of(cells: dict[str, np.ndarray], shard: int, discount: float) -> Restaurants:
    return Restaurants(np.repeat(np.arange(len(cells["spans"])), cells["spans"]) << 32 | cells["dishes"].astype(np.int64), cells["counts"], shard, discount, 32)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs whose results are stored: it does so once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def heard(answers: list[DataFrame]) -> DataFrame:
    """What the root told the shards in all rounds."""
    out = answers[0].where("shard >= 0")
    for a in answers[1:]:
        out = out.unionByName(a.where("shard >= 0"))
    return out


class Model:
    """What every task needs, the same size whatever the corpus: sums of each round's root, and at most HOT_CELLS scores."""

    def __init__(self, words: Words, discount: float):
        self.words, self.discount = words, discount
        #: round: the root's customers and tables
        self.sums: dict[int, tuple[int, int]] = {}
        self.hot_cells, self.hot_scores, self.hot_counts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def roots(self, words: np.ndarray, rows: list[dict], shards: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """The root's probabilities of a shard's words by round, and their training counts, from the replies to it."""
        where = sharded(words, shards)
        spots = {k: np.flatnonzero(where == k) for k in {r["by"] for r in rows}}
        tables, own = ({k: np.zeros(len(words), np.uint32) for k in {r["round"] for r in rows}} for _ in range(2))
        for r in rows:
            tables[r["round"]][spots[r["by"]]] = np.frombuffer(r["tables"], np.uint32)
            own[r["round"]][spots[r["by"]]] = np.frombuffer(r["own"], np.uint32)
        n = self.words.types + 1
        out = {k: root_chances(tables[k], own[k], *self.sums[k], n, self.discount) for k in {r["round"] for r in rows} if k >= 0}
        if any(r["round"] < 0 for r in rows):
            out[-1] = (tables[-1] + 1.0) / (self.words.total + n)
        return out, tables.get(-1)


def fit(docs: DataFrame, shards: int, files: common.ArrayFiles) -> tuple[Model, dict[int, int]]:
    """The model, whose cells' scores (as log10) are in the shards' files, and the training tokens of each shard."""
    spark = docs.sparkSession
    known = cell_counts(docs, shards, files)
    root = root_words(known, shards, files)
    free_shuffles(spark)
    rows = known.collect()
    discount = discount_of(sum(r["once"] for r in rows), sum(r["twice"] for r in rows))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.frombuffer(r["counts"], np.int64)
                yield pa.RecordBatch.from_pylist(replies(r["shard"], -1, counts, np.zeros_like(counts), r["askers"], r["spots"]), REPLY)

    answers = [common.stored(root.mapInArrow(begin, REPLY_SQL), "lm-root")]
    sums = {r["by"]: r["sums"] for r in answers[0].where("shard < 0").select("by", "sums").collect()}
    model = Model(Words(*(sum(s[k] for s in sums.values()) for k in (0, 2))), discount)
    model.sums[-1] = (model.words.total, 0)
    # every word has a table of the root at first
    opened = {k: s[2] for k, s in sums.items()}
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model, opened))

        def tables(answers: pa.Table) -> pa.Table:
            shard = answers.column("shard")[0].as_py()
            cells = files.read(f"cells-{shard}")
            r = restaurants_of(cells, shard, discount)
            roots, _ = sent.value[0].roots(cells["words"], answers.to_pylist(), shards)
            before = files.read(f"tables-{k - 1}-{shard}")["tables"].astype(np.int64) if k else r.seating.first()
            seated = r.sweep(before, k, roots[k - 1])
            files.write(f"tables-{k}-{shard}", tables=seated.astype(np.uint32))
            out = pa.Table.from_pylist(list(asked(shard, cells["words"], np.bincount(r.dish, weights=seated, minlength=len(cells["words"])), shards, False)), ASKED)
            del cells, r, roots, before, seated
            common.give_back()
            return out

        def reseat(key, rows: pa.Table, messages: pa.Table) -> pa.Table:
            out = []
            for row in rows.to_pylist():
                model, opened = sent.value
                total, spots = np.zeros(len(row["counts"]) // 8, np.int64), dict(zip(row["askers"], row["spots"], strict=True))
                for m in messages.to_pylist():
                    total[np.frombuffer(spots[m["asker"]], np.uint32)] += np.frombuffer(m["counts"], np.uint32)
                own = root_tables(total, discount, k, model.words.types + 1, row["shard"], sum(opened.values()) - opened[row["shard"]])
                out += replies(row["shard"], k, total, own, row["askers"], row["spots"])
            return pa.Table.from_pylist(out, REPLY)

        messages = heard(answers[-1:]).repartition(shards, "shard").groupBy("shard").applyInArrow(tables, ASKED_SQL)
        answers.append(common.stored(root.groupBy("shard").cogroup(messages.groupBy("shard")).applyInArrow(reseat, REPLY_SQL), "lm-root"))
        sums = {r["by"]: r["sums"] for r in answers[-1].where("shard < 0").select("by", "sums").collect()}
        model.sums[k] = tuple(sum(s[i] for s in sums.values()) for i in range(2))
        opened = {k: s[1] for k, s in sums.items()}
        del messages
        free_shuffles(spark)
    everything = spark.sparkContext.broadcast(model)
    hot = max(1, -(-model.words.total // HOT_CELLS))

    def score(answers: pa.Table) -> pa.Table:
        shard = answers.column("shard")[0].as_py()
        cells = files.read(f"cells-{shard}")
        r = restaurants_of(cells, shard, discount)
        roots, counts = everything.value.roots(cells["words"], answers.to_pylist(), shards)
        mean = np.zeros(len(r.counts))
        for k in range(BURN_IN, ROUNDS):
            seated = files.read(f"tables-{k}-{shard}")["tables"].astype(np.int64)
            mean += r.predict(roots[k - 1], seated, r.opened(seated), roots[k])[0] / (ROUNDS - BURN_IN)
        mean = np.log10(mean)
        files.write(f"scores-{shard}", scores=mean.astype(np.float32), word_counts=counts.astype(np.uint32))
        often = np.flatnonzero(r.counts >= hot)
        keys = cell_keys(np.repeat(cells["contexts"], cells["spans"])[often], cells["words"][r.dish[often]])
        out = pa.Table.from_pydict({"keys": [keys.tobytes()], "scores": [mean[often].tobytes()], "counts": [counts[r.dish[often]].astype(np.uint32).tobytes()]}, SCORES)
        del cells, r, roots, mean, seated
        common.give_back()
        return out

    needed = [answers[0], *answers[max(1, BURN_IN) :]] if BURN_IN else answers
    rows = heard(needed).repartition(shards, "shard").groupBy("shard").applyInArrow(score, "keys binary, scores binary, counts binary").collect()
    if rows:
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        order = np.argsort(keys)
        model.hot_cells, model.hot_scores, model.hot_counts = (np.concatenate([np.frombuffer(r[c], t) for r in rows])[order] for c, t in (("keys", np.uint64), ("scores", np.float64), ("counts", np.uint32)))
    tokens = {r["shard"]: r["tokens"] for r in known.collect()}
    for made in (known, root, *answers):
        common.forget(made)
    del known, root, answers, needed
    free_shuffles(spark)
    return model, tokens


SCORES = pa.schema([(c, pa.binary()) for c in ("keys", "scores", "counts")])


def postings(docs: DataFrame, sent, shards: int) -> DataFrame:
    """A row of INFO for each slice of texts, and rows of CELL keys for the shards that know them.

    A row of keys holds each distinct key of the slice once, and the texts it
    is in; a slice's texts are numbered within it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = sent.value, 0
        for batch in batches:
            for part in common.slices(batch):
                index, hashes, ends = tokens_of(part)
                n = part.num_rows
                keys, contexts, _, doc, place = cells_of(index, hashes, ends)
                spot = np.minimum(np.searchsorted(model.hot_cells, keys), max(0, len(model.hot_cells) - 1))
                hot = model.hot_cells[spot] == keys if len(model.hot_cells) else np.zeros(len(keys), bool)
                at = hot[place]
                theirs = spot[place[at]]
                known = np.bincount(doc[at], weights=model.hot_counts[theirs] > 0, minlength=n)
                base = np.bincount(doc[at], weights=model.words.base(model.hot_counts[theirs]), minlength=n)
                score = np.bincount(doc[at], weights=model.hot_scores[theirs], minlength=n)
                name = (TaskContext.get().partitionId() << 32) + number
                number += 1
                ids = part.column(0)
                size = np.diff(ends) + 1
                info = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), size, np.where(ids.is_null().to_numpy(zero_copy_only=False), 2, 0) + held_out(ids.to_pylist())]
                yield pa.RecordBatch.from_pydict(
                    {"shard": [name % shards], "slice": [name], "kind": [INFO], "keys": [info[0].tobytes()], "spans": [info[1].astype(np.int64).tobytes()], "texts": [info[2].astype(np.int64).tobytes()], "times": [b""]}
                    | {"known": [known.astype(np.int32).tobytes()], "base": [base.tobytes()], "score": [score.tobytes()]},
                    POSTINGS,
                )
                yield from keyed(name, keys, sharded(contexts, shards), place[~at], doc[~at])

    return docs.mapInArrow(run, POSTINGS_SQL)


def keyed(name: int, distinct: np.ndarray, shard: np.ndarray, place: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a slice's (key's place in `distinct`, text) pairs by the key's shard."""
    width = int(doc.max(initial=0)) + 1
    pairs = np.sort(place * width + doc)
    first = heads(pairs)
    times, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
    place, doc = pairs // width, pairs % width
    where = shard[place]
    order = np.argsort(where.astype(np.uint16) if len(where) and where.max() < 1 << 16 else where, kind="stable")
    place, doc, times = place[order], doc[order], times[order]
    first = heads(where[order])
    for a, b in zip(first, np.append(first[1:], len(where)), strict=False):
        s = int(where[order[a]])
        own = place[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        row = {"shard": [s], "slice": [name], "kind": [CELL], "keys": [distinct[own[first]].tobytes()]}
        row |= {"spans": [np.diff(np.append(first, len(own))).astype(np.uint16 if width <= 65535 else np.uint32).tobytes()], "texts": [doc[a:b].astype(np.uint16 if width <= 65535 else np.uint32).tobytes()]}
        row |= {"times": [times[a:b].astype(np.uint8 if times[a:b].max() < 256 else np.uint32).tobytes()]}
        yield pa.RecordBatch.from_pydict(row | {c: [None] for c in ("known", "base", "score")}, POSTINGS)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """n unsigned integers of whatever width the bytes have."""
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64)


def looked_up(rows: pa.Table, files: common.ArrayFiles, model: Model) -> Iterator[dict]:
    """The rows of a shard with their keys' sums a text in place of the keys."""
    shard = rows.column("shard")[0].as_py()
    if (np.array(rows.column("kind").to_pylist()) == CELL).any():
        known, scores = files.read(f"cells-{shard}"), files.read(f"scores-{shard}")
        cells = cell_keys(np.repeat(known["contexts"], known["spans"]), known["words"][known["dishes"]])
        order = np.argsort(cells)
        dishes = known["dishes"][order]
        cells, logs, trained, bases = cells[order], scores["scores"][order].astype(np.float64), (scores["word_counts"] > 0)[dishes], model.words.base(scores["word_counts"])[dishes]
        del known, scores, order, dishes
        # keys are evenly spread, so their first bits lead next to their places
        shift = np.uint64(64 - max(1, len(cells).bit_length()))
        near = np.searchsorted(cells, np.arange(1 << (64 - int(shift)), dtype=np.uint64) << shift)
    for row in (rows.slice(i, 1).to_pylist()[0] for i in range(rows.num_rows)):
        if row["kind"] == INFO:
            yield row
            continue
        wanted = np.frombuffer(row["keys"], np.uint64)
        m = len(wanted)
        spans = np.frombuffer(row["spans"], np.uint16 if len(row["spans"]) == 2 * m else np.uint32).astype(np.int64)
        total = int(spans.sum())
        texts, times = unpacked(row["texts"], total), unpacked(row["times"], total)
        spot = near[(wanted >> shift).astype(np.int64)]
        short = np.flatnonzero(cells[spot] < wanted)
        while len(short):  # the cells of all texts are there
            spot[short] += 1
            short = short[cells[spot[short]] < wanted[short]]
        n = int(texts.max()) + 1
        spread = lambda x: np.bincount(texts, weights=np.repeat(x[spot], spans) * times, minlength=n)
        yield row | {"keys": None, "spans": None, "texts": None, "times": None, "score": spread(logs).tobytes(), "known": spread(trained).astype(np.int32).tobytes(), "base": spread(bases).tobytes()}


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text).

    Training texts are those whose crc32(doc_id as text) mod 10 is not 0; a
    null doc_id counts as empty text and is held out. A null or empty text has
    its end alone. Rows that repeat are rows of their own. Without training
    texts all words are unknown; an empty table gives no rows. Further columns
    are left out.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    # the number of shards follows the characters, about six a token
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(max(12, -(-chars // (6 * SHARD_TOKENS))))
    files = common.ArrayFiles(common.new_path(spark, "lm-files"))
    model, tokens = fit(docs, shards, files)
    sent = spark.sparkContext.broadcast(model)

    def lookup(rows: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(list(looked_up(rows.drop_columns(["part"]), files, sent.value)), schema=POSTINGS)
        common.give_back()
        return out

    # what asks a shard is dealt to as many tasks as the shard holds shares of tokens
    parts = spark.createDataFrame([(k, max(1, -(-n // SHARD_TOKENS))) for k, n in tokens.items()] or [(0, 1)], "_shard int, _parts int")
    asking = postings(docs, sent, shards).join(F.broadcast(parts), F.col("shard") == F.col("_shard"), "left")
    asking = asking.withColumn("part", F.pmod(F.xxhash64("slice"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_shard", "_parts")
    sums = asking.groupBy("shard", "part").applyInArrow(lookup, POSTINGS_SQL)
    total = model.words.total

    def finish(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        info = next(r for r in rows if r["kind"] == INFO)
        ids, flags = np.frombuffer(info["keys"], np.int64), np.frombuffer(info["texts"], np.int64)
        n = len(ids)
        out = {"known": np.zeros(n, np.int64), "base": np.zeros(n), "score": np.zeros(n)}
        for r in sorted(rows, key=lambda r: (r["kind"], r["shard"])):
            for c, x in out.items():
                if r[c]:
                    part = np.frombuffer(r[c], np.int32 if c == "known" else np.float64)
                    x[: len(part)] += part
        return pa.Table.from_arrays(
            [pa.array(ids, mask=flags >= 2), pa.array(flags % 2 == 1), pa.array(np.frombuffer(info["spans"], np.int64)), pa.array(out["known"]), pa.array(np.full(n, total, np.int64)), pa.array(out["base"]), pa.array(out["score"])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return sums.groupBy("slice").applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
