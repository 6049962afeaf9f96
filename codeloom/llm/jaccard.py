"""Operator 10: n-gram Jaccard join with adaptive multi-match prefixes.

A document's set of word shingles is ordered from rare to frequent. If two
sets are similar enough, their prefixes of size - least overlap + l share l
shingles, for any l. Each document takes the l whose prefix is expected to
cost least: its postings plus the candidates that share l of them by chance.
Two documents are candidates when their prefixes share as many shingles as the
lesser of their l. Candidates are then verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common
from codeloom.llm.components import components

#: Buckets that shingles are counted in for the order. It only has to be the same everywhere; collisions cost time, not results.
BUCKETS = 1 << 20
CHUNKS = 64
#: The l that are weighed.
MATCHES = (1, 2, 3, 4, 6, 8)
#: What verifying a candidate costs against reading a posting.
VERIFY_COST = 20.0
#: Postings of a shingle that are all paired at once; longer lists are first paired with so many pivots.
SHORT, PIVOTS = 4, 2
#: Bits of the map of candidates' ids that the texts are filtered by before their sets are sent.
ID_BITS = 1 << 24


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's offsets into them.

    Fewer than n words are one shingle of them all; no words, none.
    """
    words, ends = common.lower_words(texts)
    index, hashes = common.word_ids(words)
    words_at = hashes[index]
    size = np.diff(ends)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(size)), count)
    at = np.arange(int(count.sum())) + np.repeat(ends[:-1] - (np.cumsum(count) - count), count)
    upto = ends[1:][doc]
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(0x9E3779B97F4A7C15)
        for k in range(n):
            out = (out + np.where(at + k < upto, words_at[np.minimum(at + k, max(0, len(words_at) - 1))], np.uint64(k + 1)) if len(at) else out) * factor
    out = common.mix64(out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return out[new], np.searchsorted(doc[new], np.arange(len(size) + 1))


def per_text(values: np.ndarray, ends: np.ndarray, how) -> np.ndarray:
    """how.reduceat over each text's values; 0 for texts without any."""
    out = np.zeros(len(ends) - 1, values.dtype)
    full = np.diff(ends) > 0
    if len(values):
        out[full] = how.reduceat(values, ends[:-1][full])
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def least_overlap(a, b, percent: int):
    """The least intersection with which 100 * intersection >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def sets_and_counts(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, size and fingerprint of each document's set; and how many sets hold a shingle of each bucket.

    One pass over the texts. A task counts into one array and sends it in
    chunks; chunks are summed by Spark, and only the sums, of fixed size, come here.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in common.slices(batch):
                found, ends = shingles(part.column(1), n)
                total += np.bincount(buckets(found), minlength=BUCKETS).astype(np.uint32)
                with np.errstate(over="ignore"):
                    f1, f2 = per_text(found, ends, np.add), per_text(common.mix64(found + np.uint64(77)), ends, np.add)
                none = pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), signed(np.diff(ends)), signed(f1), signed(f2), none, pa.nulls(part.num_rows, pa.binary())], schema=schema)
        if total.any():
            chunks = [x.tobytes() for x in total.reshape(CHUNKS, -1)]
            nothing = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(range(CHUNKS), pa.int32()), pa.array(chunks, pa.binary())], schema=schema)

    kinds = "doc_id bigint, size bigint, f1 bigint, f2 bigint, chunk int, counts binary"
    both = common.stored(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, kinds), "shingle-sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    chunks = both.where("chunk is not null").select("chunk", "counts")
    got = chunks.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()
    counts = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
    for chunk, sums in got:
        counts[chunk] += np.frombuffer(sums, np.int64)
    return both.where("chunk is null").select("doc_id", "size", "f1", "f2"), counts.ravel()


def prefix_sizes(frequency: np.ndarray, place: np.ndarray, size: np.ndarray, ends: np.ndarray, documents: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's l and the size of its prefix, by the least estimated cost."""
    below = np.concatenate([[0.0], np.cumsum(frequency)])
    short = size - least_overlap_alone(size, percent)
    best = np.full(len(size), np.inf)
    matches, length = np.ones(len(size), np.int64), np.minimum(short + 1, size)
    for l in MATCHES:
        n = np.minimum(short + l, size)
        postings = below[ends[:-1] + n] - below[ends[:-1]]
        mean = postings / max(documents, 1.0)
        less, term = np.exp(-mean), np.exp(-mean)
        for k in range(1, l):
            term = term * mean / k
            less = less + term
        cost = postings + VERIFY_COST * documents * np.maximum(1 - less, 0)
        better = (cost < best) & ((short + l <= size) | (l == 1))
        best[better], matches[better], length[better] = cost[better], l, n[better]
    return matches, length


def least_overlap_alone(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set with any similar one: that with its smallest similar subset."""
    return -(-(percent * size) // 100)


def prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray, documents: int) -> DataFrame:
    """doc_id, size, matches, p1, p2, sketch and tokens: each set's prefix, rare shingles first.

    sketch has a bit for each of 512 classes of shingles: whether the set holds
    an odd number of them; p1 and p2 have 128 coarser classes. Sets differ in
    as many shingles as these bits, at least.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("matches", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            for part in common.slices(batch):
                found, ends = shingles(part.column(1), n)
                size = np.diff(ends)
                doc = np.repeat(np.arange(len(size)), size)
                often = counts[buckets(found)]
                order = np.lexsort((found, often, doc))
                found, often = found[order], often[order]
                matches, length = prefix_sizes(often, doc, size, ends, documents, percent)
                keep = np.arange(len(found)) - ends[:-1][doc] < length[doc]
                bit = common.mix64(found + np.uint64(131))
                where = (bit >> np.uint64(55)).astype(np.int64)
                odd = (np.bincount(doc * 512 + where, minlength=512 * len(size)) & 1).astype(np.uint8).reshape(-1, 512)
                sketch = np.packbits(odd, axis=1)
                parity = np.bitwise_xor.reduce(sketch.view(np.uint64).reshape(-1, 4, 2), axis=1)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), signed(found[keep]))
                yield pa.RecordBatch.from_arrays([part.column(0), signed(size), signed(matches), signed(np.ascontiguousarray(parity[:, 0])), signed(np.ascontiguousarray(parity[:, 1])), pa.array([x.tobytes() for x in sketch], pa.binary()), tokens], schema=schema)

    kinds = "doc_id bigint, size bigint, matches bigint, p1 bigint, p2 bigint, sketch binary, tokens array<bigint>"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, kinds)


def possible(apart: np.ndarray, size_a, size_b, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in `apart` shingles at least can be similar enough."""
    return (apart <= size_a + size_b - 2 * least_overlap(size_a, size_b, percent)) & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))


def met(group: pa.Table, percent: int) -> pa.Table:
    """What the postings of a shard's tokens say: kind 0 pairs of a short list, 1 pairs with a long list's pivots, 2 a long list's postings.

    Lists of up to SHORT postings give all their pairs. Of longer ones only
    those with the first PIVOTS, which have the fewest shingles rarer than the
    token and so lie in the middle of what is alike: no more rows than a few
    for each posting, however many are alike.
    """
    token, doc, size, matches, place, p1, p2 = (group.column(c).to_numpy() for c in ("token", "doc_id", "size", "matches", "place", "p1", "p2"))
    order = np.lexsort((doc, place, token))
    token, doc, size, matches = (x[order] for x in (token, doc, size, matches))
    p1, p2 = p1.view(np.uint64)[order], p2.view(np.uint64)[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(first, len(token)))
    begun, long = np.repeat(first, length), np.repeat(length > SHORT, length)
    at = np.arange(len(token))
    pairs = []
    for k in range(1, SHORT):
        j = at[~long & (at - begun >= k)]
        pairs.append((0, j - k, j))
    for k in range(PIVOTS):
        j = at[long & (at - begun > k)]
        pairs.append((1, begun[j] + k, j))
    columns = []
    for kind, i, j in pairs:
        apart = np.bitwise_count(p1[i] ^ p1[j]).astype(np.int64) + np.bitwise_count(p2[i] ^ p2[j])
        near = possible(apart, size[i], size[j], percent) & (doc[i] != doc[j])
        i, j = i[near], j[near]
        columns.append((np.full(len(i), kind), np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), np.minimum(matches[i], matches[j])))
    kind, a, b, least = (np.concatenate(x) for x in zip(*columns, strict=True))
    order = np.lexsort((b, a, kind))
    kind, a, b, least = kind[order], a[order], b[order], least[order]
    new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(a)))
    posted = at[long]
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([kind[new], np.full(len(posted), 2)]), pa.int32()),
            pa.array(np.concatenate([a[new], token[posted]])),
            pa.array(np.concatenate([b[new], doc[posted]])),
            pa.array(np.concatenate([least[new], matches[posted]])),
            pa.array(np.concatenate([n, np.ones(len(posted), np.int64)])),
        ],
        names=["kind", "a", "b", "least", "n"],
    )


def apart_in(group: pa.Table, percent: int) -> pa.Table:
    """a, b, least, n: pairs of long lists that lie in different components and that their sketches leave possible.

    The largest component of a list is compared with the others, never with itself.
    """
    group = group.combine_chunks()
    token, doc, size, matches, component = (group.column(c).to_numpy() for c in ("token", "doc_id", "size", "matches", "component"))
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, 8)
    order = np.argsort(token, kind="stable")
    found = []
    for rows in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
        kinds, of, often = np.unique(component[rows], return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            continue
        largest = of == np.argmax(often)
        rows, of = np.concatenate([rows[~largest], rows[largest]]), np.concatenate([of[~largest], of[largest]])
        for k in range(int((~largest).sum())):
            i, j = rows[k], rows[k + 1 :][of[k + 1 :] != of[k]]
            j = j[possible(np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1).astype(np.int64), size[i], size[j], percent) & (doc[j] != doc[i])]
            if len(j):
                found.append((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), np.minimum(matches[i], matches[j])))
    a, b, least = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (a[new], b[new], least[new], np.diff(np.append(new, len(a))))], names=["a", "b", "least", "n"])


def linked(docs: DataFrame, prefix: DataFrame, n: int, percent: int) -> DataFrame:
    """node, component_id as from components(), of the candidates' links.

    First the pairs of short lists and those with pivots are verified. What
    that joins needs no further pair; pairs of long lists are then made only
    across components. A pair's shared shingles count over both kinds of list.
    """
    spark = prefix.sparkSession
    shard = lambda c: F.pmod(F.col(c), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    rows = prefix.select("doc_id", "size", "matches", "p1", "p2", F.posexplode("tokens").alias("place", "token")).withColumn("shard", shard("token"))
    kinds = "kind int, a bigint, b bigint, least bigint, n bigint"
    found = common.stored(rows.groupBy("shard").applyInArrow(lambda group: met(group, percent), kinds), "candidates")
    short = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    first = short.where("n >= least").select("a", "b").unionByName(found.where("kind = 1").select("a", "b")).distinct()
    links = common.stored(verified(docs, common.stored(first, "candidates"), n, percent), "links")
    joined = common.stored(components(links), "components")

    of = joined.withColumnsRenamed({"node": "_node", "component_id": "_c"})
    postings = found.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("doc_id"))
    postings = postings.join(of, F.col("doc_id") == F.col("_node"), "left").select("token", "doc_id", F.coalesce("_c", "doc_id").alias("component"))
    split = postings.groupBy(F.col("token").alias("_t")).agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high")
    postings = postings.join(split, F.col("token") == F.col("_t"), "left_semi").withColumnRenamed("doc_id", "_d")
    full = postings.join(prefix.select("doc_id", "size", "matches", "sketch"), F.col("_d") == F.col("doc_id")).drop("_d").withColumn("shard", shard("token"))
    across = full.groupBy("shard").applyInArrow(lambda group: apart_in(group, percent), "a bigint, b bigint, least bigint, n bigint")
    rest = across.unionByName(short.where("n < least").select("a", "b", "least", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "b")
    rest = common.stored(rest, "candidates")
    if rest.isEmpty():
        return joined
    more = verified(docs, rest, n, percent)
    return components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component_id").alias("b"))))


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. Only candidates' sets are made and sent."""
    spark = docs.sparkSession
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(ID_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit("id").alias("bit"))
    words = ids.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    wanted = np.zeros(ID_BITS + 65536, bool)
    for k, bits in words:
        first = 32768 * k if k else 0
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        wanted[first : first + len(flags)] |= flags
    sent = spark.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            spot = batch.column(2).to_numpy()
            keep = wanted[slot(spot)]
            for part in common.slices(batch.filter(pa.array(keep))) if keep.any() else ():
                found, ends = shingles(part.column(1), n)
                raw = found.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    def slot(bits: np.ndarray) -> np.ndarray:
        """32768 * bitmap_bucket_number + bitmap_bit_position: buckets begin at 1, 32769, ..., and 0 has one of its own."""
        return np.where(bits > 0, (1 + (bits - 1) // 32768) * 32768 + (bits - 1) % 32768, 0)

    with_bit = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), bit("doc_id").alias("bit"))
    sets = common.stored(with_bit.mapInArrow(run, "id bigint, shingles binary").dropDuplicates(["id", "shingles"]), "candidate-sets")
    left = pairs.join(sets.select(F.col("id").alias("_a"), F.col("shingles").alias("sa")), F.col("a") == F.col("_a")).drop("_a")
    both = left.join(sets.select(F.col("id").alias("_b"), F.col("shingles").alias("sb")), F.col("b") == F.col("_b")).select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                one = np.concatenate([s, t])
                one.sort()
                same = int(np.count_nonzero(one[1:] == one[:-1]))
                similar.append(100 * same >= percent * (len(s) + len(t) - same))
            yield batch.select([0, 1]).filter(pa.array(similar, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint").distinct()


def with_row_ids(docs: DataFrame) -> DataFrame:
    """row (all columns), id and text, each row with an id of its own: its doc_id, where no other row has that.

    Rows without a doc_id and those that share one with other rows get ids
    above all doc_ids.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text"))
    shared = rows.select("id").groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("_shared"))
    shared = common.stored(shared, "shared-ids")
    if shared.isEmpty():
        return rows
    top = rows.agg(F.max("id")).first()[0] or 0
    odd = rows.join(shared, F.col("id").eqNullSafe(F.col("_shared")), "left_semi")
    odd = common.stored(odd.withColumn("_id", F.monotonically_increasing_id() + F.lit(max(top, 0) + 1)), "odd-rows")
    even = rows.where("id is not null").join(shared, F.col("id") == F.col("_shared"), "left_anti")
    return even.unionByName(odd.select("row", F.col("_id").alias("id"), "text"))


def similar_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of docs(doc_id, text), linked where 100 * intersection >= percent * union.

    component_id is the least doc_id that links reach. Equal sets are one
    class, compared once by its least doc_id; the others follow it, so copies
    are never paired with each other. Documents without words, and those
    without a doc_id, link with nothing. Rows that repeat a doc_id are one
    document, which links with what any of its texts links with through the
    texts that are the least of their class; keep_one() tells rows apart. An
    empty table gives no rows; further columns are left out.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets, counts = sets_and_counts(docs, n)
    classes = sets.where("size > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = common.stored(classes, "classes")
    documents = classes.count()
    prefix = prefixes(docs, n, percent, counts, documents).where("size > 0")
    prefix = prefix.join(classes.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
    found = linked(docs, common.stored(prefix, "prefixes"), n, percent)
    by_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("component_id", "rep").alias("_c"))
    out = sets.join(by_class, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("size") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of similar ones, all columns as they were.

    The least doc_id stays. Rows without a doc_id, or with one that other rows
    have too, are documents like any other and give way to those with a doc_id
    of their own. Rows without words all stay.
    """
    rows = with_row_ids(docs)
    groups = similar_documents(rows.select(F.col("id").alias("doc_id"), "text"), n, percent)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, F.col("id") == F.col("_gone"), "left_anti").select("row.*")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(common.table(spark, sf_dir, "documents"), n=3, percent=90)
