"""Operator 5: token ids as Arrow stream files of equal-length sequences and masks.

A part holds the ids of a range of documents, in ascending order, packed into
sequences of one length; what the last sequence lacks is masked. Beside each
part stands a second stream file with each document's place in it. Both can be
memory-mapped: a batch's buffers are then views of the file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, common

SEQUENCE = 2048
#: Sequences in a batch: the unit of random access.
BATCH = 128
#: Bytes of text in a part, about; smaller corpora have a part for each core, of a sixteenth or more.
PART_BYTES = 16 << 20
DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, path string, docs_path string, n_docs bigint, n_tokens bigint"
#: Distinct words that a worker remembers, about; then the half unused for longest goes.
REMEMBERED = 500_000
#: The normalizer and pre-tokenizer that WordEncoder knows.
WORDS_ONLY = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class WordEncoder(bpe.PieceEncoder):
    """The piece encoder of models that lower-case and drop white space (WORDS_ONLY).

    White space before a piece is dropped and its ASCII letters are lower-cased
    before pieces are told apart. Pieces of Latin letters alone are one word
    each: the library's model encodes them without its normalizer and
    pre-tokenizer, which would leave them as they are. All others go through
    the whole tokenizer.
    """

    def __init__(self, spec: str, most: int = REMEMBERED):
        super().__init__(spec)
        self.model, self.most, self.now = self.tokenizer.model, most, 0
        #: the bytes of lower-cased words as the characters that stand for them
        self.shown = {b: c for b, c in enumerate(bpe.byte_table()) if chr(b) != c}

    def clear(self) -> None:
        super().clear()
        #: the call of encode that last met each piece
        self.last = np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        plain = plain_words(pa.array(pieces, pa.large_string()))
        words, others = list(compress(pieces, plain)), [f" {p}" for p in compress(pieces, ~plain)]
        found, sizes = [], []
        for word in map(str.lower, words):
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.shown)
            tokens = self.model.tokenize(word)
            found += [x.id for x in tokens]
            sizes.append(len(tokens))
        ids, n = self._encode(pa.array(others, pa.large_string())) if others else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        n = np.concatenate([np.array(sizes, np.int64), n])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.ids = np.concatenate([self.ids, np.array(found, np.uint32), ids])
        self.known.update(zip(words + [p[1:] for p in others], range(len(self.n), len(self.n) + len(pieces)), strict=True))
        self.n, self.last = np.concatenate([self.n, n]), np.concatenate([self.last, np.full(len(pieces), self.now)])

    def _forget(self) -> np.ndarray:
        """Drops the half of the pieces that was unused for longest, none of this call's; the places of those that stay."""
        cutoff = np.partition(self.last, len(self.last) // 2)[len(self.last) // 2]
        stays = self.last >= self.now if cutoff >= self.now else self.last > cutoff
        n = self.n[stays]
        ends = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.at[stays] - (ends - n), n) + np.arange(int(n.sum()))]
        self.at, self.n, self.last = ends - n, n, self.last[stays]
        self.known = dict(zip(compress(self.known, stays), range(len(n)), strict=True))
        return np.cumsum(stays) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, starts = common.string_bytes(pc.fill_null(texts.cast(pa.large_string()), ""))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        cuts = word_cuts(raw, starts)
        low, at = bare(raw, cuts)
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(at), pa.py_buffer(low)).dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        self.now += 1
        spot = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = spot < 0
        self.last[spot[~new]] = self.now
        if new.any():
            if len(self.known) and len(self.known) + int(new.sum()) > self.most:
                spot[~new] = self._forget()[spot[~new]]
            pieces = list(compress(distinct, new))
            self._learn(pieces)
            spot[new] = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        n = self.n[spot][index]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[spot][index] - (ends - n), n) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(cuts, starts)]


def word_cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """bpe.cut_points without those inside a text between U+0130, whose lower case ends in a mark, and the punctuation that this mark is one match with."""
    cuts = bpe.cut_points(raw, starts)
    at = cuts[(cuts > 1) & (cuts < len(raw))]
    at = at[(raw[at - 1] == 0xB0) & (raw[at - 2] == 0xC4) & ~common.SPACE[raw[at]]]
    return np.setdiff1d(cuts, np.setdiff1d(at, starts), assume_unique=True) if len(at) else cuts


def bare(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes and offsets without the ASCII white space before each and that behind other such, A-Z lower-cased.

    A letter before a byte outside ASCII stays as it is: a mark may follow,
    with which only one of the two cases has a character of its own.
    """
    low = np.where(np.append(raw[1:], np.uint8(0)) < 0x80, common.LOWER[raw], raw)
    space = common.SPACE[raw]
    drops = np.zeros(len(raw) + 1, bool)
    drops[cuts] = True
    drops[1:-1] |= space[:-1]
    keeps = ~(drops[:-1] & space)
    return low[keeps], np.concatenate([[0], np.cumsum(keeps)])[cuts]


def plain_words(pieces: pa.Array) -> np.ndarray:
    """Whether a piece is letters of ASCII and U+00C0 to U+017F alone, one at least; not U+0130, whose lower case has a mark."""
    raw, at = common.string_bytes(pieces)
    prev = np.concatenate([np.zeros(1, np.uint8), raw])[:-1]
    lead = (raw >= 0xC3) & (raw <= 0xC5)
    behind = (prev >= 0xC3) & (prev <= 0xC5) & ~((prev == 0xC3) & ((raw == 0x97) | (raw == 0xB7))) & ~((prev == 0xC4) & (raw == 0xB0))
    letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    upto = np.concatenate([[0], np.cumsum(~(letter | lead | behind))])
    return (np.diff(upto[at]) == 0) & (np.diff(at) > 0)


def encoder(spec: str) -> bpe.PieceEncoder:
    """This worker's encoder for a tokenizer."""
    key, kept = ("words", hashlib.sha1(spec.encode()).hexdigest()), common.process_cache()
    if key not in kept:
        parts = json.loads(spec)
        known = (parts["normalizer"], parts["pre_tokenizer"]) == WORDS_ONLY and all(t["special"] for t in parts["added_tokens"])
        kept[key] = WordEncoder(spec) if known and parts["model"]["type"] == "BPE" and not parts["model"]["dropout"] else bpe.encoder(spec)
    return kept[key]


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs ids into fixed-size-list batches of one stream file."""

    def __init__(self, sink, length: int, wide: bool, pad: int):
        self.schema = sequence_schema(length, wide)
        self.kind, self.length, self.pad = (np.uint32 if wide else np.uint16), length, pad
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.rest = np.zeros(0, self.kind)
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        whole = len(self.rest) // (self.length * BATCH) * self.length * BATCH
        for i in range(0, whole, self.length * BATCH):
            self._put(self.rest[i : i + self.length * BATCH], self.length * BATCH)
        self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            valid = len(self.rest)
            self._put(np.concatenate([self.rest, np.full(-valid % self.length, self.pad, self.kind)]), valid)
        self.out.close()


def write(docs: DataFrame, spec: str, folder: str, end_id: int, sequence: int = SEQUENCE, parts: int | None = None) -> list:
    """Encodes docs(doc_id, text) into part files under `folder`; a manifest row for each part, in order.

    Null texts are empty: their only id is end_id. Rows sort by doc_id, null
    first, then by a hash of the text, so repeated ids have a fixed order and
    no single id fills a part. An empty table makes no files. The manifest has
    as many rows as there are parts, whose number follows the bytes of the
    texts and the rows.
    """
    spark: SparkSession = docs.sparkSession
    if not parts:
        size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // (PART_BYTES // 16))))
    sent = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            if batch.num_rows and enc is None:
                enc = encoder(sent.value)
                wide = enc.tokenizer.get_vocab_size() > 1 << 16
                part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                made = f"{root}/{attempt}.unfinished"
                sink = fs.open_output_stream(made)
                out, ids_of, sizes = SequenceWriter(sink, sequence, wide, end_id), [], []
            for piece in common.slices(batch):
                ids, ends = enc.encode(piece.column(1))
                out.add(np.insert(ids, ends[1:], end_id))
                ids_of.append(piece.column(0))
                sizes.append(np.diff(ends) + 1)
        if enc is None:
            return
        out.close()
        sink.close()
        sizes = np.concatenate(sizes)
        name = f"{root}/part-{part:05d}"
        with fs.open_output_stream(f"{made}.docs") as sink, pa.ipc.new_stream(sink, DOCS) as stream:
            stream.write_table(pa.table([pa.chunked_array(ids_of, pa.int64()), np.cumsum(sizes) - sizes, sizes], schema=DOCS), max_chunksize=65536)
        common.put_in_place(fs, f"{made}.docs", f"{name}.docs.arrow")
        common.put_in_place(fs, made, f"{name}.arrow")
        at = f"{folder}/part-{part:05d}"
        row = {"part": [part], "path": [f"{at}.arrow"], "docs_path": [f"{at}.docs.arrow"], "n_docs": [len(sizes)], "n_tokens": [out.n]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_tie"))
    dealt = dealt.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return sorted(dealt.mapInArrow(run, MANIFEST).collect())


def open_stream(path: str) -> pa.RecordBatchReader:
    """A part's batches; views of the mapped file where it is a local one."""
    fs, at = pafs.FileSystem.from_uri(path)
    return pa.ipc.open_stream(pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at))


def sequence_at(path: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Tokens and mask of a part's i-th sequence, views of the file where it is a local one.

    All batches but the last have the same length in bytes, so the place of
    any batch follows from the first one's; nothing else is read.
    """
    fs, at = pafs.FileSystem.from_uri(path)
    with pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at) as file:
        schema = pa.ipc.read_schema(pa.ipc.read_message(file))
        begun = file.tell()
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(file), schema)
        if i >= BATCH:
            file.seek(begun + i // BATCH * (file.tell() - begun))
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(file), schema)
    row = i % BATCH
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values


def documents_in(path: str, docs_path: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, first, n_tokens, crc32 of its ids as unsigned 32-bit integers) of each document of a part."""
    table = open_stream(docs_path).read_all()
    ids, first, sizes = table.column(0).to_pylist(), table.column(1).to_numpy(), table.column(2).to_numpy()
    ends, doc, crc, at = first + sizes, 0, 0, 0
    for batch in open_stream(path):
        mask = batch.column(1).flatten()
        tokens = batch.column(0).flatten()
        if mask.true_count < len(mask):
            tokens = tokens.filter(mask)
        raw = tokens.to_numpy().astype("<u4").tobytes()
        upto = at + len(tokens)
        while doc < len(ids) and first[doc] < upto:
            crc = zlib.crc32(raw[4 * (max(at, first[doc]) - at) : 4 * (min(upto, ends[doc]) - at)], crc)
            if ends[doc] > upto:
                break
            yield ids[doc], int(first[doc]), int(sizes[doc]), crc
            doc, crc = doc + 1, 0
        at = upto


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    starts = np.concatenate([[0], np.cumsum([m.n_tokens for m in manifest])])
    rows = [(m.path, m.docs_path, int(s)) for m, s in zip(manifest, starts[:-1], strict=True)]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs_path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple] = []
                for doc_id, first, n, crc in documents_in(path, docs_path):
                    held.append((doc_id, before + first, n, crc))
                    if len(held) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=schema)

    files = spark.createDataFrame(rows, "path string, docs_path string, start bigint")
    return files.repartition(max(1, len(rows))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as spec:
        manifest = write(common.table(spark, sf_dir, "documents"), spec.read(), common.new_path(spark, "tokens"), end_id=2)
    return read(spark, manifest)
