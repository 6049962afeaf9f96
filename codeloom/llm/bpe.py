"""Operator 3: byte-level BPE encoding and decoding over Arrow batches.

The ranks of a .tiktoken file become a model of the tokenizers library: bytes
are shown as characters by the byte table, every split of a token into two
tokens is a merge, and merges stand in the order of the tokens they make.
Texts are cut where no match of the pattern can reach across, each distinct
piece of a batch is encoded once, and the ids are put together by offsets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import common

#: Distinct pieces that a worker remembers, at most; then it starts afresh.
REMEMBERED = 200_000
#: Pieces encoded in one call at most, when strung together.
GROUP = 64


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizers library's form of the ranks."""
    table = byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [
        [shown[token[:i]], shown[token[i:]]]
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
    model |= {"fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps(
        {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None}
        | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": level, "model": model}
    )


def cut_points(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which the bytes may be cut: texts' ends, and places no match reaches across.

    Those are an ASCII space behind anything but a space, and ASCII
    punctuation (no apostrophe) behind a Latin letter. Behind bytes that may
    end a space outside ASCII nothing is cut.
    """
    if len(raw) < 4:
        return np.unique(np.append(starts, len(raw)))
    here, prev = raw[1:], raw[:-1]
    two = np.concatenate([[np.uint8(0)], raw[:-2]])
    three = np.concatenate([np.zeros(2, np.uint8), raw[:-3]])
    space = (here == 0x20) | ((here >= 9) & (here <= 13))
    solid = ~((prev == 0x20) | ((prev >= 9) & (prev <= 13)))
    odd = (two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3))
    letter = ((prev | 0x20) >= 0x61) & ((prev | 0x20) <= 0x7A)
    letter |= (prev >= 0x80) & (((two == 0xC3) & (prev != 0x97) & (prev != 0xB7)) | (two == 0xC4) | (two == 0xC5))
    mark = (here >= 0x21) & (here <= 0x7E) & (here != 0x27) & ~((here >= 0x30) & (here <= 0x39)) & ~(((here | 0x20) >= 0x61) & ((here | 0x20) <= 0x7A))
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[1:-1] = (space & solid & ~odd) | (mark & letter)
    cuts[starts] = True
    cuts[-1] = True
    return np.flatnonzero(cuts)


class PieceEncoder:
    """Encodes texts by their distinct pieces; remembers the pieces it has seen, up to a bound."""

    def __init__(self, spec: str, widths: np.ndarray | None = None):
        """widths: bytes a token, for models whose ids spell the text; others are placed by their offsets."""
        # a task has a core: threads of the library's own would only hold memory, more of it the more cores a machine has
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.widths = widths
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number a piece. Pieces are strung together where that leaves their ends cuts."""
        raw, at = common.string_bytes(pieces)
        safe = np.isin(at[:-1], cut_points(raw, np.zeros(1, np.int64)), assume_unique=True)
        safe[::GROUP] = False
        first = np.flatnonzero(~safe)
        ends = at[np.append(first, len(pieces))]
        strung = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(raw))).to_pylist()
        ids, upto = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(strung), 512):
            if self.widths is not None:
                found = self.tokenizer.encode_batch_fast(strung[i : i + 512], add_special_tokens=False)
                ids.append(np.array(list(chain.from_iterable(x.ids for x in found)), np.uint32))
                continue
            # this model lower-cases and drops spaces, so places come from the offsets: a character's byte in the strung text
            for text, begun, x in zip(strung[i : i + 512], ends[i : i + 512], self.tokenizer.encode_batch(strung[i : i + 512], add_special_tokens=False), strict=False):
                ids.append(np.array(x.ids, np.uint32))
                spot = np.array(x.offsets, np.int64).reshape(-1, 2)[:, 0]
                upto.append(begun + (spot if text.isascii() else np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)[spot]))
        ids = np.concatenate(ids)
        begun = np.concatenate(upto) if self.widths is None else np.cumsum(self.widths[ids]) - self.widths[ids]
        return ids, np.diff(np.searchsorted(begun, at))

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces that aren't known; they are told apart by themselves, not by a hash."""
        ids, n = self._encode(pa.array(pieces, pa.large_string()))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids])
        self.known.update(zip(pieces, range(len(self.n), len(self.n) + len(pieces)), strict=True))
        self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, n])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts in a row, and each text's offsets into them (null: empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        raw, starts = common.string_bytes(texts)
        cuts = cut_points(raw, starts)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pieces.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.clear()
        new = [piece for piece in distinct if piece not in self.known]
        if new:
            self._learn(new)
        spot = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        at, n = self.at[spot][index], self.n[spot][index]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]))]
        first = np.searchsorted(cuts, starts)
        return ids, np.concatenate([[0], ends])[first]


def encoder(spec: str, widths: np.ndarray | None = None) -> PieceEncoder:
    """This worker's encoder for a tokenizer."""
    key = ("encoder", hashlib.sha1(spec.encode()).hexdigest())
    kept = common.process_cache()
    if key not in kept:
        kept[key] = PieceEncoder(spec, widths)
    return kept[key]


class ByteDecoder:
    """Bytes from ids, by the reversed byte table."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.n = np.fromiter(map(len, tokens), np.int64, size)
        self.at = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all the ids, and the offsets that `ends` (offsets into the ids) become."""
        n = self.n[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = self.raw[np.repeat(self.at[ids] - upto[:-1], n) + np.arange(int(upto[-1]))]
        return raw, upto[ends]


def char_offsets(raw: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For byte offsets, the number of characters that begin before them.

    A token inside a character begins after that character's first byte, so
    both parts of a split character report the same end.
    """
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[upto]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, with_offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text).

    With with_ids also ids (array of int); with with_offsets also token_ends
    (each token's end in characters) and decoded (binary). Null texts are empty ones: no ids, and
    the hashes of nothing. Rows are independent: repeated rows and null
    doc_ids come out as often as they came in; further columns are left out.
    The vocabulary file is read on the driver alone and sent to the workers.
    """
    spark: SparkSession = docs.sparkSession
    common.small_batches(spark)
    ranks = read_ranks(ranks_path)
    sent = spark.sparkContext.broadcast((tokenizer_json(ranks, pattern), ranks))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32()))]
    if with_offsets:
        fields += [pa.field("token_ends", pa.list_(pa.int32())), pa.field("decoded", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, ranks = sent.value
        kept = common.process_cache()
        name = ("decoder", hashlib.sha1(spec.encode()).hexdigest())
        dec = kept.get(name) or kept.setdefault(name, ByteDecoder(ranks))
        enc = encoder(spec, dec.n)
        for batch in batches:
            for part in common.slices(batch):
                ids, ends = enc.encode(part.column(1))
                raw, upto = dec.decode(ids, ends)
                wide, flat = ids.astype("<u4").tobytes(), raw.tobytes()
                columns = [
                    part.column(0),
                    pa.array(np.diff(ends)),
                    pa.array([hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.string()),
                ]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if with_offsets:
                    begun = np.concatenate([[0], np.cumsum(dec.n[ids])])
                    chars = char_offsets(raw, begun[1:]) - np.repeat(char_offsets(raw, upto[:-1]), np.diff(ends))
                    columns += [
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(chars.astype(np.int32))),
                        pa.array([flat[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, from_arrow_schema(schema))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
