"""What the training-data operators share: the shared folder, Arrow words, hashes."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints"
SLICE_BYTES = 2 << 20
#: Rows that Spark hands to a Python worker at once, at most.
BATCH_ROWS = 2000
#: ... and their bytes, about.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see, from spark.checkpoint.dir.

    Only a local master may leave it unset (as tests do); a cluster without
    it is an error, since a machine's own folder is invisible to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs(LOCAL_SHARED, exist_ok=True)
        at = "file://" + LOCAL_SHARED
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    at = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def forget(df: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    at = getattr(df, "_stored_at", None)
    if at:
        remove(df.sparkSession, at)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def put_in_place(fs: pafs.FileSystem, made: str, path: str) -> None:
    """Renames a finished file; a lost executor's task that runs again replaces what it left."""
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(made, path)


class ArrayFiles:
    """Named arrays in the shared folder, a file for each key; a task writes what later tasks of any machine read."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, key: str, **arrays: np.ndarray) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        made = f"{root}/{uuid.uuid4().hex}.unfinished"
        columns = {f"{name}:{x.dtype.str}": pa.array([x.tobytes()], pa.large_binary()) for name, x in arrays.items()}
        batch = pa.record_batch(columns)
        with fs.open_output_stream(made) as sink, pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        put_in_place(fs, made, f"{root}/{key}")

    def read(self, key: str) -> dict[str, np.ndarray]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{root}/{key}") as file:
            batch = pa.ipc.open_file(file).get_batch(0)
        return {name.split(":")[0]: np.frombuffer(column[0].as_buffer(), name.split(":")[1]) for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_cache() -> dict:
    """A dict that lives as long as the (reused) Python worker."""
    return sys.__dict__.setdefault("_codeloom_cache", {})


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch in this session: whole texts are long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Parts of a batch with about `limit` bytes of text, a row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, upto - at)
        at, before = upto, ends[upto - 1]
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


#: Keys of a string's first eight-byte words; longer strings' keys are made when they are met.
WORD_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def string_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array without nulls."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_strings(a: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings: the same in every process and on every machine.

    Each eight bytes are scrambled under a key of their place and the results
    are summed and scrambled again with the length: tabulation with a bijection
    in place of tables, so strings of at most eight bytes and one length never
    collide, and others only by chance, whatever pattern their letters follow
    (a power series modulo 2**64 would confuse Thue-Morse words).
    """
    raw, at = string_bytes(a)
    n = len(at) - 1
    if not n:
        return np.zeros(0, np.uint64)
    lengths = np.diff(at)
    words = (lengths + 7) // 8
    ends = np.cumsum(words)
    out = np.zeros(n, np.uint64)
    if ends[-1]:
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        every = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
        place = np.arange(ends[-1]) - np.repeat(ends - words, words)
        value = every[np.repeat(at[:-1], words) + 8 * place]
        full = words > 0
        last = ends[full] - 1
        spare = (8 * words[full] - lengths[full]).astype(np.uint64) * np.uint64(8)
        value[last] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> spare
        longest = int(words.max())
        keys = WORD_KEYS if longest <= len(WORD_KEYS) else mix64(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(mix64(mix64(value ^ keys[place]) + keys[place]), (ends - words)[full])
    with np.errstate(over="ignore"):
        return mix64(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, A-Z lower-cased, and each text's offsets into them.

    A null text counts as an empty one.
    """
    raw, at = string_bytes(pc.fill_null(texts.cast(pa.large_string()), ""))
    solid = ~SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    upto = np.cumsum(solid)
    ends = np.append(upto[starts] - 1, upto[-1] if len(raw) else 0).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(LOWER[raw[solid]]))
    return words, np.searchsorted(starts, at)


def word_ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number among the distinct ones, and the distinct ones' hashes."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), hash_strings(coded.dictionary)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
