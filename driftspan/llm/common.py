"""Shared pieces of the training-data operators: tables in the shared folder,
ASCII folding as Spark expressions, and vectorised word scanning of Arrow text."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The six ASCII white-space bytes: space and 09 to 0D.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that one vectorised step takes (a longer single text is a step of its own).
SLICE_BYTES = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else, on the JVM.

    For pure ASCII ``lower`` is the same and much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of this run only where none is set (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="driftspan-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage, so a lost executor costs a re-read only.

    ``drop`` removes tables that no later plan reads. Tables behind a returned DataFrame
    stay, like checkpoints, until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, release: bool = False) -> DataFrame:
        """df as a stored table; with release, shuffle files that were needed for it may go."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        self.paths.append(path)
        df.write.parquet(path)
        if release:
            settle(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        for path in set(self.paths) - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, place: str) -> None:
        self.paths.remove(place)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows (id, key) that keep_rows broadcasts at most, two numbers each.
BROADCAST_ROWS = 500_000


def keep_rows(docs: DataFrame, verdicts: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of those that repeat an id and a key.

    verdicts has (id, key long, kept) of each row; key is the same of a row of docs, worked out
    only where the id is asked for. A null id equals a null id. Few rows are broadcast, so no text
    is shuffled, but for rows that are repeated: one partial aggregate keeps one of each.
    """
    scratch = Scratch(docs.sparkSession, "verdicts")
    found = verdicts.groupBy(F.col("id").alias("__id__"), F.col("key").alias("__key__")).agg(F.bool_and("kept").alias("__kept__"), F.count("*").alias("__n__"))
    found = scratch.save(found.where("NOT __kept__ OR __n__ > 1"))

    def asked(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    # not an equality of two sides, so it is no join key and only rows whose id has been found work it out
    same = docs[id_col].eqNullSafe(F.col("__id__")) & (key.bitwiseXOR(F.col("__key__")) == 0)
    out = docs.join(asked(found.select("__id__", "__key__")), same, "left_anti")
    repeated = found.where("__kept__").select("__id__", "__key__")
    if not repeated.isEmpty():
        again = docs.join(asked(repeated), same, "inner").groupBy("__id__", "__key__").agg(F.first(F.struct(*docs.columns)).alias("row"))
        out = out.unionByName(again.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
    return out


def release_memory() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """Let Spark drop what no plan can reach any more: shuffle files, broadcasts; and give the driver's freed memory back."""
    gc.collect()
    release_memory()
    spark.sparkContext._jvm.System.gc()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back at a task's end: Python workers live on from stage to stage."""

    def frugally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return frugally


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) of an Arrow string column with their UTF-8 bytes and hi-lo+1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def word_spans(data: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (maximal runs of word bytes inside a row), and their rows."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    m = word_byte[data]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = m[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] = m[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


#: Bytes of a word that have a table of their own; longer words are digested one by one.
TABLES = 64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, TABLES * 256, dtype=np.uint64, endpoint=False)
#: Odd constants that tell the lanes of a hash apart.
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process, by tabulation.

    Each byte's place in its word has a table of random values, whose sum is hashed; so any two
    different words collide with probability 2**-64, whatever their structure.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    before = np.cumsum(size) - size
    total = int(before[-1] + size[-1])
    place = np.arange(total, dtype=np.int64) - np.repeat(before, size)
    at = place + np.repeat(starts, size)
    letters = data[at] if fold is None else fold[data[at]]
    np.minimum(place, TABLES - 1, out=place)
    place <<= 8
    place |= letters
    out = mix(np.add.reduceat(_TABLE[place], before) + size.astype(np.uint64) * _LANES[0])
    for i in np.flatnonzero(size > TABLES).tolist():
        a, n = int(before[i]), int(size[i])
        out[i] = int.from_bytes(hashlib.blake2b(letters[a : a + n].tobytes(), digest_size=8).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """The hash of two parts; either part alone decides it, so parts that differ seldom meet."""
    return mix(mix(a + _LANES[lane]) + b)


def gram_hashes(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of all k consecutive words, by doubling; len(words) - k + 1 of them. Rows are not told apart."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h, n = words, 1
    while 2 * n <= k:
        h = _joined(h[:-n], h[n:], lane)
        n *= 2
    rest = len(words) - k + 1
    return _joined(h[:rest], h[k - n : k - n + rest], lane) if n < k else mix(h + _LANES[lane])


def range_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of words[start : start + size], each by the two longest powers of two that cover it, and its size."""
    out = np.zeros(len(starts), np.uint64)
    h, n, most = words, 1, int(sizes.max()) if len(sizes) else 0
    while n <= most:
        at = np.flatnonzero((sizes >= n) & (sizes < 2 * n))
        if len(at):
            out[at] = _joined(h[starts[at]], h[starts[at] + sizes[at] - n], lane) + sizes[at].astype(np.uint64)
        if 2 * n <= most:
            h = _joined(h[:-n], h[n:], lane)
        n *= 2
    return mix(out)


def as_digests(*lanes: np.ndarray) -> pa.Array:
    """Binary values made of one 64-bit hash of each lane."""
    raw = np.ascontiguousarray(np.stack(lanes, 1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * len(lanes)), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
