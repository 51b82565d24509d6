"""Best-fit packing with lower-bound certificates.

Texts are tokenised once; only texts over the capacity are cut. Pieces shorter than the
capacity are dealt into partitions of about TASK_PIECES, each packed by best-fit decreasing.
Lower bounds from dual feasible functions say how many bins a partition needs at least: a
partition at its bound is certified and only its least filled bin is worth reopening; one
above its bound has gaps and reopens the emptier half of its bins. The pieces of reopened bins of
all partitions are exchanged (dealt anew into fewer partitions) and packed again, until one
partition holds the rest. Each piece tells its partition's bins and bound, the certificate.

Defined cases: null or empty text is the one piece that holds the end id alone; a very long text
is cut into pieces; of texts with one length any may be packed first; an empty table gives an
empty result; repeated rows are packed each for itself and are dealt like all others; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import Scratch, frugal, read_table

CAPACITY = 4096
END_ID = 1
#: Pieces that one packing task takes, about.
TASK_PIECES = 50_000
#: Bits of a sequence's number that hold its bin; those above hold the partition. A partition never has so many pieces.
BIN_BITS = 32
#: Texts whose new words are looked up together, and runs of letters that are encoded in one call.
TEXTS, TOGETHER = 64, 1024
#: Distinct words whose ids a process remembers.
REMEMBERED = 800_000
REMEMBERED_BYTES = 64
#: ASCII that is no letter, digit or white space: at a word's end it is a pre-token of its own.
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


class WordIds:
    """Ids of a tokenizer that drops white space, word by word, remembered as little-endian bytes.

    Pre-tokens of such a tokenizer never cross white space, so a text's ids are those of its
    words one after the other; a word of letters and closing marks is letters, then marks. Runs
    of letters that are new are encoded together, with spaces between: each is one pre-token, so
    it ends at the one token that carries the vocabulary's end-of-word suffix.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        model = json.loads(spec)["model"]
        suffix = model["end_of_word_suffix"]
        self.ends = np.zeros(max(model["vocab"].values()) + 2, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _encode(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_letters(self, runs: list[bytes]) -> None:
        for lo in range(0, len(runs), TOGETHER):
            part = runs[lo : lo + TOGETHER]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = ((np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * 4).tolist()
            if len(ends) != len(part):  # letters that this library sees otherwise
                self.words.update((r, self._encode(r.decode())) for r in part)
                continue
            raw, begin = ids.tobytes(), 0
            for run, end in zip(part, ends, strict=True):
                self.words[run] = raw[begin:end]
                begin = end

    def _learn(self, words: set[bytes]) -> None:
        known, marks, parts, new = self.words, self.marks, [], set()
        for w in words:
            letters = w.rstrip(MARKS)
            if letters.isalpha() and len(w) <= REMEMBERED_BYTES:  # ASCII letters
                low = letters.lower()
            elif letters and len(w) <= REMEMBERED_BYTES and (s := letters.decode()).isalpha() and s.lower().isalpha():
                low = letters  # (the lower case of some letters ends in a mark, which is no letter)
            else:
                known[w] = self._encode(w.decode())
                continue
            if low not in known:
                new.add(low)
            if low != w:
                rest = w[len(letters) :]
                if rest not in marks:
                    marks[rest] = self._encode(rest.decode()) if rest else b""
                parts.append((w, low, rest))
        self._encode_letters(list(new))
        for w, low, rest in parts:
            known[w] = known[low] + marks[rest]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts."""
        known = self.words
        split = [t.split() for t in texts]
        found = [list(map(known.get, words)) for words in split]
        unknown = {w for words, ids in zip(split, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        if unknown:
            if len(known) + 2 * len(unknown) > REMEMBERED:
                known.clear()
                self.marks.clear()
                found = [[None] * len(words) for words in split]
                unknown = set().union(*split)
            self._learn(unknown)
        out = [b"".join([known[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids) for words, ids in zip(split, found, strict=True)]
        for w in unknown:
            if len(w) > REMEMBERED_BYTES:
                del known[w]
        return out


_WORD_IDS: dict[int, WordIds] = {}


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of ids given as unsigned 32-bit little-endian bytes."""
    step = 4 * capacity
    return [(k, k * capacity, len(b) // 4, zlib.crc32(b)) for k, b in enumerate(ids[i : i + step] for i in range(0, max(len(ids), 1), step))]


def read_vocabulary(spark: SparkSession, vocabulary: str) -> Broadcast:
    """A tokenizer file on the driver, for the executors."""
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary, not by the data


def tokenised_pieces(docs: DataFrame, spec: Broadcast, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; spec is the tokenizer file's text."""
    key, end = zlib.crc32(spec.value.encode()), np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _WORD_IDS.get(key)
        if encode is None:
            encode = _WORD_IDS[key] = WordIds(spec.value)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            texts = batch.column(1).cast(pa.binary())
            for lo in range(0, len(texts), TEXTS):
                for i, ids in enumerate(encode(texts[lo : lo + TEXTS].to_pylist()), lo):
                    for values in cut(ids + end, capacity):
                        rows.append(i)
                        for c, v in zip(cols, values, strict=True):
                            c.append(v)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(frugal(pieces), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that the lengths need at least: the best of two families of dual feasible functions.

    f_e drops lengths below e and rounds those over capacity - e up to the capacity; u_k rounds
    (k+1) x down to a whole number of capacities unless it is one. Both keep every feasible bin
    within the capacity, so the sum over the capacity is a bound. Worked out on the histogram.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    below = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(sizes * counts)])
    for e in sizes[sizes <= capacity // 2]:
        big = np.searchsorted(sizes, capacity - e, side="right")
        small = np.searchsorted(sizes, e, side="left")
        total = capacity * int(below[-1] - below[big]) + int(weight[big] - weight[small])
        best = max(best, -(-total // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        total = int((np.where(exact, sizes * k, (scaled // capacity) * capacity) * counts).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and each bin's free room. Rooms in use are the bits of one integer."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = used >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1  # the smallest room that takes it
            b = by_room[r].pop()
            if not by_room[r]:
                used &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r = r - n
        by_room[r].append(b)
        used |= 1 << r
    return bins, offsets, room


def pack_partition(table: pa.Table, capacity: int, last: bool) -> pa.Table:
    """Packs one partition; reopened bins have sequence -1, unless this is the last round."""
    lengths = table["length"].to_numpy()
    bins, offsets, room = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    free = np.array(room)
    opened = np.zeros(len(room), bool)
    if not last:
        emptiest = np.argsort(-free, kind="stable")
        opened[emptiest[: min(1, len(room) // 2) if len(room) == bound else len(room) // 2]] = True  # some bins always stay, so rounds end
        opened &= free > 0
    new = {"bin": np.where(opened[bins], -1, bins), "offset": np.where(opened[bins], 0, offsets), "partition_bins": np.full(len(lengths), len(room)), "partition_bound": np.full(len(lengths), bound)}
    for name, values in new.items():
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table


def packer(capacity: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return pack_partition(table, capacity, last)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces (any columns, length among them) with sequence_id, offset, and bins and lower bound of the sequence's partition.

    pieces must be a stored table: it is read once a round. A length over the capacity is an error.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    names = pieces.columns
    certificate = ["partition_bins", "partition_bound"]
    one = F.lit(1).cast("long")
    full = pieces.where(F.col("length") >= capacity)
    pool = pieces.where(F.col("length") < capacity)
    done: list[DataFrame] = []
    base, n = 0, pool.count()
    while n:
        tasks = -(-n // task_pieces)
        last = tasks == 1
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema if f.name in names)
        # a row's place in its stored file deals it, so repeated rows part, and a lost task deals its rows as before
        dealt = pool.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(base)), F.lit(tasks)).cast("int").alias("task"))
        packed = scratch.save(dealt.groupBy("task").applyInArrow(packer(capacity, last), f"{schema}, task int, bin long, offset long, partition_bins long, partition_bound long"))
        number = F.shiftleft(F.lit(base).cast("long") + F.col("task"), BIN_BITS) + F.col("bin")
        done.append(packed.where("bin >= 0").select(*names, number.alias("sequence_id"), "offset", *certificate))
        base += tasks
        pool = packed.where("bin < 0").select(*names)
        n = pool.count()
    ids = F.shiftleft(F.lit(base).cast("long"), BIN_BITS) + F.monotonically_increasing_id()
    out = full.select(*names, ids.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(one.alias(c) for c in certificate))
    for part in done:
        out = out.unionByName(part)
    return out


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bins, partition_bound) of every piece of every row."""
    scratch = Scratch(docs.sparkSession, "pieces")
    spec = read_vocabulary(docs.sparkSession, vocabulary)
    pieces = scratch.save(tokenised_pieces(docs, spec, capacity, id_col, text_col))
    spec.destroy()
    return pack(pieces, capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents, with word_bpe_49k.json."""
    import public_tokenizers

    return best_fit_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
