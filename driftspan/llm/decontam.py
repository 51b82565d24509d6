"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised questions and answers are cut into aligned chunks of half a window, of which any
window of an item holds one whole. All chunks are patterns of one automaton, which reads each
normalised text once; where a chunk occurs, the text's and the item's words are compared to
either side, and a common run of a window's words or more is hit. Matches are mapped back to
words and to byte offsets of the original. An item shorter than a window is one pattern.

The automaton is made once in each Python worker, from a broadcast block of items of a checked
size. A benchmark beyond one block is matched in as many passes over the texts, each with an
automaton of its own; hits are carried along with the rows, so the result is that of one pass.

Defined cases: a null or empty text has no words and is clean; a very long text is one scan; a
null or wordless item has no window; an item with a null id hits words but is not listed; rows
that repeat an item's id are one item; items that hold the same words are all listed; an empty
benchmark leaves all clean; repeated documents are judged alike; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftspan.llm.common import FOLD, Scratch, frugal, read_table

WINDOW = 13
#: A document is contaminated if SHARE * hit words >= words.
SHARE = 20
#: Bytes of items in one broadcast block. An automaton takes some 50 bytes for each.
BLOCK_BYTES = 8_000_000
#: Maps bytes to normal form one for one: A-Z folded, ASCII that is no letter or digit to a space.
NORMAL = bytes(FOLD[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


Item = tuple[str | None, list[bytes]]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Item]]:
    """Blocks of (item id as a string, words), read item by item, so the driver holds one block."""
    block: list[Item] = []
    size = 0
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    for item, text in items.toLocalIterator():
        words = text.encode().translate(NORMAL).split()
        if words:
            block.append((item, words))
            size += sum(map(len, words)) + len(words)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


class Matcher:
    """An automaton over the chunks of items. Patterns carry a space at either end, so they match whole words only."""

    def __init__(self, items: list[Item], window: int):
        self.items, self.window, self.chunk = items, window, (window + 1) // 2
        places: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            step = self.chunk if len(words) >= window else len(words)
            for start in range(0, len(words) - step + 1, step):
                places.setdefault(b" ".join(words[start : start + step]), []).append((k, start))
        self.automaton = ahocorasick.Automaton()
        for pattern, at in places.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (len(pattern) + 2, tuple(at)))  # bytes stand as Latin-1 characters
        self.automaton.make_automaton()

    def __call__(self, words: list[bytes]) -> list[tuple[int, int, str | None]]:
        """(first word, last word + 1, item) of common runs that hold a window, and of short items."""
        text = f" {b' '.join(words).decode('latin-1')} "
        found = [(end + 1 - n, at) for end, (n, at) in self.automaton.iter(text)]
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
        out, compared = [], {}
        for first, (_, at) in zip(np.searchsorted(spaces, [f[0] for f in found]).tolist(), found, strict=True):
            for k, start in at:
                item, own = self.items[k]
                if len(own) < self.window:
                    out.append((first, first + len(own), item))
                elif first >= compared.get((k, first - start), 0):
                    a, b = first, first + self.chunk
                    while a > 0 and a - first + start > 0 and words[a - 1] == own[a - first + start - 1]:
                        a -= 1
                    while b < len(words) and b - first + start < len(own) and words[b] == own[b - first + start]:
                        b += 1
                    compared[k, first - start] = b
                    if b - a >= self.window:
                        out.append((a, b, item))
        return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(block: Broadcast, key: str, window: int) -> Matcher:
    found = _MATCHERS.get(key)
    if found is None:
        _MATCHERS.clear()  # one at a time: a worker runs one pass
        found = _MATCHERS[key] = Matcher(block.value, window)
    return found


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the original text that the runs of hit words cover; normalising keeps byte places."""
    word = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


#: Words hit so far and items found, between passes.
_CARRIED = "__hits__ array<struct<a:long,b:long>>, __items__ array<string>"


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, place: int, finish: Callable, schema: StructType) -> DataFrame:
    """finish(batch of docs, words, hits, items) of all rows; hits and items are of those rows (by number) that hold a window. The text is column `place`."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark)] or [None]
    scratch, width = Scratch(spark, "decontamination"), len(docs.columns)
    between = StructType([*docs.schema.fields, *StructType.fromDDL(_CARRIED).fields])

    def scan(k: int) -> Callable:
        block, last = blocks[k], k + 1 == len(blocks)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = _matcher(block, f"{run}-{k}", window) if block else None
            for batch in batches:
                counts, spans, items = [], {}, {}
                if k:
                    spans = {i: [(x["a"], x["b"]) for x in s] for i, s in enumerate(batch.column(width).to_pylist()) if s}
                    items = {i: set(s) for i, s in enumerate(batch.column(width + 1).to_pylist()) if s}
                for i, t in enumerate(batch.column(place).cast(pa.binary()).to_pylist()):
                    words = (t or b"").translate(NORMAL).split()
                    counts.append(len(words))
                    for a, b, item in match(words) if match and words else ():
                        spans.setdefault(i, []).append((a, b))
                        if item is not None:
                            items.setdefault(i, set()).add(item)
                if last:
                    hits = {i: covered(s, counts[i]) for i, s in spans.items()}
                    yield finish(pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width]), counts, hits, items)
                else:
                    n = range(batch.num_rows)
                    hit = pa.array([[{"a": a, "b": b} for a, b in spans.get(i, ())] for i in n], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                    found = pa.array([sorted(items.get(i, ())) for i in n], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], hit, found], [*batch.schema.names[:width], "__hits__", "__items__"])

        return step

    for k in range(len(blocks) - 1):
        docs = scratch.save(docs.mapInArrow(frugal(scan(k)), between))
    return docs.mapInArrow(frugal(scan(len(blocks) - 1)), schema)


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    out = np.zeros(n, bool)
    for a, b in spans:
        out[a:b] = True
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, items, spans, contaminated) of every row; spans are byte spans of the original text."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "n_hit", "items", "spans"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batch: pa.RecordBatch, counts: list[int], hits: dict[int, np.ndarray], items: dict[int, set[str]]) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        n_hit = [int(hits[i].sum()) if i in hits else 0 for i in range(len(counts))]
        spans = [[{"start": a, "end": b} for a, b in original_spans(texts[i].as_py(), hits[i])] if i in hits else [] for i in range(len(counts))]
        found = [sorted(items.get(i, ())) for i in range(len(counts))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, span)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = StructType.fromDDL(f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    out = _scanned(rows, benchmark, window, 1, finish, schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated. Nothing is shuffled."""

    def finish(batch: pa.RecordBatch, counts: list[int], hits: dict[int, np.ndarray], items: dict[int, set[str]]) -> pa.RecordBatch:
        keep = [not (i in hits and SHARE * int(hits[i].sum()) >= n) for i, n in enumerate(counts)]
        return batch.filter(pa.array(keep, pa.bool_()))

    return _scanned(docs, benchmark, window, docs.columns.index(text_col), finish, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents and benchmark."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
