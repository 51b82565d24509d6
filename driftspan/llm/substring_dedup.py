"""Substring dedup with a compressed FM-index per shard.

A word goes if it lies in a window of WINDOW words that also starts in a document of smaller id.

1. Every window belongs to the least hash among its word grams (its key), so equal windows have
   equal keys wherever they stand. A run of windows with one key is a segment: key, place and a
   hash of its words. Only keys that occur in two documents go on.
2. Equal segments (by 128-bit digests of their words, from random tables) are one class, held
   once, with its smallest document. All windows of its other documents' segments go: what the
   index would answer for each of them is its own class, in a smaller document.
3. Classes are dealt into shards of bounded size by their key. A shard's FM-index (wavelet matrix
   over the Burrows-Wheeler transform) holds its classes' words, compared as they are. Each class
   is streamed against it by backward search, held to occurrences in segments of smaller
   documents: the matching statistics, whose matches of WINDOW words and more are reported.
4. A key whose classes hold more than HOT_WORDS words (a passage that very many documents share,
   each in other surroundings) would overfill a shard. Its segments are cut into single windows
   with the window's own 128-bit digest as key; there equal keys are equal windows, summed up by
   partial aggregates, so such a key is spread over tasks by its windows. A window that a class
   repeats is one row, and so is a run of windows that go.
5. Spans are gathered per document and joined with the texts; documents without a span are
   read without a shuffle while the others are few enough to broadcast their ids.

Defined cases: null text and text without words keep nothing and lose nothing; a document with
a null id neither loses words nor takes them from others; rows that repeat an id are one
document; a very long text is read whole, in one slice of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import SPACE_BYTES, Scratch, as_digests, byte_class, frugal, gram_hashes, range_hashes, read_table, text_slices, word_hashes, word_spans
from driftspan.llm.fm_index import FMIndex

WINDOW = 50
#: Words of the grams whose least hash is a window's key.
GRAM = 20
#: Words that one shard's index holds, about.
SHARD_WORDS = 150_000
#: Words of one key's classes that a shard takes, so a shard is bounded by both.
HOT_WORDS = 150_000
#: Ids that are broadcast at most.
BROADCAST_IDS = 500_000
_WORD = ~byte_class(SPACE_BYTES)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minima of all width consecutive values, by doubling."""
    m, step = h, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - step :]) if width > step else m


def window_segments(words: np.ndarray, rows: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all rows' words: (row, first word's number, windows, key, 128-bit digest) of every run of windows with one key."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, pa.array([], pa.binary()))
    if len(words) < window:
        return nothing
    key = sliding_min(gram_hashes(words, gram).view(np.int64), window - gram + 1)
    at = np.flatnonzero(rows[: len(key)] == rows[window - 1 :])
    if not len(at):
        return nothing
    key, row = key[at], rows[at]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    body = as_digests(*(range_hashes(words, start, n + window - 1, lane) for lane in (0, 1)))
    return row[first], start, n, key[first], body


def segments(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, start, n, key, body) of every segment: first word, windows, key, hash of its words."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc", "start", "n", "key", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch.column(1)):
                starts, ends, rows = word_spans(data, off, _WORD)
                row, start, n, key, body = window_segments(word_hashes(data, starts, ends), rows, window, gram)
                first = np.searchsorted(rows, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array((start - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), body], names)

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(frugal(run), f"doc {kind}, start int, n int, key long, body binary")


def contents(docs: DataFrame, classes: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """classes with their words as text (column words), read from each class's own document."""
    kind = docs.schema[id_col].dataType.simpleString()
    asked = classes.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "key", "body")).alias("asked"))  # of one document
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    ids = classes.select(F.col("doc").alias("wanted")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), F.col("id") == F.col("wanted"), "left_semi")
    names = ["doc", "start", "n", "key", "body", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch.column(1)):
                starts, ends, rows = word_spans(data, off, _WORD)
                first, raw = np.searchsorted(rows, np.arange(hi - lo)), data.tobytes()
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i in range(lo, hi):
                    for x in batch.column(2)[i].as_py():
                        a = first[i - lo] + x["start"]
                        for c, v in zip(out, (i, x["start"], x["n"], x["key"], x["body"], raw[starts[a] : ends[a + x["n"] + window - 2]]), strict=True):
                            c.append(v)
                ids = batch.column(0).take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True))], names)

    return rows.join(asked, F.col("id") == F.col("doc")).select("id", "t", "asked").mapInArrow(frugal(run), f"doc {kind}, start int, n int, key long, body binary, words binary")


def shard_matches(docs: list, words: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each class of a shard the intervals of its windows that occur in a class of a smaller document."""
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in text.split()], np.int64) for text in words]
    order = sorted(range(len(docs)), key=lambda i: docs[i])
    found = FMIndex([coded[i] for i in order], np.array([docs[i] for i in order])).earlier_windows(window)
    out: list[list[tuple[int, int]]] = [[] for _ in docs]
    for place, i in enumerate(order):
        out[i] = found[place]
    return out


_MATCH = "key long, body binary, n int, lo int, hi int"


def indexed_matches(content: DataFrame, n_shards: int, window: int) -> DataFrame:
    """(key, body, n, lo, hi): windows [lo, hi) of a class that occur in a class of a smaller document, by shards."""

    def run(table: pa.Table) -> pa.Table:
        found = shard_matches(table["doc"].to_pylist(), table["words"].to_pylist(), window)
        rows = [(i, a, b) for i, spans in enumerate(found) for a, b in spans]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.table([table["key"].take(at), table["body"].take(at), table["n"].take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["key", "body", "n", "lo", "hi"])

    dealt = content.dropDuplicates(["key", "body", "n"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, _MATCH)


def class_windows(content: DataFrame, window: int) -> DataFrame:
    """(doc, key, body, n, w, places): each different window of a class, by its digest, with the places where it starts."""
    kind = content.schema["doc"].dataType.simpleString()
    names = ["doc", "key", "body", "n", "w", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch.column(4).cast(pa.string())):
                starts, ends, rows = word_spans(data, off, _WORD)
                words = word_hashes(data, starts, ends)
                if len(words) < window:
                    continue
                h = [gram_hashes(words, window, lane) for lane in (0, 1)]
                at = np.flatnonzero(rows[: len(rows) - window + 1] == rows[window - 1 :])
                at = at[np.lexsort((at, h[1][at], h[0][at], rows[at]))]
                row, h = rows[at], [x[at] for x in h]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])
                first = np.flatnonzero(new)
                part = batch.slice(lo, hi - lo).take(pa.array(row[first]))
                places = (at - np.searchsorted(rows, row)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(places))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], as_digests(h[0][first], h[1][first]), lists], names)

    rows = content.select("doc", "key", "body", "n", "words")
    return rows.mapInArrow(frugal(run), f"doc {kind}, key long, body binary, n int, w binary, places array<int>")


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs [lo, hi) of each row's places."""
    for batch in batches:
        places = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((places, row))
        row, places = row[order], places[order]
        # a place may be given twice, by rows that repeat an id
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (places[1:] > places[:-1] + 1)
        last = np.append(new[1:], np.ones(min(len(row), 1), bool))
        out = batch.take(pa.array(row[new]))
        yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(places[new]), pa.array(places[last] + np.int32(1))], ["key", "body", "n", "lo", "hi"])


def hot_matches(scratch: Scratch, content: DataFrame, window: int) -> DataFrame:
    """The same for classes of hot keys, window by window with its own hash as key; one row a run of such windows."""
    windows = class_windows(content, window)
    least = windows.groupBy("w").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w", "least")
    least = scratch.save(least)
    few = least.count() <= BROADCAST_IDS
    hit = windows.join(F.broadcast(least) if few else least, "w").where(F.col("doc") > F.col("least"))
    places = hit.groupBy("key", "body", "n").agg(F.flatten(F.collect_list("places")).alias("places"))  # of one class
    return places.mapInArrow(frugal(_intervals), _MATCH)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): the spans [a, b) of a document's words that go, unsorted and overlapping; a stored table."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    found = scratch.save(segments(docs, window, gram, id_col, text_col))
    shared = found.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key")
    members = scratch.save(found.join(shared, "key", "left_semi"), release=True)
    scratch.drop(found)
    classes = members.groupBy("key", "body", "n").agg(F.min(F.struct("doc", "start")).alias("x")).select("key", "body", "n", "x.doc", "x.start")
    classes = scratch.save(classes)
    # a key with one class has no other class to be searched in
    per_key = scratch.save(classes.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.col("n") + window - 1).alias("words")).where("c > 1"))
    cold = per_key.where(F.col("words") <= HOT_WORDS)
    hot = per_key.where(F.col("words") > HOT_WORDS)
    total = cold.agg(F.sum("words")).first()[0] or 0
    matches = docs.sparkSession.createDataFrame([], _MATCH)
    if total:
        content = contents(docs, classes.join(cold.select("key"), "key", "left_semi"), window, id_col, text_col)
        matches = scratch.save(indexed_matches(content, -(-total // SHARD_WORDS), window), release=True)
    if hot.limit(1).count():
        content = scratch.save(contents(docs, classes.join(hot.select("key"), "key", "left_semi"), window, id_col, text_col))
        matches = matches.unionByName(scratch.save(hot_matches(scratch, content, window)))
        scratch.drop(content)
    least = classes.select("key", "body", "n", F.col("doc").alias("least"))
    placed = members.join(least, ["key", "body", "n"])
    whole = placed.where(F.col("doc") > F.col("least")).select("doc", F.col("start").alias("a"), (F.col("start") + F.col("n") + window - 1).alias("b"))
    parts = placed.where(F.col("doc") == F.col("least")).join(matches, ["key", "body", "n"]).select("doc", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + window - 1).alias("b"))
    spans = scratch.save(whole.unionByName(parts).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), release=True)
    scratch.drop(members, classes, per_key)
    return spans


def cut_text(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Words, words that go, and the kept words joined by single spaces."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, [s["a"] for s in spans], 1)
    np.add.at(gone, [s["b"] for s in spans], -1)
    kept = np.cumsum(gone)[:-1] <= 0
    left = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    return len(words), len(words) - len(left), b" ".join(left)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of every row, and with keep_text the kept words as text."""
    spans = duplicate_spans(docs, window, gram, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            cuts = [cut_text(t.as_py(), s) for t, s in zip(batch.column(1).cast(pa.binary()), given, strict=True)]
            out = [batch.column(0), pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), pa.array([hashlib.sha256(c[2]).hexdigest() for c in cuts])]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array([c[2].decode() for c in cuts])] if keep_text else [])], names)

    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if spans.count() <= BROADCAST_IDS:
        ids = F.broadcast(spans.select("doc"))
        touched = rows.join(ids, F.col("id") == F.col("doc"), "left_semi").join(spans, F.col("id") == F.col("doc")).select("id", "t", "spans")
        untouched = rows.join(ids, F.col("id") == F.col("doc"), "left_anti")
        out = touched.mapInArrow(frugal(run), schema).unionByName(untouched.mapInArrow(frugal(run), schema))
    else:
        out = rows.join(spans, F.col("id") == F.col("doc"), "left").select("id", "t", "spans").mapInArrow(frugal(run), schema)
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents."""
    return substring_dedup(read_table(spark, sf_dir, "documents"), keep_text=False)


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM h JOIN m USING (h) WHERE doc_id > least),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT doc_id, ws, len(coalesce(gone, CAST([] AS BIGINT[]))) AS n_removed, 
         CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(gone, j)), lambda j: ws[j]) END AS kept
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
