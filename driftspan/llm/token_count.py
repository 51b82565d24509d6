"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as one symbol a byte. The adjacent pair of lowest rank is popped
again and again; the count is the symbols less the merges, and no token id is emitted.
Counts of pre-tokens, and of the pieces between single spaces, are remembered in bounded
per-process tables.

Defined cases: null text is empty and has 0 tokens; special strings inside a text count as
one token each, as the library does by default; very long pre-tokens cost n log n; pairs of one
rank are merged from left to right; repeated rows are counted alike; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import read_table

#: Entries that a per-process table of counts holds before it starts anew.
REMEMBERED = 600_000
#: Longer pieces are counted without being remembered.
REMEMBERED_CHARS = 64
# Unicode White_Space, and the byte-level pre-token pattern of the vocabulary's library.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict:
    """Merge ranks of a byte-level BPE tokenizer file, as plain data fit for a broadcast (bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {
        "bytes": [vocab[s] for s in byte_symbols()],
        "pairs": {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])},
        "special": sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True),
    }


def count_merges(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """How many merges byte-pair encoding applies to the symbols (the list is used up).

    The heap holds rank * 2**32 + position, so equal ranks go from left to right. A popped
    entry counts only if the pair now at its position still has that rank.
    """
    n = len(symbols)
    get = pairs.get
    heap = []
    a = symbols[0] if n else 0
    for i in range(1, n):
        b = symbols[i]
        found = get(a << 32 | b)
        if found:
            heap.append(found[0] << 32 | i - 1)
        a = b
    if not heap:
        return 0
    if len(heap) > 1:
        heapq.heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    pop, push = heapq.heappop, heapq.heappush
    merged = 0
    while heap:
        entry = pop(heap)
        i = entry & 0xFFFFFFFF
        j = right[i]
        if j >= n or symbols[i] < 0:
            continue
        found = get(symbols[i] << 32 | symbols[j])
        if not found or found[0] != entry >> 32:
            continue  # one side was merged meanwhile
        merged += 1
        symbols[i], symbols[j] = new, _ = found[1], -1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            found = get(new << 32 | symbols[k])
            if found:
                push(heap, found[0] << 32 | i)
        h = left[i]
        if h >= 0:
            found = get(symbols[h] << 32 | new)
            if found:
                push(heap, found[0] << 32 | h)
    return merged


class _Counts(dict):
    """Counts by string, made when first asked for; starts anew when full."""

    def __init__(self, make: Callable[[str], int]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        n = self.make(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = n
        return n


class TokenCounter:
    def __init__(self, ranks: dict):
        self.bytes, self.pairs = ranks["bytes"], ranks["pairs"]
        self.special = regex.compile("|".join(map(regex.escape, ranks["special"]))) if ranks["special"] else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.tokens = _Counts(self._pre_token)
        self.pieces = _Counts(lambda s: sum(map(self.tokens.__getitem__, self.pattern.findall(s))))
        self.spaced = _Counts(lambda s: sum(map(self.tokens.__getitem__, self.pattern.findall(" " + s))))
        self.uneven = regex.compile(rf" (?=[{WHITE}]|\Z)")
        self.before = regex.compile(rf"(?= [^{WHITE}])")

    def _pre_token(self, s: str) -> int:
        symbols = [self.bytes[b] for b in s.encode()]
        n = len(symbols)
        return n - count_merges(symbols, self.pairs) if n > 1 else n

    def _plain(self, text: str) -> int:
        """A pre-token never crosses the place before a space that a non-space follows, so text is cut there."""
        if not text:
            return 0
        if self.uneven.search(text):
            return sum(map(self.pieces.__getitem__, self.before.split(text)))
        head, *rest = text.split(" ")
        return (self.pieces[head] if head else 0) + sum(map(self.spaced.__getitem__, rest))

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_COUNTERS: dict[int, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row; vocabulary is the path of a byte-level BPE tokenizer file on the driver."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # bounded by the vocabulary, not by the data
    key = hash(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key)
        if counter is None:
            counter = _COUNTERS[key] = TokenCounter(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            n_tokens = [counter(t) if (t := x.as_py()) else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents, with byte_bpe_50k.json."""
    import public_tokenizers

    counts = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
