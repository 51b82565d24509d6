"""Language identification: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's script (from its first letter) narrows the languages it may be in to those that use
the script in the training rows. Its score in each of them is the mean log probability of its
byte n-grams, weighted by its length. Viterbi over the words of a text, in which a change of
language costs a fixed penalty, labels spans of mixed-language text. The prediction is the
language whose spans hold most bytes, the score its share of them.

n-gram counts are summed on the executors over a bounded sample of labelled rows
(``sample_rows`` in all, equally many of each language and all rows of smaller ones, chosen by
a hash of the id); the model is n-gram buckets x languages, whatever
the input's size. All scoring is vectorised over bytes and, in Viterbi, over texts.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; a word whose
script is unseen in training may be in any language; of languages that hold equally many bytes
the alphabetically first is taken, as it is of equally good ones of a word; a very long text is
labelled whole; without any labelled row all is ``und``; repeated rows get the same prediction;
an empty table gives an empty result; other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import FOLD, frugal, read_table, text_slices, word_spans

#: Labelled rows that the model is fitted on, about.
SAMPLE_ROWS = 20_000
BITS = 16
ORDERS = (1, 2, 3, 4)
#: Cost of a change of language between two words, in nats.
SWITCH = 6.0
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Bytes of word scores that Viterbi takes together, about; a longer single text is taken alone.
SCORE_BYTES = 1 << 26
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_FOLD = np.frombuffer(FOLD, np.uint8)


# First and last code points of the scripts' blocks. Letters outside them are of one more script.
BLOCKS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(BLOCKS) + 1
#: Code points from which on no letter is looked for.
LAST_LETTER = 0x32400


@cache
def scripts() -> np.ndarray:
    """Script number by code point: -1 for what is neither a letter nor a mark that goes with one."""
    out = np.full(0x110000, -1, np.int8)
    points = np.array([c for c in range(LAST_LETTER) if unicodedata.category(chr(c))[0] in "LM"])
    out[points] = N_SCRIPTS - 1
    for number, blocks in enumerate(BLOCKS.values()):
        for lo, hi in blocks:
            inside = points[(points >= lo) & (points <= hi)]
            out[inside] = number
    return out


def letters_only(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with Latin capitals folded and all that is no part of a letter as 0; and the script of the letter that begins at each byte, else -1."""
    table, n = scripts(), len(data)
    script = np.full(n, -1, np.int8)
    plain = data < 0x80
    script[plain] = table[:0x80][data[plain]]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):  # code points of the longer characters
        lead = data[at].astype(np.int32)
        follow = [data[np.minimum(at + j, n - 1)].astype(np.int32) & 0x3F for j in (1, 2, 3)]
        two = (lead & 0x1F) << 6 | follow[0]
        three = (lead & 0x0F) << 12 | follow[0] << 6 | follow[1]
        four = (lead & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]
        script[at] = table[np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    out = _FOLD[data]
    accented = np.zeros(n, bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[accented] += 0x20
    # continuation bytes go with their lead byte
    first = np.maximum.accumulate(np.where(plain | (data >= 0xC0), np.arange(n), 0))
    out[script[first] < 0] = 0
    return out, script


def gram_buckets(letters: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each byte; bytes that are 0 mark word ends."""
    out = []
    padded = np.concatenate([np.zeros(max(ORDERS), np.uint8), letters]).astype(np.uint32)
    for k in ORDERS:
        h = np.full(len(letters), k * 0x632BE5AB & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            lo = max(ORDERS) - j
            h = (h ^ padded[lo : lo + len(letters)]) * _MULT[j]
            h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def separated(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with zero bytes after each, so many that no n-gram reaches from one into the next."""
    n, gap = len(off) - 1, max(ORDERS) - 1
    out = np.zeros(len(data) + n * gap, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * gap, np.diff(off))] = data
    return out, off + np.arange(n + 1) * gap


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters, words' starts, ends and rows, and the script of each word's first letter."""
    letters, script = letters_only(data)
    is_word = np.ones(256, bool)
    is_word[0] = False
    starts, ends, rows = word_spans(letters, off, is_word)
    return letters, starts, ends, rows, script[starts].astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, feature): n-gram buckets, and scripts after them."""
    size = 1 << BITS
    total = np.zeros((len(langs), size + N_SCRIPTS), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    for batch in batches:
        of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
        for lo, hi, data, off in text_slices(batch.column(1)):
            data, off = separated(data, off)
            letters, starts, ends, rows, script = _words(data, off)
            if not len(starts):
                continue
            inside = letters > 0
            row_of = np.repeat(np.arange(hi - lo), np.diff(off))
            lang = of[lo:hi][row_of[inside]]
            for g in gram_buckets(letters):
                total[:, :size] += np.bincount(lang * size + g[inside], minlength=total.shape[0] * size).reshape(total.shape[0], size)
            total[:, size:] += np.bincount(of[lo:hi][rows] * N_SCRIPTS + script, minlength=total.shape[0] * N_SCRIPTS).reshape(total.shape[0], N_SCRIPTS)
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["lang", "feature", "n"])


def sample_shares(by_lang: dict[str, int], sample_rows: int) -> dict[str, float]:
    """The share of each language's rows that is drawn: all rows of small languages, equally many of the others."""
    out, left = {}, sample_rows
    for k, (lang, n) in enumerate(sorted(by_lang.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(1.0, max(1.0, left / (len(by_lang) - k)) / n)
        left -= out[lang] * n
    return out


def fit(docs: DataFrame, trained: Column, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [bucket, language], scripts [script, language] in use), from labelled rows where trained holds."""
    labelled = docs.where(trained & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    by_lang = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("l")).count().collect()}  # languages: few
    langs = sorted(by_lang)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool)
    below = F.create_map(*[F.lit(x) for lang, share in sample_shares(by_lang, sample_rows).items() for x in (lang, int(share * (1 << 30)))])
    sample = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < below[F.col(lang_col)]).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    counted = sample.mapInArrow(frugal(lambda batches: _count(batches, langs)), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(langs), (1 << BITS) + N_SCRIPTS))
    found = counted.toPandas()  # bounded: languages x features
    counts[found["lang"], found["feature"]] = found["n"]
    grams, scripts = counts[:, : 1 << BITS], counts[:, 1 << BITS :]
    total = grams.sum(axis=1, keepdims=True)
    logp = np.log((grams + SMOOTHING) / (total + SMOOTHING * (1 << BITS)))
    in_use = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return langs, np.ascontiguousarray(logp.T, np.float32), in_use.T


def word_scores(data: np.ndarray, off: np.ndarray, logp: np.ndarray, in_use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores [word, language], byte lengths and rows of the words."""
    data, off = separated(data, off)
    letters, starts, ends, rows, script = _words(data, off)
    if not len(starts):
        return np.zeros((0, logp.shape[1]), np.float32), starts, rows
    size = ends - starts
    cuts = np.stack([starts, ends], 1).ravel()
    if cuts[-1] == len(data):
        cuts = cuts[:-1]
    score = np.zeros((len(starts), logp.shape[1]), np.float32)
    buckets = gram_buckets(letters)
    for lang in range(logp.shape[1]):
        column = np.ascontiguousarray(logp[:, lang])
        per_byte = column[buckets[0]]
        for g in buckets[1:]:
            per_byte = per_byte + column[g]
        score[:, lang] = np.add.reduceat(per_byte, cuts)[::2]
    score /= len(ORDERS)
    allowed = in_use[script]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return np.where(allowed, score, score.min(axis=1, keepdims=True) - 10 * SWITCH).astype(np.float32), size, rows


def viterbi(score: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; counts are the words of each text, one after the other in score.

    All texts take their t-th step together, the longest first, so a step is a few vector operations.
    """
    n_lang = score.shape[1]
    best = np.zeros(len(score), np.int32)
    if not len(score):
        return best
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    length, first = counts[order], starts[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
    stay = np.zeros((len(score), n_lang), bool)
    came = np.zeros(len(score), np.int32)
    v = np.zeros((len(counts), n_lang), np.float32)
    v[: active[0]] = score[first[: active[0]]]
    for t in range(1, steps):
        m = active[t]
        now = v[:m]  # the texts that have ended keep their last values
        at = first[:m] + t
        top = now.argmax(axis=1)
        best_now = now[np.arange(m), top][:, None]
        came[at] = top
        stay[at] = now >= best_now - np.float32(switch)
        np.maximum(now, best_now - np.float32(switch), out=now)
        now -= best_now
        now += score[at]
    now = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        best[at] = now[:m]
        if t:
            held = stay[at, now[:m]]
            now[:m] = np.where(held, now[:m], came[at])
    return best


def label(texts: pa.Array, langs: list[str], logp: np.ndarray, in_use: np.ndarray) -> tuple[list[str], list[float], list[list[tuple[str, int]]]]:
    """Prediction, score and spans (language, words) of each text."""
    n = len(texts)
    names, shares, spans = [UNDETERMINED] * n, [0.0] * n, [[] for _ in range(n)]
    if not langs:
        return names, shares, spans
    held_together: list[tuple] = []
    for lo, hi, data, off in text_slices(texts):
        score, size, rows = word_scores(data, off, logp, in_use)
        held_together.append((lo, hi, score, size, rows))
        if hi == n or sum(h[2].nbytes for h in held_together) >= SCORE_BYTES:
            _label_words(held_together, langs, texts, names, shares, spans)
            held_together = []
    return names, shares, spans


def _label_words(parts: list[tuple], langs: list[str], texts: pa.Array, names: list[str], shares: list[float], spans: list) -> None:
    """Fills in the predictions, shares and spans of the texts of some consecutive slices (lo, hi, score, size, rows)."""
    base, n = parts[0][0], parts[-1][1] - parts[0][0]
    score, size = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    row_of = np.concatenate([p[4] + (p[0] - base) for p in parts])
    if not len(row_of):
        return
    counts = np.bincount(row_of, minlength=n)
    best = viterbi(score, counts)
    held = np.bincount(row_of * len(langs) + best, weights=size, minlength=n * len(langs)).reshape(n, len(langs))
    top = held.argmax(axis=1)
    share = held[np.arange(n), top] / np.maximum(held.sum(axis=1), 1)
    for i in np.flatnonzero(counts).tolist():
        if _any_letter(texts[base + i].as_py()):  # not marks alone
            names[base + i], shares[base + i] = langs[top[i]], float(share[i])
    change = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row_of[1:] != row_of[:-1])]))
    for a, b in zip(change.tolist(), [*change[1:].tolist(), len(best)], strict=True):
        i = base + int(row_of[a])
        if names[i] != UNDETERMINED or shares[i] > 0:
            spans[i].append((langs[best[a]], b - a))


def _any_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, spans) of every row; spans are (language, words) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the input's size
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares, spans = label(batch.column(1), *shared.value)
            spans = [[{"lang": a, "words": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(frugal(run), f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,words:long>>").withColumnRenamed("id", id_col)


def remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % mod


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
