"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters the network as its hashed word embedding beside the scaled sum of its hashed byte
n-grams' embeddings (up to six bytes); the first dimension of each starts as the evidence of the training labels
for the word or n-gram (its log odds in standard errors, less a threshold). Two gated recurrent layers read a window of words in either direction,
attention pools their states, and a logistic unit scores the window. Windows overlap by half at
least, the last one ends with the text, and all are scored; a logistic function of their highest, mean and three highest logits, fitted on
all windows of the sampled training rows, is the text's score.

Training is plain numpy on the driver, on a bounded sample of labelled rows (``sample_rows`` a
class, all windows of each; fewer whole rows if these would be more than ``train_windows``). A
window of a toxic text need not be toxic itself, so all windows of toxic texts compete: at first
those with at least half of the text's highest evidence count as toxic, after two fifths of the
passes those that the network scores highest. The model's size is fixed; it is broadcast.

Scoring is vectorised over bytes for the input and over windows for the recurrence.

Defined cases: a null or empty text, or one of white space alone, is scored as no window: the
lowest score, 0; a text shorter than a window is one window; without labelled rows of both
classes every score is the share of toxic labels (0 without any); repeated label rows count
as their largest value; a label row with a null id belongs to no document; a very long text is
scored whole, by all its windows; repeated documents get the same score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import FOLD, Scratch, byte_class, frugal, read_table, settle, text_slices, word_hashes, word_spans

#: Words of a window, and words from one window's start to the next; the last window ends with the text.
WINDOW, STRIDE = 48, 24
#: Labelled rows of a class that training takes, about, with all their windows; fewer rows if these would be more windows.
SAMPLE_ROWS = 2000
TRAIN_WINDOWS = 30_000
WORD_BITS, CHAR_BITS = 16, 16
#: Bytes of an n-gram; it ends where the word begins.
GRAM = 6
SPREAD = np.float32(3)
EMBED, HIDDEN, ATTEND = 8, 12, 8
#: Training texts whose features are made together.
ROWS_TOGETHER = 256
#: Training words whose evidence is summed together.
WORDS_TOGETHER = 100_000
#: Standard errors of a label's evidence for a word that are ignored.
EVIDENCE = 2.2
#: Learning rates: of embeddings as a share of the rest's.
RATE, EMBED_RATE = 0.01, 0.1
#: Passes over the sample and steps, at least.
EPOCHS, STEPS = 4, 250
SEED = 7
#: ASCII letters and digits and all bytes of non-ASCII characters.
WORD_BYTE = byte_class(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum()))
_FOLD = np.frombuffer(FOLD, np.uint8)
_CLIP = np.float32(30)


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, byte n-gram buckets of all bytes, word starts and ends, and words' rows."""
    starts, ends, rows = word_spans(data, off, WORD_BYTE)
    folded = _FOLD[data]
    words = (word_hashes(data, starts, ends, _FOLD) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    inside = np.where(WORD_BYTE[data], folded, 0).astype(np.uint32)
    h, step = np.zeros(len(data), np.uint32), inside
    edge = off[(off > 0) & (off < len(data))]
    alive = inside > 0
    for j in range(GRAM):  # the byte and those before it, up to the word's start
        h = np.where(alive, (h ^ step) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77), h)
        step = np.concatenate([[0], step[:-1]]).astype(np.uint32)
        alive = np.concatenate([[False], alive[:-1]]) & alive & (step > 0)
        alive[edge] = False  # an n-gram does not reach into another row
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return words, (h >> np.uint32(32 - CHAR_BITS)).astype(np.int32), starts, ends, rows


class Network:
    """Parameters, forward and backward passes. Windows are [count, WINDOW] word numbers, -1 where there is none."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        n = lambda *s, scale=0.1: r.normal(0, scale, s).astype(np.float32)
        self.p = {"word": n(1 << WORD_BITS, EMBED), "char": n(1 << CHAR_BITS, EMBED), "wa": n(2 * HIDDEN, ATTEND, scale=0.3), "ba": np.zeros(ATTEND, np.float32), "va": n(ATTEND, scale=0.3), "wo": n(2 * HIDDEN, scale=0.3), "bo": np.full(1, -2, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": n(2 * EMBED, 3 * HIDDEN, scale=0.3), f"u{d}": n(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        self.constant: float | None = None

    def inputs(self, words: np.ndarray, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[word, 2 * EMBED]: the word's embedding, and the sum of its byte n-grams', scaled."""
        x = np.empty((len(words), 2 * EMBED), np.float32)
        x[:, :EMBED] = self.p["word"][words]
        cuts = np.stack([starts, ends], 1).ravel()
        if len(cuts) and cuts[-1] == len(grams):
            cuts = cuts[:-1]
        for j in range(EMBED):
            column = np.ascontiguousarray(self.p["char"][:, j])
            x[:, EMBED + j] = np.add.reduceat(column[grams], cuts)[::2]
        x[:, EMBED:] /= SPREAD
        return x

    def inputs_of(self, w: _Windows, own: np.ndarray) -> np.ndarray:
        """The same for chosen words of training windows; remembers what the embeddings' gradients need."""
        size = (w.ends - w.starts)[own]
        flat = np.repeat(w.starts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        x = np.empty((len(own), 2 * EMBED), np.float32)
        x[:, :EMBED] = self.p["word"][w.words[own]]
        cuts = np.concatenate([[0], np.cumsum(size)[:-1]])
        x[:, EMBED:] = np.add.reduceat(self.p["char"][w.grams[flat]], cuts, axis=0) / SPREAD
        self.last = (w.words[own], w.grams[flat], np.repeat(np.arange(len(own)), size), size)
        return x

    def _direction(self, gates: np.ndarray, at: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States [step, window, HIDDEN]; gates are each word's input to the gates, with zeros as the last row."""
        u = self.p[f"u{d}"]
        n, steps = at.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        saved: list = [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, there = gates[at[:, t]], (at[:, t] >= 0)[:, None]
            zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            new = np.where(there, h + z * (c - h), h)
            if keep:
                saved[t] = (h, z, r, c, there)
            h = out[t] = new
        return out, saved

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows at (word numbers into x)."""
        out, cache = {}, {}
        for d in "fb":
            gates = np.vstack([x @ self.p[f"w{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            out[d], cache[d] = self._direction(gates, at, d, keep)
        h = np.concatenate([out["f"], out["b"]], axis=2)
        a = np.tanh(h @ self.p["wa"] + self.p["ba"])
        e = np.where(at.T >= 0, a @ self.p["va"], -_CLIP)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, h)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return logit, {"dirs": cache, "h": h, "a": a, "alpha": alpha, "pooled": pooled} if keep else {}

    def backward(self, x: np.ndarray, at: np.ndarray, cache: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters other than embeddings, and of x."""
        p, h, a, alpha, pooled = self.p, cache["h"], cache["a"], cache["alpha"], cache["pooled"]
        grad = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_alpha = np.einsum("tnh,nh->tn", h, d_pooled)
        d_h = alpha[:, :, None] * d_pooled[None]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["va"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        flat = d_a.reshape(-1, ATTEND)
        grad |= {"wa": h.reshape(-1, 2 * HIDDEN).T @ flat, "ba": flat.sum(axis=0)}
        d_h += d_a @ p["wa"].T
        d_x = np.zeros_like(x)
        steps = at.shape[1]
        for k, d in enumerate("fb"):
            u, own = p[f"u{d}"], d_h[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_gates = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            d_u, back = np.zeros_like(u), np.zeros((at.shape[0], HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h0, z, r, c, there = cache["dirs"][d][t]
                g = back + own[t]
                live = np.where(there, g, 0)
                d_c = live * z * (1 - c * c)
                d_z = live * (c - h0) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h0 * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_u[:, : 2 * HIDDEN] += h0.T @ d_zr
                d_u[:, 2 * HIDDEN :] += (r * h0).T @ d_c
                back = np.where(there, g * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T, g)
                d_gates[at[:, t]] += np.concatenate([d_zr, d_c], axis=1)  # each window has words of its own, so no row comes twice (row -1 is thrown away)
            d_gates = d_gates[:-1]
            grad |= {f"u{d}": d_u, f"w{d}": x.T @ d_gates, f"c{d}": d_gates.sum(axis=0)}
            d_x += d_gates @ p[f"w{d}"].T
        return grad, d_x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -_CLIP, _CLIP)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, grad: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, (rows, g) in grad.items():
            m, v = self.m.setdefault(k, np.zeros_like(p[k])), self.v.setdefault(k, np.zeros_like(p[k]))
            m[rows] += 0.1 * (g - m[rows])
            v[rows] += 0.001 * (g * g - v[rows])
            p[k][rows] -= scale * (EMBED_RATE if k in ("word", "char") else 1) * m[rows] / (np.sqrt(v[rows]) + 1e-8)


class _Windows:
    """Features of window texts, made once for training."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray, row: np.ndarray):
        """Features are made, and the labels' evidence is counted, a few hundred texts at a time; row ascends."""
        words, grams, starts, ends, count = [], [], [], [], np.zeros(len(texts), np.int64)
        tally = {bits: np.zeros((2, 1 << bits)) for bits in (WORD_BITS, CHAR_BITS)}
        cut = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(texts)]  # of whole texts' windows
        cut = [*cut[:-1:ROWS_TOGETHER], cut[-1]]
        base = 0
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])])
            w, g, s, e, of = word_features(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), off)
            count[lo:hi] = np.bincount(of, minlength=hi - lo)
            size = e - s
            inside = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
            text = row[lo + of]
            for bits, at, bucket in ((WORD_BITS, text, w), (CHAR_BITS, np.repeat(text, size), g[inside])):
                pairs = np.unique(at.astype(np.int64) << bits | bucket)
                for label in (0, 1):
                    mine = pairs[(toxic[pairs >> bits] > 0) == label] & ((1 << bits) - 1)
                    tally[bits][label] += np.bincount(mine, minlength=1 << bits)
            words.append(w.astype(np.uint16))
            grams.append(g.astype(np.uint16))
            starts.append((s + base).astype(np.int32))
            ends.append((e + base).astype(np.int32))
            base += int(off[-1])
        self.words, self.grams, self.starts, self.ends = map(np.concatenate, (words, grams, starts, ends))
        self.tally = tally
        self.first = np.cumsum(count) - count
        self.count = np.minimum(count, WINDOW)

    def take(self, net: Network, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the windows' own words, word numbers per step, and the words' numbers here."""
        n = self.count[which]
        own = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = np.full((len(which), WINDOW), -1)
        step = np.arange(WINDOW)[None] < n[:, None]
        at[step] = np.arange(n.sum())
        return net.inputs_of(self, own), at, own


def _embedding_gradients(net: Network, d_x: np.ndarray) -> dict:
    words, grams, of, size = net.last
    out = {}
    for name, at, g in (("word", words, d_x[:, :EMBED]), ("char", grams, (d_x[:, EMBED:] / SPREAD)[of])):
        rows, place = np.unique(at, return_inverse=True)
        out[name] = (rows, np.stack([np.bincount(place, weights=g[:, j], minlength=len(rows)) for j in range(EMBED)], 1).astype(np.float32))
    return out


def evidence(tally: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each bucket, how many standard errors beyond EVIDENCE its log odds of toxic texts lie from even, scaled; tally counts clean and toxic texts."""
    no, yes = tally + 0.5
    z = (np.log(yes / ((toxic > 0).sum() + 1)) - np.log(no / ((toxic <= 0).sum() + 1))) / np.sqrt(1 / yes + 1 / no)
    z[(yes < 1) & (no < 1)] = 0
    return (np.sign(z) * np.maximum(np.abs(z) - EVIDENCE, 0) / 2).astype(np.float32).clip(-3, 3)


def train(texts: list[bytes], row: np.ndarray, toxic: np.ndarray, seed: int = SEED, batch: int = 256) -> Network:
    """texts: windows, a list that is emptied; row: the text each is of; toxic: each text's label. A small sample is passed over more often."""
    net = Network(seed)
    if not len(texts) or toxic.min() == toxic.max():
        net.constant = float(toxic.mean()) if len(toxic) else 0.0
        return net
    row = np.asarray(row)
    w = _Windows(texts, toxic, row)
    texts.clear()  # the features are all that is needed
    usable = np.flatnonzero(w.count > 0)
    r, adam = np.random.default_rng(seed), _Adam(RATE)
    net.p["word"][:, 0] = evidence(w.tally[WORD_BITS], toxic)
    net.p["char"][:, 0] = evidence(w.tally[CHAR_BITS], toxic)
    y = toxic[row].astype(np.float32)
    found = _window_evidence(net, w)
    weight = ((y == 0) | (found >= _highest(found, row, len(toxic))[row] / 2)).astype(np.float32)
    epochs = max(EPOCHS, -(-STEPS * batch // max(1, len(usable))))
    for epoch in range(epochs):
        if epoch >= 0.4 * epochs:
            logit = _score_windows(net, w, usable)
            weight = ((y == 0) | (logit >= _highest(logit, row, len(toxic))[row]) | (logit > 0)).astype(np.float32)
        live = r.permutation(usable[weight[usable] > 0])
        balance = max(1.0, float((y[live] == 0).sum() / max(1, (y[live] == 1).sum()))) ** 0.5
        for i in range(0, len(live), batch):
            which = live[i : i + batch]
            x, at, _ = w.take(net, which)
            logit, cache = net.forward(x, at, keep=True)
            d = (_sigmoid(logit) - y[which]) * np.where(y[which] > 0, balance, 1) / len(which)
            grad, d_x = net.backward(x, at, cache, d.astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            adam.step(net.p, {k: (slice(None), g * np.float32(clip)) for k, g in grad.items()} | _embedding_gradients(net, d_x * np.float32(clip)))
        adam.rate *= 0.25 ** (1 / epochs)
    return net


def _window_evidence(net: Network, w: _Windows) -> np.ndarray:
    """Sum over each window's words of their evidence and their n-grams', where it speaks for toxic texts."""
    own = np.empty(len(w.words))
    for lo in range(0, len(own), WORDS_TOGETHER):
        starts, ends = w.starts[lo : lo + WORDS_TOGETHER], w.ends[lo : lo + WORDS_TOGETHER]
        grams = np.append(net.p["char"][:, 0][w.grams[starts[0] : ends[-1]]], np.float32(0))
        cuts = np.stack([starts, ends], 1).ravel() - starts[0]
        own[lo : lo + len(starts)] = np.maximum(net.p["word"][w.words[lo : lo + len(starts)], 0] + np.add.reduceat(grams, cuts)[::2] / SPREAD, 0)
    total = np.concatenate([[0], np.cumsum(own)])
    return total[w.first + w.count] - total[w.first]


def _highest(score: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The highest score of each of n texts' windows."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, row, score)
    return top


def _score_windows(net: Network, w: _Windows, which: np.ndarray) -> np.ndarray:
    out = np.full(len(w.count), -np.inf, np.float32)
    for i in range(0, len(which), 4096):
        x, at, _ = w.take(net, which[i : i + 4096])
        out[which[i : i + 4096]] = net.forward(x, at)[0]
    return out


def text_features(of: np.ndarray, logit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n texts have windows; of each its highest, mean and mean of the three highest logits, and a one; of is each window's text."""
    order = np.lexsort((-logit, of))
    of, logit = of[order], np.clip(logit[order], -20, 20).astype(np.float64)
    count = np.bincount(of, minlength=n)
    seen = count > 0
    first = np.cumsum(count) - count
    place = np.arange(len(of)) - first[of]
    total = lambda at: np.bincount(of[at], weights=logit[at], minlength=n)
    some = np.maximum(count, 1)
    top = total(place < 1)
    return seen, np.stack([top, total(place >= 0) / some, total(place < 3) / np.minimum(some, 3), np.log(some), np.ones(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton's method, of weighted rows."""
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ c)
        v = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (weight * (p - y)) + ridge * c)
        c = c - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return c


def texts_features(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of windows and text_features of each text; all windows are scored."""
    n = len(texts)
    windows, out = np.zeros(n, np.int64), np.zeros((n, len(net.calibration)))
    for lo, hi, data, off in text_slices(texts):
        words, grams, starts, ends, rows = word_features(data, off)
        if not len(words):
            continue
        count = np.bincount(rows, minlength=hi - lo)
        first = np.cumsum(count) - count
        n_windows = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        of = np.repeat(np.arange(hi - lo), n_windows)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        begin = first[of] + np.minimum(k * STRIDE, np.maximum(0, count[of] - WINDOW))
        end = (first + count)[of]
        x = net.inputs(words, grams, starts, ends)
        logits = np.empty(len(of), np.float32)
        for i in range(0, len(of), 2048):
            at = begin[i : i + 2048, None] + np.arange(WINDOW)
            part = slice(int(begin[i]), int(min(at[-1, -1] + 1, len(words))))
            at = np.where(at < end[i : i + 2048, None], at - part.start, -1)
            logits[i : i + 2048] = net.forward(x[part], at)[0]
        out[lo:hi] = text_features(of, logits, hi - lo)[1]
        windows[lo:hi] = n_windows
    return windows, out


def score_texts(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of each text."""
    if net.constant is not None:
        return np.full(len(texts), net.constant), np.zeros(len(texts), np.int64)
    windows, features = texts_features(net, texts)
    return np.where(windows > 0, _sigmoid(features @ net.calibration), 0.0), windows


def remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % mod


def _sampled_windows(batches: Iterator[pa.RecordBatch], chosen: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    """All windows of the rows, or of the chosen ones."""
    for batch in batches:
        if chosen is not None:
            batch = batch.filter(pa.array([x in chosen for x in batch.column(2).to_pylist()], pa.bool_()))
        rows, texts = [], []
        for lo, hi, data, off in text_slices(batch.column(1)):
            starts, ends, of = word_spans(data, off, WORD_BYTE)
            bounds = np.searchsorted(of, np.arange(hi - lo + 1))
            raw = data.tobytes()
            for i in range(hi - lo):
                a, b = int(bounds[i]), int(bounds[i + 1])
                if a == b:
                    continue
                begins = np.minimum(np.arange(a, max(a + 1, b - WINDOW + STRIDE), STRIDE), max(a, b - WINDOW))
                for s in begins.tolist():
                    rows.append(lo + i)
                    texts.append(raw[starts[s] : ends[min(b, s + WINDOW) - 1]])
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), pa.array(texts, pa.binary())], ["row", "toxic", "text"])


def _counted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, off in text_slices(batch.column(1)):
            words = np.bincount(word_spans(data, off, WORD_BYTE)[2], minlength=hi - lo)
            count[lo:hi] = np.where(words > 0, 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE)), 0)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(count)], ["row", "toxic", "windows"])


def _fitting_rows(row: np.ndarray, toxic: np.ndarray, windows: np.ndarray, most: int) -> set[int]:
    """Whole rows of about so many windows, the same share of either class's windows; one row of each at least."""
    share, out = min(1.0, most / max(1, windows.sum())), set()
    for of in (toxic > 0, toxic <= 0):
        order = np.flatnonzero(of & (windows > 0))
        order = order[np.argsort(row[order], kind="stable")]
        total = np.cumsum(windows[order])
        kept = max(1, int(np.searchsorted(total, share * total[-1], side="right"))) if len(order) else 0
        out |= set(row[order[:kept]].tolist())
    return out


def fit(docs: DataFrame, labels: DataFrame, trained: Column, sample_rows: int = SAMPLE_ROWS, train_windows: int = TRAIN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network trained on labelled rows where trained (a condition on id_col) holds."""
    known = labels.where(trained & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {int(r[0] > 0): r[1] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("label_id").cast("string")), F.lit(1 << 30))
    share = F.when(F.col("toxic") > 0, F.lit(min(1.0, sample_rows / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, 2 * sample_rows / max(1, counts.get(0, 0)))))
    drawn = known.where(draw < share * (1 << 30))  # about 3 * sample_rows rows, whatever the input's size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), F.col("id") == F.col("label_id"))
    sample = rows.select("toxic", "t", F.xxhash64(F.col("id").cast("string")).alias("row"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(sample)  # a bounded number of rows
    sizes = sample.mapInArrow(frugal(_counted_windows), "row long, toxic int, windows long").toArrow()
    chosen = _fitting_rows(*(sizes[c].to_numpy() for c in ("row", "toxic", "windows")), train_windows)
    windows = sample.mapInArrow(frugal(lambda b: _sampled_windows(b, chosen)), "row long, toxic int, text binary").toArrow()
    windows = windows.sort_by([("row", "ascending"), ("text", "ascending")])  # the same model, however the rows were split
    ids, row = np.unique(windows["row"].to_numpy(), return_inverse=True)
    toxic = np.zeros(len(ids), np.int64)
    toxic[row] = windows["toxic"].to_numpy() > 0
    texts = windows["text"].to_pylist()
    del windows
    settle(docs.sparkSession)
    net = train(texts, row, toxic)
    texts.clear()
    settle(docs.sparkSession)
    if net.constant is None:
        net.calibration = calibrate(net, sample, counts)
    scratch.drop(sample)
    return net


def calibrate(net: Network, sample: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """Coefficients of the text's score, from all windows of the sampled texts; counts are all labelled rows of a class, for its weight."""
    net.last = None
    shared = sample.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, features = texts_features(shared.value, batch.column(1))
            flat = pa.array(features.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, features.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(windows), lists], ["row", "toxic", "windows", "x"])

    found = sample.mapInArrow(frugal(run), "row long, toxic int, windows long, x array<double>").where("windows > 0").toArrow().sort_by("row")  # a row a sampled text
    x = np.array(found["x"].to_pylist()).reshape(found.num_rows, -1)
    shared.destroy()
    y = (found["toxic"].to_numpy() > 0).astype(np.float64)
    drawn = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    return _logistic(x, y, np.array([counts.get(0, 0), counts.get(1, 0)])[y.astype(int)] / drawn[y.astype(int)])


def toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, n_windows) of every row."""
    net.last = None
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, windows = score_texts(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(windows)], ["id", "score", "predicted", "n_windows"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(frugal(run), f"id {kind}, score double, predicted int, n_windows long").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are scored under 0.5. Nothing is shuffled."""
    net.last = None
    shared, place = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, batch.column(place))[0] < 0.5))

    return docs.mapInArrow(frugal(run), docs.schema)


def fit_contract(spark: SparkSession, sf_dir: str) -> Network:
    """The network learnt from the labelled rows of documents that are not held out."""
    return fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents."""
    scored = toxicity(read_table(spark, sf_dir, "documents"), fit_contract(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
