import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspan.llm import near_dedup
from driftspan.llm.common import FOLD, Scratch, gram_hashes, range_hashes
from driftspan.llm.exact_dedup import exact_dedup
from driftspan.llm.near_dedup import components
from driftspan.llm.substring_dedup import shard_matches, substring_dedup
from tests.llm.fixtures import SCHEMA, corpus, frame, words


def fold(text):
    return (text or "").encode().translate(FOLD)


def test_exact(spark):
    rows = corpus()
    got = exact_dedup(frame(spark, rows), digest_all=True).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(fold(t), []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), largest[fold(t)], len(groups[fold(t)]), i == largest[fold(t)], hashlib.sha256(fold(t)).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.digest) for r in got) == want
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_components(texts: dict, size: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = fold(t).split()
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    comp = {i: i for i in texts}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("size", [4, 5])
def test_near(spark, size):
    rows = corpus()
    got = {r.doc_id: r for r in near_dedup.near_dedup(frame(spark, rows), size).collect()}
    want = brute_components({r[0]: r[1] for r in rows if r[0] is not None}, size)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[None].component_id == min(i for i, t, *_ in rows if i is not None and want[i] == want[next(j for j, u, *_ in rows if u == rows[-1][1] and j is not None)])


def test_near_large_groups(spark, monkeypatch):
    """Values that many classes share: hubs and the comparison of the rest must find what all pairs would."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 3)
    r = random.Random(5)
    rows, n = [], 0
    for family in range(3):
        base = words(r, 150, 5000)
        for _ in range(25):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = f"x{r.randrange(40)}"
            rows.append((n, " ".join(t[: r.randrange(120, 151)]), None, None, 0))
            n += 1
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_dedup(frame(spark, rows, False), 4).collect()}
    assert got == brute_components({r[0]: r[1] for r in rows}, 4)


@pytest.mark.parametrize("size", [4, 5])
def test_near_short_texts_with_a_frequent_beginning(spark, size):
    """Two sets of 5 and 4 shingles, 3 of them frequent: they share one rare value only."""
    start = [f"c{i}" for i in range(size + 2)]
    r = random.Random(8)
    texts = [start + words(r, 20, 100_000) for _ in range(70)] + [[*start, "x", "y"], [*start, "x"]]
    rows = [(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_dedup(frame(spark, rows, False), size).collect()}
    assert got == brute_components({r[0]: r[1] for r in rows}, size)
    assert got[71] == (4, 70)


def test_near_pairs_of_short_texts_along_a_frequent_beginning(spark):
    """Sets of 5 and 4 shingles at a similarity of exactly 0.8, whose beginning all share."""
    start = "one two three four five six"
    texts = [t for i in range(100) for t in (f"{start} x{i}", f"{start} x{i} y{i}")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], False), 4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(dict(enumerate(texts)), 4).items()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(100))


@pytest.mark.parametrize(("seed", "turns"), [(1, 3), (2, 1), (3, 1)])
def test_near_tiny_sets_with_many_sharers(spark, monkeypatch, seed, turns):
    """Texts of 1 to 15 words with few different ones: every list has many members."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    monkeypatch.setattr(near_dedup, "HUB_TURNS", turns)
    r = random.Random(seed)
    base = [words(r, 15, 40) for _ in range(4)]
    texts = []
    for _ in range(260):
        t = list(r.choice(base))[: r.randint(1, 15)]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            t[r.randrange(len(t))] = f"w{r.randrange(40)}"
        texts.append(t)
    rows = [(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)]
    for size in (2, 4):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_dedup(frame(spark, rows, False), size).collect()}
        assert got == brute_components({x[0]: x[1] for x in rows}, size)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_fool_polynomial_hashes(spark):
    """A Thue-Morse word and its complement, and sequences of two words in that order, are told apart."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    sequence = [["left" if c == "a" else "right" for c in t] for t in (one, other)]
    texts = [" ".join([one] * 60), " ".join([other] * 60), " ".join([one]), other, *(" ".join(s[:64]) for s in sequence)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_dedup.near_dedup(frame(spark, rows, False), 4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(dict(enumerate(texts)), 4)
    cut = substring_dedup(frame(spark, rows, False)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in cut) == brute_substring(rows, 50)


def test_range_hashes_equal_gram_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64)
    starts, sizes = np.arange(0, 200), np.arange(1, 201)
    for lane in (0, 1):
        got = range_hashes(h, starts, sizes, lane)
        assert len(set(got.tolist())) == 200
        shifted = np.concatenate([h[:7], h])
        assert (range_hashes(shifted, starts + 7, sizes, lane) == got).all()
    assert (gram_hashes(h, 50)[3:10] == gram_hashes(h[3:59], 50)).all()
    assert len(gram_hashes(h, 400)) == 1 and not len(gram_hashes(h, 401))


def test_near_empty(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("together", [400_000, 30, 3])
def test_components(spark, monkeypatch, together):
    monkeypatch.setattr(near_dedup, "LINKS_TOGETHER", together)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    r.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.comp for x in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def brute_substring(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = (t or "").encode().split(), set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone |= set(range(p, p + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("hot", [150_000, 1])
def test_substring(spark, monkeypatch, hot):
    from driftspan.llm import substring_dedup as module

    monkeypatch.setattr(module, "HOT_WORDS", hot)
    rows = corpus()
    got = substring_dedup(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == brute_substring(rows, 50)


def test_substring_empty(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_index_equals_brute_force(seed):
    r = random.Random(seed)
    base = [r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(60)]
    docs, texts = [], []
    for _ in range(r.randint(1, 12)):
        s = r.randint(0, 20)
        t = base[s : s + r.randint(5, 40)]
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice("abcxyz")
        docs.append(r.randint(0, 6))
        texts.append(t)
    w = 5
    got = shard_matches(docs, [" ".join(t).encode() for t in texts], w)
    for i, t in enumerate(texts):
        want = {p for p in range(len(t) - w + 1) if any(docs[j] < docs[i] and any(u[q : q + w] == t[p : p + w] for q in range(len(u) - w + 1)) for j, u in enumerate(texts))}
        assert {p for a, b in got[i] for p in range(a, b)} == want


def test_estimate_is_near_the_truth(spark):
    r = np.random.default_rng(3)
    a = np.unique(r.integers(-(1 << 62), 1 << 62, 900))
    b = np.unique(np.concatenate([a[:820], r.integers(-(1 << 62), 1 << 62, 80)]))
    df = spark.createDataFrame([(a[:64].tolist(), b[:64].tolist())], "a array<long>, b array<long>")
    assert df.select(near_dedup.estimate_passes(F.col("a"), F.col("b"))).first()[0]


def test_hot_matches_are_runs(spark, monkeypatch):
    """Texts of a repeated word pair: their windows are two, and what goes is a run a text, not a row a window."""
    from driftspan.llm import substring_dedup as module

    monkeypatch.setattr(module, "HOT_WORDS", 1)
    taken, made = module.hot_matches, []

    def hot_matches(*given):
        made.append(taken(*given).collect())
        return taken(*given)

    monkeypatch.setattr(module, "hot_matches", hot_matches)
    r = random.Random(3)
    rows = [(i, " ".join([f"a{i}", *["so", "be"] * (60 + 20 * i), *words(r, 60), f"z{i}"]), "en", "s", 0) for i in range(12)]
    rows += [rows[3], (40, " ".join(["so", "be"] * 40), "en", "s", 0)]
    got = module.substring_dedup(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256, x.kept) for x in got) == brute_substring(rows, 50)
    places = [(x["key"], bytes(x["body"]), p) for x in made[0] for p in range(x["lo"], x["hi"])]
    assert len(places) == len(set(places)) > 1000 > 20 * len(made[0])
