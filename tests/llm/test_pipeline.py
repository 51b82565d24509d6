import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftspan.llm import exact_dedup, toxicity
from tests.llm.fixtures import SCHEMA, corpus, frame, store
from tests.llm.test_dedup import brute_components, fold
from tests.llm.test_text_operators import brute_decontam

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEMS = [(1, "w1 w2 w3"), (2, None), (None, "be be be"), (3, " ".join(f"q{i}" for i in range(30)))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The corpus with toxic documents, repeated ids with other texts, null ids, and documents with benchmark passages."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus(3)
    known = [r for r in rows if r[0] is not None]
    bad = [(1000 + i, f"{known[i][1] or 'some'} awful nasty awful nasty number {i}", "en", "s", 0) for i in range(25)]
    good = [(1100 + i, f"{known[i][1] or 'some'} fine kind text number {i}", "en", "s", 0) for i in range(25)]
    rows += bad + good + [bad[0], good[0], good[0]]
    rows += [(1100, "an id of another text", None, "s", 0), (None, "no id here", None, "s", 0), (None, "no id here", None, "s", 0), (None, None, None, None, None)]
    rows += [(1200, "start " + ITEMS[3][1][10:70], None, "s", 0), (1201, " ".join(f"z{i}" for i in range(3000)) + " " + ITEMS[3][1], None, "s", 0)]
    store(frame(spark, rows, False), path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r in bad)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{path}/labels.parquet")
    return path


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def brute_exact(rows):
    keep = {}
    for r in rows:
        t = fold(r[1])
        if t not in keep or (r[0] is not None and (keep[t][0] is None or r[0] > keep[t][0])):
            keep[t] = r
    return {(r[0], fold(r[1])) for r in keep.values()}


def brute_near(rows):
    """(id, text) pairs that stay, one of each; ids are unique here but for null and one."""
    comps = brute_components({r[0]: r[1] for r in rows if r[0] is not None}, 5)
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(frozenset(shingles(t)), i)
    return {(i, t) for i, t, *_ in rows if not shingles(t) or (comps[i][1] == i if i is not None else frozenset(shingles(t)) not in sets)}


def shingles(t, size=5):
    w = fold(t).split()
    return {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_stages_equal_plain_python(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    net = toxicity.fit_contract(spark, tables)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = as_rows(docs), stage(spark, docs, tables)
        assert out.columns == COLUMNS
        after = as_rows(out)
        if name == "toxicity":
            alone = {t: toxicity.score_texts(net, pa.array([t], pa.string()))[0][0] for t in {r[1] for r in before}}
            assert after == [r for r in before if alone[r[1]] < 0.5]
            assert sum(1000 <= (r[0] or 0) < 1025 for r in after) <= 3 and sum((r[0] or 0) in range(1100, 1125) for r in after) >= 25
        elif name == "exact_dedup":
            assert {(r[0], fold(r[1])) for r in after} == brute_exact(before) and len(after) == len(brute_exact(before))
        elif name == "near_dedup":
            before = [r for r in before if r[0] != 1100 or r[1] == "an id of another text"] + [r for r in before if r[0] == 1100 and r[1] != "an id of another text"]
            unique = [r for r in before if r[1] != "an id of another text"]
            want = brute_near(unique)
            assert {(r[0], r[1]) for r in after if r[1] != "an id of another text"} == want
            assert len(after) == len({(r[0], r[1]) for r in after})
        else:
            judged = [(r, brute_decontam(r[1], ITEMS)) for r in before]
            assert after == [r for r, (n, hit, _) in judged if not (hit and 20 * hit >= n)] and len(after) < len(before)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    rows = as_rows(docs)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sorted(str(p.doc_id) for p in packed if p.piece == 0) == sorted(str(r[0]) for r in rows)
    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted((str(p.doc_id), p.piece, p.length, p.ids_crc32) for p in whole) == sorted((str(p.doc_id), p.piece, p.length, p.ids_crc32) for p in packed)
    lengths = {}
    for p in whole:
        lengths.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in lengths.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)][:-1]]).tolist() and sum(n for _, n in parts) <= 4096
    unique = [r for r in rows if r[0] is not None and r[0] != 1100]
    kept = [p for p in whole if p.doc_id in {r[0] for r in unique}]
    vocabulary = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in unique:
        ids = [*vocabulary.encode(r[1] or "", add_special_tokens=False).ids, 1]
        assert sum(p.length for p in kept if p.doc_id == r[0]) == len(ids)


def test_empty_tables(spark, tmp_path):
    path = store(spark.createDataFrame([], SCHEMA), tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    """More shared keys than are broadcast: all texts are hashed, the result is the same."""
    rows = corpus()
    want = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows), digest_all=True).collect()), key=repr)
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows), digest_all=True).collect()), key=repr) == want
    assert {hashlib.sha256(fold(t)).hexdigest() for _, t, *_ in rows} == {r[4] for r in want}
