import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftspan.llm import chat, decontam, langid, license_scan, packing, token_count, toxicity
from driftspan.llm.common import text_slices
from tests.llm.fixtures import SCHEMA, corpus, frame, store, words

ALPHABET = [*"ab's  \n\t\r\x0b\x1c\x1f\x85\xa0  　éÉÉ日本😀1２_-'llre've.!İΣσ", "<|endoftext|>", "<|startoftext|>", "  ", " \n", "'s"]


def strange(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = token_count.TokenCounter(token_count.load_ranks(path))
    for t in strange(3000) + ["a" * 5000, " " * 300, "be " * 900]:
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    rows = corpus()
    got = token_count.token_counts(frame(spark, rows), path).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_count.token_counts(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_merges_pop_the_lowest_rank():
    pairs = {1 << 32 | 1: (5, 9), 9 << 32 | 1: (1, 8)}
    assert token_count.count_merges([1, 1, 1, 1], pairs) == 2
    assert token_count.count_merges([], pairs) == 0


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ids = Tokenizer.from_file(path), packing.WordIds(open(path, encoding="utf-8").read())
    texts = strange(3000, 2)
    for t, got in zip(texts, ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(got, rows, library, capacity):
    want = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((str(i), k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("task_pieces", [50_000, 8])
def test_packing(spark, task_pieces, monkeypatch):
    monkeypatch.setattr(packing, "TASK_PIECES", task_pieces)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus()
    scratch = packing.Scratch(spark, "test")
    pieces = scratch.save(packing.tokenised_pieces(frame(spark, rows), packing.read_vocabulary(spark, path), 512))
    got = packing.pack(pieces, 512, task_pieces).collect()
    n = check_packing(got, rows, Tokenizer.from_file(path), 512)
    assert n <= packing.lower_bound(np.array([r.length for r in got]), 512) + (1 if task_pieces > 8 else 3)
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), path).count() == 0


@pytest.mark.parametrize("task_pieces", [8, 50, 50_000])
@pytest.mark.parametrize("repeated", [False, True])
def test_packing_where_no_two_pieces_fit(spark, task_pieces, repeated):
    """More bins in a task than task_pieces: no sequence is over its capacity, and repeated rows part."""
    rows = [(2**60 + (7 if repeated else i), 0, 0, 300 if repeated else 300 + i % 3, 5) for i in range(180)]
    pieces = packing.Scratch(spark, "test").save(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3))
    got = packing.pack(pieces, 512, task_pieces).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 180 and all(r.offset == 0 for r in got)
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    assert all(1 <= r.partition_bound <= r.partition_bins for r in got)
    if task_pieces == 8:
        assert max(r.partition_bins for r in got) < 40  # not all in one task


@pytest.mark.parametrize("seed", range(20))
def test_lower_bound_never_exceeds_the_packing(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 200) if seed % 2 else r.choice([34, 35, 51, 67], 200)
    bins, offsets, room = packing.best_fit_decreasing(lengths, 100)
    assert packing.lower_bound(lengths, 100) <= len(room)
    assert (np.bincount(bins, lengths) + np.array(room) == 100).all() and (offsets + lengths <= 100).all()


def brute_decontam(text, items, window=13):
    w = (text or "").encode().translate(decontam.NORMAL).split()
    hit, found = set(), set()
    for item, t in items:
        own = (t or "").encode().translate(decontam.NORMAL).split()
        for win in [own[k : k + window] for k in range(max(1, len(own) - window + 1))] if own else []:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    r = random.Random(9)
    items = [(3, " ".join(words(r, 20))), (12, "Short, ITEM here!"), (5, None), (6, "?!"), (7, "été 日本"), (12, "Short, ITEM here!"), (None, "an item without an id"), (None, None)]
    items += [(20, items[0][1]), (21, "be " * 30), (12, "w1 w2 " * 12), (22, " ".join(words(r, 60, 3)))]
    rows = corpus() + [(903, "here is an item without an id", None, None, 0), (904, "be " * 12 + "is " + "be " * 13 + "x " + "be " * 40, None, None, 0), (905, " ".join(words(r, 400, 3)), None, None, 0), (906, items[-1][1][20:] + " " + items[-1][1][:80], None, None, 0), (907, "w2 w1 " * 40, None, None, 0), (900, "x short item; here y " + items[0][1].upper().replace(" ", "--"), None, None, 0), (901, items[0][1][5:], None, None, 0), (902, "ünï été日本 été 日本", None, None, 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame(spark, rows), benchmark).collect()
    for x in got:
        text = next(t for i, t, *_ in rows if i == x.doc_id)
        n, hit, found = brute_decontam(text, items)
        assert (x.n_words, x.n_hit, x.items, x.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n), x
        covered = b" ".join((text or "").encode()[s.start : s.end] for s in x.spans).translate(decontam.NORMAL).split()
        assert len(covered) == hit
    kept = sorted(str(x.doc_id) for x in decontam.drop_contaminated(frame(spark, rows), benchmark).collect())
    assert kept == sorted(str(x.doc_id) for x in got if not x.contaminated)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(x.contaminated for x in decontam.contamination(frame(spark, rows), empty).collect())
    assert decontam.contamination(spark.createDataFrame([], SCHEMA), benchmark).count() == 0


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digest(turns):
    trained = [t for r, t in turns if r == "assistant"]
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, trained)), hashlib.sha256("".join(trained).encode()).hexdigest()


def test_chat_round_trip(spark):
    hard = ["", r"\### Assistant: </turn> ok", "\\", "\\\\#", "### user: x </turn>\n", "a\nb\r\n", "日本😀", " <", "x" * 100_000]
    rows = [(c, k, r, t) for c in range(3) for k, (r, t) in enumerate(zip(["user", "assistant", "a:b#", "", "assistant", "system", "assistant", "tool", "assistant"], hard[c:] + hard[:c], strict=True))]
    rows += [(7, 0, None, None), (7, 0, None, None), (None, 1, "assistant", "x"), (8, None, "user", "first"), (8, 0, "assistant", "second")]
    got = {x.conv_id: x for x in chat.chat_digests(chat.format_chats(chat.conversation_events(chats(spark, rows)))).collect()}
    for c in (0, 1, 2, None):
        x, want = got[c], digest([(r, t) for i, _, r, t in rows if i == c])
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == want
    assert got[7].n_turns == 2 and got[8].turns_sha256 == digest([("user", "first"), ("assistant", "second")])[1]
    assert chat.format_chats(chat.conversation_events(chats(spark, []))).count() == 0


def test_chat_ignores_other_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "Hello " * 50_000)]
    plain, more = chats(spark, rows), chats(spark, rows)
    for c in ("seq", "kind", "target", "formatted", "loss_start", "loss_end", "id", "a"):
        more = more.withColumn(c, F.lit("x"))
    digests = [sorted(map(tuple, chat.chat_digests(chat.format_chats(chat.conversation_events(d))).collect())) for d in (plain, more)]
    assert digests[0] == digests[1] and digests[0][0][1] == 2


def test_chat_events(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"),
        (1, 1, "delta", 1, "assistant", "Hel"),
        (1, 2, "delta", 1, None, "lo"),
        (1, 3, "edit", 0, None, "hey"),
        (1, 4, "message", 2, "user", "more"),
        (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", 1, "assistant", "Good"),
        (1, 7, "delta", 1, None, " day"),
        (1, 8, "edit", 1, None, "Fine"),
        (1, 9, "delta", 1, None, "!"),
    ]
    turns = chat.format_chats(spark.createDataFrame(log, chat.EVENT)).orderBy("turn").collect()
    assert [t.formatted for t in turns] == ["### user: hey </turn>\n", "### assistant: Fine! </turn>\n"]
    whole = "".join(t.formatted for t in turns)
    assert whole[turns[1].loss_start : turns[1].loss_end] == "Fine!" and turns[0].loss_start is None


def test_licences(spark):
    names = ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "MIT-text", "ISC"]
    rows = [(i, f"some prose here\n{license_scan.TEMPLATES[n]}\nmore prose" if i < 4 else license_scan.TEMPLATES[n], None, None, 0) for i, n in enumerate(names)]
    rows += [(50, "Text.\n\n" + license_scan.TEMPLATES["Unlicense"].replace(" ", "\n") + "\n\nEnd", None, None, 0), (51, "licensed to drive", None, None, 0), *((1000 + k, r[1], *r[2:]) for k, r in enumerate(corpus()[:8]))]
    got = {x.doc_id: x for x in license_scan.license_scan(frame(spark, rows)).collect()}
    assert [got[i].license for i in range(6)] == names and got[50].license == "Unlicense" and got[50].dice == 1.0
    assert got[51].license is None and all(got[r[0]].n_matches == 0 for r in rows[8:])
    assert license_scan.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licences_in_nulls_long_texts_ties_and_repeated_rows(spark):
    mit = license_scan.TEMPLATES["MIT"]
    long = "\n".join(" ".join(words(random.Random(k), 12)) for k in range(3000))
    rows = [(1, None, None, None, 0), (2, f"{long}\n{mit}\n{long}", None, None, 0), (3, mit, None, None, 0), (3, mit, None, None, 0), (4, f"{mit}\n{mit}", None, None, 0)]
    got = sorted((x.doc_id, x.license, x.n_matches) for x in license_scan.license_scan(frame(spark, rows)).collect() if x.doc_id != 1)
    assert [g[:2] for g in got] == [(2, "MIT"), (3, "MIT"), (3, "MIT"), (4, "MIT")] and got[1] == got[2]
    tied = license_scan.license_scan(frame(spark, [(1, "x\nsome alpha beta gamma words\ny", None, None, 0), (2, None, None, None, 0)]), {"B": "some alpha beta gamma words", "A": "some alpha beta gamma words"}).collect()
    assert {x.doc_id: (x.license, x.licenses) for x in tied} == {1: ("A", "A,B"), 2: (None, "")}


def test_licences_that_are_no_block(spark):
    text = license_scan.TEMPLATES
    prose = "\n".join(" ".join(words(random.Random(k), 12)) for k in range(30))
    wrapped = text["GPL-3.0-notice"].split()
    wrapped = "\n".join(" ".join(wrapped[i : i + 9]) for i in range(0, len(wrapped), 9))
    mit = text["MIT-text"].replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS", 1)
    assert mit.count("\n\n") == 2
    rows = [
        (0, f"{prose}\n\n{mit}\n\n{prose}", "MIT-text"),
        (1, f"{prose}\n{wrapped}\n{prose}", "GPL-3.0-notice"),
        (2, f"This library of mine, which took long to write, is good. {text['MIT']} It has no tests at all, but many friends.", "MIT"),
        (3, f"{prose} while all of it is {text['CC-BY-NC-SA-4.0']} {prose}", "CC-BY-NC-SA-4.0"),
        (4, f"{prose} the river {' '.join(text['MIT-text'].split()[::-1])} {prose}", None),
    ]
    got = {x.doc_id: x for x in license_scan.license_scan(frame(spark, [(i, t, None, None, 0) for i, t, _ in rows])).collect()}
    assert [got[i].license for i, *_ in rows] == [x for *_, x in rows]
    assert [got[i].dice for i in range(4)] == [1.0] * 4 and got[3].licenses == "CC-BY-NC-SA-4.0" and got[3].n_matches == 1


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
BSD_3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_whole_licences(spark):
    prose = "\n".join(" ".join(words(random.Random(k), 12)) for k in range(30))
    bsd_2 = BSD_3[: BSD_3.index("3. Neither")] + BSD_3[BSD_3.index("THIS SOFTWARE") :]
    whole = [("Zlib-text", ZLIB), ("BSD-3-Clause-text", BSD_3), ("BSD-2-Clause-text", bsd_2)]
    rows = [(i, around.format(t), None, None, 0) for i, (around, (_, t)) in enumerate((a, w) for a in ("{}", prose + "\n\n{}\n" + prose) for w in whole)]
    got = {x.doc_id: x for x in license_scan.license_scan(frame(spark, rows)).collect()}
    assert [(got[i].license, got[i].dice) for i in range(6)] == [(name, 1.0) for name, _ in whole] * 2


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_cue_words_lose_nothing(threshold):
    r = random.Random(2)
    cues = license_scan.cue_words(license_scan.TEMPLATES, threshold)
    for text in license_scan.TEMPLATES.values():
        own = license_scan.bigrams(text)
        for _ in range(200):
            w = license_scan.re.findall("[a-z0-9]+", text.lower())
            for _ in range(r.randrange(0, max(2, len(w) // 4))):
                w[r.randrange(len(w))] = "zz"
            block = license_scan.bigrams(" ".join(w))
            dice = 2 * len(set(block) & set(own)) / (len(block) + len(own))
            if dice >= threshold:
                assert set(w) & set(cues)
                lo, hi = license_scan.size_bounds(len(own), threshold)
                assert lo <= len(block) <= hi


def test_languages(spark, tmp_path):
    r = random.Random(4)
    vocabulary = {"en": ["the", "house", "with", "thing"], "de": ["der", "schön", "nicht", "häuser"], "ru": ["это", "дом", "хорошо"]}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang, 30), lang, "s", 0) for i, lang in enumerate(["en", "de", "ru"] * 40)]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 !? 😀", None, "s", 0), (903, text("en", 40) + " " + text("de", 60), None, "s", 0), (904, "日本語", None, "s", 0)]
    model = langid.fit(frame(spark, rows[:120]), langid.remainder("doc_id", 4) != 2)
    got = {x.doc_id: x for x in langid.identify(frame(spark, rows), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows[:120])
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "de" and [s.lang for s in got[903].spans] == ["en", "de"] and abs(got[903].spans[0].words - 40) <= 1
    assert got[904].lang_pred in vocabulary and all(0 <= x.score <= 1 for x in got.values())
    path = store(frame(spark, rows, False), tmp_path)
    held = langid.op9_language_id(spark, path).where("doc_id < 120").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in held)
    unlabelled = langid.fit(frame(spark, [(1, "a", None, "s", 0)]), langid.remainder("doc_id", 4) != 9)
    assert langid.identify(frame(spark, rows[:3]), unlabelled).first().lang_pred == "und"


def test_rare_languages_are_sampled(spark):
    r = random.Random(6)
    vocabulary = {"en": ["the", "house", "with", "thing"], "ru": ["это", "дом", "хорошо"], "fi": ["hyvä", "talo", "kissa", "yksi"]}
    langs = ["en"] * 2000 + ["ru"] * 4 + ["fi"] * 4
    rows = [(i, " ".join(r.choice(vocabulary[x]) for _ in range(20)), x, "s", 0) for i, x in enumerate(langs)]
    model = langid.fit(frame(spark, rows), F.lit(True), sample_rows=60)
    got = {x.doc_id: x.lang_pred for x in langid.identify(frame(spark, rows[1990:]), model).collect()}
    assert all(got[i] == langs[i] for i in got)
    assert langid.sample_shares({"a": 10, "b": 100, "c": 1000}, 110) == {"a": 1.0, "b": 0.5, "c": 0.05}


def plain_letters(text):
    """The folded bytes of letters and marks, 0 for all others, and each word's (start, end, script) by plain loops."""
    out, words, previous = [], [], False
    for c in text:
        letter, raw = unicodedata.category(c)[0] in "LM", c.encode()
        if letter:
            low = c.lower() if c.isascii() or 0xC0 <= ord(c) <= 0xDE else c
            if not previous:
                number = next((k for k, blocks in enumerate(langid.BLOCKS.values()) if any(lo <= ord(c) <= hi for lo, hi in blocks)), len(langid.BLOCKS))
                words.append([len(out), 0, number])
            out += low.encode()
            words[-1][1] = len(out)
        else:
            out += [0] * len(raw)
        previous = letter
    return out, words


TRICKY = ["Das Häuschen, ÄÖÜ ×÷ ¿qué?", "日本語 の、。テキスト", "हिन्दी में लिखा", "emoji 😀😀 x🙂y", "", "123 — !", "Ελληνικά и русский", "한국어 العربية ไทย", "a\x00b", "ꦗꦮ javanese"]


def test_letters_equal_plain_loops():
    texts = pa.array(TRICKY, pa.large_string())
    for _, _, data, off in text_slices(texts):
        letters, starts, ends, rows, script = langid._words(data, off)
        for i, t in enumerate(TRICKY):
            want, words = plain_letters(t)
            assert letters[off[i] : off[i + 1]].tolist() == want, t
            mine = rows == i
            assert [list(x) for x in zip((starts[mine] - off[i]).tolist(), (ends[mine] - off[i]).tolist(), script[mine].tolist(), strict=True)] == words, t


def test_word_scores_equal_plain_loops():
    r = np.random.default_rng(2)
    logp = r.normal(-8, 2, (1 << langid.BITS, 3)).astype(np.float32)
    in_use = r.random((langid.N_SCRIPTS, 3)) < 0.5
    texts = TRICKY + ["".join(r.choice(list("abcdefgé я\n"), 200)) for _ in range(5)]
    data = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    score, size, rows = langid.word_scores(np.frombuffer(data, np.uint8), off, logp, in_use)
    at = 0
    for i, t in enumerate(texts):
        letters, words = plain_letters(t)
        padded = [0, 0, 0, *letters]
        for start, end, script in words:
            total = np.zeros(3)
            for p in range(start, end):
                for k in langid.ORDERS:
                    h = k * 0x632BE5AB & 0xFFFFFFFF
                    for j in range(k):
                        h = (h ^ padded[p + 3 - j]) * int(langid._MULT[j]) & 0xFFFFFFFF
                        h ^= h >> 15
                    total += logp[h >> (32 - langid.BITS)]
            want = (total / len(langid.ORDERS)).astype(np.float32)
            allowed = in_use[script] if in_use[script].any() else np.ones(3, bool)
            assert (rows[at], size[at]) == (i, end - start)
            assert np.allclose(score[at][allowed], want[allowed], rtol=1e-4) and (score[at][~allowed] < want.min() - langid.SWITCH).all()
            at += 1
    assert at == len(score)


def test_languages_ties_long_texts_and_many_languages(spark, monkeypatch):
    langs = [f"l{i:03}" for i in range(200)]
    r = np.random.default_rng(4)
    logp = r.normal(-8, 1, (1 << langid.BITS, 200)).astype(np.float32)
    logp[:, 150] += 5
    model = langs, logp, np.ones((langid.N_SCRIPTS, 200), bool)
    rows = [(1, "some words of a text", None, "s", 0), (2, "word " * 30_000, None, "s", 0), (3, None, None, "s", 0), (1, "some words of a text", None, "s", 0)]
    got = langid.identify(frame(spark, rows), model).collect()
    assert sorted((x.doc_id, x.lang_pred, x.score) for x in got) == [(1, "l150", 1.0), (1, "l150", 1.0), (2, "l150", 1.0), (3, "und", 0.0)]
    tied = ["a", "b"], np.full((1 << langid.BITS, 2), -5, np.float32), np.ones((langid.N_SCRIPTS, 2), bool)
    assert langid.identify(frame(spark, rows[:1]), tied).first().lang_pred == "a"
    assert langid.identify(spark.createDataFrame([], SCHEMA), model).count() == 0
    texts = pa.array([t for t in TRICKY for _ in range(3)])
    whole = langid.label(texts, *model)
    monkeypatch.setattr(langid, "SCORE_BYTES", 1)
    assert langid.label(texts, *model) == whole


def test_texts_features_equal_one_window_at_a_time():
    """Scores of all texts at once are those of each window on its own, wherever texts and slices end."""
    r = random.Random(3)
    net = toxicity.Network(5)
    net.p["word"] *= 5
    texts = [None, "", " .,! ", "one", " ".join(words(r, 48)), " ".join(words(r, 49)), " ".join(words(r, 72)), " ".join(words(r, 73)), "Ünï " * 130, " ".join(words(r, 700)), "one"]
    windows, features = toxicity.texts_features(net, pa.array(texts, pa.string()))
    for t, n, x in zip(texts, windows, features, strict=True):
        raw = (t or "").encode()
        found, starts, ends = toxicity.word_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1:4] if raw else ([], [], [])
        count = len(starts)
        begins = sorted({min(b, max(0, count - toxicity.WINDOW)) for b in range(0, max(1, count - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)}) if count else []
        assert n == len(begins)
        logits = []
        for b in begins:
            e = min(b + toxicity.WINDOW, count)
            part = raw[starts[b] : ends[e - 1]]
            w, g, s, z, _ = toxicity.word_features(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            at = np.full((1, toxicity.WINDOW), -1)
            at[0, : e - b] = np.arange(e - b)
            logits.append(float(net.forward(net.inputs(w, g, s, z), at)[0][0]))
        if logits:
            top = sorted(logits, reverse=True)
            assert np.allclose(x, [top[0], np.mean(top), np.mean(top[:3]), np.log(len(top)), 1], atol=2e-4), t
    again = toxicity.texts_features(net, pa.array(texts[::-1], pa.string()))[1][::-1]
    assert np.allclose(features, again, atol=1e-4) and np.allclose(features[3], features[-1], atol=1e-4)


def test_toxicity_empty_tables_long_texts_and_null_labels(spark):
    r = random.Random(1)
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality long, toxic long")
    docs = [(i, " ".join(words(r, 60) + (["awful", "nasty"] * 6 if i % 2 else [])), None, None, 0) for i in range(60)]
    net = toxicity.fit(frame(spark, docs), label([(i, 0, i % 2) for i in range(60)] + [(None, 0, 1), (3, None, None), (5, 0, 0)]), F.lit(True))
    far = [(100, " ".join(words(r, 30_000)), None, None, 0), (101, " ".join(words(r, 20_000) + ["awful", "nasty"] * 6 + words(r, 20_000)), None, None, 0), (None, docs[1][1], None, None, 0), (1, docs[1][1], None, None, 0), (1, docs[1][1], None, None, 0)]
    got = [(x.doc_id, x.predicted, round(x.score, 6)) for x in toxicity.toxicity(frame(spark, far), net).collect()]
    assert len(got) == 5 and len({s for i, _, s in got if i in (1, None)}) == 1
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), net).count() == 0
    nothing = toxicity.fit(spark.createDataFrame([], SCHEMA), label([]), F.lit(True))
    assert [x.score for x in toxicity.toxicity(frame(spark, docs[:2]), nothing).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_equals_one_text_at_a_time(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 12, 20)
    score = r.normal(0, 3, (counts.sum(), 3)).astype(np.float32)
    got, at = langid.viterbi(score, counts, 2.0), 0
    for n in counts:
        part, labels = score[at : at + n], got[at : at + n]
        if n:
            v = part[0].astype(float)
            for t in range(1, n):
                v = np.maximum(v, v.max() - 2.0) + part[t]
            mine = sum(part[t, labels[t]] - 2.0 * (t > 0 and labels[t] != labels[t - 1]) for t in range(n))
            assert abs(v.max() - mine) < 1e-3
        at += n


def test_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at = r.normal(size=(7, 2 * toxicity.EMBED)), np.full((2, 5), -1)
    at[0, :4], at[1, :3] = [0, 1, 2, 3], [4, 5, 6]
    out = np.array([0.7, -0.4])
    _, cache = net.forward(x, at, keep=True)
    grad, d_x = net.backward(x, at, cache, out)
    for name in ("wf", "ub", "wa", "va", "cf", "wo"):
        flat = net.p[name].reshape(-1)
        i = int(r.integers(len(flat)))
        old = flat[i]
        values = []
        for step in (1e-4, -1e-4):
            flat[i] = old + step
            values.append(net.forward(x, at)[0] @ out)
        flat[i] = old
        assert abs((values[0] - values[1]) / 2e-4 - grad[name].reshape(-1)[i]) < 1e-3, name


def test_toxicity_learns(spark, tmp_path):
    r = random.Random(3)
    mark = lambda i: ["vile", "insult"] if i % 4 == 0 else []  # noqa: E731  in every window
    rows = [(i, " ".join(words(r, 30, 5000) + mark(i) + words(r, 30, 5000) + mark(i) + words(r, 30, 5000)), "en", "s", 0) for i in range(400)]
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, " \n", None, None, 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(frame(spark, rows), labels, toxicity.remainder("doc_id", 5) != 0)
    got = {x.doc_id: x for x in toxicity.toxicity(frame(spark, rows), net).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert [got[i].score for i in (900, 901, 902)] == [0, 0, 0] and all(0 <= x.score <= 1 for x in got.values())
    kept = {x.doc_id for x in toxicity.drop_toxic(frame(spark, rows), net).collect()}
    assert kept == {i for i, x in got.items() if x.score < 0.5}
    one_class = toxicity.fit(frame(spark, rows), labels.where("toxic = 0"), toxicity.remainder("doc_id", 5) != 0)
    assert toxicity.toxicity(frame(spark, rows), one_class).first().score == 0.0


@pytest.mark.parametrize("n", [60, 400])
def test_toxicity_learns_one_marked_place(spark, n):
    r = random.Random(3)
    rows = [(i, " ".join(words(r, n, 5000) + (["vile", "insult"] if i % 4 == 0 else []) + words(r, n, 5000)), "en", "s", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(frame(spark, rows), labels, toxicity.remainder("doc_id", 5) != 0)
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(frame(spark, rows), net).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == int(i % 4 == 0) for i in held]) > 0.95


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 72, 73, 100, 1000])
def test_toxicity_windows_overlap_by_half(n):
    text = " ".join(f"w{i}" for i in range(n))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([text]), pa.array([5])], ["toxic", "t", "row"])
    found = [x.decode().split() for b in toxicity._sampled_windows(iter([batch])) for x in b["text"].to_pylist()]
    begins = [int(x[0][1:]) for x in found]
    assert all(len(x) == min(n, toxicity.WINDOW) for x in found) and all(0 < b - a <= toxicity.WINDOW // 2 for a, b in zip(begins, begins[1:]))
    assert not n or (begins[0] == 0 and found[-1][-1] == f"w{n - 1}")
    assert toxicity.texts_features(toxicity.Network(), pa.array([text]))[0].tolist() == [len(found)]
    assert next(toxicity._counted_windows(iter([batch])))["windows"].to_pylist() == [len(found)]


def test_toxicity_training_takes_whole_rows():
    row, toxic, windows = np.arange(6), np.array([1, 0, 1, 0, 0, 0]), np.array([10, 10, 10, 10, 0, 50])
    assert toxicity._fitting_rows(row, toxic, windows, 1000) == {0, 1, 2, 3, 5}
    assert toxicity._fitting_rows(row, toxic, windows, 45) == {0, 1, 3}
    assert toxicity._fitting_rows(row, toxic, windows, 1) == {0, 1}
