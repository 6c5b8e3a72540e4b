"""Operators that need no session: exact references, round trips and properties on small inputs."""

from __future__ import annotations

import hashlib
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from axisweave.llm import decontamination as dc
from axisweave.llm import language, linededup, linking, neardup, passages, sentencepieces, toxicity, warc
from axisweave.llm.common import U64, pieces, word_hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode().translate(LOW))


TEXTS = ["", None, "Hello, WORLD! Ünïcode-Wörter 42x", "a", "a a a", "\n\n", "été ÉTÉ", "x" * 5000, "one two three four five six seven eight nine ten"]


def test_word_hashes_follow_the_rule():
    h, row = word_hashes(pa.array(TEXTS, pa.string()))
    want = [(w, i) for i, t in enumerate(TEXTS) for w in words(t)]
    assert row.tolist() == [i for _, i in want]
    by = {}
    for (w, _), v in zip(want, h.tolist(), strict=True):
        assert by.setdefault(w, v) == v
    assert len(set(by.values())) == len(by)
    sliced, row2 = word_hashes(pa.array(TEXTS, pa.string()).slice(2, 3))
    assert sliced.tolist() == h[(row >= 2) & (row < 5)].tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["t"])
    assert sum(p.num_rows for p in pieces(batch, "t", 100)) == len(TEXTS)


def test_decontamination_against_brute_force():
    rnd = random.Random(2)
    vocab = "the of and in to a is that it was".split()
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([12, 9, 3, 1, 8, 0, 20])] + [(None, "never seen words here")]
    docs = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) for _ in range(40)] + ["X y " + items[0][1].upper() + " z " + items[6][1], None, ""]
    ids = np.array([str(i) if i is not None else "" for i, _ in items], object)
    block = (ids, *dc.windows(pa.array([t for _, t in items], pa.string()), 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.string())], ["doc_id", "text"])
    got = dc.scan(batch, [block], 8).to_pylist()
    for g, d in zip(got, docs, strict=True):
        w, hit, found, longest = words(d), set(), set(), 0
        for name, (_, t) in zip(ids, items, strict=True):
            v = words(t)
            grams = [v[i : i + 8] for i in range(len(v) - 7)] if len(v) >= 8 else [v] if v else []
            for x in grams:
                for i in range(len(w) - len(x) + 1):
                    if w[i : i + len(x)] == x:
                        hit.update(range(i, i + len(x)))
                        found.add(name)
            least = min(8, len(v))
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= least > 0:
                        longest = max(longest, n)
        assert (g["n_words"], g["n_hit"], g["items"], g["longest_words"]) == (len(w), len(hit), sorted(found), longest)


def test_suffix_array_is_sorted():
    rnd = random.Random(1)
    for n in (1, 7, 300):
        h = np.array([rnd.randint(0, 5) * 12345678901234567 + 99 for _ in range(n)], U64)
        row = np.sort(np.array([rnd.randint(0, 4) for _ in range(n)]))
        a = dc.SuffixArray(h, row, 8)
        key = lambda p: [int(a.rank[p + t]) for t in range(8) if p + t < a.stop[p]]
        assert sorted(a.sa.tolist()) == list(range(n))
        assert all(key(x) <= key(y) for x, y in zip(a.sa, a.sa[1:], strict=False))


def test_dart_minhash_estimates_weighted_jaccard():
    rnd = random.Random(4)
    a = [f"w{i}" for i in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    texts = pa.array([" ".join(a), " ".join(b), " ".join(a), "", "two words", " ".join(rnd.choices(a, k=50))])
    h, row, weight = neardup.shingles(texts)
    s = neardup.dart_minhash(h, row, weight, len(texts), 256)
    true = neardup.weighted_jaccard(texts.slice(0, 1), texts.slice(1, 1))[0]
    assert abs((s[0] & U64(0xFFFFFFFF) == s[1] & U64(0xFFFFFFFF)).mean() - true) < 0.1
    assert (s[0] == s[2]).all() and (s[4] != np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()
    ids = neardup.text_id(pa.array(["A b", "a  B!", "b a", "", None, "?"]))
    assert ids[0] == ids[1] != ids[2] and not ids[3:].any()
    assert neardup.weighted_jaccard(pa.array(["", "a b"]), pa.array(["", "c"])).tolist() == [1.0, 0.0]


def test_lines_and_their_likeness():
    texts = ["a\n\n b \n", None, "", "ü x\ny", "\n"]
    data, start, end, row, number = linededup.lines(pa.array(texts, pa.string()))
    raw = data.tobytes()
    got = [(r, n, raw[s:e].decode()) for r, n, s, e in zip(row.tolist(), number.tolist(), start.tolist(), end.tolist(), strict=True)]
    assert got == [(i, k, x.strip()) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    x, y = ["abcdefgh", "abc", "äöüßéèê", "same line"], ["abcdefgx", "abd", "äöüßéèë", "same line"]
    want = []
    for p, q in zip(x, y, strict=True):
        a, b = ({t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in (p, q))
        want.append(len(a & b) / len(a | b))
    assert linededup.line_jaccard(pa.array(x), pa.array(y)).tolist() == pytest.approx(want)


@pytest.mark.parametrize("size", [14, 22, 60, 200])
def test_like_lines_agree_in_their_own_bins(size):
    rnd = random.Random(size)
    make = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    x = [make(size) for _ in range(3000)]
    # shingles lost at the end and gained there: a Jaccard similarity of 0.8 or just over
    k = (size - 4) // 9
    y = [t[: size - k] + make(k) for t in x]
    true = linededup.line_jaccard(pa.array(x), pa.array(y))
    sig = []
    for texts in (x, y):
        data, off = linededup.text_buffers(pa.array(texts))
        h, line = linededup.char_shingles(data, off[:-1], off[1:])
        sig.append(linededup.own_bins(linededup.signatures(h, line, len(texts), 60)))
    like = true >= 0.8
    assert like.sum() > 2000 and (linking.agreement(*sig, empty=0)[like] >= linededup.LEAST_AGREEMENT).all()


def test_minimizers_cover_every_window():
    h = np.random.default_rng(0).integers(0, 1 << 62, 200).astype(U64)
    row = np.repeat([0, 1, 2], [120, 75, 5])
    _, at = passages.minimizers(h, row)
    kept = set(at.tolist())
    for lo, hi in ((0, 120), (120, 195)):
        for i in range(lo, hi - 6 - 12 + 2):
            assert kept & set(range(i, i + 12))
    assert not [a for a in kept if a >= 195]


def test_chains_are_collinear_and_best():
    x, y = np.array([0, 3, 10, 14, 30, 200]), np.array([5, 8, 100, 19, 36, 206])
    best = passages.chain(x, y)[0].tolist()
    assert [x[i] for i in best] == [0, 3, 14, 30]
    assert passages.align(np.arange(30), np.concatenate([np.arange(12), [99], np.arange(13, 30)]), np.array([0, 20]), np.array([0, 20])) == 25  # up to the last anchor; the tail is the caller's


def test_pieces_equal_the_library_without_dropout_and_round_trip():
    import sentencepiece

    model = sentencepieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    texts = ["Hello world", "  two  spaces \n\n x", "12345 é€😀 x", " ", "a\tb\x00", "don't it's ... --- [x](y) a.b,c; ² x².", "http://a.b/c?d=1&e=2", "übermäßig naïve", "x" * 300, "日本語 テスト"]
    plain, dropped = sentencepieces.Encoder(model, 1, 0.0), sentencepieces.Encoder(model, 1, 0.3)
    for t in [*texts, "▁ ▁▁x", ""]:
        assert sentencepieces.decode(model, plain.encode(t)) == t == sentencepieces.decode(model, dropped.encode(t, 7))
        assert (dropped.encode(t, 7) == sentencepieces.Encoder(model, 1, 0.3).encode(t, 7)).all()
    assert [plain.encode(t).tolist() for t in texts] == [sp.encode(t) for t in texts]
    long = "international organisation of thinking machines " * 30
    assert dropped.encode(long).tolist() != plain.encode(long).tolist() != sentencepieces.Encoder(model, 2, 0.3).encode(long).tolist()
    rnd = random.Random(3)
    for _ in range(200):
        c = "".join(rnd.choice("thequickbrownin") for _ in range(rnd.randint(1, 70)))
        for limit in (0, 1 << 30):
            assert sentencepieces.merge_short(model.rank, list(c), 9, limit) == sentencepieces.merge_long(model.rank, list(c), 9, limit)


def test_dropout_is_drawn_for_each_place():
    model = sentencepieces.load()
    own, word = sentencepieces.Encoder(model, 1, 0.1), " internationalisation"
    chars = list(word.replace(" ", "▁"))
    merges = len(chars) - len(sentencepieces.merge_short(model.rank, list(chars), 0, 0))
    seen = {}
    for doc in range(300):
        text = (word * 10).strip()
        ids = own.encode(text, doc)
        assert sentencepieces.decode(model, ids) == text and (ids == sentencepieces.Encoder(model, 1, 0.1).encode(text, doc)).all()
        for d in own.draws(doc, 10):
            got, n = sentencepieces.merge_drawn(model.rank, list(chars), d, own.limit)
            seen[tuple(got)] = seen.get(tuple(got), 0) + 1
    assert len(seen) > 5 and 0.9**merges == pytest.approx(sum(not d & (1 << merges) - 1 for k in range(300) for d in own.draws(k, 10)) / 3000, abs=0.04)
    assert len({own.encode(word.strip(), k).tobytes() for k in range(300)}) > 5


@pytest.mark.parametrize("version", [1, 2])
def test_arc_conversion(version):
    pages = [(1, "http://a b/ü", b"<p>\r\n\r\nx\n</p>"), (None, None, b""), (-5, "http://c", "ß".encode())]
    image = warc.arc_bytes(iter(pages), version)
    got = [warc.convert(*r) for r in warc.parse_arc(io.BytesIO(image))]
    assert [(g["page_id"], g["payload"]) for g in got] == [(i, h) for i, _, h in pages]
    assert got[0]["url"] == "http://a%20b/%C3%BC" and got[0]["date"] == "2024-01-01T00:00:00Z"
    for g, (i, _, h) in zip(got, pages, strict=True):
        assert g["payload_digest"] == warc.base64.b32encode(hashlib.sha1(h).digest()).decode() and warc.uuid_page(g["record_id"]) == i
        for again in (False, True):
            (fields, block), = warc.parse_warc(io.BytesIO(warc.warc_record(g, 9, again).encode() + b"\r\n\r\n"))
            assert block.endswith(h if not again else b"\r\n\r\n") and fields["warc-type"] == ("revisit" if again else "response")
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(io.BytesIO(image[:-4])))
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(io.BytesIO(b"http://a 1 2 3 4\nabcd\n")))


def test_factorization_machine_learns_an_interaction():
    rnd = random.Random(0)
    texts, y = [], []
    for _ in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join(rnd.choices("the of and to in".split(), k=8) + ["insult"] * a + ["group"] * b))
        y.append(int(a and b))
    bucket, row = toxicity.terms(pa.array(texts), 16)
    parts = np.split(bucket, np.searchsorted(row, np.arange(1, len(texts))))
    m = toxicity.train(parts, np.array(y), 16)
    s = m.scores(pa.array(["the insult and the group", "insult of the and", "group of the and", "", None]))
    assert s[0] > 0.7 > max(s[1:]) and ((s >= 0) & (s <= 1)).all()


def test_mixture_finds_both_languages():
    rnd = random.Random(6)
    syllables = {"x": "ka ko ki ru mo".split(), "y": "str ent ung lich sch".split()}
    make = lambda k, n: " ".join("".join(rnd.choices(syllables[k], k=3)) for _ in range(n))
    counts = {}
    for k in syllables:
        data, off = language.text_buffers(pa.array([make(k, 3000)]))
        h, _ = language.grams(*language.words(data, off)[:3], language.BUCKETS)
        counts[k] = np.bincount(h, minlength=language.BUCKETS)
    table = np.stack([np.log((c + 0.5) / (c.sum() + 0.5 * language.BUCKETS)) for c in counts.values()], 1)
    m = language.Model(list(counts), (table - table.mean(1, keepdims=True)).astype(np.float32))
    got = language.infer(m, pa.array([make("x", 50), make("y", 50), make("x", 70) + " " + make("y", 30), "12 34", None, ""]))
    assert [g[0] for g in got] == ["x", "y", "x", "und", "und", "und"]
    assert got[0][2] == ["x"] and sorted(got[2][2]) == ["x", "y"] and 0.6 < got[2][1] < 0.8
