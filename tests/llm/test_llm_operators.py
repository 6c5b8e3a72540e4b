"""The operators through Spark: brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axisweave.llm import decontamination, fingerprints, language, linededup, linking, neardup, passages, sentencepieces, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYL = {"en": "the of and th er on in ing tion es".split(), "de": "der und ein ich sch ung zu ver lich st".split()}


def prose(rnd, lang, n):
    out = ["".join(rnd.choices(SYL[lang], k=rnd.randint(1, 3))) for _ in range(n)]
    return "".join(w + ("\n" if rnd.random() < 0.08 else ". " if rnd.random() < 0.1 else " ") for w in out).strip()


def make(spark, texts, extra=True):
    """Documents with a clashing set of further columns."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("own") for c in ("id", "a", "b", "shard", "bucket", "score", "ids")}) if extra else df


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.choice(["en", "de"]), rnd.randint(3, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5].replace("the", "teh", 1) + " end", "", None, "x", "?!", None, texts[7] + "\n" + texts[8]]
    return list(enumerate(texts))


def jump(key, n):
    """Brute force of the published loop on unsigned 64-bit integers."""
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, corpus):
    rows = [*corpus, (3, "again"), (None, "no id"), (-7, "minus"), (1 << 62, "large"), (3, "again")]
    got = sharding.shard_documents(make(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = r["doc_id"] or 0
        assert (r["shard"], r["grown_shard"]) == (jump(key, 8), jump(key, 9)) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    many = spark.range(300).select(sharding.jump_hash(F.col("id"), 1000).alias("s"), "id").collect()
    assert all(r["s"] == jump(r["id"], 1000) for r in many)
    assert sharding.shard_documents(make(spark, [])).count() == 0


def test_fingerprints(spark, corpus):
    rows = [(i * 1000 if i % 3 else i * 1000 + 7, t) for i, t in corpus]
    got = {r["doc_id"]: r for r in fingerprints.compare_versions(make(spark, rows)).collect()}
    units = lambda x: {p for p in re.split(r"(?<=[.!?])\s+|[\r\n]+", x) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    docs = sorted((i, t or "") for i, t in rows)
    seen = {}
    for k, (i, t) in enumerate(docs):
        then = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + then[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(units(t), units(edited))) and r["near_next"] == pytest.approx(like(units(t), units(then)))
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_compare_by_themselves(spark, corpus):
    """The likeness that the query gives follows from the two strings."""
    long_ = "\n".join(f"line {i} of a long text" for i in range(700))
    rows = [(i, t) for i, t in corpus] + [(200, long_), (201, long_ + "\nmore")] + [(1 << 50, "far away"), (None, "no id"), (None, "none either")]
    got = fingerprints.compare_versions(make(spark, rows)).cache()
    assert got.count() == len(rows)
    pairs = got.where("doc_id is not null and doc_id <> 4").select("doc_id", "fingerprint", "edited_fingerprint", "near_edited")
    found = fingerprints.compare_fingerprints(pairs, ["doc_id"], "fingerprint", "edited_fingerprint").join(pairs, "doc_id")
    assert found.count() == pairs.count() and found.where("abs(likeness - near_edited) > 1e-12").isEmpty()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[200]["near_next"] == pytest.approx(700 / 701) and by[None]["n_chars"] > 0
    assert fingerprints.compare_versions(make(spark, [])).count() == 0


def test_peeling_recovers_the_difference(spark):
    a, b = list(range(1, 40)), list(range(20, 50))
    df = spark.createDataFrame([(1, a, b, 100), (2, a, b, 2)], "pair long, a array<long>, b array<long>, part long")
    got = {r["pair"]: r for r in fingerprints.peel(df, ["pair"]).collect()}
    assert sorted(got[1]["only_a"]) == list(range(1, 20)) and sorted(got[1]["only_b"]) == list(range(40, 50)) and got[1]["left"] == 0
    assert got[2]["left"] > 0


def test_pieces(spark, corpus):
    docs = make(spark, [*corpus, (None, "no id"), (5, "▁ lower"), (5, "▁ lower")])
    got = sentencepieces.encode_texts(docs, dropout=0.2)
    assert got.where("not lossless").count() == 0 and got.count() == docs.count() and got.select("a").distinct().first()["a"] == "own"
    back = sentencepieces.decode_ids(got.withColumnRenamed("text", "was"))
    assert back.where("not (text <=> coalesce(was, ''))").count() == 0
    assert sentencepieces.encode_texts(make(spark, [])).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "short item"), (3, None), (None, "")], "item_id long, text string")
    docs = make(spark, [(1, "zero ONE two three four five six seven eight"), (2, "a short item one two three four five six seven eight nine"), (3, None), (None, "short item"), (5, "clean")])
    got = {r["doc_id"]: r for r in decontamination.contamination_report(docs, items).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (8, 1, False)
    assert (got[2]["n_hit"], got[2]["n_items"], got[2]["contaminated"], got[2]["items_sha256"]) == (11, 2, True, hashlib.sha256(b"1,2").hexdigest())
    assert (got[3]["n_words"], got[None]["n_items"]) == (0, 1)
    kept = decontamination.decontaminate(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5] and kept.columns == docs.columns
    assert decontamination.matches(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.matches(docs.limit(0), items, block_bytes=10).count() == 0
    # items in several blocks, one at a time: the same rows
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(decontamination.matches(docs, items, block_bytes=10)) == rows(decontamination.matches(docs, items))
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items, block_bytes=10).collect()) == [3, 5]


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(spark, [*corpus, (4, corpus[4][1]), (None, "no id")])).collect()}
    assert set(got) == {i for i, _ in corpus}
    shingles = {}
    for i, t in corpus:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        shingles[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    root = {i: i for i in shingles}
    for _ in range(3):
        for i in shingles:
            for j in shingles:
                same = sum((shingles[i] & shingles[j]).values())
                total = sum((shingles[i] | shingles[j]).values())
                raw = dict(corpus)
                if (same / total if total else float((raw[i] or "") == (raw[j] or ""))) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root
    kept = neardup.keep_one(make(spark, corpus))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))


def test_links_of_a_hard_bucket(spark):
    """A chain in one bucket: neighbours are alike, leaders take in their neighbours only; the rest is linked by blocks."""
    n = 30
    buckets = spark.createDataFrame([("b", i) for i in range(n)], "bucket string, id long")
    bits = [(np.arange(n) < i).astype(np.uint16).tobytes() for i in range(n)]
    signatures = spark.createDataFrame(list(enumerate(map(bytearray, bits))), "id long, signature binary")
    like = lambda pairs: pairs.withColumn("like", 1 - F.abs(F.col("a") - F.col("b")) * 0.15).where("like >= 0.8")
    _, root = linking.verified_links(buckets, like, 0.8, lambda m: linking.block_pairs(m, signatures, 0.5))
    got = {r["id"]: r["root"] for r in root.collect()}
    assert len(set(got.values())) <= 3 and len(got) == n  # at most a cut beside each leader's neighbours
    assert set(got.values()) == {0}


@pytest.mark.parametrize("taken_by", [1, 2])
def test_members_that_leaders_take_in_stay_in_reach(spark, taken_by):
    """Groups around the bucket's leaders that are joined by one bridge, whose end is taken in before the bridge is compared."""
    buckets = spark.createDataFrame([("b", i) for i in range(40)], "bucket string, id long")
    lead = linking.leader_pairs(buckets).first()["leader"]
    rest = [i for i in range(40) if i != lead]
    if taken_by == 2:  # either side is led by a leader of its own
        half = rest[:20]
        lead2 = linking.leader_pairs(buckets.where(~F.col("id").isin(half + [lead]))).first()["leader"]
        bridge = half[0], next(i for i in rest[20:] if i != lead2)
    else:
        half = rest[:39 - 3]
        lead2, bridge = rest[-1], (half[0], rest[-2])
    group = {i: int(i not in half and i != lead) for i in range(40)}
    true = {(i, j) for i in range(40) for j in range(i + 1, 40) if group[i] == group[j] and {i, j} & {lead, lead2}} | {tuple(sorted(bridge))}
    links = spark.createDataFrame([(a, b, 0.9) for a, b in true], "a long, b long, like double")
    signatures = spark.createDataFrame([(i, bytearray(np.ones(60, np.uint16).tobytes())) for i in range(40)], "id long, signature binary")
    _, root = linking.verified_links(buckets, lambda p: p.join(links, ["a", "b"]), 0.8, lambda m: linking.block_pairs(m, signatures, 0.5))
    assert {r["id"]: r["root"] for r in root.collect()} == dict.fromkeys(range(40), 0)


def test_fuzzy_lines(spark, corpus):
    rows = [(i, t) for i, t in corpus if i % 2 or t is None] + [(100, "Licensed under the terms of version 3.0 of this licence.\n\nown line of this document"), (101, "Licensed under the terms of version 2.0 of this licence.\nok")]
    got = {(r["doc_id"], r["line_no"]): r for r in linededup.classed_lines(make(spark, rows)).collect()}
    sets, first = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip()
            if line:
                s = frozenset(line[x : x + 5] for x in range(len(line) - 4)) or frozenset([line])
                sets[i, k] = s
    for p, s in sets.items():
        first[p] = min(q for q, o in sets.items() if len(s & o) / len(s | o) >= 0.8)
    for _ in range(3):
        first = {p: first[first[p]] for p in first}
    assert set(got) == {(i, k) for i, t in rows for k in range(len((t or "").split("\n")))}
    for p, r in got.items():
        assert r["kept"] == (p not in first or first[p] == p)
        assert (r["first_doc"], r["first_line"]) == first.get(p, (None, None))
    text = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(make(spark, rows)).collect()}
    assert text[100] == rows[-2][1] and text[101] == "ok"
    assert {i for i, t in rows if not (t or "").strip()} <= set(text)


def test_repeated_passages(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    shared = [word() for _ in range(60)]
    near = [w if i % 25 else word() for i, w in enumerate(shared)]
    own = lambda n: [word() for _ in range(n)]
    rows = [(1, own(80) + shared + own(20)), (2, own(10) + near + own(30)), (3, own(200)), (4, ["for"] * 90), (7, own(5) + shared)]
    docs = make(spark, [(i, " ".join(w)) for i, w in rows] + [(8, None), (9, ""), (10, "few words"), (None, " ".join(shared))])
    got = {(r["doc_id"], r["source_doc"]): r for r in passages.passages(docs).collect()}
    assert set(got) == {(2, 1), (4, 4), (7, 1)}
    assert (got[7, 1]["from_word"], got[7, 1]["to_word"], got[7, 1]["source_from"]) == (5, 65, 80) and got[7, 1]["identity"] == 1.0
    assert got[2, 1]["identity"] > 0.9 and got[2, 1]["to_word"] - got[2, 1]["from_word"] >= 50
    assert got[4, 4]["to_word"] == 90
    assert passages.passages(docs.limit(0)).count() == 0


def test_passages_in_pieces_and_with_changes(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    own = lambda n: [word() for _ in range(n)]
    whole, base = own(54), own(56)
    changed = [word() if i % 8 == 7 else w for i, w in enumerate(base)]
    rows = [(1, own(9) + whole[:27]), (2, whole[27:] + own(9)), (3, own(5) + whole + own(5)), (4, own(7) + whole), (11, own(20) + base), (12, own(3) + changed + own(9))]
    # halves between the whole ones: only what runs over the middle meets
    rows += [(20, whole[:27] + own(4)), (21, own(4) + whole[27:]), (5000, own(8) + whole)]
    got = {(r["doc_id"], r["source_doc"]): r for r in passages.passages(make(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    assert (got[4, 3]["from_word"], got[4, 3]["to_word"], got[4, 3]["source_from"], got[4, 3]["identity"]) == (7, 61, 5, 1.0)
    assert got[12, 11]["to_word"] - got[12, 11]["from_word"] >= 54 and 0.85 <= got[12, 11]["identity"] < 0.9
    assert any(d == 5000 and s in (3, 4) for d, s in got)


@pytest.mark.parametrize("copies", [2, 20])
def test_passages_whose_seeds_are_all_elsewhere_before(spark, copies):
    """Each stretch of a passage is also in ``copies`` texts before its source, and in as many between source and copy."""
    rnd = random.Random(11)
    own = lambda n: ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)]
    parts = [own(15) for _ in range(3)]
    pieces = [own(9) + p + own(9) for p in parts for _ in range(2 * copies)]
    rows = [(i + 1000 * (i % 2), w) for i, w in enumerate(pieces)]
    rows += [(d, own(12) + parts[0] + own(1) + parts[1] + own(1) + parts[2] + own(12)) for d in (500, 5000)]
    got = passages.passages(make(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert {(r["doc_id"], r["source_doc"], r["from_word"], r["to_word"], r["source_from"], r["words"]) for r in got} == {(5000, 500, 12, 59, 12, 45)}


def test_archives(spark, tmp_path):
    pages = [(1, "http://a", "<p>ß\r\n\r\n</p>"), (2, None, "<p>ß\r\n\r\n</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e e", "WARC/1.1\r\n"), (None, "http://n", "lone"), (2, "http://b", "<p>ß\r\n\r\n</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    got = warc.archive_round_trip(df, str(tmp_path / "w")).collect()
    assert len(got) == len(pages) and all(r["digest_ok"] for r in got)
    for i, kind, ref in ((1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None)):
        mine = [r for r in got if r["page_id"] == i]
        assert {(r["record_type"], r["refers_to"]) for r in mine} == {(kind, ref)}
        html = next(h for p, _, h in pages if p == i) or ""
        assert {(r["payload_bytes"], r["payload_digest"]) for r in mine} == {(len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())}
    assert warc.archive_round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_arc_files(spark, tmp_path):
    """Both versions, with fields of their own, gzipped by member or not, and payloads that aren't UTF-8."""
    page = b"<p>caf\xe9</p>"
    other = b"HTTP/1.0 200 OK\r\nX-Name: \xe9t\xe9\r\n\r\n" + page
    own = b"filedesc://x 0.0.0.0 20200102030405 text/plain 40\n" + b"2 0 Archive\nURL Archive-date Archive-length"[:40].ljust(40) + b"\n"
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "a.arc").write_bytes(warc.arc_bytes([(1, "http://a", page), (2, "http://b c", b"")], 1))
    whole = warc.arc_bytes([(3, "http://c", page)], 2, date="20200102030405")
    (folder / "b.arc.gz").write_bytes(gzip.compress(whole[:40]) + gzip.compress(whole[40:]))
    foreign = f"http://d 192.0.2.9 19990102030405 text/html {len(other)}\n".encode() + other + b"\n" + b"http://e 192.0.2.9 19990102 text/plain 5\nplain\n"
    (folder / "c.arc").write_bytes(warc.arc_bytes([], 1) + foreign)
    got = warc.read_arc(spark, str(folder)).cache()
    by = {r["url"]: r for r in got.collect()}
    assert set(by) == {"http://a", "http://b%20c", "http://c", "http://d", "http://e"}
    assert bytes(by["http://d"]["payload"]) == page and b"\xe9t\xe9" in bytes(by["http://d"]["http"]) and by["http://d"]["page_id"] is None
    assert by["http://c"]["date"] == "2020-01-02T03:04:05Z" and by["http://e"]["date"] == "1999-01-02T00:00:00Z"
    warc.write_warc(got, str(tmp_path / "w"))
    back = {r["url"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {u: (r["payload_digest"], r["record_type"], r["digest_ok"]) for u, r in back.items()} == {u: (r["payload_digest"], "response" if r["http"] else "resource", True) for u, r in by.items()}
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert sum(warc.unzipped(f).count(b"WARC/1.1\r\n") for f in files) == 5 and all(f[:2] == b"\x1f\x8b" for f in files if f)
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(io.BytesIO(own + b"no length\n")))


def test_languages(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, lang, 60), lang, "s", 0) for i in range(60) for lang in [("en", "de")[i % 2]]] + [(90, None, None, None, None), (91, "12 34!", "en", None, None), (92, "", None, None, None), (None, prose(rnd, "en", 40), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own"))
    got = language.predict_languages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (90, 91, 92):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert {r["lang_pred"] for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, "en", 30) + (" scum of a loser" if i % 4 == 0 else "")) for i in range(240)] + [(500, None), (501, ""), (None, "scum loser")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)] + [(3, 0, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(make(spark, rows), labels).collect()}
    held = [r for i, r in got.items() if i is not None and i < 240 and r["held_out"]]
    assert sum((r["score"] > 0.5) == (r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert toxicity.score_documents(make(spark, rows[:3]), labels.limit(0)).count() == 3


def test_pipeline(spark, tmp_path):
    rnd = random.Random(21)
    base = [prose(rnd, ("en", "de")[i % 2], 80) for i in range(24)]
    passage = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(30))
    copy = base[2].replace("\n", " ")
    texts = [*base, base[0], copy, copy + " more", passage + "\n" + base[1][:40] + "zz", "123 456", None]
    spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(24)) <= set(got) | {2} and not {24, 27, 28, 29} & set(got)
    assert len({2, 25, 26} & set(got)) <= 2
    assert all(r["lossless"] and r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_lines_that_agree_and_are_not_alike_make_no_rows_of_pairs(spark, monkeypatch):
    """Versions of one line of which most agree by signature and few are alike: the pairs verified by joins grow with the lines, and no link is lost."""
    rnd, n = random.Random(3), 300
    base = [f"word{i}" for i in range(40)]
    lines = []
    for i in range(n):
        w = list(base)
        for k in rnd.sample(range(40), 2 + i % 2 if i % 20 else 1):
            w[k] = f"{k}x{rnd.randrange(10**4)}"
        lines.append(" ".join(w))
    asked = []

    def counted(buckets, verify, *more, **named):
        return linking.verified_links(buckets, lambda pairs: asked.append(pairs.count()) or verify(pairs), *more, **named)

    monkeypatch.setattr(linededup, "verified_links", counted)
    got = {r["doc_id"]: r["first_doc"] for r in linededup.classed_lines(make(spark, list(enumerate(lines)))).collect()}
    sets = [frozenset(x[k : k + 5] for k in range(len(x) - 4)) for x in lines]
    alike = [(i, j) for j in range(n) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(n))
    for _ in range(20):
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert 0 < len(alike) < n * n / 8 and [got[i] for i in range(n)] == root
    assert sum(asked) <= 30 * n


def test_unzipping_many_members_takes_time_in_proportion():
    """A file of many gzip members: what follows a member isn't copied whole for each of them."""
    want = [bytes([i % 251]) * (i % 7) + random.Random(i).randbytes(900) for i in range(3000)]
    want[5] = random.Random(0).randbytes(50_000)
    parts = [gzip.compress(w, 1, mtime=0) + b"\0" * (3 if i == 5 else 0) for i, w in enumerate(want)]
    assert warc.unzipped(b"".join(parts)) == b"".join(want) and warc.unzipped(b"plain") == b"plain"
    with pytest.raises(warc.ArchiveError):
        warc.unzipped(b"".join(parts)[:-3])
    took = []
    for times in (1, 8):
        image = b"".join(parts) * times
        began = time.process_time()
        warc.unzipped(image)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_next_documents_come_from_one_shuffle_of_the_texts(spark):
    """Inner rows, last rows and first rows of blocks read one exchange."""
    rows = fingerprints.with_next(make(spark, [(i, f"text {i}. More.") for i in range(2000)]), 8)
    run = rows._jdf.queryExecution()
    assert run.toRdd().count() == 2000
    final = run.executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [x for x in final.split("\n") if "REPARTITION_BY_NUM" in x]
    assert len(exchanges) == 3 and sum("ReusedExchange" not in x for x in exchanges) == 1


def test_documents_that_agree_and_are_not_alike_make_no_rows_of_pairs(spark, monkeypatch):
    """The same for versions of one document; within blocks the weighted similarity is that of the exact comparison."""
    import pyarrow as pa

    rnd, n = random.Random(4), 200
    docs = []
    for i in range(n):
        w = [f"word{j}" for j in range(120)]
        for k in rnd.sample(range(120), 2 if i % 20 else 1):
            w[k] = f"new{rnd.randrange(10**6)}"
        docs.append(" ".join(w))
    asked = []

    def counted(buckets, verify, *more, **named):
        return linking.verified_links(buckets, lambda pairs: asked.append(pairs.count()) or verify(pairs), *more, **named)

    monkeypatch.setattr(neardup, "verified_links", counted)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(spark, list(enumerate(docs)))).collect()}
    sets = [frozenset(tuple(x.split()[k : k + 5]) for k in range(116)) for x in docs]
    alike = [(i, j) for j in range(n) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(n))
    for _ in range(20):
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert 0 < len(alike) < n * n / 8 and [got[i] for i in range(n)] == root
    assert sum(asked) <= 30 * n
    texts = [*docs[:40], "a b a b a b a b a b a b", "a b a b a b a b a b", "b a b a b a b a b a b"]
    i, j = np.triu_indices(len(texts), 1)
    row, key = neardup.text_elements(pa.array(texts))
    assert linking.jaccard_of_pairs(row, key, len(texts), i, j).tolist() == neardup.weighted_jaccard(pa.array(texts).take(pa.array(i)), pa.array(texts).take(pa.array(j))).tolist()
