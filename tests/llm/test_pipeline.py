"""The pipeline's stages and the near-duplicate operators against brute force in plain Python."""

from __future__ import annotations

import collections
import itertools
import random
import re

import corpus_pipeline
from axisweave.llm import linededup, neardup, sentencepieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYL = {"en": "the of and th er on in ing tion es ou le".split(), "de": "der und ein ich sch ung zu ver lich st au ge".split()}


def words(rnd, lang, n):
    return ["".join(rnd.choices(SYL[lang], k=rnd.randint(2, 4))) for _ in range(n)]


def components(ids, alike):
    """The least id of each id's component."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in alike:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def pairs_of(sets, least, size, common):
    """Pairs that share an element and whose similarity is ``least`` or more."""
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    met = {p for ids in at.values() for p in itertools.combinations(sorted(ids), 2)}
    return [(i, j) for i, j in met if common(sets[i], sets[j]) >= least * (size(sets[i]) + size(sets[j]) - common(sets[i], sets[j]))]


def line_sets(lines):
    return {k: frozenset(t[x : x + 5] for x in range(len(t) - 4)) or frozenset([t]) for k, t in lines.items()}


def word_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    return out


def linked_lines(lines):
    return pairs_of(line_sets(lines), 0.8, len, lambda a, b: len(a & b))


def linked_texts(texts):
    return pairs_of(word_sets(texts), 0.8, lambda c: sum(c.values()), lambda a, b: sum((a & b).values()))


def test_stages(spark, tmp_path):
    rnd = random.Random(31)
    text = lambda lang, n: "\n".join(" ".join(words(rnd, lang, rnd.randint(6, 12))) for _ in range(n))
    texts = {i: text(("en", "de")[i % 2], 6) for i in range(40)}
    edited = lambda t, every: " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(t.replace("\n", " ").split(" ")))
    passage = " ".join(words(rnd, "en", 20))
    texts |= {50: texts[3], 51: edited(texts[4], 60), 52: edited(texts[5], 4), 53: texts[6].split("\n")[0] + "x\n\n" + text("en", 4), 54: text("en", 3) + "\n" + passage, 55: "1234 567 !", 56: None, 57: ""}
    spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in texts.items()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage.upper())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # by hand: documents without letters go; then lines, documents and matches
    kept = {i: t for i, t in texts.items() if t and re.search("[a-z]", t)}
    lines = {(i, k): line.strip() for i, t in kept.items() for k, line in enumerate(t.split("\n"))}
    solid = {p: t for p, t in lines.items() if t}
    same = collections.defaultdict(list)
    for p, t in solid.items():
        same[t].append(p)
    root = components(solid, linked_lines(solid) + [(g[0], p) for g in same.values() for p in g[1:]])
    cut = {i: [(k, line) for k, line in enumerate(t.split("\n")) if root.get((i, k), (i, k)) == (i, k)] for i, t in kept.items()}
    docs = {i: "\n".join(line for _, line in c) for i, c in cut.items() if any(line.strip() for _, line in c)}
    docs = {i: t if cut[i] and len(cut[i]) < len(kept[i].split("\n")) else kept[i] for i, t in docs.items()}
    root = components(docs, linked_texts(docs))
    docs = {i: t for i, t in docs.items() if root[i] == i}
    item = passage.split(" ")
    docs = {i: t for i, t in docs.items() if not any(" ".join(item[k : k + 8]) in " ".join(t.split()) for k in range(len(item) - 7))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == docs and len(got) == len(docs)
    assert {50, 51, 54, 55, 56, 57}.isdisjoint(docs) and {3, 4, 52, 53} <= set(docs)
    model = sentencepieces.load()
    import numpy as np

    for r in got:
        assert r["lossless"] and r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"])
        assert sentencepieces.decode(model, np.array(r["ids"])) == r["text"]


def test_recall_of_lines(spark):
    """Classes of 3,000 lines: variants of 500 lines with a few characters changed, against all pairs of similarity 0.8 or more."""
    rnd = random.Random(5)
    lines = {}
    for b in range(500):
        base = " ".join(words(rnd, "en", rnd.randint(2, 30)))
        for v in range(6):
            t = list(base)
            for _ in range(v * len(t) // 400 + (v > 0)):
                t[rnd.randrange(len(t))] = "x"
            lines[b * 6 + v] = "".join(t).strip()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in lines.items()], DOCS)
    got = {r["doc_id"]: r["first_doc"] for r in linededup.classed_lines(docs).collect()}
    pairs = linked_lines(lines)
    same = collections.defaultdict(list)
    for i, t in lines.items():
        same[t].append(i)
    root = components(lines, pairs + [(g[0], i) for g in same.values() for i in g[1:]])
    assert len(pairs) > 1000 and sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(root[i] == root[f] for i, f in got.items())


def test_recall_of_documents(spark):
    """Classes of 2,000 documents: variants of 400 texts with words changed, against all pairs of weighted similarity 0.8 or more."""
    rnd = random.Random(6)
    texts = {}
    for b in range(400):
        base = words(rnd, "de", rnd.randint(20, 150))
        for v in range(5):
            t = list(base)
            for _ in range(v * len(t) // 300 + (v > 0)):
                t[rnd.randrange(len(t))] = "anders"
            texts[b * 5 + v] = " ".join(t)
    docs = spark.createDataFrame([(i, t, "de", "s", 0) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    pairs = linked_texts(texts)
    root = components(texts, pairs)
    assert len(pairs) > 500 and sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert all(root[i] == root[c] for i, c in got.items())
