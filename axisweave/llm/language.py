"""Language identification as a mixture: each document is a blend of languages, fitted by expectation-maximisation.

A language's model is a table of byte n-gram log-likelihoods (n = 1 to 3, interpolated by sum, hashed into ``buckets``).
A word's likelihood under a language is the mean over its n-grams, raised to ``sharpness``; EM over the words gives the
proportions, and forward selection by penalised likelihood (BIC) the set of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from axisweave.llm.common import pieces, prepare, text_buffers

PREDICTED = "lang_pred string, score double, languages array<string>, proportions array<double>"
NAMES = ["lang_pred", "score", "languages", "proportions"]
#: Letters beyond ASCII begin with these bytes; punctuation and symbols (C2 80-BF, E2 80-BF ..) are weeded by is_letter().
BUCKETS = 1 << 16


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, row) of runs of ASCII letters and non-ASCII bytes."""
    low = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    ok = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    if not len(data):
        return low, *(np.zeros(0, np.int64),) * 3
    start = np.flatnonzero(ok & (~np.append(False, ok[:-1]) | edge[:-1]))
    end = np.flatnonzero(ok & (~np.append(ok[1:], False) | edge[1:])) + 1
    return low, start, end, np.searchsorted(off, start, side="right") - 1


def grams(low: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the 2- and 3-grams of each word, which is framed by a blank on both sides."""
    size = end - start + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    framed = np.full(total + 2, 0x20, np.uint32)
    word = np.repeat(np.arange(len(start)), size)
    within = np.arange(total) - np.repeat(first, size)
    inner = np.flatnonzero((within > 0) & (within < size[word] - 1))
    framed[inner] = low[within[inner] - 1 + np.repeat(start, size)[inner]]
    three = (framed[:total] << np.uint32(16)) | (framed[1 : total + 1] << np.uint32(8)) | framed[2:]
    two = three >> np.uint32(8)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    has2, has3 = within < size[word] - 1, within < size[word] - 2
    h = np.concatenate([(two[has2] * np.uint32(2654435761)) >> shift, ((three[has3] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift])
    return h, np.concatenate([word[has2], word[has3]])


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # float32 [buckets, languages]: log-likelihood, less the mean over languages
    sharpness: float = 3.0

    def word_likelihoods(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """[words, languages]: relative likelihood of each word; the best language has 1."""
        h, word = grams(low, start, end, len(self.table))
        n = np.bincount(word, minlength=len(start)).astype(np.float32)
        ll = np.stack([np.bincount(word, weights=self.table[h, k], minlength=len(start)) for k in range(len(self.names))], 1).astype(np.float32)
        ll *= self.sharpness / np.sqrt(n)[:, None]
        return np.exp(np.maximum(ll - ll.max(1, keepdims=True), -12))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 6000, max_bytes: int = 12_000_000, buckets: int = BUCKETS) -> Model:
    """Learn the n-gram tables from labelled documents.

    Bounds (documented parameters): a sample of at most max_docs labelled rows, those of the smallest hashes of the key, cut off at
    max_bytes of text. Rows with a null or empty language or text are not used.
    """
    labelled = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    chosen = labelled.select("k").orderBy(F.xxhash64("k"), "k").limit(max_docs)
    rows = labelled.join(F.broadcast(chosen.distinct()), "k").orderBy(F.xxhash64("k"), "k", "l", "t").limit(max_docs)
    counts: dict[str, np.ndarray] = {}
    held = 0
    for r in rows.toLocalIterator():
        data, off = text_buffers(pa.array([r["t"]], pa.string()))
        low, start, end, _ = words(data, off)
        h, _ = grams(low, start, end, buckets)
        counts.setdefault(r["l"], np.zeros(buckets))
        counts[r["l"]] += np.bincount(h, minlength=buckets)
        held += len(data)
        if held > max_bytes:
            break
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((buckets, 0), np.float32))
    table = np.stack([np.log((counts[n] + 0.5) / (counts[n].sum() + 0.5 * buckets)) for n in names], 1)
    return Model(names, (table - table.mean(1, keepdims=True)).astype(np.float32))


def blend(like: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: (proportions, log-likelihood) with the languages allowed in each. Every n is over 0."""
    doc = np.repeat(np.arange(len(n)), n)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        post = like * share.astype(np.float32)[doc]
        total = post.sum(1)
        post /= total[:, None]
        share = np.add.reduceat(post, first, axis=0, dtype=np.float64) / n[:, None]
    total = (like * share.astype(np.float32)[doc]).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30), dtype=np.float64), first)


def infer(model: Model, column: pa.Array, steps: int = 8, penalty: float = 1.0) -> list[tuple]:
    """(language, score, languages, proportions) of each text.

    Languages join in the order of their share in the full mixture, as long as each lowers BIC =
    -2 log-likelihood + penalty * (languages - 1) * ln(words). The prediction is the largest share.
    """
    data, off = text_buffers(column)
    low, start, end, row = words(data, off)
    rows, n = np.unique(row, return_counts=True)
    out: list[tuple] = [("und", 0.0, [], [])] * len(column)
    if not len(rows) or not model.names:
        return out
    first, size, m = np.cumsum(n) - n, n.astype(np.float64), len(model.names)
    like = model.word_likelihoods(low, start, end)
    share, _ = blend(like, first, n, np.ones((len(rows), m)), steps)
    order = np.argsort(-share, axis=1, kind="stable")
    allowed = np.zeros((len(rows), m))
    at = np.arange(len(rows))
    allowed[at, order[:, 0]] = 1
    kept, ll = blend(like, first, n, allowed, 1)
    going = at
    for k in range(1, m):
        going = going[share[going, order[going, k]] > 0.01]
        if not len(going):
            break
        words_of = np.repeat(first[going] - (np.cumsum(n[going]) - n[going]), n[going]) + np.arange(n[going].sum())
        more = allowed[going].copy()
        more[np.arange(len(going)), order[going, k]] = 1
        got, new = blend(like[words_of], np.cumsum(n[going]) - n[going], n[going], more, steps)
        better = 2 * (new - ll[going]) > penalty * np.log(size[going] + 1)
        took = going[better]
        allowed[took], kept[took], ll[took] = more[better], got[better], new[better]
        going = took
    for r, s in zip(rows.tolist(), kept, strict=True):
        best = np.argsort(-s, kind="stable")
        best = [int(b) for b in best if s[b] > 0]
        out[r] = (model.names[best[0]], float(s[best[0]]), [model.names[b] for b in best], [float(s[b]) for b in best])
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)


def identified(part: pa.RecordBatch, at: int, model: Model) -> list[pa.Array]:
    """The columns of NAMES for the texts in column ``at``."""
    letter = has_letter(part.column(at))
    found = [f if ok else ("und", 0.0, [], []) for f, ok in zip(infer(model, part.column(at)), letter, strict=True)]
    return [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the languages of every whole text: lang_pred (largest share), score (that share), languages and proportions.

    ``und`` with score 0 for null texts and texts with no letter. Long texts are taken whole; the model (a table of
    buckets x languages floats) is broadcast. Columns of docs with these names are replaced; every row is kept as it is.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*NAMES)
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(PREDICTED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 2_000_000):
                yield pa.RecordBatch.from_arrays([*part.columns, *identified(part, at, sent.value)], [*part.schema.names, *NAMES])

    return kept.mapInArrow(run, schema)


def fold(key: str, of: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def predict_languages(docs: DataFrame) -> DataFrame:
    """op9's rows: learn where crc32(doc_id) mod 4 is not 2, then predict every document."""
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).drop("text").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
