"""Toxicity by a factorization machine (Rendle, 2010) over hashed terms.

Terms are the distinct words of a text and their prefixes of 4, 6 and 8 bytes, each again if it occurs 2 or 4 times, hashed into
buckets. The buckets that tell the labels apart best in the training sample are kept; the machine learns a weight and a vector for
each, so that pairs of terms (an insult with a group's name) count beyond the sum of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import U64, mix, pieces, prepare, span_hashes, text_buffers, word_spans
from axisweave.llm.language import fold

#: Bytes of the prefixes that count as terms besides whole words, and how often a term must occur to count again.
PREFIXES = (4, 6, 8)
LEVELS = (2, 4)


def terms(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the distinct hashed terms of each text, ordered by row. A term seen 2 or 4 times is further terms."""
    data, off = text_buffers(column)
    low, start, end, row = word_spans(data, off)
    keys = [(span_hashes(low, start, end), row)]
    for n in PREFIXES:
        at = end - start > n
        keys.append((span_hashes(low, start[at], start[at] + n) * U64(2 * n + 1), row[at]))
    h, rows = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
    key, count = np.unique(rows.astype(U64) << U64(44) | h >> U64(20), return_counts=True)
    again = [mix(key[count >= n] & U64((1 << 44) - 1) ^ U64(n << 50)) for n in LEVELS]
    h = np.concatenate([mix(key & U64((1 << 44) - 1)), *again]) >> U64(64 - bits)
    rows = np.concatenate([key, *[key[count >= n] for n in LEVELS]]) >> U64(44)
    key = np.unique(rows << U64(bits) | h)
    return (key & U64((1 << bits) - 1)).astype(np.int64), (key >> U64(bits)).astype(np.int64)


@dataclass
class Machine:
    bits: int
    slot: np.ndarray  # int32 [buckets]: place among the kept terms, -1 if not kept
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, slot: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """slot and row ordered by row."""
        out = np.full(n, self.bias)
        if len(row):
            rows, first = np.unique(row, return_index=True)
            x = self.v[slot]
            s, s2 = np.add.reduceat(x, first), np.add.reduceat(x * x, first)
            out[rows] += np.add.reduceat(self.w[slot], first) + 0.5 * (s * s - s2).sum(1)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        bucket, row = terms(column, self.bits)
        slot = self.slot[bucket]
        kept = slot >= 0
        return 1 / (1 + np.exp(-np.clip(self.logits(slot[kept], row[kept], len(column)), -30, 30)))


def train(texts: list[np.ndarray], y: np.ndarray, bits: int, kept: int = 4096, rank: int = 8, epochs: int = 12, min_steps: int = 600, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; both labels weigh alike; small samples get more epochs, up to min_steps batches. texts: the buckets of each."""
    size = 1 << bits
    pos, neg = np.zeros(size), np.zeros(size)
    for t, label in zip(texts, y, strict=True):
        (pos if label else neg)[t] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    z = np.where(pos + neg >= 3, np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)), 0)
    best = np.argsort(-z, kind="stable")[:kept]
    best = np.sort(best[z[best] >= 2])  # about two standard errors
    slot = np.full(size, -1, np.int32)
    slot[best] = np.arange(len(best))
    rng = np.random.default_rng(seed)
    m = Machine(bits, slot, 0.0, np.zeros(len(best)), rng.normal(0, 0.02, (len(best), rank)))
    gw, gv, gb = np.full(len(best), 1e-3), np.full((len(best), rank), 1e-3), 1e-3
    docs = [(s := slot[t])[s >= 0] for t in texts]
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    epochs = max(epochs, min_steps * 128 // max(len(docs), 128))
    for _ in range(epochs if len(best) and 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            n = np.array([len(docs[i]) for i in part])
            s, row = np.concatenate([docs[i] for i in part]), np.repeat(np.arange(len(part)), n)
            p = 1 / (1 + np.exp(-np.clip(m.logits(s, row, len(part)), -30, 30)))
            g = (p - y[part]) * weight[part] / 128
            dense = np.zeros((len(part), rank))
            np.add.at(dense, row, m.v[s])
            dw, dv = np.zeros_like(m.w), np.zeros_like(m.v)
            np.add.at(dw, s, g[row])
            np.add.at(dv, s, g[row, None] * (dense[row] - m.v[s]))
            used = np.unique(s)
            dw, dv = dw[used] + decay * m.w[used], dv[used] + decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_each: int = 6000, bits: int = 20, **more) -> Machine:
    """Learn from labelled documents.

    Bound (a documented parameter): at most max_each documents of either label, those of the smallest hashes of the key. A document
    labelled twice counts by its largest label; null labels and keys aren't used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    take = lambda v: known.where(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(max_each)
    chosen = take(0).unionByName(take(1))  # 2 * max_each rows

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                bucket, row = terms(part.column(2), bits)
                found = np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f.tobytes() for f in found], pa.binary())], ["k", "y", "buckets"])

    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select(F.col("k").cast("long").alias("k"), "y", "text")
    rows = list(picked.mapInArrow(hashed, "k long, y int, buckets binary").toLocalIterator())
    rows.sort(key=lambda r: (r["k"], r["buckets"]))
    return train([np.frombuffer(r["buckets"], np.int32) for r in rows], np.array([r["y"] for r in rows], np.int64), bits, **more)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Of every whole text: score (0 to 1) and predicted (score >= threshold). Null and empty texts score by the bias alone."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7's rows: learn where crc32(doc_id) mod 3 is not 1, then score every document."""
    machine = fit(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, machine).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
