"""Near-duplicate documents by DartMinHash (Christiani, 2020) over weighted word shingles.

An element of weight w holds w unit regions; each region's darts land at the times of a unit-rate Poisson process that a hash of
(element, region) drives, so equal regions throw equal darts in every document. A dart goes to one of k coordinates, which
keeps its earliest dart: two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Only
darts up to time t / total weight, t = k (ln k + 2), are thrown at first, about t a document whatever its length; documents with
an empty coordinate are done again with more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import GOLDEN, U64, among, as_long, mix, pieces, prepare, rolling, store, text_buffers, word_hashes
from axisweave.llm.linking import block_pairs, verified_links

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 6 coordinates: a pair of similarity 0.8 shares a band with probability 0.9993, and 6 bands on average.
BANDS, DEPTH = 24, 6
#: Of the 144 coordinates a pair of similarity 0.8 agrees in this share with probability 0.999996.
LEAST_AGREEMENT = 0.65


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, weight) of each text's distinct shingles, ordered by row and hash; a text of fewer words is one shingle."""
    h, row = word_hashes(column)
    whole, at = rolling(h, row, k)
    rows = row[at]
    n = np.bincount(row, minlength=len(column))
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            short = np.array([np.bitwise_xor.reduce(h[first[r] : first[r] + n[r]] * (np.arange(n[r]).astype(U64) * U64(2) + GOLDEN)) for r in few], U64)
        whole, rows = np.concatenate([whole, mix(short)]), np.concatenate([rows, few])
    bits = U64(44)
    key, weight = np.unique(rows.astype(U64) << bits | whole >> U64(20), return_counts=True)
    return key & U64((1 << 44) - 1), (key >> bits).astype(np.int64), weight


def dart_minhash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """[rows, k] uint64: in each coordinate a dart (its low 32 bits name it); rows without elements keep the maximum."""
    top = U64(np.iinfo(np.uint64).max)
    out = np.full((rows, k), top, U64)
    # a region for each unit of weight
    unit = np.repeat(np.arange(len(h)), weight)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        region = mix(h[unit] * GOLDEN + nth.astype(U64) * U64(0xD1342543DE82EF95) + U64(1))
    owner = row[unit]
    total = np.bincount(owner, minlength=rows)
    reach = k * (np.log(k) + 2)
    todo = np.flatnonzero(total)
    while len(todo):
        limit = np.zeros(rows)
        limit[todo] = reach / total[todo]
        live = np.flatnonzero(limit[owner] > 0)
        out[todo] = top
        time, i = np.zeros(len(live)), 1
        flat = out.reshape(-1)
        while len(live):
            with np.errstate(over="ignore"):
                dart = mix(region[live] + U64(i) * GOLDEN)
            time = time - np.log(((dart >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = time <= limit[owner[live]]
            live, time, dart = live[hit], time[hit], mix(dart[hit])
            own = owner[live]
            rank = (time / limit[own] * (2**32 - 2)).astype(U64)
            np.minimum.at(flat, own * k + (dart % U64(k)).astype(np.int64), rank << U64(32) | dart >> U64(32))
            i += 1
        todo = todo[(out[todo] == top).any(axis=1)]
        reach *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """[rows, bands] uint64 of a [rows, bands * depth] signature."""
    named = (signature & U64(0xFFFFFFFF)).reshape(len(signature), bands, depth)
    key = np.broadcast_to(np.arange(bands, dtype=U64), (len(signature), bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(depth):
            key = mix(key * GOLDEN + named[:, :, i] + U64(1))
    return key


def text_id(column: pa.Array) -> np.ndarray:
    """A 64-bit id of each text's word sequence, odd; of a text without words an even one of its own bytes (null: as the empty text)."""
    h, row = word_hashes(column)
    n = np.bincount(row, minlength=len(column))
    out = np.zeros(len(column), U64)
    if len(h):
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            within = (np.arange(len(h)) - np.repeat(first, n)).astype(U64)
            parts = mix(h + within * GOLDEN)
            has = np.flatnonzero(n)
            out[has] = mix(np.add.reduceat(parts, first[has]) + n[has].astype(U64)) | U64(1)
    data, off = text_buffers(column)
    raw = data.tobytes()
    for r in np.flatnonzero(n == 0).tolist():
        out[r] = U64(xxhash.xxh3_64_intdigest(raw[off[r] : off[r + 1]]) & ~1)
    return out


def weighted_jaccard(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two columns, row by row."""
    sides, total = [], np.zeros(len(x), np.int64)
    for c in (x, y):
        h, row, weight = shingles(c)
        sides.append((row.astype(U64) << U64(44) | h, weight))
        total += np.bincount(row, weights=weight, minlength=len(x)).astype(np.int64)
    (a, wa), (b, wb) = sides
    key, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = np.bincount((key >> U64(44)).astype(np.int64), weights=np.minimum(wa[i], wb[j]), minlength=len(x)).astype(np.int64)
    return np.where(total > 0, low / np.maximum(total - low, 1), 1.0)


def text_elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of a column's weighted shingles, a shingle of weight w as w keys: the Jaccard similarity of these sets is the weighted one."""
    h, row, weight = shingles(column)
    unit = np.repeat(np.arange(len(h)), weight)
    nth = (np.arange(len(unit)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(U64)
    with np.errstate(over="ignore"):
        return row[unit], mix(h[unit] * GOLDEN + nth)


def classes(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): documents of one class are linked by chains of pairs with weighted Jaccard >= similarity.

    class_id is the smallest doc_id of the class; n_links counts the document's verified links with other texts (copies are one
    text: equal word sequences are one class and are represented once). Texts without words (empty, signs only) are alike only if equal, null and empty ones among them. A
    row with a null key is left out; rows that repeat a key count as one document, under its smallest text id.
    """
    prepare(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 8_000_000):
                h, row, weight = shingles(part.column(1))
                signature = dart_minhash(h, row, weight, part.num_rows, BANDS * DEPTH)
                keys = band_keys(signature, BANDS, DEPTH)
                short = [x.tobytes() for x in signature.astype(np.uint16)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), as_long(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), as_long(text_id(part.column(1))), flat, pa.array(short, pa.binary())], ["doc_id", "same", "bands", "signature"])

    base = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = store(base.mapInArrow(sign, "doc_id long, same long, bands array<long>, signature binary"))
    one = signed.groupBy("doc_id").agg(F.min("same").alias("same"))
    # copies: the smallest id stands for all; counted before the shuffle
    stands = store(signed.groupBy("same").agg(F.min("doc_id").alias("id")))
    kept = signed.join(stands, (signed["doc_id"] == stands["id"]) & (signed["same"] == stands["same"]), "left_semi").where("same % 2 <> 0").dropDuplicates(["doc_id"])
    buckets = kept.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"))
    signatures = kept.select(F.col("doc_id").alias("id"), "signature")

    def texts_of(ids: DataFrame) -> DataFrame:
        return among(base, "doc_id", ids.select("id").distinct()).groupBy("doc_id").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "id")

    def verify(pairs: DataFrame) -> DataFrame:
        texts = store(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id"))))
        x = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        both = x.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "x"):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(weighted_jaccard(part.column(2), part.column(3)))], ["a", "b", "like"])

        return both.mapInArrow(run, "a long, b long, like double").where(F.col("like") >= similarity)

    def rest(members: DataFrame):
        own = store(signatures.join(members.select("id").distinct(), "id", "left_semi"))
        return block_pairs(members, own, LEAST_AGREEMENT, None, similarity, texts_of, text_elements)

    links, root = verified_links(buckets, verify, similarity, rest)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    named = stands.join(root, "id", "left").join(degree, "id", "left").select("same", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return one.join(named, "same").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with one document of each class, that of the smallest key. Rows with a null key stay; of rows that repeat a key, all or none."""
    gone = classes(docs, key=key, text=text, **more).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
