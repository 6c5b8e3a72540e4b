"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard verification and distributed union-find.

Signatures are one-permutation MinHash: a shingle's hash names a bin and a value, a bin keeps its least value, and an empty bin takes
that of the first filled one in a fixed random order of its own (optimal densification, Shrivastava 2017), so that the bins of a band
stay independent in short lines. Buckets are gathered in two steps: where a batch has a bucket more than LOCAL times, its rows are paired
with a leader of the batch at once and the leader alone goes on, so a bucket that a third of all lines share sends at most LOCAL rows from
each batch to the task of that bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import GOLDEN, U64, as_long, clear_shuffles, mix, pieces, prepare, store, store_bucketed, text_buffers
from axisweave.llm.linking import block_pairs, verified_links

SHINGLE, SIMILARITY = 5, 0.8
#: 12 bands of 5 bins: a pair of similarity 0.8 shares a band with probability 0.99, one of 0.85 with 0.999.
BANDS, DEPTH = 12, 5
#: Of the bins that are filled in one of both lines, 60 at most, a pair of similarity 0.8 agrees in this share with probability 0.99999 or more.
LEAST_AGREEMENT = 0.58
#: Rows of a bucket in a batch from which they are paired there.
LOCAL = 8
#: The bitmap that tells candidate lines when their texts are gathered has some 16 bits a line, 2^MOST_BITS at most.
MOST_BITS = 28
#: Bytes of text that are hashed at a time, so that scratch arrays stay in the processor's cache.
SLICE = 500_000
#: Marks of a line, by which pairs that can't be alike are told before their shingles are compared.
MARKS = 1024
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
EMPTY = np.uint32(0xFFFFFFFF)
TRIES = np.random.default_rng(7).integers(0, BANDS * DEPTH, (64, BANDS * DEPTH))


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row, number) of every line, with white space at both ends cut off (the end isn't below the start)."""
    data, off = text_buffers(column)
    cut = np.flatnonzero(data == 10)
    n = len(off) - 1
    count = np.bincount(np.searchsorted(off, cut, side="right") - 1, minlength=n) + 1
    row = np.repeat(np.arange(n), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start, end = np.sort(np.concatenate([off[:-1], cut + 1])), np.sort(np.concatenate([off[1:], cut]))
    left = right = np.arange(len(row))
    for _ in range(32):
        left = left[start[left] < end[left]]
        left = left[WHITE[data[start[left]]]]
        start[left] += 1
        right = right[start[right] < end[right]]
        right = right[WHITE[data[end[right] - 1]]]
        end[right] -= 1
    for i in np.union1d(left, right):  # longer runs of white space
        raw = data[start[i] : end[i]].tobytes()
        start[i] += len(raw) - len(raw.lstrip(b"\t\n\v\f\r "))
        end[i] = start[i] + len(raw.strip(b"\t\n\v\f\r "))
    return data, start, end, row, number


def line_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit id of each line; 0 for blank lines."""
    raw = data.tobytes()
    found = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], U64)
    return np.where(end > start, found | U64(1), U64(0))


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end): the lines' ends counted in characters."""
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(chars) == len(data):
        return chars, start, end
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars, lead[start], lead[end]


def rolled(chars: np.ndarray, kind: type, k: int = SHINGLE) -> np.ndarray:
    """An unmixed hash of the k characters from each place on, in unsigned integers of the kind."""
    n = max(len(chars) - k + 1, 0)
    chars = chars.astype(kind)
    out, more = np.zeros(n, kind), np.empty(n, kind)
    with np.errstate(over="ignore"):
        for j in range(k):
            np.multiply(chars[j : j + n], kind(FACTORS[j] if kind is np.uint32 else FACTORS[j] * 0x9E3779B97F4A7C15 & (1 << 64) - 1), out=more)
            out += more
    return out


def low_values(data: np.ndarray, start: np.ndarray, end: np.ndarray, bins: int = BANDS * DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lines that have a shingle, [lines, bins] uint32): the least value of each bin, EMPTY where there is none."""
    chars, a, b = characters(data, start, end)
    h = rolled(chars, np.uint32)
    with np.errstate(over="ignore"):
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39), (15, 1)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
    count = np.maximum(b - a - SHINGLE + 1, 0)
    has = np.flatnonzero(count)
    m, a, count = len(has), a[has], count[has]
    # every place of the text goes to its line's bins, or to spare ones after the last line's
    run, line = np.zeros(2 * m + 1, np.int64), np.full(2 * m + 1, m * bins)
    run[1::2], line[1::2] = count, np.arange(m) * bins
    run[0::2] = np.diff(np.concatenate([[0], np.stack([a, a + count], 1).reshape(-1), [len(h)]]))[0::2]
    at = np.repeat(line, run)
    with np.errstate(over="ignore"):
        at += (h >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
        value = np.minimum(h * np.uint32(FACTORS[0]), EMPTY - np.uint32(1))
    low = np.full((m + 1) * bins, EMPTY, np.uint32)
    np.minimum.at(low, at, value)
    return has, low[: m * bins].reshape(m, bins)


def densified(low: np.ndarray) -> np.ndarray:
    out = low.copy()
    row, i = np.nonzero(low == EMPTY)
    for order in TRIES:
        value = low[row, order[i]]
        ok = value != EMPTY
        out[row[ok], i[ok]] = value[ok]
        row, i = row[~ok], i[~ok]
    out[row, i] = low[row, np.argmax(low != EMPTY, axis=1)[row]] if len(row) else 0
    return out


def own_bins(low: np.ndarray) -> np.ndarray:
    """[n, bins] uint16 of the bins that a line fills itself; 0 where it has none."""
    with np.errstate(over="ignore"):
        return np.where(low == EMPTY, 0, np.maximum(low * np.uint32(FACTORS[1]) >> np.uint32(16), 1)).astype(np.uint16)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, DEPTH).astype(U64)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(DEPTH):
            key = mix(key * GOLDEN + parts[:, :, i] + U64(1))
    return key


def by_bucket(bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of the bucket, its leader (the least hash of the id, so that alike buckets have one leader) and its number of rows."""
    order = np.lexsort((mix(ids), bucket))
    bucket, ids = bucket[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])
    bucket, ids = bucket[new], ids[new]
    head = np.ones(len(ids), bool)
    head[1:] = bucket[1:] != bucket[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(ids)))
    return bucket, ids, np.repeat(ids[at], size), np.repeat(size, size)


def first_leaders(docs: DataFrame, groups: int) -> DataFrame:
    """(bucket, id, leader) of the lines that share a bucket with another line."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = [], []
            for part in pieces(batch, "text", SLICE):
                data, start, end, _, _ = lines(part.column(0))
                every = line_ids(data, start, end)
                found, one = np.unique(every, return_index=True)
                one = np.sort(one[found != 0])
                has, low = low_values(data, start[one], end[one])
                own.append(every[one[has]])
                keys.append(band_keys(densified(low)))
            if not own:
                continue
            ids, first = np.unique(np.concatenate(own), return_index=True)
            # a bucket is its group, above 32 bits of the key, which alone are sent: buckets that meet so propose a few pairs more
            key = np.concatenate(keys)[first].reshape(-1)
            bucket, ids, leader, size = by_bucket((key >> U64(32)) % U64(groups) << U64(32) | key & U64(0xFFFFFFFF), np.repeat(ids, BANDS))
            sent, crowd = (size <= LOCAL) | (ids == leader), (size > LOCAL) & (ids != leader)
            # members are grouped by the bucket; pairs made here need no company and are dealt out by the id
            blobs = []
            members = ids[sent], bucket[sent].astype(np.uint32)
            for rows, by in ((members, bucket[sent]), ((bucket[crowd], ids[crowd], leader[crowd]), mix(ids[crowd]))):
                g = (by >> U64(32)).astype(np.int64) % groups
                order = np.argsort(g, kind="stable")
                rows, edge = [r[order] for r in rows], np.searchsorted(g[order], np.arange(groups + 1))
                blobs.append([b"".join(r[edge[i] : edge[i + 1]].tobytes() for r in rows) if edge[i] < edge[i + 1] else b"" for i in range(groups)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], ["g", "members", "crowd"])

    def across(table: pa.Table) -> pa.Table:
        crowd = np.concatenate([np.frombuffer(x, U64).reshape(3, -1) for x in table["crowd"].to_pylist()], axis=1)
        sent = table["members"].to_pylist()
        ids = np.concatenate([np.frombuffer(x, U64, len(x) // 12) for x in sent])
        low = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8) for x in sent])
        bucket, ids, leader, _ = by_bucket(U64(table["g"][0].as_py()) << U64(32) | low.astype(U64), ids)
        follows = ids != leader
        out = np.concatenate([crowd, np.stack([bucket[follows], ids[follows], leader[follows]])], axis=1)
        return pa.table([as_long(np.ascontiguousarray(x)) for x in out], names=["bucket", "id", "leader"])

    sent = docs.select("text").mapInArrow(local, "g int, members binary, crowd binary").where("length(members) + length(crowd) > 0")
    return sent.groupBy("g").applyInArrow(across, "bucket long, id long, leader long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the lines in ids (one column id, distinct). A bitmap of some 16 bits an id, 2^MOST_BITS at most, keeps most other lines from being sent."""
    bits = min(MOST_BITS, max(16, ids.count().bit_length() + 4))
    marks = ids.selectExpr(f"pmod(shiftrightunsigned(id, 8), {1 << bits}) as p").selectExpr("cast(p div 64 as int) as w", "shiftleft(1L, cast(p % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros((1 << bits) // 64, U64)
    for part in marks.toLocalIterator(prefetchPartitions=True):  # 2^bits / 64 rows at most
        bitmap[part["w"]] = U64(part["b"] & 0xFFFFFFFFFFFFFFFF)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, start, end, _, _ = lines(part.column(0))
                own, one = np.unique(line_ids(data, start, end), return_index=True)
                place = own >> U64(8) & U64((1 << bits) - 1)
                hit = (own != 0) & ((sent.value[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([as_long(own[hit]), pa.array([raw[start[i] : end[i]].decode() for i in one[hit]], pa.string())], ["id", "line"])

    return docs.select("text").mapInArrow(run, "id long, line string").join(ids, "id").groupBy("id").agg(F.first("line").alias("line"))


def shingle_keys(column: pa.Array) -> np.ndarray:
    """The distinct shingles of a column's lines, each with its line's number above it, in order; a line of fewer characters has none."""
    data, off = text_buffers(column)
    chars, a, b = characters(data, off[:-1], off[1:])
    count = np.maximum(b - a - SHINGLE + 1, 0)
    line = np.repeat(np.arange(len(a)), count)
    at = np.arange(len(line)) + np.repeat(a - (np.cumsum(count) - count), count)
    key = line.astype(U64) << U64(44) | mix(rolled(chars, U64))[at] >> U64(20)
    key.sort()
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def line_jaccard(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Jaccard similarity of the shingle sets of the lines of two columns, row by row; lines without shingles are alike if equal."""
    keys = [shingle_keys(c) for c in (x, y)]
    count = lambda k: np.bincount((k >> U64(44)).astype(np.int64), minlength=len(x))
    every = np.sort(np.concatenate(keys), kind="stable")  # two runs in order
    both = count(every[:-1][every[1:] == every[:-1]])
    union = count(keys[0]) + count(keys[1]) - both
    equal = np.array([a == b for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], float) if (union == 0).any() else 0.0
    return np.where(union > 0, both / np.maximum(union, 1), equal)


def marked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """([lines, MARKS] bool, places): the marks that the shingles of each line hit, and the places of shingles in it, repeated ones included."""
    data, off = text_buffers(column)
    chars, a, b = characters(data, off[:-1], off[1:])
    count = np.maximum(b - a - SHINGLE + 1, 0)
    at = np.arange(int(count.sum())) + np.repeat(a - (np.cumsum(count) - count), count)
    with np.errstate(over="ignore"):
        mark = rolled(chars, np.uint32) * np.uint32(FACTORS[2]) >> np.uint32(32 - MARKS.bit_length() + 1)
    out = np.zeros(len(a) * MARKS, bool)
    out[np.repeat(np.arange(len(a)) * MARKS, count) + mark[at]] = True
    return out.reshape(-1, MARKS), count


def may_be_alike(x: pa.Array, y: pa.Array, similarity: float) -> np.ndarray:
    """Whether the lines of two columns can have the similarity, row by row; exact in those that can't.

    Two sets that have it differ in (1 - similarity) / similarity shingles at most for each of the smaller one, and every mark that one of
    them hits alone is hit by a shingle that the other lacks. Lines without shingles aren't told apart.
    """
    coded = y.dictionary_encode()  # a line that many rows have is marked once
    (left, n), (right, m), of = marked(x), marked(coded.dictionary), coded.indices.to_numpy()
    least = np.minimum(n, m[of])
    apart = np.count_nonzero(left != right[of], axis=1)
    return (least == 0) | (apart * similarity <= (1 - similarity) * least + 1e-6)


def line_elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct shingles of a column's lines."""
    key = shingle_keys(column)
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1)


def classed_lines(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, first_doc, first_line, kept): a row for every line; lines of one class are equal or linked by pairs of
    similarity or more, and the first (by doc_id, then line number from 0) is kept.

    Lines are split at line feeds and compared without white space at their ends. Blank lines are kept and have no class (first_* null).
    A null text is one blank line. A line shorter than the shingle is only like an equal one. Null keys come first.
    Rows that repeat a key are one document: lines at one place of it are kept or removed together.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, start, end, row, number = lines(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), as_long(line_ids(data, start, end))], ["doc_id", "line_no", "id"])

    listed = store(base.mapInArrow(ids_of, "doc_id long, line_no int, id long"))
    groups = max(1024, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    led = store(first_leaders(base, groups))
    clear_shuffles(docs.sparkSession)
    # in buckets by the id, so that the joins of all rounds move ids to the texts, not the texts
    texts = store_bucketed(texts_of(base, store(led.select(F.explode(F.array("id", "leader")).alias("id")).distinct())), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    clear_shuffles(docs.sparkSession)

    def verify(pairs: DataFrame) -> DataFrame:
        x = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
        both = x.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b").select("a", "b", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "x", SLICE):
                    part = part.filter(pa.array(may_be_alike(part.column(2), part.column(3), similarity)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(line_jaccard(part.column(2), part.column(3)))], ["a", "b", "like"])

        return both.mapInArrow(run, "a long, b long, like double").where(F.col("like") >= similarity)

    def rest(members: DataFrame) -> DataFrame:
        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "line", SLICE):
                    data, off = text_buffers(part.column(1))
                    has, low = low_values(data, off[:-1], off[1:])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(has)), pa.array([x.tobytes() for x in own_bins(low)], pa.binary())], ["id", "signature"])

        own = store(texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(sign, "id long, signature binary"))
        return block_pairs(members, own, LEAST_AGREEMENT, 0, similarity, lambda ids: texts.join(ids, "id").select("id", F.col("line").alias("text")), line_elements)

    _, root = verified_links(None, verify, similarity, rest, led)
    place: Column = F.struct("doc_id", "line_no")
    firsts = listed.where("id <> 0").groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    classed = store(firsts.join(root, "id", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "id")))
    heads = classed.groupBy("root").agg(F.min("first").alias("head"))
    of_id = classed.join(heads, "root").select("id", "head")
    out = listed.join(of_id, "id", "left")
    head = F.when(F.col("id") != 0, F.coalesce("head", place))
    return out.select("doc_id", "line_no", head["doc_id"].alias("first_doc"), head["line_no"].alias("first_line"), F.coalesce(head == place, F.lit(True)).alias("kept"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with the lines that aren't kept cut out of the text. A document that loses all its lines goes; null and empty texts stay."""
    gone = classed_lines(docs, key=key, text=text, **more).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_doc")
    joined = docs.join(gone, docs[key].eqNullSafe(gone["_doc"]), "left")
    rest = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("_gone", i))
    cut = joined.withColumn("_rest", F.when(F.col("_gone").isNotNull(), rest))
    cut = cut.where("_rest is null or exists(_rest, x -> trim(x) <> '')")
    return cut.withColumn(text, F.when(F.col("_rest").isNull(), F.col(text)).otherwise(F.array_join("_rest", "\n"))).select(*docs.columns)
