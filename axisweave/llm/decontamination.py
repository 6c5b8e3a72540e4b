"""Benchmark decontamination with suffix arrays over the training text.

Each slice of training documents (a few MB) gets a word-level suffix array, sorted by prefix doubling up to the window;
every test suffix is binary-searched in it. No row is shuffled: a slice is searched where it is read, and the test set
comes in blocks of bounded size. Words follow the rule in ``common``; suffixes end with their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import U64, pieces, prepare, store, word_hashes

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, longest_words int, longest_item string, longest_doc_word int, longest_item_word int"


class SuffixArray:
    """Suffixes of the rows' word sequences, ordered by their first ``depth`` words (the end of a row comes first)."""

    def __init__(self, h: np.ndarray, row: np.ndarray, depth: int):
        n = self.n = len(h)
        self.bits = U64(max(1, int(n + 1).bit_length()))
        self.row, self.shift = row, self.bits
        at = np.arange(n, dtype=U64)
        wide = int(self.bits) > 21
        packed = np.sort((h >> self.bits) << self.bits | at)
        mask = (U64(1) << self.bits) - U64(1)
        self.symbols, self.sa = np.unique(packed >> self.bits), (packed & mask).astype(np.int64)
        self.rank = np.zeros(n + depth, np.int64)  # 0: no word there
        self.rank[self.sa] = self._ranks(packed >> self.bits)
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if n else np.zeros(0, np.int64)
        self.stop = (last[np.searchsorted(last, np.arange(n))] + 1) if n else last  # where each position's row ends
        rank, k = self.rank[:n], 1
        while k < depth and n:
            then = np.zeros(n, np.int64)
            inside = np.flatnonzero(np.arange(n) + k < self.stop)
            then[inside] = rank[inside + k]
            if wide:
                self.sa = np.lexsort((then, rank))
                a, b = rank[self.sa], then[self.sa]
                ranks = np.cumsum(np.append(1, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            else:
                packed = np.sort((rank.astype(U64) << self.bits | then.astype(U64)) << self.bits | at)
                self.sa = (packed & mask).astype(np.int64)
                ranks = self._ranks(packed >> self.bits)
            rank = np.empty(n, np.int64)
            rank[self.sa] = ranks
            k *= 2

    @staticmethod
    def _ranks(ordered: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word; -1 where no row has it."""
        want = h >> self.shift
        at = np.searchsorted(self.symbols, want)
        found = at < len(self.symbols)
        found[found] = self.symbols[at[found]] == want[found]
        return np.where(found, at + 1, -1)

    def search(self, query: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: the range [from, to) of suffixes that begin with query[i, :size[i]] (codes), for all i at once."""
        out = []
        for upper in (False, True):
            lo, hi = np.zeros(len(query), np.int64), np.full(len(query), self.n, np.int64)
            for _ in range(int(self.n).bit_length()):
                open_ = lo < hi
                mid = (lo + hi) // 2
                pos = self.sa[np.minimum(mid, self.n - 1)]
                order, undecided = np.zeros(len(query), np.int8), open_.copy()
                for t in range(query.shape[1]):
                    code = np.where(pos + t < self.stop[pos], self.rank[pos + t], 0)
                    use = undecided & (t < size)
                    order[use & (code < query[:, t])] = -1
                    order[use & (code > query[:, t])] = 1
                    undecided &= ~(use & (code != query[:, t]))
                right = open_ & ((order < 0) | ((order == 0) & upper))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            out.append(lo)
        return out[0], out[1]


def windows(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes padded to window, size, item row, offset in the item) of every window of the test texts."""
    h, row = word_hashes(texts)
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[item], window)
    at = (first[item] + offset)[:, None] + np.arange(window)
    return (h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else np.zeros((0, window), U64)), size, item, offset


def test_blocks(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[tuple]:
    """The test set as blocks of at most block_bytes of text (an item at least), gathered one after another."""
    ids, texts, held = [], [], 0
    for r in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(text, F.lit("")).alias("t")).toLocalIterator():
        if texts and held + len(r["t"]) > block_bytes:
            yield (np.array(ids, object), *windows(pa.array(texts, pa.string()), window))
            ids, texts, held = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"])
    if texts:
        yield (np.array(ids, object), *windows(pa.array(texts, pa.string()), window))


def scan(batch: pa.RecordBatch, blocks: list, window: int) -> pa.RecordBatch:
    """The matches of one slice of documents with all test blocks."""
    docs = batch.num_rows
    h, row = word_hashes(batch.column(1))
    n_words = np.bincount(row, minlength=docs)
    first = np.cumsum(n_words) - n_words
    cover = np.zeros(len(h) + 1, np.int64)
    found: list[set] = [set() for _ in range(docs)]
    best: list[tuple] = [(0, None, None, None)] * docs
    array = SuffixArray(h, row, window) if len(h) else None
    for ids, hashes, size, item, offset in blocks if array else []:
        codes = array.codes(hashes.ravel()).reshape(hashes.shape)
        live = np.flatnonzero(((codes > 0) | (np.arange(window) >= size[:, None])).all(axis=1))
        if not len(live):
            continue
        lo, hi = array.search(codes[live], size[live])
        hit = np.flatnonzero(hi > lo)
        count = hi[hit] - lo[hit]
        which = np.repeat(live[hit], count)
        pos = array.sa[np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + size[which], -1)
        doc, it = row[pos], item[which]
        # runs of windows on one diagonal are one longer match
        order = np.lexsort((pos, pos - offset[which], it, doc))
        d, i, p, o, s = doc[order], it[order], pos[order], offset[which][order], size[which][order]
        if not len(d):
            continue
        new = np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1) | (o[1:] != o[:-1] + 1))
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(d)))
        for b, length in zip(begin.tolist(), (run - 1 + s[begin]).tolist(), strict=True):
            name = ids[i[b]]
            found[d[b]].add(name)
            key = (-length, name, int(p[b] - first[d[b]]), int(o[b]))
            if best[d[b]][1] is None or key < (-best[d[b]][0], *best[d[b]][1:]):
                best[d[b]] = (length, *key[1:])
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(row[hit], minlength=docs) if len(h) else n_words
    # runs of words that are hit, by document
    edge = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(h))
    edge, stop = (x[hit[edge]] for x in (edge, stop)) if len(h) else (edge, edge)
    owner = row[edge]
    low, high = (pa.array((x - first[owner]).astype(np.int32)) for x in (edge, stop))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))]).astype(np.int32)
    ranges = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([low, high], ["low", "high"]))
    columns = [
        batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in found], pa.list_(pa.string())),
        pa.array([b[0] for b in best], pa.int32()), pa.array([b[1] for b in best], pa.string()), pa.array([b[2] for b in best], pa.int32()), pa.array([b[3] for b in best], pa.int32()), ranges,
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "longest_words", "longest_item", "longest_doc_word", "longest_item_word", "ranges"])


def matches(docs: DataFrame, items: DataFrame, window: int = 8, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32_000_000) -> DataFrame:
    """Per document: its verbatim matches with the items' windows (``window`` consecutive words; an item of fewer words is one window).

    n_hit counts document words inside any occurrence; ``items`` are the distinct ids of items with an occurring window,
    sorted as strings; longest_* tell the longest verbatim match and where it lies (ties: smallest item, then place).
    Null and empty texts have no words and no matches; a null item id reads as ''; items that share an id count once;
    repeated documents are reported each. An empty table of items yields no matches; one of documents no rows.
    Only one block of items, of block_bytes of text at most (an item at least), is held and broadcast at a time; the documents are read once for each.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _by_blocks(rows, test_blocks(items, item_id, item_text, window, block_bytes), window).drop("ranges", "_row")


def _by_blocks(rows: DataFrame, blocks: Iterator[tuple], window: int) -> DataFrame:
    """rows (doc_id, text and, with several blocks, _row) to SCHEMA, ranges and _row, over all blocks."""
    spark = rows.sparkSession

    def searched(docs: DataFrame, block: tuple | None):
        sent = spark.sparkContext.broadcast([block] if block else [])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = scan(part, sent.value, window)
                    yield pa.RecordBatch.from_arrays([*found.columns, part.column(2)], [*found.schema.names, "_row"])

        return sent, docs.select("doc_id", "text", "_row").mapInArrow(search, f"{SCHEMA}, ranges array<struct<low:int,high:int>>, _row long")

    one, two = next(blocks, None), next(blocks, None)
    if two is None:
        return searched(rows if "_row" in rows.columns else rows.withColumn("_row", F.lit(0).cast("long")), one)[1]
    rows = rows if "_row" in rows.columns else store(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = []
    for block in chain([one, two], blocks):
        sent, found = searched(rows, block)
        parts.append(store(found))
        sent.destroy()
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    best = F.struct((-F.col("longest_words")).alias("l"), "longest_item", "longest_doc_word", "longest_item_word")
    merged = union.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min(F.when(F.col("longest_words") > 0, best)).alias("b"),
    )
    step = lambda s, r: F.struct(F.greatest(s["end"], r["high"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["high"] - F.greatest(r["low"], s["end"]))).alias("n"))
    n_hit = F.aggregate("ranges", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long")
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.coalesce(-F.col("b.l"), F.lit(0)).cast("int").alias("longest_words"), "b.longest_item", "b.longest_doc_word", "b.longest_item_word", "ranges", "_row")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 1, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32_000_000) -> DataFrame:
    """docs without the rows that hold windows of at least min_items items. With one block of items rows are dropped where they are read; null texts stay."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    blocks = test_blocks(items, item_id, item_text, window, block_bytes)
    one, two = next(blocks, None), next(blocks, None)
    if two is not None:
        numbered = store(docs.withColumn("_row", F.monotonically_increasing_id()))
        rows = numbered.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), "_row")
        gone = _by_blocks(rows, chain([one, two], blocks), window).where(F.size("items") >= min_items).select("_row")
        return numbered.join(gone, "_row", "left_anti").select(*docs.columns)
    sent = spark.sparkContext.broadcast([one] if one else [])
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                pair = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column(at)], ["doc_id", "text"])
                found = scan(pair, sent.value, window).column(3)
                yield part.filter(pa.array([len(x) < min_items for x in found.to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
        "longest_words", "longest_item", "longest_doc_word", "longest_item_word",
    )
