"""What the operators share: shared storage, Arrow batches and vectorised hashing of words.

Word rule (fixed by the decontamination contract and used everywhere here): A-Z are lower-cased and a word is
a run of bytes that are digits, letters or part of a non-ASCII character.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


#: Rows and bytes of an Arrow batch; the session's own values are kept where they are smaller.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Have Arrow batches of bounded size, as texts can be long: each task holds several of them, in the JVM and in Python."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="axisweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again. Survives lost executors."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/axisweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(rows: DataFrame, buckets: int, by: str) -> DataFrame:
    """Write rows to the shared folder as a table in buckets, so that what groups by the column reads them without a shuffle."""
    spark = rows.sparkSession
    name = f"axisweave_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, by).option("path", f"{shared_dir(spark)}/axisweave/{name}").saveAsTable(name)
    return spark.table(name)


def release(*stored: DataFrame) -> None:
    """Delete what store() wrote for these, once what was made of it is stored itself, and have Spark clear the shuffle files of finished steps.

    Only files below the shared folder's axisweave are deleted. Shuffle files go when the driver's JVM finds that nothing refers to them any more.
    """
    for df in stored:
        spark = df.sparkSession
        jvm = spark._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/axisweave/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if stored:
        clear_shuffles(stored[0].sparkSession)


def clear_shuffles(spark: SparkSession) -> None:
    """Have Spark clear the shuffle files of steps that nothing refers to any more."""
    for _ in range(2):  # what the first round frees may hold what the second finds
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); bijective."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls read as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column, large = column.cast(pa.string()), False
    n = len(column)
    _, off, data = column.buffers()
    kind = np.int64 if large else np.int32
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (at least a row), so that scratch arrays stay bounded."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: What a byte counts as in a word: 0 ends it; A-Z count as a-z.
BYTE = np.zeros(256, np.uint8)
BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
BYTE[0x80:] = np.arange(0x80, 0x100)


def powers(n: int, base: np.uint64 = GOLDEN) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    step = base
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            done += more
            step = step * step
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, start, end, row) of each word, in order."""
    low = BYTE[data]
    is_word = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return low, start, end, row


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for non-empty disjoint ascending spans."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    total = int(size.sum())
    first = np.cumsum(size) - size
    within = np.arange(total) - np.repeat(first, size)
    power = powers(int(size.max()))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((values[within + np.repeat(start, size)].astype(U64) + U64(1)) * power[within], first)
        return mix(h + size.astype(U64) * GOLDEN)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of a text column, in order."""
    data, off = text_buffers(column)
    low, start, end, row = word_spans(data, off)
    return span_hashes(low, start, end), row


def rolling(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each run of k consecutive words of one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for i in range(k):
            out = out * GOLDEN + h[i : i + n]
    keep = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[keep]), keep


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def among(df: DataFrame, column: str, ids: DataFrame, most: int = 27) -> DataFrame:
    """Rows of df whose integer ``column`` is in the one column of ids, each once for each time that its value is in ids.

    A bitmap with some 16 bits for each id, 2^most bits at most (2^(most - 6) rows of 16 bytes, which bounds the broadcast), drops most
    other rows before the shuffle of the exact join. The join is an inner one: a semi join would be planned below the bitmap.
    """
    from pyspark.sql import functions as F

    (name,) = ids.columns
    ids = store(ids.select(F.col(name).alias("_id")))
    bits = min(most, max(16, ids.count().bit_length() + 4))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    marks = ids.select(place("_id").alias("_p")).selectExpr("_p div 64 as _word", "shiftleft(1L, cast(_p % 64 as int)) as _bit")
    marks = store(marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    kept = df.withColumn("_p", place(column)).withColumn("_w", F.expr("_p div 64")).join(F.broadcast(marks), F.col("_w") == F.col("_word"))
    return kept.where("getbit(_bits, cast(_p % 64 as int)) = 1").join(ids, F.col(column) == F.col("_id")).select(*df.columns)
