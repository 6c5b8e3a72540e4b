"""Interval-shaped views of the test tables, as DataFrames and (for the SQL check) as SQL of DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shipped line is an interval of as many days as its quantity; flags are chromosomes."""
    d = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("chr"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (d + 1).cast("int").alias("start"), (d + 1 + F.col("l_quantity").cast("int")).cast("int").alias("stop"),
        "l_partkey", "l_suppkey", "l_quantity",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a read at its minute."""
    m = F.expr("cast(timestampdiff(MINUTE, timestamp'2024-01-01 00:00:00', ts) as int)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("read_id"), F.col("event_type").alias("chr"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"), (m + 1).alias("start"), (m + 1 + F.floor("value").cast("int") % 60).cast("int").alias("stop"),
        (1 + F.col("user_id") % 3).cast("int").alias("nh"), (F.col("event_id") % 7 == 0).alias("dup"), (F.col("event_id") % 2 == 0).alias("second"), F.col("user_id"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads on a grid, with a CIGAR string; those of even ids are spliced."""
    r = reads(spark, sf_dir)
    start = (F.expr("(start - 1) div 30") * 30 + 1).cast("int")
    left, gap, right = 5 + 5 * (F.col("user_id") % 2), 10 + 5 * (F.col("user_id") % 3), 6 + F.col("read_id") % 5
    cigar = F.when(F.col("read_id") % 2 == 0, F.concat(left.cast("string"), F.lit("M"), gap.cast("string"), F.lit("N"), right.cast("string"), F.lit("M"))).otherwise(F.concat((F.col("stop") - F.col("start") + 1).cast("string"), F.lit("M")))
    return r.select("read_id", "chr", "strand", start.alias("start"), cigar.alias("cigar"), "nh", "dup")


SQL = {
    "intervals": """intervals AS (SELECT l_returnflag AS chr, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand,
        CAST(date_diff('day', date '1995-01-01', l_shipdate) AS INT) + 1 AS start, CAST(date_diff('day', date '1995-01-01', l_shipdate) + 1 + CAST(l_quantity AS INT) AS INT) AS stop,
        l_partkey, l_suppkey, l_quantity FROM lineitem)""",
    "reads": """reads AS (SELECT event_id AS read_id, event_type AS chr, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
        CAST(date_diff('minute', timestamp '2024-01-01 00:00:00', ts) AS INT) + 1 AS start,
        CAST(date_diff('minute', timestamp '2024-01-01 00:00:00', ts) + 1 + CAST(floor(value) AS INT) % 60 AS INT) AS stop,
        CAST(1 + user_id % 3 AS INT) AS nh, event_id % 7 = 0 AS dup, event_id % 2 = 0 AS second, user_id FROM events)""",
    "alignments": """alignments AS (SELECT read_id, chr, strand, CAST((start - 1) // 30 * 30 + 1 AS INT) AS start, read_id % 2 = 0 AS spliced,
        CAST(CASE WHEN read_id % 2 = 0 THEN 5 + 5 * (user_id % 2) ELSE stop - start + 1 END AS INT) AS b1, CAST(10 + 5 * (user_id % 3) AS INT) AS gap, CAST(6 + read_id % 5 AS INT) AS b2, nh, dup FROM reads)""",
}
#: Runs of constant depth of a relation with chr, strand, start and stop.
RUNS = """SELECT chr, strand, pos AS start, nxt - 1 AS stop, depth FROM (
    SELECT chr, strand, pos, lead(pos) OVER (PARTITION BY chr, strand ORDER BY pos) AS nxt, sum(d) OVER (PARTITION BY chr, strand ORDER BY pos) AS depth FROM (
      SELECT chr, strand, pos, sum(d) AS d FROM (SELECT chr, strand, start AS pos, 1 AS d FROM {0} UNION ALL SELECT chr, strand, stop + 1, -1 FROM {0}) GROUP BY ALL HAVING sum(d) <> 0)) WHERE depth > 0"""
#: Merged runs of a relation, with gaps of at most {1} positions closed.
ISLANDS = """SELECT chr, strand, min(start) AS start, max(stop) AS stop FROM (
    SELECT *, sum(opened) OVER (PARTITION BY chr, strand ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY chr, strand ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= {1} THEN 0 ELSE 1 END AS opened FROM {0}))
    GROUP BY chr, strand, run"""


def runs(relation: str) -> str:
    return RUNS.format(relation)


def islands(relation: str, radius: int = 0) -> str:
    return ISLANDS.format(relation, radius)


def sql(views: str, body: str) -> str:
    """A query over views, which are named with commas; alignments needs reads."""
    return f"WITH {', '.join(SQL[v] for v in views.split(','))} {body}"
