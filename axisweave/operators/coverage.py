"""Coverage of regions by reads: binned counts, medians over dense depth, and expression measures."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.operators.intervals import KEYS, count_overlaps, depth_runs, fragment, overlap_join


def multimap_policy(stranded: bool, nh: str = "nh") -> Column:
    """Reads that binned coverage counts: unknown hits count as one; under 3 hits when stranded, one when not."""
    return F.coalesce(F.col(nh), F.lit(1)) < (3 if stranded else 2)


def binned_max_end(reads: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """(region columns, bin, y): in each bin of a region the greater of the read starts and the read stops, zeros included.

    Bins count from the region's start by a division that truncates toward zero, so a read that starts up to width - 1 before
    the region counts in bin 0; only reads that overlap the region count.
    """
    names = regions.columns
    hits = overlap_join(regions, reads.select(*KEYS, "start", "stop"), suffix="_r")
    bins = F.expr(f"(stop - start) div {width} + 1")
    at = lambda c: F.expr(f"cast(({c} - start) div {width} as int)")
    marks = hits.select(*names, F.explode(F.array(F.struct(at("start_r").alias("bin"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(at("stop_r").alias("bin"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
    marks = marks.select(*names, "x.*").where(F.col("bin").between(F.lit(0), bins - 1)).groupBy(*names, "bin").agg(F.greatest(F.sum("s"), F.sum("e")).cast("long").alias("y"))
    every = regions.distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), (bins - 1).cast("int"))))
    return every.join(marks, [*names, "bin"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def binned_counts(reads: DataFrame, width: int, what: str = "overlap") -> DataFrame:
    """(chr, strand, bin, n) on the axis itself: reads that overlap, start or stop in a bin."""
    at = {"overlap": F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)), "start": F.array(F.floor(F.col("start") / width)), "stop": F.array(F.floor(F.col("stop") / width))}[what]
    return reads.select(*KEYS, F.explode(at).alias("bin")).groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("n"))


def binned_max_depth(reads: DataFrame, width: int) -> DataFrame:
    """(chr, strand, bin, depth): the greatest depth in each bin that has any."""
    runs = depth_runs(reads)
    return runs.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))).groupBy(*KEYS, "bin").agg(F.max("depth").alias("depth"))


def region_depths(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """(region columns, depth, n): how many positions of each region have each depth; positions without reads have 0."""
    names = regions.columns
    hits = overlap_join(regions.distinct(), depth_runs(reads), suffix="_d")
    cut = hits.select(*names, F.col("depth_d").alias("depth"), (F.least("stop", "stop_d") - F.greatest("start", "start_d") + 1).alias("n"))
    some = cut.groupBy(*names).agg(F.sum("n").alias("n"))
    rest = regions.distinct().join(some, names, "left").select(*names, F.lit(0).cast("long").alias("depth"), (F.col("stop") - F.col("start") + 1 - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    return cut.unionByName(rest).groupBy(*names, "depth").agg(F.sum("n").alias("n"))


def median_depth(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """The exact median of the dense depth of each region."""
    return region_depths(reads, regions).groupBy(*regions.columns).agg(F.expr("percentile(depth, 0.5, n)").alias("coverage"))


def fraction_covered(reads: DataFrame, regions: DataFrame, depth: int = 1) -> DataFrame:
    covered = F.sum(F.when(F.col("depth") >= depth, F.col("n")).otherwise(0))
    return region_depths(reads, regions).groupBy(*regions.columns).agg((covered / F.sum("n")).alias("fraction"))


def least_fragment_median(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Coverage of overlapping regions: the least median among the elementary fragments within each."""
    parts = median_depth(reads, fragment(regions))
    inside = (F.col("start_f") >= F.col("start")) & (F.col("stop_f") <= F.col("stop"))
    return overlap_join(regions.distinct(), parts, suffix="_f", condition=inside).groupBy(*regions.columns).agg(F.min("coverage_f").alias("coverage"))


def count_reads(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Overlapping reads of each region, zeros included."""
    return count_overlaps(regions.distinct(), reads)


def fpkm(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads per kilobase of region and million reads; null without any reads."""
    total = reads.agg(F.count(F.lit(1)).alias("_total"))
    return count_reads(reads, regions).crossJoin(F.broadcast(total)).withColumn("fpkm", F.try_divide(F.col("n") * 1e9, F.col("_total") * (F.col("stop") - F.col("start") + 1))).drop("_total")


def insert_size(sizes: DataFrame, column: str, quantile: float = 0.99) -> DataFrame:
    """A robust quantile of insert sizes: of the normal whose mean is the median and whose deviation is half the central 68 %."""
    n, z = NormalDist(), NormalDist().inv_cdf(quantile)
    low, high = n.cdf(-1), n.cdf(1)
    q = sizes.agg(F.expr(f"percentile({column}, array({low}, 0.5, {high}))").alias("q"))
    return q.select((F.col("q")[1] + F.lit(z) * (F.col("q")[2] - F.col("q")[0]) / 2).cast("int").alias("max_insert"))
