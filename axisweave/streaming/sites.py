"""Site counts of a stream of spliced reads: sorted input emits a site once no later read can touch it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_site_counts(reads: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Reads per (window, chr, strand, site) with a watermark: a window is emitted, and its state dropped, once the stream has
    passed its end by ``delay``; later rows are ignored. Use append mode."""
    late = reads.withWatermark(time, delay)
    return late.groupBy(F.window(time, window), "chr", "strand", "site").agg(F.count(F.lit(1)).alias("n"))
