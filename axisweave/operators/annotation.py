"""Transcript annotation: introns and untranslated regions, reports by gene, and the exons that a splice graph leaves no choice about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.operators.intervals import KEYS, coalesce_intervals, overlap_join, subtract

#: Rows that one task is to sort.
ROWS_A_TASK = 1_000_000


def transcripts(exons: DataFrame, by: str = "transcript_id") -> DataFrame:
    """The span of each transcript's exons (chr, strand, start, stop, transcript)."""
    return exons.groupBy(*KEYS, by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as hold ROWS_A_TASK rows each, and the session's number of shuffle partitions at least, so that what one task sorts doesn't grow with the input."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))


def _reached(by: str) -> Column:
    """The last position of the exons before, in the order of their starts."""
    return F.max("stop").over(Window.partitionBy(*KEYS, by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))


def introns(exons: DataFrame, by: str = "transcript_id", tasks: int | None = None) -> DataFrame:
    """What a transcript's exons leave of its span: gaps before exons that start past all exons before. Rows are sorted once, within their transcript."""
    dealt = exons.select(*KEYS, by, "start", "stop").repartition(tasks or tasks_for(exons), by).withColumn("_reached", _reached(by))
    return dealt.where(F.col("start") - 1 > F.col("_reached")).select(*KEYS, by, (F.col("_reached") + 1).alias("start"), (F.col("start") - 1).alias("stop"))


def untranslated(exons: DataFrame, cds: DataFrame, by: str = "transcript_id") -> DataFrame:
    """(keys, start, stop, side) of transcripts that have a coding span: exonic positions before (5p) and after (3p) it, as the strand goes."""
    coding = transcripts(cds, by)
    spans = exons.join(coding.select(*KEYS, by), [*KEYS, by], "left_semi")
    rest = subtract(spans, coding, keys=[*KEYS, by])
    named = rest.join(coding.select(*KEYS, by, F.col("start").alias("_low")), [*KEYS, by])
    return named.withColumn("side", F.when((F.col("stop") < F.col("_low")) == (F.col("strand") == "+"), "5p").otherwise("3p")).drop("_low")


def gene_report(exons: DataFrame, cds: DataFrame, gene: str = "gene_id", by: str = "transcript_id", tasks: int | None = None) -> DataFrame:
    """Each gene with its transcript of the longest 3' UTR (the least id of several) and the least, greatest and mean size of the introns of that one.

    Exons and coding spans meet in one sort by transcript: an exon's gap is what lies between it and all exons before, its part of the UTR the
    positions that no exon before has, past the coding span. A transcript of several genes counts whole for each.
    """
    tasks = tasks or tasks_for(exons)
    both = exons.select(*KEYS, by, gene, "start", "stop", F.lit(None).cast("int").alias("_c0"), F.lit(None).cast("int").alias("_c1"), F.lit(True).alias("_exon"))
    coding = transcripts(cds, by).dropna(subset=[*KEYS, by]).select(*KEYS, by, F.lit(None).cast(dict(exons.dtypes)[gene]).alias(gene), *[F.lit(None).cast("int").alias(c) for c in ("start", "stop")], F.col("start").alias("_c0"), F.col("stop").alias("_c1"), F.lit(False).alias("_exon"))
    whole = Window.partitionBy(*KEYS, by)
    rows = both.unionByName(coding).repartition(tasks, by).withColumn("_reached", _reached(by)).withColumn("_low", F.max("_c0").over(whole)).withColumn("_high", F.max("_c1").over(whole)).where("_exon")
    fresh = F.greatest(F.col("start"), F.col("_reached") + 1)
    plus = F.col("strand") == "+"
    part = F.when(plus, F.col("stop") - F.greatest(fresh, F.col("_high") + 1)).otherwise(F.least(F.col("stop"), F.col("_low") - 1) - fresh) + 1
    rows = rows.withColumn("_part", F.when(F.col("_high").isNotNull(), F.greatest(part, F.lit(0)))).withColumn("_gap", F.when(F.col("start") - 1 > F.col("_reached"), F.col("start") - 1 - F.col("_reached")))
    sums = rows.groupBy(by, gene).agg(F.sum("_part").alias("_utr3"), F.min("_gap").alias("_least"), F.max("_gap").alias("_greatest"), F.sum("_gap").alias("_sum"), F.count("_gap").alias("_n"))
    of = Window.partitionBy(by)
    sums = sums.select(
        gene, by, F.coalesce(F.sum("_utr3").over(of), F.lit(0).cast("long")).alias("utr3"), F.min("_least").over(of).alias("least_intron"), F.max("_greatest").over(of).alias("greatest_intron"),
        F.try_divide(F.sum("_sum").over(of), F.sum("_n").over(of)).alias("mean_intron"),
    )
    names = ["least_intron", "greatest_intron", "mean_intron"]
    best = sums.repartition(tasks, gene).groupBy(gene).agg(F.min(F.struct((-F.col("utr3")).alias("least"), by, *names)).alias("b"))
    return best.select(F.col(f"b.{by}").alias(by), gene, (-F.col("b.least")).alias("utr3"), *[F.col(f"b.{n}").alias(n) for n in names])


def without_isoform(gene: str) -> Column:
    """A gene id without what follows its last hyphen."""
    return F.regexp_replace(gene, "-[^-]*$", "")


def invariable_exons(exons: DataFrame, juncs: DataFrame) -> DataFrame:
    """Exons (chr, strand, start, stop, group) of the stretches without a choice: around junctions that overlap no other junction and have one exon in the exonic
    interval on either side. Stretches that overlap are one group, numbered by their start.
    """
    j, x = juncs.select(*KEYS, "start", "stop").distinct(), exons.select(*KEYS, "start", "stop").distinct()
    alone = overlap_join(j, j, suffix="_o").groupBy(*KEYS, "start", "stop").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    unions = coalesce_intervals(x)
    single = overlap_join(unions, x, suffix="_x").groupBy(*KEYS, "start", "stop").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    flank = alone.select(*KEYS, F.col("start").alias("j0"), F.col("stop").alias("j1"), F.explode(F.array(F.col("start") - 1, F.col("stop") + 1)).alias("start")).withColumn("stop", F.col("start"))
    beside = overlap_join(flank, single, suffix="_u").groupBy(*KEYS, "j0", "j1").agg(F.countDistinct("start").alias("n"), F.min("start_u").alias("start"), F.max("stop_u").alias("stop")).where("n = 2")
    stretches = coalesce_intervals(beside.select(*KEYS, "start", "stop")).withColumn("group", F.concat_ws(":", *KEYS, "start"))
    return overlap_join(x, stretches, suffix="_s").select(*KEYS, "start", "stop", F.col("group_s").alias("group"))


def bypass(points: DataFrame, distance: int = 300) -> DataFrame:
    """Joint change points (up and down: levels of two samples) not within ``distance`` of the exon's 3' end, with the level before the point and the share that goes on, 1 at most."""
    end = F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("stop"))
    share = [F.least(F.try_divide(F.col("down")[i], F.col("up")[i]), F.lit(1.0)) for i in (0, 1)]
    return points.where(F.abs(F.col("pos") - end) >= distance).select(*KEYS, "pos", F.col("up")[0].alias("level_1"), F.col("up")[1].alias("level_2"), share[0].alias("bypass_1"), share[1].alias("bypass_2"), (share[0] - share[1]).alias("difference"))


def graph_drawing(exons: DataFrame, juncs: DataFrame) -> DataFrame:
    """(locus_id, chr, strand, start, stop, type, nth): exons without the base at each spliced end, and for each junction its two flanking bases, numbered by locus.

    exons have locus_id and type; a base is cut at the ends where the type says that the exon is spliced.
    """
    plus = F.col("strand") == "+"
    at5 = F.col("type").isin("internal_exon", "3p_exon")
    at3 = F.col("type").isin("internal_exon", "5p_exon")
    low, high = F.when(plus, at5).otherwise(at3), F.when(plus, at3).otherwise(at5)
    body = exons.select("locus_id", *KEYS, (F.col("start") + low.cast("int")).alias("start"), (F.col("stop") - high.cast("int")).alias("stop"), F.lit("exon").alias("type"))
    ends = juncs.select("locus_id", *KEYS, F.explode(F.array(F.col("start") - 1, F.col("stop") + 1)).alias("start")).withColumn("stop", F.col("start")).withColumn("type", F.lit("splice_jnct"))
    every = body.unionByName(ends)
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("locus_id").orderBy("start", "stop", "type", *KEYS)))
