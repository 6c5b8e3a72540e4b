"""The assembly pipeline and what follows it: assemble, compare, enumerate and diff, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisweave.operators import exons, graph, segmentation, splice
from axisweave.operators import intervals as iv
from axisweave.sources.regions import Config


@dataclass
class Assembly:
    segments: DataFrame
    junctions: DataFrame
    exons: DataFrame
    unspliced: DataFrame
    change_points: DataFrame


def coarsened(reads: DataFrame, regions: DataFrame, config: Config) -> DataFrame:
    """Binned counts with at most max_bins bins to a region: longer regions get wider bins (column width). A bin without reads has no row,
    but for the first, so that each region has one."""
    size = F.col("stop") - F.col("start") + 1
    sized = regions.withColumn("width", F.greatest(F.lit(config.bin_width), F.ceil(size / config.max_bins)).cast("int"))
    hits = iv.overlap_join(sized, reads.select(*iv.KEYS, "start", "stop"), suffix="_r")
    at = lambda c: F.expr(f"cast(({c} - start) div width as int)")
    marks = hits.select(*sized.columns, F.explode(F.array(F.struct(at("start_r").alias("bin"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(at("stop_r").alias("bin"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).select(*sized.columns, "x.*")
    marks = marks.where("bin >= 0 and bin <= (stop - start) div width").groupBy(*sized.columns, "bin").agg(F.greatest(F.sum("s"), F.sum("e")).alias("y"))
    return marks.unionByName(sized.withColumn("bin", F.lit(0)).withColumn("y", F.lit(0).cast("long")))


def assemble(alignments: DataFrame, config: Config | None = None, known: DataFrame | None = None) -> Assembly:
    """alignments: chr, strand, start, cigar (strand of the library); known: regions (chr, start, stop) whose gaps are bridged.

    exons: spliced exons with terminal ones cut back from antisense ones, and what the change points leave of them. Each step is written
    to the shared folder, as later ones read it several times.
    """
    config = config or Config()
    aligned = splice.aligned(alignments)
    expressed = iv.expressed(aligned, config.threshold)
    segments = graph.store(iv.coalesce_intervals(expressed, config.merge_radius) if known is None else exons.bridge_known(graph.store(expressed), known, config.merge_radius))
    judged = graph.store(splice.judge_junctions(splice.junctions(alignments), graph.store(splice.site_counts(alignments)), config.alpha))
    accepted = judged.where("accepted").select(*iv.KEYS, "start", "stop")
    found = graph.store(exons.trim_antisense(graph.store(exons.spliced_exons(segments, accepted))))
    windows = graph.store(exons.eligible_segments(found, config.bin_width, config.min_terminal, config.internal))
    bins = coarsened(aligned, windows.select(*iv.KEYS, "start", "stop", "mode").distinct(), config).withColumn("sample", F.lit("s"))
    points = graph.store(segmentation.change_points(bins, config.bin_width, segmentation.Prior(min_fold=config.min_fold)))
    points = points.withColumn("before", F.col("sample_levels")[0][0]).withColumn("after", F.col("sample_levels")[1][0])
    points = graph.store(exons.filter_change_points(points.drop("start", "stop"), found, accepted, config.bin_width))
    every = graph.store(found.select(*iv.KEYS, "start", "stop", "type").unionByName(exons.change_point_exons(points, found)).distinct())
    return Assembly(segments, judged, every, exons.unspliced_remainder(segments, found), points)


def loci(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Exons with locus_id: exons and junctions that touch are one locus; ids follow (chr, strand, start)."""
    nodes = iv.coalesce_intervals(found).withColumn("id", F.xxhash64("chr", "strand", "start"))
    ends = accepted.select(*iv.KEYS, F.xxhash64("chr", "strand", "start", "stop").alias("j"), F.explode(F.array(F.col("start") - 1, F.col("stop") + 1)).alias("start")).withColumn("stop", F.col("start"))
    touch = iv.overlap_join(ends, nodes.select(*iv.KEYS, "start", "stop", "id"), suffix="_n").select("j", F.col("id_n").alias("id"))
    pair = touch.groupBy("j").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    labels = graph.connected_components(nodes.select("id"), pair)
    named = nodes.join(labels, "id")
    order = named.groupBy("component").agg(F.min(F.struct("chr", "strand", "start")).alias("at"))
    ranked = order.select("component", F.format_string("locus.%016x", F.col("component")).alias("locus_id"))
    runs = named.join(ranked, "component").select(*iv.KEYS, "start", "stop", "locus_id")
    inside = (F.col("start_l") <= F.col("start")) & (F.col("stop_l") >= F.col("stop"))
    return iv.overlap_join(found, runs, suffix="_l", condition=inside).select(*found.columns, F.col("locus_id_l").alias("locus_id"))


def common_terminal_exons(one: DataFrame, two: DataFrame) -> DataFrame:
    """3' exons of two samples with the same 5' end, as the span of both; spans that meet several exons of a sample are left out."""
    ends = [x.where(F.col("type") == "3p_exon").withColumn("end5", iv.five_prime()) for x in (one, two)]
    both = ends[0].select(*iv.KEYS, "end5", "start", "stop").join(ends[1].select(*iv.KEYS, "end5", F.col("start").alias("s"), F.col("stop").alias("e")), [*iv.KEYS, "end5"])
    span = both.select(*iv.KEYS, F.least("start", "s").alias("start"), F.greatest("stop", "e").alias("stop")).distinct()
    for x in (one, two):
        met = iv.overlap_join(span, x.select(*iv.KEYS, "start", "stop"), suffix="_x").groupBy(*span.columns).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        span = met.select(*span.columns)
    return span


def compare(one: tuple[DataFrame, DataFrame], two: tuple[DataFrame, DataFrame], config: Config | None = None) -> DataFrame:
    """(exons, reads) of two samples to joint change points with each sample's usage and their difference. Exons of over max_bins bins get wider ones."""
    config = config or Config()
    span = common_terminal_exons(one[0], two[0])
    bins = [coarsened(reads, span, config).withColumn("sample", F.lit(s)) for s, (_, reads) in (("1", one), ("2", two))]
    points = segmentation.change_points(bins[0].unionByName(bins[1]), config.bin_width, segmentation.Prior(min_fold=config.min_fold), shift=False)
    up, down = (F.when(F.col("strand") == "-", F.col("sample_levels")[1 - i]).otherwise(F.col("sample_levels")[i]) for i in (0, 1))
    rows = points.withColumn("up", up).withColumn("down", down)
    for i in (0, 1):
        rows = rows.withColumn(f"u{i}", F.col("up")[i]).withColumn(f"d{i}", F.col("down")[i]).withColumn(f"usage_{i + 1}", exons.usage(f"u{i}", f"d{i}")).drop(f"u{i}", f"d{i}")
    return rows.withColumn("differential_usage", F.col("usage_1") - F.col("usage_2"))


#: Columns of the table that compare_table() gives, in order (fixed values).
COMPARE_COLUMNS = "samples locus_id changepoint confidence log_odds upstream_segment downstream_segment locus strand upstream_cov downstream_cov site_usage differential_usage".split()


def compare_table(points: DataFrame, names: tuple[str, str] = ("1", "2")) -> DataFrame:
    """compare()'s rows as the table that is written: a row for each change point, with lists by sample joined by commas.

    Regions are chr:start-stop; the segments beside a change point reach to the exon's ends or the next change point. Ids number the exons in order of place.
    """
    order = Window.partitionBy(*iv.KEYS, "start", "stop").orderBy("pos")
    locus = F.concat("chr", F.lit(":"), "start", F.lit("-"), "stop")
    place = points.withColumn("_low", F.coalesce(F.lag("pos").over(order), F.col("start"))).withColumn("_high", F.coalesce(F.lead("pos").over(order) - 1, F.col("stop")))
    span = lambda a, b: F.concat("chr", F.lit(":"), a, F.lit("-"), b)
    left, right = span(F.col("_low"), F.col("pos") - 1), span(F.col("pos"), F.col("_high"))
    minus = F.col("strand") == "-"
    joined = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.3f", v)), ",")
    return place.select(
        F.lit(",".join(names)).alias("samples"), F.concat(F.lit("locus."), locus).alias("locus_id"), span(F.col("pos"), F.col("pos")).alias("changepoint"),
        F.format_string("%.3e", "confidence").alias("confidence"), F.format_string("%.3e", "log_odds").alias("log_odds"), F.when(minus, right).otherwise(left).alias("upstream_segment"), F.when(minus, left).otherwise(right).alias("downstream_segment"),
        locus.alias("locus"), "strand", joined("up").alias("upstream_cov"), joined("down").alias("downstream_cov"), F.concat_ws(",", F.format_string("%.3f", "usage_1"), F.format_string("%.3f", "usage_2")).alias("site_usage"), F.format_string("%.3f", "differential_usage").alias("differential_usage"),
    ).select(*COMPARE_COLUMNS)


def exon_edges(located: DataFrame, accepted: DataFrame) -> DataFrame:
    """(locus_id, a, b): exons (chr:strand:start:stop) that an accepted junction joins, in the direction of the strand."""
    plus = F.col("strand") == "+"
    x = located.withColumn("id", F.concat_ws(":", "chr", "strand", "start", "stop"))
    out = x.select(*iv.KEYS, "locus_id", F.col("id").alias("a"), F.when(plus, F.col("stop") + 1).otherwise(F.col("start") - 1).alias("p5"))
    into = x.select(*iv.KEYS, "locus_id", F.col("id").alias("b"), F.when(plus, F.col("start") - 1).otherwise(F.col("stop") + 1).alias("p3"))
    j = accepted.select(*iv.KEYS, F.when(plus, F.col("start")).otherwise(F.col("stop")).alias("p5"), F.when(plus, F.col("stop")).otherwise(F.col("start")).alias("p3")).distinct()
    return out.join(j, [*iv.KEYS, "p5"]).join(into, [*iv.KEYS, "locus_id", "p3"]).select("locus_id", "a", "b").distinct()


def isoforms(located: DataFrame, accepted: DataFrame, config: Config | None = None) -> DataFrame:
    """Paths of exons through accepted junctions, by locus; loci over max_isoforms are left out and listed by skipped()."""
    return graph.enumerate_paths(exon_edges(located, accepted), (config or Config()).max_isoforms)


def skipped(located: DataFrame, accepted: DataFrame, config: Config | None = None) -> DataFrame:
    """Loci of which isoforms() leaves paths out."""
    return graph.skipped_loci(exon_edges(located, accepted), (config or Config()).max_isoforms)


def isoform_features(paths: DataFrame) -> DataFrame:
    """isoforms() as features to be written: one exon row for each member of a path, with transcript_id = locus.k counted over the locus."""
    number = F.row_number().over(Window.partitionBy("locus_id").orderBy("first", "k")) - 1
    member = paths.withColumn("transcript_id", F.concat_ws(".", "locus_id", number.cast("string"))).select("locus_id", "transcript_id", F.posexplode("path").alias("nth", "id"))
    part = F.split("id", ":")
    return member.select(part[0].alias("chr"), part[1].alias("strand"), part[2].cast("int").alias("start"), part[3].cast("int").alias("stop"), F.lit("exon").alias("type"), "locus_id", "transcript_id", "nth")


def diff(located: DataFrame, reference: DataFrame) -> DataFrame:
    """Each locus with the reference transcripts and genes that its exons overlap, and those with which it shares a 5' or 3' end."""
    r = reference.select(*iv.KEYS, "start", "stop", "transcript_id", "gene_id")
    hits = iv.overlap_join(located.select(*iv.KEYS, "start", "stop", "locus_id"), r, suffix="_r")
    same = lambda f, name: F.array_sort(F.collect_set(F.when(f, F.col(name))))
    start, stop = F.col("start") == F.col("start_r"), F.col("stop") == F.col("stop_r")
    plus = F.col("strand") == "+"
    five, three = F.when(plus, start).otherwise(stop), F.when(plus, stop).otherwise(start)
    return hits.groupBy("locus_id").agg(
        same(F.lit(True), "transcript_id_r").alias("transcripts"), same(F.lit(True), "gene_id_r").alias("genes"), same(five, "transcript_id_r").alias("same_5p"), same(three, "transcript_id_r").alias("same_3p")
    )
