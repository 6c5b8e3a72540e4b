"""Exons from expressed segments and junctions, and the filters on change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.operators.intervals import KEYS, coalesce_intervals, downstream, five_prime, fragment, intersect, opposite, overlap_join, overlap_semi, subtract, three_prime, upstream


def infer_strand(segments: DataFrame, juncs: DataFrame) -> DataFrame:
    """Unstranded segments (chr, start, stop) with the strands of the junctions whose flanks touch them; '.' where none does."""
    flank = juncs.select("chr", "strand", F.explode(F.array(F.col("start") - 1, F.col("stop") + 1)).alias("start")).withColumn("stop", F.col("start"))
    plain = segments.select("chr", "start", "stop").distinct()
    hits = overlap_join(plain, flank, suffix="_j", keys=["chr"]).select("chr", "start", "stop", F.col("strand_j").alias("strand")).distinct()
    rest = plain.join(hits, ["chr", "start", "stop"], "left_anti").withColumn("strand", F.lit("."))
    return hits.unionByName(rest)


def spliced_exons(segments: DataFrame, juncs: DataFrame) -> DataFrame:
    """(chr, strand, start, stop, type): exons between acceptors and donors of a segment.

    internal: from after an acceptor to before a donor further down, unless a junction lies within; 5p: from the segment's 5' end to a
    donor with no such acceptor; 3p: from an acceptor with no such donor to the segment's 3' end; neither holds a junction.
    """
    plus = F.col("strand") == "+"
    ends = juncs.select(*KEYS, F.explode(F.array(
        F.struct(F.when(plus, F.col("start")).otherwise(F.col("stop")).alias("pos"), F.lit("donor").alias("kind")), F.struct(F.when(plus, F.col("stop")).otherwise(F.col("start")).alias("pos"), F.lit("acceptor").alias("kind")),
    )).alias("x")).select(*KEYS, "x.*").distinct()
    seg = segments.select(*KEYS, F.col("start").alias("s"), F.col("stop").alias("e"), (F.col("start") - 1).alias("start"), (F.col("stop") + 1).alias("stop"))
    at = overlap_join(seg, ends.select(*KEYS, F.col("pos").alias("start"), F.col("pos").alias("stop"), "kind"), suffix="_p").select(*KEYS, "s", "e", F.col("start_p").alias("pos"), F.col("kind_p").alias("kind"))
    donors, acceptors = (at.where(F.col("kind") == k).select(*KEYS, "s", "e", F.col("pos").alias(k)) for k in ("donor", "acceptor"))
    # an internal exon lies between a left site (acceptor on +, donor on -) and a right one; it may not hold a junction, so the left
    # site isn't before the last start of the junctions that end before the right site
    side = F.when((F.col("kind") == "acceptor") == plus, "left").otherwise("right")
    marks = at.select(*KEYS, "s", "e", F.col("pos").alias("p"), side.alias("what"), F.lit(None).cast("int").alias("from"))
    within = overlap_join(seg, juncs.select(*KEYS, "start", "stop").distinct(), suffix="_j", condition=(F.col("start_j") >= F.col("start")) & (F.col("stop_j") <= F.col("stop")))
    marks = marks.unionByName(within.select(*KEYS, "s", "e", F.col("stop_j").alias("p"), F.lit("junction").alias("what"), F.col("start_j").cast("int").alias("from")))
    before = Window.partitionBy(*KEYS, "s", "e").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    right = marks.withColumn("from", F.max("from").over(before)).where("what = 'right'").select(*KEYS, "s", "e", F.col("p").alias("right"), F.coalesce("from", F.col("s") - 1).alias("start"), (F.col("p") - 2).alias("stop"))
    left = at.where(side == "left").select(*KEYS, F.col("pos").alias("start"), F.col("pos").alias("stop"), F.col("s").alias("s"))
    internal = overlap_join(right.where("stop >= start"), left, suffix="_l", condition=F.col("s") == F.col("s_l"))
    internal = internal.select(*KEYS, (F.col("start_l") + 1).alias("start"), (F.col("right") - 1).alias("stop"), F.lit("internal_exon").alias("type")).distinct()
    # a donor is first if its segment has no acceptor at least 2 upstream, an acceptor is last if there is no donor downstream
    up = lambda c: F.when(plus, F.col(c)).otherwise(-F.col(c))
    far = donors.groupBy(*KEYS, "s", "e").agg(F.max(up("donor")).alias("far"))
    near = acceptors.groupBy(*KEYS, "s", "e").agg(F.min(up("acceptor")).alias("near"))
    first = donors.join(near, [*KEYS, "s", "e"], "left").where(F.col("near").isNull() | (up("donor") - F.col("near") < 2))
    first = first.select(*KEYS, F.when(plus, F.col("s")).otherwise(F.col("donor") + 1).alias("start"), F.when(plus, F.col("donor") - 1).otherwise(F.col("e")).alias("stop"), F.lit("5p_exon").alias("type"))
    last = acceptors.join(far, [*KEYS, "s", "e"], "left").where(F.col("far").isNull() | (F.col("far") - up("acceptor") < 2))
    last = last.select(*KEYS, F.when(plus, F.col("acceptor") + 1).otherwise(F.col("s")).alias("start"), F.when(plus, F.col("e")).otherwise(F.col("acceptor") - 1).alias("stop"), F.lit("3p_exon").alias("type"))
    holds = (F.col("start_j") >= F.col("start")) & (F.col("stop_j") <= F.col("stop"))
    terminal = overlap_semi(first.unionByName(last).where("stop >= start").distinct(), juncs, anti=True, condition=holds, suffix="_j")
    return internal.unionByName(terminal).where("stop >= start").distinct()


def unspliced_remainder(segments: DataFrame, exons: DataFrame) -> DataFrame:
    """What exons leave of the segments."""
    return subtract(segments, exons)


def is_five_prime() -> Column:
    """Whether a change point (before, after, strand) begins a transcript: coverage rises in the direction of the strand."""
    return (F.col("before") < F.col("after")) != (F.col("strand") == "-")


def running_best(points: DataFrame, segment: list[str], five: bool = False) -> DataFrame:
    """Change points (pos, before, after, strand) whose level inside the transcript exceeds that of all points further out in their segment.

    3' ends are seen from the far end of the transcript (the level inside is upstream); 5' ends, with ``five``, mirror it.
    """
    rising = (F.col("strand") == "+") != F.lit(five)
    one = points.groupBy(*segment, "strand", "pos").agg(F.min("before").alias("before"), F.min("after").alias("after"))
    order = Window.partitionBy(*segment, "strand").orderBy(F.when(rising, -F.col("pos")).otherwise(F.col("pos"))).rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("_level", F.when(rising, F.col("before")).otherwise(F.col("after")))
    return one.withColumn("_best", F.coalesce(F.max("_level").over(order), F.lit(0.0))).where("_level > _best").drop("_level", "_best")


def filter_change_points(points: DataFrame, exons: DataFrame, accepted: DataFrame, radius: int) -> DataFrame:
    """Change points (chr, strand, pos, before, after ..), one for each place: 5' ends with no accepted junction's 3' end within radius and 3' ends
    with no 5' end within it, that are running maxima in every elementary fragment of the exons that they lie in.
    """
    ends = accepted.select(*KEYS, five_prime().alias("p5"), three_prime().alias("p3"))
    once = points.dropDuplicates([*KEYS, "pos"])
    parts = []
    for five, end in ((True, "p3"), (False, "p5")):
        away = away_from(once.where(is_five_prime() == F.lit(five)), ends.select(*KEYS, F.col(end).alias("pos")), radius)
        inside = overlap_join(away.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos")), fragment(exons), suffix="_f")
        best = running_best(inside.select(*KEYS, "start_f", "stop_f", "pos", "before", "after"), ["chr", "start_f", "stop_f"], five)
        lost = inside.join(best.select(*KEYS, "start_f", "stop_f", "pos"), [*KEYS, "start_f", "stop_f", "pos"], "left_anti").select(*KEYS, "pos").distinct()
        parts.append(away.join(lost, [*KEYS, "pos"], "left_anti"))
    return parts[0].unionByName(parts[1])


def change_point_exons(points: DataFrame, exons: DataFrame) -> DataFrame:
    """(chr, strand, start, stop, type): the part of each exon from its 3' end to a 5' change point in it, and from its 5' end to a 3' one.

    5' points cut 5p and internal exons, 3' points 3p and internal ones; what a cut leaves of an internal exon is terminal.
    """
    hit = overlap_join(points.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos")), exons.select(*KEYS, "start", "stop", "type"), suffix="_x")
    kind = F.when(is_five_prime(), "5p_exon").otherwise("3p_exon")
    plus = F.col("strand") == "+"
    keeps_stop = is_five_prime() == plus
    cut = hit.where((F.col("type_x") == "internal_exon") | (F.col("type_x") == kind))
    return cut.select(*KEYS, F.when(keeps_stop, F.col("pos")).otherwise(F.col("start_x")).alias("start"), F.when(keeps_stop, F.col("stop_x")).otherwise(F.col("pos")).alias("stop"), kind.alias("type")).distinct()


def eligible_segments(exons: DataFrame, bin_width: int, min_terminal: int, internal: bool = False) -> DataFrame:
    """(chr, strand, start, stop, type, mode): the windows in which change points are sought.

    Of the elementary fragments of the exons those whose exons are all of one type, with at least two bins once min_terminal is added. Windows of
    terminal exons are wider by min_terminal at the outer end, and coverage may only rise (5p) or fall (3p) in the direction of the strand;
    internal exons (on request) have no direction.
    """
    pieces = fragment(exons).where(F.col("stop") - F.col("start") + 1 + min_terminal >= 2 * bin_width)
    typed = overlap_join(pieces, exons.select(*KEYS, "start", "stop", "type"), suffix="_x").groupBy(*KEYS, "start", "stop").agg(F.min("type_x").alias("type"), F.max("type_x").alias("_other")).where("type = _other").drop("_other")
    low = ((F.col("type") == "5p_exon") & (F.col("strand") == "+")) | ((F.col("type") == "3p_exon") & (F.col("strand") == "-"))
    high = ((F.col("type") == "5p_exon") & (F.col("strand") == "-")) | ((F.col("type") == "3p_exon") & (F.col("strand") == "+"))
    mode = F.when(low, "increasing").when(high, "decreasing").otherwise("fold")
    wide = typed.select(*KEYS, (F.col("start") - F.when(low, min_terminal).otherwise(0)).alias("start"), (F.col("stop") + F.when(high, min_terminal).otherwise(0)).alias("stop"), "type", mode.alias("mode"))
    return wide if internal else wide.where("mode <> 'fold'")


def trim_antisense(exons: DataFrame) -> DataFrame:
    """Exons (chr, strand, start, stop, type) with terminal ones that meet an antisense stretch cut back.

    An antisense stretch is a part of both strands' unions. A 3p exon that overlaps one then runs from its 5' end to the nearest 5' end of an
    exon of the other strand that lies upstream as seen from that strand; a 5p exon from the nearest 3' end downstream as seen from there to its 3' end. Where there is no such end, the exon stays.
    An exon of one base keeps its start and only its stop moves.
    """
    union = coalesce_intervals(exons)
    sides = [union.where(F.col("strand") == s).withColumn("strand", F.lit(".")) for s in "+-"]
    both = intersect(*sides).drop("strand")
    both = both.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    hit, rest = overlap_semi(exons, both), overlap_semi(exons, both, anti=True)
    ends = lambda c: exons.select("chr", "strand", c.cast("int").alias("site")).distinct()
    turned = hit.withColumn("own", F.col("strand")).withColumn("strand", opposite())
    own5 = F.when(F.col("own") == "+", F.col("start")).otherwise(F.col("stop"))
    own3 = F.when(F.col("own") == "+", F.col("stop")).otherwise(F.col("start"))
    last = upstream(turned.where("type = '3p_exon'").withColumn("pos", own5), ends(five_prime()))
    first = downstream(turned.where("type = '5p_exon'").withColumn("pos", own3), ends(three_prime()))
    cut = last.unionByName(first)
    # as in the SQL, an exon of one base is kept by its start, so only its stop can move
    begins = F.col("pos") == F.col("start")
    start = F.when(begins, F.col("start")).otherwise(F.least("pos", F.coalesce("site", "start")))
    stop = F.when(begins, F.greatest("pos", F.coalesce("site", "stop"))).otherwise(F.col("stop"))
    cut = cut.withColumn("_s", start).withColumn("_e", stop).withColumn("strand", F.col("own"))
    cut = cut.select(*[F.col("_s").alias(c) if c == "start" else F.col("_e").alias(c) if c == "stop" else F.col(c) for c in exons.columns])
    return rest.unionByName(hit.where("type = 'internal_exon'")).unionByName(cut)


def bridge_known(segments: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    """Segments merged within radius, and across the gaps that a known region (chr, start, stop) explains.

    Known regions are merged within radius without a strand. One that overlaps several segments of a strand ties them: from the first of their
    stops to the last of their starts, where the latter is further on.
    """
    merged = coalesce_intervals(segments, radius)
    regions = coalesce_intervals(known.select("chr", F.lit(".").alias("strand"), "start", "stop"), radius).select("chr", "start", "stop").withColumn("region", F.xxhash64("chr", "start"))
    met = overlap_join(regions, merged, suffix="_s", keys=["chr"]).groupBy("region", "chr", F.col("strand_s").alias("strand")).agg(F.min("stop_s").alias("start"), F.max("start_s").alias("stop"))
    return coalesce_intervals(merged.unionByName(met.where("stop > start").select(*KEYS, "start", "stop")), radius)


def away_from(points: DataFrame, sites: DataFrame, radius: int) -> DataFrame:
    """Points (chr, strand, pos) with no site (chr, strand, pos) within radius."""
    near = sites.select(*KEYS, (F.col("pos") - radius).alias("start"), (F.col("pos") + radius).alias("stop"))
    at = points.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos"))
    return overlap_semi(at, near, anti=True).select(*points.columns)


def label_roles(exons: DataFrame, by: str = "transcript_id") -> DataFrame:
    """exons with their role in the transcript, in the direction of the strand."""
    order = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    w = Window.partitionBy(by).orderBy(order, "stop")
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(by))
    return exons.withColumn("_k", k).withColumn("_n", n).withColumn("role", F.when(F.col("_n") == 1, "unspliced").when(F.col("_k") == 1, "5p_exon").when(F.col("_k") == F.col("_n"), "3p_exon").otherwise("internal_exon")).drop("_k", "_n")


def usage(up: str, down: str):
    """Site usage: 1 - min(downstream / upstream, 1)."""
    return F.lit(1.0) - F.least(F.try_divide(F.col(down), F.col(up)), F.lit(1.0))
