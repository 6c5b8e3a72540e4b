"""Splice junctions: CIGAR blocks, junction and site counts, and the test that accepts or rejects junctions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.operators.intervals import KEYS, _count_overlaps, five_prime, overlap_join, three_prime

BLOCK = "array<struct<op:string,start:int,stop:int>>"
#: ln(n!) as the C library's lgamma has it, to the last bit.
LOG_FACTORIALS = [
    0.0, 0.0, 0.6931471805599453, 1.791759469228055, 3.1780538303479458, 4.787491742782046, 6.579251212010101, 8.525161361065413, 10.60460290274525,
    12.80182748008147, 15.104412573075518, 17.502307845873887, 19.98721449566189, 22.55216385312342, 25.19122118273868, 27.89927138384089, 30.671860106080675,
]
#: Up to so many reads of a site all terms of its tail are summed, with these.
FEW = len(LOG_FACTORIALS) - 1
#: Probabilities this close are ties.
TIE = 1e-9


def blocks(cigar: str = "cigar", start: str = "start") -> Column:
    """The reference spans of a CIGAR's elements; an element that consumes no reference has stop = start - 1."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    parts = F.arrays_zip(F.regexp_extract_all(cigar, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("op"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"].cast("int")).otherwise(F.lit(0))
        one = F.struct(x["op"].alias("op"), s["at"].alias("start"), (s["at"] + n - 1).alias("stop"))
        return F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(parts, F.struct(F.col(start).alias("at"), F.array().cast(BLOCK).alias("out")), step)["out"]


def introns(rows: DataFrame) -> DataFrame:
    """(chr, strand, start, stop) of every N block of every read."""
    return rows.select(*KEYS, F.explode(F.filter(blocks(), lambda b: b["op"] == "N")).alias("b")).select(*KEYS, "b.start", "b.stop")


def aligned(rows: DataFrame, *extra: str) -> DataFrame:
    """(chr, strand, start, stop) of the blocks that consume read and reference."""
    return rows.select(*KEYS, *extra, F.explode(F.filter(blocks(), lambda b: b["op"].isin("M", "=", "X"))).alias("b")).select(*KEYS, *extra, "b.start", "b.stop")


def all_consume_reference(cigar: str = "cigar") -> Column:
    return ~F.col(cigar).rlike("[ISHP]")


def junctions(rows: DataFrame) -> DataFrame:
    """Distinct introns with the reads that support each."""
    return introns(rows).groupBy(*KEYS, "start", "stop").agg(F.count(F.lit(1)).alias("n"))


def site_counts(rows: DataFrame) -> DataFrame:
    """(chr, strand, pos, side, e, i): for each 5' and 3' site the reads spliced there and those aligned across it.

    On '+' the 5' site is the intron's first base and the 3' site its last; on '-' the other way round. A read spans a first base
    with that base and the one before it in one block, a last base with the one after it.
    """
    j = junctions(rows)
    sites = j.select(*KEYS, "n", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit("left").alias("edge")), F.struct(F.col("stop").alias("pos"), F.lit("right").alias("edge")))).alias("x"))
    sites = sites.select(*KEYS, "x.*", "n").groupBy(*KEYS, "pos", "edge").agg(F.sum("n").alias("e"))
    # a block holds pos and the base beside it if it reaches, less its last base, over the first of the two
    span = sites.withColumn("start", F.when(F.col("edge") == "left", F.col("pos") - 1).otherwise(F.col("pos"))).withColumn("stop", F.col("start"))
    crossed = _count_overlaps(span, aligned(rows).where("stop > start").withColumn("stop", F.col("stop") - 1), KEYS, "i")
    side = F.when((F.col("strand") == "+") == (F.col("edge") == "left"), "5p").otherwise("3p")
    return crossed.select(*KEYS, "pos", side.alias("side"), "e", "i")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series, ten places further on."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    below = x
    for k in range(1, 10):
        below = below * (x + float(k))
    return series - F.log(below)


def binomial_tail(i: Column, e: Column) -> Column:
    """P(Bin(i + e, 1/2) <= i).

    The smaller of both tails is summed from its largest term on; terms fall at least as a normal density does, so 10 standard deviations of
    them, a number that grows with the root of the depth, hold all but 1e-20 of it. Up to FEW reads all terms are summed in order, with the
    very operations of the SQL: tails as 1/128 (of 7 and 10 reads) lie half-way between two figures of six digits, and their last bit decides.
    """
    n, low = (i + e).cast("double"), F.least(i, e - 1).cast("double")
    first = log_gamma(n + 1) - log_gamma(low + 1) - log_gamma(n - low + 1) - n * 0.6931471805599453

    def step(s: Column, k: Column) -> Column:
        term = s["t"] * (low - k + 1) / (n - low + k)
        return F.struct(term.alias("t"), (s["p"] + term).alias("p"))

    many = F.least(low, F.ceil(F.sqrt(n) * 5) + 20).cast("long")
    ks = F.when(many > 0, F.sequence(F.lit(1).cast("long"), many)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(ks, F.struct(F.exp(first).alias("t"), F.exp(first).alias("p")), step)["p"]
    reads, log = (i + e).cast("int"), F.array(*[F.lit(v) for v in LOG_FACTORIALS])
    one = lambda k: F.exp(log[reads] - log[k] - log[reads - k] - reads * F.lit(math.log(2.0)))
    plain = F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), i.cast("int")), F.lit(0.0), lambda s, k: s + one(k)))
    return F.when(e <= 0, 1.0).when(i + e <= FEW, plain).when(low == i, tail).otherwise(1.0 - tail)


def judge_junctions(juncs: DataFrame, sites: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Junctions with the tail probabilities of both sites and ``accepted``.

    Accepted: both under alpha; or one site passes and this junction is the best of those that share the site, where none of them passes
    at its other site (ties, which are probabilities within TIE, are all kept).
    """
    five = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop"))
    three = F.when(F.col("strand") == "+", F.col("stop")).otherwise(F.col("start"))
    p = sites.withColumn("p", binomial_tail(F.col("i"), F.col("e")))
    side = lambda s, pos, name: p.where(F.col("side") == s).select(*KEYS, F.col("pos").alias(pos), F.col("p").alias(name))
    rows = juncs.withColumn("pos5", five).withColumn("pos3", three).join(side("5p", "pos5", "p5"), [*KEYS, "pos5"]).join(side("3p", "pos3", "p3"), [*KEYS, "pos3"])
    best3 = F.min("p3").over(Window.partitionBy(*KEYS, "pos5"))
    best5 = F.min("p5").over(Window.partitionBy(*KEYS, "pos3"))
    ok5, ok3 = F.col("p5") < alpha, F.col("p3") < alpha
    rows = rows.withColumn("_b3", best3).withColumn("_b5", best5)
    accepted = (ok5 & ok3) | (ok5 & (F.col("_b3") >= alpha) & (F.col("p3") - F.col("_b3") < TIE)) | (ok3 & (F.col("_b5") >= alpha) & (F.col("p5") - F.col("_b5") < TIE))
    return rows.withColumn("accepted", accepted).drop("_b3", "_b5", "pos5", "pos3")


# -- further filters and counts ------------------------------------------------------------------------------------------------


def consistent(rows: DataFrame, xs: str = "xs") -> DataFrame:
    """Reads without those that are spliced and whose strand tag, if any, isn't the strand of the library."""
    return rows.where(~F.col("cigar").contains("N") | F.col(xs).isNull() | (F.col(xs) == F.col("strand")))


def tagged(rows: DataFrame, xs: str = "xs") -> DataFrame:
    """Reads with the strand that the tag names, where there is one."""
    return rows.withColumn("strand", F.coalesce(xs, "strand"))


def replicate_junctions(samples: list[DataFrame]) -> DataFrame:
    """The distinct introns of several samples, with the samples that have each."""
    parts = [introns(s).distinct() for s in samples]
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union.groupBy(*KEYS, "start", "stop").agg(F.count(F.lit(1)).alias("samples"))


def deletions(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.explode(F.filter(blocks(), lambda b: b["op"] == "D")).alias("b")).select(*KEYS, "b.start", "b.stop")


def read_span(cigar: str = "cigar") -> Column:
    """(first, last) index within the read, from 0, of what is aligned; null where nothing is."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    parts = F.arrays_zip(F.regexp_extract_all(cigar, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("op"))

    def step(s: Column, x: Column) -> Column:
        n, hit = x["n"].cast("int"), x["op"].isin("M", "=", "X")
        on = F.when(x["op"].isin("M", "=", "X", "I", "S"), n).otherwise(0)
        return F.struct((s["at"] + on).alias("at"), F.when(hit, F.coalesce(s["first"], s["at"])).otherwise(s["first"]).alias("first"), F.when(hit, s["at"] + n - 1).otherwise(s["last"]).alias("last"))

    out = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")), step)
    return F.struct(out["first"].alias("first"), out["last"].alias("last"))


def terminus(five: bool, library: str = "forward") -> Column:
    """The position of a transcript's end by a read (strand, start, stop) of a forward or reverse library."""
    if library not in ("forward", "reverse"):
        raise ValueError("library must be forward or reverse")
    at_start = (F.col("strand") == "-") != F.lit(five == (library == "forward"))
    return F.when(at_start, F.col("start")).otherwise(F.col("stop"))


def next_aligned(position: Column) -> Column:
    """The read's first aligned position after ``position``; null if there is none."""
    after = F.transform(F.filter(blocks(), lambda b: b["op"].isin("M", "=", "X") & (b["stop"] > position)), lambda b: F.greatest(b["start"], position + 1))
    return F.array_min(after)


def consuming_reads(rows: DataFrame, regions: DataFrame, read: str = "read_id") -> DataFrame:
    """Regions (chr, strand, start, stop) with the number of reads that have an aligned base in them."""
    hit = overlap_join(regions.distinct(), aligned(rows, read), suffix="_b").select(*regions.columns, F.col(f"{read}_b").alias("_read")).distinct()
    return regions.distinct().join(hit.groupBy(*regions.columns).agg(F.count(F.lit(1)).alias("n")), regions.columns, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def terminating_reads(rows: DataFrame, points: DataFrame, five: bool, library: str = "forward") -> DataFrame:
    """Points (chr, strand, pos) with the number of reads whose transcript end is there."""
    ends = rows.select(*KEYS, terminus(five, library).alias("pos")).groupBy(*KEYS, "pos").agg(F.count(F.lit(1)).alias("n"))
    return points.distinct().join(ends, [*KEYS, "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def window_support(rows: DataFrame, juncs: DataFrame, w: int, read: str = "read_id") -> DataFrame:
    """(chr, strand, pos, side, exon, spanning) of the junctions' sites: reads aligned at the exon's base beside the site, and those of them that
    are also aligned w bases into the intron. Give reads of one hit only, if others shouldn't count.
    """
    edges = juncs.select(*KEYS, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(-1).alias("k")), F.struct(F.col("stop").alias("pos"), F.lit(1).alias("k")))).alias("x")).select(*KEYS, "x.*").distinct()
    side = F.when((F.col("strand") == "+") == (F.col("k") == -1), "5p").otherwise("3p")
    parts = aligned(rows, read)
    at = lambda p: overlap_join(edges.withColumn("start", p).withColumn("stop", p), parts, suffix="_b").select(*KEYS, "pos", "k", F.col(f"{read}_b").alias("_read")).distinct()
    exon = at(F.col("pos") + F.col("k")).withColumn("_e", F.lit(1))
    intron = at(F.col("pos") - F.col("k") * w).withColumn("_i", F.lit(1))
    counts = exon.join(intron, [*KEYS, "pos", "k", "_read"], "left").groupBy(*KEYS, "pos", "k").agg(F.count("_e").alias("exon"), F.count("_i").alias("spanning"))
    return edges.join(counts, [*KEYS, "pos", "k"], "left").select(*KEYS, "pos", side.alias("side"), F.coalesce("exon", F.lit(0)).alias("exon"), F.coalesce("spanning", F.lit(0)).alias("spanning"))


def supported(juncs: DataFrame, support: DataFrame) -> DataFrame:
    """Junctions with the support of both sites: exon5, spanning5, exon3, spanning3."""
    out = juncs.withColumn("_5", five_prime()).withColumn("_3", three_prime())
    for n in "53":
        out = out.join(support.where(F.col("side") == f"{n}p").select(*KEYS, F.col("pos").alias(f"_{n}"), F.col("exon").alias(f"exon{n}"), F.col("spanning").alias(f"spanning{n}")), [*KEYS, f"_{n}"])
    return out.drop("_5", "_3")


def ratio_filter(juncs: DataFrame, support: DataFrame, most: float, few: int = 16) -> DataFrame:
    """Junctions of which each site has ``few`` reads at most or at most ``most`` times as many spanning ones as exon ones (none in the exon: over it, unless few)."""
    both = supported(juncs, support)
    ok = lambda n: (F.col(f"spanning{n}") + F.col(f"exon{n}") <= few) | (F.col(f"spanning{n}") <= F.col(f"exon{n}") * most)
    return both.where(ok(5) & ok(3)).select(*juncs.columns)
