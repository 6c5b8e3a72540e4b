"""Further registered queries: change points in all modes, the steps of the assembly, junction filters, annotation and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisweave.operators import annotation, coverage, exons, graph, segmentation, splice
from axisweave.operators import intervals as iv
from axisweave.plans import views
from axisweave.plans.queries import BLOCKS, C, EDGES, EXONS, JUNC, OVERLAP, SEGMENTS, _edges, _segments, ab, query, with_ab, with_splice
from axisweave.plans.views import islands, runs, table

# -- change points of planted steps -------------------------------------------------------------------------------------------

#: Signals of 120 bins of 20 positions, one for each nation: 36 reads a bin or so, then 4 after a cut that differs from nation to nation.
BINS, WIDTH, HIGH, LOW = 120, 20, 36, 4


def signal(spark, sf_dir, samples: int = 1, shape: str = "step"):
    """step: high, then low from bin 40 + n on (for odd n, on -, the other way round). valley: low between 40 + n and 80 + n; peak: high there."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n"))
    rows = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), F.lit(0).alias("_")).select("n", "bin", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s"))
    first, second = F.col("bin") <= 40 + F.col("n"), F.col("bin") <= 80 + F.col("n")
    high = {"step": first == (F.col("n") % 2 == 0), "valley": first | ~second, "peak": ~first & second}[shape]
    noise = (F.col("bin") * 7 + F.col("n") * 3 + F.col("s")) % 3
    y = F.when(high, HIGH + noise).otherwise(LOW + noise) * F.col("s")
    strand = F.when(F.col("n") % 2 == 0, "+").otherwise("-") if shape == "step" else F.lit("+")
    return rows.select(F.concat(F.lit("c"), "n").alias("chr"), strand.alias("strand"), F.lit(1001).alias("start"), F.lit(1000 + BINS * WIDTH).alias("stop"), F.col("s").cast("string").alias("sample"), "bin", y.alias("y"))


def planted(cuts: str, strand: str = "CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END", rising: str = "n_nationkey % 2 = 1", shift: int = 1) -> str:
    return f"SELECT concat('c', n_nationkey) AS chr, {strand} AS strand, cut, CAST(1001 + (cut + CASE WHEN {rising} THEN {shift} ELSE 0 END) * 20 + 10 AS INT) AS pos, true AS sure FROM (SELECT n_nationkey, unnest([{cuts}]) AS cut FROM nation)"


STEP = planted("40 + n_nationkey")
TURN = "40 + n_nationkey, 80 + n_nationkey"


def found(points):
    return points.select("chr", "strand", "cut", "pos", (F.col("confidence") > 0.5).alias("sure"))


@query(STEP)
def change_points(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir), WIDTH))


@query(STEP)
def change_points_fold(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir), WIDTH, mode="fold"))


@query(STEP)
def change_points_monotone(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir), WIDTH, segmentation.Prior(min_fold=1.0)))


@query(planted("40 + n_nationkey", shift=0))
def change_points_joint(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir, samples=2), WIDTH, shift=False))


@query(STEP)
def change_points_free(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir), WIDTH, mode="free"))


@query(STEP)
def change_points_fixed(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir), WIDTH, mode="free", segments=2))


@query(planted("40 + n_nationkey", shift=1))
def change_points_fixed_joint(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir, samples=2), WIDTH, mode="free", segments=2))


@query(planted(TURN, "'+'", "cut >= 80 + n_nationkey"))
def change_points_valley(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir, shape="valley"), WIDTH, mode="valley"))


@query(planted(TURN, "'+'", "cut < 80 + n_nationkey"))
def change_points_peak(spark, sf_dir):
    return found(segmentation.change_points(signal(spark, sf_dir, shape="peak"), WIDTH, mode="peak"))


@query("SELECT concat('c', n_nationkey) AS chr, CAST(40 + n_nationkey AS INT) AS cut FROM nation")
def change_points_sampled(spark, sf_dir):
    return segmentation.sampled_change_points(signal(spark, sf_dir), WIDTH, 100, seed=3).where("share >= 0.5").select("chr", "cut")


# -- steps of the assembly -----------------------------------------------------------------------------------------------------

#: Exons of three types from reads, and change points at the ends of others.
KIND = "CASE read_id % 3 WHEN 0 THEN '5p_exon' WHEN 1 THEN '3p_exon' ELSE 'internal_exon' END"
TYPED = f"ty AS (SELECT DISTINCT chr, strand, start, stop, {KIND} AS type FROM reads WHERE nh = 1)"
POINTS = "po AS (SELECT chr, strand, start AS pos, min(user_id % 50 + 1) AS before, max(user_id % 40 + 1) AS after FROM reads WHERE nh = 3 GROUP BY ALL)"
RISES = "((before < after) <> (strand = '-'))"


def typed_exons(spark, sf_dir):
    r = views.reads(spark, sf_dir).where("nh = 1")
    return r.select("chr", "strand", "start", "stop", F.expr(KIND).alias("type")).distinct()


def points(spark, sf_dir):
    r = views.reads(spark, sf_dir).where("nh = 3")
    return r.groupBy("chr", "strand", F.col("start").alias("pos")).agg(F.min(F.col("user_id") % 50 + 1).cast("double").alias("before"), F.max(F.col("user_id") % 40 + 1).cast("double").alias("after"))


def with_typed(body: str, *parts: str) -> str:
    return f"WITH {views.SQL['reads']}, {TYPED}, {', '.join([POINTS, *parts])} {body}"


@query(with_typed(f"""SELECT DISTINCT a.chr, a.strand, CASE WHEN {RISES.replace("strand", "a.strand")} = (a.strand = '+') THEN a.pos ELSE b.start END AS start, CASE WHEN {RISES.replace("strand", "a.strand")} = (a.strand = '+') THEN b.stop ELSE a.pos END AS stop,
    CASE WHEN {RISES.replace("strand", "a.strand")} THEN '5p_exon' ELSE '3p_exon' END AS type FROM po a JOIN ty b ON a.chr = b.chr AND a.strand = b.strand AND a.pos BETWEEN b.start AND b.stop
    WHERE b.type = 'internal_exon' OR b.type = CASE WHEN {RISES.replace("strand", "a.strand")} THEN '5p_exon' ELSE '3p_exon' END"""))
def change_point_exons(spark, sf_dir):
    return exons.change_point_exons(points(spark, sf_dir), typed_exons(spark, sf_dir))


FRAGMENTS = f"""cu AS (SELECT DISTINCT chr, strand, unnest([start, stop + 1]) AS p FROM ty), cq AS (SELECT chr, strand, p AS start, lead(p) OVER (PARTITION BY chr, strand ORDER BY p) - 1 AS stop FROM cu),
  fr AS (SELECT {C} FROM cq a WHERE stop IS NOT NULL AND EXISTS (SELECT 1 FROM ty b WHERE b.chr = a.chr AND b.strand = a.strand AND b.start <= a.start AND b.stop >= a.stop))"""


@query(with_typed("""SELECT chr, strand, CAST(start - CASE WHEN (type = '5p_exon' AND strand = '+') OR (type = '3p_exon' AND strand = '-') THEN 30 ELSE 0 END AS INT) AS start,
    CAST(stop + CASE WHEN (type = '5p_exon' AND strand = '-') OR (type = '3p_exon' AND strand = '+') THEN 30 ELSE 0 END AS INT) AS stop, type,
    CASE WHEN type = 'internal_exon' THEN 'fold' WHEN (type = '5p_exon') = (strand = '+') THEN 'increasing' ELSE 'decreasing' END AS mode
    FROM (SELECT a.chr, a.strand, a.start, a.stop, min(b.type) AS type, count(DISTINCT b.type) AS n FROM fr a JOIN ty b ON a.chr = b.chr AND a.strand = b.strand AND a.start <= b.stop AND a.stop >= b.start WHERE a.stop - a.start + 1 + 30 >= 40 GROUP BY ALL) WHERE n = 1""", FRAGMENTS))
def eligible_segments(spark, sf_dir):
    return exons.eligible_segments(typed_exons(spark, sf_dir), 20, 30, internal=True)


@query(with_typed("""SELECT chr, strand, pos, before, after FROM po p WHERE {RISES} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ju j WHERE j.chr = p.chr AND j.strand = p.strand AND abs(CASE WHEN ({RISES}) = (p.strand = '+') THEN j.stop ELSE j.start END - p.pos) <= 3)
    AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.chr = p.chr AND l.strand = p.strand AND l.pos = p.pos)""".replace("{RISES}", RISES), FRAGMENTS,
    "ju AS (SELECT DISTINCT chr, strand, start, stop FROM reads WHERE nh = 2)",
    f"""aw AS (SELECT *, {RISES} AS five FROM po p WHERE NOT EXISTS (SELECT 1 FROM ju j WHERE j.chr = p.chr AND j.strand = p.strand AND abs(CASE WHEN ({RISES}) = (p.strand = '+') THEN j.stop ELSE j.start END - p.pos) <= 3))""",
    """ins AS (SELECT aw.*, fr.start AS f0, fr.stop AS f1, CASE WHEN (aw.strand = '+') <> five THEN before ELSE after END AS lev, CASE WHEN (aw.strand = '+') <> five THEN -pos ELSE pos END AS far FROM aw JOIN fr ON fr.chr = aw.chr AND fr.strand = aw.strand AND pos BETWEEN fr.start AND fr.stop)""",
    """lost AS (SELECT chr, strand, pos FROM (SELECT *, coalesce(max(lev) OVER (PARTITION BY chr, strand, f0, f1, five ORDER BY far ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM ins) WHERE lev <= best)"""))
def filtered_change_points(spark, sf_dir):
    juncs = views.reads(spark, sf_dir).where("nh = 2").select("chr", "strand", "start", "stop").distinct()
    return exons.filter_change_points(points(spark, sf_dir), typed_exons(spark, sf_dir), juncs, 3).select("chr", "strand", "pos", "before", "after")


@query(with_typed("""SELECT chr, strand, start, stop, type FROM ty WHERE type = 'internal_exon' OR NOT hit UNION ALL
    SELECT chr, strand, CASE WHEN p = start THEN start ELSE coalesce(least(site, p), start) END AS start, CASE WHEN p = start THEN coalesce(greatest(site, p), stop) ELSE stop END AS stop, type FROM (SELECT chr, strand, start, stop, type, p,
      CASE WHEN (strand = '+') = (type = '3p_exon') THEN (SELECT min(s) FROM en WHERE en.chr = h.chr AND en.strand <> h.strand AND en.type = h.type AND en.s >= h.p) ELSE (SELECT max(s) FROM en WHERE en.chr = h.chr AND en.strand <> h.strand AND en.type = h.type AND en.s <= h.p) END AS site
      FROM (SELECT *, CASE WHEN (strand = '+') = (type = '3p_exon') THEN start ELSE stop END AS p FROM ty WHERE hit AND type <> 'internal_exon') h)""".replace("FROM ty", "FROM tm").replace("WITH tm", "WITH ty"),
    f"un AS ({islands('ty')})", "an AS (SELECT p.chr, greatest(p.start, m.start) AS start, least(p.stop, m.stop) AS stop FROM un p JOIN un m ON p.strand = '+' AND m.strand = '-' AND p.chr = m.chr AND p.start <= m.stop AND p.stop >= m.start)",
    "tm AS (SELECT *, EXISTS (SELECT 1 FROM an WHERE an.chr = ty.chr AND an.start <= ty.stop AND an.stop >= ty.start) AS hit FROM ty)",
    "en AS (SELECT DISTINCT chr, strand, '3p_exon' AS type, CASE strand WHEN '+' THEN start ELSE stop END AS s FROM ty UNION SELECT DISTINCT chr, strand, '5p_exon', CASE strand WHEN '+' THEN stop ELSE start END FROM ty)"))
def antisense_trimming(spark, sf_dir):
    return exons.trim_antisense(typed_exons(spark, sf_dir))


@query(with_ab(f""", ms AS ({islands('a', 5)}), kr AS (SELECT chr, '.' AS strand, start, start + 20 AS stop FROM b), kn AS ({islands('kr', 5)}),
    br AS (SELECT m.chr, m.strand, min(m.stop) AS start, max(m.start) AS stop FROM kn k JOIN ms m ON m.chr = k.chr AND m.start <= k.stop AND m.stop >= k.start GROUP BY m.chr, m.strand, k.start),
    al AS (SELECT * FROM ms UNION ALL SELECT * FROM br WHERE stop > start) {islands('al', 5)}"""))
def bridged_segments(spark, sf_dir):
    a, b = ab(spark, sf_dir)
    return exons.bridge_known(a, b.select("chr", "start", (F.col("start") + 20).alias("stop")), 5)


UNSPLICED = f""", dl AS (SELECT chr, strand, pos, sum(da) AS da, sum(db) AS db FROM (SELECT chr, strand, start AS pos, 1 AS da, 0 AS db FROM s UNION ALL SELECT chr, strand, stop + 1, -1, 0 FROM s
  UNION ALL SELECT chr, strand, start, 0, 1 FROM exs UNION ALL SELECT chr, strand, stop + 1, 0, -1 FROM exs) GROUP BY ALL),
  du AS (SELECT chr, strand, pos AS start, lead(pos) OVER w - 1 AS stop, sum(da) OVER w AS na, sum(db) OVER w AS nb FROM dl WINDOW w AS (PARTITION BY chr, strand ORDER BY pos)),
  uk AS (SELECT {C} FROM du WHERE na > 0 AND nb = 0) {islands('uk')}"""


@query(with_splice("", JUNC, BLOCKS, SEGMENTS, EXONS).rstrip() + UNSPLICED)
def unspliced_remainder(spark, sf_dir):
    s, j = _segments(spark, sf_dir)
    return exons.unspliced_remainder(s, exons.spliced_exons(s, j))


@query(with_ab(f""", u AS (SELECT DISTINCT {C} FROM a), cu AS (SELECT DISTINCT chr, strand, unnest([start, stop + 1]) AS p FROM u), cq AS (SELECT chr, strand, p AS start, lead(p) OVER (PARTITION BY chr, strand ORDER BY p) - 1 AS stop FROM cu),
  g AS (SELECT {C} FROM cq a WHERE stop IS NOT NULL AND EXISTS (SELECT 1 FROM u b WHERE b.chr = a.chr AND b.strand = a.strand AND b.start <= a.start AND b.stop >= a.stop)),
  d AS ({runs('reads')}), h AS (SELECT a.chr, a.strand, a.start, a.stop, b.depth, least(a.stop, b.stop) - greatest(a.start, b.start) + 1 AS n FROM g a JOIN d b ON {OVERLAP}),
  e AS (SELECT chr, strand, start, stop, depth, unnest(generate_series(1, CAST(n AS BIGINT))) FROM h), m AS (SELECT {C}, median(depth) AS coverage FROM e GROUP BY ALL)
  SELECT u.chr, u.strand, u.start, u.stop, min(m.coverage) AS coverage FROM u JOIN m ON m.chr = u.chr AND m.strand = u.strand AND m.start >= u.start AND m.stop <= u.stop GROUP BY ALL"""))
def least_fragment_median(spark, sf_dir):
    a, _ = ab(spark, sf_dir)
    return coverage.least_fragment_median(views.reads(spark, sf_dir), a)


# -- reads, junctions and sites ------------------------------------------------------------------------------------------------

BLOCKS_OF = "br AS (SELECT read_id, chr, strand, start, start + b1 - 1 AS stop FROM alignments UNION ALL SELECT read_id, chr, strand, start + b1 + gap, start + b1 + gap + b2 - 1 FROM alignments WHERE spliced)"
XS = "CASE read_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE strand END"


@query(with_splice("SELECT a.chr, a.strand, a.start, a.stop, count(DISTINCT b.read_id) AS n FROM pq a LEFT JOIN br b ON a.chr = b.chr AND a.strand = b.strand AND a.start <= b.stop AND a.stop >= b.start GROUP BY ALL", BLOCKS_OF, "pq AS (SELECT DISTINCT chr, strand, CAST(start + 7 AS INT) AS start, CAST(start + 12 AS INT) AS stop FROM alignments WHERE read_id % 4 = 1)"))
def consuming_reads(spark, sf_dir):
    a = views.alignments(spark, sf_dir)
    regions = a.where("read_id % 4 = 1").select("chr", "strand", (F.col("start") + 7).alias("start"), (F.col("start") + 12).alias("stop")).distinct()
    return splice.consuming_reads(a, regions)


@query("WITH " + views.SQL["reads"] + " SELECT p.chr, p.strand, p.pos, count(r.read_id) AS n FROM (SELECT DISTINCT chr, strand, start AS pos FROM reads) p LEFT JOIN reads r ON r.chr = p.chr AND r.strand = p.strand AND CASE r.strand WHEN '+' THEN r.stop ELSE r.start END = p.pos GROUP BY ALL")
def terminating_reads(spark, sf_dir):
    r = views.reads(spark, sf_dir)
    return splice.terminating_reads(r, r.select("chr", "strand", F.col("start").alias("pos")), five=False)


SUPPORT = """ed AS (SELECT chr, strand, start AS pos, -1 AS k FROM j UNION SELECT chr, strand, stop, 1 FROM j),
  su AS (SELECT ed.chr, ed.strand, ed.pos, CASE WHEN (ed.strand = '+') = (k = -1) THEN '5p' ELSE '3p' END AS side,
    (SELECT count(DISTINCT x.read_id) FROM br x WHERE x.chr = ed.chr AND x.strand = ed.strand AND ed.pos + k BETWEEN x.start AND x.stop) AS exon,
    (SELECT count(DISTINCT x.read_id) FROM br x JOIN br y USING (read_id) WHERE x.chr = ed.chr AND x.strand = ed.strand AND ed.pos + k BETWEEN x.start AND x.stop AND ed.pos - k * 3 BETWEEN y.start AND y.stop) AS spanning FROM ed)"""


@query(with_splice("SELECT chr, strand, pos, side, exon, spanning FROM su", JUNC, BLOCKS_OF, SUPPORT))
def window_support(spark, sf_dir):
    a = views.alignments(spark, sf_dir)
    return splice.window_support(a, splice.junctions(a), 3)


SUPPORTED = """sj AS (SELECT j.*, f.exon AS exon5, f.spanning AS spanning5, t.exon AS exon3, t.spanning AS spanning3 FROM j
  JOIN su f ON f.side = '5p' AND f.chr = j.chr AND f.strand = j.strand AND f.pos = CASE j.strand WHEN '+' THEN j.start ELSE j.stop END
  JOIN su t ON t.side = '3p' AND t.chr = j.chr AND t.strand = j.strand AND t.pos = CASE j.strand WHEN '+' THEN j.stop ELSE j.start END)"""


@query(with_splice("SELECT * FROM sj", JUNC, BLOCKS_OF, SUPPORT, SUPPORTED))
def junction_support(spark, sf_dir):
    a = views.alignments(spark, sf_dir)
    j = splice.junctions(a)
    return splice.supported(j, splice.window_support(a, j, 3))


@query(with_splice("SELECT chr, strand, start, stop, n FROM sj WHERE (exon5 + spanning5 <= 2 OR spanning5 <= 0.5 * exon5) AND (exon3 + spanning3 <= 2 OR spanning3 <= 0.5 * exon3)", JUNC, BLOCKS_OF, SUPPORT, SUPPORTED))
def ratio_filter(spark, sf_dir):
    a = views.alignments(spark, sf_dir)
    j = splice.junctions(a)
    return splice.ratio_filter(j, splice.window_support(a, j, 3), 0.5, few=2)


@query(with_splice(f"SELECT read_id FROM (SELECT *, {XS} AS xs FROM alignments) WHERE NOT spliced OR xs IS NULL OR xs = strand", JUNC))
def strand_consistency(spark, sf_dir):
    return splice.consistent(views.alignments(spark, sf_dir).withColumn("xs", F.expr(XS))).select("read_id")


@query("WITH " + views.SQL["reads"] + f", tg AS (SELECT chr, coalesce({XS}, strand) AS strand, start, stop FROM reads) {runs('tg')}")
def tagged_coverage(spark, sf_dir):
    return iv.depth_runs(splice.tagged(views.reads(spark, sf_dir).withColumn("xs", F.expr(XS))))


@query(with_splice("SELECT chr, strand, start, stop, count(DISTINCT part) AS samples FROM (SELECT chr, strand, CAST(start + b1 AS INT) AS start, CAST(start + b1 + gap - 1 AS INT) AS stop, read_id % 3 AS part FROM alignments WHERE spliced) GROUP BY ALL", JUNC))
def replicate_junctions(spark, sf_dir):
    a = views.alignments(spark, sf_dir)
    return splice.replicate_junctions([a.where(F.col("read_id") % 3 == k) for k in range(3)])


def _edited(spark, sf_dir):
    """Reads with a clipped start, a deletion and an insertion: 3S 5M 2D 7M 1I 4M."""
    return views.alignments(spark, sf_dir).withColumn("cigar", F.lit("3S5M2D7M1I4M"))


@query(with_splice("SELECT chr, strand, CAST(start + 5 AS INT) AS start, CAST(start + 6 AS INT) AS stop, count(*) AS n FROM alignments GROUP BY ALL", JUNC))
def deletions(spark, sf_dir):
    return splice.deletions(_edited(spark, sf_dir)).groupBy("chr", "strand", "start", "stop").agg(F.count("*").alias("n"))


@query(with_splice("SELECT read_id, 3 AS first, 19 AS last, CAST(start + 7 AS INT) AS next FROM alignments", JUNC))
def read_positions(spark, sf_dir):
    span = splice.read_span()
    return _edited(spark, sf_dir).select("read_id", span["first"].alias("first"), span["last"].alias("last"), splice.next_aligned(F.col("start") + 4).alias("next"))


@query("WITH " + views.SQL["reads"] + " SELECT read_id, CASE strand WHEN '+' THEN start ELSE stop END AS forward5, CASE strand WHEN '+' THEN stop ELSE start END AS forward3, CASE strand WHEN '+' THEN stop ELSE start END AS reverse5 FROM reads")
def transcript_termini(spark, sf_dir):
    return views.reads(spark, sf_dir).select("read_id", splice.terminus(True).alias("forward5"), splice.terminus(False).alias("forward3"), splice.terminus(True, "reverse").alias("reverse5"))


@query("WITH " + views.SQL["reads"] + " SELECT a.read_id, b.read_id AS other, CAST(CASE a.strand WHEN '-' THEN a.start - b.start ELSE b.start - a.start END AS INT) AS offset, CAST(greatest(0, greatest(a.start, b.start) - least(a.stop, b.stop)) AS INT) AS distance FROM reads a JOIN reads b ON a.user_id = b.user_id AND a.chr = b.chr AND a.read_id < b.read_id")
def signed_distances(spark, sf_dir):
    r = views.reads(spark, sf_dir).select("read_id", "chr", "strand", "user_id", "start", "stop")
    pairs = r.join(r.select("chr", "user_id", F.col("read_id").alias("other"), F.col("start").alias("s"), F.col("stop").alias("e")), ["chr", "user_id"]).where("read_id < other")
    return pairs.select("read_id", "other", F.when(F.col("strand") == "-", F.col("start") - F.col("s")).otherwise(F.col("s") - F.col("start")).alias("offset"), F.greatest(F.lit(0), F.greatest("start", "s") - F.least("stop", "e")).alias("distance"))


# -- annotation ----------------------------------------------------------------------------------------------------------------

#: An order's shipped lines are a transcript's exons; the second line's exon is coding.
EX = "ex AS (SELECT 'o' AS chr, '+' AS strand, l_orderkey AS transcript_id, CAST(date_diff('day', date '1990-01-01', l_shipdate) AS INT) AS start, CAST(date_diff('day', date '1990-01-01', l_shipdate) + CAST(l_quantity AS INT) % 9 AS INT) AS stop, l_linenumber FROM lineitem)"
GAPS = "mx AS (SELECT *, max(stop) OVER (PARTITION BY transcript_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ex), ga AS (SELECT chr, strand, transcript_id, CAST(before + 1 AS INT) AS start, CAST(start - 1 AS INT) AS stop FROM mx WHERE start > before + 1)"


def order_exons(spark, sf_dir):
    d = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(F.lit("o").alias("chr"), F.lit("+").alias("strand"), F.col("l_orderkey").alias("transcript_id"), d.alias("start"), (d + F.col("l_quantity").cast("int") % 9).cast("int").alias("stop"), "l_linenumber")


@query(f"WITH {EX}, {GAPS} SELECT * FROM ga")
def transcript_introns(spark, sf_dir):
    return annotation.introns(order_exons(spark, sf_dir), tasks=annotation.tasks_for(table(spark, sf_dir, "lineitem")))


@query(f"""WITH {EX}, cd AS (SELECT transcript_id, min(start) AS c0, max(stop) AS c1 FROM ex WHERE l_linenumber = 2 GROUP BY ALL), po AS (SELECT DISTINCT transcript_id, p FROM (SELECT transcript_id, unnest(generate_series(start, stop)) AS p FROM ex)),
  pp AS (SELECT po.transcript_id, p, c0 FROM po JOIN cd USING (transcript_id) WHERE p < c0 OR p > c1), rr AS (SELECT *, p - row_number() OVER (PARTITION BY transcript_id ORDER BY p) AS run FROM pp)
  SELECT 'o' AS chr, '+' AS strand, transcript_id, CAST(min(p) AS INT) AS start, CAST(max(p) AS INT) AS stop, CASE WHEN max(p) < any_value(c0) THEN '5p' ELSE '3p' END AS side FROM rr GROUP BY transcript_id, run""")
def untranslated_regions(spark, sf_dir):
    x = order_exons(spark, sf_dir)
    return annotation.untranslated(x, x.where("l_linenumber = 2"))


@query(f"""WITH {EX}, {GAPS}, cd AS (SELECT transcript_id, min(start) AS c0, max(stop) AS c1 FROM ex WHERE l_linenumber = 2 GROUP BY ALL), po AS (SELECT DISTINCT transcript_id, p FROM (SELECT transcript_id, unnest(generate_series(start, stop)) AS p FROM ex)),
  ut AS (SELECT transcript_id, count(*) FILTER (p > c1) AS utr3 FROM po JOIN cd USING (transcript_id) GROUP BY ALL), nm AS (SELECT DISTINCT o_custkey AS gene_id, transcript_id, coalesce(utr3, 0) AS utr3 FROM ex JOIN orders ON o_orderkey = transcript_id LEFT JOIN ut USING (transcript_id)),
  be AS (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY utr3 DESC, transcript_id) = 1), gs AS (SELECT transcript_id, min(stop - start + 1) AS least_intron, max(stop - start + 1) AS greatest_intron, avg(stop - start + 1) AS mean_intron FROM ga GROUP BY ALL)
  SELECT gene_id, transcript_id, CAST(utr3 AS BIGINT) AS utr3, least_intron, greatest_intron, round(mean_intron, 9) AS mean_intron FROM be LEFT JOIN gs USING (transcript_id)""")
def gene_report(spark, sf_dir):
    tasks, x = annotation.tasks_for(table(spark, sf_dir, "lineitem")), order_exons(spark, sf_dir)
    genes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transcript_id"), F.col("o_custkey").alias("gene_id"))
    named = x.repartition(tasks, "transcript_id").join(genes.repartition(tasks, "transcript_id"), "transcript_id")
    return annotation.gene_report(named, x.where("l_linenumber = 2"), tasks=tasks).select("gene_id", "transcript_id", "utr3", "least_intron", "greatest_intron", F.round("mean_intron", 9).alias("mean_intron"))


# -- graphs --------------------------------------------------------------------------------------------------------------------

NODES = "nd AS (SELECT o_custkey AS locus_id, o_orderkey AS a, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
#: Each order is joined to the next two, so the number of paths from the m-th before the last is a Fibonacci number.
FIB = "round(pow((1 + sqrt(5.0)) / 2, n - k + 1) / sqrt(5.0))"


@query(f"WITH {NODES} SELECT locus_id, a AS node, CAST({FIB} AS BIGINT) AS paths FROM nd WHERE n > 1")
def path_counts(spark, sf_dir):
    return graph.count_paths(_edges(spark, sf_dir)).withColumn("paths", F.col("paths").cast("bigint"))


@query(f"WITH {NODES} SELECT locus_id FROM nd WHERE n > 1 AND k = 1 AND {FIB} >= 20")
def skipped_loci(spark, sf_dir):
    return graph.skipped_loci(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, ro AS (SELECT locus_id, a FROM nd WHERE k = 1 AND n > 1 AND {FIB} < 20), wk AS (SELECT locus_id, a AS first, a AS at, [a] AS path FROM ro UNION ALL SELECT wk.locus_id, first, ed.b, list_append(path, ed.b) FROM wk JOIN ed ON ed.locus_id = wk.locus_id AND ed.a = wk.at),
  en AS (SELECT * FROM wk WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.locus_id = wk.locus_id AND ed.a = wk.at)) SELECT locus_id, first, CAST(row_number() OVER (PARTITION BY locus_id, first ORDER BY path) - 1 AS INT) AS k, array_to_string(path, '>') AS path FROM en""")
def path_enumeration(spark, sf_dir):
    return graph.enumerate_paths(_edges(spark, sf_dir)).select("locus_id", "first", "k", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(with_splice(f"""SELECT exs.chr, exs.strand, exs.start, exs.stop FROM (SELECT DISTINCT {C} FROM exs) exs JOIN sr ON sr.chr = exs.chr AND sr.strand = exs.strand AND sr.start <= exs.stop AND sr.stop >= exs.start""", JUNC, BLOCKS, SEGMENTS, EXONS,
    "al AS (SELECT a.chr, a.strand, a.start, a.stop FROM j a JOIN j b ON a.chr = b.chr AND a.strand = b.strand AND a.start <= b.stop AND a.stop >= b.start GROUP BY ALL HAVING count(*) = 1)",
    f"xd AS (SELECT DISTINCT {C} FROM exs)", f"ux AS ({islands('xd')})", "sg AS (SELECT a.chr, a.strand, a.start, a.stop FROM ux a JOIN xd b ON a.chr = b.chr AND a.strand = b.strand AND a.start <= b.stop AND a.stop >= b.start GROUP BY ALL HAVING count(*) = 1)",
    "bs AS (SELECT al.chr, al.strand, l.start, r.stop FROM al JOIN sg l ON l.chr = al.chr AND l.strand = al.strand AND al.start - 1 BETWEEN l.start AND l.stop JOIN sg r ON r.chr = al.chr AND r.strand = al.strand AND al.stop + 1 BETWEEN r.start AND r.stop)",
    f"sr AS ({islands('bs')})"))
def invariable_exons(spark, sf_dir):
    s, j = _segments(spark, sf_dir)
    return annotation.invariable_exons(exons.spliced_exons(s, j), j).select("chr", "strand", "start", "stop")


# -- small things --------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(bit_count(CAST(p_partkey & p_size AS BIGINT)) AS INT) AS common, p_partkey | p_size AS either, xor(p_partkey, CAST(p_size AS BIGINT)) AS differ FROM part")
def bit_strings(spark, sf_dir):
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.bit_count(F.col("p_partkey").bitwiseAND(size)).alias("common"), F.col("p_partkey").bitwiseOR(size).alias("either"), F.col("p_partkey").bitwiseXOR(size).alias("differ"))


@query("SELECT l_partkey AS value, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS keys FROM lineitem GROUP BY ALL")
def inverted_map(spark, sf_dir):
    of = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("values"))
    return of.select("l_orderkey", F.explode("values").alias("value")).groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("l_orderkey")), ",").alias("keys"))


@query("SELECT event_id, event_type, lead(event_id) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS ahead, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS nth FROM events")
def peeked(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.lead("event_id").over(w).alias("ahead"), (F.row_number().over(w) - 1).alias("nth"))
