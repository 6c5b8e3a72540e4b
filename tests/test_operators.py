"""Hand-worked rows and brute force for the operators."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisweave.operators import coverage, exons, graph, segmentation, splice
from axisweave.operators import intervals as iv


def rows(spark, spans, strand="+"):
    return spark.createDataFrame([("c", strand, s, e) for s, e in spans], "chr string, strand string, start int, stop int")


def spans(df):
    return sorted((r["start"], r["stop"]) for r in df.collect())


def test_fixture_rows(spark):
    assert spans(iv.coalesce_intervals(rows(spark, [(1, 4), (5, 9)]))) == [(1, 9)]
    assert spans(iv.subtract(rows(spark, [(1, 9)]), rows(spark, [(4, 5)]))) == [(1, 3), (6, 9)]
    assert spans(iv.coalesce_intervals(rows(spark, [(1, 2), (6, 7), (12, 13)]), radius=3)) == [(1, 7), (12, 13)]
    assert spans(iv.fragment(rows(spark, [(1, 10), (5, 15)]))) == [(1, 4), (5, 10), (11, 15)]
    at = spark.createDataFrame([("c", "+", 12)], "chr string, strand string, pos int")
    assert spans(iv.split_at(rows(spark, [(10, 17)]), at)) == [(10, 11), (12, 17)]
    assert spans(iv.split_at(rows(spark, [(10, 17)]), at, before=False)) == [(10, 12), (13, 17)]


@pytest.mark.parametrize("seed", range(3))
def test_sets_against_positions(spark, seed):
    rnd = random.Random(seed)
    a, b = ([(s := rnd.randint(1, 200), s + rnd.randint(0, 15)) for _ in range(30)] for _ in range(2))
    pos = lambda x: {p for s, e in x for p in range(s, e + 1)}

    def runs(ps):
        out = []
        for p in sorted(ps):
            if out and out[-1][1] == p - 1:
                out[-1] = (out[-1][0], p)
            else:
                out.append((p, p))
        return out

    x, y = rows(spark, a), rows(spark, b)
    assert spans(iv.coalesce_intervals(x, width=16)) == runs(pos(a))
    assert spans(iv.subtract(x, y)) == runs(pos(a) - pos(b))
    assert spans(iv.intersect(x, y)) == runs(pos(a) & pos(b))
    depth = {p: sum(s <= p <= e for s, e in a) for p in pos(a)}
    assert {p: r["depth"] for r in iv.depth_runs(x, width=16).collect() for p in range(r["start"], r["stop"] + 1)} == depth
    pairs = sorted((s, e, t, f) for s, e in a for t, f in b if s <= f and e >= t)
    assert sorted(tuple(r[c] for c in ("start", "stop", "start_b", "stop_b")) for r in iv.overlap_join(x, y, width=8).collect()) == pairs


def test_nearest_across_tiles(spark):
    p = spark.createDataFrame([("c", "+", v) for v in (1, 9, 250, 400)], "chr string, strand string, pos int")
    s = spark.createDataFrame([("c", "+", v) for v in (5, 9, 310)], "chr string, strand string, site int")
    assert {r["pos"]: r["site"] for r in iv.nearest(p, s, width=50).collect()} == {1: None, 9: 9, 250: 9, 400: 310}
    assert {r["pos"]: r["site"] for r in iv.nearest(p, s, after=True, width=50).collect()} == {1: 5, 9: 9, 250: 310, 400: None}


def test_binned_max_end(spark):
    reads = rows(spark, [(95, 101), (100, 103), (101, 104), (105, 118), (118, 118)])
    y = {r["bin"]: r["y"] for r in coverage.binned_max_end(reads, rows(spark, [(100, 139)]), 20).collect()}
    assert y == {0: 5, 1: 0}


def test_median_counts_zeros(spark):
    assert coverage.median_depth(rows(spark, [(4, 5), (6, 6)] + [(6, 6)] * 8), rows(spark, [(1, 6)])).first()["coverage"] == 0.5


def test_cigar_and_sites(spark):
    r = spark.createDataFrame([("c", "+", 101, "10M5N20M"), ("c", "+", 105, "20M")], "chr string, strand string, start int, cigar string")
    assert spans(splice.introns(r)) == [(111, 115)]
    assert spans(splice.aligned(r)) == [(101, 110), (105, 124), (116, 135)]
    got = {(x["pos"], x["side"]): (x["e"], x["i"]) for x in splice.site_counts(r).collect()}
    assert got == {(111, "5p"): (1, 1), (115, "3p"): (1, 1)}


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(0, 4), (0, 5), (3, 2)], "i long, e long")
    assert [round(r["p"], 5) for r in d.select(splice.binomial_tail(F.col("i"), F.col("e")).alias("p")).collect()] == [0.0625, 0.03125, 0.8125]


def test_running_best(spark):
    p = spark.createDataFrame([("s", "+", 100, 9.0, 0.0), ("s", "+", 200, 4.0, 0.0), ("s", "+", 300, 6.0, 0.0)], "seg string, strand string, pos int, before double, after double")
    assert sorted(r["pos"] for r in exons.running_best(p, ["seg"]).collect()) == [100, 300]


def test_trimming_of_one_base_exons(spark):
    """As in the SQL: a terminal exon of one base keeps its start, and its stop moves only to the right."""
    rows = [("+", 100, 100, "5p_exon"), ("-", 90, 110, "internal_exon"), ("-", 200, 200, "3p_exon"), ("+", 190, 210, "internal_exon"), ("+", 300, 300, "3p_exon"), ("-", 290, 310, "internal_exon")]
    got = exons.trim_antisense(spark.createDataFrame([("c", *r) for r in rows], "chr string, strand string, start int, stop int, type string"))
    assert sorted((r["start"], r["stop"]) for r in got.where("type <> 'internal_exon'").collect()) == [(100, 100), (200, 200), (300, 310)]
    assert got.count() == len(rows)


def test_components_and_paths(spark):
    rnd = random.Random(5)
    e = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(x,) for x in par], "id long")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}
    dag = spark.createDataFrame([("l", 1, 2), ("l", 1, 3), ("l", 2, 4), ("l", 3, 4), ("l", 4, 5), ("l", 4, 6)], "locus_id string, a int, b int")
    assert {r["node"]: int(r["paths"]) for r in graph.count_paths(dag).collect()} == {1: 4, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    assert sorted(tuple(r["path"]) for r in graph.enumerate_paths(dag).collect()) == [(1, 2, 4, 5), (1, 2, 4, 6), (1, 3, 4, 5), (1, 3, 4, 6)]
    assert graph.enumerate_paths(dag, max_paths=4).count() == 0


def test_segmentation_finds_planted_steps():
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.poisson(60, 45), rng.poisson(20, 45), rng.poisson(4, 45)])
    cuts, levels = segmentation.segment([y], segmentation.Prior(min_fold=0.6))
    assert len(cuts) == 2 and abs(cuts[0] - 44) <= 1 and abs(cuts[1] - 89) <= 1
    assert levels[0][0] > levels[1][0] > levels[2][0]
    assert segmentation.segment([rng.poisson(20, 90)], segmentation.Prior())[0] == []
    assert segmentation.segment([np.zeros(30)], segmentation.Prior())[0] == []
    assert segmentation.segment([np.array([5.0])], segmentation.Prior())[0] == []
    conf = np.exp(segmentation.cut_confidence([y], segmentation.Prior()))
    assert conf.max() <= 1 + 1e-9 and conf[cuts[0]] > 0.2 and conf[20] < 0.2
    both, _ = segmentation.segment([y, y * 2], segmentation.Prior(min_fold=0.6))
    assert len(both) == 2


def test_confidence_is_the_share_of_all_segmentations():
    rng = np.random.default_rng(1)
    y, p = rng.poisson(5, 7), segmentation.Prior(segment_r=2, segment_p=0.5)
    ev = segmentation.Evidence(y, p)
    log_g, over = segmentation.length_prior(7, p.segment_r, p.segment_p)
    edge = np.concatenate([[0.0], over])
    total, with_cut = -np.inf, np.full(6, -np.inf)
    for k in range(7):
        for cut in combinations(range(6), k):
            bounds = [0, *[c + 1 for c in cut], 7]
            v = 0.0
            for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                v += ev.row(s)[0][e - s - 1] + (edge[e - s - 1] if i in (0, len(bounds) - 2) else log_g[e - s - 1])
            total = np.logaddexp(total, v)
            for c in cut:
                with_cut[c] = np.logaddexp(with_cut[c], v)
    assert np.allclose(segmentation.cut_confidence([y], p), with_cut - total, atol=1e-6)


def test_nulls_are_the_same(spark):
    """Rows with a null attribute: one of the left join is paired or unmatched, not both, and one that is split is cut."""
    a = spark.createDataFrame([("c", "+", 1, 9, None), ("c", "+", 20, 29, None), ("c", "+", 20, 29, None)], "chr string, strand string, start int, stop int, name string")
    b = rows(spark, [(5, 6)])
    got = iv.overlap_join(a, b, how="left").collect()
    assert sorted((r["start"], r["start_b"] or 0) for r in got) == [(1, 5), (20, 0), (20, 0)]
    at = spark.createDataFrame([("c", "+", 5), ("c", "+", 25)], "chr string, strand string, pos int")
    assert spans(iv.split_at(a, at)) == [(1, 4), (5, 9), (20, 24), (20, 24), (25, 29), (25, 29)]


def test_islands_over_many_tiles(spark):
    """Long intervals that swallow runs of later tiles, and runs that go on from tile to tile."""
    rnd = random.Random(7)
    for _ in range(4):
        x = [(s := rnd.randint(1, 400), s + rnd.choice([0, 1, 3, 60, 150])) for _ in range(25)]
        for radius in (0, 4):
            want = []
            for s, e in sorted(x):
                if want and s - want[-1][1] - 1 <= radius:
                    want[-1] = (want[-1][0], max(want[-1][1], e))
                else:
                    want.append((s, e))
            assert spans(iv.coalesce_intervals(rows(spark, x), radius, width=10)) == want


def test_absent_bins_keep_their_place(spark):
    """A step with a gap of bins without rows before it: the cut stays where it is."""
    bins = [("c", "+", 1, 2000, "s", k, 40 if k < 50 else 5) for k in range(100) if not 20 <= k < 30]
    df = spark.createDataFrame(bins, "chr string, strand string, start int, stop int, sample string, bin int, y int")
    cuts = [r["cut"] for r in segmentation.change_points(df, 20, mode="fold").collect()]
    assert 49 in cuts


def test_tail_of_the_binomial(spark):
    from math import comb

    pairs = [(i, e) for i in (0, 1, 5, 40, 300) for e in (1, 2, 5, 39, 41, 280, 700)] + [(5, 0), (10**6, 10**6)]
    got = spark.createDataFrame(pairs, "i long, e long").withColumn("p", splice.binomial_tail(F.col("i"), F.col("e"))).collect()
    for r in got:
        if r["i"] + r["e"] < 10**4:
            want = sum(comb(r["i"] + r["e"], k) for k in range(r["i"] + 1)) / 2 ** (r["i"] + r["e"])
            assert r["p"] == pytest.approx(want, rel=1e-8, abs=1e-14)
        else:
            assert r["p"] == pytest.approx(0.5, abs=1e-3)


def test_assembly(spark):
    """Two exons and a junction, an exon with a step in its coverage, and a sample whose step is lower."""
    from axisweave.plans import assembly
    from axisweave.sources.regions import Config

    reads = [("c", "+", 181, "20M100N20M")] * 30 + [("c", "+", s, "20M") for s in range(101, 181, 2) for _ in range(4)]
    reads += [("c", "+", s, "20M") for s in range(301, 1281, 2) for _ in range(6 if s < 800 else 1)]
    df = spark.createDataFrame(reads, "chr string, strand string, start int, cigar string")
    config = Config(merge_radius=10, min_terminal=0)
    got = assembly.assemble(df, config)
    assert [(r["start"], r["stop"]) for r in got.junctions.where("accepted").collect()] == [(201, 300)]
    found = {(r["type"], r["start"], r["stop"]) for r in got.exons.collect()}
    assert ("5p_exon", 101, 200) in found and any(t == "3p_exon" and s == 301 and e > 1200 for t, s, e in found)
    points = [r["pos"] for r in got.change_points.collect()]
    assert any(abs(p - 810) <= 40 for p in points) and any(t == "3p_exon" and s == 301 and abs(e - 810) <= 40 for t, s, e in found)
    located = assembly.loci(got.exons, got.junctions.where("accepted"))
    paths = assembly.isoforms(located, got.junctions.where("accepted"), config)
    features = assembly.isoform_features(paths)
    assert paths.count() >= 2 and features.count() == 2 * paths.count() and assembly.skipped(located, got.junctions.where("accepted"), config).count() == 0
    aligned = splice.aligned(df)
    joint = assembly.compare((got.exons.where("stop > 1200 or type = '5p_exon'"), aligned), (got.exons.where("stop > 1200 or type = '5p_exon'"), aligned), config)
    table = assembly.compare_table(joint)
    assert table.columns == assembly.COMPARE_COLUMNS and table.count() == joint.count() > 0


def test_tails_between_two_figures(spark):
    """Tails of 7 and 10 reads that lie half-way between two figures of six digits are rounded as DuckDB rounds them; near ties are ties."""
    import duckdb

    pairs = [(n - i, i) for n in range(1, 41) for i in range(n)]
    sql = "select e, i, round(least(1, (select sum(exp(lgamma(e + i + 1.0) - lgamma(k + 1.0) - lgamma(e + i - k + 1.0) - (e + i) * ln(2.0))) from (select unnest(generate_series(0, i)) as k))), 6)"
    want = duckdb.connect().execute(f"{sql} from (values {', '.join(map(str, pairs))}) t(e, i)").fetchall()
    got = spark.createDataFrame(pairs, "e long, i long").select("e", "i", F.round(splice.binomial_tail(F.col("i"), F.col("e")), 6).alias("p")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_ties_of_junctions(spark):
    """Two junctions of one 5' site, whose 3' sites have tails of 1 less 1e-11 or so: both are the best."""
    j = spark.createDataFrame([("c", "+", 10, 20, 20), ("c", "+", 10, 40, 20)], "chr string, strand string, start int, stop int, n long")
    s = spark.createDataFrame([("c", "+", 10, "5p", 40, 0), ("c", "+", 20, "3p", 20, 90), ("c", "+", 40, "3p", 20, 100)], "chr string, strand string, pos int, side string, e long, i long")
    got = splice.judge_junctions(j, s).orderBy("stop").collect()
    assert got[0]["p3"] != got[1]["p3"] and [r["accepted"] for r in got] == [True, True]


def test_path_walks_go_by_batches(spark):
    """Many small loci are walked in one Arrow batch, not a group each; a locus that goes on in later batches stays whole."""
    loci = spark.range(300).select(F.col("id").alias("locus_id"), F.explode(F.sequence(F.lit(0), (F.col("id") % 6).cast("int"))).alias("a"))
    edges = loci.select("locus_id", F.col("a").cast("long").alias("a"), F.explode(F.array(F.col("a") + 1, F.col("a") + 2)).alias("b")).withColumn("b", F.col("b").cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        plan = graph.count_paths(edges)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
        counts = {(r["locus_id"], r["node"]): int(r["paths"]) for r in graph.count_paths(edges).collect()}
        paths, skipped = graph.enumerate_paths(edges, 8).collect(), {r["locus_id"] for r in graph.skipped_loci(edges, 8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    # node n has n + 1 and n + 2 below it, up to the leaves m + 1 and m + 2 (m = locus % 6)
    def number(m, a):
        return 1 if a > m else number(m, a + 1) + number(m, a + 2)

    assert counts == {(i, a): number(i % 6, a) for i in range(300) for a in range(i % 6 + 3)}
    assert skipped == {i for i in range(300) if number(i % 6, 0) >= 8}
    assert {i: sum(r["locus_id"] == i for r in paths) for i in range(300)} == {i: 0 if i in skipped else number(i % 6, 0) for i in range(300)}
    assert all(r["path"][0] == r["first"] == 0 and all(y - x in (1, 2) for x, y in zip(r["path"], r["path"][1:])) for r in paths)


def test_path_numbers_over_64_bits(spark):
    edges = spark.createDataFrame([(1, a, a + d) for a in range(120) for d in (1, 2)], "locus_id long, a long, b long")
    x, y = 1, 1
    for _ in range(120):
        x, y = y, x + y
    assert graph.count_paths(edges).where("node = 0").first()["paths"] == y


@pytest.mark.parametrize("strand", "+-")
def test_reports_by_gene_against_positions(spark, strand):
    """Introns and 3' UTRs by one sort, held against sets of positions; a transcript of two genes counts for both. Neither plan joins."""
    from axisweave.operators import annotation

    rnd = random.Random(strand)
    x = [(f"g{t % 7}", t, s := rnd.randint(1, 150), s + rnd.randint(0, 20)) for t in range(40) for _ in range(rnd.randint(1, 6))]
    x += [("g1", t, s, e) for g, t, s, e in x if t == 12]
    c = [(t, s := rnd.randint(1, 150), s + rnd.randint(0, 20)) for t in range(0, 45, 2) for _ in range(2)]
    exon = spark.createDataFrame([("c", strand, *r) for r in x], "chr string, strand string, gene_id string, transcript_id long, start int, stop int")
    cds = spark.createDataFrame([("c", strand, *r) for r in c], "chr string, strand string, transcript_id long, start int, stop int")
    on = {t: {p for _, u, s, e in x if u == t for p in range(s, e + 1)} for t in range(40)}
    ranked = {t: sorted(ps) for t, ps in on.items()}
    gaps = {t: [b - a - 1 for a, b in zip(ps, ps[1:]) if b - a > 1] for t, ps in ranked.items()}
    found = annotation.introns(exon)
    assert {t: sorted(r["stop"] - r["start"] + 1 for r in found.where(F.col("transcript_id") == t).collect()) for t in (0, 5, 12, 39)} == {t: sorted(gaps[t]) for t in (0, 5, 12, 39)}
    assert found.count() == sum(map(len, gaps.values()))
    coding = {t: (min(s for u, s, _ in c if u == t), max(e for u, _, e in c if u == t)) for t in range(0, 45, 2)}
    utr = {t: sum(p > coding[t][1] if strand == "+" else p < coding[t][0] for p in on[t]) if t in coding else 0 for t in on}
    of = {g: {t for h, t, _, _ in x if h == g} for g, *_ in x}
    want = {g: min((-utr[t], t) for t in ts)[1] for g, ts in of.items()}
    report = annotation.gene_report(exon, cds)
    got = {r["gene_id"]: r for r in report.collect()}
    assert {g: r["transcript_id"] for g, r in got.items()} == want
    for g, r in got.items():
        size = gaps[r["transcript_id"]]
        assert (r["utr3"], r["least_intron"], r["greatest_intron"]) == (utr[want[g]], min(size, default=None), max(size, default=None))
        assert r["mean_intron"] == (pytest.approx(sum(size) / len(size)) if size else None)
    assert all("Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (found, report))


def test_tasks_grow_with_rows(spark, monkeypatch):
    from axisweave.operators import annotation

    monkeypatch.setattr(annotation, "ROWS_A_TASK", 10)
    assert annotation.tasks_for(spark.range(95)) == 10 and annotation.tasks_for(spark.range(5)) == 4


@pytest.mark.parametrize("odd", [False, True])
def test_counts_without_pairs(spark, odd):
    """Overlaps are counted from starts and stops, also across tiles and (odd) where rows stop before they start; null keys overlap nothing."""
    rnd = random.Random(int(odd))
    a, b = ([(rnd.choice("cd"), rnd.choice("+-"), s := rnd.randint(1, 150), s + rnd.randint(-3 if odd else 0, 12)) for _ in range(60)] for _ in range(2))
    a, b = [*a, *a[:9], (None, "+", 3, 9), ("c", "+", None, 9), ("e", "+", 3, 9)], [*b, *b[:5], (None, "+", 3, 9), ("c", "+", None, 9), ("c", "+", 5, None)]
    x, y = (spark.createDataFrame(v, "chr string, strand string, start int, stop int") for v in (a, b))
    met = lambda r, q: None not in (*r, *q) and r[:2] == q[:2] and r[2] <= q[3] and r[3] >= q[2]
    within = lambda r, q: None not in (*r, *q) and r[:2] == q[:2] and r[2] >= q[2] and r[3] <= q[3]
    ordered = lambda rows: sorted(map(tuple, rows), key=lambda v: [(c is None, str(c)) for c in v])
    n = iv.count_overlaps(x, y, width=16)
    assert ordered(n.collect()) == ordered((*r, sum(met(r, q) for q in b)) for r in a)
    assert ordered(iv.overlap_semi(x, y).collect()) == ordered(r for r in a if any(met(r, q) for q in b))
    assert ordered(iv.overlap_semi(x, y, anti=True).collect()) == ordered(r for r in a if not any(met(r, q) for q in b))
    for anti in (False, True):
        assert ordered(iv.contained_semi(x, y, anti, width=16).collect()) == ordered(r for r in a if any(within(r, q) for q in b) != anti)
    if not odd:
        assert all("_bin" not in d._jdf.queryExecution().toString() for d in (n, iv.overlap_semi(x, y), coverage.count_reads(y, x)))


def test_no_pairs_in_overlap_queries(spark):
    from axisweave.plans.queries import QUERIES

    for name in ("overlap_join_unstranded", "overlap_semi_join", "overlap_anti_join", "containment_anti_join", "splice_site_counts"):
        assert "_bin" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString(), name
