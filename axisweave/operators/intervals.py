"""Interval algebra and interval joins on a stranded axis.

An interval set is a DataFrame with chr, strand, start and stop (1-based, both ends included). Positions are dealt out by (chr, strand,
tile), a tile being ``TILE`` positions, so that one chromosome isn't one task; what must pass from tile to tile is first
reduced to a row or a few for each tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["chr", "strand"]
TILE = 100_000


def tile(position: Column | str, width: int = TILE) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / F.lit(width)).cast("long")


def _islands(rows: DataFrame, by: list[str], radius: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(before.isNull() | (F.col("start") - before - 1 > radius), 1).otherwise(0))
    return opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def coalesce_intervals(rows: DataFrame, radius: int = 0, keys: list[str] | None = None, width: int = TILE) -> DataFrame:
    """Union of intervals: overlapping and adjacent ones merge, as do those with a gap of at most ``radius`` positions.

    Runs are merged within tiles first. A tile's runs are apart, so only its first and last run and the one that what came before runs
    into can go on in another tile: at most three rows a tile meet by key, the others are whole or lie within what came before.
    """
    keys = KEYS if keys is None else keys
    local = _islands(rows.select(*keys, "start", "stop", tile("start", width).alias("_tile")), [*keys, "_tile"], radius)
    tiles = local.groupBy(*keys, "_tile").agg(F.max("stop").alias("_stop"), F.min("start").alias("_low"), F.max("start").alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(*keys, "_tile", "_low", "_high", F.max("_stop").over(before).alias("_carry"))
    met = F.coalesce(F.col("start") - F.col("_carry") - 1 <= radius, F.lit(False))
    edge = F.col("start").isin(F.col("_low"), F.col("_high")) | (met & (F.col("stop") > F.col("_carry")))
    runs = local.join(tiles, [*keys, "_tile"]).where(edge | ~met).withColumn("_tile", F.when(edge, F.lit(None)).otherwise(F.col("_tile")))
    return _islands(runs.select(*keys, "_tile", "start", "stop"), [*keys, "_tile"], radius).drop("_tile")


def depth_runs(rows: DataFrame, keys: list[str] | None = None, width: int = TILE, weight: str | None = None) -> DataFrame:
    """Coverage as runs (keys, start, stop, depth) of constant depth over 0; neighbouring runs differ in depth.

    Breakpoints are summed by position before the shuffle; a tile's depth at its start is the sum of all tiles before.
    """
    keys = KEYS if keys is None else keys
    w = F.col(weight) if weight else F.lit(1)
    ends = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), w.cast("long").alias("d")), F.struct((F.col("stop") + 1).alias("pos"), (-w).cast("long").alias("d")))).alias("x"))
    steps = ends.select(*keys, "x.pos", "x.d").groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("_tile", tile("pos", width))
    tiles = steps.groupBy(*keys, "_tile").agg(F.sum("d").alias("_d"), F.min("pos").alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_tile")
    tiles = tiles.select(*keys, "_tile", F.coalesce(F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_first").over(order).alias("_next"))
    inside = Window.partitionBy(*keys, "_tile").orderBy("pos")
    runs = steps.join(tiles, [*keys, "_tile"]).select(
        *keys, F.col("pos").alias("start"), (F.coalesce(F.lead("pos").over(inside), F.col("_next")) - 1).alias("stop"), (F.col("_base") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth")
    )
    return runs.where("depth > 0")


def expressed(rows: DataFrame, threshold: int = 1, **more) -> DataFrame:
    """Maximal runs of positions with depth of at least max(threshold, 1)."""
    return coalesce_intervals(depth_runs(rows, **more).where(F.col("depth") >= max(threshold, 1)), keys=more.get("keys"))


def covered_by(a: DataFrame, b: DataFrame, keep: Column, keys: list[str] | None = None) -> DataFrame:
    """Runs of positions by how often a and b cover them (columns a and b); keep selects runs, which are then merged."""
    keys = KEYS if keys is None else keys
    both = a.select(*keys, "start", "stop", F.lit(1).alias("w")).unionByName(b.select(*keys, "start", "stop", F.lit(1 << 32).alias("w")))
    runs = depth_runs(both, keys=keys, weight="w")
    runs = runs.withColumn("b", F.shiftright("depth", 32)).withColumn("a", F.col("depth") - F.shiftleft("b", 32))
    return coalesce_intervals(runs.where(keep), keys=keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Positions of a that b doesn't cover, as merged runs."""
    return covered_by(a, b, (F.col("a") > 0) & (F.col("b") == 0), keys)


def intersect(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Positions that both cover, as merged runs."""
    return covered_by(a, b, (F.col("a") > 0) & (F.col("b") > 0), keys)


def fragment(rows: DataFrame, keys: list[str] | None = None, width: int = TILE) -> DataFrame:
    """Elementary pieces: the covered positions cut at every start and after every stop.

    As depth_runs(), but every cut is kept, also where starts and stops balance; a piece reaches to the next cut.
    """
    keys = KEYS if keys is None else keys
    ends = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.select(*keys, "x.pos", "x.d").groupBy(*keys, "pos").agg(F.sum("d").alias("d")).withColumn("_tile", tile("pos", width))
    tiles = steps.groupBy(*keys, "_tile").agg(F.sum("d").alias("_d"), F.min("pos").alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_tile")
    tiles = tiles.select(*keys, "_tile", F.coalesce(F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_first").over(order).alias("_next"))
    inside = Window.partitionBy(*keys, "_tile").orderBy("pos")
    cut = steps.join(tiles, [*keys, "_tile"]).select(
        *keys, F.col("pos").alias("start"), (F.coalesce(F.lead("pos").over(inside), F.col("_next")) - 1).alias("stop"), (F.col("_base") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("_depth")
    )
    return cut.where("_depth > 0").drop("_depth")


def split_at(rows: DataFrame, points: DataFrame, before: bool = True) -> DataFrame:
    """Intervals cut before (or after) each point (chr, strand, pos) within them; ``piece`` counts from 1."""
    at = points.select(*KEYS, (F.col("pos") if before else F.col("pos") + 1).alias("start")).distinct()
    extra = rows.columns
    hits = overlap_join(rows.distinct(), at.withColumn("stop", F.col("start")), suffix="_p").where("start_p > start").groupBy(*extra).agg(F.array_sort(F.collect_set("start_p")).alias("_ps"))
    cuts = _null_safe_join(rows, hits, extra, "left")
    ps = F.coalesce("_ps", F.array().cast("array<int>"))
    pieces = F.arrays_zip(F.concat(F.array("start"), ps).alias("start"), F.concat(F.transform(ps, lambda p: p - 1), F.array("stop")).alias("stop"))
    others = [c for c in extra if c not in ("start", "stop")]
    return cuts.select(*others, F.posexplode(pieces).alias("piece", "_x")).select(*others, F.col("_x.start").alias("start"), F.col("_x.stop").alias("stop"), (F.col("piece") + 1).alias("piece"))


def _bins(width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))


def overlap_join(a: DataFrame, b: DataFrame, suffix: str = "_b", keys: list[str] | None = None, width: int = 4096, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Pairs of a and b that share a position: an equi-join on (keys, bin) with the residual, each pair in its first common bin.

    b's columns other than the keys get the suffix. ``condition`` narrows the pairs further (containment and the like).
    width: about the length of long intervals, so that few are copied to several bins; the bins deal out hot chromosomes.
    """
    keys = KEYS if keys is None else keys
    named = b.select(*keys, *[F.col(c).alias(c + suffix) for c in b.columns if c not in keys])
    x = a.withColumn("_bin", _bins(width))
    y = b.select(*b.columns, _bins(width).alias("_bin")).select(*keys, "_bin", *[F.col(c).alias(c + suffix) for c in b.columns if c not in keys])
    s, e = F.col(f"start{suffix}"), F.col(f"stop{suffix}")
    pairs = x.join(y, [*keys, "_bin"]).where((F.col("start") <= e) & (F.col("stop") >= s) & (F.col("_bin") == F.floor(F.greatest(F.col("start"), s) / width))).drop("_bin")
    if condition is not None:
        pairs = pairs.where(condition)
    out = [*a.columns, *[c for c in named.columns if c not in keys]]
    if how == "left":
        pairs = pairs.select(*a.columns, *[c for c in named.columns if c not in keys])
        missing = _null_safe_join(a, pairs.select(*a.columns).distinct(), a.columns, "left_anti")
        return pairs.unionByName(missing, allowMissingColumns=True).select(*out)
    return pairs.select(*out)


def _null_safe_join(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    """a join b where all the columns are the same, null being the same as null; columns come once."""
    named = b.withColumnsRenamed({c: f"_same_{c}" for c in columns})
    return a.join(named, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in columns], how).drop(*[f"_same_{c}" for c in columns])


def running(steps: DataFrame, at: DataFrame, keys: list[str], total=F.sum, width: int = TILE) -> DataFrame:
    """(keys, pos, values): at each position of steps (keys, pos, values) and of at (keys, pos) the total of the values up to there; null before the first.

    Positions are aggregated first, so rows grow with the axis, not with the input; a tile has the total of the tiles before from one row a tile.
    """
    values = [c for c in steps.columns if c not in (*keys, "pos")]
    rows = steps.unionByName(at.select(*keys, "pos").distinct(), allowMissingColumns=True).groupBy(*keys, "pos").agg(*[total(v).alias(v) for v in values]).withColumn("_tile", tile("pos", width))
    order = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = rows.groupBy(*keys, "_tile").agg(*[total(v).alias(v) for v in values]).select(*keys, "_tile", *[total(v).over(order).alias(f"_before_{v}") for v in values])
    inside = Window.partitionBy(*keys, "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*keys, "_tile", "pos", *[total(v).over(inside).alias(v) for v in values]).join(tiles, [*keys, "_tile"])
    sum_ = lambda v: F.coalesce(F.col(f"_before_{v}") + F.col(v), f"_before_{v}", v)
    most = lambda v: F.greatest(f"_before_{v}", v)
    return local.select(*keys, "pos", *[(sum_ if total is F.sum else most)(v).alias(v) for v in values])


def count_overlaps(a: DataFrame, b: DataFrame, keys: list[str] | None = None, name: str = "n", width: int = TILE) -> DataFrame:
    """Rows of a with the number of rows of b that share a position, without making the pairs: those that start up to a's stop, less those that
    stop before a's start. Where rows of either stop before they start, this doesn't hold, and pairs are made.
    """
    keys = KEYS if keys is None else keys
    if any(not d.where("stop < start").isEmpty() for d in (a, b)):
        pairs = overlap_join(a.distinct(), b.select(*keys, "start", "stop"), keys=keys).groupBy(*a.columns).agg(F.count(F.lit(1)).alias(name))
        return _null_safe_join(a, pairs, a.columns, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return _count_overlaps(a, b.where("start <= stop"), keys, name, width)


def _count_overlaps(a: DataFrame, b: DataFrame, keys: list[str], name: str, width: int = TILE) -> DataFrame:
    """count_overlaps() of rows that don't stop before they start."""
    ends = [b.select(*keys, F.col(c).alias("pos")).groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias(v)) for c, v in (("start", "_starts"), ("stop", "_stops"))]
    asked = a.select(*keys, F.explode(F.array(F.col("stop"), F.col("start") - 1)).alias("pos")).where("pos is not null")
    sums = running(ends[0].unionByName(ends[1], allowMissingColumns=True), asked, keys, width=width)
    out = a.withColumn("_last", F.col("start") - 1).join(sums.select(*keys, F.col("pos").alias("stop"), F.col("_starts")), [*keys, "stop"], "left")
    out = out.join(sums.select(*keys, F.col("pos").alias("_last"), F.col("_stops")), [*keys, "_last"], "left")
    n = F.coalesce("_starts", F.lit(0)) - F.coalesce("_stops", F.lit(0))
    return out.select(*a.columns, F.when(F.col("start").isNotNull() & F.col("stop").isNotNull(), n).otherwise(0).cast("long").alias(name))


def overlap_semi(a: DataFrame, b: DataFrame, anti: bool = False, condition: Column | None = None, **more) -> DataFrame:
    """Rows of a with (or, anti, without) an overlapping row in b; identical rows of a stay as often as they are. Without a condition no pairs are made."""
    if condition is None:
        return count_overlaps(a, b, name="_n").where(F.col("_n") == 0 if anti else F.col("_n") > 0).drop("_n")
    hit = overlap_join(a.distinct(), b.select(*KEYS, "start", "stop").distinct(), condition=condition, **more).select(*a.columns).distinct()
    return _null_safe_join(a, hit, a.columns, "left_anti" if anti else "left_semi")


def contained_semi(a: DataFrame, b: DataFrame, anti: bool = False, width: int = TILE) -> DataFrame:
    """Rows of a that lie (or, anti, don't lie) within one row of b: the furthest stop of those that start up to a's start is a's stop or past it."""
    far = b.where("stop is not null and start is not null").groupBy(*KEYS, F.col("start").alias("pos")).agg(F.max("stop").alias("_far"))
    sums = running(far, a.select(*KEYS, F.col("start").alias("pos")).where("pos is not null"), KEYS, F.max, width)
    out = a.join(sums.withColumnRenamed("pos", "start"), [*KEYS, "start"], "left")
    within = F.coalesce(F.col("_far") >= F.col("stop"), F.lit(False))
    return out.where(~within if anti else within).select(*a.columns)


def nearest(points: DataFrame, sites: DataFrame, after: bool = False, keys: list[str] | None = None, width: int = TILE) -> DataFrame:
    """points (keys, pos ..) with ``site``: the last site (keys, site) at or before pos, or (after) the first at or after it.

    Within a tile by a window over points and sites; else from the tiles before (after), of which a row each is kept.
    """
    keys = KEYS if keys is None else keys
    best = F.min if after else F.max
    rows = points.withColumn("_site", F.lit(None).cast("int")).withColumn("_tile", tile("pos", width)).withColumn("_point", F.lit(True))
    marks = sites.select(*keys, F.col("site").cast("int").alias("_site"), F.col("site").alias("pos"), tile("site", width).alias("_tile"), F.lit(False).alias("_point")).distinct()
    order = Window.partitionBy(*keys, "_tile").orderBy(F.col("pos").desc() if after else F.col("pos"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_near", best("_site").over(order)).where("_point")
    # carried from other tiles
    edge = both.select(*keys, "_tile").distinct().withColumn("_best", F.lit(None).cast("int")).unionByName(marks.groupBy(*keys, "_tile").agg(best("_site").alias("_best")))
    edge = edge.groupBy(*keys, "_tile").agg(best("_best").alias("_best"))
    over = Window.partitionBy(*keys).orderBy(F.col("_tile").desc() if after else F.col("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "_tile", best("_best").over(over).alias("_carry"))
    return both.join(edge, [*keys, "_tile"], "left").withColumn("site", F.coalesce("_near", "_carry")).select(*points.columns, "site")


def upstream(points: DataFrame, sites: DataFrame) -> DataFrame:
    """The nearest site upstream of each point, inclusive: smaller positions on '+', larger on '-'."""
    plus, minus = (nearest(points.where(F.col("strand") == s), sites.where(F.col("strand") == s), after) for s, after in (("+", False), ("-", True)))
    return plus.unionByName(minus)


def downstream(points: DataFrame, sites: DataFrame) -> DataFrame:
    plus, minus = (nearest(points.where(F.col("strand") == s), sites.where(F.col("strand") == s), after) for s, after in (("+", True), ("-", False)))
    return plus.unionByName(minus)


def closest(points: DataFrame, sites: DataFrame) -> DataFrame:
    """The nearest site on either side; of two at one distance the larger."""
    low = nearest(points, sites).withColumnRenamed("site", "_low")
    both = nearest(low, sites, after=True).withColumnRenamed("site", "_high")
    pick = F.when(F.col("_low").isNull(), F.col("_high")).when(F.col("_high").isNull(), F.col("_low")).when(F.col("_high") - F.col("pos") <= F.col("pos") - F.col("_low"), F.col("_high")).otherwise(F.col("_low"))
    return both.withColumn("site", pick).drop("_low", "_high")


def five_prime() -> Column:
    """Strand-relative 5' end; null without a strand."""
    return F.when(F.col("strand") == "+", F.col("start")).when(F.col("strand") == "-", F.col("stop"))


def three_prime() -> Column:
    return F.when(F.col("strand") == "+", F.col("stop")).when(F.col("strand") == "-", F.col("start"))


def opposite(strand: str = "strand") -> Column:
    return F.translate(F.col(strand), "+-", "-+")


def group_spans(rows: DataFrame, by: list[str], extra: list[Column] | None = None) -> DataFrame:
    """The span of each group."""
    return rows.groupBy(*by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *(extra or []))
