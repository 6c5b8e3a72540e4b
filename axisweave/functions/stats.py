"""Statistics and window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Sum, mean, population variance and deviation, sum of squares and standard error."""
    return rows.groupBy(*by).agg(
        F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("stdev"), F.sum(F.col(x) * F.col(x)).alias("squares"), (F.stddev_pop(x) / F.sqrt(F.count(x))).alias("stderr"),
    )


def bivariate(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Population covariance, Pearson's r and its square."""
    r = F.corr(x, y)
    return rows.groupBy(*by).agg(F.covar_pop(x, y).alias("cov"), r.alias("pearson"), (r * r).alias("r_squared"))


def average_rank(rows: DataFrame, by: list[str], x: str, name: str = "rank") -> DataFrame:
    """Ranks from 0; equal values share the mean of theirs. Values are counted first, so that the window runs over a row for each value. Null keys and values come last and have no rank."""
    counts = rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select(*by, x, (below + (F.col("_n") - 1) / 2.0).alias(name)), [*by, x], "left")


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r of the ranks."""
    ranked = average_rank(average_rank(rows, by, x, "_x"), by, y, "_y")
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("spearman"))


def _shares(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    n = rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by)))


def entropy(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Entropy of x in nats."""
    return _shares(rows, by, x).groupBy(*by).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))


def jensen_shannon(rows: DataFrame, of: str, x: str) -> DataFrame:
    """Jensen-Shannon divergence of the distributions of x, one for each value of ``of``, weighted alike."""
    p = _shares(rows, [of], x)
    k = p.agg(F.countDistinct(of).alias("k"), F.sum(-F.col("_p") * F.log("_p")).alias("own"))
    mixed = p.groupBy(x).agg(F.sum("_p").alias("s")).crossJoin(F.broadcast(k)).select((F.col("s") / F.col("k")).alias("m"), "k", "own")
    return mixed.agg(F.sum(-F.col("m") * F.log("m")).alias("h"), F.first("own").alias("own"), F.first("k").alias("k")).select((F.col("h") - F.col("own") / F.col("k")).alias("jsd"))


def quantiles(rows: DataFrame, by: list[str], x: str, q: float) -> DataFrame:
    """The median, and the element at ceil(q (n - 1)) without interpolation (percentile over value counts stays small in memory)."""
    n = rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    at = n.withColumn("_upto", upto).withColumn("_at", F.ceil(F.lit(q) * (F.sum("_n").over(w) - 1)) + 1)
    return at.groupBy(*by).agg(F.expr(f"percentile({x}, 0.5, _n)").alias("median"), F.min(F.when(F.col("_upto") >= F.col("_at"), F.col(x))).alias(f"q{round(q * 100)}"))


def extremes(rows: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """Least and greatest x, and the least name of those that have the greatest."""
    return rows.groupBy(*by).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.min_by(name, F.struct(-F.col(x), F.col(name))).alias("best"))


def running_sum(rows: DataFrame, by: list[str], order: str, x: str, name: str, width: int = 100_000) -> DataFrame:
    """Prefix sums along ``order`` in blocks of positions, so that one key isn't one task."""
    blocks = rows.withColumn("_block", F.floor(F.col(order) / width))
    sums = blocks.groupBy(*by, "_block").agg(F.sum(x).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*by, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return blocks.join(sums, [*by, "_block"]).select(*by, order, (F.col("_base") + F.sum(x).over(own)).alias(name))


def moving(rows: DataFrame, by: list[str], order: list[str], f: Column, n: int) -> DataFrame:
    """f over each row and the n - 1 after it, where there are as many."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, n - 1)
    return rows.withColumn("moved", f.over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == n).drop("_n")


def smooth(rows: DataFrame, by: list[str], order: list[str], x: str, kernel: list[float]) -> DataFrame:
    """A centred kernel, with its weights renormalised at the ends."""
    w, half = Window.partitionBy(*by).orderBy(*order), len(kernel) // 2
    at = lambda i: F.col(x) if i == half else F.lag(x, half - i).over(w) if i < half else F.lead(x, i - half).over(w)
    total = sum((F.coalesce(at(i), F.lit(0.0)) * k for i, k in enumerate(kernel)), F.lit(0.0))
    weight = sum((F.when(at(i).isNull(), 0.0).otherwise(k) for i, k in enumerate(kernel)), F.lit(0.0))
    return rows.withColumn("smooth", total / weight)


def fixed_bins(rows: DataFrame, by: list[str], order: list[str], f: Column, width: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("_k", k).groupBy(*by, F.expr(f"cast(_k div {width} as int)").alias("bin")).agg(f)


def rescale(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """x scaled to 0..1 and standardised by the population deviation; null where there is no spread."""
    of = rows.groupBy(*by).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_dev"))
    joined = rows.join(of, by)
    return joined.withColumn("scaled", F.try_divide(F.col(x) - F.col("_low"), F.col("_high") - F.col("_low"))).withColumn("standard", F.try_divide(F.col(x) - F.col("_mean"), F.col("_dev"))).drop("_low", "_high", "_mean", "_dev")


def log_sum(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """ln of the sum of exp(x), shifted by the greatest x."""
    top = rows.groupBy(*by).agg(F.max(x).alias("_m"))
    return rows.join(top, by).groupBy(*by, "_m").agg((F.first("_m") + F.log(F.sum(F.exp(F.col(x) - F.col("_m"))))).alias("log_sum")).drop("_m")


def log_subtract(a: Column, b: Column) -> Column:
    """ln(exp(a) - exp(b)) for a > b."""
    return a + F.log1p(-F.exp(b - a))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)
