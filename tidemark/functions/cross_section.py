"""Column functions over one cross-section (a window partitioned by session, by sector too where named)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def section(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def winsorised(rows: DataFrame, value: str, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """rows with a column held between its sorted values at floor(low (n-1)) and ceil(high (n-1)); sections of under 3 stay.

    One sort of each section: the two values are picked by position, and no section is gathered into a row.
    """
    w, x = Window.partitionBy(*keys), F.col(value)
    r = rows.withColumns({"__pos": F.row_number().over(w.orderBy(x.asc_nulls_last())) - 1, "__n": F.count(x).over(w)})
    at = lambda p: F.max(F.when(F.col("__pos") == p, x)).over(w)
    r = r.withColumns({"__low": at(F.floor(F.lit(low) * (F.col("__n") - 1))), "__high": at(F.ceil(F.lit(high) * (F.col("__n") - 1)))})
    held = F.when((F.col("__n") >= 3) & x.isNotNull(), F.greatest(F.least(x, F.col("__high")), F.col("__low"))).otherwise(x)
    return r.withColumn(value, held).drop("__pos", "__n", "__low", "__high")


def tie_rank(x: Column, keys: list[str]) -> Column:
    """Rank from 1, ties at their mean; null stays null."""
    own = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(own) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2)


def unit_rank(x: Column, keys: list[str]) -> Column:
    """tie_rank on 0 to 1; a single value gets 0.5."""
    n = F.count(x).over(Window.partitionBy(*keys))
    return F.when(n == 1, F.when(x.isNotNull(), 0.5)).otherwise(F.try_divide(tie_rank(x, keys) - 1, n - 1))


def zscore(x: Column, over: WindowSpec) -> Column:
    """Standard score by the population deviation; 0 where it is under 1e-12."""
    sd = F.stddev_pop(x).over(over)
    return F.when(x.isNull(), None).when(sd < 1e-12, 0.0).otherwise(F.try_divide(x - F.avg(x).over(over), sd))


def robust_zscore(x: Column, over: WindowSpec, median: Column, mad: Column) -> Column:
    """Score by median and scaled absolute deviation, both given as columns; the plain score where that deviation vanishes."""
    scale = F.lit(1.4826) * mad
    return F.when(x.isNull(), None).when(scale < 1e-12, zscore(x, over)).otherwise(F.try_divide(x - median, scale))


def robust_scores(rows: DataFrame, value: str, keys: list[str], most: int = 100_000) -> DataFrame:
    """rows with robust_zscore in place of the value, for sections of any length: medians come from prefix.exact_quantiles and means
    from partial sums, so that no task has to hold a section."""
    from ..operators.prefix import exact_quantiles

    x = F.col(value)
    sums = rows.groupBy(*keys).agg(F.avg(x).alias("__avg"), F.stddev_pop(x).alias("__sd"))
    r = rows.join(sums, keys).join(exact_quantiles(rows, keys, value, most=most).select(*keys, F.col("q0").alias("__md")), keys, "left")
    off = r.withColumn("__off", F.abs(x - F.col("__md")))
    r = r.join(exact_quantiles(off, keys, "__off", most=most).select(*keys, F.col("q0").alias("__mad")), keys, "left")
    scale = F.lit(1.4826) * F.col("__mad")
    plain = F.when(F.col("__sd") < 1e-12, 0.0).otherwise(F.try_divide(x - F.col("__avg"), F.col("__sd")))
    z = F.when(x.isNull(), None).when(scale < 1e-12, plain).otherwise(F.try_divide(x - F.col("__md"), scale))
    return r.withColumn(value, z).drop("__avg", "__sd", "__md", "__mad")


def bucket(x: Column, keys: list[str], tie: str, q: int = 5) -> Column:
    """Bucket 1 to q by position, which isn't ntile where q doesn't divide n; ties in order of `tie`."""
    n = F.count("*").over(Window.partitionBy(*keys))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(x, tie)) - 1
    return F.least(F.lit(q), F.floor(pos * q / n) + 1).cast("int")


def safe_corr(x: str, y: str, least: int = 3) -> Column:
    """Aggregate correlation: null under `least` rows, 0 where a sum of squares is under 1e-12."""
    n, vx, vy = F.count("*"), F.var_pop(x), F.var_pop(y)
    return F.when(n < least, None).when((vx * n < 1e-12) | (vy * n < 1e-12), 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))


def valid_denominator(x: Column, positive: bool = False) -> Column:
    """Whether x can divide: not null, not NaN, finite, at least 1e-6 from 0, above 0 if asked."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (F.abs(x) >= 1e-6)
    return ok & (x > 0) if positive else ok
