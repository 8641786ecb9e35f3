"""Performance of equity series (key, session, equity), many series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_returns(series: DataFrame, key: str = "inst") -> DataFrame:
    prev = F.lag("equity").over(Window.partitionBy(key).orderBy("session"))
    return series.withColumn("ret", F.when(prev > 0, F.col("equity") / prev - 1))


def metrics(series: DataFrame, key: str = "inst", per_year: float = 252.0) -> DataFrame:
    """Total return, CAGR, volatility, Sharpe as CAGR / volatility, Sortino, drawdown, its longest run, Calmar, win rate, profit factor.

    Undefined ratios are 0, the profit factor of a series without losses 99. A run of drawdown counts every bar that isn't
    a new peak, the first one too.
    """
    w = Window.partitionBy(key).orderBy("session")
    r = daily_returns(series, key).withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumns({"fall": 1 - F.col("equity") / F.col("peak"), "new": (before.isNotNull() & (F.col("equity") > before)).cast("int")})
    r = r.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = r.groupBy(key, "island").agg((F.count("*") - F.max("new")).alias("run")).groupBy(key).agg(F.max("run").alias("drawdown_bars"))
    neg = F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0)
    g = r.groupBy(key).agg(
        F.count("ret").alias("n"), F.min_by("equity", "session").alias("e0"), F.max_by("equity", "session").alias("e1"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"), F.sum(neg * neg).alias("down"),
        F.max("fall").alias("max_drawdown"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("win_rate"), F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)).alias("gain"), F.sum(-neg).alias("loss"),
    ).filter("n >= 2 AND e0 > 0 AND e1 > 0")
    g = g.withColumn("total_return", F.col("e1") / F.col("e0") - 1).withColumn("cagr", F.pow(F.col("e1") / F.col("e0"), F.lit(per_year) / F.col("n")) - 1)
    g = g.withColumns({"volatility": F.col("sd") * F.sqrt(F.lit(per_year)), "downside": F.sqrt(F.col("down") / (F.col("n") - 1)) * F.sqrt(F.lit(per_year))})
    ratio = lambda a, b: F.when(F.col(b) > 1e-12, F.try_divide(a, b)).otherwise(0.0)
    return g.join(runs, key).select(key, "n", "total_return", "cagr", "volatility", ratio("cagr", "volatility").alias("sharpe"), ratio("cagr", "downside").alias("sortino"), "max_drawdown", "drawdown_bars", ratio("cagr", "max_drawdown").alias("calmar"), "win_rate", F.when(F.col("loss") > 1e-12, F.least(F.lit(99.0), F.try_divide("gain", "loss"))).otherwise(99.0).alias("profit_factor"))


def benchmark_compare(series: DataFrame, bench: DataFrame, key: str = "inst", per_year: float = 252.0) -> DataFrame:
    """Beta, alpha, tracking error, information ratio, correlation, on days of both; returns span to the previous such day."""
    j = series.join(bench.select("session", F.col("equity").alias("b")), "session")
    w = Window.partitionBy(key).orderBy("session")
    j = j.withColumns({"r": F.col("equity") / F.lag("equity").over(w) - 1, "m": F.col("b") / F.lag("b").over(w) - 1}).filter("r IS NOT NULL AND m IS NOT NULL")
    g = j.groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("ar"), F.avg("m").alias("am"), F.var_samp("m").alias("vm"), F.covar_samp("r", "m").alias("c"), F.stddev_samp(F.col("r") - F.col("m")).alias("te"), F.var_samp("r").alias("vr")).filter("n >= 3")
    g = g.withColumn("beta", F.when(F.col("vm") <= 1e-8, 1.0).otherwise(F.try_divide("c", "vm"))).withColumn("tracking_error", F.col("te") * F.sqrt(F.lit(per_year)))
    return g.select(key, "n", "beta", ((F.col("ar") - F.col("beta") * F.col("am")) * per_year).alias("alpha"), "tracking_error", F.when(F.col("tracking_error") > 1e-12, (F.col("ar") - F.col("am")) * per_year / F.col("tracking_error")).otherwise(0.0).alias("information_ratio"), F.when(F.col("vr") * F.col("vm") > 1e-24, F.col("c") / F.sqrt(F.col("vr") * F.col("vm"))).otherwise(0.0).alias("correlation"))


def year_returns(series: DataFrame, key: str = "inst") -> DataFrame:
    return daily_returns(series, key).filter("ret IS NOT NULL").groupBy(key, F.year("session").alias("year")).agg((F.product(F.lit(1.0) + F.col("ret")) - 1).alias("ret"))


def moments(values: DataFrame, value: str, key: str) -> DataFrame:
    """Skew and kurtosis standardised by the sample deviation, divided by n; 0 and 3 under four values."""
    n = F.count(value)
    g = values.groupBy(key).agg(n.alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    f = (F.col("n") - 1) / F.col("n")
    ok = (F.col("n") >= 4) & (F.col("sd") > 0)
    return g.select(key, "n", "mean", "sd", F.when(ok, F.col("g1") * F.pow(f, F.lit(1.5))).otherwise(0.0).alias("skew"), F.when(ok, (F.col("g2") + 3) * f * f).otherwise(3.0).alias("kurtosis"))


def result_hash(curves: DataFrame, key: str = "variant") -> DataFrame:
    """(key, sessions, hash): sha256 over all sessions and equities, to cents, in order of session; the curve of a key is one row a session."""
    line = F.concat_ws(":", F.col("session").cast("string"), F.format_string("%.2f", "equity"))
    g = curves.groupBy(key).agg(F.count("*").alias("sessions"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines"))
    return g.select(key, "sessions", F.sha2(F.col("lines").cast("binary"), 256).alias("hash"))
