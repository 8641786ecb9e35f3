"""Evaluation of scores against forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import bucket, robust_zscore, safe_corr, section, tie_rank, unit_rank, winsorised, zscore


def joined(scores: DataFrame, returns: DataFrame) -> DataFrame:
    """(session, horizon, inst, value, ret) where both are there and finite."""
    ok = scores.filter("value IS NOT NULL").select("session", "inst", "value")
    return ok.join(returns, ["session", "inst"]).filter(~F.isnan("ret") & (F.abs("ret") != float("inf")))


def ic_series(pairs: DataFrame, keys: tuple = ("session", "horizon")) -> DataFrame:
    """Pearson and rank correlation of each section; ranks are taken within the pairs, ties at their mean."""
    k = list(keys)
    r = pairs.withColumns({"rx": tie_rank(F.col("value"), k), "ry": tie_rank(F.col("ret"), k)})
    return r.groupBy(*k).agg(safe_corr("value", "ret").alias("ic"), safe_corr("rx", "ry").alias("rank_ic"), F.count("*").alias("n")).filter("ic IS NOT NULL")


def summary(series: DataFrame, value: str, keys: list[str], lags: int = 3, order: str = "session") -> DataFrame:
    """Mean, sample deviation, ratio, share above 0, t and Newey-West t of each ordered series."""
    w = Window.partitionBy(*keys)
    d = series.withColumn("d", F.col(value) - F.avg(value).over(w)).withColumn("pos", F.row_number().over(w.orderBy(order)))
    for i in range(1, lags + 1):
        d = d.withColumn(f"l{i}", F.lag("d", i).over(w.orderBy(order)) * F.col("d"))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.avg((F.col(value) > 0).cast("double")).alias("positive"), (F.sum(F.col("d") * F.col("d")) / F.count("*")).alias("g0"), *[(F.coalesce(F.sum(f"l{i}"), F.lit(0.0)) / F.count("*")).alias(f"g{i}") for i in range(1, lags + 1)])
    used = F.least(F.lit(lags), F.col("n") - 1)
    var = F.col("g0")
    for i in range(1, lags + 1):
        var = var + F.when(F.lit(i) <= used, 2 * (1 - F.lit(float(i)) / (used + 1)) * F.col(f"g{i}")).otherwise(0.0)
    ir = F.when(F.col("sd") > 0, F.try_divide("mean", "sd")).otherwise(0.0)
    nw = F.when((F.col("n") < 3) | (var <= 1e-18), 0.0).otherwise(F.try_divide(F.col("mean"), F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n"))))
    return g.select(*keys, "n", "mean", "sd", ir.alias("ir"), "positive", (ir * F.sqrt("n")).alias("t"), nw.alias("nw_t"))


def annualised(value: Column, n: Column, per_year: int = 12) -> Column:
    """Compound growth a year from a product of (1 + r) over n periods; -1 where it isn't positive."""
    return F.when(n == 0, 0.0).when(value <= 0, -1.0).otherwise(F.pow(value, F.lit(float(per_year)) / n) - 1)


def quantile_returns(pairs: DataFrame, q: int = 5) -> DataFrame:
    """(session, bucket, ret): mean return of each bucket of each section; a bucket without members has 0."""
    b = pairs.select("session", bucket(F.col("value"), ["session"], "inst", q).alias("bucket"), "ret").groupBy("session", "bucket").agg(F.avg("ret").alias("ret"))
    every = pairs.select("session").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(q))))
    return every.join(b, ["session", "bucket"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def quantile_summary(by_bucket: DataFrame, per_year: int = 12) -> DataFrame:
    return by_bucket.groupBy("bucket").agg(F.count("*").alias("n"), F.product(F.lit(1.0) + F.col("ret")).alias("g")).select("bucket", "n", annualised(F.col("g"), F.col("n"), per_year).alias("annual"))


def monotonicity(per_bucket: DataFrame) -> DataFrame:
    """Rank correlation of bucket number and annual return; ties in order of the bucket."""
    r = per_bucket.withColumn("pos", F.row_number().over(Window.orderBy("annual", "bucket")).cast("double")).withColumn("b", F.col("bucket").cast("double"))
    return r.agg(safe_corr("b", "pos").alias("monotonicity"))


def long_short(by_bucket: DataFrame, q: int = 5, per_year: int = 12) -> DataFrame:
    """Top bucket less bottom: yearly return, deviation and their ratio."""
    s = by_bucket.groupBy("session").agg((F.max(F.when(F.col("bucket") == q, F.col("ret"))) - F.max(F.when(F.col("bucket") == 1, F.col("ret")))).alias("r"))
    g = s.agg(F.count("*").alias("n"), F.product(F.lit(1.0) + F.col("r")).alias("g"), (F.coalesce(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.lit(float(per_year)))).alias("vol"))
    g = g.withColumn("annual", annualised(F.col("g"), F.col("n"), per_year))
    return g.select("n", "annual", "vol", F.when(F.col("vol") > 0, F.try_divide("annual", "vol")).otherwise(0.0).alias("sharpe"))


def turnover(scores: DataFrame) -> DataFrame:
    """(session, turnover): 1 less the correlation of a section's ranks with the one before, on names in both; 1 if undefined."""
    s = scores.filter("value IS NOT NULL").select("session", "inst", tie_rank(F.col("value"), ["session"]).alias("r"))
    order = s.select("session").distinct().withColumn("pos", F.row_number().over(Window.orderBy("session")))
    s = s.join(order, "session")
    prev = s.select("inst", (F.col("pos") + 1).alias("pos"), F.col("r").alias("was"))
    c = s.join(prev, ["inst", "pos"]).groupBy("session").agg(safe_corr("r", "was").alias("c"))
    return order.filter("pos > 1").join(c, "session", "left").select("session", F.greatest(F.lit(0.0), F.when(F.col("c").isNull(), 1.0).otherwise(1 - F.col("c"))).alias("turnover"))


def transform(x: DataFrame, direction: int = 1, winsorize: bool = True, rank: bool = False, robust: bool = False, value: str = "value") -> DataFrame:
    """Winsorised, then ranked, or scored by median and deviation, or by mean: the first asked for; then turned.

    A rank r turns to 1 - r, a score to its negative. Null stays null, and other columns, such as a reason, stay as they are.
    """
    if winsorize:
        x = winsorised(x, value, ["session"])
    w = section("session")
    if rank:
        x = x.withColumn(value, unit_rank(F.col(value), ["session"]))
    elif robust:
        x = x.withColumn("__md", F.median(value).over(w)).withColumn("__mad", F.median(F.abs(F.col(value) - F.col("__md"))).over(w))
        x = x.withColumn(value, robust_zscore(F.col(value), w, F.col("__md"), F.col("__mad"))).drop("__md", "__mad")
    else:
        x = x.withColumn(value, zscore(F.col(value), w))
    return x if direction > 0 else x.withColumn(value, 1 - F.col(value) if rank else -F.col(value))


def composite(parts: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """(session, inst, value) of a long table with factor: weighted mean of scored factors, null under `least` of all weight.

    Each factor is winsorised and scored before the mean, the mean after it; a factor's direction isn't applied.
    """
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    k = Window.partitionBy("session", "factor")
    z = winsorised(parts.filter(F.col("factor").isin(*weights)), "value", ["session", "factor"]).withColumn("value", zscore(F.col("value"), k))
    own = F.when(F.col("value").isNotNull(), w[F.col("factor")])
    m = z.groupBy("session", "inst").agg(F.sum(own * F.col("value")).alias("s"), F.sum(own).alias("w"))
    m = m.select("session", "inst", F.when(F.col("w") >= F.lit(least * sum(weights.values())), F.try_divide("s", "w")).alias("value"))
    return transform(m)


def excess_label(returns: DataFrame) -> DataFrame:
    """Forward returns less the mean of their section."""
    return returns.withColumn("label", F.col("ret") - F.avg("ret").over(Window.partitionBy("session", "horizon")))


def rank_label(returns: DataFrame) -> DataFrame:
    """Tie-averaged rank of each section's returns on -0.5 to 0.5; sections of under 3 go."""
    k = ["session", "horizon"]
    return returns.withColumn("__n", F.count("*").over(Window.partitionBy(*k))).filter("__n >= 3").withColumn("label", unit_rank(F.col("ret"), k) - 0.5).drop("__n")


def ordinal_label(returns: DataFrame) -> DataFrame:
    """Place of each return in its section on -1 to 1, ties in order of name; 0 where it is alone."""
    w = Window.partitionBy("session", "horizon")
    n = F.count("*").over(w)
    pos = F.row_number().over(w.orderBy("ret", "inst")) - 1
    return returns.withColumn("label", F.when(n > 1, 2.0 * pos / F.greatest(n - 1, F.lit(1)) - 1.0).otherwise(0.0))


def coverage(scores: DataFrame) -> DataFrame:
    """(session, names, valid, coverage): how many of a section's names have a value, which is its breadth, and their share."""
    g = scores.groupBy("session").agg(F.count("*").alias("names"), F.count("value").alias("valid"))
    return g.withColumn("coverage", F.col("valid") / F.col("names"))


def availability(snapshots: DataFrame) -> DataFrame:
    """(session, as_of): a composite is available when the last of its parts (session, factor, as_of) is."""
    return snapshots.groupBy("session").agg(F.max("as_of").alias("as_of"))


# ---- models: predictions (model, session, inst, prediction, label) -----------------------------------------------------------


def prediction_ics(predictions: DataFrame) -> DataFrame:
    """(model, session, n, ic): rank correlation of predictions and labels, ties at their mean; 0 where either side is flat."""
    k = ["model", "session"]
    r = predictions.withColumns({"rx": tie_rank(F.col("prediction"), k), "ry": tie_rank(F.col("label"), k)})
    return r.groupBy(*k).agg(F.count("*").alias("n"), F.coalesce(safe_corr("rx", "ry"), F.lit(0.0)).alias("ic"))


def quintiles(predictions: DataFrame, q: int = 5) -> DataFrame:
    """(model, bucket, label): mean label of each predicted bucket, from 0, over sections of at least q names; ties in order of name."""
    w = Window.partitionBy("model", "session")
    n, pos = F.count("*").over(w), F.row_number().over(w.orderBy("prediction", "inst")) - 1
    r = predictions.withColumns({"n": n, "bucket": F.least(F.lit(q - 1), F.floor(pos * q / n)).cast("int")}).filter(F.col("n") >= q)
    every = predictions.select("model").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    return every.join(r.groupBy("model", "bucket").agg(F.avg("label").alias("label")), ["model", "bucket"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def model_reports(predictions: DataFrame, per_year: float = 12.0) -> DataFrame:
    """(model, n, mean, sd, ir, ir_annual, t, spread, monotonic) over sections of at least 3 names."""
    g = prediction_ics(predictions).filter("n >= 3").groupBy("model").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("sd"))
    ir = F.when(F.col("sd") > 1e-9, F.try_divide("mean", "sd")).otherwise(0.0)
    step = F.col("label") - F.lag("label").over(Window.partitionBy("model").orderBy("bucket"))
    b = quintiles(predictions).withColumn("step", step).groupBy("model").agg((F.max_by("label", "bucket") - F.min_by("label", "bucket")).alias("spread"), (F.min("step") >= 0).alias("monotonic"))
    return g.join(b, "model").select("model", "n", "mean", "sd", ir.alias("ir"), (ir * F.sqrt(F.lit(per_year))).alias("ir_annual"), (ir * F.sqrt("n")).alias("t"), "spread", "monotonic")
