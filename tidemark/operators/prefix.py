"""Prefix aggregates over ordered rows of a key that may be too long for one task, and exact quantiles of sections that may be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a kind of running value is taken over rows, and how that of a slice meets what all slices before have carried.
_OVER = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum, "xor": F.bit_xor}
_MEET = {
    "last": lambda own, before: F.coalesce(own, before),
    "max": lambda own, before: F.when(own.isNull() | (before > own), before).otherwise(own),
    "sum": lambda own, before: F.coalesce(own + before, own, before),
    "xor": lambda own, before: F.coalesce(own.bitwiseXOR(before), own, before),
}


def _slice_of(time: Column, bounds: list) -> Column:
    """How many of the ordered bounds are under time, by a binary search written as a tree of comparisons; 0 for null."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    over = _slice_of(time, bounds[mid + 1 :]) + (mid + 1)
    return F.when(time > F.lit(bounds[mid]), over).otherwise(_slice_of(time, bounds[:mid]))


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], slices: int = 1) -> DataFrame:
    """rows with columns {name: (kind, column)}: the column's last value that isn't null, 'max', 'sum' or 'xor' over the rows of the
    key up to this one in order.

    With slices over 1 the rows are parted by order[0] at approximate percentiles of the whole table, so that each key takes
    up to so many tasks: values run within a slice, and a row a key and slice, made by partial aggregates, carries them on.
    The bounds (a list of slices - 1 values) move work, not results. Null keys are a key; null times come first.
    """
    part = Window.partitionBy(*keys)
    if slices <= 1:
        w = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: _OVER[kind](c).over(w) for name, (kind, c) in values.items()})
    grid = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    bounds = rows.agg(F.percentile_approx(order[0], grid, F.lit(100 * slices)).alias("b")).first()["b"] or []
    bounds = sorted({b for b in bounds if b is not None})
    sliced = rows.withColumn("__slice", _slice_of(F.col(order[0]), bounds))
    place = F.struct(*order)
    whole = {"last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)), "max": F.max, "sum": F.sum, "xor": F.bit_xor}
    before = part.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # over a row a slice
    tails = sliced.groupBy(*keys, "__slice").agg(*[whole[kind](c).alias(f"__tail_{name}") for name, (kind, c) in values.items()])
    tails = tails.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__slice").alias("__at"), *[_OVER[kind](f"__tail_{name}").over(before).alias(f"__before_{name}") for name, (kind, _) in values.items()])
    w = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = sliced.withColumns({name: _OVER[kind](c).over(w) for name, (kind, c) in values.items()})
    meet = reduce(lambda a, b: a & b, [own[k].eqNullSafe(tails[f"__key_{k}"]) for k in keys], own["__slice"] == tails["__at"])
    out = own.join(tails, meet, "left")
    return out.withColumns({name: _MEET[kind](F.col(name), F.col(f"__before_{name}")) for name, (kind, _) in values.items()}).select(*rows.columns, *[n for n in values if n not in rows.columns])


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: tuple = (0.5,), bins: int = 4096, most: int = 100_000) -> DataFrame:
    """(keys, n, q0, q1, ...): quantiles of the finite values, interpolated between the two next in order, as F.median has them.

    A section may be of any length: each rank asked for is looked for in a histogram of the range that holds it, which partial
    aggregates keep to `bins` rows a task, and then in the bin found, until that has at most `most` rows or one value; only
    its distinct values are put in order. A round reads the table once. Sections without finite values have no row.
    """
    v = rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    far = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities) for up in (0, 1)])
    at = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = at.select("*", F.explode(far).alias("t")).select(*keys, "n", "lo", "hi", F.col("n").alias("size"), "t.*").withColumn("exact", F.col("p") * (F.col("n") - 1))
    at = at.withColumn("rank", F.when(F.col("up") == 1, F.ceil("exact")).otherwise(F.floor("exact")))
    asked = [*keys, "i", "up"]

    def inside(at: DataFrame) -> DataFrame:
        named = at.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in at.columns if c not in keys])
        meet = reduce(lambda a, b: a & b, [v[k].eqNullSafe(named[f"__{k}"]) for k in keys], v["v"].between(named["lo"], named["hi"]))
        return v.join(named, meet).drop(*[f"__{k}" for k in keys])

    def found(steps: DataFrame, step: str) -> DataFrame:
        """Of counts by step the one that holds the rank."""
        upto = F.sum("count").over(Window.partitionBy(*asked).orderBy(step))
        return steps.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("count")))

    held = [F.max(c).alias(c) for c in ("n", "p", "exact", "rank")]
    while at.filter((F.col("size") > most) & (F.col("lo") < F.col("hi"))).limit(1).count():
        wide = F.col("hi") - F.col("lo")
        place = F.when(wide > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))).otherwise(0)
        h = inside(at).groupBy(*asked, place.alias("bin")).agg(F.count("*").alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"), *held)
        at = found(h, "bin").select(*asked, "n", "p", "exact", (F.col("rank") - F.col("upto") + F.col("count")).alias("rank"), "lo", "hi", F.col("count").alias("size"))
        at = rows.sparkSession.createDataFrame(at.toArrow())  # a row a key and rank; so that rounds don't nest
    one = found(inside(at).groupBy(*asked, "v").agg(F.count("*").alias("count"), *held), "v")
    low, high = (F.max(F.when(F.col("up") == u, F.col("v"))) for u in (0, 1))
    q = one.groupBy(*keys, "i").agg(F.max("n").alias("n"), (low + (high - low) * F.max(F.col("exact") - F.floor("exact"))).alias("q"))
    return q.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probabilities))])
