"""Point-in-time operators: as-of joins, vintages, interval joins, corporate-action adjustment, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def sessions(bars: DataFrame) -> DataFrame:
    """(session, idx): the union calendar, numbered from 1. One row per day of history, so that one task can number it."""
    return bars.select("session").distinct().withColumn("idx", F.row_number().over(Window.orderBy("session")))


def month_ends(bars: DataFrame) -> DataFrame:
    """(session): the last one of each month."""
    return bars.groupBy(F.trunc("session", "month").alias("m")).agg(F.max("session").alias("session")).select("session")


def spine(bars: DataFrame, at: DataFrame) -> DataFrame:
    """(session, inst): the sessions `at` for each instrument ever seen; the calendar side is small and broadcast by size."""
    return bars.select("inst").distinct().crossJoin(at)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: list[str] | None = None, strict: bool = False, slices: int = 1) -> DataFrame:
    """left with a struct column `hit`: the last row of right with equal keys and a time not after left's (before, if strict).

    One shuffle on the keys and one sort, for any number of versions a key: rows of both sides are laid in order of time
    and the last right row is carried on. Of right rows of one time the last in order of `tie` is taken. For few or hot keys
    `slices` deals each over so many tasks by time (see prefix.running).
    """
    tie = tie or []
    cols = [c for c in right.columns if c not in keys]
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__k"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(tie)], F.struct(*cols).alias("hit"), F.lit(None).cast("string").alias("__l"))
    lcols = [c for c in left.columns if c not in keys]
    lt = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__k"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(tie)], F.struct(*lcols).alias("__l"))
    r = r.withColumn("__l", F.lit(None).cast(lt.schema["__l"].dataType))
    both = r.unionByName(lt.withColumn("hit", F.lit(None).cast(r.schema["hit"].dataType)))
    out = running(both, keys, ["__t", "__k", *[f"__o{i}" for i in range(len(tie))]], {"__hit": ("last", "hit")}, slices)
    return out.filter("__l IS NOT NULL").select(*keys, "__l.*", F.col("__hit").alias("hit"))


def latest_vintage(facts: DataFrame, asks: DataFrame, keys: list[str], available: str = "available", order: tuple = ("period_end", "available", "id"), slices: int = 1) -> DataFrame:
    """asks (keys, as_of) with the visible fact that is last in `order`: value of the latest period, its latest vintage.

    The best visible fact is the running maximum of (order) over facts as they become available, so that the as-of join
    carries it along instead of joining each ask with its whole history. slices as in as_of.
    """
    own = facts.groupBy(*keys, available).agg(F.max(F.struct(*order, "value")).alias("own"))
    steps = running(own, keys, [available], {"best": ("max", "own")}, slices).select(*keys, available, "best")
    out = as_of(asks, steps, keys, "as_of", available, slices=slices)
    return out.select(*[c for c in asks.columns], *[F.col(f"hit.best.{c}").alias(c) for c in (*order, "value") if c not in asks.columns])


def restatements(facts: DataFrame, keys: list[str], order: tuple = ("available", "id")) -> DataFrame:
    """(keys, vintages, first_value, last_value) of facts that were published more than once."""
    k = F.struct(*order)
    return facts.groupBy(*keys).agg(F.count("*").alias("vintages"), F.min_by("value", k).alias("first_value"), F.max_by("value", k).alias("last_value")).filter("vintages > 1")


def interval_resolve(asks: DataFrame, history: DataFrame, strict: bool = False, slices: int = 1) -> DataFrame:
    """asks (symbol, exchange, day) with matches, how many intervals hold the symbol on the day, and inst where it is one.

    With strict=True a symbol that several held on a day fails the job. A sweep, linear in asks and intervals: intervals open
    before the asks of their first day and close after those of their last, so that matches is a running sum, and the exclusive
    or of the open holders' codes is the holder's own where there is one. slices deals a hot symbol over so many tasks.
    Null symbols, exchanges and days are held by none; an interval that ends before it begins holds nothing.
    """
    keys, kind = ["symbol", "exchange"], history.schema["inst"].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    code = F.coalesce(F.col("inst").cast("long"), F.lit(0)) if whole else F.xxhash64("inst")
    h = history.filter("symbol IS NOT NULL AND exchange IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to >= valid_from)")
    h = h.select(*keys, "valid_from", "valid_to", code.cast("long").alias("code"), F.col("inst").isNull().cast("long").alias("unknown"))
    none = F.lit(None).cast(asks.select(F.struct("*").alias("a")).schema["a"].dataType)
    event = lambda t, turn, n: [*keys, F.col(t).alias("__t"), F.lit(turn).alias("__turn"), F.lit(n).alias("n"), "code", (F.col("unknown") * n).alias("unknown"), none.alias("ask")]
    zero = F.lit(0).cast("long")
    ask = asks.select(*keys, F.col("day").alias("__t"), F.lit(1).alias("__turn"), F.lit(0).alias("n"), zero.alias("code"), zero.alias("unknown"), F.struct("*").alias("ask"))
    rows = h.select(*event("valid_from", 0, 1)).unionByName(h.filter("valid_to IS NOT NULL").select(*event("valid_to", 2, -1))).unionByName(ask)
    out = running(rows, keys, ["__t", "__turn"], {"__n": ("sum", "n"), "__code": ("xor", "code"), "__unknown": ("sum", "unknown")}, slices)
    out = out.filter("ask IS NOT NULL").select("ask.*", F.coalesce("__n", zero).alias("matches"), F.when((F.col("__n") == 1) & (F.col("__unknown") == 0), F.col("__code")).alias("code"))
    if whole:
        out = out.withColumn("inst", F.col("code").cast(kind))
    else:
        names = history.select(*keys, F.xxhash64("inst").alias("code"), "inst").dropDuplicates([*keys, "code"])
        out = out.join(names, [*keys, "code"], "left")
    several = F.raise_error(F.concat(F.lit("several instruments hold "), F.col("symbol"))).cast(kind) if strict else F.lit(None)
    return out.select(*asks.columns, "matches", F.when(F.col("matches") == 1, F.col("inst")).when(F.col("matches") > 1, several).alias("inst"))


def interval_overlaps(history: DataFrame) -> DataFrame:
    """Rows of a symbol history whose end isn't before the next start of the symbol and exchange."""
    nxt = F.lead("valid_from").over(Window.partitionBy("symbol", "exchange").orderBy("valid_from", "inst"))
    return history.withColumn("next_from", nxt).filter("next_from IS NOT NULL AND (valid_to IS NULL OR valid_to >= next_from)")


def adjustment_factors(bars: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """bars with price_factor and volume_factor: the products of the visible actions effective after each bar.

    A split of R divides prices by R and multiplies volume; a dividend D scales prices by (p - D) / p with the last close p
    before it, if p > D. Bars and actions share one window by instrument, so that actions on days without a bar count.
    """
    day = F.lit(as_of).cast("date")
    first = bars.groupBy("inst").agg(F.min("session").alias("first"))
    a = actions.filter((F.col("available") <= day) & (F.col("effective") <= day)).join(first, "inst").filter("effective > first")
    rows = bars.select("inst", F.col("session").alias("day"), F.lit(1).alias("bar"), "close", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("double").alias("cash"))
    rows = rows.unionByName(a.select("inst", F.col("effective").alias("day"), F.lit(0).alias("bar"), F.lit(None).cast("double").alias("close"), "kind", "ratio", "cash"))
    prior = F.last("close", ignorenulls=True).over(Window.partitionBy("inst").orderBy("day", "bar").rowsBetween(Window.unboundedPreceding, -1))
    p = F.when(F.col("kind") == "split", F.try_divide(F.lit(1.0), F.col("ratio"))).when((F.col("kind") == "dividend") & (prior > F.col("cash")), (prior - F.col("cash")) / prior).otherwise(1.0)
    rows = rows.withColumns({"p": p, "v": F.when(F.col("kind") == "split", F.col("ratio")).otherwise(1.0)})
    later = Window.partitionBy("inst").orderBy(F.desc("day"), F.desc("bar")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"price_factor": F.coalesce(F.product("p").over(later), F.lit(1.0)), "volume_factor": F.coalesce(F.product("v").over(later), F.lit(1.0))}).filter("bar = 1")
    return bars.join(rows.select("inst", F.col("day").alias("session"), "price_factor", "volume_factor"), ["inst", "session"])


def apply_adjustments(bars: DataFrame) -> DataFrame:
    """Bars with factors to adjusted bars: half-even to 6 places (volume 4), floors 1e-6 and 1e-4, high and low outermost."""
    px = lambda c: F.greatest(F.bround(F.col(c) * F.col("price_factor"), 6), F.lit(1e-6))
    out = bars.withColumns({c: px(c) for c in ("open", "high", "low", "close")} | {"volume": F.greatest(F.bround(F.col("volume") * F.col("volume_factor"), 4), F.lit(1e-4))})
    return out.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})


def split_unadjust(actions: DataFrame) -> DataFrame:
    """Splits with `factor`: the product of all later ratios of the instrument, for taking a provider's adjustment back."""
    w = Window.partitionBy("inst").orderBy(F.desc("effective"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    return actions.filter("kind = 'split'").withColumn("factor", F.coalesce(F.product("ratio").over(w), F.lit(1.0)))


def series_errors(engine: DataFrame, provider: DataFrame) -> DataFrame:
    """(inst, sessions, median_error, worst_error) of two series (inst, session, close), scaled to meet on their last common session."""
    j = engine.select("inst", "session", F.col("close").alias("e")).join(provider.select("inst", "session", F.col("close").alias("p")), ["inst", "session"]).filter("p > 0 AND e > 0")
    scale = F.max_by(F.col("p") / F.col("e"), "session").over(Window.partitionBy("inst"))
    j = j.withColumn("err", F.abs(F.col("e") * scale - F.col("p")) / F.col("p"))
    return j.groupBy("inst").agg(F.count("*").alias("sessions"), F.median("err").alias("median_error"), F.max("err").alias("worst_error"))


def series_summary(errors: DataFrame) -> DataFrame:
    """One row of series_errors: names, the median of their medians, and the worst error of all."""
    return errors.agg(F.count("*").alias("names"), F.median("median_error").alias("median_error"), F.max("worst_error").alias("worst_error"))
