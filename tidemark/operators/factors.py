"""Cross-sectional factors on a spine of sessions and instruments, as long tables (session, inst, value, reason).

Each history window is a window function over (inst, session) whose result stands on the bar that ends it; the as-of join
then picks, for each session, the last visible bar. With strict=True a session's own bar isn't visible yet (research),
else it is (trading). A window of n bars also has to begin within a number of calendar days before the session.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import valid_denominator
from .pit import as_of

SHORT, BAD = "insufficient_history", "invalid_denominator"


#: Column beside inst by which rows of copies were dealt to tasks: inst settles it.
HOME = "__home"


def own(bars: DataFrame) -> list[str]:
    """What tells instruments apart: inst and, where rows were dealt by it, their home. Who groups by both needn't move a row."""
    return ["inst", *[c for c in bars.columns if c == HOME]]


def _by_bar():
    return Window.partitionBy("inst").orderBy("session")


def _on_spine(bars: DataFrame, at: DataFrame, cols: dict[str, Column], strict: bool) -> DataFrame:
    rows = bars.select("inst", "session", *[c.alias(n) for n, c in cols.items()])
    return as_of(at, rows.withColumnRenamed("session", "bar_session"), ["inst"], "session", "bar_session", strict=strict)


def _finish(df: DataFrame, first: str, days: int, value: Column, base: Column | None = None) -> DataFrame:
    enough = F.coalesce(F.col(first) >= F.date_sub("session", days), F.lit(False))
    bad = (base <= 0) if base is not None else F.lit(False)
    reason = F.when(~enough, SHORT).when(bad, BAD).when(value.isNull() | F.isnan(value), SHORT)
    return df.select("session", "inst", F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def momentum(bars: DataFrame, at: DataFrame, far: int = 252, near: int = 21, days: int = 450, strict: bool = True) -> DataFrame:
    """close[-near] / close[-far] - 1, of at least `far` bars.

    Bars and points are laid in order of time together and the two bars are counted back from the point, so that bars are
    shuffled and sorted once, and no bar carries a window that no point asks for.
    """
    keys = own(bars)
    b = bars.select(*keys, F.col("session").alias("__t"), F.lit(1 if strict else 0).alias("__k"), F.struct("session", "close").alias("bar"))
    p = at.select(*keys, F.col("session").alias("__t"), F.lit(0 if strict else 1).alias("__k"), F.lit(None).cast(b.schema["bar"].dataType).alias("bar"))
    back = lambda n: F.expr(f"lag(bar, {n}) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY __t, __k)")
    j = b.unionByName(p).withColumns({"near": back(near), "far": back(far)}).filter("bar IS NULL")
    j = j.select(F.col("__t").alias("session"), "inst", F.col("near.close").alias("c_near"), F.col("far.close").alias("c_far"), F.col("far.session").alias("d_far"))
    return _finish(j, "d_far", days, F.try_divide("c_near", "c_far") - 1, F.col("c_far"))


def volatility(bars: DataFrame, at: DataFrame, n: int = 60, days: int = 120, strict: bool = True) -> DataFrame:
    """Sample deviation of the last n simple returns, by the root of 252; a previous close of 0 or less counts as short."""
    prev = F.lag("close").over(_by_bar())
    b = bars.withColumn("ret", F.when(prev > 0, F.col("close") / prev - 1))
    frame = _by_bar().rowsBetween(1 - n, 0)
    cols = {"sd": F.when(F.count("ret").over(frame) == n, F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(252.0))), "d_far": F.lag("session", n).over(_by_bar())}
    return _finish(_on_spine(b, at, cols, strict).select("session", "inst", "hit.*"), "d_far", days, F.col("sd"))


def max_drawdown(bars: DataFrame, at: DataFrame, n: int = 252, days: int = 450, strict: bool = True) -> DataFrame:
    """Largest fall from a running peak of the last n closes, as a positive number; no close may be negative.

    A window of n bars is the end of one block of n and the beginning of the next. Each bar has the peak and the worst fall of
    its block's rest, and the low and the worst fall of its block so far; the worst of a window is that of either part, or from
    the peak of the first to the low of the second. A few running values a bar, whatever n.
    """
    b = bars.select("inst", "session", "close", (F.row_number().over(_by_bar()) - 1).alias("k"))
    b = b.withColumns({"block": F.floor(F.col("k") / n), "place": F.col("k") % n, "d_far": F.lag("session", n - 1).over(_by_bar())})
    block = Window.partitionBy("inst", "block")
    so_far, rest = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("session", F.desc("session")))
    fall = lambda low, peak: F.when(peak > 0, 1 - low / peak)
    b = b.withColumns({"low": F.min("close").over(so_far), "fall": fall(F.col("close"), F.max("close").over(so_far))}).withColumn("worst", F.max("fall").over(so_far))
    b = b.withColumns({"peak": F.max("close").over(rest), "fall": fall(F.min("close").over(rest), F.col("close"))}).withColumn("later", F.max("fall").over(rest))
    first = F.lag(F.struct("peak", "later"), n - 1).over(_by_bar())
    b = b.withColumn("first", first)
    worst = F.when(F.col("place") == n - 1, F.col("worst")).otherwise(F.greatest("first.later", "worst", fall(F.col("low"), F.col("first.peak"))))
    return _finish(_on_spine(b, at, {"worst": F.coalesce(worst, F.lit(0.0)), "d_far": F.col("d_far")}, strict).select("session", "inst", "hit.*"), "d_far", days, F.col("worst"))


def beta(bars: DataFrame, at: DataFrame, n: int = 252, days: int = 450, strict: bool = True) -> DataFrame:
    """Slope on the equal-weight market of instruments with full history; returns are aligned by position, not by date.

    A point has one row: its n returns as an array, cut from the two blocks of n bars that hold them. The market of a section is
    the sum of these arrays, element by element and partial before it is shuffled, over how many names have each.
    """
    ret = F.when(F.lag("close").over(_by_bar()) > 0, F.col("close") / F.lag("close").over(_by_bar()) - 1)
    b = bars.select("inst", "session", (F.row_number().over(_by_bar()) - 1).alias("k"), ret.alias("ret"), F.lag("session", n).over(_by_bar()).alias("d_far"))
    own = b.groupBy("inst", F.floor(F.col("k") / n).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ret"))), lambda x: x["ret"]).alias("rets"))
    two = own.withColumn("rets", F.concat(F.coalesce(F.lag("rets").over(Window.partitionBy("inst").orderBy("block")), F.array().cast("array<double>")), "rets"))
    hit = _on_spine(b, at, {"k": F.col("k"), "d_far": F.col("d_far")}, strict).select("session", "inst", "hit.*")
    full = hit.filter(F.col("d_far") >= F.date_sub("session", days)).withColumn("block", F.floor(F.col("k") / n))
    end = F.when(F.col("block") > 0, n).otherwise(0) + F.col("k") % n + 1
    points = full.join(two, ["inst", "block"]).select("session", "inst", F.slice("rets", end - (n - 1), F.lit(n)).alias("rets"))
    there = F.concat(F.transform("rets", lambda r: F.coalesce(r, F.lit(0.0))), F.transform("rets", lambda r: F.when(r.isNull(), 0.0).otherwise(1.0)))
    total = points.groupBy("session").agg(vector_to_array(Summarizer.sum(array_to_vector(there))).alias("total"))
    market = total.select("session", F.zip_with(F.slice("total", 1, n), F.slice("total", n + 1, n), lambda s, c: F.when(c > 0, s / c)).alias("market"))
    pairs = points.join(market, "session").select("session", "inst", F.arrays_zip(F.col("rets").alias("r"), F.col("market").alias("m")).alias("p"))

    known = F.filter("p", lambda x: x["m"].isNotNull())
    both = F.filter("p", lambda x: x["r"].isNotNull() & x["m"].isNotNull())
    mean = lambda rows, c: F.try_divide(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x[c]), F.size(rows))
    spread = lambda rows, f: F.try_divide(F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x)), F.size(rows) - 1)
    s = pairs.select("session", "inst", known.alias("known"), both.alias("both"))
    s = s.withColumns({"m": mean("known", "m"), "bm": mean("both", "m"), "br": mean("both", "r")})
    v = spread("known", lambda x: (x["m"] - F.col("m")) * (x["m"] - F.col("m")))
    c = spread("both", lambda x: (x["r"] - F.col("br")) * (x["m"] - F.col("bm")))
    m = s.select("session", "inst", v.alias("v"), c.alias("c")).select("session", "inst", F.when(F.col("v") <= 1e-12, 1.0).otherwise(F.try_divide("c", "v")).alias("value"))
    out = at.join(m, ["session", "inst"], "left")
    return out.select("session", "inst", "value", F.when(F.col("value").isNull(), SHORT).alias("reason"))


def forward_returns(bars: DataFrame, calendar: DataFrame, horizons: tuple[int, ...] = (21,), at: DataFrame | None = None) -> DataFrame:
    """(session, horizon, inst, ret): open one session on to open `horizon` sessions after that, by the union calendar.

    at: the sessions asked for, all if not given; only bars that open or close a return of theirs are joined. Calendars have a
    row a day, so that they are broadcast and bars stay where they are until then.
    """
    opens = bars.join(F.broadcast(calendar), "session").select("inst", "idx", "open")
    asked = calendar if at is None else calendar.join(F.broadcast(at), "session", "left_semi")
    times = asked.select("session", (F.col("idx") + 1).alias("idx"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).withColumn("x", F.col("idx") + F.col("horizon"))
    entry = opens.filter("open > 0").join(F.broadcast(times), "idx").select("session", "horizon", "inst", "x", F.col("open").alias("entry"))
    exits = opens if at is None else opens.join(F.broadcast(times.select(F.col("x").alias("idx"))), "idx", "left_semi")
    got = entry.join(exits.select("inst", F.col("idx").alias("x"), F.col("open").alias("exit")), ["inst", "x"])
    return got.select("session", "horizon", "inst", (F.col("exit") / F.col("entry") - 1).alias("ret"))


# ---- fundamentals: facts at a point are the latest vintage of the latest period, one column a metric ---------------------------


def facts_at(filings: DataFrame, at: DataFrame, metrics: list[str]) -> DataFrame:
    """(session, inst, one column per metric and prior_<metric>): values visible at each point, and those a year before.

    The prior value is that of the period a year earlier, in the vintage visible at the same point.
    """
    from .pit import latest_vintage

    ask = at.select("inst", "session", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")).withColumn("as_of", F.col("session"))
    now = latest_vintage(filings, ask, ["inst", "metric"])
    old = filings.select("inst", "metric", F.col("period_end").alias("prior_end"), F.col("available").alias("old_available"), F.col("id").alias("old_id"), F.col("value").alias("old_value"))
    j = now.withColumn("prior_end", F.add_months("period_end", -12)).join(old, ["inst", "metric", "prior_end"], "left")
    seen = F.when(F.col("old_available") <= F.col("session"), F.struct("old_available", "old_id", "old_value"))
    j = j.groupBy("inst", "session", "metric").agg(F.first("value").alias("value"), F.max(seen).getField("old_value").alias("prior"))
    out = j.groupBy("inst", "session").pivot("metric", metrics).agg(F.first("value").alias("v"), F.first("prior").alias("p"))
    return out.select("inst", "session", *[F.col(f"{m}_v").alias(m) for m in metrics], *[F.col(f"{m}_p").alias(f"prior_{m}") for m in metrics])


#: Fallbacks as the rules have them: a missing item is read as net income, a missing base as 1, a missing prior year as 5 % growth.
def quality_and_growth(facts: DataFrame) -> DataFrame:
    ni = F.col("net_income")
    ratio = lambda a, b: F.when(a.isNotNull() & valid_denominator(b), F.try_divide(a, b))
    growth = lambda x: F.when(F.col(x).isNull(), None).when(F.col(f"prior_{x}").isNull(), 0.05).otherwise(ratio(F.col(x) - F.col(f"prior_{x}"), F.abs(F.col(f"prior_{x}"))))
    cash = F.coalesce(F.col("operating_income"), ni) * 1.1
    return facts.select(
        "session", "inst", ratio(ni, F.coalesce("stockholders_equity", F.lit(1.0))).alias("roe"), ratio(ni, F.coalesce("total_assets", F.lit(1.0))).alias("roa"),
        ratio(F.coalesce(F.col("revenue"), ni), F.coalesce("total_assets", F.lit(1.0))).alias("gross_profitability"), ratio(cash - ni, F.coalesce("total_assets", F.lit(1.0))).alias("accrual_quality"),
        growth("revenue").alias("revenue_growth"), growth("operating_income").alias("opinc_growth"),
    )


def value_family(facts: DataFrame, bars: DataFrame, days: int = 30, strict: bool = True) -> DataFrame:
    """Earnings, book and cash flow over the last close of the last 30 days, as the rules have it: aggregate over share price."""
    rows = bars.select("inst", "session", "close").withColumnRenamed("session", "bar_session")
    j = as_of(facts, rows, ["inst"], "session", "bar_session", strict=strict)
    px = F.when(F.col("hit.bar_session") >= F.date_sub("session", days), F.col("hit.close"))
    ni = F.col("net_income")
    per = lambda a: F.when((px > 0) & a.isNotNull(), F.try_divide(a, px))
    return j.select("session", "inst", per(ni).alias("earnings_yield"), per(F.coalesce(F.col("stockholders_equity"), ni)).alias("book_to_market"), per(F.coalesce(F.col("operating_income"), ni)).alias("fcf_yield"))
