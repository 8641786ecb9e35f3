"""Universe, quality audit and small set operators over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality_audit(bars: DataFrame, as_of: str | None = None, order: str = "session") -> DataFrame:
    """One row: bars, five counts of faults, status and confidence, which is the share of counts that are 0.

    positivity: a price of 0 or less or a negative volume; ohlc: high or low within the others; lookahead: observed after as_of,
    where given (a column observed, or the session); weekend; chronology: a session before the one that came before it, in
    the order in which bars came (a column, such as a line number). Any fault is FAIL; without bars WARN at 0.5.
    """
    b = bars.withColumn("__prev", F.lag("session").over(Window.partitionBy("inst").orderBy(order)))
    seen = F.col("observed" if "observed" in bars.columns else "session")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = b.agg(
        F.count("*").alias("bars"), n((F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0)).alias("positivity"),
        n((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))).alias("ohlc"), n(seen > F.lit(as_of).cast(b.select(seen).schema[0].dataType) if as_of else F.lit(False)).alias("lookahead"),
        n(F.weekday("session") >= 5).alias("weekend"), n(F.col("__prev") > F.col("session")).alias("chronology"),
    )
    clean = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in ("positivity", "ohlc", "lookahead", "weekend", "chronology")), F.lit(0))
    status = F.when(F.col("bars") == 0, "WARN").when(clean < 5, "FAIL").otherwise("PASS")
    return out.withColumns({"status": status, "confidence": F.when(F.col("bars") == 0, 0.5).otherwise(F.round(clean / 5.0, 2))})


def quarantine(bars: DataFrame) -> DataFrame:
    """bars with the first rule that each row breaks, null for a sound one: missing, price, volume, ohlc, weekend."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = F.greatest(*[c.isNull().cast("int") for c in (*prices, F.col("volume"), F.col("session"))]) == 1
    rule = F.when(missing, "missing").when(F.least(*prices) <= 0, "price").when(F.col("volume") < 0, "volume")
    rule = rule.when((F.col("high") < F.greatest(*prices)) | (F.col("low") > F.least(*prices)), "ohlc").when(F.weekday("session") >= 5, "weekend")
    return bars.withColumn("fault", rule)


def partition_valid(scores: DataFrame) -> DataFrame:
    """(session, inst, value, reason): a value that is no finite number becomes null, with out_of_range; a null keeps its reason."""
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    own = F.col("reason") if "reason" in scores.columns else F.lit(None).cast("string")
    reason = F.when(F.col("value").isNull(), F.coalesce(own, F.lit("insufficient_history"))).when(odd, "out_of_range")
    return scores.select("session", "inst", F.when(~odd, F.col("value")).alias("value"), reason.alias("reason"))


def snapshot(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of exactly the names of a universe (session, inst): one that isn't scored is not_in_universe, one without a value short of history."""
    have = scores.select("session", "inst", "value", F.lit(True).alias("__there"))
    j = members.select("session", "inst").join(have, ["session", "inst"], "left")
    reason = F.when(F.col("__there").isNull(), "not_in_universe").when(F.col("value").isNull(), "insufficient_history")
    return j.select("session", "inst", "value", reason.alias("reason"))


def between(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a range of sessions, both ends in; the filter reaches the scan."""
    return rows.filter(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def partition_overlaps(parts: DataFrame, *keys: str) -> DataFrame:
    """Time partitions (keys, part, start, end) that reach into the next one of their key, with its name; none in a sound scheme."""
    w = Window.partitionBy(*keys).orderBy("start", "part")
    p = parts.withColumns({"next_part": F.lead("part").over(w), "next_start": F.lead("start").over(w)})
    return p.filter((F.col("end") >= F.col("next_start")) | (F.col("start") > F.col("end")))


def in_partitions(rows: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, session) with the partition that holds their session; a scheme without overlaps gives at most one.

    The last partition begun is carried to each row, one shuffle by key, and its end decides.
    """
    from .pit import as_of

    j = as_of(rows, parts.select(*keys, "start", "end", "part"), list(keys), "session", "start")
    return j.withColumn("part", F.when(F.col("hit.end") >= F.col("session"), F.col("hit.part"))).drop("hit")


def median_dollar_volume(bars: DataFrame, day: str, days: int = 20) -> DataFrame:
    """(inst, n, mdv): exact median of close times volume over 2 * days calendar days up to `day`."""
    d = F.lit(day).cast("date")
    w = bars.filter(F.col("session").between(F.date_sub(d, 2 * days), d))
    return w.groupBy("inst").agg(F.count("*").alias("n"), F.median(F.col("close") * F.col("volume")).alias("mdv"))


def tradable(bars: DataFrame, members: DataFrame, day: str, threshold: float, least: int, kinds: tuple = ("equity",), exchanges: tuple = ()) -> DataFrame:
    """Instruments of `members` (inst, type, exchange, active_from, active_to) listed on the day, of a kind and exchange asked for, and liquid."""
    d = F.lit(day).cast("date")
    m = members.filter((F.col("active_from") <= d) & (F.col("active_to").isNull() | (F.col("active_to") >= d)) & F.col("type").isin(*kinds))
    if exchanges:
        m = m.filter(F.upper("exchange").isin(*[e.upper() for e in exchanges]))
    liquid = median_dollar_volume(bars, day).filter((F.col("n") >= least) & (F.col("mdv") >= threshold))
    return m.join(liquid, "inst").select("inst", "n", "mdv")


def average_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean volume of the last n bars at each bar, rounded to 4."""
    w = Window.partitionBy("inst").orderBy("session").rowsBetween(1 - n, 0)
    return bars.select("inst", "session", F.bround(F.avg("volume").over(w), 4).alias("adv"))


def drop_later_duplicates(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in the order of a column."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("__r = 1").drop("__r")


def content_hash(rows: DataFrame) -> DataFrame:
    """One row: a hash of the rows whatever their order and the order of their columns.

    Row hashes are added up in 32-bit words, so that the sum is partial before one small row a task is shuffled.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    word = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(word(i)).alias(f"s{i}") for i in range(8)])
    return sums.select("n", F.sha2(F.concat_ws("-", "n", *[f"s{i}" for i in range(8)]), 256).alias("hash"))
