"""The rule-based exchange calendar, as column functions. Data sets bring their own sessions; this is the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Holidays by date (month, day, first year), moved to Monday from a Sunday and to Friday from a Saturday, and
#: holidays by week (month, weekday from Monday 0, first and last possible day). Good Friday is not among the rules.
BY_DATE = ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (12, 25, 0))
BY_WEEK = ((1, 0, 15, 21), (2, 0, 15, 21), (5, 0, 25, 31), (9, 0, 1, 7), (11, 3, 22, 28))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def is_holiday(day: Column) -> Column:
    def on(d: Column) -> Column:
        out = F.lit(False)
        for month, dom, since in BY_DATE:
            out = out | ((F.month(d) == month) & (F.dayofmonth(d) == dom) & (F.year(day) >= since))
        return out

    out = on(day) | ((F.weekday(day) == 0) & on(F.date_sub(day, 1))) | ((F.weekday(day) == 4) & on(F.date_add(day, 1)))
    for month, weekday, first, last in BY_WEEK:
        out = out | ((F.month(day) == month) & (F.weekday(day) == weekday) & F.dayofmonth(day).between(first, last))
    return out


def is_session(day: Column) -> Column:
    return ~is_weekend(day) & ~is_holiday(day)


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(session) of a date range, both ends in."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    return days.filter(is_session(F.col("session")))


def next_session(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (day) with the first session after each; null beyond the calendar."""
    c = calendar.select(F.col("session").alias("t"), F.lit(1).alias("k"), F.col("session").alias("s"))
    d = days.select(F.col("day").alias("t"), F.lit(0).alias("k"), F.lit(None).cast("date").alias("s"))
    w = Window.orderBy("t", F.desc("k")).rowsBetween(1, Window.unboundedFollowing)  # one row a day, so that one task can hold it
    return c.unionByName(d).withColumn("next", F.first("s", ignorenulls=True).over(w)).filter("k = 0").select(F.col("t").alias("day"), "next")


def session_times(sessions: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """sessions with opens, closes and decides in UTC: 09:30, 16:00 and 16:05 of the exchange's clock."""
    at = lambda hm: F.to_utc_timestamp(F.concat(F.col("session").cast("string"), F.lit(f" {hm}:00")), zone)
    return sessions.withColumns({"opens": at("09:30"), "closes": at("16:00"), "decides": at("16:05")})


#: Order of events of one moment.
PRIORITY = {"corporate_action": 10, "open": 20, "bar": 30, "close": 40, "decision": 50}


def timeline(sessions: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(session, event, ts, priority, seq): opens and closes of all sessions, decisions of some, in order of time and priority."""
    t = session_times(sessions)
    pick = lambda e, c, d: d.select("session", F.lit(e).alias("event"), F.col(c).alias("ts"), F.lit(PRIORITY[e]).alias("priority"))
    ev = pick("open", "opens", t).unionByName(pick("close", "closes", t)).unionByName(pick("decision", "decides", t.join(rebalances.select("session"), "session", "left_semi")))
    return ev.withColumn("seq", F.row_number().over(Window.orderBy("ts", "priority")))
