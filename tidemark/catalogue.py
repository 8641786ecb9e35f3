"""All registered queries of the research engine, over the star-schema tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import calendar
from .functions import cross_section as xs
from .operators import backtest, evaluation, factors, learning, ledger, performance, pit, portfolio, prefix, universe, validation
from .operators import trees as trees_of
from .plans import registry, sql_facade, sql_functions
from .sources import connector, market, store
from .streaming import fills as stream

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to 6 places, and never a negative zero."""
    return df.select(*[(F.round(F.col(n), places) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# ---- shared tables ----------------------------------------------------------------------------------------------------------

K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: Names grow with the tables: see market.bars.
NAME = "CASE WHEN p_partkey <= 2000 THEN p_brand ELSE p_brand || '.' || ((p_partkey - 1) // 2000) END"
HELD = "'Brand#' || (o_custkey % 25 + 1) || CASE WHEN o_custkey <= 1500 THEN '' ELSE '.' || ((o_custkey - 1) // 1500) END"
BARS_ALL = f"""bars_all AS (
  SELECT {NAME} AS inst, cast(l_shipdate AS DATE) AS session, first(px ORDER BY {K}) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY {K}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""
BARS = BARS_ALL + ", bars AS MATERIALIZED (SELECT * FROM bars_all WHERE isodow(session) <= 5)"
CAL = BARS + ", cal AS MATERIALIZED (SELECT session, row_number() OVER (ORDER BY session) AS idx FROM (SELECT DISTINCT session FROM bars))"
ENDS = CAL + ", ends AS MATERIALIZED (SELECT max(session) AS session FROM cal GROUP BY date_trunc('month', session)), spine AS MATERIALIZED (SELECT session, inst FROM ends, (SELECT DISTINCT inst FROM bars))"
SECTORS = f"sectors AS (SELECT {NAME} AS inst, first(p_type ORDER BY p_partkey) AS sector FROM part GROUP BY 1)"
ACTIONS = f"""actions AS (
  SELECT {HELD} AS inst, CASE WHEN o_orderkey % 997 = 0 THEN 'split' ELSE 'dividend' END AS kind, cast(o_orderdate AS DATE) AS effective,
         cast(o_orderdate AS DATE) + cast(o_orderkey % 5 AS INTEGER) AS available, CASE WHEN o_orderkey % 997 = 0 THEN 2.0::DOUBLE END AS ratio,
         CASE WHEN o_orderkey % 997 <> 0 THEN 0.5::DOUBLE END AS cash, o_orderkey AS id
  FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 211 = 0)"""
FILINGS = f"""filings AS MATERIALIZED (
  SELECT {HELD} AS inst, CASE o_orderpriority WHEN '1-URGENT' THEN 'net_income' WHEN '2-HIGH' THEN 'stockholders_equity' WHEN '3-MEDIUM' THEN 'total_assets'
         WHEN '4-NOT SPECIFIED' THEN 'revenue' ELSE 'operating_income' END AS metric, cast(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         cast(o_orderdate AS DATE) + 45 AS available, o_totalprice AS value, o_orderkey AS id FROM orders)"""
AS_OF = "DATE '2001-01-01'"


def _bars(s, d):
    return market.bars(s, d)


def _kept_bars(s, d):
    """For queries that read the bars several times."""
    return store.kept(market.bars(s, d), "bars")


def _at(b: DataFrame) -> DataFrame:
    return pit.spine(b, pit.month_ends(b))


def _section(s, d, b=None) -> DataFrame:
    """A cross-section with ties: volume at month ends."""
    b = _bars(s, d) if b is None else b
    return b.join(pit.month_ends(b), "session").select("session", "inst", F.col("volume").alias("value"))


SECTION = ENDS + ", sec AS MATERIALIZED (SELECT session, inst, volume AS value FROM bars JOIN ends USING (session))"

# ---- scans, calendars, quality -----------------------------------------------------------------------------------------------


@_query(f"WITH {BARS} SELECT * FROM bars")
def bars_daily(s, d):
    return _bars(s, d)


@_query(f"WITH {BARS} SELECT DISTINCT session FROM bars")
def sessions_distinct(s, d):
    return _bars(s, d).select("session").distinct()


@_query(f"WITH {ENDS} SELECT session FROM ends")
def month_end_sessions(s, d):
    return pit.month_ends(_bars(s, d))


@_query(f"""WITH {BARS_ALL}, n AS (SELECT count(*) AS bars, count(*) FILTER (least(open, high, low, close) <= 0 OR volume < 0) AS positivity, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS ohlc,
  count(*) FILTER (session > {AS_OF}) AS lookahead, count(*) FILTER (isodow(session) > 5) AS weekend, 0::BIGINT AS chronology FROM bars_all), c AS (SELECT *, list_sum([cast(x = 0 AS INTEGER) FOR x IN [positivity, ohlc, lookahead, weekend, chronology]]) AS clean FROM n)
  SELECT bars, positivity, ohlc, lookahead, weekend, chronology, CASE WHEN bars = 0 THEN 'WARN' WHEN clean < 5 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN bars = 0 THEN 0.5 ELSE round(clean / 5.0, 2) END::DOUBLE AS confidence FROM c""")
def bars_quality_audit(s, d):
    return universe.quality_audit(market.bars(s, d, weekdays=False), "2001-01-01")


@_query("""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, coalesce(o, c) AS open, greatest(coalesce(o, c), c) AS high, least(coalesce(o, c), c) AS low, c AS close, coalesce(v, 100000) AS volume
  FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS o, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_tax END AS c,
        CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem) WHERE c IS NOT NULL""")
def price_imputation(s, d):
    n = F.col("l_linenumber")
    li = market.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.when(n % 3 != 0, F.col("l_discount")).alias("open"), F.when(n % 5 != 0, F.col("l_tax")).alias("close"), F.when(n % 2 != 0, F.col("l_quantity")).alias("volume"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"))
    return market.impute_prices(li)


@_query(f"WITH {FILINGS} SELECT inst, metric, period_end, available, value, id FROM filings QUALIFY row_number() OVER (PARTITION BY inst, metric, period_end ORDER BY id) = 1")
def dedupe_natural_key(s, d):
    return universe.drop_later_duplicates(market.order_filings(s, d), ["inst", "metric", "period_end"], "id")


@_query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 2 = 0 AND o.o_custkey = orders.o_custkey AND o.o_orderpriority = orders.o_orderpriority) GROUP BY 1, 2""")
def insert_ignore(s, d):
    o = market.table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    new = o.filter("o_orderkey % 2 = 1").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))
    return market.insert_ignore(o.filter("o_orderkey % 2 = 0"), new, ["o_custkey", "o_orderpriority"])


MEMBERS = f"members AS (SELECT {NAME} AS inst, CASE WHEN min(p_size) % 2 = 0 THEN 'etf' ELSE 'equity' END AS type, min(p_type) AS exchange, DATE '1995-01-01' + cast(min(p_size) * 10 AS INTEGER) AS active_from, CASE WHEN min(p_partkey) % 3 = 0 THEN DATE '2000-06-30' END AS active_to FROM part GROUP BY 1)"
MDV = BARS + f", mdv AS (SELECT inst, count(*) AS n, median(close * volume) AS mdv FROM bars WHERE session BETWEEN {AS_OF} - 40 AND {AS_OF} GROUP BY 1)"


def _members(s, d):
    g = market.table(s, d, "part").groupBy(market.issue(F.col("p_brand"), "p_partkey", market.PARTS).alias("inst")).agg(F.min("p_size").alias("z"), F.min("p_type").alias("exchange"), F.min("p_partkey").alias("k"))
    return g.select("inst", F.when(F.col("z") % 2 == 0, "etf").otherwise("equity").alias("type"), "exchange", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("z") * 10).cast("int")).alias("active_from"), F.when(F.col("k") % 3 == 0, F.lit("2000-06-30").cast("date")).alias("active_to"))


@_query(f"WITH {MDV}, {MEMBERS} SELECT inst, n, round(mdv, 6) AS mdv FROM members JOIN mdv USING (inst) WHERE active_from <= {AS_OF} AND (active_to IS NULL OR active_to >= {AS_OF}) AND type IN ('equity', 'etf') AND n >= 3 AND mdv >= 10000")
def tradable_universe(s, d):
    return _rounded(universe.tradable(_bars(s, d), _members(s, d), "2001-01-01", 10000.0, 3, ("equity", "etf")))


@_query(f"WITH {MDV} SELECT inst, n, round(mdv, 6) AS mdv FROM mdv")
def liquidity_median_dv(s, d):
    return _rounded(universe.median_dollar_volume(_bars(s, d), "2001-01-01"))


@_query(f"WITH {BARS} SELECT inst, session, round_even(avg(volume) OVER (PARTITION BY inst ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS adv FROM bars")
def adv20(s, d):
    return universe.average_volume(_bars(s, d))


# ---- as-of, vintages, intervals ------------------------------------------------------------------------------------------------


@_query(f"""WITH {ENDS}, {FILINGS}, j AS (
  SELECT s.session, s.inst, m.metric, f.period_end, f.available, f.id, f.value, row_number() OVER (PARTITION BY s.session, s.inst, m.metric ORDER BY f.period_end DESC NULLS LAST, f.available DESC, f.id DESC) AS r
  FROM spine s CROSS JOIN (SELECT unnest(['net_income', 'revenue']) AS metric) m LEFT JOIN filings f ON f.inst = s.inst AND f.metric = m.metric AND f.available <= s.session)
  SELECT session, inst, metric, period_end, available, id, value FROM j WHERE r = 1""")
def asof_filing(s, d):
    ask = _at(_bars(s, d)).withColumn("metric", F.explode(F.array(F.lit("net_income"), F.lit("revenue")))).withColumn("as_of", F.col("session"))
    return pit.latest_vintage(market.order_filings(s, d), ask, ["inst", "metric"]).drop("as_of")


MACRO = "v AS (SELECT event_type AS series, cast(ts AS DATE) AS period, ts AS release, value, event_id AS id FROM events)"


@_query(f"""WITH {MACRO}, ask AS (SELECT series, cast(day AS TIMESTAMP) AS as_of FROM (SELECT DISTINCT event_type AS series FROM events), (SELECT DISTINCT cast(ts AS DATE) AS day FROM events)), j AS (
  SELECT a.series, a.as_of, v.period, v.release, v.id, v.value, row_number() OVER (PARTITION BY a.series, a.as_of ORDER BY v.period DESC NULLS LAST, v.release DESC, v.id DESC) AS r
  FROM ask a LEFT JOIN v ON v.series = a.series AND v.release <= a.as_of)
  SELECT series, cast(as_of AS DATE) AS day, period, id, value FROM j WHERE r = 1""")
def asof_macro(s, d):
    v = market.event_vintages(s, d)
    ask = v.select("series").distinct().crossJoin(v.select(F.col("period").cast("timestamp_ntz").alias("as_of")).distinct())
    return pit.latest_vintage(v, ask, ["series"], "release", ("period", "release", "id"), slices=8).select("series", F.to_date("as_of").alias("day"), "period", "id", "value")


@_query(f"WITH {FILINGS} SELECT inst, metric, period_end, count(*) AS vintages, first(value ORDER BY available, id) AS first_value, last(value ORDER BY available, id) AS last_value FROM filings GROUP BY 1, 2, 3 HAVING count(*) > 1")
def restatement_history(s, d):
    return pit.restatements(market.order_filings(s, d), ["inst", "metric", "period_end"])


HISTORY = "hist AS (SELECT c_custkey AS inst, 'SYM' || (c_custkey % 50) AS symbol, c_mktsegment AS exchange, DATE '1995-01-01' + cast(c_custkey * 7 % 2000 AS INTEGER) AS valid_from, CASE WHEN c_custkey % 5 <> 0 THEN DATE '1995-01-01' + cast(c_custkey * 7 % 2000 AS INTEGER) + cast(c_custkey % 400 + 90 AS INTEGER) END AS valid_to FROM customer)"


@_query(f"""WITH {HISTORY}, ask AS (SELECT DISTINCT 'SYM' || (o_custkey % 50) AS symbol, ['BUILDING', 'MACHINERY', 'HOUSEHOLD'][o_custkey % 3 + 1] AS exchange, cast(o_orderdate AS DATE) AS day FROM orders)
  SELECT symbol, exchange, day, matches, CASE WHEN matches = 1 THEN inst END AS inst FROM (
    SELECT a.symbol, a.exchange, a.day, count(h.inst) AS matches, min(h.inst) AS inst FROM ask a LEFT JOIN hist h ON h.symbol = a.symbol AND h.exchange = a.exchange AND h.valid_from <= a.day AND (h.valid_to IS NULL OR a.day <= h.valid_to) GROUP BY 1, 2, 3)""")
def symbol_interval_join(s, d):
    o = market.table(s, d, "orders")
    ask = o.select(F.concat(F.lit("SYM"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("HOUSEHOLD")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("exchange"), F.to_date("o_orderdate").alias("day")).distinct()
    return pit.interval_resolve(ask, market.symbol_history(s, d), slices=4)


@_query(f"WITH {HISTORY} SELECT * FROM (SELECT *, lead(valid_from) OVER (PARTITION BY symbol, exchange ORDER BY valid_from, inst) AS next_from FROM hist) WHERE next_from IS NOT NULL AND (valid_to IS NULL OR valid_to >= next_from)")
def interval_overlap(s, d):
    return pit.interval_overlaps(market.symbol_history(s, d))


ADJ = BARS + f""", {ACTIONS}, act AS (SELECT a.* FROM actions a JOIN (SELECT inst, min(session) AS f FROM bars GROUP BY 1) b ON a.inst = b.inst WHERE effective > f AND effective <= {AS_OF} AND available <= {AS_OF}),
 u AS (SELECT inst, session AS day, 1 AS bar, close, NULL AS kind, NULL AS ratio, NULL AS cash FROM bars UNION ALL SELECT inst, effective, 0, NULL, kind, ratio, cash FROM act),
 w AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY inst ORDER BY day, bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM u),
 p AS (SELECT *, CASE WHEN kind = 'split' THEN 1.0::DOUBLE / ratio WHEN kind = 'dividend' AND prior > cash THEN (prior - cash) / prior ELSE 1.0::DOUBLE END AS pf, CASE WHEN kind = 'split' THEN ratio ELSE 1.0::DOUBLE END AS vf FROM w),
 fac AS MATERIALIZED (SELECT inst, day AS session, bar, coalesce(product(pf) OVER x, 1.0) AS price_factor, coalesce(product(vf) OVER x, 1.0) AS volume_factor FROM p
   WINDOW x AS (PARTITION BY inst ORDER BY day DESC, bar DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 adj AS (SELECT b.*, price_factor, volume_factor FROM bars b JOIN fac f ON b.inst = f.inst AND b.session = f.session AND f.bar = 1)"""


def _adjusted(s, d):
    return pit.adjustment_factors(_bars(s, d), market.order_actions(s, d), "2001-01-01")


@_query(f"WITH {ADJ} SELECT inst, session, round(price_factor, 6) AS price_factor, round(volume_factor, 6) AS volume_factor FROM adj")
def adj_factors(s, d):
    return _rounded(_adjusted(s, d).select("inst", "session", "price_factor", "volume_factor"))


@_query(f"""WITH {ADJ}, a AS (SELECT inst, session, greatest(round_even(open * price_factor, 6), 1e-6) AS o, greatest(round_even(high * price_factor, 6), 1e-6) AS h, greatest(round_even(low * price_factor, 6), 1e-6) AS l, greatest(round_even(close * price_factor, 6), 1e-6) AS c, greatest(volume * volume_factor, 1e-4) AS volume FROM adj)
  SELECT inst, session, round(o + 1e-8, 4) AS open, round(greatest(h, o, c) + 1e-8, 4) AS high, round(least(l, o, c) + 1e-8, 4) AS low, round(c + 1e-8, 4) AS close, round(volume, 4) AS volume FROM a""")
def adjusted_bars(s, d):
    a = pit.apply_adjustments(_adjusted(s, d))  # the nudge settles ties at the fourth place alike on both sides
    return _rounded(a.select("inst", "session", *[(F.col(c) + 1e-8).alias(c) for c in ("open", "high", "low", "close")], "volume"), 4)


@_query(f"WITH {ACTIONS} SELECT inst, effective, id, coalesce(product(ratio) OVER (PARTITION BY inst ORDER BY effective DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS factor FROM actions WHERE kind = 'split'")
def split_unadjust(s, d):
    return pit.split_unadjust(market.order_actions(s, d)).select("inst", "effective", "id", "factor")


# ---- factors ------------------------------------------------------------------------------------------------------------------


def _lag_factor(near: int, far: int, days: int) -> str:
    return f""", h AS MATERIALIZED (SELECT inst, session, lag(close, {near - 1}) OVER w AS cn, lag(close, {far - 1}) OVER w AS cf, lag(session, {far - 1}) OVER w AS df FROM bars WINDOW w AS (PARTITION BY inst ORDER BY session)),
 hit AS (SELECT s.session, s.inst, h.cn, h.cf, h.df FROM spine s ASOF LEFT JOIN h ON s.inst = h.inst AND s.session > h.session),
 scores AS MATERIALIZED (SELECT session, inst, CASE WHEN df >= session - {days} AND cf > 0 THEN cn / cf - 1 END AS value,
   CASE WHEN df IS NULL OR df < session - {days} THEN 'insufficient_history' WHEN cf <= 0 THEN 'invalid_denominator' END AS reason FROM hit)"""


MOM12 = ENDS + _lag_factor(21, 252, 450)
#: Brands trade on some days only, so that 252 bars take more calendar days than a full calendar's 450; research here allows for that.
WIDE = 900
MOM12W = ENDS + _lag_factor(21, 252, WIDE)
SCORES_OUT = " SELECT session, inst, round(value, 6) + 0.0 AS value, reason FROM scores"


@_query(f"WITH {MOM12} {SCORES_OUT}")
def mom_12_1(s, d):
    b = _bars(s, d)
    return _rounded(registry.get("momentum_12_1").make(b, _at(b)))


@_query(f"WITH {MOM12W} {SCORES_OUT}")
def mom_12_1_wide(s, d):
    b = _bars(s, d)
    return _rounded(factors.momentum(b, _at(b), days=WIDE))


@_query(f"WITH {ENDS} {_lag_factor(21, 126, 250)} {SCORES_OUT}")
def mom_6_1(s, d):
    b = _bars(s, d)
    return _rounded(registry.get("momentum_6_1").make(b, _at(b)))


VOL = ENDS + """, r AS (SELECT inst, session, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lag(session, 60) OVER w AS df FROM bars WINDOW w AS (PARTITION BY inst ORDER BY session)),
 h AS MATERIALIZED (SELECT inst, session, df, CASE WHEN count(ret) OVER f = 60 THEN stddev_samp(ret) OVER f * sqrt(252.0) END AS sd FROM r WINDOW f AS (PARTITION BY inst ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 hit AS (SELECT s.session, s.inst, h.sd, h.df FROM spine s ASOF LEFT JOIN h ON s.inst = h.inst AND s.session > h.session),
 scores AS (SELECT session, inst, CASE WHEN df >= session - 120 THEN sd END AS value, CASE WHEN df IS NULL OR df < session - 120 OR sd IS NULL THEN 'insufficient_history' END AS reason FROM hit)"""


@_query(f"WITH {VOL.replace('120', '365')} {SCORES_OUT}")
def vol_60d_wide(s, d):
    b = _bars(s, d)
    return _rounded(factors.volatility(b, _at(b), days=365))


@_query(f"WITH {VOL} {SCORES_OUT}")
def vol_60d(s, d):
    b = _bars(s, d)
    return _rounded(registry.get("volatility_60d").make(b, _at(b)))


def _tail_sql(n: int, days: int) -> str:
    return f""", num AS MATERIALIZED (SELECT inst, session, close, row_number() OVER w AS rn, lag(close) OVER w AS prev, lag(session, {n - 1}) OVER w AS df FROM bars WINDOW w AS (PARTITION BY inst ORDER BY session)),
 hit AS MATERIALIZED (SELECT s.session, s.inst, h.rn, h.df FROM spine s ASOF LEFT JOIN num h ON s.inst = h.inst AND s.session > h.session),
 tail AS MATERIALIZED (SELECT k.session, k.inst, k.pos, b.close, b.prev FROM (SELECT session, inst, rn - p AS rn, p AS pos FROM hit, range({n}) AS g(p) WHERE df >= session - {days}) k JOIN num b ON b.inst = k.inst AND b.rn = k.rn)"""


def _mdd_sql(days):
    return f"""WITH {ENDS} {_tail_sql(252, days)}, m AS (SELECT session, inst, max(1 - close / peak) AS value FROM (SELECT *, max(close) OVER (PARTITION BY session, inst ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM tail) GROUP BY 1, 2),
  scores AS (SELECT s.session, s.inst, value, CASE WHEN value IS NULL THEN 'insufficient_history' END AS reason FROM spine s LEFT JOIN m ON s.session = m.session AND s.inst = m.inst) {SCORES_OUT}"""


@_query(_mdd_sql(WIDE))
def mdd_252d_wide(s, d):
    b = _bars(s, d)
    return _rounded(factors.max_drawdown(b, _at(b), days=WIDE))


@_query(_mdd_sql(450))
def mdd_252d(s, d):
    b = _bars(s, d)
    return _rounded(registry.get("max_drawdown_252d").make(b, _at(b)))


def _beta_sql(days):
    return f"""WITH {ENDS} {_tail_sql(253, days)}, r AS (SELECT session, inst, pos, close / prev - 1 AS ret FROM tail WHERE pos < 252 AND prev > 0), k AS (SELECT *, avg(ret) OVER (PARTITION BY session, pos) AS mkt FROM r),
  m AS (SELECT session, inst, CASE WHEN var_samp(mkt) <= 1e-12 THEN 1.0 ELSE covar_samp(ret, mkt) / var_samp(mkt) END AS value FROM k GROUP BY 1, 2),
  scores AS (SELECT s.session, s.inst, value, CASE WHEN value IS NULL THEN 'insufficient_history' END AS reason FROM spine s LEFT JOIN m ON s.session = m.session AND s.inst = m.inst) {SCORES_OUT}"""


@_query(_beta_sql(WIDE))
def beta_252d_wide(s, d):
    b = _bars(s, d)
    return _rounded(factors.beta(b, _at(b), days=WIDE))


@_query(_beta_sql(450))
def beta_252d(s, d):
    b = _bars(s, d)
    return _rounded(registry.get("beta").make(b, _at(b)))


ITEMS = ["net_income", "stockholders_equity", "total_assets", "revenue", "operating_income"]
FACTS = ENDS + f""", {FILINGS}, ask AS (SELECT session, inst, unnest({ITEMS}) AS metric FROM spine),
 cur AS MATERIALIZED (SELECT * FROM (SELECT a.session, a.inst, a.metric, f.period_end, f.value, row_number() OVER (PARTITION BY a.session, a.inst, a.metric ORDER BY f.period_end DESC NULLS LAST, f.available DESC, f.id DESC) AS r
   FROM ask a LEFT JOIN filings f ON f.inst = a.inst AND f.metric = a.metric AND f.available <= a.session) WHERE r = 1),
 old AS (SELECT * FROM (SELECT c.session, c.inst, c.metric, c.value, f.value AS prior, row_number() OVER (PARTITION BY c.session, c.inst, c.metric ORDER BY f.available DESC NULLS LAST, f.id DESC) AS r
   FROM cur c LEFT JOIN filings f ON f.inst = c.inst AND f.metric = c.metric AND f.available <= c.session AND f.period_end = cast(c.period_end - INTERVAL 12 MONTH AS DATE)) WHERE r = 1),
 facts AS MATERIALIZED (SELECT session, inst, {', '.join(f"max(value) FILTER (metric = '{m}') AS {m}, max(prior) FILTER (metric = '{m}') AS prior_{m}" for m in ITEMS)} FROM old GROUP BY 1, 2)"""


def _facts(s, d):
    b = _bars(s, d)
    return factors.facts_at(market.order_filings(s, d), _at(b), ITEMS)


def _growth_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN prior_{x} IS NULL THEN 0.05 WHEN abs(prior_{x}) < 1e-6 THEN NULL ELSE ({x} - prior_{x}) / abs(prior_{x}) END"


_QUALITY_SQL = {
    "roe": "net_income / coalesce(stockholders_equity, 1.0)", "roa": "net_income / coalesce(total_assets, 1.0)", "gross_profitability": "coalesce(revenue, net_income) / coalesce(total_assets, 1.0)",
    "accrual_quality": "(coalesce(operating_income, net_income) * 1.1 - net_income) / coalesce(total_assets, 1.0)", "revenue_growth": _growth_sql("revenue"), "opinc_growth": _growth_sql("operating_income"),
}
for _name, _expr in _QUALITY_SQL.items():

    def _make(s, d, name=_name):
        return _rounded(factors.quality_and_growth(_facts(s, d)).select("session", "inst", F.col(name).alias("value")))

    _query(f"WITH {FACTS} SELECT session, inst, round({_expr}, 6) + 0.0 AS value FROM facts", _name)(_make)

_VALUE_SQL = {"earnings_yield": "net_income", "book_to_market": "coalesce(stockholders_equity, net_income)", "fcf_yield": "coalesce(operating_income, net_income)"}
for _name, _expr in _VALUE_SQL.items():

    def _make(s, d, name=_name):
        return _rounded(factors.value_family(_facts(s, d), _bars(s, d)).select("session", "inst", F.col(name).alias("value")))

    _query(f"WITH {FACTS} SELECT f.session, f.inst, round({_expr} / CASE WHEN b.session >= f.session - 30 AND b.close > 0 THEN b.close END, 6) + 0.0 AS value FROM facts f ASOF LEFT JOIN bars b ON f.inst = b.inst AND f.session > b.session", _name)(_make)

# ---- cross-sections -------------------------------------------------------------------------------------------------------------

SEC_OUT = "SELECT session, inst, round(v, 6) + 0.0 AS v FROM"
WINSOR_SQL = "sw AS (SELECT *, list_sort(list(value) OVER (PARTITION BY session)) AS srt, count(*) OVER (PARTITION BY session) AS n FROM sec), wz AS (SELECT session, inst, CASE WHEN n < 3 THEN value ELSE greatest(least(value, srt[cast(ceil(0.99 * (n - 1)) AS INTEGER) + 1]), srt[cast(floor(0.01 * (n - 1)) AS INTEGER) + 1]) END AS value FROM sw)"
RANK_SQL = "(rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0)"
Z_SQL = "CASE WHEN stddev_pop({x}) OVER p < 1e-12 THEN 0.0 ELSE ({x} - avg({x}) OVER p) / stddev_pop({x}) OVER p END"


@_query(f"WITH {SECTION}, {WINSOR_SQL} SELECT session, inst, value AS v FROM wz")
def xs_winsor(s, d):
    return xs.winsorised(_section(s, d), "value", ["session"]).select("session", "inst", F.col("value").alias("v"))


def _rank_sql(keys: str, x: str, source: str) -> str:
    return f"{SEC_OUT} (SELECT session, inst, CASE WHEN count(*) OVER (PARTITION BY {keys}) = 1 THEN 0.5 ELSE ({RANK_SQL.format(k=keys, x=x)} - 1) / (count(*) OVER (PARTITION BY {keys}) - 1) END AS v FROM {source})"


@_query(f"WITH {SECTION} {_rank_sql('session', 'value', 'sec')}")
def xs_rank(s, d):
    return _rounded(_section(s, d).select("session", "inst", xs.unit_rank(F.col("value"), ["session"]).alias("v")))


@_query(f"WITH {SECTION} {SEC_OUT} (SELECT session, inst, {Z_SQL.format(x='value')} AS v FROM sec WINDOW p AS (PARTITION BY session))")
def xs_zscore(s, d):
    return _rounded(_section(s, d).select("session", "inst", xs.zscore(F.col("value"), xs.section("session")).alias("v")))


@_query(f"""WITH {SECTION}, m AS (SELECT *, median(value) OVER (PARTITION BY session) AS md FROM sec), q AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY session) AS mad FROM m)
  {SEC_OUT} (SELECT session, inst, CASE WHEN 1.4826 * mad < 1e-12 THEN {Z_SQL.format(x='value')} ELSE (value - md) / (1.4826 * mad) END AS v FROM q WINDOW p AS (PARTITION BY session))""")
def xs_robust_z(s, d):
    w = xs.section("session")
    m = _section(s, d).withColumn("md", F.median("value").over(w)).withColumn("mad", F.median(F.abs(F.col("value") - F.col("md"))).over(w))
    return _rounded(m.select("session", "inst", xs.robust_zscore(F.col("value"), w, F.col("md"), F.col("mad")).alias("v")))


@_query(f"""WITH {SECTION}, m AS (SELECT *, median(value) OVER (PARTITION BY session) AS md FROM sec), q AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY session) AS mad FROM m)
  {SEC_OUT} (SELECT session, inst, CASE WHEN 1.4826 * mad < 1e-12 THEN {Z_SQL.format(x='value')} ELSE (value - md) / (1.4826 * mad) END AS v FROM q WINDOW p AS (PARTITION BY session))""")
def xs_robust_z_long(s, d):
    """The same for sections that no task need hold."""
    return _rounded(xs.robust_scores(_section(s, d), "value", ["session"]).select("session", "inst", F.col("value").alias("v")))


@_query("SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 4) AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) AS q1, round(quantile_cont(l_extendedprice, 0.95), 4) AS q2 FROM lineitem GROUP BY 1")
def price_quantiles(s, d):
    """Of a few sections that hold all lines."""
    li = market.table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return _rounded(prefix.exact_quantiles(li, ["flag"], "l_extendedprice", (0.05, 0.5, 0.95), most=1000), 4)


@_query(f"WITH {SECTION} SELECT session, inst, cast(least(5, floor((row_number() OVER (PARTITION BY session ORDER BY value, inst) - 1) * 5 / count(*) OVER (PARTITION BY session)) + 1) AS INTEGER) AS v FROM sec")
def xs_quantile(s, d):
    return _section(s, d).select("session", "inst", xs.bucket(F.col("value"), ["session"], "inst").alias("v"))


@_query(f"WITH {SECTION}, {SECTORS}, ss AS (SELECT sec.*, sector FROM sec JOIN sectors USING (inst)) {_rank_sql('session, sector', 'value', 'ss')}")
def sector_rank(s, d):
    j = _section(s, d).join(market.sectors(s, d), "inst")
    return _rounded(j.select("session", "inst", xs.unit_rank(F.col("value"), ["session", "sector"]).alias("v")))


@_query(f"WITH {SECTION}, {SECTORS} {SEC_OUT} (SELECT session, inst, value - avg(value) OVER (PARTITION BY session, sector) AS v FROM sec JOIN sectors USING (inst))")
def sector_residual(s, d):
    j = _section(s, d).join(market.sectors(s, d), "inst")
    return _rounded(j.select("session", "inst", (F.col("value") - F.avg("value").over(xs.section("session", "sector"))).alias("v")))


@_query(f"WITH {SECTION}, {WINSOR_SQL} {SEC_OUT} (SELECT session, inst, -({Z_SQL.format(x='value')}) AS v FROM wz WINDOW p AS (PARTITION BY session))")
def transform_pipeline(s, d):
    return _rounded(evaluation.transform(_section(s, d), direction=-1).select("session", "inst", F.col("value").alias("v")))


@_query(f"""WITH {SECTION}, parts AS (SELECT session, inst, 'a' AS factor, volume AS value FROM bars JOIN ends USING (session) UNION ALL SELECT session, inst, 'b', close FROM bars JOIN ends USING (session) UNION ALL
   SELECT session, inst, 'c', CASE WHEN volume > 60 THEN NULL ELSE high - low END FROM bars JOIN ends USING (session)),
  s1 AS (SELECT *, list_sort(list(value) FILTER (value IS NOT NULL) OVER q) AS srt, count(value) OVER q AS n FROM parts WINDOW q AS (PARTITION BY session, factor)),
  s2 AS (SELECT session, inst, factor, CASE WHEN value IS NULL OR n < 3 THEN value ELSE greatest(least(value, srt[cast(ceil(0.99 * (n - 1)) AS INTEGER) + 1]), srt[cast(floor(0.01 * (n - 1)) AS INTEGER) + 1]) END AS value FROM s1),
  s3 AS (SELECT session, inst, factor, CASE WHEN value IS NULL THEN NULL ELSE {Z_SQL.format(x='value')} END AS z FROM s2 WINDOW p AS (PARTITION BY session, factor)),
  s4 AS (SELECT session, inst, sum(z * w) AS sz, sum(CASE WHEN z IS NOT NULL THEN w END) AS sw FROM s3 JOIN (VALUES ('a', 0.5::DOUBLE), ('b', 0.3::DOUBLE), ('c', 0.2::DOUBLE)) t(factor, w) USING (factor) GROUP BY 1, 2),
  s5 AS (SELECT session, inst, CASE WHEN sw >= 0.75 THEN sz / sw END AS value FROM s4),
  s6 AS (SELECT *, list_sort(list(value) FILTER (value IS NOT NULL) OVER q) AS srt, count(value) OVER q AS n FROM s5 WINDOW q AS (PARTITION BY session)),
  s7 AS (SELECT session, inst, CASE WHEN value IS NULL OR n < 3 THEN value ELSE greatest(least(value, srt[cast(ceil(0.99 * (n - 1)) AS INTEGER) + 1]), srt[cast(floor(0.01 * (n - 1)) AS INTEGER) + 1]) END AS value FROM s6)
  SELECT session, inst, round(v, 6) + 0.0 AS value FROM (SELECT session, inst, CASE WHEN value IS NULL THEN NULL ELSE {Z_SQL.format(x='value')} END AS v FROM s7 WINDOW p AS (PARTITION BY session))""")
def composite_score(s, d):
    b = _bars(s, d)
    b = b.join(pit.month_ends(b), "session")
    long = b.select("session", "inst", F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in "abc"]), F.array(F.col("volume"), F.col("close"), F.when(F.col("volume") <= 60, F.col("high") - F.col("low"))))).alias("factor", "value"))
    return _rounded(evaluation.composite(long, {"a": 0.5, "b": 0.3, "c": 0.2}, 0.75))


# ---- labels and evaluation ---------------------------------------------------------------------------------------------------------


def _fwd(horizons: str) -> str:
    return f", ob AS MATERIALIZED (SELECT inst, idx, open FROM bars JOIN cal USING (session)), en AS MATERIALIZED (SELECT inst, idx - 1 AS t, h AS horizon, idx + h AS x, open AS entry FROM ob, (SELECT unnest([{horizons}]) AS h) WHERE open > 0), fwd AS MATERIALIZED (SELECT c.session, e.horizon, e.inst, o.open / e.entry - 1 AS ret FROM en e JOIN ob o ON o.inst = e.inst AND o.idx = e.x JOIN cal c ON c.idx = e.t)"


def _returns(s, d, horizons=(21,)):
    b = _bars(s, d)
    return factors.forward_returns(b, pit.sessions(b), horizons)


FWD = CAL + _fwd("21")


@_query(f"WITH {FWD} SELECT session, cast(horizon AS INTEGER) AS horizon, inst, round(ret, 6) + 0.0 AS ret FROM fwd")
def fwd_returns(s, d):
    return _rounded(_returns(s, d))


@_query(f"WITH {FWD} SELECT session, inst, round(ret - avg(ret) OVER (PARTITION BY session), 6) + 0.0 AS label FROM fwd")
def label_excess(s, d):
    return _rounded(evaluation.excess_label(_returns(s, d)).select("session", "inst", "label"))


@_query(f"WITH {FWD}, n3 AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM fwd) SELECT session, inst, round(({RANK_SQL.format(k='session', x='ret')} - 1) / (n - 1) - 0.5, 6) + 0.0 AS label FROM n3 WHERE n >= 3")
def label_rank(s, d):
    return _rounded(evaluation.rank_label(_returns(s, d)).select("session", "inst", "label"))


CORR = "CASE WHEN count(*) < 3 THEN NULL WHEN var_pop({x}) * count(*) < 1e-12 OR var_pop({y}) * count(*) < 1e-12 THEN 0.0 ELSE covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"
PAIRS = f", pairs AS MATERIALIZED (SELECT s.session, f.horizon, s.inst, s.value, f.ret FROM scores s JOIN fwd f ON s.session = f.session AND s.inst = f.inst WHERE s.value IS NOT NULL), rk AS (SELECT *, {RANK_SQL.format(k='session, horizon', x='value')} AS rx, {RANK_SQL.format(k='session, horizon', x='ret')} AS ry FROM pairs), ics AS MATERIALIZED (SELECT * FROM (SELECT session, horizon, {CORR.format(x='value', y='ret')} AS ic, {CORR.format(x='rx', y='ry')} AS rank_ic, count(*) AS n FROM rk GROUP BY 1, 2) WHERE ic IS NOT NULL)"
IC = MOM12W + _fwd("21") + PAIRS


def _month_end_study(s, d, horizons=(21,)):
    """(bars, month ends, momentum, forward returns) at month ends. Bars are worked out once, as a written table; only returns of these sections are joined."""
    b = store.kept(_bars(s, d).select("session", "inst", "open", "close", "volume"), "bars")
    days = pit.sessions(b)
    at = pit.month_ends(days)
    return b, at, factors.momentum(b, pit.spine(b, at), days=WIDE), factors.forward_returns(b, days, horizons, at)


def _pairs(s, d, horizons=(21,)):
    _, _, m, r = _month_end_study(s, d, horizons)
    return evaluation.joined(m, r)


@_query(f"WITH {IC} SELECT session, round(ic, 6) + 0.0 AS ic, n FROM ics")
def ic_series(s, d):
    return _rounded(evaluation.ic_series(_pairs(s, d)).select("session", "ic", "n"))


@_query(f"WITH {IC} SELECT session, round(rank_ic, 6) + 0.0 AS rank_ic, n FROM ics")
def rank_ic_series(s, d):
    return _rounded(evaluation.ic_series(_pairs(s, d)).select("session", "rank_ic", "n"))


NW = """, dd AS (SELECT session, rank_ic, rank_ic - avg(rank_ic) OVER () AS d FROM ics), ll AS (SELECT *, lag(d, 1) OVER o * d AS l1, lag(d, 2) OVER o * d AS l2, lag(d, 3) OVER o * d AS l3 FROM dd WINDOW o AS (ORDER BY session)),
 gg AS (SELECT count(*) AS n, avg(rank_ic) AS mean, coalesce(stddev_samp(rank_ic), 0.0) AS sd, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, sum(d * d) / count(*) AS g0, coalesce(sum(l1), 0) / count(*) AS g1, coalesce(sum(l2), 0) / count(*) AS g2, coalesce(sum(l3), 0) / count(*) AS g3 FROM ll),
 vv AS (SELECT *, g0 + CASE WHEN n > 1 THEN 2 * (1 - 1.0 / (least(3, n - 1) + 1)) * g1 ELSE 0 END + CASE WHEN n > 2 THEN 2 * (1 - 2.0 / (least(3, n - 1) + 1)) * g2 ELSE 0 END + CASE WHEN n > 3 THEN 2 * (1 - 3.0 / (least(3, n - 1) + 1)) * g3 ELSE 0 END AS var FROM gg WHERE n > 0)"""


@_query(f"WITH {IC} {NW} SELECT n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(CASE WHEN sd > 0 THEN mean / sd ELSE 0 END, 6) + 0.0 AS ir, round(positive, 6) AS positive, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(n) ELSE 0 END, 6) + 0.0 AS t FROM vv")
def ic_summary(s, d):
    c = evaluation.ic_series(_pairs(s, d)).withColumn("factor", F.lit("momentum"))
    return _rounded(evaluation.summary(c, "rank_ic", ["factor"]).select("n", "mean", "sd", "ir", "positive", "t"))


@_query(f"WITH {IC} {NW} SELECT n, round(CASE WHEN n < 3 OR var <= 1e-18 THEN 0 ELSE mean / sqrt(var / n) END, 6) + 0.0 AS nw_t FROM vv")
def newey_west(s, d):
    c = evaluation.ic_series(_pairs(s, d)).withColumn("factor", F.lit("momentum"))
    return _rounded(evaluation.summary(c, "rank_ic", ["factor"]).select("n", "nw_t"))


@_query(f"WITH {MOM12W} {_fwd('21, 63, 126, 252')} {PAIRS} SELECT cast(horizon AS INTEGER) AS horizon, round(avg(rank_ic), 6) + 0.0 AS rank_ic, count(*) AS n FROM ics GROUP BY 1")
def ic_decay(s, d):
    return _rounded(evaluation.ic_series(_pairs(s, d, (21, 63, 126, 252))).groupBy("horizon").agg(F.avg("rank_ic").alias("rank_ic"), F.count("*").alias("n")))


@_query(f"WITH {IC} SELECT cast(year(session) AS INTEGER) AS year, round(avg(rank_ic), 6) + 0.0 AS rank_ic, count(*) AS n FROM ics GROUP BY 1")
def ic_by_year(s, d):
    return _rounded(evaluation.ic_series(_pairs(s, d)).groupBy(F.year("session").alias("year")).agg(F.avg("rank_ic").alias("rank_ic"), F.count("*").alias("n")))


QR = IC + """, bk AS (SELECT session, least(5, floor((row_number() OVER (PARTITION BY session ORDER BY value, inst) - 1) * 5 / count(*) OVER (PARTITION BY session)) + 1) AS bucket, ret FROM pairs),
 qr AS MATERIALIZED (SELECT e.session, cast(e.bucket AS INTEGER) AS bucket, coalesce(avg(bk.ret), 0.0) AS ret FROM (SELECT DISTINCT session, b.bucket FROM pairs, range(1, 6) AS b(bucket)) e LEFT JOIN bk ON bk.session = e.session AND bk.bucket = e.bucket GROUP BY 1, 2),
 qa AS MATERIALIZED (SELECT bucket, count(*) AS n, CASE WHEN product(1 + ret) <= 0 THEN -1 ELSE pow(product(1 + ret), 12.0 / count(*)) - 1 END AS annual FROM qr GROUP BY 1)"""


@_query(f"WITH {QR} SELECT bucket, n, round(annual, 6) + 0.0 AS annual FROM qa")
def quantile_returns(s, d):
    return _rounded(evaluation.quantile_summary(evaluation.quantile_returns(_pairs(s, d))))


@_query(f"WITH {QR}, o AS (SELECT cast(bucket AS DOUBLE) AS b, cast(row_number() OVER (ORDER BY annual, bucket) AS DOUBLE) AS p FROM qa) SELECT round({CORR.format(x='b', y='p')}, 6) + 0.0 AS monotonicity FROM o")
def monotonicity(s, d):
    return _rounded(evaluation.monotonicity(evaluation.quantile_summary(evaluation.quantile_returns(_pairs(s, d)))))


@_query(f"""WITH {QR}, ls AS (SELECT session, max(ret) FILTER (bucket = 5) - max(ret) FILTER (bucket = 1) AS r FROM qr GROUP BY 1), g AS (SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 0.0 WHEN product(1 + r) <= 0 THEN -1.0 ELSE pow(product(1 + r), 12.0 / count(*)) - 1 END AS annual, coalesce(stddev_samp(r), 0.0) * sqrt(12.0) AS vol FROM ls)
  SELECT n, round(annual, 6) + 0.0 AS annual, round(vol, 6) + 0.0 AS vol, round(CASE WHEN vol > 0 THEN annual / vol ELSE 0 END, 6) + 0.0 AS sharpe FROM g""")
def long_short(s, d):
    return _rounded(evaluation.long_short(evaluation.quantile_returns(_pairs(s, d))))


@_query(f"""WITH {MOM12W}, r AS MATERIALIZED (SELECT session, inst, {RANK_SQL.format(k='session', x='value')} AS r FROM scores WHERE value IS NOT NULL), o AS (SELECT session, row_number() OVER (ORDER BY session) AS pos FROM (SELECT DISTINCT session FROM r)), ro AS MATERIALIZED (SELECT r.*, pos, pos + 1 AS nxt FROM r JOIN o USING (session)),
  c AS (SELECT a.session, {CORR.format(x='a.r', y='b.r')} AS c FROM ro a JOIN ro b ON a.inst = b.inst AND a.pos = b.nxt GROUP BY 1)
  SELECT o.session, round(greatest(0.0, CASE WHEN c IS NULL THEN 1.0 ELSE 1 - c END), 6) AS turnover FROM o LEFT JOIN c USING (session) WHERE pos > 1""")
def turnover(s, d):
    b = _bars(s, d)
    return _rounded(evaluation.turnover(factors.momentum(b, _at(b), days=WIDE)))


@_query(f"WITH {MOM12W} {_fwd('21')} SELECT s.session, s.inst, round(value, 6) + 0.0 AS score, reason, round(ret, 6) + 0.0 AS ret FROM scores s LEFT JOIN fwd f ON s.session = f.session AND s.inst = f.inst")
def factor_research_momentum(s, d):
    _, _, m, r = _month_end_study(s, d)
    return _rounded(m.join(r.select("session", "inst", "ret"), ["session", "inst"], "left").select("session", "inst", F.col("value").alias("score"), "reason", "ret"))


# ---- portfolio ---------------------------------------------------------------------------------------------------------------------

TOPK = SECTION + ", pick AS MATERIALIZED (SELECT * FROM (SELECT session, inst, value, row_number() OVER (PARTITION BY session ORDER BY value DESC, inst) AS rank FROM sec) WHERE rank <= 10)"
EQW = TOPK + ", eq AS MATERIALIZED (SELECT *, round(round_even(0.99 / n, 6) + CASE WHEN rank = 1 THEN 0.99 - round_even(0.99 / n, 6) * n ELSE 0 END, 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM pick))"


def _chosen(s, d, b=None):
    return portfolio.top_k(_section(s, d, b), 10, 15)


@_query(f"WITH {TOPK} SELECT session, inst, value, cast(rank AS INTEGER) AS rank, 'top_k_entry' AS reason FROM pick")
def topk_select(s, d):
    return _chosen(s, d)


@_query(f"""WITH {SECTION}, held AS (SELECT session, inst FROM sec WHERE cast(split_part(substr(inst, 7), '.', 1) AS INTEGER) % 3 = 0), r AS (SELECT s.*, row_number() OVER (PARTITION BY s.session ORDER BY value DESC, s.inst) AS rank, h.inst IS NOT NULL AS h FROM sec s LEFT JOIN held h ON s.session = h.session AND s.inst = h.inst),
  o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY (h AND rank <= 12) DESC, rank) AS p FROM r)
  SELECT session, inst, value, cast(rank AS INTEGER) AS rank, CASE WHEN h AND rank <= 12 THEN 'buffer_hold' ELSE 'top_k_entry' END AS reason FROM o WHERE p <= 8""")
def topk_buffer(s, d):
    sec = _section(s, d)
    held = sec.filter(F.regexp_extract("inst", r"#(\d+)", 1).cast("int") % 3 == 0)
    return portfolio.top_k(sec, 8, 12, held)


@_query(f"WITH {EQW} SELECT session, inst, weight FROM eq")
def eq_weights(s, d):
    return portfolio.equal_weights(_chosen(s, d)).select("session", "inst", "weight")


@_query(f"""WITH {TOPK}, v AS (SELECT *, 1 / CASE WHEN value / 1000 > 1e-4 THEN value / 1000 ELSE 0.20 END AS i FROM pick), w AS (SELECT *, round_even(0.99 * i / sum(i) OVER (PARTITION BY session), 6) AS w FROM v)
  SELECT session, inst, round(w + CASE WHEN rank = 1 THEN 0.99 - sum(w) OVER (PARTITION BY session) ELSE 0 END, 6) AS weight FROM w""")
def invvol_weights(s, d):
    c = _chosen(s, d)
    return portfolio.inverse_volatility_weights(c, c.select("session", "inst", (F.col("value") / 1000).alias("value"))).select("session", "inst", "weight")


@_query(f"WITH {EQW} SELECT session, inst, least(weight, 0.08) AS weight FROM eq")
def cap_name(s, d):
    return portfolio.cap_name(portfolio.equal_weights(_chosen(s, d)), 0.08).select("session", "inst", "weight")


CAPS = EQW + f", {SECTORS}, cn AS (SELECT session, inst, least(weight, 0.08) AS weight, sector FROM eq JOIN sectors USING (inst)), cs AS MATERIALIZED (SELECT session, inst, sector, CASE WHEN t > 0.20 THEN round_even(weight * 0.20 / t, 6) ELSE weight END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY session, sector) AS t FROM cn))"


def _capped(s, d):
    w = portfolio.equal_weights(_chosen(s, d)).join(market.sectors(s, d), "inst")
    return portfolio.cap_sector(portfolio.cap_name(w, 0.08), 0.20)


@_query(f"WITH {CAPS} SELECT session, inst, round(weight, 6) AS weight FROM cs")
def cap_sector(s, d):
    return _rounded(_capped(s, d).select("session", "inst", "weight"))


@_query(f"WITH {CAPS} SELECT session, inst, round(CASE WHEN t > 0.5 THEN round_even(weight * 0.5 / t, 6) ELSE weight END, 6) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY session) AS t FROM cs)")
def cap_gross(s, d):
    return _rounded(portfolio.cap_gross(_capped(s, d), 0.5).select("session", "inst", "weight"))


HOLD = ", hold AS (SELECT session, inst, cast(volume AS BIGINT) AS have FROM bars JOIN ends USING (session) WHERE cast(split_part(substr(inst, 7), '.', 1) AS INTEGER) % 2 = 0)"


@_query(f"""WITH {EQW} {HOLD}, j AS (SELECT coalesce(e.session, h.session) AS session, coalesce(e.inst, h.inst) AS inst, coalesce(weight, 0) AS weight, coalesce(have, 0) AS have FROM eq e FULL JOIN hold h ON e.session = h.session AND e.inst = h.inst),
  p AS (SELECT j.*, close AS price, volume, floor(weight * 1000000 / close) - have AS delta FROM j JOIN bars b ON b.session = j.session AND b.inst = j.inst WHERE close > 0),
  f AS (SELECT * FROM p WHERE delta <> 0 AND NOT (have > 0 AND weight > 0 AND abs(weight - have * price / 1000000) < 0.005) AND NOT (weight > 0 AND abs(delta) * price < 100))
  SELECT session, inst, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, cast(CASE WHEN floor(volume * 0.10) > 0 THEN least(abs(delta), floor(volume * 0.10)) ELSE abs(delta) END AS BIGINT) AS shares FROM f""")
def order_plan(s, d):
    b = _bars(s, d)
    hold = b.join(pit.month_ends(b), "session").filter(F.regexp_extract("inst", r"#(\d+)", 1).cast("int") % 2 == 0).select("session", "inst", F.col("volume").cast("long").alias("shares"))
    return portfolio.plan_orders(portfolio.equal_weights(_chosen(s, d)), hold, b, 1_000_000.0)


@_query(f"""WITH {CAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, inst) AS r FROM cs), g AS (SELECT session, sum(weight * weight) AS hhi, sum(CASE WHEN r <= 5 THEN weight ELSE 0 END) AS top5 FROM r GROUP BY 1), t AS (SELECT session, max(s) AS top_sector FROM (SELECT session, sector, sum(weight) AS s FROM cs GROUP BY 1, 2) GROUP BY 1)
  SELECT session, round(hhi, 6) AS hhi, round(1 / hhi, 6) AS effective, round(top5, 6) AS top5, round(top_sector, 6) AS top_sector, hhi > 0.15 OR top_sector > 0.40 AS flagged FROM g JOIN t USING (session)""")
def concentration(s, d):
    return _rounded(portfolio.concentration(_capped(s, d)))


_SECTOR_RET = "SELECT p_type AS sector, sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem WHERE l_returnflag = '{f}') AS weight, avg(l_discount) AS ret FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = '{f}' GROUP BY 1"


@_query(f"WITH p AS ({_SECTOR_RET.format(f='A')}), b AS ({_SECTOR_RET.format(f='N')}), j AS (SELECT coalesce(p.weight, 0) AS wp, coalesce(p.ret, 0) AS rp, coalesce(b.weight, 0) AS wb, coalesce(b.ret, 0) AS rb FROM p FULL JOIN b ON p.sector = b.sector) SELECT round_even(sum((wp - wb) * (rb - t)), 4) + 0.0 AS allocation, round_even(sum(wb * (rp - rb)), 4) + 0.0 AS selection FROM j, (SELECT sum(wb * rb) AS t FROM j)")
def brinson(s, d):
    li = market.table(s, d, "lineitem").join(market.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")

    def side(f):
        g = li.filter(F.col("l_returnflag") == f).groupBy(F.col("p_type").alias("sector")).agg(F.sum("l_extendedprice").alias("w"), F.avg("l_discount").alias("ret"))
        return g.select("sector", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"), "ret")

    return _rounded(portfolio.brinson(side("A"), side("N")))


# ---- performance -------------------------------------------------------------------------------------------------------------------

RET = BARS + ", rt AS MATERIALIZED (SELECT inst, session, close AS equity, close / lag(close) OVER (PARTITION BY inst ORDER BY session) - 1 AS ret FROM bars)"


def _series(s, d, b=None):
    return (_bars(s, d) if b is None else b).select("inst", "session", F.col("close").alias("equity"))


@_query(f"""WITH {RET}, pk AS (SELECT *, max(equity) OVER (PARTITION BY inst ORDER BY session) AS peak FROM rt), g AS (
  SELECT inst, count(ret) AS n, first(equity ORDER BY session) AS e0, last(equity ORDER BY session) AS e1, coalesce(stddev_samp(ret), 0) AS sd, sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) AS down, max(1 - equity / peak) AS max_drawdown,
         avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS win_rate, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS gain, -sum(CASE WHEN ret < 0 THEN ret ELSE 0 END) AS loss FROM pk GROUP BY 1),
  k AS (SELECT *, pow(e1 / e0, 252.0 / n) - 1 AS cagr, sd * sqrt(252.0) AS vol, sqrt(down / (n - 1)) * sqrt(252.0) AS dn FROM g WHERE n >= 2)
  SELECT inst, n, round(e1 / e0 - 1, 6) AS total_return, round(cagr, 6) AS cagr, round(vol, 6) AS volatility, round(CASE WHEN vol > 1e-12 THEN cagr / vol ELSE 0 END, 6) AS sharpe, round(CASE WHEN dn > 1e-12 THEN cagr / dn ELSE 0 END, 6) AS sortino,
         round(max_drawdown, 6) AS max_drawdown, round(CASE WHEN max_drawdown > 1e-12 THEN cagr / max_drawdown ELSE 0 END, 6) AS calmar, round(win_rate, 6) AS win_rate, round(CASE WHEN loss > 1e-12 THEN least(99, gain / loss) ELSE 99 END, 6) AS profit_factor FROM k""")
def perf_metrics(s, d):
    return _rounded(performance.metrics(_series(s, d)).drop("drawdown_bars"))


@_query(f"""WITH {RET}, n AS (SELECT *, CASE WHEN equity > max(equity) OVER (PARTITION BY inst ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM rt), i AS (SELECT *, sum(new) OVER (PARTITION BY inst ORDER BY session) AS island FROM n)
  SELECT inst, max(run) AS drawdown_bars FROM (SELECT inst, island, count(*) - max(new) AS run FROM i GROUP BY 1, 2) GROUP BY 1 HAVING sum(run) + count(*) >= 4""")
def drawdown_duration(s, d):
    return performance.metrics(_series(s, d)).select("inst", "drawdown_bars")


@_query(f"""WITH {BARS}, bm AS (SELECT session, avg(close) AS b FROM bars GROUP BY 1), j AS (SELECT inst, close / lag(close) OVER w - 1 AS r, b / lag(b) OVER w - 1 AS m FROM bars JOIN bm USING (session) WINDOW w AS (PARTITION BY inst ORDER BY session)),
  g AS (SELECT inst, count(*) AS n, avg(r) AS ar, avg(m) AS am, var_samp(m) AS vm, covar_samp(r, m) AS c, stddev_samp(r - m) * sqrt(252.0) AS te, var_samp(r) AS vr FROM j WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT *, CASE WHEN vm <= 1e-8 THEN 1.0 ELSE c / vm END AS beta FROM g)
  SELECT inst, n, round(beta, 6) AS beta, round((ar - beta * am) * 252, 6) AS alpha, round(te, 6) AS tracking_error, round(CASE WHEN te > 1e-12 THEN (ar - am) * 252 / te ELSE 0 END, 6) AS information_ratio, round(CASE WHEN vr * vm > 1e-24 THEN c / sqrt(vr * vm) ELSE 0 END, 6) AS correlation FROM k""")
def benchmark_compare(s, d):
    b = _bars(s, d)
    return _rounded(performance.benchmark_compare(_series(s, d), b.groupBy("session").agg(F.avg("close").alias("equity"))))


@_query(f"WITH {RET} SELECT inst, cast(year(session) AS INTEGER) AS year, round(product(1 + ret) - 1, 4) + 0.0 AS ret FROM rt WHERE ret IS NOT NULL GROUP BY 1, 2")
def year_returns(s, d):
    return _rounded(performance.year_returns(_series(s, d)), 4)


@_query(f"""WITH {RET}, m AS (SELECT inst, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM rt GROUP BY 1), k AS (SELECT inst, m.n, mean, coalesce(sd, 0) AS sd, sum(pow((ret - mean) / sd, 3)) / m.n AS sk, sum(pow((ret - mean) / sd, 4)) / m.n AS ku FROM rt JOIN m USING (inst) WHERE ret IS NOT NULL GROUP BY 1, 2, 3, 4)
  SELECT inst, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN n >= 4 AND sd > 0 THEN sk ELSE 0 END, 6) AS skew, round(CASE WHEN n >= 4 AND sd > 0 THEN ku ELSE 3 END, 6) AS kurtosis FROM k""")
def moments(s, d):
    return _rounded(performance.moments(performance.daily_returns(_series(s, d)).filter("ret IS NOT NULL"), "ret", "inst"))


# ---- ledgers -------------------------------------------------------------------------------------------------------------------------

FILLS = "fills AS MATERIALIZED (SELECT event_id AS fill_id, user_id AS inst, CASE event_type WHEN 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, cast(cast(floor(value) AS BIGINT) % 50 + 1 AS BIGINT) AS qty, value AS price, ts FROM events WHERE event_type IN ('purchase', 'error'))"


@_query(f"WITH {FILLS}, a AS (SELECT *, round_even(CASE side WHEN 'BUY' THEN -1.0 ELSE 1.0 END * qty * price, 2) AS amount FROM fills) SELECT fill_id, inst, round(amount, 2) AS amount, round(100000 + sum(amount) OVER (PARTITION BY inst ORDER BY ts, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS balance FROM a")
def ledger_balance(s, d):
    return _rounded(ledger.balances(market.event_fills(s, d), 100000.0, "inst").select("fill_id", "inst", "amount", "balance"), 2)


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN px IS NULL THEN NULL WHEN buy THEN round_even(px + slip, 4) ELSE round_even(px - slip, 4) END AS price, CASE WHEN px IS NOT NULL THEN round_even(greatest(l_quantity * 0.01, 0.0), 2) END AS commission, CASE WHEN px IS NULL THEN 'REJECTED' ELSE 'FILLED' END AS status
  FROM (SELECT *, round_even(px * 4.0 / 1e4, 4) AS slip FROM (SELECT *, l_returnflag = 'A' AS buy, CASE WHEN l_discount > 0 THEN round_even(l_extendedprice, 4) END AS px FROM lineitem))""")
def fill_costs(s, d):
    li = market.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").alias("shares"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("open"))
    return ledger.execution(li, 4.0, 0.01).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "commission", "status")


@_query(f"""WITH {ENDS}, pos AS (SELECT session, inst, cast(split_part(substr(inst, 7), '.', 1) AS BIGINT) AS shares, 100.0::DOUBLE AS cost FROM spine)
  SELECT p.session, p.inst, shares, coalesce(b.close, cost) AS mark, b.session IS NULL OR b.session < p.session AS stale, shares * coalesce(b.close, cost) AS value FROM pos p ASOF LEFT JOIN bars b ON p.inst = b.inst AND p.session >= b.session""")
def stale_mark(s, d):
    b = _bars(s, d)
    pos = _at(b).withColumns({"shares": F.regexp_extract("inst", r"#(\d+)", 1).cast("long"), "cost": F.lit(100.0)})
    return ledger.marks(pos, b)


@_query(f"""WITH {FILLS}, p AS (SELECT inst, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS shares FROM fills GROUP BY 1), b AS (SELECT inst, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS shares FROM fills WHERE fill_id % 97 <> 0 GROUP BY 1)
  SELECT coalesce(p.inst, b.inst) AS inst, cast(coalesce(p.shares, 0) AS BIGINT) AS own, cast(coalesce(b.shares, 0) AS BIGINT) AS broker, CASE WHEN coalesce(b.shares, 0) = 0 THEN 'MISSING_AT_BROKER' WHEN coalesce(p.shares, 0) = 0 THEN 'UNKNOWN_AT_OWN' ELSE 'QUANTITY' END AS kind, 'CRITICAL' AS severity
  FROM p FULL JOIN b ON p.inst = b.inst WHERE coalesce(p.shares, 0) <> coalesce(b.shares, 0)""")
def reconcile_breaks(s, d):
    f = market.event_fills(s, d)
    return ledger.reconcile(ledger.positions(f, ["inst"]), ledger.positions(f.filter("fill_id % 97 != 0"), ["inst"]))


@_query(f"WITH {FILLS} SELECT inst, cast(sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS shares, count(*) AS fills FROM fills GROUP BY 1 HAVING sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) <> 0")
def fills_replay(s, d):
    f = market.event_fills(s, d)
    return ledger.positions(f.unionByName(f), ["inst"])  # a replay of everything changes nothing


LOTS = f"""WITH RECURSIVE {FILLS}, f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY ts, fill_id) AS k FROM fills), r(inst, fill_id, k, shares, cost, gain) AS (
  SELECT inst, fill_id, k, CASE side WHEN 'BUY' THEN qty ELSE 0 END, CASE side WHEN 'BUY' THEN round_even(round(price, 9), 4) ELSE 0.0 END::DOUBLE, 0.0::DOUBLE FROM f WHERE k = 1
  UNION ALL SELECT f.inst, f.fill_id, f.k, CASE side WHEN 'BUY' THEN shares + qty ELSE shares - least(qty, shares) END, CASE WHEN side = 'BUY' THEN round_even(round((shares * cost + qty * price) / (shares + qty), 9), 4) WHEN qty >= shares THEN 0.0 ELSE cost END,
    CASE side WHEN 'BUY' THEN gain ELSE round_even(round(gain + least(qty, shares) * (price - cost), 9), 4) END FROM r JOIN f ON f.inst = r.inst AND f.k = r.k + 1)
  SELECT inst, fill_id, cast(shares AS BIGINT) AS shares, round(cost + 1e-6, 2) AS cost, round(gain + 1e-6, 1) + 0.0 AS gain FROM r"""


@_query(LOTS)
def fill_lots(s, d):
    out = ledger.lots(market.event_fills(s, d), oversell="cut")  # events know nothing of lots
    return out.withColumns({"cost": F.round(F.col("cost") + 1e-6, 2), "gain": F.round(F.col("gain") + 1e-6, 1) + 0.0})  # the nudge settles ties


@_query(LOTS)
def fills_stream_lots(s, d):
    """The fills as they come: the first half in files of any order, then the query is started again from its checkpoint on the rest, with
    fills that come half a day late and a fifth of the old ones once more."""
    f = market.event_fills(s, d)
    half = f.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half"), F.max("ts").alias("end"))
    f = f.join(F.broadcast(half), F.lit(True)).withColumn("late", (F.col("fill_id") % 17 == 0) & (F.col("ts") > F.col("half") - F.expr("INTERVAL 12 HOURS")))
    at = store.scratch(s, "fills")
    first, second = (F.col("ts") <= F.col("half")) & ~F.col("late"), (F.col("ts") > F.col("half")) | F.col("late") | (F.col("fill_id") % 5 == 0)
    for part in (first, second):
        f.filter(part).drop("half", "end", "late").repartitionByRange(4, "ts").write.mode("append").parquet(f"{at}/in")
        stream.replay_lots(s, f"{at}/in", f"{at}/out", f"{at}/checkpoint", files=16)
    out = stream.latest_lots(s.read.parquet(f"{at}/out"))
    return out.withColumns({"cost": F.round(F.col("cost") + 1e-6, 2), "gain": F.round(F.col("gain") + 1e-6, 1) + 0.0})


# ---- learning ------------------------------------------------------------------------------------------------------------------------

FOLDS = CAL + ", nn AS (SELECT count(*) AS n FROM cal), folds AS (SELECT cast(k AS INTEGER) AS fold, 1::BIGINT AS train_from, 252 + 63 * k AS train_to, 273 + 63 * k + 1 AS test_from, 273 + 63 * k + 63 AS test_to FROM range(0, 1000) AS g(k), nn WHERE 273 + 63 * k + 63 <= n)"


@_query(f"WITH {FOLDS} SELECT * FROM folds")
def wf_folds(s, d):
    return learning.folds(pit.sessions(_bars(s, d)))


PANEL = MOM12W + _fwd("21") + ", fac2 AS (SELECT inst, session, lag(close, 20) OVER w / nullif(lag(close, 125) OVER w, 0) - 1 AS v FROM bars WINDOW w AS (PARTITION BY inst ORDER BY session))" + f", lab AS (SELECT session, inst, ({RANK_SQL.format(k='session', x='ret')} - 1) / (n - 1) - 0.5 AS label FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM fwd) WHERE n >= 3), panel AS MATERIALIZED (SELECT s.session, s.inst, s.value AS f1, b.volume AS f2, label FROM scores s JOIN bars b ON b.session = s.session AND b.inst = s.inst JOIN lab l ON l.session = s.session AND l.inst = s.inst WHERE s.value IS NOT NULL)"


def _panel(s, d):
    b, at, m, r = _month_end_study(s, d)
    m = m.filter("value IS NOT NULL").select("session", "inst", F.col("value").alias("f1"))
    f2 = b.join(F.broadcast(at), "session").select("session", "inst", F.col("volume").alias("f2"))
    return m.join(f2, ["session", "inst"]).join(evaluation.rank_label(r).select("session", "inst", "label"), ["session", "inst"])


@_query(f"WITH {PANEL} SELECT cast(year(session) AS INTEGER) AS year, count(*) AS n, {', '.join(f'round(sum({a} * {b}), 4) + 0.0 AS {c}' for a, b, c in [('f1', 'f1', 'xx_0_0'), ('f1', 'f2', 'xx_0_1'), ('f2', 'f2', 'xx_1_1'), ('f1', 'label', 'xy_0'), ('f2', 'label', 'xy_1')])} FROM panel GROUP BY 1")
def ridge_normal_eq(s, d):
    p = _panel(s, d).withColumn("year", F.year("session"))
    return _rounded(learning.normal_equations(p, ["f1", "f2"], "label", ["year"]), 4)


@_query(f"""WITH {PANEL}, lo AS (SELECT cast(year(session) AS INTEGER) AS year, unnest(['f1', 'f2']) AS feature, unnest([f1, f2]) AS v FROM panel), r AS (SELECT *, row_number() OVER (PARTITION BY year, feature ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY year, feature) AS n FROM lo),
  b AS (SELECT *, max(CASE WHEN pos = least(floor(0.01 * n), n - 1) THEN v END) OVER (PARTITION BY year, feature) AS low, max(CASE WHEN pos = least(floor(0.99 * n), n - 1) THEN v END) OVER (PARTITION BY year, feature) AS high FROM r)
  SELECT year, feature, round(first(low), 6) AS low, round(first(high), 6) AS high, round(avg(least(greatest(v, low), high)), 6) AS mean, round(CASE WHEN var_samp(least(greatest(v, low), high)) > 1e-8 THEN sqrt(var_samp(least(greatest(v, low), high))) ELSE 1.0 END, 6) AS sd FROM b GROUP BY 1, 2""")
def ml_preprocess(s, d):
    return _rounded(learning.preprocessor(_panel(s, d).withColumn("year", F.year("session")), ["f1", "f2"], ["year"]))


SPLITS = """, days AS (SELECT session, row_number() OVER (ORDER BY session) AS idx FROM (SELECT DISTINCT session FROM panel)), splits AS (SELECT cast(k AS INTEGER) AS fold, 12 + 6 * k AS train_to, 14 + 6 * k AS test_from, 13 + 6 * k + 6 AS test_to FROM range(0, 1000) AS g(k), (SELECT count(*) AS n FROM days) WHERE 13 + 6 * k + 6 <= n),
 fr AS MATERIALIZED (SELECT p.*, fold, CASE WHEN idx <= train_to THEN 'train' ELSE 'test' END AS part FROM panel p JOIN days USING (session) JOIN splits ON idx <= train_to OR idx BETWEEN test_from AND test_to)"""


def _split_rows(s, d, p=None):
    p = store.kept(_panel(s, d) if p is None else p, "panel")  # a row a name and month: three readers follow
    cal = p.select("session").distinct().withColumn("idx", F.row_number().over(Window.orderBy("session")))
    return learning.fold_rows(p, cal, learning.folds(cal, 12, 6, 6, 1))


def _boosted_sql(trees: int = 20, rate: float = 0.05, depth: int = 3, least: int = 5) -> str:
    """Common tables from `fr` to `boosted` (fold, session, inst, part, label, pred): each level of each tree a table."""
    unit = trees_of.UNIT
    sql = f""", fl AS (SELECT fold, unnest([0, 1]) AS j, unnest([f1, f2]) AS v FROM fr WHERE part = 'train'),
 fo AS (SELECT *, row_number() OVER (PARTITION BY fold, j ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY fold, j) AS n FROM fl),
 fb AS (SELECT fold, j, max(CASE WHEN pos = least(floor(0.01 * n), n - 1) THEN v END) AS lo, max(CASE WHEN pos = least(floor(0.99 * n), n - 1) THEN v END) AS hi FROM fo GROUP BY 1, 2),
 z0 AS MATERIALIZED (SELECT fr.fold, session, inst, part, label, least(greatest(f1, a.lo), a.hi) AS x0, least(greatest(f2, b.lo), b.hi) AS x1 FROM fr JOIN fb a ON a.fold = fr.fold AND a.j = 0 JOIN fb b ON b.fold = fr.fold AND b.j = 1),
 p0 AS MATERIALIZED (SELECT z0.*, base AS pred FROM z0 JOIN (SELECT fold, cast(sum(cast(floor(label * {unit} + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / {unit} AS base FROM z0 WHERE part = 'train' GROUP BY 1) USING (fold))"""
    for t in range(1, trees + 1):
        sql += f",\n r{t}_0 AS MATERIALIZED (SELECT *, cast(floor((label - pred) * {unit} + 0.5) AS BIGINT) AS r, 0 AS node FROM p{t - 1})"
        for k in range(depth):
            sql += f""",
 v{t}_{k} AS (SELECT fold, node, j, x, count(*) AS n, sum(r) AS s FROM (SELECT fold, node, r, unnest([0, 1]) AS j, unnest([x0, x1]) AS x FROM r{t}_{k} WHERE part = 'train') GROUP BY 1, 2, 3, 4),
 w{t}_{k} AS (SELECT *, cast(sum(n) OVER o AS DOUBLE) AS nl, cast(sum(s) OVER o AS DOUBLE) AS sl, lead(x) OVER o AS nx, cast(sum(n) OVER a AS DOUBLE) AS na, cast(sum(s) OVER a AS DOUBLE) AS sa FROM v{t}_{k} WINDOW o AS (PARTITION BY fold, node, j ORDER BY x), a AS (PARTITION BY fold, node, j)),
 b{t}_{k} AS (SELECT fold, node, j, (x + nx) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY fold, node ORDER BY sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na DESC, j, x) AS first FROM w{t}_{k} WHERE nx IS NOT NULL AND na >= {least}) WHERE first = 1),
 r{t}_{k + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node), CASE WHEN b.j IS NULL THEN a.node WHEN CASE b.j WHEN 0 THEN x0 ELSE x1 END <= cut THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node FROM r{t}_{k} a LEFT JOIN b{t}_{k} b ON a.fold = b.fold AND a.node = b.node)"""
        sql += f""",
 p{t} AS MATERIALIZED (SELECT a.* EXCLUDE (r, node, pred), pred + {rate} * value AS pred FROM r{t}_{depth} a JOIN (SELECT fold, node, cast(sum(r) AS DOUBLE) / count(*) / {unit} AS value FROM r{t}_{depth} WHERE part = 'train' GROUP BY 1, 2) g ON a.fold = g.fold AND a.node = g.node)"""
    return sql + f", boosted AS (SELECT * FROM p{trees})"


@_query(f"WITH {PANEL} {SPLITS} {_boosted_sql()} SELECT fold, session, inst, round(pred, 9) + 0.0 AS prediction, round(label, 9) + 0.0 AS label FROM boosted WHERE part = 'test'")
def gbdt_oos(s, d):
    return _rounded(trees_of.boosted_predictions(_split_rows(s, d), ["f1", "f2"]), 9)


@_query(f"WITH {PANEL} {SPLITS} {_boosted_sql(1, 1.0, 4, 10)} SELECT fold, session, inst, round(pred, 9) + 0.0 AS prediction, round(label, 9) + 0.0 AS label FROM boosted WHERE part = 'test'")
def tree_oos(s, d):
    """One tree of depth 4 a fold."""
    return _rounded(trees_of.boosted_predictions(_split_rows(s, d), ["f1", "f2"], trees=1, rate=1.0, depth=4, least=10), 9)


@_query(f"""WITH {PANEL} {SPLITS}, lo AS (SELECT fold, unnest(['f1', 'f2']) AS feature, unnest([f1, f2]) AS v FROM fr WHERE part = 'train'), rr AS (SELECT *, row_number() OVER (PARTITION BY fold, feature ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY fold, feature) AS n FROM lo),
  bb AS (SELECT *, max(CASE WHEN pos = least(floor(0.01 * n), n - 1) THEN v END) OVER (PARTITION BY fold, feature) AS low, max(CASE WHEN pos = least(floor(0.99 * n), n - 1) THEN v END) OVER (PARTITION BY fold, feature) AS high FROM rr),
  st AS (SELECT fold, feature, first(low) AS low, first(high) AS high, avg(least(greatest(v, low), high)) AS mean, CASE WHEN var_samp(least(greatest(v, low), high)) > 1e-8 THEN sqrt(var_samp(least(greatest(v, low), high))) ELSE 1.0 END AS sd FROM bb GROUP BY 1, 2),
  z AS MATERIALIZED (SELECT fr.fold, session, inst, part, label, (greatest(least(f1, a.high), a.low) - a.mean) / a.sd AS x, (greatest(least(f2, b.high), b.low) - b.mean) / b.sd AS y FROM fr JOIN st a ON a.fold = fr.fold AND a.feature = 'f1' JOIN st b ON b.fold = fr.fold AND b.feature = 'f2'),
  q AS (SELECT fold, sum(x * x) + 1 AS xx, sum(x * y) AS xy, sum(y * y) + 1 AS yy, sum(x * label) AS xl, sum(y * label) AS yl FROM z WHERE part = 'train' GROUP BY 1)
  SELECT z.fold, session, inst, round(x * (xl * yy - yl * xy) / (xx * yy - xy * xy) + y * (yl * xx - xl * xy) / (xx * yy - xy * xy), 6) + 0.0 AS prediction, round(label, 6) + 0.0 AS label FROM z JOIN q USING (fold) WHERE part = 'test'""")
def ridge_oos(s, d):
    return _rounded(learning.ridge_predictions(_split_rows(s, d), ["f1", "f2"]))


SEEDS = 8
SHUFFLED = f""", seeds AS (SELECT cast(seed AS INTEGER) AS seed FROM range(-1, {SEEDS}) AS g(seed)), dd AS MATERIALIZED (SELECT seed, session, inst, f1, label, row_number() OVER (PARTITION BY seed, session ORDER BY inst) AS a, row_number() OVER (PARTITION BY seed, session ORDER BY CASE WHEN seed < 0 THEN inst ELSE md5(inst || '|' || session || '|' || seed) END, inst) AS b FROM panel, seeds),
  dealt AS (SELECT x.seed, x.session, x.f1, y.label FROM dd x JOIN dd y ON x.seed = y.seed AND x.session = y.session AND x.a = y.b), rks AS (SELECT *, {RANK_SQL.format(k='seed, session', x='f1')} AS rx, {RANK_SQL.format(k='seed, session', x='label')} AS ry FROM dealt),
  sic AS (SELECT seed, session, {CORR.format(x='rx', y='ry')} AS ic FROM rks GROUP BY 1, 2), draws AS MATERIALIZED (SELECT seed, avg(ic) AS mean, count(*) AS n FROM sic WHERE ic IS NOT NULL GROUP BY 1)"""


def _draws(s, d):
    p = store.kept(_panel(s, d), "panel")  # two readers a seed follow
    real = p.withColumn("seed", F.lit(-1))
    for k in range(SEEDS):
        real = real.unionByName(learning.shuffled_labels(p, k).withColumn("seed", F.lit(k)))
    c = evaluation.ic_series(real.select("seed", "session", "inst", F.col("f1").alias("value"), F.col("label").alias("ret")), ("seed", "session"))
    return c.groupBy("seed").agg(F.avg("rank_ic").alias("mean"), F.count("*").alias("n"))


@_query(f"WITH {PANEL} {SHUFFLED} SELECT seed, round(mean, 6) + 0.0 AS mean, n FROM draws")
def label_shuffle(s, d):
    return _rounded(_draws(s, d))


@_query(f"WITH {PANEL} {SHUFFLED} SELECT round(o.mean, 6) + 0.0 AS observed, count(x.seed) AS draws, round((count(*) FILTER (x.mean >= o.mean) + 1) / (count(x.seed) + 1), 6) AS p FROM (SELECT mean FROM draws WHERE seed < 0) o LEFT JOIN draws x ON x.seed >= 0 GROUP BY o.mean")
def label_shuffle_p(s, d):
    g = _draws(s, d)
    observed = g.filter("seed < 0").select(F.col("mean").alias("observed"))
    return _rounded(validation.empirical_p(observed, g.filter("seed >= 0")))


# ---- validation ----------------------------------------------------------------------------------------------------------------------


@_query("""WITH t AS (SELECT c_custkey AS id, cast(c_nationkey AS BIGINT) AS grp, ((c_custkey * 7919 % 1000) + 1) / 10000.0 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS rank, count(*) OVER (PARTITION BY grp) AS m FROM t)
  SELECT id, grp, cast(rank AS INTEGER) AS rank, coalesce(rank <= max(CASE WHEN p <= rank / m * 0.05 THEN rank END) OVER (PARTITION BY grp), FALSE) AS significant FROM r""")
def bh_fdr(s, d):
    t = market.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("grp"), ((F.col("c_custkey") * 7919 % 1000 + 1) / 10000.0).alias("p"))
    return validation.discoveries(t, 0.05, ("grp",)).select("id", "grp", "rank", "significant")


STRATS = f"""{RET}, pg AS (SELECT inst, pow(last(equity ORDER BY session) / first(equity ORDER BY session), 252.0 / count(ret)) - 1 AS cagr, coalesce(stddev_samp(ret), 0) * sqrt(252.0) AS vol FROM rt GROUP BY 1 HAVING count(ret) >= 2),
  st AS (SELECT inst AS id, cagr, turnover, vol FROM pg JOIN (SELECT inst, stddev_samp(volume) / avg(volume) * 4 AS turnover FROM bars GROUP BY 1) USING (inst))"""


def _strategies(s, d):
    """Each brand as a strategy: growth and deviation of its closes, and how often its volume turns over."""
    m = performance.metrics(_series(s, d)).select(F.col("inst").alias("id"), "cagr", F.col("volatility").alias("vol"))
    return m.join(_bars(s, d).groupBy(F.col("inst").alias("id")).agg((F.stddev_samp("volume") / F.avg("volume") * 4).alias("turnover")), "id")


@_query(f"""WITH {STRATS}, e AS (SELECT *, CASE WHEN cagr <= 0 THEN 0.0 WHEN turnover > 1e-4 THEN least(1000.0, cagr / (turnover * 2) * 1e4) ELSE 1000.0 END AS ev FROM st)
  SELECT id, bps, round(cagr - turnover * bps / 1e4 * 2, 4) + 0.0 AS net_cagr, round((cagr - turnover * bps / 1e4 * 2) / CASE WHEN vol > 1e-6 THEN vol ELSE 0.15 END, 2) + 0.0 AS sharpe, round(ev, 1) AS break_even, ev < 10 AS fragile FROM e, (SELECT unnest([0.0, 5.0, 10.0, 20.0, 50.0, 100.0])::DOUBLE AS bps)""")
def cost_stress(s, d):
    out = validation.cost_stress(_strategies(s, d))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("net_cagr", "sharpe")})


@_query(f"""WITH {IC}, rk3 AS (SELECT session, ret, row_number() OVER (PARTITION BY session ORDER BY value DESC, inst) AS r FROM pairs), c AS (SELECT session, k, avg(ret) AS r FROM rk3 JOIN (SELECT unnest([3, 5, 8, 10]) AS k) ON r <= k GROUP BY 1, 2),
  k AS (SELECT cast(year(session) AS INTEGER) AS grp, k AS pos, round(CASE WHEN coalesce(stddev_samp(r), 0) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(12.0) ELSE 0 END, 2) AS sharpe FROM c GROUP BY 1, 2),
  g AS (SELECT grp, count(*) AS n, max(sharpe) AS hi, min(sharpe) AS lo, avg(sharpe) AS mid, min(dd) AS dn, max(dd) AS up FROM (SELECT *, sharpe - lag(sharpe) OVER (PARTITION BY grp ORDER BY pos) AS dd FROM k) GROUP BY 1)
  SELECT grp, n, CASE WHEN n < 2 THEN 'PLATEAU' WHEN hi > 1.5 * mid AND hi - lo > 0.75 THEN 'SPIKE' WHEN hi - lo < 0.35 THEN 'PLATEAU' WHEN dn >= 0 OR up <= 0 THEN 'MONOTONIC' ELSE 'FRAGILE' END AS topology FROM g""")
def sensitivity_topology(s, d):
    """How the ratio of the best k names of each section depends on k, by year."""
    r = _pairs(s, d).withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("value"), "inst")))
    r = r.withColumn("pos", F.explode(F.array(*[F.lit(k) for k in (3, 5, 8, 10)]))).filter("r <= pos").groupBy("session", "pos").agg(F.avg("ret").alias("ret"))
    sd = F.coalesce(F.stddev_samp("ret"), F.lit(0.0))
    cells = r.groupBy(F.year("session").alias("grp"), "pos").agg(F.round(F.when(sd > 1e-12, F.try_divide(F.avg("ret"), sd) * F.sqrt(F.lit(12.0))).otherwise(0.0), 2).alias("sharpe"))
    return validation.topology(cells, ["grp"])


@_query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN 'REJECTED' WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'RESEARCH_ONLY' WHEN s_suppkey % 2 = 0 THEN 'PAPER_CANDIDATE' ELSE 'VALIDATED' END AS verdict FROM supplier")
def verdict(s, d):
    k = F.col("s_suppkey")
    c = market.table(s, d, "supplier").select(k.alias("id"), (k % 11 != 0).alias("gates_ok"), (k % 3 == 0).alias("cost_fragile"), (k % 5 == 0).alias("concentrated"), (k % 7 == 0).alias("warned"), (k % 2 == 0).alias("eligible"))
    return validation.verdict(c).select("id", "verdict")


def _drawn(what: str, seed: int) -> str:
    return f"((cast('0x' || substr(md5({what} || '|{seed}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _bootstrap_sql(rets: str, sims: int) -> str:
    """From rets (id, session, ret) to the interval of each series."""
    at = "id || '|' || sim || '|' || t"
    return f"""{rets}, r AS MATERIALIZED (SELECT id, ret, row_number() OVER (PARTITION BY id ORDER BY session) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM rets WHERE ret IS NOT NULL),
 twice AS (SELECT id, k, ret FROM r UNION ALL SELECT id, k + n, ret FROM r),
 ends AS MATERIALIZED (SELECT id, k + 1 AS k, sum(ret) OVER w AS s, sum(ret * ret) OVER w AS q FROM twice WINDOW w AS (PARTITION BY id ORDER BY k) UNION ALL SELECT DISTINCT id, 0, 0.0, 0.0 FROM r),
 sizes AS (SELECT id, max(n) AS n, avg(ret) AS mean FROM r GROUP BY 1), sims AS (SELECT id, n, mean, sim FROM sizes, range({sims}) AS g(sim)),
 st AS (SELECT id, sim, n, t FROM (SELECT id, sim, n, unnest(range(n)) AS t FROM sims WHERE n >= 5) WHERE t = 0 OR {_drawn(at, 42)} < 1.0 / 21),
 bl AS (SELECT id, sim, n, cast(floor({_drawn(at, 43)} * n) AS BIGINT) AS k, coalesce(lead(t) OVER (PARTITION BY id, sim ORDER BY t), n) - t AS long FROM st),
 g AS (SELECT bl.id, sim, max(n) AS n, sum(b.s - a.s) AS s, sum(b.q - a.q) AS q FROM bl JOIN ends a ON a.id = bl.id AND a.k = bl.k JOIN ends b ON b.id = bl.id AND b.k = bl.k + bl.long GROUP BY 1, 2),
 sh AS (SELECT id, sim, CASE WHEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) > 1e-8 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252) ELSE 0 END AS sharpe FROM g UNION ALL SELECT id, sim, mean * sqrt(252) FROM sims WHERE n < 5),
 p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sharpe, sim) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n FROM sh)
 SELECT id, count(*) AS n, round(avg(sharpe), 5) + 0.0 AS mean, round(stddev_pop(sharpe), 5) + 0.0 AS error, round(max(CASE WHEN pos = least(floor({(1 - 0.95) / 2!r} * n), n - 1) THEN sharpe END), 5) + 0.0 AS low, round(max(CASE WHEN pos = least(floor({1 - (1 - 0.95) / 2!r} * n), n - 1) THEN sharpe END), 5) + 0.0 AS high FROM p GROUP BY 1"""


@_query(_bootstrap_sql(f"WITH {BARS}, rets AS (SELECT 'index' AS id, session, e / lag(e) OVER (ORDER BY session) - 1 AS ret FROM (SELECT session, avg(close) AS e FROM bars GROUP BY 1))", 1000))
def bootstrap_sharpe(s, d):
    b = _bars(s, d).groupBy("session").agg(F.avg("close").alias("equity")).withColumn("inst", F.lit("index"))
    r = performance.daily_returns(b).withColumnRenamed("inst", "id")
    return _rounded(validation.bootstrap_interval(validation.bootstrap_sharpe(r)), 5)


@_query(_bootstrap_sql(f"WITH {BARS}, rets AS (SELECT inst AS id, session, close / lag(close) OVER (PARTITION BY inst ORDER BY session) - 1 AS ret FROM bars)", 100))
def bootstrap_names(s, d):
    """All names at once."""
    r = performance.daily_returns(_kept_bars(s, d).select(F.col("inst"), "session", F.col("close").alias("equity"))).withColumnRenamed("inst", "id")
    return _rounded(validation.bootstrap_interval(validation.bootstrap_sharpe(r, 100)), 5)


@_query()
def dsr(s, d):
    m = performance.moments(performance.daily_returns(_series(s, d)).filter("ret IS NOT NULL"), "ret", "inst")

    def run(batches):
        for pdf in batches:
            sr = (pdf["mean"] / pdf["sd"]).where(pdf["sd"] > 1e-12, 0.0)
            yield pdf[["inst", "n"]].assign(sharpe=sr, p=[validation.deflated_sharpe(a, 25, 0.25, b, c, int(n)) for a, b, c, n in zip(sr, pdf["skew"], pdf["kurtosis"], pdf["n"], strict=True)])

    return m.mapInPandas(run, "inst string, n long, sharpe double, p double")


@_query()
def backtest_fold(s, d):
    b = market.bars(s, d, issues=False).join(market.sectors(s, d), "inst")  # a simulation is one group a variant
    ends = pit.month_ends(b).withColumn("rebalance", F.lit(True))
    a = market.order_actions(s, d).groupBy("inst", F.col("effective").alias("session")).agg(F.product("ratio").alias("split"), F.sum("cash").alias("dividend"))
    score = factors.momentum(b, _at(b), days=WIDE, strict=False).select("session", "inst", F.col("value").alias("score"))
    panel = b.join(ends, "session", "left").fillna(False, ["rebalance"]).join(score, ["session", "inst"], "left").join(a, ["inst", "session"], "left")
    panel = panel.select("session", "inst", "open", "close", "volume", "sector", "score", "split", "dividend", "rebalance")
    v = s.createDataFrame([(f"top{k}-{int(bps)}bps", k, k + 5, 1_000_000.0, bps, 0.005, 0.10, 0.005, 100.0, 0.10, 0.30, 0.10, 0.01) for k in (5, 10) for bps in (5.0, 20.0)], "variant string, k int, keep_to int, cash0 double, bps double, per_share double, participation double, band double, least double, name_cap double, sector_cap double, unknown_cap double, buffer double")
    return backtest.simulate(panel, v)


@_query("SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 100 GROUP BY 1")
def adhoc_sql(s, d):
    t = {n: market.table(s, d, n) for n in ("customer", "nation", "region")}
    return sql_facade.query(s, "SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > :least GROUP BY r_name", t, {"least": 100})


@_query(f"WITH {SECTION} SELECT session, inst, round({Z_SQL.format(x='value')} / 4, 6) + 0.0 AS v FROM sec WINDOW p AS (PARTITION BY session)")
def adhoc_sections(s, d):
    """Scalar and table functions in SQL."""
    sql = "SELECT session, inst, round(safe_ratio(value, :size), 6) + 0.0D AS v FROM section_scores(TABLE(SELECT session, inst, value FROM sections) PARTITION BY (session), 'z')"
    return sql_facade.query(s, sql, {"sections": _section(s, d)}, {"size": 4.0})


@_query(_SQL["mom_12_1"])
def adhoc_factor(s, d):
    """A factor by its name in SQL."""
    b = _bars(s, d)
    sql_functions.install_factors(s, b, _at(b), market.order_filings(s, d))
    return sql_facade.query(s, "SELECT session, inst, round(value, 6) + 0.0D AS value, reason FROM factor('momentum_12_1')", {})


@_query("SELECT user_id % 10 AS symbol, count(*) AS fills, round(sum(value), 4) AS value FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 10 IN (3, 7) AND value >= 20.5 AND cast(ts AS DATE) > (SELECT cast(min(ts) AS DATE) FROM events) GROUP BY 1")
def connector_scan(s, d):
    """Events laid down as a provider's delimited files in a folder a type, read by many tasks with filters taken by the scan."""
    at = store.scratch(s, "provider")
    e = market.table(s, d, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("user_id") % 10).alias("symbol"), "value")
    e.repartition(4).write.option("header", True).partitionBy("event_type").csv(at)
    connector.install(s)
    rows = s.read.format("provider_csv").schema("day date, symbol long, value double, event_type string").option("splitBytes", 1 << 16).load(at)
    rows = rows.filter(F.col("event_type").isin("purchase", "error") & F.col("symbol").isin(3, 7) & (F.col("value") >= 20.5))
    first = market.table(s, d, "events").agg(F.to_date(F.min("ts")).alias("first"))
    g = rows.join(F.broadcast(first), F.col("day") > F.col("first")).groupBy("symbol").agg(F.count("*").alias("fills"), F.sum("value").alias("value"))
    return g.select("symbol", "fills", F.round("value", 4).alias("value"))


@_query()
def content_hash(s, d):
    return universe.content_hash(market.table(s, d, "orders"))


_WORDS = " || '-' || ".join(f"sum(cast('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT))" for i in range(8))


@_query(f"""WITH r AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders)
  SELECT count(*) AS n, sha256(count(*) || '-' || {_WORDS}) AS hash FROM r""")
def content_hash_keys(s, d):
    """Of columns that all engines write alike, shuffled and in another order of columns."""
    o = market.table(s, d, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", "o_custkey")
    return universe.content_hash(o.repartition(7, "o_custkey"))


HOLIDAY = """(
   (month(day) = 1 AND day(day) = 1) OR (month(day) = 1 AND day(day) = 2 AND isodow(day) = 1) OR (month(day) = 12 AND day(day) = 31 AND isodow(day) = 5)
   OR (year(day) >= 2021 AND month(day) = 6 AND (day(day) = 19 OR (day(day) = 20 AND isodow(day) = 1) OR (day(day) = 18 AND isodow(day) = 5)))
   OR (month(day) = 7 AND (day(day) = 4 OR (day(day) = 5 AND isodow(day) = 1) OR (day(day) = 3 AND isodow(day) = 5)))
   OR (month(day) = 12 AND (day(day) = 25 OR (day(day) = 26 AND isodow(day) = 1) OR (day(day) = 24 AND isodow(day) = 5)))
   OR (isodow(day) = 1 AND ((month(day) IN (1, 2) AND day(day) BETWEEN 15 AND 21) OR (month(day) = 5 AND day(day) >= 25) OR (month(day) = 9 AND day(day) <= 7)))
   OR (isodow(day) = 4 AND month(day) = 11 AND day(day) BETWEEN 22 AND 28))"""
RULED = f"days AS (SELECT cast(unnest(generate_series((SELECT date_trunc('day', min(o_orderdate)) + INTERVAL 288 MONTH FROM orders), (SELECT date_trunc('day', max(o_orderdate)) + INTERVAL 288 MONTH FROM orders), INTERVAL 1 DAY)) AS DATE) AS day), ruled AS MATERIALIZED (SELECT day AS session FROM days WHERE isodow(day) <= 5 AND NOT {HOLIDAY})"


def _ruled(s, d):
    """The exchange's calendar over the days of the orders, 24 years on, where all holidays are kept."""
    day = lambda f: F.add_months(F.to_date(f("o_orderdate")), 288).cast("string")
    return calendar.sessions(s, *market.table(s, d, "orders").agg(day(F.min), day(F.max)).first())


@_query(f"WITH {RULED} SELECT session FROM ruled")
def calendar_sessions(s, d):
    return _ruled(s, d)


#: Summer time runs from the second Sunday of March to the first of November.
SUMMER = "(session >= make_date(year(session), 3, 8) + cast((7 - isodow(make_date(year(session), 3, 8))) AS INTEGER) AND session < make_date(year(session), 11, 1) + cast((7 - isodow(make_date(year(session), 11, 1))) AS INTEGER))"


@_query(f"""WITH {RULED}, e AS (SELECT max(session) AS session FROM ruled GROUP BY date_trunc('month', session)), o AS (SELECT session, CASE WHEN {SUMMER} THEN 4 ELSE 5 END AS h FROM ruled),
  t AS (SELECT session, 'open' AS event, session + to_hours(9 + h) + to_minutes(30) AS ts, 20 AS priority FROM o UNION ALL SELECT session, 'close', session + to_hours(16 + h), 40 FROM o UNION ALL SELECT session, 'decision', session + to_hours(16 + h) + to_minutes(5), 50 FROM o JOIN e USING (session))
  SELECT session, event, cast(epoch(ts) AS BIGINT) AS ts, priority, cast(row_number() OVER (ORDER BY ts, priority) AS INTEGER) AS seq FROM t""")
def event_timeline(s, d):
    c = _ruled(s, d)
    return calendar.timeline(c, pit.month_ends(c)).withColumn("ts", F.unix_timestamp("ts"))


@_query(f"WITH {FWD} SELECT session, inst, round(CASE WHEN count(*) OVER (PARTITION BY session) > 1 THEN 2.0 * (row_number() OVER (PARTITION BY session ORDER BY ret, inst) - 1) / greatest(count(*) OVER (PARTITION BY session) - 1, 1) - 1.0 ELSE 0.0 END, 6) + 0.0 AS label FROM fwd")
def label_ordinal(s, d):
    return _rounded(evaluation.ordinal_label(_returns(s, d)).select("session", "inst", "label"))


@_query(f"WITH {CAPS} SELECT session, count(*) AS names, round(sum(weight), 6) AS gross, round(1 - sum(weight), 6) + 0.0 AS cash, round(max(weight), 6) AS largest, round(sum(weight * weight), 3) AS hhi, round(1 / sum(weight * weight), 1) AS effective FROM cs WHERE weight > 0 GROUP BY 1")
def pre_trade_diagnostics(s, d):
    g = portfolio.diagnostics(_capped(s, d))
    w = _capped(s, d).groupBy("session").agg(F.sum(F.col("weight") * F.col("weight")).alias("h"))
    return _rounded(g.drop("hhi", "effective").join(w, "session").select("session", "names", "gross", "cash", "largest", F.round("h", 3).alias("hhi"), F.round(1 / F.col("h"), 1).alias("effective")))


@_query(f"""WITH {ADJ}, e AS (SELECT inst, session, close * price_factor AS e, close * 3 * CASE WHEN month(session) = 7 THEN 1.01 ELSE 1.0 END AS p FROM adj), a AS (SELECT inst, last(p / e ORDER BY session) AS k FROM e GROUP BY 1)
  SELECT inst, count(*) AS sessions, round(median(abs(e * k - p) / p), 6) AS median_error, round(max(abs(e * k - p) / p), 6) AS worst_error FROM e JOIN a USING (inst) GROUP BY 1""")
def verify_series(s, d):
    a = _adjusted(s, d)
    provider = a.select("inst", "session", (F.col("close") * 3 * F.when(F.month("session") == 7, 1.01).otherwise(1.0)).alias("close"))
    return _rounded(pit.series_errors(a.select("inst", "session", (F.col("close") * F.col("price_factor")).alias("close")), provider))


@_query("SELECT s_suppkey AS id, gate, CASE gate WHEN 'AUTHORITY' THEN s_suppkey % 4 <> 0 WHEN 'LOOKAHEAD' THEN s_suppkey % 3 <> 0 WHEN 'INTEGRITY' THEN s_suppkey % 5 <> 0 ELSE s_suppkey % 7 <> 0 END AS passed FROM supplier, (SELECT unnest(['AUTHORITY', 'LOOKAHEAD', 'INTEGRITY', 'REPRODUCIBILITY']) AS gate)")
def hard_gates(s, d):
    k = F.col("s_suppkey")
    c = market.table(s, d, "supplier").select(k.alias("id"), F.when(k % 4 != 0, "c").alias("code"), F.lit("f").alias("config"), (k % 3 == 0).alias("lookahead"), (k % 5 == 0).alias("corrupt"), (k % 7 == 0).alias("irreproducible"))
    return validation.gates(c)


@_query("WITH t AS (SELECT 'spec' || (c_custkey % 40) AS spec, c_acctbal AS sharpe, c_custkey AS tried FROM customer), f AS (SELECT *, sha256(spec) AS spec_hash FROM t QUALIFY row_number() OVER (PARTITION BY spec ORDER BY tried) = 1) SELECT spec, sharpe, tried, spec_hash, cast(row_number() OVER (ORDER BY tried, spec_hash) AS INTEGER) AS trial FROM f")
def trial_ledger(s, d):
    return validation.trial_ledger(market.table(s, d, "customer").select(F.concat(F.lit("spec"), (F.col("c_custkey") % 40).cast("string")).alias("spec"), F.col("c_acctbal").alias("sharpe"), F.col("c_custkey").alias("at"))).withColumnRenamed("at", "tried")


@_query(f"WITH {PANEL}, r AS (SELECT session, 'momentum' AS model, {CORR.format(x='f1', y='label')} AS ic FROM panel GROUP BY 1 UNION ALL SELECT session, 'composite', {CORR.format(x='f2', y='label')} FROM panel GROUP BY 1), m AS (SELECT model, avg(ic) AS mean FROM r WHERE ic IS NOT NULL GROUP BY 1) SELECT CASE WHEN max(mean) > max(mean) FILTER (model = 'composite') + 0.005 THEN arg_max(model, mean) ELSE 'composite' END AS champion, round(max(mean), 6) + 0.0 AS top, round(max(mean) FILTER (model = 'composite'), 6) + 0.0 AS base FROM m HAVING count(*) > 0")
def champion_model(s, d):
    p = _panel(s, d)
    r = p.groupBy("session").agg(xs.safe_corr("f1", "label").alias("momentum"), xs.safe_corr("f2", "label").alias("composite")).unpivot("session", ["momentum", "composite"], "model", "ic").filter("ic IS NOT NULL")
    return _rounded(learning.champion(r.groupBy("model").agg(F.avg("ic").alias("mean"))).filter("top IS NOT NULL"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_research_momentum(spark, sf_dir)


def _load() -> None:
    from . import studies  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
