"""Registered queries of whole studies: portfolio construction, risk, models, validation, ingestion; each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import (
    BARS, BARS_ALL, CAL, CAPS, CORR, ENDS, FILLS, IC, MEMBERS, MOM12W, PANEL, RANK_SQL, RET, SECTION, SECTORS, SPLITS, TOPK, WIDE, Z_SQL, _at, _bars, _chosen, _fwd, _lag_factor, _members, _pairs,
    _SQL, _boosted_sql, _bootstrap_sql, _kept_bars, _query, _returns, _rounded, _section, _series, _split_rows, verify_series,
)
from .operators import backtest, evaluation, factors, learning, ledger, performance, pit, portfolio, universe, validation
from .plans import registry
from .sources import ingest, market, store
from .streaming import fills as stream

# ---- sections, universes, partitions -------------------------------------------------------------------------------------------

ODD = SECTION + ", odd AS (SELECT session, inst, CASE WHEN cast(value AS BIGINT) % 7 = 0 THEN NULL WHEN cast(value AS BIGINT) % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM sec)"


def _odd(s, d):
    v = F.col("value").cast("long")
    return _section(s, d).withColumn("value", F.when(v % 7 == 0, None).when(v % 5 == 0, float("nan")).otherwise(F.col("value")))


@_query(f"WITH {ODD} SELECT session, inst, CASE WHEN NOT isnan(value) THEN value END AS value, CASE WHEN value IS NULL THEN 'insufficient_history' WHEN isnan(value) THEN 'out_of_range' END AS reason FROM odd")
def factor_partition(s, d):
    return universe.partition_valid(_odd(s, d))


SNAP = ODD + ", have AS (SELECT session, inst, CASE WHEN NOT isnan(value) THEN value END AS value FROM odd)"


@_query(f"WITH {SNAP} SELECT p.session, p.inst, h.value, CASE WHEN h.inst IS NULL THEN 'not_in_universe' WHEN h.value IS NULL THEN 'insufficient_history' END AS reason FROM spine p LEFT JOIN have h ON h.session = p.session AND h.inst = p.inst")
def factor_snapshot(s, d):
    return universe.snapshot(universe.partition_valid(_odd(s, d)), _at(_bars(s, d)))


@_query(f"WITH {SNAP} SELECT session, count(*) AS names, count(value) AS valid, round(count(value) / count(*), 6) AS coverage FROM have GROUP BY 1")
def coverage_breadth(s, d):
    return _rounded(evaluation.coverage(universe.partition_valid(_odd(s, d))))


@_query(f"WITH {ENDS} SELECT session, max(session + days) AS as_of FROM ends, (SELECT unnest([1, 3]) AS days) GROUP BY 1")
def composite_availability(s, d):
    at = pit.month_ends(_bars(s, d))
    parts = at.select("session", F.lit("price").alias("factor"), F.date_add("session", 1).alias("as_of")).unionByName(at.select("session", F.lit("filing"), F.date_add("session", 3)).toDF("session", "factor", "as_of"))
    return evaluation.availability(parts)


@_query(f"WITH {BARS} SELECT * FROM bars WHERE session BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'")
def session_slice(s, d):
    return universe.between(_bars(s, d), "1996-03-01", "1997-02-28")


QUARTERS = "parts AS (SELECT 'q' || i AS part, DATE '1995-01-01' + cast(i * 90 AS INTEGER) AS start, DATE '1995-01-01' + cast(i * 90 + CASE WHEN i % 4 = 0 THEN 100 ELSE 80 END AS INTEGER) AS stop FROM (SELECT s_suppkey AS i FROM supplier))"


def _quarters(s, d):
    """A time partition of each supplier."""
    i = F.col("s_suppkey").cast("int")
    return market.table(s, d, "supplier").select(F.concat(F.lit("q"), i.cast("string")).alias("part"), F.date_add(F.lit("1995-01-01").cast("date"), i * 90).alias("start"), F.date_add(F.lit("1995-01-01").cast("date"), i * 90 + F.when(i % 4 == 0, 100).otherwise(80)).alias("end"), F.lit(1).alias("scheme"))


@_query(f"WITH {QUARTERS} SELECT part, next_part FROM (SELECT *, lead(part) OVER (ORDER BY start, part) AS next_part, lead(start) OVER (ORDER BY start, part) AS next_start FROM parts) WHERE stop >= next_start OR start > stop")
def partition_overlap(s, d):
    return universe.partition_overlaps(_quarters(s, d), "scheme").select("part", "next_part")


@_query(f"WITH {CAL}, {QUARTERS} SELECT session, CASE WHEN stop >= session THEN part END AS part FROM cal ASOF LEFT JOIN parts ON session >= start")
def partition_members(s, d):
    cal = pit.sessions(_bars(s, d)).select("session", F.lit(1).alias("scheme"))
    return universe.in_partitions(cal, _quarters(s, d), "scheme").select("session", "part")


RAWPX = "rawpx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate AS DATE) AS session, CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE l_extendedprice END AS open, l_extendedprice * CASE WHEN l_orderkey % 11 = 0 THEN 0.5 ELSE 1.1 END AS high, l_extendedprice * 0.9 AS low, l_extendedprice * CASE WHEN l_orderkey % 13 = 0 THEN -1 ELSE 1 END AS close, l_quantity * CASE WHEN l_orderkey % 17 = 0 THEN -1 ELSE 1 END AS volume FROM lineitem)"


@_query(f"""WITH {RAWPX}, q AS (SELECT CASE WHEN open IS NULL THEN 'missing' WHEN least(open, high, low, close) <= 0 THEN 'price' WHEN volume < 0 THEN 'volume' WHEN high < greatest(open, high, low, close) OR low > least(open, high, low, close) THEN 'ohlc' WHEN isodow(session) > 5 THEN 'weekend' END AS fault FROM rawpx)
  SELECT fault, count(*) AS n FROM q GROUP BY 1""")
def bars_quarantine(s, d):
    k, p = F.col("l_orderkey"), F.col("l_extendedprice")
    li = market.table(s, d, "lineitem")
    raw = li.select(F.to_date("l_shipdate").alias("session"), F.when(F.col("l_linenumber") % 7 != 3, p).alias("open"), (p * F.when(k % 11 == 0, 0.5).otherwise(1.1)).alias("high"), (p * 0.9).alias("low"), (p * F.when(k % 13 == 0, -1).otherwise(1)).alias("close"), (F.col("l_quantity") * F.when(k % 17 == 0, -1).otherwise(1)).alias("volume"))
    return universe.quarantine(raw).groupBy("fault").agg(F.count("*").alias("n"))


ROBUST = SECTION + ", sw AS (SELECT *, list_sort(list(value) OVER (PARTITION BY session)) AS srt, count(*) OVER (PARTITION BY session) AS n FROM sec), wz AS (SELECT session, inst, CASE WHEN n < 3 THEN value ELSE greatest(least(value, srt[cast(ceil(0.99 * (n - 1)) AS INTEGER) + 1]), srt[cast(floor(0.01 * (n - 1)) AS INTEGER) + 1]) END AS value FROM sw), m AS (SELECT *, median(value) OVER (PARTITION BY session) AS md FROM wz), q AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY session) AS mad FROM m)"


@_query(f"WITH {ROBUST} SELECT session, inst, round(-(CASE WHEN 1.4826 * mad < 1e-12 THEN {Z_SQL.format(x='value')} ELSE (value - md) / (1.4826 * mad) END), 6) + 0.0 AS v FROM q WINDOW p AS (PARTITION BY session)")
def transform_robust(s, d):
    return _rounded(evaluation.transform(_section(s, d), -1, robust=True).select("session", "inst", F.col("value").alias("v")))


# ---- construction and risk ------------------------------------------------------------------------------------------------------

BOOK = SECTION + f", {MEMBERS}, pool AS (SELECT sec.* FROM sec JOIN members USING (inst) WHERE type = 'equity'), pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY value DESC, inst) AS rank FROM pool) WHERE rank <= 6), bk0 AS MATERIALIZED (SELECT *, round(round_even(0.99 / n, 6) + CASE WHEN rank = 1 THEN 0.99 - round_even(0.99 / n, 6) * n ELSE 0 END, 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM pk))"


def _book(s, d) -> DataFrame:
    sec = _section(s, d)
    pool = sec.select("session", "inst").join(_members(s, d).filter("type = 'equity'").select("inst"), "inst")
    return portfolio.construct(sec, pool, 6, 10)


@_query(f"WITH {BOOK} SELECT session, inst, cast(rank AS INTEGER) AS rank, 'top_k_entry' AS reason, round(weight, 6) AS weight FROM bk0")
def construct_portfolio(s, d):
    return _rounded(_book(s, d))


NAME, SECTOR, UNKNOWN, ROUNDS = 0.19, 0.30, 0.10, 10


def _rounds_sql() -> str:
    out = "r0 AS MATERIALIZED (SELECT b.session, b.inst, CASE WHEN cast(split_part(substr(b.inst, 7), '.', 1) AS INTEGER) % 4 <> 0 THEN sector END AS sector, weight FROM bk0 b JOIN sectors USING (inst))"
    for i in range(ROUNDS):
        out += f""", n{i} AS (SELECT session, inst, sector, least(weight, {NAME}) AS weight FROM r{i}), t{i} AS (SELECT *, sum(weight) OVER (PARTITION BY session, coalesce(sector, 'UNKNOWN')) AS t, CASE WHEN sector IS NULL THEN {UNKNOWN} ELSE {SECTOR} END AS lim FROM n{i}),
 s{i} AS (SELECT session, inst, sector, CASE WHEN t > lim THEN round_even(weight * lim / t, 6) ELSE weight END AS weight FROM t{i}), r{i + 1} AS MATERIALIZED (SELECT session, inst, sector, CASE WHEN t > 0.99 THEN round_even(weight * 0.99 / t, 6) ELSE weight END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY session) AS t FROM s{i}))"""
    moved = ", ".join(f"m{i} AS (SELECT a.session, max(abs(a.weight - b.weight)) < 1e-9 AS still FROM r{i} a JOIN r{i + 1} b ON a.session = b.session AND a.inst = b.inst GROUP BY 1)" for i in range(ROUNDS))
    return f"{out}, {moved}, st AS MATERIALIZED (SELECT m0.session, CASE WHEN m0.still THEN 'PASS' WHEN {' OR '.join(f'm{i}.still' for i in range(1, ROUNDS))} THEN 'ADJUST' ELSE 'REJECT' END AS status FROM m0 {' '.join(f'JOIN m{i} ON m{i}.session = m0.session' for i in range(1, ROUNDS))})"


RISK = f"{BOOK}, {SECTORS}, {_rounds_sql()}"


def _risk(s, d):
    w = _book(s, d).join(market.sectors(s, d), "inst").withColumn("sector", F.when(F.regexp_extract("inst", r"#(\d+)", 1).cast("int") % 4 != 0, F.col("sector")))
    return portfolio.apply_risk(w, name=NAME, sector=SECTOR, unknown=UNKNOWN)


@_query(f"WITH {RISK} SELECT b.session, b.inst, round(CASE WHEN status = 'REJECT' THEN b.weight ELSE r.weight END, 4) AS weight, status FROM r0 b JOIN r{ROUNDS} r ON r.session = b.session AND r.inst = b.inst JOIN st ON st.session = b.session")
def risk_weights(s, d):
    return _rounded(_risk(s, d).select("session", "inst", "weight", "status"), 4)


@_query(f"WITH {RISK} SELECT status, count(*) AS sections FROM st GROUP BY 1")
def risk_status(s, d):
    return _risk(s, d).select("session", "status").distinct().groupBy("status").agg(F.count("*").alias("sections"))


ORD = TOPK + ", ords AS (SELECT session, inst, CASE WHEN rank % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, cast(rank * 7 AS BIGINT) AS shares FROM pick)"


def _orders(s, d):
    r = F.col("rank")
    return _chosen(s, d).select("session", "inst", F.when(r % 3 == 0, "SELL").otherwise("BUY").alias("side"), (r * 7).cast("long").alias("shares"))


@_query(f"WITH {ORD} SELECT session, inst, side, shares, cast(row_number() OVER (PARTITION BY session ORDER BY side = 'BUY', inst) AS INTEGER) AS seq FROM ords")
def order_sequence(s, d):
    return portfolio.sequenced(_orders(s, d))


@_query(f"""WITH {ORD}, j AS (SELECT o.*, CASE WHEN cast(split_part(substr(o.inst, 7), '.', 1) AS INTEGER) % 5 <> 0 THEN b.open END AS open, cast(floor(b.volume * 0.5) AS BIGINT) AS most FROM ords o LEFT JOIN bars b ON b.session = o.session AND b.inst = o.inst),
  k AS (SELECT *, CASE WHEN open > 0 THEN least(shares, greatest(most, 0)) ELSE 0 END AS filled, CASE WHEN open > 0 THEN round_even(open, 4) END AS ref FROM j), p AS (SELECT *, round_even(ref * 5.0 / 1e4, 4) AS slip FROM k)
  SELECT session, inst, side, shares, cast(filled AS BIGINT) AS filled, round(CASE WHEN filled > 0 THEN CASE side WHEN 'BUY' THEN ref + slip ELSE ref - slip END END + 1e-6, 3) AS price, round(CASE WHEN filled > 0 THEN filled * 0.01 END, 2) AS commission, CASE WHEN ref IS NULL THEN 'REJECTED' WHEN filled = 0 THEN 'SUBMITTED' WHEN filled < shares THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS state FROM p""")
def broker_fills(s, d):
    b = _bars(s, d).withColumn("open", F.when(F.regexp_extract("inst", r"#(\d+)", 1).cast("int") % 5 != 0, F.col("open")))
    out = ledger.fill_orders(_orders(s, d), b, per_share=0.01, participation=0.5)
    return out.withColumns({"price": F.round(F.col("price") + 1e-6, 3), "commission": F.round("commission", 2)})


@_query(f"""WITH {FILLS}, o AS (SELECT inst AS account, fill_id, side, qty, CASE WHEN fill_id % 9 = 0 THEN 100.0 ELSE price END AS px FROM fills), f AS (SELECT *, CASE side WHEN 'BUY' THEN 1.0 ELSE -1.0 END AS sg FROM o)
  SELECT account, count(*) AS orders, round(round(1000000.00303 - sum(sg * round(px * (1 + sg * 5.0 / 1e4), 4) * qty) - count(*), 2), 0) AS cash, round(round(1000000.00303 - sum(sg * round(px * (1 + sg * 5.0 / 1e4), 4) * qty) - count(*) + sum(sg * qty * px), 2), 0) AS equity FROM f GROUP BY 1""")
def mock_broker(s, d):
    f = market.event_fills(s, d)
    o = f.select(F.col("inst").alias("account"), "side", F.col("qty").alias("shares"), F.when(F.col("fill_id") % 9 != 0, F.col("price")).alias("price"))
    return _rounded(ledger.paper_accounts(o, 1_000_000.00303), 0)  # the odd cash settles ties


def paper_forward(days: DataFrame, names: int = 30, shares: int = 10) -> DataFrame:
    """A forward run on paper: on every weekday of days (session) some shares of each name are bought at a constant price from a mock broker."""
    days = days.filter(F.weekday("session") < 5)
    orders = days.select("session", F.explode(F.sequence(F.lit(1), F.lit(names))).alias("inst"), F.lit("paper").alias("account"), F.lit("BUY").alias("side"), F.lit(shares).cast("long").alias("shares"), F.lit(100.0).alias("price"))
    total = ledger.paper_accounts(orders, commission=0.0)
    return total.crossJoin(F.broadcast(days.agg(F.count("*").alias("sessions")))).select("account", "sessions", "orders", "cash", "equity")  # one row each


@_query("WITH w AS (SELECT count(DISTINCT cast(o_orderdate AS DATE)) AS n FROM orders WHERE isodow(o_orderdate) <= 5) SELECT 'paper' AS account, n AS sessions, n * 30 AS orders, round(1000000 - n * 300 * 100.05, 2) AS cash, round(1000000 - n * 300 * 0.05, 2) AS equity FROM w")
def paper_cycle(s, d):
    """On the days that have orders."""
    return paper_forward(market.table(s, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct())


@_query(f"""WITH {FILLS}, t AS (SELECT inst AS account, sum(qty * price) AS traded FROM fills GROUP BY 1), e AS (SELECT inst AS account, avg(100000 + price) AS mean, count(*) AS n FROM fills GROUP BY 1)
  SELECT account, round(CASE WHEN n < 2 THEN 0 ELSE traded / mean / (n / 252.0) END, 6) AS turnover FROM t JOIN e USING (account)""")
def annual_turnover(s, d):
    f = market.event_fills(s, d).withColumnRenamed("inst", "account")
    return _rounded(ledger.annual_turnover(f, f.select("account", (F.lit(100000.0) + F.col("price")).alias("equity"))))


@_query(f"WITH {BARS}, l AS (SELECT inst, close * cast(split_part(substr(inst, 7), '.', 1) AS INTEGER) AS value FROM bars WHERE session = (SELECT max(session) FROM bars)) SELECT inst, round(value / (sum(value) OVER () + 1000), 6) AS weight FROM l")
def terminal_weights(s, d):
    b = _kept_bars(s, d).select("session", "inst", (F.col("close") * F.regexp_extract("inst", r"#(\d+)", 1).cast("int")).alias("value"))
    return _rounded(ledger.terminal_weights(b, 1000.0))


@_query(f"WITH {BARS} SELECT inst, count(*) AS sessions, sha256(string_agg(session || ':' || printf('%.2f', close), ',' ORDER BY session || ':' || printf('%.2f', close))) AS hash FROM (SELECT inst, session, round(close * 4) / 4 AS close FROM bars) GROUP BY 1")
def result_hash(s, d):
    return performance.result_hash(_bars(s, d).select("inst", "session", (F.round(F.col("close") * 4) / 4).alias("equity")), "inst")


# ---- models ------------------------------------------------------------------------------------------------------------------------

FOUR = f"""panel4 AS MATERIALIZED (SELECT session, inst, coalesce(a.value, 0.0) AS momentum_12_1, coalesce(b.value, 0.0) AS momentum_6_1, coalesce(c.value, 0.0) AS rank_volume, coalesce(e.value, 0.0) AS spread
 FROM (WITH {MOM12W} SELECT session, inst, value FROM scores) a JOIN (WITH {ENDS} {_lag_factor(21, 126, 250)} SELECT session, inst, value FROM scores) b USING (session, inst)
 JOIN (WITH {SECTION} SELECT session, inst, value FROM sec) c USING (session, inst) JOIN (WITH {ENDS} SELECT session, inst, high - low AS value FROM bars JOIN ends USING (session)) e USING (session, inst))"""


def _four(s, d):
    b = _bars(s, d)
    ends = b.join(pit.month_ends(b), "session")
    return {"momentum_12_1": factors.momentum(b, _at(b), days=WIDE), "momentum_6_1": registry.compute("momentum_6_1", b, _at(b)), "rank_volume": _section(s, d), "spread": ends.select("session", "inst", (F.col("high") - F.col("low")).alias("value"))}


LAB = f"lab AS (SELECT session, inst, ({RANK_SQL.format(k='session', x='ret')} - 1) / (n - 1) - 0.5 AS label FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM fwd) WHERE n >= 3)"


@_query(f"WITH {CAL} {_fwd('21')}, {LAB}, {FOUR} SELECT p.session, p.inst, round(momentum_12_1, 6) + 0.0 AS momentum_12_1, round(momentum_6_1, 6) + 0.0 AS momentum_6_1, rank_volume, round(spread, 6) + 0.0 AS spread, round(label, 6) + 0.0 AS label FROM panel4 p LEFT JOIN lab l ON l.session = p.session AND l.inst = p.inst")
def ml_panel(s, d):
    return _rounded(learning.assemble(_four(s, d), evaluation.rank_label(_returns(s, d))))


COMP = PANEL + SPLITS + f", cz AS (SELECT fold, session, inst, label, {Z_SQL.format(x='f1')} AS z1, {Z_SQL.format(x='f2')} AS z2 FROM fr WHERE part = 'test' WINDOW p AS (PARTITION BY fold, session)), cp AS MATERIALIZED (SELECT 'composite' AS model, session, inst, (z1 + z2) / 2 AS prediction, label FROM cz)"


def _composite_oos(s, d):
    return learning.composite_predictions(_split_rows(s, d), ["f1", "f2"]).withColumn("model", F.lit("composite"))


@_query(f"WITH {COMP} SELECT session, inst, round(prediction, 6) + 0.0 AS prediction, round(label, 6) + 0.0 AS label FROM cp")
def composite_oos(s, d):
    return _rounded(_composite_oos(s, d).select("session", "inst", "prediction", "label"))


QUINT = COMP + ", qn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY prediction, inst) - 1 AS pos, count(*) OVER (PARTITION BY session) AS n FROM cp), qb AS MATERIALIZED (SELECT b.bucket, coalesce(avg(label), 0.0) AS label FROM (SELECT DISTINCT bucket FROM cp, range(0, 5) AS g(bucket)) b LEFT JOIN (SELECT *, least(4, pos * 5 // n) AS bucket FROM qn WHERE n >= 5) q ON q.bucket = b.bucket GROUP BY 1)"


@_query(f"WITH {QUINT} SELECT cast(bucket AS INTEGER) AS bucket, round(label, 6) + 0.0 AS label FROM qb")
def ml_quintiles(s, d):
    return _rounded(evaluation.quintiles(_composite_oos(s, d)).select("bucket", "label"))


REPORT = QUINT + f", pr AS (SELECT *, {RANK_SQL.format(k='session', x='prediction')} AS rx, {RANK_SQL.format(k='session', x='label')} AS ry FROM cp), pi AS (SELECT session, count(*) AS n, coalesce({CORR.format(x='rx', y='ry')}, 0.0) AS ic FROM pr GROUP BY 1), g AS (SELECT count(*) AS n, avg(ic) AS mean, coalesce(stddev_samp(ic), 0.0) AS sd FROM pi WHERE n >= 3 HAVING count(*) > 0), sp AS (SELECT max(label) FILTER (bucket = 4) - max(label) FILTER (bucket = 0) AS spread, min(step) >= 0 AS monotonic FROM (SELECT *, label - lag(label) OVER (ORDER BY bucket) AS step FROM qb))"


@_query(f"WITH {REPORT} SELECT n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(CASE WHEN sd > 1e-9 THEN mean / sd ELSE 0 END * sqrt(n), 6) + 0.0 AS t, round(spread, 6) + 0.0 AS spread, monotonic FROM g, sp")
def ml_report(s, d):
    return _rounded(evaluation.model_reports(_composite_oos(s, d)).select("n", "mean", "sd", "t", "spread", "monotonic"))


def _report_sql(predictions: str) -> str:
    """From predictions (model, session, inst, prediction, label) to a report of each model and the champion, as common tables."""
    return f""", mr AS (SELECT *, {RANK_SQL.format(k='model, session', x='prediction')} AS rx, {RANK_SQL.format(k='model, session', x='label')} AS ry FROM {predictions}),
 mi AS (SELECT model, session, count(*) AS n, coalesce({CORR.format(x='rx', y='ry')}, 0.0) AS ic FROM mr GROUP BY 1, 2), mg AS (SELECT model, count(*) AS n, avg(ic) AS mean, coalesce(stddev_samp(ic), 0.0) AS sd FROM mi WHERE n >= 3 GROUP BY 1),
 mq AS (SELECT *, row_number() OVER (PARTITION BY model, session ORDER BY prediction, inst) - 1 AS pos, count(*) OVER (PARTITION BY model, session) AS n FROM {predictions}),
 mb AS (SELECT b.model, b.bucket, coalesce(avg(label), 0.0) AS label FROM (SELECT DISTINCT model, bucket FROM {predictions}, range(0, 5) AS g(bucket)) b LEFT JOIN (SELECT *, least(4, pos * 5 // n) AS bucket FROM mq WHERE n >= 5) q ON q.model = b.model AND q.bucket = b.bucket GROUP BY 1, 2),
 ms AS (SELECT model, max(label) FILTER (bucket = 4) - max(label) FILTER (bucket = 0) AS spread, min(step) >= 0 AS monotonic FROM (SELECT *, label - lag(label) OVER (PARTITION BY model ORDER BY bucket) AS step FROM mb) GROUP BY 1),
 mc AS (SELECT CASE WHEN max(mean) > max(mean) FILTER (model = 'composite') + 0.005 THEN max_by(model, mean) ELSE 'composite' END AS champion FROM mg)"""


MODELS = COMP + _boosted_sql() + f""", rp AS (SELECT fold, session, inst, prediction, label FROM ({_SQL["ridge_oos"]})), every AS MATERIALIZED (SELECT model, session, inst, round(prediction, 6) AS prediction, label FROM cp UNION ALL SELECT 'ridge', session, inst, prediction, label FROM rp
 UNION ALL SELECT 'gbdt', session, inst, round(pred, 6), label FROM boosted WHERE part = 'test')""" + _report_sql("every")


@_query(f"""WITH {MODELS} SELECT model, n, round(mean, 5) + 0.0 AS mean, round(sd, 5) + 0.0 AS sd, round(CASE WHEN sd > 1e-9 THEN mean / sd ELSE 0 END, 5) + 0.0 AS ir, round(CASE WHEN sd > 1e-9 THEN mean / sd ELSE 0 END * sqrt(12.0), 5) + 0.0 AS ir_annual,
  round(CASE WHEN sd > 1e-9 THEN mean / sd ELSE 0 END * sqrt(n), 5) + 0.0 AS t, round(spread, 5) + 0.0 AS spread, monotonic, champion FROM mg JOIN ms USING (model), mc""")
def model_comparison(s, d):
    """Reports of all models on the same test rows; predictions to 6 places, so that ranks don't hang on last digits."""
    every = learning.compare(_split_rows(s, d), ["f1", "f2"]).withColumn("prediction", F.round("prediction", 6))
    reports = evaluation.model_reports(store.kept(every, "predictions"))  # three readers follow, of whom two rank
    return _rounded(reports.crossJoin(F.broadcast(learning.champion(reports.select("model", "mean")).select("champion"))), 5)  # a row a model


# ---- validation ----------------------------------------------------------------------------------------------------------------------

U = "((cast('0x' || substr(md5(inst || '|' || session || '|{seed}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"
U1, U2 = U.replace("inst || '|' || session", "session || '|' || inst").format(seed=42), U.replace("inst || '|' || session", "session || '|' || inst").format(seed=43)
NOISE = ENDS + f", noise AS MATERIALIZED (SELECT session, inst, sqrt(-2.0 * ln({U1})) * cos(2 * pi() * {U2}) AS value FROM spine)"


@_query(f"WITH {NOISE} SELECT session, inst, round(value, 6) + 0.0 AS value FROM noise")
def noise_control(s, d):
    return _rounded(validation.noise_factor(_at(_bars(s, d))))


@_query(f"""WITH {NOISE} {_fwd('21')}, np AS (SELECT n.session, n.inst, n.value, f.ret FROM noise n JOIN fwd f ON f.session = n.session AND f.inst = n.inst), nr AS (SELECT *, {RANK_SQL.format(k='session', x='value')} AS rx, {RANK_SQL.format(k='session', x='ret')} AS ry FROM np),
  ni AS (SELECT session, {CORR.format(x='rx', y='ry')} AS ic FROM nr GROUP BY 1) SELECT count(*) AS n, round(avg(ic), 6) + 0.0 AS mean, round(coalesce(stddev_samp(ic), 0), 6) AS sd FROM ni WHERE ic IS NOT NULL""")
def noise_ic(s, d):
    c = evaluation.ic_series(evaluation.joined(validation.noise_factor(_at(_bars(s, d))), _returns(s, d)), ("session",))
    return _rounded(c.agg(F.count("*").alias("n"), F.avg("rank_ic").alias("mean"), F.coalesce(F.stddev_samp("rank_ic"), F.lit(0.0)).alias("sd")))


@_query(f"""WITH {IC}, dd AS (SELECT session, inst, value, ret, row_number() OVER (PARTITION BY session ORDER BY inst) AS a, row_number() OVER (PARTITION BY session ORDER BY md5(inst || '|' || session || '|42'), inst) AS b FROM pairs),
  dl AS (SELECT x.session, x.value, y.ret FROM dd x JOIN dd y ON x.session = y.session AND x.a = y.b), rs AS (SELECT *, {RANK_SQL.format(k='session', x='value')} AS rx, {RANK_SQL.format(k='session', x='ret')} AS ry FROM dl)
  SELECT session, round(CASE WHEN n < 5 THEN 0.0 ELSE c END, 6) + 0.0 AS rank_ic FROM (SELECT session, count(*) AS n, {CORR.format(x='rx', y='ry')} AS c, {CORR.format(x='value', y='ret')} AS v FROM rs GROUP BY 1) WHERE v IS NOT NULL""")
def shuffle_control(s, d):
    return _rounded(validation.shuffled_ic(_pairs(s, d)))


ABL = f"""{BARS}, {SECTORS}, om AS (SELECT 'all' AS omitted UNION ALL SELECT DISTINCT sector FROM sectors), ix AS (SELECT omitted, session, avg(close) AS e FROM bars JOIN sectors USING (inst) JOIN om ON omitted <> sector GROUP BY 1, 2), rr AS (SELECT *, e / lag(e) OVER (PARTITION BY omitted ORDER BY session) - 1 AS ret FROM ix),
 g AS (SELECT omitted, count(ret) AS n, first(e ORDER BY session) AS e0, last(e ORDER BY session) AS e1, coalesce(stddev_samp(ret), 0) AS sd FROM rr GROUP BY 1), k AS (SELECT omitted, pow(e1 / e0, 252.0 / n) - 1 AS cagr, sd * sqrt(252.0) AS vol FROM g WHERE n >= 2), a AS (SELECT omitted, cagr, CASE WHEN vol > 1e-12 THEN cagr / vol ELSE 0 END AS sharpe FROM k)"""


@_query(f"WITH {ABL} SELECT omitted, round(sharpe, 6) + 0.0 AS sharpe, round(cagr, 6) + 0.0 AS cagr, round((SELECT sharpe FROM a WHERE omitted = 'all') - sharpe, 4) + 0.0 AS marginal FROM a WHERE omitted <> 'all'")
def ablation_sectors(s, d, b=None):
    """The equal-weight index without each sector in turn, measured against the whole."""
    priced = (_bars(s, d) if b is None else b).join(market.sectors(s, d), "inst")
    index = validation.without_each(priced, "sector").withColumnRenamed("omitted", "inst")
    m = performance.metrics(index).select(F.col("inst").alias("omitted"), "sharpe", "cagr")
    return _rounded(validation.ablation(m))


@_query("""WITH c AS (SELECT s_suppkey AS id, 'STRAT' || (s_suppkey % 5) AS strategy, '{"band": ' || (s_suppkey % 3) || ', "k": ' || (s_suppkey % 4 * 10) || ', "region": "R' || (s_suppkey % 2) || '"}' AS cfg FROM supplier) SELECT id, sha256(cfg) AS config_hash, 'CAND-' || strategy || '-' || substr(sha256(cfg), 1, 10) AS candidate_id FROM c""")
def candidate_freeze(s, d):
    k = F.col("s_suppkey")
    c = market.table(s, d, "supplier").select(k.alias("id"), F.concat(F.lit("STRAT"), (k % 5).cast("string")).alias("strategy"), (k % 3).alias("band"), (k % 4 * 10).alias("k"), F.concat(F.lit("R"), (k % 2).cast("string")).alias("region"))
    return validation.freeze(c, "strategy", ["band", "k", "region"]).select("id", "config_hash", "candidate_id")


@_query("SELECT user_id % 50 AS candidate, event_type AS part, first(user_id ORDER BY ts, user_id) AS actor, cast(floor(epoch(min(ts))) AS BIGINT) AS at_second, count(*) AS asked FROM events GROUP BY 1, 2")
def holdout_ledger(s, d):
    log = market.table(s, d, "events").select((F.col("user_id") % 50).alias("candidate"), F.col("event_type").alias("part"), F.col("user_id").alias("actor"), F.col("ts").alias("at"))
    return validation.first_access(log).withColumn("at_second", F.unix_timestamp(F.col("at").cast("timestamp"))).drop("at")


DIAG = f"""{RET}, mo AS (SELECT inst, count(ret) AS n, avg(ret) AS mean, coalesce(stddev_samp(ret), 0) AS sd FROM rt WHERE ret IS NOT NULL GROUP BY 1), m4 AS (SELECT inst, mo.n, mo.mean, sd, CASE WHEN mo.n >= 4 AND sd > 0 THEN sum(pow((ret - mean) / sd, 3)) / mo.n ELSE 0 END AS skew, CASE WHEN mo.n >= 4 AND sd > 0 THEN sum(pow((ret - mean) / sd, 4)) / mo.n ELSE 3 END AS kurtosis FROM rt JOIN mo USING (inst) WHERE ret IS NOT NULL GROUP BY 1, 2, 3, 4),
 tr AS (SELECT inst, CASE WHEN sd > 1e-12 THEN mean / sd ELSE 0 END * sqrt(252.0) AS sharpe FROM m4), tv AS (SELECT count(*) AS trials, CASE WHEN count(*) < 2 OR coalesce(var_samp(sharpe), 0) < 1e-4 THEN 0.25 ELSE var_samp(sharpe) END AS variance FROM tr),
 q0 AS (SELECT *, sqrt(-2.0 * ln(least(1.0 / trials, 1 - 1.0 / trials))) AS qa, sqrt(-2.0 * ln(least(1 / (trials * exp(1.0)), 1 - 1 / (trials * exp(1.0))))) AS qb FROM tv),
 q1 AS (SELECT *, qa - (2.515517 + 0.802853 * qa + 0.010328 * qa * qa) / (1 + 1.432788 * qa + 0.189269 * qa * qa + 0.001308 * qa * qa * qa) AS xa, qb - (2.515517 + 0.802853 * qb + 0.010328 * qb * qb) / (1 + 1.432788 * qb + 0.189269 * qb * qb + 0.001308 * qb * qb * qb) AS xb FROM q0),
 dg AS MATERIALIZED (SELECT inst, n, mean, sd, skew, kurtosis, trials, variance, CASE WHEN sd > 1e-12 THEN mean / sd ELSE 0 END AS sr, CASE WHEN trials <= 1 THEN 0 ELSE (0.4227843350984671 * xa + 0.5772156649015329 * xb) * sqrt(variance) END AS em FROM m4, q1),
 ds AS MATERIALIZED (SELECT *, CASE WHEN n < 5 THEN 0.0 ELSE (sr - em) / sqrt(greatest(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, 1e-6) / (n - 1)) END AS score FROM dg)"""


def _diagnosed(s, d, b=None):
    m = performance.moments(performance.daily_returns(_series(s, d, b)).filter("ret IS NOT NULL"), "ret", "inst").withColumnRenamed("inst", "id")
    trials = m.select((F.when(F.col("sd") > 1e-12, F.try_divide("mean", "sd")).otherwise(0.0) * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return validation.trial_diagnostics(m, trials)


@_query(f"WITH {DIAG} SELECT inst AS id, trials, round(variance, 5) AS variance, round(sr, 6) + 0.0 AS sharpe, round(sr * sqrt(252.0), 5) + 0.0 AS sharpe_annual, round(skew, 5) + 0.0 AS skew, round(kurtosis - 3, 4) + 0.0 AS excess, round(em, 5) AS expected_max, round(score, 4) + 0.0 AS score, score >= 1.6448536269514722 AS significant, trials >= 50 OR trials > 5 AND score < 1.6448536269514722 AS warned FROM ds")
def trial_diagnostics(s, d):
    t = _diagnosed(s, d)
    places = {"variance": 5, "sharpe": 6, "sharpe_annual": 5, "skew": 5, "excess": 4, "expected_max": 5, "score": 4}
    return t.withColumns({c: F.round(c, n) + 0.0 for c, n in places.items()})


def _cases(s, d, b) -> DataFrame:
    """Each brand as a strategy: its own growth, how often its volume turns over, the concentration of the book, its diagnosis."""
    m = performance.metrics(_series(s, d, b)).select(F.col("inst").alias("id"), "cagr")
    moved = b.groupBy(F.col("inst").alias("id")).agg((F.stddev_samp("volume") / F.avg("volume") * 4).alias("turnover"), F.max(F.col("high") < F.col("low")).alias("corrupt"))
    book = portfolio.concentration(_chosen_book(s, d, b)).agg(F.max("hhi").alias("hhi"), F.max("top_sector").alias("top_sector"))
    c = m.join(moved, "id").join(_diagnosed(s, d, b).select("id", "warned"), "id").crossJoin(F.broadcast(book))  # one row of the book
    return c.withColumns({"code": F.lit("c"), "config": F.lit("f"), "lookahead": F.lit(False), "irreproducible": F.lit(False)})


def _chosen_book(s, d, b):
    w = portfolio.equal_weights(_chosen(s, d, b)).join(market.sectors(s, d), "inst")
    return portfolio.cap_sector(portfolio.cap_name(w, 0.08), 0.20)


BOOT = _bootstrap_sql("WITH rets AS (SELECT inst AS id, session, ret FROM rt)", 100)
ABLATED = _SQL["ablation_sectors"]


@_query(f"""WITH {DIAG}, pg AS (SELECT inst, pow(last(equity ORDER BY session) / first(equity ORDER BY session), 252.0 / count(ret)) - 1 AS cagr FROM rt GROUP BY 1 HAVING count(ret) >= 2),
  mv AS (SELECT inst, stddev_samp(volume) / avg(volume) * 4 AS turnover FROM bars GROUP BY 1), bk AS (SELECT max(hhi) AS hhi, max(top_sector) AS top_sector FROM (WITH {CAPS}, r AS (SELECT session, sum(weight * weight) AS hhi FROM cs GROUP BY 1), t AS (SELECT session, max(w) AS top_sector FROM (SELECT session, sector, sum(weight) AS w FROM cs GROUP BY 1, 2) GROUP BY 1) SELECT hhi, top_sector FROM r JOIN t USING (session))),
  cs2 AS (SELECT inst AS id, CASE WHEN cagr <= 0 THEN 0.0 WHEN turnover > 1e-4 THEN least(1000.0, cagr / (turnover * 2) * 1e4) ELSE 1000.0 END < 10 AS fragile, hhi > 0.15 OR top_sector > 0.40 AS conc, trials >= 50 OR trials > 5 AND score < 1.6448536269514722 AS warned FROM ds JOIN pg USING (inst) JOIN mv USING (inst), bk),
  vr AS (SELECT id, CASE WHEN fragile OR conc OR warned THEN 'RESEARCH_ONLY' ELSE 'PAPER_CANDIDATE' END AS verdict, concat_ws(',', CASE WHEN fragile THEN 'cost_fragile' END, CASE WHEN conc THEN 'concentrated' END, CASE WHEN warned THEN 'warned' END) AS reasons FROM cs2),
  hd AS (SELECT inst AS id, equity / lag(equity, 1) OVER (PARTITION BY inst ORDER BY session) - 1 AS h1, equity / lag(equity, 5) OVER (PARTITION BY inst ORDER BY session) - 1 AS h5, equity / lag(equity, 21) OVER (PARTITION BY inst ORDER BY session) - 1 AS h21 FROM rt),
  hr AS (SELECT id, [coalesce(avg(h1) / stddev_samp(h1), 0) * sqrt(252.0 / 1), coalesce(avg(h5) / stddev_samp(h5), 0) * sqrt(252.0 / 5), coalesce(avg(h21) / stddev_samp(h21), 0) * sqrt(252.0 / 21)] AS c FROM hd GROUP BY 1),
  tp AS (SELECT id, CASE WHEN list_max(c) > 1.5 * list_avg(c) AND list_max(c) - list_min(c) > 0.75 THEN 'SPIKE' WHEN list_max(c) - list_min(c) < 0.35 THEN 'PLATEAU' WHEN c[1] <= c[2] AND c[2] <= c[3] OR c[1] >= c[2] AND c[2] >= c[3] THEN 'MONOTONIC' ELSE 'FRAGILE' END AS topology FROM hr),
  ct AS (SELECT inst AS id, round(CASE WHEN cagr <= 0 THEN 0.0 WHEN turnover > 1e-4 THEN least(1000.0, cagr / (turnover * 2) * 1e4) ELSE 1000.0 END, 1) AS break_even, round(cagr - turnover * 20 / 1e4 * 2, 4) + 0.0 AS net_cagr FROM pg JOIN mv USING (inst)),
  bs AS ({BOOT}), ab AS (SELECT max(marginal) AS worst_part FROM ({ABLATED}))
  SELECT vr.*, low, high, topology, break_even, net_cagr, worst_part FROM vr JOIN tp USING (id) JOIN ct USING (id) JOIN bs USING (id), ab""")
def validation_report(s, d):
    """Verdicts with their evidence: bootstrap interval, shape of the surface by holding time, costs, and the sector that carries most."""
    b = _kept_bars(s, d)
    series, cases = _series(s, d, b), store.kept(_cases(s, d, b), "cases")  # a row a name: three readers follow
    returns = performance.daily_returns(series).select(F.col("inst").alias("id"), "session", "ret")
    interval = _rounded(validation.bootstrap_interval(validation.bootstrap_sharpe(returns, 100)), 5).select("id", "low", "high")
    surface = validation.holding_surface(series.withColumnRenamed("inst", "id")).select("id", "topology")
    costs = validation.cost_stress(cases.withColumn("vol", F.lit(0.15)), (20.0,)).select("id", "break_even", (F.col("net_cagr") + 0.0).alias("net_cagr"))
    worst = cases.select("id").crossJoin(F.broadcast(ablation_sectors(s, d, b).agg(F.max("marginal").alias("worst_part"))))  # one row of the study
    out = validation.evaluate(cases, evidence=(interval, surface, costs, worst))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@_query("SELECT * FROM (VALUES ('lookahead', 'REJECTED', 'LOOKAHEAD'), ('random_mining', 'RESEARCH_ONLY', 'warned'), ('cost_illusion', 'RESEARCH_ONLY', 'cost_fragile')) t(id, verdict, reasons)")
def red_team(s, d):
    """The canary's leaks are those that lookahead finds, the noise is drawn on the calendar of the bars."""
    b = _kept_closes(s, d)
    leaks = validation.lookahead(_canary, b, _at(b))
    return validation.evaluate(validation.red_team(pit.sessions(b), leaks)).withColumn("reasons", F.array_join("reasons", ","))


def _kept_closes(s, d) -> DataFrame:
    return store.kept(_bars(s, d).select("inst", "session", "close"), "closes")


def _canary(b: DataFrame, at: DataFrame) -> DataFrame:
    """A factor that peeks: the last close of all history over the session's own."""
    keys = factors.own(b)
    last = b.groupBy(*keys).agg(F.max_by("close", "session").alias("last"))
    own = b.select("session", *keys, "close").join(F.broadcast(at.select("session").distinct()), "session", "left_semi")  # other sessions meet no point; rows of one calendar
    return at.join(own, ["session", *keys], "left").join(last, keys, "left").select("session", "inst", (F.try_divide("last", "close")).alias("value"), F.lit(None).cast("string").alias("reason"))


@_query(f"""WITH {ENDS}, e3 AS (SELECT session FROM ends), own AS (SELECT e3.session, s.inst, b.close FROM e3 JOIN spine s ON s.session = e3.session LEFT JOIN bars b ON b.session = s.session AND b.inst = s.inst)
  SELECT 'canary' AS factor, session, count(*) AS names, count(close) AS leaked FROM own GROUP BY 2 UNION ALL SELECT 'momentum', session, count(*), 0 FROM own GROUP BY 2""")
def lookahead_detected(s, d):
    b = _kept_closes(s, d)
    at = _at(b)
    found = validation.lookahead(_canary, b, at).withColumn("factor", F.lit("canary"))
    sound = validation.lookahead(lambda x, y: factors.momentum(x, y, days=WIDE), b, at, WIDE).withColumn("factor", F.lit("momentum"))
    return found.unionByName(sound).select("factor", "session", "names", "leaked")


@_query(f"SELECT count(*) AS names, round(median(median_error), 6) AS median_error, round(max(worst_error), 6) AS worst_error FROM ({_SQL['verify_series']})")
def verify_summary(s, d):
    return _rounded(pit.series_summary(verify_series(s, d)))


# ---- simulation -----------------------------------------------------------------------------------------------------------------------


def backtest_panel(s, d) -> DataFrame:
    """Bars with sectors, actions, delistings, and the composite of three sleeves, whole and without each."""
    b = market.bars(s, d, issues=False).join(market.sectors(s, d), "inst")
    ends = pit.month_ends(b).withColumn("rebalance", F.lit(True))
    a = market.order_actions(s, d).groupBy("inst", F.col("effective").alias("session")).agg(F.product("ratio").alias("split"), F.sum("cash").alias("dividend"))
    e = b.join(pit.month_ends(b), "session")
    parts = e.select("session", "inst", F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in "abc"]), F.array(F.col("volume"), F.col("close"), F.col("high") - F.col("low")))).alias("factor", "value"))
    panel = b.join(ends, "session", "left").fillna(False, ["rebalance"]).join(a, ["inst", "session"], "left")
    whole = {"a": 0.5, "b": 0.3, "c": 0.2}
    for drop in ("", "a", "b", "c"):
        left = {k: v for k, v in whole.items() if k != drop}
        w = {k: v / sum(left.values()) for k, v in left.items()}
        panel = panel.join(evaluation.composite(parts, w, 0.75).select("session", "inst", F.col("value").alias(f"score{drop}")), ["session", "inst"], "left")
    gone = b.groupBy("inst").agg(F.max("session").alias("session"), F.max_by("close", "session").alias("delisting"), F.count("*").alias("n")).filter(F.regexp_extract("inst", r"#(\d+)", 1).cast("int") % 8 == 3)
    return panel.join(gone.drop("n"), ["inst", "session"], "left")


@_query()
def backtest_ablation(s, d):
    """The study whole, without each sleeve, and with more names or dearer trades: what each variant comes to, with the hash of its curve."""
    rows = [("baseline", "score", 5, 15, 5.0), ("drop-a", "scorea", 5, 15, 5.0), ("drop-b", "scoreb", 5, 15, 5.0), ("drop-c", "scorec", 5, 15, 5.0), ("top-10", "score", 10, 20, 5.0), ("costs", "score", 5, 15, 50.0)]
    v = s.createDataFrame(rows, "variant string, score string, k int, keep_to int, bps double")
    return backtest.outcomes(backtest.simulate(backtest_panel(s, d), v))


# ---- tables kept by key -----------------------------------------------------------------------------------------------------------------


@_query("SELECT inst, status, version FROM (SELECT inst, status, version, row_number() OVER (PARTITION BY inst ORDER BY side DESC, version DESC) AS r FROM (SELECT c_custkey AS inst, 'listed' AS status, 0::BIGINT AS version, 0 AS side FROM customer UNION ALL SELECT o_custkey, o_orderstatus, o_orderkey, 1 FROM orders)) WHERE r = 1")
def instrument_upsert(s, d):
    old = market.table(s, d, "customer").select(F.col("c_custkey").alias("inst"), F.lit("listed").alias("status"), F.lit(0).cast("long").alias("version"))
    new = market.table(s, d, "orders").select(F.col("o_custkey").alias("inst"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("long").alias("version"))
    held = market.symbol_history(s, d)
    apart = held.join(pit.interval_overlaps(held).select("inst", "symbol", "exchange", "valid_from"), ["inst", "symbol", "exchange", "valid_from"], "left_anti")  # what ends before the next begins
    try:
        return ingest.upsert_instruments(old, new, held)
    except ValueError:  # two held a symbol at one time, as they do from some hundred customers on
        return ingest.upsert_instruments(old, new, apart)


@_query("WITH l AS (SELECT user_id AS job, event_id AS k, CASE WHEN event_id % 3 <> 0 THEN event_type END AS status, CASE WHEN event_id % 5 = 0 THEN event_id END AS size FROM events) SELECT job, max_by(status, CASE WHEN status IS NOT NULL THEN k END) AS status, max_by(size, CASE WHEN size IS NOT NULL THEN k END) AS size FROM l GROUP BY 1")
def job_states(s, d):
    e, k = market.table(s, d, "events"), F.col("event_id")
    log = e.select(F.col("user_id").alias("job"), k.alias("k"), F.when(k % 3 != 0, F.col("event_type")).alias("status"), F.when(k % 5 == 0, k).alias("size"))
    return ingest.merged_updates(log, "job", ["k"], ["status", "size"])


@_query("WITH o AS (SELECT o_custkey AS account, o_orderpriority AS inst, count(*) AS shares FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2), n AS (SELECT o_custkey AS account, o_orderpriority AS inst, count(*) AS shares FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0 GROUP BY 1, 2) SELECT * FROM o WHERE account NOT IN (SELECT account FROM n) UNION ALL SELECT * FROM n")
def positions_replace(s, d):
    o = market.table(s, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("inst"), "o_orderkey")
    count = lambda x: x.groupBy("account", "inst").agg(F.count("*").alias("shares"))
    return ingest.replace_groups(count(o.filter("o_orderkey % 2 = 1")), count(o.filter("o_orderkey % 2 = 0 AND account % 3 = 0")), ["account"])


# ---- what is written and read again ---------------------------------------------------------------------------------------------------


@_query(f"WITH {BARS} SELECT inst AS instrument_id, session, close, volume FROM bars WHERE session BETWEEN DATE '1997-11-15' AND DATE '1998-02-15'")
def bars_range(s, d):
    """Bars of two datasets and two semantics, written by partition, one dataset written twice; a range across two years is read."""
    at = store.scratch(s, "bars")
    b = _kept_bars(s, d).withColumnRenamed("inst", "instrument_id")  # written four times
    raw, twice = b.withColumn("semantic", F.lit("raw")), b.withColumns({"close": F.col("close") * 2, "semantic": F.lit("adjusted")})
    for rows, dataset in ((twice, "one"), (twice.withColumn("semantic", F.lit("raw")), "two"), (raw, "one"), (raw, "one")):
        market.write_bars(rows, at, dataset)
    return market.read_bars(s, at, "1997-11-15", "1998-02-15", "raw", "one").select("instrument_id", "session", "close", "volume")


@_query("SELECT 'orders' AS name, count(*) AS rows, TRUE AS verified, 'v10' AS version FROM orders UNION ALL SELECT 'supplier', count(*), TRUE, 'v10' FROM supplier")
def dataset_verified(s, d):
    """Two versions published; the later one, by number and not by letter, is opened, and its tables still match the manifest."""
    at = store.scratch(s, "datasets")
    tables = {n: market.table(s, d, n) for n in ("orders", "supplier")}
    for version in ("v9", "v10"):
        store.publish(s, at, "star", version, tables)
    m = store.inspect(s, at, "star")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x["rows"]).cast("long").alias("rows"), F.lit(m["verified"]).alias("verified"), F.lit(m["version"]).alias("version")) for n, x in sorted(m["tables"].items())])
    return tables["supplier"].limit(1).select(F.inline(rows))


@_query(f"""WITH {BARS_ALL}, px AS (SELECT inst, session, cast(open AS DECIMAL(20, 6)) AS open, cast(high AS DECIMAL(20, 6)) AS high, cast(low AS DECIMAL(20, 6)) AS low, cast(CASE WHEN volume > 60 THEN -close ELSE close END AS DECIMAL(20, 6)) AS close FROM bars_all),
  k AS (SELECT *, CASE WHEN least(open, high, low, close) <= 0 THEN 'price' WHEN isodow(session) > 5 THEN 'weekend' WHEN cast(split_part(substr(inst, 7), '.', 1) AS INTEGER) % 3 = 0 OR session > DATE '2000-01-01' AND cast(split_part(substr(inst, 7), '.', 1) AS INTEGER) % 3 = 1 THEN 'unresolved' END AS fault FROM px)
  SELECT coalesce(fault, 'sound') AS fault, count(*) AS n, round(sum(cast(close AS DOUBLE)), 2) AS total FROM k GROUP BY 1""")
def prices_normalised(s, d):
    """Prices as a provider's text: numbers are read, symbols resolved by who held them that day, unsound rows set apart with their fault."""
    b = market.bars(s, d, weekdays=False)
    text = b.select(F.concat(F.lit(" "), F.lower("inst")).alias("symbol"), F.col("session").cast("string").alias("date"), *[F.col(c).cast("decimal(20,6)").cast("string").alias(c) for c in ("open", "high", "low")],
                    F.when(F.col("volume") > 60, -F.col("close")).otherwise(F.col("close")).cast("decimal(20,6)").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))
    kind = F.regexp_extract("inst", r"#(\d+)", 1).cast("int") % 3
    held = b.select("inst").distinct().filter(kind != 0).select("inst", F.upper("inst").alias("symbol"), F.lit("X").alias("exchange"), F.lit("1980-01-01").cast("date").alias("valid_from"), F.when(kind == 1, F.lit("2000-01-01").cast("date")).alias("valid_to"))
    sound, refused = ingest.normalise(text, held, "X", strict=False)
    every = sound.select(F.lit("sound").alias("fault"), "close").unionByName(refused.select("fault", "close"))
    return every.groupBy("fault").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close").cast("double")), 2).alias("total"))


STATES = "(VALUES ('view', 'CREATED'), ('click', 'SUBMITTED'), ('purchase', 'FILLED'), ('error', 'REJECTED'))"


@_query(f"""WITH l AS (SELECT user_id AS order_id, event_id AS seq, coalesce(st, 'CANCELLED') AS state FROM events LEFT JOIN {STATES} v(ev, st) ON event_type = ev),
  p AS (SELECT *, lag(state) OVER (PARTITION BY order_id ORDER BY seq) AS prev FROM l)
  SELECT prev, state, count(*) AS n FROM p WHERE prev IS NOT NULL AND NOT (prev = 'CREATED' AND state IN ('SUBMITTED', 'CANCELLED', 'REJECTED') OR prev = 'SUBMITTED' AND state IN ('PARTIALLY_FILLED', 'FILLED', 'CANCELLED', 'REJECTED') OR prev = 'PARTIALLY_FILLED' AND state IN ('FILLED', 'CANCELLED')) GROUP BY 1, 2""")
def order_transitions(s, d):
    """What the log of an order may not hold: events of a user as states of an order."""
    state = F.coalesce(F.create_map(*[F.lit(x) for x in ("view", "CREATED", "click", "SUBMITTED", "purchase", "FILLED", "error", "REJECTED")])[F.col("event_type")], F.lit("CANCELLED"))
    log = market.table(s, d, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), state.alias("state"))
    return ledger.illegal_transitions(log).groupBy("prev", "state").agg(F.count("*").alias("n"))


@_query("SELECT event_type AS series, count(*) * 2 AS releases, max(event_id) AS last_id FROM events GROUP BY 1")
def macro_log(s, d):
    """Releases appended by series, sent twice, read again."""
    at = store.scratch(s, "vintages")
    for _ in range(2):
        ingest.append_vintages(s, at, market.event_vintages(s, d))
    return s.read.parquet(at).groupBy("series").agg(F.count("*").alias("releases"), F.max("id").alias("last_id"))


@_query(f"WITH {FILLS} SELECT fill_id, inst, side, qty FROM fills")
def fills_log(s, d):
    """Fills appended by day in three batches that overlap, each fill kept once."""
    f, at = market.event_fills(s, d), store.scratch(s, "log")
    sink = stream.idempotent_append(at, time="ts")
    for epoch, rows in enumerate((f.filter("fill_id % 3 != 0"), f, f.filter("fill_id % 2 = 0"))):
        sink(rows, epoch)
    return s.read.parquet(at).select("fill_id", "inst", "side", "qty")
