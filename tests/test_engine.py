import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cross_section as xs
from tidemark.operators import backtest, evaluation, factors, learning, ledger, performance, pit, portfolio, universe, validation
from tidemark.plans import registry, sql_facade
from tidemark.sources import market

D = dt.date


def section(spark, values, session=D(2024, 1, 31)):
    return spark.createDataFrame([(session, f"i{n:03d}", v) for n, v in enumerate(values)], "session date, inst string, value double")


def column(df, c, order="inst"):
    return [r[0] for r in df.orderBy(order).select(c.alias("v")).collect()]


def test_tie_ranks(spark):
    df = section(spark, [10.0, 20.0, 20.0, 30.0])
    assert column(df, xs.unit_rank(F.col("value"), ["session"])) == [0.0, 0.5, 0.5, 1.0]
    assert column(df, xs.tie_rank(F.col("value"), ["session"])) == [1.0, 2.5, 2.5, 4.0]
    assert column(section(spark, [7.0]), xs.unit_rank(F.col("value"), ["session"])) == [0.5]


def test_winsor(spark):
    got = column(xs.winsorised(section(spark, [float(i) for i in range(100)]), "value", ["session"], 0.05, 0.95), F.col("value"))
    assert min(got) == 4.0 and max(got) == 95.0


def test_buckets_are_not_ntile(spark):
    assert column(section(spark, [float(i) for i in range(7)]), xs.bucket(F.col("value"), ["session"], "inst")) == [1, 1, 2, 3, 3, 4, 5]
    assert sorted(column(section(spark, [float(i) for i in range(10)]), xs.bucket(F.col("value"), ["session"], "inst"))) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_zscore_of_a_constant_is_zero(spark):
    assert column(section(spark, [3.0, 3.0]), xs.zscore(F.col("value"), xs.section("session"))) == [0.0, 0.0]


def test_direction_and_missing(spark):
    df = section(spark, [10.0, 20.0, None])
    assert [r["value"] for r in evaluation.transform(df, direction=-1, winsorize=False, rank=True).orderBy("inst").collect()] == [1.0, 0.0, None]


def test_ic_of_a_line_is_one(spark):
    rows = [(D(2024, m, 28), 21, f"i{i}", float(i), i * 0.01) for m in (1, 2, 3) for i in range(5)]
    got = evaluation.ic_series(spark.createDataFrame(rows, "session date, horizon int, inst string, value double, ret double")).collect()
    assert len(got) == 3 and all(math.isclose(r["ic"], 1) and math.isclose(r["rank_ic"], 1) for r in got)


def test_ic_guards(spark):
    flat = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0), (2, 1.0, 2.0)], "k int, x double, y double")
    assert {r["k"]: r["c"] for r in flat.groupBy("k").agg(xs.safe_corr("x", "y").alias("c")).collect()} == {1: 0.0, 2: None}


def bars(spark, rows):
    return spark.createDataFrame([(i, d, float(c), float(c), float(c), float(c), 100.0) for i, d, c in rows], "inst string, session date, open double, high double, low double, close double, volume double")


def test_split_factors(spark):
    b = bars(spark, [("a", D(2024, 1, 2), 400), ("a", D(2024, 1, 3), 400), ("a", D(2024, 1, 4), 100)])
    a = spark.createDataFrame([("a", "split", D(2024, 1, 4), D(2024, 1, 4), 4.0, None, 1)], "inst string, kind string, effective date, available date, ratio double, cash double, id long")
    got = pit.apply_adjustments(pit.adjustment_factors(b, a, "2024-02-01")).orderBy("session").collect()
    assert [r["price_factor"] for r in got] == [0.25, 0.25, 1.0] and [r["close"] for r in got] == [100.0] * 3 and [r["volume"] for r in got] == [400.0, 400.0, 100.0]
    early = pit.adjustment_factors(b, a, "2024-01-03").orderBy("session").collect()
    assert [r["price_factor"] for r in early] == [1.0] * 3


def test_dividend_uses_the_last_close_before(spark):
    b = bars(spark, [("a", D(2024, 1, 2), 100), ("a", D(2024, 1, 5), 90)])
    a = spark.createDataFrame([("a", "dividend", D(2024, 1, 5), D(2024, 1, 5), None, 10.0, 1)], "inst string, kind string, effective date, available date, ratio double, cash double, id long")
    assert [r["price_factor"] for r in pit.adjustment_factors(b, a, "2024-02-01").orderBy("session").collect()] == [0.9, 1.0]


def test_restatement(spark):
    f = spark.createDataFrame([("a", "net_income", D(2019, 12, 31), D(2020, 2, 20), 22.0, 1), ("a", "net_income", D(2019, 12, 31), D(2020, 4, 15), 21.5, 2)], "inst string, metric string, period_end date, available date, value double, id long")
    ask = spark.createDataFrame([("a", "net_income", D(2020, 1, 15)), ("a", "net_income", D(2020, 3, 1)), ("a", "net_income", D(2020, 5, 1))], "inst string, metric string, as_of date")
    assert [r["value"] for r in pit.latest_vintage(f, ask, ["inst", "metric"]).orderBy("as_of").collect()] == [None, 22.0, 21.5]


def test_late_vintage_of_an_old_period_does_not_win(spark):
    f = spark.createDataFrame([("a", D(2020, 6, 30), D(2020, 8, 1), 2.0, 1), ("a", D(2020, 3, 31), D(2020, 9, 1), 1.0, 2)], "inst string, period_end date, available date, value double, id long")
    ask = spark.createDataFrame([("a", D(2020, 10, 1))], "inst string, as_of date")
    assert pit.latest_vintage(f, ask, ["inst"]).first()["value"] == 2.0


def test_as_of_strict(spark):
    left = spark.createDataFrame([("a", 5), ("a", 6), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 1, "z")], "k string, u int, v string")
    got = lambda strict: {(r["k"], r["t"]): r["hit"] and r["hit"]["v"] for r in pit.as_of(left, right, ["k"], "t", "u", ["v"], strict).collect()}
    assert got(False) == {("a", 5): "y", ("a", 6): "y", ("b", 5): None}
    assert got(True) == {("a", 5): "z", ("a", 6): "y", ("b", 5): None}


def test_momentum_needs_history(spark):
    days = [D(2022, 1, 3) + dt.timedelta(days=i) for i in range(300)]
    b = bars(spark, [("long", d, 100 + n) for n, d in enumerate(days)] + [("short", d, 100) for d in days[-50:]])
    at = pit.spine(b, spark.createDataFrame([(days[-1],)], "session date"))
    got = {r["inst"]: r for r in factors.momentum(b, at).collect()}
    assert got["short"]["reason"] == factors.SHORT and got["short"]["value"] is None
    assert math.isclose(got["long"]["value"], (100 + 298 - 20) / (100 + 298 - 251) - 1)
    seen = {r["inst"]: r["value"] for r in factors.momentum(b, at, strict=False).collect()}
    assert math.isclose(seen["long"], (100 + 299 - 20) / (100 + 299 - 251) - 1)


def test_drawdown_beta_volatility(spark):
    days = [D(2022, 1, 3) + dt.timedelta(days=i) for i in range(260)]
    path = [100 + (n % 10) for n in range(260)]
    b = bars(spark, [("a", d, c) for d, c in zip(days, path, strict=True)] + [("b", d, 2 * c) for d, c in zip(days, path, strict=True)])
    at = pit.spine(b, spark.createDataFrame([(days[-1],)], "session date"))
    assert all(math.isclose(r["value"], 1 - 100 / 109) for r in factors.max_drawdown(b, at).collect())
    assert all(math.isclose(r["value"], 1.0) for r in factors.beta(b, at).collect())
    assert len({round(r["value"], 9) for r in factors.volatility(b, at).collect()}) == 1
    assert {"beta", "max_drawdown_252d", "momentum_12_1", "momentum_6_1", "volatility_60d"} <= set(registry.names()) and len(registry.get("beta").digest) == 64
    with pytest.raises(ValueError):
        registry.register("beta")(None)


def test_forward_returns_use_the_union_calendar(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    b = bars(spark, [("a", d, 10 + n) for n, d in enumerate(days)] + [("b", days[1], 5), ("b", days[3], 6)])
    got = {(r["inst"], r["session"]): r["ret"] for r in factors.forward_returns(b, pit.sessions(b), (2,)).collect()}
    assert math.isclose(got["a", days[0]], 13 / 11 - 1) and math.isclose(got["b", days[0]], 6 / 5 - 1) and ("b", days[1]) not in got


def test_forward_returns_at_sessions_are_those_of_all(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(9)]
    rows = [("a", d, 10 + n) for n, d in enumerate(days)] + [("b", d, c) for d, c in ((days[1], 5), (days[3], 6), (days[4], 0), (days[6], 7))]
    b = bars(spark, rows)
    asked = spark.createDataFrame([(days[0],), (days[3],), (days[8],), (D(2023, 1, 1),)], "session date")
    every = factors.forward_returns(b, pit.sessions(b), (2, 3))
    got = factors.forward_returns(b, pit.sessions(b), (2, 3), asked)
    want = sorted(r for r in every.collect() if r["session"] in (days[0], days[3], days[8]))
    assert [(r["session"], r["horizon"], r["inst"]) for r in want] == [(days[0], 2, "a"), (days[0], 2, "b"), (days[0], 3, "a"), (days[0], 3, "b"), (days[3], 2, "a"), (days[3], 3, "a")]
    assert got.columns == every.columns and sorted(got.collect()) == want


def test_liquidity(spark):
    rows = [("big", D(2024, 1, d), 50_000.0) for d in range(2, 12)] + [("small", D(2024, 1, d), 100.0) for d in range(2, 12)]
    m = spark.createDataFrame([(i, "equity", "X", D(2020, 1, 1), None) for i in ("big", "small")], "inst string, type string, exchange string, active_from date, active_to date")
    assert [r["inst"] for r in universe.tradable(bars(spark, rows), m, "2024-01-12", 1_000_000.0, 5, exchanges=("x",)).collect()] == ["big"]


def test_audit(spark):
    b = bars(spark, [("a", D(2024, 1, 2), 10), ("a", D(2024, 1, 6), 10), ("b", D(2024, 1, 2), -1)])
    r = universe.quality_audit(b).first()
    assert (r["bars"], r["positivity"], r["weekend"], r["status"]) == (3, 1, 1, "FAIL")
    assert universe.quality_audit(b.filter("1 = 0")).first()["status"] == "WARN"


def test_equal_weights_and_caps(spark):
    chosen = portfolio.top_k(section(spark, [float(i) for i in range(60)]))
    w = portfolio.equal_weights(chosen)
    assert math.isclose(w.agg(F.sum("weight")).first()[0], 0.99, abs_tol=1e-9) and w.count() == 30
    ten = portfolio.equal_weights(portfolio.top_k(section(spark, [float(i) for i in range(10)]), 10)).withColumn("sector", F.lit(None).cast("string"))
    assert portfolio.cap_name(ten).agg(F.max("weight")).first()[0] == 0.05
    assert math.isclose(portfolio.apply_risk(ten).agg(F.sum("weight")).first()[0], 0.10, abs_tol=1e-6)


def test_buffer_keeps_holdings(spark):
    s = section(spark, [float(i) for i in range(10)])
    held = spark.createDataFrame([(D(2024, 1, 31), "i005"), (D(2024, 1, 31), "i000")], "session date, inst string")
    got = {r["inst"]: r["reason"] for r in portfolio.top_k(s, 3, 5, held).collect()}
    assert got == {"i005": "buffer_hold", "i009": "top_k_entry", "i008": "top_k_entry"}


def test_order_plan(spark):
    day = D(2024, 1, 31)
    t = spark.createDataFrame([(day, "a", 0.5), (day, "b", 0.5)], "session date, inst string, weight double")
    h = spark.createDataFrame([(day, "c", 10), (day, "b", 499)], "session date, inst string, shares long")
    p = spark.createDataFrame([(day, i, 100.0, 1e6) for i in "abc"], "session date, inst string, close double, volume double")
    got = {r["inst"]: (r["side"], r["shares"]) for r in portfolio.plan_orders(t, h, p, 100_000.0).collect()}
    assert got == {"a": ("BUY", 500), "c": ("SELL", 10)}


def test_ledger(spark):
    f = spark.createDataFrame([(1, "acct", "x", "BUY", 1000, 100.0, 1), (2, "acct", "y", "BUY", 2000, 50.0, 2), (3, "acct", "x", "SELL", 400, 110.0, 3)], "fill_id long, account string, inst string, side string, qty long, price double, ts long")
    assert [r["balance"] for r in ledger.balances(f, 500_000.0).orderBy("ts").collect()] == [400_000.0, 300_000.0, 344_000.0]
    last = {r["inst"]: r for r in ledger.lots(f).orderBy("fill_id").collect()}
    assert (last["x"]["shares"], last["x"]["cost"], last["x"]["gain"]) == (600, 100.0, 4000.0)
    assert {r["inst"]: r["shares"] for r in ledger.positions(f.unionByName(f), ["inst"]).collect()} == {"x": 600, "y": 2000}
    log = spark.createDataFrame([(1, 1, "CREATED"), (1, 2, "SUBMITTED"), (1, 3, "FILLED"), (1, 4, "CANCELLED"), (2, 1, "CREATED"), (2, 2, "FILLED")], "order_id long, seq long, state string")
    assert sorted((r["order_id"], r["seq"]) for r in ledger.illegal_transitions(log).collect()) == [(1, 4), (2, 2)]
    assert str(ledger.cents("0.125")) == "0.12"


def test_walk_forward(spark):
    cal = spark.range(1, 501).select(F.date_add(F.lit(D(2020, 1, 1)), F.col("id").cast("int")).alias("session"), F.col("id").alias("idx"))
    got = learning.folds(cal, 200, 50, 50, 20).orderBy("fold").collect()
    assert len(got) >= 4 and all(r["test_from"] - r["train_to"] > 20 and r["test_to"] - r["test_from"] == 49 for r in got)
    assert learning.folds(cal.limit(100), 200, 50, 50, 20).count() == 0



def test_statistics(spark):
    assert math.isclose(validation.normal_ppf(0.975), 1.96, abs_tol=1e-3) and math.isclose(validation.normal_cdf(0), 0.5)
    assert validation.expected_max_sharpe(1) == 0 and validation.deflated_sharpe(0.2, 1, n=500) > validation.deflated_sharpe(0.2, 50, n=500)
    t = spark.createDataFrame([(1, 0.001), (2, 0.02), (3, 0.04), (4, 0.5)], "id int, p double")
    assert [r["significant"] for r in validation.discoveries(t).orderBy("id").collect()] == [True, True, False, False]


def test_bootstrap_draws_blocks_around_the_series(spark):
    """Against resamples built return by return from the same draws; short and flat series."""
    import hashlib

    rets = {"x": [0.01 * ((7 * k) % 11 - 4) for k in range(40)], "flat": [0.01] * 30, "short": [0.1, 0.2]}
    s = spark.createDataFrame([(i, k, r) for i, rs in rets.items() for k, r in enumerate([*rs, None])], "id string, session int, ret double")
    got = {(r["id"], r["sim"]): r["sharpe"] for r in validation.bootstrap_sharpe(s, 50, block=5, seed=9).collect()}

    def u(*key):
        return (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    for sim in range(50):
        x, out, at = rets["x"], [], 0
        for t in range(40):
            at = int(u("x", sim, t, 10) * 40) if t == 0 or u("x", sim, t, 9) < 0.2 else at + 1
            out.append(x[at % 40])
        mean = sum(out) / 40
        sd = math.sqrt(sum((v - mean) ** 2 for v in out) / 39)
        assert math.isclose(got["x", sim], mean / sd * math.sqrt(252), rel_tol=1e-9)
        assert got["flat", sim] == 0.0 and math.isclose(got["short", sim], 0.15 * math.sqrt(252))
    i = {r["id"]: r for r in validation.bootstrap_interval(validation.bootstrap_sharpe(s, 50, block=5, seed=9)).collect()}
    assert i["x"]["n"] == 50 and i["x"]["low"] <= i["x"]["mean"] <= i["x"]["high"]
    assert validation.normal_ppf(0.5) == 0.0


def test_bootstrap_shuffles_series_only(spark):
    """Beyond the join of lots by series, nothing is shuffled by place or simulation."""
    s = spark.createDataFrame([("x", k, 0.01 * k) for k in range(9)], "id string, session int, ret double")
    plan = validation.bootstrap_sharpe(s, 20, block=3)._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert by and all(b.startswith("id#") and b.count("#") == 1 for b in by)
    assert validation.bootstrap_sharpe(s, 20, block=1).count() == 20



def test_performance(spark):
    e = spark.createDataFrame([("a", D(2024, 1, d), v) for d, v in ((1, 100.0), (2, 110.0), (3, 99.0), (4, 99.0), (5, 120.0))], "inst string, session date, equity double")
    r = performance.metrics(e).first()
    assert math.isclose(r["total_return"], 0.2) and math.isclose(r["max_drawdown"], 0.1) and r["drawdown_bars"] == 2 and r["win_rate"] == 0.5


def test_backtest_conserves_value(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    rows = [(d, i, 100.0, 100.0, 1e6, "s" + i, 1.0, None, None, n == 0) for n, d in enumerate(days) for i in "abcde"]
    panel = spark.createDataFrame(rows, "session date, inst string, open double, close double, volume double, sector string, score double, split double, dividend double, rebalance boolean")
    v = spark.createDataFrame([("v", 3, 4, 1000000.0, 0.0, 0.0, 0.1, 0.005, 100.0, 0.3, 0.3, 0.1, 0.01)], "variant string, k int, keep_to int, cash0 double, bps double, per_share double, participation double, band double, least double, name_cap double, sector_cap double, unknown_cap double, buffer double")
    got = backtest.simulate(panel, v).orderBy("session").collect()
    assert [r["equity"] for r in got] == [1_000_000.0] * 4 and got[-1]["names"] == 3 and got[-1]["fills"] == 3


def test_sql_facade(spark):
    t = {"t": spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")}
    assert [tuple(r) for r in sql_facade.query(spark, "SELECT k, count(*) AS n FROM t GROUP BY k ORDER BY k", t).collect()] == [("a", 2), ("b", 1)]
    assert sql_facade.query(spark, "SELECT v FROM t WHERE v > :x", t, {"x": 2}).count() == 1
    for bad in ("DROP TABLE t", "SELECT 1; DELETE FROM t", "insert into t values ('x', 1)"):
        with pytest.raises(ValueError):
            sql_facade.query(spark, bad, t)
    with pytest.raises(ValueError):
        sql_facade.assert_read_only(spark, "CREATE VIEW v AS SELECT 1", strict=False)


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    h = lambda d: universe.content_hash(d).first()["hash"]
    assert h(a) == h(a.orderBy(F.desc("a")).select("b", "a").repartition(3)) != h(a.limit(1))


def test_csv_scans(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,symbol,open,high,low,close,volume\n2024-01-02,a,,11,9,10,\n2024-01-03,a,1,1,1,,5\n")
    p = market.impute_prices(market.read_csv(spark, str(tmp_path / "p.csv"), market.PRICES)).collect()
    assert len(p) == 1 and float(p[0]["open"]) == 10 and float(p[0]["volume"]) == 100000
    (tmp_path / "l.csv").write_text("symbol,name,exchange,listed_date,delisted_date,is_etf\n a ,A,nyse,2020-01-01,,True\n")
    r = market.listings(market.read_csv(spark, str(tmp_path / "l.csv"), market.LISTINGS)).first()
    assert (r["symbol"], r["type"], r["sector"], r["status"]) == ("A", "etf", "UNKNOWN", "active")
    b = spark.createDataFrame([("x", D(2023, 5, 1), 1.0, "raw"), ("x", D(2024, 5, 1), 2.0, "raw")], "instrument_id string, session date, close double, semantic string")
    market.write_bars(b, str(tmp_path / "bars"))
    assert market.read_bars(spark, str(tmp_path / "bars"), "2024-01-01", "2024-12-31").count() == 1
    old = spark.createDataFrame([(1, None)], "a int, b string")
    new = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert market.insert_ignore(old, new, ["a", "b"]).collect() == [(2, "x")]


def test_ridge_solves_the_normal_equations(spark):
    rows = spark.createDataFrame([(1, float(a), float(b), 2.0 * a - b) for a in range(5) for b in range(5)], "k int, a double, b double, y double")
    w = learning.ridge(learning.normal_equations(rows, ["a", "b"], "y", ["k"]), ["a", "b"], ["k"], 1e-9).first()["weights"]
    assert math.isclose(w[0], 2, abs_tol=1e-6) and math.isclose(w[1], -1, abs_tol=1e-6)
