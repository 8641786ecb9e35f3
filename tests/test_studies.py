import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark import catalogue, studies
from tidemark.functions import cross_section as xs
from tidemark.operators import backtest, factors, ledger, pit, portfolio, universe, validation
from tidemark.plans import protocols, registry, sql_facade, sql_functions
from tidemark.sources import ingest, market, store
from tidemark.streaming import fills as stream

D = dt.date
DAYS = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(5)]
PANEL = "session date, inst string, open double, close double, volume double, sector string, score double, split double, dividend double, rebalance boolean, delisting double"


def panel(spark, change=lambda d, i, r: r, names="abc"):
    rows = [change(n, i, [d, i, 100.0, 100.0, 1e6, "s" + i, 1.0, None, None, n == 0, None]) for n, d in enumerate(DAYS) for i in names]
    return spark.createDataFrame([tuple(r) for r in rows if r], PANEL)


def variant(spark, **x):
    own = {"variant": "v", "k": 3, "keep_to": 4, "name_cap": 0.4, "sector_cap": 0.4, "unknown_cap": 0.1, "bps": 0.0, "per_share": 0.0} | x
    return spark.createDataFrame([tuple(own.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in own.items()))


def run(spark, p, **x):
    return backtest.simulate(p, variant(spark, **x)).orderBy("session").collect()


def test_delisting_settles_at_the_cash_given(spark):
    def change(cash):
        return lambda n, i, r: ([*r[:-1], cash] if n == 3 else None if n > 3 else r) if i == "a" else r

    whole = run(spark, panel(spark))[-1]["equity"]
    half, none = run(spark, panel(spark, change(50.0)))[-1], run(spark, panel(spark, change(0.0)))[-1]
    assert whole == 1_000_000 and half["names"] == none["names"] == 2
    assert math.isclose(whole - none["equity"], 2 * (whole - half["equity"])) and 300_000 < whole - none["equity"] < 340_000


def test_partial_fills_are_not_carried_on_and_no_volume_waits(spark):
    got = run(spark, panel(spark, lambda n, i, r: [*r[:4], 1000.0, *r[5:]]))
    assert got[-1]["partial"] == 0 and got[-1]["fills"] == 3 and got[1]["equity"] == 1_000_000.0  # orders are held to the share when planned
    thin = run(spark, panel(spark, lambda n, i, r: [*r[:4], 500.0 if n == 1 else 1000.0, *r[5:]]))
    assert thin[1]["partial"] == 3 and thin[-1]["fills"] == 3
    dry = run(spark, panel(spark, lambda n, i, r: [*r[:4], 0.0 if n == 1 else 1000.0, *r[5:]]))
    assert dry[1]["fills"] == 0 and dry[2]["fills"] == 3
    gone = run(spark, panel(spark, lambda n, i, r: None if n == 1 and i == "a" else r))
    assert gone[-1]["rejected"] == 1 and gone[-1]["fills"] == 2


def test_fee_is_on_what_is_sold(spark):
    def change(n, i, r):
        r[9] = n in (0, 2)
        if n == 2:
            r[6] = None
        if n == 3 and i == "a":
            r[7] = 0.5  # a split after the sale was planned leaves half the shares
        return r

    got = run(spark, panel(spark, change), per_share=1.0)
    bought, sold = got[2]["fees"], got[-1]["fees"] - got[2]["fees"]
    assert got[-1]["names"] == 0 and math.isclose(sold, bought * 5 / 6, rel_tol=1e-3)


def test_variants_of_a_study(spark):
    p = panel(spark).withColumn("scoreb", F.when(F.col("inst") == "a", None).otherwise(F.col("score")))
    v = variant(spark, score="score").unionByName(variant(spark, variant="w", score="scoreb"))
    out = {r["variant"]: r for r in backtest.outcomes(backtest.simulate(p, v)).collect()}
    assert out["v"]["fills"] == 3 and out["w"]["fills"] == 2 and out["v"]["turnover"] > out["w"]["turnover"]
    again = {r["variant"]: r for r in backtest.outcomes(backtest.simulate(p.repartition(3), v)).collect()}
    assert out["v"]["hash"] == again["v"]["hash"]


def test_caps_settle_or_are_rejected():
    assert portfolio.capped({"a": 0.04, "b": 0.04}, {"a": "x", "b": "y"}) == ({"a": 0.04, "b": 0.04}, "PASS")
    w, status = portfolio.capped({"a": 0.5, "b": 0.5}, {"a": "x", "b": "x"}, name=0.4)
    assert status == "ADJUST" and w == {"a": 0.15, "b": 0.15}
    target = {"a": 0.5}
    assert portfolio.capped(target, {"a": "x"}, rounds=1) == (target, "REJECT")
    for sectors in ({}, {"a": "x", "c": "x"}):
        w, _ = portfolio.capped(dict.fromkeys("abcdef", 0.3), sectors)
        assert max(w.values()) <= 0.05 and sum(w.values()) <= 0.99 and sum(x for k, x in w.items() if k not in sectors) <= 0.1 + 1e-5
        assert portfolio.capped(w, sectors) == (w, "PASS")


def test_lots(spark):
    kinds = "fill_id long, inst string, side string, qty long, price double, ts long"
    f = spark.createDataFrame([(1, "x", "BUY", 10, 10.0, 1), (2, "x", "SPLIT", 0, 2.0, 2), (3, "x", "SELL", 5, 6.0, 3)], kinds)
    last = ledger.lots(f).orderBy("fill_id").collect()[-1]
    assert (last["shares"], last["cost"], last["gain"]) == (15, 5.0, 5.0)
    over = f.unionByName(spark.createDataFrame([(4, "x", "SELL", 99, 6.0, 4)], kinds))
    assert ledger.lots(over, oversell="cut").orderBy("fill_id").collect()[-1]["shares"] == 0
    with pytest.raises(Exception, match="99 sold of 15"):
        ledger.lots(over).collect()


def test_audit_counts(spark):
    b = spark.createDataFrame([("a", D(2024, 1, 3), 1), ("a", D(2024, 1, 2), 2), ("a", D(2024, 1, 9), 3)], "inst string, session date, line long")
    b = b.withColumns(dict.fromkeys(("open", "high", "low", "close", "volume"), F.lit(1.0)))
    r = universe.quality_audit(b, "2024-01-05", "line").first()
    assert (r["chronology"], r["lookahead"], r["status"], r["confidence"]) == (1, 1, "FAIL", 0.6)
    assert universe.quality_audit(b).first()["status"] == "PASS" and universe.quality_audit(b.limit(0)).first()["confidence"] == 0.5


def test_several_holders_of_a_symbol(spark):
    h = spark.createDataFrame([("i", "S", "x", D(2020, 1, 1), None), ("j", "S", "x", D(2021, 1, 1), None)], "inst string, symbol string, exchange string, valid_from date, valid_to date")
    ask = spark.createDataFrame([("S", "x", D(2020, 6, 1)), ("S", "x", D(2022, 6, 1))], "symbol string, exchange string, day date")
    assert sorted((r["matches"], r["inst"]) for r in pit.interval_resolve(ask, h).collect()) == [(1, "i"), (2, None)]
    with pytest.raises(Exception, match="several instruments"):
        pit.interval_resolve(ask, h, strict=True).collect()
    with pytest.raises(ValueError, match="several instruments"):
        ingest.upsert_instruments(h, h, h)


def test_normalisation(spark, tmp_path):
    (tmp_path / "listings.csv").write_text("symbol,name,exchange,listed_date,delisted_date,is_etf\naa,A,nyse,2020-01-01,,false\n")
    rows = ["date,symbol,open,high,low,close,volume", "2024-01-02,aa,1,2,1,2,5", "2024-01-06,aa,1,2,1,2,5", "2024-01-03,aa,1,2,1,,5", "2024-01-04,aa,1,2,1,x,5", "2024-01-05,zz,1,2,1,2,5", "2024-01-08,aa,1,0.5,1,2,5"]
    (tmp_path / "prices.csv").write_text("\n".join(rows))
    listed = market.listings(market.read_csv(spark, str(tmp_path / "listings.csv"), market.LISTINGS))
    history = listed.select(F.col("instrument_id").alias("inst"), "symbol", "exchange", F.col("active_from").alias("valid_from"), F.col("active_to").alias("valid_to"))
    raw = spark.read.option("header", True).csv(str(tmp_path / "prices.csv"))
    good, bad = ingest.normalise(raw, history, "NYSE", strict=False)
    assert good.count() == 1 and sorted(r["fault"] for r in bad.collect()) == ["missing", "missing", "ohlc", "unresolved", "weekend"]
    with pytest.raises(Exception, match="AA 2024-01"):
        ingest.normalise(raw, history, "NYSE")[0].collect()
    (tmp_path / "prices.csv").write_text("\n".join(rows[:2]))
    m = cli.build(spark, str(tmp_path), "nyse", str(tmp_path / "root"), "demo", "v1")
    assert m["tables"]["bars"]["rows"] == 1 and m["quality"]["status"] == "PASS"
    assert ingest.roster(listed, "equity", ["aa"]).count() == 1 and ingest.roster(listed, "etf").count() == 0


def test_jobs_and_providers(spark, tmp_path):
    (tmp_path / "prices.csv").write_text("date,symbol,open,high,low,close,volume\n2024-01-02,aa,1,2,1,2,5\n2024-02-02,bb,1,2,1,2,5\n")
    p, root = ingest.CsvProvider(str(tmp_path)), str(tmp_path / "root")
    done = ingest.ingest(spark, p, "prices", ["aa"], "2024-01-01", "2024-12-31", root, "job-1")
    assert (done["status"], done["rows"], done["kind"]) == ("COMPLETED", 1, "prices")
    assert ingest.ingest(spark, p, "prices", [], "2024-01-01", "2024-12-31", root, "job-1") == done  # once
    assert ingest.ingest(spark, p, "filings", [], "2024-01-01", "2024-12-31", root, "job-2")["status"] == "FAILED"
    v = spark.createDataFrame([("cpi", D(2024, 1, 1), 1.0)], "series string, period date, value double")
    for _ in range(2):
        ingest.append_vintages(spark, str(tmp_path / "macro"), v)
    assert spark.read.parquet(str(tmp_path / "macro")).count() == 2


def test_retry():
    calls, waits = [], []

    def op():
        calls.append(1)
        if len(calls) < 3:
            raise ingest.RateLimited
        return "ok"

    assert ingest.retry(op, wait=1, sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(ingest.RateLimited):
        ingest.retry(lambda: (_ for _ in ()).throw(ingest.RateLimited()), sleep=lambda _: None)


def test_partitions(spark):
    parts = spark.createDataFrame([(1, "train", D(2020, 1, 1), D(2020, 6, 30)), (1, "test", D(2020, 7, 1), D(2020, 12, 31))], "k int, part string, start date, end date")
    assert universe.partition_overlaps(parts, "k").count() == 0
    late = parts.withColumn("end", F.date_add("end", 1))
    assert [r["part"] for r in universe.partition_overlaps(late, "k").collect()] == ["train"]
    rows = spark.createDataFrame([(1, D(2020, 6, 30)), (1, D(2020, 7, 1)), (1, D(2021, 1, 1)), (1, D(2019, 1, 1))], "k int, session date")
    assert sorted(str(r["part"]) for r in universe.in_partitions(rows, parts, "k").collect()) == ["None", "None", "test", "train"]


def test_all_factors_are_registered():
    assert len(registry.names()) == 14 and {"roe", "fcf_yield", "operating_income_growth", "beta"} <= set(registry.names())


def test_denominators_and_p(spark):
    from tidemark.functions.cross_section import valid_denominator

    x = spark.createDataFrame([(v,) for v in (None, float("nan"), float("inf"), 1e-7, -1.0, 2.0)], "x double")
    assert [r[0] for r in x.select(valid_denominator(F.col("x"))).collect()] == [False, False, False, False, True, True]
    assert [r[0] for r in x.select(valid_denominator(F.col("x"), True)).collect()][-2:] == [False, True]
    draws = spark.createDataFrame([(0.1,), (0.3,), (0.5,)], "mean double")
    asked = spark.createDataFrame([(0.3,), (9.0,)], "observed double")
    assert {r["observed"]: (r["draws"], r["p"]) for r in validation.empirical_p(asked, draws).collect()} == {0.3: (3, 0.75), 9.0: (3, 0.25)}
    assert validation.empirical_p(asked, draws.filter("1 = 0")).first()["p"] == 1.0


def test_verdicts_see_through_the_red_team(spark):
    got = {r["id"]: r["verdict"] for r in studies.red_team(spark, "/root/testdata/sf0.001").collect()}
    assert got == {"lookahead": "REJECTED", "random_mining": "RESEARCH_ONLY", "cost_illusion": "RESEARCH_ONLY"}


def test_paper_command(spark, capsys):
    d = "/root/testdata/sf0.001"
    cli.main(["paper", d])
    days = {r["day"] for r in spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).collect()}
    assert json.loads(capsys.readouterr().out)["paper_cycle"][0]["sessions"] == sum(x.weekday() < 5 for x in days)


def test_paper_store(spark, tmp_path):
    store_ = stream.PaperStore(spark, str(tmp_path))
    kinds = "fill_id long, account string, inst string, side string, qty long, price double, ts timestamp"
    at = [dt.datetime(2024, 1, d, 12) for d in (2, 3)]
    a = spark.createDataFrame([(2, "p", "x", "BUY", 5, 1.0, at[1]), (1, "p", "x", "BUY", 5, 1.0, at[0])], kinds)
    for i in range(2):
        store_.record_fills(a, i)
    store_.record_fills(a.unionByName(spark.createDataFrame([(3, "p", "x", "SELL", 4, 1.0, at[1])], kinds)), 2)
    assert [r["fill_id"] for r in store_.load_fills("p").collect()] == [1, 2, 3] and store_.replay().first()["shares"] == 6
    rows = lambda *x: spark.createDataFrame(x, "account string, inst string, shares long")
    store_.save("positions", rows(("p", "x", 1), ("p", "y", 2), ("q", "x", 9)), 1)
    store_.save("positions", rows(("p", "x", 6)), 2)
    assert sorted((r["account"], r["shares"]) for r in store_.load("positions").collect()) == [("p", 6), ("q", 9)]


def test_config_and_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("db:\n  host: h\n  password: x\nlevel: info\n")
    (tmp_path / "b.json").write_text('{"db": {"port": 1}}')
    c = store.load_config([str(tmp_path / "a.yaml"), str(tmp_path / "b.json")], {"TIDEMARK_DB__HOST": "k", "OTHER": "z"}, required=("level",))
    assert c == {"db": {"host": "k", "password": "x", "port": 1}, "level": "info"}
    with pytest.raises(ValueError, match="missing"):
        store.load_config([], required=("level",))
    assert json.loads(store.log_event("start", db=c["db"], users=[{"token": "t"}])) == {"event": "start", "db": {"host": "k", "password": "***", "port": 1}, "users": [{"token": "***"}]}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "p.csv").write_text("a\n1\n2\n")
    sha = store.file_digests(spark, str(tmp_path / "f")).first()["sha256"]
    check = lambda *r: [(x["name"], x["fault"]) for x in store.verify_files(spark, str(tmp_path / "f"), spark.createDataFrame(r, "name string, rows long, sha256 string")).collect()]
    assert check(("p.csv", 2, sha)) == [] and check(("p.csv", 3, sha)) == [("p.csv", "rows")] and check(("q.csv", 1, sha)) == [("q.csv", "missing")] and check(("p.csv", 2, "0")) == [("p.csv", "digest")]


def test_bars_of_two_datasets(spark, tmp_path):
    b = spark.createDataFrame([("x", D(2024, 5, 1), 2.0, "raw")], "instrument_id string, session date, close double, semantic string")
    market.write_bars(b, str(tmp_path), "one")
    market.write_bars(b.withColumn("close", F.lit(3.0)), str(tmp_path), "two")
    assert [market.read_bars(spark, str(tmp_path), "2024-01-01", "2024-12-31", dataset=d).first()["close"] for d in ("one", "two")] == [2.0, 3.0]


def test_a_round_of_trading_with_parts_of_ones_own(spark):
    s = spark.createDataFrame([(DAYS[0], i, v) for i, v in (("a", 3.0), ("b", 2.0), ("c", 9.0))], "session date, inst string, value double")
    bars = spark.createDataFrame([(DAYS[0], i, 10.0, 10.0, 1e6) for i in "abc"], "session date, inst string, open double, close double, volume double")
    none = spark.createDataFrame([], "session date, inst string, shares long")
    heavy = lambda chosen, cash: chosen.withColumn("weight", F.when(F.col("rank") == 1, 0.9).otherwise(0.05))
    got = {r["inst"]: r["filled"] for r in protocols.trade(s, s.filter("inst != 'c'"), none, bars, 100_000.0, 2, heavy).collect()}
    assert got == {"a": 9000, "b": 500}


def test_functions_in_sql(spark):
    rows = [(D(2024, 1, d), n, v) for d in (1, 2) for n, v in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 9.0 * d))]
    t = {"t": spark.createDataFrame(rows, "session date, inst string, value double")}
    got = {how: sorted((str(r["session"]), r["inst"], None if r["value"] is None else round(r["value"], 9)) for r in sql_facade.query(spark, f"SELECT * FROM section_scores(TABLE(t) PARTITION BY (session), '{how}')", t).collect()) for how in ("winsor", "z", "rank", "robust")}
    w = xs.section("session")
    md = t["t"].withColumn("md", F.median("value").over(w)).withColumn("mad", F.median(F.abs(F.col("value") - F.col("md"))).over(w))
    want = {
        "winsor": xs.winsorised(t["t"], "value", ["session"]), "z": t["t"].withColumn("value", xs.zscore(F.col("value"), w)), "rank": t["t"].withColumn("value", xs.unit_rank(F.col("value"), ["session"])),
        "robust": md.withColumn("value", xs.robust_zscore(F.col("value"), w, F.col("md"), F.col("mad"))),
    }
    for how, df in want.items():
        assert got[how] == sorted((str(r["session"]), r["inst"], None if r["value"] is None else round(r["value"], 9)) for r in df.collect()), how
    one = sql_facade.query(spark, "SELECT safe_ratio(1, 1e-7D) AS a, safe_ratio(1, 2) AS b, simple_return(3, 2) AS c, simple_return(3, 0) AS d, held_between(5, 0, 1) AS e, standard_score(1, 1, 0) AS f, robust_score(3, 1, 0) AS g, basis_points(1, 200) AS h", {}).first()
    assert tuple(one) == (None, 0.5, 0.5, None, 1.0, 0.0, None, 50.0)
    with pytest.raises(Exception, match="not a way"):
        sql_facade.query(spark, "SELECT * FROM section_scores(TABLE(t) PARTITION BY (session), 'no')", t).collect()


def test_a_factor_asked_for_by_name_runs_alone(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(days=k), 10.0 + k, 10.0 + k, 10.0 + k, 10.0 + k, 5.0) for k in range(80)], "inst string, session date, open double, high double, low double, close double, volume double")
    sql_functions.install_factors(spark, bars, bars.select("inst", "session").filter("session > DATE'2024-03-15'"))
    df = sql_facade.query(spark, "SELECT * FROM factor('volatility_60d')", {})
    assert df.filter("value IS NOT NULL").count() > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union ") == 1 and "c_far" not in plan  # that of its own as-of join; no other factor
    assert sql_facade.query(spark, "SELECT * FROM factor('none')", {}).count() == 0


def test_means_without_each_part(spark):
    rows = [(1, "a", 1.0), (1, "a", 3.0), (1, "b", 8.0), (2, "b", 4.0), (3, "c", None)]
    got = sorted(map(tuple, validation.without_each(spark.createDataFrame(rows, "session int, part string, close double"), "part").collect()))
    assert got == [("a", 1, 8.0), ("a", 2, 4.0), ("all", 1, 4.0), ("all", 2, 4.0), ("b", 1, 2.0), ("c", 1, 4.0), ("c", 2, 4.0)]


def test_lookahead_is_found_in_every_section(spark):
    bars = spark.createDataFrame([(n, D(2024, 1, 1) + dt.timedelta(days=k), float(k + len(n))) for n in ("a", "bb") for k in range(40)], "inst string, session date, close double")
    at = bars.select("inst", "session").filter("session >= DATE'2024-01-20'")
    peek = lambda b, p: p.join(b, ["inst", "session"], "left").select("session", "inst", F.col("close").alias("value"))
    fair = lambda b, p: factors.momentum(b, p, 5, 2, 10)
    assert {r["leaked"] for r in validation.lookahead(peek, bars, at).collect()} == {2}
    sound = validation.lookahead(fair, bars, at, 10).collect()
    assert len(sound) == 21 and {(r["names"], r["leaked"]) for r in sound} == {(2, 0)}
    assert validation.lookahead(fair, bars, at.filter("1 = 0")).collect() == []


def test_copies_of_lookahead_are_numbered_and_a_day_is_matched_once(spark):
    rows = [(n, D(2024, 1, 1) + dt.timedelta(days=k), float(k + 1)) for n in ("a", "b", None) for k in range(40)]
    bars, kinds = spark.createDataFrame(rows, "inst string, session date, close double"), []

    def fair(b, p):
        kinds.append(dict(b.dtypes)["inst"])
        return factors.momentum(b, p, 5, 2, 10)

    got = validation.lookahead(fair, bars, bars.select("inst", "session").filter("session >= DATE'2024-01-20'"), 10)
    assert {(r["names"], r["leaked"]) for r in got.collect()} == {(3, 0)} and kinds == ["bigint", "string"]
    assert "lambdafunction" not in plan_of(got)


def rows_moved(spark, df) -> tuple[list, int]:
    """What df holds, and how many rows its shuffles wrote."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    last = max(stages(), default=-1)
    rows = df.collect()
    return rows, sum(n for k, n in stages().items() if k > last)


def test_copies_of_lookahead_stay_where_their_bars_were_dealt(spark):
    rows = [(n, D(2024, 1, 1) + dt.timedelta(days=k), float(k + 1 + len(n))) for n in ("a", "bb", "ccc") for k in range(300)]
    bars = store.kept(spark.createDataFrame(rows, "inst string, session date, close double"), "closes")
    at = bars.select("inst", "session").filter("dayofmonth(session) % 5 = 0")
    copies = 3 * sum(min(k, 100) for k in range(300) if (D(2024, 1, 1) + dt.timedelta(days=k)).day % 5 == 0)
    fair = lambda b, p: factors.momentum(b, p, 60, 5, 100)
    blind = lambda b, p: factors.momentum(b.drop(factors.HOME), p.drop(factors.HOME), 60, 5, 100)
    got, moved = rows_moved(spark, validation.lookahead(fair, bars, at, 100))
    same, all_moved = rows_moved(spark, validation.lookahead(blind, bars, at, 100))
    assert sorted(got) == sorted(same) and {(r["names"], r["leaked"]) for r in got} == {(3, 0)}
    leaks, leak_moved = rows_moved(spark, validation.lookahead(studies._canary, bars, at, 100))
    assert {(r["names"], r["leaked"]) for r in leaks} == {(3, 3)}
    assert all_moved > copies and moved < copies / 2 and leak_moved < copies / 2


def test_a_section_sees_the_bars_of_its_reach_alone(spark):
    rows = [(n, D(1969, 12, 1) + dt.timedelta(days=k * g), float(k)) for n, g in (("b", 1), ("a", 3), (None, 2)) for k in range(40)] + [("a", None, 9.0)]
    bars, seen = spark.createDataFrame(rows, "inst string, session date, close double"), []

    def fair(b, p):
        seen.append(b)
        return factors.momentum(b, p, 2, 1, 7)

    at = bars.select("inst", "session").filter("session > DATE'1969-12-04'")
    validation.lookahead(fair, bars, at, 7)
    epoch, reach, cuts = D(1970, 1, 1), dt.timedelta(days=7), {d for _, d, _ in rows if d and d > D(1969, 12, 4)}
    number = {None: 1, "a": 2, "b": 3}
    want = sorted((number[n] * validation.DAYS + (c - epoch).days, d, x) for n, d, x in rows if d for c in cuts if c - reach <= d < c)
    assert sorted((r["inst"], r["session"], r["close"]) for r in seen[0].collect()) == want and len(want) == 644


def test_momentum_shuffles_bars_once(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, d), float(d)) for d in range(1, 9)], "inst string, session date, close double")
    at = spark.createDataFrame([("a", D(2024, 1, 6)), ("a", D(2024, 1, 4)), ("b", D(2024, 1, 6))], "inst string, session date")
    for strict, want in ((True, 4.0 / 2 - 1), (False, 5.0 / 3 - 1)):
        m = factors.momentum(bars, at, 4, 2, 10, strict)
        assert plan_of(m).count("Exchange hashpartitioning") == 1
        assert {(r["inst"], r["session"].day): (r["value"], r["reason"]) for r in m.collect()} == {("a", 6): (want, None), ("a", 4): (None, "insufficient_history") if strict else (3.0 / 1 - 1, None), ("b", 6): (None, "insufficient_history")}


def test_versions_are_numbers_and_jobs_are_claimed_once(spark, tmp_path):
    assert max(["v9", "v10", "v2", "v10-rc1"], key=store.by_number) == "v10-rc1" and max(["v9", "v10"], key=store.by_number) == "v10"
    t = spark.createDataFrame([(1,)], "k int")
    for v, rows in (("v9", t), ("v10", t.union(t))):
        store.publish(spark, str(tmp_path / "d"), "x", v, {"t": rows})
        rows.write.parquet(str(tmp_path / "n" / v / "t"))
    assert store.inspect(spark, str(tmp_path / "d"), "x")["version"] == "v10" and ingest.newest(spark, str(tmp_path / "n"), "t").count() == 2
    a, b = (ingest.Jobs(spark, str(tmp_path / "jobs")) for _ in range(2))
    assert [x.create_once("j", "prices") for x in (a, b, a)] == [True, False, False] and a.create_once("k", "prices")
    assert a.states().count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_of_the_last_session_pass_no_window(spark):
    marked = spark.createDataFrame([(D(2024, 1, d), i, v) for d, i, v in ((1, "a", 5.0), (2, "a", 1.0), (2, "b", 3.0))], "session date, inst string, value double")
    got = ledger.terminal_weights(marked, 1.0)
    assert {r["inst"]: r["weight"] for r in got.collect()} == {"a": 0.2, "b": 0.6} and "Window" not in plan_of(got)
    assert ledger.terminal_weights(marked.filter("inst = 'c'")).collect() == []


def test_report_works_bars_out_once(spark, monkeypatch):
    made = []
    bars = market.bars
    monkeypatch.setattr(market, "bars", lambda *a, **k: made.append(1) or bars(*a, **k))
    df = studies.validation_report(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and not [f for f in df.inputFiles() if "lineitem" in f]


def test_label_shuffles_read_a_written_panel(spark):
    got = catalogue.label_shuffle(spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and not [f for f in got.inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["champion_model", "ic_summary", "factor_research_momentum"])
def test_month_end_studies_work_bars_out_once(spark, monkeypatch, name):
    made = []
    bars = market.bars
    monkeypatch.setattr(market, "bars", lambda *a, **k: made.append(1) or bars(*a, **k))
    got = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and got.inputFiles() and not [f for f in got.inputFiles() if "lineitem" in f]


def test_bars_of_a_range_are_worked_out_once(spark, monkeypatch):
    kept, bars = [], studies.market.write_bars
    monkeypatch.setattr(market, "write_bars", lambda rows, *a: kept.append([f for f in rows.inputFiles() if "lineitem" in f]) or bars(rows, *a))
    studies.bars_range(spark, "/root/testdata/sf0.001")
    assert kept == [[], [], [], []]


def test_red_team_works_its_closes_out_once(spark, monkeypatch):
    names, kept = [], store.kept
    monkeypatch.setattr(store, "kept", lambda df, name: names.append((name, df.columns)) or kept(df, name))
    studies.red_team(spark, "/root/testdata/sf0.001")
    assert names == [("closes", ["inst", "session", "close"])]
