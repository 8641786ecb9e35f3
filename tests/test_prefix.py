"""Running values by slices, as-of joins of hot keys, interval sweeps, exact quantiles of long sections, sliding drawdown and beta."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import factors, pit, prefix

DAY = dt.date(2020, 1, 1)
key = lambda r: tuple((x is None, str(x)) for x in r)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


@pytest.mark.parametrize("slices", [1, 3, 9])
def test_running_values_are_those_of_one_window(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, rng.randint(-9, 9)]), rng.choice([None, rng.randint(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v long, w long").repartition(5)
    values = {"l": ("last", "v"), "m": ("max", "v"), "s": ("sum", "w"), "x": ("xor", "w"), "w": ("sum", "w")}
    got = prefix.running(df, ["k"], ["t", "i"], values, slices)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "t", "i", "v", F.sum("w").over(w).alias("w"), F.last("v", True).over(w).alias("l"), F.max("v").over(w).alias("m"), F.sum("w").over(w).alias("s"), F.bit_xor("w").over(w).alias("x"))
    assert got.columns == ["k", "t", "i", "v", "w", "l", "m", "s", "x"] and rows_of(got, *got.columns) == rows_of(want, *got.columns)
    assert prefix.running(df.filter("k = 'z'"), ["k"], ["t", "i"], values, slices).count() == 0


def test_a_hot_key_takes_many_tasks(spark):
    """Nine tenths of all rows have one key; no partition that makes the result holds more than a third of them."""
    right = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), F.col("id").alias("t"), (F.col("id") * 3).alias("v"))
    left = spark.range(0, 20_000, 7).select(F.lit("hot").alias("k"), (F.col("id") + 1).alias("at"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        plain, sliced = (pit.as_of(left, right, ["k"], "at", "t", slices=n) for n in (1, 24))
        assert rows_of(plain, "k", "at", "hit.v") == rows_of(sliced, "k", "at", "hit.v")
        share = [max(r["n"] for r in df.select("hit.v", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.max("v")).collect()) / left.count() for df in (plain, sliced)]
        assert share[0] == 1 and share[1] < 1 / 3
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def plain_resolve(ask, history):
    held = [h for h in history if h[1] == ask[0] and h[2] == ask[1] and None not in ask and h[3] is not None and h[3] <= ask[2] and (h[4] is None or ask[2] <= h[4])]
    return len(held), held[0][0] if len(held) == 1 else None


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("slices", [1, 5])
def test_interval_sweep_against_all_pairs(spark, kind, slices):
    rng = random.Random(7)
    day = lambda: rng.choice([None, *(DAY + dt.timedelta(days=k) for k in range(40))])
    name = lambda i: None if i % 41 == 0 else i if kind == "long" else f"i{i}"
    history = [(name(i), rng.choice(["s", "t", None]), rng.choice(["x", None]), day(), day()) for i in range(120)]
    asks = sorted({(rng.choice(["s", "t", "u", None]), rng.choice(["x", None]), day()) for _ in range(150)}, key=key)
    got = pit.interval_resolve(spark.createDataFrame(asks, "symbol string, exchange string, day date"), spark.createDataFrame(history, f"inst {kind}, symbol string, exchange string, valid_from date, valid_to date"), slices=slices)
    assert rows_of(got, *got.columns) == sorted(((*a, *plain_resolve(a, history)) for a in asks), key=key)


def test_interval_sweep_is_linear_on_one_symbol(spark):
    """100,000 intervals and 100,000 asks of one symbol: no join of the two."""
    h = spark.range(100_000).select(F.col("id").alias("inst"), F.lit("s").alias("symbol"), F.lit("x").alias("exchange"), F.col("id").alias("valid_from"), F.col("id").alias("valid_to"))
    asks = spark.range(100_000).select(F.lit("s").alias("symbol"), F.lit("x").alias("exchange"), F.col("id").alias("day"))
    out = pit.interval_resolve(asks, h, slices=8)
    assert out.filter("matches = 1 AND inst = day").count() == 100_000
    with pytest.raises(Exception, match="several instruments"):
        pit.interval_resolve(asks, h.unionByName(h), strict=True).collect()


@pytest.mark.parametrize("most,bins", [(100_000, 4096), (10, 4), (3, 2)])
def test_quantiles_are_exact(spark, most, bins):
    rng = random.Random(most)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), float("inf"), 5.0, rng.gauss(0, 1), rng.lognormvariate(0, 9), -1e308, 1e308])) for _ in range(700)] + [("one", 3.0), ("none", None), ("alike", 2.0), ("alike", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    ps = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: r for r in prefix.exact_quantiles(df, ["k"], "x", ps, bins, most).collect()}
    for k in ("a", "b", None, "one", "alike"):
        own = [x for kk, x in rows if kk == k and x is not None and np.isfinite(x)]
        assert got[k]["n"] == len(own)
        for i, p in enumerate(ps):
            at = sorted(own)
            e = p * (len(own) - 1)
            assert got[k][f"q{i}"] == at[int(e)] + (at[-int(-e // 1)] - at[int(e)]) * (e - int(e))
    assert "none" not in got and prefix.exact_quantiles(df.filter("k = 'z'"), ["k"], "x").count() == 0
    finite = df.filter("x IS NOT NULL AND abs(x) < 1e300")
    assert prefix.exact_quantiles(finite, [], "x", (0.5,), bins, most).first()["q0"] == statistics.median(r["x"] for r in finite.collect())


def _bars(spark, names, days, hole=None):
    rng = random.Random(4)
    rows = []
    for i in range(names):
        p = 100.0
        for k in range(days):
            p = max(0.0, p * (1 + rng.gauss(0, 0.02)))
            if (i + k) % 11 or i == 0:
                rows.append((f"n{i}", DAY + dt.timedelta(days=k), 0.0 if (i, k) == hole else p))
    return spark.createDataFrame(rows, "inst string, session date, close double"), rows


@pytest.mark.parametrize("n", [2, 5, 20])
def test_sliding_drawdown_and_beta_against_whole_windows(spark, n):
    bars, rows = _bars(spark, 4, 60, hole=(1, 30))
    at = pit.spine(bars, bars.select("session").distinct())
    dd = {(r["session"], r["inst"]): r["value"] for r in factors.max_drawdown(bars, at, n, 30).collect()}
    be = {(r["session"], r["inst"]): r["value"] for r in factors.beta(bars, at, n, 30).collect()}
    for day in {r[1] for r in rows}:
        past = {i: [(s, c) for name, s, c in rows if name == i and s < day] for i in ("n0", "n1", "n2", "n3")}
        rets = {}
        for i, p in past.items():
            tail = p[-n:]
            want = None
            if len(tail) == n and tail[0][0] >= day - dt.timedelta(days=30):
                peak, want = 0.0, 0.0
                for _, c in tail:
                    peak = max(peak, c)
                    want = max(want, 1 - c / peak if peak > 0 else 0.0)
            assert dd[day, i] == want
            tail = p[-n - 1 :]
            if len(tail) == n + 1 and tail[0][0] >= day - dt.timedelta(days=30):
                rets[i] = [b / a - 1 if a > 0 else np.nan for (_, a), (_, b) in zip(tail[:-1], tail[1:], strict=True)]
        if rets:
            market = np.array([np.nanmean([r[k] for r in rets.values()]) if any(np.isfinite(r[k]) for r in rets.values()) else np.nan for k in range(n)])
        for i in past:
            if i not in rets:
                assert be[day, i] is None
                continue
            r = np.array(rets[i])
            ok = np.isfinite(r) & np.isfinite(market)
            v = np.var(market[np.isfinite(market)], ddof=1) if np.isfinite(market).sum() > 1 else np.nan
            if ok.sum() > 1 and np.isfinite(v):
                want = 1.0 if v <= 1e-12 else ((r[ok] - r[ok].mean()) * (market[ok] - market[ok].mean())).sum() / (ok.sum() - 1) / v
                assert be[day, i] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_windows_of_risk_factors_do_not_fan_out(spark):
    bars, _ = _bars(spark, 3, 40)
    at = pit.spine(bars, bars.select("session").distinct())
    for f in (factors.max_drawdown(bars, at, 10, 30), factors.beta(bars, at, 10, 30)):
        plan = f._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
