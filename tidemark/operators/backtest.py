"""An event-driven simulation: one fold over sessions for each variant, variants in parallel.

Signals, ranks and prices are made in Spark. What depends on the day before (cash, lots, open orders) is a fold, so that all
rows of one variant, a compact panel of its calendar and names, form one group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import capped

SCHEMA = "variant string, session date, equity double, cash double, names int, orders int, fills int, partial int, rejected int, fees double, traded double, risk string"
#: What a variant may leave out, and its value then.
DEFAULTS = {"score": "score", "k": 30, "keep_to": 40, "cash0": 1_000_000.0, "bps": 5.0, "per_share": 0.005, "participation": 0.10, "band": 0.005, "least": 100.0, "name_cap": 0.05, "sector_cap": 0.30, "unknown_cap": 0.10, "gross_cap": 1.0, "buffer": 0.01}


def simulate(panel: DataFrame, variants: DataFrame) -> DataFrame:
    """panel (session, inst, open, close, volume, sector, score, split, dividend, rebalance) run under each row of variants.

    panel may hold several scores; a variant names its own in `score`, which is how a sleeve is left out. It may also hold
    delisting: the cash a share is settled at on that session (0 for nothing). variants: variant, and any of DEFAULTS.
    A session opens with corporate actions and the open orders, sells first, closes with marks, and on a rebalance session
    plans orders for the next one. A part-filled order is not carried on; an order without a bar is rejected; an order whose
    participation cap is nothing waits. A sale is cut to what is held before its fee is taken, and one cut to nothing is no
    fill. Marks without a bar stay at the last close. Caps that don't settle are rejected, and the target stands (see capped).
    """
    rows = variants.collect()  # a few rows of parameters
    own = [{**DEFAULTS, **{k: v for k, v in r.asDict().items() if v is not None}} for r in rows]
    w = Window.partitionBy("session")
    p = panel if "delisting" in panel.columns else panel.withColumn("delisting", F.lit(None).cast("double"))
    for s in {v["score"] for v in own}:
        p = p.withColumn(f"rank_{s}", F.when(F.col(s).isNotNull(), F.row_number().over(w.orderBy(F.col(s).desc_nulls_last(), "inst"))))
    cols = ["session", "inst", "open", "close", "volume", "sector", "split", "dividend", "delisting", "rebalance"]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"rank_{v['score']}").alias("rank")) for i, v in enumerate(own)])
    dealt = p.select(*cols, F.explode(ranks).alias("v")).select(*cols, F.col("v.i").alias("i"), F.col("v.rank").alias("rank"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = own[int(pdf["i"].iloc[0])]
        cash, shares, last, sectors, pending, out = float(v["cash0"]), {}, {}, {}, [], []
        orders = fills = partial = rejected = 0
        fees = traded = 0.0
        risk = "PASS"
        real = lambda x: x is not None and not pd.isna(x)
        for day, g in pdf.sort_values(["session", "inst"]).groupby("session", sort=True):
            bar = {r.inst: r for r in g.itertuples()}
            for i, r in bar.items():  # corporate actions
                if shares.get(i) and real(r.split) and r.split > 0:
                    shares[i] *= r.split
                if shares.get(i) and real(r.dividend) and r.dividend > 0:
                    cash = round(cash + shares[i] * r.dividend, 2)
                if shares.get(i) and real(r.delisting):
                    cash = round(cash + shares.pop(i) * r.delisting, 2)
            waiting = []
            for i, q in pending:
                orders += 1
                r = bar.get(i)
                if r is None or not real(r.open) or not r.open > 0:
                    rejected += 1
                    continue
                most = math.floor(r.volume * v["participation"])
                if most <= 0:
                    waiting.append((i, q))
                    continue
                n = min(abs(q), most) if q > 0 else min(abs(q), most, shares.get(i, 0))
                if n <= 0:
                    rejected += 1
                    continue
                slip = round(r.open * v["bps"] / 1e4, 4)
                price = round(r.open + (slip if q > 0 else -slip), 4)
                fee = round(n * v["per_share"], 2)
                cash = round(cash - math.copysign(n * price, q) - fee, 2)
                shares[i] = shares.get(i, 0) + math.copysign(n, q)
                fills += 1
                partial += n < abs(q)
                fees += fee
                traded += n * price
            pending = waiting
            shares = {i: q for i, q in shares.items() if q}
            last.update({i: r.close for i, r in bar.items()})
            sectors.update({i: r.sector for i, r in bar.items() if isinstance(r.sector, str)})
            equity = cash + sum(q * last.get(i, 0.0) for i, q in shares.items())
            if g["rebalance"].iloc[0] and equity > 0:
                scored = sorted((r for r in bar.values() if real(r.rank) and not real(r.delisting)), key=lambda r: r.rank)
                keep = [r.inst for r in scored if shares.get(r.inst) and r.rank <= v["keep_to"]][: v["k"]]
                chosen = keep + [r.inst for r in scored if r.inst not in set(keep)][: v["k"] - len(keep)]
                w, risk = capped({i: (1 - v["buffer"]) / len(chosen) for i in chosen}, sectors, v["name_cap"], v["sector_cap"], v["unknown_cap"], v["gross_cap"], v["buffer"])
                plan = []
                for i in sorted(set(w) | set(shares)):
                    price = bar[i].close if i in bar else None
                    if not price or price <= 0:
                        continue
                    have, want = shares.get(i, 0), math.floor(equity * w.get(i, 0.0) / price)
                    delta, target = want - have, w.get(i, 0.0)
                    if not delta or (have and target and abs(target - have * price / equity) < v["band"]) or (target and abs(delta) * price < v["least"]):
                        continue
                    most = math.floor(bar[i].volume * v["participation"])
                    plan.append((i, math.copysign(min(abs(delta), most) if most > 0 else abs(delta), delta)))
                pending += sorted(plan, key=lambda x: x[1] > 0)
            out.append((v["variant"], day, equity, cash, len(shares), orders, fills, partial, rejected, fees, traded, risk))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.groupBy("i").applyInPandas(run, SCHEMA)


def outcomes(simulated: DataFrame) -> DataFrame:
    """(variant, sessions, cagr, sharpe, turnover, fills, fees, hash) of each variant's run; the hash stands for its whole curve."""
    from .performance import result_hash

    w = Window.partitionBy("variant").orderBy("session")
    r = simulated.withColumn("ret", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    g = r.groupBy("variant").agg(
        F.count("*").alias("sessions"), F.min_by("equity", "session").alias("first"), F.max_by("equity", "session").alias("last"), F.avg("equity").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"),
        F.max("traded").alias("traded"), F.max("fills").alias("fills"), F.max("fees").alias("fees"),
    )
    years = F.greatest(F.col("sessions") / 252.0, F.lit(1 / 252.0))
    cagr = F.pow(F.greatest(F.try_divide("last", "first"), F.lit(0.0)), 1 / years) - 1
    vol = F.col("sd") * math.sqrt(252.0)
    g = g.select("variant", "sessions", cagr.alias("cagr"), F.when(vol > 1e-12, cagr / vol).otherwise(0.0).alias("sharpe"), (F.try_divide("traded", "mean") / years).alias("turnover"), "fills", "fees")
    return g.join(result_hash(simulated.select("variant", "session", "equity")).select("variant", "hash"), "variant")
