"""Portfolio construction and orders, section by section."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _section():
    return Window.partitionBy("session")


def top_k(scores: DataFrame, k: int = 30, keep_to: int = 40, held: DataFrame | None = None) -> DataFrame:
    """(session, inst, rank, reason): names held and ranked within `keep_to` first, then by score; ties in order of name."""
    w = _section().orderBy(F.desc("value"), "inst")
    s = scores.filter("value IS NOT NULL").withColumn("rank", F.row_number().over(w))
    s = s.join(held.select("session", "inst").withColumn("__h", F.lit(True)), ["session", "inst"], "left") if held is not None else s.withColumn("__h", F.lit(None).cast("boolean"))
    stay = F.coalesce(F.col("__h"), F.lit(False)) & (F.col("rank") <= keep_to)
    s = s.withColumn("__s", stay).withColumn("__o", F.row_number().over(_section().orderBy(F.desc("__s"), "rank")))
    return s.filter(F.col("__o") <= k).select("session", "inst", "value", "rank", F.when(F.col("__s"), "buffer_hold").otherwise("top_k_entry").alias("reason"))


def equal_weights(chosen: DataFrame, cash: float = 0.01) -> DataFrame:
    """Equal weights to 6 places; what rounding leaves goes to the best rank."""
    n = F.count("*").over(_section())
    total = F.lit(1 - cash)
    w = F.bround(total / n, 6)
    first = F.row_number().over(_section().orderBy("rank")) == 1
    return chosen.withColumn("weight", F.round(w + F.when(first, total - w * n).otherwise(0.0), 6))


def inverse_volatility_weights(chosen: DataFrame, risk: DataFrame, cash: float = 0.01) -> DataFrame:
    """Weights by 1 / volatility to 6 places; a missing or tiny volatility counts as 0.20."""
    j = chosen.join(risk.select("session", "inst", F.col("value").alias("vol")), ["session", "inst"], "left")
    inv = 1 / F.when(F.col("vol") > 1e-4, F.col("vol")).otherwise(0.20)
    total = F.lit(1 - cash)
    j = j.withColumn("__i", inv)
    j = j.withColumn("__w", F.bround(total * F.col("__i") / F.sum("__i").over(_section()), 6))
    first = F.row_number().over(_section().orderBy("rank")) == 1
    return j.withColumn("weight", F.round(F.col("__w") + F.when(first, total - F.sum("__w").over(_section())).otherwise(0.0), 6)).drop("__i", "__w", "vol")


def cap_name(w: DataFrame, cap: float = 0.05) -> DataFrame:
    return w.withColumn("weight", F.least("weight", F.lit(cap)))


def cap_sector(w: DataFrame, cap: float = 0.30, unknown: float = 0.10) -> DataFrame:
    """Sectors above their cap are scaled down to it; without a sector a name is UNKNOWN, with a cap of its own."""
    own = F.coalesce("sector", F.lit("UNKNOWN"))
    total = F.sum("weight").over(Window.partitionBy("session", own))
    limit = F.when(own == "UNKNOWN", unknown).otherwise(cap)
    return w.withColumn("weight", F.when(total > limit, F.bround(F.col("weight") * limit / total, 6)).otherwise(F.col("weight")))


def cap_gross(w: DataFrame, gross: float = 1.0, cash: float = 0.01) -> DataFrame:
    total, most = F.sum("weight").over(_section()), F.lit(min(gross, 1 - cash))
    return w.withColumn("weight", F.when(total > most, F.bround(F.col("weight") * most / total, 6)).otherwise(F.col("weight")))


def capped(weights: dict, sectors: dict, name: float = 0.05, sector: float = 0.30, unknown: float = 0.10, gross: float = 1.0, cash: float = 0.01, rounds: int = 10) -> tuple[dict, str]:
    """Weights of one section under name, sector and gross caps in turn until they stay, and PASS, ADJUST or REJECT.

    Weights that haven't settled after `rounds` are rejected, and the target stands as it was. This one rule serves apply_risk
    and the simulation.
    """
    was, w = dict(weights), dict(weights)
    for i in range(rounds):
        new = {k: min(x, name) for k, x in w.items()}
        total: dict[str, float] = {}
        for k, x in sorted(new.items()):
            total[sectors.get(k) or "UNKNOWN"] = total.get(sectors.get(k) or "UNKNOWN", 0.0) + x
        cap = {s: unknown if s == "UNKNOWN" else sector for s in total}
        new = {k: round(x * cap[s] / total[s], 6) if total[s := sectors.get(k) or "UNKNOWN"] > cap[s] else x for k, x in new.items()}
        whole, most = sum(new[k] for k in sorted(new)), min(gross, 1 - cash)
        if whole > most:
            new = {k: round(x * most / whole, 6) for k, x in new.items()}
        if all(abs(new[k] - w[k]) < 1e-9 for k in w):
            return w, "PASS" if i == 0 else "ADJUST"
        w = new
    return was, "REJECT"


def apply_risk(targets: DataFrame, **caps: float) -> DataFrame:
    """targets (session, inst, sector, weight) with the weights that caps leave and the status of their section.

    A section is a portfolio of some dozens of names, and each is settled on its own (see capped).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, status = capped(dict(zip(pdf["inst"], pdf["weight"], strict=True)), {k: v for k, v in zip(pdf["inst"], pdf["sector"], strict=True) if isinstance(v, str)}, **caps)
        return pdf.assign(weight=[w[i] for i in pdf["inst"]], status=status)[["session", "inst", "sector", "weight", "status"]]

    return targets.select("session", "inst", "sector", "weight").groupBy("session").applyInPandas(run, "session date, inst string, sector string, weight double, status string")


def construct(scores: DataFrame, members: DataFrame, k: int = 30, keep_to: int = 40, held: DataFrame | None = None, risk: DataFrame | None = None, cash: float = 0.01, name_cap: float | None = None) -> DataFrame:
    """(session, inst, rank, reason, weight): scores of a universe (session, inst), the best chosen, weighed and held to a name cap.

    Weights are equal, or by inverse volatility where risk (session, inst, value) is given.
    """
    chosen = top_k(scores.join(members.select("session", "inst"), ["session", "inst"], "left_semi"), k, keep_to, held)
    w = inverse_volatility_weights(chosen, risk, cash) if risk is not None else equal_weights(chosen, cash)
    return (cap_name(w, name_cap) if name_cap else w).select("session", "inst", "rank", "reason", "weight")


def sequenced(orders: DataFrame) -> DataFrame:
    """Orders (session, inst, side) with seq, their place in the session: sells first, then by name."""
    w = _section().orderBy(F.when(F.col("side") == "SELL", 0).otherwise(1), "inst")
    return orders.withColumn("seq", F.row_number().over(w))


def plan_orders(targets: DataFrame, holdings: DataFrame, prices: DataFrame, equity: float, band: float = 0.005, least: float = 100.0, adv_share: float = 0.10) -> DataFrame:
    """(session, inst, side, shares): what takes holdings to target weights, in whole shares.

    A name that is held and stays is left alone within the band of weight; an order under `least` in value is left out
    unless the name goes; an order is held to a share of the day's volume where that is a share at least.
    """
    j = targets.select("session", "inst", "weight").join(holdings.select("session", "inst", F.col("shares").alias("have")), ["session", "inst"], "full_outer")
    j = j.join(prices.select("session", "inst", F.col("close").alias("price"), "volume"), ["session", "inst"]).fillna(0.0, ["weight"]).fillna(0, ["have"]).filter("price > 0")
    want = F.floor(F.col("weight") * equity / F.col("price"))
    j = j.withColumn("delta", want - F.col("have"))
    drift = F.abs(F.col("weight") - F.col("have") * F.col("price") / equity)
    still = (F.col("have") > 0) & (F.col("weight") > 0) & (drift < band)
    small = (F.col("weight") > 0) & (F.abs("delta") * F.col("price") < least)
    j = j.filter((F.col("delta") != 0) & ~still & ~small)
    most = F.floor(F.col("volume") * adv_share)
    shares = F.when(most > 0, F.least(F.abs("delta"), most)).otherwise(F.abs("delta")).cast("long")
    return j.select("session", "inst", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), shares.alias("shares")).filter("shares > 0")


def concentration(w: DataFrame) -> DataFrame:
    """(session, hhi, effective, top5, top_sector, flagged)."""
    top5 = w.withColumn("__r", F.row_number().over(_section().orderBy(F.desc("weight"), "inst")))
    sect = w.groupBy("session", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(F.sum("weight").alias("s")).groupBy("session").agg(F.max("s").alias("top_sector"))
    g = top5.groupBy("session").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum(F.when(F.col("__r") <= 5, F.col("weight")).otherwise(0.0)).alias("top5")).join(sect, "session")
    return g.select("session", "hhi", F.when(F.col("hhi") > 0, F.try_divide(F.lit(1.0), F.col("hhi"))).otherwise(0.0).alias("effective"), "top5", "top_sector", ((F.col("hhi") > 0.15) | (F.col("top_sector") > 0.40)).alias("flagged"))


def brinson(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Allocation and selection over sectors (sector, weight, ret), a sector on one side alone counting 0 on the other."""
    j = portfolio.select("sector", F.col("weight").alias("wp"), F.col("ret").alias("rp")).join(benchmark.select("sector", F.col("weight").alias("wb"), F.col("ret").alias("rb")), "sector", "full_outer").fillna(0.0)
    total = j.agg(F.sum(F.col("wb") * F.col("rb")).alias("t"))
    out = j.crossJoin(F.broadcast(total)).agg(F.sum((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("t"))).alias("allocation"), F.sum(F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"))
    return out.select(F.bround("allocation", 4).alias("allocation"), F.bround("selection", 4).alias("selection"))


def diagnostics(w: DataFrame, gross_cap: float = 1.0) -> DataFrame:
    """(session, names, gross, cash, largest, hhi, effective) of the names with a weight."""
    g = w.filter("weight > 0").groupBy("session").agg(F.count("*").alias("names"), F.sum("weight").alias("gross"), F.max("weight").alias("largest"), F.sum(F.col("weight") * F.col("weight")).alias("h"))
    return g.select("session", "names", "gross", (F.lit(gross_cap) - F.col("gross")).alias("cash"), "largest", F.bround("h", 4).alias("hhi"), F.bround(F.try_divide(F.lit(1.0), F.col("h")), 2).alias("effective"))
