"""Ledgers: running balances, marks, reconciliation, replay of fills."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def execution(orders: DataFrame, bps: float = 5.0, per_share: float = 0.005, minimum: float = 0.0) -> DataFrame:
    """Orders (side, shares, open) with price after slippage and commission; no open, or one of 0 or less, rejects the order."""
    ref = F.when(F.col("open") > 0, F.bround("open", 4))
    slip = F.bround(ref * bps / 1e4, 4)
    price = F.bround(F.when(F.col("side") == "BUY", ref + slip).otherwise(ref - slip), 4)
    out = orders.withColumns({"price": price, "commission": F.when(price.isNotNull(), F.bround(F.greatest(F.col("shares") * per_share, F.lit(minimum)), 2))})
    return out.withColumn("status", F.when(F.col("price").isNull(), "REJECTED").otherwise("FILLED"))


def fill_orders(orders: DataFrame, bars: DataFrame, bps: float = 5.0, per_share: float = 0.005, minimum: float = 0.0, participation: float | None = 0.10) -> DataFrame:
    """Orders (session, inst, side, shares) met with the bars of their session: filled, price, commission and state.

    Without a bar or a price to open at an order is REJECTED; where the share of the volume allows nothing it stays SUBMITTED;
    what it allows less than asked is PARTIALLY_FILLED. Commission is on what is filled.
    """
    j = orders.join(bars.select("session", "inst", "open", "volume"), ["session", "inst"], "left")
    most = F.floor(F.col("volume") * participation) if participation is not None else F.col("shares")
    n = F.when(F.col("open") > 0, F.least(F.col("shares"), F.greatest(most, F.lit(0))).cast("long"))
    out = execution(j.withColumn("__asked", F.col("shares")).withColumn("shares", n), bps, per_share, minimum)
    state = F.when(F.col("price").isNull(), "REJECTED").when(F.col("filled") == 0, "SUBMITTED").when(F.col("filled") < F.col("shares"), "PARTIALLY_FILLED").otherwise("FILLED")
    out = out.withColumn("filled", F.coalesce("shares", F.lit(0).cast("long"))).withColumn("shares", F.col("__asked")).withColumn("state", state)
    traded = F.col("filled") > 0
    return out.select(*orders.columns, "filled", F.when(traded, F.col("price")).alias("price"), F.when(traded, F.col("commission")).alias("commission"), "state")


def balances(fills: DataFrame, cash: float, key: str = "account") -> DataFrame:
    """Cash after each fill (fill_id, ts, side, qty, price), rounded to cents at each."""
    amount = F.bround(F.when(F.col("side") == "BUY", -1.0).otherwise(1.0) * F.col("qty") * F.col("price"), 2)
    w = Window.partitionBy(key).orderBy("ts", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    return fills.withColumn("amount", amount).withColumn("balance", F.lit(cash) + F.sum("amount").over(w))


def marks(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """positions (session, inst, shares, cost) with a mark: the day's close, else the last known one, else the cost."""
    from .pit import as_of

    good = bars.filter("close > 0").select("inst", F.col("session").alias("bar_session"), "close")
    j = as_of(positions, good, ["inst"], "session", "bar_session")
    stale = F.col("hit.bar_session").isNull() | (F.col("hit.bar_session") < F.col("session"))
    return j.select("session", "inst", "shares", F.coalesce("hit.close", "cost").alias("mark"), stale.alias("stale"), (F.col("shares") * F.coalesce("hit.close", "cost")).alias("value"))


def reconcile(own: DataFrame, broker: DataFrame) -> DataFrame:
    """Positions (inst, shares) of both sides that differ; a side without the name has 0."""
    j = own.select("inst", F.col("shares").alias("own")).join(broker.select("inst", F.col("shares").alias("broker")), "inst", "full_outer").fillna(0, ["own", "broker"])
    kind = F.when(F.col("broker") == 0, "MISSING_AT_BROKER").when(F.col("own") == 0, "UNKNOWN_AT_OWN").otherwise("QUANTITY")
    return j.filter("own != broker").select("inst", "own", "broker", kind.alias("kind"), F.lit("CRITICAL").alias("severity"))


def positions(fills: DataFrame, key: list[str]) -> DataFrame:
    """Net shares of each key after all fills, each fill_id once; flat positions go."""
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    return fills.dropDuplicates(["fill_id"]).groupBy(*key).agg(F.sum(signed).alias("shares"), F.count("*").alias("fills")).filter("shares != 0")


def next_lot(lot: tuple, side: str, qty: int, price: float, oversell: str = "raise", name: str = "") -> tuple:
    """(shares, cost, gain) after one event of a lot: weighted-average cost and realised gain, rounded to 4 places as decimals are.

    side is BUY, SELL or SPLIT, which multiplies the shares by price and divides the cost by it. A sale beyond the lot fails,
    or is cut to it with oversell='cut'.
    """
    money = lambda x: float(cents(round(x, 9), 4))
    shares, cost, gain = lot
    if side == "SPLIT":
        return int(shares * price), money(cost / price), gain
    if side == "BUY":
        return shares + qty, money((shares * cost + qty * price) / (shares + qty)), gain
    if qty > shares and oversell == "raise":
        raise ValueError(f"{name}: {qty} sold of {shares}")
    qty = min(qty, shares)
    return shares - qty, cost if shares > qty else 0.0, money(gain + qty * (price - cost))


def lots(fills: DataFrame, key: str = "inst", oversell: str = "raise") -> DataFrame:
    """Weighted-average lots after each event of a key, in order of ts and fill_id: shares, cost, realised gain (see next_lot).

    The average cost is rounded at each step and so depends on the order of events: a key's events pass one after the other,
    sorted by Spark, and only its last lot is held, whatever their number.
    """

    def fold(batches):
        held, lot = None, (0, 0.0, 0.0)
        for pdf in batches:
            out = []
            for k, fill_id, side, qty, price in zip(pdf[key], pdf["fill_id"], pdf["side"], pdf["qty"], pdf["price"], strict=True):
                if k != held:
                    held, lot = k, (0, 0.0, 0.0)
                lot = next_lot(lot, side, int(qty), float(price), oversell, str(k))
                out.append((k, fill_id, *lot))
            yield pd.DataFrame(out, columns=[key, "fill_id", "shares", "cost", "gain"])

    kind = dict(fills.dtypes)[key]
    ordered = fills.select(key, "ts", "fill_id", "side", "qty", "price").repartition(key).sortWithinPartitions(key, "ts", "fill_id")
    return ordered.mapInPandas(fold, f"{key} {kind}, fill_id long, shares long, cost double, gain double")


def paper_accounts(orders: DataFrame, cash: float = 1_000_000.0, bps: float = 5.0, commission: float = 1.0) -> DataFrame:
    """(account, orders, cash, equity) after a mock broker has filled every order (account, inst, side, shares, price) at once.

    Price moves against the order by bps, to 4 places; each order pays a commission. Sums are partial before they are shuffled.
    """
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    fill = F.round(F.coalesce("price", F.lit(100.0)) * (1 + sign * bps / 1e4), 4)
    g = orders.groupBy("account").agg(F.count("*").alias("orders"), F.sum(sign * fill * F.col("shares")).alias("spent"), F.sum(sign * F.col("shares") * F.coalesce("price", F.lit(100.0))).alias("held"))
    left = F.lit(cash) - F.col("spent") - F.col("orders") * commission
    return g.select("account", "orders", F.round(left, 2).alias("cash"), F.round(left + F.col("held"), 2).alias("equity"))


def annual_turnover(fills: DataFrame, equity: DataFrame, key: str = "account") -> DataFrame:
    """(key, turnover): value traded over mean equity, a year of 252 sessions."""
    traded = fills.groupBy(key).agg(F.sum(F.col("qty") * F.col("price")).alias("traded"))
    e = equity.groupBy(key).agg(F.avg("equity").alias("mean"), F.count("*").alias("n"))
    return traded.join(e, key).select(key, F.when(F.col("n") < 2, 0.0).otherwise(F.try_divide("traded", "mean") / (F.col("n") / 252.0)).alias("turnover"))


def terminal_weights(marked: DataFrame, cash: float = 0.0) -> DataFrame:
    """(inst, weight) of the last session of marked positions (session, inst, value), cash in the whole."""
    end = marked.agg(F.max("session").alias("__last"))
    last = marked.join(F.broadcast(end), F.col("session") == F.col("__last"))  # one row
    total = F.col("__sum") + cash
    held = last.crossJoin(F.broadcast(last.agg(F.sum("value").alias("__sum"))))  # one row
    return held.select("inst", F.when(total > 0, F.try_divide("value", total)).otherwise(0.0).alias("weight"))


def cents(x: float | str | Decimal, places: int = 2) -> Decimal:
    """Half-even rounding of money on the driver."""
    return Decimal(str(x)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_EVEN)


#: Legal order states and what each may become.
TRANSITIONS = {
    "CREATED": ("SUBMITTED", "CANCELLED", "REJECTED"),
    "SUBMITTED": ("PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED"),
    "PARTIALLY_FILLED": ("FILLED", "CANCELLED"),
    "FILLED": (),
    "CANCELLED": (),
    "REJECTED": (),
}


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Rows of an order log (order_id, seq, state) whose state can't follow the one before."""
    prev = F.lag("state").over(Window.partitionBy("order_id").orderBy("seq"))
    legal = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return log.withColumn("prev", prev).filter(F.col("prev").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(legal, F.col("prev")), F.col("state")), F.lit(False)))
