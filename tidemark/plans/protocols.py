"""What a user may put in place of the engine's own parts; any object or function of the shape will do.

Bars, actions, scores, sectors, universes and calendars are DataFrames (see the operators), so that they need no protocol; a source
of raw tables is a sources.ingest.Provider, a factor a function of the registry.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..operators import ledger, portfolio


class Weighting(Protocol):
    """Chosen names (session, inst, rank, ...) to the same with a weight."""

    def __call__(self, chosen: DataFrame, cash: float) -> DataFrame: ...


class Broker(Protocol):
    """Orders (session, inst, side, shares) and bars to what became of them: filled, price, commission, state."""

    def __call__(self, orders: DataFrame, bars: DataFrame) -> DataFrame: ...


def trade(scores: DataFrame, members: DataFrame, holdings: DataFrame, bars: DataFrame, equity: float, k: int = 30, weighting: Weighting = portfolio.equal_weights, broker: Broker = ledger.fill_orders) -> DataFrame:
    """One round of every section: choose of the universe, weigh, plan against holdings, and fill on the same section's bars."""
    chosen = portfolio.top_k(scores.join(members.select("session", "inst"), ["session", "inst"], "left_semi"), k)
    orders = portfolio.plan_orders(weighting(chosen, 0.01), holdings, bars, equity)
    return broker(portfolio.sequenced(orders), bars)
