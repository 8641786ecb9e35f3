"""Factors by name: the plug-in surface. A factor is a function to a long table (session, inst, value, reason).

Price factors take (bars, at), factors of fundamentals (bars, at, filings).
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factors


@dataclass(frozen=True)
class Factor:
    name: str
    version: str
    direction: int
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ("bars",)

    @property
    def digest(self) -> str:
        return hashlib.sha256(f"{self.name}:{self.version}:{self.direction}:{inspect.getsource(self.make)}".encode()).hexdigest()


_KNOWN: dict[str, Factor] = {}


def register(name: str, version: str = "1", direction: int = 1, needs: tuple[str, ...] = ("bars",)):
    """Adds a factor; a name can't be taken twice."""

    def add(make):
        if name in _KNOWN:
            raise ValueError(f"factor {name} is there already")
        _KNOWN[name] = Factor(name, version, direction, make, needs)
        return make

    return add


def get(name: str) -> Factor:
    return _KNOWN[name]


def names() -> list[str]:
    return sorted(_KNOWN)


@register("momentum_12_1")
def _mom12(bars, at):
    return factors.momentum(bars, at, 252, 21, 450)


@register("momentum_6_1")
def _mom6(bars, at):
    return factors.momentum(bars, at, 126, 21, 250)


@register("volatility_60d", direction=-1)
def _vol(bars, at):
    return factors.volatility(bars, at)


@register("max_drawdown_252d", direction=-1)
def _mdd(bars, at):
    return factors.max_drawdown(bars, at)


@register("beta", direction=-1)
def _beta(bars, at):
    return factors.beta(bars, at)


#: Items of filings that the factors read.
ITEMS = ("net_income", "stockholders_equity", "total_assets", "revenue", "operating_income")


def _scored(wide: DataFrame, name: str) -> DataFrame:
    v = F.col(name)
    return wide.select("session", "inst", v.alias("value"), F.when(v.isNull(), factors.SHORT).alias("reason"))


def _of_filings(name: str, direction: int = 1, priced: bool = False):
    def make(bars, at, filings):
        facts = factors.facts_at(filings, at, list(ITEMS))
        return _scored(factors.value_family(facts, bars) if priced else factors.quality_and_growth(facts), name)

    register({"opinc_growth": "operating_income_growth"}.get(name, name), direction=direction, needs=("bars", "filings"))(make)


for _n in ("roe", "roa", "gross_profitability", "accrual_quality", "revenue_growth", "opinc_growth"):
    _of_filings(_n)
for _n in ("earnings_yield", "book_to_market", "fcf_yield"):
    _of_filings(_n, priced=True)


def compute(name: str, bars: DataFrame, at: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Scores of a factor by name from the tables that it needs."""
    f = get(name)
    return f.make(bars, at, filings) if "filings" in f.needs else f.make(bars, at)
