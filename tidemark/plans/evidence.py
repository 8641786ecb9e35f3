"""Evidence: small JSON documents of results, written and read by name."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, factors, pit
from ..sources import market, store
from . import registry


def factor_research(spark: SparkSession, folder: str, factor: str, horizon: int = 21) -> dict:
    """IC statistics, quantile returns, coverage and turnover of a factor over a folder of tables; one small document."""
    bars = market.bars(spark, folder).cache()
    at = pit.spine(bars, pit.month_ends(bars))
    scores = registry.compute(factor, bars, at, market.order_filings(spark, folder)).cache()
    pairs = evaluation.joined(scores, factors.forward_returns(bars, pit.sessions(bars), (horizon,))).cache()
    ics = evaluation.ic_series(pairs).withColumn("factor", F.lit(factor)).cache()
    rank = evaluation.summary(ics, "rank_ic", ["factor"]).first()
    plain = evaluation.summary(ics, "ic", ["factor"]).first()
    by_bucket = evaluation.quantile_returns(pairs)
    cover = scores.agg(F.count("*").alias("n"), F.count("value").alias("v")).first()
    doc = {
        "factor": factor, "horizon": horizon, "digest": registry.get(factor).digest, "sections": rank["n"] if rank else 0,
        "rank_ic": {k: rank[k] for k in ("mean", "sd", "ir", "positive", "t", "nw_t")} if rank else None, "ic": {k: plain[k] for k in ("mean", "sd")} if plain else None,
        "quantiles": {str(r["bucket"]): r["annual"] for r in evaluation.quantile_summary(by_bucket).orderBy("bucket").collect()},
        "long_short": evaluation.long_short(by_bucket).first().asDict(), "coverage": cover["v"] / cover["n"] if cover["n"] else 0.0,
        "turnover": evaluation.turnover(scores).agg(F.avg("turnover")).first()[0],
    }
    for df in (ics, pairs, scores, bars):
        df.unpersist()
    return doc


def write(spark: SparkSession, folder: str, name: str, doc: dict) -> str:
    """Stores a document with its hash; returns the hash."""
    body = json.dumps(doc, sort_keys=True, default=str)
    key = hashlib.sha256(body.encode()).hexdigest()
    store.Files(spark, folder).put(f"{name}.json", json.dumps({"hash": key, "document": json.loads(body)}, sort_keys=True).encode(), replace=True)
    return key


def read(spark: SparkSession, folder: str, name: str) -> dict:
    """A document by name; raises ValueError if it was changed after it was written."""
    held = json.loads(store.Files(spark, folder).get(f"{name}.json"))
    if hashlib.sha256(json.dumps(held["document"], sort_keys=True).encode()).hexdigest() != held["hash"]:
        raise ValueError(f"{name}: content was changed")
    return held["document"]


def inventory(spark: SparkSession, folder: str) -> list[str]:
    return [n.removesuffix(".json") for n in store.Files(spark, folder).names() if n.endswith(".json")]


def verify(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """What is wrong with each document of a folder; None for a sound one."""
    out: dict[str, str | None] = {}
    for name in inventory(spark, folder):
        try:
            read(spark, folder, name)
            out[name] = None
        except (ValueError, KeyError) as e:
            out[name] = str(e)
    return out
