"""Ingestion: providers, retries, jobs with a status log, strict normalisation, and tables that are kept by key."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pit import interval_overlaps, interval_resolve
from ..operators.universe import quarantine
from . import market


class RateLimited(Exception):
    """A provider asks for patience."""


class Provider(Protocol):
    """Where raw tables come from; symbols and an inclusive range of dates select rows."""

    def prices(self, spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame: ...

    def actions(self, spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame: ...

    def filings(self, spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame: ...


class CsvProvider:
    """A folder with prices.csv, actions.csv and filings.csv, or folders of such names."""

    def __init__(self, folder: str):
        self.folder = folder

    def _read(self, spark, name, schema, symbols, start, end, date):
        return market.fetch(market.read_csv(spark, f"{self.folder}/{name}.csv", schema), symbols, start, end, date)

    def prices(self, spark, symbols, start, end):
        return self._read(spark, "prices", market.PRICES, symbols, start, end, "date")

    def actions(self, spark, symbols, start, end):
        return self._read(spark, "actions", market.ACTIONS, symbols, start, end, "effective_date")

    def filings(self, spark, symbols, start, end):
        return self._read(spark, "filings", market.FILINGS, symbols, start, end, "period_end")


def retry(op: Callable, tries: int = 3, wait: float = 0.5, factor: float = 2.0, on: tuple = (RateLimited,), sleep: Callable[[float], None] = time.sleep):
    """The result of op; one of the errors is tried again, `tries` times at most, after a wait that grows by `factor`."""
    for i in range(tries + 1):
        try:
            return op()
        except on:
            if i == tries:
                raise
            sleep(wait * factor**i)


# ---- tables kept by key ------------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in `order` of both sides, the new side after the old one."""
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("__side"), *[F.desc(c) for c in order])
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__side")


def upsert_instruments(old: DataFrame, new: DataFrame, history: DataFrame) -> DataFrame:
    """upsert by inst, refused where two instruments would hold a symbol at one time (history of symbol, exchange, valid_from, valid_to)."""
    clash = interval_overlaps(history).limit(1).collect()
    if clash:
        raise ValueError(f"several instruments hold {clash[0]['symbol']}")
    return upsert(old, new, ["inst"], ["version"])


def merged_updates(log: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """A log of partial updates to one row a key: of each column the last value that isn't null."""
    k = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), k)).alias(c) for c in cols])


def replace_groups(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the groups that new has rows of, and new: a snapshot of a group replaces what was there."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def append_vintages(spark: SparkSession, path: str, vintages: DataFrame) -> None:
    """Adds releases of series to a log, by series; a release sent twice stands twice, as its readers take the last."""
    vintages.write.mode("append").partitionBy("series").parquet(path)


# ---- jobs --------------------------------------------------------------------------------------------------------------------

JOB = "job_id string, kind string, status string, rows long, error string, at timestamp"


class Jobs:
    """A log of job events under a folder; the state of a job is what its events add up to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self, job_id: str, kind: str | None = None, status: str | None = None, rows: int | None = None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(job_id, kind, status, rows, error)], "job_id string, kind string, status string, rows long, error string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def states(self) -> DataFrame:
        return merged_updates(self.spark.read.schema(JOB).parquet(self.path), "job_id", ["at"], ["kind", "status", "rows", "error"])

    def create_once(self, job_id: str, kind: str) -> bool:
        """Whether the job is new; one that is there stays as it is. A file that only one can create decides between two that ask at once."""
        from .store import Files

        claims, name = Files(self.spark, f"{self.path}-claims"), uuid.uuid5(uuid.NAMESPACE_OID, job_id).hex
        try:
            claims.put(name, job_id.encode())
        except Exception:
            if claims.exists(name):
                return False
            raise
        self._log(job_id, kind, "CREATED")
        return True

    def update(self, job_id: str, status: str, rows: int | None = None, error: str | None = None) -> None:
        self._log(job_id, None, status, rows, error)


def ingest(spark: SparkSession, provider: Provider, kind: str, symbols: list[str], start: str, end: str, root: str, job_id: str | None = None) -> dict:
    """Fetches prices, actions or filings, writes them as they came, counts them; a failure is a status, not an error."""
    jobs, job_id = Jobs(spark, f"{root}/jobs"), job_id or uuid.uuid4().hex
    if not jobs.create_once(job_id, kind):
        return jobs.states().filter(F.col("job_id") == job_id).first().asDict()
    try:
        path = f"{root}/raw/{kind}/{job_id}"
        retry(lambda: getattr(provider, kind)(spark, symbols, start, end)).write.parquet(path)
        jobs.update(job_id, "COMPLETED", spark.read.parquet(path).count())
    except Exception as e:
        jobs.update(job_id, "FAILED", None, str(e)[:500])
    return jobs.states().filter(F.col("job_id") == job_id).first().asDict()


# ---- normalisation -----------------------------------------------------------------------------------------------------------


def normalise(prices: DataFrame, history: DataFrame, exchange: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw prices (symbol, date and numbers as text) to sound bars (inst, session, ...) and to the rows that were refused, with their fault.

    Faults are those of quarantine, and unresolved: no instrument held the symbol on the exchange that day. With strict=True a
    refused row fails the job once bars are read.
    """
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) AS decimal(20,6))")
    raw = prices.select(F.upper(F.trim("symbol")).alias("symbol"), F.expr("try_cast(trim(`date`) AS date)").alias("session"), *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    days = raw.filter("session IS NOT NULL").select("symbol", F.lit(exchange).alias("exchange"), F.col("session").alias("day")).distinct()
    who = interval_resolve(days, history).select("symbol", F.col("day").alias("session"), "inst")
    j = quarantine(raw.join(who, ["symbol", "session"], "left"))
    j = j.withColumn("fault", F.coalesce("fault", F.when(F.col("inst").isNull(), "unresolved")))
    cols = ["inst", "session", "open", "high", "low", "close", "volume"]
    if strict:
        fail = F.raise_error(F.concat_ws(" ", F.col("fault"), F.col("symbol"), F.col("session").cast("string"))).cast("boolean")
        return j.filter(F.when(F.col("fault").isNotNull(), fail).otherwise(F.lit(True))).select(*cols), j.filter("fault IS NOT NULL")
    return j.filter("fault IS NULL").select(*cols), j.filter("fault IS NOT NULL")


# ---- rosters -----------------------------------------------------------------------------------------------------------------


def newest(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the last version, by number, under root/<version>/<table>."""
    from .store import Files, by_number

    version = max({n.split("/")[0] for n in Files(spark, root).names()}, key=by_number)
    return spark.read.parquet(f"{root}/{version}/{table}")


def roster(members: DataFrame, kind: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Members of a kind ('equity', 'etf'; none: all), of some symbols if given, in order of symbol."""
    out = members.filter(F.col("type") == kind) if kind else members
    return (out.filter(F.col("symbol").isin([s.upper() for s in symbols])) if symbols else out).orderBy("symbol")
