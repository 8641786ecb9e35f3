"""Tables of the research domain: bars, actions, filings, vintages, fills, from CSV files, Parquet or the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Explicit schemas; nothing is inferred.
LISTINGS = "symbol string, name string, exchange string, listed_date date, delisted_date date, is_etf string, sector string"
PRICES = "date date, symbol string, open decimal(20,6), high decimal(20,6), low decimal(20,6), close decimal(20,6), volume decimal(24,4), observed_at timestamp"
ACTIONS = "effective_date date, symbol string, action_type string, value decimal(20,6), split_ratio decimal(20,6), ratio decimal(20,6), cash_amount decimal(20,6), available_at timestamp"
FILINGS = "symbol string, metric string, period_end date, filing_date date, available_at timestamp, value decimal(24,2), is_restatement string, source string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, columns by name; those that the file lacks are null."""
    fields = T._parse_datatype_string(schema)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(F.expr(f"try_cast(trim(`{have[f.name]}`) AS {f.dataType.simpleString()})") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def listings(raw: DataFrame) -> DataFrame:
    """Instruments of a listings table: upper-case symbols, type, sector or UNKNOWN, status by delisting."""
    etf = F.lower(F.trim("is_etf")).isin("true", "1")
    return raw.select(
        F.sha2(F.upper(F.trim("symbol")).cast("binary"), 256).alias("instrument_id"), F.upper(F.trim("symbol")).alias("symbol"), "name", F.upper(F.trim("exchange")).alias("exchange"),
        F.when(etf, "etf").otherwise("equity").alias("type"), F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("UNKNOWN")).alias("sector"),
        F.col("listed_date").alias("active_from"), F.col("delisted_date").alias("active_to"), F.when(F.col("delisted_date").isNull(), "active").otherwise("delisted").alias("status"),
    )


def listed_symbols(listed: DataFrame) -> DataFrame:
    """(inst, symbol, exchange, valid_from, valid_to) of instruments: who held which symbol when."""
    return listed.select(F.col("instrument_id").alias("inst"), "symbol", "exchange", F.col("active_from").alias("valid_from"), F.col("active_to").alias("valid_to"))


def impute_prices(raw: DataFrame) -> DataFrame:
    """Bars of a price table: rows without a close go; open falls to close, high and low to the outer of both, volume to 100000."""
    o = F.coalesce("open", "close")
    return raw.filter(F.col("close").isNotNull()).withColumns({"open": o, "high": F.coalesce("high", F.greatest(o, "close")), "low": F.coalesce("low", F.least(o, "close")), "volume": F.coalesce(F.col("volume"), F.lit(100000).cast(raw.schema["volume"].dataType))})


def actions(raw: DataFrame) -> DataFrame:
    """Corporate actions: either name of the ratio and of the cash amount is taken."""
    return raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.lower("action_type").alias("action_type"), "effective_date", F.coalesce("available_at", F.to_timestamp(F.concat(F.col("effective_date").cast("string"), F.lit(" 09:00:00")))).alias("available_at"), F.coalesce("ratio", "split_ratio").alias("ratio"), F.coalesce("cash_amount", "value").alias("cash_amount"))


def filings(raw: DataFrame) -> DataFrame:
    """Filings: the filing date falls to the period's end, availability to 21:00 of the filing date."""
    filed = F.coalesce("filing_date", "period_end")
    return raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.lower(F.trim("metric")).alias("metric"), "period_end", filed.alias("filing_date"), F.coalesce("available_at", F.to_timestamp(F.concat(filed.cast("string"), F.lit(" 21:00:00")))).alias("available_at"), "value", F.lower(F.trim("is_restatement")).isin("true", "1").alias("is_restatement"))


def fetch(raw: DataFrame, symbols: list[str], start: str, end: str, date: str = "date") -> DataFrame:
    """Provider fetch: the named symbols, all if none, within inclusive dates; both filters reach the scan."""
    out = raw.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.filter(F.upper("symbol").isin([s.upper() for s in symbols])) if symbols else out


def write_bars(bars: DataFrame, path: str, dataset: str = "default") -> None:
    """Bars by dataset, semantic and year, sorted by instrument within a file; only the partitions written are replaced.

    Instruments aren't partitions: files would be small without end. Sorted files prune them by their statistics.
    """
    out = bars.withColumns({"dataset_id": F.lit(dataset), "year": F.year("session")})
    keys = ("dataset_id", "semantic", "year")
    out.repartition(*keys).sortWithinPartitions("instrument_id", "session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_bars(spark: SparkSession, path: str, start: str, end: str, semantic: str = "raw", dataset: str = "default") -> DataFrame:
    """Bars of a date range of one dataset; dataset, semantic and year prune partitions, the dates reach the scan."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return spark.read.parquet(path).filter((F.col("dataset_id") == dataset) & (F.col("semantic") == semantic) & F.col("year").between(F.year(s), F.year(e)) & F.col("session").between(s, e))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key, nulls equal, isn't in old yet, one of each key."""
    cond = None
    for k in key:
        c = old[k].eqNullSafe(new[k])
        cond = c if cond is None else cond & c
    return new.join(old.select(*key), cond, "left_anti").dropDuplicates(key)


# ---- the star-schema tables as market data ----------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many parts, and customers, the names of one issue stand for; more of them make more names.
PARTS, HOLDERS = 2000, 1500


def issue(name: Column, k: str, size: int) -> Column:
    """The name, with the number of its issue for keys beyond the first `size`, so that names grow with the table."""
    return F.when(F.col(k) <= size, name).otherwise(F.concat(name, F.lit("."), F.floor((F.col(k) - 1) / size).cast("string")))


def _held(k: str = "o_custkey") -> Column:
    return issue(F.concat(F.lit("Brand#"), (F.col(k) % 25 + 1).cast("string")), k, HOLDERS)


def bars(spark: SparkSession, sf_dir: str, weekdays: bool = True, issues: bool = True) -> DataFrame:
    """(inst, session, open, high, low, close, volume): lines of a day and name are its trades, in order of their key. A name is a
    brand's issue of 2,000 parts in a row, so that there are 25 names for each of these; without issues it is a brand."""
    name = issue(F.col("p_brand"), "p_partkey", PARTS) if issues else F.col("p_brand")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("session"))
    li = li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("inst")), "l_partkey")
    if weekdays:
        li = li.filter(F.weekday("session") < 5)
    px, k = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.groupBy("inst", "session").agg(F.min_by(px, k).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, k).alias("close"), F.sum("l_quantity").alias("volume"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst, sector): type of the first part of each name."""
    return table(spark, sf_dir, "part").groupBy(issue(F.col("p_brand"), "p_partkey", PARTS).alias("inst")).agg(F.min_by("p_type", "p_partkey").alias("sector"))


def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst, kind, effective, available, ratio, cash): rare orders as splits and dividends."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("effective"))
    o = o.withColumn("kind", F.when(F.col("o_orderkey") % 997 == 0, "split").when(F.col("o_orderkey") % 211 == 0, "dividend")).filter("kind IS NOT NULL")
    return o.select(_held().alias("inst"), "kind", "effective", F.date_add("effective", (F.col("o_orderkey") % 5).cast("int")).alias("available"), F.when(F.col("kind") == "split", 2.0).alias("ratio"), F.when(F.col("kind") == "dividend", 0.5).alias("cash"), F.col("o_orderkey").alias("id"))


#: What each order priority reports.
METRICS = {"1-URGENT": "net_income", "2-HIGH": "stockholders_equity", "3-MEDIUM": "total_assets", "4-NOT SPECIFIED": "revenue", "5-LOW": "operating_income"}


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst, metric, period_end, available, value, id): orders as filings on the last quarter, known 45 days on."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
    metric = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[F.col("o_orderpriority")]
    return o.select(_held().alias("inst"), metric.alias("metric"), F.date_sub(F.add_months(F.trunc("d", "quarter"), 3), 1).alias("period_end"), F.date_add("d", 45).alias("available"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


def event_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, period, release, value, id): events as releases of a daily series."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("period"), F.col("ts").alias("release"), "value", F.col("event_id").alias("id"))


def event_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fill_id, inst, side, qty, price, ts): purchases buy, errors sell."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.select(F.col("event_id").alias("fill_id"), F.col("user_id").alias("inst"), F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"), (F.floor("value") % 50 + 1).cast("long").alias("qty"), "value", "ts").withColumnRenamed("value", "price")


def symbol_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst, symbol, exchange, valid_from, valid_to): customers as holders of symbols for a while."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 7 % 2000).cast("int"))
    end = F.when(F.col("c_custkey") % 5 != 0, F.date_add(start, (F.col("c_custkey") % 400 + 90).cast("int")))
    return c.select(F.col("c_custkey").alias("inst"), F.concat(F.lit("SYM"), (F.col("c_custkey") % 50).cast("string")).alias("symbol"), F.col("c_mktsegment").alias("exchange"), start.alias("valid_from"), end.alias("valid_to"))
