"""The fill ledger as a stream: each fill once, positions by account as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.ledger import next_lot

STORE = "spark.sql.streaming.stateStore.providerClass"


def each_once(fills: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of fills (fill_id, ts, ...), a repeated fill_id within the watermark dropped."""
    return fills.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fill_id"])


def running_positions(fills: DataFrame, key: str = "inst") -> DataFrame:
    """A stream of (key, shares, cash, fills) after each batch (output mode update): net shares and signed cash, summed as state."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return fills.groupBy(key).agg(F.sum(sign * F.col("qty")).alias("shares"), F.sum(-sign * F.col("qty") * F.col("price")).alias("cash"), F.count("*").alias("fills"))


class LotBook(StatefulProcessor):
    """Lots of one key as state: the lot as of the watermark, and the fills since, by time and id.

    A fill changes all lots behind it, so that one that comes late within the watermark restates them: they go out again with a
    greater revision. When the watermark passes, a timer folds the fills before it into the lot and forgets them, so that a
    busy key holds no more than the fills of the watermark's delay. A fill_id that is still held is taken once.

    All of a key's state is one value, read once and written once a call, since each call to the store goes to another
    process: a map with an entry a fill cost two of them a fill.
    """

    def __init__(self, key: str, oversell: str):
        self.row, self.oversell = Row(key, "fill_id", "revision", "shares", "cost", "gain"), oversell

    def init(self, handle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "shares long, cost double, gain double, revision long, micros array<long>, fill_ids array<long>, sides array<string>, qtys array<long>, prices array<double>")

    def _state(self) -> tuple[tuple, int, dict]:
        got = self.book.get()
        if not got:
            return (0, 0.0, 0.0), 0, {}
        return (got[0], got[1], got[2]), got[3], dict(zip(zip(*got[4:6], strict=True), zip(*got[6:9], strict=True), strict=True))

    def _save(self, lot: tuple, revision: int, held: dict) -> None:
        micros, ids = ([at[k] for at in held] for k in range(2))
        self.book.update((*lot, revision, micros, ids, *([fill[k] for fill in held.values()] for k in range(3))))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        lot, revision, held = self._state()
        first, ids, earliest = min(held, default=None), {k[1] for k in held}, None
        for r in rows:
            if r.fill_id in ids:
                continue
            at = (r.micros, r.fill_id)
            ids.add(r.fill_id)
            held[at] = (r.side, r.qty, r.price)
            earliest = at if earliest is None else min(earliest, at)
        if earliest is None:
            return
        self._save(lot, revision + 1, held)
        if first is None or earliest < first:  # else the timer of the first is set
            self.handle.registerTimer(earliest[0] // 1000 + 1)
        for at in sorted(held):
            lot = next_lot(lot, *held[at], self.oversell, str(key[0]))
            if at >= earliest:
                yield self.row(key[0], at[1], revision + 1, *lot)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        lot, revision, held = self._state()
        passed, n = timerValues.getCurrentWatermarkInMs() * 1000, len(held)
        for at in sorted(held):
            if at[0] >= passed:
                self.handle.registerTimer(at[0] // 1000 + 1)
                break
            lot = next_lot(lot, *held.pop(at), self.oversell, str(key[0]))
        if len(held) < n:
            self._save(lot, revision, held)
        return iter(())

    def close(self) -> None:
        pass


def lots_as_they_come(fills: DataFrame, key: str = "inst", late: str = "1 day", oversell: str = "cut") -> DataFrame:
    """A stream of (key, fill_id, revision, shares, cost, gain): the lot after each fill, again with a greater revision where a later
    arrival has changed it. The last revision of a fill is what operators.ledger.lots gives for all fills that were taken.

    Fills (fill_id, ts, key, side, qty, price) older than the watermark are left out, as are repeated ones; what is too late
    for it is a restatement, for which the log is replayed with operators.ledger.lots. The state store has to be RocksDB.
    """
    kind = dict(fills.dtypes)[key]
    rows = fills.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    rows = rows.select(key, "ts", "micros", F.col("fill_id").cast("long"), "side", F.col("qty").cast("long"), F.col("price").cast("double"))
    return rows.groupBy(key).transformWithState(LotBook(key, oversell), f"{key} {kind}, fill_id long, revision long, shares long, cost double, gain double", "Append", "EventTime")


def replay_lots(spark, source: str, out: str, checkpoint: str, key: str = "inst", late: str = "1 day", files: int | None = None) -> None:
    """Takes in all fills that have come to the Parquet folder `source` since the last call, and appends their lots to `out`.

    Started again from its checkpoint it goes on where it ended, or was ended: offsets, state and output files are committed
    together. files is how many new files a batch takes.
    """
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files or 1000).parquet(source)
    had = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = lots_as_they_come(stream, key, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, had) if had else spark.conf.unset(STORE)


def latest_lots(rows: DataFrame, key: str = "inst") -> DataFrame:
    """(key, fill_id, shares, cost, gain): the last revision of each fill."""
    return rows.groupBy(key, "fill_id").agg(F.max_by(F.struct("shares", "cost", "gain"), "revision").alias("lot")).select(key, "fill_id", "lot.*")


def idempotent_append(path: str, key: str = "fill_id", time: str | None = None):
    """A foreachBatch sink: rows whose key the Parquet log at path already holds are left out.

    With `time` the log is kept by day, and a batch is compared with the days that it touches alone, since what is sent again
    bears its old time; the days of a batch are few. Without it the whole log is read.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if time:
            new = new.withColumn("day", F.to_date(time))
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            log = spark.read.parquet(path)
            if time:
                log = log.filter(F.col("day").isin([r["day"] for r in new.select("day").distinct().collect()]))
            new = new.join(log.select(key), key, "left_anti")
        out = new.withColumn("epoch", F.lit(epoch)).write.mode("append")
        (out.partitionBy("day") if time else out).parquet(path)

    return sink


class PaperStore:
    """State of paper accounts under a folder: fills once each, the account and its positions as last saved."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def record_fills(self, fills: DataFrame, epoch: int = 0) -> None:
        idempotent_append(f"{self.path}/fills", time="ts" if "ts" in fills.columns else None)(fills, epoch)

    def load_fills(self, account: str | None = None) -> DataFrame:
        """Fills in order of time and id."""
        f = self.spark.read.parquet(f"{self.path}/fills")
        return (f.filter(F.col("account") == account) if account else f).orderBy("ts", "fill_id")

    def save(self, name: str, rows: DataFrame, version: int) -> None:
        """A version of accounts or positions; loading takes each account's last one, so that a snapshot replaces what was there."""
        rows.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        t = self.spark.read.parquet(f"{self.path}/{name}")
        return t.join(t.groupBy("account").agg(F.max("version").alias("version")), ["account", "version"], "left_semi")

    def replay(self) -> DataFrame:
        """(account, inst, shares) that all fills add up to."""
        sign = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
        return self.load_fills().groupBy("account", "inst").agg(F.sum(sign).alias("shares")).filter("shares != 0")
