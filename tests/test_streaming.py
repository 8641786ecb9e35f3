import datetime as dt
import random

from pyspark.sql import Row

from tidemark.operators import ledger
from tidemark.streaming import fills as stream

SCHEMA = "fill_id long, inst string, side string, qty long, price double, ts timestamp"


def test_fills_once_and_positions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, "a", "BUY", 10, 2.0, t), (1, "a", "BUY", 10, 2.0, t), (2, "a", "SELL", 4, 3.0, t), (3, "b", "BUY", 5, 1.0, t)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = stream.running_positions(stream.each_once(src)).writeStream.outputMode("update").format("memory").queryName("positions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["inst"], r["shares"], r["cash"], r["fills"]) for r in spark.sql("SELECT * FROM positions").collect()} == {("a", 6, -8.0, 2), ("b", 5, -5.0, 1)}


def test_idempotent_append(spark, tmp_path):
    sink = stream.idempotent_append(str(tmp_path / "log"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "fill_id long, v string")
    sink(a, 0)
    sink(a.unionByName(spark.createDataFrame([(3, "z")], "fill_id long, v string")), 1)
    assert sorted(r["fill_id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2, 3]


def _fills(n, seed, start=0):
    rng = random.Random(seed)
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(start + i, rng.choice("abc"), rng.choice(["BUY", "BUY", "SELL"]), rng.randint(1, 50), round(rng.uniform(1, 9), 2), t + dt.timedelta(minutes=7 * (start + i) + rng.randint(0, 60))) for i in range(n)]


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_lots_survive_restart_repeats_and_late_fills(spark, tmp_path):
    """Files in and out of order, some sent twice, the query started anew after each: as the replay of the whole log."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = _fills(240, 5)
    for k, part in enumerate((rows[:80], rows[:40] + rows[100:160], rows[80:100] + rows[160:], rows[200:])):  # 80 to 99 come late
        _write(spark, part, src)
        stream.replay_lots(spark, src, out, cp, late="12 hours")
        if k == 1:
            early = stream.latest_lots(spark.read.parquet(out)).count()
    got = stream.latest_lots(spark.read.parquet(out)).collect()
    want = ledger.lots(spark.createDataFrame(rows, SCHEMA), oversell="cut").collect()
    assert early == 140 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.read.parquet(out).groupBy("fill_id").count().agg({"count": "max"}).first()[0] > 1  # something was restated


def test_fills_behind_the_watermark_are_left_to_the_batch_replay(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = _fills(300, 6)
    for part in (rows[:100] + rows[110:], rows[100:110], rows[295:]):
        _write(spark, part, src)
        stream.replay_lots(spark, src, out, cp, late="1 hour")
    got = sorted(map(tuple, stream.latest_lots(spark.read.parquet(out)).collect()))
    assert got == sorted(map(tuple, ledger.lots(spark.createDataFrame(rows[:100] + rows[110:], SCHEMA), oversell="cut").collect()))


def test_lots_of_a_busy_key_pass_in_order(spark):
    rows = [(i, "a", "BUY", 1, 1.0 + i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(30_000)]
    out = ledger.lots(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert out.agg({"shares": "max"}).first()[0] == 30_000 and out.filter("shares != fill_id + 1").count() == 0


class _Store:
    """Counts the calls that a key's state takes."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value


def test_state_calls_do_not_grow_with_fills():
    took = []
    for n in (2, 200):
        book, at = stream.LotBook("inst", "cut"), _Store()
        book.init(at)
        rows = [Row(micros=1_000_000 * k, fill_id=k, side="BUY", qty=1, price=2.0) for k in range(n)]
        assert [r.shares for r in book.handleInputRows(("a",), iter(rows), None)] == list(range(1, n + 1))
        late = [Row(micros=1_000_000 * n + 5, fill_id=n, side="SELL", qty=1, price=3.0), rows[0]]  # a later one, and a repeated one
        assert [(r.fill_id, r.revision, r.shares) for r in book.handleInputRows(("a",), iter(late), None)] == [(n, 2, n - 1)]
        passed = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 1000 * n})()  # noqa: B023
        assert list(book.handleExpiredTimer(("a",), passed, None)) == []
        assert at.kept[:4] == (n, 2.0, 0.0, 2) and at.kept[5] == [n] and at.timers == [1, 1000 * n + 1]
        took.append(at.calls)
    assert took[0] == took[1] == 8
