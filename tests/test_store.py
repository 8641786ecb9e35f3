import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.sources import store


def test_artifacts(spark, tmp_path):
    files = store.Files(spark, str(tmp_path))
    k = store.put_bytes(files, b"abc")
    assert store.put_bytes(files, b"abc") == k and store.get_verified(files, k) == b"abc"
    files.put(f"{k[:2]}/{k}", b"abd", replace=True)
    with pytest.raises(ValueError):
        store.get_verified(files, k)
    with pytest.raises(ValueError):
        files.get("../x")
    assert store.snapshot(files, "p", "d", {"a": 1}, b"raw") == store.snapshot(files, "p", "d", {"a": 1}, b"raw")


def test_publish_and_inspect(spark, tmp_path):
    t = {"t": spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")}
    m = store.publish(spark, str(tmp_path), "d", "v1", t)
    assert m["tables"]["t"]["rows"] == 2 and store.inspect(spark, str(tmp_path), "d")["verified"]
    with pytest.raises(ValueError):
        store.publish(spark, str(tmp_path), "d", "v1", t)
    t["t"].limit(1).write.mode("append").parquet(f"{tmp_path}/d/v1/t")
    assert not store.inspect(spark, str(tmp_path), "d")["verified"]
    assert store.file_digests(spark, f"{tmp_path}/d/v1").filter("name = 'manifest.json'").count() == 1


def test_config_and_ids():
    assert store.merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert store.redact({"db": {"password": "x", "host": "h"}}) == {"db": {"password": "***", "host": "h"}}
    assert store.stable_id("entity", " fb") == store.stable_id("entity", "FB") != store.stable_id("entity", "MSFT")


def test_calendar(spark):
    days = {r["session"] for r in calendar.sessions(spark, "2021-12-20", "2022-07-10").collect()}
    closed = [dt.date(2021, 12, 24), dt.date(2021, 12, 31), dt.date(2022, 1, 17), dt.date(2022, 5, 30), dt.date(2022, 6, 20), dt.date(2022, 7, 4)]
    assert not days & set(closed) and dt.date(2022, 4, 15) in days  # Good Friday isn't among the rules
    t = {r["session"]: r for r in calendar.session_times(spark.createDataFrame([(dt.date(2024, 3, 8),), (dt.date(2024, 3, 11),)], "session date")).withColumn("opens", F.date_format("opens", "HH:mm")).collect()}
    assert (t[dt.date(2024, 3, 8)]["opens"], t[dt.date(2024, 3, 11)]["opens"]) == ("14:30", "13:30")
    nxt = calendar.next_session(spark.createDataFrame([(dt.date(2022, 7, 1),), (dt.date(2022, 7, 3),)], "day date"), calendar.sessions(spark, "2022-06-20", "2022-07-10")).orderBy("day").collect()
    assert [r["next"] for r in nxt] == [dt.date(2022, 7, 5)] * 2
