import datetime as dt
import json
import os

import pytest

from tidemark import __main__ as cli
from tidemark.plans import evidence

DATA = "/root/testdata/sf0.001"


def test_lists(capsys):
    assert cli.main(["queries"]) == 0 and "bars_daily" in capsys.readouterr().out
    assert cli.main(["factors"]) == 0 and "momentum_12_1" in capsys.readouterr().out


def test_doctor(spark):
    assert all(cli.doctor(spark).values())


def test_evidence(spark, tmp_path):
    evidence.write(spark, str(tmp_path), "a", {"x": 1})
    assert evidence.read(spark, str(tmp_path), "a") == {"x": 1} and evidence.inventory(spark, str(tmp_path)) == ["a"]
    held = json.loads((tmp_path / "a.json").read_text())
    held["document"]["x"] = 2
    os.remove(tmp_path / ".a.json.crc") if (tmp_path / ".a.json.crc").exists() else None
    (tmp_path / "a.json").write_text(json.dumps(held))
    with pytest.raises(ValueError):
        evidence.read(spark, str(tmp_path), "a")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_commands(spark, capsys, tmp_path):
    assert cli.main(["run", "month_end_sessions", DATA]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) > 50
    assert cli.main(["sql", "SELECT count(*) AS n FROM r", f"r={DATA}/region.parquet"]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"n": 5}
    assert cli.main(["publish", str(tmp_path), "d", "v1", f"region={DATA}/region.parquet"]) == 0
    capsys.readouterr()
    assert cli.main(["inspect", str(tmp_path), "d"]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["verified"]
    doc = evidence.factor_research(spark, DATA, "volatility_60d")
    assert doc["factor"] == "volatility_60d" and 0 <= doc["coverage"] <= 1


def test_reconcile_lots_and_verify(spark, capsys, tmp_path):
    fills = [(1, "a", "BUY", 10, 2.0, dt.datetime(2024, 1, 1)), (1, "a", "BUY", 10, 2.0, dt.datetime(2024, 1, 1)), (2, "a", "SELL", 4, 3.0, dt.datetime(2024, 1, 2)), (3, "b", "BUY", 5, 1.0, dt.datetime(2024, 1, 2))]
    spark.createDataFrame(fills, "fill_id long, inst string, side string, qty long, price double, ts timestamp").write.parquet(str(tmp_path / "fills"))
    for name, rows in (("same", [("a", 6), ("b", 5)]), ("other", [("a", 7), ("c", 1)])):
        spark.createDataFrame(rows, "inst string, shares long").write.parquet(str(tmp_path / name))
    assert cli.main(["reconcile", str(tmp_path / "fills"), str(tmp_path / "same")]) == 0 and capsys.readouterr().out == ""
    assert cli.main(["reconcile", str(tmp_path / "fills"), str(tmp_path / "other")]) == 1
    assert sorted(json.loads(x)["kind"] for x in capsys.readouterr().out.strip().split("\n")) == ["MISSING_AT_BROKER", "QUANTITY", "UNKNOWN_AT_OWN"]
    assert cli.main(["lots", *(str(tmp_path / x) for x in ("fills", "lots", "checkpoint"))]) == 0
    assert json.loads(capsys.readouterr().out) == {"fills": 3}
    evidence.write(spark, str(tmp_path / "evidence"), "a", {"x": 1})
    assert cli.main(["verify", str(tmp_path / "evidence")]) == 0
    (tmp_path / "evidence" / "b.json").write_text('{"hash": "0", "document": {"x": 2}}')
    assert cli.main(["verify", str(tmp_path / "evidence")]) == 1
