import datetime as dt

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import connector

SCHEMA = "symbol string, date date, close double, volume long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    connector.install(spark)
    d = tmp_path_factory.mktemp("provider")
    for year in (2020, 2021, 2022):
        (d / f"year={year}").mkdir()
        with open(d / f"year={year}" / "prices.csv", "w") as f:
            f.write("symbol,date,close,volume\n")
            for k in range(1000):
                day = dt.date(year, 1, 1) + dt.timedelta(days=k % 365)
                f.write(f"S{k % 7},{day},{'' if k % 50 == 0 else k / 4},{k}\n")
    (d / "_SUCCESS").write_text("")
    return str(d)


def load(spark, folder, **options):
    return spark.read.format("provider_csv").schema(SCHEMA + ", year int").options(**options).load(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scan_is_that_of_spark_whatever_the_split(spark, folder):
    want = rows(spark.read.option("header", True).schema(SCHEMA).csv(folder).select("symbol", "date", "close", "volume", "year"))
    assert len(want) == 3000
    for size in (997, 40_000, 10**9):
        df = load(spark, folder, splitBytes=size)
        assert rows(df) == want
        assert df.rdd.getNumPartitions() == sum(-(-n // size) for _, n, _ in connector._files(folder))


def test_lines_belong_to_one_span(folder):
    """Every cut of a small file, at each byte: each line is read once."""
    path, size, _ = connector._files(folder)[0]
    schema = StructType.fromDDL(SCHEMA)
    with open(path) as f:
        lines = f.read().split("\n")[:6]
    small = path.replace("prices.csv", "_small.csv")
    with open(small, "w") as f:
        f.write("\n".join(lines))
    n = len("\n".join(lines))
    for cut in range(1, n):
        source = connector._Source(schema, {"path": small})
        got = [x for s in (connector.Span(small, 0, cut, {}), connector.Span(small, cut, n, {})) for b in source.read(s) for x in b.column(3).to_pylist()]
        assert got == [0, 1, 2, 3, 4], cut


def test_filters_reach_the_scan(spark, folder):
    reader = connector.DelimitedFiles({"path": folder}).reader(StructType.fromDDL(SCHEMA + ", year int"))
    left = list(reader.pushFilters([ds.EqualTo(("symbol",), "S3"), ds.GreaterThanOrEqual(("date",), dt.date(2021, 6, 1)), ds.EqualTo(("year",), 2021), ds.StringContains(("symbol",), "S")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "StringContains"]
    assert {s.values["year"] for s in reader.partitions()} == {"2021"}
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    assert sum(b.num_rows for b in batches) < 200 and {x for b in batches for x in b.column(0).to_pylist()} == {"S3"}
    everything = rows(load(spark, folder))
    day = dt.date(2021, 3, 1)
    for condition, keep in (
        (F.col("symbol").isin("S1", "S2") & (F.col("date") > F.lit(day)), lambda r: r[0] in ("S1", "S2") and r[1] > day), (F.col("close").isNotNull() & (F.col("close") <= 9.5), lambda r: r[2] is not None and r[2] <= 9.5),
        (F.col("year") >= 2022, lambda r: r[4] >= 2022), (F.col("close").isNull(), lambda r: r[2] is None), (F.col("symbol").startswith("S6") & (F.col("volume") == 6), lambda r: r[0] == "S6" and r[3] == 6),
        ((F.col("year") == 1999), lambda r: False), (~F.col("symbol").isin("S1"), lambda r: r[0] != "S1"),
    ):
        assert rows(load(spark, folder).filter(condition)) == [r for r in everything if keep(r)]


def test_columns_of_the_header_quotes_and_bad_fields(spark, tmp_path):
    connector.install(spark)
    (tmp_path / "a.csv").write_text('name,note\nx,"one, two"\ny,"line\nend"\nz,""\nw,\n')
    df = spark.read.format("provider_csv").option("quotedLines", "true").option("splitBytes", 5).load(str(tmp_path))
    assert df.columns == ["name", "note"] and rows(df) == [("w", None), ("x", "one, two"), ("y", "line\nend"), ("z", "")]
    with pytest.raises(Exception, match="note|convert|Invalid"):
        spark.read.format("provider_csv").schema("name string, note int").option("quotedLines", "true").load(str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("provider_csv").schema("name string").load(str(tmp_path / "none")).collect() == []


def test_new_files_come_as_a_stream(spark, tmp_path):
    connector.install(spark)
    src, out, cp = (tmp_path / x for x in ("in", "out", "cp"))
    src.mkdir()
    total = 0
    for k in range(3):
        (src / f"part{9 - k}.csv").write_text("fill_id,qty\n" + "".join(f"{k}-{i},{i}\n" for i in range(50)))
        stream = spark.readStream.format("provider_csv").schema("fill_id string, qty long").option("splitBytes", 64).load(str(src))
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).start()
        q.processAllAvailable()
        q.stop()
        total += 50
        got = spark.read.parquet(str(out))
        assert got.count() == total == got.select("fill_id").distinct().count()
