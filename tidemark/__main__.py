"""Command line: python -m tidemark queries | factors | run | research | composite | backtest | validate | models | paper | reconcile | lots | verify | ingest | build | sql | publish | inspect | doctor."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile

from . import catalogue
from .plans import evidence, registry, sql_facade
from .operators import ledger, universe
from .sources import ingest, market, store
from .streaming import fills

#: Reports of each study, by query.
STUDIES = {"composite": ("composite_score",), "backtest": ("backtest_ablation",), "validate": ("validation_report", "red_team"), "models": ("model_comparison", "label_shuffle_p"), "paper": ("paper_cycle",)}


def _session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _tables(pairs: list[str]) -> dict[str, str]:
    return dict(p.split("=", 1) for p in pairs)


def doctor(spark) -> dict[str, bool]:
    """Quick checks of what the engine stands on."""
    with tempfile.TemporaryDirectory() as d:
        files = store.Files(spark, d)
        return {
            "utc": spark.conf.get("spark.sql.session.timeZone") == "UTC",
            "arrow": spark.range(3).mapInPandas(lambda it: it, "id long").count() == 3,
            "artifacts": store.get_verified(files, store.put_bytes(files, b"x")) == b"x",
            "sql": sql_facade.query(spark, "SELECT count(*) AS n FROM probe", {"probe": spark.range(5)}).first()["n"] == 5,
            "factors": len(registry.names()) == 14,
            "twins": set(catalogue.oracle_sql()) <= set(catalogue.queries()),
            "hash": spark.range(1).selectExpr("sha2('x', 256) = '2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881' AS ok").first()["ok"],
            "stable": not spark.range(3).union(spark.range(0)).exceptAll(spark.range(3)).count(),
        }


def build(spark, folder: str, exchange: str, root: str, dataset: str, version: str) -> dict:
    """Strictly normalised bars and instruments of a folder of CSV files, audited and published."""
    listed = market.listings(market.read_csv(spark, f"{folder}/listings.csv", market.LISTINGS))
    raw = spark.read.option("header", True).csv(f"{folder}/prices.csv")
    bars, _ = ingest.normalise(raw, market.listed_symbols(listed), exchange.upper())
    audit = universe.quality_audit(bars).first().asDict()
    return store.publish(spark, root, dataset, version, {"bars": bars, "instruments": listed}, audit)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("queries", help="names of the research queries")
    sub.add_parser("factors", help="names, versions and directions of factors")
    sub.add_parser("doctor", help="checks of the environment")
    r = sub.add_parser("run", help="run a query over a folder of tables")
    r.add_argument("name", choices=sorted(catalogue.queries()))
    r.add_argument("folder")
    r.add_argument("--out", help="write Parquet here instead of printing JSON lines")
    f = sub.add_parser("research", help="evaluate a factor: IC summary as evidence")
    f.add_argument("factor", choices=registry.names())
    f.add_argument("folder")
    f.add_argument("--evidence", help="folder for the JSON document")
    q = sub.add_parser("sql", help="one SELECT over Parquet tables given as name=path")
    q.add_argument("select")
    q.add_argument("tables", nargs="*")
    b = sub.add_parser("publish", help="publish Parquet tables as a version of a dataset")
    i = sub.add_parser("inspect", help="manifest of a dataset version, verified")
    for x in (b, i):
        x.add_argument("root")
        x.add_argument("dataset")
        x.add_argument("version", nargs=None if x is b else "?")
    b.add_argument("tables", nargs="+")
    for name, what in (("composite", "scores of the composite of three sleeves"), ("backtest", "the study and its variants"), ("validate", "verdict on each strategy, and the cases it must see through"), ("models", "composite, ridge and trees out of sample, and the champion"), ("paper", "a forward run on paper")):
        x = sub.add_parser(name, help=what)
        x.add_argument("folder")
        x.add_argument("--evidence", help="folder for the JSON document")
    c = sub.add_parser("reconcile", help="positions that a Parquet log of fills adds up to against a broker's (inst, shares); 1 if they differ")
    l = sub.add_parser("lots", help="take in the fills that have come to a folder since the last call, and append their lots")  # noqa: E741
    v = sub.add_parser("verify", help="all evidence of a folder against its hashes; 1 if a document was changed")
    for x, names in ((c, ("fills", "broker")), (l, ("source", "out", "checkpoint")), (v, ("folder",))):
        for n in names:
            x.add_argument(n)
    g = sub.add_parser("ingest", help="fetch prices, actions or filings from a folder of CSV files; the job's state")
    g.add_argument("kind", choices=("prices", "actions", "filings"))
    for x in ("folder", "start", "end", "root"):
        g.add_argument(x)
    g.add_argument("--symbols", nargs="*", default=[])
    g.add_argument("--job")
    d = sub.add_parser("build", help="normalise prices.csv and listings.csv of a folder and publish them as a dataset version")
    for x in ("folder", "exchange", "root", "dataset", "version"):
        d.add_argument(x)
    a = p.parse_args(argv)
    if a.what == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if a.what == "factors":
        for n in registry.names():
            k = registry.get(n)
            print(f"{k.name}\t{k.version}\t{k.direction:+d}\t{k.digest[:12]}")
        return 0
    spark = _session()
    if a.what == "doctor":
        checks = doctor(spark)
        print(json.dumps(checks))
        return int(not all(checks.values()))
    if a.what == "run":
        df = catalogue.queries()[a.name](spark, a.folder)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            for row in df.toJSON().toLocalIterator():
                print(row)
    elif a.what == "research":
        doc = evidence.factor_research(spark, a.folder, a.factor)
        if a.evidence:
            evidence.write(spark, a.evidence, f"factor-{a.factor}", doc)
        print(json.dumps(doc, sort_keys=True))
    elif a.what in STUDIES:
        doc = {n: [r.asDict() for r in catalogue.queries()[n](spark, a.folder).collect()] for n in STUDIES[a.what]}  # small reports
        if a.evidence:
            evidence.write(spark, a.evidence, a.what, doc)
        print(json.dumps(doc, sort_keys=True, default=str))
    elif a.what == "reconcile":
        broken = 0
        for row in ledger.reconcile(ledger.positions(spark.read.parquet(a.fills), ["inst"]), spark.read.parquet(a.broker)).toJSON().toLocalIterator():
            broken = 1
            print(row)
        return broken
    elif a.what == "lots":
        fills.replay_lots(spark, a.source, a.out, a.checkpoint)
        print(json.dumps({"fills": fills.latest_lots(spark.read.parquet(a.out)).count()}))
    elif a.what == "verify":
        faults = evidence.verify(spark, a.folder)
        print(json.dumps(faults))
        return int(any(faults.values()))
    elif a.what == "ingest":
        print(json.dumps(ingest.ingest(spark, ingest.CsvProvider(a.folder), a.kind, a.symbols, a.start, a.end, a.root, a.job), default=str))
    elif a.what == "build":
        print(json.dumps(build(spark, a.folder, a.exchange, a.root, a.dataset, a.version)))
    elif a.what == "sql":
        for row in sql_facade.query(spark, a.select, _tables(a.tables)).toJSON().toLocalIterator():
            print(row)
    elif a.what == "publish":
        print(json.dumps(store.publish(spark, a.root, a.dataset, a.version, {n: spark.read.parquet(t) for n, t in _tables(a.tables).items()})))
    else:
        print(json.dumps(store.inspect(spark, a.root, a.dataset, a.version)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
