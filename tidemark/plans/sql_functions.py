"""Functions for read-only SQL: scalar ones that Spark inlines, sections as a table function, factors by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import lit, udtf

from . import registry

#: Scalar functions as Spark SQL: name, parameters, result, body. They follow functions/cross_section.py.
SCALARS = (
    ("safe_ratio", "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b IS NOT NULL AND NOT isnan(b) AND abs(b) < double('infinity') AND abs(b) >= 1e-6 THEN a / b END"),
    ("simple_return", "now DOUBLE, before DOUBLE", "DOUBLE", "CASE WHEN before > 0 THEN now / before - 1 END"),
    ("held_between", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(least(x, high), low) END"),
    ("standard_score", "x DOUBLE, mean DOUBLE, sd DOUBLE", "DOUBLE", "CASE WHEN x IS NULL THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE try_divide(x - mean, sd) END"),
    ("robust_score", "x DOUBLE, median DOUBLE, mad DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL AND 1.4826 * mad >= 1e-12 THEN (x - median) / (1.4826 * mad) END"),
    ("basis_points", "cost DOUBLE, traded DOUBLE", "DOUBLE", "try_divide(cost, traded) * 1e4"),
)


@udtf(returnType="session date, inst string, value double")
class SectionScores:
    """section_scores(TABLE(t) PARTITION BY (session), how): rows (session, inst, value) with value as how says: 'winsor' (held
    between its 1st and 99th percentiles by position), 'z', 'rank' (ties at their mean, from 0 to 1) or 'robust'.

    A section is held by one task, as the language has it; for longer ones functions.cross_section has the same as columns.
    """

    def __init__(self):
        self.rows, self.how = [], None

    def eval(self, row, how):
        self.rows.append((row["session"], row["inst"], row["value"]))
        self.how = how

    def terminate(self):
        import numpy as np

        x = np.array([v for *_, v in self.rows if v is not None], dtype=float)
        if self.how == "winsor":
            s, n = np.sort(x), len(x)
            out = np.clip(x, s[int(np.floor(0.01 * (n - 1)))], s[int(np.ceil(0.99 * (n - 1)))]) if n >= 3 else x
        elif self.how == "rank":
            s = np.sort(x)
            out = ((np.searchsorted(s, x) + np.searchsorted(s, x, side="right") - 1) / 2 / (len(x) - 1)) if len(x) > 1 else np.full(len(x), 0.5)
        elif self.how in ("z", "robust"):
            sd = x.std() if len(x) else 0.0
            out = (x - x.mean()) / sd if sd >= 1e-12 else np.zeros(len(x))
            mad = 1.4826 * np.median(np.abs(x - np.median(x))) if len(x) else 0.0
            if self.how == "robust" and mad >= 1e-12:
                out = (x - np.median(x)) / mad
        else:
            raise ValueError(f"{self.how}: not a way to score a section")
        scored = iter(out.tolist())
        for session, inst, v in self.rows:
            yield session, inst, None if v is None else next(scored)


def install(spark: SparkSession) -> None:
    """Makes the scalar functions and section_scores known to a session."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("section_scores", SectionScores)


def install_factors(spark: SparkSession, bars: DataFrame, at: DataFrame, filings: DataFrame | None = None) -> None:
    """Makes factor(name) known: SELECT * FROM factor('momentum_12_1'), with columns session, inst, value, reason.

    Behind it is a union of all factors that the tables allow, each with its name as a constant; the name asked for folds all
    other branches away before the plan is run.
    """
    every = None
    for name in registry.names():
        if "filings" in registry.get(name).needs and filings is None:
            continue
        f = registry.compute(name, bars, at, filings).select(lit(name).alias("factor"), "session", "inst", "value", "reason")
        every = f if every is None else every.unionByName(f)
    every.createOrReplaceTempView("factor_values")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION factor(wanted STRING) RETURNS TABLE(session DATE, inst STRING, value DOUBLE, reason STRING) RETURN SELECT session, inst, value, reason FROM factor_values WHERE factor = wanted")
