"""Read-only SQL over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .sql_functions import install

#: Words that a read-only query may not hold as a statement.
BANNED = ("insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "attach", "detach")
_WORD = re.compile(rf"\b({'|'.join(BANNED)})\b", re.IGNORECASE)


def assert_read_only(spark: SparkSession, sql: str, strict: bool = True) -> None:
    """Raises ValueError on anything but a query: by banned words (strict, literals included), and by the parsed plan."""
    if strict and (m := _WORD.search(sql)):
        raise ValueError(f"not read-only: {m[1]}")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    for kind in ("Command", "ParsedStatement"):
        if spark._jvm.java.lang.Class.forName(f"{logical}.{kind}").isInstance(plan):
            raise ValueError(f"not a query: {plan.nodeName()}")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame | str], args: dict | list | None = None, strict: bool = True) -> DataFrame:
    """The result of one SELECT over tables (DataFrames, or Parquet paths), with bound parameters and the functions of sql_functions.
    Columns keep their types."""
    assert_read_only(spark, sql, strict)
    install(spark)
    for name, t in tables.items():
        (spark.read.parquet(t) if isinstance(t, str) else t).createOrReplaceTempView(name)
    return spark.sql(sql, args=args) if args else spark.sql(sql)
