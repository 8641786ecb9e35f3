"""Walk-forward folds, preprocessing, ridge, comparison of models and label shuffles.

Folds are rows. Sums over rows stay in Spark; trees are in trees.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import boosted_predictions


def folds(calendar: DataFrame, least: int = 252, test: int = 63, step: int = 63, purge: int = 21, rolling: int | None = None) -> DataFrame:
    """(fold, train_from, train_to, test_from, test_to) as positions from 1 in the calendar (session, idx).

    The first test begins after `least` + `purge` sessions, each next one `step` later; training ends `purge` before it.
    """
    n = calendar.agg(F.count("*").alias("n"))
    f = n.filter(F.col("n") >= least + purge + test).select(F.posexplode(F.sequence(F.lit(least + purge).cast("long"), F.col("n") - test, F.lit(step).cast("long"))).alias("fold", "start"))
    end = F.col("start") - purge
    first = F.greatest(F.lit(0), end - rolling) if rolling else F.lit(0)
    f = f.select("fold", (first + 1).cast("long").alias("train_from"), end.cast("long").alias("train_to"), (F.col("start") + 1).cast("long").alias("test_from"), (F.col("start") + test).cast("long").alias("test_to"))
    return f.filter(F.col("train_to") - F.col("train_from") + 1 >= least)


def fold_rows(panel: DataFrame, calendar: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Panel rows (session, ...) once for each fold that holds them, with fold and part ('train' or 'test').

    Sessions meet folds first, each fold counting up its own sessions; that table has a row a session and fold, and which way
    it meets the panel is left to Spark's own check of its size.
    """
    own = fold_table.withColumn("idx", F.explode(F.sequence("train_from", "test_to")))
    p = panel.join(own.join(calendar, "idx"), "session")
    part = F.when(F.col("idx").between(F.col("train_from"), F.col("train_to")), "train").when(F.col("idx").between(F.col("test_from"), F.col("test_to")), "test")
    return p.withColumn("part", part).filter("part IS NOT NULL").drop("train_from", "train_to", "test_from", "test_to", "idx")


def preprocessor(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, low, high, mean, sd) of training rows: values at int(0.01 n) and int(0.99 n), then clipped mean and deviation.

    A deviation whose square is 1e-8 or less counts as 1.
    """
    long = rows.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*features))).alias("feature", "v")).filter("v IS NOT NULL")
    k = [*keys, "feature"]
    w = Window.partitionBy(*k)
    r = long.withColumns({"pos": F.row_number().over(w.orderBy("v")) - 1, "n": F.count("*").over(w)})
    at = lambda q: F.max(F.when(F.col("pos") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col("v"))).over(w)
    r = r.withColumns({"low": at(0.01), "high": at(0.99)}).withColumn("c", F.least(F.greatest("v", "low"), "high"))
    var = F.var_samp("c")
    return r.groupBy(*k).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.avg("c").alias("mean"), F.when(var > 1e-8, F.sqrt(var)).otherwise(1.0).alias("sd"))


def normal_equations(rows: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    """(keys, n, xx, xy): sums of products, one row a key; no intercept. Sums are partial before they are shuffled."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"xx_{i}_{j}") for i, j in pairs] + [F.sum(F.col(f) * F.col(label)).alias(f"xy_{i}") for i, f in enumerate(features)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def ridge(equations: DataFrame, features: list[str], keys: list[str], alpha: float = 1.0) -> DataFrame:
    """(keys, weights) of (X'X + alpha I) w = X'y, one small solve a row."""
    d = len(features)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.array([[getattr(r, f"xx_{min(i, j)}_{max(i, j)}") for j in range(d)] for i in range(d)], dtype=float) + alpha * np.eye(d)
                out.append(np.linalg.solve(a, np.array([getattr(r, f"xy_{i}") for i in range(d)], dtype=float)).tolist())
            yield pdf[keys].assign(weights=out)

    kinds = dict(equations.dtypes)
    return equations.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", weights array<double>")


def champion(reports: DataFrame, baseline: str = "composite", margin: float = 0.005) -> DataFrame:
    """The model of the greatest mean rank correlation if it beats the baseline by more than the margin, else the baseline."""
    g = reports.agg(F.max_by("model", F.struct("mean", "model")).alias("best"), F.max("mean").alias("top"), F.max(F.when(F.col("model") == baseline, F.col("mean"))).alias("base"))
    return g.select(F.when(F.col("top") > F.col("base") + margin, F.col("best")).otherwise(baseline).alias("champion"), "top", "base")


def shuffled_labels(panel: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """The panel with each section's labels dealt anew among its names, by a hash of name and seed."""
    w = Window.partitionBy("session")
    p = panel.withColumns({"__a": F.row_number().over(w.orderBy("inst")), "__b": F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", "inst", F.col("session").cast("string"), F.lit(str(seed))).cast("binary")), "inst"))})
    dealt = p.select("session", F.col("__b").alias("__a"), F.col(label).alias("__l"))
    return p.drop(label).join(dealt, ["session", "__a"]).withColumn(label, F.col("__l")).drop("__a", "__b", "__l")


def assemble(features: dict[str, DataFrame], labels: DataFrame | None = None) -> DataFrame:
    """(session, inst, one column a feature, label): names that all features (session, inst, value) hold, a null value read as 0; labels where there are."""
    out = None
    for name in sorted(features):
        f = features[name].select("session", "inst", F.coalesce("value", F.lit(0.0)).alias(name))
        out = f if out is None else out.join(f, ["session", "inst"])
    return out.join(labels.select("session", "inst", "label"), ["session", "inst"], "left") if labels is not None else out


def standardised(rows: DataFrame, stats: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Rows with each feature clipped and scaled by the preprocessor's table of its key."""
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, F.struct("low", "high", "mean", "sd"))).alias(f"__{f}") for f in features])
    j = rows.join(wide, keys)
    for f in features:
        s = F.col(f"__{f}")
        j = j.withColumn(f, (F.greatest(F.least(F.col(f), s["high"]), s["low"]) - s["mean"]) / s["sd"])
    return j.drop(*[f"__{f}" for f in features])


def ridge_predictions(rows: DataFrame, features: list[str], label: str = "label", alpha: float = 1.0) -> DataFrame:
    """(fold, session, inst, prediction, label) of test rows of fold_rows: statistics and sums in Spark, one small solve a fold."""
    stats = preprocessor(rows.filter("part = 'train'"), features, ["fold"])
    z = standardised(rows, stats, features, ["fold"])
    w = ridge(normal_equations(z.filter("part = 'train'"), features, label, ["fold"]), features, ["fold"], alpha)
    j = z.filter("part = 'test'").join(w, "fold")
    value = sum((F.col(f) * F.col("weights")[i] for i, f in enumerate(features)), F.lit(0.0))
    return j.select("fold", "session", "inst", value.alias("prediction"), F.col(label).alias("label"))


def composite_predictions(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """The baseline on test rows: the mean of the features, each scored within its section; a flat one scores 0."""
    w = Window.partitionBy("fold", "session")
    z = [F.when(F.var_pop(f).over(w) < 1e-18, 0.0).otherwise(F.try_divide(F.col(f) - F.avg(f).over(w), F.sqrt(F.var_pop(f).over(w)))) for f in features]
    return rows.filter("part = 'test'").select("fold", "session", "inst", (sum(z, F.lit(0.0)) / len(z)).alias("prediction"), F.col(label).alias("label"))


def compare(rows: DataFrame, features: list[str]) -> DataFrame:
    """(model, ...) predictions of the composite, ridge and boosted trees on the same test rows."""
    parts = {"composite": composite_predictions(rows, features), "ridge": ridge_predictions(rows, features), "gbdt": boosted_predictions(rows, features)}
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("model"), "session", "inst", "prediction", "label")
        out = p if out is None else out.unionByName(p)
    return out
