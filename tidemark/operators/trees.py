"""Regression trees and their boosting, all folds at once and level by level: splits come from prefix sums that Spark shuffles.

Rows never leave Spark. What the driver holds is the trees: at most 2**(depth + 1) - 1 nodes a tree and fold.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept, scratch

#: Residuals are summed as whole multiples of 2**-30, so that no order of rows, and no other number of tasks, moves a split.
UNIT = 1 << 30
#: After so many trees rows are written with their value so far, so that a level's work doesn't grow with the trees before it.
SETTLED = 4
NODE = "array<struct<feature:int,cut:double,value:double>>"


def cuts(rows: DataFrame, features: list[str], key: str = "fold", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(key, lo, hi): arrays with the values at int(low n) and int(high n) of each feature's order, by key."""
    long = rows.select(key, F.posexplode(F.array(*features)).alias("j", "x"))
    steps = long.groupBy(key, "j", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key, "j").orderBy("x")
    s = steps.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(key, "j"))})
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(q) * F.col("all")), F.col("all") - 1), F.col("x")))
    b = s.groupBy(key, "j").agg(at(low).alias("lo"), at(high).alias("hi"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("j", c))), lambda x: x[c])
    return b.groupBy(key).agg(ordered("lo").alias("lo"), ordered("hi").alias("hi"))


def _fall(tree: str, depth: int) -> str:
    """SQL of the number of the node in which x ends: the children of node k are 2k + 1, where x is at most the cut, and 2k + 2."""
    if not depth:
        return "0"
    node = f"get({tree}, k)"
    return f"aggregate(sequence(1, {depth}), 0, (k, i) -> CASE WHEN {node}.feature IS NULL THEN k WHEN get(x, {node}.feature) <= {node}.cut THEN 2 * k + 1 ELSE 2 * k + 2 END)"


def _value(rate: float, depth: int, before: str = "__base") -> str:
    """SQL of what the trees add for x to the base, or to the value of those before them."""
    return f"aggregate(__trees, {before}, (a, t) -> a + double({rate!r}) * get(t, {_fall('t', depth)}).value)"


def _residual(label: str, value: str) -> str:
    return f"CAST(floor(({label} - {value}) * {UNIT}.0D + 0.5D) AS BIGINT)"


def best_splits(rows: DataFrame, keys: list[str], blocks: int = 1) -> DataFrame:
    """rows (keys, x array, r long) to (keys, n, s, feature, cut, n_left, s_left): for each key the split of greatest gain over all
    midpoints of all features, the first of equals by feature and value; nulls where all rows are alike.

    The gain is SL^2 / nL + SR^2 / nR - S^2 / n. Rows are shuffled once, by key, feature and block of the feature's range; prefix
    sums run within blocks, and block totals carry them on, so that a key's rows are dealt over up to `blocks` tasks a feature.
    The blocks' bounds are one pass of approximate percentiles: they move work, not results.
    """
    full = [*keys, "feature"]
    by = [*full, "block"] if blocks > 1 else full
    k, f, g = ", ".join(keys), ", ".join(full), ", ".join(by)
    long = rows.selectExpr(*keys, "r", "posexplode(x) AS (feature, x)")
    if blocks > 1:
        grid = F.array(*[F.lit(b / blocks) for b in range(1, blocks)])
        bounds = long.groupBy("feature").agg(F.percentile_approx("x", grid, F.lit(100 * blocks)).alias("bounds"))  # a row a feature
        long = long.join(F.broadcast(bounds), "feature").selectExpr(*full, "r", "x", "size(filter(bounds, b -> b < x)) AS block")
    steps = f"""SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, lead(x) OVER w AS next FROM (SELECT {g}, x, count(*) AS n, sum(r) AS s FROM {{long}} GROUP BY {g}, x)
      WINDOW w AS (PARTITION BY {g} ORDER BY x)"""
    if blocks > 1:
        totals = f"""SELECT {f}, block, coalesce(sum(n) OVER before, 0) AS n0, coalesce(sum(s) OVER before, 0) AS s0, lead(first) OVER (PARTITION BY {f} ORDER BY block) AS then, sum(n) OVER whole AS na, sum(s) OVER whole AS sa
          FROM (SELECT {f}, block, count(*) AS n, sum(r) AS s, min(x) AS first FROM {{long}} GROUP BY {f}, block)
          WINDOW before AS (PARTITION BY {f} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole AS (PARTITION BY {f})"""
        steps = f"SELECT {f}, x, nl + n0 AS nl, sl + s0 AS sl, coalesce(next, then) AS next, na, sa FROM ({steps}) JOIN ({totals}) USING ({f}, block)"
    else:
        steps = f"SELECT *, sum(n) OVER (PARTITION BY {g}) AS na, sum(s) OVER (PARTITION BY {g}) AS sa FROM ({steps})"
    sl, right, sa, nl, na = "double(sl)", "(double(sa) - double(sl))", "double(sa)", "double(nl)", "double(na)"
    gain = f"{sl} * {sl} / {nl} + {right} * {right} / ({na} - {nl}) - {sa} * {sa} / {na}"
    best = f"""SELECT {k}, max(na) AS n, max(sa) AS s, min(CASE WHEN next IS NOT NULL THEN struct(-({gain}) AS loss, feature, x, (x + next) / 2 AS cut, nl AS n_left, sl AS s_left) END) AS b FROM ({steps}) GROUP BY {k}"""
    return rows.sparkSession.sql(f"SELECT {k}, n, s, b.feature, b.cut, b.n_left, b.s_left FROM ({best})", long=long.repartition(*by))


def _known(rows: DataFrame, key: str, found: dict, **more: tuple) -> DataFrame:
    """rows joined with what is known of each key: a table of the driver, as large as the trees are, and sent to all."""
    node = lambda n: dict(zip(("feature", "cut", "value"), n, strict=True))
    plain = lambda k: k.isoformat() if hasattr(k, "isoformat") else k
    made = [{key: plain(k), "__base": b, "__trees": [[node(n) for n in t] for t in ts]} | {name: values[k] for name, (values, _) in more.items()} for k, (b, ts) in found.items()]
    kinds = "".join(f", {name}: {kind}" for name, (_, kind) in more.items())
    table = rows.sparkSession.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(made)), f"array<struct<{key}: {dict(rows.dtypes)[key]}, __base: double, __trees: array<{NODE}>{kinds}>>")))
    return rows.join(F.broadcast(table), key)


def boost(rows: DataFrame, label: str = "label", key: str = "fold", trees: int = 20, rate: float = 0.05, depth: int = 3, least: int = 5, blocks: int | None = None) -> dict:
    """rows (key, x array, label) to {key: (base, [tree, ...])}; a tree is a list of nodes (feature, cut, value), children of k at
    2k + 1 and 2k + 2, with no feature in leaves.

    Each level of each tree is one job over all rows: residuals and nodes are worked out from the trees so far, of which all but the
    last few are in a value that rows bear (SETTLED), by the same additions in the same order; the best split of every node of
    every key is taken in by the driver. A node with under `least` rows is a leaf. rows should be cached or
    cheap to read; any executor can be lost, since the trees are all there is to keep. blocks is that of best_splits; by default one for
    each million rows of the largest key.
    """
    start = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.expr(_residual(label, "0.0D"))).alias("s")).collect()  # a row a key
    forest = {r[key]: (r["s"] / r["n"] / UNIT, []) for r in start}
    blocks = blocks or 1 + max((r["n"] for r in start), default=0) // 1_000_000
    recent = {k: (b, []) for k, (b, _) in forest.items()}  # the trees that rows don't bear the value of yet
    before = "__base"
    for _ in range(trees if forest else 0):
        if len(next(iter(recent.values()))[1]) == SETTLED:
            known = _known(rows, key, recent).withColumn("__value", F.expr(_value(rate, depth, before)))
            rows, before = kept(known.select(key, "x", label, "__value"), "values"), "__value"
            recent = {k: (b, []) for k, (b, _) in forest.items()}
        grown = {k: [(None, None, None)] * (2 ** (depth + 1) - 1) for k in forest}
        open_nodes = {(k, 0) for k in forest}
        for level in range(depth):
            if not open_nodes:
                break
            tree = {k: [dict(zip(("feature", "cut", "value"), n, strict=True)) for n in grown[k]] for k in forest}
            j = _known(rows, key, recent, __tree=(tree, NODE), __open=({k: [n for kk, n in open_nodes if kk == k] for k in forest}, "array<int>"))
            node = _fall("__tree", level) if level else "__open[0]"
            j = j.selectExpr(key, f"{node} AS node", "__open", f"{_residual(label, _value(rate, depth, before))} AS r", "x").filter("array_contains(__open, node)")
            for r in best_splits(j, [key, "node"], blocks).collect():  # a row a key and node
                k, node, n, s = r[key], r["node"], r["n"], r["s"]
                open_nodes.discard((k, node))
                if n < least or r["feature"] is None:
                    grown[k][node] = (None, None, s / n / UNIT)
                    continue
                grown[k][node] = (r["feature"], r["cut"], None)
                for child, cn, cs in ((2 * node + 1, r["n_left"], r["s_left"]), (2 * node + 2, n - r["n_left"], s - r["s_left"])):
                    grown[k][child] = (None, None, cs / cn / UNIT)
                    if level + 1 < depth and cn >= least:
                        open_nodes.add((k, child))
        for k in forest:
            forest[k][1].append(grown[k])
            recent[k][1].append(grown[k])
    return forest


def predictions(rows: DataFrame, forest: dict, key: str = "fold", rate: float = 0.05, depth: int = 3, name: str = "prediction") -> DataFrame:
    """rows (key, x, ...) with the value that the key's trees give; rows of a key without trees go."""
    return _known(rows, key, forest).withColumn(name, F.expr(_value(rate, depth))).drop("__base", "__trees")


def boosted_predictions(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, rate: float = 0.05, depth: int = 3, least: int = 5, blocks: int | None = None) -> DataFrame:
    """(fold, session, inst, prediction, label) of the test rows of learning.fold_rows, from trees boosted on each fold's training rows.

    Features are clipped at the training rows' 1st and 99th percentiles (positional); scaling them, as the ridge needs it, would
    not move a split. Rows without nulls; folds without training rows have no predictions.
    """
    bounds = cuts(rows.filter("part = 'train'"), features)
    x = F.transform(F.arrays_zip(F.array(*features).alias("v"), F.col("lo"), F.col("hi")), lambda z: F.least(F.greatest(z["v"], z["lo"]), z["hi"]))
    ready = rows.join(bounds, "fold").select("fold", "session", "inst", "part", F.col(label).alias("label"), x.alias("x"))
    path = scratch(rows.sparkSession, "rows")  # each of the many jobs has a short plan then, and outlives its executors
    ready.write.partitionBy("part").parquet(path)
    ready = rows.sparkSession.read.schema(ready.schema).parquet(path)
    forest = boost(ready.filter("part = 'train'"), trees=trees, rate=rate, depth=depth, least=least, blocks=blocks)
    return predictions(ready.filter("part = 'test'"), forest, rate=rate, depth=depth).select("fold", "session", "inst", "prediction", "label")
