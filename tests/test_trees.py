"""Trees grown level by level in Spark against a plain recursive version on the driver."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


def plain_tree(x, r, depth, least):
    """Nested (feature, cut, left, right) or a value; residuals are whole numbers."""
    n, s = len(r), sum(r)
    if depth == 0 or n < least:
        return s / n / trees.UNIT
    best = None
    for j in range(len(x[0])):
        order = sorted(range(n), key=lambda i: x[i][j])
        left = 0
        for k in range(n - 1):
            left += r[order[k]]
            a, b = x[order[k]][j], x[order[k + 1]][j]
            if a != b:
                gain = float(left) * float(left) / (k + 1) + (float(s) - float(left)) ** 2 / (n - k - 1) - float(s) * float(s) / n
                if best is None or gain > best[0]:
                    best = (gain, j, (a + b) / 2, [i for i in range(n) if x[i][j] <= a])
    if best is None:
        return s / n / trees.UNIT
    low = set(best[3])
    side = lambda keep: plain_tree([x[i] for i in range(n) if (i in low) == keep], [r[i] for i in range(n) if (i in low) == keep], depth - 1, least)
    return best[1], best[2], side(True), side(False)


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(x, y, test, n_trees, rate, depth, least):
    whole = lambda v: math.floor(v * trees.UNIT + 0.5)
    base = sum(whole(v) for v in y) / len(y) / trees.UNIT
    now, out = [base] * len(y), [base] * len(test)
    for _ in range(n_trees):
        t = plain_tree(x, [whole(v - p) for v, p in zip(y, now, strict=True)], depth, least)
        now = [p + rate * walk(t, v) for p, v in zip(now, x, strict=True)]
        out = [p + rate * walk(t, v) for p, v in zip(out, test, strict=True)]
    return out


@pytest.mark.parametrize("blocks", [1, 5])
def test_boosting_equals_the_plain_version(spark, blocks):
    rng = random.Random(11)
    rows = []
    for fold, n in ((0, 60), (1, 90), (2, 3), (3, 1)):
        for i in range(n + 8):
            x = [round(rng.gauss(0, 1), 1 if fold else 6), float(rng.randint(0, 3)), 1.0]
            rows.append((fold, i, "train" if i < n else "test", x, 0.3 * x[0] - 0.2 * (x[1] > 1) + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "fold int, i int, part string, x array<double>, label double").cache()
    forest = trees.boost(df.filter("part = 'train'"), trees=4, rate=0.3, depth=3, least=5, blocks=blocks)
    got = {(r["fold"], r["i"]): r["prediction"] for r in trees.predictions(df.filter("part = 'test'"), forest, rate=0.3).collect()}
    for fold in range(4):
        own = [r for r in rows if r[0] == fold]
        train, test = [r for r in own if r[2] == "train"], [r for r in own if r[2] == "test"]
        want = plain_boost([r[3] for r in train], [r[4] for r in train], [r[3] for r in test], 4, 0.3, 3, 5)
        assert [got[fold, r[1]] for r in test] == want


def test_a_split_does_not_depend_on_partitions(spark):
    df = spark.range(4000).select(F.lit(0).alias("fold"), F.array((F.col("id") % 97).cast("double"), (F.col("id") % 89).cast("double")).alias("x"), F.sin(F.col("id") * 1.7).alias("label"))
    grown = [trees.boost(df.repartition(n), trees=2, blocks=b) for n, b in ((1, 1), (7, 1), (3, 16))]
    assert grown[0] == grown[1] == grown[2]


def test_equal_splits_take_the_first_feature_and_alike_rows_are_a_leaf(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], -1.0), (0, [2.0, 2.0], 1.0), (1, [5.0, 5.0], 1.0), (1, [5.0, 5.0], 3.0)], "fold int, x array<double>, label double")
    forest = trees.boost(df, trees=1, rate=1.0, depth=1, least=2)
    assert forest[0] == (0.0, [[(0, 1.5, None), (None, None, -1.0), (None, None, 1.0)]])
    assert forest[1][0] == 2.0 and forest[1][1][0][0] == (None, None, 0.0)
    assert trees.boost(df.filter("fold > 5")) == {}


def test_clips_are_positional(spark):
    df = spark.createDataFrame([(0, float(v), 1.0) for v in range(200)], "fold int, a double, b double")
    r = trees.cuts(df, ["a", "b"]).first()
    assert (r["lo"], r["hi"]) == ([2.0, 1.0], [198.0, 1.0])


def test_levels_read_few_trees_and_grow_the_same_ones(spark, monkeypatch):
    """Rows bear the value of earlier trees: however often that is written, trees are equal to the last digit."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(i % 2, [rng.random(), rng.random()], rng.random()) for i in range(60)], "fold int, x array<double>, label double")
    read, known = [], trees._known
    monkeypatch.setattr(trees, "_known", lambda r, key, found, **more: read.append(max(len(ts) for _, ts in found.values())) or known(r, key, found, **more))
    monkeypatch.setattr(trees, "SETTLED", 2)
    often = trees.boost(rows, trees=5, depth=2)
    assert max(read) == 2
    monkeypatch.setattr(trees, "SETTLED", 100)
    assert often == trees.boost(rows, trees=5, depth=2)
