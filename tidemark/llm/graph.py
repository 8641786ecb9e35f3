"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for every node of the links, the smallest node that it reaches. Ids are long and not null.

    Each round gives a node the least label of itself and its neighbours, then that label's own label (pointer
    jumping), so that rounds grow with the logarithm of a path. Minima are partial before they are shuffled; a node with a
    large share of all links makes one skewed join key, which Spark splits. Each round is written and read again.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = keep(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x != y").distinct(), "links")
    label = keep(both.groupBy("x").agg(F.least("x", F.min("y")).alias("comp")).withColumnRenamed("x", "node").withColumn("moved", F.lit(True)), "labels")
    while True:
        mark = kept()
        near = both.join(label.select(F.col("node").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        step = label.select("node", "comp").join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("comp", "m").alias("m"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("m"), F.col("comp").alias("next"))
        nxt = step.join(jump, "m", "left").select("node", F.least("m", F.coalesce("next", "m")).alias("comp"), "was")
        label = keep(nxt.select("node", "comp", (F.col("comp") != F.col("was")).alias("moved")), "labels")
        discard(links.sparkSession, mark - 1, mark)  # the labels of the round before
        if label.filter("moved").isEmpty():
            return label.select("node", "comp")
