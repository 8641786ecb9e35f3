"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_RE, unused

ADDED = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of a table (key, source, source_size), one row per source.

    Sources weigh `weights` in turn, by code point, null last, and share the sum of all sizes; a target stops at `cap`
    times its source's size, and the excess goes to the others by weight until none is above. That end state is a
    water level: sorted by size a unit of weight, the first k sources are full and the rest stand at one level.
    The windows without a key run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("key"))
    w = w.withColumns({
        "at": F.row_number().over(by_level),
        "level": (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    w = w.withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    w = w.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("at"))).over(Window.partitionBy()))
    return w.select("key", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def measured(docs: DataFrame, text: str = "text", digest: str = "digest") -> DataFrame:
    """docs with size, the number of words of the text (null: 0), and its md5 (null as empty); columns of these names are replaced."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"size": F.regexp_count(whole, F.lit(SPACED_RE)).cast("long"), digest: F.md5(whole.cast("binary"))})


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str | None = "text", source: str = "source", weights: tuple = (5, 2, 1), cap: float = 3.0, seed: str = "mix", digits: int = 3) -> DataFrame:
    """Every input row with size, source_size, target and taken, the words that the mix takes of it.

    With text=None docs has size and digest already (see measured). A row's place in its source is a hash of its id and
    text. Rows are dealt to 16**digits hash ranges within each source, so that no source, however large, meets in one task,
    nor do rows without an id; sums of the ranges give each range its offset, and a running sum within the range gives each
    row the words before it. A source with target t and size s takes each document t // s times whole (the repeated epochs)
    and then, in hash order, the words up to t exactly: the document at the cut is taken in part.

    Null or empty text: size 0, taken 0. Null source: a source of its own, the last. Null id: hashed as the empty text.
    Texts may be of any length. Rows that share an id and a text are interchangeable. An empty table gives an empty result.
    Other columns pass unchanged; input columns that are named as an added one are replaced.
    """
    key, place, part, total, offset, within = unused(docs, "key", "place", "part", "total", "offset", "within")
    own = [c for c in docs.columns if c not in ADDED]
    digest = "digest" if text is None else total
    b = docs if text is None else measured(docs, text, digest)
    b = b.withColumns({
        key: F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("n")),
        place: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.col(digest)).cast("binary")),
    })
    b = b.withColumn(part, F.substring(place, 1, digits)).select(*[F.col(f"`{c}`") for c in own], "size", key, place, part)
    ranges = b.groupBy(key, part).agg(F.sum("size").alias(total))
    sizes = ranges.groupBy(key).agg(F.sum(total).alias("source_size"))
    sizes = sizes.select(F.col(key).alias("key"), F.when(F.col(key) != "n", F.substring(key, 2, 1 << 30)).alias("source"), "source_size")
    targets = source_targets(sizes, weights, cap)
    before = F.coalesce(F.sum(total).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn(offset, before).drop(total).join(targets.withColumnRenamed("key", key), key)
    running = F.sum("size").over(Window.partitionBy(key, part).orderBy(place, "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = b.withColumn(within, running).join(ranges, [key, part])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col(offset) - F.col(within)
    out = out.withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in own], *ADDED)
