"""A corpus from raw documents to a mix: toxic texts, near copies, benchmark leaks, personal data, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, neardup, pii, toxicity
from tidemark.llm.common import SPACED_RE, discard, keep, kept, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on the labelled ones doesn't reject. Null and empty texts are scored like any other; repeated
    rows share their fate; columns pass unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(toxicity.fit_sample(docs, labels), toxicity.rate(labels))
    scored = toxicity.score_toxicity(docs, machine, added=("__held_out", "__score", "__predicted"))
    return scored.filter("__predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles of similarity 0.8. Texts without words link with
    nothing and stay; a text of fewer words is one shingle."""
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item in a row, nor a shorter item; without a benchmark all stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = pii.find_pii(docs, spans="__pii", redacted="text").drop("__pii")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with size, source_size, target, taken, copy and words; columns of these
    names are replaced.

    taken is the words that all copies of the document have together, words those of this copy. The copy that a source's
    budget cuts has its first words only, joined by single spaces; documents of which nothing is taken go.
    """
    m = mixing.mix_sources(docs).filter("taken > 0")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")).cast("long"))))
    m = m.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({SPACED_RE})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    m = m.withColumn("text", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text")))
    return m.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else m


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("pii", mask_personal), ("mixing", mix)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written and read again before the next; what a stage has left over is deleted then.

    Null ids, null and empty texts, repeated rows and further columns are treated as each stage says; an empty table gives an
    empty result with the columns of the last stage.
    """
    docs, mark = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), kept()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, mark, kept() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
