"""Helpers that the training-data operators share: tables cut from their lineage, words, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns the six ASCII white-space characters into a space.
SPACED = bytes(32 if i in (32, 9, 10, 11, 12, 13) else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
#: Native form of the white-space word, for Java's and DuckDB's regular expressions.
SPACED_RE = r"[^\x20\x09-\x0D]+"


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores. A table of fewer is small, and one big file would keep one core busy."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one, but on one machine only: executors share no other."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def claim(spark: SparkSession, name: str) -> str:
    """The path of a new table or folder in the shared folder, which discard will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and any executor can be lost.

    The table stays until discard is called, since results are lazy and may still read it.
    """
    spark = df.sparkSession
    path = claim(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept() -> int:
    """How many tables there are; a mark for discard."""
    return len(_KEPT)


def discard(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Deletes the tables that keep wrote between two marks (all: without marks). Call it when what reads them is written."""
    for path in _KEPT[since:upto]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _KEPT[since:upto]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_mod_py(i, n: int) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def words(text: str | None, table: bytes = SPACED) -> list[bytes]:
    """Lower-case words of a whole text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


_M = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3  # odd, so that it has an inverse modulo 2**64
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _M) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))
_POWERS = {"n": 0, "up": None, "down": None}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for side, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                _POWERS[side] = np.multiply.accumulate(x)
        _POWERS["n"] = n
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of a byte array; one more entry than bytes."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    up, _ = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes start to end; equal bytes have equal hashes wherever they stand."""
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _M)
