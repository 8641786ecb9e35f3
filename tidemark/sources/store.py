"""Datasets, artifacts and logs on any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.universe import content_hash

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "tidemark")


def scratch(spark, name: str) -> str:
    """The path of a new folder for tables in between, under spark.checkpoint.dir; where that is unset, a temporary one, but on one machine only."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, for what is read several times: they are worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable_id(kind: str, name: str) -> str:
    """The same id for the same name, always."""
    return str(uuid.uuid5(NAMESPACE, f"{kind}.{name.strip().upper()}"))


class Files:
    """Small files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        if ".." in name.split("/") or name.startswith("/"):
            raise ValueError(f"{name}: outside the store")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def put(self, name: str, data: bytes, replace: bool = False) -> None:
        fs, p = self._at(name)
        out = fs.create(p, replace)
        out.write(bytearray(data))
        out.close()

    def get(self, name: str) -> bytes:
        fs, p = self._at(name)
        f = fs.open(p)
        try:
            return bytes(f.readAllBytes())
        finally:
            f.close()

    def names(self, folder: str = "") -> list[str]:
        fs, p = self._at(folder or ".")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def by_number(name: str) -> list:
    """A key that puts v9 before v10: runs of digits count as numbers."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name) if x]


def put_bytes(files: Files, data: bytes) -> str:
    """Stores bytes under their sha256 and returns it; equal bytes are stored once."""
    key = hashlib.sha256(data).hexdigest()
    if not files.exists(f"{key[:2]}/{key}"):
        files.put(f"{key[:2]}/{key}", data)
    return key


def get_verified(files: Files, key: str) -> bytes:
    data = files.get(f"{key[:2]}/{key}")
    if hashlib.sha256(data).hexdigest() != key:
        raise ValueError(f"{key}: content was changed")
    return data


def snapshot(files: Files, provider: str, dataset: str, params: dict, payload: bytes) -> str:
    """Keeps a raw payload with what was asked for; returns the name of its note."""
    key = put_bytes(files, payload)
    note = json.dumps({"provider": provider, "dataset": dataset, "params": params, "sha256": key, "bytes": len(payload)}, sort_keys=True)
    name = f"notes/{provider}-{dataset}-{hashlib.sha256(note.encode()).hexdigest()[:16]}.json"
    if not files.exists(name):
        files.put(name, note.encode())
    return name


def publish(spark: SparkSession, root: str, dataset: str, version: str, tables: dict[str, DataFrame], quality: dict | None = None) -> dict:
    """Writes tables as Parquet and a manifest of their row counts and hashes; a version can't be published twice."""
    files = Files(spark, root)
    name = f"{dataset}/{version}/manifest.json"
    if files.exists(name):
        raise ValueError(f"{dataset} {version} is published already")
    listed = {}
    for t, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{root}/{dataset}/{version}/{t}")
        r = content_hash(spark.read.parquet(f"{root}/{dataset}/{version}/{t}")).first()
        listed[t] = {"rows": r["n"], "hash": r["hash"]}
    manifest = {"dataset": dataset, "version": version, "tables": listed, "quality": quality or {}}
    manifest["hash"] = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    files.put(name, json.dumps(manifest, sort_keys=True).encode())
    return manifest


def inspect(spark: SparkSession, root: str, dataset: str, version: str | None = None, verify: bool = True) -> dict:
    """The manifest of a version, the last, by number, if none is given, with verified: whether tables still match it."""
    files = Files(spark, root)
    version = version or max(files.names(dataset), key=by_number)
    m = json.loads(files.get(f"{dataset}/{version}/manifest.json"))
    if verify:
        own = hashlib.sha256(json.dumps({k: v for k, v in m.items() if k != "hash"}, sort_keys=True).encode()).hexdigest() == m["hash"]
        now = {t: content_hash(spark.read.parquet(f"{root}/{dataset}/{version}/{t}")).first() for t in m["tables"]}
        m["verified"] = own and all(now[t]["hash"] == x["hash"] and now[t]["n"] == x["rows"] for t, x in m["tables"].items())
    return m


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file under a path, hashed where it is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, fault) of files that differ from a manifest (name, rows, sha256): missing, digest, or rows (lines but the header); none if sound."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit(r"\n")) + F.when(F.decode("content", "UTF-8").endswith("\n"), 0).otherwise(1) - 1
    have = f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("own"), lines.cast("long").alias("lines"))
    j = manifest.join(have, "name", "left")
    fault = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("sha256"), "digest").when(F.col("rows").isNotNull() & (F.col("rows") != F.col("lines")), "rows")
    return j.select("name", fault.alias("fault")).filter("fault IS NOT NULL")


def load_config(paths: list[str], env: dict[str, str] | None = None, prefix: str = "TIDEMARK_", required: tuple = ()) -> dict:
    """JSON or YAML files, later ones over earlier, and over both the environment: PREFIX_A__B sets b within a. Missing keys fail."""
    parts = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            text = f.read()
        try:
            own = json.loads(text) if text.strip() else {}
        except json.JSONDecodeError:
            import yaml

            own = yaml.safe_load(text)
        if not isinstance(own, dict):
            raise ValueError(f"{p}: the root must be a table")
        parts.append(own)
    for k, v in sorted((env or {}).items()):
        if k.startswith(prefix):
            own = v
            for name in reversed(k[len(prefix) :].lower().split("__")):
                own = {name: own}
            parts.append(own)
    out = merge_config(*parts)
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return out


def log_event(name: str, **fields) -> str:
    """One line of JSON for a log, secrets hidden."""
    return json.dumps({"event": name, **redact(fields)}, sort_keys=True, default=str)


def merge_config(*parts: dict) -> dict:
    """Later parts win, nested tables key by key."""
    out: dict = {}
    for p in parts:
        for k, v in p.items():
            out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def redact(config: dict, words: tuple = ("password", "secret", "token", "key")) -> dict:
    """A copy whose values under secret-looking names are hidden."""
    hide = lambda v: redact(v, words) if isinstance(v, dict) else [hide(x) for x in v] if isinstance(v, list) else v
    return {k: "***" if any(w in k.lower() for w in words) and not isinstance(v, dict) else hide(v) for k, v in config.items()}
