"""WARC records and not-modified revisits: an as-of join to the latest earlier full response of the same address."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep

#: Header fields that a not-modified answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RECORD = "record_id string, kind string, url string, ts timestamp, status int, headers map<string,string>, payload binary"
ADDED = ("surt", "refers_to", "status", "merged", "body_digest")


def canonical_url(url: Column) -> Column:
    """Sort-friendly address: the host's labels in reverse, then path and query, as in org,example)/a?x=1&y=2.

    Scheme, user, leading www., default port, fragment, closing slashes, empty parameters and those whose name begins with
    utm_ go; the host is in lower case, parameters are sorted, and escapes of letters, digits and -._~ are undone, others
    written with capitals. Paths keep their case.
    """
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    code = lambda p: F.conv(F.substring(p, 2, 2), 16, 10).cast("int")
    plain = lambda p: F.chr(code(p)).rlike(r"^[A-Za-z0-9._~-]$")
    part = lambda p: F.when(F.length(p) != 3, p).when(~p.startswith("%"), p).when(plain(p), F.chr(code(p))).otherwise(F.upper(p))
    u = F.when(~u.contains("%"), u).otherwise(F.array_join(F.transform(F.regexp_extract_all(u, F.lit("(%[0-9A-Fa-f]{2}|[^%]|%)"), F.lit(1)), part), ""))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?:[^/?@]*@)?([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    site = F.when(host.rlike(r"^[0-9.:]*$|^\["), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(u, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    return F.concat(site, F.lit(")"), path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit of a table (id, kind, url, ts, headers, digest) with what it stands for.

    kind is 'response' for a full response or 'revisit'; headers has lower-case names; ts is a number. Added columns:
    surt (the canonical address), refers_to, body_digest, merged and status:
    - 'resolved': the latest response of the address with a smaller ts has the revisit's validators; merged is its
      headers, renewed by the PERMITTED ones of the revisit; body_digest is its digest;
    - 'mismatch': it has others: an etag, compared without its weak mark, or in its absence last-modified, differs, or
      there is nothing to compare; refers_to names it, merged and body_digest are null;
    - 'orphan': there is none, or the revisit has no address or ts.

    Responses of equal ts: the one of the greater id is the latest. Rows are dealt by range of address and time, in parts of
    about equal numbers of rows, so that an address with a large share of all captures takes many parts: within a part a
    window finds the response, and a small table, one row per address and part, carries the last one into later parts.
    Repeated rows each get their result; bodies aren't looked at, only their digests; other columns pass unchanged, but
    those named as an added one are replaced; an empty table gives an empty result.
    """
    spark = records.sparkSession
    named = [F.col(f"`{c}`") for c in records.columns if c not in ADDED]
    r = records.select("id", "kind", "ts", "headers", "digest", canonical_url(F.col("url")).alias("surt"), F.when(F.col("kind") == "revisit", F.struct(*named)).alias("row"))
    whole = F.col("surt").isNotNull() & F.col("ts").isNotNull()
    dealt = r.filter(whole).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "surt", "ts").withColumn("part", F.spark_partition_id())
    r2 = keep(dealt, "captures")
    full = F.when(F.col("kind") == "response", F.struct("ts", "id", "headers", "digest"))
    order = Window.partitionBy("surt", "part").orderBy("ts", F.when(F.col("kind") == "response", 1).otherwise(0), "id")
    here = F.last(full, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spread = r2.groupBy("surt", "part").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("ts", "id"))).alias("tail"))
    steps = spread.select("surt", "part", F.last("tail", ignorenulls=True).over(Window.partitionBy("surt").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    steps = steps.filter("carried IS NOT NULL")
    found = r2.withColumn("here", here).filter("kind = 'revisit'").join(steps, ["surt", "part"], "left").withColumn("hit", F.coalesce("here", "carried"))
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    old, new = F.col("hit.headers"), F.col("headers")
    same = F.coalesce(weak(old["etag"]) == weak(new["etag"]), old["last-modified"] == new["last-modified"], F.lit(False))
    ok = F.col("hit").isNotNull() & same
    renew = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(renew), k)), renew)
    status = F.when(F.col("hit").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    out = found.select("row.*", "surt", F.col("hit.id").alias("refers_to"), status.alias("status"), F.when(ok, merged).alias("merged"), F.when(ok, F.col("hit.digest")).alias("body_digest"))
    none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("refers_to", "merged", "body_digest")]
    lost = r.filter(~whole & (F.col("kind") == "revisit")).select("row.*", "surt", none[0], F.lit("orphan").alias("status"), *none[1:])
    return out.unionByName(lost)


def _inflated(raw: bytes):
    """Bytes of a WARC file in pieces, plain or compressed by record; None where a damaged member was left out."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + (1 << 20)] for i in range(0, len(raw), 1 << 20))
        return
    at = 0
    while 0 <= at < len(raw):
        d, start = zlib.decompressobj(31), at
        try:
            while not d.eof and at < len(raw):
                piece = raw[at : at + (1 << 16)]
                out = d.decompress(piece)
                at += len(piece) - len(d.unused_data)
                yield out
            if not d.eof:
                yield None
            elif raw[at : at + 2] != b"\x1f\x8b":
                at = raw.find(b"\x1f\x8b\x08", at)
        except zlib.error:
            yield None
            at = raw.find(b"\x1f\x8b\x08", start + 1)


def _fields(lines: list[str]) -> dict:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_warc(raw: bytes, damaged: bool = False):
    """Records of a WARC file, plain or compressed by record, as dicts of RECORD, read from front to back.

    A damaged member, a record cut short and one whose length is no number are left out, and reading goes on with the next
    record; with damaged=True each of them gives a record of kind 'damaged' and nulls.
    """
    lost = dict.fromkeys(("record_id", "url", "ts", "status", "headers", "payload"), None) | {"kind": "damaged"}
    buf, at, pieces, more = bytearray(), 0, _inflated(raw), True
    while True:
        begin = buf.find(b"WARC/1.", at)
        end = buf.find(b"\r\n\r\n", begin) if begin >= 0 else -1
        head, size = {}, 0
        if end >= 0:
            head = _fields(buf[begin:end].decode("utf-8", "replace").split("\r\n")[1:])
            n = head.get("content-length", "0") or "0"
            if not (n.isascii() and n.isdigit()):
                if damaged:
                    yield dict(lost)
                at = end
                continue
            size = int(n)
        if end < 0 or len(buf) < end + 4 + size:
            drop = begin if begin >= 0 else max(at, len(buf) - 6)
            need = (len(buf) + 1 if end < 0 else end + 4 + size) - drop
            del buf[:drop]
            at = 0
            while more and len(buf) < need:
                piece = next(pieces, False)
                if piece is False:
                    more = False
                elif piece is None:
                    if damaged:
                        yield dict(lost)
                    buf.clear()
                    break
                else:
                    buf += piece
            if not more and len(buf) < need:  # the file ends within this record
                if begin < 0:
                    return
                if damaged:
                    yield dict(lost)
                at = 1
            continue
        block = bytes(buf[end + 4 : end + 4 + size])
        at = end + 4 + size
        if at > 1 << 20:
            del buf[:at]
            at = 0
        http, _, body = block.partition(b"\r\n\r\n")
        lines = http.decode("utf-8", "replace").split("\r\n")
        is_http = lines[0].startswith("HTTP/")
        code = lines[0].split(" ")[1:2] if is_http else []
        status = int(code[0]) if code and code[0].isascii() and code[0].isdigit() else None
        yield {"record_id": head.get("warc-record-id"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "ts": head.get("warc-date"), "status": status, "headers": _fields(lines[1:]) if is_http else {}, "payload": body if is_http else block}


def render_warc(records: list[dict], compress: bool = True) -> bytes:
    """The inverse of parse_warc for http records: ts is text such as 2024-01-01T00:00:00Z."""
    out = []
    for r in records:
        lines = [f"HTTP/1.1 {r['status'] or 200} -", *(f"{k}: {v}" for k, v in (r["headers"] or {}).items())]
        block = "\r\n".join(lines).encode() + b"\r\n\r\n" + (r["payload"] or b"")
        head = f"WARC/1.1\r\nWARC-Type: {r['kind']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {r['ts']}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        out.append(gzip.compress(head + block + b"\r\n\r\n") if compress else head + block + b"\r\n\r\n")
    return b"".join(out)


def read_warc(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """Records of all WARC files under a path; with damaged=True also a row of kind 'damaged' for each one left out.

    A file is a row of the scan; it is unfolded and parsed piece by piece, and records leave in batches of about 16 MB. A ts
    that is no time is null.
    """
    names = ("record_id", "kind", "url", "ts", "status", "headers", "payload")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary())

    def batch(rows):
        cols = [[list(r[n].items()) if n == "headers" and r[n] is not None else r[n] for r in rows] for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    def run(batches):
        for b in batches:
            for raw in b["content"]:
                rows, size = [], 0
                for r in parse_warc(raw.as_py(), damaged):
                    rows.append(r)
                    size += len(r["payload"] or b"") + 1000
                    if size > 1 << 24:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD.replace("ts timestamp", "ts string")).withColumn("ts", F.try_to_timestamp("ts"))


def recrawl_log(pages: DataFrame, later: int = 5000) -> DataFrame:
    """Captures of a table (page_id, url, html): each page in full at second page_id, and a not-modified answer `later` seconds on.

    Its validators are those of the page itself: an etag, or for some addresses, by hash, last-modified alone. Another
    page fetched from the same address in between makes it a mismatch. A null page has an empty body; the answer at a null
    address is an orphan; repeated rows are captures each; an empty table gives an empty result.
    """
    p = pages.withColumns({"digest": F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), "tag": F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"')), "by_date": F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1) < "5"})
    text = lambda c: F.col(c).cast("string")
    kv = lambda **x: F.map_filter(F.create_map(*[y for k, v in x.items() for y in (F.lit(k.replace("_", "-")), v)]), lambda k, v: v.isNotNull())
    tag = F.when(~F.col("by_date"), F.col("tag"))
    first = p.select(F.col("page_id").alias("id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), kv(cache_control=F.lit("max-age=60"), content_length=F.length(F.coalesce("html", F.lit(""))).cast("string"), content_type=F.lit("text/html"), date=text("page_id"), etag=tag, last_modified=text("page_id")).alias("headers"), "digest")
    again = p.select(F.col("page_id").alias("id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") + later).alias("ts"), kv(cache_control=F.lit("max-age=300"), content_length=F.lit("0"), date=(F.col("page_id") + later).cast("string"), etag=tag, last_modified=F.when(F.col("by_date"), text("page_id"))).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return first.unionByName(again)
