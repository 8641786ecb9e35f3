"""Benchmark decontamination: a prefix-filtered join of documents and benchmark windows on their rarest shingle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, keep, prefix_hash, range_hash, unused, words

SHINGLE = 5
STEP = 64
SALTS = 16
MAX_BITS = 1 << 27


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64(bits - 1)).astype(np.int64)


def item_windows(benchmark: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(item, win, n, grams): each window of each item, as words, with its shingles' offsets and hashes.

    Only distinct pairs of item and window stay. Items without an id or without words have none.
    """
    src = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for item, t in zip(b["item"].to_pylist(), b["text"].to_pylist(), strict=True):
                w = words(t, WORDS)
                if not w:
                    continue
                n = min(size, len(w))
                g = min(SHINGLE, n)
                sh = []
                for i in range(len(w) - g + 1):
                    raw = np.frombuffer(b" ".join(w[i : i + g]), dtype=np.uint8)
                    sh.append(int(range_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)])).view(np.int64)[0]))
                rows = range(len(w) - n + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(rows)), pa.array([b" ".join(w[i : i + n]).decode("utf-8", "replace") for i in rows]), pa.array([n] * len(rows), pa.int32()), pa.array([[{"off": j, "sh": sh[i + j]} for j in range(n - g + 1)] for i in rows], pa.list_(pa.struct([("off", pa.int32()), ("sh", pa.int64())])))],
                    names=["item", "win", "n", "grams"],
                )

    return src.mapInArrow(run, "item string, win string, n int, grams array<struct<off:int,sh:long>>").dropDuplicates(["item", "win"])


def _filter_bits(wins: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap over all shingle hashes, at most MAX_BITS bits, and the shingle sizes in use (1 to SHINGLE).

    The bitmap only spares work: a shingle that passes by chance fails the join. At most 8 tasks send one bitmap each.
    """
    grams = wins.select(F.explode("grams.sh").alias("sh"))
    sizes = [r["g"] for r in wins.select(F.least(F.col("n"), F.lit(SHINGLE)).alias("g")).distinct().collect()]
    bits = 1 << 16
    count = grams.count()
    while bits < 32 * count and bits < MAX_BITS:
        bits *= 2

    def run(batches):
        out = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            at = _slots(b["sh"].to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in grams.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], dtype=np.uint8)
    return total, sorted(sizes)


def _pieces(doc_words: list[bytes], at: list[int], sizes: list[int], sh: list[int], size: int) -> list[dict]:
    """Stretches of a document under hit shingles, in pieces of STEP starts and size - 1 more words."""
    out, order = [], sorted(zip(at, sizes, sh, strict=True))
    i = 0
    while i < len(order):
        a, end, j = order[i][0], order[i][0], i
        while j < len(order) and order[j][0] <= end:
            end = max(end, order[j][0] + order[j][1])
            j += 1
        own = order[i:j]
        lo = 0
        for s in range(a, end, STEP):
            stop = min(end, s + STEP + size - 1)
            while lo < len(own) and own[lo][0] < s:
                lo += 1
            k = lo
            inside = []
            while k < len(own) and own[k][0] < stop:
                if own[k][0] + own[k][1] <= stop:
                    inside.append((own[k][0] - s, own[k][2]))
                k += 1
            if inside:
                out.append({"a": s, "n": stop - s, "words": b" ".join(doc_words[s:stop]).decode("utf-8", "replace"), "hits": [{"pos": p, "sh": h} for p, h in inside]})
        i = j
    return out


def document_pieces(docs: DataFrame, bitmap: np.ndarray, grams: list[int], size: int) -> DataFrame:
    """docs (id, k, text) to (id, k, n_words, pieces): the stretches whose shingles pass the bitmap; most have none."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    piece = pa.struct([("a", pa.int32()), ("n", pa.int32()), ("words", pa.string()), ("hits", pa.list_(pa.struct([("pos", pa.int32()), ("sh", pa.int64())])))])

    def chunk(texts: list[str | None]):
        bits = sent.value
        mask = len(bits) * 8
        own = [words(t, WORDS) for t in texts]
        counts = np.array([len(w) for w in own], dtype=np.int64)
        found = [[] for _ in own]
        if counts.sum():
            raw = np.frombuffer(b" ".join(b" ".join(w) for w in own if w), dtype=np.uint8)
            space = np.flatnonzero(raw == 32)
            start, end = np.append(0, space + 1), np.append(space, len(raw))
            doc = np.repeat(np.arange(len(own)), counts)
            first = np.cumsum(counts) - counts
            h = prefix_hash(raw)
            for g in grams:
                n = len(start) - g + 1
                if n <= 0:
                    continue
                sh = range_hash(h, start[:n], end[g - 1 :])
                at = _slots(sh, mask)
                ok = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                ok = ok[doc[ok] == doc[ok + g - 1]]
                for i, d, x in zip(ok.tolist(), doc[ok].tolist(), sh[ok].view(np.int64).tolist(), strict=True):
                    found[d].append((i - int(first[d]), g, x))
        return counts, [_pieces(w, *map(list, zip(*f, strict=True)), size) if f else [] for w, f in zip(own, found, strict=True)]

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            at = 0
            while at < len(texts):
                upto, total = at, 0
                while upto < len(texts) and (upto == at or total < 1 << 20):
                    total += len(texts[upto] or "")
                    upto += 1
                counts, pieces = chunk(texts[at:upto])
                part = b.slice(at, upto - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(pieces, pa.list_(piece))], names=["id", "k", "n_words", "pieces"])
                at = upto

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, k binary, n_words long, pieces array<struct<a:int,n:int,words:string,hits:array<struct<pos:int,sh:long>>>>")


def row_key(id_col: str, text: str):
    """16 bytes that stand for a row's id and text, so that repeated rows share a result and odd ones don't meet."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k, id, n_words, n_hit, n_items, items): one row a document; k is row_key, items the sorted ids as strings.

    A window of `size` words of an item, or a shorter item as a whole, contaminates a document that holds it word for word.
    1. Shingles of five words (fewer in short windows) of all windows make a bitmap of bounded size. One pass over the
       documents keeps the stretches of words whose shingles pass it: a window that occurs lies within one.
    2. Shingles are ordered by how often the stretches hold them. Exact containment needs every shingle of a window, so
       the necessary prefix is its single rarest one; a window with an absent shingle goes at once.
    3. Stretches and windows meet on that shingle, within the bounds that offset and length set, on a salted key, since a
       common passage may sit in a third of all documents. The words themselves then decide.

    Null and empty texts have no words; texts of any length are read whole, in pieces; null item ids take no part; repeated
    rows each get their result; columns but those named aren't looked at; an empty benchmark leaves every document clean; an
    empty table gives an empty result.
    """
    iw = keep(item_windows(benchmark, item_id, item_text, size), "item-windows")
    wins = iw.dropDuplicates(["win"]).select("win", "n", "grams")
    bitmap, grams = _filter_bits(wins)
    base = keep(document_pieces(docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("k"), F.col(text).alias("text")), bitmap, grams, size), "doc-pieces")
    pieces = base.filter(F.size("pieces") > 0).select("k", F.explode("pieces").alias("p")).select("k", "p.*").dropDuplicates(["k", "a"])
    hits = pieces.select("k", "a", F.col("n").alias("len"), F.explode("hits").alias("h")).select("k", "a", "len", "h.pos", "h.sh")
    often = hits.groupBy("sh").count()
    rare = wins.select("win", "n", F.explode("grams").alias("g")).select("win", "n", "g.off", "g.sh").join(often, "sh", "left")
    rare = rare.groupBy("win", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "sh", "off")).alias("r")).filter("r.c > 0")
    salt = F.pmod(F.xxhash64("k", "a"), F.lit(SALTS))
    rare = rare.select("win", "n", "r.sh", "r.off", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cand = hits.withColumn("salt", salt).join(rare, ["sh", "salt"])
    cand = cand.withColumn("at", F.col("pos") - F.col("off")).filter("at >= 0 AND at + n <= len").select("k", "a", "at", "n", "win")
    texts = pieces.select("k", "a", "words")
    same = F.array_join(F.slice(F.split("words", " "), F.col("at") + 1, F.col("n")), " ") == F.col("win")
    found = cand.join(texts, ["k", "a"]).filter(same).select("k", (F.col("a") + F.col("at")).alias("at"), "n", "win").distinct()
    found = keep(found, "found-windows")
    end = F.col("at") + F.col("n")
    before = F.max(end).over(Window.partitionBy("k").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1))
    hit = found.select("k", "at", "n").distinct().withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(before, F.col("at")))))
    hit = hit.groupBy("k").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = iw.select("item", "win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    items = found.select("k", "win").distinct().withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS))).join(owners, ["win", "salt"])
    items = items.select("k", "item").distinct().groupBy("k").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    out = base.select("id", "k", "n_words").join(hit, "k", "left").join(items, "k", "left")
    none = F.lit(0).cast("long")
    return out.select("k", "id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold no window of the benchmark, with all their columns.

    Texts that are null or have no words are clean and stay, whatever their ids; repeated rows go or stay together; an empty
    benchmark, or one without words, takes nothing away; an empty table gives an empty result.
    """
    (key,) = unused(docs, "k")
    dirty = contamination(docs, benchmark, size, id_col, text).filter("n_hit > 0").select(F.col("k").alias(key))
    return docs.withColumn(key, row_key(id_col, text)).join(dirty, key, "left_anti").drop(key)
