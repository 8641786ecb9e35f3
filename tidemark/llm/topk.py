"""Exact top-k inner products from a bit-sliced index.

Quantised vectors are held as slices: for each component, one bitmap over rows for each bit. A query's score is a weighted
sum of components; with each weight written in signed binary digits it is a sum of shifted slices, which full adders over
bitmaps reduce to one score slice a bit. The best rows are then found from the most significant score slice downward.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Rows of one block of the index: its slices of 64 components of 7 bits take 3.6 MB.
BLOCK = 1 << 16
#: Queries that visit a block together at most.
CHUNK = 1 << 14
#: Quantised components from here on fail: with them a score would hardly fit in 64 bits. Nothing is held to a bound.
LIMIT = 1 << 61


def quantise(vectors: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) of each component. Vectors that are null or hold a null or non-finite one are left out."""
    x = F.transform(vec, lambda v: v.cast("double"))
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    ok = vectors.filter(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    fail = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("long")
    q = F.transform(x, lambda v: F.when(F.abs(v * scale) < float(LIMIT), F.floor(v * scale).cast("long")).otherwise(fail))
    return ok.select(F.col(id_col).cast("long").alias("id"), q.alias("q"))


class Slices:
    """Slices of the rows of one block, rows in order of id."""

    def __init__(self, n: int, low: np.ndarray, bits: np.ndarray, maps: np.ndarray):
        self.n, self.dims, self.low, self.bits = n, len(low), low, bits.tolist()
        self.words = -(-n // 64)
        rows = maps.reshape(-1, self.words)
        first = np.cumsum(bits) - bits
        self.maps = [list(rows[f : f + b]) for f, b in zip(first, bits, strict=True)]
        self.every = np.zeros(self.words * 8, dtype=np.uint8)
        full = np.packbits(np.ones(n, dtype=np.uint8), bitorder="little")
        self.every[: len(full)] = full
        self.every = self.every.view(np.uint64)

    @classmethod
    def of(cls, q: np.ndarray) -> Slices:
        """The slices of a matrix, a row for each vector."""
        low = q.min(axis=0).astype(np.int64)
        u = (q - low).astype(np.int64)
        bits = np.array([int(x).bit_length() for x in u.max(axis=0)], dtype=np.int64)
        size = -(-len(q) // 64) * 8
        maps = np.zeros((int(bits.sum()), size), dtype=np.uint8)
        at = 0
        for d in range(q.shape[1]):
            for b in range(bits[d]):
                packed = np.packbits(((u[:, d] >> b) & 1).astype(np.uint8), bitorder="little")
                maps[at, : len(packed)] = packed
                at += 1
        return cls(len(q), low, bits, maps.view(np.uint64))

    def total(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least first, of the score less a constant that makes it positive, and that constant."""
        columns: list[list[np.ndarray]] = []
        offset = sum(w * x for w, x in zip(weights.tolist(), self.low.tolist(), strict=True))

        def put(at: int, bitmap: np.ndarray) -> None:
            while len(columns) <= at:
                columns.append([])
            columns[at].append(bitmap)

        for d in range(self.dims):
            w, shift = int(weights[d]), 0
            while w:  # signed digits: of neighbours at most one is not 0
                digit = 0
                if w & 1:
                    digit = 2 - (w & 3)
                    w -= digit
                for b in range(self.bits[d]) if digit else ():
                    if digit > 0:
                        put(shift + b, self.maps[d][b])
                    else:  # -x is (not x) - 1, a bit at a time
                        put(shift + b, ~self.maps[d][b])
                        offset -= 1 << (shift + b)
                w >>= 1
                shift += 1
        at = 0
        out: list[np.ndarray] = []
        while at < len(columns):
            todo = columns[at]
            while len(todo) > 2:  # full adder: three bitmaps of one weight to one, and one of the next
                a, b, c = todo.pop(), todo.pop(), todo.pop()
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                todo.insert(0, x)
                put(at + 1, carry)
            if len(todo) == 2:
                a, b = todo
                put(at + 1, a & b)
                todo = [a ^ b]
            out.append(todo[0] if todo else np.zeros(self.words, dtype=np.uint64))
            at += 1
        return out, offset

    def best(self, weights: np.ndarray, k: int, without: range = range(0)) -> list[tuple[int, int]]:
        """(row, score) of the k best rows, all if fewer; equal scores go to the smaller row. Rows in `without` take no part."""
        slices, offset = self.total(weights)
        open_rows = self.every.copy()
        for r in without:
            open_rows[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure = np.zeros_like(open_rows)
        need = min(k, int(np.bitwise_count(open_rows).sum()))
        have = 0
        for s in reversed(slices):
            hit = open_rows & s
            n = int(np.bitwise_count(hit).sum())
            if have + n > need:
                open_rows = hit
            else:
                sure |= hit
                have += n
                open_rows &= ~s
                if have == need:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if have < need:  # what is left has one score: the boundary
            rows = np.append(rows, np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little"))[: need - have])
        kind = np.int64 if len(slices) < 63 else object  # Python's integers where 64 bits don't do
        score = np.zeros(len(rows), dtype=kind)
        for b, s in enumerate(slices):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << b
        return sorted(((int(r), int(x) + offset) for r, x in zip(rows, score, strict=True)), key=lambda x: (-x[1], x[0]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query vector the k rows of the greatest integer inner product, itself left out.

    Rows are dealt by hash to blocks of about BLOCK rows, and each block's slices are built once and written. Queries are dealt
    to turns of at most CHUNK; each turn visits each block, which sends its slices, a ninth of its rows' size. A block
    answers with its own k best, which are whole, and the k best of these are taken for each query. Nothing is broadcast.

    Null ids, null vectors and vectors with null or non-finite components take no part. A query meets the rows of its own
    length, which have blocks of their own. Every row but those of the query's own id is a candidate, so that an id that
    repeats may come more than once; of query rows with one id the greatest vector asks. Ties go to the smaller id.
    Components or scores beyond 64 bits fail. Vectors may be of any length; columns but the two named aren't looked at.
    Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    copies = F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))  # further equal rows can't be in a result
    index = quantise(vectors, id_col, vec, scale).groupBy("id", "q").agg(F.count("*").alias("n")).select("id", "q", F.explode(copies).alias("copy"))
    asks = quantise(queries, id_col, vec, scale).groupBy("id").agg(F.max("q").alias("q"))
    index, asks = keep(index, "index-rows"), keep(asks, "index-queries")
    size = F.size("q").alias("dims")
    total = index.count()
    schema = "query_id long, rank int, id long, score long"
    if not total:
        return spark.createDataFrame([], schema)
    # lengths of more than one block; there are fewer of them than blocks
    many = {r["dims"]: -(-r["n"] // BLOCK) for r in index.groupBy(size).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).collect()}
    pieces = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.size("q")] if many else F.lit(None).cast("int")
    parts = F.coalesce(pieces, F.lit(1))
    blocks = -(-total // BLOCK)
    count = asks.count()
    turns = max(1, -(-count // CHUNK), min(-(-count // 16), -(-3 * spark.sparkContext.defaultParallelism // blocks)))
    own = F.pmod(F.xxhash64("id", "q", "copy"), parts).cast("int").alias("block")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table["id"].to_numpy()
        q = table["q"].combine_chunks()
        flat = (pa.concat_arrays(q.chunks) if isinstance(q, pa.ChunkedArray) else q).flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), len(flat) // len(ids))[order]

    def build(rows: pa.Table) -> pa.Table:
        ids, q = matrix(rows)
        s = Slices.of(q)
        maps = np.concatenate([np.zeros(0, dtype=np.uint64), *(m for own in s.maps for m in own)])
        raw = [np.ascontiguousarray(x).tobytes() for x in (ids, s.low, np.array(s.bits, dtype=np.int64), maps)]
        return pa.table({"dims": rows["dims"][:1], "block": rows["block"][:1], **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "low", "bits", "maps"), raw, strict=True)}})

    built = index.select(size, own, "id", "q").groupBy("dims", "block").applyInArrow(build, "dims int, block int, ids binary, low binary, bits binary, maps binary")
    built = keep(built, "index-slices").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    turn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(turns)).cast("int").alias("turn")
    asks = asks.select(size, F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), turn, "id", "q")

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            ids, low, bits, maps = (np.frombuffer(rows[n][0].as_buffer(), dtype=t) for n, t in (("ids", np.int64), ("low", np.int64), ("bits", np.int64), ("maps", np.uint64)))
            slices = Slices(len(ids), low, bits, maps)
            for i, w in zip(*matrix(queries), strict=True):
                mine = range(*np.searchsorted(ids, i + np.array([0, 1])).tolist())
                out += [(int(i), int(ids[r]), s) for r, s in slices.best(w.astype(np.int64), k, mine)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), cols, strict=True)})

    found = built.groupBy("dims", "block", "turn").cogroup(asks.groupBy("dims", "block", "turn")).applyInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
