"""Near-duplicates: SetSketch registers in bands, a joint likelihood estimate, and full sets to confirm."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, mix64, prefix_hash, range_hash, unused, words
from .graph import components

#: 40 bands of 5 registers: two sets of similarity 0.8 miss all bands once in 8 million pairs, sets of 0.05 meet in one pair of 80,000.
BANDS, ROWS = 40, 5
M = BANDS * ROWS
BASE, SCALE = 1.005, 20.0
#: Pairs that the likelihood puts below this are dropped; the estimate of a true 0.8 is 8 standard errors above.
LOOSE = 0.55
#: Bands and LOOSE are laid out for links of so many per cent or more.
LEAST = 80
#: Documents that are compared in one task; larger groups are split.
BLOCK, HUBS = 200, 8
#: Classes of one band key whose registers are compared in one task; keys with more are cut into cells.
CELL = 1000

with np.errstate(over="ignore"):
    _SEED = mix64(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _C = (_SEED[:M] | np.uint64(1))[:, None], _SEED[M:][:, None]


def shingle_set(w: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence; none without words."""
    if not w:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(b" ".join(w), dtype=np.uint8)
    space = np.flatnonzero(raw == 32)
    start, end = np.append(0, space + 1), np.append(space, len(raw))
    g = min(shingle, len(w))
    return np.unique(range_hash(prefix_hash(raw), start[: len(w) - g + 1], end[g - 1 :]))


def registers(h: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: per hash function the floor of 1 - log_BASE of the least exponential, truncated to 16 bits.

    The least exponential belongs to the least uniform value, so that the logarithm is taken once a register.
    Registers of a union are the greater of each pair.
    """
    least = np.full(M, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 512):
            np.minimum(least, (_A * h[None, i : i + 512] + _C).min(axis=1), out=least)
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(x / SCALE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = mix64(out * np.uint64(0x100000001B3) + regs.reshape(BANDS, ROWS)[:, j].astype(np.uint64) + np.uint64(j << 20))
    return out.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs (rows) by joint maximum likelihood of greater, smaller and equal registers, given both sizes."""
    up, down = (regs_a > regs_b).sum(axis=1)[:, None], (regs_a < regs_b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    more, less = p(u - v * j), p(v - u * j)
    like = up * np.log(np.maximum(more, 1e-12)) + down * np.log(np.maximum(less, 1e-12)) + (M - up - down) * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), like.argmax(axis=1)]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (id, text) to (id, k, n, bands, regs): k stands for the word sequence, n is the size of the set."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 2000):
                k, n, bands, regs = [], [], [], []
                for t in texts[at : at + 2000]:
                    w = words(t)
                    h = shingle_set(w, shingle)
                    k.append(hashlib.md5(b" ".join(w), usedforsecurity=False).digest())
                    n.append(len(h))
                    r = registers(h) if len(h) else None
                    regs.append(r.tobytes() if len(h) else None)
                    bands.append(band_keys(r) if len(h) else np.zeros(0, dtype=np.int64))
                offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 2000), pa.array(k, pa.binary()), pa.array(n, pa.int64()), lists, pa.array(regs, pa.binary())], names=["id", "k", "n", "bands", "regs"])

    return docs.mapInArrow(run, "id long, k binary, n long, bands array<long>, regs binary")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, keys) of class representatives to (a, b, keys, ok): whether their estimate reaches LOOSE."""
    own = classes.select("node", "n", "regs")
    both = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b")

    def run(batches):
        for t in batches:
            for at in range(0, t.num_rows, 4000):
                s = t.slice(at, 4000)
                ra, rb = (np.frombuffer(b"".join(s[c].to_pylist()), dtype=np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                ok = estimate(ra, rb, s["na"].to_numpy().astype(float), s["nb"].to_numpy().astype(float)) >= LOOSE
                yield pa.RecordBatch.from_arrays([s["a"], s["b"], s["keys"], pa.array(ok)], names=["a", "b", "keys", "ok"])

    return both.select("a", "b", "keys", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, keys array<struct<key:long,c:long>>, ok boolean")


def _spread(nodes: np.ndarray, out: np.ndarray, n: np.ndarray, regs: np.ndarray):
    """Links (a, b) that connect what estimates of LOOSE connect among rows, of which those not `out` are connected already."""
    inside, left = np.flatnonzero(~out), np.flatnonzero(out)

    def near(i, others):
        others = others[np.minimum(n[others], n[i]) >= LOOSE * np.maximum(n[others], n[i]) - 1e-9]  # no estimate exceeds the ratio of the sizes
        got = [o[estimate(np.broadcast_to(regs[i], (len(o), M)), regs[o], np.full(len(o), n[i]), n[o]) >= LOOSE] for o in np.split(others, range(4000, len(others), 4000))]
        return np.concatenate(got)

    while len(left):
        todo, left, joined = [left[0]], left[1:], not len(inside)
        while todo and (len(left) or not joined):
            i = todo.pop()
            got = near(i, left)
            for j in got:
                yield int(nodes[i]), int(nodes[j])
            todo += got.tolist()
            left = np.setdiff1d(left, got, assume_unique=True)
            if not joined and len(hit := near(i, inside)):
                joined = True
                yield int(nodes[i]), int(nodes[hit[0]])


def _repair(tried: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) for classes that share a band key but were refused by its hub; None where no key has any to compare.

    Each refused class is compared with all classes of its key, those that the hub took included: these are connected
    already, so that one link to them is enough. A key of over CELL classes, or refused ones, is cut into cells, so that each
    refused class still meets every other.
    """
    refused = keep(tried.filter("NOT ok").select(F.explode("keys").alias("x"), F.col("b").alias("node")).select("x.key", "x.c", "node"), "refused")
    if refused.isEmpty():
        return None
    keys = keep(refused.groupBy("key").agg(F.ceil(F.first("c") / CELL).cast("int").alias("parts"), F.ceil(F.count("*") / CELL).cast("int").alias("turns")), "refused-keys")
    own = rows.join(keys, "key").join(refused.select("key", "node", F.lit(True).alias("out")), ["key", "node"], "left").withColumn("out", F.coalesce("out", F.lit(False)))
    at = lambda col: F.pmod(F.xxhash64("node"), F.col(col)).cast("int")
    base = own.select("key", "node", "out", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), at("parts").alias("part"))
    more = own.filter("out AND (parts > 1 OR turns > 1)").select("key", "node", "out", at("turns").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    cells = base.unionByName(more).distinct().join(classes.select("node", "n", "regs"), "node")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "key", "turn", "part").sortWithinPartitions("key", "turn", "part", "node")

    def run(batches):
        at, own = None, []

        def done():
            nodes, out, size, regs = zip(*own, strict=True)
            found = list(_spread(np.array(nodes), np.array(out), np.array(size, dtype=float), np.frombuffer(b"".join(regs), dtype=np.uint16).reshape(-1, M)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for t in batches:
            for *cell, node, out, size, regs in zip(*(t[c].to_pylist() for c in ("key", "turn", "part", "node", "out", "n", "regs")), strict=True):
                if cell != at:
                    if own:
                        yield done()
                    at, own = cell, []
                own.append((node, out, size, regs))
        if own:
            yield done()

    return dealt.select("key", "turn", "part", "node", "out", "n", "regs").mapInArrow(run, "a long, b long").distinct()


class _Sets:
    """Sets of a few documents, numbered, for comparing one with all."""

    def __init__(self, texts: list[str], shingle: int):
        sets = [shingle_set(words(t), shingle) for t in texts]
        self.size = np.array([len(s) for s in sets])
        _, inv = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.cumsum(self.size) - self.size
        self.codes = inv.astype(np.int64)
        self.flag = np.zeros(int(inv.max()) + 1 if len(inv) else 1, dtype=bool)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others whose similarity with i, on the full sets, is at least percent / 100."""
        n = self.size[i]
        near = others[(100 * np.minimum(self.size[others], n) >= percent * np.maximum(self.size[others], n))]
        if not len(near):
            return near
        own = self.codes[self.first[i] : self.first[i] + n]
        self.flag[own] = True
        size = self.size[near]
        at = np.repeat(self.first[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.add.reduceat(self.flag[self.codes[at]].astype(np.int64), np.cumsum(size) - size)
        self.flag[own] = False
        return near[100 * both >= percent * (n + size - both)]


def _confirm(shingle: int, percent: int):
    """Rows (grp, part, node, text, extra), sorted by group and part, to links (a, b) that connect what truly connects.

    Within a part a search spreads from document to document, each compared with all that are not yet reached; it stops
    when none is left, so that a group of copies takes few comparisons, and no link between components is missed. Where
    a part holds extra documents, only these are compared, each with all others.
    """

    def work(rows):
        nodes = np.array([r[0] for r in rows])
        extra = np.array([r[2] for r in rows])
        sets = _Sets([r[1] for r in rows], shingle)
        if extra.any():
            for i in np.flatnonzero(extra):
                for j in sets.linked(i, np.flatnonzero(nodes != nodes[i]), percent):
                    yield int(nodes[i]), int(nodes[j])
            return
        left = np.arange(len(nodes))
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                i = todo.pop()
                got = sets.linked(i, left, percent)
                for j in got:
                    yield int(nodes[i]), int(nodes[j])
                todo += got.tolist()
                left = np.setdiff1d(left, got, assume_unique=True)

    def run(batches):
        at, rows = None, []

        def done():
            found = list(work(rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for t in batches:
            for g, p, node, text, extra in zip(*(t[c].to_pylist() for c in ("grp", "part", "node", "text", "extra")), strict=True):
                if (g, p) != at:
                    if rows:
                        yield done()
                    at, rows = (g, p), []
                rows.append((node, text, extra))
        if rows:
            yield done()

    return run


def _compare(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "grp", "part").sortWithinPartitions("grp", "part", "node")
    return dealt.select("grp", "part", "node", "text", "extra").mapInArrow(_confirm(shingle, percent), "a long, b long")


def _bitmap(ids: DataFrame, col: str, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of fixed size over hashes of ids; it only spares work."""

    def run(batches):
        out = np.zeros(bits, dtype=bool)
        for b in batches:
            out[mix64(b[0].to_numpy().view(np.uint64)) % np.uint64(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in ids.select(F.col(col).cast("long")).coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], dtype=np.uint8)
    return np.unpackbits(total).astype(bool)


def _member_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(k, node, grp, text): the text of each representative in a group; of other documents few texts leave their task."""
    seen = docs.sparkSession.sparkContext.broadcast(_bitmap(members, "node"))

    def run(batches):
        for b in batches:
            ids = b.column(0)
            ok = np.flatnonzero(seen.value[mix64(ids.fill_null(0).to_numpy().view(np.uint64)) % np.uint64(len(seen.value))])
            texts = b.column(1).take(pa.array(ok)).to_pylist()
            k = [hashlib.md5(b" ".join(words(t)), usedforsecurity=False).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(ok)), pa.array(k, pa.binary()), pa.array(texts, pa.string())], names=["id", "k", "text"])

    texts = docs.mapInArrow(run, "id long, k binary, text string")
    return texts.withColumnRenamed("id", "node").join(members.select("k", "node", "grp"), ["k", "node"]).dropDuplicates(["k", "node"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, comp), one row per input row: the size of its set and the smallest id that links reach.

    Two texts link where 100 * |intersection| >= percent * |union| of their sets of word shingles.
    1. Rows with the same word sequence make a class; its smallest id stands for it. From here on each class counts once.
    2. Each set's registers are cut into bands; in each band, classes with equal registers are paired with the smallest
       id among them, so that pairs grow with rows and not with the squares of groups.
    3. Pairs that the joint likelihood of their registers puts below LOOSE go; the class so refused is compared with all
       others of its band (see _repair). The rest connect classes into groups, which hold every pair that may link.
    4. Full sets decide within each group (see _confirm). A group of over BLOCK classes is split into parts that share
       HUBS classes; what isn't connected to the group's main component after that is compared with all parts.

    An empty or null text has an empty set and links with nothing; its comp is its own id. A row with a null id takes no
    part in links and has a null comp. Rows that share an id but not a text follow their own texts. Ties don't arise:
    comp is a minimum. Texts may be of any length; columns but the two named aren't looked at. An empty table gives an empty
    result. percent under LEAST is refused, since the bands would lose links.
    """
    if percent < LEAST:
        raise ValueError(f"links of under {LEAST} per cent are beyond the bands")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sk = keep(sketches(src, shingle), "sketches")
    classes = sk.filter("n > 0 AND id IS NOT NULL").groupBy("k").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    classes = keep(classes, "classes")
    rows = classes.select(F.explode("bands").alias("key"), "node")
    hubs = rows.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).filter("c > 1")
    # where a hub has but one partner, nobody is left to compare
    more = F.collect_list(F.when(F.col("c") > 2, F.struct("key", "c"))).alias("keys")
    pairs = rows.join(hubs, "key").filter("node != a").groupBy("a", F.col("node").alias("b")).agg(more)
    tried = keep(_likely(pairs, classes), "tried")
    links, again = tried.filter("ok").select("a", "b"), _repair(tried, rows, classes)
    groups = components(links if again is None else links.unionByName(again)).withColumnRenamed("comp", "grp")
    members = classes.select("k", "node").join(groups, "node")
    sized = members.groupBy("grp").agg(F.count("*").alias("c"))
    members = keep(members.join(sized, "grp").withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int")), "members")
    texts = keep(_member_texts(src, members).join(members.select("node", "k", "parts"), ["k", "node"]), "member-texts")
    part = F.pmod(F.xxhash64("node", "k"), F.col("parts")).cast("int")
    plain = texts.select("grp", "node", "text", part.alias("part"), "parts", F.lit(False).alias("extra"))
    large = members.filter("parts > 1")
    hot = not large.isEmpty()
    if hot:
        # the smallest ids by hash of each large group go to all of its parts
        hub = large.groupBy("grp").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.floor(F.col("c") / (4 * HUBS)))) == 0, F.col("node")))), 1, HUBS).alias("hub"))
        hub = hub.select("grp", F.explode("hub").alias("node"))
        spread = plain.join(hub, ["grp", "node"]).withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part != own")
        links = _compare(plain.unionByName(spread.drop("own")).drop("parts"), shingle, percent)
        links = keep(links, "true-links")
        comp = components(links)
        where = large.select("node", "grp", "parts").distinct().join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        main = where.groupBy("grp", "comp").count().groupBy("grp").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        rest = keep(where.join(main, "grp").filter("comp != main").select("grp", "node", "parts"), "rest")
        if not rest.isEmpty():
            turns = rest.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
            rest = rest.join(turns, "grp").withColumn("turn", F.pmod(F.xxhash64("node"), F.col("turns")).cast("int"))
            code = lambda turn, part: (turn * F.col("parts") + part).cast("int")
            more = texts.select("grp", "node", "text").join(rest, ["grp", "node"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            more = more.select("grp", "node", "text", code(F.col("turn"), F.col("p")).alias("part"), F.lit(True).alias("extra"))
            base = plain.join(turns, "grp").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
            base = base.select("grp", "node", "text", code(F.col("t"), F.col("part")).alias("part"), "extra")
            links = links.unionByName(_compare(base.unionByName(more), shingle, percent))
            comp = components(links)
    else:
        comp = components(_compare(plain.drop("parts"), shingle, percent))
    named = classes.select("k", "node").join(comp, "node", "left").select("k", F.coalesce("comp", "node").alias("comp"))
    out = sk.select("id", "k", "n").join(named, "k", "left")
    return out.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id")).alias("comp"), "k")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose id is the smallest of their component, with all their columns; rows with a null id stay.

    The components are decided on distinct ids, so that a repeated row stays as often as it came.
    """
    (key,) = unused(docs, "id")
    gone = near_duplicates(docs, shingle, percent, id_col, text).filter("id IS NOT NULL AND id != comp").select(F.col("id").alias(key)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_anti")
