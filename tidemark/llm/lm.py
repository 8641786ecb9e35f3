"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation, normalised by matrix products.

The words that the model knows are those with a count of at least the root of the number of training tokens over SHARE, so
that the vocabulary and what is learnt of its words grow with the corpus. Words are dealt by frequency to about as many
classes as a class has words. The last CONTEXT words, each weighed by its place, add up to a prediction q; with it the
model gives a distribution over classes and one over the words of each class, so that a token's probability is normalised
by two matrix products of the root of the vocabulary each. Words that the model doesn't know make up class 0, within which a
word has its smoothed share of the training counts.
"""

from __future__ import annotations

from collections import Counter
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, crc_mod_py, keep, words

WIDTH, CONTEXT, SHARE = 16, 4, 20
#: Noise words and classes for each token, shared by a step; tokens of a step; rate of learning.
NOISE, CLASS_NOISE, STEP, RATE = 32, 16, 4096, 0.02
#: Training starts from a model of so many frequent words, after one word of context; then all words learn in full context.
START = 512
#: Words whose counts every task holds beside the model's own: so many at most, of so many bytes at most; it only spares a join.
HEAD, LONGEST = 1 << 18, 64
#: Tokens that are scored together.
BLOCK = 1 << 16
#: Tokens of the smallest shard that is learnt from by itself.
SHARD = 1 << 20
END = b""


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): counts of all words of a table (text), and of the end of each text as the empty word."""

    def run(batches):
        tally: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["w", "c"])
            tally.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                tally.update(words(t))
                tally[END] += 1
                if len(tally) > 400_000:
                    yield flush()
        if tally:
            yield flush()

    return docs.select("text").mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def start(pairs: np.ndarray, width: int = WIDTH, noise: int = 10, steps: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors, prediction vectors and offsets of a few words from the counts of all their pairs.

    The score of word w after h is r_h . t_w + b_w. Noise-contrastive estimation tells the pairs seen from `noise` times as many
    drawn from the word frequencies; since pairs are counted over the whole corpus, its gradient is taken over all of them
    at once, the noise in expectation.
    """
    n = len(pairs)
    total = max(pairs.sum(), 1.0)
    joint, after = pairs / total, pairs.sum(axis=1) / total
    share = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * n)
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 0.1, (n, width)), rng.normal(0, 0.1, (n, width)), np.log(share)]
    m, v = ([np.zeros_like(x) for x in p] for _ in range(2))
    lift = np.log(noise * share)[None, :]
    for i in range(1, steps + 1):
        true = 1 / (1 + np.exp(-np.clip(p[0] @ p[1].T + p[2][None, :] - lift, -40, 40)))
        g = noise * after[:, None] * share[None, :] * true - joint * (1 - true)
        for j, x in enumerate((g @ p[1] + 1e-7 * p[0], g.T @ p[0] + 1e-7 * p[1], g.sum(axis=0))):
            m[j] = 0.9 * m[j] + 0.1 * x
            v[j] = 0.99 * v[j] + 0.01 * x * x
            p[j] = p[j] - 0.03 * (1 - i / (steps + 1)) * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-9)
    return p[0], p[1], p[2]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, of sorted ones, and the sums of rows of values by key."""
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[head], *(np.add.reduceat(v, head) for v in values)]


class Model:
    """Parameters of a log-bilinear model of the words 1 to n by falling frequency; word 0 is any other.

    r: what a word says as context, with weights c for each place; t and b: a word as prediction; s and e: a class as
    prediction. gr, gt, gs and gc are the sums of squares that steps are measured by.
    """

    def __init__(self, counts: np.ndarray, width: int = WIDTH):
        """counts: of word 0, 1, ... in training; 0 for none."""
        n = len(counts) - 1
        self.n, self.size = n, max(1, int(np.ceil(np.sqrt(n))))
        self.cls = np.append(0, 1 + np.arange(n) // self.size).astype(np.int32)
        self.k = int(self.cls[-1]) + 1
        share = (counts + 0.5) / (counts + 0.5).sum()
        p_class = np.bincount(self.cls, share, self.k)
        p_word = share[1:] / max(share[1:].sum(), 1e-300)
        self.sum_word, self.sum_class = np.cumsum(p_word), np.cumsum(p_class)
        self.lift_word = np.append(0, np.log(NOISE * p_word)).astype(np.float32)
        self.lift_class = np.log(CLASS_NOISE * p_class).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, dtype=np.float32)
        self.r, self.t, self.s = zero(n + 1, width), zero(n + 1, width), zero(self.k, width)
        self.c = np.full((CONTEXT, width), 1.0 / CONTEXT, dtype=np.float32)
        self.b, self.e = np.append(0, np.log(p_word)).astype(np.float32), np.log(p_class).astype(np.float32)
        self.gr, self.gt, self.gs = (np.full(m, 1.0, dtype=np.float32) for m in (n + 1, n + 1, self.k))
        self.gc = np.full(1, 1.0, dtype=np.float32)

    def begin(self, r: np.ndarray, t: np.ndarray) -> None:
        """Takes over the vectors of the first words from start()."""
        self.r[: len(r)], self.t[1 : len(t)] = r, t[1:]

    def predict(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context vectors of ids, and predictions for all places but the first CONTEXT ones."""
        seen = self.r[ids]
        n = len(ids) - CONTEXT
        q = seen[CONTEXT - 1 : CONTEXT - 1 + n] * self.c[0]
        for d in range(2, CONTEXT + 1):
            q += seen[CONTEXT - d : CONTEXT - d + n] * self.c[d - 1]
        return seen, q

    def learn(self, ids: np.ndarray, real: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One step of noise-contrastive estimation over a stretch of texts; `real` tells tokens from padding.

        Every token and its class are told from NOISE words and CLASS_NOISE classes drawn from the training frequencies.
        """
        seen, q_all = self.predict(ids)
        at = np.flatnonzero(real[CONTEXT:])
        if not len(at):
            return
        at = at[np.argsort(ids[CONTEXT:][at], kind="stable")]
        w = ids[CONTEXT:][at]
        q, dq = q_all[at], np.zeros((len(at), q_all.shape[1]), dtype=np.float32)
        first = int(np.searchsorted(w, 1))  # words that aren't known take part as a class only
        todo = [("s", "e", "gs", 0, self.cls[w], self.sum_class, self.lift_class, CLASS_NOISE)]
        if first < len(w):
            todo.append(("t", "b", "gt", first, w[first:], self.sum_word, self.lift_word, NOISE))
        for vec, off, sq, lo, true, sums, lift, count in todo:
            t, b, g, own = getattr(self, vec), getattr(self, off), getattr(self, sq), q[lo:]
            noise = np.minimum(np.searchsorted(sums, rng.random(count) * sums[-1], side="right"), len(sums) - 1) + (len(b) - len(sums))
            tw = t[true]
            up = 1 - _sigmoid(np.einsum("ij,ij->i", own, tw) + b[true] - lift[true])
            down = own @ t[noise].T
            down += b[noise] - lift[noise]
            _sigmoid(down)
            tw *= up[:, None]
            dq[lo:] += tw
            dq[lo:] -= down @ t[noise]
            rows, dt, db = _sums(true, up[:, None] * own, up)  # classes rise with words
            rows, inv = np.unique(np.append(rows, noise), return_inverse=True)
            total = np.zeros((len(rows), dt.shape[1] + 1), dtype=np.float32)
            np.add.at(total, inv, np.vstack([np.column_stack([dt, db]), np.column_stack([-(down.T @ own), -down.sum(axis=0)])]))
            g[rows] += np.square(total).mean(axis=1)
            total *= (rate / np.sqrt(g[rows]))[:, None]
            t[rows] += total[:, :-1]
            b[rows] += total[:, -1]
        back, full = np.zeros_like(seen), np.zeros_like(q_all)
        full[at] = dq
        n = len(full)
        for d in range(1, CONTEXT + 1):
            back[CONTEXT - d : CONTEXT - d + n] += full * self.c[d - 1]
        order = np.argsort(ids, kind="stable")
        rows, dr = _sums(ids[order], back[order])
        self.gr[rows] += np.square(dr).mean(axis=1)
        self.r[rows] += dr * (rate / np.sqrt(self.gr[rows]))[:, None]
        if rng.random() < 0.25:  # there are few weights of places: a step in four does
            dc = np.stack([np.einsum("ij,ij->j", full, seen[CONTEXT - d : CONTEXT - d + n]) for d in range(1, CONTEXT + 1)])
            self.gc += np.square(dc).mean()
            self.c += dc * (rate / np.sqrt(self.gc))

    def score(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Natural log probability of each real token after the first CONTEXT ones: of its class, and of the word in its class."""
        out = []
        for lo in range(0, len(ids) - CONTEXT, BLOCK):
            part = ids[lo : lo + BLOCK + CONTEXT]
            at = np.flatnonzero(real[lo + CONTEXT : lo + BLOCK + CONTEXT])
            q, w = self.predict(part)[1][at], part[CONTEXT:][at]
            own = self.cls[w]
            got = np.empty(len(w), dtype=np.float32)
            for i in range(0, len(w), 4096):
                got[i : i + 4096] = _log_share(q[i : i + 4096], self.s, self.e, own[i : i + 4096])
            order = np.argsort(own, kind="stable")
            edge = np.searchsorted(own[order], np.arange(1, self.k + 1))
            for c in range(1, self.k):
                first = 1 + (c - 1) * self.size
                for i in range(edge[c - 1], edge[c], 4096):
                    rows = order[i : min(i + 4096, edge[c])]
                    got[rows] += _log_share(q[rows], self.t[first : first + self.size], self.b[first : first + self.size], w[rows] - first)
            out.append(got)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)


def _log_share(q: np.ndarray, t: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of the softmax over all rows of t, at the one that each row of q has."""
    z = q @ t.T
    z += b
    true = z[np.arange(len(z)), own]
    np.minimum(z, 80, out=z)
    return np.minimum(true, 80) - np.log(np.exp(z, out=z).sum(axis=1))


def known_words(counts: DataFrame, total: int) -> tuple[list[tuple[bytes, int]], int]:
    """Words with counts, by falling count and then bytes, and how many of them the model knows: these come first.

    The model knows the words of at least the root of `total` over SHARE, and the end; all of them are at most SHARE times that
    root. The others are the next most frequent ones, up to HEAD in all; they change no result.
    """
    if not total:
        return [], 0
    least = max(2.0, np.sqrt(total) / SHARE)
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut = next((s for (s, _), n in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if n > HEAD), -1)
    own = (F.col("c") >= least) | (F.col("w") == F.lit(END))
    rows = counts.filter(own | (step > cut) & (F.length("w") <= LONGEST)).toArrow()
    rows = sorted(zip(rows["w"].to_pylist(), rows["c"].to_pylist(), strict=True), key=lambda x: (x[1] < least and x[0] != END, -x[1], x[0]))
    return rows, sum(c >= least or w == END for w, c in rows)


def _encoded(src: DataFrame, head: list[tuple[bytes, int]], known: int, modulus: int, held: int) -> DataFrame:
    """Every text (id, text) as numbers of the model's words, with what its other words add up to.

    base: sum of log10(count + 1) over tokens of the head, known: their number; rest, rest_log: number of tokens that the
    model doesn't know, and that sum over those in the head; tail: the words that aren't in the head.
    """
    pack = {w: i for i, (w, _) in enumerate(head)}
    logs = np.append(np.log10(np.array([c for _, c in head], dtype=float) + 1), 0.0)
    sent = src.sparkSession.sparkContext.broadcast((pack, logs))  # at most HEAD words of LONGEST bytes beside the model's own
    kind = src.schema[0].dataType.simpleString()
    fields = (("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("rest", pa.int64()), ("rest_log", pa.float64()), ("ids", pa.binary()), ("tail", pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int32())]))))
    schema = f"rid long, id {kind}, held_out boolean, n_tokens long, known long, base double, rest long, rest_log double, ids binary, tail array<struct<w:binary,n:int>>"

    def run(batches):
        pack, logs = sent.value
        get, none = pack.get, len(pack)
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for at in range(0, len(texts), 1000):
                part = ids.slice(at, 1000)
                out = []
                for i, t in zip(part.to_pylist(), texts[at : at + 1000], strict=True):
                    w = [*words(t), END]
                    place = np.fromiter((get(x, none) for x in w), dtype=np.int32, count=len(w))
                    seen, value, other = place < none, logs[place], place >= known
                    tail = Counter(x for x, s in zip(w, seen.tolist(), strict=True) if not s) if not seen.all() else {}
                    out.append((crc_mod_py(i, modulus) == held, len(w), int(seen.sum()), float(value.sum()), int(other.sum()), float(value[other].sum()), np.where(other, 0, place + 1).astype(np.int32).tobytes(), [{"w": k, "n": c} for k, c in tail.items()]))
                cols = [pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(out))), part, *cols], names=["rid", "id", *(n for n, _ in fields)])
                rid += len(out)

    return src.mapInArrow(run, schema)


def _stretches(batch: pa.RecordBatch, end: int, size: int):
    """The texts of a column ids, each after CONTEXT ends, in parts of about `size` tokens: rows, numbers, which are real, and lengths."""
    raw = batch.column("ids").to_pylist()
    lo = 0
    while lo < len(raw):
        hi, n = lo, 0
        while hi < len(raw) and (hi == lo or n < size):
            n += len(raw[hi]) // 4
            hi += 1
        yield range(lo, hi), *_laid(raw[lo:hi], end)
        lo = hi


def _laid(raw: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, each after CONTEXT ends: numbers, which are real, and lengths."""
    length = np.array([len(x) // 4 for x in raw])
    at = np.arange(length.sum()) + CONTEXT * np.repeat(np.arange(1, len(raw) + 1), length)
    ids, real = np.full(length.sum() + CONTEXT * len(raw), end, dtype=np.int32), np.zeros(length.sum() + CONTEXT * len(raw), dtype=bool)
    ids[at], real[at] = np.frombuffer(b"".join(raw), dtype=np.int32), True
    return ids, real, length


def _of_shards(batches, end: int):
    """Batches of (shard, ids), in order of shards, as (shard, numbers, which are real) of about BLOCK tokens of one shard each, however
    the rows come in batches."""
    held, tokens, shard = [], 0, None
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and (s != shard or tokens >= BLOCK):
                yield shard, *_laid(held, end)[:2]
                held, tokens = [], 0
            shard = s
            held.append(x)
            tokens += len(x) // 4
    if held:
        yield shard, *_laid(held, end)[:2]


def pair_counts(encoded: DataFrame, first: int, end: int) -> np.ndarray:
    """How often each of the first words follows each, over all texts; 0 is any other word, a text starts after an end."""
    n = first + 1

    def run(batches):
        total = np.zeros(n * n, dtype=np.int64)
        for b in batches:
            for _, ids, real, _ in _stretches(b, end, BLOCK):
                x = np.where(ids < n, ids, 0)
                total += np.bincount((x[:-1] * n + x[1:])[real[1:]], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "c"])

    rows = encoded.select("ids").mapInArrow(run, "code int, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()  # at most (START + 1)**2
    out = np.zeros(n * n)
    out[rows["code"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(n, n)


def shards_of(tokens: int) -> int:
    """How many shards so many tokens are learnt in: one for SHARD tokens, eight times as many tokens each for ten thousand times as many in all."""
    return max(1, int(np.ceil((tokens / SHARD) ** 0.75)))


def train(encoded: DataFrame, counts: np.ndarray, end: int, shards: int = 1) -> Model:
    """A model of the texts of columns id and ids. Every shard learns from all its texts, starting alike; then parameters are averaged.

    Shards, and the order of their texts, follow from hashes of id and text, and draws from the shard's number, so that the model
    doesn't depend on how rows are dealt to files, batches and tasks (but for the last digits of sums). A word's vectors
    are weighed by how often the shard has met it, the others by its tokens. What comes back is of the size of the model,
    which grows with the root of the corpus.
    """
    model = Model(counts)
    first = min(START, model.n)
    model.begin(*start(pair_counts(encoded, first, end))[:2])
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    width = model.r.shape[1]

    def rows_of(m: Model, met: np.ndarray, tokens: int):
        at = np.flatnonzero(met)
        own = np.column_stack([m.r, m.t, m.b, m.gr, m.gt])[at]
        rest = np.zeros((m.k + CONTEXT, 2 * width + 3), dtype=np.float32)
        rest[: m.k, :width], rest[: m.k, width], rest[: m.k, width + 1] = m.s, m.e, m.gs
        rest[m.k :, :width] = m.c
        row = np.append(at, -1 - np.arange(len(rest)))
        weight = np.append(met[at], np.full(len(rest), tokens)).astype(float)
        flat = np.vstack([own, rest]).astype(np.float32)
        for i in range(0, len(row), 10000):
            part = flat[i : i + 10000]
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]).astype(np.int32)), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(row[i : i + 10000]), pa.array(weight[i : i + 10000]), v], names=["row", "weight", "v"])

    def run(batches):
        at, m = None, None
        for shard, ids, real in _of_shards(batches, end):
            if shard != at:
                if m is not None:
                    yield from rows_of(m, met, tokens)  # noqa: F821
                at, m, rng, tokens = shard, deepcopy(sent.value), np.random.default_rng(shard), 0
                met = np.zeros(m.n + 1, dtype=np.int64)
            for lo in range(0, len(ids) - CONTEXT, STEP):
                m.learn(ids[lo : lo + STEP + CONTEXT], real[lo : lo + STEP + CONTEXT], rng)
            met += np.bincount(ids, minlength=m.n + 1)
            tokens += len(ids)
        if m is not None:
            yield from rows_of(m, met, tokens)

    shard = F.pmod(F.xxhash64("id", "ids"), F.lit(shards)).cast("int")
    dealt = encoded.select(shard.alias("shard"), "ids", F.xxhash64("ids", "id").alias("order"), "id").repartitionById(shards, "shard").sortWithinPartitions("shard", "order", "id")
    learnt = dealt.select("shard", "ids").mapInArrow(run, "row long, weight double, v array<float>")
    sums = [F.sum(F.col("v")[i] * F.col("weight")).alias(f"v{i}") for i in range(2 * width + 3)]
    got = learnt.groupBy("row").agg(F.sum("weight").alias("weight"), *sums).toArrow()
    row, flat = got["row"].to_numpy(), np.column_stack([got[f"v{i}"].to_numpy() for i in range(2 * width + 3)] or [np.zeros(0)])
    flat = (flat / got["weight"].to_numpy()[:, None]).astype(np.float32)
    at, own = row[row >= 0], flat[row >= 0]
    model.r[at], model.t[at], model.b[at] = own[:, :width], own[:, width : 2 * width], own[:, 2 * width]
    at, own = -1 - row[row < 0], flat[row < 0]
    cls = at < model.k
    model.s[at[cls]], model.e[at[cls]] = own[cls, :width], own[cls, width]
    model.c[at[~cls] - model.k] = own[~cls, :width]
    return model


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row, over whole texts.

    Rows whose crc32 of the id modulo `modulus` is `held` are not learnt from. A text's tokens are its words and one end;
    a null or empty text has the end alone. A null id hashes as the empty text. Texts may be of any length. Repeated rows are
    scored, and learnt from, as often as they come. With nothing to learn from, both scores are 0. An empty table gives
    an empty result. Other columns are not looked at. Scores don't depend on how the rows are dealt to files and tasks.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    counts = keep(word_counts(src.filter(crc_mod("id", modulus) != held)), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(sums["n"]), int(sums["v"])
    head, known = known_words(counts, n_all)
    own = np.array([c for _, c in head[:known]], dtype=float)
    rest = n_all - own.sum()
    size_all, size_rest = np.log10(n_all + v_all + 1), np.log10(rest + v_all - known + 1)
    end = next((i + 1 for i, (w, _) in enumerate(head[:known]) if w == END), 0)
    encoded = keep(_encoded(src, head, known, modulus, held), "encoded")
    model = train(encoded.filter("NOT held_out"), np.append(rest, own), end, shards_of(n_all)) if n_all else Model(np.zeros(1))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for rows, ids, real, length in _stretches(b, end, BLOCK):
                out[rows.start : rows.stop] = np.add.reduceat(m.score(ids, real).astype(float), np.cumsum(length) - length)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(out / np.log(10))], names=[*b.schema.names[:-1], "model"])

    cols = ["rid", "id", "held_out", "n_tokens", "known", "base", "rest", "rest_log"]
    schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in cols) + ", model double"
    scored = encoded.select(*cols, "ids").mapInArrow(run, schema)
    tail = encoded.select("rid", F.explode("tail").alias("x")).select("rid", "x.w", "x.n").join(counts, "w")  # words never learnt add log10(1)
    tail = tail.groupBy("rid").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"))
    out = scored.join(tail, "rid", "left")
    add, zero = F.coalesce("tail_log", F.lit(0.0)), F.lit(0).cast("long")
    return out.select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(float(size_all))).alias("base_score"),
        (F.col("model") + F.col("rest_log") + add - F.col("rest") * F.lit(float(size_rest))).alias("score"),
    )
