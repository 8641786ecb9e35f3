"""Toxicity: a support vector machine over a gapped subsequence kernel with Nyström landmarks, trained on labelled texts.

The kernel compares windows of one or two neighbouring words. It counts the runs of four signs that both windows hold in order (a
word's start and end are signs, too), gaps allowed up to a span of SPAN, each weighed DECAY to its span, over the root of
what the windows' lengths alone would give. A gapped or padded insult ("stxupid", "s.t.u.p.i.d", "s t u p i d") keeps most
of its runs, and so does an insult of two words. Words of over PIECE letters count as several.

Labels belong to whole texts, of which one window may be to blame. So the machine learns from texts as bags of windows: a
toxic text is held to its worst window, a clean one to its three worst, and the choice is renewed round by round. The
kernel has an explicit table of runs, hashed to 2**20 codes, so that the machine's weights over its landmarks fold into one
table of 4 MB, and scoring is one vectorised pass over bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep

SPAN, DECAY, PIECE = 6, 0.6, 24
#: What a window of two words has to be above one of a single word, so that an insult of one word is learnt as such.
PAIR = 0.2
#: Landmarks of the machine, rounds in which windows are chosen anew, and how dear the errors of each class are, all in all.
LANDMARKS, ROUNDS, COST = 320, 3, 600.0
#: Labelled texts of each class that the machine is fitted on, at most; the only bound.
PER_CLASS = 3000
#: Digits and signs read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
CODES = 1 << 20
_DROP, _START, _END = 255, 0, 63


def _classes() -> np.ndarray:
    out = np.full(256, _DROP, dtype=np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    for k, v in LEET.items():
        out[ord(k)] = ord(v) - 96
    out[128:192] = 27 + np.arange(64) % 36  # the last bytes of a letter beyond ASCII; its first goes
    out[[32, 9, 10, 11, 12, 13]] = _START
    return out


CLASSES = _classes()
_EACH, _LESS = sum(DECAY ** (2 * c) for _, _, c in _GAPS), sum(c * DECAY ** (2 * c) for _, _, c in _GAPS)
_SHORT = np.array([sum(max(0, n - c) * DECAY ** (2 * c) for _, _, c in _GAPS) for n in range(SPAN)])


def norm(n: np.ndarray) -> np.ndarray:
    """Root of what the weights of the runs of n signs sum to if each stands once."""
    n = np.asarray(n)
    return np.sqrt(np.maximum(np.where(n < SPAN, _SHORT[np.minimum(n, SPAN - 1)], _EACH * n - _LESS), 1e-9)).astype(np.float32)


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each word between its signs, and the place where each text begins.

    Signs within a word go; single letters in a row make one word.
    """
    raw = CLASSES[np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    mark = np.zeros(len(raw), dtype=bool)
    begins = np.cumsum(np.append(0, lengths[:-1])) if len(texts) else np.zeros(0, dtype=np.int64)
    mark[begins] = True
    stay = (raw != _DROP) & ~((raw == _START) & ~mark & np.append(False, raw[:-1] == _START))
    sym, mark = raw[stay], mark[stay]
    sep = sym == _START
    if len(sym) > 4:  # a start sign between two single letters goes
        one = np.zeros(len(sym), dtype=bool)
        one[1:-1] = sep[:-2] & ~sep[1:-1] & sep[2:]
        glue = np.zeros(len(sym), dtype=bool)
        glue[2:-1] = sep[2:-1] & one[1:-2] & one[3:]
        glue &= ~mark
        sym, mark = sym[~glue], mark[~glue]
    sep = np.flatnonzero(sym == _START)
    begins = np.flatnonzero(mark)
    return np.insert(sym, sep[1:], _END), begins + np.searchsorted(sep, begins)


def _codes(s: np.ndarray, at, a: int, b: int, c: int) -> np.ndarray:
    run = (s[at] << np.uint32(18)) | (s[at + a] << np.uint32(12)) | (s[at + b] << np.uint32(6)) | s[at + c]
    return (run * np.uint32(2654435761)) >> np.uint32(12)


def units(sym: np.ndarray) -> np.ndarray:
    """Where units begin: words, and pieces of PIECE signs of longer ones."""
    at = np.flatnonzero(sym == _START)
    length = np.diff(np.append(at, len(sym)))
    parts = np.maximum(1, length // PIECE)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(at, parts) + nth * PIECE


def unit_sums(sym: np.ndarray, starts: np.ndarray, table: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a table by code, or by rows[code], over the runs within each unit, and over those from each unit into the next."""
    unit = np.zeros(len(sym), dtype=np.int32)
    unit[starts[1:]] = 1
    unit = np.cumsum(unit, dtype=np.int32)
    s = sym.astype(np.uint32)
    shape = (len(sym),) + table.shape[1:]
    own, over = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32)
    for a, b, c in _GAPS:
        n = len(sym) - c
        if n <= 0:
            continue
        step = unit[c:] - unit[:n]
        for total, which in ((own, step == 0), (over, step == 1)):
            at = np.flatnonzero(which)
            key = _codes(s, at, a, b, c)
            if rows is not None:
                key = rows[key]
                at, key = at[key > 0], key[key > 0]
            total[at] += table[key] * np.float32(DECAY**c)
    return (np.add.reduceat(own, starts, axis=0), np.add.reduceat(over, starts, axis=0)) if len(starts) else (own[:0], over[:0])


def windows(sym: np.ndarray, begins: np.ndarray, table: np.ndarray):
    """Kernel values against a table of all windows, of one unit and of it with the next of its text: (values, units, first unit of each text)."""
    starts = units(sym)
    own, over = unit_sums(sym, starts, table)
    size = np.diff(np.append(starts, len(sym)))
    first = np.searchsorted(starts, begins)
    one = own / norm(size)
    two = np.full(len(one), -np.inf, dtype=np.float32)
    if len(one) > 1:
        two[:-1] = (own[:-1] + own[1:] + over[:-1]) / norm(size[:-1] + size[1:])
    two[np.append(first[1:], len(one)) - 1] = -np.inf
    return np.stack([one, two]), starts, first


class Landmarks:
    """Kernel features of a few windows: the codes that they hold, a row each, and a column a window; row 0 is empty."""

    def __init__(self, texts: list[bytes]):
        parts = []
        for j, t in enumerate(texts):
            sym, _ = symbols([t])
            s = sym[: len(sym) - 1].astype(np.uint32)  # without the sign that closes the text
            for a, b, c in _GAPS:
                if (n := len(s) - c) > 0:
                    parts.append((_codes(s, np.arange(n), a, b, c).astype(np.int64), np.full(n, j), np.full(n, DECAY**c / norm(len(s)))))
        code, col, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.codes, row = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes) + 1, len(texts)), dtype=np.float32)
        np.add.at(self.table, (row + 1, col), value)
        self.rows = np.zeros(CODES, dtype=np.int32)
        self.rows[self.codes] = np.arange(1, len(self.codes) + 1)

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """One row a window, one column a landmark."""
        out = [np.zeros((0, self.table.shape[1]))]
        for i in range(0, len(texts), 200):
            sym, begins = symbols(texts[i : i + 200])
            sym = sym[:-1]
            starts = units(sym)
            own, over = unit_sums(sym, starts, self.table, self.rows)
            first = np.searchsorted(starts, begins)
            over[np.append(first[1:], len(starts)) - 1] = 0
            out.append(np.add.reduceat(own + over, first, axis=0) / norm(np.diff(np.append(begins, len(sym))))[:, None])
        return np.vstack(out)

    def folded(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(CODES, dtype=np.float32)
        out[self.codes] = self.table[1:] @ weights
        return out


class Machine:
    """A table of values by code, an offset and the sigmoid's two numbers."""

    def __init__(self, table: np.ndarray, offset: float, slope: float = 4.0, shift: float = 0.0):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift

    def parts(self, texts: list[bytes]):
        """Texts in parts of about 1 MB, which bounds the memory: (first text, signs, window margins, units, first unit of each text)."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size == 0 or size + len(texts[upto]) < 1 << 20):
                size += len(texts[upto])
                upto += 1
            sym, begins = symbols(texts[at:upto])
            sym = sym[:-1]  # the sign that closes the last text
            value, starts, first = windows(sym, begins, self.table)
            yield at, sym, value - self.offset - np.array([[0.0], [PAIR]]), starts, first
            at = upto

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Largest margin of the windows of each text, -3 at least; a text without words has that."""
        out = np.full(len(texts), -3.0)
        for at, _, value, _, first in self.parts(texts):
            out[at : at + len(first)] = np.maximum(np.maximum.reduceat(value.max(axis=0), first), -3.0)
        return out

    def worst(self, texts: list[bytes], k: int) -> list[list[bytes]]:
        """The k windows of the largest margins of each text, in the kernel's own letters."""
        out = []
        for _, sym, value, starts, first in self.parts(texts):
            letters, ends, last = _LETTERS[sym].tobytes(), np.append(starts[1:], len(sym)), np.append(first[1:], len(starts))
            for f, e in zip(first, last, strict=True):
                best = np.argsort(-value[:, f:e], axis=None, kind="stable")[:k]
                kind, unit = np.unravel_index(best, (2, e - f))
                own = [letters[starts[f + u] : ends[min(f + u + j, len(ends) - 1)]] for j, u in zip(kind, unit, strict=True) if np.isfinite(value[j, f + u])]
                out.append([b" ".join(w.split()) for w in own])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by accelerated full-batch gradient steps; deterministic."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    step = 1.0 / (1.0 + 2 * c * np.linalg.eigvalsh((xb * weight[:, None]).T @ xb)[-1])
    w = v = np.zeros(xb.shape[1])
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ v))
        g = np.append(v[:-1], 0) - 2 * c * xb.T @ (weight * y * slack)
        nxt = v - step * g
        v = nxt + i / (i + 3) * (nxt - w)
        w = nxt
    return w[:-1], float(w[-1])


_LETTERS = np.frombuffer(b" " + bytes(range(97, 123)) + bytes(range(128, 164)) + b" ", dtype=np.uint8)  # a byte for each sign
_BACK = bytes(next((b for b in range(128, 192) if CLASSES[b] == i - 128 + 27), 32) if i >= 128 else i for i in range(256))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _distinct(text: str | None) -> set[bytes]:
    """Distinct windows of a text, in the kernel's own letters."""
    sym, _ = symbols([_raw(text)])
    sym = sym[:-1]
    starts = units(sym)
    letters, ends = _LETTERS[sym].tobytes(), np.append(starts[1:], len(sym))
    one = {b" ".join(letters[s:e].split()) for s, e in zip(starts, ends, strict=True)}
    two = {b" ".join(letters[s:e].split()) for s, e in zip(starts, ends[1:], strict=False)}
    return {w for w in one | two if len(w) > 1}


def fit(labelled: DataFrame, toxic_rate: float = 0.5, landmarks: int = LANDMARKS) -> Machine:
    """A machine from a table (text, toxic), a bounded sample (see fit_sample).

    Landmarks are windows of the texts: four fifths those that tell toxic texts from others best, by the difference of their
    shares over its standard error, the rest the most frequent ones of other texts. The first machine learns from the landmark that
    tells each toxic text best and from the frequent ones, each of ROUNDS further ones from the windows that the last one finds worst: one of each toxic text, three of each
    other text, these added up over the rounds. The sigmoid is fitted on the sample's texts and moved from its share of
    toxic ones to toxic_rate.
    """

    def explode(batches):
        for b in batches:
            y, u = [], []
            for t, z in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                own = [x.decode("latin-1") for x in _distinct(t)]
                y += [z] * len(own)
                u += own
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(y, pa.int32())], names=["unit", "y"])

    n_toxic, n_all = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:  # nothing to tell apart: every text scores alike, near the rate of toxic ones
        return Machine(np.zeros(CODES, dtype=np.float32), 0.0, 0.0, -3.0)
    counted = labelled.select("text", "toxic").mapInArrow(explode, "unit string, y int").groupBy("unit").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    counted = keep(counted, "toxic-windows")
    apart = (F.col("p") / n_toxic - F.col("n") / n_clean) / F.sqrt((F.col("p") + F.col("n")) / n_all * (1 / n_toxic + 1 / n_clean))
    bad = {r["unit"]: i for i, r in enumerate(counted.orderBy(F.desc(apart), F.col("unit").contains(" "), "unit").limit(landmarks * 4 // 5).collect())}
    fine = {r["unit"]: r["n"] for r in counted.filter("n > 0").orderBy(F.desc("n"), "unit").limit(landmarks // 5).collect() if r["unit"] not in bad}
    enc = lambda us: [u.encode("latin-1").translate(_BACK) for u in us]
    marks = Landmarks(enc([*bad, *fine]))
    gram = marks.kernel(enc([*bad, *fine]))
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])

    done: dict = {}

    def learn(pos: dict, neg: dict) -> Machine:
        new = [u for u in (*pos, *neg) if u not in done]
        done.update(zip(new, marks.kernel(enc(new)) @ root, strict=True))
        x = np.stack([done[u] for u in (*pos, *neg)])
        y = np.append(np.ones(len(pos)), -np.ones(len(neg)))
        dear = [np.sqrt(np.array(list(c.values()), dtype=float)) for c in (pos, neg)]
        w, b = _svm(x, y, np.concatenate([COST * d / d.sum() for d in dear]))
        return Machine(marks.folded(root @ w), -b)

    def first(batches):
        for b in batches:
            own = [min((w for w in (x.decode("latin-1") for x in _distinct(t)) if w in bad), key=bad.get, default=None) for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True) if y == 1]
            yield pa.RecordBatch.from_arrays([pa.array([w for w in own if w], pa.string())], names=["unit"])

    told = {r["unit"]: r["count"] for r in labelled.select("text", "toxic").mapInArrow(first, "unit string").groupBy("unit").count().orderBy("unit").collect()}  # landmarks
    machine, clean = learn(told, fine), dict(fine)
    for _ in range(ROUNDS):
        pos, neg = _worst(labelled, machine)
        for u, n in neg.items():
            clean[u] = max(n, clean.get(u, 0))
        machine = learn(pos, clean)
    sample = _margins(labelled, machine)
    m, y = sample[:, 0], sample[:, 1]
    a, b = 4.0, 0.0
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, hi, lo)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, w = p - target, p * (1 - p) + 1e-6
        h = np.array([[np.sum(w * m * m) + 1e-3, np.sum(w * m)], [np.sum(w * m), np.sum(w) + 1e-3]])
        da, db = np.linalg.solve(h, [np.sum(r * m), np.sum(r)])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    odds = lambda x: np.log(x / (1 - x))
    machine.slope, machine.shift = float(np.clip(a, 0.5, 40)), float(b + odds(toxic_rate) - odds((y.sum() + 0.5) / (len(y) + 1)))
    return machine


def _worst(labelled: DataFrame, machine: Machine) -> tuple[dict[str, int], dict[str, int]]:
    """The windows that toxic and other texts are held to, with the number of texts."""
    sent = labelled.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            for label, k in ((1, 1), (0, 3)):
                own = [_raw(t) for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True) if y == label]
                u = [w.decode("latin-1") for ws in sent.value.worst(own, k) for w in ws if len(w) > 1]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array([label] * len(u), pa.int32())], names=["unit", "y"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "unit string, y int").groupBy("unit", "y").count().orderBy("unit").collect()  # at most three a text
    return ({r["unit"]: r["count"] for r in rows if r["y"] == k} for k in (1, 0))


def _margins(labelled: DataFrame, machine: Machine) -> np.ndarray:
    sent = labelled.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            m = sent.value.margins([_raw(t) for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.float64()), b["toxic"]], names=["m", "toxic"])

    return labelled.select("text", "toxic").mapInArrow(run, "m double, toxic int").toPandas().to_numpy(dtype=float).reshape(-1, 2)


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from: a null one counts for nothing, of several the highest holds."""
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", 4) != 2))
    return ok.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def rate(labels: DataFrame) -> float:
    """Share of toxic ones among all usable labels; 0.5 without any."""
    r = usable(labels).agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    return (r["p"] + 0.5) / (r["n"] + 1.0) if r["n"] else 0.5


def fit_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most per_class labelled texts of each class, by hash of the id, never one whose crc32 modulo 4 is 2.

    One text of several equal ones stays. This bounds the sample, in rows, and nothing else is bounded: all windows of the
    sample's texts are counted, and scores are given to all texts.
    """
    use = usable(labels)
    picks = [use.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
    sample = sample.groupBy("text", "toxic").agg(F.min("doc_id").alias("id"))
    return keep(sample, "toxic-sample")


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3, added: tuple = ("held_out", "score", "predicted")) -> DataFrame:
    """docs with held_out, score and predicted, or three other names; existing columns of those names are replaced.

    The score is the sigmoid of the largest margin of a window, over whole texts, however long. A null or empty text, or
    one without words, has the lowest margin. Rows stand alone: repeats, ties and null ids need nothing, other columns pass
    unchanged, and an empty table gives an empty result.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    at = base.columns.index(text)
    ids = base.columns.index(id_col)
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.offset, machine.slope, machine.shift))  # 4 MB
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(added, ("boolean", "double", "int"), strict=True))

    def run(batches):
        own = Machine(*shared.value)
        for b in batches:
            s = own.scores([(t or "").encode("utf-8", "replace") for t in b.column(at).to_pylist()])
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, *added])

    return base.mapInArrow(run, schema)
