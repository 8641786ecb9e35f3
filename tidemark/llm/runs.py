"""Periodic runs of words: Lyndon stacks under both orders propose them, hashed extensions measure them, words confirm them."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "array<struct<start:long,length:long,period:long>>"
_MOD, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
_NEAR = 8


class Words:
    """Word numbers of one text, with common prefixes and suffixes of any two places in logarithmic time.

    A few words are compared as they are; longer stretches by binary search over a polynomial hash modulo 2**61 - 1, whose
    sums are made when the first such question comes. The words at which a search ends are compared themselves.
    """

    def __init__(self, numbers: list[int]):
        self.w, self.n = numbers, len(numbers)
        self._sums: list[int] | None = None

    def _hashes(self) -> tuple[list[int], list[int]]:
        if self._sums is None:
            h, p, sums, powers = 0, 1, [0], [1]
            for x in self.w:
                h = (h * _BASE + x + 1) % _MOD
                p = p * _BASE % _MOD
                sums.append(h)
                powers.append(p)
            self._sums, self._powers = sums, powers
        return self._sums, self._powers

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        w, most = self.w, self.n - j
        for k in range(min(_NEAR, most)):
            if w[i + k] != w[j + k]:
                return k
        if most <= _NEAR:
            return most
        h, p = self._hashes()
        low, step = _NEAR, _NEAR
        while low + step <= most and (h[i + low + step] - h[i + low] * p[step] - h[j + low + step] + h[j + low] * p[step]) % _MOD == 0:
            low, step = low + step, 2 * step
        high = min(most, low + step)  # the answer is at least low; under low + step unless the text ends
        while low < high:
            mid = (low + high + 1) // 2
            d = mid - low
            if (h[i + mid] - h[i + low] * p[d] - h[j + mid] + h[j + low] * p[d]) % _MOD == 0:
                low = mid
            else:
                high = mid - 1
        while low < most and w[i + low] == w[j + low]:
            low += 1
        return low

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        w = self.w
        for k in range(min(_NEAR, i)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        if i <= _NEAR:
            return i
        h, p = self._hashes()
        low, high = _NEAR, i
        while low < high:
            mid = (low + high + 1) // 2
            if (h[i] - h[i - mid] * p[mid] - h[j] + h[j - mid] * p[mid]) % _MOD == 0:
                low = mid
            else:
                high = mid - 1
        while low < i and w[i - 1 - low] == w[j - 1 - low]:
            low += 1
        return low

    def lyndon(self, sign: int) -> list[int]:
        """The end of the longest Lyndon word that starts at each place, under the order of sign * number.

        Scanned from right to left; the words that factor the rest of the text lie on a stack (of which each place holds its
        end), and a word swallows those after it that are greater. A suffix is greater than its own beginnings in both orders.
        """
        w = self.w if sign > 0 else [-x for x in self.w]
        n, forward = self.n, self.forward
        end = [n] * n
        for i in range(n - 2, -1, -1):
            j, x = i + 1, w[i]
            while j < n:
                y = w[j]
                if x == y:
                    k = forward(i, j)
                    if j + k == n or w[i + k] > w[j + k]:
                        break
                elif x > y:
                    break
                j = end[j]
            end[i] = j
        return end


def find_runs(numbers: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, exponent * period) words, by start, then period.

    A run is a stretch of smallest period q that no neighbour extends. Each run of exponent 2 or more has a period that is
    the longest Lyndon word of its place under one of the two orders; where the exponent is 4 or more, one starts so early
    that two more periods follow it. All words of a run are compared before it is reported, so that a hash can't add one.
    exponent has to be at least 3.
    """
    if exponent < 3:
        raise ValueError("exponent under 3")
    n = len(numbers)
    if n < max(least, exponent):
        return []
    text, w, found = Words(numbers), np.array(numbers, dtype=np.int64), set()
    for sign in (1, -1):
        end = np.array(text.lyndon(sign), dtype=np.int64)
        at = np.arange(n)
        period = end - at
        ok = at + (exponent - 1) * period <= n
        at, period = at[ok], period[ok]
        for k in range(1, exponent - 1):
            ok = w[at] == w[at + k * period]
            at, period = at[ok], period[ok]
        upto: dict[int, int] = {}
        for i, q in zip(at.tolist(), period.tolist(), strict=True):
            if i + q <= upto.get(q, 0):
                continue
            e = i + q + text.forward(i, i + q)
            if e - i < (exponent - 1) * q:
                continue
            s = i - text.backward(i, i + q)
            upto[q] = e
            if e - s >= max(least, exponent * q):
                if not np.array_equal(w[s : e - q], w[s + q : e]):  # two stretches of one hash: word by word from the root
                    differ = np.flatnonzero(w[: n - q] != w[q:])
                    s = int(differ[differ < i].max(initial=-1)) + 1
                    e = int(differ[differ >= i].min(initial=n - q)) + q
                if e - s >= max(least, exponent * q):
                    found.add((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) > 0


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str | None = "collapsed", n_words: str | None = None, least: int = 6, exponent: int = 4) -> DataFrame:
    """docs with a column of runs and, if named, one of the text without the words that repeat a run's first period, joined by
    single spaces, and one of the number of words; columns of these names are replaced.

    Words are what ASCII white space parts. One pass without a shuffle, a text at a time, in memory proportional to the text
    (some 150 bytes a word) and time of n log n; each row stands alone, so repeated rows, ties and null ids need nothing, an
    empty table gives an empty result. A null, empty or blank text has no words, no runs and the empty text.
    """
    new = [(runs, RUN), (collapsed, "string"), (n_words, "long")]
    new = [(name, kind) for name, kind in new if name]
    names = {name for name, _ in new}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names or c == text])
    at = base.columns.index(text)
    carried = [k for k, c in enumerate(base.columns) if c not in names]
    schema = ", ".join([f"`{base.schema[k].name}` {base.schema[k].dataType.simpleString()}" for k in carried] + [f"`{name}` {kind}" for name, kind in new])
    labels = [base.columns[k] for k in carried] + [name for name, _ in new]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            out_runs, out_text, out_n = [], [], []
            for t in batch.column(at).to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").split()
                found = find_runs(list(map({}.setdefault, words, count())), least, exponent)
                out_runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                out_n.append(len(words))
                if collapsed:
                    gone = repeated(len(words), found).tolist() if found else []
                    out_text.append(b" ".join([x for x, g in zip(words, gone, strict=True) if not g] if found else words))
            made = {runs: pa.array(out_runs, kind), n_words: pa.array(out_n, pa.int64())}
            if collapsed:
                made[collapsed] = pa.array(out_text, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in carried] + [made[name] for name, _ in new], names=labels)

    return base.mapInArrow(run, schema)
