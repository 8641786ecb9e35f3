"""Suffix-array deduplication: repeated byte strings from merged Burrows-Wheeler transforms of shards.

To keep strings that can repeat together without a suffix array of the whole corpus, texts are cut by content. Of each
window of WIDTH bytes the least hash of its GRAM-byte substrings is its anchor; equal windows have equal anchors wherever
they stand, and consecutive windows mostly share one. The stretch of consecutive windows with one anchor is a region. Only
regions whose anchor occurs in two documents travel, and all regions of an anchor meet in one task. There each shard of
them is suffix-sorted, and the shards' transforms are merged by interleave refinement (see merge_shards).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, mix64, prefix_hash, range_hash

WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1  # windows that one substring can be the anchor of
CHUNK = 4 << 20
SHARD, BATCH = 1 << 18, 3 << 19
#: Bytes of text for each bucket, which a task holds at once.
BUCKET = 32 << 20
#: Entries of an anchor from which on its windows are dealt one by one, so that a very common passage is spread: over all
#: chunks, as far as they send them, and within one chunk, whose entries then stay off the way.
HOT, LOCAL = 1 << 14, 64


# ---- merging -------------------------------------------------------------------------------------------------------------


def shard_bwt(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the strings in text (symbols from 1, a 0 after each string) sorted to a depth of 56.

    Returns the position of each row, the symbol before it (0 at a string's start), and for each position its row.
    """
    n = len(text)
    pad = np.append(text.astype(np.int64), np.zeros(7, dtype=np.int64))
    key, alive = pad[:n].copy(), pad[:n] != 0
    for j in range(1, 7):
        s = pad[j : j + n]
        key = (key << 9) | np.where(alive, s, 0)
        alive &= s != 0
    step = 7
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        if step >= 56:
            break
        ahead = np.zeros(n, dtype=np.int64)
        if n > step:
            ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + np.where(alive, ahead, 0)
        more = np.zeros(n, dtype=bool)
        if n > step:
            more[: n - step] = alive[step:]
        alive &= more
        step *= 2
    row = np.empty(n, dtype=np.int64)
    row[order] = np.arange(n)
    before = np.append(0, text[:-1]).astype(np.uint16)[order]
    return order, before, row


def merge_shards(shards: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated intervals of the merged transform of several shards (as for shard_bwt).

    Returns (shard, position, interval) of each window of `width` symbols that occurs more than once over all shards,
    as arrays ordered by interval; windows of one interval are equal.

    The interleave starts as shard after shard, each in the order of its own transform. One refinement puts each row's
    predecessor in the order of the symbol before the row, ties as they stood: after k of them rows are in the order of
    their first k symbols, and neighbours between which no border has arisen have a common prefix of k. No suffix is
    compared or sorted again. A row whose interval has shrunk to itself can be dropped, and so can one from which no
    window begins `width - k` symbols earlier; rows near the end of a string are never reached.
    """
    owner, place, prior, back, active = [], [], [], [], []
    base = 0
    for i, text in enumerate(shards):
        pos, before, row = shard_bwt(text)
        first = np.flatnonzero(np.append(True, text[:-1] == 0))
        length = np.diff(np.append(first, len(text)))
        offset = np.arange(len(text)) - np.repeat(first, length)
        owner.append(np.full(len(text), i, dtype=np.int32))
        place.append(pos)
        prior.append(before)
        back.append(np.where(offset[pos] > 0, row[np.maximum(pos - 1, 0)], 0) + base)
        active.append(base + np.flatnonzero(offset[pos] >= width))
        base += len(text)
    prior, back = np.concatenate(prior), np.concatenate(back).astype(np.int32)
    rows = np.concatenate(active).astype(np.int32)
    block = np.zeros(len(rows), dtype=np.int32)
    for k in range(1, width + 1):
        symbol = prior[rows]
        order = np.argsort(symbol, kind="stable")
        symbol, block = symbol[order], block[order]
        border = np.empty(len(rows), dtype=bool)
        border[:1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=border[1:])
        border[1:] |= block[1:] != block[:-1]
        rows = back[rows[order]]
        block = np.cumsum(border, dtype=np.int32)
        if k % 5 == 0 or k == width:
            alone = border & np.append(border[1:], True)
            if alone.any():
                rows, block = rows[~alone], block[~alone]
        if not len(rows):
            break
    return np.concatenate(owner)[rows], np.concatenate(place)[rows], block


def least_owner(pool: np.ndarray, first: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window of each string (pool[first : first + length]), the least owner of a string that holds it."""
    count = length - WIDTH + 1
    begin = np.cumsum(count) - count
    out = np.repeat(owner, count)
    at, lo = np.append(np.cumsum(length), 0), 0
    shards, spans = [], []
    while lo < len(first):
        hi = lo + 1
        while hi < len(first) and at[hi] - at[lo] < SHARD:
            hi += 1
        size = length[lo:hi] + 1
        start = np.cumsum(size) - size
        text = np.zeros(int(size.sum()), dtype=np.uint16)
        src = np.repeat(first[lo:hi] - (np.cumsum(length[lo:hi]) - length[lo:hi]), length[lo:hi]) + np.arange(length[lo:hi].sum())
        dst = np.repeat(start - (np.cumsum(length[lo:hi]) - length[lo:hi]), length[lo:hi]) + np.arange(length[lo:hi].sum())
        text[dst] = pool[src].astype(np.uint16) + 1
        shards.append(text)
        spans.append((lo, start))
        lo = hi
    shard, pos, block = merge_shards(shards)
    if len(block):
        cell = np.empty(len(pos), dtype=np.int64)
        for i, (lo, start) in enumerate(spans):
            own = np.flatnonzero(shard == i)
            s = np.searchsorted(start, pos[own], side="right") - 1
            cell[own] = begin[lo + s] + pos[own] - start[s]
        head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        least = np.minimum.reduceat(out[cell], head)
        out[cell] = np.repeat(least, np.diff(np.append(head, len(block))))
    return out


# ---- anchors -------------------------------------------------------------------------------------------------------------


def anchors(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions of texts that stand one after another in raw: text, first window in it, number of windows, anchor.

    A run of windows with one anchor may be cut anywhere, since all windows of an anchor meet; it is cut to SPAN.
    """
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(raw) - GRAM + 1)
    low = range_hash(prefix_hash(raw), at, at + GRAM)
    reach = 1
    while reach * 2 <= SPAN:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:n], low[SPAN - reach : SPAN - reach + n])
    whole = np.flatnonzero(doc[:n] == doc[WIDTH - 1 :])
    value, owner = low[whole], doc[whole]
    cut = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))) if len(whole) else whole
    count = np.diff(np.append(cut, len(whole)))
    parts = -(-count // SPAN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(cut, parts) + nth * SPAN
    windows = np.minimum(np.repeat(count, parts) - nth * SPAN, SPAN)
    begin = np.cumsum(size) - size
    return owner[first], whole[first] - begin[owner[first]], windows, value[first]


def _groups(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


_OUT = "bucket int, ids binary, keys binary, counts binary, a binary, lo binary, hi binary, w binary, pool binary"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_KINDS = [pa.int32()] + [pa.binary()] * 8


def _rows(bucket: np.ndarray, ids, keys, doc, a, pos, w, pool=None, first=None, length=None):
    """One row for each bucket, entries packed by text: low and high halves of numbers apart, which compresses well."""
    order = np.lexsort((pos, doc, bucket))
    bucket, doc, a, pos, w = bucket[order], doc[order], a[order], pos[order], w[order]
    head = np.flatnonzero(_groups(bucket)) if len(bucket) else []
    cols: list[list] = [[] for _ in _NAMES]
    for s, e in zip(head, np.append(head[1:], len(bucket)), strict=True):
        d = doc[s:e]
        new = np.flatnonzero(_groups(d))
        blob = b""
        if pool is not None:
            n = length[order[s:e]]
            src = np.repeat(first[order[s:e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            blob = zstandard.compress(pool[src].tobytes(), 1)
        p = pos[s:e]
        for c, v in zip(cols, (int(bucket[s]), ids[d[new]].tobytes(), keys[d[new]].tobytes(), np.diff(np.append(new, e - s)).astype(np.uint32).tobytes(), a[s:e].astype(np.uint32).tobytes(), (p & 0xFFFF).astype(np.uint16).tobytes(), (p >> 16).astype(np.uint16).tobytes(), w[s:e].tobytes(), blob), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _unpack(rows: list[dict], wide) -> tuple[np.ndarray, ...]:
    cat = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), dtype=kind)
    counts = cat("counts", np.uint32)
    pos = cat("lo", np.uint16).astype(np.int64) | (cat("hi", np.uint16).astype(np.int64) << 16)
    return np.repeat(cat("ids", np.int64), counts), np.repeat(cat("keys", np.int64), counts), cat("a", np.uint32), pos, cat("w", wide)


#: Texts (kind 0: counts are lengths, pool their bytes) and entries on their way back to them (kind 1), packed by hash of the id.
_PACKED = "bucket int, kind int, ids binary, keys binary, counts binary, a binary, pos binary, w binary, pool binary"
_PACKED_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), *[pa.binary()] * 7], strict=True)], names=_PACKED_NAMES)


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _answers(ids, keys, a, pos, w, n: int) -> pa.RecordBatch:
    """One row for each home of the texts: their entries."""
    home = _home(ids, n)
    order = np.lexsort((pos, keys, ids, home))
    ids, keys, a, pos, w, home = ids[order], keys[order], a[order], pos[order], w[order], home[order]
    rows = []
    head = np.flatnonzero(_groups(home)) if len(home) else []
    for s, e in zip(head, np.append(head[1:], len(home)), strict=True):
        new = np.flatnonzero(_groups(ids[s:e], keys[s:e]))
        rows.append((int(home[s]), 1, ids[s:e][new].tobytes(), keys[s:e][new].tobytes(), np.diff(np.append(new, e - s)).astype(np.uint32).tobytes(), a[s:e].astype(np.uint32).tobytes(), pos[s:e].astype(np.uint32).tobytes(), w[s:e].tobytes(), b""))
    return _packed(rows)


def _packed_texts(texts: DataFrame, n: int, seen=None) -> DataFrame:
    """Texts (id, key, text) packed by home; of ids that aren't in the bitmap `seen`, none."""

    def run(batches):
        for b in batches:
            all_ids, all_keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, own in _chunks(b, 2):
                ids, keys = all_ids[at], all_keys[at]
                home, rows = _home(ids, n), []
                for h in np.unique(home):
                    pick = np.flatnonzero(home == h)
                    if seen is not None:
                        pick = pick[seen.value[mix64(ids[pick].view(np.uint64)) % np.uint64(len(seen.value))]]
                    if len(pick):
                        pool = b"".join(own[i] for i in pick)
                        rows.append((int(h), 0, ids[pick].tobytes(), keys[pick].tobytes(), np.array([len(own[i]) for i in pick], dtype=np.uint32).tobytes(), b"", b"", b"", zstandard.compress(pool, 1)))
                if rows:
                    yield _packed(rows)

    return texts.mapInArrow(run, _PACKED)


def _meeting(rows: list[dict], wide):
    """Texts of one home and their entries, in chunks: ids, keys, bytes, and per entry the text's number, a, pos and w.

    Texts without entries are left out; an equal text of the same id comes once; entries of one place come once.
    """
    notes = [r for r in rows if r["kind"] == 1]
    if not notes:
        return
    cat = lambda name, kind: np.frombuffer(b"".join(r[name] for r in notes), dtype=kind)
    counts = cat("counts", np.uint32)
    eid, ekey = np.repeat(cat("ids", np.int64), counts), np.repeat(cat("keys", np.int64), counts)
    a, pos, w = cat("a", np.uint32), cat("pos", np.uint32).astype(np.int64), cat("w", wide)
    order = np.lexsort((pos, ekey, eid))
    order = order[_groups(eid[order], ekey[order], pos[order])]
    eid, ekey, a, pos, w = eid[order], ekey[order], a[order], pos[order], w[order]
    head = np.flatnonzero(_groups(eid, ekey))
    stop = np.append(head[1:], len(eid))
    place = {(i, k): x for x, (i, k) in enumerate(zip(eid[head].tolist(), ekey[head].tolist(), strict=True))}
    part, size = [], 0

    def chunk():
        spans = [np.arange(head[x], stop[x]) for x, _ in part]
        at = np.concatenate(spans)
        return eid[head[[x for x, _ in part]]], ekey[head[[x for x, _ in part]]], [t for _, t in part], np.repeat(np.arange(len(part)), [len(x) for x in spans]), a[at], pos[at], w[at]

    for r in rows:
        if r["kind"] == 0:
            pool, lo = zstandard.decompress(r["pool"]), 0
            for i, k, n in zip(np.frombuffer(r["ids"], dtype=np.int64).tolist(), np.frombuffer(r["keys"], dtype=np.int64).tolist(), np.frombuffer(r["counts"], dtype=np.uint32).tolist(), strict=True):
                x = place.pop((i, k), None)
                if x is not None:
                    part.append((x, pool[lo : lo + n]))
                    size += n
                lo += n
                if size >= CHUNK:
                    yield chunk()
                    part, size = [], 0
    if part:
        yield chunk()


def _by_bucket(batches):
    """Rows of one bucket at a time, of partitions sorted by bucket."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != at:
                if rows:
                    yield rows
                at, rows = r["bucket"], []
            rows.append(r)
    if rows:
        yield rows


def _chunks(batch, text: int):
    """Parts of a batch of about CHUNK bytes of text: (indices, bytes of each)."""
    own = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()]
    lo = 0
    while lo < len(own):
        hi, size = lo, 0
        while hi < len(own) and (hi == lo or size < CHUNK):
            size += len(own[hi])
            hi += 1
        yield np.arange(lo, hi), own[lo:hi]
        lo = hi


def _repeated_anchors(texts: DataFrame, n: int) -> DataFrame:
    """(id, key, text) to the regions of each text whose anchor stands in another document too, as entries of _PACKED.

    An anchor of LOCAL entries in one chunk, of several documents, is known to repeat and to be common: two of its entries
    go and say so, the others are answered at once. The top bit of w marks entries of a common anchor.
    """

    def send(batches):
        for b in batches:
            all_ids, all_keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, own in _chunks(b, 2):
                ids, keys = all_ids[at], all_keys[at]
                doc, pos, windows, value = anchors(np.frombuffer(b"".join(own), dtype=np.uint8), np.array([len(x) for x in own]))
                if not len(doc):
                    continue
                bucket, a, w = ((value >> np.uint64(32)) % np.uint64(n)).astype(np.int32), (value & np.uint64(0xFFFFFFFF)).astype(np.uint32), windows.astype(np.uint8)
                order = np.lexsort((ids[doc], value))
                head = np.flatnonzero(_groups(value[order]))
                last = np.append(head[1:], len(order)) - 1
                count = last - head + 1
                known = np.zeros(len(order), dtype=bool)
                known[order] = np.repeat((ids[doc[order[head]]] != ids[doc[order[last]]]) & (count >= LOCAL), count)
                w = w | (known.astype(np.uint8) << 7)
                ends = np.zeros(len(order), dtype=bool)
                ends[order[head]] = ends[order[last]] = True
                go = ~known | ends
                yield _rows(bucket[go], ids, keys, doc[go], a[go], pos[go], w[go])
                stay = ~go
                if stay.any():
                    yield _rows((mix64(ids[doc[stay]].view(np.uint64)) % np.uint64(n)).astype(np.int32) - n, ids, keys, doc[stay], a[stay], pos[stay], w[stay])

    def meet(batches):
        for rows in _by_bucket(batches):
            ids, keys, a, pos, w = _unpack(rows, np.uint8)
            if rows[0]["bucket"] >= 0:
                order = np.argsort(a, kind="stable")
                head = np.flatnonzero(_groups(a[order]))
                count = np.diff(np.append(head, len(order)))
                own = ids[order]
                several = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
                hot = np.repeat((count > HOT) | (np.maximum.reduceat(w[order], head) > 127), count)
                pick = np.repeat(several, count)
                order, hot = order[pick], hot[pick]
                ids, keys, a, pos, w = ids[order], keys[order], a[order], pos[order], (w[order] & 127) | (hot.astype(np.uint8) << 7)
            if len(ids):
                yield _answers(ids, keys, a, pos, w, n)

    sent = _dealt(texts.mapInArrow(send, _OUT), n)
    return sent.mapInArrow(meet, _PACKED)


def _dealt(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.repartition(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket", *order)


def _removed_windows(packed: DataFrame, n: int) -> DataFrame:
    """Texts and entries of _PACKED to entries whose w is a mask: which windows from pos on stand in a smaller document.

    Of equal regions in one chunk only those of the smallest document travel: the others are answered at once.
    """

    def send(batches):
        for rows in _by_bucket(batches):
            for ids, keys, own, doc, a, pos, w in _meeting(rows, np.uint8):
                raw = np.frombuffer(b"".join(own), dtype=np.uint8)
                size = np.array([len(x) for x in own])
                begin = (np.cumsum(size) - size)[doc] + pos
                hot, w = w >> 7 == 1, (w & 127).astype(np.int64)
                h = prefix_hash(raw)
                if hot.any():  # a region of one window each, dealt by the window itself
                    times = np.where(hot, w, 1)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    doc, a, pos, begin, w, hot = (np.repeat(x, times) for x in (doc, a, pos, begin, w, hot))
                    pos, begin, w = pos + nth, begin + nth, np.where(hot, 1, w)
                    own_hash = range_hash(h, begin, begin + WIDTH)
                    a = np.where(hot, (own_hash & np.uint64(0xFFFFFFFF)).astype(np.uint32), a)
                region = range_hash(h, begin, begin + w + WIDTH - 1)
                order = np.lexsort((ids[doc], region, a))
                head = np.flatnonzero(_groups(a[order], region[order]))
                least = np.empty(len(order), dtype=np.int64)
                least[order] = np.repeat(ids[doc[order[head]]], np.diff(np.append(head, len(order))))
                go = ids[doc] == least
                mask = ((np.uint64(1) << w.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
                bucket = (mix64(a.astype(np.uint64)) % np.uint64(n)).astype(np.int32)
                yield _rows(bucket[go], ids, keys, doc[go], a[go], pos[go], w[go].astype(np.uint32), raw, begin[go], (w + WIDTH - 1)[go])
                stay = ~go
                if stay.any():
                    yield _rows((mix64(ids[doc[stay]].view(np.uint64)) % np.uint64(n)).astype(np.int32) - n, ids, keys, doc[stay], a[stay], pos[stay], mask[stay])

    def meet(batches):
        for rows in _by_bucket(batches):
            ids, keys, a, pos, w = _unpack(rows, np.uint32)
            if rows[0]["bucket"] >= 0:
                pool = np.frombuffer(b"".join(zstandard.decompress(r["pool"]) for r in rows), dtype=np.uint8)
                w = _masks(pool, w.astype(np.int64), a, ids)
                ok = w > 0
                ids, keys, a, pos, w = ids[ok], keys[ok], a[ok], pos[ok], w[ok]
            if len(ids):
                yield _answers(ids, keys, a, pos, w, n)

    sent = _dealt(_dealt(packed, n, "kind").mapInArrow(send, _OUT), n)
    return sent.mapInArrow(meet, _PACKED)


def _masks(pool: np.ndarray, windows: np.ndarray, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each region (one after another in pool), a bit for each window that stands in a region of a smaller document."""
    length = windows + WIDTH - 1
    first = np.cumsum(length) - length
    region = np.empty(len(a), dtype=np.uint64)
    for s in range(0, len(a), 1 << 16):  # hashes in pieces, so that memory is bounded
        e = min(len(a), s + (1 << 16))
        h = prefix_hash(pool[first[s] : first[e - 1] + length[e - 1]])
        region[s:e] = range_hash(h, first[s:e] - first[s], first[s:e] - first[s] + length[s:e])
    order = np.lexsort((ids, region, a))
    new = _groups(a[order], region[order])
    head = np.flatnonzero(new)
    kind = np.empty(len(a), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    rep = order[head]  # of equal regions the one of the smallest document stands for all
    least_begin = np.cumsum(windows[rep]) - windows[rep]
    least = np.repeat(ids[rep], windows[rep])
    group = np.flatnonzero(_groups(a[rep]))
    end = np.append(group[1:], len(rep))
    mixed = np.flatnonzero(end - group > 1)
    i = 0
    while i < len(mixed):  # anchors with several regions, whole, in batches
        j, size, own = i, 0, []
        while j < len(mixed) and (j == i or size < BATCH):
            r = rep[group[mixed[j]] : end[mixed[j]]]
            size += int(length[r].sum())
            own.append(np.arange(group[mixed[j]], end[mixed[j]]))
            j += 1
        own = np.concatenate(own)
        r = rep[own]
        got = least_owner(pool, first[r], length[r], ids[r])
        n = windows[r]
        least[np.repeat(least_begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = got
        i = j
    total = np.repeat(np.arange(len(a)), windows)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    smaller = least[least_begin[kind[total]] + nth] < ids[total]
    return np.add.reduceat(smaller.astype(np.uint64) << nth.astype(np.uint64), np.cumsum(windows) - windows).astype(np.uint32) if len(a) else np.zeros(0, dtype=np.uint32)


def cut(text: bytes, starts: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal spans covered by windows from the sorted starts, and the rest of the text."""
    gap = np.flatnonzero(starts[1:] > starts[:-1] + WIDTH)
    begin, end = starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + WIDTH
    spans = list(zip(begin.tolist(), end.tolist(), strict=True))
    at, rest = 0, []
    for s, e in spans:
        rest.append(text[at:s])
        at = e
    return spans, b"".join([*rest, text[at:]])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, spans, kept) of each text that loses bytes; key is xxhash64 of the text.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id, judged on the input;
    matches never cross documents. spans are the maximal runs of such bytes, kept is what is left, as bytes.

    A null text or one of under 50 bytes loses nothing, and so does a row with a null id, which takes no part. Rows with
    one id are one document: they don't remove from each other, and equal ones share a row here. An empty table gives an
    empty result. Texts may be of any length; columns but the two named aren't looked at. Groups of copies cost a region a
    chunk; the windows of an anchor in over HOT entries are dealt singly. There are as many buckets as BUCKET asks for.
    """
    spark = docs.sparkSession
    src = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text) >= WIDTH)).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // BUCKET))
    masks = keep(_removed_windows(_packed_texts(src, n).unionByName(_repeated_anchors(src, n)), n), "removed-windows")
    bits = min(1 << 27, max(1 << 20, 1 << (8 * size["n"]).bit_length()))
    seen = spark.sparkContext.broadcast(_seen(masks, bits))  # at most 16 MB; it only spares moving other texts

    def finish(batches):
        for rows in _by_bucket(batches):
            for ids, keys, own, doc, _, pos, mask in _meeting(rows, np.uint32):
                out = []
                head = np.flatnonzero(_groups(doc))
                for t, s, e in zip(own, head, np.append(head[1:], len(doc)), strict=True):
                    starts = np.unique(np.concatenate([pos[s:e][(mask[s:e] >> np.uint32(j)) & 1 == 1] + j for j in range(SPAN)]))
                    out.append(cut(t, starts))
                spans = pa.array([[{"start": s, "end": e} for s, e in x[0]] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), spans, pa.array([x[1] for x in out], pa.binary())], names=["id", "key", "spans", "kept"])

    return _dealt(_packed_texts(src, n, seen).unionByName(masks), n, "kind").mapInArrow(finish, "id long, key long, spans array<struct<start:int,end:int>>, kept binary")


def _seen(packed: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over hashes of the ids of all entries."""

    def run(batches):
        out = np.zeros(bits, dtype=bool)
        for b in batches:
            for x in b[0].to_pylist():
                out[mix64(np.frombuffer(x, dtype=np.uint64)) % np.uint64(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    for r in packed.select("ids").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], dtype=np.uint8)
    return np.unpackbits(total).astype(bool)
