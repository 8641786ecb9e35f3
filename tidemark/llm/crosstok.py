"""Two tokenizers over the same bytes: groups of tokens between common ends, links of overlapping tokens, counts of linked id pairs."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, keep

#: A space after a visible ASCII character, a letter or a digit, if something follows. No token of either tokenizer reaches over
#: such a place: A's pattern takes white space at the start of a match or alone, and no piece of B holds its space sign
#: after another character (checked when B is read).
_CUT = re.compile(r"(?<=[!-~\w]) (?!\Z)")
_END = re.compile(r"[!-~\w]\Z")
#: A space that is no cut, other than at either end of a text.
_ODD = re.compile(r"[^!-~\w] ")
_WIDE = np.int64(32)
#: A task keeps what it knows of a piece of text until it knows so many pieces or characters; then it starts anew.
PIECES, CHARACTERS = 1 << 19, 1 << 24
#: Characters of texts handled together, and of those that A's library encodes at once: it needs some 100 bytes for each.
LOT, ENCODED = 1 << 20, 1 << 17
#: Keys that a task holds before it sums them.
BUFFER = 1 << 21


class Pair:
    """Tokenizers A (a file of the tokenizers library, byte level) and B (a model of sentencepiece) and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte_of = {c: i for i, c in enumerate(_byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        width = len(str(max(len(pieces), len(self.a_bytes)))) + 1
        # decimal numbers with the sign that follows: the next token of the group, the other side, the next group, nothing
        self.names = np.array([f"{i}{s}" for s in (",", "|", ";", "") for i in range(max(len(pieces), len(self.a_bytes)))], dtype=f"S{width}")
        self.name_len = np.char.str_len(self.names)

    def split(self, text: str) -> list[str]:
        """The text in pieces, each encoded on its own behind a space; both tokenizers give the pieces' tokens for the whole."""
        if not self.cuts:
            return [text]
        plain = text and text[0] != " " and text[-1] != " " and not _ODD.search(text)
        return text.split(" ") if plain else _CUT.split(text)  # where all spaces are cuts both are the same, and the plain one is faster

    def encode(self, pieces: list[str]):
        """Flat ids of A and B with the pieces' offsets, and which pieces both give back byte by byte; others have no tokens.

        Pieces are joined again to lots of some thousand characters, since many small calls are slow: where a piece ends as _CUT
        wants it, the next may follow. Byte lengths part the tokens. A lot that doesn't come back whole is encoded piece by piece.
        """
        size = np.array([len(p.encode()) + 1 for p in pieces], dtype=np.int64)
        lots = list(_joinable(pieces, self.cuts))
        ids, counts, ok = ([], []), ([], []), np.ones(len(pieces), dtype=bool)
        for some in _lots([int(size[lot].sum()) for lot in lots], ENCODED):
            texts = [" ".join(pieces[lot]) for lot in lots[some]]
            both = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
            for lot, text, *found in zip(lots[some], texts, *both, strict=True):
                if all(b"".join(map(spell.__getitem__, x)) == b" " + text.encode() for spell, x in zip((self.a_bytes, self.b_bytes), found, strict=True)):
                    ends = np.cumsum(size[lot])
                    for side, length, x in zip(range(2), (self.a_len, self.b_len), found, strict=True):
                        x = np.array(x, dtype=np.int64)
                        ids[side].append(x)
                        counts[side].append(np.diff(np.searchsorted(np.cumsum(length[x]), ends, side="right"), prepend=0))
                elif lot.stop - lot.start > 1:
                    for k in range(lot.start, lot.stop):
                        sides, good = self.encode(pieces[k : k + 1])
                        ok[k] = good[0]
                        for side in range(2):
                            ids[side].append(sides[side][0])
                            counts[side].append(np.diff(sides[side][1]))
                else:
                    ok[lot] = False
                    for side in range(2):
                        counts[side].append(np.zeros(1, dtype=np.int64))
        none = [np.zeros(0, dtype=np.int64)]
        return [(np.concatenate(ids[side] + none), np.concatenate([[0], np.cumsum(np.concatenate(counts[side] + none))])) for side in range(2)], ok


def _joinable(pieces: list[str], cuts: bool, most: int = 1 << 13):
    """Slices of pieces that may be joined by spaces: all but the last end as _CUT wants it, and together they have some thousand characters."""
    start, size = 0, 0
    for k, p in enumerate(pieces):
        size += len(p) + 1
        if size > most or not cuts or not _END.search(p):
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(pieces):
        yield slice(start, len(pieces))


def _byte_letters() -> str:
    """The letters that stand for the bytes 0 to 255 in a byte-level vocabulary: visible bytes as they are, others from 256 on."""
    seen = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i]
    hidden = iter(range(256, 512))
    return "".join(chr(i) if i in seen else chr(next(hidden)) for i in range(256))


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    """The two tokenizers, once a process."""
    return Pair(a, b)


def align(p: Pair, pieces: list[str], grouped: bool = True) -> dict:
    """Links and groups of pieces: key and end of each link, with offsets by piece, and what a piece has of tokens and groups; without
    grouped only ok, keys and link_off.

    The ends of both sides cut the bytes into stretches; each lies in one token of A and one of B, and each overlapping pair
    of occurrences shares one stretch. Its key is B's id in the upper and A's in the lower 32 bits.
    """
    ((a, a_off), (b, b_off)), ok = p.encode(pieces)
    a_end, b_end = np.cumsum(p.a_len[a]), np.cumsum(p.b_len[b])
    ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two runs in order
    ends = ends[np.flatnonzero(np.diff(ends, append=-1))]
    keys = (b[np.searchsorted(b_end, ends)] << _WIDE) | a[np.searchsorted(a_end, ends)]
    whole = a_end[a_off[1:] - 1] if len(a) else np.zeros(len(pieces), dtype=np.int64)
    whole[~ok] = 0
    link_off = np.concatenate([[0], np.searchsorted(ends, np.maximum.accumulate(whole), side="right")])
    if not grouped:
        return {"ok": ok, "keys": keys, "link_off": link_off}
    common = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end] if len(b_end) else a_end
    group_off = np.concatenate([[0], np.searchsorted(common, np.maximum.accumulate(whole), side="right")])
    return {"ok": ok, "keys": keys, "link_off": link_off, "n_a": np.diff(a_off), "n_b": np.diff(b_off), "n_groups": np.diff(group_off), "groups": _written(p, a, b, a_end, b_end, common, group_off, a_off, b_off)}


def _written(p: Pair, a, b, a_end, b_end, common, group_off, a_off, b_off) -> list[str]:
    """The groups of each piece as a1,a2|b1;a3|b2: ids in order, written by one look into the table of numbers and signs."""
    a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    a_last, b_last = np.searchsorted(a_end, common), np.searchsorted(b_end, common)  # of each group
    size, n = len(p.names) // 4, len(a) + len(b)
    code = np.empty(n, dtype=np.int64)
    a_at = np.arange(len(a)) + np.concatenate([[0], b_last + 1])[a_group]
    b_at = np.arange(len(b)) + (a_last + 1)[b_group]
    code[a_at], code[b_at] = a, b
    code[a_at[a_last]] += size
    code[b_at[b_last]] += 2 * size
    closing = group_off[1:][np.diff(group_off) > 0] - 1  # the last group of a piece
    code[b_at[b_last[closing]]] += size
    names = p.names[code]
    lengths = np.concatenate([[0], np.cumsum(p.name_len[code])])
    raw = names.tobytes().replace(b"\0", b"").decode("ascii")
    cut = lengths[a_off + b_off].tolist()
    return [raw[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Known:
    """Pieces that a task has met, with one array for each figure; told to forget when there are too many."""

    def __init__(self, p: Pair, figures):
        self.p, self.figures = p, figures
        self.forget()

    def forget(self) -> None:
        self.number, self.size, self.parts = Numbers(), 0, None

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, end to end, and offsets by text."""
        split, old = [self.p.split(t) for t in texts], len(self.number)
        at = [np.fromiter(map(self.number.__getitem__, x), dtype=np.int64, count=len(x)) for x in split]
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in split], out=offsets[1:])
        if len(self.number) > old:
            new = list(islice(self.number, old, None))
            self.size += sum(map(len, new))
            made = self.figures(new)
            self.parts = made if self.parts is None else {k: _joined(self.parts[k], v) for k, v in made.items()}
        return np.concatenate(at), offsets

    @property
    def full(self) -> bool:
        return len(self.number) > PIECES or self.size > CHARACTERS


def _joined(x, y):
    if isinstance(x, list):
        x.extend(y)
        return x
    return np.concatenate([x, y])


def _lots(sizes: list[int], most: int):
    """Slices that cover the list, each of about so much together."""
    start, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size > most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _texts(column: pa.Array):
    """Slices of a column of texts, each of about LOT bytes, with their texts."""
    for lot in _lots(pc.fill_null(pc.binary_length(column), 0).to_pylist(), LOT):
        yield lot, column[lot].to_pylist()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n[:0]


def pair_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(key, n): for each task the counts of its linked id pairs, distinct in its documents but for what its memory parts."""
    return docs.select(F.col(f"`{text}`")).mapInArrow(lambda batches: count_pairs(batches, a, b), "key long, n long")


def count_pairs(batches, a: str, b: str):
    """Batches of one column of texts to batches of keys and counts: a piece's links count as often as valid texts hold it."""
    p = pair(a, b)

    def figures(pieces):
        x = align(p, pieces, grouped=False)
        return {"ok": x["ok"], "keys": x["keys"], "n_links": np.diff(x["link_off"])}

    known, seen, sums = Known(p, figures), np.zeros(0, dtype=np.int64), []

    def drain():
        if known.parts is not None:
            times = np.repeat(np.pad(seen, (0, len(known.number) - len(seen))), known.parts["n_links"])
            sums.append(_summed(known.parts["keys"][times > 0], times[times > 0]))
        known.forget()
        return np.zeros(0, dtype=np.int64)

    def merged():
        both = _summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))
        sums.clear()
        return both

    for batch in batches:
        for _, texts in _texts(batch.column(0)):
            texts = [t for t in texts if t]
            if not texts:
                continue
            at, offsets = known.numbers(texts)
            good = np.logical_and.reduceat(known.parts["ok"][at], offsets[:-1])
            met = np.bincount(at[np.repeat(good, np.diff(offsets))], minlength=len(known.number))
            seen = met + np.pad(seen, (0, len(met) - len(seen)))
            if known.full:
                seen = drain()
                if sum(len(k) for k, _ in sums) > BUFFER:
                    sums.append(merged())
                    if len(sums[0][0]) > BUFFER:
                        yield from _rows(*sums.pop())
    drain()
    if sums:
        yield from _rows(*merged())


def _rows(keys: np.ndarray, n: np.ndarray, size: int = 1 << 17):
    for k in range(0, len(keys), size):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(n[k : k + size])], names=["key", "n"])


def _store(path: str):
    """The file system and path of a folder that executors share; Hadoop writes file:/x for file:///x."""
    from pyarrow import fs

    at = urlparse(path)
    return (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def write_shards(counts: DataFrame) -> list[dict]:
    """Sorted shards of (key, n), summed over equal keys, in the shared folder; returns what there is of each: path, length, least
    key, and the highest count of each B id in it.

    Keys are dealt by range and sorted; a task sums runs of equal keys as they pass and writes its keys, then its counts, as
    64-bit numbers to a file of a new name, so that a lost or repeated task leaves no more than an unused file. The list has
    a row a shard and at most an entry for each id of B and shard border, whatever the corpus.
    """
    partial = keep(counts, "pairs")
    folder = claim(partial.sparkSession, "shards")

    def run(batches):
        keys, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            k, n = _summed(np.concatenate([keys[-1][-1:], batch.column(0).to_numpy()]), np.concatenate([sums[-1][-1:], batch.column(1).to_numpy()]))
            keys[-1], sums[-1] = keys[-1][:-1], sums[-1][:-1]
            keys.append(k)
            sums.append(n)
        key, n = np.concatenate(keys), np.concatenate(sums)
        if len(key):
            store, at = _store(folder)
            store.create_dir(at, recursive=True)
            path = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{at}/{path.rpartition('/')[2]}") as f:
                f.write(key.tobytes())
                f.write(n.tobytes())
            ids = key >> _WIDE
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            yield pa.RecordBatch.from_pylist([{"path": path, "low": int(key[0]), "size": len(key), "ids": ids[first].tolist(), "tops": np.maximum.reduceat(n, first).tolist()}], schema=out)

    out = pa.schema([("path", pa.string()), ("low", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("tops", pa.list_(pa.int64()))])
    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    rows = ordered.mapInArrow(run, "path string, low long, size long, ids array<long>, tops array<long>").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["low"])


class Shards:
    """Counts by key, looked up by binary search; files of a local or mounted folder are mapped, others read when first needed."""

    def __init__(self, listed: list[dict]):
        self.listed, self.low, self.open = listed, np.array([x["low"] for x in listed], dtype=np.int64), {}
        self.top = np.zeros(max([i for x in listed for i in x["ids"]], default=0) + 1, dtype=np.int64)
        for x in listed:
            np.maximum.at(self.top, np.array(x["ids"], dtype=np.int64), np.array(x["tops"], dtype=np.int64))

    def _shard(self, k: int) -> np.ndarray:
        if k not in self.open:
            store, at = _store(self.listed[k]["path"])
            if store.type_name == "local":
                self.open[k] = np.memmap(at, dtype=np.int64, mode="r").reshape(2, -1)
            else:
                with store.open_input_file(at) as f:
                    self.open[k] = np.frombuffer(f.read(), dtype=np.int64).reshape(2, -1)
        return self.open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys in any order, of which all were counted; the shards are gone through one by one."""
        distinct, back = np.unique(keys, return_inverse=True)
        out, cuts = np.zeros(len(distinct), dtype=np.int64), np.append(np.searchsorted(distinct, self.low), len(distinct))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            key, n = self._shard(k)
            part = distinct[cuts[k] : cuts[k + 1]]
            at = np.minimum(np.searchsorted(key, part), len(key) - 1)
            out[cuts[k] : cuts[k + 1]] = np.where(key[at] == part, n[at], 0)
        return out[back]


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_texts(docs: DataFrame, a: str, b: str, text: str = "text", groups: str = "groups", shards: list[dict] | None = None) -> DataFrame:
    """docs with counts of both tokenizers' tokens, of groups and links, of links whose pair is the corpus-wide most frequent of its
    B id (ties count), the sum of the links' counts, and the groups as a1,a2|b1;a3|b2; columns of these names are replaced.

    a and b are paths that every executor can open; A sees a space and the text, B adds its own. Counts come from docs
    itself, unless shards are handed over. Texts that are null, empty or not given back byte by byte by both tokenizers have
    zeros and the empty text. Rows stand for themselves: repeated rows count as often as they stand there; null ids and ties
    need nothing; an empty table gives an empty result. Each text is encoded twice, by its pieces, so that only id pairs are
    shuffled; the shards stay until common.discard.
    """
    shards = write_shards(pair_counts(docs, a, b, text)) if shards is None else shards
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    new = [*FIGURES, groups]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new or c == text])
    at = base.columns.index(text)
    carried = [k for k, c in enumerate(base.columns) if c not in new]
    labels = [base.columns[k] for k in carried] + new
    schema = ", ".join([f"`{base.columns[k]}` {base.schema[k].dataType.simpleString()}" for k in carried] + [f"{x} long" for x in FIGURES] + [f"`{groups}` string"])

    return base.mapInArrow(lambda batches: align_batches(batches, a, b, sent.value, at, carried, labels), schema)


def align_batches(batches, a: str, b: str, shards: list[dict], at: int, carried: list[int], labels: list[str]):
    """Batches to their carried columns, the figures and the groups of the texts in column `at`."""
    p, table = pair(a, b), Shards(shards)

    def figures(pieces):
        x = align(p, pieces)
        n = table.counts(x["keys"])
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[x["link_off"]])
        best = n == table.top[np.minimum(x["keys"] >> _WIDE, len(table.top) - 1)]
        return {"ok": x["ok"], "n_a": x["n_a"], "n_b": x["n_b"], "n_groups": x["n_groups"], "n_links": np.diff(x["link_off"]), "n_best": sums(best), "count_sum": sums(n), "groups": x["groups"]}

    known = Known(p, figures)
    for batch in batches:
        for lot, texts in _texts(batch.column(at)):
            if known.full:
                known.forget()
            there, size = [k for k, t in enumerate(texts) if t], len(texts)
            made, written = np.zeros((len(FIGURES), size), dtype=np.int64), [""] * size
            if there:
                numbers, offsets = known.numbers([texts[k] for k in there])
                good = np.logical_and.reduceat(known.parts["ok"][numbers], offsets[:-1])
                for row, name in zip(made, FIGURES, strict=True):
                    row[there] = np.where(good, np.add.reduceat(known.parts[name][numbers], offsets[:-1]), 0)
                spelled, cut = list(map(known.parts["groups"].__getitem__, numbers.tolist())), offsets.tolist()
                for k, g, s, e in zip(there, good.tolist(), cut[:-1], cut[1:], strict=True):
                    if g:
                        written[k] = ";".join(spelled[s:e])
            part = batch.slice(lot.start, size)
            yield pa.RecordBatch.from_arrays([part.column(k) for k in carried] + [pa.array(x) for x in made] + [pa.array(written, pa.string())], names=labels)
