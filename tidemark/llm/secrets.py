"""Secret scans: a worklist unwraps encoded layers until nothing new appears, scans each, and maps what it finds back."""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,via:string>>"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# A percent sign that was itself encoded, however often, is unwrapped at once; so is a backslash.
_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_UNIT = re.compile(r"\\(?:u005[cC])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
#: A run of base64, with what follows on further lines.
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})*={0,2}")
_WIDE = re.compile(r"(?:[ -~]\x00){4}|(?:\x00[ -~]){4}")
_ZIP = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_ESCAPED = re.compile(rb"%[0-9A-Fa-f]{2}|\\[ux]")
#: Words of which an assignment holds one, in lower case.
_NAMES = (b"pass", b"secret", b"token", b"apikey", b"api_key")


def _table(members: str) -> bytes:
    return bytes(120 if chr(i) in members else 32 for i in range(256))


_DIGITS = "0123456789"
_IS_HEX = _table(_DIGITS + "abcdef")
_IS_B64 = _table(_DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")
#: Visible characters, zero bytes, and the rest.
_IS_WIDE = bytes(48 if i == 0 else 120 if 32 <= i <= 126 else 32 for i in range(256))


def _wide(raw: bytes) -> bool:
    kinds = raw.translate(_IS_WIDE)
    return b"x0x0x0x0" in kinds or b"0x0x0x0x" in kinds


def _worth(raw: bytes) -> bool:
    """Whether a finding or a further layer may lie in bytes; plain searches, since most bytes that get here are noise."""
    low = raw.lower()
    if any(w in low for w in _NAMES) or b"x" * 16 in raw.translate(_IS_B64) or _wide(raw):
        return True
    return bool((b"%" in raw or b"\\" in raw) and _ESCAPED.search(raw) or _ZIP.search(raw))


_SAFE = str.maketrans("-_", "+/", " \t\r\n")

#: A compressed layer is scanned in pieces of so many bytes, which overlap; a token that is open at the end of a piece is
#: carried into the next one, if it isn't longer than CARRY.
PIECE, OVERLAP, CARRY = 1 << 22, 1 << 12, 1 << 26
#: Bytes on which the beginning of a compressed stream is tried.
PROBE = 1 << 12


def scan_layer(t: str):
    """Base findings of one text: (kind, start, end). Patterns run only where a plain search finds what they need."""
    raw = t.encode("latin-1", "replace")
    low = raw.lower()
    for m in _ASSIGN.finditer(t) if any(w in low for w in _NAMES) else ():
        if len(m[1]) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in t:
        for m in _ACCESS.finditer(t):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(t) if b"x" * 24 in raw.translate(_IS_HEX) else ():
        yield "hex", m.start(), m.end()


def _replaced(t: str, pattern: re.Pattern, value) -> tuple:
    """t with the matches of a pattern replaced by one character each; the stretch of t behind each character; which were replaced."""
    stay, new = np.ones(len(t), dtype=bool), np.zeros(len(t), dtype=bool)
    for m in pattern.finditer(t):
        stay[m.start() + 1 : m.end()] = False
        new[m.start()] = True
    lo = np.flatnonzero(stay)
    return pattern.sub(value, t), lo, np.append(lo[1:], len(t)), new[lo]


def _decoded(s: str) -> bytes:
    whole = len(s) // 4 * 4
    rest = s[whole:]
    return binascii.a2b_base64(s[:whole]) + (binascii.a2b_base64(rest + "=" * (4 - len(rest))) if len(rest) > 1 else b"")


def _unwrap(t: str, touched: np.ndarray | None, first: bool):
    """Encoded layers of a text: (code, decoded text or None, lo, hi, touched) or, for compressed bytes, (code, None, start, end, bytes).

    lo and hi give the stretch of t behind each character. Bytes become characters one to one, which is all that the
    patterns need. Escapes are replaced in the whole text, so that a finding may be part plain; `touched` marks what was
    encoded (None: all), and only stretches with a touched character are looked at again, but all where the layer is seen
    first. A base64 run is read at each of its four alignments, since a path or a word before it may be part of the run.
    """
    if "%" in t and _PERCENT.search(t):
        yield ("url", *_kept(_replaced(t, _PERCENT, lambda m: chr(int(m[1], 16))), touched))
    if "\\" in t and _UNIT.search(t):
        yield ("unicode", *_kept(_replaced(t, _UNIT, lambda m: chr(int(m[1] or m[2], 16))), touched))
    if "\x00" in t and _wide(t.encode("latin-1", "replace")) and _WIDE.search(t):
        at = np.array([i for i, c in enumerate(t) if c != "\x00"])
        yield "utf16", t.replace("\x00", ""), at, at + 1, None
    for m in _B64.finditer(t):
        if not first and touched is not None and not touched[m.start() : m.end()].any():
            continue
        run = m[0].rstrip("=")
        s = run.translate(_SAFE)
        for k in range(4):
            raw = _decoded(s[k:])
            if not _worth(raw):
                continue
            for z in _streams(raw):
                yield "base64>zip", None, m.start(), m.end(), z
            i = np.arange(len(raw))
            at = m.start() + (np.arange(len(s)) if len(s) == len(run) else np.array([j for j, c in enumerate(run) if c not in " \t\r\n"]))
            hi = at[np.minimum(k + (4 * i + 3) // 3, len(s) - 1)] + 1
            hi[-1:] = m.end()  # the sign that fills up the last letters is part of them
            yield "base64", raw.decode("latin-1"), at[k + i * 4 // 3], hi, None


def _kept(replaced: tuple, touched: np.ndarray | None) -> tuple:
    text, lo, hi, new = replaced
    return text, lo, hi, None if touched is None else new | touched[lo]


def _streams(raw: bytes):
    """Views of the bytes from each place on at which a compressed stream begins.

    Two bytes look like a beginning once in some 16,000 bytes of noise. Such a place is tried on its first bytes: what fails
    there would fail before anything came out, and most noise does, so that it is neither copied nor hashed.
    """
    view = memoryview(raw)
    for m in _ZIP.finditer(raw):
        try:
            zlib.decompressobj(47).decompress(view[m.start() : m.start() + PROBE], PIECE)
        except zlib.error:
            continue
        yield view[m.start() :]


def _members(raw: bytes):
    """Bytes of the members of a zlib or gzip stream, in pieces; what isn't a member ends it."""
    while raw:
        d = zlib.decompressobj(47)
        try:
            while raw and not d.eof:
                yield d.decompress(raw, PIECE)
                raw = d.unconsumed_tail or (b"" if not d.eof else raw)
            if not d.eof:
                yield d.flush()
        except zlib.error:
            return
        raw = d.unused_data


def _inflated(raw: bytes):
    """Texts of a compressed layer in pieces that overlap, so that memory is bounded whatever it unfolds to."""
    carry = b""
    for out in _members(raw):
        buf = carry + out
        if len(buf) < PIECE:
            carry = buf
            continue
        yield buf.decode("latin-1")
        open_at = max(buf.rfind(b" "), buf.rfind(b"\t")) + 1
        carry = buf[min(open_at, len(buf) - OVERLAP) :] if len(buf) - open_at < CARRY else buf[-OVERLAP:]
    if carry:
        yield carry.decode("latin-1")


def _contents(raw: bytes):
    """What a compressed layer holds, layers within it unwrapped: (codes, kind, None) or (codes, None, compressed bytes)."""
    for piece in _inflated(raw):
        for z in _streams(piece.encode("latin-1")):
            yield ">zip", None, z
        work = [(piece, "", np.zeros(len(piece), dtype=bool))]
        while work:
            t, via, touched = work.pop()
            for kind, s, e in scan_layer(t):
                if not via or touched is None or touched[s:e].any():
                    yield via, kind, None
            for code, inner, *_, more in _unwrap(t, touched, not via):
                if inner is None:
                    yield f"{via}>{code}", None, more
                else:
                    work.append((inner, f"{via}>{code}", more))


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _explore(raw: bytes, notes: dict) -> bytes:
    """Notes for a compressed layer and all compressed layers that it leads to, each by digest and once: findings, and further layers."""
    root = _digest(raw)
    if root not in notes:
        notes[root] = (set(), {})
        work = [(root, _contents(raw))]
        while work:
            at, items = work[-1]
            item = next(items, None)
            if item is None:
                work.pop()
                continue
            via, kind, inner = item
            if inner is None:
                notes[at][0].add((kind, via))
            else:
                d = _digest(inner)
                notes[at][1][via, d] = None
                if d not in notes:
                    notes[d] = (set(), {})
                    work.append((d, _contents(inner)))
    return root


def scan(text: str | None) -> list[dict]:
    """Spans in code points of the outermost text, end exclusive, by start, kind and layer. Null or empty: none.

    Base findings are those of the text itself. Then a worklist of layers: each is scanned and unwrapped, and a finding is
    mapped back through all layers to the characters that encode it. Each of these layers is shorter than the one it lies in,
    so that the list ends. A compressed layer has no such map: what it holds, however deep, has the span of its whole run.
    Compressed layers are noted by digest and read once, in pieces, one for each level in memory, so that cycles end.
    """
    text = text or ""
    found = {(k, s, e, True, "") for k, s, e in scan_layer(text)}
    work, notes = [(text, None, None, np.zeros(len(text), dtype=bool), "")], {}
    while work:
        t, lo, hi, touched, via = work.pop()
        at = lambda s, e: (s, e) if lo is None else (int(lo[s]), int(hi[e - 1]))  # noqa: B023, E731
        if via:
            found.update((k, *at(s, e), False, via) for k, s, e in scan_layer(t) if touched is None or touched[s:e].any())
        for code, inner, a, b, more in _unwrap(t, touched, not via):
            path = f"{via}>{code}".lstrip(">")
            if inner is None:
                s, e = at(a, b)
                seen, todo = set(), [(_explore(more, notes), path)]
                while todo:
                    d, p = todo.pop()
                    if d not in seen:
                        seen.add(d)
                        found.update((k, s, e, False, p + v) for k, v in notes[d][0])
                        todo += [(x, p + v) for v, x in notes[d][1]]
            else:
                work.append((inner, a if lo is None else lo[a], b if hi is None else hi[b - 1], more, path))
    return [dict(zip(("kind", "start", "end", "base", "via"), x, strict=True)) for x in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), not x[3], x[2], x[4]))]


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """docs with a column of spans; an existing column of that name is replaced.

    One pass without a shuffle over whole texts, however long; rows stand alone, so repeated rows, ties and null ids need
    nothing, other columns pass unchanged, and an empty table gives an empty result.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != spans])
    at = base.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{spans}` {SPAN}"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("via", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans])

    return base.mapInArrow(run, schema)
