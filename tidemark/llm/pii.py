"""Personal data: patterns propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed; the last two are added by the method.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from within, so that only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")

#: Score of a confirmed span, what a fitting word within 40 characters adds, and what a word of figures takes away.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
NEAR, BONUS, MALUS, ACCEPT = 40, 0.3, 0.3, 0.5
CONTEXT = {
    "email": {"mail", "email", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "addr", "ping"},
    "card": {"card", "visa", "credit", "debit", "karte", "carte", "tarjeta", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {"version", "release", "isbn", "serial", "sku", "part"}


def luhn(digits: str) -> bool:
    """Mod-10 check of a digit string."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    rest = 0
    for c in code[4:] + code[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(t: str):
    free, at = 0, t.find("@")
    while at >= 0:
        if m := _DOMAIN.match(t, at + 1):
            s = at
            while s > free and t[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                yield s, (free := m.end())
        at = t.find("@", at + 1)


def _ibans(t: str):
    """Of each run of groups, the longest beginning that ends with a group and passes the check; the search goes on behind it."""
    m = _IBAN.search(t)
    while m:
        s, e = m.span()
        while e > s and not (15 <= len(code := t[s:e].replace(" ", "")) <= 34 and mod97(code)):
            e = t.rfind(" ", s, e)
        if e > s:
            yield s, e
        m = _IBAN.search(t, e if e > s else s + 1)


def _candidates(t: str):
    """Confirmed spans of every kind."""
    if "@" in t:
        for s, e in _emails(t):
            yield "email", s, e
    if not _DIGIT.search(t):
        return
    for m in _IP.finditer(t):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in _ibans(t):
        yield "iban", s, e
    for m in _SSN.finditer(t):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", m.start(), m.end()


def scan(text: str | None) -> list[dict]:
    """Spans in code points, end exclusive, by start and then kind. A null or empty text has none.

    email, ip, card and phone are the base kinds: each is kept once its check holds, whatever its score. iban and ssn
    are added where the score reaches ACCEPT; an ssn has no checksum and needs a fitting word nearby.
    """
    out = []
    for kind, s, e in _candidates(text or ""):
        near = set(_WORD.findall(text[max(0, s - NEAR) : s].lower())) | set(_WORD.findall(text[e : e + NEAR].lower()))
        score = min(1.0, max(0.0, PRIOR[kind] + BONUS * bool(near & CONTEXT[kind]) - MALUS * bool(near & AGAINST)))
        base = kind in KINDS[:4]
        if base or score >= ACCEPT:
            out.append({"kind": kind, "start": s, "end": e, "base": base, "score": round(score, 3)})
    out.sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
    return out


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with each maximal stretch of spans replaced by the kind of its first, as [EMAIL]."""
    if not text or not spans:
        return text
    out, at, upto = [], 0, -1
    for x in spans:
        if x["start"] < upto:
            upto = max(upto, x["end"])
            at = upto
            continue
        out += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
        at = upto = x["end"]
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text: str = "text", spans: str = "pii", redacted: str | None = None) -> DataFrame:
    """docs with a column of spans and, if named, one of redacted text; existing columns of those names are replaced.

    One pass without a shuffle; each row stands alone, so repeated rows, ties and null ids need nothing, and an empty
    table gives an empty result. Texts are read whole.
    """
    drop = [c for c in (spans, redacted) if c in docs.columns and c != text]
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in drop]
    base = docs.select(*cols)
    at = base.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{spans}` {SPAN}"
    if redacted and redacted != text:
        schema += f", `{redacted}` string"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [scan(t) for t in texts]
            arrays = list(batch.columns)
            names = list(batch.schema.names)
            new = pa.array([redact(t, s) for t, s in zip(texts, found, strict=True)], pa.string()) if redacted else None
            if redacted == text:
                arrays[at] = new
            arrays.append(pa.array(found, kind))
            names.append(spans)
            if redacted and redacted != text:
                arrays.append(new)
                names.append(redacted)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return base.mapInArrow(run, schema)
