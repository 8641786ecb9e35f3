"""Byte-level BPE over texts of any length: token ids by the tiktoken library and a rank file, and the bytes that ids stand for."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, which is what \s means to the library.
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Texts of more characters are encoded in chunks of about this many.
CHUNK = 1 << 15
#: White space of at least so many characters is one match on its own; the library's matcher overflows on a million of them.
BLANK = 1 << 12
_CUT = re.compile(r"(?<=[!-~\w])(?=[ \t\n\r])")
_BLANKS = re.compile(rf"(?:(?<=[^{SPACE}])|\A)[{SPACE}]{{{BLANK},}}")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str):
    """The library's encoder for a rank file (a base64 token and a number a line), once a process."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def chunks(text: str, size: int = CHUNK):
    """Parts of a text whose tokens are those of the whole, with a mark for parts that are one match of the pattern.

    A match holds white space at its start or holds nothing else, so that each place between a visible character and white
    space parts two matches: long texts are cut there. Of a long stretch of white space the pattern takes all but the last
    character, which belongs to what follows, or all at the end of the text; that part needs no matching. What has no such
    place (a million letters in a row) stays whole, as the library takes it in n log n.
    """
    if len(text) <= min(size, BLANK):
        yield text, False
        return
    at = 0
    for m in [*_BLANKS.finditer(text), None]:
        stop = m.start() if m else len(text)
        while stop - at > size and (c := _CUT.search(text, at + size, stop)):
            yield text[at : c.start()], False
            at = c.start()
        if stop > at:
            yield text[at:stop], False
        if m:
            at = m.end() if m.end() == len(text) else m.end() - 1
            yield text[stop:at], True


def encode(text: str | None, enc, size: int = CHUNK) -> np.ndarray:
    """Token ids of a whole text, as the library gives them for it in one piece; none for a null or empty text."""
    parts = [np.array(enc._encode_single_piece(part), dtype=np.uint32) if single else enc.encode_to_numpy(part, disallowed_special=()) for part, single in chunks(text or "", size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _added(df: DataFrame, source: str, name: str, kind: str, make) -> DataFrame:
    """df with a column made from a batch's column source; one of its name is replaced."""
    at = df.columns.index(source)
    carried = [k for k, c in enumerate(df.columns) if c != name]
    schema = ", ".join([f"`{df.columns[k]}` {df.schema[k].dataType.simpleString()}" for k in carried] + [f"`{name}` {kind}"])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in carried] + [make(batch.column(at))], names=[batch.schema.names[k] for k in carried] + [name])

    return df.select(*[F.col(f"`{c}`") for c in df.columns]).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of token ids; a column of that name is replaced. ranks is a path that every executor can open.

    One pass without a shuffle; whole texts, cut at safe places if long. Rows stand alone: repeated rows, ties and null ids
    need nothing; null and empty texts get an empty array, an empty table an empty result. Special tokens aren't known:
    their strings are plain text.
    """

    def make(column):
        enc = encoding(ranks, pattern)
        arrays = [encode(t.as_py(), enc) for t in column]
        offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
        np.cumsum([len(a) for a in arrays], out=offsets[1:])
        flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return _added(docs, text, ids, "array<int>", make)


def decode_ids(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that an array of ids stands for, which need not be UTF-8; a column of that name is replaced.

    Null ids of an array stand for nothing, a null or empty array for no bytes; an id that the rank file lacks is an error.
    """

    def make(column):
        enc = encoding(ranks, pattern)
        return pa.array([enc.decode_bytes([i for i in x.as_py() or () if i is not None]) for x in column], pa.binary())

    return _added(df, ids, decoded, "binary", make)
