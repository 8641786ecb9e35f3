"""Runs of words, byte-level BPE and the alignment of two tokenizers, against plain versions."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import texts
from tidemark.llm import bpe, common, crosstok, queries, runs

ROWS = texts()
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
key = lambda r: tuple((x is None, str(x)) for x in r)
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture(scope="module")
def tables(messy, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tokens"))
    messy.select("doc_id", "text", "key", "score", "id").write.parquet(f"{d}/documents.parquet")
    return d


# ---- runs ----------------------------------------------------------------------------------------------------------------------


def plain_runs(w, least=6, exponent=4):
    """Each stretch of equal distance, the smallest distance of those that cover the same words."""
    found, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q - s), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_op11(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = plain_runs(w)
    gone = {i for s, length, q in r for i in range(s + q, s + length)}
    best = min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None)
    milli = 1000 * best[1] // best[2] if r else None
    return doc_id, len(r), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in r)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_random_words(w):
    assert runs.find_runs(w) == plain_runs(w)


def test_runs_of_structured_words():
    rng = random.Random(3)
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 5)):
            root = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
            part = root * rng.randint(1, 9)
            w += part[: rng.randint(1, len(part))]
        w = (w * rng.randint(1, 5))[: rng.randint(1, 400)]
        for least, exponent in ((6, 4), (1, 3), (20, 5)):
            assert runs.find_runs(w, least, exponent) == plain_runs(w, least, exponent)


def test_runs_of_words_that_hash_badly():
    """Thue-Morse words have no cubes, Fibonacci words none of a fourth power; powers of both have."""
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    assert runs.find_runs(thue, 3, 3) == []
    a, b = [0], [0, 1]
    while len(b) < 1000:
        a, b = b, b + a
    assert runs.find_runs(b) == []
    assert runs.find_runs(thue[:64] * 5)[0] == (0, 320, 64)
    with pytest.raises(ValueError):
        runs.find_runs(thue, exponent=2)


def test_runs_survive_equal_hashes(monkeypatch):
    """With a hash that takes all words for equal, no run is reported that isn't one."""
    monkeypatch.setattr(runs, "_MOD", 1)
    w = [1, 2] * 30 + [1, 3] * 30 + list(range(60))
    assert set(runs.find_runs(w)) <= set(plain_runs(w))


def test_long_texts_take_n_log_n():
    assert runs.find_runs([0] * 200_000) == [(0, 200_000, 1)]
    assert runs.find_runs(list(range(40_000)) * 5) == [(0, 200_000, 40_000)]


def test_registered_runs(spark, tables):
    same(queries.op11_periodic_runs(spark, tables).collect(), [plain_op11(i, t) for i, t in ROWS])
    looped = [(i, " ".join(f"w{k % 37}" for k in range(i))) for i in range(1, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame(looped, "doc_id long, text string")
    text = queries._looped(F.col("text"), F.col("doc_id"))
    got = {r["doc_id"]: r["t"].split(" ") for r in docs.select("doc_id", text.alias("t")).collect()}
    for i, t in looped:
        g, w = zlib.crc32(str(i).encode()) // 10, t.split(" ")
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert got[i] == [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def test_runs_keep_columns(messy, nothing):
    out = runs.periodic_runs(messy, runs="key", collapsed="id", n_words="k")
    assert sorted(out.columns) == sorted(messy.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[26]["id"] == "pen ten pen ten" and rows[6]["id"] == "" and rows[8]["k"] == 0 and rows[6]["text"] is None and rows[16]["id"] == "ééé ñandú straße 東京"
    assert [tuple(x) for x in rows[16]["key"]] == [(0, 120, 4)]
    assert runs.periodic_runs(messy, runs="text", collapsed=None).columns[-1] == "text"
    assert runs.periodic_runs(nothing).collect() == []


# ---- byte-level BPE --------------------------------------------------------------------------------------------------------------


def table(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def plain_encode(text, ranks, match=regex.compile(public_tokenizers.PATTERN)):
    out = []
    for m in match.finditer(text or ""):
        parts = [bytes([c]) for c in m[0].encode()]
        while len(parts) > 1:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_registered_bpe(spark, tables):
    ranks = table(MULTI)
    spell = {v: k for k, v in ranks.items()}
    want = []
    for i, t in ROWS:
        ids = plain_encode(t, ranks) if len(t or "") < 100_000 else bpe.encoding(MULTI, public_tokenizers.PATTERN).encode_ordinary(t)
        assert b"".join(spell[x] for x in ids) == (t or "").encode()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    same(queries.op12_byte_bpe(spark, tables).collect(), want)


TRICKY = ["a  b", " \n\n x", "it's '" * 50 + "s", "　　 x  y", "\x1c\x1c a\x85 b", "x" * 300 + " " * 70 + "\n" * 9 + "y", "<|endoftext|> </s>", "12 34١٢ ½", "é ﬁ​‍", "\x00 \x00", " ", "\n", "tail   ", "a\r\nb\t\tc"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*TRICKY, "word", " ", "  ", "\n", "é", "9", "!?"]), max_size=30).map("".join), st.integers(1, 40))
def test_chunks_leave_tokens_alone(text, size):
    enc = bpe.encoding(MULTI, public_tokenizers.PATTERN)
    old, bpe.BLANK, blanks = bpe.BLANK, 4, bpe._BLANKS
    bpe._BLANKS = regex.compile(rf"(?:(?<=[^{bpe.SPACE}])|\A)[{bpe.SPACE}]{{4,}}")
    try:
        assert "".join(c for c, _ in bpe.chunks(text, size)) == text
        assert bpe.encode(text, enc, size).tolist() == enc.encode_ordinary(text)
    finally:
        bpe.BLANK, bpe._BLANKS = old, blanks


def test_long_texts_are_encoded_whole():
    enc, ranks = bpe.encoding(MULTI, public_tokenizers.PATTERN), table(MULTI)
    for t in (" " * 1_500_000 + "x", "\n" * 1_200_000, "ab" * 200_000, "word and more " * 200_000):
        ids = bpe.encode(t, enc)
        assert enc.decode_bytes(ids.tolist()) == t.encode()
    assert bpe.encode("word and more " * 20_000, enc).tolist() == enc.encode_ordinary("word and more " * 20_000)
    assert bpe.encode("q" + " " * 9_000 + "x  ", enc).tolist() == plain_encode("q", ranks) + enc._encode_single_piece(" " * 8_999) + plain_encode(" x  ", ranks)


def test_bpe_keeps_columns(spark, messy, nothing):
    out = bpe.decode_ids(bpe.encode_texts(messy, MULTI, public_tokenizers.PATTERN, ids="key"), MULTI, public_tokenizers.PATTERN, ids="key", decoded="id")
    assert sorted(out.columns) == sorted(messy.columns)
    assert all(bytes(r["id"]).decode() == (r["text"] or "") for r in out.collect())
    assert bpe.encode_texts(nothing, MULTI, public_tokenizers.PATTERN).collect() == []
    odd = spark.createDataFrame([([72, None],), ([],), (None,)], "ids array<int>")
    spell = {v: k for k, v in table(MULTI).items()}
    assert [bytes(r["decoded"]) for r in bpe.decode_ids(odd, MULTI, public_tokenizers.PATTERN).collect()] == [spell[72], b"", b""]


# ---- two tokenizers --------------------------------------------------------------------------------------------------------------


def plain_align(rows):
    p = crosstok.pair(A, B)
    done, links = [], Counter()
    for i, t in rows:
        groups, pairs, na, nb = [], [], 0, 0
        if t:
            a, b = p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t)
            if b"".join(p.a_bytes[x] for x in a) == b"".join(p.b_bytes[x] for x in b) == (" " + t).encode():
                na, nb, x, y, ea, eb, ga, gb = len(a), len(b), 0, 0, len(p.a_bytes[a[0]]), len(p.b_bytes[b[0]]), [a[0]], [b[0]]
                while True:
                    pairs.append((a[x], b[y]))
                    if ea == eb:
                        groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                        ga, gb = [], []
                    go_a, go_b = ea <= eb, eb <= ea
                    x, y = x + go_a, y + go_b
                    if x == na or y == nb:
                        break
                    if go_a:
                        ea += len(p.a_bytes[a[x]])
                        ga.append(a[x])
                    if go_b:
                        eb += len(p.b_bytes[b[y]])
                        gb.append(b[y])
        links.update(pairs)
        done.append((i, na, nb, groups, pairs))
    top = {}
    for (_, y), n in links.items():
        top[y] = max(top.get(y, 0), n)
    return [(i, na, nb, len(g), len(pr), sum(links[x] == top[x[1]] for x in pr), sum(links[x] for x in pr), sha(";".join(g)) if g else "") for i, na, nb, g, pr in done]


EXTRA = [(100 + k, t) for k, t in enumerate([*TRICKY, "".join(TRICKY), " ".join(TRICKY), "▁ has the space sign", "fine then ▁", "<0x41> <unk> <s>", "퟿ ﻿ x", "a " * 3000, "東京" * 4000, "x" * 5000 + " y"])]


def test_registered_alignment(spark, tables, messy, tmp_path):
    same(queries.op13_cross_tokenizer(spark, tables).collect(), plain_align(ROWS))
    spark.createDataFrame(EXTRA, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op13_cross_tokenizer(spark, str(tmp_path)).collect(), plain_align(EXTRA))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*TRICKY, "word", " ", "  ", "\n", "é", "9", "!?", "▁"]), max_size=20).map("".join))
def test_pieces_have_the_tokens_of_the_text(text):
    p = crosstok.pair(A, B)
    pieces = p.split(text)
    assert " ".join(pieces) == text
    if text and "▁" not in text:
        ((a, _), (b, _)), ok = p.encode(pieces)
        assert ok.all() and a.tolist() == p.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == p.b.encode(text)


def test_alignment_forgets_and_drains(monkeypatch):
    """Small memories give what large ones do: pieces are forgotten, partial counts given out more than once."""
    texts = [t for _, t in [*ROWS, *EXTRA] if t is None or len(t) < 20_000] * 3
    batches = [pa.record_batch({"text": pa.array(texts[k : k + 40], pa.string())}) for k in range(0, len(texts), 40)]

    def counts():
        out, rows = Counter(), 0
        for batch in crosstok.count_pairs(batches, A, B):
            rows += batch.num_rows
            for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out[k] += n
        return out, rows

    def aligned(shards):
        return [tuple(r.values()) for batch in crosstok.align_batches(batches, A, B, shards, 0, [], [*crosstok.FIGURES, "groups"]) for r in batch.to_pylist()]

    monkeypatch.setattr(crosstok.Shards, "_shard", lambda self, k: self.listed[k]["rows"])
    want, rows = counts()
    assert rows == len(want)
    key = np.array(sorted(want), dtype=np.int64)
    n = np.array([want[k] for k in key.tolist()], dtype=np.int64)
    shards = [{"low": int(key[s]), "rows": (key[s:e], n[s:e]), "ids": (key[s:e] >> 32).tolist(), "tops": n[s:e].tolist()} for s, e in ((0, 150), (150, len(key)))]
    full = aligned(shards)
    for name, value in (("PIECES", 50), ("LOT", 300), ("ENCODED", 100), ("BUFFER", 60)):
        monkeypatch.setattr(crosstok, name, value)
    got, rows = counts()
    assert got == want and rows > len(want) and aligned(shards) == full


def test_counts_lie_in_sorted_shards(spark, messy):
    shards = crosstok.write_shards(crosstok.pair_counts(messy, A, B))
    table = crosstok.Shards(shards)
    assert [x["low"] for x in shards] == sorted(x["low"] for x in shards)
    plain = {r["key"]: r["n"] for r in crosstok.pair_counts(messy, A, B).groupBy("key").agg(F.sum("n").alias("n")).collect()}
    keys = np.array([*plain, 1 << 60], dtype=np.int64)
    assert table.counts(keys).tolist() == [*plain.values(), 0]
    tops = Counter()
    for k, n in plain.items():
        tops[k >> 32] = max(tops[k >> 32], n)
    assert {i: int(n) for i, n in enumerate(table.top) if n} == dict(tops)


def test_alignment_keeps_columns(messy, nothing):
    out = crosstok.align_texts(messy.withColumnRenamed("k", "n_a"), A, B, groups="id")
    assert sorted(out.columns) == sorted([*(c for c in messy.columns if c != "k"), *crosstok.FIGURES])
    assert all((r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]) and (r["id"] == "") == (r["n_a"] == 0) for r in out.collect())
    assert crosstok.align_texts(nothing, A, B).collect() == []
    common.discard(messy.sparkSession)


# ---- secrets: repeated spans, noise ----------------------------------------------------------------------------------------------


def test_spans_are_listed_once_and_noise_is_linear(spark, tmp_path):
    import gzip
    import os
    import time

    from tidemark.llm import secrets

    inner = b"token=abcdefgh " + base64.b64encode(b"token = abcdefgh and more of it") + b" x" * 40
    text = "x " + base64.b64encode(gzip.compress(inner)).decode() + " y"
    assert len(secrets.scan(text)) > len({(x["kind"], x["start"], x["end"]) for x in secrets.scan(text)})
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = queries.op9_secrets(spark, str(tmp_path)).first()["spans"].split(",")
    assert len(spans) == len(set(spans)) == 1
    took = []
    for n in (1, 4):
        t = "x " + base64.b64encode(os.urandom(n << 20)).decode() + " password=hunter22"
        began = time.process_time()
        assert ("assign", True) in {(x["kind"], x["base"]) for x in secrets.scan(t)}
        took.append(time.process_time() - began)
    assert took[1] < 12 and took[1] < 10 * took[0]


# ---- language model: the deal of rows ------------------------------------------------------------------------------------------


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    from tidemark.llm import lm

    monkeypatch.setattr(lm, "SHARD", 3000)  # several shards
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.9)) % 400}" for _ in range(40_000)]
    rows = [(i, " ".join(words[80 * i : 80 * i + rng.randint(1, 160)])) for i in range(500)] + [(7, "x y"), (None, "a b a b"), (None, None)]
    got = []
    for n in (1, 8, 64):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n, F.rand(n))
        got.append(sorted(((r["id"], r["n_tokens"], r["score"], r["base_score"]) for r in lm.score_texts(df).collect()), key=str))
    assert lm.shards_of(40_000) == 7
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * a[1] and abs(a[3] - b[3]) < 1e-6


def test_plain_texts_are_cut_without_the_pattern(monkeypatch):
    p, cut = crosstok.pair(A, B), crosstok._CUT
    odd = [" a b", "a b ", "a  b c", "a\n b c", "a。 b c", " ", "a\x00 b", "  a b"]
    plain = ["a", "a b c", "a. b\nc d", "é ü 中 x", "a。b c"]
    whole = [crosstok.align(p, x.split(" ")) for x in plain]
    assert [p.split(x) for x in odd + plain + [""]] == [cut.split(x) for x in odd + plain + [""]]
    monkeypatch.setattr(crosstok, "_CUT", None)
    monkeypatch.setattr(crosstok, "_written", None)
    for x, want in zip(plain, whole, strict=True):
        got = crosstok.align(p, p.split(x), grouped=False)  # nor are groups written for counts
        assert all((got[k] == want[k]).all() for k in ("ok", "keys", "link_off")) and len(got) == 3
