"""The registered queries of this subpackage: thin wrappers that derive digest columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt, crosstok, decontaminate, lm, mixing, neardup, pii, runs, secrets, topk, toxicity, warc
from .common import SPACED_RE, keep, spread


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df) if table == "documents" else df


def _joined(spans: Column) -> Column:
    """kind:start:end of each span once, whatever the number of layers in which it was found."""
    return F.array_join(F.array_distinct(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))), ",")


def _digests(df: DataFrame, spans: str, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter(spans, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in kinds]
    return df.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(rows, rows.filter("vec_id % 20 = 0"), k=20, scale=64).withColumnRenamed("id", "vec_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = keep(mixing.measured(docs).drop("text"), "sizes")  # so that texts are read once
    out = mixing.mix_sources(sized, text=None)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_read(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    cut = bwt.repeated_spans(docs)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    cut = cut.select("id", "key", size.alias("cut_bytes"), F.size("spans").cast("long").alias("cut_spans"), F.sha2("kept", 256).alias("cut_sha"))
    raw = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw.cast("binary"), 256).alias("sha"))
    out = base.join(cut, (base.doc_id == cut.id) & (base.key == cut.key), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("cut_bytes", zero).alias("n_removed"), F.coalesce("cut_spans", zero).alias("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), shingle=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic")
    machine = toxicity.fit(toxicity.fit_sample(docs, labels), toxicity.rate(labels))
    return toxicity.score_toxicity(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(pii.find_pii(_read(spark, sf_dir, "documents", "doc_id", "text")), "pii", pii.KINDS[:4])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secrets.find_secrets(_read(spark, sf_dir, "documents", "doc_id", "text")), "secrets", secrets.KINDS)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.recrawl_log(_read(spark, sf_dir, "pages", "page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("merged")), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    return out.select(F.col("id").alias("page_id"), "surt", "status", F.col("refers_to").alias("refers_to"), F.array_join(lines, "|").alias("headers"), "body_digest")


def _looped(text: Column, doc_id: Column) -> Column:
    """The text, of which every tenth document repeats its words from one on with a period that its id sets."""
    code = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({SPACED_RE})"), F.lit(1))
    n, g = F.size(words), F.floor(code / 10)
    first = (g % n).cast("int")
    left = n - first
    period = F.lit(1) + F.floor(left / (F.lit(3) + g % 8)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil(left / period).cast("int"))), F.lit(1), left)
    return F.when((code % 10 == 0) & text.rlike(SPACED_RE), F.array_join(F.concat(F.slice(words, F.lit(1), first), tail), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    out = runs.periodic_runs(docs.select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text")))
    far = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]  # noqa: E731  over 0 where a has the greater exponent
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(far(b, a) > 0, b).otherwise(a))
    out = out.select("doc_id", "runs", "collapsed", best.alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_texts(_read(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    out = bpe.decode_ids(out, ranks, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    import public_tokenizers

    a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    out = crosstok.align_texts(_read(spark, sf_dir, "documents", "doc_id", "text"), a, b)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", *crosstok.FIGURES, digest.alias("groups_sha256"))


ORACLE_LEAKS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

ORACLE_TOPK = """
WITH e AS (
  SELECT vec_id, [cast(floor(64 * cast(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, cast(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_WARC = r"""
WITH bare AS (
  SELECT page_id, html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS a FROM pages
), undone AS (
  SELECT page_id, html, url, array_to_string(list_transform(regexp_extract_all(a, '%[0-9A-Fa-f]{2}|[^%]|%'), lambda p:
    CASE WHEN length(p) < 3 THEN p WHEN regexp_matches(chr(cast('0x' || substr(p, 2, 2) AS INTEGER)), '^[A-Za-z0-9._~-]$') THEN chr(cast('0x' || substr(p, 2, 2) AS INTEGER)) ELSE upper(p) END), '') AS a FROM bare
), parts AS (
  SELECT page_id, html, url, regexp_replace(regexp_replace(lower(regexp_extract(a, '^(?:[^/?@]*@)?([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         rtrim(regexp_extract(a, '^[^/?]*([^?]*)', 1), '/') AS path, list_sort(list_filter(string_split(regexp_extract(a, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS query
  FROM undone
), c AS (
  SELECT page_id, html, url, CASE WHEN regexp_matches(host, '^[0-9.:]*$|^\[') THEN host ELSE array_to_string(list_reverse(string_split(host, '.')), ',') END
         || ')' || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS surt
  FROM parts
), w AS (
  SELECT *, CASE WHEN substr(md5(coalesce(url, '')), 1, 1) < '5' THEN NULL ELSE '"' || md5(coalesce(html, '')) || '"' END AS tag FROM c
), r AS (
  SELECT a.page_id, a.surt, b.page_id AS refers_to, a.tag, b.html,
         CASE WHEN a.tag IS NOT NULL AND b.tag IS NOT NULL THEN a.tag = b.tag WHEN a.tag IS NULL THEN coalesce(a.page_id = b.page_id, FALSE) ELSE FALSE END AS same,
         row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC NULLS LAST) AS pos
  FROM w a LEFT JOIN w b ON a.surt = b.surt AND b.page_id < a.page_id + 5000
)
SELECT page_id, surt, CASE WHEN refers_to IS NULL THEN 'orphan' WHEN same THEN 'resolved' ELSE 'mismatch' END AS status, refers_to,
       CASE WHEN same THEN 'cache-control: max-age=300|content-length: ' || length(coalesce(html, '')) || '|content-type: text/html|date: '
         || (page_id + 5000) || coalesce('|etag: ' || tag, '') || '|last-modified: ' || refers_to END AS headers,
       CASE WHEN same THEN sha256(coalesce(html, '')) END AS body_digest
FROM r WHERE pos = 1
"""

ORACLE_NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS MATERIALIZED (
  SELECT s.doc_id, n.n, g, row_number() OVER (PARTITION BY s.doc_id ORDER BY c, g) AS pos FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS c FROM s GROUP BY 1) USING (g)
), p AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.pos <= a.n - ceil(0.8 * a.n) + 1 AND b.pos <= b.n - ceil(0.8 * b.n) + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), c AS MATERIALIZED (
  SELECT p.a, p.b, count(*) AS common FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND x.g = y.g GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), e AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY 1) r ON r.x = d.doc_id
"""

ORACLE_REPEATS = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)
), f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY 1 HAVING count(*) > 1
), r AS MATERIALIZED (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first_doc
), k AS (SELECT *, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 THEN 1 ELSE 0 END AS new FROM r
), g AS MATERIALIZED (
  SELECT doc_id, isl, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM k) GROUP BY 1, 2
), p AS (
  SELECT doc_id, a, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS from_i, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt, b FROM g
), o AS (
  SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * from_i - 1, 2 * (a - from_i)), '' ORDER BY a) || max(CASE WHEN nxt IS NULL THEN substr(h, 2 * b - 1) END) AS rest
  FROM p JOIN d USING (doc_id) GROUP BY 1
)
SELECT d.doc_id, cast(n AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

ORACLE_MIX = f"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(cast(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         len(regexp_extract_all(coalesce(text, ''), '{SPACED_RE}')) AS size
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS full_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY full_size / weight, coalesce('s' || source, 'n')) AS pos FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, cast(source_size AS BIGINT) AS source_size,
         least(full_size, (SELECT min_by(level, pos) FROM l WHERE level * weight <= full_size) * weight) AS target FROM l
), p AS (
  SELECT d.*, source_size, target, floor(target) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target,
       cast(CASE WHEN source_size > 0 THEN floor(budget / source_size) * size
         + greatest(0, least(size, budget - floor(budget / source_size) * source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""


#: crc32 of the id's digits, bit by bit: list_reduce takes in a byte (0 or more) or shifts once (-1).
ORACLE_RUNS = r"""
WITH c AS (
  SELECT doc_id, text, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(coalesce(cast(doc_id AS VARCHAR), ''), ''),
    lambda d: [cast(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384::BIGINT) ELSE h // 2 END), 4294967295::BIGINT) AS h
  FROM documents
), o AS MATERIALIZED (
  SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM c
), m AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM o
), w AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN looped AND i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // k)] ELSE w[1 + i] END AS x
  FROM (SELECT doc_id, w, n, looped, a, k, unnest(range(n)) AS i FROM m)
), e AS (
  SELECT p.doc_id, q.i - p.i AS q, p.i FROM w p JOIN w q ON p.doc_id = q.doc_id AND p.x = q.x AND q.i > p.i AND 4 * (q.i - p.i) <= p.n
), g AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isl FROM e) GROUP BY doc_id, q, isl
), r AS MATERIALIZED (
  SELECT doc_id, s, len, min(q) AS q FROM g WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len
), d AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM r GROUP BY doc_id
), b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r.doc_id ORDER BY s, q) AS pos FROM r
    WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.doc_id = r.doc_id AND z.len * r.q > r.len * z.q)) WHERE pos = 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT w.doc_id, w.i, x FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i) GROUP BY doc_id
)
SELECT o.doc_id, cast(coalesce(n_runs, 0) AS BIGINT) AS n_runs, cast(b.s AS BIGINT) AS start, cast(b.len AS BIGINT) AS length, cast(b.q AS BIGINT) AS period,
       cast(1000 * b.len // b.q AS BIGINT) AS exponent_milli, coalesce(d.sha, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM o LEFT JOIN d ON o.doc_id = d.doc_id LEFT JOIN b ON o.doc_id = b.doc_id LEFT JOIN k ON o.doc_id = k.doc_id
"""


def queries() -> dict:
    return {"op11_periodic_runs": op11_periodic_runs, "op12_byte_bpe": op12_byte_bpe, "op13_cross_tokenizer": op13_cross_tokenizer, "op1_decontaminate": op1_decontaminate, "op2_topk": op2_topk, "op3_mix_sources": op3_mix_sources, "op4_lm_scores": op4_lm_scores, "op5_suffix_dedup": op5_suffix_dedup, "op6_near_duplicates": op6_near_duplicates, "op7_toxicity": op7_toxicity, "op8_pii": op8_pii, "op9_secrets": op9_secrets, "op10_warc_revisits": op10_warc_revisits}


def oracle_sql() -> dict[str, str]:
    return {"op11_periodic_runs": ORACLE_RUNS, "op10_warc_revisits": ORACLE_WARC, "op1_decontaminate": ORACLE_LEAKS, "op2_topk": ORACLE_TOPK, "op3_mix_sources": ORACLE_MIX, "op5_suffix_dedup": ORACLE_REPEATS, "op6_near_duplicates": ORACLE_NEAR}
