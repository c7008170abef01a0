"""The queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, katz, langid, linededup, media, neardup, quality, warc
from .common import remainder, table, written


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = remainder("doc_id", 5)
    model = langid.fit(docs, "text", "lang", rest != 0)
    found = langid.identify(docs.select("doc_id", "text", F.coalesce(rest == 0, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    says = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"),
    )
    return chat.digest(chat.assemble(chat.format_turns(rows.unionAll(more))))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.digest(media.load(media.store(docs)))


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, remainder("doc_id", 5) == 1)


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.to_warc(warc.crawl_of_pages(table(spark, sf_dir, "pages")))
    # parsed once; the as-of step then reads a few narrow columns only
    return warc.digest(warc.resolve(written(warc.from_warc(files, "record"), "warc_records")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = bpe.prepare(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digest(bpe.round_trip(docs, codec))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_formatting, op3_decontamination, op4_minhash_neardup, op5_media_columns, op6_line_dedup, op7_katz_lm, op8_quality_crf, op9_warc_revisits, op10_bpe)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS header,
    CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
      THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS content
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(24 + length(header) + length(content)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Every pair of sets that share a shingle, and reachability over the links.
ORACLE_SQL["op4_minhash_neardup"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh
  FROM d
), e AS (SELECT k, doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.k AS ka, b.k AS kb, a.doc_id AS da, b.doc_id AS db, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.k < b.k GROUP BY ALL),
l AS (SELECT da, db FROM p WHERE 100 * c >= 75 * (na + nb - c)),
u AS (SELECT da AS a, db AS b FROM l UNION SELECT db, da FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, cast(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s LEFT JOIN m ON s.doc_id = m.a
"""

#: Windows compared as text.
ORACLE_SQL["op6_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
k AS (SELECT row_number() OVER () AS r, * FROM d),
w AS (
  SELECT r, doc_id, text, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS win
  FROM k, unnest(range(0, greatest(len(l) - 2, 0))) AS u(p)
  WHERE len(l) >= 3 AND trim(l[p + 1] || l[p + 2] || l[p + 3]) <> ''
), f AS (
  SELECT win, min(struct_pack(a := doc_id IS NULL, b := doc_id, c := p)) AS first FROM w GROUP BY win HAVING count(*) > 1
), later AS (
  SELECT DISTINCT r, x FROM (
    SELECT r, unnest(range(CASE WHEN doc_id IS NOT DISTINCT FROM first.b AND p < first.c + 3 THEN first.c + 3 ELSE p END, p + 3)) AS x
    FROM w JOIN f USING (win) WHERE struct_pack(a := doc_id IS NULL, b := doc_id, c := p) > first)
), g AS (SELECT r, list(x) AS gone FROM later GROUP BY r)
SELECT doc_id, cast(coalesce(len(l), 0) AS BIGINT) AS n_lines, cast(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)), '') END AS text
FROM k LEFT JOIN g USING (r)
"""

#: Items and documents as words, windows of items by direct comparison.
ORACLE_SQL["op3_decontamination"] = r"""
WITH d AS (
  SELECT rowid_ AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)
), b AS (
  SELECT cast(item_id AS VARCHAR) AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT i, least(len(w), 13) AS m, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(s) WHERE len(w) > 0
), m AS (SELECT DISTINCT m FROM p), dw AS (
  SELECT k, s, m.m AS m, array_to_string(w[s : s + m.m - 1], ' ') AS win
  FROM d, m, unnest(range(1, greatest(len(w) - m.m + 2, 1))) AS u(s)
), hits AS (
  SELECT dw.k, dw.s, dw.m, p.i FROM dw JOIN p ON dw.m = p.m AND dw.win = p.win
), pos AS (
  SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT k, s, m FROM hits), unnest(range(s, s + m)) AS u(x) GROUP BY k
), its AS (
  SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT k, i FROM hits WHERE i IS NOT NULL) GROUP BY k
)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""

ORACLE_SQL["op9_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(translate(url, chr(13) || chr(10), '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
    CASE WHEN page_id % 5 <> 0 THEN '"' || md5(coalesce(html, '')) || '"' END AS etag, CASE WHEN page_id % 11 <> 0 THEN 'day ' || (page_id % 97) END AS day
  FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@|:(80|443)$', '', 'g'), '^www\.', '') AS host,
    regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path,
    list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)')) AS own
  FROM p
), r AS (
  SELECT *, CASE WHEN len(own) > 0 THEN path || '?' || array_to_string(own, '&') ELSE regexp_replace(path, '/+$', '') END AS rest FROM u
), f AS (SELECT *, CASE WHEN host <> '' THEN host || rest END AS place, 2 * page_id AS id, page_id AS ts FROM r),
v AS (SELECT *, 2 * page_id + 1 AS vid, page_id + 1000 * (page_id % 3) AS vts FROM f),
m AS (
  SELECT v.page_id, max(struct_pack(ts := f.ts, id := f.id)).id AS source_id
  FROM v JOIN f ON v.place = f.place AND (f.ts < v.vts OR f.ts = v.vts AND f.id < v.vid) GROUP BY v.page_id
), j AS (
  SELECT v.vid, v.etag AS etag, v.day AS day, v.page_id, m.source_id, s.html AS s_html, s.etag AS s_etag, s.day AS s_day, s.page_id AS s_page,
    CASE WHEN m.source_id IS NULL THEN 'orphan' WHEN coalesce(v.etag = s.etag, v.day = s.day, true) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM v LEFT JOIN m USING (page_id) LEFT JOIN f s ON s.id = m.source_id
)
SELECT id AS record_id, 'full' AS outcome, cast(-1 AS BIGINT) AS source_id, 200 AS status,
  sha256(concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || strlen(html), 'content-type: text/html', 'etag: ' || etag, 'last-modified: ' || day, 'set-cookie: a=' || (page_id % 7), 'set-cookie: b=' || (page_id % 3))) AS headers_sha256,
  cast(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_sha256
FROM f
UNION ALL
SELECT vid, outcome, coalesce(source_id, -1), CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END,
  sha256(CASE WHEN outcome = 'resolved'
    THEN concat_ws(chr(10), 'cache-control: max-age=' || (page_id % 100), 'content-length: ' || strlen(s_html), 'content-type: text/html', 'etag: ' || coalesce(etag, s_etag), 'last-modified: ' || coalesce(day, s_day),
      CASE WHEN page_id % 2 = 0 THEN 'set-cookie: c=1' ELSE 'set-cookie: a=' || (s_page % 7) || chr(10) || 'set-cookie: b=' || (s_page % 3) END)
    ELSE concat_ws(chr(10), 'cache-control: max-age=' || (page_id % 100), 'content-length: 0', 'etag: ' || etag, 'last-modified: ' || day, CASE WHEN page_id % 2 = 0 THEN 'set-cookie: c=1' END) END),
  CASE WHEN outcome = 'resolved' THEN strlen(s_html) ELSE 0 END, sha256(CASE WHEN outcome = 'resolved' THEN s_html ELSE '' END)
FROM j
"""
