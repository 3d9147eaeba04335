"""The subpackage's queries, (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from lectern.llm import ann, decontaminate, html_extract, near_dedup, pack, quality, secrets, suffix_dedup, surrogates, warc
from lectern.llm.common import read


def tokenizer_path() -> str:
    """The vocabulary file of op9: LECTERN_TOKENIZER, or the installed public one."""
    if path := os.environ.get("LECTERN_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_secrets(spark, sf_dir):
    return secrets.secret_digests(read(spark, sf_dir, "documents"))


def op4_nearest(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op5_main_text(spark, sf_dir):
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op6_quality(spark, sf_dir):
    return quality.rated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_surrogates(spark, sf_dir):
    return surrogates.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.session_key(spark))


def op8_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_packing(spark, sf_dir):
    return pack.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_repeats(spark, sf_dir):
    return suffix_dedup.repeat_digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_secrets, op4_nearest, op5_main_text, op6_quality, op7_surrogates, op8_warc, op9_packing, op10_repeats)}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM benchmark),
bw AS (SELECT item, least(8, len(ws)) AS n, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, list_slice(ws, i, i + n - 1) AS w FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s.n, ws, unnest(range(1, len(ws) - s.n + 2)) AS i FROM d CROSS JOIN sizes s WHERE len(ws) >= s.n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON win.n = dw.n AND list_slice(dw.ws, dw.i, dw.i + dw.n - 1) = win.w),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, octet_length(b) AS n, h, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM f""",
}
