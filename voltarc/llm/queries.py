"""One query per operator over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltarc.llm import (bpe, decontaminate, language_id, near_dedup, perplexity, pii,
                         quality_rules, resample, spelling, suffix_dedup, toxicity, url_filter, warc)
from voltarc.llm.common import table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


CATEGORIES = ["low_quality", "toxic"]


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's categories: low quality, then toxic."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, labels_of(spark, sf_dir), CATEGORIES)
    return toxicity.classify(docs, chain).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.fit(docs.where(bucket != 2))  # rows without an id teach nothing
    return (language_id.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"),
                    "lang_pred", "score", "ambiguous"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeated(docs).drop("text", "removed")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contaminated(docs, items).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity.judge(docs, trusted)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).drop("url")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs).select("doc_id", "pii_spans")
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k))
    return found.select("doc_id", *[count(k).cast("long").alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.joined(kinds=pii.BASE), 256).alias("base_sha256"),
                        pii.joined().alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs, misspell=31))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder)
    return warc.read_archives(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "benchmark").select("text")
    return resample.resampled(docs, target)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_language_id, op3_near_dedup, op4_suffix_dedup,
                            op5_decontaminate, op6_quality_rules, op7_bpe, op8_perplexity,
                            op9_url_filter, op10_pii, op11_spelling_variants, op12_warc,
                            op13_resample)}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLE_SQL: dict[str, str] = {
    "op9_url_filter": f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES}),
p AS (SELECT page_id, CASE WHEN contains(url, '://')
             THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT q.*, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC,
                                length(rhost) DESC, rverdict DESC) AS k
      FROM q LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost))
                            AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM r WHERE k = 1""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i + 1 : i + least(len(w), 13)] AS g
        FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i
              FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, w[i + 1 : i + n] AS g
        FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
              FROM d, lens WHERE len(w) >= n)),
met AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100
             THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q""",
}
