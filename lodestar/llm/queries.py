"""The registered queries of the ten operators and of the pipeline, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, language, lm_score, packing, pii, quality, simhash, token_counts, toxicity, warc
from lodestar.llm.common import read, spread

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spread(read(spark, sf_dir, "pages")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    scores = F.concat_ws(",", F.transform("scores", lambda x: x.cast("string")))  # one of each span, in order
    return found.withColumn("scores", scores)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op5 that SQL can express."""
    return pii.find(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7 that SQL can express."""
    return quality.measure(documents(spark, sf_dir)).select("doc_id", *quality.COUNTS[:5])


def base_token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of op9's texts."""
    return token_counts.count_tokens(documents(spark, sf_dir)).select("doc_id", "n_bytes")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (base_pii, base_quality, base_token_bytes, op1_decontaminate, op2_simhash, op3_toxicity, op4_warc, op5_pii, op6_lm_score, op7_quality, op8_language, op9_token_counts, op10_packing)}


#: op4: DuckDB has no base 32, so the digest's hex is turned five bits at a time.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_reduce(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), lambda a, c: a || c) AS bits,
             min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT) + 1, 1)), lambda a, c: a || c) AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

#: op1: every window of ten words, word by word; a document's words are hit by any of them.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, lens)),
hit AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: op5: matches of each kind, then the contract's tests on their digits.
PII_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
        regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
        list_transform(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS card,
        list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS BIGINT), 999) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN x[i]::INT WHEN x[i]::INT > 4 THEN 2 * x[i]::INT - 9 ELSE 2 * x[i]::INT END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM m
"""

#: op7: words, their windows of five by place, and lines by their order.
QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT r, s, w[s : s + 4] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS s FROM w)),
often AS (SELECT r, s FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 5)) AS p FROM often) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
"""

BYTES_SQL = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_warc": OP4_SQL, "base_pii": PII_SQL, "base_quality": QUALITY_SQL, "base_token_bytes": BYTES_SQL}
