"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.llm.bpe import digests
from morphmill.llm.exact_dedup import exact_copies
from morphmill.llm.filter_audit import filter_audit
from morphmill.llm.line_dedup import repeated_runs
from morphmill.llm.mixing import mix_documents
from morphmill.llm.ngram_join import ngram_join
from morphmill.llm.pii import find_personal_data
from morphmill.llm.quality_classifier import classify
from morphmill.llm.quality_rules import quality_rules
from morphmill.llm.source_divergence import source_divergence
from morphmill.llm.substring_dedup import repeated_spans
from morphmill.llm.suffix_dedup import repeated_strings
from morphmill.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_bad", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), k=3, percent=90)


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(spans)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(_table(spark, sf_dir, "documents"), cut_long=True)
    return found.select("doc_id", _span_text("spans"), "removed_units", "removed_words", "removed_chars")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # segments of a few KB, so that about half of the pages have several
    return archive_round_trip(_table(spark, sf_dir, "pages"), segment_bytes=2048, chunk_bytes=1024)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_runs(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", _span_text("spans"), "removed_lines")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(_table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), least_docs=30, ranks=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality_rules": op2_quality_rules,
        "op3_pii": op3_pii,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_ngram_join": op5_ngram_join,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_bpe": op8_bpe,
        "op9_warc": op9_warc,
        "op10_line_dedup": op10_line_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_source_divergence": op13_source_divergence,
    }


OP2_COUNTS_SQL = r"""
d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)
), grams AS (
  SELECT r, pos, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)
), twice AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, word, second, third) AS n FROM grams WHERE third IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, pos + k AS p FROM twice, (VALUES (0), (1), (2)) AS s(k)) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dups
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counts AS (
  SELECT d.r, doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.dups, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines ON lines.r = d.r LEFT JOIN repeats ON repeats.r = d.r
)"""

OP2_SQL = (
    "WITH "
    + OP2_COUNTS_SQL
    + """, checked AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         n_words > 0 AND 3 * n_symbols > n_words AS symbols, n_words > 0 AND 2 * n_upper > word_chars AS capitals,
         n_words > 0 AND 2 * n_dup_lines > n_lines AS repeated_lines, n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words) AS word_length
  FROM counts
), fails AS (
  SELECT source, rule, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS f FROM (
    SELECT source, 'base' AS rule, base_failed AS failed FROM checked UNION ALL SELECT source, 'symbols', symbols FROM checked
    UNION ALL SELECT source, 'capitals', capitals FROM checked UNION ALL SELECT source, 'lines', repeated_lines FROM checked
    UNION ALL SELECT source, 'length', word_length FROM checked
  ) GROUP BY source, rule
), total AS (
  SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(n * n) AS squares, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM fails GROUP BY rule
), spread AS (
  SELECT *, m * (1 - m) AS noise, (q - docs * m * m - (hosts - 1) * m * (1 - m)) / greatest(docs - squares / docs, 1.0) AS between_hosts FROM total
), prior AS (
  SELECT rule, m, CASE WHEN noise <= 0 OR between_hosts <= noise / 1e6 THEN 1e6 ELSE greatest(noise / between_hosts - 1, 1.0) END AS strength FROM spread
), rates AS (
  SELECT source, n, m, strength, (f + strength * m) / (n + strength) AS rate FROM fails JOIN prior ON prior.rule = fails.rule
), hosts AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) > greatest(2 * m, 0.2)) AS host_bad FROM rates GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad,
       NOT (base_failed OR symbols OR capitals OR repeated_lines OR word_length OR host_bad) AS kept
FROM checked JOIN hosts ON checked.source IS NOT DISTINCT FROM hosts.source
"""
)

OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), w AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS winner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN winner END AS refers_to, false AS fault
FROM w
"""

OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), judged AS (
  SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), flags AS (
  SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN judged ON judged.id = w.doc_id
), tally AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
            || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed, good, toxic, count(*) AS n
  FROM flags GROUP BY ALL
), letters(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x
), steps AS (
  SELECT filter_order, step, substring(filter_order, step, 1) AS own, substring(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), judged_steps AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS only_this,
         before <> '' AND regexp_matches(failed, '[' || before || '.]') AS gone
  FROM steps, tally
), counted AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed,
         sum(n) FILTER (gone AND fails) AS redundant, sum(n) FILTER (only_this) AS unique_fails,
         sum(n) FILTER (NOT gone AND fails AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
  FROM judged_steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""

OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), places AS (
  SELECT r, unnest(range(0, length(x) // 2 - 199)) AS p FROM d WHERE length(x) >= 400
), strings AS (
  SELECT places.r, p, md5_number(substring(x, 2 * p + 1, 400)) AS m FROM places JOIN d ON d.r = places.r
), often AS (
  SELECT m FROM strings GROUP BY m HAVING count(*) > 1
), hits AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM strings WHERE m IN (FROM often)
), runs AS (
  SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM hits
), spans AS (
  SELECT r, run, min(p) AS s, max(p) + 200 AS e FROM runs GROUP BY r, run
), gaps AS (
  SELECT r, e AS s, lead(s) OVER (PARTITION BY r ORDER BY s) AS e FROM spans
  UNION ALL SELECT r, 0, min(s) FROM spans GROUP BY r
), kept AS (
  SELECT gaps.r, string_agg(substring(x, 2 * s + 1, 2 * (coalesce(e, length(x) // 2) - s)), '' ORDER BY s) AS k FROM gaps JOIN d ON d.r = gaps.r GROUP BY gaps.r
), removed AS (
  SELECT r, sum(e - s) AS n, count(*) AS spans FROM spans GROUP BY r
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN removed ON removed.r = d.r
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), terms AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS c FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v))::BIGINT AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang JOIN vocabulary v ON v.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, (1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v))::BIGINT AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term) k
  JOIN (SELECT lang, sum(c) AS n FROM counts GROUP BY lang) s ON s.lang = k.lang JOIN vocabulary v ON v.lang = k.lang
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), best AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM best)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": OP2_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op9_warc": OP9_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_suffix_dedup": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }
