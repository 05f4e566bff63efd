"""The registered queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import bpe, codebooks, forest, infill, jaccard, licenses, linededup, lm, ordermin, packing, quality, repeats, warc
from creditloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query
def op1_bpe(spark, sf):
    coded = bpe.encode_decode(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op10_packing(spark, sf):
    pieces = packing.pack(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_warc(spark, sf):
    records = warc.read_archives(warc.write_archives(table(spark, sf, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op9_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q
"""


@query
def op7_quality(spark, sf):
    judged = quality.judge(documents(spark, sf), measures=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE["op7_quality"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), runs AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS w FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN covered ON covered.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT *, NOT (base_failed OR word_chars > n_words * 25 OR word_chars < n_words * 2 - n_words / 2.0
               OR n_symbols > n_words OR n_dup_lines * 4 > n_words) AS kept
FROM b
"""


@query
def op3_order_minhash(spark, sf):
    rows = ordermin.fingerprints(documents(spark, sf))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.array_join("fingerprint", " ").alias("fingerprint"),
        F.array_join("edited_fingerprint", " ").alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op4_licenses(spark, sf):
    return licenses.scan(documents(spark, sf))


@query
def op6_line_dedup(spark, sf):
    rows = linededup.dedup_runs(documents(spark, sf))
    return rows.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_jaccard(spark, sf):
    return jaccard.groups(documents(spark, sf))


@query
def op5_repeats(spark, sf):
    rows = repeats.dedup(documents(spark, sf))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op2_lm(spark, sf):
    return lm.score_texts(documents(spark, sf))


@query
def op12_infill(spark, sf):
    rows = infill.transform(documents(spark, sf))
    restored = infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                       F.sha2(F.encode(restored, "UTF-8"), 256).alias("restored_sha256"))


ORACLE["op12_infill"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), d AS (
  SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
         array_to_string(tokens[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query
def op11_codebooks(spark, sf):
    rows = codebooks.encode(table(spark, sf, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.sha2(F.encode("codebooks", "UTF-8"), 256).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int = codebooks.ROUNDS) -> str:
    """Lloyd's rounds in SQL, one pair of steps for each round."""
    distance = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - e.v[i]) * (x.v[i] - e.v[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT x.row, x.p, x.v, min({{'d': {distance}, 'e': e.e}}) AS best FROM x JOIN book{k} e ON x.p = e.p GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT b.p, b.e, b.i, coalesce(floor(u.total / u.n)::HUGEINT, b.c) AS m
    FROM (SELECT p, e, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM book{k}) b
    LEFT JOIN (
      SELECT p, best.e AS e, i, sum(c)::HUGEINT AS total, count(*) AS n
      FROM (SELECT p, best, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY ALL
    ) u ON u.p = b.p AND u.e = b.e AND u.i = b.i
  ) GROUP BY p, e
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 4096)::HUGEINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (
  SELECT row, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS v FROM kept, range(8) AS parts(p)
), book0 AS (SELECT p, row - 1 AS e, v FROM x WHERE row <= 16),
{", ".join(steps)},
coded AS (
  SELECT kept.row, vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM kept JOIN near{rounds} USING (row) GROUP BY ALL
), books AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM book{rounds})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


ORACLE["op11_codebooks"] = _lloyd_sql()


@query
def op13_forest(spark, sf):
    return forest.groups(documents(spark, sf))
