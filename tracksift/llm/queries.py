"""Queries of the corpus operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.llm import decontaminate, fingerprint, html_text, line_dedup, mixing, near_dup, passages, pii, quality, spelling, token_file, toxicity, whitening
from tracksift.session import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "kinds", "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "e")
    out = out.select("vec_id", "n", "deviation", "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("print")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprint.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op12_spelling": OP12_SQL}


#: Runs of two lines or more: a pair of neighbouring lines that stood before goes, but for lines of a pair that stands for the first time.
OP1_SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM cut),
w AS (SELECT doc_id, no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS nxt FROM l),
f AS (SELECT doc_id, no, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, no) AS k, count(*) OVER (PARTITION BY line, nxt) AS n FROM w WHERE nxt IS NOT NULL),
each AS (SELECT doc_id, unnest([no, no + 1]) AS no, k = 1 AS stays FROM f WHERE n > 1),
hit AS (SELECT doc_id, no FROM each GROUP BY doc_id, no HAVING NOT bool_or(stays)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(hit.no) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE hit.no IS NULL), '') AS t
  FROM l LEFT JOIN hit ON l.doc_id = hit.doc_id AND l.no = hit.no GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(t) AS n_chars, md5(t) AS text_md5 FROM kept
"""

#: The CRC is taken byte by byte from its table; words one error apart share what is left without one letter.
OP12_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 7 GROUP BY ALL),
bytes AS (SELECT w, n, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64] END)) AS b FROM own),
hashed AS (SELECT w, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, (list(near ORDER BY near_n DESC, near))[1] AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS further FROM forms
  UNION ALL SELECT c.word, c.further, f.form FROM chain c JOIN forms f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.further IS NULL
"""
