"""Queries whose inputs take the branches that the other ones leave out, each with the DuckDB SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.functions import hangul as H
from tracksift.operators import extract, match, resolve, songs
from tracksift.operators import match as M
from tracksift.plans import queries as base
from tracksift.plans.oracle import MATCH, SONGS
from tracksift.session import table

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        _ALL[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Hangul names


def _hangul(k: Column) -> Column:
    """A word of three syllables for each number."""
    return F.concat(*[F.decode(F.unhex(F.lpad(F.hex((F.lit(44032) + (k * 7919 * (i + 1) + i * 613) % 11172).cast("long")), 8, "0")), "UTF-32") for i in range(3)])


#: Each syllable by its letters' numbers; a letter's spelling depends on its neighbours.
_SPELT = f"""sy AS (SELECT p_partkey, i, CAST((p_partkey::BIGINT * 7919 * (i + 1) + i * 613) % 11172 AS INT) AS c FROM part, range(3) r(i)),
le AS (SELECT *, c // 588 AS f, c % 588 // 28 AS m, c % 28 AS l FROM sy),
so AS (SELECT *, {_list(H.LAST)}[l + 1] AS snd, lag({_list(H.LAST)}[l + 1]) OVER (PARTITION BY p_partkey ORDER BY i) AS bef, lead(f) OVER (PARTITION BY p_partkey ORDER BY i) AS aft FROM le),
na AS (SELECT *, CASE snd WHEN 'k' THEN 'ng' WHEN 't' THEN 'n' WHEN 'p' THEN 'm' ELSE snd END AS nasal FROM so),
sp AS (SELECT p_partkey, string_agg(CASE WHEN f = 5 AND bef IN ('l', 'n') THEN 'l' WHEN f = 5 AND bef <> '' THEN 'n' WHEN f = 2 AND bef = 'l' THEN 'l' ELSE {_list(H.FIRST)}[f + 1] END || {_list(H.MIDDLE)}[m + 1]
  || CASE WHEN aft = 11 THEN {_list(H.CARRIED)}[l + 1] WHEN aft IN (2, 6) THEN nasal WHEN aft = 5 AND snd = 'n' THEN 'l' WHEN aft = 5 THEN nasal ELSE snd END, '' ORDER BY i) AS spelt, string_agg(chr(44032 + c), '' ORDER BY i) AS word FROM na GROUP BY p_partkey)"""


@query(f"WITH {_SPELT} SELECT p_partkey, word, spelt FROM sp")
def hangul_spellings(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select("p_partkey", _hangul(F.col("p_partkey")).alias("word"))
    return own.select("p_partkey", "word", H.romanised(F.col("word")).alias("spelt"))


@query(f"WITH {_SPELT} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'artist_romanization_match' ELSE '' END AS evidence, p_partkey % 2 = 1 AS none, p_partkey % 2 = 0 AS romanised FROM sp")
def romanised_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Songs of Hangul artists and tracks with another title, half of them by the artist in Latin capitals: only that ties them."""
    own = table(spark, sf, "part").withColumn("artist", _hangul(F.col("p_partkey")))
    latin = F.when(F.col("p_partkey") % 2 == 0, F.upper(H.romanised(F.col("artist")))).otherwise("0123456789")
    rows = own.select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), "artist", F.col("p_partkey").alias("track_id"), F.lit("77 88").alias("name"), latin.alias("artist_name"),
        F.lit(1).alias("popularity"), F.lit(1).alias("api_rank"), F.lit(False).alias("has_image"),
    )
    out = match.evidence_gate(resolve.scored(resolve.paired(rows)))
    return out.select(F.col("song_id").alias("p_partkey"), F.array_join("matched_evidence", ",").alias("evidence"), F.col("no_evidence").alias("none"), "romanised")


# decisions, with what they rest on

_HOLDS = "len(list_filter({words}, lambda w: contains(name || ' ' || cn, w))) > 0"


@query(f"""WITH RECURSIVE {MATCH}, x AS (SELECT *, artist IS NOT NULL AS given, {_HOLDS.format(words=_list(M.NON_ORIGINAL_WORDS))} AS other, {_HOLDS.format(words=_list(M.ACCEPTABLE_WORDS))} OR p_versions > 0 AS version,
  len(t_tok) <= 2 AND t >= 0.8 AND a < 0.45 AND NOT a_alias AND (len(string_split(title, ' ')) = 1 OR len(n_tok) >= len(t_tok) + 3) AS short FROM ev),
y AS (SELECT *, CASE WHEN status = 'invalid_candidate' THEN 'invalid_candidate' WHEN other THEN 'non_original_audio' WHEN given AND a >= 0.85 AND t < 0.55 THEN 'artist_only_overconfidence' WHEN given AND t >= 0.85 AND a < 0.45 THEN 'title_only_overconfidence'
  WHEN short THEN 'short_title_false_positive' WHEN version THEN 'version_candidate' WHEN evidence_score >= 0.82 THEN 'matched' WHEN t < 0.4 AND (NOT given OR a < 0.4) THEN 'weak_title_and_artist' WHEN t < 0.45 THEN 'title_mismatch'
  WHEN given AND a < 0.45 THEN 'artist_mismatch' WHEN evidence_score >= 0.55 THEN 'partial_match_needs_review' ELSE 'low_score' END AS reason FROM x)
SELECT song_id, track_id, pattern, evidence_score, reason, CASE WHEN status = 'matched' THEN '' WHEN contains(reason, 'non_original') OR reason = 'version_candidate' THEN 'non_original' WHEN contains(reason, 'title') THEN 'low_title_sim' WHEN contains(reason, 'artist') THEN 'low_artist_sim' ELSE reason END AS rejection,
  t AS title_score, a AS artist_score FROM y""")
def match_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of every song with what the decision on it rests on."""
    q = F.concat_ws(" ", "title", "artist")
    rows = base.scored(spark, sf).withColumns({"query_no": F.lit(0), "reliability": match.reliability(q, F.col("title"), F.col("artist"), F.lit(True)), "query_has_both": match.query_has_both(q, F.col("title"), F.col("artist"))})
    rows = match.explain(match.final_status(resolve.with_evidence(match.signal(match.evidence_gate(rows)))))
    e = lambda c: F.col(f"explain.{c}")
    return rows.select("song_id", "track_id", e("pattern"), e("evidence_score"), e("reason"), e("rejection_reason").alias("rejection"), e("title_score"), e("artist_score"))


# what a model reads and answers


@query(f"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n'), lambda x: trim(x)), lambda x: x <> '') AS bs FROM documents),
e AS (SELECT doc_id, unnest(bs[:{extract.MODEL_BLOCKS}]) AS block, unnest(range(len(bs[:{extract.MODEL_BLOCKS}]))) AS block_no FROM b) SELECT doc_id, CAST(block_no AS INT) AS block_no, md5(block) AS block_md5, length(block) AS chars FROM e""")
def model_blocks(spark: SparkSession, sf: str) -> DataFrame:
    own = extract.model_input(table(spark, sf, "documents"))
    return own.select("doc_id", "block_no", F.md5("block").alias("block_md5"), F.length("block").cast("long").alias("chars"))


@query(f"""WITH {SONGS}, v AS (SELECT DISTINCT doc_id FROM songs)
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'llm' ELSE 'rule' END AS source, CASE doc_id % 4 WHEN 0 THEN 'title_artist' WHEN 2 THEN 'per_line' ELSE 'artist_title' END AS direction, CASE doc_id % 4 WHEN 0 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END AS confidence FROM v""")
def model_directions(spark: SparkSession, sf: str) -> DataFrame:
    """A reply that is known, one that isn't, one with an unknown confidence, and none."""
    pairs = songs.parsed(base.tracklists(spark, sf)).where("separator is not null")
    d = F.col("doc_id") % 4
    replies = pairs.select("doc_id").distinct().where(d < 3)
    replies = replies.select("doc_id", F.when(d == 0, " Title_Artist ").when(d == 1, "backwards").otherwise("PER_LINE").alias("direction"), F.when(d == 0, "Medium").otherwise("sure").alias("confidence"))
    return extract.model_direction(pairs, replies).select("doc_id", "source", "direction", "confidence")


@query("""WITH d AS (SELECT p_partkey // 10 AS doc_id, p_partkey // 10 % 4 AS kind, count(*) AS n, count(DISTINCT p_name || p_brand) AS songs FROM part GROUP BY 1, 2)
SELECT doc_id, kind < 3 AS rule_first, CASE WHEN kind < 3 THEN 'rule_based' ELSE 'llm' END AS method, true AS success, songs FROM d WHERE n >= 5""")
def extraction_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Ten songs a document, written with times, with delimiters only, as blocks of three lines, and as prose that only the model's reply reads."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    n, kind = (k % 10).cast("int"), F.floor(k / 10) % 4
    pair = F.concat("p_brand", F.lit(" - "), "p_name")
    at = F.concat(F.lit("0"), n.cast("string"), F.lit(":00"))
    prose = F.concat(F.lit("we then heard "), "p_name", F.lit(" which was by "), "p_brand", F.lit(" and it was really quite good"))
    text = F.when(kind == 0, F.concat(at, F.lit(" "), pair)).when(kind == 1, pair).when(kind == 2, F.concat_ws("\n", at, F.col("p_name"), F.col("p_brand"))).otherwise(prose)
    own = p.select(F.floor(k / 10).cast("long").alias("doc_id"), n.alias("line_no"), text.alias("raw_line"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    docs = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))), lambda x: x.raw_line), "\n").alias("text"), F.count("*").alias("n")).where("n >= 5").drop("n")
    found, verdicts = extract.extract(docs, own)
    counted = found.groupBy("doc_id").agg(F.count("*").alias("songs"))
    return verdicts.join(counted, "doc_id").select("doc_id", "rule_first", "method", "success", "songs")
