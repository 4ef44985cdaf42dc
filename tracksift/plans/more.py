"""More queries over the driver's tables: single functions over decorated names, and the operators around the main flow.

Each stands with the DuckDB SQL that states its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.operators import context, dedup, extract, feedback, match, media, playlist, resolve, songs
from tracksift.plans import queries as base
from tracksift.plans.oracle import MATCH
from tracksift.session import table
from tracksift.sources import landed

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


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def _both(*parts: str) -> Column:
    """Texts and columns (names with p_) put together."""
    return F.concat(*[F.col(p) if p.startswith("p_") else F.lit(p) for p in parts])


@query("SELECT p_partkey, p_brand || ',Zed' AS credits FROM part")
def title_credits(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).select("p_partkey", F.array_join(X.credits_of(_both("p_name", " (Feat. ", "p_brand", " & Zed)")), ",").alias("credits"))


@query("SELECT p_partkey, p_name || ' (Live!)' AS a, p_name AS b, 2 AS n FROM part")
def title_spellings(spark: SparkSession, sf: str) -> DataFrame:
    v = X.title_variants(_both("p_name", " (Live!)"))
    return _part(spark, sf).select("p_partkey", F.get(v, F.lit(0)).alias("a"), F.get(v, F.lit(1)).alias("b"), F.least(F.size(v), F.lit(2)).alias("n"))


@query("SELECT p_partkey, p_name AS base, upper(p_name) AS folded, lower(p_name) || '|||' || lower(p_brand) AS id FROM part")
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.translate(F.upper(F.col("p_name")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return _part(spark, sf).select("p_partkey", X.base_title(_both("p_name", " (Live) [2024]")).alias("base"), X.nfkc(wide).alias("folded"), X.match_id(_both(" ", "p_name", " "), F.col("p_brand")).alias("id"))


@query("SELECT p_partkey, p_brand AS first, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM part")
def artist_names(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("p_partkey") % 2 == 0, _both("p_brand", ", Zed")).otherwise(_both("p_brand", " (kr)"))
    return _part(spark, sf).select("p_partkey", X.search_artist(a).alias("first"), F.size(X.artist_parts(a)).alias("n"))


@query("SELECT p_partkey, p_brand || ', Zed' AS names, '[TITLE]' || chr(10) || p_name || chr(10) || '[ARTIST]' || chr(10) || p_brand AS labelled, '1:00 ' || p_name || ' | ' || p_brand AS line FROM part")
def name_joins(spark: SparkSession, sf: str) -> DataFrame:
    people = F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.lit("Zed ").alias("name")))
    return _part(spark, sf).select("p_partkey", X.join_names(people).alias("names"), X.labelled(title=F.col("p_name"), mood=F.lit(" "), artist=F.col("p_brand")).alias("labelled"), X.line_format(_both("[1:00] ", "p_name", " ㅣ ", "p_brand")).alias("line"))


@query("SELECT p_partkey, p_name || ' (a - b)' AS \"left\", p_brand AS \"right\", CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ' - ' END AS separator FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 0")
def bracketed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, _both("p_name", " [x - y]")).otherwise(_both("p_name", " (a - b) - ", "p_brand"))
    own = _part(spark, sf).select("p_partkey", songs.pair_parts(line).alias("p"))
    return own.select("p_partkey", *[F.when(F.col("p.separator").isNotNull(), F.col(f"p.{c}")).alias(c) for c in ("left", "right", "separator")])


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'made_popular_by' WHEN p_partkey % 4 = 1 THEN 'karaoke' WHEN p_partkey % 4 = 2 THEN 'live' ELSE 'official_track' END AS kind, p_partkey % 4 <> 3 AS other FROM part")
def candidate_types(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, _both("p_name", " (Made Popular by Zed)")).when(k == 1, _both("p_name", " Karaoke")).when(k == 2, _both("p_name", " live")).otherwise(F.col("p_name"))
    kind = match.candidate_type(name, F.col("p_brand"))
    return _part(spark, sf).select("p_partkey", kind.alias("kind"), (kind != "official_track").alias("other"))


@query("SELECT p_partkey, 'track:\"' || p_name || '\" artist:\"' || p_brand || '\"' AS q1, p_name || ' ' || p_brand AS q2, 'high' AS r1, 'medium' AS r2, true AS has FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name, NULL, 'low', NULL, true FROM part WHERE p_partkey % 2 = 1")
def case_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Search queries of each part's name, under its brand or alone, and what each query is worth."""
    own = _part(spark, sf).withColumn("artist", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).withColumn("q", match.queries(F.col("p_name"), F.col("artist")))
    q = lambda i: F.get("q", F.lit(i))["query"]
    worth = lambda i: F.when(q(i).isNotNull(), match.reliability(q(i), F.col("p_name"), F.col("artist"), F.lit(i == 0)))
    return own.select("p_partkey", q(0).alias("q1"), q(1).alias("q2"), worth(0).alias("r1"), worth(1).alias("r2"), match.query_has_both(q(0), F.col("p_name"), F.col("artist")).alias("has"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'high' WHEN length(split_part(p_name, ' ', 1)) <= 5 AND length(split_part(p_name, ' ', 2)) <= 5 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN p_partkey % 10 < 3 THEN 'confirmed_wrong' WHEN p_partkey % 10 < 5 AND p_partkey % 10 / 10.0 < 0.45 THEN 'ambiguous' ELSE 'partial' END AS severity, greatest(0.0, (5 - p_partkey % 7) / 5.0)::DOUBLE AS rank_score FROM part")
def title_risks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, F.get(F.split(F.col("p_name"), " "), F.lit(0))).otherwise(F.col("p_name"))
    return _part(spark, sf).select("p_partkey", match.collision_risk(title).alias("risk"), match.mismatch_severity(k % 10 / 10).alias("severity"), match.rank_score(k % 7 + 1).alias("rank_score"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS suspicious, p_partkey % 2 = 0 OR p_partkey % 5 = 0 AS has_id FROM part")
def song_filters(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 6 == 0, F.lit(" ")).when(k % 3 == 0, F.upper(F.col("p_brand"))).otherwise(F.col("p_name"))
    ids = F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z")))
    return _part(spark, sf).select("p_partkey", match.suspicious_song(title, F.col("p_brand")).alias("suspicious"), match.has_artist_id(ids, F.when(k % 5 == 0, "").otherwise("y")).alias("has_id"))


@query("SELECT DISTINCT 'the ' || lower(replace(p_brand, '#', ' ')) AS artist, p_brand AS artist_id, 0.92::DOUBLE AS score FROM part WHERE length(p_brand) > 7 OR p_brand = 'Brand#0'")
def artist_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Names with an article, looked up among the brands; the names of one digit are parts of longer ones, so only one of them is asked for."""
    p = _part(spark, sf).select(F.col("p_brand").alias("name")).distinct()
    artists = p.select(F.col("name").alias("artist_id"), "name", F.lit(1).alias("popularity"))
    asked = p.where("length(name) > 7 or name = 'Brand#0'").select(F.concat(F.lit("the "), F.lower(F.replace("name", F.lit("#"), F.lit(" ")))).alias("artist"))
    return match.artist_ids(asked, artists)


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand has a Hangul name of its own."""
    p = _part(spark, sf).select(F.col("p_brand").alias("alias")).distinct()
    return p.select(F.concat(F.lit("가수"), F.regexp_extract("alias", r"(\d+)", 1)).alias("canonical"), "alias")


@query("SELECT p_partkey, true AS match, '가수' || regexp_extract(p_brand, '\\d+') AS canonical FROM part")
def alias_matches(spark: SparkSession, sf: str) -> DataFrame:
    """A song under an artist's Hangul name meets tracks under the other name, through the alias groups."""
    aliases = _aliases(spark, sf)
    groups = match.alias_groups(aliases)
    own = _part(spark, sf).select("p_partkey", F.concat(F.lit("가수"), F.regexp_extract(F.col("p_brand"), r"(\d+)", 1)).alias("artist"), F.col("p_brand").alias("other"))
    keyed = own.withColumn("alias_key", X.artist_key(F.col("artist"))).join(groups, "alias_key", "left")
    hit = keyed.select("p_partkey", "other", F.arrays_overlap("keys", F.array(X.artist_key(F.col("other")))).alias("match"))
    return resolve.canonical(hit, resolve.alias_keys(aliases), "other").select("p_partkey", "match", F.col("other_canonical").alias("canonical"))


@query("SELECT min(p_partkey) AS song_id, min(p_partkey) AS track_id, 'matched' AS match_status, 'EXACT' AS kind FROM part GROUP BY p_name, p_brand")
def match_by_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Every song of a part under its brand's Hangul name finds the part, at the first query."""
    p = _part(spark, sf).groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"), F.max("p_size").alias("popularity"))
    wanted = p.select(F.col("id").alias("song_id"), F.col("p_name").alias("title"), F.concat(F.lit("가수"), F.regexp_extract(F.col("p_brand"), r"(\d+)", 1)).alias("artist"))
    cat = p.select(F.col("id").alias("track_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist_name"), "popularity", F.lit(True).alias("has_image"))
    return match.match_batch(wanted, cat, _aliases(spark, sf)).select("song_id", "track_id", "match_status", F.when(F.col("evidence_score") >= 0.85, "EXACT").alias("kind"))


@query("SELECT p_partkey AS song_id, first AS track_id, CASE WHEN p_partkey % 4 = 0 THEN 'suspicious_song' ELSE 'matched' END AS reason FROM (SELECT *, CASE WHEN p_partkey % 4 > 0 THEN min(p_partkey) OVER (PARTITION BY p_name, p_brand) END AS first FROM part)")
def match_songs_once(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as songs: those with one key are matched once and share the track; those under their own name aren't songs."""
    p = _part(spark, sf)
    cat = p.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("artist_name")).agg(F.min("p_partkey").alias("track_id"), F.max("p_size").alias("popularity")).withColumn("has_image", F.lit(True))
    wanted = p.select(F.col("p_partkey").alias("song_id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"))
    out = match.match_batch(wanted, cat)
    return out.select("song_id", "track_id", F.when(F.col("match_status") == "matched", "matched").otherwise(F.col("reason")).alias("reason"))


@query(f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, array_to_string(list_filter([CASE WHEN a_alias THEN 'artist_alias_match' END, CASE WHEN t >= 0.55 THEN 'title_direct_match' END, CASE WHEN overlap > 0 THEN 'token_overlap' END], lambda x: x IS NOT NULL), ',') AS evidence, NOT (a_alias OR t >= 0.55 OR overlap > 0) AS none FROM ev0")
def evidence_gates(spark: SparkSession, sf: str) -> DataFrame:
    return match.evidence_gate(base.scored(spark, sf)).select("song_id", "track_id", F.array_join("matched_evidence", ",").alias("evidence"), F.col("no_evidence").alias("none"))


@query(f"""WITH RECURSIVE {MATCH}, s0 AS (SELECT *, CASE WHEN artist IS NULL THEN 'low' ELSE 'high' END AS rel, t >= 0.72 OR t_alias AS tok, artist IS NULL OR a >= 0.6 OR a_alias AS aok FROM ev0),
s1 AS (SELECT *, CASE WHEN api_rank <> 1 THEN 'not_rank1' WHEN rel = 'low' THEN 'low_query_reliability' WHEN t >= 0.95 AND artist IS NOT NULL AND a < 0.45 AND NOT a_alias THEN 'title_exact_artist_mismatch' WHEN a >= 0.95 AND t < 0.35 AND NOT t_alias THEN 'artist_exact_title_mismatch'
  WHEN t >= 0.95 AND artist IS NOT NULL AND NOT aok THEN 'possible_same_title_different_artist' WHEN NOT (tok OR aok OR overlap > 0) THEN 'no_explainable_title_or_artist_evidence' ELSE '' END AS blocked FROM s0)
SELECT song_id, track_id, blocked, CASE WHEN blocked = '' AND (aok OR tok) THEN 0.22 ELSE 0.0 END::DOUBLE AS signal FROM s1""")
def search_signals(spark: SparkSession, sf: str) -> DataFrame:
    q = F.concat_ws(" ", "title", "artist")
    rows = base.scored(spark, sf).withColumn("reliability", match.reliability(q, F.col("title"), F.col("artist"), F.lit(True))).withColumn("query_has_both", match.query_has_both(q, F.col("title"), F.col("artist")))
    return match.signal(rows).select("song_id", "track_id", F.col("signal_blocked").alias("blocked"), F.col("signal_score").alias("signal"))


@query(f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, status AS match_status, CASE status WHEN 'review_needed' THEN 'low_confidence' ELSE status END AS ui_status, CASE status WHEN 'invalid_candidate' THEN 'rejected' WHEN 'matched' THEN 'selectable' ELSE 'warning' END AS decision FROM ev")
def final_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return match.final_status(resolve.with_evidence(base.scored(spark, sf))).select("song_id", "track_id", "match_status", "ui_status", "decision")


@query("SELECT lower(p_name) || '|||' || lower(p_brand) AS key, arg_max(p_partkey, p_partkey) AS track_id, count(*) AS confirmations FROM part GROUP BY 1")
def confirmed_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The even parts confirmed first, then the odd ones."""
    own = _part(spark, sf).select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_partkey").alias("track_id"), F.col("p_partkey").alias("at"))
    before = match.confirmed(None, own.where("track_id % 2 = 0"))
    return match.confirmed(before, own.where("track_id % 2 = 1")).drop("at")


@query("SELECT p_partkey, (p_partkey % 5) % 2 = 0 AS hit, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN 0.88 ELSE 0.4 END::DOUBLE AS evidence_score FROM part")
def audio_id_boost(spark: SparkSession, sf: str) -> DataFrame:
    own = _part(spark, sf).select("p_partkey", F.col("p_partkey").alias("song_id"), F.col("p_partkey").alias("track_id"), F.lit(0.7).alias("title_score"), F.lit(0.5).alias("artist_score"), F.lit(0.4).alias("evidence_score"), F.lit("review_needed").alias("status"))
    ids = own.select("song_id", F.when(F.col("song_id") % 5 % 2 == 0, F.col("song_id")).otherwise(F.lit(-1)).alias("track_id"))
    out = resolve.with_audio_id(own, ids)
    return out.select("p_partkey", (F.col("status") == "matched").alias("hit"), "evidence_score")


@query("SELECT p_partkey, p_brand AS artist, p_name AS title FROM part")
def comma_titles(spark: SparkSession, sf: str) -> DataFrame:
    own = _part(spark, sf).select("p_partkey", F.lit(None).cast("string").alias("artist"), _both("p_name", " , ", "p_brand").alias("title"))
    return songs.comma_artist(own).select("p_partkey", "artist", "title")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS artist FROM part")
def playlist_artists(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 2 == 0, _both("[", "p_name", "] 노래모음")).otherwise(F.lit("best playlist"))
    return _part(spark, sf).select("p_partkey", context.artist_of_title(t).alias("artist"))


@query("SELECT doc_id, rule_first, method, success FROM (SELECT DISTINCT p_partkey // 100 AS doc_id, false AS rule_first, 'rule_based' AS method, true AS success FROM part)")
def extraction_routes(spark: SparkSession, sf: str) -> DataFrame:
    """A model's reply that is one song a document falls short, so the rules' songs stand."""
    docs = base.tracklist_docs(spark, sf)
    reply = base.tracklists(spark, sf).select("doc_id", "line_no", F.lit("Model").alias("artist"), F.lit("Reply").alias("title"), F.col("line").alias("raw_line"))
    return extract.extract(docs, reply)[1].select("doc_id", "rule_first", "method", "success")


@query("SELECT p_partkey // 4 AS doc_id, count(*) AS songs, 'llm' AS method FROM part GROUP BY 1 HAVING count(*) >= 3")
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Prose that names songs: rules find none, and the model's reply stands where its lines are in the text."""
    own = _part(spark, sf).select(F.floor(F.col("p_partkey") / 4).cast("long").alias("doc_id"), (F.col("p_partkey") % 4).cast("int").alias("line_no"), _both("we then heard ", "p_name", " which was by ", "p_brand", " and it was really quite good").alias("raw_line"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    docs = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))), lambda x: x.raw_line), "\n").alias("text"))
    reply = own.select("doc_id", "line_no", F.concat(F.col("artist"), F.lit(" ("), "line_no", F.lit(")")).alias("artist"), F.concat(F.col("title"), F.lit(" "), "line_no").alias("title"), "raw_line")
    reply = reply.unionByName(reply.withColumn("raw_line", F.lit("not in the text")).withColumn("line_no", F.lit(9)))
    got = extract.extract(docs, reply)[0].where("method = 'llm'")
    return got.groupBy("doc_id").agg(F.count("*").alias("songs"), F.first("method").alias("method"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'acr' WHEN 2 THEN 'text' ELSE 'text' END AS mode, CASE p_partkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'playlist' END AS name FROM part")
def request_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    mode = F.when(k % 4 == 0, " Video ").when(k % 4 == 1, "audio").when(k % 4 == 2, "").otherwise("nonsense")
    return _part(spark, sf).select("p_partkey", extract.mode(mode).alias("mode"), extract.confidence(F.when(k % 3 == 0, "HIGH").otherwise("sure")).alias("confidence"), extract.playlist_name(F.lit(" "), F.when(k % 2 == 0, F.col("p_name"))).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The music is machine-made and not in the catalogue.' WHEN 1 THEN 'No frame holds any text; the list may not be on the screen.' WHEN 2 THEN 'The audio is not in the recognition catalogue.' ELSE 'No songs were found in the text; try ocr.' END AS said FROM part")
def failure_messages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = extract.message(F.when(k == 1, "ocr").when(k == 2, "acr").otherwise("text"), F.when(k == 1, "no_text_frame").when(k == 2, "not_in_db"), k == 0, F.when(k == 3, "ocr"))
    return _part(spark, sf).select("p_partkey", said.alias("said"))


@query("SELECT o_custkey AS playlist_id, arg_min(o_orderkey, o_orderdate || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS item_id FROM orders GROUP BY 1")
def first_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("playlist_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("position"))
    return extract.first_item(items)


@query("SELECT event_id AS id, event_type AS title, 'question' AS category, CASE WHEN event_id % 4 = 0 THEN 'answered' ELSE 'waiting' END AS status, CASE WHEN event_id % 4 = 0 THEN 'a' || event_id END AS answer FROM events WHERE event_id % 2 = 0 AND event_id % 10 <> 0")
def qa_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts inserted (odd ones lack an author), some answered, some deleted."""
    e = table(spark, sf, "events")
    raw = e.select(F.col("event_id").alias("id"), F.concat(F.lit(" "), "event_type").alias("title"), F.lit("text").alias("content"), F.when(F.col("event_id") % 2 == 0, "who").alias("author"), F.lit(" Unheard-of ").alias("category"))
    posts = feedback.new_posts(raw, F.lit("2024-01-01").cast("timestamp"))
    answers = e.where("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("a"), "event_id").alias("answer"), F.col("ts").cast("timestamp").alias("at"))
    answers = answers.unionByName(answers.withColumn("answer", F.lit(" ")).withColumn("at", F.lit("2100-01-01").cast("timestamp")))
    gone = e.where("event_id % 10 = 0").select(F.col("event_id").alias("id"))
    return feedback.deleted(feedback.answered(posts, answers), gone).select("id", "title", "category", "status", "answer")


@query("SELECT event_id AS state, event_id % 3 = 0 AS asked FROM events WHERE event_id % 2 = 0")
def token_states(spark: SparkSession, sf: str) -> DataFrame:
    """States that haven't expired: those asked for are given out, the others stay."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("state"), feedback.expiry(F.lit("2024-01-01").cast("timestamp"), F.when(F.col("event_id") % 2 == 0, 7290).otherwise(0)).alias("expires_at"))
    given, left = feedback.popped(e, e.where("state % 3 = 0").select("state"), F.lit("2024-01-01 01:00:00").cast("timestamp"))
    return given.select("state", F.lit(True).alias("asked")).unionByName(left.select("state", F.lit(False).alias("asked")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{\"v\":null,\"s\":{\"x\":[1.0,null]}}' WHEN 1 THEN '{\"v\":1.5,\"s\":{\"x\":[1.0,null]}}' ELSE '{\"v\":null,\"s\":{\"x\":[1.0,null]}}' END AS json FROM part")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, float("nan")).when(F.col("p_partkey") % 3 == 1, 1.5).otherwise(float("inf"))
    own = _part(spark, sf).select("p_partkey", v.alias("v"), F.struct(F.array(F.lit(1.0), F.lit(float("nan"))).alias("x")).alias("s"))
    body = feedback.json_safe(own.select("p_partkey", "v", "s"))
    got = body.select(F.get_json_object("json", "$.p_partkey").cast("long").alias("p_partkey"), "json")
    return got.select("p_partkey", F.regexp_replace("json", r'"p_partkey":\d+,', "").alias("json"))


@query("SELECT p_partkey, (p_size + 0.5)::DOUBLE AS total FROM part")
def map_totals(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("p_size").cast("double"), F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(None).cast("double"))
    return _part(spark, sf).select("p_partkey", feedback.total(m).alias("total"))


@query(f"WITH RECURSIVE {MATCH} SELECT count(*) FILTER (WHERE track_id % 2 = 0) AS selected, count(*) AS candidates, count(*) FILTER (WHERE status IN ('review_needed', 'low_confidence')) AS review, count(*) FILTER (WHERE status = 'invalid_candidate') AS failed FROM ev")
def client_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.final_status(resolve.with_evidence(base.scored(spark, sf)))
    return feedback.client_counts(rows.withColumn("selected", F.col("track_id") % 2 == 0))


@query("""WITH s AS (SELECT p_partkey // 5 AS doc_id, p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_type END AS artist FROM part), g AS (SELECT doc_id, artist, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM s WHERE artist IS NOT NULL GROUP BY 1, 2),
t AS (SELECT doc_id, artist AS top FROM g WHERE n / total::DOUBLE >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, artist) = 1) SELECT p_partkey, coalesce(artist, top) AS artist FROM s LEFT JOIN t USING (doc_id)""")
def filled_artists(spark: SparkSession, sf: str) -> DataFrame:
    own = _part(spark, sf).select(F.floor(F.col("p_partkey") / 5).cast("long").alias("doc_id"), "p_partkey", F.when(F.col("p_partkey") % 5 > 1, F.col("p_type")).alias("artist"))
    return feedback.fill_artists(own).select("p_partkey", "artist")


@query("SELECT p_partkey // 10 AS doc_id, 'A' || (p_partkey // 10) AS title, CASE WHEN max(p_partkey) % 2 = 1 THEN 'x' ELSE 'y feat. z' END AS artist, max(50 + p_partkey % 10) AS max_score, count(*) AS n FROM part GROUP BY 1")
def audio_near_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Ten readings of one song a document, the artist spelt in two ways: one row with all segments, the best score and that reading's artist."""
    k = F.col("p_partkey")
    own = _part(spark, sf).select(F.floor(k / 10).cast("long").alias("doc_id"), (k % 10).alias("segment_index"), F.concat(F.lit("A"), F.floor(k / 10).cast("string")).alias("title"), F.when(k % 2 == 1, "x").otherwise("y feat. z").alias("artist"), (50 + k % 10).alias("score"))
    out = dedup.merge_audio_hits(own)
    return out.select("doc_id", "title", "artist", "max_score", "n")


@query("SELECT doc_id, 0 AS frame, CAST(n AS BIGINT) AS songs FROM (SELECT p_partkey // 20 AS doc_id, count(*) FILTER (WHERE p_partkey % 2 = 0) AS n FROM part GROUP BY 1) WHERE n > 0")
def best_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Even lines are songs and stand in frame 0; the other frame has none."""
    k = F.col("p_partkey")
    own = _part(spark, sf).select(F.floor(k / 20).cast("long").alias("doc_id"), (k % 2).alias("frame"), k.alias("line_no"), F.when(k % 2 == 0, _both("p_brand", " - ", "p_name")).otherwise(F.col("p_name")).alias("line"))
    scores = media.frame_scores(own.withColumn("f", F.struct("doc_id", "frame")), "f").select("f.doc_id", "f.frame", "score", "songs")
    return media.representative(scores).select("doc_id", "frame", "songs")


@query("SELECT doc_id, 2 AS frames, CASE WHEN doc_id % 2 = 0 THEN '' WHEN n * 12 < 60 THEN 'low_quality_frame' ELSE 'ocr_noise_too_high' END AS failure_reason FROM (SELECT p_partkey // 20 AS doc_id, count(*) AS n FROM part GROUP BY 1) WHERE n = 20")
def ocr_runs(spark: SparkSession, sf: str) -> DataFrame:
    k, doc = F.col("p_partkey"), F.floor(F.col("p_partkey") / 20).cast("long")
    own = _part(spark, sf).select(doc.alias("doc_id"), (k % 2).alias("frame"), k.alias("line_no"), F.when(doc % 2 == 0, _both("p_brand", " - ", "p_name")).otherwise(F.col("p_name")).alias("line"))
    whole = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 20").select("doc_id")
    return media.ocr_run(own.join(whole, "doc_id", "left_semi")).select("doc_id", F.col("frames").cast("int").alias("frames"), "failure_reason")


@query("SELECT p_partkey // 4 AS doc_id, count(DISTINCT p_name) AS n FROM part GROUP BY 1")
def distinct_frame_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each name in two frames, once with a time before it; times alone go."""
    k = F.col("p_partkey")
    own = _part(spark, sf).select(F.floor(k / 4).cast("long").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("frame_index"), F.col("p_name").alias("line")), F.struct(F.lit(1).alias("frame_index"), _both("1:23 ", "p_name").alias("line")), F.struct(F.lit(1).alias("frame_index"), F.lit("1:23").alias("line")))).alias("x"), k.alias("line_no"))
    return media.distinct_lines(own.select("doc_id", "x.*", "line_no")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey // 3 AS doc_id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_partkey END AS p_partkey FROM part WHERE p_partkey % 3 < 2")
def swapped_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Of each three songs the first is confirmed, the last is the first with its sides changed: it goes."""
    k = F.col("p_partkey")
    doc = F.floor(k / 3).cast("long")
    first = _part(spark, sf).where("p_partkey % 3 = 0").select(doc.alias("doc_id"), F.col("p_name").alias("t0"), F.col("p_brand").alias("a0"))
    own = _part(spark, sf).withColumn("doc_id", doc).join(first, "doc_id")
    own = own.select("doc_id", "p_partkey", F.when(k % 3 == 2, F.col("a0")).otherwise(F.concat(F.col("p_name"), F.lit(" "), k.cast("string"))).alias("title"), F.when(k % 3 == 2, F.col("t0")).otherwise(F.col("p_brand")).alias("artist"), F.when(k % 3 == 0, 0).alias("section_index"))
    own = own.withColumn("title", F.when(k % 3 == 0, F.col("title")).otherwise(F.col("title"))).withColumn("artist", F.when(k % 3 == 2, F.concat(F.col("artist"), F.lit(" "), (k - 2).cast("string"))).otherwise(F.col("artist")))
    return dedup.drop_swapped(own).select("doc_id", "p_partkey")


@query("SELECT p_partkey // 2 AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'duplicate_music_section_artist_position' ELSE 'added' END AS decision FROM part")
def section_positions(spark: SparkSession, sf: str) -> DataFrame:
    """A translated title of the same artist at the same place stays out; another artist's song comes in."""
    k = F.col("p_partkey")
    doc = F.floor(k / 2).cast("long")
    own = _part(spark, sf).select(doc.alias("doc_id"), (k % 2).cast("int").alias("line_no"), F.concat(F.lit("곡"), k.cast("string")).alias("title"), F.concat(F.lit("가수"), k.cast("string")).alias("artist"))
    cards = _part(spark, sf).select(doc.alias("doc_id"), (k % 2).cast("int").alias("section_index"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("가수"), k.cast("string"))).otherwise(F.lit("Somebody else")).alias("artist"))
    return dedup.supplement(own, cards).select("doc_id", "decision")


@query("SELECT doc_id, line_no, artist, title FROM (SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS line_no, p_brand AS artist, p_name || ' (' || (p_partkey % 10) || ')' AS title FROM part) WHERE line_no <> 9")
def fuzzy_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that differ in their brackets by one sign: the last of ten is one edit from an earlier one of the same artist."""
    k = F.col("p_partkey")
    doc = F.floor(k / 10).cast("long")
    first = _part(spark, sf).where("p_partkey % 10 = 0").select(doc.alias("doc_id"), F.col("p_name").alias("t0"), F.col("p_brand").alias("a0"))
    own = _part(spark, sf).withColumn("doc_id", doc).join(first, "doc_id")
    num = (k % 10).cast("string")
    title = F.when(k % 10 == 9, F.concat(F.upper("t0"), F.lit(" (9)"))).otherwise(F.concat(F.col("p_name"), F.lit(" ("), num, F.lit(")")))
    own = own.select("doc_id", (k % 10).alias("line_no"), F.when(k % 10 == 9, F.col("a0")).otherwise(F.concat(F.col("p_brand"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("!"), num)))).alias("artist"), title.alias("title"))
    out = dedup.fuzzy_dedup(own)
    return out.select("doc_id", "line_no", F.regexp_replace("artist", "!.*$", "").alias("artist"), "title")


@query("SELECT p_partkey, 0 AS section_index, p_name AS title, p_brand AS artist, 'high' AS confidence FROM part")
def section_songs(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.lit("Music").alias("header"), F.array(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))).alias("items"))).alias("sections")))
    cards = landed.cards(_part(spark, sf).select(F.col("p_partkey").alias("doc_id"), body.alias("payload")))
    return context.songs_of_cards(cards).select(F.col("doc_id").alias("p_partkey"), F.col("line_no").alias("section_index"), "title", "artist", "confidence")


@query("SELECT song_id, CASE WHEN song_id % 2 = 0 THEN 1 ELSE 0 END AS best FROM (SELECT p_partkey AS song_id FROM part)")
def best_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Two cases a song: the second counts if it is clearly better."""
    k = F.col("p_partkey")
    rows = _part(spark, sf).select(k.alias("song_id"), F.explode(F.array(F.struct(F.lit(0).alias("case"), F.lit(0.5).alias("evidence_score")), F.struct(F.lit(1).alias("case"), F.when(k % 2 == 0, 0.9).otherwise(0.51).alias("evidence_score")))).alias("x"), F.lit(1).alias("popularity"))
    return context.best_case(rows.select("song_id", "x.*", "popularity")).select("song_id", F.col("case").alias("best"))


@query("SELECT p_partkey // 10 AS doc_id, p_partkey % 10 + 1 AS place, p_name AS title, CASE WHEN p_partkey % 10 < 5 THEN p_partkey // 10 * 10 + (p_partkey % 10) * 2 END AS track_id FROM part")
def zipped_results(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of ten beside the even ones, by place."""
    k = F.col("p_partkey")
    own = _part(spark, sf).select(F.floor(k / 10).cast("long").alias("doc_id"), k.alias("line_no"), F.col("p_name").alias("title"))
    found = _part(spark, sf).where("p_partkey % 2 = 0").select(F.floor(k / 10).cast("long").alias("doc_id"), k.alias("ord"), k.alias("track_id"))
    return playlist.zipped(own, found).select("doc_id", "place", "title", "track_id")


@query("""WITH m AS (SELECT o_orderkey AS doc_id, 60 + o_orderkey % 7200 AS d FROM orders), f AS (SELECT doc_id, unnest(range(0, d, 40)) AS s FROM m UNION SELECT doc_id, unnest(range(0, least(d - 1, 90) + 1, 15)) FROM m UNION SELECT doc_id, unnest(range(greatest(d - 90, 0), d, 15)) FROM m UNION SELECT doc_id, 7 FROM m UNION SELECT doc_id, 3601 FROM m WHERE d > 3601)
SELECT doc_id, count(DISTINCT s) AS frames FROM f GROUP BY doc_id""")
def frame_plan_cuts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (60 + F.col("o_orderkey") % 7200).cast("int").alias("duration_s"))
    cuts = m.select("doc_id", F.explode(F.array(F.lit(7), F.lit(3601))).alias("second"))
    return media.frame_plan(m, cuts=cuts).groupBy("doc_id").agg(F.count("*").alias("frames"))


@query("""WITH s AS (SELECT p_partkey // 10 AS doc_id, p_partkey % 2 AS rk, p_partkey AS n, p_name AS title, p_brand AS artist FROM part), c AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 END AS ok FROM s)
SELECT doc_id, CASE WHEN max(ok) IS NULL THEN 'merged' WHEN max(ok) = 0 THEN 'description' ELSE 'comments' END AS chosen, count(DISTINCT lower(artist) || '|' || lower(title)) AS songs FROM c WHERE ok IS NULL OR rk = ok GROUP BY doc_id""")
def source_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Even parts from the description, odd ones from comments: one succeeds, or both are merged."""
    k = F.col("p_partkey")
    doc, rank = F.floor(k / 10).cast("long"), (k % 2).cast("int")
    own = _part(spark, sf).select(doc.alias("doc_id"), rank.alias("source_rank"), F.when(rank == 0, "description").otherwise("comments").alias("source"), (doc % 3 == rank).alias("success"), k.alias("line_no"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("timestamp"))
    return songs.cascade(own).groupBy("doc_id").agg(F.first("chosen").alias("chosen"), F.count("*").alias("songs"))
