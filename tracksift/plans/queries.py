"""The engine's queries over the driver's tables: each a thin use of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X
from tracksift.operators import context, dedup, direction, feedback, media, playlist, resolve, songs
from tracksift.session import table
from tracksift.sources import landed, targets

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


# inputs derived from the driver's tables


def tracklists(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, line_no, line: a tracklist of a hundred lines for every hundred parts."""
    n, d = F.col("p_partkey") % 100, F.floor(F.col("p_partkey") / 100)
    s = n * 210
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    ts = F.when(n < 18, F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60)))
    pair = F.when(d % 2 == 0, F.concat("p_brand", F.lit(" - "), "p_name")).otherwise(F.concat("p_name", F.lit(" - "), "p_brand"))
    line = F.when(n == 50, F.concat(F.lit("https://example.com/"), d.cast("string"))).when(n % 5 == 4, pair).otherwise(F.concat(ts, F.lit(" "), pair))
    return table(spark, sf, "part").select(d.cast("long").alias("doc_id"), n.cast("int").alias("line_no"), line.alias("line"))


def tracklist_docs(spark: SparkSession, sf: str) -> DataFrame:
    own = tracklists(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return own.select("doc_id", F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("text"))


def all_songs(spark: SparkSession, sf: str) -> DataFrame:
    return songs.songs(songs.parsed(tracklists(spark, sf)))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("artist_name")).agg(F.min("p_partkey").alias("track_id"), F.max("p_size").alias("popularity"))
    return own.withColumn("has_image", F.col("popularity") % 2 == 0)


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Songs to match: every type of part with every size and name it occurs with, under a part's brand; one in three without an artist."""
    own = table(spark, sf, "part").groupBy(F.col("p_name").alias("title"), F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("song_id"))
    odd = F.when(F.col("song_id") % 5 == 0, F.concat("title", F.lit(" live"))).otherwise(F.col("title"))
    return own.select("song_id", odd.alias("title"), F.when(F.col("song_id") % 3 > 0, F.col("brand")).alias("artist"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.scored(resolve.candidates(wanted(spark, sf), catalog(spark, sf)))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    best = resolve.best(resolve.with_evidence(scored(spark, sf)))
    return best.withColumn("uri", F.concat(F.lit("track:"), F.col("track_id").cast("string")))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), (1 + F.col("event_id") % 5).alias("score"), F.when(F.col("value") > 100, F.col("event_type")).otherwise("").alias("comment"), F.col("ts").alias("created_at"))


# flagship


@query
def dedup_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Which songs each document lists: parse, orient, de-duplicate."""
    return songs.dedup_songs(all_songs(spark, sf)).select("doc_id", "place", "timestamp", "artist", "title")


# lines and parsing


@query
def extract_pairs(spark: SparkSession, sf: str) -> DataFrame:
    own = tracklists(spark, sf).withColumn("p", songs.pair_parts(X.strip_timestamps(F.regexp_replace("line", X.LEAD_TIME, ""))))
    return own.where("p.separator is not null").select("doc_id", "line_no", "p.left", "p.right", "p.separator")


@query
def extract_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    own = tracklists(spark, sf).withColumn("timestamp", X.timestamp_of(F.col("line")))
    return own.where("timestamp is not null").select("doc_id", "line_no", "timestamp", X.seconds_of(F.col("timestamp")).alias("offset_s"))


@query
def valid_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = X.with_valid(tracklists(spark, sf), into="ok")
    return own.groupBy("doc_id").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


@query
def not_music_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = songs.lines_of(table(spark, sf, "documents"))
    return lines.where(X.not_music(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query
def section_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = songs.lines_of(table(spark, sf, "documents"))
    return lines.groupBy("doc_id").agg(F.count_if(X.section_word(F.col("line"))).alias("section_lines"), F.count_if(X.has_separator(F.col("line"))).alias("separated_lines"))


@query
def numbered_tracks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("line", F.concat(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), "p_brand", F.lit("-"), "p_name")).otherwise(F.concat(F.lit(". - "), "p_name", F.lit(" - "), "p_brand"))))
    return p.withColumn("s", songs.numbered(F.col("line"))).select("p_partkey", "s.artist", "s.title")


@query
def three_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 10
    ls = F.array(F.concat(F.lit("0"), k.cast("string"), F.lit(":00")), F.col("p_name"), F.col("p_brand"))
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("doc_id"), k.alias("k"), F.posexplode(ls).alias("i", "line"))
    own = p.select("doc_id", (F.col("k") * 3 + F.col("i")).alias("line_no"), "line")
    return songs.three_line_blocks(own).select("doc_id", "block", "timestamp", "title", "artist")


@query
def direction_votes(spark: SparkSession, sf: str) -> DataFrame:
    return direction.document_votes(songs.parsed(tracklists(spark, sf)).where("separator is not null"))


@query
def oriented_songs(spark: SparkSession, sf: str) -> DataFrame:
    return all_songs(spark, sf).select("doc_id", "line_no", "artist", "title", "direction")


@query
def timestamp_gate(spark: SparkSession, sf: str) -> DataFrame:
    return songs.parsed(tracklists(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("timed_pairs").alias("timed_pairs"))


@query
def clean_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaners over decorated titles."""
    raw = F.concat(F.lit("~ 03:15 "), "p_name", F.lit(" (Live) feat. "), "p_brand", F.lit(" -"))
    return table(spark, sf, "part").select("p_partkey", X.clean_text(raw).alias("cleaned"), X.title_noise_free(F.concat("p_name", F.lit(" official video"))).alias("bare"), X.match_key(F.concat("p_brand", F.lit(" & "), "p_name")).alias("match_key"))


# documents


@query
def line_signals(spark: SparkSession, sf: str) -> DataFrame:
    return songs.signals(tracklist_docs(spark, sf)).select("doc_id", "timestamp_count", "bare_timestamp_count", "pattern_count", "candidate_line_count", "line_count", "candidate_line_ratio", "has_tracklist_structure")


@query
def document_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return songs.signals(table(spark, sf, "documents")).select("doc_id", "timestamp_count", "pattern_count", "line_count")


@query
def song_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return songs.song_metrics(all_songs(spark, sf))


def _verdict(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = tracklist_docs(spark, sf)
    signal = songs.signals(docs)
    return songs.validity(docs, songs.song_metrics(all_songs(spark, sf)), signal), signal


@query
def doc_validity(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict(spark, sf)[0]


@query
def analysis_state(spark: SparkSession, sf: str) -> DataFrame:
    return songs.analysis_state(_verdict(spark, sf)[0])


@query
def fallback_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return songs.fallback(*_verdict(spark, sf))


@query
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    own = all_songs(spark, sf).withColumn("source_rank", F.col("line_no") % 2).withColumn("source", F.when(F.col("line_no") % 2 == 0, "description").otherwise("comments"))
    return songs.merge_sources(own).select("doc_id", "artist", "title", "timestamp", F.array_join("sources", ",").alias("sources"))


@query
def source_cascade(spark: SparkSession, sf: str) -> DataFrame:
    own = all_songs(spark, sf).withColumn("source_rank", F.col("line_no") % 3).groupBy("doc_id", "source_rank").agg(F.count("*").alias("n"))
    own = own.withColumn("source", F.element_at(F.array(F.lit("description"), F.lit("comments"), F.lit("section")), (F.col("source_rank") + 1).cast("int"))).withColumn("success", F.col("n") >= 27)
    return songs.choose_source(own)


@query
def mode_artist(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("doc_id"), F.col("p_partkey").alias("line_no"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).otherwise(F.upper("p_type")).alias("artist"))
    return songs.mode_artist(own)


@query
def hashtag_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Each name as a hashtag, three parts a document, among tags that name no artist."""
    own = table(spark, sf, "part").select((F.col("p_partkey") % 700).alias("doc_id"), F.concat(F.lit("hear #"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" #playlist #x")).alias("text"))
    return songs.hashtags(own)


@query
def ai_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.lower("text").rlike(X.any_of(L.AI_WORDS)).alias("ai_content"))


@query
def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query
def comment_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.length("text").alias("like_count"), (F.col("role") == "assistant").alias("is_author"))
    return landed.comment_groups(c).groupBy("doc_id", "group_rank", "source").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query
def url_routing(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    known = F.when(F.col("page_id") % 5 == 0, "https://www.youtube.com/watch?v=Bw-8gOHPzyM&list=RDBw-8gOHPzyM").when(F.col("page_id") % 5 == 1, "https://youtu.be/Bw-8gOHPzyM?si=x").when(F.col("page_id") % 5 == 2, "https://www.youtube.com/playlist?list=PL123").when(F.col("page_id") % 5 == 3, "PLabc_1")
    return p.select("page_id", targets.route(F.coalesce(known, F.col("url"))).alias("r")).select("page_id", "r.kind", "r.id")


@query
def track_uris(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ident = F.lpad(k.cast("string"), 22, "A")
    raw = F.when(k % 4 == 0, F.concat(F.lit("spotify:track:"), ident)).when(k % 4 == 1, F.concat(F.lit("https://open.spotify.com/intl-ko/track/"), ident, F.lit("?si=1"))).when(k % 4 == 2, ident).otherwise(F.concat(F.lit("x"), ident))
    return table(spark, sf, "part").select("p_partkey", X.track_uri(raw).alias("uri"))


@query
def json_songs(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('```json\n{"songs": [{"artist": "'), "p_brand", F.lit('", "title": "'), "p_name", F.lit('"}]}\n```'))
    own = table(spark, sf, "part").select("p_partkey", F.explode(X.songs_json(F.when(F.col("p_partkey") % 3 > 0, raw).otherwise("no json"))).alias("s"))
    return own.select("p_partkey", "s.artist", "s.title")


# matching


@query
def alias_canonical(spark: SparkSession, sf: str) -> DataFrame:
    names = [n for k, v in L.ARTIST_ALIASES.items() for n in v]
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    own = table(spark, sf, "part").select("p_partkey", pick.alias("artist"))
    return resolve.canonical(own, resolve.alias_table(spark)).select("p_partkey", "artist", "artist_canonical")


@query
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name against the next part's."""
    own = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    after = own.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return own.join(after, "p_partkey").select("p_partkey", X.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query
def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one type within one edit: such names share themselves with at most one letter left out, so only those meet."""
    own = table(spark, sf, "part").select("p_type", F.concat("p_name", (F.col("p_partkey") % 10).cast("string")).alias("n")).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.concat(F.left(F.col("n"), i - 1), F.substr(F.col("n"), i + 1)))
    keyed = own.select("p_type", "n", F.explode(F.array_distinct(F.array_append(cut, F.col("n")))).alias("key"))
    a, b = (keyed.select("p_type", "key", F.col("n").alias(c)) for c in "ab")
    pairs = a.join(b, ["p_type", "key"]).where("a < b").select("p_type", "a", "b").distinct()
    return pairs.where(X.edit_within_one(F.col("a"), F.col("b")))


@query
def candidate_topk(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.candidates(wanted(spark, sf), catalog(spark, sf)).select("song_id", "track_id", "block_score", "api_rank")


@query
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("song_id", "track_id", "title_score", "artist_score", "overlap", "suspicious", "score")


@query
def pattern_tags(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("song_id", "track_id", resolve.tags().alias("tags"))


@query
def evidence_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.with_evidence(scored(spark, sf)).select("song_id", "track_id", "pattern", "status", "evidence_score")


@query
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).select("song_id", "track_id", "pattern", "status", "evidence_score", "confidence_label")


@query
def match_counters(spark: SparkSession, sf: str) -> DataFrame:
    return playlist.label_counters(matches(spark, sf))


@query
def playlist_routing(spark: SparkSession, sf: str) -> DataFrame:
    return playlist.routed(matches(spark, sf)).select("song_id", "uri", "route")


@query
def playlist_counters(spark: SparkSession, sf: str) -> DataFrame:
    return playlist.counters(playlist.routed(matches(spark, sf)))


@query
def playlist_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen playlists."""
    own = playlist.routed(matches(spark, sf)).withColumn("playlist_id", F.col("song_id") % 16)
    return playlist.chunks(own, playlist="playlist_id")


@query
def result_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.dedup_results(matches(spark, sf)).select("song_id", "track_id", "evidence_score")


@query
def batch_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return playlist.enriched(matches(spark, sf).select("song_id", "track_id", "title", "artist"), catalog(spark, sf)).select("song_id", "display_title", "display_artist")


@query
def cube_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).cube("pattern", "confidence_label").agg(F.count("*").alias("n"))


# sequential groupers: no SQL form


@query
def fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fuzzy_dedup(all_songs(spark, sf)).select("doc_id", "line_no", "artist", "title")


@query
def near_duplicate_songs(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_duplicates(all_songs(spark, sf).select("doc_id", "line_no", "artist", "title"))


@query
def similarity_full(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select("p_name").distinct()
    return own.withColumn("other", F.reverse("p_name")).withColumn("similarity", X.similarity(F.col("p_name"), F.col("other")))


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    own = tracklists(spark, sf).where("line_no % 7 = 0").select("doc_id", F.col("line_no").alias("section_index"), songs.pair_parts(X.strip_timestamps(F.regexp_replace("line", X.LEAD_TIME, ""))).alias("p"))
    return own.where("p.separator is not null").select("doc_id", "section_index", F.col("p.right").alias("title"), F.col("p.left").alias("artist"))


@query
def section_join(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.section_join(all_songs(spark, sf).select("doc_id", "line_no", "artist", "title"), _cards(spark, sf))


@query
def section_extras(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.section_extras(_cards(spark, sf), section_join(spark, sf))


@query
def supplement(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.supplement(all_songs(spark, sf).select("doc_id", "line_no", "artist", "title"), _cards(spark, sf))


# context


@query
def multi_artist_override(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("doc_id"), F.col("p_partkey").alias("line_no"), F.col("p_type").alias("artist"))
    return context.override_single(songs.mode_artist(own), own.where(F.col("line_no") % 3 != 1))


@query
def ocr_policy(spark: SparkSession, sf: str) -> DataFrame:
    return context.ocr_policy(matches(spark, sf)).groupBy("status").agg(F.count("*").alias("n"), F.max("evidence_score").alias("top"))


@query
def source_quality(spark: SparkSession, sf: str) -> DataFrame:
    own = all_songs(spark, sf).withColumn("source", F.when(F.col("line_no") % 2 == 0, "description").otherwise("comments"))
    return context.source_quality(own)


# media


def _media(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (60 + F.col("o_orderkey") % 7200).cast("int").alias("duration_s"))


@query
def audio_plan(spark: SparkSession, sf: str) -> DataFrame:
    return media.audio_plan(_media(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("segments"), F.max("start_s").alias("last_start"))


@query
def frame_plan(spark: SparkSession, sf: str) -> DataFrame:
    return media.frame_plan(_media(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("frames"), F.sum("second").alias("total"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("segment_index"), (F.col("event_id") % 101).alias("score"), F.col("event_type").alias("title"), F.lit("x").alias("artist"))


@query
def audio_recognition(spark: SparkSession, sf: str) -> DataFrame:
    return media.recognition(_hits(spark, sf))


@query
def audio_merge(spark: SparkSession, sf: str) -> DataFrame:
    return media.merge_hits(_hits(spark, sf)).select("doc_id", "title", "artist", "n", "max_score", F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments"))


@query
def ocr_frame_scores(spark: SparkSession, sf: str) -> DataFrame:
    return media.frame_scores(tracklists(spark, sf)).select("doc_id", "ts", "delims", "songs", "n", "consistency", "score")


@query
def best_song_run(spark: SparkSession, sf: str) -> DataFrame:
    return media.song_runs(tracklists(spark, sf))


# feedback and activity


@query
def rating_stats(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.rating_stats(ratings(spark, sf))


@query
def rating_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.distribution(ratings(spark, sf))


@query
def rejected_ratings(spark: SparkSession, sf: str) -> DataFrame:
    own = ratings(spark, sf).withColumn("score", F.col("id") % 7).withColumn("reason", feedback.invalid_reason())
    return own.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query
def qa_board(spark: SparkSession, sf: str) -> DataFrame:
    posts = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("title"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 2 == 0, "waiting").otherwise("answered").alias("status"), F.col("ts").alias("created_at"))
    return feedback.board(posts, status="waiting", category="click", page=2).select("id", "title", "category", "status")


@query
def latest_tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return feedback.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query
def rate_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("minute"), "n")


@query
def sliding_rating_average(spark: SparkSession, sf: str) -> DataFrame:
    own = ratings(spark, sf).groupBy(F.to_date("created_at").alias("day")).agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    w = Window.orderBy("day").rowsBetween(-6, 0)  # one row a day
    return own.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.sum("s").over(w) / F.sum("n").over(w), 4).alias("average"))


@query
def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = e.withColumn("new", F.when(F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS")), 1).otherwise(0))
    own = own.withColumn("session", F.sum("new").over(w))
    return own.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
