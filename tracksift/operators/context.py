"""Context of a document: its single artist and what overrides it, evidence of songs, policies that follow from the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import text as X

#: Words that name a playlist, in Korean and English.
PLAYLIST_KO, PLAYLIST_EN = r"노래\s*모음|플레이리스트|전곡|음악\s*모음|모음", r"playlist|songs?|best|hits|collection|discography"
_STOP = ["the", "my", "your", "best", "top", "new", "kpop", "k-pop", "pop", "music"]


def plausible_artist(c: Column) -> Column:
    """2 to 40 characters, no stop word, no sentence ending."""
    return F.coalesce(F.length(F.trim(c)).between(2, 40) & ~F.lower(F.trim(c)).isin(_STOP) & ~c.rlike("(?:다|요|까|네)[.!?]?$"), F.lit(False))


def artist_of_title(c: Column) -> Column:
    """The name before or after a playlist word of a title; null if none is plausible."""
    t = X.spaces(F.regexp_replace(X.ascii_brackets(c), r"[\[\](){}]", " "))
    before = F.trim(F.regexp_extract(t, rf"(?i)^(.{{2,40}}?)\s*(?:{PLAYLIST_KO}|{PLAYLIST_EN})(?:\s|$)", 1))
    after = F.trim(F.regexp_extract(t, rf"(?i)(?:{PLAYLIST_KO}|{PLAYLIST_EN})\s*(?:of|by|-|:)\s*(.{{2,40}})$", 1))
    return F.coalesce(F.when(plausible_artist(before), before), F.when(plausible_artist(after), after))


def override_single(single: DataFrame, confirmed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document's single artist, unless its section confirms two artists or more: then null, with the reason."""
    n = confirmed.groupBy(key).agg(F.count_distinct(F.lower("artist")).alias("artists"))
    own = single.join(n, key, "left").withColumn("artists", F.coalesce("artists", F.lit(0)))
    many = F.col("artists") >= 2
    return own.select(key, F.when(~many, F.col("artist")).alias("artist"), "artists", F.when(many, "music_section_multi_artist_override").otherwise("").alias("reason"))


def with_evidence_type(songs: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Songs (with raw_line) with the first line that holds it, its number, a type and a confidence."""
    own = songs.join(lines.select(key, "line_no", F.col("line").alias("_line")), key, "left")
    hit = F.contains("_line", "raw_line")
    at = F.min(F.when(hit, F.col("line_no")))
    out = own.groupBy(key, "artist", "title", "raw_line").agg(at.alias("line_index"))
    timed, pair = X.timestamp_of(F.col("raw_line")).isNotNull(), X.has_separator(F.col("raw_line"))
    kind = F.when(timed & pair, "timestamp_pair").when(timed, "title_only_timestamp").when(pair, "delimiter_pair").otherwise("other")
    sure = F.when(F.col("line_index").isNull(), "low").when(timed & pair, "high").when(timed | pair, "medium").otherwise("low")
    return out.withColumn("evidence_type", kind).withColumn("confidence", sure)


def strong_text(evidence: Column, confidence: Column) -> Column:
    return evidence.isin("timestamp_pair", "explicit_tracklist", "delimiter_pair") & (confidence != "low")


def songs_of_cards(cards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Structured cards as songs: complete, confident, in card order."""
    return cards.select(key, F.col("section_index").alias("line_no"), "artist", "title", F.lit("music_section").alias("evidence_type"), F.lit("high").alias("confidence"))


def artist_filter(inferred: Column, confirmed: Column, artist: Column, single: Column) -> Column:
    """Whether the search is narrowed to the single artist, and why: struct(applied, reason)."""
    why = (
        F.when(single.isNull(), "no_single_artist").when(confirmed, "section_confirmed").when(inferred, "inferred_artist")
        .when(artist.isNull(), "artist_missing").otherwise("artist_given")
    )
    return F.struct(why.isin("inferred_artist", "artist_missing").alias("applied"), why.alias("reason"))


def ocr_policy(rows: DataFrame) -> DataFrame:
    """Matches of OCR text: dropped, capped or demoted where the artist's evidence is weak (evidence_score, status, title_score, artist_score)."""
    t, a, s = F.col("title_score"), F.col("artist_score"), F.col("evidence_score")
    own = rows.where(~((a < 0.3) & (X.word_count(F.col("title")) <= 2) & (s < 0.8)))
    weak = (a < 0.5) | (F.col("artist").isNull())
    cap = F.when(a == 0, F.least(s, F.lit(0.79))).when(weak, F.least(s, F.lit(0.60))).otherwise(s)
    score = F.when(weak & (t >= 0.8), F.greatest(cap, F.lit(0.55))).otherwise(cap)
    return own.withColumns({"evidence_score": F.round(score, 4), "status": F.when(weak & (F.col("status") == "matched"), "review_needed").otherwise(F.col("status"))})


def best_case(rows: DataFrame, margin: float = 0.05) -> DataFrame:
    """Of a song's cases (case: 0 as given, then others) the best score; another than the given needs `margin` more."""
    given = F.max(F.when(F.col("case") == 0, F.col("evidence_score"))).over(Window.partitionBy("song_id"))
    own = rows.withColumn("_given", given).where((F.col("case") == 0) | F.col("_given").isNull() | (F.col("evidence_score") >= F.col("_given") + margin))
    w = Window.partitionBy("song_id").orderBy(F.col("evidence_score").desc(), F.col("popularity").desc(), "case")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_given")


def source_quality(songs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Songs, complete songs and mean completeness of each document's sources."""
    return songs.groupBy(key, "source").agg(F.count("*").alias("songs"), F.count_if("is_complete").alias("complete"), F.round(F.avg("completeness"), 3).alias("avg_completeness"))


def artist_coverage(expected: Column, found: Column) -> Column:
    """Share of the expected artists (array) that the candidate has, by key."""
    keys = lambda c: F.transform(c, X.artist_key)
    return F.when(F.size(expected) > 0, F.round(F.size(F.array_intersect(keys(expected), keys(found))) / F.size(F.array_distinct(keys(expected))), 4)).otherwise(0.0)
