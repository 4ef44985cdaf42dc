"""Playlists from matches: routing, counters, chunks, enrichment. matches: song_id, track_id, uri, status, evidence_score, confidence_label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import text as X

#: Gates of automatic and low-confidence adding, tracks a request.
AUTO_GATE, LOW_GATE, CHUNK = 0.85, 0.6, 100
#: Fixed value: tracks that one request fetches.
FETCH = 50
#: The name of a playlist without one, and the error of one without tracks.
DEFAULT_NAME, NO_TRACKS = "YouTube Playlist", "선택된 곡이 없습니다."


def routed(matches: DataFrame, high_only: bool = False) -> DataFrame:
    """route: matched, low_confidence_added, low_confidence_skipped or unmatched."""
    s, ok = F.col("evidence_score"), F.col("uri").isNotNull() & (F.col("status") != "invalid_candidate")
    sure = ok & (F.col("status") == "matched") & (s >= (AUTO_GATE if high_only else 0.0))
    low = ok & F.col("status").isin("matched", "review_needed", "low_confidence")
    route = F.when(sure, "matched").when(low & (s >= LOW_GATE) & F.lit(not high_only), "low_confidence_added").when(low, "low_confidence_skipped").otherwise("unmatched")
    return matches.withColumn("route", route)


def counters(routes: DataFrame) -> DataFrame:
    """Rows by route, distinct matched tracks, and the rate of matched and added ones in percent, 1 place."""
    n = lambda r: F.count_if(F.col("route") == r)
    distinct = F.count_distinct(F.when(F.col("route") == "matched", F.col("uri")))
    own = routes.agg(F.count("*").alias("total"), distinct.alias("matched"), n("low_confidence_added").alias("low_added"), n("low_confidence_skipped").alias("low_skipped"), n("unmatched").alias("unmatched"))
    good, all_ = F.col("matched") + F.col("low_added"), F.col("matched") + F.col("low_added") + F.col("low_skipped") + F.col("unmatched")
    return own.withColumn("match_rate", F.when(all_ > 0, F.round(good / all_ * 100, 1)).otherwise(0.0))


def label_counters(matches: DataFrame) -> DataFrame:
    """Candidates, those to review (mid, low), failed ones."""
    lab = F.col("confidence_label")
    return matches.agg(F.count_if(lab == "high").alias("high"), F.count_if(lab.isin("mid", "low")).alias("needs_review"), F.count_if(lab == "failed").alias("failed"), F.count("*").alias("candidates"))


def chunks(routes: DataFrame, order: str = "song_id", size: int = CHUNK, playlist: str | None = None) -> DataFrame:
    """The playlist's tracks, each once at its first place, with position and chunk of `size`; by playlist where a column is named.

    Without a playlist column all rows are one playlist, which is as long as one playlist may be.
    """
    keys = [playlist] if playlist else []
    own = routes.where(F.col("route").isin("matched", "low_confidence_added")).groupBy(*keys, "uri").agg(F.min(order).alias("first_at"))
    w = Window.partitionBy(*keys).orderBy("first_at", "uri") if keys else Window.orderBy("first_at", "uri")
    at = F.row_number().over(w) - 1
    return own.withColumn("position", at).withColumn("chunk", F.floor(at / size).cast("int"))


def enriched(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """Display fields of the fetched tracks (track_id, name, artist_name) where there are any, else the matches' own."""
    t = tracks.select("track_id", F.col("name").alias("_n"), F.col("artist_name").alias("_a"))
    return matches.join(t, "track_id", "left").withColumn("display_title", F.coalesce("_n", "title")).withColumn("display_artist", F.coalesce("_a", "artist")).drop("_n", "_a")


def fetched(requests: DataFrame, tracks: DataFrame, size: int = FETCH) -> DataFrame:
    """Each requested track (request_id, position, track_id) at its place in the request, with the chunk of `size` that asks for it.

    place counts from 0 in the order of positions; ids that name no track keep their place, with nulls and found false.
    Repeated ids are answered each time. tracks have one row a track_id.
    """
    w = Window.partitionBy("request_id").orderBy("position", "track_id")
    own = requests.withColumn("place", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    return own.join(tracks.withColumn("_found", F.lit(True)), "track_id", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def header(name, description):
    """Name and description in the lengths that a playlist may have."""
    return F.substring(name, 1, 100).alias("name"), F.substring(description, 1, 300).alias("description")


def zipped(songs: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Songs beside the results at the same place of their document; either may be longer. songs: key, line_no, ...; results: key, ord, ..."""
    a = songs.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    b = results.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
    return a.join(b, [key, "place"], "full")


def requests(rows: DataFrame, headers: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """The requests that make playlists of chosen tracks: one to create each, and one for every `size` tracks; rows as the sink takes them.

    rows: playlist_id, position, value (a URI, address or id). Values that name no track go, a track stays at its first
    place, and deduped_count (on the creating request) says how many went. A playlist of no tracks has one request, with an
    error. headers: playlist_id, name, description, cut to their lengths.
    """
    own = rows.select("playlist_id", "position", X.track_uri(F.col("value")).alias("uri"))
    firsts = own.where("uri is not null").groupBy("playlist_id", "uri").agg(F.min("position").alias("at"))
    nth = F.row_number().over(Window.partitionBy("playlist_id").orderBy("at", "uri")) - 1
    placed = firsts.withColumn("nth", nth).withColumn("chunk", F.floor(F.col("nth") / size).cast("int"))
    adds = placed.groupBy("playlist_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "uri"))), lambda x: x.uri).alias("uris"))
    counts = own.groupBy("playlist_id").agg(F.count("*").alias("asked")).join(firsts.groupBy("playlist_id").agg(F.count("*").alias("kept")), "playlist_id", "left")
    if headers is not None:
        counts = counts.join(headers.select("playlist_id", "name", "description"), "playlist_id", "left")
    else:
        counts = counts.withColumns({"name": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    name, description = header(F.coalesce("name", F.lit(DEFAULT_NAME)), F.coalesce("description", F.lit("")))
    none = F.array().cast("array<string>")
    kept = F.coalesce("kept", F.lit(0))
    creates = counts.select(
        "playlist_id", F.when(kept > 0, "create").otherwise("error").alias("kind"), F.lit(None).cast("int").alias("chunk"), name, description, none.alias("uris"),
        (F.col("asked") - kept).alias("deduped_count"), F.when(kept == 0, NO_TRACKS).alias("error"),
    )
    null = lambda kind, c: F.lit(None).cast(kind).alias(c)
    return creates.unionByName(adds.select("playlist_id", F.lit("add").alias("kind"), "chunk", null("string", "name"), null("string", "description"), "uris", null("long", "deduped_count"), null("string", "error")))
