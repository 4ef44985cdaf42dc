"""Top-k candidate retrieval: an inverted index over what two names may share, with postings cut at k, exact.

A track's score against a song is the overlap of their title tokens (1 if the titles are equal without spaces) plus that of
their artists' tokens (1 if an artist is the same under its key); ties go to popularity, then to the least id. The
index has a posting list for every combination of title tokens and artist tokens (or the whole title, or the artist's
key) that a track has, by the track's numbers of tokens. All tracks of such a list score at least what the
combination gives, and a track stands in the list of just what it shares with a song, so the first k of each list by
popularity are enough: what is cut has k better ones before it. So a list's length, and what a song meets, doesn't grow with
the catalogue, however many tracks share a title or an artist.

Names of many tokens have too many combinations: of a title the TITLE_TOKENS longest tokens are searched, of an artist
the ARTIST_TOKENS longest; overlaps still count all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TITLE_TOKENS, ARTIST_TOKENS = 6, 4
#: Which fields a search must match.
ANY, BOTH, TITLE = "any", "both", "title"


def longest(tokens: Column, most: int) -> Column:
    """The longest tokens, in order of the alphabet; ties in length go by the alphabet."""
    ranked = F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    cut = F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: x.t)
    return F.sort_array(F.when(F.size(tokens) > most, cut).otherwise(tokens))


def _facets(tokens: Column, whole: Column, most: int, part: str, name: str) -> Column:
    """Array of structs f, got, size: nothing, each combination of tokens, and each whole name (got: -1)."""
    none = F.array().cast("array<string>")
    all_ = F.coalesce(tokens, none)
    own = longest(all_, most)
    masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(own)).cast("int") - 1)
    sets = F.transform(masks, lambda m: F.filter(own, lambda _, i: F.getbit(m, i) == 1))
    one = lambda f, got, size: F.struct(f.alias("f"), got.cast("int").alias("got"), size.cast("int").alias("size"))
    combined = F.transform(sets, lambda s: one(F.when(F.size(s) > 0, F.concat(F.lit(f"{part}:"), F.array_join(s, " "))).otherwise(""), F.size(s), F.when(F.size(s) > 0, F.size(all_)).otherwise(0)))
    return F.concat(combined, F.transform(F.coalesce(whole, none), lambda w: one(F.concat(F.lit(f"{name}:"), w), F.lit(-1), F.lit(0))))


def keys(rows: DataFrame, id_col: str, by: str, *keep: str) -> DataFrame:
    """id_col, keep, key and what it stands for: title_got, title_size, artist_got, artist_size. rows: <by>_title, <by>_tokens, <by>_names, <by>_akeys."""
    title = F.replace(F.col(f"{by}_title"), F.lit(" "), F.lit(""))
    titles = _facets(F.col(f"{by}_tokens"), F.when(F.length(title) > 0, F.array(title)), TITLE_TOKENS, "t", "c")
    artists = _facets(F.col(f"{by}_names"), F.col(f"{by}_akeys"), ARTIST_TOKENS, "a", "k")
    own = rows.select(id_col, *keep, titles.alias("_ts"), artists.alias("_as"))
    own = own.select(id_col, *keep, F.explode("_ts").alias("_t"), "_as").select(id_col, *keep, "_t", F.explode("_as").alias("_a"))
    key = F.concat("_t.f", F.lit("\t"), "_a.f").alias("key")
    return own.where("_t.got <> 0 or _a.got <> 0").select(
        id_col, *keep, key, F.col("_t.got").alias("title_got"), F.col("_t.size").alias("title_size"), F.col("_a.got").alias("artist_got"), F.col("_a.size").alias("artist_size")
    )


def index(tracks: DataFrame, k: int) -> DataFrame:
    """key, title_n, artist_n, track_id, popularity: the first k tracks of each list. Spark cuts lists in the tasks that make them, before the shuffle."""
    own = keys(tracks, "track_id", "c", "popularity").select("key", F.col("title_size").alias("title_n"), F.col("artist_size").alias("artist_n"), "track_id", "popularity").distinct()
    nth = F.row_number().over(Window.partitionBy("key", "title_n", "artist_n").orderBy(F.col("popularity").desc(), "track_id"))
    return own.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _part(got: str, size: str, other: str) -> Column:
    return F.when(F.col(got) < 0, 1.0).when(F.col(got) == 0, 0.0).otherwise(F.round(F.col(got) / F.greatest(size, other), 4))


def hits(songs: DataFrame, postings: DataFrame, fields: str = ANY) -> DataFrame:
    """song_id, track_id, popularity, block_score: what each song meets in its lists, each track once with its best score."""
    own = keys(songs, "song_id", "s")
    if fields == BOTH:
        own = own.where("title_got <> 0 and artist_got <> 0")
    if fields == TITLE:
        own = own.where("title_got <> 0 and artist_got = 0")
    met = own.join(postings, "key")
    score = F.round(_part("title_got", "title_size", "title_n") + _part("artist_got", "artist_size", "artist_n"), 4)
    return met.groupBy("song_id", "track_id", "popularity").agg(F.max(score).alias("block_score"))


def top(songs: DataFrame, postings: DataFrame, k: int, fields: str = ANY) -> DataFrame:
    """song_id, track_id, popularity, block_score, api_rank: the k best tracks of each song by score, popularity and id."""
    order = Window.partitionBy("song_id").orderBy(F.col("block_score").desc(), F.col("popularity").desc(), "track_id")
    return hits(songs, postings, fields).withColumn("api_rank", F.row_number().over(order)).where(F.col("api_rank") <= k)
