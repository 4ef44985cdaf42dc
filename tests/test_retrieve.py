"""Candidate retrieval: equal to scoring all tracks, and hits that grow with songs, not with their square."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracksift.operators import resolve, retrieve
from tracksift.plans import queries


def overlap(a, b):
    return round(len(a & b) / max(len(a), len(b)) + 1e-12, 4) if a and b else 0.0


def brute(songs, tracks, k, fields):
    """Every song against every track, on tokens cut by spaces."""
    out = []
    for sid, title, artist in songs:
        rows = []
        for tid, name, by, pop in tracks:
            t = overlap(set(title.split()), set(name.split()))
            if title.replace(" ", "") == name.replace(" ", ""):
                t = 1.0
            a = overlap(set((artist or "").split()), set(by.split()))
            if artist and artist.replace(" ", "") == by.replace(" ", ""):
                a = 1.0
            if fields == "title":
                a = 0.0
            if (t and a) if fields == "both" else t if fields == "title" else (t or a):
                rows.append((-round(t + a, 4), -pop, tid))
        out += [(sid, tid, -s, i + 1) for i, (s, p, tid) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("fields", ["any", "both", "title"])
def test_equals_all_pairs(spark, fields):
    rng = random.Random(7)
    name = lambda most, words: " ".join(rng.sample(words, rng.randrange(1, most + 1)))
    titles, artists = [f"word{i}" for i in range(7)] + ["sun", "flower", "sunflower"], [f"band{i}" for i in range(5)]
    tracks = [(i, name(4, titles), name(3, artists), rng.randrange(4)) for i in range(300)]
    songs = [(i, name(4, titles), name(3, artists) if i % 4 else None) for i in range(60)] + [(99, "sun flower", "band0 band1")]
    s = spark.createDataFrame(songs, "song_id long, title string, artist string")
    c = spark.createDataFrame(tracks, "track_id long, name string, artist_name string, popularity int")
    got = resolve.candidates(s, c, fields=fields).select("song_id", "track_id", "block_score", "api_rank").collect()
    assert sorted(map(tuple, got)) == brute(songs, tracks, 5, fields)


def test_a_hot_title_and_a_hot_artist(spark):
    """Thousands of tracks of one title and thousands of one artist: each song still meets few of them."""
    tracks = spark.range(8000).select(
        F.col("id").alias("track_id"), F.when(F.col("id") < 4000, "hello").otherwise(F.concat(F.lit("song"), F.col("id"))).alias("name"),
        F.when(F.col("id") < 4000, F.concat(F.lit("band"), F.col("id"))).otherwise("adele").alias("artist_name"), (F.col("id") % 100).cast("int").alias("popularity"),
    )
    songs = spark.range(500).select(F.col("id").alias("song_id"), F.lit("hello").alias("title"), F.concat(F.lit("band"), F.col("id") * 7).alias("artist"))
    songs = songs.union(spark.createDataFrame([(1000, "hello", "adele")], songs.schema))
    s, c = resolve._normal(songs, "title", "artist", "s"), resolve._normal(tracks, "name", "artist_name", "c")
    assert retrieve.hits(s, retrieve.index(c, 5)).count() <= 501 * 20
    top = {}
    for r in resolve.candidates(songs, tracks).collect():
        top.setdefault(r.song_id, {})[r.api_rank] = r
    assert all(top[i][1].track_id == i * 7 and top[i][1].block_score == 2.0 for i in range(500))
    assert [top[1000][n].track_id for n in range(1, 6)] == [99, 199, 299, 399, 499]  # equal scores: by popularity, then id


def test_hits_grow_with_songs(spark):
    n = {}
    for sf in ("sf0.01", "sf0.1"):
        songs, tracks = queries.wanted(spark, f"/root/testdata/{sf}"), queries.catalog(spark, f"/root/testdata/{sf}")
        s, c = resolve._normal(songs, "title", "artist", "s"), resolve._normal(tracks, "name", "artist_name", "c")
        n[sf] = songs.count(), retrieve.hits(s, retrieve.index(c, 5)).count()
    assert n["sf0.1"][1] / n["sf0.01"][1] < 1.1 * n["sf0.1"][0] / n["sf0.01"][0]


def test_long_names_and_nothing_to_search(spark):
    long = " ".join(f"word{i:02d}" for i in range(12))
    s = spark.createDataFrame([(1, long, "a b c d e f g"), (2, None, None), (3, "", " "), (4, "word00", None)], "song_id long, title string, artist string")
    c = spark.createDataFrame([(7, long, "g f e d c b a", 1), (8, None, None, 2), (9, "zzz", "yyy", None)], "track_id long, name string, artist_name string, popularity int")
    got = {(r.song_id, r.track_id): r.block_score for r in resolve.candidates(s, c).collect()}
    assert (1, 7) in got and got[1, 7] >= 1.0 and got[4, 7] == round(1 / 12, 4) and len(got) == 2
    assert resolve.candidates(s.where("false"), c).count() == 0
