"""Albums and risks, lines with more than two names, nested pages, fetches in order, frames: odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.operators import direction, match, media, metadata, playlist, resolve, songs
from tracksift.sources import landed


def test_a_live_album_makes_a_version_unless_the_song_is_live(spark):
    rows = spark.createDataFrame(
        [(1, "Blue Sun", "Zed", "Live in Rome"), (2, "Blue Sun live", "Zed", "Live in Rome"), (3, "Blue Sun", "Zed", None), (4, "Blue Sun", "Zed", "Blue Sun"), (5, None, None, "")],
        "song_id int, title string, artist string, album string",
    ).select("*", F.lit(1).alias("track_id"), F.lit("Blue Sun").alias("name"), F.lit("Zed").alias("artist_name"), F.lit(50).alias("popularity"), F.lit(1).alias("api_rank"), F.lit(True).alias("has_image"))
    out = {r.song_id: r for r in metadata.with_detail(resolve.scored(resolve.paired(rows))).collect()}
    assert (out[1].pattern, out[1].risk_reasons, out[1].evidence_score) == ("VERSION_REVIEW", ["version_candidate"], 0.35)
    assert not out[2].version_candidate and out[2].pattern == "EXACT_MATCH"
    assert out[3].album_score == 0 and out[3].album_part == 0 and out[3].evidence_score == 1
    assert out[4].album_score == 1 and out[4].album_part == 0.05 and out[4].popularity_part == 0.025
    assert out[4].detail_reasons[0] == "artist=1.0000 weighted=45%"
    assert out[5].album_score == 0


def test_match_batch_takes_albums_into_account(spark):
    wanted = spark.createDataFrame([(1, "Blue Sun", "Zed")], "song_id long, title string, artist string")
    track = "track_id long, name string, artist_name string, popularity int, has_image boolean, album string"
    live = spark.createDataFrame([(1, "Blue Sun", "Zed", 90, True, "Live in Rome")], track)
    both = live.union(spark.createDataFrame([(2, "Blue Sun", "Zed", 10, True, "Blue Sun")], track))
    assert [(r.track_id, r.match_status) for r in match.match_batch(wanted, both).collect()] == [(2, "matched")]
    assert match.match_batch(wanted, live).first().match_status != "matched"


def test_sides_with_more_names_are_parted_again(spark):
    lines = {
        1: "BTS - IU Blue Sky", 2: "TREASURE - KING KONG", 3: "IU - Blue Sky _ BTS", 4: "IU - Blue Sky _ what a long note this is", 5: "샤이니 (SHINee) <Don't Call Me>",
        6: "BTS - IU (아이유) Blue Sky", 7: "BTS - BIGBANG <뱅뱅뱅>", 8: "no pair at all", 9: None, 10: "", 11: "BTS - RED 7UP 영웅의 노래", 12: "Zed - IU Blue Sky",
    }
    rows = spark.createDataFrame([(1, k, v) for k, v in lines.items()], "doc_id int, line_no int, body string")
    rows = rows.withColumn("p", songs.pair_parts(F.col("body"))).select("*", "p.*").drop("p")
    got = songs.resplit(rows, direction.known_artists(spark))
    assert got.columns == rows.columns
    out = {r.line_no: (r.left, r.right) for r in got.collect()}
    assert len(out) == len(lines)
    assert out[1] == ("IU", "Blue Sky") and out[2] == ("TREASURE", "KING KONG") and out[3] == ("IU", "Blue Sky")
    assert out[4] == ("IU", "Blue Sky _ what a long note this is")
    assert out[5] == ("샤이니 (SHINee)", "Don't Call Me")
    assert out[7] == ("BIGBANG", "뱅뱅뱅") and out[11] == ("RED 7UP", "영웅의 노래") and out[12] == ("Zed", "IU Blue Sky")
    assert out[8] == out[9] == out[10] == (None, None)


def test_parsed_uses_known_artists(spark):
    lines = spark.createDataFrame([(1, 0, "0:10 BTS - IU Blue Sky"), (1, 1, "1:10 BTS - Spring Day")], "doc_id int, line_no int, line string")
    known = direction.known_artists(spark)
    got = {r.line_no: (r.left, r.right) for r in songs.parsed(lines, known=known).collect()}
    assert got == {0: ("IU", "Blue Sky"), 1: ("BTS", "Spring Day")}


def test_pages_that_hold_no_music_give_none(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]"), (5, '{"engagementPanels": null}'), (6, '{"engagementPanels": [null, {}]}')], "doc_id int, payload string")
    assert landed.panel_cards(rows).collect() == []
    assert landed.panel_cards(rows.limit(0)).columns == ["doc_id", "section_index", "title", "artist", "album"]


def test_fetches_keep_places_of_missing_and_repeated_ids(spark):
    ask = spark.createDataFrame([(1, p, t) for p, t in enumerate([5, 7, 5, None, 9])], "request_id int, position int, track_id int")
    have = spark.createDataFrame([(5, "five"), (9, "nine")], "track_id int, name string")
    out = playlist.fetched(ask, have, size=2).orderBy("place").collect()
    assert [(r.place, r.chunk, r.found, r.name) for r in out] == [(0, 0, True, "five"), (1, 0, False, None), (2, 1, True, "five"), (3, 1, False, None), (4, 2, True, "nine")]


def test_frames_count_the_longest_run_or_all_lines(spark):
    lines = ["Zed - Sky", "prose", "1:00 Zed - Sun", "2:00 Zed - Moon", "3:00", "", None]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)] + [("b", 0, "Zed - Sky"), ("b", 1, "official prose"), ("b", 2, "Zed - Sun"), ("c", 0, "prose")], "doc_id string, line_no int, line string")
    out = {r.doc_id: r for r in media.frame_scores(rows).collect()}
    assert (out["a"].songs, out["a"].ts, out["a"].n, out["a"].overlay, out["a"].score) == (2, 2, 4, 0, 10 + 6 + 8 + 2.25 + 4)
    assert (out["b"].songs, out["b"].overlay, out["b"].score) == (2, 1, 6 + 8 + 2 + 2.2 - 1)
    assert (out["c"].songs, out["c"].score) == (0, 0)


def test_frame_plan_with_cuts_exchanges_lengths_and_cuts_alone(spark):
    """Odd rows as the plain union of seconds; the seconds themselves, some hundred a key, aren't dealt out."""
    lengths = [(1, 7000), (2, 61), (3, None), (4, 0), (5, -7), (6, 300), (6, 1234), (6, None), (6, 300), (7, 1), (None, 100), (8, 90)]
    cuts = [(1, 7.0), (1, 7.9), (1, 3601.5), (1, 6999.9), (1, 7000.0), (1, 1e12), (1, float("nan")), (1, None), (1, -0.5), (2, 60.0), (2, 61.0), (3, 0.0), (3, 5.0), (4, 0.0), (5, 0.0), (6, 299.0), (6, 1233.0), (7, 0.0), (7, 0.0), (None, 50.0), (9, 5.0)]
    want = set()
    for k, d in lengths:
        top = max((d or 0) - 1, 0)
        seconds = {*range(0, top + 1, 40), *range(0, min(top, 90) + 1, 15), *range(max((d or 0) - 90, 0), top + 1, 15)}
        seconds |= {int(s) for c, s in cuts if k is not None and c == k and s is not None and s >= 0 and s < (d or 0)}
        want |= {(k, s) for s in seconds}
    own = spark.createDataFrame(lengths, "doc_id long, duration_s int")
    out = media.frame_plan(own, cuts=spark.createDataFrame(cuts, "doc_id long, second double"))
    assert out.dtypes == [("doc_id", "bigint"), ("second", "int")]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
    counted = out.groupBy("doc_id").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.second) for r in media.frame_plan(own).collect()} <= want
