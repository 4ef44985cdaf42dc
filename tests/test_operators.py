"""Small cases with expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.operators import context, dedup, feedback, media, playlist, resolve, songs
from tracksift.sources import landed, targets
from tracksift.streaming import live


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def parse(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = songs.songs(songs.parsed(songs.lines_of(docs))).orderBy("line_no").collect()
    return [(r.artist, r.title) for r in rows]


def test_lines_that_are_no_songs(spark):
    text = "Mitski - my love mine all mine\nd4vd - here with me\nProvided by Dead Oceans / Secretly Group\nig : offwebkr\nspotify : offweb\nHearts2Hearts - RUDE!\nhttps://x.y/z"
    assert parse(spark, text) == [("Mitski", "my love mine all mine"), ("d4vd", "here with me"), ("Hearts2Hearts", "RUDE!")]


def test_orientation_by_vote(spark):
    assert parse(spark, "1:00 좋은 날 - 아이유\n2:00 Some Night - Ariana Grande\n3:00 Another Day - Kendrick Lamar")[0] == ("아이유", "좋은 날")
    assert parse(spark, "빅뱅 - FANTASTIC BABY") == [("빅뱅", "FANTASTIC BABY")]
    assert parse(spark, "23:13 404 (new era) - kiiikiii")[0] in {("kiiikiii", "404 (new era)"), ("404 (new era)", "kiiikiii")}


def test_cleaners(spark):
    assert one(spark, "~ 03:15 f(x) - 4 Walls (Live) feat. Somebody", X.clean_text) == "f(x) - 4 Walls"
    assert one(spark, "a) b (c", X.drop_unmatched_closers) == "a b (c"
    assert one(spark, "XI (Feat. 이하이, CODE & DEAN)", X.credits_of) == ["이하이", "CODE", "DEAN"]
    assert one(spark, "here with me", X.strip_credits) == "here with me"
    assert one(spark, "ｆｕｌｌ", X.nfkc) == "full"
    assert one(spark, "Simon & Garfunkel (Live)", X.match_text) == "simon and garfunkel"
    assert one(spark, None, X.clean_text) is None
    assert one(spark, "1:02:03", X.seconds_of) == 3723
    assert one(spark, "https://open.spotify.com/intl-ko/track/" + "A" * 22, X.track_uri) == "spotify:track:" + "A" * 22
    assert one(spark, "Song - official video", X.title_noise_free) == "Song"
    assert [tuple(r) for r in one(spark, '```json\n{"songs":[{"artist":"a","title":"b"}]}```', X.songs_json)] == [("a", "b", None)]
    assert one(spark, "no json", X.songs_json) == []


def test_similarity(spark):
    rows = [("Ditto", "Ditto", 1.0), ("봐", "봄인가 봐", 0.55), ("Love", "Love Story", 0.92), ("", "x", 0.0), ("tide", "diet", round(0.25 * 0.82, 4))]
    df = spark.createDataFrame(rows, "a string, b string, want double").withColumn("got", X.similarity(F.col("a"), F.col("b")))
    assert all(abs(r.got - r.want) < 1e-9 for r in df.collect())


def test_numbered_and_blocks(spark):
    assert tuple(one(spark, "1. - 처음 그 자리에 - 이보람", songs.numbered)) == ("이보람", "처음 그 자리에")
    assert tuple(one(spark, "01-IU-Palette", songs.numbered)) == ("IU", "Palette")
    text = "0:00\nA title\nAn artist\n\n3:00\nB title\nB artist\n6:00\n"
    docs = spark.createDataFrame([(1, text), (2, "x\ny\nz\n1:00\nb\nc")], "doc_id long, text string")
    got = songs.three_line_blocks(songs.lines_of(docs)).orderBy("block").collect()
    assert [(r.doc_id, r.title, r.artist) for r in got] == [(1, "A title", "An artist"), (1, "B title", "B artist")]


def test_dedup_merge_and_mode(spark):
    rows = [(1, 0, "IU", None, None), (1, 1, "IU", "Good Day", "1:00"), (1, 2, "iu", "good day", None), (1, 3, None, "Ditto", None)]
    df = songs.with_completeness(spark.createDataFrame(rows, "doc_id long, line_no int, artist string, title string, timestamp string"))
    got = {(r.artist, r.title, r.place) for r in songs.dedup_songs(df).collect()}
    assert got == {("IU", None, 0), ("IU", "Good Day", 1), (None, "Ditto", 3)}
    assert [(r.artist, r.share) for r in songs.mode_artist(df).collect()] == [("IU", 1.0)]
    two = df.withColumns({"source_rank": F.col("line_no") % 2, "source": F.when(F.col("line_no") % 2 == 0, "text").otherwise("ocr")})
    merged = {(r.title, tuple(r.sources), r.timestamp) for r in songs.merge_sources(two).collect()}
    assert ("good day", ("text", "ocr"), "1:00") in merged
    hint = songs.with_artist_hint(df, songs.mode_artist(df)).where("title = 'Ditto'").first()
    assert hint.artist is None and hint.artist_hint == "IU" and hint.artist_inferred


def test_sequential_groupers(spark):
    rows = [(1, i, "A", t) for i, t in enumerate(["one", "onee", "oneee", "two", "tvo", "x1", "y2y", "zzz3", "w4w4", "q5q5q"])]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, artist string, title string")
    assert [r.title for r in dedup.fuzzy_dedup(df).orderBy("line_no").collect()] == ["one", "oneee", "two", "x1", "y2y", "zzz3", "w4w4", "q5q5q"]
    near = dedup.near_duplicates(spark.createDataFrame([(1, 0, "A", "Good Day"), (1, 1, "A", "Good Dayy"), (1, 2, "B", "Other")], df.schema)).orderBy("line_no").collect()
    assert [(r.title, r.n_variants) for r in near] == [("Good Dayy", 2), ("Other", 1)]
    s = spark.createDataFrame([(1, 0, None, "Xii"), (1, 1, None, "어려워")], df.schema)
    c = spark.createDataFrame([(1, 0, "Xii", "CODE KUNST"), (1, 1, "What is Love?", "LEEHI")], "doc_id long, section_index int, title string, artist string")
    got = dedup.section_join(s, c).orderBy("line_no").collect()
    assert [(r.card_artist, r.how) for r in got] == [("CODE KUNST", "title"), ("LEEHI", "position")]
    assert dedup.section_extras(c, dedup.section_join(s, c)).count() == 0


def test_matching(spark):
    song = spark.createDataFrame([(1, "The Last", "Yoon Sang"), (2, "There She Goes", "실키보이즈"), (3, "Zed Zed", "Nobody")], "song_id long, title string, artist string")
    cat = spark.createDataFrame([(10, "The Last", "Yoon Sang", 50, True), (11, "The Last Karaoke", "KY Noraebang", 50, True), (12, "There She Goes", "The La's", 50, False)], "track_id long, name string, artist_name string, popularity int, has_image boolean")
    rows = resolve.with_evidence(resolve.scored(resolve.candidates(song, cat)))
    got = {(r.song_id, r.track_id): (r.pattern, r.status) for r in rows.collect()}
    assert got[1, 10] == ("EXACT_MATCH", "matched") and got[1, 11][0] == "VERSION_REVIEW" and got[2, 12] == ("TITLE_ONLY_MATCH", "review_needed")
    best = {r.song_id: (r.track_id, r.confidence_label) for r in resolve.best(rows).collect()}
    assert best == {1: (10, "high"), 2: (12, "low")}
    names = spark.createDataFrame([("iu",), ("Unknown",)], "artist string")
    assert {r.artist_canonical for r in resolve.canonical(names, resolve.alias_table(spark)).collect()} == {"아이유", "Unknown"}
    m = resolve.best(rows).withColumn("uri", F.when(F.col("song_id") == 1, "u1"))
    routes = {r.song_id: r.route for r in playlist.routed(m).collect()}
    assert routes == {1: "matched", 2: "unmatched"} and playlist.counters(playlist.routed(m)).first().match_rate == 50.0


def test_feedback(spark):
    none = spark.createDataFrame([], "id long, score int, comment string, created_at timestamp")
    r = feedback.rating_stats(none).first()
    assert (r.n, r.average, r.recent_average, r.comment_rate, r.score_1, r.score_5) == (0, None, None, 0.0, 0, 0)
    rows = spark.sql("SELECT id, CAST(score AS int) score, IF(score >= 4, 'x', '') comment, timestamp'2024-01-01' created_at FROM VALUES (1, 5), (2, 5), (3, 4), (4, 3), (5, 2) t(id, score)")
    r = feedback.rating_stats(rows).first()
    assert (r.n, r.average, r.comment_rate, r.score_5, r.score_1) == (5, 3.8, 0.6, 2, 0)


def test_media_and_sources(spark):
    m = spark.createDataFrame([(1, 100), (2, 10_000)], "doc_id long, duration_s int")
    got = {r.doc_id: (r.n, r.m) for r in media.audio_plan(m).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start_s").alias("m")).collect()}
    assert got == {1: (4, 90), 2: (30, 5220)}
    assert tuple(one(spark, "https://www.youtube.com/watch?v=Bw-8gOHPzyM&list=RDBw-8gOHPzyM&start_radio=1", targets.route)) == ("video", "Bw-8gOHPzyM")
    assert tuple(one(spark, "nonsense", targets.route)) == ("error", None)
    body = '{"sections":[{"header":"Other","items":[{"title":"t","artist":"a"}]},{"header":"Music","items":[{"title":"x","artist":"y"},{"title":"","artist":"z"}]}]}'
    cards = landed.cards(spark.createDataFrame([(1, body), (2, "bad")], "doc_id long, payload string")).collect()
    assert [(r.doc_id, r.section_index, r.title, r.artist) for r in cards] == [(1, 0, "x", "y")]


def test_streams_end_as_batches_do(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = live.per_window(stream, size="1 day").writeStream.format("memory").queryName("live_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = batch.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    assert spark.table("live_windows").agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]
    assert spark.table("live_windows").count() == want.count()


def test_context(spark):
    assert one(spark, "wave to earth 노래모음", context.artist_of_title) == "wave to earth"
    assert one(spark, "IU playlist", context.artist_of_title) == "IU"
    assert one(spark, "playlist", context.artist_of_title) is None
    song = spark.createDataFrame([(1, "IU", "Ditto", "1:00 IU - Ditto"), (1, "X", "Y", "not there")], "doc_id long, artist string, title string, raw_line string")
    lines = spark.createDataFrame([(1, 4, "1:00 IU - Ditto"), (1, 5, "other")], "doc_id long, line_no int, line string")
    got = {r.title: (r.line_index, r.evidence_type, r.confidence) for r in context.with_evidence_type(song, lines).collect()}
    assert got == {"Ditto": (4, "timestamp_pair", "high"), "Y": (None, "other", "low")}
    cases = spark.createDataFrame([(1, 0, 0.8, 1), (1, 1, 0.82, 1), (2, 0, 0.5, 1), (2, 1, 0.9, 1)], "song_id long, case int, evidence_score double, popularity int")
    assert {(r.song_id, r.case) for r in context.best_case(cases).collect()} == {(1, 0), (2, 1)}
    cover = spark.createDataFrame([(["IU", "Suga"], ["iu"])], "a array<string>, b array<string>").select(context.artist_coverage(F.col("a"), F.col("b")).alias("r"))
    assert cover.first().r == 0.5
