"""Matching and extraction on small cases with known results."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.operators import dedup, extract, feedback, match, media, resolve, songs
from tracksift.streaming import live

ALIASES = [("한로로", "HANRORO"), ("김동률", "Kim Dong Ryul"), ("다비치", "DAVICHI"), ("검정치마", "The Black Skirts"), ("코르티스", "CORTIS")]
PAIRS = [
    ("The Last", "Yoon Sang", "The Last", "Yoon Sang", True, "EXACT_MATCH", "matched"),
    ("0+0", "한로로", "0+0", "HANRORO", True, "EXACT_MATCH", "matched"),
    ("긴 이별", "김동률", "A Long Goodbye", "Kim Dong Ryul", True, "TRANSLATED_TITLE_ARTIST_STRONG", "matched"),
    ("입춘", "한로로", "Let Me Love My Youth", "HANRORO", True, "TRANSLATED_TITLE_ARTIST_STRONG", "matched"),
    ("타임캡슐", "다비치", "TIME CAPSULE", "DAVICHI", False, "ARTIST_STRONG_TITLE_WEAK", "review_needed"),
    ("청춘만화", "가수", "Coming Of Age Story", "Unknown Romanized Artist", False, "SEARCH_RANK1_REVIEW", "review_needed"),
    ("영원은 그렇듯", "리도어", "영원은 그렇듯", "Pluggboi", False, "TITLE_ONLY_MATCH", "review_needed"),
    ("어떻게 이별까지 사랑하겠어", "악동뮤지션", "어떻게 이별까지 사랑하겠어 Cover Ver.", "Sogumm", False, "VERSION_REVIEW", "review_needed"),
    ("The Last", "Yoon Sang", "The Last Karaoke", "KY Noraebang", False, "VERSION_REVIEW", "unmatched"),
    ("everything", "검정치마", "EVERYTHING", "The Black Skirts", False, "EXACT_MATCH", "matched"),
    ("drowning", "woodz", "Drowning", "WOODZ", False, "EXACT_MATCH", "matched"),
]


def test_known_pairs(spark):
    rows = spark.createDataFrame([(i, t, a, i, n, an, 50, 1, im) for i, (t, a, n, an, im, _, _) in enumerate(PAIRS)], "song_id long, title string, artist string, track_id long, name string, artist_name string, popularity int, api_rank int, has_image boolean")
    groups = match.alias_groups(spark.createDataFrame(ALIASES, "canonical string, alias string"))
    own = match.final_status(resolve.with_evidence(resolve.scored(resolve.paired(rows, groups))))
    got = {r.song_id: (r.pattern, r.match_status) for r in own.collect()}
    assert got == {i: (p, s) for i, (*_, p, s) in enumerate(PAIRS)}
    score = {r.song_id: r for r in own.collect()}
    assert score[0].score >= 0.85 and score[0].title_score == 1.0 and score[8].adjusted_score < 0.5 and score[8].rejection_reason == "non_original"


def test_similarity_in_tasks_is_the_column_form(spark):
    rng = random.Random(3)
    words = ["love", "live", "story", "봄", "the", "a", "loveless", "stories", "remix"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("want", X.similarity(F.col("a"), F.col("b")))
    for r in df.collect():
        assert abs(r.want - X.similar(*(x.lower().strip() for x in (r.a, r.b)))) < 1e-9, (r.a, r.b)


def test_queries_and_worth(spark):
    own = spark.createDataFrame([("Ditto", "NewJeans"), ("Ditto", None)], "title string, artist string").withColumn("q", match.queries(F.col("title"), F.col("artist")))
    got = {r.artist: [x["query"] for x in r.q] for r in own.collect()}
    assert got == {"NewJeans": ['track:"Ditto" artist:"NewJeans"', "Ditto NewJeans"], None: ["Ditto"]}


def test_match_batch_by_hand(spark):
    wanted = spark.createDataFrame([(1, "The Last", "Yoon Sang"), (2, "the last", "yoon sang"), (3, "", "X"), (4, "Nothing Like It", "Nobody"), (5, "긴 이별", "김동률")], "song_id long, title string, artist string")
    cat = spark.createDataFrame([(10, "The Last", "Yoon Sang", 50, True), (11, "The Last Karaoke", "KY Noraebang", 90, True), (12, "A Long Goodbye", "Kim Dong Ryul", 40, True)], "track_id long, name string, artist_name string, popularity int, has_image boolean")
    got = {r.song_id: (r.track_id, r.match_status, r.reason) for r in match.match_batch(wanted, cat, spark.createDataFrame(ALIASES, "canonical string, alias string")).collect()}
    assert got[1][:2] == got[2][:2] == (10, "matched") and got[5][:2] == (12, "matched")
    assert got[3] == (None, "unmatched", "suspicious_song") and got[4] == (None, "unmatched", "no_search_result")


def test_early_stop_keeps_the_first_good_query(spark):
    rows = spark.createDataFrame([(1, 0, 10, 0.9, 1), (1, 1, 11, 0.95, 1), (2, 0, 10, 0.5, 1), (2, 1, 12, 0.7, 1)], "song_id long, query_no int, track_id long, evidence_score double, api_rank int")
    assert {(r.song_id, r.track_id) for r in match.search_tiers(rows).collect()} == {(1, 10), (2, 10), (2, 12)}


def test_brackets_and_numbers(spark):
    docs = spark.createDataFrame([(1, "32:45 SUPER JUNIOR - 행복 (원곡 : H.O.T. - 행복)\n썸네일 - Hearts2Hearts '에이나&유하' 님")], "doc_id long, text string")
    assert [(r.artist, r.title) for r in songs.songs(songs.parsed(songs.lines_of(docs))).collect()] == [("SUPER JUNIOR", "행복")]
    own = spark.createDataFrame([(1, 0, None, "지구에서 금성까지, 이바다")], "doc_id long, line_no int, artist string, title string")
    assert [(r.artist, r.title) for r in songs.comma_artist(own).collect()] == [("이바다", "지구에서 금성까지")]


def test_routes(spark):
    docs = spark.createDataFrame([(1, "00:00 IU - Good Day\n03:30 NewJeans - Ditto"), (2, "IU - Good Day\nNewJeans - Ditto"), (3, "")], "doc_id long, text string")
    reply = spark.createDataFrame([(1, 0, "Wrong", "One", "00:00 IU - Good Day"), (2, 0, "IU", "Good Day", "IU - Good Day"), (2, 1, "NewJeans", "Ditto", "NewJeans - Ditto"), (2, 2, "Not", "There", "never said")], "doc_id long, line_no int, artist string, title string, raw_line string")
    rows, verdict = extract.extract(docs, reply)
    got = {r.doc_id: (r.rule_first, r.success, r.method) for r in verdict.collect()}
    assert got == {1: (True, True, "rule_based"), 2: (False, True, "llm"), 3: (False, False, "rule_based")}
    # two lines alone don't settle which side the artist stands on
    assert {(r.doc_id, *sorted((r.artist, r.title))) for r in rows.collect()} == {(i, *x) for i in (1, 2) for x in (("Good Day", "IU"), ("Ditto", "NewJeans"))}
    blocks = spark.createDataFrame([(1, "0:00\nA title\nAn artist\n3:00\nB title\nB artist")], "doc_id long, text string")
    assert [(r.artist, r.title) for r in extract.rule_parse(blocks).orderBy("line_no").collect()] == [("An artist", "A title"), ("B artist", "B title")]


def test_dispatch(spark):
    jobs = spark.createDataFrame([(1, "text"), (2, "video"), (3, "audio"), (4, "ocr")], "doc_id long, mode string")
    docs = spark.createDataFrame([(1, "00:00 IU - Good Day\n03:30 NewJeans - Ditto")], "doc_id long, text string")
    frames = spark.createDataFrame([(2, 0, 0, "00:15 Artist - Title"), (2, 1, 0, "artist - title"), (2, 1, 1, "noise")], "doc_id long, frame long, line_no int, line string")
    hits = spark.createDataFrame([(3, 0, 10), (3, 1, 20)], "doc_id long, segment_index int, score int")
    got = {r.doc_id: (r.success, r.failure_reason) for r in extract.dispatch(jobs, docs, frames, hits).collect()}
    assert got == {1: (True, ""), 2: (True, ""), 3: (False, "not_in_db"), 4: (False, "frame_selection_failed")}


def test_audio_hits_and_supplement(spark):
    hits = spark.createDataFrame([(1, 0, "Good Day", "IU", 70), (1, 1, "Good Day!", "IU ft X", 90), (1, 2, "Other", "Z", 80), (1, 3, None, "Z", 99)], "doc_id long, segment_index int, title string, artist string, score int")
    got = [(r.title, r.max_score, list(r.segments), r.n) for r in dedup.merge_audio_hits(hits).orderBy("title").collect()]
    assert got == [("Good Day!", 90, [0, 1], 2), ("Other", 80, [2], 1)]
    own = spark.createDataFrame([(1, 0, "조유리", "이제 안녕!"), (1, 1, "최예나", "그건 사랑이었다고")], "doc_id long, line_no int, artist string, title string")
    cards = spark.createDataFrame([(1, 0, "Farewell for now!", "JO YURI"), (1, 1, "It was love", "YENA"), (1, 2, "New one", "Who")], "doc_id long, section_index int, title string, artist string")
    groups = match.alias_groups(spark.createDataFrame([("조유리", "JO YURI"), ("최예나", "YENA")], "canonical string, alias string"))
    got = [r.decision for r in dedup.supplement(own, cards, groups=groups).orderBy("section_index").collect()]
    assert got == ["duplicate_music_section_artist_position"] * 2 + ["added"]


def test_json_and_expiry(spark):
    own = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "id long, v double")
    assert [r.json for r in feedback.json_safe(own).orderBy("json").collect()] == ['{"id":1,"v":null}', '{"id":2,"v":2.5}']
    text = "\n".join(["noise", "more noise"])
    frames = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(text.split("\n"))], "doc_id long, frame long, line_no int, line string")
    assert [(r.failure_reason, r.partial) for r in media.ocr_run(frames).collect()] == [("low_quality_frame", False)]


def test_state_with_time_to_live(spark, tmp_path):
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set(key, store)
    try:
        spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in"))
        out = []
        q = live.with_ttl(stream, "k", 3600).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert sorted((r.key, r.fresh, r.asked) for r in out) == [("a", True, 2), ("b", True, 1)]
    finally:
        spark.conf.unset(key)
