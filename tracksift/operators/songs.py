"""From lines to songs: generation, parsing, gates, de-duplication, merging and the verdict on a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.operators import direction as D

#: Verdict thresholds, places of the three-line block.
MIN_SONGS, MIN_COMPLETE, MIN_AVERAGE = 3, 2, 0.6
SINGLE_SHARE = 0.7


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line: the lines of each text, blank ones too. Null texts have none."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def pair_parts(body: Column) -> Column:
    """left, right and separator of a line's body; null sides if there is no separator. What stands in brackets isn't parted."""
    open_ = body.rlike(r"[(\[{]")
    masked = F.when(open_, X.mask_brackets(body)).otherwise(body)
    sep = X.separator_of(masked)
    at = F.position(sep, masked)
    whole = lambda c: F.when(open_, X.unmask_brackets(c, body)).otherwise(c)
    left, right = whole(F.trim(F.left(masked, at - 1))), whole(F.trim(F.substr(masked, at + F.length(sep))))
    return F.struct(left.alias("left"), right.alias("right"), sep.alias("separator"))


def _angle(text: Column) -> tuple[Column, Column]:
    """What stands before and within the angle of "artist <title>"."""
    at = F.position(F.lit(" <"), text)
    inner = F.regexp_replace(F.trim(F.substr(text, at + 2)), r"[>\s]+$", "")
    return F.trim(F.left(text, at - 1)), inner


def resplit(rows: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs (key, line_no, body, left, right, separator) parted again where their sides hold more than one name each.

    - "before - artist <title>", and "artist <title>" without a separator: the artist and the title of the angle count, if
      the one looks like an artist's name (without a separator, a Hangul name with another spelling in brackets will do).
    - "before - artist title" (a compilation's line): where the left side is a known artist, up to four first words of the
      right one are the artist, the most that are known, or several in capitals before a title that can be nothing else. So
      "A - KING KONG" stays.
    - "artist - title _ note": a note of two words at most that looks like an artist and not like a title goes.

    known: alias_key, from direction.known_artists(). Only lines that may be such are exploded, into five rows at most, and
    only they are shuffled; what they give comes back by key and line.
    """
    own, row = rows, [key, "line_no"]
    right = F.col("right")
    cand = own.select(*row, "left", "right", "separator", "body").withColumns({
        "in_right": F.coalesce(F.contains(right, F.lit(" <")), F.lit(False)),
        "in_body": F.col("separator").isNull() & F.contains("body", F.lit(" <")),
        "left_key": X.artist_key(X.clean_text(F.col("left"))),
        "noted": F.coalesce((F.col("separator") != " _ ") & F.contains(right, F.lit(" _ ")), F.lit(False)),
    })
    masked = F.when(right.rlike(r"[(\[{]"), X.mask_brackets(right)).otherwise(right)
    angle = F.when(F.col("in_right"), right).when(F.col("in_body"), F.col("body"))
    in_angle = cand.where("in_right or in_body").select(*row, "in_body", *[c.alias(n) for n, c in zip(("artist", "title"), _angle(angle), strict=True)], F.lit(9).alias("end"))
    # a line's words are taken from the text before the note, as the note goes in any case
    words = cand.where("not in_right and separator is not null").join(known.withColumnRenamed("alias_key", "left_key"), "left_key", "left_semi")
    words = words.withColumn("tokens", F.filter(F.split(masked, r"\s+"), lambda w: w != "")).where(F.size("tokens") >= 2)
    words = words.withColumn("end", F.explode(F.sequence(F.lit(1), F.least(F.size("tokens") - 1, F.lit(4)))))
    text = lambda c: F.when(right.rlike(r"[(\[{]"), X.unmask_brackets(c, right)).otherwise(c)
    words = words.select(
        *row, F.lit(False).alias("in_body"), text(F.array_join(F.slice("tokens", 1, F.col("end")), " ")).alias("artist"),
        text(F.array_join(F.slice("tokens", F.col("end") + 1, F.size("tokens")), " ")).alias("title"), "end",
    )
    notes = F.regexp_extract("right", r"^.*? _ (.*)$", 1)
    note = cand.where("noted").select(*row, F.lit(False).alias("in_body"), notes.alias("artist"), notes.alias("title"), F.lit(0).alias("end"))
    every, f = D.with_features(in_angle.unionByName(words).unionByName(note), {"_a": "artist", "_t": "title"})
    every = every.withColumn("alias_key", X.artist_key(F.col("_a_clean"))).join(known.withColumn("_known", F.lit(True)), "alias_key", "left")
    a, t, is_known = f["_a"], f["_t"], F.coalesce("_known", F.lit(False))
    capitals = (a["words"] >= 2) & F.forall(F.slice(F.split(a["clean"], r"\s+"), 1, 2), lambda w: w.rlike("^[A-Z0-9]+$"))
    sure_title = t["clean"].rlike(r"^[가-힣一-鿿\x{3040}-\x{30FF}]") | (t["words"] >= 2)
    bare = F.regexp_replace(F.regexp_replace("artist", r"\s*\([^)]*\)\s*", ""), " ", "")
    hangul = F.col("in_body") & bare.rlike("^[가-힣]{2,15}$")
    looks = a["artist_shape"] | is_known
    good = (
        F.when(F.col("end") == 0, (a["words"] <= 2) & looks & ~t["title_shape"])
        .when(F.col("end") == 9, (F.trim("artist") != "") & (F.trim("title") != "") & (looks | hangul))
        .otherwise((is_known | (capitals & sure_title)) & looks & F.col("artist").rlike("^[A-Za-z]") & t["title_shape"])
    )
    kept = every.where(good).select(*row, "end", "artist", "title")
    # the note's end is 0, so it never beats a name
    best = F.max(F.when(F.col("end") > 0, F.struct("end", "artist", "title")))
    hits = kept.groupBy(*row).agg(best.alias("_b"), F.bool_or(F.col("end") == 0).alias("_noted"))
    joined = own.join(hits, row, "left")
    new_right = F.coalesce("_b.title", "right")
    new_right = F.when(F.col("_noted"), F.regexp_replace(new_right, r" _ .*$", "")).otherwise(new_right)
    joined = joined.withColumns({
        "left": F.coalesce("_b.artist", "left"), "right": new_right,
        "separator": F.coalesce("separator", F.when(F.col("_b").isNotNull(), F.lit(" <"))),
    })
    return joined.select(*rows.columns)


def parsed(lines: DataFrame, key: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """Valid lines with their time, track number, sides and vote; the rest is dropped. known (alias_key) lets resplit() part sides again.

    A line that ends in an ellipsis is dropped. Where a document has three timed pairs or more, lines
    without time or number go.
    """
    own = X.with_valid(lines).where("valid").drop("valid").where(~F.col("line").rlike("(?:\\.\\.\\.|…)\\s*$"))
    own = own.withColumn("timestamp", X.timestamp_of(F.col("line")))
    body = X.strip_timestamps(F.regexp_replace("line", X.LEAD_TIME, ""))
    own = own.withColumn("track_prefix", X.track_prefix(body)).withColumn("body", X.without_track_prefix(body))
    own = own.withColumn("parts", pair_parts(F.col("body"))).select("*", "parts.*").drop("parts")
    if known is not None:
        own = resplit(own, known, key)
    timed = F.sum(F.when(F.col("timestamp").isNotNull() & F.col("separator").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(key))
    own = own.withColumn("timed_pairs", timed).where((F.col("timed_pairs") < 3) | F.col("timestamp").isNotNull() | F.col("track_prefix").isNotNull())
    return D.with_votes(own)


def songs(rows: DataFrame, key: str = "doc_id", trusted: DataFrame | None = None) -> DataFrame:
    """Oriented songs of parsed lines: key, line_no, timestamp, artist, title, completeness, is_complete.

    Each document's pairs vote on the direction, in a window on the exchange that parsed() made. In trusted documents
    (key) the artist stands first whatever the votes.
    """
    w = Window.partitionBy(key)
    n = lambda v: F.sum(F.when(F.col("separator").isNotNull() & (F.col("vote") == v), 1).otherwise(0)).over(w)
    own = rows.withColumns({"_at": n("artist_title"), "_ta": n("title_artist")})
    _, direction, sure = D.direction_of(F.col("_at"), F.col("_ta"))
    own = own.withColumn("direction", direction).withColumn("confidence", sure).drop("_at", "_ta")
    if trusted is not None:
        known = trusted.select(F.col(key).alias("_of")).distinct()
        own = own.join(known, own[key] == known["_of"], "left").withColumn("direction", F.when(F.col("_of").isNotNull(), "artist_title").otherwise(F.col("direction"))).drop("_of")
    artist, title = D.orient(F.col("left"), F.col("right"), F.coalesce("direction", F.lit("per_line")), F.col("vote"))
    pair = F.col("separator").isNotNull()
    artist, title = F.when(pair, X.clean_side(artist)), F.when(pair, X.clean_side(title)).otherwise(X.clean_side(F.col("body")))
    out = own.select(key, "line_no", "timestamp", "track_prefix", X.blank_to_null(artist).alias("artist"), X.blank_to_null(title).alias("title"), "direction", "confidence")
    return with_completeness(out.where(X.meaningful(F.coalesce("title", "artist"))))


def with_completeness(rows: DataFrame) -> DataFrame:
    half = F.when(F.col("artist").isNotNull(), 0.5).otherwise(0.0) + F.when(F.col("title").isNotNull(), 0.5).otherwise(0.0)
    return rows.withColumn("completeness", half).withColumn("is_complete", half == 1.0)


def comma_artist(rows: DataFrame) -> DataFrame:
    """Rows without an artist whose title reads "title, artist" are parted."""
    m = F.col("artist").isNull() & F.col("title").rlike(r"^.*\S\s*,\s*[^,]*\S[^,]*$")
    last = F.trim(F.regexp_extract("title", r"^.*,([^,]*)$", 1))
    rest = F.trim(F.regexp_extract("title", r"^(.*),[^,]*$", 1))
    return rows.withColumns({"artist": F.when(m, last).otherwise(F.col("artist")), "title": F.when(m, rest).otherwise(F.col("title"))})


def numbered(line: Column) -> Column:
    """artist and title of "NN-Artist-Title"; of "NN. - title - artist", which forces its order; else nulls."""
    flat, nested = r"^\s*\d{1,3}-(.+?)-(.+)$", r"^\s*\d{1,3}[.)]?\s+-\s+(.+?)\s+-\s+(.+)$"
    get = lambda p, i: F.nullif(F.trim(F.regexp_extract(line, p, i)), F.lit(""))
    return F.struct(F.coalesce(get(nested, 2), get(flat, 1)).alias("artist"), F.coalesce(get(nested, 1), get(flat, 2)).alias("title"))


def three_line_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Songs of documents written as blocks of time, title, artist: all blocks must keep the form, two at least."""
    w = Window.partitionBy(key).orderBy("line_no")
    own = lines.where(F.trim("line") != "").withColumn("i", F.row_number().over(w) - 1)
    bare = F.trim("line").rlike(rf"^{X.TIME}$")
    own = own.withColumn("block", F.floor(F.col("i") / 3)).withColumn("place", F.col("i") % 3).withColumn("bare", bare)
    pick = lambda k: F.max(F.when(F.col("place") == k, F.trim("line")))
    form = F.bool_and(F.col("bare") == (F.col("place") == 0))
    blocks = own.groupBy(key, "block").agg(pick(0).alias("timestamp"), pick(1).alias("title"), pick(2).alias("artist"), form.alias("form"), F.count("*").alias("n"))
    whole = blocks.where("n = 3")
    doc = Window.partitionBy(key)
    held = whole.withColumn("all", F.bool_and("form").over(doc)).withColumn("blocks", F.count("*").over(doc))
    return held.where("all and blocks >= 2").select(key, "block", "timestamp", "title", "artist")


def song_key(artist: Column, title: Column) -> Column:
    return F.concat_ws("|", F.coalesce(F.lower(X.clean_text(artist)), F.lit("")), F.coalesce(F.lower(X.clean_text(title)), F.lit("")))


def dedup_songs(rows: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """One row for each song of a document: the first, unless a later one is more complete; it takes the first's place."""
    own = rows.withColumn("song_key", song_key(F.col("artist"), F.col("title")))
    w = Window.partitionBy(key, "song_key")
    best = F.row_number().over(w.orderBy(F.col("completeness").desc(), order))
    own = own.withColumn("place", F.min(order).over(w)).withColumn("best", best)
    return own.where("best = 1").drop("best", "song_key")


def merge_sources(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ordered union of several sources (source_rank, source, line_no, artist, title, timestamp): one row a song, all its sources, missing fields filled from later ones."""
    own = rows.withColumn("song_key", song_key(F.col("artist"), F.col("title"))).withColumn("ord", F.struct("source_rank", "line_no"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    ranked = F.array_sort(F.collect_set(F.struct("source_rank", "source")))
    out = own.groupBy(key, "song_key").agg(F.min("ord").alias("place"), first("artist"), first("title"), first("timestamp"), F.array_distinct(F.transform(ranked, lambda x: x.source)).alias("sources"))
    return out.drop("song_key")


def signals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each document's lines: times, bare times, pairs, candidate lines, lines; their ratio and whether it has a tracklist's structure."""
    lines = docs.select(key, F.explode(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("line"))
    line = F.col("line")
    bare, timed, pair = line.rlike(rf"^\s*{X.TIME}\s*$"), line.rlike(rf"^\s*[~*#>+\-–—•·‣\[\(\s]*{TIMES}\s+"), line.rlike(X.PAIR)
    lines = X.with_valid(lines)
    marked = lines.select(key, bare.alias("bare"), timed.alias("timed"), pair.alias("pair"), X.section_word(line).alias("word"), (F.col("valid") & (timed | pair)).alias("candidate"))
    n = lambda c: F.count_if(F.col(c))
    out = marked.groupBy(key).agg(
        (n("timed") + n("bare")).alias("timestamp_count"), n("bare").alias("bare_timestamp_count"), n("pair").alias("pattern_count"),
        n("candidate").alias("candidate_line_count"), F.count("*").alias("line_count"), F.bool_or("word").alias("word"),
    )
    ratio = F.round(F.col("candidate_line_count") / F.greatest("line_count", F.lit(1)), 3)
    shape = (F.col("timestamp_count") >= 2) | (F.col("pattern_count") >= 2) | (F.col("candidate_line_count") / F.col("line_count") >= 0.35) | F.col("word")
    return out.withColumn("candidate_line_ratio", ratio).withColumn("has_tracklist_structure", shape).drop("word")


TIMES = rf"(?:{X.TIME})"


def song_metrics(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("song_count"), F.count_if("is_complete").alias("complete_song_count"), F.round(F.avg("completeness"), 3).alias("avg_completeness"))


def validity(docs: DataFrame, metrics: DataFrame, signal: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whether a document's songs stand, and why or why not; documents without songs too."""
    own = docs.select(key, F.length(F.trim(F.coalesce(F.col(text), F.lit("")))).alias("n")).join(signal, key, "left").join(metrics, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    total, done, avg, ts, pairs = z("song_count"), z("complete_song_count"), z("avg_completeness"), z("timestamp_count"), z("pattern_count")
    strong = (ts >= 2) | (pairs >= 2) | (z("candidate_line_ratio") >= 0.35) | F.coalesce("has_tracklist_structure", F.lit(False))
    absolute = (total >= MIN_SONGS) & (done >= MIN_COMPLETE) & (avg >= MIN_AVERAGE)
    pattern = (total >= 2) & (done >= 1) & strong
    why = F.when(absolute, "absolute_threshold_met").when(pattern & (ts >= 2), "timestamp_pattern_detected").when(pattern & (pairs >= 2), "artist_title_delimiter_pattern_detected")
    why = why.when(pattern & (z("candidate_line_ratio") >= 0.35), "candidate_line_ratio_detected").when(pattern, "tracklist_structure_detected").otherwise("")
    fail = (
        F.when(absolute | pattern, "").when(F.col("n") < 20, "too_short").when((ts == 0) & (total == 0), "no_timestamps").when((total > 0) & (total < MIN_SONGS) & ~strong, "too_few_songs_without_pattern")
        .when((total > 0) & (avg < MIN_AVERAGE), "low_completeness").when((pairs == 0) & ~strong, "no_pattern").when(total < MIN_SONGS, "too_few_songs").otherwise("no_pattern")
    )
    return own.select(key, (absolute | pattern).alias("success"), (pattern & ~absolute).alias("is_partial_but_valid"), why.alias("validity_reason"), fail.alias("failure_reason"), total.alias("song_count"), done.alias("complete_song_count"), avg.alias("avg_completeness"))


def analysis_state(verdict: DataFrame, key: str = "doc_id") -> DataFrame:
    """text_success, partial_success or text_failed, with reasons and the next action."""
    total, done, avg = F.col("song_count"), F.col("complete_song_count"), F.col("avg_completeness")
    reasons = F.array(
        F.when(total < 3, F.lit("too_few_songs")), F.when(done < 2, F.lit("too_few_complete_songs")), F.when((total > 0) & (done / total < 0.7), F.lit("many_incomplete_songs")),
        F.when((avg > 0) & (avg < 0.6), F.lit("low_completeness")), F.when(F.col("failure_reason") != "", F.col("failure_reason")),
    )
    reasons = F.filter(reasons, lambda x: x.isNotNull())
    state = F.when((total == 0) | ~F.col("success"), "text_failed").when(F.size(reasons) > 0, "partial_success").otherwise("text_success")
    out = verdict.select(key, state.alias("state"), F.array_join(reasons, ",").alias("reasons"))
    return out.withColumn("next_action", F.when(F.col("state") == "text_success", "match_candidates").otherwise("choose_fallback"))


def fallback(verdict: DataFrame, signal: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which other reading of the media to try: ocr or acr, and why."""
    own = verdict.join(signal, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    visible = (z("timestamp_count") >= 2) | (z("pattern_count") >= 2) | F.coalesce("has_tracklist_structure", F.lit(False))
    empty = F.col("failure_reason").isin("", "too_short", "no_timestamps", "no_pattern", "noisy_comments", "too_few_songs_without_pattern")
    stage = F.when(visible, "ocr").when(empty, "acr").otherwise("ocr")
    why = F.when(visible, "visible_tracklist_possible").when(empty, "no_text_or_visible_tracklist_signal").otherwise("low_completeness_or_pattern_gap")
    return own.select(key, stage.alias("recommended_stage"), why.alias("reason"))


def mode_artist(rows: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The artist of SINGLE_SHARE or more of a document's named songs (two at least), in its first spelling; ties go to the first named."""
    named = rows.where("artist is not null").groupBy(key, F.lower("artist").alias("k")).agg(F.count("*").alias("n"), F.min(order).alias("at"), F.min_by("artist", order).alias("artist"))
    top = named.groupBy(key).agg(F.sum("n").alias("named"), F.max(F.struct("n", (-F.col("at")).alias("at"), "artist")).alias("t"))
    return top.where((F.col("named") >= 2) & (F.col("t.n") / F.col("named") >= SINGLE_SHARE)).select(key, F.col("t.artist").alias("artist"), F.round(F.col("t.n") / F.col("named"), 4).alias("share"))


def with_artist_hint(rows: DataFrame, single: DataFrame, key: str = "doc_id") -> DataFrame:
    """Songs without an artist, or whose artist is their title, get the document's single artist as a hint."""
    own = rows.join(single.select(key, F.col("artist").alias("single")), key, "left")
    open_ = F.col("single").isNotNull() & (F.col("artist").isNull() | (X.match_text(F.col("artist")) == X.match_text(F.col("title"))))
    return own.withColumn("artist_hint", F.when(open_, F.col("single"))).withColumn("artist", F.when(~open_, F.col("artist"))).withColumn("artist_inferred", open_).drop("single")


def hashtags(docs: DataFrame, key: str = "doc_id", text: str = "text", stop: tuple[str, ...] = ("playlist", "music", "kpop", "shorts", "live", "mix")) -> DataFrame:
    """Distinct hashtags that may be artists, with how often they occur."""
    tags = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"#([A-Za-z가-힣][A-Za-z0-9가-힣_]{1,30})"), F.lit(1))).alias("t"))
    tags = tags.select(key, F.trim(F.replace("t", F.lit("_"), F.lit(" "))).alias("tag"))
    ok = F.length("tag").between(2, 40) & ~F.lower("tag").isin(list(stop))
    return tags.where(ok).groupBy(key, F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def grounded(candidates: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of another extractor whose raw_line the document holds."""
    return candidates.join(docs.select(key, F.col(text).alias("_text")), key).where(F.contains("_text", "raw_line")).drop("_text")


def choose_source(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of a document's sources (source, source_rank, success) the first that succeeded, else none."""
    ok = F.when(F.col("success"), F.col("source_rank"))
    return rows.groupBy(key).agg(F.coalesce(F.min_by("source", ok), F.lit("none")).alias("source"), F.count("*").alias("sources"))


def cascade(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The songs of each document by source: the first source that succeeded; where none did, all partial sources merged.

    rows: key, source, source_rank, success, line_no, artist, title, timestamp. Adds chosen: the source's name, or merged.
    """
    ok = F.min(F.when(F.col("success"), F.col("source_rank"))).over(Window.partitionBy(key))
    own = rows.withColumn("_ok", ok).where(F.col("_ok").isNull() | (F.col("source_rank") == F.col("_ok"))).withColumn("chosen", F.when(F.col("_ok").isNull(), "merged").otherwise(F.col("source")))
    names = own.groupBy(key).agg(F.first("chosen").alias("chosen"))
    return merge_sources(own.drop("_ok", "chosen"), key).join(names, key)
