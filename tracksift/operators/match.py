"""Around the scores: alias groups, search queries, what a query says of a candidate, gates, adjustments, statuses, and whole batches.

Rows are those of resolve.scored(): one row for each song and candidate, with title_score, artist_score, overlap,
artist_alias, title_alias, suspicious, score, api_rank and both sides' names. All are projections; only
match_batch() shuffles, on match keys and song ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import hangul as H
from tracksift.functions import lexicon as L
from tracksift.functions import text as X
from tracksift.operators import resolve as R
from tracksift.operators import retrieve
from tracksift.session import cut

#: Thresholds of the matching rules.
EARLY_STOP, MIN_ARTIST, MIN_TITLE, REVIEW_SCORE = 0.85, 0.45, 0.45, 0.55
ARTIST_ID_SCORE, ROMANISED = 0.78, 0.55
MISMATCH_TITLE, MISMATCH_ARTIST = 0.45, 0.85
ACCEPTABLE_WORDS = ["live", "remaster", "remastered", "acoustic", "duet", "explicit", "radio edit", "edit"]
NON_ORIGINAL_WORDS = ["mr", "karaoke", "noraebang", "노래방", "금영", "ky", "tj", "cover", "piano cover", "remix", "prod by", "produced by", "performance", "instrumental", "inst", "tribute", "lullaby", "nightcore", "vocal version", "backing track", "sing along", "sing-along", "in the style of"]
NON_ORIGINAL_PHRASES = r"(?i)made\s+popular\s+by|as\s+(?:performed|recorded|made)\s+by|originally\s+(?:performed|recorded)\s+by|in\s+the\s+style\s+of|vocal\s+version|backing\s+track|sing[\s-]along"


def alias_groups(aliases: DataFrame) -> DataFrame:
    """alias_key, keys: for each name's key the keys of all names of its groups. aliases: canonical, alias."""
    every = aliases.select("canonical", "alias").union(aliases.select("canonical", F.col("canonical").alias("alias")))
    keyed = every.select("canonical", X.artist_key(F.col("alias")).alias("alias_key")).where("alias_key <> ''").distinct()
    group = keyed.groupBy("canonical").agg(F.collect_set("alias_key").alias("own"))
    return keyed.join(group, "canonical").groupBy("alias_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("keys"))


def canonical_title(rows: DataFrame, aliases: DataFrame, column: str = "title") -> DataFrame:
    """rows with {column}_canonical: the least canonical title whose alias has the same normal form, else the title."""
    every = aliases.select("canonical", X.match_text(F.col("alias")).alias("_k")).union(aliases.select("canonical", X.match_text(F.col("canonical")).alias("_k")))
    one = every.groupBy("_k").agg(F.min("canonical").alias("_c"))
    own = rows.withColumn("_k", X.match_text(F.col(column))).join(one, "_k", "left")
    return own.withColumn(f"{column}_canonical", F.coalesce("_c", column)).drop("_k", "_c")


def match_key(title: Column, artist: Column) -> Column:
    """One key for songs that are matched once."""
    return F.concat_ws("|", F.coalesce(X.match_key(X.search_artist(artist)), F.lit("")), F.coalesce(X.match_key(title), F.lit("")))


def queries(title: Column, artist: Column) -> Column:
    """Search queries of a song, in order: by fields, both as free text, the title alone where there is no artist."""
    t = F.coalesce(F.get(X.title_variants(title), F.lit(0)), F.trim(title), F.lit(""))
    a = F.coalesce(X.search_artist(artist), F.lit(""))
    one = lambda mode, q: F.struct(F.lit(mode).alias("mode"), t.alias("title"), a.alias("artist"), q.alias("query"))
    fielded = F.concat(F.lit('track:"'), t, F.lit('" artist:"'), a, F.lit('"'))
    free = F.trim(F.concat_ws(" ", t, a))
    return F.filter(F.array(F.when((t != "") & (a != ""), one("track_artist", fielded)), F.when(free != "", one("query", free))), lambda x: x.isNotNull())


def cases(songs: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """song_id, case_no, query_no, mode, title, artist, query: the song as it is and, with hints (song_id, artist), under the hinted artist too."""
    own = songs.select("song_id", F.lit(0).alias("case_no"), "title", "artist")
    if hints is not None:
        other = songs.join(hints.select("song_id", F.col("artist").alias("hint")), "song_id").where("hint is not null and not (hint <=> artist)")
        own = own.unionByName(other.select("song_id", F.lit(1).alias("case_no"), "title", F.col("hint").alias("artist")))
    each = own.select("song_id", "case_no", F.posexplode(queries(F.col("title"), F.col("artist"))).alias("query_no", "q"))
    return each.select("song_id", "case_no", "query_no", "q.*")


def _names_in(query: Column, title: Column, artist: Column) -> tuple[Column, Column]:
    q, t = X.match_text(query), X.match_text(title)
    part = lambda p: (X.match_text(p) != "") & F.contains(q, X.match_text(p))
    return (t != "") & F.contains(q, t), F.coalesce(F.exists(X.artist_parts(artist), part), F.lit(False))


def query_has_both(query: Column, title: Column, artist: Column) -> Column:
    """The query holds the title and, if there is one, an artist."""
    t, a = _names_in(query, title, artist)
    return t & (F.coalesce(artist, F.lit("")).eqNullSafe("") | a)


def reliability(query: Column, title: Column, artist: Column, primary: Column) -> Column:
    """high if the first query holds title and artist, medium if another does, else low."""
    t, a = _names_in(query, title, artist)
    return F.when(t & a, F.when(primary, "high").otherwise("medium")).otherwise("low")


def rank_score(rank: Column, limit: int = R.LIMIT) -> Column:
    return F.greatest(F.lit(0.0), (limit - rank + 1) / limit)


def collision_risk(title: Column) -> Column:
    """high for titles of one word, medium for two short ones, else low."""
    words = F.filter(F.split(X.match_text(title), " "), lambda w: w != "")
    return F.when(F.size(words) <= 1, "high").when((F.size(words) == 2) & F.forall(words, lambda w: F.length(w) <= 5), "medium").otherwise("low")


def mismatch_severity(artist_score: Column) -> Column:
    return F.when(artist_score < 0.3, "confirmed_wrong").when(artist_score < 0.45, "ambiguous").otherwise("partial")


def has_artist_id(ids: Column, wanted: Column) -> Column:
    """Whether a track's artist ids hold the one wanted; a blank wish holds for all."""
    return (F.coalesce(F.trim(wanted), F.lit("")) == "") | F.coalesce(F.array_contains(ids, F.trim(wanted)), F.lit(False))


def artist_ids(names: DataFrame, artists: DataFrame, limit: int = R.LIMIT) -> DataFrame:
    """artist, artist_id, score: each name's best of the `limit` artists found by its tokens, if similar enough.

    artists: artist_id, name, popularity. Found means sharing a token of the normal form; of those, the most alike in
    tokens, then the most popular.
    """
    left = names.select("artist").distinct().withColumn("n", X.match_text(F.col("artist"))).where("n <> ''")
    right = artists.withColumn("m", X.match_text(F.col("name")))
    split = lambda c: F.explode(F.filter(F.split(c, " "), lambda x: x != ""))
    pairs = left.select("artist", "n", split(F.col("n")).alias("t")).join(right.select("artist_id", "m", "popularity", split(F.col("m")).alias("t")), "t").drop("t").distinct()
    shared = X.overlap_of_tokens(F.split("n", " "), F.split("m", " "))
    w = Window.partitionBy("artist").orderBy(F.col("shared").desc(), F.col("popularity").desc(), "artist_id")
    found = pairs.withColumn("shared", shared).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    found = found.withColumn("score", F.round(X.best_similarity(F.array("n"), F.array("m")), 4))
    best = found.groupBy("artist").agg(F.max(F.struct("score", (-F.col("r")).alias("r"), "artist_id")).alias("b"))
    return best.where(F.col("b.score") >= ARTIST_ID_SCORE).select("artist", F.col("b.artist_id").alias("artist_id"), F.col("b.score").alias("score"))


def romanised(artist: Column, names: Column, resolved: Column | None = None) -> Column:
    """A Hangul artist may be one of the Latin names: it is like one when written in Latin letters, or its known other name (resolved) is, or their keys are the same."""
    asked = X.has_hangul(artist) & F.exists(names, X.has_latin)
    latin = F.transform(names, X.match_text)
    spelt = F.transform(H.name_spellings(artist), X.match_text)
    if resolved is not None:
        spelt = F.when(X.artist_key(resolved) != X.artist_key(artist), F.array_append(spelt, X.match_text(resolved))).otherwise(spelt)
    like = X.best_similarity(F.when(asked, spelt), F.when(asked, latin)) >= ROMANISED  # other rows need no matching
    same = F.exists(names, lambda n: X.artist_key(n) == X.artist_key(artist))
    return F.coalesce(asked & (like | same), F.lit(False))


def with_romanised(rows: DataFrame) -> DataFrame:
    """rows with whether the candidate's artist may be the song's in Latin letters, found once."""
    return rows if "romanised" in rows.columns else rows.withColumn("romanised", romanised(F.col("artist"), F.array("artist_name")))


def notation(rows: DataFrame) -> DataFrame:
    """rows with notation_reasons (array) and notation_difference: the names may be the same in another script."""
    ht, ha = F.coalesce(X.has_hangul(F.col("title")), F.lit(False)), F.coalesce(X.has_hangul(F.col("artist")), F.lit(False))
    latin = lambda c: X.has_latin(F.col(c)) & ~X.has_hangul(F.col(c))
    shape = lambda c: latin(c) & F.size(F.split(X.match_text(F.col(c)), " ")).between(1, 6)
    t, a = F.col("title_score"), F.col("artist_score")
    found = F.filter(F.array(
        F.when(ht & latin("name"), F.lit("korean_title_english_candidate")), F.when(ha & latin("artist_name"), F.lit("korean_artist_romanized_candidate")),
        F.when((ht | ha) & (X.upper_latin(F.col("name")) | X.upper_latin(F.col("artist_name"))), F.lit("korean_input_uppercase_english_candidate")),
        F.when(ht & shape("name"), F.lit("official_english_title_shape")), F.when(ha & shape("artist_name"), F.lit("romanized_artist_shape")),
    ), lambda x: x.isNotNull())
    low = (F.col("api_rank") == 1) & F.col("reliability").isin("high", "medium") & (t < 0.45) & (a < 0.45) & (F.size(found) > 0)
    found = F.when(low, F.array_append(found, F.lit("low_string_score_rank1_reliable_query"))).otherwise(found)
    explicit = F.col("artist_alias") | F.col("title_alias") | (t >= 0.55) | (ha & X.has_latin(F.col("artist_name")) & ~X.has_hangul(F.col("artist_name")) & (a >= 0.55))
    own = rows.withColumn("notation_reasons", found)
    return own.withColumn("notation_difference", F.coalesce((F.size("notation_reasons") > 0) & explicit, F.lit(False)))


def strong_evidence() -> Column:
    return (
        (F.col("artist_score") >= 0.8) | (F.col("title_score") >= 0.8) | F.col("artist_alias") | F.col("title_alias") | (F.col("overlap") > 0)
        | ((F.col("reliability") == "high") & F.col("notation_difference"))
    )


def signal(rows: DataFrame) -> DataFrame:
    """rows with signal_score, signal_reason, signal_blocked: what the search engine's first rank adds, or why it adds nothing.

    Needs reliability and query_has_both besides scored()'s columns.
    """
    own = notation(rows)
    t, a, given = F.col("title_score"), F.col("artist_score"), F.col("artist").isNotNull()
    title_ok, artist_ok = (t >= 0.72) | F.col("title_alias"), ~given | (a >= 0.6) | F.col("artist_alias")
    gap = F.col("notation_difference")
    blocked = (
        F.when(F.col("api_rank") != 1, "not_rank1").when(F.col("reliability") == "low", "low_query_reliability").when(F.col("suspicious") > 0, "non_original_or_version_candidate")
        .when((t >= 0.95) & given & (a < MIN_ARTIST) & ~F.col("artist_alias"), "title_exact_artist_mismatch").when((a >= 0.95) & (t < 0.35) & ~(F.col("title_alias") | gap), "artist_exact_title_mismatch")
        .when((t >= 0.95) & given & ~artist_ok, "possible_same_title_different_artist").when(~(title_ok | artist_ok | (F.col("overlap") > 0) | gap), "no_explainable_title_or_artist_evidence")
    )
    high = (F.col("reliability") == "high") & F.col("query_has_both")
    reason = (
        F.when(high & artist_ok, "high_query_rank1_artist_variant_alias_or_romanization").when(high & title_ok, "high_query_rank1_title_variant_alias_or_romanization")
        .when(high & gap, "high_query_rank1_notation_difference").when((F.col("reliability") == "medium") & gap, "medium_query_rank1_notation_difference")
    )
    own = own.withColumn("signal_blocked", F.coalesce(blocked, F.lit(""))).withColumn("signal_reason", F.when(F.col("signal_blocked") == "", F.coalesce(reason, F.lit(""))).otherwise(""))
    size = F.when(F.col("signal_reason") == "", 0.0).when(F.col("reliability") == "medium", 0.14).when(F.col("signal_reason").endswith("notation_difference"), 0.18).otherwise(0.22)
    own = own.withColumn("signal_score", size)
    s = F.least(F.lit(1.0), F.col("score") + F.col("signal_score"))
    s = F.when((F.col("score") < REVIEW_SCORE) & high & gap, F.greatest(s, F.lit(REVIEW_SCORE))).otherwise(s)
    s = F.when((F.col("reliability") == "high") & (title_ok | artist_ok) & gap, F.greatest(s, F.lit(0.75))).otherwise(s)
    s = F.when((t >= 0.95) & (a >= 0.7) & strong_evidence(), F.greatest(s, F.lit(0.82))).otherwise(s)
    return own.withColumn("signal_total", F.round(F.when(F.col("signal_score") > 0, s).otherwise(F.col("score")), 4))


def evidence_gate(rows: DataFrame) -> DataFrame:
    """rows with matched_evidence (array) and no_evidence: nothing ties the candidate to the song."""
    rows = with_romanised(rows)
    latin = X.has_hangul(F.col("artist")) & X.has_latin(F.col("artist_name")) & ((F.col("artist_score") >= 0.72) | F.col("romanised"))
    found = F.filter(F.array(
        F.when(F.col("artist_alias"), F.lit("artist_alias_match")), F.when(latin, F.lit("artist_romanization_match")),
        F.when(F.col("title_score") >= 0.55, F.lit("title_direct_match")), F.when(F.col("overlap") > 0, F.lit("token_overlap")),
    ), lambda x: x.isNotNull())
    own = rows.withColumn("matched_evidence", found)
    return own.withColumn("no_evidence", F.size("matched_evidence") == 0)


def _holds(words: list[str], text: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def version_tags(rows: DataFrame) -> DataFrame:
    """rows with acceptable_version, non_original, hard_non_original: what kind of recording the candidate names."""
    text = F.concat_ws(" ", "c_title", *(["c_album"] if "c_album" in rows.columns else []), "c_artist")
    raw = F.concat_ws(" ", "name", "artist_name")
    return rows.withColumns({
        "acceptable_version": _holds(ACCEPTABLE_WORDS, text) | (R.penalties()[1] > 0), "non_original": _holds(NON_ORIGINAL_WORDS, text) | raw.rlike(NON_ORIGINAL_PHRASES),
        "hard_non_original": F.arrays_overlap(F.split(text, " "), F.array(*[F.lit(w) for w in ("karaoke", "instrumental", "piano")])),
    })


def candidate_type(name: Column, artist: Column) -> Column:
    """The kind of recording that a candidate's names give away, else official_track."""
    raw = F.concat_ws(" ", name, artist)
    return (
        F.when(raw.rlike(NON_ORIGINAL_PHRASES), "made_popular_by").when(raw.rlike(r"(?i)\bkaraoke\b|노래방|\bnoraebang\b"), "karaoke").when(raw.rlike(r"(?i)\btribute\b"), "tribute").when(raw.rlike(r"(?i)\bcover\b"), "cover")
        .when(raw.rlike(r"(?i)\bremix\b"), "remix").when(raw.rlike(r"(?i)\b(?:instrumental|inst)\b"), "instrumental").when(raw.rlike(r"(?i)\b(?:live|concert)\b"), "live").when(raw.rlike(r"(?i)\b(?:acoustic|piano|version|ver)\b"), "version")
        .otherwise("official_track")
    )


def adjusted(rows: DataFrame) -> DataFrame:
    """rows with adjusted_score: the weighted score with the patterns' bonuses, floors, penalties and caps (version_tags() first)."""
    t, a, given = F.col("title_score"), F.col("artist_score"), F.col("artist").isNotNull()
    alias = F.col("artist_alias")
    same_script = alias | F.col("title_alias") | (t >= 0.9) | (a >= 0.9)
    top = (F.col("api_rank") == 1) & ((t >= 0.95) | (a >= 0.95))
    only_artist, only_title = given & (a >= 0.85) & (t < 0.55), given & (t >= 0.85) & (a < MIN_ARTIST)
    short = (F.size("s_tokens") <= 2) & (t >= 0.8) & (a < MIN_ARTIST) & ~alias & ((collision_risk(F.col("title")) == "high") | (F.size("c_tokens") >= F.size("s_tokens") + 3))
    weak = (t < 0.4) & (~given | (a < 0.4))
    version = F.col("suspicious") > 0
    ok_version = F.col("acceptable_version")
    gap = same_script & top & ((t >= 0.98) | (a >= 0.98)) & (alias | (F.col("title_alias") & (a >= MIN_ARTIST)))
    on = lambda c, x: F.when(c, x).otherwise(0.0)
    s = F.col("score") + on((t >= 0.95) & (~given | (a >= 0.85)), 0.03) + on(same_script, 0.03)
    floor = F.when((t >= 0.98) & (a >= 0.85), 0.8).otherwise(0.72)
    s = F.when(same_script & (t >= 0.92) & (a >= 0.7), F.greatest(s, floor)).otherwise(s)
    s = F.when(same_script & (t >= 0.98) & (a < MIN_ARTIST) & (alias | (a >= 0.25)), F.greatest(s, F.lit(0.78))).otherwise(s)
    s = F.when(same_script & (a >= 0.98) & (t < MIN_TITLE), F.greatest(s, F.lit(0.72))).otherwise(s)
    _, versions = R.penalties()
    loss = F.when(versions > 0, F.least(versions, F.lit(0.08))).otherwise(0.04)
    s = s + on(top, 0.1) - on(ok_version | (versions > 0), loss) - on(F.col("non_original"), 0.35) - on(version, 0.25) - on(only_title & ~gap, 0.12) - on(short, 0.2)
    caps = [(F.col("non_original"), 0.49), (version, 0.64), (only_artist & ~gap, 0.69), (only_title & ~gap, 0.69), (short, 0.62), (weak, 0.49)]
    for c, cap in caps:
        s = F.when(c, F.least(s, F.lit(cap))).otherwise(s)
    return rows.withColumn("short_title", short).withColumn("adjusted_score", F.round(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)), 4))


def reason(rows: DataFrame) -> DataFrame:
    """rows with reason: the first thing that speaks against a candidate, or matched. evidence_gate() finds romanised artists; without it none is known."""
    like = F.col("romanised") if "romanised" in rows.columns else F.lit(False)
    t, a, given, s = F.col("title_score"), F.col("artist_score"), F.col("artist").isNotNull(), F.col("evidence_score")
    why = (
        F.when(F.col("status") == R.INVALID, "invalid_candidate").when(F.col("suspicious") > 0, "version_candidate").when(F.col("non_original"), "non_original_audio")
        .when(given & (a >= 0.85) & (t < 0.55), "artist_only_overconfidence").when(given & (t >= 0.85) & (a < MIN_ARTIST), "title_only_overconfidence").when(F.col("short_title"), "short_title_false_positive")
        .when(F.col("acceptable_version"), "version_candidate").when(s >= 0.82, "matched").when(given & (t >= 0.95) & (a < MIN_ARTIST), "title_matched_artist_alias_candidate")
        .when(given & (a >= 0.95) & (t < MIN_TITLE), "artist_matched_title_mismatch").when(given & (F.col("api_rank") == 1) & (t < MISMATCH_TITLE) & like & ~((a >= MISMATCH_ARTIST) | F.col("artist_alias")), "top_candidate_artist_romanization_title_mismatch")
        .when((t < 0.4) & (~given | (a < 0.4)), "weak_title_and_artist").when(t < MIN_TITLE, "title_mismatch")
        .when(given & (a < MIN_ARTIST), "artist_mismatch").when(s >= REVIEW_SCORE, "partial_match_needs_review").otherwise("low_score")
    )
    return rows.withColumn("reason", why)


def rejection(why: Column) -> Column:
    """The few reasons that are shown, from reason()."""
    return (
        F.when(why.contains("non_original") | (why == "version_candidate"), "non_original").when(why.contains("title"), "low_title_sim")
        .when(why.contains("artist"), F.when(why.contains("romanization") | why.contains("alias"), "romanization_mismatch").otherwise("low_artist_sim"))
        .when(why.contains("no_search_result"), "no_search_result").when(F.coalesce(why, F.lit("")) == "", "low_title_sim").otherwise(why)
    )


def final_status(rows: DataFrame) -> DataFrame:
    """rows with match_status, ui_status, rejection_reason and decision: tags override what the evidence says."""
    own = reason(adjusted(version_tags(rows)))
    status = (
        F.when(F.col("status") == R.INVALID, R.INVALID).when(F.col("non_original") & (F.col("hard_non_original") | ~F.col("acceptable_version")), "unmatched")
        .when((F.col("suspicious") > 0) & ~F.col("acceptable_version") & (F.col("evidence_score") < REVIEW_SCORE), "unmatched").otherwise(F.col("status"))
    )
    own = own.withColumn("match_status", status)
    decision = F.when(F.col("match_status") == R.INVALID, "rejected").when(F.col("match_status").isin(R.REVIEW, R.LOW), "warning").otherwise("selectable")
    return own.withColumns({
        "ui_status": F.when(F.col("match_status") == R.REVIEW, R.LOW).otherwise(F.col("match_status")),
        "rejection_reason": F.when(F.col("match_status") == R.MATCHED, "").otherwise(rejection(F.col("reason"))), "decision": decision,
    })


def acceptable(rows: DataFrame) -> Column:
    """Whether a candidate may be taken as it is; recoverable() ones may be taken after a look."""
    return F.col("match_status") == R.MATCHED


def recoverable(rows: DataFrame) -> Column:
    return (F.col("evidence_score") > 0) & F.col("match_status").isin(R.REVIEW, R.LOW) & ~((F.col("suspicious") > 0) & (F.col("evidence_score") < REVIEW_SCORE))


def search_tiers(rows: DataFrame) -> DataFrame:
    """rows of the query that counts: the first whose best candidate reaches EARLY_STOP, or all of them if none does.

    rows hold query_no; a candidate that several queries found counts with its first.
    """
    w = Window.partitionBy("song_id")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("song_id", "track_id").orderBy("query_no", "api_rank"))).where("_n = 1").drop("_n")
    stop = F.min(F.when(F.col("evidence_score") >= EARLY_STOP, F.col("query_no"))).over(w)
    return once.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("query_no") <= F.col("_stop"))).drop("_stop")


def searched(songs: DataFrame, catalog: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Scored candidates of every query of each song, with query_no, reliability and query_has_both.

    The first query asks for title and artist by field, so its candidates share something of both; the free query asks for
    either. A song without an artist has the free query only.
    """
    s, c = R.named(songs, catalog, groups)
    postings = cut(retrieve.index(c, R.LIMIT), "postings")  # both queries read it
    found = lambda fields, mode: retrieve.top(s, postings, R.LIMIT, fields).select("song_id", "track_id", "block_score", "api_rank", F.lit(mode).alias("mode"))
    ranks = cut(found(retrieve.ANY, "query").unionByName(found(retrieve.BOTH, "track_artist")), "ranks")
    # a pair that both find is scored once
    pairs = ranks.groupBy("song_id", "track_id").agg(F.max("block_score").alias("block_score"))
    scored = R.scored(pairs.join(s, "song_id").join(c, "track_id"))
    each = cases(songs).select("song_id", "query_no", "mode", "query")
    rows = ranks.drop("block_score").join(each, ["song_id", "mode"]).join(scored, ["song_id", "track_id"])
    t, a = F.col("title"), F.col("artist")
    return rows.withColumns({"reliability": reliability(F.col("query"), t, a, F.col("query_no") == 0), "query_has_both": query_has_both(F.col("query"), t, a)})


def choose(rows: DataFrame) -> DataFrame:
    """One candidate a song and its runners-up: the acceptable one of the highest score, else the recoverable one of the best status; top: the three best.

    Ties go to popularity, title and artist scores, rank and id.
    """
    tier = F.when(acceptable(rows), 0).when(recoverable(rows), F.when(F.col("match_status") == R.REVIEW, 1).otherwise(2)).otherwise(3)
    own = rows.withColumn("tier", tier)
    weight = F.when(F.col("reliability") == "high", 3).when(F.col("reliability") == "medium", 2).otherwise(1)
    order = ["tier", F.col("evidence_score").desc(), F.col("signal_score").desc(), weight.desc(), F.col("artist_score").desc(), F.col("title_score").desc(), "api_rank", F.col("popularity").desc(), "track_id"]
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("song_id").orderBy(*order)))
    top = own.where("rank <= 3").groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id", "evidence_score", "match_status"))).alias("top"))
    return own.where("rank = 1 and tier < 3").join(top, "song_id")


def explain(rows: DataFrame) -> DataFrame:
    """song_id, track_id and a struct of all that the decision rests on."""
    parts = ["query_no", "reliability", "signal_score", "signal_reason", "signal_blocked", "title_score", "artist_score", "overlap", "score", "adjusted_score", "pattern", "evidence_score", "matched_evidence", "notation_reasons", "reason", "rejection_reason"]
    return rows.select("song_id", "track_id", F.struct(*parts).alias("explain"))


def match_batch(songs: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, audio_ids: DataFrame | None = None) -> DataFrame:
    """songs (song_id, title, artist) with their match: track_id, match_status, evidence_score, reason, rejection_reason, top; unmatched songs too.

    Songs with one match key are matched once (the one with the least id) and share the result. A song that isn't one
    (no title, or the artist's name as title) is suspicious and isn't searched for. audio_ids (song_id, track_id)
    raise the recognised track. aliases: canonical, alias. Where the catalogue has albums, they count as metadata.with_detail() says.
    """
    own = songs.withColumn("_key", match_key(F.col("title"), F.col("artist"))).withColumn("suspicious_song", suspicious_song(F.col("title"), F.col("artist")))
    firsts = own.where("not suspicious_song").groupBy("_key").agg(F.min("song_id").alias("_first"))
    asked = own.join(firsts, (own["_key"] == firsts["_key"]) & (own["song_id"] == firsts["_first"])).select("song_id", "title", "artist")
    groups = alias_groups(aliases) if aliases is not None else None
    rows = signal(evidence_gate(searched(asked, catalog, groups)))
    if "album" in catalog.columns:
        from tracksift.operators import metadata  # it builds on this module

        rows = metadata.with_detail(rows)
    else:
        rows = R.with_evidence(rows)
    if audio_ids is not None:
        rows = R.with_audio_id(rows, audio_ids)
    best = choose(final_status(search_tiers(rows)))
    best = best.select(F.col("song_id").alias("_of"), "track_id", "match_status", "evidence_score", "signal_score", "reason", "rejection_reason", "top")
    out = own.join(firsts, "_key", "left").join(best, F.col("_first") == F.col("_of"), "left")
    miss = lambda c, x: F.when(F.col("suspicious_song"), "suspicious_song" if c != "match_status" else "unmatched").otherwise(F.coalesce(c, F.lit(x)))
    return out.select("song_id", "title", "artist", "track_id", miss("match_status", "unmatched").alias("match_status"), F.coalesce("evidence_score", F.lit(0.0)).alias("evidence_score"), miss("reason", "no_search_result").alias("reason"), miss("rejection_reason", "no_search_result").alias("rejection_reason"), "top")


def suspicious_song(title: Column, artist: Column) -> Column:
    """No title, or a title that is the artist's name."""
    t, a = F.coalesce(F.trim(title), F.lit("")), F.coalesce(F.trim(artist), F.lit(""))
    return (t == "") | ((a != "") & (X.match_text(t) == X.match_text(a)))


def confirmed(before: DataFrame | None, new: DataFrame) -> DataFrame:
    """key, track_id, confirmations: each confirmed match's key with its last track and how often it was confirmed.

    new: title, artist, track_id, at; before: an earlier result with `at`.
    """
    one = new.select(X.match_id(F.col("title"), F.col("artist")).alias("key"), "track_id", F.lit(1).cast("long").alias("confirmations"), "at")
    every = one if before is None else before.select("key", "track_id", "confirmations", "at").unionByName(one)
    return every.groupBy("key").agg(F.max_by("track_id", F.struct("at", "track_id")).alias("track_id"), F.sum("confirmations").alias("confirmations"), F.max("at").alias("at"))


def with_confirmed(songs: DataFrame, known: DataFrame) -> DataFrame:
    """songs with confirmed_track_id where the match was confirmed before."""
    own = songs.withColumn("_k", X.match_id(F.col("title"), F.col("artist")))
    return own.join(known.select(F.col("key").alias("_k"), F.col("track_id").alias("confirmed_track_id")), "_k", "left").drop("_k")
