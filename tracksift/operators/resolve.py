"""Entity resolution: blocking, candidate ranks, scores, evidence patterns, labels. songs × catalogue.

Songs: song_id, title, artist. Catalogue: track_id, name, artist_name, popularity, has_image.
Candidates come from the posting lists of retrieve, never from a cross join or from all pairs of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X
from tracksift.operators import retrieve

LIMIT = 5
#: Labels and gates.
MATCHED, REVIEW, LOW, INVALID = "matched", "review_needed", "low_confidence", "invalid_candidate"


def _normal(rows: DataFrame, title: str, artist: str, by: str) -> DataFrame:
    """rows with normal forms, tokens, spellings and artist keys of both names, once a row rather than once a pair."""
    own = rows.withColumns({f"{by}_title": X.match_text(F.col(title)), f"{by}_artist": X.match_text(F.col(artist)), f"{by}_parts": X.artist_parts(F.col(artist))})
    normal = lambda c: F.array_distinct(F.transform(c, X.match_text))
    own = own.withColumns({
        f"{by}_tokens": X.tokens_of_normal(F.col(f"{by}_title")), f"{by}_names": X.tokens_of_normal(F.col(f"{by}_artist")),
        f"{by}_titles": normal(X.title_variants(F.col(title))), f"{by}_bare": X.match_text(X.title_noise_free(F.col(title))),
        f"{by}_artists": F.array_distinct(F.concat(F.array(f"{by}_artist"), normal(F.col(f"{by}_parts")))),
    })
    return own.withColumn(f"{by}_akeys", F.coalesce(F.array_distinct(F.filter(F.transform(f"{by}_parts", X.artist_key), lambda k: k != "")), F.array().cast("array<string>"))).drop(f"{by}_parts")


def candidates(songs: DataFrame, catalog: DataFrame, limit: int = LIMIT, groups: DataFrame | None = None, fields: str = retrieve.ANY) -> DataFrame:
    """The first `limit` tracks of each song by token overlap of titles and artists, of all that share a token, the title or an artist; api_rank from 1.

    groups (match.alias_groups) lets an artist's other names find tracks. fields: which of title and artist a track must
    match. Lists and hits carry ids only; names and tokens join back on the few that stay.
    """
    s, c = named(songs, catalog, groups)
    ranks = retrieve.top(s, retrieve.index(c, limit), limit, fields).drop("popularity")
    return ranks.join(s, "song_id").join(c, "track_id")


def named(songs: DataFrame, catalog: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Songs and tracks with the normal forms that searching and scoring need."""
    s, c = _normal(songs, "title", "artist", "s"), _normal(catalog, "name", "artist_name", "c")
    return (s if groups is None else with_group_keys(s, groups)), c


def paired(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows that name a song (song_id, title, artist) and a candidate (name, artist_name), ready for scored()."""
    own = _normal(_normal(rows, "title", "artist", "s"), "name", "artist_name", "c")
    return own if groups is None else with_group_keys(own, groups)


def with_group_keys(songs: DataFrame, groups: DataFrame) -> DataFrame:
    """s_akeys with the keys of all other names of the song's artists."""
    each = songs.select("song_id", F.explode("s_akeys").alias("alias_key")).join(groups, "alias_key")
    more = each.groupBy("song_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("more"))
    own = songs.join(more, "song_id", "left")
    return own.withColumn("s_akeys", F.when(F.col("more").isNotNull(), F.array_union("s_akeys", "more")).otherwise(F.col("s_akeys"))).drop("more")


def scored(rows: DataFrame) -> DataFrame:
    """title_score, artist_score, overlap, alias flags, version words and the weighted score (4 places) of candidates().

    Titles and artists score by the best pair of their spellings; an artist that is the same under its key or a
    known alias scores 1.
    """
    given = F.col("artist").isNotNull()
    own = rows.withColumns({
        "artist_alias": given & F.arrays_overlap("s_akeys", "c_akeys"), "title_alias": F.replace(F.col("s_title"), F.lit(" "), F.lit("")) == F.replace(F.col("c_title"), F.lit(" "), F.lit("")),
        "best_title": X.best_similarity(F.col("s_titles"), F.col("c_titles")), "bare_score": X.best_similarity(F.array("s_bare"), F.array("c_bare")),
        "best_artist": X.best_similarity(F.col("s_artists"), F.col("c_artists")),
        "all_tokens": X.overlap_of_tokens(F.array_union(F.coalesce("s_names", F.array().cast("array<string>")), "s_tokens"), F.array_union(F.coalesce("c_names", F.array().cast("array<string>")), "c_tokens")),
    })
    own = own.withColumns({
        "title_score": F.when(F.col("title_alias"), 1.0).otherwise(F.round("best_title", 4)),
        "artist_score": F.when(~given, 0.0).when(F.col("artist_alias"), 1.0).otherwise(F.round("best_artist", 4)),
        "overlap": F.greatest(X.overlap_of_tokens(F.col("s_tokens"), F.col("c_tokens")), F.col("all_tokens")),
        "suspicious": suspicious(),
    })
    return own.withColumn("score", weighted_score()).drop("best_title", "best_artist", "all_tokens")


def suspicious() -> Column:
    """Words of a cover or version that only the candidate has."""
    have, own = (F.split(F.col(c), " ") for c in ("c_title", "s_title"))
    words = F.array(*[F.lit(w) for w in L.SUSPICIOUS_WORDS if " " not in w])
    one = F.size(F.array_except(F.array_intersect(words, have), own))
    phrases = [w for w in L.SUSPICIOUS_WORDS if " " in w]
    return one + sum((F.contains("c_title", F.lit(w)) & ~F.contains("s_title", F.lit(w))).cast("int") for w in phrases)


def _held(words: list[str], text: Column) -> Column:
    """How many of the words a text holds, as a part of other words too."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def penalties() -> tuple[Column, Column]:
    """For words of covers and noise in the candidate's names; for versions that only one of both titles names."""
    names = F.concat_ws(" ", "c_title", "c_artist")
    words = 0.08 * _held(L.SUSPICIOUS_WORDS, names) + 0.03 * _held(L.NOISE_WORDS, names)
    mine, theirs = F.col("s_title"), F.col("c_title")
    versions = F.array(*[F.lit(w) for w in L.VERSION_WORDS])
    more = F.size(F.filter(versions, lambda w: F.contains(theirs, w) & ~F.contains(mine, w)))
    less = F.size(F.filter(versions, lambda w: F.contains(mine, w) & ~F.contains(theirs, w)))
    return F.least(words, F.lit(0.24)), F.least(0.04 * more + 0.02 * less, F.lit(0.18))


def weighted_score() -> Column:
    """Fixed weights of titles, artists, tokens, aliases and popularity, less penalties; 0 to 1, 4 places."""
    t, a, o, n, given = F.col("title_score"), F.col("artist_score"), F.col("overlap"), F.col("bare_score"), F.col("artist").isNotNull()
    pop = F.least(F.coalesce("popularity", F.lit(0)) / 1000, F.lit(0.03))
    on = lambda c, x: F.when(c, x).otherwise(0.0)
    words, versions = penalties()
    alias = on(F.col("artist_alias"), 0.05) + on(F.col("title_alias"), 0.05)
    exact = on(F.col("title_alias"), 0.04) + on(given & (a >= 0.999), 0.03)
    gap = F.when(a < 0.15, 0.14).when(a < 0.35, 0.07).otherwise(0.0)
    both = 0.45 * t + 0.35 * a + 0.05 * n + 0.05 * a + 0.10 * o + alias + exact - gap
    alone = 0.72 * t + 0.12 * n + 0.10 * o + alias + exact
    s = F.when(given, both).otherwise(alone) + pop - words - versions
    s = F.when(given & (t >= 0.85) & (a < 0.2), F.least(s, F.lit(0.64))).otherwise(s)
    return F.round(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)), 4)


def tags() -> Column:
    """Pattern tags in a fixed order, joined by commas."""
    t, a, given = F.col("title_score"), F.col("artist_score"), F.col("artist").isNotNull()
    short = (F.size("s_tokens") <= 2) & (t >= 0.8) & (F.size("c_tokens") >= F.size("s_tokens") + 3) & (a < 0.45)
    out = F.array(
        F.when((t >= 0.95) & (~given | (a >= 0.85)), F.lit("exact")), F.when((t >= 0.9) | (a >= 0.9), F.lit("notation_difference")), F.when(F.col("suspicious") > 0, F.lit("version_candidate")),
        F.when((a >= 0.85) & (t < 0.55), F.lit("artist_only_overconfidence")), F.when((t >= 0.85) & (a < 0.45), F.lit("title_only_overconfidence")), F.when(short, F.lit("short_title_false_positive")),
        F.when((t < 0.4) & (a < 0.4), F.lit("weak_both")), F.when((F.col("api_rank") == 1) & ((t >= 0.95) | (a >= 0.95)), F.lit("top_rank_one_side_exact")),
    )
    return F.array_join(F.filter(out, lambda x: x.isNotNull()), ",")


#: Patterns whose score has a floor.
SURE = ["EXACT_MATCH", "ARTIST_ALIAS_TITLE_MATCH", "TRANSLATED_TITLE_ARTIST_STRONG"]


def pattern_of(version: Column, reliable: Column | None = None, high: Column | None = None) -> Column:
    """A struct of pattern, status and value (before penalties): the first row of the ordered table that holds.

    version: whether the candidate is another version. reliable, high: whether the query names title and artist and is to be
    trusted for a differing title, or for anything; every query is, where they aren't given. Needs scored()'s columns and has_image.
    """
    t, a, rank = F.col("title_score"), F.col("artist_score"), F.col("api_rank")
    alias = F.coalesce("artist_alias", F.lit(False))
    reliable, high = (F.lit(True) if c is None else c for c in (reliable, high))
    image, both = F.coalesce("has_image", F.lit(False)), F.col("artist").isNotNull() & F.col("title").isNotNull()
    hangul_to_latin = X.has_hangul(F.concat_ws(" ", "title", "artist")) & ~X.has_hangul(F.concat_ws(" ", "name", "artist_name"))
    official = (rank == 1) & both & hangul_to_latin & image
    strong = (a >= 0.8) | alias | official
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    table = [
        (version, "VERSION_REVIEW", REVIEW, clamp(0.35 * t + 0.25 * a, 0.5, 0.64)),
        ((t >= 0.85) & (a >= 0.7), "EXACT_MATCH", MATCHED, clamp(0.85 + 0.08 * t + 0.07 * a, 0.85, 1.0)),
        (alias & (t >= 0.75), "ARTIST_ALIAS_TITLE_MATCH", MATCHED, clamp(0.82 + 0.10 * t, 0.85, 1.0)),
        (strong & (t < 0.75) & (rank == 1) & both & reliable & high & official & (alias | (a >= 0.7)), "TRANSLATED_TITLE_ARTIST_STRONG", MATCHED, F.lit(0.86)),
        (strong & (t < 0.75) & (rank == 1) & both & reliable, "ARTIST_STRONG_TITLE_WEAK", REVIEW, F.lit(0.66)),
        ((rank == 1) & both & high & image & official & ((a >= 0.3) | alias), "SEARCH_ENGINE_CONFIDENT", MATCHED, F.lit(0.85)),
        ((rank == 1) & both & high & image, "SEARCH_ENGINE_CONFIDENT", REVIEW, F.lit(0.62)),
        ((t >= 0.8) & (a < 0.3) & ~alias, "TITLE_ONLY_MATCH", REVIEW, F.lit(0.5)),
        (strong & (t < 0.3) & (rank >= 2), "ARTIST_ONLY_MATCH", LOW, F.when(image, 0.52).otherwise(0.45)),
        ((t < 0.2) & (a < 0.2) & ~alias & (rank >= 2), "INVALID", INVALID, F.lit(0.0)),
        (rank == 1, "SEARCH_RANK1_REVIEW", REVIEW, clamp(0.35 + 0.15 * t + 0.20 * a, 0.4, 0.6)),
        (F.lit(True), "WEAK_EVIDENCE_REVIEW", REVIEW, clamp(0.25 * t + 0.25 * a + 0.10 * F.col("overlap"), 0.2, 0.55)),
    ]
    out = None
    for cond, name, status, value in reversed(table):
        row = F.struct(F.lit(name).alias("pattern"), F.lit(status).alias("status"), value.cast("double").alias("value"))
        out = row if out is None else F.when(cond, row).otherwise(out)
    return out


def with_evidence(rows: DataFrame) -> DataFrame:
    """pattern, status and evidence_score by pattern_of(), less what a version costs."""
    own = rows.withColumn("_e", pattern_of(F.col("suspicious") > 0))
    keeps = F.col("_e.pattern").isin(SURE)
    penalty = F.when(F.col("suspicious") > 0, 0.25).otherwise(0.0)
    value = F.when(F.col("_e.pattern") == "INVALID", 0.0).when(keeps, F.greatest(F.col("_e.value") - penalty, F.lit(0.85))).otherwise(F.greatest(F.col("_e.value") - penalty, F.lit(0.0)))
    return own.select(*rows.columns, F.col("_e.pattern").alias("pattern"), F.col("_e.status").alias("status"), F.round(value, 4).alias("evidence_score"))


def label(status: Column, score: Column, has_uri: Column) -> Column:
    """high, mid, low or failed."""
    return (
        F.when(~has_uri | (status == INVALID), "failed").when(status.isin(REVIEW, LOW) & (score >= 0.6), "mid").when(status == REVIEW, "low")
        .when((status == MATCHED) | (score >= 0.82), "high").when(score >= 0.7, "mid").otherwise("low")
    )


def ranked(rows: DataFrame) -> DataFrame:
    """rank of each song's candidates: matched before review before low; then scores, popularity, id."""
    order = F.when(F.col("status") == MATCHED, 0).when(F.col("status") == REVIEW, 1).when(F.col("status") == LOW, 2).otherwise(3)
    w = Window.partitionBy("song_id").orderBy(order, F.col("evidence_score").desc(), F.col("artist_score").desc(), F.col("title_score").desc(), "api_rank", F.col("popularity").desc(), "track_id")
    return rows.withColumn("rank", F.row_number().over(w))


def best(rows: DataFrame) -> DataFrame:
    """One match a song; songs whose candidates are all invalid have none."""
    own = ranked(rows).where((F.col("rank") == 1) & (F.col("status") != INVALID))
    return own.withColumn("confidence_label", label(F.col("status"), F.col("evidence_score"), F.lit(True)))


def alias_table(spark, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """canonical, alias_key: a small fixed dimension."""
    rows = [(k, n) for k, v in (aliases or L.ARTIST_ALIASES).items() for n in (k, *v)]
    return alias_keys(spark.createDataFrame(rows, "canonical string, alias string"))


def alias_keys(aliases: DataFrame) -> DataFrame:
    """canonical, alias_key of a table of aliases (canonical, alias), the canonical names among them."""
    every = aliases.select("canonical", "alias").union(aliases.select("canonical", F.col("canonical").alias("alias")))
    return every.select("canonical", X.artist_key(F.col("alias")).alias("alias_key")).distinct()


def canonical(rows: DataFrame, aliases: DataFrame, column: str = "artist") -> DataFrame:
    """rows with the canonical name of column, itself where no alias is known; of several names the least."""
    one = aliases.groupBy("alias_key").agg(F.min("canonical").alias(f"{column}_canonical"))
    own = rows.withColumn("_k", X.artist_key(F.col(column)))
    return own.join(one, F.col("_k") == F.col("alias_key"), "left").drop("_k", "alias_key").withColumn(f"{column}_canonical", F.coalesce(f"{column}_canonical", column))


def with_audio_id(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """Matches by a recognised track id (song_id, track_id) are raised by what titles and artists say."""
    own = matches.join(ids.select("song_id", F.col("track_id").alias("_id")), "song_id", "left")
    t, a, hit = F.col("title_score"), F.col("artist_score"), F.col("_id") == F.col("track_id")
    floor = F.when((t >= 0.6) & (a >= 0.4), 0.88).when((t >= 0.4) | (a >= 0.5), 0.82).when((t >= 0.2) | (a >= 0.2), 0.65).otherwise(0.58)
    status = F.when((t >= 0.4) | (a >= 0.5), MATCHED).otherwise(REVIEW)
    return own.withColumn("evidence_score", F.when(hit, F.greatest("evidence_score", floor)).otherwise(F.col("evidence_score"))).withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_id")


def dedup_results(rows: DataFrame) -> DataFrame:
    """One result a track, the most confident, first on ties, and then one a URI (where rows have it), the first; results without one all stay."""
    w = Window.partitionBy("track_id").orderBy(F.col("evidence_score").desc(), "song_id")
    own = rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | F.col("track_id").isNull())
    if "uri" in rows.columns:
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("uri").orderBy("song_id"))).where((F.col("_n") == 1) | F.col("uri").isNull())
    return own.drop("_n")
