"""What a candidate's album, rank and popularity say besides its names, and what its risks cost.

Rows are those of resolve.scored() with an `album` (null where a track has none). All are projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X
from tracksift.operators import match as M
from tracksift.operators import resolve as R

#: Weights of the parts of the evidence, and what each risk costs.
WEIGHTS = {"artist": 0.45, "title": 0.30, "rank": 0.15, "album": 0.05, "popularity": 0.05}
RISKS = {"non_original_audio": 0.35, "version_candidate": 0.25, "short_title_false_positive": 0.20, "title_only_overconfidence": 0.12, "artist_only_overconfidence": 0.12}
#: Patterns that explain a title or artist that differs, and those whose score has a floor.
TRANSLATED = ["ARTIST_STRONG_TITLE_WEAK", "TRANSLATED_TITLE_ARTIST_STRONG", "SEARCH_ENGINE_CONFIDENT"]
FLOOR = 0.85


def version_words(normal: Column) -> Column:
    """Words of another version in a normal form, in order: single ones as whole tokens, phrases anywhere. Null has none."""
    text = F.coalesce(normal, F.lit(""))
    single = F.array(*[F.lit(w) for w in L.BLOCKING_WORDS if " " not in w])
    found = F.array_intersect(single, F.split(text, " "))
    phrases = F.filter(F.array(*[F.lit(w) for w in L.BLOCKING_WORDS if " " in w]), lambda w: F.contains(text, w))
    return F.array_sort(F.concat(found, phrases))


def with_album(rows: DataFrame) -> DataFrame:
    """rows with c_album (normal form), album_score (the title's likeness to the album; 0 without one), version_words and version_candidate.

    A candidate is a version if it, its album or its artist names one and the song doesn't.
    """
    own = rows.withColumn("c_album", F.coalesce(X.match_text(F.col("album")), F.lit("")))
    spellings = F.array_distinct(F.filter(F.transform(X.title_variants(F.col("album")), X.match_text), lambda x: x != ""))
    asked = F.col("c_album") != ""  # rows without an album need no matching
    own = own.withColumn("album_score", F.coalesce(F.round(X.best_similarity(F.when(asked, F.col("s_titles")), F.when(asked, spellings)), 4), F.lit(0.0)))
    mine = version_words(F.concat_ws(" ", "s_title", "s_artist"))
    own = own.withColumn("version_words", version_words(F.concat_ws(" ", "c_title", "c_album", "c_artist")))
    return own.withColumn("version_candidate", (F.size("version_words") > 0) & (F.size(mine) == 0))


def evidence_type(score: Column, alias: Column, romanised: Column, official: Column) -> Column:
    return (
        F.when(alias, "alias").when(romanised, "romanization").when(official, "translation_alias")
        .when(score >= 0.95, "exact").when(score >= 0.55, "partial").otherwise("mismatch")
    )


def risks(rows: DataFrame, pattern: Column) -> Column:
    """Names of the risks that a candidate bears, in a fixed order. Needs version_tags() and adjusted()."""
    t, a, given = F.col("title_score"), F.col("artist_score"), F.col("artist").isNotNull()
    explained = pattern.isin(TRANSLATED)
    holds = {
        "non_original_audio": F.col("non_original"),
        "version_candidate": F.col("version_candidate"),
        "short_title_false_positive": F.col("short_title"),
        "title_only_overconfidence": given & (t >= 0.85) & (a < M.MIN_ARTIST) & ~explained,
        "artist_only_overconfidence": given & (a >= 0.85) & (t < 0.55) & ~explained,
    }
    return F.filter(F.array(*[F.when(holds[k], F.lit(k)) for k in RISKS]), lambda x: x.isNotNull())


def with_detail(rows: DataFrame) -> DataFrame:
    """rows with pattern, status and evidence_score less the risks, and with the parts of the evidence.

    risk_reasons and risk_penalty; title_part, artist_part, rank_part, album_part, popularity_part (each weighted, 4 places);
    title_type, artist_type; detail_reasons (array of texts). Patterns of sure matches keep a floor.
    """
    own = rows if "album_score" in rows.columns else with_album(rows)
    own = M.adjusted(M.version_tags(M.with_romanised(own)))
    trust = []
    if "reliability" in own.columns:  # searched() says how far each query is to be trusted
        high = F.col("query_has_both") & (F.col("reliability") == "high")
        trust = [high | (F.col("query_has_both") & (F.col("reliability") == "medium") & F.col("artist_alias")), high]
    own = own.withColumn("_e", R.pattern_of(F.col("version_candidate"), *trust)).withColumn("risk_reasons", risks(own, F.col("_e.pattern")))
    cost = F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv])
    own = own.withColumn("risk_penalty", F.round(F.aggregate("risk_reasons", F.lit(0.0), lambda s, r: s + F.element_at(cost, r)), 4))
    left = F.greatest(F.lit(0.0), F.round(F.col("_e.value") - F.col("risk_penalty"), 4))
    score = F.when(F.col("_e.pattern") == "INVALID", 0.0).when(F.col("_e.pattern").isin(R.SURE), F.greatest(left, F.lit(FLOOR))).otherwise(left)
    popularity = F.round(F.least(F.greatest(F.coalesce("popularity", F.lit(0)), F.lit(0)), F.lit(100)) / 100.0, 4)
    rank = F.when(F.col("api_rank").between(1, R.LIMIT), F.round(M.rank_score(F.col("api_rank")), 4)).otherwise(0.0)
    part = lambda k, c: F.round(c * WEIGHTS[k], 4).alias(f"{k}_part")
    none = F.lit(False)
    out = own.select(
        *[c for c in own.columns if c != "_e"], F.col("_e.pattern").alias("pattern"), F.col("_e.status").alias("status"), score.alias("evidence_score"),
        part("title", F.col("title_score")), part("artist", F.col("artist_score")), part("rank", rank), part("album", F.col("album_score")), part("popularity", popularity),
        evidence_type(F.col("title_score"), none, none, F.col("_e.pattern").isin(TRANSLATED[:2])).alias("title_type"),
        evidence_type(F.col("artist_score"), F.col("artist_alias"), F.col("romanised"), none).alias("artist_type"),
    )
    says = lambda k, c: F.format_string(f"{k}=%.4f weighted={WEIGHTS[k] * 100:.0f}%%", c.cast("double"))
    lines = F.array(says("artist", F.col("artist_score")), says("title", F.col("title_score")), says("rank", rank), says("album", F.col("album_score")), says("popularity", popularity))
    return out.withColumn("detail_reasons", F.concat(lines, F.col("risk_reasons")))
