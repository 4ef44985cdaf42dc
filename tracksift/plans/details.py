"""Queries of the evidence beside the names, of lines with more than two names, and of nested inputs, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.operators import direction, match, media, metadata, playlist, songs
from tracksift.operators import match as M
from tracksift.plans import queries as base
from tracksift.plans.oracle import MATCH, _list, _similar
from tracksift.session import table
from tracksift.sources import landed

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        _ALL[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


# albums and risks

#: Albums of four kinds: the song's own name, a live one, a collection of the artist's, none.
_ALBUM = "CASE track_id % 4 WHEN 0 THEN name WHEN 1 THEN name || ' live' WHEN 2 THEN 'hits of ' || replace(lower(artist_name), '#', ' ') ELSE '' END"
_PAIRS = "SELECT DISTINCT an, cn FROM sc0 WHERE an IS NOT NULL)"
assert _PAIRS in MATCH
#: MATCH, whose ratios are those of titles and albums too.
ALBUMS = MATCH.replace(_PAIRS, f"SELECT DISTINCT an, cn FROM sc0 WHERE an IS NOT NULL UNION SELECT DISTINCT title, {_ALBUM} FROM sc0)") + f""",
al0 AS (SELECT *, {_ALBUM} AS album, artist IS NOT NULL AS given, p_versions > 0 AS versions FROM ev0),
al1 AS (SELECT al0.*, CASE WHEN album = '' THEN 0.0 ELSE {_similar("title", "album", "rb.ratio", "0.0")} END AS plain, list_filter(string_split(album, ' '), lambda w: NOT list_contains({_list(L.STOPWORDS)}, w)) AS al_tok FROM al0 LEFT JOIN ro rb ON rb.x = title AND rb.y = album),
al2 AS (SELECT *, CASE WHEN album = '' OR plain >= 0.92 THEN plain ELSE greatest(plain, round(len(list_intersect(list_filter(string_split(title, ' '), lambda w: w <> 'live'), al_tok)) / greatest(len(t_tok), len(al_tok))::DOUBLE, 4)) END AS album_score,
  track_id % 4 = 1 AND NOT contains(title, ' live') AS version,
  len(list_filter({_list(M.NON_ORIGINAL_WORDS)}, lambda w: contains(name || ' ' || album || ' ' || cn, w))) > 0 AS other,
  len(list_filter({_list(M.ACCEPTABLE_WORDS)}, lambda w: contains(name || ' ' || album || ' ' || cn, w))) > 0 OR versions AS acceptable,
  len(t_tok) <= 2 AND t >= 0.8 AND a < 0.45 AND NOT a_alias AND (len(string_split(title, ' ')) = 1 OR len(n_tok) >= len(t_tok) + 3) AS short FROM al1),
al3 AS (SELECT *, CASE WHEN version THEN 'VERSION_REVIEW' WHEN t >= 0.85 AND a >= 0.7 THEN 'EXACT_MATCH' WHEN a_alias AND t >= 0.75 THEN 'ARTIST_ALIAS_TITLE_MATCH' WHEN strong AND t < 0.75 AND api_rank = 1 AND both_ THEN 'ARTIST_STRONG_TITLE_WEAK'
  WHEN api_rank = 1 AND both_ AND img THEN 'SEARCH_ENGINE_CONFIDENT' WHEN t >= 0.8 AND a < 0.3 AND NOT a_alias THEN 'TITLE_ONLY_MATCH' WHEN strong AND t < 0.3 AND api_rank >= 2 THEN 'ARTIST_ONLY_MATCH'
  WHEN t < 0.2 AND a < 0.2 AND api_rank >= 2 THEN 'INVALID' WHEN api_rank = 1 THEN 'SEARCH_RANK1_REVIEW' ELSE 'WEAK_EVIDENCE_REVIEW' END AS pattern FROM al2),
al4 AS (SELECT *, CASE pattern WHEN 'VERSION_REVIEW' THEN least(greatest(0.35 * t + 0.25 * a, 0.5), 0.64) WHEN 'EXACT_MATCH' THEN least(greatest(0.85 + 0.08 * t + 0.07 * a, 0.85), 1.0) WHEN 'ARTIST_ALIAS_TITLE_MATCH' THEN least(greatest(0.82 + 0.10 * t, 0.85), 1.0)
    WHEN 'ARTIST_STRONG_TITLE_WEAK' THEN 0.66 WHEN 'SEARCH_ENGINE_CONFIDENT' THEN 0.62 WHEN 'TITLE_ONLY_MATCH' THEN 0.5 WHEN 'ARTIST_ONLY_MATCH' THEN CASE WHEN img THEN 0.52 ELSE 0.45 END WHEN 'INVALID' THEN 0.0
    WHEN 'SEARCH_RANK1_REVIEW' THEN least(greatest(0.35 + 0.15 * t + 0.20 * a, 0.4), 0.6) ELSE least(greatest(0.25 * t + 0.25 * a + 0.10 * overlap, 0.2), 0.55) END::DOUBLE AS value,
  pattern IN ('ARTIST_STRONG_TITLE_WEAK', 'SEARCH_ENGINE_CONFIDENT') AS explained FROM al3),
al5 AS (SELECT *, list_filter([CASE WHEN other THEN 'non_original_audio' END, CASE WHEN version THEN 'version_candidate' END, CASE WHEN short THEN 'short_title_false_positive' END,
  CASE WHEN given AND t >= 0.85 AND a < 0.45 AND NOT explained THEN 'title_only_overconfidence' END, CASE WHEN given AND a >= 0.85 AND t < 0.55 AND NOT explained THEN 'artist_only_overconfidence' END], lambda r: r IS NOT NULL) AS risks,
  round((CASE WHEN other THEN 0.35 ELSE 0 END + CASE WHEN version THEN 0.25 ELSE 0 END + CASE WHEN short THEN 0.20 ELSE 0 END + CASE WHEN given AND t >= 0.85 AND a < 0.45 AND NOT explained THEN 0.12 ELSE 0 END
    + CASE WHEN given AND a >= 0.85 AND t < 0.55 AND NOT explained THEN 0.12 ELSE 0 END)::DOUBLE, 4) AS penalty FROM al4)"""


def albums(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with albums of four kinds."""
    k, name = F.col("track_id") % 4, F.col("name")
    album = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" Live"))).when(k == 2, F.concat(F.lit("Hits of "), "artist_name"))
    return base.scored(spark, sf).withColumn("album", album)


@query(f"WITH RECURSIVE {ALBUMS} SELECT song_id, track_id, album_score::DOUBLE AS album_score, version, CASE WHEN track_id % 4 = 1 THEN 'live' ELSE '' END AS words FROM al2")
def album_scores(spark: SparkSession, sf: str) -> DataFrame:
    own = metadata.with_album(albums(spark, sf))
    return own.select("song_id", "track_id", "album_score", F.col("version_candidate").alias("version"), F.array_join("version_words", ",").alias("words"))


@query(f"""WITH RECURSIVE {ALBUMS} SELECT song_id, track_id, pattern, array_to_string(risks, ',') AS risks, penalty, CASE WHEN pattern = 'INVALID' THEN 0.0 WHEN pattern IN ('EXACT_MATCH', 'ARTIST_ALIAS_TITLE_MATCH') THEN greatest(round(value - penalty, 4), 0.85) ELSE greatest(round(value - penalty, 4), 0.0) END::DOUBLE AS score,
round(t * 0.3, 4)::DOUBLE AS title_part, round(a * 0.45, 4)::DOUBLE AS artist_part, round((6 - api_rank) / 5.0 * 0.15, 4)::DOUBLE AS rank_part, round(album_score * 0.05, 4)::DOUBLE AS album_part, round(least(popularity, 100) / 100.0 * 0.05, 4)::DOUBLE AS popularity_part,
CASE WHEN pattern = 'ARTIST_STRONG_TITLE_WEAK' THEN 'translation_alias' WHEN t >= 0.95 THEN 'exact' WHEN t >= 0.55 THEN 'partial' ELSE 'mismatch' END AS title_type, CASE WHEN a_alias THEN 'alias' WHEN a >= 0.95 THEN 'exact' WHEN a >= 0.55 THEN 'partial' ELSE 'mismatch' END AS artist_type FROM al5""")
def album_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate with the parts of its evidence, its risks and what they leave of its score."""
    own = metadata.with_detail(albums(spark, sf))
    parts = ["title_part", "artist_part", "rank_part", "album_part", "popularity_part", "title_type", "artist_type"]
    return own.select("song_id", "track_id", "pattern", F.array_join("risk_reasons", ",").alias("risks"), F.col("risk_penalty").alias("penalty"), F.col("evidence_score").alias("score"), *parts)


@query(f"""WITH RECURSIVE {MATCH}, x AS (SELECT *, artist IS NOT NULL AS given, len(list_filter({_list(M.NON_ORIGINAL_WORDS)}, lambda w: contains(name || ' ' || cn, w))) > 0 AS other,
  len(list_filter({_list(M.ACCEPTABLE_WORDS)}, lambda w: contains(name || ' ' || cn, w))) > 0 OR p_versions > 0 AS ok,
  len(t_tok) <= 2 AND t >= 0.8 AND a < 0.45 AND NOT a_alias AND (len(string_split(title, ' ')) = 1 OR len(n_tok) >= len(t_tok) + 3) AS short, a_alias OR t_alias OR t >= 0.9 OR a >= 0.9 AS same, api_rank = 1 AND (t >= 0.95 OR a >= 0.95) AS top_ FROM ev),
y AS (SELECT *, same AND top_ AND (t >= 0.98 OR a >= 0.98) AND (a_alias OR (t_alias AND a >= 0.45)) AS gap, given AND a >= 0.85 AND t < 0.55 AS only_a, given AND t >= 0.85 AND a < 0.45 AS only_t, t < 0.4 AND (NOT given OR a < 0.4) AS weak,
  score + CASE WHEN t >= 0.95 AND (NOT given OR a >= 0.85) THEN 0.03 ELSE 0 END + CASE WHEN same THEN 0.03 ELSE 0 END AS s0 FROM x),
z AS (SELECT *, greatest(s0, CASE WHEN same AND t >= 0.92 AND a >= 0.7 THEN CASE WHEN t >= 0.98 AND a >= 0.85 THEN 0.8 ELSE 0.72 END ELSE 0 END, CASE WHEN same AND t >= 0.98 AND a < 0.45 AND (a_alias OR a >= 0.25) THEN 0.78 ELSE 0 END,
  CASE WHEN same AND a >= 0.98 AND t < 0.45 THEN 0.72 ELSE 0 END) + CASE WHEN top_ THEN 0.1 ELSE 0 END - CASE WHEN ok THEN CASE WHEN p_versions > 0 THEN least(p_versions, 0.08) ELSE 0.04 END ELSE 0 END
  - CASE WHEN other THEN 0.35 ELSE 0 END - CASE WHEN only_t AND NOT gap THEN 0.12 ELSE 0 END - CASE WHEN short THEN 0.2 ELSE 0 END AS s1 FROM y)
SELECT song_id, track_id, short, round(greatest(least(s1, CASE WHEN other THEN 0.49 ELSE 1 END, CASE WHEN (only_a OR only_t) AND NOT gap THEN 0.69 ELSE 1 END, CASE WHEN short THEN 0.62 ELSE 1 END, CASE WHEN weak THEN 0.49 ELSE 1 END), 0), 4)::DOUBLE AS adjusted FROM z""")
def adjusted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted scores with their bonuses, floors, penalties and caps."""
    own = match.adjusted(match.version_tags(base.scored(spark, sf)))
    return own.select("song_id", "track_id", F.col("short_title").alias("short"), F.col("adjusted_score").alias("adjusted"))


# lines that hold more than two names


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'IU' WHEN 1 THEN 'NCT 127' WHEN 2 THEN 'TREASURE' WHEN 3 THEN 'IU' WHEN 4 THEN 'Zed Quux' WHEN 5 THEN '샤이니 (SHINee)' ELSE 'BIGBANG' END AS "left",
CASE p_partkey % 7 WHEN 2 THEN 'KING KONG' WHEN 4 THEN 'IU ' || p_name ELSE p_name END AS "right", CASE WHEN p_partkey % 7 = 5 THEN ' <' ELSE ' - ' END AS separator FROM part""")
def compilation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of compilations: an artist before the one who sings, titles in angles, notes at the end, and two kinds that stay."""
    k, name = F.col("p_partkey") % 7, F.col("p_name")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    body = (
        F.when(k == 0, say("BTS - IU ", name)).when(k == 1, say("BTS - NCT 127 ", name)).when(k == 2, F.lit("TREASURE - KING KONG")).when(k == 3, say("IU - ", name, " _ BTS"))
        .when(k == 4, say("Zed Quux - IU ", name)).when(k == 5, say("샤이니 (SHINee) <", name, ">")).otherwise(say("BTS - BIGBANG <", name, ">"))
    )
    own = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 100).alias("doc_id"), F.col("p_partkey").alias("line_no"), body.alias("body"))
    own = own.withColumn("p", songs.pair_parts(F.col("body"))).select("*", "p.*").drop("p")
    return songs.resplit(own, direction.known_artists(spark)).select("p_partkey", "left", "right", "separator")


# nested pages, fetches in order, frames


@query("""WITH d AS (SELECT p_partkey // 4 AS doc_id, CAST(p_partkey % 4 AS INTEGER) AS nth, p_name, p_brand FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS i FROM d WHERE doc_id % 5 < 4 AND nth <> 3)
SELECT doc_id, CAST(i AS INTEGER) AS section_index, p_name AS title, p_brand AS artist, CASE WHEN nth = 1 THEN '' ELSE 'Hits' END AS album FROM k""")
def panel_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of nested panels: a list that isn't music, a music list without artists, and one with cards in three layouts, the last of which has no artist. One page in five is broken."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    null = lambda t: F.lit(None).cast(t)
    view = lambda **c: F.struct(*[c.get(n, null("string")).alias(n) for n in ("title", "subtitle")], c.get("second", null("struct<content:string>")).alias("secondarySubtitle"), *[c.get(n, null("string")).alias(n) for n in ("artist", "album")])
    name, brand, hits, kind = F.col("p_name"), F.col("p_brand"), F.lit("Hits"), f"{landed._CARD}"
    at = k % 4
    card = F.struct(
        F.when(at == 0, view(title=name, subtitle=brand, second=F.struct(hits.alias("content")))).when(at == 3, view(title=name)).otherwise(null(kind)).alias("videoAttributeViewModel"),
        F.when(at == 1, view(title=name, subtitle=brand)).otherwise(null(kind)).alias("musicAttributeViewModel"), F.when(at == 2, view(title=name, artist=brand, album=hits)).otherwise(null(kind)).alias("musicCardAttributeViewModel"),
    )
    docs = p.groupBy(F.floor(k / 4).alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), card.alias("card")))), lambda x: x.card).alias("cards"))
    text = lambda c: F.struct(c.alias("simpleText"))
    rich = lambda sub, title: F.struct(F.struct(text(sub).alias("subtitle"), text(title).alias("title")).alias("richListHeaderRenderer"), null("struct<runs:array<struct<text:string>>>").alias("titleText"))
    runs = F.struct(null("struct<subtitle:struct<simpleText:string>,title:struct<simpleText:string>>").alias("richListHeaderRenderer"), F.struct(F.array(F.struct(F.lit("12 Songs").alias("text"))).alias("runs")).alias("titleText"))
    d = F.col("doc_id") % 5
    header = F.when(d == 0, rich(F.lit("Music"), F.lit("x"))).when(d == 1, rich(null("string"), F.lit("음악"))).otherwise(runs)
    item = lambda h, c: F.struct(F.struct(h.alias("header"), c.alias("cards")).alias("horizontalCardListRenderer"))
    bare = F.transform("cards", lambda c: F.struct(view(title=F.lit("no artist")).alias("videoAttributeViewModel"), null(kind).alias("musicAttributeViewModel"), null(kind).alias("musicCardAttributeViewModel")))
    items = F.array(item(rich(F.lit("Chapters"), F.lit("x")), F.col("cards")), item(rich(F.lit("Music"), F.lit("x")), bare), item(header, F.col("cards")))
    body = F.struct(items.alias("items"))
    panel = F.struct(F.lit(landed.DESCRIPTION_PANEL).alias("panelIdentifier"), F.when(d == 3, F.struct(null(f"{landed._BODY}").alias("structuredDescriptionContentRenderer"), F.struct(F.struct(body.alias("structuredDescriptionContentRenderer")).alias("content")).alias("engagementPanelSectionListRenderer")))
        .otherwise(F.struct(body.alias("structuredDescriptionContentRenderer"), null(f"struct<content:struct<structuredDescriptionContentRenderer:{landed._BODY}>>").alias("engagementPanelSectionListRenderer"))).alias("content"))
    other = F.struct(F.lit("comments").alias("panelIdentifier"), null("struct<a:int>").alias("content"))
    page = F.concat(F.lit('{"engagementPanels":[{"engagementPanelSectionListRenderer":'), F.to_json(other), F.lit("},"), F.when(d == 1, F.lit('{"engagementPanelSectionListRendererV2":')).otherwise(F.lit('{"engagementPanelSectionListRenderer":')), F.to_json(panel), F.lit("}]}"))
    pages = docs.select("doc_id", F.when(d == 4, F.left(page, F.lit(40))).otherwise(page).alias("payload"))
    return landed.panel_cards(pages)


@query("""WITH r AS (SELECT l_orderkey // 100 AS request_id, l_orderkey * 8 + l_linenumber AS position, l_partkey AS track_id FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position, track_id) - 1 AS place FROM r)
SELECT request_id, place, CAST(place // 50 AS INTEGER) AS chunk, o.track_id, p_partkey IS NOT NULL AS found, p_name AS name FROM o LEFT JOIN part ON p_partkey = o.track_id AND p_partkey % 7 <> 0""")
def fetched_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """A request for the tracks of every hundred orders, in order; one track in seven isn't there."""
    own = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("request_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), F.col("l_partkey").alias("track_id"))
    tracks = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"))
    return playlist.fetched(own, tracks).select("request_id", F.col("place").cast("long").alias("place"), "chunk", "track_id", "found", "name")


@query("""WITH l AS (SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS i, CASE WHEN p_partkey // 10 % 2 = 0 AND p_partkey % 10 = 0 THEN 3 WHEN p_partkey % 10 = 9 THEN 2 WHEN p_partkey % 10 = p_partkey // 10 % 4 + 2 THEN 1 ELSE 0 END AS kind FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM l WHERE kind <> 2), h AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k WHERE kind = 0),
g AS (SELECT doc_id, run, count(*) AS songs, min(place) AS start, count(*) FILTER (WHERE i % 2 = 0) AS ts FROM h GROUP BY 1, 2), b AS (SELECT doc_id, songs, ts FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY songs DESC, start) = 1),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE kind = 0) AS hits, CASE WHEN count(*) FILTER (WHERE kind = 3) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS overlay FROM k GROUP BY 1),
c AS (SELECT *, round((0.45 * ts + 0.55 * songs) / songs::DOUBLE, 4) AS consistency FROM n JOIN b USING (doc_id) WHERE songs >= 2)
SELECT doc_id, songs, ts, n, overlay, round(5.0 * ts + 7.0 * songs + 3.0 * hits / n::DOUBLE + 4.0 * consistency - overlay, 4)::DOUBLE AS score FROM c""")
def frame_overlays(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of ten lines: songs, half of them timed, one line of prose between, a time alone at the end, and in every other frame a call to subscribe."""
    k, doc = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    pair = F.concat("p_brand", F.lit(" - "), "p_name")
    line = (
        F.when((doc % 2 == 0) & (k % 10 == 0), "please SUBSCRIBE now").when(k % 10 == 9, "12:34").when(k % 10 == doc % 4 + 2, F.col("p_name"))
        .when(k % 2 == 0, F.concat(F.lit("1:23 "), pair)).otherwise(pair)
    )
    own = table(spark, sf, "part").select(doc.cast("long").alias("doc_id"), k.alias("line_no"), line.alias("line"))
    return media.frame_scores(own).where("songs >= 2").select("doc_id", "songs", "ts", "n", "overlay", "score")
