"""DuckDB SQL that states the queries' results over the driver's tables."""

from __future__ import annotations

from tracksift.functions import lexicon as L
from tracksift.functions.text import any_of, not_music_pattern


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TL = """
tl0 AS (SELECT p_partkey // 100 AS doc_id, CAST(p_partkey % 100 AS INTEGER) AS line_no, p_brand, p_name, (p_partkey % 100) * 210 AS s FROM part),
tl1 AS (SELECT doc_id, line_no,
  CASE WHEN line_no % 5 = 4 THEN NULL WHEN line_no < 18 THEN lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
       ELSE CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS ts,
  s, CASE WHEN doc_id % 2 = 0 THEN p_brand ELSE p_name END AS l, CASE WHEN doc_id % 2 = 0 THEN p_name ELSE p_brand END AS r FROM tl0),
tl AS (SELECT *, CASE WHEN line_no = 50 THEN 'https://example.com/' || doc_id ELSE coalesce(ts || ' ', '') || l || ' - ' || r END AS line FROM tl1)"""
#: Each document has three timed pairs or more, so lines without a time go; so does the address.
SONGS = TL + """,
songs AS (SELECT doc_id, line_no, ts AS timestamp, l AS artist, r AS title FROM tl WHERE line_no % 5 <> 4 AND line_no <> 50)"""
VERDICT = SONGS + """,
sig AS (SELECT doc_id, sum(CASE WHEN line_no <> 50 AND line_no % 5 <> 4 THEN 1 ELSE 0 END) AS timestamp_count, 0 AS bare_timestamp_count,
  sum(CASE WHEN line_no <> 50 THEN 1 ELSE 0 END) AS pattern_count, sum(CASE WHEN line_no <> 50 THEN 1 ELSE 0 END) AS candidate_line_count, count(*) AS line_count FROM tl GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS song_count, count(*) AS complete_song_count, 1.0::DOUBLE AS avg_completeness FROM songs GROUP BY doc_id)"""
def _list(words: list[str]) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


#: The Ratcliff-Obershelp ratio of the pairs q(x, y): runs of equal characters by diagonal; in each segment the longest
#: run, the earliest in x and then in y, is kept and parts the segment in two.
RATIO = """
ch AS (SELECT x, y, i, j FROM (SELECT x, y, unnest(range(length(x))) AS i FROM q) JOIN (SELECT x AS x2, y AS y2, unnest(range(length(y))) AS j FROM q) ON x = x2 AND y = y2 WHERE substr(x, i + 1, 1) = substr(y, j + 1, 1)),
runs AS (SELECT x, y, min(i) AS i0, min(j) AS j0, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y, i - j ORDER BY i) AS g FROM ch) GROUP BY x, y, i - j, g),
seg(x, y, a0, a1, b0, b1, m) AS (SELECT x, y, 0::BIGINT, length(x)::BIGINT, 0::BIGINT, length(y)::BIGINT, 0::BIGINT FROM q UNION ALL
  SELECT x, y, p.a0, p.a1, p.b0, p.b1, p.m FROM (SELECT x, y, unnest([{a0: a0, a1: -t.i, b0: b0, b1: -t.j, m: t.n}, {a0: t.n - t.i, a1: a1, b0: t.n - t.j, b1: b1, m: 0}]) AS p FROM (
    SELECT x, y, a0, a1, b0, b1, max({n: hi - lo, i: -lo, j: -(lo + j0 - i0)}) AS t FROM (
      SELECT s.*, r.i0, r.j0, greatest(r.i0, s.a0, s.b0 - r.j0 + r.i0) AS lo, least(r.i0 + r.n, s.a1, s.b1 - r.j0 + r.i0) AS hi FROM seg s JOIN runs r ON s.x = r.x AND s.y = r.y)
    WHERE hi > lo GROUP BY x, y, a0, a1, b0, b1))),
ro AS (SELECT x, y, 2.0 * sum(m) / (length(x) + length(y)) AS ratio FROM seg GROUP BY x, y)"""


def _similar(x: str, y: str, ratio: str, over: str) -> str:
    """Similarity of two normal forms of three letters or more."""
    return f"CASE WHEN {x} = {y} OR replace({x}, ' ', '') = replace({y}, ' ', '') THEN 1.0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.92 ELSE greatest({over}, round({ratio} * 0.82, 4)) END"


MATCH = """
cat AS (SELECT p_name AS name, p_brand AS artist_name, min(p_partkey) AS track_id, max(p_size) AS popularity FROM part GROUP BY 1, 2),
own AS (SELECT p_name AS t0, p_brand AS brand, min(p_partkey) AS song_id FROM part GROUP BY 1, 2),
song AS (SELECT song_id, CASE WHEN song_id % 5 = 0 THEN t0 || ' live' ELSE t0 END AS title, CASE WHEN song_id % 3 > 0 THEN brand END AS artist, t0 FROM own),
st AS (SELECT *, string_split(t0, ' ') AS t_tok, string_split(replace(lower(artist), '#', ' '), ' ') AS a_tok FROM song),
ct AS (SELECT *, string_split(name, ' ') AS n_tok, string_split(replace(lower(artist_name), '#', ' '), ' ') AS c_tok FROM cat),
pairs AS (SELECT * FROM st JOIN ct ON len(list_intersect(t_tok, n_tok)) > 0 OR len(list_intersect(a_tok, c_tok)) > 0),
ov AS (SELECT *, round(len(list_intersect(t_tok, n_tok)) / greatest(len(list_distinct(t_tok)), len(list_distinct(n_tok)))::DOUBLE, 4) AS overlap,
  coalesce(round(len(list_intersect(a_tok, c_tok)) / greatest(len(list_distinct(a_tok)), len(list_distinct(c_tok)))::DOUBLE, 4), 0) AS aov FROM pairs),
cand AS (SELECT *, round(overlap + aov, 4) AS block_score, row_number() OVER (PARTITION BY song_id ORDER BY round(overlap + aov, 4) DESC, popularity DESC, track_id) AS api_rank FROM ov QUALIFY api_rank <= 5),
sc0 AS (SELECT *, replace(title, ' ', '') AS tk, replace(name, ' ', '') AS nk, replace(lower(artist), '#', ' ') AS an, replace(lower(artist_name), '#', ' ') AS cn,
  list_distinct(coalesce(a_tok, []) || t_tok) AS s_all, list_distinct(c_tok || n_tok) AS c_all FROM cand),
q AS (SELECT DISTINCT title AS x, name AS y FROM sc0 UNION SELECT DISTINCT an, cn FROM sc0 WHERE an IS NOT NULL),""" + RATIO + """,
sc1 AS (SELECT sc0.*, tk = nk AS t_alias, coalesce(an = cn, false) AS a_alias, """ + _similar("title", "name", "rt.ratio", "sc0.overlap") + """ AS bare,
  """ + _similar("an", "cn", "ra.ratio", "aov") + """ AS asim, greatest(sc0.overlap, round(len(list_intersect(s_all, c_all)) / greatest(len(s_all), len(c_all))::DOUBLE, 4)) AS tokens
  FROM sc0 JOIN ro rt ON rt.x = title AND rt.y = name LEFT JOIN ro ra ON ra.x = an AND ra.y = cn),
sc2 AS (SELECT * EXCLUDE (overlap), tokens AS overlap, CASE WHEN t_alias THEN 1.0 ELSE round(bare, 4) END AS title_score, CASE WHEN artist IS NULL THEN 0.0 WHEN a_alias THEN 1.0 ELSE round(asim, 4) END AS artist_score,
  least(0.08 * len(list_filter(""" + _list(L.SUSPICIOUS_WORDS) + """, lambda w: contains(name || ' ' || cn, w))) + 0.03 * len(list_filter(""" + _list(L.NOISE_WORDS) + """, lambda w: contains(name || ' ' || cn, w))), 0.24) AS p_words,
  least(0.04 * len(list_filter(""" + _list(L.VERSION_WORDS) + """, lambda w: contains(name, w) AND NOT contains(title, w))) + 0.02 * len(list_filter(""" + _list(L.VERSION_WORDS) + """, lambda w: contains(title, w) AND NOT contains(name, w))), 0.18) AS p_versions FROM sc1),
sc AS (SELECT *, 0 AS suspicious, round(greatest(least(CASE WHEN artist IS NOT NULL AND title_score >= 0.85 AND artist_score < 0.2 THEN least(raw, 0.64) ELSE raw END, 1.0), 0.0), 4) AS score FROM (
  SELECT *, CASE WHEN artist IS NOT NULL THEN 0.45 * title_score + 0.35 * artist_score + 0.05 * bare + 0.05 * artist_score + 0.10 * overlap + CASE WHEN a_alias THEN 0.05 ELSE 0.0 END + CASE WHEN t_alias THEN 0.05 ELSE 0.0 END
      + CASE WHEN t_alias THEN 0.04 ELSE 0.0 END + CASE WHEN artist_score >= 0.999 THEN 0.03 ELSE 0.0 END - CASE WHEN artist_score < 0.15 THEN 0.14 WHEN artist_score < 0.35 THEN 0.07 ELSE 0.0 END
    ELSE 0.72 * title_score + 0.12 * bare + 0.10 * overlap + CASE WHEN t_alias THEN 0.05 ELSE 0.0 END + CASE WHEN t_alias THEN 0.04 ELSE 0.0 END END + least(popularity / 1000.0, 0.03) - p_words - p_versions AS raw FROM sc2)),
ev0 AS (SELECT *, title_score AS t, artist_score AS a, popularity % 2 = 0 AS img, artist IS NOT NULL AS both_, artist_score >= 0.8 OR a_alias AS strong FROM sc),
ev1 AS (SELECT *, CASE WHEN t >= 0.85 AND a >= 0.7 THEN 'EXACT_MATCH' WHEN a_alias AND t >= 0.75 THEN 'ARTIST_ALIAS_TITLE_MATCH' WHEN strong AND t < 0.75 AND api_rank = 1 AND both_ THEN 'ARTIST_STRONG_TITLE_WEAK'
  WHEN api_rank = 1 AND both_ AND img THEN 'SEARCH_ENGINE_CONFIDENT' WHEN t >= 0.8 AND a < 0.3 AND NOT a_alias THEN 'TITLE_ONLY_MATCH' WHEN strong AND t < 0.3 AND api_rank >= 2 THEN 'ARTIST_ONLY_MATCH'
  WHEN t < 0.2 AND a < 0.2 AND api_rank >= 2 THEN 'INVALID' WHEN api_rank = 1 THEN 'SEARCH_RANK1_REVIEW' ELSE 'WEAK_EVIDENCE_REVIEW' END AS pattern FROM ev0),
ev AS (SELECT *, CASE pattern WHEN 'EXACT_MATCH' THEN 'matched' WHEN 'ARTIST_ALIAS_TITLE_MATCH' THEN 'matched' WHEN 'ARTIST_ONLY_MATCH' THEN 'low_confidence' WHEN 'INVALID' THEN 'invalid_candidate' ELSE 'review_needed' END AS status,
  round(CASE pattern WHEN 'EXACT_MATCH' THEN least(greatest(0.85 + 0.08 * t + 0.07 * a, 0.85), 1.0) WHEN 'ARTIST_ALIAS_TITLE_MATCH' THEN least(greatest(0.82 + 0.10 * t, 0.85), 1.0) WHEN 'ARTIST_STRONG_TITLE_WEAK' THEN 0.66 WHEN 'SEARCH_ENGINE_CONFIDENT' THEN 0.62 WHEN 'TITLE_ONLY_MATCH' THEN 0.5
    WHEN 'ARTIST_ONLY_MATCH' THEN CASE WHEN img THEN 0.52 ELSE 0.45 END WHEN 'INVALID' THEN 0.0 WHEN 'SEARCH_RANK1_REVIEW' THEN least(greatest(0.35 + 0.15 * t + 0.20 * a, 0.4), 0.6)
    ELSE least(greatest(0.25 * t + 0.25 * a + 0.10 * overlap, 0.2), 0.55) END, 4)::DOUBLE AS evidence_score FROM ev1),
best AS (SELECT *, CASE WHEN status IN ('review_needed', 'low_confidence') AND evidence_score >= 0.6 THEN 'mid' WHEN status = 'review_needed' THEN 'low' WHEN status = 'matched' OR evidence_score >= 0.82 THEN 'high' WHEN evidence_score >= 0.7 THEN 'mid' ELSE 'low' END AS confidence_label, 'track:' || track_id AS uri
  FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY CASE status WHEN 'matched' THEN 0 WHEN 'review_needed' THEN 1 WHEN 'low_confidence' THEN 2 ELSE 3 END, evidence_score DESC, a DESC, t DESC, api_rank, popularity DESC, track_id) AS rk FROM ev) WHERE rk = 1 AND status <> 'invalid_candidate'),
routes AS (SELECT *, CASE WHEN status = 'matched' THEN 'matched' WHEN evidence_score >= 0.6 THEN 'low_confidence_added' ELSE 'low_confidence_skipped' END AS route FROM best)"""
RATINGS = "ratings AS (SELECT event_id AS id, 1 + event_id % 5 AS score, CASE WHEN value > 100 THEN event_type ELSE '' END AS comment, ts AS created_at FROM events)"
_NAMES = [n for v in L.ARTIST_ALIASES.values() for n in v]
_CANON = {n: min(k for k, v in L.ARTIST_ALIASES.items() if any(_k == "".join(c for c in m.lower() if c.isalnum()) for m in [k, *v])) for n in _NAMES for _k in ["".join(c for c in n.lower() if c.isalnum())]}

SQL = {
    "dedup_songs": f"WITH {SONGS} SELECT doc_id, min(line_no) AS place, min_by(timestamp, line_no) AS timestamp, min_by(artist, line_no) AS artist, min_by(title, line_no) AS title FROM songs GROUP BY doc_id, lower(artist), lower(title)",
    "extract_pairs": f'WITH {TL} SELECT doc_id, line_no, l AS "left", r AS "right", \' - \' AS separator FROM tl WHERE line_no <> 50',
    "extract_timestamps": f"WITH {TL} SELECT doc_id, line_no, ts AS timestamp, CAST(s AS INTEGER) AS offset_s FROM tl WHERE ts IS NOT NULL AND line_no <> 50",
    "valid_lines": f"WITH {TL} SELECT doc_id, count(*) FILTER (WHERE line_no <> 50) AS valid, count(*) FILTER (WHERE line_no = 50) AS invalid FROM tl GROUP BY doc_id",
    "not_music_lines": f"""WITH s AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM s)
SELECT doc_id, count(*) AS n, CAST(min(n) AS INTEGER) AS first_line FROM l WHERE regexp_matches(line, {_q(not_music_pattern())}) GROUP BY doc_id""",
    "section_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(lower(line), {_q(any_of([w.lower() for w in L.SECTION_WORDS]))})) AS section_lines, count(*) FILTER (WHERE regexp_matches(line, {_q(any_of(L.SEPARATORS))})) AS separated_lines FROM l GROUP BY doc_id""",
    "numbered_tracks": "SELECT p_partkey, p_brand AS artist, p_name AS title FROM part",
    "three_line_blocks": "SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS block, '0' || (p_partkey % 10) || ':00' AS timestamp, p_name AS title, p_brand AS artist FROM part",
    "direction_votes": f"WITH {SONGS} SELECT doc_id, count(*) AS artist_title, 0 AS title_artist, 1.0::DOUBLE AS share, 'artist_title' AS direction, 'high' AS confidence FROM songs GROUP BY doc_id",
    "oriented_songs": f"WITH {SONGS} SELECT doc_id, line_no, artist, title, 'artist_title' AS direction FROM songs",
    "timestamp_gate": f"WITH {SONGS} SELECT doc_id, count(*) AS kept, count(*) AS timed_pairs FROM songs GROUP BY doc_id",
    "clean_titles": "SELECT p_partkey, p_name AS cleaned, p_name AS bare, lower(replace(p_brand, '#', '')) || 'and' || replace(p_name, ' ', '') AS match_key FROM part",
    "line_signals": f"WITH {VERDICT} SELECT *, round(candidate_line_count / line_count::DOUBLE, 3) AS candidate_line_ratio, true AS has_tracklist_structure FROM sig",
    "document_patterns": r"""WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\r?\n'))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^\s*[~*#>+\-–—•·‣\[\(\s]*(?:\d{1,2}:\d{2}(?::\d{2})?)\s+')) + count(*) FILTER (WHERE regexp_matches(line, '^\s*\d{1,2}:\d{2}(?::\d{2})?\s*$')) AS timestamp_count,
count(*) FILTER (WHERE regexp_matches(line, '.+\s[-–—|/:~_]\s.+')) AS pattern_count, count(*) AS line_count FROM l WHERE line <> '' GROUP BY doc_id""",
    "song_metrics": f"WITH {VERDICT} SELECT * FROM met",
    "doc_validity": f"WITH {VERDICT} SELECT doc_id, true AS success, false AS is_partial_but_valid, 'absolute_threshold_met' AS validity_reason, '' AS failure_reason, song_count, complete_song_count, avg_completeness FROM met",
    "analysis_state": f"WITH {VERDICT} SELECT doc_id, 'text_success' AS state, '' AS reasons, 'match_candidates' AS next_action FROM met",
    "fallback_recommendation": f"WITH {VERDICT} SELECT doc_id, 'ocr' AS recommended_stage, 'visible_tracklist_possible' AS reason FROM met",
    "merge_sources": f"""WITH {SONGS}, o AS (SELECT *, line_no % 2 AS rk FROM songs) SELECT doc_id, arg_min(artist, rk * 1000 + line_no) AS artist, arg_min(title, rk * 1000 + line_no) AS title, arg_min(timestamp, rk * 1000 + line_no) AS timestamp,
array_to_string(list_filter(['description', 'comments'], lambda x: list_contains(list(DISTINCT CASE rk WHEN 0 THEN 'description' ELSE 'comments' END), x)), ',') AS sources FROM o GROUP BY doc_id, lower(artist), lower(title)""",
    "source_cascade": f"""WITH {SONGS}, g AS (SELECT doc_id, line_no % 3 AS rk, count(*) AS n FROM songs GROUP BY 1, 2)
SELECT doc_id, coalesce(arg_min(CASE rk WHEN 0 THEN 'description' WHEN 1 THEN 'comments' ELSE 'section' END, CASE WHEN n >= 27 THEN rk END), 'none') AS source, count(*) AS sources FROM g GROUP BY doc_id""",
    "mode_artist": """WITH s AS (SELECT p_partkey // 3 AS doc_id, p_partkey AS line_no, CASE WHEN p_size % 4 > 0 THEN p_type ELSE upper(p_type) END AS artist FROM part),
g AS (SELECT doc_id, lower(artist) AS k, count(*) AS n, min(line_no) AS first_at, arg_min(artist, line_no) AS artist FROM s GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS named, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS rk FROM g)
SELECT doc_id, artist, round(n / named::DOUBLE, 4) AS share FROM t WHERE rk = 1 AND named >= 2 AND n / named::DOUBLE >= 0.7""",
    "hashtag_terms": "SELECT p_partkey % 700 AS doc_id, p_name AS tag, count(*) AS n FROM part GROUP BY 1, 2",
    "ai_gate": f"SELECT doc_id, regexp_matches(lower(text), {_q(any_of(L.AI_WORDS))}) AS ai_content FROM documents",
    "dedup_documents": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "comment_groups": r"""WITH c AS (SELECT conv_id AS doc_id, turn AS pos, text, length(text) AS likes, role = 'assistant' AS author, regexp_matches(text, '(?:^|[^\d])(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[^\d]|$)') AS timed, regexp_matches(text, '\S\s[-–—|/:~_]\s\S') AS pr FROM conversations WHERE trim(text) <> ''),
r AS (SELECT *, timed OR pr AS pat, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc_id ORDER BY likes DESC, pos) AS liked, row_number() OVER (PARTITION BY doc_id, timed ORDER BY pos) AS tn FROM c),
g AS (SELECT doc_id, pos, 0 AS group_rank, 'author_comment' AS source FROM r WHERE author AND pat UNION ALL SELECT doc_id, pos, 1, 'pinned_comment' FROM r WHERE nth = 1 AND pat UNION ALL SELECT doc_id, pos, 2, 'top_liked_comment' FROM r WHERE liked <= 3 AND pat
UNION ALL SELECT doc_id, pos, 3, 'timestamp_comments' FROM r WHERE timed AND tn <= 10 UNION ALL SELECT doc_id, pos, 4, 'expanded_comments' FROM r WHERE nth <= 30)
SELECT doc_id, group_rank, source, count(*) AS n, min(pos) AS first_pos FROM g GROUP BY 1, 2, 3""",
    "url_routing": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'playlist' WHEN 3 THEN 'playlist' ELSE 'error' END AS kind, CASE page_id % 5 WHEN 0 THEN 'Bw-8gOHPzyM' WHEN 1 THEN 'Bw-8gOHPzyM' WHEN 2 THEN 'PL123' WHEN 3 THEN 'PLabc_1' END AS id FROM pages",
    "track_uris": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'spotify:track:' || lpad(CAST(p_partkey AS VARCHAR), 22, 'A') END AS uri FROM part",
    "json_songs": "SELECT p_partkey, p_brand AS artist, p_name AS title FROM part WHERE p_partkey % 3 > 0",
    "alias_canonical": f"WITH a(i, n, c) AS (VALUES {', '.join(f'({i}, {_q(n)}, {_q(_CANON[n])})' for i, n in enumerate(_NAMES))}) SELECT p_partkey, n AS artist, c AS artist_canonical FROM part JOIN a ON p_partkey % {len(_NAMES)} = i",
    "token_overlap": """WITH n AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part) SELECT a.p_partkey, round(len(list_intersect(a.t, b.t)) / greatest(len(list_distinct(a.t)), len(list_distinct(b.t)))::DOUBLE, 4) AS overlap
FROM n a JOIN n b ON a.p_partkey + 1 = b.p_partkey""",
    "similarity_full": f"""WITH RECURSIVE q AS (SELECT DISTINCT p_name AS x, reverse(p_name) AS y FROM part),{RATIO}, o AS (SELECT *, string_split(x, ' ') AS a, string_split(y, ' ') AS b FROM ro)
SELECT x AS p_name, y AS other, {_similar("x", "y", "ratio", "round(len(list_intersect(a, b)) / greatest(len(list_distinct(a)), len(list_distinct(b)))::DOUBLE, 4)")} AS similarity FROM o""",
    "fuzzy_pairs": "WITH n AS (SELECT DISTINCT p_type, p_name || (p_partkey % 10) AS n FROM part) SELECT x.p_type, x.n AS a, y.n AS b FROM n x JOIN n y ON x.p_type = y.p_type AND x.n < y.n WHERE levenshtein(x.n, y.n) <= 1",
    "candidate_topk": f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, block_score, CAST(api_rank AS INTEGER) AS api_rank FROM cand",
    "weighted_score": f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, title_score, artist_score, overlap, suspicious, score FROM sc",
    "pattern_tags": f"""WITH RECURSIVE {MATCH} SELECT song_id, track_id, array_to_string(list_filter([CASE WHEN t >= 0.95 AND (artist IS NULL OR a >= 0.85) THEN 'exact' END, CASE WHEN t >= 0.9 OR a >= 0.9 THEN 'notation_difference' END, CASE WHEN a >= 0.85 AND t < 0.55 THEN 'artist_only_overconfidence' END,
CASE WHEN t >= 0.85 AND a < 0.45 THEN 'title_only_overconfidence' END, CASE WHEN t < 0.4 AND a < 0.4 THEN 'weak_both' END, CASE WHEN api_rank = 1 AND (t >= 0.95 OR a >= 0.95) THEN 'top_rank_one_side_exact' END], lambda x: x IS NOT NULL), ',') AS tags FROM ev0""",
    "evidence_pattern": f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, pattern, status, evidence_score FROM ev",
    "best_candidate": f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, pattern, status, evidence_score, confidence_label FROM best",
    "match_counters": f"WITH RECURSIVE {MATCH} SELECT count(*) FILTER (WHERE confidence_label = 'high') AS high, count(*) FILTER (WHERE confidence_label IN ('mid', 'low')) AS needs_review, count(*) FILTER (WHERE confidence_label = 'failed') AS failed, count(*) AS candidates FROM best",
    "playlist_routing": f"WITH RECURSIVE {MATCH} SELECT song_id, uri, route FROM routes",
    "playlist_counters": f"""WITH RECURSIVE {MATCH}, c AS (SELECT count(*) AS total, count(DISTINCT CASE WHEN route = 'matched' THEN uri END) AS matched, count(*) FILTER (WHERE route = 'low_confidence_added') AS low_added, count(*) FILTER (WHERE route = 'low_confidence_skipped') AS low_skipped, count(*) FILTER (WHERE route = 'unmatched') AS unmatched FROM routes)
SELECT *, round((matched + low_added) / (matched + low_added + low_skipped + unmatched)::DOUBLE * 100, 1) AS match_rate FROM c""",
    "playlist_chunks": f"""WITH RECURSIVE {MATCH}, u AS (SELECT song_id % 16 AS playlist_id, uri, min(song_id) AS first_at FROM routes WHERE route IN ('matched', 'low_confidence_added') GROUP BY 1, 2), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY first_at, uri) - 1 AS INTEGER) AS position FROM u)
SELECT *, CAST(position // 100 AS INTEGER) AS chunk FROM n""",
    "result_dedup": f"WITH RECURSIVE {MATCH} SELECT song_id, track_id, evidence_score FROM best QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY evidence_score DESC, song_id) = 1",
    "batch_enrich": f"WITH RECURSIVE {MATCH} SELECT song_id, name AS display_title, artist_name AS display_artist FROM best",
    "cube_matches": f"WITH RECURSIVE {MATCH} SELECT pattern, confidence_label, count(*) AS n FROM best GROUP BY CUBE (pattern, confidence_label)",
    "multi_artist_override": """WITH s AS (SELECT p_partkey // 3 AS doc_id, p_partkey AS line_no, p_type AS artist FROM part), g AS (SELECT doc_id, artist, count(*) AS n, min(line_no) AS f FROM s GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS named, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rk FROM g), c AS (SELECT doc_id, count(DISTINCT artist) AS artists FROM s WHERE line_no % 3 <> 1 GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(artists, 0) < 2 THEN artist END AS artist, coalesce(artists, 0) AS artists, CASE WHEN coalesce(artists, 0) >= 2 THEN 'music_section_multi_artist_override' ELSE '' END AS reason FROM t LEFT JOIN c USING (doc_id) WHERE rk = 1 AND named >= 2 AND n / named::DOUBLE >= 0.7""",
    "ocr_policy": f"""WITH RECURSIVE {MATCH}, k AS (SELECT *, a < 0.5 OR artist IS NULL AS weak FROM best WHERE NOT (a < 0.3 AND len(string_split(title, ' ')) <= 2 AND evidence_score < 0.8)),
p AS (SELECT CASE WHEN weak AND status = 'matched' THEN 'review_needed' ELSE status END AS status, weak, t, CASE WHEN a = 0 THEN least(evidence_score, 0.79) WHEN weak THEN least(evidence_score, 0.6) ELSE evidence_score END AS cap FROM k)
SELECT status, count(*) AS n, max(round(CASE WHEN weak AND t >= 0.8 THEN greatest(cap, 0.55) ELSE cap END, 4))::DOUBLE AS top FROM p GROUP BY status""",
    "source_quality": f"WITH {SONGS} SELECT doc_id, CASE WHEN line_no % 2 = 0 THEN 'description' ELSE 'comments' END AS source, count(*) AS songs, count(*) AS complete, 1.0::DOUBLE AS avg_completeness FROM songs GROUP BY 1, 2",
    "audio_plan": """WITH m AS (SELECT o_orderkey AS doc_id, 60 + o_orderkey % 7200 AS d FROM orders), s AS (SELECT *, greatest(30, least(180, CAST(ceil(d / 30.0) AS INTEGER))) AS step FROM m), g AS (SELECT doc_id, d, step * i AS start_s FROM s, range(30) t(i))
SELECT doc_id, count(*) AS segments, CAST(max(start_s) AS INTEGER) AS last_start FROM g WHERE start_s < d GROUP BY doc_id""",
    "frame_plan": """WITH m AS (SELECT o_orderkey AS doc_id, 60 + o_orderkey % 7200 AS d FROM orders), f AS (SELECT doc_id, unnest(range(0, d, 40)) AS s FROM m UNION SELECT doc_id, unnest(range(0, least(d - 1, 90) + 1, 15)) FROM m UNION SELECT doc_id, unnest(range(greatest(d - 90, 0), d, 15)) FROM m)
SELECT doc_id, count(DISTINCT s) AS frames, CAST(sum(s) AS BIGINT) AS total FROM f GROUP BY doc_id""",
    "audio_recognition": """WITH h AS (SELECT user_id AS doc_id, count(*) AS segments, count(*) FILTER (WHERE event_id % 101 > 60) AS recognised FROM events GROUP BY 1), r AS (SELECT *, round(recognised / segments::DOUBLE, 4) AS rate FROM h)
SELECT *, CASE WHEN rate = 0 THEN 'not_in_db' WHEN rate < 0.35 THEN 'transition' ELSE '' END AS reason FROM r""",
    "audio_merge": "SELECT user_id AS doc_id, event_type AS title, 'x' AS artist, count(*) AS n, max(event_id % 101) AS max_score, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS segments FROM events WHERE event_id % 101 > 60 GROUP BY 1, 2",
    "ocr_frame_scores": f"""WITH {TL}, h AS (SELECT doc_id, line_no, ts, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM tl WHERE line_no <> 50),
g AS (SELECT doc_id, count(*) AS songs, count(ts) AS ts, min(line_no) AS start FROM h GROUP BY doc_id, run), b AS (SELECT doc_id, ts, songs AS delims, songs FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY songs DESC, start) = 1),
e AS (SELECT b.*, n, hits, round(0.45 * ts / songs::DOUBLE + 0.55 * delims / songs::DOUBLE, 4) AS consistency FROM b JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE line_no <> 50) AS hits FROM tl GROUP BY doc_id) USING (doc_id))
SELECT doc_id, ts, delims, songs, n, consistency, round(5.0 * ts + 3.0 * delims + 4.0 * songs + 3.0 * hits / n::DOUBLE + 4.0 * consistency, 4) AS score FROM e""",
    "best_song_run": f"""WITH {TL}, h AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM tl WHERE line_no <> 50), g AS (SELECT doc_id, run, count(*) AS n_lines, min(line_no) AS start FROM h GROUP BY 1, 2)
SELECT doc_id, start, n_lines FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_lines DESC, start) = 1""",
    "rating_stats": f"""WITH {RATINGS}, l AS (SELECT max(created_at) AS last FROM ratings) SELECT count(*) AS n, round(avg(score), 2) AS average, round(avg(score) FILTER (WHERE created_at >= last - INTERVAL 7 DAY), 2) AS recent_average, round(avg(CASE WHEN trim(comment) <> '' THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS comment_rate,
{', '.join(f'count(*) FILTER (WHERE score = {k}) AS score_{k}' for k in range(1, 6))} FROM ratings, l""",
    "rating_distribution": f"WITH {RATINGS} SELECT CAST(k AS INTEGER) AS score, count(id) AS n FROM range(1, 6) t(k) LEFT JOIN ratings ON score = k GROUP BY k",
    "rejected_ratings": "SELECT 'score_out_of_range' AS reason, count(*) AS n FROM events WHERE event_id % 7 NOT BETWEEN 1 AND 5",
    "qa_board": "SELECT event_id AS id, props AS title, event_type AS category, 'waiting' AS status FROM events WHERE event_id % 2 = 0 AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 5 OFFSET 5",
    "latest_tokens": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "rate_per_minute": "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1",
    "sliding_rating_average": f"""WITH {RATINGS}, d AS (SELECT CAST(created_at AS DATE) AS day, sum(score) AS s, count(*) AS n FROM ratings GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w, 4) AS average FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "session_activity": """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
