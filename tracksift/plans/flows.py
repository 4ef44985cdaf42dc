"""Queries around sources, sinks, caches and limits, each with the DuckDB SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.operators import order, playlist, reuse
from tracksift.session import scratch, table
from tracksift.sources import landed, paged, sink

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


# paged comments

_PAGE, _LIMIT = 2, 5


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as comments: two a page, relevance being the turn; the second page of one conversation in seven is broken, and the channel's own comments are the assistant's."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.floor(F.col("turn") / _PAGE).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("author"))
    last = c.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    item = F.struct("turn", "text", (F.col("turn") * 3).alias("like_count"), F.lit("").alias("published_at"), "author")
    each = c.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("items")).join(last, "doc_id")
    body = paged.page_body(F.col("items"), F.col("page_no") < F.col("last"))
    broken = (F.col("doc_id") % 7 == 3) & (F.col("page_no") == 1)
    return each.select("doc_id", F.lit("assistant").alias("channel"), "page_no", F.when(broken, '{"error": {"code": 503}}').otherwise(body).alias("body"))


_PAGED = f"""WITH c AS (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS text, coalesce(role, '') AS role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r AS (SELECT *, doc_id % 7 = 3 AND n > {_PAGE} AS broken FROM c)
SELECT doc_id, turn AS pos, text, turn * 3 AS like_count, role = 'assistant' AS is_author, CASE WHEN broken THEN 'error' WHEN n >= {_LIMIT} THEN 'limit' ELSE 'end' END AS ended
FROM r WHERE turn < {_LIMIT} AND NOT (broken AND turn >= {_PAGE})"""


@query(_PAGED)
def paged_comments(spark: SparkSession, sf: str) -> DataFrame:
    path = paged.land(pages(spark, sf), scratch(spark, "pages"))
    return paged.read(spark, path, _LIMIT).select("doc_id", "pos", "text", "like_count", "is_author", "ended")


@query(f"WITH p AS ({_PAGED}) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE is_author) AS n_author, sum(length(text)) AS chars FROM p WHERE pos < 3 GROUP BY doc_id")
def first_comments(spark: SparkSession, sf: str) -> DataFrame:
    """The first three comments of each document's pages, composed with their video."""
    path = paged.land(pages(spark, sf), scratch(spark, "pages"))
    rows = landed.comments(paged.read(spark, path, _LIMIT), limit=3)
    videos = rows.select("doc_id").distinct()
    own = landed.compose(videos, rows.select("doc_id", "pos", "text", "like_count"))
    authors = rows.groupBy("doc_id").agg(F.count_if("is_author").alias("n_author"))
    chars = F.aggregate("comments", F.lit(0).cast("long"), lambda n, c: n + F.length(c.text))
    return own.join(authors, "doc_id").select("doc_id", F.size("comments").cast("long").alias("n"), "n_author", chars.alias("chars"))


# playlist requests


@query("""WITH r AS (SELECT p_partkey % 8 AS playlist_id, p_partkey AS position, CASE WHEN p_partkey % 8 < 7 AND p_partkey % 5 < 4 THEN 'spotify:track:' || lpad(CAST(p_partkey % 500 AS VARCHAR), 22, '0') END AS uri FROM part),
f AS (SELECT playlist_id, uri, row_number() OVER (PARTITION BY playlist_id ORDER BY min(position)) - 1 AS nth FROM r WHERE uri IS NOT NULL GROUP BY playlist_id, uri),
a AS (SELECT playlist_id, nth // 100 AS chunk, count(*) AS n_uris, arg_min(uri, nth) AS first_uri, arg_max(uri, nth) AS last_uri FROM f GROUP BY 1, 2),
c AS (SELECT playlist_id, count(*) AS asked, (SELECT count(*) FROM f WHERE f.playlist_id = r.playlist_id) AS kept FROM r GROUP BY playlist_id)
SELECT playlist_id, 'add' AS kind, CAST(chunk AS INT) AS chunk, NULL AS name, CAST(n_uris AS INT) AS n_uris, first_uri, last_uri, NULL AS deduped_count, NULL AS error FROM a
UNION ALL SELECT playlist_id, CASE WHEN kept > 0 THEN 'create' ELSE 'error' END, NULL, left('list ' || playlist_id || repeat('x', 120), 100), 0, NULL, NULL, asked - kept, CASE WHEN kept = 0 THEN '선택된 곡이 없습니다.' END FROM c""")
def playlist_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Eight playlists of values in four forms, one in five of which names no track, and one playlist without any; written twice as one job, read back."""
    k = F.col("p_partkey")
    track = F.lpad((k % 500).cast("string"), 22, "0")
    forms = F.when(k % 4 == 0, F.concat(F.lit("spotify:track:"), track)).when(k % 4 == 1, F.concat(F.lit("https://open.spotify.com/track/"), track, F.lit("?si=x"))).when(k % 4 == 2, track)
    forms = forms.otherwise(F.concat(F.lit(" https://open.spotify.com/intl-de/track/"), track))
    rows = table(spark, sf, "part").select((k % 8).alias("playlist_id"), k.alias("position"), F.when((k % 8 < 7) & (k % 5 < 4), forms).otherwise(F.concat(F.lit("no track "), track)).alias("value"))
    headers = rows.select("playlist_id").distinct().withColumns({"name": F.concat(F.lit("list "), "playlist_id", F.repeat(F.lit("x"), 120)), "description": F.lit("d")})
    path = scratch(spark, "playlists")
    requests = playlist.requests(rows, headers)
    sink.write(requests, path, "all")
    sink.write(requests, path, "all")
    out = sink.read(spark, path, "all")
    edge = lambda i: F.try_element_at("uris", F.lit(i))
    return out.select("playlist_id", "kind", "chunk", "name", F.size("uris").alias("n_uris"), edge(1).alias("first_uri"), edge(-1).alias("last_uri"), "deduped_count", "error")


# caches and limits


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_DISTANCE = """WITH RECURSIVE e AS (SELECT *, {key} AS k, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), p AS (SELECT *, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM e),
d AS (SELECT a.i, count(DISTINCT b.k) AS distance FROM p a LEFT JOIN p b ON b.i > a.prev AND b.i < a.i WHERE a.prev IS NOT NULL GROUP BY a.i),
n AS (SELECT p.*, coalesce(distance < {size}, false) AS held, row_number() OVER (PARTITION BY k ORDER BY p.i) AS nth FROM p LEFT JOIN d ON p.i = d.i)"""


@query(_DISTANCE.format(key="user_id", size=100) + """, w AS (SELECT k, nth, event_id, ts AS fetched, false AS hit FROM n WHERE nth = 1
  UNION ALL SELECT n.k, n.nth, n.event_id, CASE WHEN held AND epoch_us(n.ts) - epoch_us(fetched) < 259200000000 THEN fetched ELSE n.ts END, held AND epoch_us(n.ts) - epoch_us(fetched) < 259200000000 FROM w JOIN n ON n.k = w.k AND n.nth = w.nth + 1)
SELECT k AS user_id, event_id, hit FROM w""")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Users as addresses: a cache of 100 whose answers live for three days."""
    return reuse.cache_hits(_events(spark, sf), "user_id", ["ts", "event_id"], "ts", 100, 3 * 86_400).select("user_id", "event_id", "hit")


@query(_DISTANCE.format(key="user_id || event_type", size=300) + " SELECT event_id, held AS hit FROM n")
def match_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Users and types as songs: a cache of 300 matches without an end."""
    own = _events(spark, sf).withColumn("song", F.concat(F.col("user_id").cast("string"), "event_type"))
    return reuse.cache_hits(own, "song", ["ts", "event_id"], "ts", 300).select("event_id", "hit")


@query("""WITH RECURSIVE o AS (SELECT event_type AS k, min(ts) AS opened FROM events GROUP BY 1 UNION ALL SELECT k, opened FROM (SELECT o.k, min(e.ts) AS opened FROM o JOIN events e ON e.event_type = o.k AND epoch_us(e.ts) - epoch_us(o.opened) >= 21600000000 GROUP BY o.k, o.opened)),
r AS (SELECT e.event_id, e.ts, opened, row_number() OVER (PARTITION BY event_type, opened ORDER BY e.ts, e.event_id) AS n FROM events e ASOF JOIN o ON e.event_type = o.k AND e.ts >= o.opened)
SELECT event_id, n <= 10 AS allowed_10, CASE WHEN n > 10 THEN CAST(greatest(1, ceil((epoch_us(opened) + 21600000000 - epoch_us(ts)) / 1e6)) AS INT) END AS retry_after, n <= 20 AS allowed_20 FROM r""")
def rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Ten and twenty requests of a type in six hours."""
    own = order.placed(_events(spark, sf).select("event_id", "event_type", "ts"), "ts", "event_id").withColumn("us", F.unix_micros("ts"))
    ten = order.limited(own, "event_type", "at", "us", 10, 21_600).select("event_id", F.col("allowed").alias("allowed_10"), "retry_after")
    twenty = order.limited(own, "event_type", "at", "us", 20, 21_600).select("event_id", F.col("allowed").alias("allowed_20"))
    return ten.join(twenty, "event_id")
