"""Landed tables as the engine's inputs: documents, comments, cards, catalogues, and joins that compose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X

_TEXT = "struct<simpleText:string>"
_CARD = "struct<title:string,subtitle:string,secondarySubtitle:struct<content:string>,artist:string,album:string>"
_LIST = (
    f"struct<header:struct<richListHeaderRenderer:struct<subtitle:{_TEXT},title:{_TEXT}>,titleText:struct<runs:array<struct<text:string>>>>,"
    f"cards:array<struct<videoAttributeViewModel:{_CARD},musicAttributeViewModel:{_CARD},musicCardAttributeViewModel:{_CARD}>>>"
)
_BODY = f"struct<items:array<struct<horizontalCardListRenderer:{_LIST}>>>"
_PANEL = f"struct<panelIdentifier:string,content:struct<structuredDescriptionContentRenderer:{_BODY},engagementPanelSectionListRenderer:struct<content:struct<structuredDescriptionContentRenderer:{_BODY}>>>>"
#: The nesting of a page's panels, and the panel that holds lists of cards.
PANELS = f"struct<engagementPanels:array<struct<engagementPanelSectionListRenderer:{_PANEL},engagementPanelSectionListRendererV2:{_PANEL}>>>"
DESCRIPTION_PANEL = "engagement-panel-structured-description"
CARDS = "struct<sections:array<struct<header:string,items:array<struct<title:string,artist:string,album:string>>>>>"


def comments(rows: DataFrame, limit: int = 30, key: str = "doc_id") -> DataFrame:
    """The first `limit` comments of each document, by position."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= limit).drop("_n")


def compose(videos: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the array of their comments, in order."""
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "like_count"))).alias("comments"))
    return videos.join(own, key, "left").withColumn("comments", F.coalesce("comments", F.array().cast("array<struct<pos:int,text:string,like_count:bigint>>")))


def cards(payloads: DataFrame, key: str = "doc_id", body: str = "payload") -> DataFrame:
    """section_index, title, artist, album of the first music section that has cards; bad JSON gives none."""
    own = payloads.select(key, F.posexplode(F.from_json(body, CARDS)["sections"]).alias("section", "s"))
    own = own.where(F.lower("s.header").rlike("music|음악") & (F.size("s.items") > 0))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("section"))).where("_n = 1")
    each = first.select(key, F.posexplode("s.items").alias("section_index", "c")).select(key, "section_index", "c.*")
    return each.where("coalesce(trim(title), '') <> '' and coalesce(trim(artist), '') <> ''")


def _card(c: Column) -> Column:
    """title, artist, album of a card in either layout; the older one counts where it has a title."""
    trimmed = lambda x: F.trim(F.coalesce(x, F.lit("")))
    old, new = c["videoAttributeViewModel"], F.coalesce(c["musicAttributeViewModel"], c["musicCardAttributeViewModel"])
    is_old = trimmed(old["title"]) != ""
    album = F.when(is_old, trimmed(old["secondarySubtitle"]["content"])).otherwise(trimmed(new["album"]))
    artist = F.when(is_old, trimmed(old["subtitle"])).otherwise(F.coalesce(X.blank_to_null(new["artist"]), trimmed(new["subtitle"])))
    return F.struct(F.when(is_old, trimmed(old["title"])).otherwise(trimmed(new["title"])).alias("title"), artist.alias("artist"), album.alias("album"))


def panel_cards(payloads: DataFrame, key: str = "doc_id", body: str = "payload") -> DataFrame:
    """key, section_index, title, artist, album: the songs of a page's first music list that has any, from its nested panels.

    A list is one of music if its header (subtitle, title or first run) says so. Cards without a title or artist go; a
    page that is no JSON or has no such list gives none. A projection: each page is read once, nothing is shuffled.
    """
    panels = F.from_json(F.col(body), PANELS)["engagementPanels"]
    panels = F.transform(panels, lambda p: F.coalesce(p["engagementPanelSectionListRenderer"], p["engagementPanelSectionListRendererV2"]))
    panels = F.filter(panels, lambda p: p["panelIdentifier"] == DESCRIPTION_PANEL)
    content = lambda p: p["content"]
    nested = lambda p: content(p)["engagementPanelSectionListRenderer"]["content"]["structuredDescriptionContentRenderer"]["items"]
    lists = F.flatten(F.transform(panels, lambda p: F.coalesce(content(p)["structuredDescriptionContentRenderer"]["items"], nested(p), F.from_json(F.lit("[]"), f"array<struct<horizontalCardListRenderer:{_LIST}>>"))))
    lists = F.transform(lists, lambda i: i["horizontalCardListRenderer"])

    def header(i: Column) -> Column:
        rich = i["header"]["richListHeaderRenderer"]
        said = [F.nullif(c, F.lit("")) for c in (rich["subtitle"]["simpleText"], rich["title"]["simpleText"], F.get(i["header"]["titleText"]["runs"], F.lit(0))["text"])]
        return F.lower(F.trim(F.coalesce(*said, F.lit(""))))

    lists = F.filter(lists, lambda i: header(i).rlike(X.any_of(L.MUSIC_HEADERS)))
    songs = F.transform(lists, lambda i: F.filter(F.transform(i["cards"], _card), lambda s: (s["title"] != "") & (s["artist"] != "")))
    first = F.get(F.filter(songs, lambda s: F.size(s) > 0), F.lit(0))
    return payloads.select(key, F.posexplode(first).alias("section_index", "s")).select(key, "section_index", "s.*")


def comment_groups(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Comments by the source they serve, in order of priority: author, pinned (the first), the three most liked, timed (ten at most), all (thirty at most).

    rows: key, pos, text, like_count, is_author. A comment may serve several groups; groups but the last two
    need a time or pair in the text.
    """
    timed = F.col("text").rlike(r"(?:^|[^\d])(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[^\d]|$)")
    pattern = timed | F.col("text").rlike(r"\S\s[-–—|/:~_]\s\S")
    by = lambda *o: F.row_number().over(Window.partitionBy(key).orderBy(*o))
    own = rows.where(F.trim("text") != "").withColumn("timed", timed).withColumn("pattern", pattern).withColumn("nth", by("pos")).withColumn("liked", by(F.col("like_count").desc(), "pos"))
    own = own.withColumn("timed_nth", F.when(F.col("timed"), F.row_number().over(Window.partitionBy(key, "timed").orderBy("pos"))))
    groups = [
        (F.col("is_author") & F.col("pattern"), 0, "author_comment"), ((F.col("nth") == 1) & F.col("pattern"), 1, "pinned_comment"), ((F.col("liked") <= 3) & F.col("pattern"), 2, "top_liked_comment"),
        (F.col("timed_nth") <= 10, 3, "timestamp_comments"), (F.col("nth") <= 30, 4, "expanded_comments"),
    ]
    tags = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("group_rank"), F.lit(n).alias("source"))) for c, r, n in groups]), lambda x: x.isNotNull())
    return own.select(key, "pos", "text", F.explode(tags).alias("g")).select(key, "pos", "text", "g.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
