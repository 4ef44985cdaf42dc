"""Routing of inputs: video and playlist addresses and bare ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route(c: Column) -> Column:
    """struct(kind, id): video, playlist or error (null id) of an address or a bare id; null is an error."""
    s = F.trim(c)
    part = lambda name: F.nullif(F.regexp_extract(s, rf"[?&]{name}=([^&#]+)", 1), F.lit(""))
    v, lst = part("v"), part("list")
    short = F.nullif(F.regexp_extract(s, r"^https?://youtu\.be/([A-Za-z0-9_-]{11})", 1), F.lit(""))
    web = s.rlike(r"^https?://(?:www\.|m\.|music\.)?youtube\.com/")
    radio = F.coalesce(lst.startswith("RD"), F.lit(False))
    video = F.when(short.isNotNull(), short).when(web & v.isNotNull() & (lst.isNull() | radio), v).when(s.rlike(r"^[A-Za-z0-9_-]{11}$"), s)
    listed = F.when(web & lst.isNotNull() & ~(radio & v.isNotNull()), lst).when(s.rlike(r"^(?:PL|UU|LL|OLAK)[A-Za-z0-9_-]+$"), s)
    kind = F.when(listed.isNotNull(), "playlist").when(video.isNotNull(), "video").otherwise("error")
    return F.struct(kind.alias("kind"), F.coalesce(listed, video).alias("id"))


def thumbnail_id(c: Column) -> Column:
    """The video id of a watch, short, shorts or embed address; null if none."""
    return F.nullif(F.regexp_extract(c, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
