"""Comments of paged responses, as a Spark data source: batch and stream.

Landed pages are lines of text files: document, its channel, page number and the response as it came, parted by tabs. All pages of a
document are in one file, in order. A partition is a file, read line by line; a document's scan goes from page to page
until it has `limit` comments, the last page is read, or a page is broken, and keeps what came before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracksift.session import ship
from tracksift.sources import files

SCHEMA = "doc_id long, pos int, text string, like_count long, published_at string, author string, is_author boolean, ended string"
LIMIT, PAGE = 30, 100


def land(pages: DataFrame, path: str, name: str = "000000", parts: int | None = None) -> str:
    """Write pages (doc_id, channel, page_no, body) as one landing: a folder below path. Landings are read in order of their names."""
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("channel", F.lit("")), F.col("page_no").cast("string"), F.regexp_replace(F.coalesce("body", F.lit("")), r"[\t\r\n]", " "))
    dealt = pages.repartition(parts, "doc_id") if parts else pages.repartition("doc_id")
    dealt.sortWithinPartitions("doc_id", "page_no").select(line.alias("value")).write.text(f"{path}/{name}")
    return path


def page_body(items, more) -> F.Column:
    """A response as JSON: items are structs text, like_count, published_at, author; more says whether another page follows."""
    snippet = lambda c: F.struct(c.text.alias("textDisplay"), c.like_count.alias("likeCount"), c.published_at.alias("publishedAt"), F.struct(c.author.alias("value")).alias("authorChannelId"))
    shaped = F.transform(items, lambda c: F.struct(F.struct(F.struct(snippet(c).alias("snippet")).alias("topLevelComment")).alias("snippet")))
    return F.to_json(F.struct(shaped.alias("items"), F.when(more, "next").alias("nextPageToken")))


def scan(doc_id: int, channel: str, bodies: Iterator[str], limit: int) -> list[tuple]:
    """Rows of one document's pages: whatever a page breaks on (no JSON, no items) ends the scan with what is there."""
    rows: list[tuple] = []
    ended = "end"
    for body in bodies:
        try:
            page = json.loads(body)
            items = [i["snippet"]["topLevelComment"]["snippet"] for i in page["items"]]
            found = [((c.get("textDisplay") or ""), int(c.get("likeCount") or 0), c.get("publishedAt") or "", (c.get("authorChannelId") or {}).get("value") or "") for c in items]
        except (ValueError, KeyError, TypeError, AttributeError):
            ended = "error"
            break
        rows += found[: limit - len(rows)]
        if len(rows) >= limit:
            ended = "limit"
            break
        if not page.get("nextPageToken"):
            break
    return [(doc_id, i, t, n, at, who, bool(channel) and who == channel, ended) for i, (t, n, at, who) in enumerate(rows)]


def _documents(lines: Iterator[str]) -> Iterator[tuple[int, str, Iterator[str]]]:
    """Consecutive lines of a document, as an iterator that may be left before its end."""
    ahead = next(lines, None)
    while ahead is not None:
        doc, channel = ahead.split("\t", 3)[:2]
        left = [ahead]

        def bodies(doc: str = doc, left: list = left) -> Iterator[str]:
            while left[0] is not None and left[0].split("\t", 1)[0] == doc:
                body = left[0].rstrip("\n").split("\t", 3)[3]
                left[0] = next(lines, None)
                yield body

        own = bodies()
        yield int(doc), channel, own
        for _ in own:  # pages past the scan's end
            pass
        ahead = left[0]


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _read(partition: _File | None, limit: int) -> Iterator[tuple]:
    if partition is None:  # nothing has landed
        return
    store, own = files.at(partition.path)
    with store.open_input_stream(own) as raw:

        def lines() -> Iterator[str]:
            rest = b""
            while block := raw.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (x.decode() for x in whole)
            if rest:
                yield rest.decode()

        for doc, channel, bodies in _documents(lines()):
            yield from scan(doc, channel, bodies, limit)


def _folders(path: str) -> list[str]:
    from pyarrow import fs

    store, own = files.at(path)
    found = store.get_file_info(fs.FileSelector(own, allow_not_found=True))
    done = [f.base_name for f in found if f.type == fs.FileType.Directory and files.exists(f"{path}/{f.base_name}/_SUCCESS")]
    return [f"{path}/{d}" for d in sorted(done)]


class _Batch(DataSourceReader):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def partitions(self) -> list[InputPartition]:
        return [_File(f"{d}/{n}") for d in _folders(self.path) for n in files.names(d)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(partition, self.limit)


class _Stream(DataSourceStreamReader):
    """The offset is how many whole landings were read; a landing is never read in part."""

    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def initialOffset(self) -> dict:  # noqa: N802
        return {"landings": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"landings": len(_folders(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f"{d}/{n}") for d in _folders(self.path)[start["landings"] : end["landings"]] for n in files.names(d)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(partition, self.limit)

    def commit(self, end: dict) -> None:
        pass


class PagedComments(DataSource):
    """Options: path, limit (LIMIT comments a document)."""

    @classmethod
    def name(cls) -> str:
        return "paged_comments"

    def schema(self) -> str:
        return SCHEMA

    def _own(self) -> tuple[str, int]:
        return self.options["path"].rstrip("/"), max(0, int(self.options.get("limit", LIMIT)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._own())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._own())


def read(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """The first `limit` comments of each landed document, and how its scan ended: limit, end or error."""
    ship(spark)
    spark.dataSource.register(PagedComments)
    return spark.read.format("paged_comments").option("limit", limit).load(path)


def read_stream(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """The same as a stream of landings: each is one step, and a restarted query goes on after the last whole one."""
    ship(spark)
    spark.dataSource.register(PagedComments)
    return spark.readStream.format("paged_comments").option("limit", limit).load(path)
