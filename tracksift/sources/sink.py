"""Playlist requests, as a Spark data sink: each job's requests are there once, whatever fails or runs again.

A task writes its requests to a file of its own in the job's staging folder and reports the file. Commit, on the driver, moves the
reported files to the job's folder, leaves those of lost attempts behind, and writes the manifest last: a job is there
when its manifest is. A job that is there already isn't written again. Abort removes the staging folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tracksift.session import ship
from tracksift.sources import files

REQUEST = "playlist_id long, kind string, chunk int, name string, description string, uris array<string>, deduped_count long, error string"
MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """One task's file and what is in it."""

    file: str
    requests: int
    tracks: int
    deduped_count: int
    errors: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, job: str) -> None:
        self.final, self.staging = f"{path}/job={job}", f"{path}/_staging-{job}"
        self.there = files.exists(f"{self.final}/{MANIFEST}")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        if self.there:
            return Written("", 0, 0, 0, 0)
        context = TaskContext.get()
        out = Written(f"part-{context.partitionId():05d}-{context.taskAttemptId()}.json", 0, 0, 0, 0)
        store, own = files.at(f"{self.staging}/{out.file}")
        store.create_dir(own.rpartition("/")[0], recursive=True)
        with store.open_output_stream(own) as f:
            for r in rows:
                f.write(json.dumps(r.asDict(), ensure_ascii=False).encode() + b"\n")
                out.requests += 1
                out.tracks += len(r.uris or ())
                out.deduped_count += r.deduped_count or 0
                out.errors += r.error is not None
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.there:
            return
        done = [m for m in messages if m is not None]
        store, final = files.at(self.final)
        files.delete(self.final)  # of a commit that stopped before its manifest
        store.create_dir(final, recursive=True)
        for m in done:
            if m.requests:
                store.move(files.at(f"{self.staging}/{m.file}")[1], f"{final}/{m.file}")
        total = {k: sum(getattr(m, k) for m in done) for k in ("requests", "tracks", "deduped_count", "errors")}
        with store.open_output_stream(f"{final}/{MANIFEST}") as f:
            f.write(json.dumps(total | {"files": sorted(m.file for m in done if m.requests)}).encode())
        files.delete(self.staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if not self.there:
            files.delete(self.staging)


class PlaylistRequests(DataSource):
    """Options: path, job (what makes a rerun the same write)."""

    @classmethod
    def name(cls) -> str:
        return "playlist_requests"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options["job"])


def write(requests: DataFrame, path: str, job: str) -> dict:
    """Write requests (see REQUEST) as a job and return its manifest: requests, tracks, deduped_count, errors, files."""
    spark = requests.sparkSession
    ship(spark)
    spark.dataSource.register(PlaylistRequests)
    columns = [F.col(c.split()[0]) for c in REQUEST.split(", ")]
    requests.select(*columns).write.format("playlist_requests").option("job", job).mode("append").save(path)
    store, own = files.at(f"{path.rstrip('/')}/job={job}/{MANIFEST}")
    with store.open_input_stream(own) as f:
        return json.loads(f.read())


def read(spark: SparkSession, path: str, job: str) -> DataFrame:
    """The requests of a written job."""
    return spark.read.schema(REQUEST).json(f"{path.rstrip('/')}/job={job}")
