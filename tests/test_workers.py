"""Python workers get the package from the session, not from their path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

CODE = """
import sys
sys.path.insert(0, {repo!r})  # the driver's path only: workers start in another folder
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tracksift.functions import text as X
from tracksift.operators import dedup
from tracksift.plans import queries
from pyspark.sql import functions as F
songs = spark.createDataFrame([(1, i, "a title", "an artist", i, 50) for i in range(12)], "doc_id long, line_no int, title string, artist string, segment_index long, score long")
cards = spark.createDataFrame([(1, 0, "a title", "an artist")], "doc_id long, section_index int, title string, artist string")
assert songs.select(X.nfkc("title"), X.best_similarity(F.array("title"), F.array("artist")), X.similarity(F.col("title"), F.col("artist"))).count() == 12
from tracksift.operators import order, playlist, reuse
from tracksift.sources import paged, sink
pages = spark.createDataFrame([(1, "c", 0, '{{"items": []}}')], "doc_id long, channel string, page_no int, body string")
assert paged.read(spark, paged.land(pages, "file://{here}/pages")).count() == 0
wishes = spark.createDataFrame([(1, 0, "0" * 22)], "playlist_id long, position int, value string")
assert sink.write(playlist.requests(wishes), "file://{here}/lists", "j")["tracks"] == 1
rows = order.placed(songs, "line_no")
assert order.limited(rows, "title", "at", "score", 3).where("allowed").count() == 3
assert reuse.cache_hits(songs, "title", ["line_no"], "line_no", 3).where("hit").count() == 11
for f in (songs.select(X.nfkc("title").alias("n")), songs.select(X.best_similarity(F.array("title"), F.array("artist"))), dedup.fuzzy_dedup(songs), dedup.near_duplicates(songs),
          dedup.section_join(songs, cards), dedup.supplement(songs, cards), dedup.merge_audio_hits(songs)):
    f.collect()
print("all ran")
"""


def test_workers_without_the_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), here=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-3000:]
