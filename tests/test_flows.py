"""Paged scans with broken pages and as a stream, sinks that fail and run again, caches against simulated ones, limits in batch and stream."""

from __future__ import annotations

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tracksift.operators import order, playlist, reuse
from tracksift.sources import files, paged, sink
from tracksift.streaming import live


def body(texts, more=True, author="c"):
    items = [{"snippet": {"topLevelComment": {"snippet": {"textDisplay": t, "likeCount": len(t), "authorChannelId": {"value": author}}}}} for t in texts]
    return json.dumps({"items": items} | ({"nextPageToken": "x"} if more else {}))


def landed(spark, path, rows, name="000000"):
    return paged.land(spark.createDataFrame(rows, "doc_id long, channel string, page_no int, body string"), path, name, parts=2)


def test_a_scan_ends_where_a_page_breaks(spark, tmp_path):
    rows = [
        (1, "c", 0, body(["a", "b"])), (1, "c", 1, "<html>502</html>"), (1, "c", 2, body(["never"], False)),  # broken in the middle
        (2, "c", 0, '{"error": {}}'),  # and at once
        (3, "d", 0, body(["x"])), (3, "d", 1, body(["y\tz\n2"], False)),  # whole
        (4, "", 0, body([str(i) for i in range(9)])), (4, "", 1, body(["over"], False)),  # more than the limit
        (5, None, 0, body([], False)), (6, "c", 0, body(["z"], True)),  # no comments; a next page that never landed
        (7, "c", 0, '{"items": [{"snippet": null}]}'), (8, "c", 0, None),
    ]
    path = landed(spark, f"file://{tmp_path}/p", rows)
    got = {}
    for r in paged.read(spark, path, 4).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.text, r.is_author, r.ended))
    assert got == {
        1: [(0, "a", True, "error"), (1, "b", True, "error")],
        3: [(0, "x", False, "end"), (1, "y\tz\n2", False, "end")],
        4: [(i, str(i), False, "limit") for i in range(4)],
        6: [(0, "z", True, "end")],
    }
    assert paged.read(spark, path, 0).count() == 0
    assert paged.read(spark, f"file://{tmp_path}/nothing").count() == 0


def test_stream_of_landings_goes_on_where_it_stopped(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        q = paged.read_stream(spark, path, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    landed(spark, path, [(1, "c", 0, body(["a"], False)), (2, "c", 0, body(["b"], False))])
    run()
    landed(spark, path, [(3, "c", 0, body(["d", "e", "f", "g"], False)), (4, "c", 0, "broken")], "000001")
    run()
    run()  # nothing new
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "d"), (3, "e"), (3, "f")]


def wishes(spark, n=250):
    rows = [(p, i, f"spotify:track:{i % 120:022d}" if i % 7 else "junk") for p in range(3) for i in range(n)] + [(9, 0, "junk"), (9, 1, None)]
    return spark.createDataFrame(rows, "playlist_id long, position int, value string").repartition(4)


def test_requests_by_hand(spark):
    rows = playlist.requests(wishes(spark), spark.createDataFrame([(0, "n" * 150, "d" * 400)], "playlist_id long, name string, description string")).collect()
    by = {(r.playlist_id, r.kind, r.chunk): r for r in rows}
    assert len(rows) == len(by) == 10
    create = by[0, "create", None]
    assert (len(create.name), len(create.description), create.deduped_count) == (100, 300, 250 - 120) and by[1, "create", None].name == "YouTube Playlist"
    first = [f"spotify:track:{i % 120:022d}" for i in range(250) if i % 7]
    want = list(dict.fromkeys(first))
    assert by[1, "add", 0].uris == want[:100] and by[1, "add", 1].uris == want[100:]
    assert by[9, "error", None].error == playlist.NO_TRACKS and by[9, "error", None].deduped_count == 2


def test_a_failed_write_leaves_nothing_and_a_rerun_one_copy(spark, tmp_path):
    path = f"file://{tmp_path}/lists"
    good = playlist.requests(wishes(spark))
    poison = F.when(F.col("chunk") == 1, F.raise_error(F.lit("executor lost"))).otherwise(F.col("error"))
    with pytest.raises(Exception, match="executor lost"):
        sink.write(good.withColumn("error", poison.cast("string")), path, "j1")
    assert not files.exists(f"{path}/job=j1") and not files.exists(f"{path}/_staging-j1")
    # a commit that stopped before its manifest
    store, own = files.at(f"{path}/job=j1")
    store.create_dir(own, recursive=True)
    with store.open_output_stream(f"{own}/part-00000-old.json") as f:
        f.write(b'{"playlist_id": 77}\n')
    total = sink.write(good, path, "j1")
    assert (total["requests"], total["tracks"], total["errors"], total["deduped_count"]) == (10, 360, 1, 3 * 130 + 2)
    assert sink.write(good, path, "j1") == total  # run again: the same manifest, no second copy
    want = sorted((r.playlist_id, r.kind, r.chunk or 0, tuple(r.uris)) for r in good.collect())
    assert sorted((r.playlist_id, r.kind, r.chunk or 0, tuple(r.uris)) for r in sink.read(spark, path, "j1").collect()) == want
    sink.write(good.limit(1), path, "j2")
    assert sink.read(spark, path, "j2").count() == 1 and sink.read(spark, path, "j1").count() == 10
    assert sink.write(good.where("false"), path, "j3")["requests"] == 0


def simulated(requests, size, ttl):
    cache, out = OrderedDict(), []
    for key, t in requests:
        hit = key in cache and (ttl is None or t - cache[key] < ttl)
        if hit:
            cache.move_to_end(key)
        else:
            cache.pop(key, None)
            cache[key] = t
            if len(cache) > size:
                cache.popitem(last=False)
        out.append(hit)
    return out


@pytest.mark.parametrize(("size", "ttl", "block"), [(5, None, 16), (5, 40, 16), (20, 90, 7), (3, 25, 1000), (1, 10, 5)])
def test_cache_equals_a_simulated_one(spark, size, ttl, block):
    rng = random.Random(size * 100 + block)
    t, requests = 0, []
    for _ in range(400):
        t += rng.choice((0, 1, 1, 2, 5, 30))
        requests.append((rng.choice((None, "hot", "hot", *(f"k{i}" for i in range(25)))), t))
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(requests)], "i int, k string, t long").withColumn("ts", F.timestamp_seconds("t")).repartition(3)
    got = reuse.cache_hits(rows, "k", ["ts", "i"], "ts", size, ttl, block=block).collect()
    assert [r.hit for r in sorted(got, key=lambda r: r.i)] == simulated(requests, size, ttl)
    assert reuse.cache_hits(rows.where("false"), "k", ["ts", "i"], "ts", size, ttl).count() == 0


def test_distances_are_exact_below_the_bound(spark):
    rng = random.Random(8)
    keys = [rng.randrange(30) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k int")
    got = {r.i: r.distance for r in reuse.distances(rows, "k", ["i"], 10, block=32).collect()}
    for i, k in enumerate(keys):
        before = [j for j in range(i) if keys[j] == k]
        want = len(set(keys[before[-1] + 1 : i])) if before else None
        assert got[i] == want or (want is not None and want >= 10 and (got[i] is None or got[i] == want))


def limits(requests, limit, span):
    state, out = {}, {}
    for i, k, us in requests:
        opened, n = state.get(k, (None, 0))
        if opened is None or us - opened >= span * 1_000_000:
            opened, n = us, 0
        n += 1
        state[k] = (opened, n)
        out[i] = (True, None) if n <= limit else (False, max(1, -(-(opened + span * 1_000_000 - us) // 1_000_000)))
    return out


def test_limits_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    us, requests = 1_700_000_000_000_000, []
    for i in range(600):
        us += rng.randrange(1, 4_000_000)
        requests.append((i, rng.choice("aab"), us))
    rows = spark.createDataFrame(requests, "i int, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    want = limits(requests, 10, 60)
    assert any(not a for a, _ in want.values())
    own = order.placed(rows.repartition(3), "us", "i")
    assert [r.at for r in own.orderBy("i").collect()] == list(range(600))
    got = {r.i: (r.allowed, r.retry_after) for r in order.limited(own, "k", "at", "us", 10).collect()}
    assert got == want
    for n in range(3):  # three steps of a stream
        rows.where(f"i >= {n * 200} and i < {n * 200 + 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = live.limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "i", "ts", 10).writeStream.format("parquet")
        conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(180)
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if conf is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", conf)
    got = {r.id: (r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
