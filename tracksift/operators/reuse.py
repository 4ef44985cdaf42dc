"""Caches of a bounded size, by reuse distance: how many other keys were asked for since a key was last.

A cache of `size` that drops what was used longest ago holds a key exactly if fewer than `size` others came since. Requests are
cut in blocks of their order. What a block needs of all before is the keys used last, `most` of them: such lists merge (the later
use of a key counts), so all blocks get theirs in as many rounds as the number of blocks doubles. Within a
block a counting tree over places, with a mark at the last use of each key, gives the distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksift.operators import order
from tracksift.session import cut, ship

BLOCK = 1 << 16


class CountingTree:
    """Marks at places, and how many stand in a range (Fenwick)."""

    def __init__(self, n: int) -> None:
        self.sums = [0] * (n + 1)

    def add(self, place: int, by: int) -> None:
        place += 1
        while place < len(self.sums):
            self.sums[place] += by
            place += place & -place

    def before(self, place: int) -> int:
        total = 0
        while place > 0:
            total += self.sums[place]
            place -= place & -place
        return total


def block_distances(keys: list, known: list) -> list[int | None]:
    """For each request, how many other keys came since its key's last; null if that is neither here nor in known (keys used before, the last one at the end)."""
    tree, last, out = CountingTree(len(known) + len(keys)), {}, []
    for i, k in enumerate(known):
        last[k] = i
        tree.add(i, 1)
    for i, k in enumerate(keys, len(known)):
        was = last.get(k)
        out.append(None if was is None else tree.before(i) - tree.before(was + 1))
        if was is not None:
            tree.add(was, -1)
        tree.add(i, 1)
        last[k] = i
    return out


def _stacks(requests: DataFrame, most: int) -> DataFrame:
    """block, key, at: for each block the `most` keys used last in all blocks before."""

    def cut_to_most(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("block", "key").agg(F.max("at").alias("at"))
        return one.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy(F.col("at").desc()))).where(F.col("nth") <= most).drop("nth")

    blocks = (requests.agg(F.max("block")).first()[0] or 0) + 1
    now = cut(cut_to_most(requests.select((F.col("block") + 1).alias("block"), "key", "at")).where(F.col("block") < blocks), "reuse-stack")
    reach = 1
    while reach < blocks:
        earlier = now.select((F.col("block") + reach).alias("block"), "key", "at").where(F.col("block") < blocks)
        now = cut(cut_to_most(now.unionByName(earlier)), "reuse-stack")
        reach *= 2
    return now


def distances(requests: DataFrame, key: str, by: list[str], most: int, block: int = BLOCK) -> DataFrame:
    """requests with at (their place by `by`, which must tell them apart) and distance: exact below `most`, null for a first request, and either the distance or null above.

    A null key is a key. An empty table stays empty.
    """
    ship(requests.sparkSession)
    # one read of the ordered rows serves all that follows
    rows = cut(order.placed(requests, *by), "reuse-rows")
    own = rows.select("at", F.struct(key).alias("key"), F.floor(F.col("at") / block).cast("int").alias("block"))
    stacks = _stacks(own, most)

    def walk(here: pa.Table, before: pa.Table) -> pa.Table:
        def names(t: pa.Table) -> tuple[list, np.ndarray]:
            at = t.column("at").to_numpy()
            nth = np.argsort(at)
            return [tuple(k.values()) for k in t.column("key").take(pa.array(nth)).to_pylist()], at[nth]

        keys, at = names(here)
        return pa.table({"at": pa.array(at), "distance": pa.array(block_distances(keys, names(before)[0]), pa.int64())})

    found = own.groupBy("block").cogroup(stacks.groupBy("block")).applyInArrow(walk, "at long, distance long")
    return rows.join(found, "at")


def cache_hits(requests: DataFrame, key: str, by: list[str], ts: str, size: int, ttl_s: float | None = None, block: int = BLOCK) -> DataFrame:
    """requests with hit: what a cache of `size` answers, from which the key used longest ago goes first.

    With ttl_s an answer is as old as the request that fetched it, and from that age on is fetched again; it keeps its
    place in the order of use meanwhile.
    """
    own = distances(requests, key, by, size, block)
    held = F.coalesce(F.col("distance") < size, F.lit(False))
    if ttl_s is None:
        return own.withColumn("hit", held).drop("at", "distance")
    timed = own.withColumns({"_held": held, "_us": F.unix_micros(F.col(ts).cast("timestamp")), "_key": F.to_json(F.struct(key))})
    walked = order.chained(timed, ["_key"], "at", "_us", ttl_s, breaks=~F.col("_held"), into="_from")
    # the request that starts a chain fetches; equal times are told apart by what the chain's first place is
    first = F.min("at").over(Window.partitionBy("_key", "_from"))
    return walked.withColumn("hit", F.col("_held") & (F.col("at") != first)).drop("at", "distance", "_held", "_us", "_key", "_from")
