"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

Tokens are lower-cased runs of letters and digits; distances count token edits. An item of L tokens is
found where some run of the document is within floor(EDIT_RATE * L) edits of it.

1. CGK: a walk over a string copies the token it stands on at each step and goes on or stays by a shared random
   coin of (walk, step, token). Strings at few edits fall back into step, so edits become Hamming distance.
   Coins repeat with PHASES steps (one of them goes on, so no walk gets stuck), so walks that meet on a token in
   one phase go on alike: what a walk copies after a place is the same for all windows that lead there.
2. Index: each item's embedding is sampled at places j, j + g1, j + g2, ... for all j in phase 0 and the gap sets
   of GAPS or, for items under SHORT tokens, SHORT_GAPS, in WALKS walks; the sampled tokens' hash is the key, in one
   sorted array for each walk and gap set.
3. Windows: for each token of a document the same samples of the walk that stands there in phase 0 belong to every
   item-sized window that leads there; each is looked up once for all of them. A key in the index gives the item
   and, by its place in it, the window. A pair at the full edit rate shares a key in more than 99 of 100 cases
   (measured against brute force by the tests). Items under LEAST tokens allow no edits and are looked up whole.
4. A window goes on if its region lacks no more of the item's tokens than edits are allowed, which loses nothing.
5. Exact edit distance of the item against the region around the window (Myers' bit vectors).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksift.llm import words as W
from tracksift.llm.quality import BREAKS
from tracksift.session import ship

EDIT_RATE = 0.2
LEAST = 5
WALKS, PHASES = 4, 4
#: Steps from a sample's first place to its others; those of items under SHORT tokens reach less far.
GAPS, SHORT_GAPS, SHORT = ((2, 4, 6),), ((2, 4),), 12
#: Items searched for in one pass over the documents; what is broadcast is bounded by this many items.
ITEMS_AT_ONCE = 20_000
_FILTER = 1 << 20


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block, and where rows begin."""
    start, end = W.spans(off, data, BREAKS)
    return W.span_hash(W.LOWER[data], start, end), np.searchsorted(start, off)


class Items(NamedTuple):
    """Items' tokens, and the index: for each (walk, gaps), and each length under LEAST, sorted keys, items, places and a filter of the keys."""

    ids: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    known: np.ndarray
    index: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def coins(x: np.ndarray, walk: int) -> list[np.ndarray]:
    """Whether the walk goes on from each token, in each phase."""
    h = W.mix(x ^ np.uint64(0xA5A5 + walk))
    always = (h >> np.uint64(60)) % np.uint64(PHASES)
    return [((h >> np.uint64(r)) & np.uint64(1)).astype(np.int64) | (always == r) for r in range(PHASES)]


def samples(x: np.ndarray, at: np.ndarray, ends: np.ndarray, walk: int, gaps: tuple[tuple[int, ...], ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gap set those of the places at whose samples lie before their row's end, and the samples' keys."""
    coin = coins(x, walk)
    place = [at]
    for j in range(max(max(g) for g in gaps)):
        place.append(np.minimum(place[j] + coin[j % PHASES][np.minimum(place[j], len(x) - 1)], ends))
    for n, g in enumerate(gaps):
        inside = np.flatnonzero(place[g[-1]] < ends)
        key = np.full(len(inside), np.uint64((walk << 8) + (len(g) << 4) + n + 1))
        for j in (0, *g):
            key = W.mix(key ^ x[place[j][inside]])
        yield at[inside], key


def _filled(key: np.ndarray) -> np.ndarray:
    seen = np.zeros(_FILTER, bool)
    seen[(key & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    return seen


def items_of(ids: list[int], texts: list[str | None]) -> Items:
    """The index of all items with a token; items are whole, however long."""
    off, data = W.buffers(pa.array([t or "" for t in texts], pa.large_string()))
    h, first = tokens(off, data)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    found: dict[tuple, list] = {}
    at = np.arange(len(h))
    for gaps, chosen in ((GAPS, size >= SHORT), (SHORT_GAPS, (size >= LEAST) & (size < SHORT))):
        for walk in range(WALKS) if chosen.any() else ():
            for n, (inside, key) in enumerate(samples(h, at, first[row + 1], walk, gaps)):
                part = chosen[row[inside]]
                found[walk, gaps, n] = [key[part], inside[part]]
    for k in range(1, LEAST):
        own = first[:-1][size == k]
        if len(own):
            found[k,] = [W.shingles(h, k)[own], own]
    index = {}
    for name, (key, where) in found.items():
        order = np.argsort(key, kind="stable")
        key, where = key[order], where[order]
        index[name] = key, row[where], at[where] - first[row[where]], _filled(key)
    return Items(np.array(ids, np.int64), h, first[:-1], size, np.floor(EDIT_RATE * size + 1e-9).astype(np.int64), _filled(h), index)


def windows(items: Items, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, start from the row's first token, item) of the windows that share a key with an item."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = [np.zeros((3, 0), np.int64)]

    def look(name: tuple, at: np.ndarray, s: np.ndarray) -> None:
        key, item, place, seen = items.index[name]
        hit = np.flatnonzero(seen[(s & np.uint64(_FILTER - 1)).astype(np.int64)])
        at, s = at[hit], s[hit]
        lo, hi = np.searchsorted(key, s, side="left"), np.searchsorted(key, s, side="right")
        n = hi - lo
        hit, at = W.ragged(lo, n), np.repeat(at, n)
        out.append(np.stack([row[at], at - first[row[at]] - place[hit], item[hit]]))

    if len(h):
        for k in range(1, LEAST):
            if (k,) in items.index:
                s = W.shingles(h, k)
                at = np.flatnonzero(W.inside(row, k))
                look((k,), at, s[at])
        # only tokens that some item has can be an item's first sample
        known = np.flatnonzero(items.known[(h & np.uint64(_FILTER - 1)).astype(np.int64)])
        ends = first[row[known] + 1]
        for gaps in (GAPS, SHORT_GAPS):
            for walk in range(WALKS) if (0, gaps, 0) in items.index else ():
                for n, (at, s) in enumerate(samples(h, known, ends, walk, gaps)):
                    look((walk, gaps, n), at, s)
    found = np.unique(np.concatenate(out, axis=1), axis=1)
    return found[0], found[1], found[2]


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any run of text, and where that run ends."""
    m = len(item)
    if not m:
        return 0, 0
    where: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text.tolist()):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def search(items: Items, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, start, edits) of each row and item that match: the place with the fewest edits."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    own: dict[int, list[int]] = {}
    for r, at, k in zip(*(x.tolist() for x in windows(items, h, first)), strict=True):
        old = best.get((r, k))
        if old and old[1] == 0:
            continue
        size, d, lo = int(items.size[k]), int(items.edits[k]), int(first[r])
        begin = max(0, at - d)
        region = h[lo + begin : min(int(first[r + 1]), lo + at + size + d)]
        if k not in own:
            own[k] = items.tokens[items.first[k] : items.first[k] + size].tolist()
        have = set(region.tolist())
        if sum(x not in have for x in own[k]) > d:
            continue
        e, end = edit_distance(items.tokens[items.first[k] : items.first[k] + size], region)
        if e <= d and (old is None or e < old[1]):
            best[r, k] = begin + max(0, end - size), e
    return [(r, k, s, e) for (r, k), (s, e) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it: id, item, start (token), edits (the fewest).

    Null items, items without a letter or digit and null ids of items aren't searched for; null and
    empty texts match nothing; a null document id is kept as null. Documents that share an id give one row
    an item, with the fewest edits, as do items that share an id. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    out, last = None, None
    while True:
        # the next block of items, in the order of ids; the benchmark is the stated query set
        rest = known if last is None else known.where((F.col("item") > last[0]) | ((F.col("item") == last[0]) & (F.col("text") > last[1])))
        rows = rest.distinct().orderBy("item", "text").limit(ITEMS_AT_ONCE).collect()
        if not rows:
            break
        last = rows[-1]
        items = spark.sparkContext.broadcast(items_of([r.item for r in rows], [r.text for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, off, data in W.blocks(batch.column(1)):
                    found = search(items.value, *tokens(off, data))
                    if found:
                        r, k, s, e = (np.array(x, np.int64) for x in zip(*found, strict=True))
                        yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(r)), pa.array(items.value.ids[k]), pa.array(s), pa.array(e)], ["id", "item", "start", "edits"])

        part = own.mapInArrow(scan, f"id {kind}, item long, start long, edits long")
        out = part if out is None else out.unionByName(part)
        if len(rows) < ITEMS_AT_ONCE:
            break
    if out is None:
        out = spark.createDataFrame([], f"id {kind}, item long, start long, edits long")
    best = out.groupBy("id", "item").agg(F.min(F.struct("edits", "start")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), F.col("b.start").alias("start"), F.col("b.edits").alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; rows that share an id, or have none, are judged each by itself."""
    own = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    bad = contaminated(own, benchmark, "th", "text").select("th").distinct()
    return docs.join(bad, F.xxhash64(docs[text_col]) == bad["th"], "left_anti")
