"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles.

Weights: a shingle of five words weighs its term frequency times the mean inverse document frequency
of its words. Word frequencies are counted over all documents in a table of IDF_SLOTS hashed slots,
so what is broadcast has a fixed size. The idf is scaled to 1..2, so frequent boilerplate counts less
while groups of thousands of copies still compare as copies.

Steps: (1) equal word sequences fold into one node; (2) each node gets SAMPLES consistent weighted samples
and, from eight of them each, BANDS bucket keys: at a similarity of 0.8 a pair shares a bucket in about
99 of 100 cases, at 0.3 (documents that share a passage) in 3 of 1000; (3) in each bucket every node
is verified against one leader by exact weighted Jaccard: first the member that shares the most buckets
with others, then, for members in other classes, one drawn by a hash; (4) links become classes;
(5) where a bucket still holds several classes, all pairs between them that may be similar enough are
verified, block against block, so no link between candidates is lost. What may be is bounded by total weights and by overlaps
with the leader: two members share at most what one shares with it and what the other has besides it. So
a large group of copies, even of copies that differ from each other, costs a few comparisons a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksift.llm import words as W
from tracksift.llm.components import nearer, stars
from tracksift.session import cut, drop_paths, ship

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES, ROWS, ROUNDS = 64, 8, 5
#: Each round parts all samples into bands of ROWS by another permutation, so bands share samples.
BANDS = ROUNDS * SAMPLES // ROWS
#: Rounds in which a bucket's members are compared with one leader.
LEADERS = 2
#: Members of a block of the last step.
BLOCK = 512
IDF_SLOTS = 1 << 17
#: Bits of the table by which most texts that need no vector are passed over before the exchange; a hit decides nothing.
SLOTS = 1 << 24
_TABLE = 1 << 16


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with a word in each hashed slot, and documents in all; the table has IDF_SLOTS entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(IDF_SLOTS, np.int64), 0
        for batch in batches:
            for lo, hi, off, data in W.blocks(batch.column(0)):
                w = W.words(off, data, lower=True)
                key = (w.row.astype(np.int64) << 17) | (w.hash & np.uint64(IDF_SLOTS - 1)).astype(np.int64)
                key = np.unique(key)
                seen += np.bincount(key & (IDF_SLOTS - 1), minlength=IDF_SLOTS)
                n += hi - lo
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["slot", "n"])

    table = docs.select(text).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(IDF_SLOTS, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return df, int(n[slot < 0].sum())


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """1 for a word of every document, 2 for a word of none."""
    return (1 + np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(2 + n)).astype(np.float32)


def vectors(off: np.ndarray, data: np.ndarray, idf: np.ndarray) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for every row its distinct shingles: row, hash, weight. Under five words, the words together are the one shingle."""
    w = W.words(off, data, lower=True)
    n = np.diff(w.first)
    own = idf[(w.hash & np.uint64(IDF_SLOTS - 1)).astype(np.int64)]
    h, ok = W.shingles(w.hash, SHINGLE), W.inside(w.row, SHINGLE)
    total = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
    mean = (total[SHINGLE:] - total[:-SHINGLE]) / SHINGLE if len(own) >= SHINGLE else np.zeros(0)
    row, h, mean = w.row[: len(h)][ok], h[ok], mean[ok]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        a, _ = W.fold(w.hash, w.first)
        at = (total[w.first[short + 1]] - total[w.first[short]]) / n[short]
        row, h, mean = np.concatenate([row, short]), np.concatenate([h, a[short]]), np.concatenate([mean, at])
    order = np.lexsort((h, row))
    row, h, mean = row[order], h[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return w, row[at], h[at], (tf * mean[at]).astype(np.float32)


_samples: tuple[np.ndarray, ...] | None = None


def _tables() -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) draws r and ln c, and uniform b, from fixed seeds: alike on every worker."""
    global _samples
    if _samples is None:
        u = W.mix(np.arange(5 * _TABLE, dtype=np.uint64)).astype(np.float64).reshape(5, _TABLE) / 2.0**64 + 1e-18
        _samples = (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32), u[4].astype(np.float32)
    return _samples


def sketch(row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have shingles, their BANDS bucket keys, and a byte of each sample: the shingle and level that win (Ioffe's ICWS)."""
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64), np.zeros((0, SAMPLES), np.uint8)
    size = np.diff(np.append(at, len(row)))
    gamma, ln_c, beta = _tables()
    ln_s, mask = np.log(weight), np.uint64(_TABLE - 1)
    won = np.zeros((SAMPLES, len(at)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            salt = np.uint64((2 * k + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
            x = (h ^ (h >> np.uint64(31))) * salt
            x ^= x >> np.uint64(32)
            r, b = gamma[x & mask], beta[(x >> np.uint64(16)) & mask]
            t = np.floor(ln_s / r + b)
            a = ln_c[(x >> np.uint64(32)) & mask] - r * (t - b) - r
            low = np.minimum.reduceat(a, at)
            hit = np.flatnonzero(a == np.repeat(low, size))
            hit = hit[np.append(True, row[hit[1:]] != row[hit[:-1]])]
            won[k] = W.mix(h[hit] ^ t[hit].astype(np.int64).view(np.uint64) * W._BASE)
        keys = np.zeros((len(at), BANDS), np.uint64)
        for band in range(BANDS):
            turn, block = divmod(band, SAMPLES // ROWS)
            order = np.random.default_rng(turn).permutation(SAMPLES)[block * ROWS : (block + 1) * ROWS]
            key = np.full(len(at), np.uint64(band + 1))
            for k in order:
                key = W.mix(key ^ won[k])
            keys[:, band] = key
    return row[at], keys, np.ascontiguousarray(won.T.astype(np.uint8))


def _ids(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two sorted sparse vectors."""
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    hit = ha[at] == hb
    low = float(np.minimum(wa[at[hit]], wb[hit]).sum(dtype=np.float64))
    high = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - low
    return low / high if high > 0 else 0.0


def _most_similar(agree: int) -> float:
    """The similarity at which so few samples agree once in a million."""
    lo, hi = agree / SAMPLES, 1.0
    for _ in range(40):
        p = (lo + hi) / 2
        tail = sum(math.comb(SAMPLES, i) * p**i * (1 - p) ** (SAMPLES - i) for i in range(agree + 1))
        lo, hi = (p, hi) if tail > 1e-6 else (lo, p)
    return hi


def _tested(pairs: DataFrame, vec: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with bounds (least, most) of their weighted Jaccard similarity.

    Where the samples allow the threshold, but for one pair in a million, both bounds are the similarity;
    else least is 0 and most what the samples allow.
    """
    table = np.array([_most_similar(k) for k in range(SAMPLES + 1)])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SAMPLES) for i in (2, 3))
            most = table[(x == y).sum(axis=1)]
            least, va, vb = np.zeros(len(most)), batch.column(4), batch.column(5)
            for i in np.flatnonzero(most >= threshold).tolist():
                least[i] = most[i] = similarity(*_vector(va[i].as_buffer()), *_vector(vb[i].as_buffer()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(least), pa.array(most)], ["a", "b", "least", "most"])

    left, right = (vec.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"), F.col("v").alias(f"v{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "va", "vb")
    return both.mapInArrow(test, "a long, b long, least double, most double")


def _slots(ids: DataFrame) -> np.ndarray:
    """Which of SLOTS hashed slots (see _slot) hold one of the ids of a one-column frame: bytes of bits, of a fixed size."""
    slot = _slot(F.col(ids.columns[0]))
    table = ids.select((slot / 8).cast("int").alias("at"), F.pow(F.lit(2), slot % 8).cast("int").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 8, np.uint8)
    out[table["at"].to_numpy()] = table["bits"].to_numpy()
    return out


def _slot(c: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


_SIDE = ("key", "node", "class", "major", "weight", "lo", "hi", "keys", "v")


def _block_links(threshold: float):
    """Of one bucket's two blocks of members, the links between classes that aren't met in another bucket first."""

    def run(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        xs, ys = [r for r in rows if r["is_x"]], [r for r in rows if not r["is_x"]]
        out: list[tuple[int, int]] = []
        if xs and ys:
            part = {k: np.array([r[k] for r in ys]) for k in ("node", "class", "weight", "lo", "hi")}
            vectors_ = [_vector(r["v"]) for r in ys]
            keys = [set(r["keys"]) for r in ys]
            for x in xs:
                once = (part["class"] == x["major"]) | (part["node"] > x["node"])
                both = x["weight"] + part["weight"]
                # overlap of two: no more than what one shares with the leader and what the other has besides it
                top = np.minimum.reduce([x["hi"] + part["weight"] - part["lo"], part["hi"] + x["weight"] - x["lo"], part["weight"], np.full(len(ys), x["weight"])])
                at = np.flatnonzero((part["class"] != x["class"]) & once & (top >= (threshold - 0.003) * (both - top)))
                if not len(at):
                    continue
                own, mine = _vector(x["v"]), set(x["keys"])
                for i in at:
                    if min(mine & keys[i]) == x["key"] and similarity(*own, *vectors_[i]) >= threshold:
                        out.append((min(x["node"], int(part["node"][i])), max(x["node"], int(part["node"][i]))))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _vector(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.uint8)
    n = len(x) // 6
    return x[: 4 * n].view(np.uint32), x[4 * n :].view(np.float16).astype(np.float32)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: its id (a long), class_id (the least id of its class) and class_size (rows).

    Words are compared with ASCII letters folded. Equal word sequences are of one class; rows without
    words (null, empty, white space) each stay alone. Different texts under one id get the class of either; a null
    id has a null class and size 1. An empty table gives no rows; other columns are not read.
    """
    out = _classes(docs, id_col, text_col, threshold)
    count = out.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1")
    out = out.join(count, "class_id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """id, th (the text's hash), class_id and has_words of each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    df, n = document_frequency(docs, "text")
    idf = spark.sparkContext.broadcast(idf_of(df, n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in W.blocks(batch.column(1)):
                w, row, h, weight = vectors(off, data, idf.value)
                a, b = W.fold(w.hash, w.first)
                at, keys, sig = sketch(row, h, weight)
                total = np.bincount(row, weight, minlength=hi - lo).astype(np.float64)  # numpy gives integers for no rows
                lists = np.zeros(hi - lo, np.int64)
                lists[at] = BANDS
                offsets = np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), W.longs(keys.reshape(-1)))
                sigs = np.concatenate([[0], np.cumsum(lists // BANDS * SAMPLES)]).astype(np.int32)
                sig = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(sigs), pa.py_buffer(sig)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), W.longs(a), W.longs(b), bands, sig, pa.array(total)], ["id", "th", "h1", "h2", "bands", "sig", "weight"])

    scanned = cut(docs.withColumn("th", F.xxhash64("text")).mapInArrow(scan, "id long, th long, h1 long, h2 long, bands array<long>, sig binary, weight double"), "near-scan")
    rows = scanned.select("id", "th", "h1", "h2")
    # equal word sequences; a hot group is folded map-side
    known = scanned.where("id is not null")
    nodes = known.where("size(bands) > 0").groupBy("h1", "h2").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("bands", "sig", "weight")])
    nodes = cut(nodes, "near-nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(banded.join(sizes, "key").select("key", "node", "n"), "near-member")
    popular = member.groupBy("node").agg(F.sum("n").alias("pop"))
    # the nodes that share a bucket; of an id with several texts, one of them
    own = nodes.groupBy("node").agg(F.min(F.struct("h1", "h2", "sig", "weight")).alias("own"))
    core = cut(own.join(popular, "node").select("node", "pop", "own.*"), "near-core")
    member2 = cut(member.join(core.select("node", "pop", "weight"), "node").select("key", "node", "pop", "weight"), "near-popular")
    drop_paths(member)

    def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((held_slots.value[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            for lo, hi, off, data in W.blocks(batch.column(1)):
                w, row, h, weight = vectors(off, data, idf.value)
                a, b = W.fold(w.hash, w.first)
                # 32 bits tell the shingles of two documents apart; sorted by them
                h = (h >> np.uint64(32)).astype(np.uint32)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                weight = np.minimum(weight, 60000).astype(np.float16)
                out = [h[i:j].tobytes() + weight[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), W.longs(a), W.longs(b), pa.array(out, pa.binary())], ["node", "h1", "h2", "v"])

    # vectors of the nodes that share a bucket, once
    held_slots = spark.sparkContext.broadcast(_slots(core.select("node")))
    made = docs.select("id", "text", _slot(F.col("id")).alias("slot")).mapInArrow(blob, "node long, h1 long, h2 long, v binary")
    vec = made.join(core.select("node", "h1", "h2", "sig"), ["node", "h1", "h2"]).dropDuplicates(["node", "h1", "h2"])
    vec = cut(vec.select("node", "sig", "v"), "near-vectors")

    def mixed(label: DataFrame) -> DataFrame:
        """Members of the buckets that hold several classes yet."""
        held = member2.join(label.select(F.col("b").alias("node"), F.col("a").alias("label")), "node", "left")
        held = held.select("key", "node", "pop", "weight", F.coalesce("label", "node").alias("class"))
        several = held.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
        return held.join(several, "key")

    pair = F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
    # label: (a, b), the class a of every other node b of a link; links: edges with the same components
    label = links = done = bounds = first = None
    for turn in range(LEADERS):
        held = member2.withColumn("class", F.col("node")) if turn == 0 else cut(mixed(label), "near-held")
        # at first the member that shares the most buckets with others, then one by chance in each bucket
        rank = -F.col("pop") if turn == 0 else F.xxhash64(F.lit(turn), "key", "node")
        lead = held.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "class", "weight")).alias("top"))
        lead = lead.select("key", F.col("top.node").alias("leader"), F.col("top.class").alias("own"), F.col("top.weight").alias("lw"))
        if turn == 0:
            lead = first = cut(lead, "near-first")
        pairs = held.join(lead, "key").where("class <> own").select(*pair).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        near = cut(_tested(pairs, vec, threshold), "near-tested")
        if near.isEmpty():
            label = None if links is None else stars(links)
            break
        if turn == 0:
            bounds = near
        else:
            drop_paths(held)
        done = near.select("a", "b") if done is None else done.unionByName(near.select("a", "b"))
        found = near.where(F.col("least") >= threshold).select("a", "b")
        links = found if links is None else links.unionByName(found)
        if turn + 1 < LEADERS:
            # not whole classes yet: parts of them do, to find what the next leader is compared with
            links = nearer(links)
            label = links.groupBy("b").agg(F.min("a").alias("a"))
        else:
            links = label = stars(links)
    # buckets that still hold several classes: every pair between classes that may reach the threshold
    if label is not None:
        held = mixed(label)
        major = held.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("class", F.struct("n", (-F.col("class")).alias("c"))).alias("major"), F.sum("n").alias("members"))
        held = held.join(major, "key").join(first.select("key", "leader", "lw"), "key")
        # each node's weight and its overlap with the bucket's first leader, from bounds on their similarity
        held = held.withColumns({"a": F.least("node", "leader"), "b": F.greatest("node", "leader")}).join(bounds, ["a", "b"], "left")
        shared = lambda c, other: F.when(F.col("node") == F.col("leader"), F.col("weight")).otherwise(F.coalesce(F.col(c) * (F.col("weight") + F.col("lw")) / (1 + F.col(c)), other))
        # the members outside a bucket's largest class against all, in blocks: a task gets two blocks and their
        # vectors, not pairs, and gives back links; a hot bucket is many tasks
        bins = F.ceil(F.col("members") / BLOCK).cast("long")
        held = held.select("key", "node", "class", "major", "weight", shared("least", F.lit(0.0)).alias("lo"), shared("most", F.least("weight", "lw")).alias("hi"), (F.col("class") != F.col("major")).alias("minor"), bins.alias("bins"), F.pmod(F.xxhash64("node"), bins).alias("bin"))
        held = cut(held, "near-rest")
        if not held.isEmpty():
            # blocks without a minor member on the left have nothing to compare
            live = held.where("minor").groupBy("key").agg(F.collect_set("bin").alias("live"))
            keys = held.groupBy("node").agg(F.collect_set("key").alias("keys"))
            sides = held.join(live, "key").join(keys, "node").join(vec.select("node", "v"), "node")
            x = sides.where("minor").select(*_SIDE, F.col("bin").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("j"), F.lit(True).alias("is_x"))
            y = sides.select(*_SIDE, F.explode("live").alias("i"), F.col("bin").alias("j"), F.lit(False).alias("is_x"))
            more = cut(x.unionByName(y).groupBy("key", "i", "j").applyInArrow(_block_links(threshold), "a long, b long"), "near-links")
            if not more.isEmpty():
                label = stars(label.unionByName(more))
        label = label.select(F.col("b").alias("node"), F.col("a").alias("label"))
    else:
        label = nodes.select("node", F.col("node").alias("label")).limit(0)
    named = nodes.select("h1", "h2", "node").join(label, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class_id"))
    return rows.join(named, ["h1", "h2"], "left").select("id", "th", F.coalesce("class_id", "id").alias("class_id"), ((F.col("h1") != 0) | (F.col("h2") != 0)).alias("has_words"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class: that with the least id; rows with null ids stay.

    Rows equal in id and text are one; the one with the least hash of its other columns stays. Different texts under
    one id all stay.
    """
    rows = _classes(docs, id_col, text_col, threshold).where("id is not null")
    # texts without words are of no class, and neither are the texts of an id that has several: classes are named by ids
    several = rows.groupBy("id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select(F.col("id").alias("several"))
    rows = rows.join(several, rows["id"] == several["several"], "left")
    first = rows.groupBy("class_id", F.when(~F.col("has_words") | F.col("several").isNotNull(), F.col("th"))).agg(F.min(F.struct("id", "th")).alias("f"))
    kept = first.select(F.col("f.id").alias("id"), F.col("f.th").alias("th"))
    mine = (docs[id_col].cast("long") == kept["id"]) & (F.xxhash64(docs[text_col]) == kept["th"])
    # one exchange of the texts: the rest works on the partitioning of the join
    own = docs.join(kept, mine, "left_semi")
    key = [F.col(id_col).cast("long"), F.xxhash64(text_col)]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns)))
    struct = own.select(F.struct(*docs.columns).alias("row"), turn.alias("turn")).where("turn = 1").select("row.*")
    return struct.unionByName(docs.where(docs[id_col].isNull()))
