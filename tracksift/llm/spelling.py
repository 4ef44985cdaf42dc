"""Spelling variant grouping: words of a corpus that are one letter apart, by a bit-sliced position index.

Words are counted by Spark. Two words with one error between them agree before it and after it, so each word goes to
blocks keyed by what it has outside an interval that may hold the error: first the two halves, and where a block has more
than BLOCK words, the halves of its interval, down to single letters, where a block is bounded by the
alphabet (a pair of letters in the longer word). Nothing is dropped: every pair meets in a block of any level.

In a task, whole blocks are packed side by side into an index of about BLOCK words: for every (position, letter) a bitset
of the words that have it there. All words of the index are also its queries. For each query, going through its letters,
one bitset holds the words that agree so far (zero errors) and three hold those with one error so far: replaced, missing
from the word (the index is read one position back), or added in the word (one position on). A step is a few
word-wide ANDs and ORs for 64 words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksift.session import cut, ship

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_TIMES = 10
DAMAGE = 31
BLOCK = 1024
#: Letters of the words packed into one index, padding counted.
CELLS = 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = r"[A-Za-zÀ-ÿ]+"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z only, of `least` letters or more and `least_count` occurrences or more.

    One run in DAMAGE, chosen by the CRC of id and run, loses a letter first. A null id is written as nothing.
    """
    runs = F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(_RUN), F.lit(0))
    # shorter runs can't become words
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda w: F.length(w) >= least)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = own.select(F.when(h % DAMAGE == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key(lo: Column, hi: Column) -> Column:
    """What a word has outside letters lo..hi (from 0) of a pair whose shorter word has m letters."""
    after = F.col("m") - hi
    return F.concat_ws("\x00", F.col("m"), lo, F.substring("word", F.lit(1), lo), F.substring("word", F.length("word") - after + 1, after))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows word, n, m, key: words (word, n) with one error between them share a key; a key has at most `most` words, or as many as one open letter allows."""
    letters = F.length("word")
    m = F.explode(F.array(letters, letters - 1)).alias("m")  # the word is the shorter of a pair, or the longer by one
    rows = words.select("word", "n", m).withColumn("lo", F.lit(0)).withColumn("hi", F.col("m"))
    done = None
    while True:
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi").alias("hi")))
        rows = rows.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.lo", "p.hi").withColumn("key", _key(F.col("lo"), F.col("hi")))
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        # few keys are too large: a block has over `most` rows
        large = cut(sizes.where((F.col("size") > most) & (F.col("open") > 1)).select("key"), "spelling-large")
        if large.isEmpty():
            kept = rows.select("word", "n", "m", "key")
            return kept if done is None else done.unionByName(kept)
        rows = cut(rows, "spelling-blocks")
        kept = rows.join(large, "key", "left_anti").select("word", "n", "m", "key")
        done = kept if done is None else done.unionByName(kept)
        rows = rows.join(large, "key", "left_semi").drop("key")


class PositionIndex:
    """Bitsets of words by (position, letter), 64 words to a machine word."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        at = np.repeat(np.arange(len(words)), self.length)
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.first = np.cumsum(self.length) - self.length
        place = np.arange(len(at)) - self.first[at]
        keys = place << 32 | self.letters
        self.keys, slot = np.unique(keys, return_inverse=True)
        self.width = -(-len(words) // 64)
        #: The last row is empty: letters that no word has at a position.
        self.bits = np.zeros((len(self.keys) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.bits, (slot, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.all = np.zeros(self.width * 64, bool)
        self.all[: len(words)] = True

    def packed(self, which: np.ndarray) -> np.ndarray:
        full = np.zeros(self.width * 64, bool)
        full[: len(which)] = which
        return np.packbits(full, bitorder="little").view(np.uint64)

    def has(self, place: int, letter: np.ndarray) -> np.ndarray:
        """A bitset for each letter: the words with it at this position."""
        if place < 0:
            return self.bits[-1]
        key = place << 32 | letter
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.bits[np.where(self.keys[slot] == key, slot, len(self.keys))]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All ordered pairs of words with exactly one letter replaced, missing or added between them."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(self.length):
            who = np.flatnonzero(self.length == n)
            agree = np.broadcast_to(self.packed(self.all), (len(who), self.width)).copy()
            replaced, missing = np.zeros_like(agree), np.zeros_like(agree)
            added = agree.copy()  # a letter before the first
            for i in range(n):
                letter = self.letters[self.first[who] + i]
                here = self.has(i, letter)
                replaced = (replaced & here) | (agree & ~here)
                missing = (missing & self.has(i - 1, letter)) | agree
                agree &= here
                added = (added & self.has(i + 1, letter)) | agree
            lengths = [self.packed(self.length == x) for x in (n, n - 1, n + 1)]
            hit = (replaced & lengths[0]) | (missing & lengths[1]) | (added & lengths[2])
            q, bit = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
            found.append((who[q], bit))
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows word, n, key, sorted by key: near pairs within each index of whole blocks."""
    words: list[str] = []
    counts: list[int] = []
    widest = 0

    def flush() -> pa.RecordBatch:
        uniq, at = np.unique(np.array(words, object), return_index=True)
        index = PositionIndex(list(uniq))
        q, w = index.near()
        text, n = pa.array(list(uniq), pa.string()), np.array(counts, np.int64)[at]
        return pa.record_batch({"word": text.take(pa.array(q)), "near": text.take(pa.array(w)), "near_n": pa.array(n[w])})

    block: list[tuple[str, int]] = []
    last = None
    for b in batches:
        for word, n, key in zip(*(b.column(c).to_pylist() for c in ("word", "n", "key")), strict=True):
            if key != last and block:
                width = max(widest, max(len(x) for x, _ in block))
                if words and (len(words) + len(block) > BLOCK or (len(words) + len(block)) * width > CELLS):
                    yield flush()
                    words, counts, widest = [], [], 0
                words += [x for x, _ in block]
                counts += [x for _, x in block]
                widest = max(widest, max(len(x) for x, _ in block))
                block = []
            last = key
            block.append((word, n))
    words += [x for x, _ in block]
    counts += [x for _, x in block]
    if words:
        yield flush()


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: each ordered pair of words (word, n) one error apart, once."""
    ship(words.sparkSession)
    keyed = blocks(words).repartition("key").sortWithinPartitions("m", "key").select("word", "n", "key")
    return keyed.mapInArrow(_search, "word string, near string, near_n long").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: each counted word, its near word of largest count if that is FORM_TIMES its own, and the last word that forms lead to.

    Ties go to the smallest word in code-point order. Words are counted over whole texts, see counted(); null, empty and
    letterless texts have none, rows that share an id or a text count each, other columns don't matter. An empty table gives no rows.
    """
    words = cut(counted(docs, id_col, text_col), "spelling-words")
    # min of (-n, word): the largest count, then the smallest word; strings compare by UTF-8 bytes, which is code-point order
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left")
    form = (-F.col("best.n") >= FORM_TIMES * F.col("n")) & F.col("best").isNotNull()
    rows = cut(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n")),
        "spelling-forms",
    )
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # counts grow FORM_TIMES a step, so a chain has at most 18 steps: links double until none goes on
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(on, "root", "left_semi").isEmpty():
            break
        links = cut(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
