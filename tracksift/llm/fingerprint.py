"""Document fingerprints by order min-hash. DataFrame functions only.

A k-mer is a run of K words, one ending at each word; before the text's start words are missing, so a text of n
words has n k-mers. k-mers get their occurrence number within the text, so that repeats count, and a 33-bit hash of
both. Each of SAMPLES samples orders the hashes anew, takes the PICKS least and hashes them in the order in
which they stand in the text: two fingerprints agree in a sample if the same k-mers were drawn and stand in the same
order, which a move of a passage breaks though the set of k-mers stays.

The orders are rotations: sample s ranks a hash x by its distance from a fixed random point, upwards and around.
Hashes are random themselves, so each k-mer of two texts is equally likely to come first, as with hash functions drawn
for each sample; but a text is sorted once and a sample is one binary search.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SAMPLES = 64
PICKS = 2
POINT_SEED = 13
ROWS_A_BUCKET = 1000
MOST_BUCKETS = 20_000

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACES = r"[\x20\x09-\x0D]+"
_PLACE = (1 << 31) - 1  # the low bits of a packed k-mer hold its place in the text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def below(ascending: Column, value: Column, equal: bool = False) -> Column:
    """How many entries of an ascending array are less than value (or equal): a binary search by falling powers of two."""
    n = F.size(ascending)
    exponents = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
    powers = F.transform(exponents, lambda k: F.call_function("shiftleft", F.lit(1), k))
    holds = (lambda x: x <= value) if equal else (lambda x: x < value)
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= n) & holds(F.get(ascending, at + p - 1)), at + p).otherwise(at))


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def kmers(text: Column, k: int = K) -> Column:
    """A text's occurrence-numbered k-mers, ascending: 33 bits of hash, then 31 bits of place."""
    inked = F.btrim(text, F.lit(_SPACE))
    gram = lambda w, i: _packed(F.xxhash64(*[F.get(w, i - j) for j in range(k)]), i)
    plain = lambda w: F.sort_array(F.transform(w, lambda _, i: gram(w, i)))

    def numbered(p: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            again = F.shiftright(F.get(p, i - 1), 31) == F.shiftright(v, 31)
            nth = F.when(again, i - below(p, v.bitwiseAND(F.lit(~_PLACE)))).otherwise(F.lit(0))
            return _packed(F.xxhash64(F.shiftright(v, 31), nth), v.bitwiseAND(F.lit(_PLACE)))

        return F.sort_array(F.transform(p, one))

    return F.when(inked == "", F.array().cast("array<long>")).otherwise(_let(_let(F.split(inked, _SPACES), plain), numbered))


def points(samples: int = SAMPLES) -> list[int]:
    """Where each sample's order begins: fixed random numbers."""
    rng = random.Random(POINT_SEED)
    return [rng.randrange(-(1 << 63), 1 << 63) for _ in range(samples)]


def order_minhash(text: Column, samples: int = SAMPLES, picks: int = PICKS, k: int = K) -> Column:
    """The fingerprint of a text as an array of 32-bit integers; null counts as empty, which has its own constant one."""

    def drawn(v: Column, point: Column) -> Column:
        n = F.size(v)

        def taken(first: Column) -> Column:
            own = F.transform(F.sequence(F.lit(0), F.least(F.lit(picks), n) - 1), lambda t: F.get(v, (first + t) % n))
            by_place = F.sort_array(F.transform(own, lambda x: F.shiftleft(x, 33).bitwiseOR(F.shiftrightunsigned(x, 31))))
            return F.xxhash64(F.transform(by_place, lambda x: x.bitwiseAND(F.lit((1 << 33) - 1))))

        return F.when(n > 0, _let(below(v, point), taken)).otherwise(F.lit(0).cast("long"))

    at = F.split(F.lit(",".join(map(str, points(samples)))), ",").cast("array<long>")
    low = lambda h: F.shiftright(h, 32).cast("int")
    return _let(kmers(F.coalesce(text, F.lit("")), k), lambda v: F.transform(at, lambda p: low(drawn(v, p))))


def as_text(print_: Column) -> Column:
    """A fingerprint as lowercase hex, eight digits a sample."""
    return F.array_join(F.transform(print_, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints agree, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def with_next(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows (id, key, cols) with next_<col>: that column of the row after it by id, nulls first, then by key; after the last comes the first.

    Rows are dealt out by ranges of (id, key). A range also gets the first row of the next one, so no task sees
    more than its range, and the driver holds the ranges' bounds only (ROWS_A_BUCKET rows each, MOST_BUCKETS at most).
    """
    at = F.struct("id", "key")
    parts = max(1, min(MOST_BUCKETS, rows.count() // ROWS_A_BUCKET))
    ranged = rows.select("id", "key").repartitionByRange(parts, F.col("id").asc_nulls_first(), "key")
    firsts = ranged.groupBy(F.spark_partition_id().alias("pid")).agg(F.min(at).alias("at"))
    bounds = firsts.agg(F.to_json(F.sort_array(F.collect_list("at"))).alias("all")).first()[0]
    bounds = F.from_json(F.lit(bounds), firsts.select(F.array("at").alias("a")).schema["a"].dataType)
    home = below(bounds, F.col("at"), equal=True) - 1
    opens = F.get(bounds, F.col("home")) == F.col("at")
    before = F.when(F.col("home") == 0, F.size(bounds) - 1).otherwise(F.col("home") - 1)
    seats = F.array(F.struct(F.col("home").alias("range"), F.lit(0).alias("guest")), F.when(opens, F.struct(before.alias("range"), F.lit(1).alias("guest"))))
    dealt = rows.withColumn("at", at).withColumn("home", home).withColumn("seat", F.explode(F.filter(seats, lambda x: x.isNotNull())))
    order = Window.partitionBy("seat.range").orderBy("seat.guest", "at")
    return dealt.select("id", "key", *cols, "seat", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols]).where("seat.guest = 0").drop("seat")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_chars, fingerprint (array of SAMPLES integers), and the same of its edited text and of the next row's text.

    The edited text has the last quarter of its code points (rounded down) replaced by the first as many of the
    next document by ascending id, or all of it where it is shorter; after the last document comes the first. Columns: id_col, n_chars,
    print, edited, edited_print, next_print.

    Null and empty texts count as empty and have the fingerprint of the empty text, as have blank ones. Null ids come
    first. Rows that share an id follow each other by a hash of their texts; equal rows stay apart, each with its row. The id may
    be of any type that JSON carries whole (numbers, strings). Other columns don't matter. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    rows = with_next(rows.withColumn("print", order_minhash(F.col("text"))), ["text", "print"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "print", edited.alias("edited"), F.col("next_print"))
    return rows.select(F.col("id").alias(id_col), "n_chars", "print", "edited", order_minhash(F.col("edited")).alias("edited_print"), "next_print")
