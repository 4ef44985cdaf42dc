"""Order min-hash against a plain Python version, next rows against a sort, and edits that it must feel."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import DOC_SCHEMA, SF, prose
from tracksift.llm import fingerprint as fp
from tracksift.llm.queries import op13_fingerprints


def _hashes(spark, rows):
    """xxhash64 of rows of values, by Spark; None stands for a missing word."""
    width = max(map(len, rows), default=1)
    df = spark.createDataFrame([(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{j} {'string' if rows and isinstance(rows[0][0], str) else 'long'}" for j in range(width)))
    out = df.select("i", F.xxhash64(*[f"c{j}" for j in range(width)]).alias("h")).collect()
    return [r.h for r in sorted(out)]


def brute(spark, text, k=fp.K, picks=fp.PICKS):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return [0] * fp.SAMPLES
    grams = [tuple(reversed(words[max(0, i - k + 1) : i + 1])) for i in range(len(words))]
    base = [h >> 31 for h in _hashes(spark, grams)]
    seen, numbered = {}, []
    for h in base:
        numbered.append((h, seen.get(h, 0)))
        seen[h] = seen.get(h, 0) + 1
    df = spark.createDataFrame([(i, h, n) for i, (h, n) in enumerate(numbered)], "i int, h long, n int")
    x = [r.h >> 31 for r in sorted(df.select("i", F.xxhash64("h", "n").alias("h")).collect())]
    drawn = []
    for p in fp.points():
        ranked = sorted(range(len(x)), key=lambda i: ((((x[i] << 31) | i) - p) % (1 << 64)))
        drawn.append([x[i] & ((1 << 33) - 1) for i in sorted(ranked[:picks])])
    df = spark.createDataFrame([(i, d) for i, d in enumerate(drawn)], "i int, d array<long>")
    return [r.h >> 32 for r in sorted(df.select("i", F.xxhash64("d").alias("h")).collect())]


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.p for r in sorted(df.select("i", fp.order_minhash(F.col("text")).alias("p")).collect())]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60, 30), "a b a b a b a b a b a b", "one", " \n one\ttwo ", "é ü ñ é ü ñ x", None, "", " \x0b ", prose(rng, 300)]
    assert prints(spark, texts) == [brute(spark, t) for t in texts]


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def test_order_counts(spark):
    """A swap of two halves keeps nearly all 5-mers, and so a set sketch; the order of picks changes in about half the samples."""
    rng = random.Random(4)
    w = prose(rng, 400, 10_000).split()
    same, swapped, part, other, repeated = prints(spark, [" ".join(w), " ".join(w[200:] + w[:200]), " ".join(w[:390] + ["x"] * 10), prose(rng, 400, 10_000), " ".join(w + w[:40])])
    assert alike(same, same) == 1
    assert 0.3 < alike(same, swapped) < 0.7
    assert alike(same, part) > 0.8
    assert alike(same, other) == 0
    assert 0.6 < alike(same, repeated) < 1  # repeats count by their number


def edited(text, following):
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def test_next_and_edit_against_a_sort(spark, monkeypatch):
    """Ranges of few rows: each row's next by id, and the first after the last, across range bounds."""
    monkeypatch.setattr(fp, "ROWS_A_BUCKET", 3)
    rng = random.Random(6)
    docs = [(i * 7 - 50, prose(rng, rng.randrange(1, 30)) + "é" * (i % 5)) for i in range(40)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    docs.sort()
    assert len(got) == 40
    p = dict(zip([d for d, _ in docs], prints(spark, [t for _, t in docs]), strict=True))
    e = prints(spark, [edited(t, docs[(i + 1) % 40][1]) for i, (_, t) in enumerate(docs)])
    for i, (d, t) in enumerate(docs):
        r, (nid, nt) = got[d], docs[(i + 1) % 40]
        assert (r.n_chars, r.edited, r.print, r.next_print, r.edited_print) == (len(t), edited(t, nt), p[d], p[nid], e[i])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = fp.fingerprints(odd_docs).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].print == by[2][0].print == by[2][1].print  # equal texts
    assert by[3][0].print == by[4][0].print == by[5][0].print == [0] * fp.SAMPLES
    assert by[3][0].n_chars == 0 and by[3][0].edited == ""
    assert len(by[None]) == 1
    assert fp.fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcdefgh", "print", 1)], "doc_id long, text string, edited string, id int")
    assert fp.fingerprints(one).first().edited == "abcdefab"
    named = spark.createDataFrame([("b", "x y"), ("a", "z" * 8)], "name string, text string")
    assert {r.name: r.edited for r in fp.fingerprints(named, "name").collect()} == {"a": "zzzzzzx ", "b": "x y"}


def test_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r.doc_id: r for r in op13_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, (d, t) in enumerate(docs):
        e = edited(t, docs[(i + 1) % len(docs)][1])
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
    long = [r for r in rows.values() if r.n_chars >= 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.3
    assert sum(r.near_edited > r.near_next for r in long) > 0.99 * len(long)
