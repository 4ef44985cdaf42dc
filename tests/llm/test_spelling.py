"""Spelling variants against brute force, blocks that are split down to letters, and odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tests.llm.conftest import SF
from tracksift.llm import spelling
from tracksift.llm.queries import OP12_SQL, op12_spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def words_of(docs):
    low = str.maketrans(spelling._UPPER, spelling._LOWER)
    n = Counter()
    for d, t in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(docs):
    n = words_of(docs)
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def random_docs(rng, n_docs, per_doc, stems):
    letters = "abcdeéÿ"
    docs = []
    for d in range(n_docs):
        out = []
        for _ in range(per_doc):
            w = rng.choice(stems)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w = w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind < 2) :]
            out.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((d, rng.choice((" ", ", ", "-", "1", "Ā")).join(out)))
    return docs


def result(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_index_equals_brute_force():
    rng = random.Random(1)
    for trial in range(8):
        k = (3, 70, 200)[trial % 3]
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6 + trial))) for _ in range(k)})
        index = spelling.PositionIndex(words)
        got = set(zip(*(x.tolist() for x in index.near()), strict=True))
        assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if is_near(a, b)}


@pytest.mark.parametrize("most", [spelling.BLOCK, 8])
def test_equals_brute_force(spark, monkeypatch, most):
    """Also with blocks of eight words, which are split again and again."""
    monkeypatch.setattr(spelling, "BLOCK", most)
    monkeypatch.setattr(spelling.blocks, "__defaults__", (most,))
    rng = random.Random(2)
    stems = ["abcdeabc", "bbcdeabc", "aaaaaaa", "aaaaaaaaaaaa", "edcbaedcba", "ééééééé"]
    docs = random_docs(rng, 60, 60, stems) + [(100 + i, "abcdeabc " * 400) for i in range(3)]
    want = sorted(brute(docs), key=lambda r: r[0])
    assert result(spark, docs) == want
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)  # forms, and forms of forms


def test_blocks_are_bounded(spark):
    """Words that share their beginning and differ in the rest: every block ends within the bound, and every near pair meets."""
    words = [f"prefix{a}{b}{c}suffix" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.blocks(df, most=16).collect()
    sizes, keys = Counter(r.key for r in rows), {}
    for r in rows:
        keys.setdefault(r.word, set()).add(r.key)
    assert max(sizes.values()) <= 64  # a pair of letters open at most
    assert all(keys[a] & keys[b] for a in words for b in words if is_near(a, b))


def test_sql_equals_brute_force():
    docs = random_docs(random.Random(3), 30, 40, ["abcdeabc", "eeeeeee", "abcabcabc"])
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert set(c.execute(OP12_SQL).fetchall()) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = spelling.variants(odd_docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == brute(docs)
    assert spelling.variants(no_docs).count() == 0
    # a very long word, ties of forms, and columns named like the operator's own
    rows = [(1, ("x" * 50_000 + " ") * 3, "a", 1), (2, "aabbccdd aabbccdd " + "aabbccde " * 20 + "aabbccdc " * 20, "b", 2), (None, "x" * 50_001 + " " + "x" * 50_001, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert set(map(tuple, (r[:] for r in got.values()))) == {(w, f, r, n, k, fn) for w, f, r, n, k, fn in brute([(d, t) for d, t, _, _ in rows])}


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(c.execute(OP12_SQL).fetchall())
    got = sorted(map(tuple, op12_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == want and got
