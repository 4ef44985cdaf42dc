import random
import re
from collections import defaultdict

import pytest

from tracksift.llm import mixing as M
from tracksift.llm import queries as Q
from tests.llm.conftest import SF, prose


def brute_targets(sizes):
    """Water-filling by rounds: full sources leave, the rest is shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(rows, docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += count(t)
    goal = brute_targets(sizes)
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(d[0]) for d in docs)
    of = {d[0]: d for d in docs}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = of[r.doc_id][2]
        assert r["size"] == count(of[r.doc_id][1]) and r.source_size == sizes[s]
        assert r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in goal:
        assert abs(taken[s] - goal[s]) <= largest[s], s
    return taken, goal


def test_query_meets_targets_and_repeats(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = Q.op5_mixing(spark, SF).collect()
    taken, goal = check(rows, docs)
    assert sum(abs(taken[s] - goal[s]) for s in goal) < 0.02 * sum(goal.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, Q.op5_mixing(spark, SF).collect()))


def test_hot_source_spreads_over_groups(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randrange(1, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(2000)]
    check(M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs)


def test_chances_are_unbiased(spark, monkeypatch):
    docs = [(i, "w " * (1 + i % 5), "a" if i < 40 else "b") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").cache()
    total = defaultdict(float)
    for seed in range(12):
        monkeypatch.setattr(M, "SEED", seed)
        rows = M.mix(df).collect()
        want = {r.doc_id: r.target / r.source_size for r in rows}
        for r in rows:
            total[r.doc_id] += r.copies / 12
    assert sum(total[i] - want[i] for i in want) / 80 == pytest.approx(0, abs=0.02)
    assert max(abs(total[i] - want[i]) for i in want) < 0.6


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert M.mix(no_docs).collect() == []
    out = M.mixture(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert M.mixture(no_docs).collect() == []
    one = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, source string")
    assert [r.copies for r in M.mix(one).collect()][0] in (1, 2)


def test_mixture_is_the_mix(spark):
    rng = random.Random(5)
    docs = [(None if i % 5 == 0 else i // 3, prose(rng, 1 + i % 9), f"s{i % 4}") for i in range(300)] + [(7, "same text", "s1")] * 5
    df = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], "doc_id long, text string, source string, `row` int, copies string")
    want, got = defaultdict(int), defaultdict(int)
    for r in M.mix(df).collect():
        want[r.doc_id, r["size"]] += r.taken
    out = M.mixture(df)
    assert out.columns == df.columns
    for r in out.collect():
        n = len(r.text.split())
        got[r.doc_id, n] += n
    assert got == {k: n for k, n in want.items() if n}
