import random
import re
from collections import Counter

import numpy as np
import pytest

from tracksift.llm import quality as K
from tracksift.llm import queries as Q
from tests.llm.conftest import SF, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def toks(text):
    return [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def brute_log_ppl(texts):
    """The same modified Kneser-Ney model with dictionaries: a bigram counts once for each word before it."""
    seen = {}
    for t in texts:
        x = [None, b"", *toks(t)]
        for u, v, w in zip(x, x[1:], x[2:], strict=False):
            seen.setdefault((v, w), set()).add(u if v else None)
    pairs = Counter({k: len(s) for k, s in seen.items()})
    ctx, cont = Counter(), Counter()
    for (v, w), c in pairs.items():
        ctx[v] += c
        cont[w] += 1

    def discounts(values):
        n = [max(sum(x == k for x in values), 0.5) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]

    d, e = discounts(pairs.values()), discounts(cont.values())
    n = len(pairs)
    own = {w: (c - e[min(c, 3)]) / n for w, c in cont.items() if c >= 2}
    rest = max(1 - sum(own.values()), 1e-6) / (len(own) + 1)
    high = {k: (c - d[min(c, 3)]) / ctx[k[0]] for k, c in pairs.items() if c >= 2}
    held = Counter()
    for (v, _), p in high.items():
        held[v] += p
    out = []
    for t in texts:
        x = [b"", *toks(t)]
        logs = [np.log(high.get((v, w), 0) + (max(1 - held[v], 1e-6) if held[v] else 1) * (own.get(w, 0) + rest)) for v, w in zip(x, x[1:], strict=False)]
        out.append(-np.mean(logs) if logs else None)
    return out


def check(rows, texts):
    ppl = brute_log_ppl([t for _, t in texts])
    want = {i: (*base(t), p) for (i, t), p in zip(texts, ppl, strict=True)}
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w[:6], r.doc_id
        assert (r.log_ppl is None) == (w[6] is None)
        if w[6] is not None:
            # contexts are told apart by CONTEXT_BITS bits
            assert r.log_ppl == pytest.approx(w[6], rel=1e-2)
        assert not (r.base_failed and r.kept)


def test_query_matches_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = Q.op7_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows(spark, odd_docs, no_docs):
    texts = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    rows = K.score(odd_docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert K.score(no_docs).collect() == []
    assert K.keep_good(no_docs).collect() == []
    assert {r.doc_id for r in K.keep_good(odd_docs).collect()} >= {1, 2, 6, 9}


def test_both_bands_reject_and_copies_stay(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    pool = [f"w{i}" for i in range(3000)]
    own = [(i, text(150)) for i in range(400)]
    group = text(150).split()
    copies = [(1000 + i, " ".join(group)) for i in range(200)]
    near = [(2000 + i, " ".join(rng.choice(pool) if rng.random() < 0.05 else w for w in group)) for i in range(4)]
    foreign = [(5000 + i, " ".join(f"zz{rng.random()}".replace(".", "") for _ in range(150))) for i in range(5)]
    said = [(6000, " ".join(rng.choices(["ha", "ho", "hm"], k=150)))]
    symbols = [(7000, "# $ % & " * 30)]
    rows = own + copies + near + foreign + said + symbols
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in K.score(df).collect()}
    high = {i for i, r in got.items() if r.log_ppl is not None and r.log_ppl > r.upper}
    low = {i for i, r in got.items() if r.log_ppl is not None and r.log_ppl < r.lower}
    assert high == {i for i, _ in foreign}
    assert low == {6000}
    assert {i for i, r in got.items() if not r.kept} == high | low | {7000}
    assert not got[6000].base_failed


def test_verdicts_stay_with_their_rows(spark):
    rng = random.Random(3)
    good = [(None, prose(rng, 100, 500)) for _ in range(30)] + [(5, prose(rng, 100, 500))]
    df = spark.createDataFrame([(i, t, "en", t) for i, t in [*good, (None, "bad"), (5, "short"), (None, None)]], "doc_id long, text string, lang string, th string")
    assert sorted(r.text for r in K.keep_good(df).collect()) == sorted(t for _, t in good)


def test_estimate_is_exact_for_small_counts():
    assert (K.estimate(np.arange(60)) == np.arange(60)).all()


def test_long_text_is_whole():
    rng = random.Random(1)
    t = prose(rng, 5000, 30) + "\n" + prose(rng, 10) + "\n" + "x # y"
    b = t.encode()
    got = K.base_counts(np.array([0, len(b)]), np.frombuffer(b, np.uint8))
    assert tuple(int(x[0]) for x in got.values()) == base(t)[:5]


def test_lots_meet_their_answers(spark, monkeypatch):
    monkeypatch.setattr(K, "_FLUSH", 300)
    rng = random.Random(5)
    texts = [(i, prose(rng, 60, 40)) for i in range(120)] + [(500, None), (501, "")]
    rows = K.score(spark.createDataFrame([(*x, "en") for x in texts], "doc_id long, text string, lang string")).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_a_lot_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    n, vocab = 1_000_000, np.arange(1, 200_001, dtype=np.uint64)
    x, inner = rng.integers(0, len(vocab), n).astype(np.uint32), np.ones(n, bool)
    tracemalloc.start()
    lot = K.lot_of(vocab, x, inner, 48)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pair = np.stack([lot.w, lot.v])[:, lot.back]
    assert (np.diff(lot.w * len(vocab) + lot.v) > 0).all() and pair.shape[1] == n - 1
    assert (lot.vocab[pair[0]] == vocab[x[1:]]).all() and (lot.vocab[pair[1]] == vocab[x[:-1]]).all()
    assert most < 45 * n


def test_bands_reject_labelled_junk_and_no_clean_text(spark):
    rows = Q.op7_quality_rules(spark, SF).where("not base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(not r.kept for r in rows if r.quality == 0) >= 11
    assert all(r.kept for r in rows if r.quality == 1)


def test_contexts_of_pairs_are_counted_in_little_memory():
    """Before, np.unique held a second copy of the longest array, and every list went on in eight bytes a number."""
    import tracemalloc

    rng = np.random.default_rng(1)
    group, n = rng.integers(0, 50_000, 200_000).astype(np.uint32), rng.integers(1, 4, 200_000).astype(np.uint16)
    cell = rng.integers(0, 1 << K.CONTEXT_BITS, int(n.sum())).astype(np.uint16)
    want = np.bincount(np.unique(np.repeat(group, n).astype(np.int64) << K.CONTEXT_BITS | cell) >> K.CONTEXT_BITS, minlength=50_000)
    tracemalloc.start()
    got = K._pair_contexts(group, n, cell, 50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 20 * len(cell)
    assert len(K._pair_contexts(group[:0], n[:0], cell[:0], 0)) == 0
    parts = [cell[:7], cell[7:7], cell[7:20]]
    assert (K._joined(parts) == cell[:20]).all() and not parts
