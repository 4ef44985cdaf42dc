import random

import numpy as np

from tracksift.llm import decontaminate as D
from tracksift.llm import queries as Q
from tracksift.llm import words as W
from tests.llm.conftest import SF, prose


def tokens_of(t):
    b = (t or "").encode()
    return D.tokens(np.array([0, len(b)]), np.frombuffer(b, np.uint8))[0].tolist()


def brute(item, text):
    """Sellers: least edits of item against any run of text."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_edit_distance_matches_table():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
        assert D.edit_distance(np.array(a), np.array(b))[0] == brute(a, b)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = {r.item_id: tokens_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in Q.op9_decontamination(spark, SF).collect()}
    want = {}
    for r in docs:
        t = tokens_of(r.text)
        have = set(t)
        for k, item in items.items():
            d = int(D.EDIT_RATE * len(item) + 1e-9)
            if sum(x not in have for x in item) <= d and (e := brute(item, t)) <= d:
                want[r.doc_id, k] = e
    assert got == want and want


def test_edited_items_are_found_and_others_not(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(8, 60), 3000)) for i in range(60)]
    docs, truth = [], set()
    for i in range(400):
        w = prose(rng, 200, 3000).split()
        if i % 2:
            k = rng.randrange(60)
            x = items[k][1].split()
            for _ in range(int(0.2 * len(x))):
                at = rng.randrange(len(x))
                kind = rng.randrange(3)
                x[at : at + (kind > 0)] = [f"n{rng.randrange(99)}"] * (kind < 2)
            at = rng.randrange(200)
            w[at:at] = x
            truth.add((i, k))
        docs.append((i, " ".join(w)))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(truth - got) <= 2 and not got - truth


def test_items_in_blocks(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 2)
    long = odd_docs.where("doc_id = 6").first().text
    items = [(1, " ".join(long.split()[100:130])), (2, None), (None, "a b c d e f"), (3, "one two"), (4, "zz " * 9), (5, " ".join(long.split()[-40:])), (1, " ".join(long.split()[:25]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in D.contaminated(odd_docs, b).collect())
    assert got == [(6, 1, 0), (6, 5, 0), (7, 3, 0), (8, 3, 0)]
    assert not {6, 7, 8} & {r.doc_id for r in D.clean(odd_docs, b).collect()}


def edited(rng, x, n):
    x = list(x)
    for _ in range(n):
        at, kind = rng.randrange(len(x)), rng.randrange(3)
        x[at : at + (kind > 0)] = [f"n{rng.randrange(999)}"] * (kind < 2)
    return x


def test_index_recall_at_the_full_edit_rate():
    """Windows found through the index, against all windows that are near enough."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    for lengths, least in (((5, 7), 0.97), ((8, 11), 0.99), ((12, 20), 0.99), ((21, 60), 0.99)):
        texts = [rng.choices(vocab, k=rng.randint(*lengths)) for _ in range(300)]
        items = D.items_of(list(range(300)), [" ".join(x) for x in texts])
        hit = n = 0
        for k, x in enumerate(texts):
            y = rng.choices(vocab, k=30) + edited(rng, x, len(x) // 5) + rng.choices(vocab, k=30)
            h = np.array(tokens_of(" ".join(y)), np.uint64)
            if brute(tokens_of(" ".join(x)), h.tolist()) <= len(x) // 5:
                n += 1
                hit += k in {i for _, i, _, _ in D.search(items, h, np.array([0, len(h)]))}
        assert n == 300 and hit >= least * n, (lengths, hit)


def test_tiny_and_huge_items(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(900)]
    huge = rng.choices(vocab, k=3000)
    docs = [(1, "say alpha now"), (2, "say alpha beta gamma now"), (3, " ".join([*rng.choices(vocab, k=20), *edited(rng, huge, 500)])), (4, "alpha x gamma")]
    items = [(1, "Alpha"), (2, "alpha beta gamma"), (3, " ".join(huge)), (4, "?!")]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (2, 2), (3, 3)}


def test_clean_judges_each_row(spark):
    docs = spark.createDataFrame([(None, "say alpha beta gamma delta omega now", "x"), (None, "nothing here", "y"), (1, "alpha beta gamma delta omega", "z"), (1, "fine", "w")], "doc_id long, text string, th string")
    b = spark.createDataFrame([(1, "alpha beta gamma delta omega")], "item_id long, text string")
    assert sorted(r.th for r in D.clean(docs, b).collect()) == ["w", "y"]


def test_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string")
    assert D.contaminated(no_docs, b).collect() == []
    assert D.contaminated(odd_docs, b.limit(0)).collect() == []
    kept = D.clean(odd_docs, b)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
