import zlib

import numpy as np
import pyarrow as pa

from tracksift.llm import queries as Q
from tracksift.llm import toxicity as T
from tracksift.llm import words as W


def test_query_contract_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op4_toxicity(spark, sf).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    own = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p for y, p in own if y) / sum(y for y, _ in own)
    false = sum(p for y, p in own if not y) / sum(not y for y, _ in own)
    assert hit > 0.8 and false < 0.02, (hit, false)


def test_unseen_misspellings_share_vectors(spark):
    sf = "/root/testdata/sf0.1"
    texts, y = T.sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", "toxic")
    m = T.train(texts, y)
    clean = "The others in an hour went there to see the old house that stood on the hill and it was good"
    odd = ["idiott", "stuppid", "patheticc", "worthles", "disgustingg", "idiots", "morron", "loooser", "trashy", "clownn"]
    s = T.scores(m, *W.buffers(pa.array([clean, *[f"{clean} {w} {clean}" for w in odd]])))
    assert s[0] < 0.1 and (s[1:] >= 0.3).sum() >= 8, dict(zip(odd, s[1:].round(2), strict=True))


def test_prefix_sums_equal_plain_averages():
    rng = np.random.default_rng(0)
    m = T.Model(rng.normal(size=T.BUCKETS).astype(np.float32), -0.5)
    texts = ["Hello, wörld! it's", "", "  ", "a", "x" * 500, " ".join(f"w{i}" for i in range(40)), "end"]
    off, data = W.buffers(pa.array(texts))
    got = T.scores(m, off, data)

    def plain(t):
        clean = "".join(chr(b) if b >= 128 or chr(b).isalnum() else " " for b in t.lower().encode()).split()
        best = None
        for i in range(0, max(1, len(clean) - T.WINDOW + T.STRIDE) if clean else 0, T.STRIDE):
            g = []
            for w in clean[i : i + T.WINDOW]:
                p = f" {w} ".encode("latin1")
                for k in T.GRAMS:
                    for j in range(len(p) - k + 1):
                        g.append((k, p[j : j + k]))
            z = sum(float(m.value[bucket(k, x)]) for k, x in g) / max(len(g), 1) + m.bias
            best = z if best is None else max(best, z)
        return 1 / (1 + np.exp(-(m.bias if best is None else best)))

    def bucket(k, x):
        h = k * 0x9E3779B1 & 0xFFFFFFFF
        for b in x:
            h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 13
        return h & (T.BUCKETS - 1)

    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (9, 0), (None, 1), (7, 1), (7, 1)], "doc_id long, toxic int")
    rows = T.score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(no_docs, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in T.score(odd_docs, none).collect()} == {0.5}
