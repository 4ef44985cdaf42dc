import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracksift.llm import queries as Q
from tracksift.llm import token_file as T
from pyspark.sql import functions as F

from tests.llm.conftest import SF


def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_dac_round_trip_and_random_access(ids):
    d = T.Dac(T.encode_file(np.array(ids, np.uint32), np.array([7]), np.array([len(ids)])))
    assert d.all().tolist() == ids
    assert [d.get(i) for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        d.get(len(ids))


def test_query_matches_whole_text_tokenizer(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in Q.op8_token_file(spark, SF).collect())
    assert got == expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    key = lambda r: (r[1],)
    assert sorted((tuple(r) for r in T.encode_documents(odd_docs, Q.tokenizer_path()).collect()), key=key) == expected(rows)
    assert T.encode_documents(no_docs, Q.tokenizer_path()).collect() == []


def test_small_files_and_full_cache(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(T.WordEncoder, "CACHE", 10)
    path = T.scratch(spark, "dac-test")
    enc = Q.tokenizer_path()
    m = T.write(odd_docs, path, lambda: T.WordEncoder(enc), file_tokens=50)
    rows = m.orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert sum(r.n_docs for r in rows) == odd_docs.count()


def test_over_a_thousand_files_a_task(spark):
    df = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text")).coalesce(1)
    path = T.scratch(spark, "dac-test")
    enc = Q.tokenizer_path()
    # a batch of one row a file, all in one task
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = T.write(df, path, lambda: T.WordEncoder(enc), file_tokens=1).orderBy("first_id").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 1300 and rows[0].start == 0 and max(r.no for r in rows) >= 1000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAzZ09'.,<|>#-_éÉßñ×÷“…İΣ\u0301\u00a0\x85\x1c \n\t") | st.characters(codec="utf-8"), max_size=40) | st.sampled_from(["<|endoftext|>", "it's", "don'T x", "a<|startoftext|>b"]), max_size=6))
def test_pieces_encode_as_whole_texts_do(texts):
    import pyarrow as pa

    from tracksift.llm import words as W

    e = T.WordEncoder.of(Q.tokenizer_path())
    ids, size = e(*W.buffers(pa.array(texts, pa.string())))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert size.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
