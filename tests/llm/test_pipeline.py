import zlib

import numpy as np

import corpus_pipeline as C
from tracksift.llm import decontaminate, mixing, near_dup, quality
from tracksift.llm import queries as Q
from tracksift.session import cut
from tests.llm.conftest import SF


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = cut(C.STAGES[0][1](spark, docs, SF), "t")
    want = {r.doc_id for r in quality.score(docs).collect() if r.kept}
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == want
    one = cut(C.STAGES[1][1](spark, kept, SF), "t")
    want = {r.doc_id for r in near_dup.near_duplicates(kept).collect() if r.class_id == r.doc_id}
    assert one.columns == names and {r.doc_id for r in one.collect()} == want
    clean = cut(C.STAGES[2][1](spark, one, SF), "t")
    bad = {r.doc_id for r in decontaminate.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and {r.doc_id for r in clean.collect()} == want - bad and clean.columns == names
    mixed = cut(C.STAGES[3][1](spark, clean, SF), "t")
    copies = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mix(clean).collect()}
    got = [r.doc_id for r in mixed.select("doc_id").collect()]
    assert mixed.columns == names and all(got.count(i) == n for i, n in copies.items())
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in C.STAGES[4][1](spark, mixed, SF).collect())
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(Q.tokenizer_path()), 0
    texts = sorted(((r.doc_id, r.text) for r in mixed.collect()))
    for (start, doc_id, n, crc), (i, t) in zip(rows, texts, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, doc_id, n, crc) == (at, i, len(ids), zlib.crc32(ids.tobytes()))
        at += n


def test_run_and_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        at = docs
        for _, stage in C.STAGES:
            out = cut(stage(spark, at, SF), "t")
            if stage is not C.STAGES[-1][1]:
                assert out.columns == docs.columns
            at = out
        assert at.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage_drops_labelled_junk_and_no_clean_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in C.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    rows = quality.score(docs).where("not base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "quality").collect()
    assert sum(r.doc_id not in kept for r in rows if r.quality == 0) >= 11
    assert all(r.doc_id in kept for r in rows if r.quality == 1)
