import random
from collections import Counter

import duckdb

from tracksift.llm import line_dedup as L
from tracksift.llm import queries as Q
from tests.llm.conftest import SF


def brute(rows, m):
    """Cleaned texts of distinct (id, text) rows in order."""
    docs = [(i, t, t.split("\n")) for i, t in rows if t is not None]
    seen, count, out = set(), Counter(), {}
    for _, _, ls in docs:
        count.update(tuple(ls[k : k + m]) for k in range(len(ls) - m + 1))
    for i, t, ls in docs:
        gone, stays = set(), set()
        for k in range(len(ls) - m + 1):
            w = tuple(ls[k : k + m])
            if count[w] > 1:
                (gone if w in seen else stays).update(range(k, k + m))
            seen.add(w)
        gone -= stays
        out[i, t] = "\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone)
    return out


def test_query_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "n_lines", "n_removed", "n_chars", "text_md5"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({Q.OP1_SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in Q.op1_line_dedup(spark, SF).collect()) == want


def test_runs_of_any_length(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(f"l{rng.randrange(12)}" for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for m in (1, 3, 5):
        want = brute(rows, m)
        for r in L.dedup_lines(df, min_lines=m).collect():
            assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id, dict(rows)[r.doc_id]]


def test_full_depth_finds_the_longest_shared_prefix(spark):
    rows = [(1, "a\nb\nc\nd\ne\nx"), (2, "q\na\nb\nc\nd\ne"), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.no) for r in L.shared_prefixes(L.lines(df, "doc_id", "text"), 0).collect()}
    assert got == {(1, 0), (1, 1), (2, 1), (2, 2)}  # four shared lines begin there
    assert {(r.doc, r.start, r.end) for r in L.later_copies(df).collect()} == {(2, 1, 5)}


def test_odd_rows(spark, odd_docs, no_docs):
    out = L.dedup_lines(odd_docs, min_lines=1)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    rows = sorted({(r.doc_id, r.text) for r in odd_docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute(rows, 1)
    got = out.collect()
    assert len(got) == odd_docs.count()
    assert [r.n_removed for r in got if r.doc_id == 2] == [1, 1] and {r.text for r in got if r.doc_id == 2} == {""}
    assert [(r.text, r.n_lines) for r in got if r.doc_id == 3] == [(None, 0)]
    assert {(r.doc_id, r.text) for r in got if r.text is not None} == {(i, v[0]) for (i, _), v in want.items()}
    assert L.dedup_lines(no_docs).collect() == []


def test_first_copies_stay_whole(spark):
    rows = [(1, "A\nA\nA"), (2, "B\nC"), (3, "x\nB\nC\nD\ny"), (4, "C\nD")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # in 3, C stays: "C D" stands there for the first time
    assert got == {1: "A\nA", 2: "B\nC", 3: "x\nC\nD\ny", 4: ""}


def test_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "a\nb", 1, 2, 3), (2, "a\nb", 1, 2, 3)], "doc_id long, text string, runs int, lost int, `_runs` int")
    got = L.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and {(r.doc_id, r.text) for r in got.collect()} == {(1, "a\nb"), (2, "")}
