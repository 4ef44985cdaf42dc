"""Groupers on large groups: as the plain loops over all pairs, and in time that a large group allows."""

from __future__ import annotations

import difflib
import random
import time

import pytest

from tracksift.operators import dedup


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def same(kt, ka, t, a):
    rt = ratio(kt, t)
    return (ka == a and rt >= 0.86) or rt >= 0.95 or (rt >= 0.8 and ratio(ka, a) >= 0.35)


def plain_near_duplicates(rows):
    kept = []
    for _, title, artist in rows:
        t, a = (title or "").lower(), (artist or "").lower()
        for k in kept:
            kt, ka = (k[0] or "").lower(), (k[1] or "").lower()
            if same(kt, ka, t, a) or ratio(f"{ka} {kt}", f"{a} {t}") >= 0.9:
                k[2] += 1
                if len(title or "") > len(k[0] or ""):
                    k[0] = title
                break
        else:
            kept.append([title, artist, 1])
    return sorted(map(tuple, kept), key=str)


def varied(rng, n):
    words = ["love", "Story", "hello", "blue", "ring", "봄날", "a", "the", "midnight", "o"]
    out = []
    for i in range(n):
        t = " ".join(rng.choices(words, k=rng.randrange(0, 5)))
        for _ in range(rng.randrange(0, 3)):
            j = rng.randrange(len(t) + 1)
            t = t[:j] + rng.choice(("", "x", "!", "e")) + t[j + rng.randrange(0, 2) :]
        out.append((i, rng.choice((t, t, t, None)) if not t else t, rng.choice(("IU", "iu", "Blue Band", "The Blue Band", None))))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicates_are_those_of_all_pairs(spark, seed):
    rows = varied(random.Random(seed), 220)
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, line_no int, title string, artist string")
    got = dedup.near_duplicates(df).collect()
    assert sorted(((r.title, r.artist, r.n_variants) for r in got), key=str) == plain_near_duplicates(rows)


def test_no_near_text_is_missed():
    rng = random.Random(5)
    texts = [r[1] or "" for r in varied(rng, 250)] + ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    for least in (0.8, 0.9):
        index = dedup.NearTexts(least)
        for i, t in enumerate(texts):
            index.add(i, t)
        for t in texts:
            near = index.near(t)
            assert all(i in near for i, x in enumerate(texts) if ratio(x, t) >= least or ratio(t, x) >= least)


def test_fuzzy_dedup_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))), rng.choice("xy")) for i in range(150)]
    kept = []
    for i, t, a in rows:
        if not any(b == a and dedup._within_one(t, k) for _, k, b in kept):
            kept.append((i, t, a))
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, line_no int, title string, artist string")
    assert sorted((r.line_no, r.title, r.artist) for r in dedup.fuzzy_dedup(df).collect()) == kept


def big(spark, n):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    vocabulary = [word() for _ in range(3000)]
    rows = [(1, i, " ".join(rng.choices(vocabulary, k=3)), rng.choice(vocabulary), i, 50) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, title string, artist string, segment_index long, score long")


def test_a_group_of_many_rows(spark):
    """Ten thousand rows of one document, which as pairs are fifty million."""
    rows = big(spark, 10_000).cache()
    for f in (dedup.fuzzy_dedup, dedup.near_duplicates, dedup.merge_audio_hits):
        began = time.time()
        assert f(rows).count() > 9000
        assert time.time() - began < 100, f.__name__


def plain_supplement(songs, cards):
    """Rows of (doc, place, title, artist), songs with confirmed and sure: the decision on each card, by all pairs."""
    low = lambda x: (x or "").lower().strip()
    last = lambda r: (r[1] is None, r[1] or 0)
    out = []
    for doc in {r[0] for r in cards}:
        have = [(low(t), low(a), c, s) for _, _, t, a, c, s in sorted((r for r in songs if r[0] == doc), key=last)]
        for _, at, title, artist in sorted((r for r in cards if r[0] == doc), key=last):
            t, a, why = low(title), low(artist), "added" if low(title) and low(artist) else "missing_title_or_artist"
            for i, (ht, ha, confirmed, sure) in enumerate(have if why == "added" else ()):
                if ht and dedup._same_title(ht, t):
                    if ha == a or confirmed:
                        why = "duplicate_title_artist" if ha == a else "duplicate_music_section_title"
                        break
                elif at == i and sure and (ha == a or (min(len(ha), len(a)) >= 4 and (ha in a or a in ha))):
                    why = "duplicate_music_section_artist_position"
                    break
            if why == "added":
                have.append((t, a, True, False))
            out.append((doc, at, title, artist, why))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_supplement_is_that_of_plain_loops(spark, seed):
    rng = random.Random(seed)
    word, name = lambda: rng.choice(("sky", "Blue", "moonrise", "곡", "", " ", None)), lambda: rng.choice(("zed", "Zeds", "Somebody", "somebodyelse", "가수", "", None))
    title = lambda: rng.choice((word(), f"{word()}{rng.randrange(30)}"))
    doc = lambda: rng.choice((None, *range(40)))
    places = lambda n: rng.sample(range(n * 2), n)
    songs = [(doc(), i, title(), name(), rng.random() < 0.4, rng.random() < 0.7) for i in places(300)]
    cards, taken = [], set()
    for _ in range(300):
        d, i = doc(), rng.choice((None, *range(9)))
        if (d, i) not in taken:
            taken.add((d, i))
            cards.append((d, i, title(), name()))
    own = spark.createDataFrame([(d, i, t, a, 0 if c else None, "high" if s else None) for d, i, t, a, c, s in songs], "doc_id long, line_no int, title string, artist string, section_index int, confidence string")
    extras = spark.createDataFrame(cards, "doc_id long, section_index int, title string, artist string")
    out = dedup.supplement(own, extras)
    assert out.columns == [*extras.columns, "decision"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == plain_supplement(songs, cards)
    assert len({r[-1] for r in got}) == 5


def test_supplement_of_many_small_documents(spark):
    """Twelve thousand documents of two songs and two cards: rows cost, not documents."""
    k = spark.range(24_000)
    own = k.selectExpr("id div 2 AS doc_id", "CAST(id % 2 AS int) AS line_no", "concat('곡', id) AS title", "concat('가수', id) AS artist")
    cards = k.selectExpr("id div 2 AS doc_id", "CAST(id % 2 AS int) AS section_index", "concat('song ', id) AS title", "CASE WHEN id % 2 = 0 THEN concat('가수', id) ELSE 'Somebody else' END AS artist")
    began = time.time()
    got = {(r.section_index, r.decision): r["count"] for r in dedup.supplement(own, cards).groupBy("section_index", "decision").count().collect()}
    assert time.time() - began < 40
    assert got == {(0, "duplicate_music_section_artist_position"): 12_000, (1, "added"): 12_000}
