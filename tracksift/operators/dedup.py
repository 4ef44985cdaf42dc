"""Groupers whose rule is sequential: the first kept row stands, later ones are compared with kept ones.

Each runs within one document's group; groups are a document's songs, cards or frames.
"""

from __future__ import annotations

import difflib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.session import ship

#: Fixed values.
FUZZY_MIN_ROWS = 10
SECTION_RATIO = 0.8
TITLE_RATIO, WHOLE_RATIO = 0.8, 0.9


def fuzzy_dedup(songs: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Songs without those whose title is within one edit of an earlier kept one of the same artist; for documents of FUZZY_MIN_ROWS songs or more.

    Titles and artists are compared trimmed and in lower case, brackets and all; songs without a title go.
    """
    fold = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    own = songs.withColumn("_t", fold("title")).withColumn("_a", fold("artist")).where("_t <> ''")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        if len(pdf) < FUZZY_MIN_ROWS:
            return pdf.drop(columns=["_t", "_a"])
        # titles within one edit share themselves or what is left without one letter
        kept: dict[tuple[str, str], list[str]] = {}
        keep = []
        for t, a in zip(pdf["_t"], pdf["_a"], strict=True):
            keys = {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}
            near = any(_within_one(t, k) for x in keys for k in kept.get((a, x), ()))
            keep.append(not near)
            if not near:
                for x in keys:
                    kept.setdefault((a, x), []).append(t)
        return pdf[keep].drop(columns=["_t", "_a"])

    ship(own.sparkSession)
    return own.groupBy(key).applyInPandas(greedy, songs.schema)


def _within_one(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _pairs(text: str) -> list[tuple[str, int]]:
    """A text's pairs of neighbouring letters, each with its number among equal ones."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - 1):
        x = text[i : i + 2]
        out.append((x, seen[x]))
        seen[x] += 1
    return out


class NearTexts:
    """Texts by number, and which of them may have a sequence ratio of `ratio` or more with another text: none that has is missed.

    Texts of T letters in all with M of them matched in runs have 3M - T - 1 pairs of neighbouring letters in common at least:
    two runs are parted by a letter of one side that isn't matched. So pairs in common are counted by an inverted index,
    and lengths bound the ratio too; short texts go by length alone.
    """

    def __init__(self, ratio: float) -> None:
        self.ratio = ratio
        self.by_pair: dict[tuple[str, int], array] = {}
        self.numbers, self.lengths = array("i"), array("i")

    def add(self, number: int, text: str) -> None:
        for x in _pairs(text):
            self.by_pair.setdefault(x, array("i")).append(len(self.numbers))
        self.numbers.append(number)
        self.lengths.append(len(text))

    def near(self, text: str) -> list[int]:
        lists = [np.frombuffer(self.by_pair[x], np.int32) for x in _pairs(text) if x in self.by_pair]
        shared = np.bincount(np.concatenate(lists) if lists else np.zeros(0, np.int32), minlength=len(self.numbers))
        lengths = np.frombuffer(self.lengths, np.int32) if self.lengths else np.zeros(0, np.int32)
        total = lengths + len(text)
        may = (2 * np.minimum(lengths, len(text)) >= self.ratio * total - 1e-9) & (shared >= (1.5 * self.ratio - 1) * total - 1 - 1e-9)
        return sorted({self.numbers[i] for i in np.flatnonzero(may)})


def _may_reach(a: str, b: str, ratio: float) -> bool:
    """Whether letters in common allow a sequence ratio that high."""
    total = len(a) + len(b)
    return 2 * min(len(a), len(b)) >= ratio * total - 1e-9 and 2 * (Counter(a) & Counter(b)).total() >= ratio * total - 1e-9


def _same_song(kt: str, ka: str, t: str, a: str) -> bool:
    """Equal artists and titles at 0.86, or titles at 0.95, or titles at 0.80 with artists at 0.35."""
    if not _may_reach(kt, t, TITLE_RATIO):
        return False
    rt = _ratio(kt, t)
    return (ka == a and rt >= 0.86) or rt >= 0.95 or (rt >= TITLE_RATIO and _ratio(ka, a) >= 0.35)


def near_duplicates(songs: DataFrame, key: str = "doc_id", order: str = "line_no", full_rule: bool = True) -> DataFrame:
    """Near-equal readings of a song as one: the longest title stays, n_variants counts them.

    Two rows are one song where artists are equal and titles at 0.86, or titles at 0.95, or titles at 0.80 with
    artists at 0.35, or (full_rule) the whole at 0.90.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        fold = lambda r: ((r["title"] or "").lower(), (r["artist"] or "").lower())
        whole = lambda t, a: f"{a} {t}"
        rows = pdf.to_dict("records")
        folded = [fold(r) for r in rows]
        titles, wholes = NearTexts(TITLE_RATIO), NearTexts(WHOLE_RATIO)
        kept: list[dict] = []
        for r, (t, a) in zip(rows, folded, strict=True):
            for i in sorted({*titles.near(t), *(wholes.near(whole(t, a)) if full_rule else ())}):
                k = kept[i]
                kt, ka = fold(k)
                if _same_song(kt, ka, t, a) or (full_rule and _may_reach(whole(kt, ka), whole(t, a), WHOLE_RATIO) and _ratio(whole(kt, ka), whole(t, a)) >= WHOLE_RATIO):
                    k["n_variants"] += 1
                    if len(r["title"] or "") > len(k["title"] or ""):
                        k["title"] = r["title"]
                        titles.add(i, t)
                        wholes.add(i, whole(t, ka))
                    break
            else:
                titles.add(len(kept), t)
                wholes.add(len(kept), whole(t, a))
                kept.append(r | {"n_variants": 1})
        return pd.DataFrame(kept, columns=[*pdf.columns, "n_variants"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in songs.schema.fields)
    ship(songs.sparkSession)
    return songs.groupBy(key).applyInPandas(greedy, f"{fields}, n_variants long")


def with_title_keys(rows: DataFrame, titles: DataFrame | None, into: str = "_keys") -> DataFrame:
    """rows with the title's other names (of its alias groups; titles: canonical, alias), in lower case."""
    if titles is None:
        return rows.withColumn(into, F.array().cast("array<string>"))
    every = titles.select("canonical", "alias").union(titles.select("canonical", F.col("canonical").alias("alias"))).select("canonical", F.lower(F.trim("alias")).alias("a")).distinct()
    group = every.groupBy("canonical").agg(F.collect_set("a").alias("own"))
    names = every.join(group, "canonical").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias(into))
    return rows.withColumn("a", F.lower(F.trim("title"))).join(names, "a", "left").drop("a").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def section_join(songs: DataFrame, cards: DataFrame, key: str = "doc_id", titles: DataFrame | None = None) -> DataFrame:
    """Each song with the card it is: equal, contained or a known other title, then the best ratio of SECTION_RATIO; each card once; equal leftovers by position.

    Songs: key, line_no, artist, title. Cards: key, section_index, title, artist. Adds section_index, card_artist, how.
    """
    columns, schema = songs.columns, songs.schema
    songs, cards = with_title_keys(songs, titles), with_title_keys(cards, titles)

    def match(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("line_no", kind="stable"), right.sort_values("section_index", kind="stable")
        free = right.to_dict("records")
        rows = [r | {"section_index": None, "card_artist": None, "how": None} for r in left.to_dict("records")]

        def take(r: dict, c: dict, how: str) -> None:
            r.update(section_index=c["section_index"], card_artist=c["artist"], how=how)
            free.remove(c)

        for r in rows:
            t = (r["title"] or "").lower().strip()
            hit = next((c for c in free if t and (_same_title(t, (c["title"] or "").lower().strip()) or set(r["_keys"]) & set(c["_keys"]))), None)
            if hit is None and t and free:
                score, hit = max(((_ratio(t, (c["title"] or "").lower()), c) for c in free), key=lambda x: x[0])
                hit = hit if score >= SECTION_RATIO else None
            if hit is not None:
                take(r, hit, "title")
        left_over = [r for r in rows if r["how"] is None]
        if left_over and len(left_over) == len(free) and len(left_over) < len(rows):
            for r, c in zip(left_over, list(free), strict=True):
                take(r, c, "position")
        return pd.DataFrame(rows, columns=[*columns, "section_index", "card_artist", "how"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    ship(songs.sparkSession)
    return songs.groupBy(key).cogroup(cards.groupBy(key)).applyInPandas(match, f"{fields}, section_index int, card_artist string, how string")


def _same_title(a: str, b: str) -> bool:
    return bool(b) and (a == b or a.startswith(b) or b.startswith(a) or (min(len(a), len(b)) >= 3 and (a in b or b in a)))


def section_extras(cards: DataFrame, joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cards that no song took."""
    used = joined.where("section_index is not null").select(key, "section_index")
    return cards.join(used, [key, "section_index"], "left_anti")


def drop_swapped(joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """joined without songs that are a confirmed song with artist and title changed places."""
    fold = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    own = joined.withColumns({"_t": fold("title"), "_a": fold("artist")})
    sure = own.where("section_index is not null and _t <> '' and _a <> ''").select(F.col(key).alias("_key"), F.col("_t").alias("_ct"), F.col("_a").alias("_ca")).distinct()
    other = F.col("section_index").isNull() & (F.col(key) == F.col("_key")) & (F.col("_a") == F.col("_ct")) & (F.col("_t") == F.col("_ca"))
    return own.join(sure, other, "left_anti").drop("_t", "_a")


def _same_artist(a: list[str], b: list[str]) -> bool:
    return bool(set(a) & set(b)) or any(len(x) >= 4 and len(y) >= 4 and (x in y or y in x) for x in a for y in b)


def supplement(songs: DataFrame, extras: DataFrame, key: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """Extras with the decision on each: added, or why not. An added one may keep a later one out.

    Out go extras without title or artist, those whose title stands with the same artist or under a confirmed song, and
    those at whose place in the document a song by the same artist stands (a translated title). Songs may have section_index
    (not null: confirmed) and confidence (only high ones hold their place); groups: match.alias_groups(). Documents pass through
    a task as a sorted stream, songs before extras: small ones cost no more than their rows.
    """
    flag = lambda c, v: F.col(c).isNotNull() if c in songs.columns else F.lit(v)
    sure = F.col("confidence") == "high" if "confidence" in songs.columns else F.lit(True)
    own = songs.select(key, "title", "artist", F.col("line_no").alias("_line"), flag("section_index", False).alias("_confirmed"), F.coalesce(sure, F.lit(False)).alias("_sure"))
    own = _with_artist_keys(own.unionByName(extras, allowMissingColumns=True), groups)
    columns = extras.columns
    # keys hold letters and digits only; extras are the rows without _confirmed
    own = own.withColumn("_akeys", F.array_join("_akeys", "\n")).repartition(key)
    own = own.sortWithinPartitions(key, F.col("_confirmed").isNull(), F.asc_nulls_last("_line"), F.asc_nulls_last("section_index"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = lambda x: (x or "").lower().strip()
        last: object = decide  # no key
        have: list[tuple] = []
        for b in batches:
            decisions = []
            for k, title, artist, akeys, place, known, high in zip(*(b.column(c).to_pylist() for c in (key, "title", "artist", "_akeys", "section_index", "_confirmed", "_sure")), strict=True):
                if k != last:
                    last, have = k, []
                t, a, why = low(title), low(artist), "added"
                if known is not None:
                    have.append((t, a, akeys, known, high))
                    continue
                if not t or not a:
                    why = "missing_title_or_artist"
                for i, (ht, ha, keys, confirmed, sure) in enumerate(have if why == "added" else ()):
                    if not (ht and _same_title(ht, t)):
                        if place == i and sure and _same_artist(keys.split(), akeys.split()):
                            why = "duplicate_music_section_artist_position"
                            break
                    elif ha == a:
                        why = "duplicate_title_artist"
                        break
                    elif confirmed:
                        why = "duplicate_music_section_title"
                        break
                if why == "added":
                    have.append((t, a, akeys, True, False))
                decisions.append(why)
            cards = b.filter(b.column("_confirmed").is_null())
            yield pa.RecordBatch.from_arrays([*(cards.column(c) for c in columns), pa.array(decisions, pa.string())], names=[*columns, "decision"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*columns).schema.fields)
    ship(own.sparkSession)
    return own.mapInArrow(decide, f"{fields}, decision string")


def _with_artist_keys(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    own = F.filter(F.transform(X.artist_parts(F.col("artist")), X.artist_key), lambda k: k != "")
    rows = rows.withColumn("_akeys", F.coalesce(own, F.array().cast("array<string>")))
    if groups is None:
        return rows
    # a name is looked up whole: cards and songs name one artist, or are told apart by their parts
    one = rows.withColumn("alias_key", X.artist_key(F.col("artist"))).join(groups, "alias_key", "left")
    return one.withColumn("_akeys", F.when(F.col("keys").isNotNull(), F.array_union("_akeys", "keys")).otherwise(F.col("_akeys"))).drop("alias_key", "keys")


def merge_audio_hits(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Near-equal audio hits of a document as one: the reading of the highest score (the first on ties), all its segments, how many, max_score.

    Two hits are one song where artists are equal and titles at 0.86, or titles at 0.95, or titles at 0.80 with artists
    at 0.35. Hits without a title go. hits: key, segment_index, title, artist, score.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"title": (r["title"] or "").strip(), "artist": (r["artist"] or "").strip()} for r in pdf.sort_values("segment_index", kind="stable").to_dict("records")]
        titles = NearTexts(TITLE_RATIO)
        kept: list[dict] = []
        for r in rows:
            t, a = r["title"], r["artist"]
            if not t:
                continue
            for i in titles.near(t.lower()):
                k = kept[i]
                if _same_song(t.lower(), a.lower(), k["title"].lower(), k["artist"].lower()):
                    if r["score"] > k["max_score"]:
                        k.update(title=t, artist=a, max_score=r["score"])
                        titles.add(i, t.lower())
                    if r["segment_index"] not in k["segments"]:
                        k["segments"][r["segment_index"]] = None
                    break
            else:
                titles.add(len(kept), t.lower())
                kept.append({key: r[key], "title": t, "artist": a, "max_score": r["score"], "segments": {r["segment_index"]: None}})
        for k in kept:
            k["segments"] = list(k["segments"])
        out = pd.DataFrame(kept, columns=[key, "title", "artist", "max_score", "segments"])
        out["n"] = out["segments"].map(len).astype("int64") if len(out) else pd.Series(dtype="int64")
        return out

    own = hits.select(key, F.col("segment_index").cast("long"), "title", "artist", F.col("score").cast("long"))
    kind = hits.schema[key].dataType.simpleString()
    ship(hits.sparkSession)
    return own.groupBy(key).applyInPandas(greedy, f"`{key}` {kind}, title string, artist string, max_score long, segments array<long>, n long")
