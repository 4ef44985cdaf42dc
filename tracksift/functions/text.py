"""Scalar text functions, Column to Column. Null in, null out, unless a function says otherwise.

Patterns write character classes out, so Spark's and other engines' regular expressions agree.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache, reduce, wraps
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions import lexicon as L
from tracksift.session import ship

TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
DECORATION = r"~*#>+\-–—•·‣\s"
WORD = r"\p{L}\p{N}_"
LEAD_TIME = rf"^\s*[~*#>+\-–—•·‣\[\(\s]*(?:{TIME})[\]\)]?\s*[-|~>*]*\s*"
PAIR = r".\s[-–—|/:~_]\s."


def any_of(words: list[str]) -> str:
    """A pattern of literal words."""
    return "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", w) for w in words)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def spaces(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_timestamps(c: Column) -> Column:
    return spaces(F.regexp_replace(c, rf"(?<!\d)(?:{TIME})(?!\d)", " "))


def timestamp_of(c: Column) -> Column:
    """The time that opens a line, or closes one of 2 to 60 characters; null if none."""
    lead = F.regexp_extract(c, rf"^\s*[~*#>+\-–—•·‣\[\(\s]*({TIME})(?:[\]\)]|\s|$)", 1)
    tail = F.regexp_extract(c, rf"^.{{2,60}}?\s+({TIME})$", 1)
    return F.coalesce(F.nullif(lead, F.lit("")), F.nullif(tail, F.lit("")))


def seconds_of(c: Column) -> Column:
    """m:ss or h:mm:ss as seconds."""
    p = F.split(c, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(p) == 2, n(0) * 60 + n(1))


def ascii_brackets(c: Column) -> Column:
    return F.translate(c, "（）［］｛｝", "()[]{}")


def strip_short_brackets(c: Column, by: str = "") -> Column:
    """Parentheticals of up to 12 characters go, but for those glued to an identifier, as f(x) or (G)I-DLE."""
    glued = r"(?<![A-Za-z0-9])[(\[{](?!\s*[A-Za-z0-9]+\s*[)\]}][A-Za-z0-9])[^)\]}]{1,12}[)\]}]|(?<=[A-Za-z0-9])[(\[{](?![A-Za-z0-9]+[)\]}])[^)\]}]{1,12}[)\]}]"
    return F.regexp_replace(ascii_brackets(c), glued, by)


def strip_credits(c: Column) -> Column:
    """feat, ft, featuring, with and prod by phrases go, and (original: ...); "with me" and the like stay."""
    original = r"(?i)\s*[(\[{]\s*(?:원곡|original(?:ly)?(?:\s+(?:performed|recorded)\s+by)?)\s*[:：-]\s*[^)\]}]{1,120}[)\]}]\s*"
    pronoun = rf"(?!with\.?\s+(?:{'|'.join(L.WITH_PRONOUNS)})\s*(?:[)\]}}_/|–—-]|$))"
    phrase = rf"(?i)[(\[{{]?\s*(?<![{WORD}]){pronoun}(?:feat|ft|featuring|with|prod(?:uced)?\s+by)\.?\s+[^)\]}}_/|–—-]{{1,80}}[)\]}}]?"
    return F.regexp_replace(F.regexp_replace(c, original, " "), phrase, " ")


def credits_of(c: Column) -> Column:
    """Featured artists named in a title, distinct, in order."""
    found = F.regexp_extract_all(ascii_brackets(c), F.lit(rf"(?i)(?<![{WORD}])(?:feat|ft|featuring|with)\.?\s+([^)\]}}_/|–—-]{{1,80}})"), F.lit(1))
    cut = F.transform(found, lambda x: F.regexp_replace(x, r"(?i)\b(?:remix|instrumental|inst|live|remaster(?:ed)?|version|ver)\b.*$", ""))
    parts = F.flatten(F.transform(cut, lambda x: F.split(x, r"(?i)\s*(?:,|&| x | and |/)\s*")))
    kept = F.filter(F.transform(parts, lambda x: spaces(x)), lambda x: (x != "") & ~F.lower(x).isin(L.WITH_PRONOUNS))
    return F.array_distinct(kept)


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(c, LEAD_TIME, "")
    c = strip_timestamps(c)
    c = F.regexp_replace(F.regexp_replace(c, rf"^[{DECORATION}]+", ""), rf"[~*#<>\-–—•·‣\s]+$", "")
    return F.trim(F.regexp_replace(spaces(c), r"^[ \-|/:~]+|[ \-|/:~]+$", ""))


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def clean_text(c: Column) -> Column:
    """The canonical cleaner of a line: quotes, credits, short brackets, times and decorations."""
    return _tidy(strip_short_brackets(strip_credits(plain_quotes(c))))


def drop_unmatched_closers(c: Column) -> Column:
    """Closing brackets without an opener go."""
    start = F.struct(F.lit("").alias("out"), *[F.lit(0).alias(k) for k in "pbc"])

    def step(acc: Column, x: Column) -> Column:
        fields, keep = [], F.lit(True)
        for k, (o, e) in zip("pbc", ("()", "[]", "{}"), strict=True):
            n = acc[k]
            keep = keep & ~((x == e) & (n == 0))
            fields.append((n + F.when(x == o, 1).when((x == e) & (n > 0), -1).otherwise(0)).alias(k))
        return F.struct(F.concat(acc.out, F.when(keep, x).otherwise("")).alias("out"), *fields)

    return F.when(~c.rlike(r"[)\]}]"), c).otherwise(F.aggregate(F.split(c, ""), start, step, lambda acc: acc.out))


def clean_side(c: Column) -> Column:
    """One side of a pair: as clean_text, but descriptive parentheticals stay."""
    return _tidy(drop_unmatched_closers(strip_credits(plain_quotes(c))))


def compare_text(c: Column) -> Column:
    """Lower case, letters, digits and & . , ' - only."""
    return spaces(F.regexp_replace(F.lower(clean_text(c)), rf"[^{WORD}\s&.,'\-]", " "))


def match_text(c: Column) -> Column:
    """The normal form of matching: no brackets, no punctuation, feat spelt out."""
    c = F.regexp_replace(ascii_brackets(F.trim(F.lower(c))), "&", " and ")
    c = F.regexp_replace(c, r"[‐-―:|/]+", " ")
    c = F.regexp_replace(c, r"\b(?:feat|ft|featuring)\b\.?", " featuring ")
    c = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    return spaces(F.regexp_replace(c, rf"[^{WORD}\s]", " "))


def match_key(c: Column) -> Column:
    return F.replace(match_text(c), F.lit(" "), F.lit(""))


def artist_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(strip_short_brackets(c, " ")), "&", " and ")
    return F.regexp_replace(c, rf"[^{WORD}]", "")


def base_title(c: Column) -> Column:
    """A title without parentheticals."""
    return spaces(F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " "))


def shipped(udf):
    """A pandas UDF that makes sure, where it is used, that Python workers have this package."""

    @wraps(udf.func)
    def use(*cols: Column) -> Column:
        ship(SparkSession.active())
        return udf(*cols)

    return use


@shipped
@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def upper_latin(c: Column) -> Column:
    """Three Latin letters or more, all capitals."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.length(letters) >= 3) & (letters == F.upper(letters))


def hangul_only(c: Column) -> Column:
    return F.replace(clean_text(c), F.lit(" "), F.lit("")).rlike("^[가-힣]+$")


def word_count(c: Column) -> Column:
    """Words of the compared text."""
    t = compare_text(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def compact_length(c: Column) -> Column:
    return F.length(F.regexp_replace(clean_text(c), r"\s+", ""))


def tokens(c: Column) -> Column:
    return tokens_of_normal(match_text(c))


def tokens_of_normal(c: Column) -> Column:
    """Distinct tokens of a normal form, without stop words."""
    return F.array_except(F.filter(F.split(c, " "), lambda x: x != ""), F.array(*[F.lit(w) for w in L.STOPWORDS]))


def token_overlap(a: Column, b: Column) -> Column:
    return overlap_of_tokens(tokens(a), tokens(b))


def overlap_of_tokens(x: Column, y: Column) -> Column:
    """Shared tokens over the larger set's size, 4 places; 0 where a side has none."""
    return F.when((F.size(x) < 1) | (F.size(y) < 1), F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)), 4))


@shipped
@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of arguments matters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _half_up(v: float) -> float:
    return math.floor(v * 10_000 + 0.5) / 10_000


@lru_cache(maxsize=1 << 16)
def _form(x: str) -> tuple[str, frozenset[str], Counter[str]]:
    """Of a normal form: without spaces, its tokens without stop words, its letters."""
    return x.replace(" ", ""), frozenset(x.split()) - frozenset(L.STOPWORDS), Counter(x)


@lru_cache(maxsize=1 << 16)
def _sequence(x: str, y: str) -> float:
    return _half_up(difflib.SequenceMatcher(None, x, y).ratio() * 0.82)


def similar(x: str, y: str, least: float = 0.0) -> float:
    """similarity() of two normal forms, for use in tasks; where it can't exceed `least`, any value up to that.

    Letters in common bound the sequence ratio, first by length and then by their counts, so most pairs need no matching.
    """
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    (p, a, own), (q, b, other) = _form(x), _form(y)
    if len(p) <= 2 or len(q) <= 2:
        if p == q:
            return 1.0
        return (0.55 if re.search("[가-힣]", p + q) else 0.75) if p in q or q in p else 0.0
    if p == q:
        return 1.0
    if x in y or y in x:
        return 0.92
    best = max(least, _half_up(len(a & b) / max(len(a), len(b))) if a and b else 0.0)
    total = len(x) + len(y)
    if _half_up(2 * min(len(x), len(y)) / total * 0.82) <= best or _half_up(2 * (own & other).total() / total * 0.82) <= best:
        return best
    return max(best, _sequence(x, y))


@shipped
@F.pandas_udf(T.DoubleType())
def best_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The highest similarity between two arrays of normal forms; 0 if one is empty, null if one is null."""

    def best(x, y) -> float:
        top = 0.0
        for i in x:
            for j in y:
                top = max(top, similar(i, j, top))
                if top == 1.0:
                    return top
        return top

    return pd.Series([None if x is None or y is None else best(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def quick_similarity(a: Column, b: Column) -> Column:
    return quick_similarity_of_normal(match_text(a), match_text(b))


def quick_similarity_of_normal(x: Column, y: Column) -> Column:
    """The branches of similarity() that need no sequence matching, from normal forms; null where it would."""
    p, q = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    within = F.contains(q, p) | F.contains(p, q)
    short = F.when(p == q, 1.0).when(within, F.when(has_hangul(F.concat(p, q)), 0.55).otherwise(0.75)).otherwise(0.0)
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when((F.length(p) <= 2) | (F.length(q) <= 2), short)
        .when((x == y) | (p == q), 1.0)
        .when(F.contains(y, x) | F.contains(x, y), 0.92)
    )


def similarity(a: Column, b: Column) -> Column:
    """Piecewise similarity of two names: equal, contained, token overlap, or 0.82 of the sequence ratio."""
    ratio = sequence_ratio(match_text(a), match_text(b)) * 0.82
    return F.coalesce(quick_similarity(a, b), F.greatest(token_overlap(a, b), F.round(ratio, 4)))


def edit_within_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def title_noise_free(c: Column) -> Column:
    """Brackets and tails from feat, with, prod, remix, version, remaster, official, lyrics, mv, ost on go; never to nothing."""
    t = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:feat|ft|with|prod|produced|remix|version|ver|remaster|remastered|official|lyrics?|mv|ost)\b.*$", " ")
    t = F.regexp_replace(spaces(t), r"^[ \-_/:|]+|[ \-_/:|]+$", "")
    return F.when(t == "", F.trim(c)).otherwise(t)


def search_artist(c: Column) -> Column:
    """The first of several artists."""
    first = F.get(F.split(strip_short_brackets(c, " "), r"(?i)\s*(?:feat\.?|ft\.?|with|,|&| x )\s*", 2), F.lit(0))
    return F.regexp_replace(spaces(first), r"^[ \-_/:|]+|[ \-_/:|]+$", "")


def artist_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?i)\s*(?:,|&| x |feat\.?|ft\.?)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def title_variants(c: Column, most: int = 4) -> Column:
    """Distinct spellings of a title to search by: as is, without brackets, trailing dots, symbols and noise."""
    t = spaces(c)
    short = F.length(match_key(t)) <= 2
    bare = spaces(F.regexp_replace(t, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " "))
    dots = spaces(F.regexp_replace(t, r"(?:\.\.\.|…)+$|\.+$", ""))
    calm = spaces(F.regexp_replace(t, r"[!\"'`~@#$%^&*_+=]+", " "))
    all_ = F.when(short, F.array(t, dots)).otherwise(F.array(t, bare, dots, calm, title_noise_free(t)))
    return F.slice(F.array_distinct(F.filter(all_, lambda x: x != "")), 1, most)


def track_uri(c: Column) -> Column:
    """A track URI from a URI, a web address (with or without a locale) or a bare id of 22 characters; else null."""
    found = F.regexp_extract(F.trim(c), r"^(?:spotify:track:|https?://open\.spotify\.com/(?:intl-[a-z]+/)?track/)?([A-Za-z0-9]{22})(?:[?/#].*)?$", 1)
    return F.when(found != "", F.concat(F.lit("spotify:track:"), found))


def join_names(c: Column) -> Column:
    """Names of an array of structs, by comma."""
    return F.array_join(F.filter(F.transform(c, lambda a: F.trim(a["name"])), lambda n: n != ""), ", ")


def line_format(c: Column) -> Column:
    """Emoji go, [m:ss] becomes m:ss, upright bars of other scripts become |."""
    c = F.regexp_replace(c, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", "")
    return F.translate(F.regexp_replace(c, rf"\[({TIME})\]", "$1"), "ㅣ｜", "||")


def mask_brackets(c: Column) -> Column:
    """What stands in brackets, and the brackets, as a private mark for each; unmask_brackets() puts them back."""
    spans = bracket_spans(c)
    return F.aggregate(F.transform(spans, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), c, lambda acc, e: F.replace(acc, e.x, mark(e.i)))


def bracket_spans(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\})"), F.lit(1)))


def mark(i: Column) -> Column:
    return F.concat(F.lit("\ue000"), i.cast("string"), F.lit("\ue001"))


def unmask_brackets(c: Column, of: Column) -> Column:
    """c, a part of the masked text `of`, with its brackets again."""
    return F.aggregate(F.transform(bracket_spans(of), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), c, lambda acc, e: F.replace(acc, mark(e.i), e.x))


def match_id(title: Column, artist: Column) -> Column:
    return F.concat_ws("|||", F.lower(F.trim(title)), F.lower(F.trim(artist)))


def labelled(**parts: Column) -> Column:
    """Texts under their labels, blank ones left out."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"[{k.upper()}]\n"), F.trim(c))) for k, c in parts.items()])


def songs_json(c: Column) -> Column:
    """Songs of a JSON reply, fenced or not: an array of (artist, title, raw_line); empty if there is none."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "struct<songs:array<struct<artist:string,title:string,raw_line:string>>>")
    return F.coalesce(parsed["songs"], F.array().cast("array<struct<artist:string,title:string,raw_line:string>>"))


# predicates of lines


def has_separator(c: Column) -> Column:
    return c.rlike(any_of(L.SEPARATORS))


def not_music_pattern() -> str:
    """NOT_MUSIC as one pattern; what is bound to a line's start is tried there alone."""
    bound = [p.removeprefix(r"^\s*") for p in L.NOT_MUSIC if p.startswith(r"^\s*")]
    free = [p for p in L.NOT_MUSIC if not p.startswith(r"^\s*")]
    return rf"(?i)(?:^\s*(?:{'|'.join(bound)})|{'|'.join(free)})"


def not_music(c: Column) -> Column:
    return c.rlike(not_music_pattern())


def section_word(c: Column) -> Column:
    words = {w.lower() for w in L.SECTION_WORDS}
    # a word that holds another one needs no test; each test stops at the first byte that differs
    least = [w for w in sorted(words) if not any(o != w and o in w for o in words)]
    low = F.lower(c)
    return reduce(or_, [F.contains(low, F.lit(w)) for w in least])


def _hits(c: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(c, F.lit(w)).cast("int")
    return out


def playlist_title(c: Column) -> Column:
    """A playlist's own title rather than a song."""
    n, low = _hits(F.lower(c), L.PLAYLIST_WORDS), F.lower(c)
    wrapped = F.trim(c).rlike(r"^[\[({].{12,}[\])}]?$")
    words = F.size(F.split(F.trim(low), r"\s+"))
    return ((n >= 2) & (wrapped | (F.regexp_count(low, F.lit("/")) >= 2) | (words >= 10))) | (wrapped & (n >= 1) & (words >= 8))


def separator_of(c: Column) -> Column:
    """The first separator, in order of priority, that a text holds; null if none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(s)), F.lit(s)) for s in L.SEPARATORS])


def left_is_metadata(c: Column) -> Column:
    sep = separator_of(c)
    left = F.trim(F.left(c, F.position(sep, c) - 1))
    return F.coalesce(section_word(left) | (sep.isin(" — ", " – ") & left.rlike(r"(?i)^from\s+\S")), F.lit(False))


def sentence(c: Column) -> Column:
    """A sentence rather than a song: no separator, and hints, punctuation or length of one."""
    low = F.lower(c)
    words = F.size(F.split(F.trim(low), r"\s+"))
    marks = F.length(low) - F.length(F.translate(low, ".?,", ""))
    return ~has_separator(c) & ((_hits(low, L.SENTENCE_WORDS) >= 2) | ((marks >= 2) & (words >= 2)) | (words >= 8))


def with_valid(rows: DataFrame, line: str = "line", into: str = "valid") -> DataFrame:
    """rows with whether each line may hold a song (false for null); the cleaned line is computed once."""
    c = F.col(line)

    def good(n: Column) -> Column:
        bad = not_music(c) | not_music(n) | playlist_title(n) | (section_word(n) & ~has_separator(n)) | left_is_metadata(n) | sentence(n)
        return (F.length(F.trim(c)) >= 2) & (n != "") & ~bad

    # the lambda binds the cleaned line, so a filter that is pushed down carries its cleaning once
    return rows.withColumn(into, F.coalesce(F.get(F.transform(F.array(clean_text(c)), good), F.lit(0)), F.lit(False)))


def meaningful(c: Column) -> Column:
    """Not only punctuation, and digits alone only from three on."""
    t = clean_text(c)
    return F.coalesce((t != "") & ~t.rlike(rf"^[^{WORD}]+$") & (~t.rlike(r"^[\d\s]+$") | (F.length(F.regexp_replace(t, r"\s", "")) >= 3)), F.lit(False))


def track_prefix(c: Column) -> Column:
    """A track number that opens a title, as "12." or "b)"."""
    return F.nullif(F.trim(F.regexp_extract(c, r"^\s*((?:\d{1,3}|[A-Za-z])\s*[.)|])\s+", 1)), F.lit(""))


def without_track_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*(?:\d{1,3}|[A-Za-z])\s*[.)|]\s+", "")
