"""Hangul in Latin letters by the revised rules: syllables are taken apart into their letters, and neighbours change each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The revised romanisation of first, middle and last letters, in Unicode's order of jamo.
FIRST = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
MIDDLE = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
LAST = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
# Fixed values. Last letters before a vowel, where they are read as the next syllable's first.
CARRIED = ["", "g", "kk", "ks", "n", "nj", "n", "d", "r", "lg", "lm", "lb", "ls", "lt", "lp", "r", "m", "b", "ps", "s", "ss", "ng", "j", "ch", "k", "t", "p", ""]
# Fixed values. What last sounds become before n or m.
NASAL = {"k": "ng", "t": "n", "p": "m"}

_BASE, _FIRSTS, _MIDDLES, _LASTS = 0xAC00, 19, 21, 28
_N, _R, _M, _SILENT = 2, 5, 6, 11


def _letter(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)


def _nasal(sound: Column) -> Column:
    out = sound
    for k, v in NASAL.items():
        out = F.when(sound == k, v).otherwise(out)
    return out


def _jamo(ch: Column) -> tuple[Column, Column, Column]:
    """First, middle and last letter of a syllable, by number; nulls for any other character."""
    code = F.ascii(ch) - _BASE
    inside = (ch != "") & (code >= 0) & (code < _FIRSTS * _MIDDLES * _LASTS)
    n = lambda x: F.when(inside, F.floor(x).cast("int"))
    return n(code / (_MIDDLES * _LASTS)), n(code % (_MIDDLES * _LASTS) / _LASTS), n(code % _LASTS)


def romanised(c: Column) -> Column:
    """A name with each Hangul syllable in Latin letters; other characters stay. Null stays null."""

    def one(i: Column) -> Column:
        ch = F.substring(c, i, F.lit(1))
        first, middle, last = _jamo(ch)
        before = F.coalesce(_letter(LAST, _jamo(F.when(i > 1, F.substring(c, i - 1, F.lit(1))))[2]), F.lit(""))
        after = F.coalesce(_jamo(F.substring(c, i + 1, F.lit(1)))[0], F.lit(-1))
        # the first letter, by what came before it
        opening = (
            F.when((first == _R) & before.isin("l", "n"), "l").when((first == _R) & (before != ""), "n")
            .when((first == _N) & (before == "l"), "l").otherwise(_letter(FIRST, first))
        )
        # the last letter, by what comes after it
        sound = _letter(LAST, last)
        closing = (
            F.when(after == _SILENT, _letter(CARRIED, last)).when(after.isin(_N, _M), _nasal(sound))
            .when((after == _R) & (sound == "n"), "l").when(after == _R, _nasal(sound)).otherwise(sound)
        )
        return F.when(first.isNull(), ch).otherwise(F.concat(opening, _letter(MIDDLE, middle), closing))

    places = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).when(c.isNotNull(), F.array().cast("array<int>"))
    return F.array_join(F.transform(places, one), "")


def name_spellings(c: Column) -> Column:
    """How a Hangul name may be written: in one word, with the family name first, and with it last (the family name being one syllable)."""
    t = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    family, given = romanised(F.substring(t, 1, 1)), romanised(F.substring(t, F.lit(2), F.length(t)))
    both = F.filter(F.array(romanised(t), F.concat_ws(" ", family, given), F.concat_ws(" ", given, family)), lambda x: F.trim(x) != "")
    return F.when(c.isNotNull(), F.array_distinct(both))
