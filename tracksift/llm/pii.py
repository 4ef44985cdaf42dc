"""PII surrogates: each detected entity gets a keyed replacement of its own type, format, script and gender.

An entity's characters fall into classes (digits, hex digits, vowels and consonants of a script and
case); the string of that pattern is a number below the product of the class sizes, and a keyed
Feistel permutation of that range gives the surrogate. So surrogates keep length, case, script and
separators, the same entity gets the same surrogate in every document (coreference), and different
entities of one pattern get different ones (distinctness). Given names of the lexicon become, one to one,
names of their gender from a second lexicon; a surname maps by itself, so "Mr Smith" follows "John Smith". Cards keep a valid check
digit and account numbers their check digits, addresses stay addresses.

Collision check: a surrogate must not be another real entity of the corpus. The distinct entities of all
documents are joined with their own surrogates; where one hits, the entity draws again from another
permutation until it meets neither a real entity nor another's surrogate. After MOST_TURNS draws the
range counts as full of real entities and the first surrogate stands. These few overrides are broadcast
up to MAX_OVERRIDES, and beyond that joined to the documents they occur in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksift.llm import words as W
from tracksift.session import cut, ship, unused

MAX_OVERRIDES = 100_000
MOST_TURNS = 40
KEY = b"tracksift surrogate key; pass another"

#: Fixed lexicon of given names by gender.
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Hans Peter Klaus Jürgen Stefan Wolfgang Pierre Jean Luc Michel Jacques Antoine José Juan Carlos Miguel Luis Javier Pedro Diego Ivan Sergei Dmitri".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily Anna Laura Emma Olivia Helen Julia Rachel Ursula Sabine Monika Petra Heike Claudia Marie Sophie Camille Claire Juliette Chantal María Carmen Ana Isabel Lucía Elena Pilar Rosa Olga Natalia Svetlana".split()
#: What given names become, of the same gender and as many: none of them is in the lexicon, so a surrogate is no other person's name.
TO_MALE = "Adrian Alfred Armin Arthur Axel Barnaby Bastian Bruno Cedric Clemens Conrad Cyril Damian Duncan Edgar Edmund Elias Felix Gideon Gregor Gustav Harold Hector Hugo Ivo Jasper Jonas Julius Kilian Leander Linus Lorenz Magnus Marius Nestor Oscar Otto Percy Quentin Rufus Silas Tobias Victor Walter Xaver Yann Zeno".split()
TO_FEMALE = "Adela Agatha Alma Astrid Beatrice Bianca Celia Clara Daphne Delia Dorothea Edith Eleonora Elvira Esther Felicia Flora Frieda Greta Hanna Hedwig Ida Irma Isolde Jana Josefa Judith Katja Leonie Lydia Magda Mathilda Mira Nadia Nora Ottilie Paula Regina Rita Ruth Selma Silvia Tamara Thea Ulrike Verena Wilma Yvonne Zita".split()
TITLES_M = "Mr Herr Monsieur Señor Sr".split()
TITLES_F = "Mrs Ms Miss Frau Madame Mme Señora Sra".split()
TITLES_N = "Dr Prof Doctor Professor".split()

_GIVEN = {**{n: "m" for n in MALE}, **{n: "f" for n in FEMALE}}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[\wа-яё]"
_ENTITY = re.compile(
    r"(?P<email>[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36}\b|\bsk-(?:[0-9A-Za-z]+[-_])*[0-9A-Za-z]{20,}\b|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b|(?<=password=)[^\s\"',;]{6,}|(?<=password: )[^\s\"',;]{6,}|(?<=passwd=)[^\s\"',;]{6,}|(?<=secret=)[^\s\"',;]{6,}|(?<=token=)[^\s\"',;]{6,}|(?<=api_key=)[^\s\"',;]{6,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])(?:\d[ -]?){12,18}\d(?![\d]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{8,14}(?!\w))"
)
_NAME = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES_M + TITLES_F + TITLES_N)})\b\.?[ \t]+)?(?P<given>(?:{'|'.join(_GIVEN)})\b(?:[ \t]+(?=[A-ZÀ-ÞА-Я]))?)?(?(title)(?P<last>{_CAP})?|(?(given)(?P<sur>{_CAP})|(?!)))")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in order, none inside another.

    A person is found by a title, by a given name of the lexicon with a surname, or by a phrase that introduces a
    name. Every other place in the text where a part of a found name stands as a word is the same person: mentions by
    the given name or the surname alone, before or after.
    """
    out = [(m.start(), m.end(), m.lastgroup) for m in _ENTITY.finditer(text)] if _HINT.search(text) else []
    if _CUE.search(text):
        taken = [(a, b) for a, b, _ in out]
        known: dict[str, str] = {}
        for m in _INTRODUCED.finditer(text):
            for part in ("first", "second"):
                if m[part] and m[part] not in _TITLES:
                    known[m[part]] = f"given_{_GIVEN[m[part]]}" if m[part] in _GIVEN else "surname"
        for m in _NAME.finditer(text):
            if m["given"]:
                g = m["given"].rstrip()
                out.append((m.start("given"), m.start("given") + len(g), f"given_{_GIVEN[g]}"))
            for part in ("last", "sur"):
                if m[part]:
                    kind = f"given_{_GIVEN[m[part]]}" if m[part] in _GIVEN else "surname"
                    out.append((m.start(part), m.end(part), kind))
        known |= {text[a:b]: kind for a, b, kind in out[len(taken) :]}
        if known:
            mention = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w|-\w|['’][A-Z])")
            out += [(m.start(), m.end(), known[m[0]]) for m in mention.finditer(text)]
        out.sort(key=lambda x: (x[0], -x[1]))
        # what was found first stands: an entity over a name in it, a longer name over a shorter one
        kept: list[tuple[int, int, str]] = []
        ends = 0
        spans = iter(taken)
        here = next(spans, None)
        for a, b, kind in out:
            while here and here[1] <= a:
                here = next(spans, None)
            if a < ends or (here and here[0] < b and (a, b) != here):
                continue
            kept.append((a, b, kind))
            ends = b
        return kept
    return out


_TITLES = {*TITLES_M, *TITLES_F, *TITLES_N}
#: Fixed phrases that introduce a name, and the one or two words of it.
INTRODUCTIONS = ["My name is", "my name is", "I am called", "Mein Name ist", "mein Name ist", "ich heiße", "Ich heiße", "Je m'appelle", "je m'appelle", "Mi nombre es", "mi nombre es", "me llamo", "Me llamo", "Dear", "Lieber", "Liebe", "Cher", "Chère", "Querido", "Querida"]
_INTRODUCED = re.compile(rf"\b(?:{'|'.join(INTRODUCTIONS)})[ \t]+(?P<first>{_CAP})(?:[ \t]+(?P<second>{_CAP}))?")

#: A text without any of these has no entity of _ENTITY; one without a cue has no name.
_HINT = re.compile(r"@|\d[\d. ()-]{5}|[0-9a-f]{32}|AKIA|gh[pousr]_|sk-|password|passwd|secret=|token=|api_key=|[A-Z]{2}\d{2}")
_CUE = re.compile(rf"\b(?:{'|'.join([*TITLES_M, *TITLES_F, *TITLES_N, *_GIVEN, *INTRODUCTIONS])})\b")

#: Fixed character classes; a character of none stays.
_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöüőűåæøœãõýÿ", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜŐŰÅÆØŒÃÕÝŸ", "çñßłńśźżćčďđěğřšşťžņ", "ÇÑŁŃŚŹŻĆČĎĐĚĞŘŠŞŤŽŅ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ")
_CLASS_OF = {c: k for k in _CLASSES for c in k}
_HEX = "0123456789abcdef"
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0..n - 1: a Feistel network over an even number of bits, walked until it falls below n."""
    if n < 2:
        return 0
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    size = (half + 7) // 8 + 1
    while True:
        a, b = x >> half, x & mask
        for r in range(6):
            d = hashlib.blake2b(bytes([r]) + b.to_bytes(size, "little"), key=key[:64], person=tweak[:16], digest_size=min(64, size + 8)).digest()
            a, b = b, a ^ int.from_bytes(d, "little") & mask
        x = a << half | b
        if x < n:
            return x


def by_pattern(text: str, classes: list[str | None], key: bytes, tweak: str) -> str:
    """The surrogate of a string whose characters are of the given classes (None stays)."""
    x, n = 0, 1
    for c, k in zip(text, classes, strict=True):
        if k:
            x, n = x * len(k) + k.index(c), n * len(k)
    shape = "".join(c if k is None else chr(ord("a") + len(k) % 26) for c, k in zip(text, classes, strict=True))
    x = permute(x, n, key, hashlib.blake2b(f"{tweak}|{shape}".encode(), digest_size=16).digest())
    out = []
    for c, k in zip(reversed(text), reversed(classes), strict=True):
        if k:
            x, r = divmod(x, len(k))
            c = k[r]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that ends these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def normal(kind: str, text: str) -> str:
    """What is the same entity: letters' case and separators apart, where the kind has none of its own."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", text)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", text)
    return text


@lru_cache(maxsize=200_000)
def once(kind: str, entity: str, key: bytes) -> str:
    """One step of the kind's permutation on a normal form."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2:-1] == ["example"] else 1
        head = ".".join(labels[:-keep])
        text = f"{local}@{head}"
        # the last labels stay: a reserved or real top level keeps the format
        return by_pattern(text, [_CLASS_OF.get(c) for c in text], key, kind + "." + ".".join(labels[-keep:])) + "." * bool(head) + ".".join(labels[-keep:])
    if kind == "ip":
        a, b, c, d = (int(x) for x in entity.split("."))
        x = permute(a << 24 | b << 16 | c << 8 | d, 1 << 32, key, b"ip")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        if luhn(entity[:-1]) == int(entity[-1]):
            body = entity[0] + by_pattern(entity[1:-1], ["0123456789"] * (len(entity) - 2), key, "card" + entity[0])
            return body + str(luhn(body))
        return by_pattern(entity, ["0123456789"] * len(entity), key, "number")
    if kind == "phone":
        # country and area stay, the last seven digits change
        head, tail = entity[:-7], entity[-7:]
        return head + by_pattern(tail, ["0123456789" if c.isdigit() else None for c in tail], key, kind + head)
    if kind == "iban":
        classes = ["0123456789" if c.isdigit() else _ALNUM[10:] for c in entity]
        if iban_check(entity[:2], entity[4:]) == entity[2:4]:
            body = by_pattern(entity[4:], classes[4:], key, kind + entity[:2])
            return entity[:2] + iban_check(entity[:2], body) + body
        return entity[:2] + by_pattern(entity[2:], classes[2:], key, "no " + kind + entity[:2])
    if kind == "secret":
        if entity.startswith("AKIA"):
            return "AKIA" + by_pattern(entity[4:], [_ALNUM] * (len(entity) - 4), key, "akia")
        if re.fullmatch(r"[0-9a-f]+", entity):
            return by_pattern(entity, [_HEX] * len(entity), key, "hex")
        head = re.match(r"gh[pousr]_|sk-|", entity)[0]
        return head + by_pattern(entity[len(head) :], [_CLASS_OF.get(c) for c in entity[len(head) :]], key, kind + head)
    if kind.startswith("given_"):
        names, to = (MALE, TO_MALE) if kind == "given_m" else (FEMALE, TO_FEMALE)
        return to[permute(names.index(entity), len(names), key, kind.encode())]
    return by_pattern(entity, [_CLASS_OF.get(c) for c in entity], key, kind)


def formatted(kind: str, text: str, surrogate: str) -> str:
    """A surrogate's normal form in the written form of the entity it replaces."""
    if kind == "email":
        return surrogate.upper() if text.isupper() else surrogate
    if kind in ("card", "iban", "phone"):
        chars = iter(surrogate)
        return "".join(c if c in " -.()" else next(chars) for c in text)
    return surrogate


def rewrite(text: str, key: bytes, overrides: dict[tuple[str, str], str]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced, in order."""
    at, out, kinds = 0, [], []
    for a, b, kind in find(text):
        n = normal(kind, text[a:b])
        s = overrides.get((kind, n)) or once(kind, n, key)
        out += [text[at:a], formatted(kind, text[a:b], s)]
        kinds.append(kind)
        at = b
    return "".join([*out, text[at:]]), kinds


def _entities(own: DataFrame, key: bytes, with_id: bool) -> DataFrame:
    """Entities of each task's rows, once each (with their rows' ids, if asked for): [id,] kind, entity, surrogate."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for i, t in zip(ids, batch.column(1), strict=True):
                t = t.as_py() or ""
                for a, b, kind in find(t):
                    e = (i if with_id else 0, kind, normal(kind, t[a:b]))
                    if e not in seen:
                        if len(seen) < 500_000:
                            seen.add(e)
                        rows.append(e)
            if rows:
                i, k, e = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(i, pa.int64()), pa.array(k), pa.array(e), pa.array([once(x, y, key) for x, y in zip(k, e, strict=True)])], ["id", "kind", "entity", "surrogate"])

    return own.mapInArrow(scan, "id long, kind string, entity string, surrogate string")


def overrides_of(own: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, surrogate of the entities whose first surrogate is itself a real entity."""
    spark = own.sparkSession
    # given names become names outside their lexicon, so they never meet one that is found: they aren't checked
    real = cut(_entities(own, key, False).where("kind not like 'given%'").groupBy("kind", "entity").agg(F.first("surrogate").alias("surrogate")), "pii-entities")
    def same(other: DataFrame) -> tuple[DataFrame, F.Column]:
        return other, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s"))

    names = real.select(F.col("kind").alias("k"), F.col("entity").alias("s"))
    open_ = real.join(*same(names), "left_semi")
    taken = real.join(*same(names), "left_anti").select(F.col("kind").alias("k"), F.col("surrogate").alias("s"))
    out = spark.createDataFrame([], real.schema)
    for turn in range(1, MOST_TURNS):
        new_key = hashlib.blake2b(turn.to_bytes(4, "little"), key=key[:64]).digest()

        def again(batches: Iterator[pa.RecordBatch], new_key=new_key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([once(k, e, new_key) for k, e in pairs], pa.string())], ["kind", "entity", "surrogate"])

        open_ = cut(open_.select("kind", "entity", "surrogate"), "pii-open")
        if open_.isEmpty():
            return out
        drawn = cut(open_.mapInArrow(again, real.schema), "pii-drawn")
        # one permutation doesn't meet itself, so only real entities and earlier surrogates are in the way
        free = cut(drawn.join(*same(names), "left_anti").join(*same(taken), "left_anti"), "pii-free")
        out = out.unionByName(free)
        taken = taken.unionByName(free.select(F.col("kind").alias("k"), F.col("surrogate").alias("s")))
        open_ = drawn.join(free.select("kind", "entity"), ["kind", "entity"], "left_anti")
    return out


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """docs with surrogates in the text, and n_entities and kinds (distinct, sorted).

    Every other column and row stays, rows that repeat too; a null text stays null with 0 entities. Ids
    play a part only beyond MAX_OVERRIDES, where null ids can't be told apart and share their overrides.
    Columns named n_entities or kinds are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).alias("text"))
    over = cut(overrides_of(own, key), "pii-overrides")
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    at, extra, key_col = names.index(text_col), unused(docs, "over"), unused(docs, "of")
    small = over.limit(MAX_OVERRIDES + 1).count() <= MAX_OVERRIDES
    if small:
        table = spark.sparkContext.broadcast({(r.kind, r.entity): r.surrogate for r in over.collect()})
        joined = docs.select(*names, F.lit(None).cast("array<struct<kind:string,entity:string,surrogate:string>>").alias(extra))
    else:
        table = spark.sparkContext.broadcast({})
        held = _entities(own, key, True).join(over.withColumnRenamed("surrogate", "to"), ["kind", "entity"])
        held = held.groupBy(F.col("id").alias(key_col)).agg(F.collect_set(F.struct("kind", "entity", F.col("to").alias("surrogate"))).alias(extra))
        joined = docs.join(held, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)) == held[key_col], "left").select(*[docs[c] for c in names], held[extra])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in W.blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts, counts, kinds = part.column(at).to_pylist(), np.zeros(hi - lo, np.int64), []
                for i, (t, o) in enumerate(zip(texts, part.column(len(names)).to_pylist(), strict=True)):
                    found: list[str] = []
                    if t:
                        texts[i], found = rewrite(t, key, {(x["kind"], x["entity"]): x["surrogate"] for x in o} if o else table.value)
                    counts[i] = len(found)
                    kinds.append(sorted(set(found)))
                cols = part.columns[: len(names)]
                cols[at] = pa.array(texts, pa.string())
                yield pa.record_batch([*cols, pa.array(counts), pa.array(kinds, pa.list_(pa.string()))], [*names, "n_entities", "kinds"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1]), "n_entities long, kinds array<string>"])
    return joined.mapInArrow(scan, schema)
