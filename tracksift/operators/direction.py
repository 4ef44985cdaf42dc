"""Which side of a pair is the artist: likeness scores, a vote of all pairs of a document, orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X

DOMINANT, MARGIN = 0.65, 0.8


#: Features of a side, as columns named by side and feature, each level built on the columns of the one before.
_LEVELS = 4


def _alias_keys() -> list[str]:
    names = [n for k, v in L.ARTIST_ALIASES.items() for n in (k, *v)]
    return sorted({"".join(ch for ch in n.lower() if ch.isalnum()) for n in names})


def known_artists(spark: SparkSession, aliases: DataFrame | None = None) -> DataFrame:
    """alias_key of every artist that is known: the seed list, and a table of aliases (alias_key) where there is one."""
    groups = ["".join(ch for ch in g if ch.isalnum()) for g in L.KNOWN_GROUPS]
    seed = spark.createDataFrame([(k,) for k in sorted({*_alias_keys(), *groups})], "alias_key string")
    return seed if aliases is None else seed.union(aliases.select("alias_key")).distinct()


def _sum(*terms: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for cond, weight in terms:
        out = out + F.when(cond, weight).otherwise(0.0)
    return out


def _features(raw: Column, f: dict[str, Column], level: int) -> dict[str, Column]:
    """The features of one level from the columns of the levels below."""
    if level == 0:
        return {"clean": X.clean_text(raw)}
    clean = f["clean"]
    if level == 1:
        return {"cmp": X.spaces(F.regexp_replace(F.lower(clean), rf"[^{X.WORD}\s&.,'\-]", " "))}
    cmp_ = f["cmp"]
    padded = F.concat(F.lit(" "), cmp_, F.lit(" "))
    if level == 2:
        w = F.split(cmp_, " ")
        first, last = F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)
        connector = padded.rlike(X.any_of(L.ARTIST_CONNECTORS))
        one = cmp_.rlike(r"^[a-z][a-z0-9._-]{2,24}$") | cmp_.rlike(r"^[a-z][a-z0-9'._-]{1,24}$")
        verb = F.arrays_overlap(w, F.array(*[F.lit(v) for v in L.TITLE_VERBS]))
        several = cmp_.rlike(r"^[a-z0-9&.,'\- ]+$") & ~(first.isin(L.TITLE_FIRST_WORDS) | verb | last.isin(L.TITLE_LAST_WORDS))
        korean_name = clean.rlike("^[가-힣]{2,4}$")
        hints = clean.rlike(X.any_of(L.TITLE_HINTS_KO)) | clean.rlike(r"^([가-힣]{1,2})\1+$") | F.contains(clean, F.lit(" ")) | ((F.length(clean) >= 3) & ~korean_name)
        capital = r"[A-Z][A-Za-z0-9'.éèêëáàäâíìïîóòöôúùüûñ-]+[,.&]*"
        parts = F.filter(F.split(clean, r"\s*,\s*|\s*&\s+|\s+and\s+"), lambda x: F.trim(x) != "")
        phrase = lambda c: (F.size(F.split(c, " ")) <= 4) & (c.rlike(r"^[A-Z0-9.]{2,8}(?: [A-Z0-9.]{2,8})*$") | c.rlike(rf"^{capital}(?: {capital})*$"))
        noise = F.lit(0)
        for x in L.NOISE_WORDS:
            noise = noise + F.contains(cmp_, F.lit(x)).cast("int")
        return {
            "words": F.when(cmp_ == "", 0).otherwise(F.size(w)), "size": F.length(F.regexp_replace(clean, r"\s+", "")), "connector": connector, "known_group": cmp_.isin(L.KNOWN_GROUPS),
            "alias": F.regexp_replace(cmp_, rf"[^{X.WORD}]", "").isin(_alias_keys()), "korean_name": korean_name, "english_artist": (cmp_ != "") & (F.size(w) <= 3) & (connector | F.when(F.size(w) == 1, one).otherwise(several)),
            "korean_title": X.has_hangul(clean) & hints, "english_title": F.contains(cmp_, F.lit(" ")) | (F.length(cmp_) >= 4), "name_phrase": (clean != "") & phrase(clean), "name_list": (F.size(parts) >= 2) & F.forall(parts, phrase),
            "featured": cmp_.rlike("feat|ft|with"), "joined": padded.rlike(r" & | \+ | and | feat | ft | with "), "noise": noise,
            "glued": X.ascii_brackets(raw).rlike(r"[A-Za-z0-9]\([A-Za-z0-9]{1,12}\)|\([A-Za-z0-9]{1,12}\)[A-Za-z0-9]"), "hangul_short": F.replace(clean, F.lit(" "), F.lit("")).rlike("^[가-힣]+$") & F.length(clean).between(2, 5),
        }
    if level == 3:
        return {
            "artist_shape": (clean != "") & (f["connector"] | f["known_group"] | f["alias"] | f["korean_name"] | f["english_artist"] | f["hangul_short"]),
            "title_shape": (clean != "") & ~f["known_group"] & (clean.rlike(r"\(.*?\)") | f["korean_title"] | f["english_title"]),
            "strong": _sum((f["alias"], 3.0), (f["known_group"], 2.5), (f["glued"], 2.2)),
        }
    known = f["known_group"] | f["alias"]
    title_phrase = (f["words"] >= 2) | f["joined"] | (f["title_shape"] & ~known)
    short = (clean != "") & (F.length(clean) <= 32) & (f["words"] <= 4) & (f["title_shape"] | ((f["words"] <= 3) & ~f["connector"]))
    artist = _sum((f["artist_shape"], 1.0), (f["known_group"], 1.1), (f["korean_name"], 0.8), (f["english_artist"], 0.8), (f["alias"], 0.8), (f["connector"], 0.7), (f["title_shape"], -0.4)) - F.when(f["noise"] > 0, 0.4).otherwise(0.0)
    title = _sum((f["title_shape"], 1.0), (f["korean_title"], 0.8), (f["english_title"], 0.8), (f["known_group"], -1.0), (f["korean_name"], -0.5), (f["english_artist"], -0.5), (f["connector"], -0.4))
    evidence = _sum((title_phrase, 1.6), (f["korean_title"], 1.2), (f["english_title"], 1.0), (short, 0.8), (f["strong"] > 0, -1.8))
    return {"known": known, "title_phrase": title_phrase, "short_title": short, "artist_like": F.round(artist, 3), "title_like": F.round(title, 3), "title_evidence": evidence}


def with_features(rows: DataFrame, sides: dict[str, str], levels: int = 3) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """rows with the features of columns up to a level, and those features by side; sides name a prefix and a column each."""
    have: dict[str, dict[str, Column]] = {k: {} for k in sides}
    own = rows
    for level in range(levels + 1):
        new = {(k, n): c for k, raw in sides.items() for n, c in _features(F.col(raw), have[k], level).items()}
        own = own.withColumns({f"{k}_{n}": c for (k, n), c in new.items()})
        for k, n in new:
            have[k][n] = F.col(f"{k}_{n}")
    return own, have


def with_votes(rows: DataFrame, left: str = "left", right: str = "right", into: str = "vote") -> DataFrame:
    """rows with the vote of each pair: artist_title, title_artist or unknown; null where a side is null.

    Likeness and evidence of both sides are columns, each computed once, in levels.
    """
    own, have = with_features(rows, {"_l": left, "_r": right}, _LEVELS)
    a, b, raw_a, raw_b = have["_l"], have["_r"], F.col(left), F.col(right)
    signal = b["known"] | b["connector"]
    one = b["name_phrase"] & (b["words"] == 1) & ~b["connector"] & (a["title_evidence"] >= 1.2)
    probable = (b["name_list"] | signal | (b["name_phrase"] & (b["words"] >= 2)) | one) & (a["title_phrase"] | a["featured"] | a["title_shape"])
    own = own.withColumn("_probable", probable)
    name_like = a["english_artist"] | a["known"]
    short = a["size"].between(2, 5) & (b["size"] > a["size"]) & ((b["words"] >= 2) | b["joined"]) & ~b["connector"]
    guard = (
        F.when(F.col("_probable"), None).when(a["strong"] >= 2.5, "left_known_artist").when((b["strong"] >= 2.5) & (a["title_evidence"] >= 0.8), None)
        .when(raw_a.rlike("[&,]") & ~a["featured"], "left_has_connector").when((a["words"] >= 2) & b["short_title"] & name_like, "left_name_right_short_title")
        .when(short, "left_short_artist").when(a["short_title"] & b["english_artist"], None).when(b["title_phrase"] & ~b["known"], "right_title")
    )
    own = own.withColumn("guard", guard)
    normal, swapped = a["artist_like"] + b["title_like"], b["artist_like"] + a["title_like"]
    vote = (
        F.when(raw_a.isNull() | raw_b.isNull(), None).when(raw_a.rlike(r"^\s*\d+\s*\([^)]+\)") & b["english_artist"], "title_artist")
        .when(raw_b.rlike("^[A-Z0-9]{1,4}$") & X.has_hangul(raw_a) & (F.length(raw_a) >= 4), "artist_title").when(F.col("_probable"), "title_artist")
        .when(F.col("guard").isNotNull(), "artist_title").when(normal >= swapped + MARGIN, "artist_title").when(swapped >= normal + MARGIN, "title_artist").otherwise("unknown")
    )
    own = own.withColumn(into, vote)
    return own.select(*rows.columns, "guard", into)


def document_votes(pairs: DataFrame, key: str = "doc_id", voted: str = "vote") -> DataFrame:
    """Votes of each document: counts, share of the leader, direction (per_line if none leads) and confidence."""
    own = pairs.groupBy(key).agg(F.count_if(F.col(voted) == "artist_title").alias("artist_title"), F.count_if(F.col(voted) == "title_artist").alias("title_artist"))
    share, direction, sure = direction_of(F.col("artist_title"), F.col("title_artist"))
    return own.select(key, "artist_title", "title_artist", F.round(share, 4).alias("share"), direction.alias("direction"), sure.alias("confidence"))


def direction_of(artist_title: Column, title_artist: Column) -> tuple[Column, Column, Column]:
    """The leader's share of the votes, the direction and its confidence."""
    total = artist_title + title_artist
    share = F.when(total > 0, F.greatest(artist_title, title_artist) / total).otherwise(0.0)
    lead = share >= DOMINANT
    direction = F.when(lead & (artist_title / total >= DOMINANT), "artist_title").when(lead, "title_artist").otherwise("per_line")
    sure = F.when(~lead | (total == 0), "low").when((share >= 0.9) & (total >= 3), "high").when(total >= 2, "medium").otherwise("low")
    return share, direction, sure


def orient(left: Column, right: Column, direction: Column, own_vote: Column) -> tuple[Column, Column]:
    """(artist, title): the document's direction is forced; without one each line follows its own vote."""
    swap = (direction == "title_artist") | ((direction == "per_line") & (own_vote == "title_artist"))
    return F.when(swap, right).otherwise(left), F.when(swap, left).otherwise(right)
