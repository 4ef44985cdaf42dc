"""Ratings and the question board. ratings: id, score, comment, created_at. posts: id, title, category, status, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = 5


def invalid_reason() -> Column:
    """Why a rating is rejected; null if it stands."""
    s = F.col("score")
    return F.when(s.isNull() | ~s.between(1, 5) | (s != F.floor(s)), "score_out_of_range").when(F.length("comment") > 500, "comment_too_long")


def rating_stats(ratings: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: count, average (2 places), average of the last seven days up to now (by default the newest), comment rate (4 places). Empty: zeros and nulls."""
    last = ratings.agg(F.max("created_at").alias("last")) if now is None else ratings.sparkSession.range(1).select(now.alias("last"))
    own = ratings.crossJoin(F.broadcast(last))  # one row
    recent = F.col("created_at") >= F.col("last") - F.expr("INTERVAL 7 DAYS")
    has = F.coalesce(F.trim("comment"), F.lit("")) != ""
    return own.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("average"), F.round(F.avg(F.when(recent, F.col("score"))), 2).alias("recent_average"),
        F.coalesce(F.round(F.avg(has.cast("double")), 4), F.lit(0.0)).alias("comment_rate"), *[F.count_if(F.col("score") == k).alias(f"score_{k}") for k in range(1, 6)],
    )


def distribution(ratings: DataFrame) -> DataFrame:
    """score 1..5 and its count, zeros too."""
    one = ratings.agg(*[F.count_if(F.col("score") == k).alias(str(k)) for k in range(1, 6)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("score"), F.col(str(k)).alias("n")) for k in range(1, 6)])).alias("x")).select("x.*")


def board(posts: DataFrame, status: str | None = None, category: str | None = None, text: str | None = None, page: int = 1, size: int = PAGE) -> DataFrame:
    """A page of posts, newest first, filtered by status, category and a part of the title."""
    own = posts
    if status:
        own = own.where(F.col("status") == status)
    if category:
        own = own.where(F.col("category") == category)
    if text:
        own = own.where(F.contains(F.lower("title"), F.lit(text.lower())))
    return own.orderBy(F.col("created_at").desc(), "id").offset((page - 1) * size).limit(size)


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both by key, the greatest version of each."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return table.unionByName(changes).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Categories of posts; others count as the first.
CATEGORIES = ["question", "bug", "feature", "etc"]


def new_posts(raw: DataFrame, at: Column) -> DataFrame:
    """Posts as they are stored: trimmed fields, a known category, waiting; rows without title, content or author are left out."""
    own = raw.select("id", *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("title", "content", "author")], F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("category"))
    own = own.where("title <> '' and content <> '' and author <> ''")
    kind = F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise(CATEGORIES[0])
    return own.withColumns({"category": kind, "status": F.lit("waiting"), "answer": F.lit(None).cast("string"), "created_at": at, "updated_at": at})


def answered(posts: DataFrame, answers: DataFrame) -> DataFrame:
    """posts with the last answer (id, answer, at) to each; blank answers count for nothing."""
    last = answers.where(F.trim("answer") != "").groupBy("id").agg(F.max_by("answer", "at").alias("_answer"), F.max("at").alias("_at"))
    own = posts.join(last, "id", "left")
    hit = F.col("_answer").isNotNull()
    return own.withColumns({"answer": F.when(hit, F.trim("_answer")).otherwise(F.col("answer")), "status": F.when(hit, "answered").otherwise(F.col("status")), "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at"))}).drop("_answer", "_at")


def deleted(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """table without the rows of ids."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def expiry(issued_at: Column, expires_in: Column) -> Column:
    """When a token counts as expired: 90 seconds early, but not within the first minute."""
    return F.timestamp_add("second", F.greatest(F.lit(60), expires_in - 90), issued_at)


def pruned(table: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that haven't expired; rows without a time don't."""
    return table.where(F.col(expires).isNull() | (F.col(expires) > now))


def popped(states: DataFrame, asked: DataFrame, now: Column, key: str = "state") -> tuple[DataFrame, DataFrame]:
    """(the asked states that are still good, the table without any asked or expired one): a state is good once."""
    good = pruned(states, now)
    return good.join(asked.select(key).distinct(), key, "left_semi"), deleted(good, asked, key)


def json_safe(df: DataFrame) -> DataFrame:
    """One column, json: each row as JSON, with null for NaN and the infinities at any depth of structs and arrays."""
    return df.select(F.to_json(F.struct(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"}).alias("json"))


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    return c


def total(values: Column) -> Column:
    """The sum of a map's values; nulls count as 0."""
    return F.aggregate(F.map_values(values), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def client_counts(rows: DataFrame) -> DataFrame:
    """One row: selected, candidates, review, failed."""
    return rows.agg(F.count_if("selected").alias("selected"), F.count("*").alias("candidates"), F.count_if(F.col("match_status").isin("review_needed", "low_confidence")).alias("review"), F.count_if(F.col("match_status").isin("unmatched", "invalid_candidate")).alias("failed"))


def fill_artists(rows: DataFrame, key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """Unknown artists of a document filled with the one that half of its named rows have (the first by name on ties)."""
    named = rows.where("artist is not null and trim(artist) <> ''").groupBy(key, "artist").agg(F.count("*").alias("n"))
    top = named.groupBy(key).agg(F.sum("n").alias("all"), F.max("n").alias("best"), F.min_by("artist", F.struct((-F.col("n")).alias("n"), "artist")).alias("_top"))
    top = top.where(F.col("best") / F.col("all") >= share).select(key, "_top")
    return rows.join(top, key, "left").withColumn("artist", F.when(F.coalesce(F.trim("artist"), F.lit("")) == "", F.col("_top")).otherwise(F.col("artist"))).drop("_top")
