"""Landed media tables: sampling plans, OCR frames, audio hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X

#: Segments of ten seconds, interval bounds, least score of a hit.
SEGMENTS, INTERVAL, HIT_SCORE = 30, (30, 180), 60
BLANK_SIGMA = 12
DELIMITER = r"\s[-–—|/:~]\s"
STANDALONE = rf"^\s*{X.TIME}\s*$"


def audio_plan(media: DataFrame, key: str = "doc_id", duration: str = "duration_s") -> DataFrame:
    """segment, start_s: up to SEGMENTS starts at an interval of a thirtieth of the length, within bounds."""
    step = F.greatest(F.lit(INTERVAL[0]), F.least(F.lit(INTERVAL[1]), F.ceil(F.col(duration) / SEGMENTS).cast("int")))
    own = media.select(key, F.col(duration).alias("d"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("segment"))
    return own.withColumn("start_s", (F.col("segment") * F.col("step")).cast("int")).where("start_s < d").select(key, "segment", "start_s")


def blank(sigma: Column) -> Column:
    """A frame whose grey levels hardly vary holds no text; an unknown spread counts as some."""
    return F.coalesce(sigma < BLANK_SIGMA, F.lit(False))


def frame_plan(media: DataFrame, every: int = 40, key: str = "doc_id", duration: str = "duration_s", cuts: DataFrame | None = None) -> DataFrame:
    """Distinct seconds to read: every `every`, each 15 in the first and last 90, and the scene cuts (key, second) within the length.

    With cuts, rows of one key are planned together. Lengths and cuts are exchanged, not the seconds, which are many more.
    """
    seq = lambda a, b, s: F.sequence(a, F.greatest(a, b), F.lit(s))
    top = lambda d: F.greatest(d - 1, F.lit(0))
    tail = lambda d: seq(F.greatest(d - 90, F.lit(0)), top(d), 15)
    plan = lambda d: F.concat(seq(F.lit(0), top(d), every), seq(F.lit(0), F.least(top(d), F.lit(90)), 15), tail(d))
    if cuts is None:
        return media.select(key, F.explode(F.array_distinct(plan(F.col(duration)))).alias("second"))
    # an unknown length has second 0 alone, as the length 0 has
    own = media.select(key, F.coalesce(F.col(duration), F.lit(0)).alias("length"))
    own = own.unionByName(cuts.where(F.col(key).isNotNull() & (F.col("second") >= 0)).select(key, "second"), allowMissingColumns=True)
    own = own.groupBy(key).agg(F.collect_set("length").alias("lengths"), F.collect_set("second").alias("cuts")).where(F.size("lengths") > 0)
    longest = F.array_max("lengths")
    inside = F.transform(F.filter("cuts", lambda s: s < longest), lambda s: s.cast("int"))
    # of a key's shorter lengths only the last seconds aren't those of the longest
    seconds = F.array_distinct(F.concat(plan(longest), F.flatten(F.transform("lengths", tail)), inside))
    # a column first: inside explode the array's functions would be interpreted
    return own.select(key, seconds.alias("seconds")).select(key, F.explode("seconds").alias("second"))


def broken(c: Column) -> Column:
    """Less than two characters, or less than 45 % letters and digits."""
    t = F.regexp_replace(c, r"\s", "")
    return (F.length(t) < 2) | (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(t), F.lit(1)) < 0.45)


def song_line(c: Column) -> Column:
    body = F.regexp_replace(c, rf"^\s*{X.TIME}\s+", "")
    left, right = F.get(F.split(body, DELIMITER, 2), F.lit(0)), F.get(F.split(body, DELIMITER, 2), F.lit(1))
    return F.coalesce(body.rlike(DELIMITER) & (F.length(body) <= 90) & ~broken(left) & ~broken(right), F.lit(False))


def song_runs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """start, n_lines of each document's longest run of song lines, the first on ties."""
    own = lines.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    hit = own.where(song_line(F.col("line"))).withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    runs = hit.groupBy(key, "run").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("start"))
    return runs.groupBy(key).agg(F.max(F.struct("n_lines", (-F.col("start")).alias("at"))).alias("t")).select(key, (-F.col("t.at")).alias("start"), F.col("t.n_lines").alias("n_lines"))


def frame_scores(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """score of each frame: 5 a time, 3 a delimiter and 4 a line of its song lines, 3 density, 4 consistency, less 1 for words of an overlay.

    The song lines that count are the longest run of them, the first on ties; if no two stand together, all. Density is the
    share of all song lines in n lines; blank lines and times that stand alone don't count. Columns: ts, delims, songs (those
    that count), n, consistency, overlay, score. One exchange, on the key.
    """
    own = lines.where((F.trim("line") != "") & ~F.col("line").rlike(STANDALONE))
    words = F.lower("line").rlike(X.any_of(L.FRAME_NOISE))
    own = own.select(key, "line_no", F.col("line").rlike(rf"^\s*{X.TIME}\s+").alias("timed"), F.col("line").rlike(DELIMITER).alias("pair"), song_line(F.col("line")).alias("hit"), words.alias("noise"))
    own = own.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    own = own.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(key, "hit").orderBy("line_no")))
    runs = own.groupBy(key, "hit", F.when(F.col("hit"), F.col("run")).alias("run")).agg(
        F.count("*").alias("n"), F.count_if("timed").alias("ts"), F.count_if("pair").alias("delims"), F.min("at").alias("start"), F.bool_or("noise").alias("noise")
    )
    of_hits = lambda c: F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0))
    longest = F.max(F.when(F.col("hit"), F.struct(F.col("n").alias("songs"), (-F.col("start")).alias("at"), "ts", "delims")))
    out = runs.groupBy(key).agg(longest.alias("b"), of_hits("n").alias("hits"), of_hits("ts").alias("all_ts"), of_hits("delims").alias("all_delims"), F.sum("n").alias("n"), F.bool_or("noise").alias("noise"))
    run = F.coalesce(F.col("b.songs") >= 2, F.lit(False))
    out = out.select(
        key, F.when(run, F.col("b.ts")).otherwise(F.col("all_ts")).alias("ts"), F.when(run, F.col("b.delims")).otherwise(F.col("all_delims")).alias("delims"),
        F.when(run, F.col("b.songs")).otherwise(F.col("hits")).alias("songs"), "hits", "n", F.when(F.col("noise"), 1.0).otherwise(0.0).alias("overlay"),
    )
    even = F.when(F.col("songs") > 0, F.round(0.45 * F.col("ts") / F.col("songs") + 0.55 * F.col("delims") / F.col("songs"), 4)).otherwise(0.0)
    out = out.withColumn("consistency", even)
    total = 5.0 * F.col("ts") + 3.0 * F.col("delims") + 4.0 * F.col("songs") + 3.0 * F.col("hits") / F.col("n") + 4.0 * F.col("consistency") - F.col("overlay")
    return out.withColumn("score", F.round(total, 4)).drop("hits")


def distinct_lines(frames: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of a document's frames (frame_index, line), stand-alone times dropped, each once in its first spelling."""
    own = frames.where((F.trim("line") != "") & ~F.col("line").rlike(rf"^\s*{X.TIME}\s*$")).withColumn("k", X.match_key(F.regexp_replace("line", rf"^\s*{X.TIME}\s+", "")))
    w = Window.partitionBy(key, "k").orderBy("frame_index", "line_no")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "k")


def recognition(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """segments, recognised (score above HIT_SCORE), rate (4 places) and the reason where it is low."""
    own = hits.groupBy(key).agg(F.count("*").alias("segments"), F.count_if(F.col("score") > HIT_SCORE).alias("recognised"))
    rate = F.round(F.col("recognised") / F.col("segments"), 4)
    return own.withColumn("rate", rate).withColumn("reason", F.when(rate == 0, "not_in_db").when(rate < 0.35, "transition").otherwise(""))


def representative(frames: DataFrame, key: str = "doc_id") -> DataFrame:
    """frame, score, songs of each document's best frame that holds a song line: the highest score, then song lines, the first on ties."""
    own = frames.where("songs > 0")
    best = own.groupBy(key).agg(F.max(F.struct("score", "songs", (-F.col("frame")).alias("at"))).alias("b"))
    return best.select(key, (-F.col("b.at")).alias("frame"), F.col("b.score").alias("score"), F.col("b.songs").alias("songs"))


def merged_text(lines: DataFrame, frames: DataFrame, key: str = "doc_id") -> DataFrame:
    """text: the song lines of frames that hold any, best frame first, each line once. lines: key, frame, line_no, line."""
    own = lines.where(song_line(F.col("line"))).join(frames.select(key, "frame", "score"), [key, "frame"]).withColumn("k", X.match_key(F.col("line")))
    best = Window.partitionBy(key, "k").orderBy(F.col("score").desc(), "frame", "line_no")
    kept = own.withColumn("n", F.row_number().over(best)).where("n = 1")
    item = F.struct((-F.col("score")).alias("by"), "frame", "line_no", F.trim("line").alias("line"))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.line), "\n").alias("text"))


def ocr_run(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document of read frames (key, frame, line_no, line): frames, frames_with_text, texts (different lines), text (merged, else all lines), best_frame, partial, failure_reason.

    Short texts and few lines make it partial; without song lines the reason says what was missing.
    """
    inked = F.trim(F.coalesce("line", F.lit(""))) != ""
    seen = lines.groupBy(key).agg(F.countDistinct("frame").alias("frames"), F.countDistinct(F.when(inked, F.col("frame"))).alias("frames_with_text"), F.countDistinct(F.when(inked, X.match_key(F.col("line")))).alias("texts"))
    whole = lines.where(inked).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "line_no", "line"))), lambda x: x.line), "\n").alias("all_text"))
    scores = frame_scores(lines.where(inked).withColumn("_f", F.struct(key, "frame")), "_f").select(F.col(f"_f.{key}").alias(key), F.col("_f.frame").alias("frame"), "score", "songs")
    scores = scores.where("songs > 0")
    best = representative(scores, key).select(key, F.col("frame").alias("best_frame"))
    out = seen.join(whole, key, "left").join(merged_text(lines.where(inked), scores, key), key, "left").join(best, key, "left")
    text = F.coalesce(F.nullif("text", F.lit("")), "all_text", F.lit(""))
    thin = (F.length(text) < 100) | (F.col("texts") < 3)
    found = F.col("best_frame").isNotNull()
    why = F.when(found, "").when(F.col("frames") <= 0, "frame_selection_failed").when(F.col("texts") <= 0, "no_text_frame").when(F.length(text) < 100, "low_quality_frame").otherwise("ocr_noise_too_high")
    return out.select(key, "frames", "frames_with_text", "texts", text.alias("text"), "best_frame", (found & thin).alias("partial"), why.alias("failure_reason"))


def audio_run(hits: DataFrame, media: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row a document: segments, recognised, rate, success, failure_reason. media (key, duration_s): those too short for a segment are short_segment."""
    own = recognition(hits, key)
    if media is not None:
        own = own.join(media.select(key, "duration_s"), key, "left").withColumn("reason", F.when((F.col("recognised") == 0) & (F.col("duration_s") < 10), "short_segment").otherwise(F.col("reason"))).drop("duration_s")
    return own.select(key, "segments", "recognised", "rate", (F.col("recognised") > 0).alias("success"), F.col("reason").alias("failure_reason"))


def merge_hits(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Equal songs (normal title and artist) of a document's hits: count, best score, segments in order."""
    own = hits.where(F.col("score") > HIT_SCORE).withColumn("k", F.concat_ws("|", X.match_key(F.col("title")), X.match_key(F.col("artist"))))
    return own.groupBy(key, "k").agg(F.min_by("title", "segment_index").alias("title"), F.min_by("artist", "segment_index").alias("artist"), F.count("*").alias("n"), F.max("score").alias("max_score"), F.array_sort(F.collect_set("segment_index")).alias("segments")).drop("k")
