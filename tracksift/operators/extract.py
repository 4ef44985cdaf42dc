"""From texts to songs by rules or by a language model's landed reply, whichever the text calls for; other readings of the media beside it.

docs: doc_id, text. llm: doc_id, line_no, artist, title, raw_line, a table that a model's replies were landed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions import lexicon as L
from tracksift.functions import text as X
from tracksift.operators import context as C
from tracksift.operators import direction as D
from tracksift.operators import media as M
from tracksift.operators import songs as S
from tracksift.session import cut

#: Caps of what a model is shown.
MODEL_BLOCKS, MODEL_PAIRS = 20, 40


def clean_times() -> Column:
    """Lines with times that hold little else: rules read them well. Over signals()."""
    ts, lines = F.col("timestamp_count"), F.col("line_count")
    dense = (F.col("candidate_line_ratio") >= 0.6) & (F.col("pattern_count") <= ts + 1)
    return (ts >= 2) & (F.col("candidate_line_count") >= ts) & ((lines <= ts + 1) | dense)


def strong_delimiters() -> Column:
    return (F.col("pattern_count") >= 3) & (F.col("candidate_line_ratio") >= 0.6) & (F.col("timestamp_count") < 2)


def block_form() -> Column:
    """Times on lines of their own."""
    return F.col("bare_timestamp_count") >= 2


def rule_first() -> Column:
    return F.coalesce(clean_times() | strong_delimiters() | block_form(), F.lit(False))


def normalised(rows: DataFrame, key: str = "doc_id", hint: DataFrame | None = None, trusted: bool = False) -> DataFrame:
    """Songs that came from elsewhere (key, line_no, artist, title), cleaned and oriented like parsed ones; one row a song.

    A title that reads "title, artist" under no artist is parted; pairs vote on the direction of their document, unless
    trusted; a missing artist gets the document's single artist (hint: key, artist) as artist_hint; rows whose title
    says nothing go.
    """
    own = S.comma_artist(rows.withColumns({"artist": X.blank_to_null(X.clean_text(F.col("artist"))), "title": X.blank_to_null(X.clean_text(F.col("title")))}))
    if not trusted:
        voted = D.with_votes(own.withColumns({"left": F.col("artist"), "right": F.col("title")}))
        w = Window.partitionBy(key)
        n = lambda v: F.sum(F.when(F.col("vote") == v, 1).otherwise(0)).over(w)
        voted = voted.withColumns({"_at": n("artist_title"), "_ta": n("title_artist")})
        _, direction, _ = D.direction_of(F.col("_at"), F.col("_ta"))
        artist, title = D.orient(F.col("left"), F.col("right"), direction, F.col("vote"))
        both = F.col("left").isNotNull() & F.col("right").isNotNull()
        own = voted.withColumns({"artist": F.when(both, artist).otherwise(F.col("left")), "title": F.when(both, title).otherwise(F.col("right"))}).select(*own.columns)
    own = own.withColumns({"artist": X.blank_to_null(X.clean_text(F.col("artist"))), "title": X.blank_to_null(X.clean_side(F.col("title")))})
    if hint is not None:
        own = own.join(hint.select(F.col(key).alias("_of"), F.col("artist").alias("_hint")), F.col(key) == F.col("_of"), "left")
        own = own.withColumn("artist_hint", F.when(F.col("artist").isNull(), F.col("_hint"))).drop("_of", "_hint")
    return S.dedup_songs(S.with_completeness(own.where(X.meaningful(F.col("title")))), key)


def rule_parse(docs: DataFrame, key: str = "doc_id", trusted: DataFrame | None = None) -> DataFrame:
    """Songs by rules: blocks of three lines where the whole text has that form, else line by line; with evidence and confidence."""
    lines = S.lines_of(docs, key)
    blocks = S.three_line_blocks(lines, key)
    block_docs = blocks.select(F.col(key).alias("_of")).distinct()
    others = lines.join(block_docs, lines[key] == block_docs["_of"], "left_anti")
    by_line = S.songs(S.parsed(others, key), key, trusted).select(key, "line_no", "timestamp", "artist", "title")
    by_block = blocks.select(key, (F.col("block") * 3).cast("int").alias("line_no"), "timestamp", X.blank_to_null(X.clean_side(F.col("artist"))).alias("artist"), X.blank_to_null(X.clean_side(F.col("title"))).alias("title"))
    return S.dedup_songs(S.with_completeness(by_line.unionByName(by_block).repartition(key, "line_no")), key)


def with_title_only(rows: DataFrame) -> DataFrame:
    """A song that has only an artist side is a title; evidence_type says what its line shows."""
    alone = F.col("title").isNull() & F.col("artist").isNotNull()
    kind = F.when(alone | F.col("artist").isNull(), F.when(F.col("timestamp").isNotNull(), "title_only_timestamp").otherwise("title_only")).when(F.col("timestamp").isNotNull(), "timestamp_pair").otherwise("delimiter_pair")
    return rows.withColumns({"title": F.when(alone, F.col("artist")).otherwise(F.col("title")), "artist": F.when(~alone, F.col("artist")), "evidence_type": kind})


def extract(docs: DataFrame, llm: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(songs with method, verdicts with method and rule_first) of each document.

    Where rules read a text well they come first and the model's reply is what they fall back on; elsewhere the reply
    comes first, and rules then take the artist to stand first. A reply counts if its lines stand in the text and its
    songs pass the verdict.
    """
    signal = S.signals(docs, key)
    route = docs.select(key).distinct().join(signal.select(key, rule_first().alias("rule_first")), key, "left").withColumn("rule_first", F.coalesce("rule_first", F.lit(False)))
    # both tables are read several times below, and are small against the texts
    route = cut(route, "routes")
    rule = cut(rule_parse(docs, key, route.where("not rule_first")), "rules")
    verdict = S.validity(docs, S.song_metrics(rule, key), signal, key).join(route, key)
    if llm is None:
        out = verdict.withColumn("method", F.lit("rule_based"))
        return with_title_only(rule).withColumn("method", F.lit("rule_based")), out
    given = cut(normalised(S.grounded(llm, docs, key).select(key, "line_no", F.lit(None).cast("string").alias("timestamp"), "artist", "title"), key, trusted=True), "replies")
    model = S.validity(docs, S.song_metrics(given, key), signal, key).select(key, F.col("success").alias("model_ok"))
    chosen = verdict.join(model, key)
    method = F.when(F.col("rule_first") & F.col("success"), "rule_based").when(F.col("model_ok"), "llm").otherwise("rule_based")
    # a reply that stands is a success, whatever the rules found
    chosen = chosen.withColumn("method", method).withColumn("success", F.col("success") | (F.col("method") == "llm"))
    rows = rule.select(key, "line_no", "timestamp", "artist", "title", F.lit("rule_based").alias("method")).unionByName(given.select(key, "line_no", "timestamp", "artist", "title", F.lit("llm").alias("method"))).repartition(key, "line_no")
    return with_title_only(rows.join(chosen.select(key, "method"), [key, "method"], "left_semi")), chosen.drop("model_ok")


def model_input(docs: DataFrame, key: str = "doc_id", most: int = MODEL_BLOCKS) -> DataFrame:
    """The first `most` blocks (what blank lines part) of each text, for a model to read."""
    part = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    return docs.select(key, F.posexplode(F.slice(part, 1, most)).alias("block_no", "block"))


def model_direction(pairs: DataFrame, replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's direction by a model's landed reply (key, direction, confidence) where that is one of the known values, else by votes."""
    known = replies.select(key, F.lower(F.trim("direction")).alias("_d"), F.lower(F.trim("confidence")).alias("_c")).where(F.col("_d").isin("artist_title", "title_artist", "per_line"))
    own = D.document_votes(pairs, key).join(known, key, "left")
    level = F.when(F.col("_c").isin("high", "medium", "low"), F.col("_c")).otherwise("low")
    return own.withColumns({"source": F.when(F.col("_d").isNotNull(), "llm").otherwise("rule"), "direction": F.coalesce("_d", "direction"), "confidence": F.when(F.col("_d").isNotNull(), level).otherwise(F.col("confidence"))}).drop("_d", "_c")


def mode(c: Column) -> Column:
    """text, ocr or acr by a mode's names; text for others."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit("text")
    for name, to in L.MODE_ALIASES.items():
        out = F.when(low == name, to).otherwise(out)
    return out


def confidence(c: Column) -> Column:
    """high, medium or low; medium for others."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


def playlist_name(given: Column, title: Column, default: str = "playlist") -> Column:
    return F.coalesce(X.blank_to_null(given), X.blank_to_null(title), F.lit(default))


def dispatch(jobs: DataFrame, docs: DataFrame, frames: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a job (key, mode): mode, success, failure_reason, by the reading that its mode asks for.

    Each reading runs on the jobs of its mode only. docs: key, text; frames: key, frame, line_no, line; hits: key,
    segment_index, score.
    """
    own = jobs.select(key, mode(F.col("mode")).alias("mode")).distinct()
    of = lambda m: own.where(F.col("mode") == m).select(key)
    text = extract(docs.join(of("text"), key, "left_semi"))[1].select(key, "success", "failure_reason")
    seen = M.ocr_run(frames.join(of("ocr"), key, "left_semi"), key).select(key, (F.col("failure_reason") == "").alias("success"), "failure_reason")
    heard = M.audio_run(hits.join(of("acr"), key, "left_semi"), key=key).select(key, "success", "failure_reason")
    found = text.withColumn("mode", F.lit("text")).unionByName(seen.withColumn("mode", F.lit("ocr"))).unionByName(heard.withColumn("mode", F.lit("acr")))
    missing = F.when(F.col("mode") == "ocr", "frame_selection_failed").when(F.col("mode") == "acr", "not_in_db").otherwise("too_short")
    return own.join(found, [key, "mode"], "left").select(key, "mode", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("failure_reason", missing).alias("failure_reason"))


#: What people are told when no song was found.
MESSAGES = {
    ("ocr", "frame_selection_failed"): "No frames could be read from the video.",
    ("ocr", "no_text_frame"): "No frame holds any text; the list may not be on the screen.",
    ("ocr", "low_quality_frame"): "The text on the screen is too short to read a list from.",
    ("ocr", "ocr_noise_too_high"): "Text was read, but it has not the form of a list.",
    ("acr", "not_in_db"): "The audio is not in the recognition catalogue.",
    ("acr", "short_segment"): "The audio is too short to recognise.",
    ("acr", "transition"): "Too many transitions to recognise the songs between them.",
    ("acr", "low_confidence_audio"): "The audio is not clear enough to recognise.",
}
OTHER = {"ocr": "No songs were found on the screen.", "acr": "No songs were recognised in the audio.", "text": "No songs were found in the description and the comments."}
GENERATED = "The music is machine-made and not in the catalogue."


def message(mode_: Column, why: Column, generated: Column, recommended: Column) -> Column:
    """What is said when a document gave no songs."""
    out = F.when(mode_ == "ocr", OTHER["ocr"]).when(mode_ == "acr", OTHER["acr"]).otherwise(OTHER["text"])
    for (m, w), said in MESSAGES.items():
        out = F.when((mode_ == m) & (why == w), said).otherwise(out)
    tried = F.concat(F.lit("No songs were found in the text; try "), recommended, F.lit("."))
    out = F.when((mode_ == "text") & (F.coalesce(recommended, F.lit("")) != ""), tried).otherwise(out)
    return F.when(F.coalesce(generated, F.lit(False)), GENERATED).otherwise(out)


def first_item(items: DataFrame, key: str = "playlist_id") -> DataFrame:
    """Each playlist's first item by position; playlists without items have none."""
    return items.where("item_id is not null").groupBy(key).agg(F.min_by("item_id", F.struct("position", "item_id")).alias("item_id"))


def with_evidence(rows: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (with raw_line) grounded in their document's lines: line_index, evidence_type, confidence."""
    return C.with_evidence_type(rows, S.lines_of(docs, key))
