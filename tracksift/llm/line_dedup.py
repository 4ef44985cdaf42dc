"""Line dedup: a suffix array over line ids by distributed prefix doubling. DataFrame functions only.

Every line is an id (its hash) and every document a sequence of ids; a suffix runs from a line to its
document's end. Doubling ranks suffixes by their first 1, 2, 4, ... lines: the rank by 2h lines is the rank
of the pair (rank by h here, rank by h at h lines on). Distinct pairs are counted first and only they are
sorted, by range over all partitions, so neither a hot line nor a large group of copies meets in one
task; a suffix whose prefix no other shares has its final place and leaves the rounds.

An interval of the suffix array whose longest common prefixes have m lines or more is a class of equal
ranks by m lines: its first member stays whole, in the order of documents and lines, and the m lines of every other
member are a later copy. Later copies, less lines that some first member needs, make up the maximal runs, which are
deleted: of "A A A" the first "A A" stays, and a run that stands in full for the first time keeps all its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksift.session import cut, unused

MIN_LINES = 2
_DOC = ("doc", "th")
_AT = (*_DOC, "no")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, th (hash of the text), no, h1, h2: the lines of each distinct row."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n", -1).alias("ls"))
    each = own.select(*_DOC, F.posexplode("ls").alias("no", "line"))
    # rows that repeat are one document
    return each.select(*_AT, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).distinct()


def _ranked(suffixes: DataFrame, *by: str) -> DataFrame:
    """Suffixes whose key another shares, with the key's rank: an ascending number, in the order of keys."""
    classes = suffixes.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    classes = classes.sort(*by).withColumn("rank", F.monotonically_increasing_id())
    classes = cut(classes, "suffix-ranks")  # numbers are drawn once
    return suffixes.join(classes, list(by)).select(*_AT, "rank")


def shared_prefixes(all_lines: DataFrame, depth: int) -> DataFrame:
    """Suffixes that share their first `depth` lines with another (doc, th, no, rank), ranked by those lines.

    depth 0 doubles on until every suffix has a place of its own, and gives the last round's ties before that.
    """
    now, h = cut(_ranked(all_lines, "h1", "h2"), "suffix"), 1
    while h < depth or depth == 0:
        step = min(h, depth - h) if depth else h
        on = now.select(*_DOC, (F.col("no") - step).alias("no"), F.col("rank").alias("next"))
        # a null document id is an id like others
        pairs = now.alias("a").join(on.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.no") == F.col("b.no")))
        pairs = pairs.select("a.doc", "a.th", "a.no", F.col("a.rank").alias("r"), "b.next")
        new = cut(_ranked(pairs, "r", "next"), "suffix")
        if depth == 0 and new.isEmpty():
            break
        now, h = new, h + step
    return now


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """doc, th, start, end, n_lines: the maximal runs (lines counted from 0, end included) that are deleted."""
    ranked = shared_prefixes(lines(docs, id_col, text_col), min_lines)
    # first member of each class: map-side minima, so a hot class is no hot task
    order = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "th", "no")
    first = ranked.groupBy("rank").agg(F.min(order).alias("f"))
    known = ranked.join(first, "rank")
    is_first = F.col("f.doc").eqNullSafe(F.col("doc")) & (F.col("f.th") == F.col("th")) & (F.col("f.no") == F.col("no"))
    # lines of later members, but for those that a first member of some class needs to stay whole
    each = known.select(*_DOC, is_first.alias("stays"), F.explode(F.sequence("no", F.col("no") + min_lines - 1)).alias("no"))
    gone = each.groupBy(*_AT).agg(F.bool_or("stays").alias("stays")).where("not stays")
    run = F.col("no") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("no"))
    runs = gone.withColumn("run", run).groupBy(*_DOC, "run").agg(F.min("no").alias("start"), F.max("no").alias("end"))
    return runs.select(*_DOC, "start", "end", (F.col("end") - F.col("start") + 1).alias("n_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with later copies of runs of min_lines lines or more deleted, and n_lines (before), n_removed.

    Documents stand in the order of ids (null first), equal ids by a hash of the text; lines are what
    newlines part, blank ones among them, and count as equal if all bytes are. Rows equal in id and text
    are one document and get one result. A null text stays null, with 0 lines; a text may become empty.
    Columns named n_lines or n_removed are replaced. An empty table gives no rows.
    """
    spans, lost = unused(docs, "runs"), unused(docs, "lost")
    runs = later_copies(docs, id_col, text_col, min_lines).groupBy(*_DOC).agg(F.collect_list(F.struct("start", "end")).alias(spans), F.sum("n_lines").alias(lost))
    runs = cut(runs, "line-runs")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # runs grow with the documents: never broadcast
    joined = docs.join(runs.hint("merge"), docs[id_col].cast("long").eqNullSafe(runs["doc"]) & (F.xxhash64(docs[text_col]) == runs["th"]), "left")
    split = F.split(docs[text_col], "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.exists(runs[spans], lambda r: (i >= r["start"]) & (i <= r["end"])))
    text = F.when(runs[spans].isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else docs[c] for c in names]
    count = F.when(docs[text_col].isNull(), 0).otherwise(F.size(split))
    return joined.select(*columns, count.cast("long").alias("n_lines"), F.coalesce(runs[lost], F.lit(0)).cast("long").alias("n_removed"))
