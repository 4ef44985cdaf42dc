"""Mixing sources to target weights, by pivotal dependent rounding. DataFrame functions only.

A source's documents all want the same expected number of copies, target / source size. The whole part
is taken; the fractions are rounded together: two documents transfer words between their fractions at
random, without bias, until one fraction is 0 or 1, and the other goes on to the next. Words, not
counts, are conserved, so a source ends within one document of its target.

The reduction is a tree: documents of a source fall into groups of about GROUP by a hash (a hot source
has many), each group folds to one open document, the open documents form groups again, and so on.
Rows hold ids and sizes only; every level is written before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
GROUP = 64
SEED = 20_240_229


def size_of(text: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, from rows (source, size): one row a source, null among them.

    Weights go round WEIGHTS by code point order, null last. A source's target stops at MOST times its
    size and the excess is shared again by weight: with sources in the order of cap / weight, those before
    the level are full and the others get weight times the level.
    """
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (nth % len(WEIGHTS) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    whole = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = SHARE * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    own = own.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level that holds is that of the first source which isn't full
    first = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * first, F.col("cap")))
    return own.select("source", "source_size", target.alias("target"))


def uniform(*on: Column) -> Column:
    """A number in 0..1 (1 not reached) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *on), 11) / F.lit(float(1 << 53))


def _settle(open_: Column, new: Column, level: int) -> tuple[Column, Column]:
    """One step on two fractions: (decided, still open). Each is a struct id, th, nth, size, copies, part."""
    m1, m2 = open_.part * open_["size"], new.part * new["size"]
    up = F.least((1 - open_.part) * open_["size"], m2)  # words that may go from new to open
    down = F.least(m1, (1 - new.part) * new["size"])
    rise = uniform(open_["id"], open_["th"], open_["nth"], new["id"], new["th"], new["nth"], F.lit(level)) * (up + down) < down

    def at(x: Column, part: Column, more: Column | int = 0) -> Column:
        return F.struct(x["id"].alias("id"), x["th"].alias("th"), x["nth"].alias("nth"), x["size"].alias("size"), (x["copies"] + more).alias("copies"), part.alias("part"))

    zero = F.lit(0.0)
    one_up = (1 - open_.part) * open_["size"] <= m2  # rising, open is filled first
    one_down = m1 <= (1 - new.part) * new["size"]  # falling, open is emptied first
    left_up, left_down = (m2 - up) / new["size"], (m1 - down) / open_["size"]
    decided = F.when(rise & one_up, at(open_, zero, 1)).when(rise, at(new, zero)).when(one_down, at(open_, zero)).otherwise(at(new, zero, 1))
    rest = (
        F.when(rise & one_up, at(new, left_up)).when(rise, at(open_, open_.part + up / open_["size"])).when(one_down, at(new, new.part + down / new["size"])).otherwise(at(open_, left_down))
    )
    return decided, rest


def _fold(rows: DataFrame, groups: Column, level: int) -> DataFrame:
    """One level: source, decided (array), rest (the open one)."""
    item = F.struct("id", "th", "nth", "size", "copies", "part")
    listed = rows.groupBy("source", groups.alias("grp")).agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("by"), item.alias("x")))).alias("all"))
    none = F.slice(F.transform("all", lambda e: e.x), 1, 0)
    start = F.struct(F.col("all")[0].x.alias("rest"), none.alias("done"))

    def step(acc: Column, e: Column) -> Column:
        decided, rest = _settle(acc.rest, e.x, level)
        return F.struct(rest.alias("rest"), F.concat(acc.done, F.array(decided)).alias("done"))

    out = F.aggregate(F.slice("all", 2, 1 << 30), start, step)
    return listed.select("source", out.alias("o")).select("source", "o.done", "o.rest")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's id, size, source_size, target (its source's), copies, taken (size times copies).

    Null and blank texts have size 0 and taken 0; a source of such rows has target 0. A null source is a
    source, the last one. Rows that share an id count each; where they share the text too, which of them
    gets which copies is left open, the rows returned are the same. Reruns agree: all chance comes from
    hashes. An empty table gives no rows.
    """
    out = _planned(docs, id_col, text_col, source_col)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """mix()'s rows by (source, id, th), th being the text's hash."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    own = cut(own, "mix-sizes")
    goal = cut(targets(own.select("source", "size")), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = own.join(goal, own["source"].eqNullSafe(goal["source"]), "left").select("id", "th", own["source"], "size", "source_size", "target", ratio.alias("ratio"))
    # rows that share id and text are told apart by a number
    twin = Window.partitionBy("source", "id", "th").orderBy("ratio")
    whole = F.floor(F.col("ratio") + 1e-12)
    part = F.greatest(F.col("ratio") - whole, F.lit(0.0))
    rows = rows.withColumn("nth", F.row_number().over(twin)).withColumn("copies", whole.cast("long")).withColumn("part", F.when((part > 1e-12) & (F.col("size") > 0), part).otherwise(0.0))
    keep = ["source", "id", "th", "nth", "size", "copies", "part"]
    rows = cut(rows.select(*keep), "mix-rows")
    done = [rows.where("part = 0").select("source", "id", "th", "size", "copies")]
    now, level = rows.where("part > 0"), 0
    while True:
        count = now.groupBy("source").agg(F.count("*").alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        groups = F.pmod(F.xxhash64(F.lit(SEED + level), "id", "th", "nth"), F.ceil(F.col("n") / GROUP).cast("long"))
        dealt = now.join(count.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        folded = cut(_fold(dealt, groups, level), "mix-level")
        done.append(folded.select("source", F.explode("done").alias("x")).select("source", "x.id", "x.th", "x.size", "x.copies"))
        rest = folded.select("source", "rest.*")
        done.append(rest.where("part <= 1e-9 or part >= 1 - 1e-9").select("source", "id", "th", "size", (F.col("copies") + F.round("part").cast("long")).alias("copies")))
        now = rest.where("part > 1e-9 and part < 1 - 1e-9").select(*keep)
        level += 1
    last = F.when(uniform(F.col("id"), F.col("th"), F.col("nth"), F.lit(-1)) < F.col("part"), 1).otherwise(0)
    done.append(now.select("source", "id", "th", "size", (F.col("copies") + last).alias("copies")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    goal = goal.withColumnRenamed("source", "of")
    return out.join(goal, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it (0, 1 or 2 times).

    Rows of size 0 are taken once: they hold nothing that the mix could weigh. Of rows equal in id, text and
    source, which are alike for the mix, the first few by a hash of their other columns take the copies that are over.
    """
    plan = _planned(docs, id_col, text_col, source_col).where("size > 0")
    plan = plan.groupBy("source", "id", "th").agg(F.sum("copies").alias("all"), F.count("*").alias("n"))
    row, k = F.struct(*docs.columns).alias("row"), ("source", "id", "th")
    sized = docs.select(row, F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), size_of(text_col).alias("size"))
    same = [sized[c].eqNullSafe(plan[c]) for c in k]
    own = sized.join(plan, same[0] & same[1] & same[2], "left").select("row", *[sized[c] for c in k], "size", "all", "n")
    # a number only where rows are equal: one row a key needs none
    several = own.where("n > 1").withColumn("nth", F.row_number().over(Window.partitionBy(*k).orderBy(F.xxhash64("row"))))
    out = own.where("coalesce(n, 1) = 1").withColumn("nth", F.lit(1)).unionByName(several)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("all") / F.col("n")) + (F.col("nth") <= F.col("all") % F.col("n")).cast("int"))
    return out.select("row", copies.cast("int").alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("each")).select("row.*")
