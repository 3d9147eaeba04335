"""Sections and chapters: cleaning, choice of a level, cuts at pages, and each unit's chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lectern import schemas
from lectern.functions import text as T

LEAST_UNITS, CHAPTERS, UNITS_EACH = 60, (2, 40), 3
PAGE_TARGET, CHAR_TARGET, CHAR_TAIL = 90, 26000, 3
LONG_TEXT, FEW_UNITS, LONG_CHAPTER = 40000, 120, 150
FRONT = "권두"


def clean(sections: DataFrame, sizes: DataFrame) -> DataFrame:
    """(work, i, lv, t): sections (work, i, lv, t) inside the work (sizes: work, n), the highest at each place. Two
    that start alike leave one, so none is empty."""
    s = sections.join(sizes, "work").where("i >= 0 and i < n")
    first = F.row_number().over(W.partitionBy("work", "i").orderBy("lv", *([c for c in ("ord",) if c in sections.columns]), "t"))
    return s.withColumn("_r", first).where("_r = 1").select("work", "i", "lv", "t")


def chapters(cleaned: DataFrame, sizes: DataFrame) -> DataFrame:
    """(work, i, lv, t): the sections of the highest level that gives 2 to 40 chapters of at least three units on
    average, with a front chapter at 0; none for works under 60 units."""
    s = cleaned.join(sizes, "work").where(F.col("n") >= LEAST_UNITS)
    per = s.groupBy("work", "n", "lv").agg(F.count("*").alias("k"))
    upto = per.withColumn("k", F.sum("k").over(W.partitionBy("work").orderBy("lv")))
    level = upto.where(F.col("k").between(*CHAPTERS) & (F.col("n") / F.col("k") >= UNITS_EACH)).groupBy("work").agg(F.min("lv").alias("level"))
    c = s.join(level, "work").where("lv <= level").select("work", "i", "lv", "t", "level")
    front = c.groupBy("work", "level").agg(F.min("i").alias("least")).where("least > 0").select("work", F.lit(0).cast("int").alias("i"), F.col("level").alias("lv"), F.lit(FRONT).alias("t"))
    return c.select("work", F.col("i").cast("int").alias("i"), "lv", "t").unionByName(front)


def volume_lines(units: DataFrame) -> DataFrame:
    """(work, i, lv, t): each unit's first volume title that no earlier unit was given (i from 0)."""
    lines = units.select("work", (F.col("i") - 1).alias("i"), F.posexplode("cn").alias("p", "t")).withColumn("t", F.trim("t"))
    lines = lines.where(F.regexp_like("t", F.lit(T.VOLUME_LINE)))
    # titles in order, each kept if it isn't among those kept: sequential, over a work's few titles
    listed = lines.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("i", "p", "t"))).alias("all"))
    keep = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<i:int,t:string>>)"),
        lambda a, x: F.when(F.exists(a, lambda y: (y["t"] == x["t"]) | (y["i"] == x["i"])), a).otherwise(F.concat(a, F.array(F.struct(x["i"].cast("int").alias("i"), x["t"].alias("t"))))),
    )
    return listed.select("work", F.explode(keep).alias("k")).select("work", "k.i", F.lit(1).alias("lv"), "k.t")


def _greedy(items, start, target: int):
    """Places at which the distance to the last cut reaches the target."""
    return F.aggregate(
        items,
        F.struct(start.alias("prev"), F.array().cast("array<int>").alias("out")),
        lambda a, b: F.when(b - a["prev"] >= target, F.struct(b.alias("prev"), F.concat(a["out"], F.array(b)).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )


def _without_tail(cuts, end, least: int):
    return F.when((F.size(cuts) > 0) & (end - F.element_at(cuts, -1) < least), F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0)))).otherwise(cuts)


def _within(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """units (work, at, ...) with the range (start, end) that each lies in, once for each of several. A work's ranges,
    few, go to its units as one array, so that units aren't multiplied by ranges first."""
    r = ranges.groupBy("work").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("_ranges"))
    u = units.join(r, "work")
    u = u.withColumn("_r", F.explode(F.filter("_ranges", lambda x: (F.col("at") >= x["start"]) & (F.col("at") < x["end"]))))
    return u.select(*units.columns, "_r.start", "_r.end")


def page_cuts(units: DataFrame, ranges: DataFrame, target: int = PAGE_TARGET) -> DataFrame:
    """(work, start, end, cuts) for ranges (work, start, end) of units (i from 1): places where the page changes, each
    at least `target` units after the last; a short tail is left with what comes before."""
    u = units.select("work", (F.col("i") - 1).cast("int").alias("at"), "m").where("m is not null")
    u = _within(u, ranges).withColumn("page", T.page_of(F.col("m")))
    w = W.partitionBy("work", "start", "end").orderBy("at")
    breaks = u.withColumn("prev", F.lag("page").over(w)).where("prev is not null and prev != page")
    g = breaks.groupBy("work", "start", "end").agg(F.array_sort(F.collect_list("at")).alias("b"))
    g = g.withColumn("cuts", _greedy(F.col("b"), F.col("start"), target))
    return g.select("work", "start", "end", _without_tail(F.col("cuts"), F.col("end"), target // 2).alias("cuts"))


def char_cuts(units: DataFrame, target: int = CHAR_TARGET) -> DataFrame:
    """(work, cuts): places where the page changes once `target` characters have been passed since the last cut.
    units: work, i (from 1), m, n (characters). Sequential by nature: a fold over a work's units."""
    g = units.groupBy("work").agg(F.array_sort(F.collect_list(F.struct((F.col("i") - 1).cast("int").alias("at"), T.page_of(F.coalesce("m", F.lit(""))).alias("page"), F.col("n").cast("long").alias("n")))).alias("u"))

    def step(a, x):
        some = F.length(x["page"]) > 0
        cut = (a["acc"] >= target) & some & ~x["page"].eqNullSafe(a["page"])
        return F.struct((F.when(cut, F.lit(0).cast("long")).otherwise(a["acc"]) + x["n"]).alias("acc"), F.when(some, x["page"]).otherwise(a["page"]).alias("page"), F.when(cut, F.concat(a["out"], F.array(x["at"]))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(None).cast("string").alias("page"), F.array().cast("array<int>").alias("out"))
    g = g.withColumn("cuts", F.aggregate("u", start, step, lambda a: a["out"]))
    return g.select("work", _without_tail(F.col("cuts"), F.size("u"), CHAR_TAIL).alias("cuts"))


def range_labels(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """(work, start, end, label): first and last marker of each range; one marker alone; else the units' numbers."""
    u = units.select("work", (F.col("i") - 1).alias("at"), "m")
    g = _within(u, ranges).groupBy("work", "start", "end")
    g = g.agg(F.count("m").alias("n"), F.min_by("m", F.when(F.col("m").isNotNull(), F.col("at"))).alias("a"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("at"))).alias("z"))
    label = F.when(F.col("n") == 0, F.concat((F.col("start") + 1).cast("string"), F.lit("–"), F.col("end").cast("string"), F.lit("단위"))).when(F.col("n") == 1, F.col("a")).otherwise(F.concat("a", F.lit("–"), "z"))
    return g.select("work", "start", "end", label.alias("label"))


def _as_chapters(cuts: DataFrame, sizes: DataFrame, units: DataFrame) -> DataFrame:
    c = cuts.where(F.size("cuts") > 0).join(sizes, "work").withColumn("edges", F.concat(F.array(F.lit(0)), "cuts", F.array(F.col("n").cast("int"))))
    r = c.select("work", F.explode(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda k: F.struct(F.get("edges", k).alias("start"), F.get("edges", k + 1).alias("end")))).alias("r")).select("work", "r.start", "r.end")
    return range_labels(units, r).select("work", F.col("start").alias("i"), F.lit(1).alias("lv"), F.col("label").alias("t"))


def choose(units: DataFrame, headed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(work, i, lv, t): a work's chapters by policy. headed: chapters from headings; lengths: work, i, m, n characters.

    Without headed ones: long texts of few units are cut by characters, then works of many units by page. Long
    chapters are cut again by page, and the cuts numbered from 2.
    """
    sizes = units.groupBy("work").agg(F.count("*").cast("int").alias("n"))
    bare = sizes.join(headed.select("work").distinct(), "work", "left_anti")
    total = lengths.groupBy("work").agg(F.sum("n").alias("chars"))
    long_ = bare.join(total, "work").where((F.col("chars") > LONG_TEXT) & (F.col("n") <= FEW_UNITS)).select("work")
    by_chars = _as_chapters(char_cuts(lengths.join(long_, "work", "left_semi")), sizes, units)
    many = bare.where(F.col("n") > FEW_UNITS)
    by_page = _as_chapters(page_cuts(units, many.select("work", F.lit(0).alias("start"), F.col("n").alias("end"))).select("work", "cuts"), sizes, units)
    c = headed.unionByName(by_chars).unionByName(by_page)
    return subdivide(units, c, sizes)


def subdivide(units: DataFrame, chapters_: DataFrame, sizes: DataFrame, limit: int = LONG_CHAPTER) -> DataFrame:
    c = chapters_.join(sizes, "work").withColumn("end", F.coalesce(F.lead("i").over(W.partitionBy("work").orderBy("i")), F.col("n")))
    cuts = page_cuts(units, c.where(F.col("end") - F.col("i") > limit).select("work", F.col("i").alias("start"), "end"))
    parts = cuts.withColumn("edges", F.concat("cuts", F.array("end"))).where(F.size("cuts") > 0)
    parts = parts.select("work", F.col("start").alias("of"), F.posexplode(F.transform("cuts", lambda x, k: F.struct(x.alias("start"), F.get("edges", k + 1).alias("end")))).alias("k", "r")).select("work", "of", "k", "r.start", "r.end")
    named = parts.join(range_labels(units, parts.select("work", "start", "end")), ["work", "start", "end"]).join(c.select("work", F.col("i").alias("of"), "lv", "t"), ["work", "of"])
    more = named.select("work", F.col("start").alias("i"), "lv", F.concat("t", F.lit(" ("), (F.col("k") + 2).cast("string"), F.lit(") "), "label").alias("t"))
    return c.select("work", "i", "lv", "t").unionByName(more)


def assign(units: DataFrame, chapters_: DataFrame) -> DataFrame:
    """units with c: the number (from 0) of the last chapter at or before the unit (backward as-of). A work's chapter
    starts, few, go to its units as one array: an equi-join, of which a hot work's side can be split."""
    name = schemas.unused(units, "_starts")
    starts = chapters_.groupBy("work").agg(F.sort_array(F.collect_list("i")).alias(name))
    u = units.drop("c").join(starts, "work", "left")
    n = F.size(F.filter(name, lambda s: s < F.col("i")))
    return u.withColumn("c", F.when(n > 0, n - 1)).drop(name)


def chapter_sizes(chapters_: DataFrame, sizes: DataFrame) -> DataFrame:
    w = W.partitionBy("work").orderBy("i")
    c = chapters_.join(sizes, "work")
    return c.select("work", "i", "t", (F.coalesce(F.lead("i").over(w), F.col("n")) - F.col("i")).alias("units"), F.lag("t").over(w).alias("prev"), F.lead("t").over(w).alias("next"))


def sub_headings(sections: DataFrame, chapters_: DataFrame) -> DataFrame:
    """(work, i, t): sections that start no chapter; of several at one place the last."""
    s = sections.join(chapters_.select("work", "i"), ["work", "i"], "left_anti")
    order = F.struct("ord") if "ord" in sections.columns else F.struct("lv", "t")
    return s.groupBy("work", "i").agg(F.max_by("t", order).alias("t"))
