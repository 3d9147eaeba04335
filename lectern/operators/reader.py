"""Reading by coordinate: point lookup, chapter ranges, neighbours, display rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

TITLE_MOST = 80


def lookup(units: DataFrame, work, anchor: str, number: int | None = None) -> DataFrame:
    """At most one unit: that of the number, if it lies in a chapter but the first; else the first that the anchor
    names (u<i>, or a marker); else that of the number. units: work, i, m, and c where chapters are known."""
    digits = anchor.removeprefix("u") if anchor.startswith("u") else ""
    named = (F.col("i") == int(digits)) if digits.isdigit() else F.coalesce(F.col("m") == anchor, F.lit(False))
    numbered = F.coalesce(F.col("i") == F.lit(number).cast("long"), F.lit(False))
    later = F.coalesce(F.col("c") > 0, F.lit(False)) if "c" in units.columns else F.lit(False)
    rank = F.when(numbered & later, 0).when(named, 1).when(numbered, 2)
    return units.where(F.col("work") == work).withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "i").limit(1).drop("_rank")


def chapter(units: DataFrame, chapters: DataFrame, sub: DataFrame, work: str, number: int) -> DataFrame:
    """The units of a chapter (number clamped) in order, with the sub-heading that stands before each."""
    w = W.partitionBy("work").orderBy("i")
    c = chapters.where(F.col("work") == work).select("work", F.col("i").alias("start"), F.lead("i").over(w).alias("stop"), (F.row_number().over(w) - 1).alias("k"), F.count("*").over(W.partitionBy("work")).alias("all"))
    c = c.where(F.col("k") == F.least(F.greatest(F.lit(number), F.lit(0)), F.col("all") - 1)).select("work", "start", "stop")
    u = units.where(F.col("work") == work).join(F.broadcast(c), "work").where((F.col("i") - 1 >= F.col("start")) & (F.col("stop").isNull() | (F.col("i") - 1 < F.col("stop"))))
    s = sub.where(F.col("work") == work).select("work", (F.col("i") + 1).alias("i"), F.col("t").alias("heading"))
    return u.drop("start", "stop").join(s, ["work", "i"], "left").orderBy("i")


def display(units: DataFrame) -> DataFrame:
    """units with title_like (no marker and little source) and untranslated."""
    n = F.length(F.array_join("cn", ""))
    return units.withColumn("title_like", F.col("m").isNull() & (n <= TITLE_MOST)).withColumn("untranslated", F.size("ko") == 0)


def side(units: DataFrame, mode: str = "both") -> DataFrame:
    return units.drop(*{"cn": ("ko", "nt"), "ko": ("cn",)}.get(mode, ()))


def group_headers(works: DataFrame) -> DataFrame:
    """Works in catalogue order (ord) with head: whether the canon differs from the one before."""
    return works.withColumn("head", ~F.col("canon_id").eqNullSafe(F.lag("canon_id").over(W.orderBy("ord")))).withColumn("tags2", F.slice("tags", 1, 2))
