"""Full-text search over normalised units: hits, counts, facets, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import schemas
from lectern.functions import text as T

#: Needles up to which each is sought in every text; beyond, windows of the texts meet the needles by equality.
NEEDLES = 200
PAGE_SIZES = (10, 20, 30, 50, 100)
BLOCK = 10


def index(units: DataFrame, compose: bool = True) -> DataFrame:
    """units (work, i, m, cn, ko) with the texts that search compares; to be written once and searched often."""
    u = units.withColumn("cn_raw", F.array_join("cn", "\n")).withColumn("ko_raw", F.array_join("ko", "\n"))
    return u.withColumn("ncn", T.norm_cn(F.col("cn_raw"), compose=compose)).withColumn("nko", T.norm_ko(F.col("ko_raw"), compose=compose))


def side_of(ncn: Column, nko: Column, qcn: str, qko: str, scope: str = "both") -> Column:
    """cn, ko or null: the source is tested first and wins; an empty needle matches nothing."""
    side = F.lit(None).cast("string")
    if scope != "cn" and qko:
        side = F.when(nko.contains(qko), "ko")
    if scope != "ko" and qcn:
        side = F.when(ncn.contains(qcn), "cn").otherwise(side)
    return side


def normal_query(spark, query: str) -> tuple[str, str]:
    row = spark.createDataFrame([(query,)], "q string").select(T.norm_cn(F.col("q")), T.norm_ko(F.col("q"))).first()
    return row[0], row[1]


def hits(indexed: DataFrame, works: DataFrame, query: str, scope: str = "both", limit: int = 0) -> DataFrame:
    """(work, title, title_ko, ord, i, m, where, snip, alt) in catalogue and unit order; limit 0 is none.

    Snippets are cut after filter and limit, so only kept hits reach Python. A hit that normalises otherwise as a
    whole than by character has a null snippet.
    """
    qcn, qko = normal_query(indexed.sparkSession, query)
    h = indexed.withColumn("where", side_of(F.col("ncn"), F.col("nko"), qcn, qko, scope)).where("where is not null")
    h = h.join(works.select("work", "title", "title_ko", "ord"), "work", "left").orderBy("ord", "work", "i")
    h = h.limit(limit) if limit else h
    snip = F.when(F.col("where") == "cn", T.kwic(F.col("cn_raw"), F.lit(qcn), "cn")).otherwise(T.kwic(F.col("ko_raw"), F.lit(qko), "ko"))
    alt = F.when(F.col("where") == "cn", F.substring("ko_raw", 1, T.PREVIEW["ko"])).otherwise(F.substring(F.regexp_replace("cn_raw", T.MARKER, ""), 1, T.PREVIEW["cn"]))
    return h.select("work", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("title_ko", F.lit("")).alias("title_ko"), "ord", "i", "m", "where", snip.alias("snip"), alt.alias("alt"))


def counts(indexed: DataFrame, works: DataFrame, query: str, scope: str = "both") -> DataFrame:
    """(work, ord, n): hits of every work, those without included; never cut by a limit. Empty for an empty query."""
    qcn, qko = normal_query(indexed.sparkSession, query)
    if not qcn and not qko:
        return works.select("work", "ord", F.lit(0).cast("long").alias("n")).limit(0)
    found = indexed.where(side_of(F.col("ncn"), F.col("nko"), qcn, qko, scope).isNotNull()).groupBy("work").count()
    return works.join(found, "work", "left").select("work", "ord", F.coalesce("count", F.lit(0)).alias("n"))


def facets(counted: DataFrame) -> DataFrame:
    """(work, n): all (null) first, then works with hits in catalogue order."""
    return counted.where("n > 0").rollup("work").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"), F.grouping("work").alias("all_")).orderBy(F.desc("all_"), "ord").select("work", "n")


def page(found: DataFrame, number: int, size: int = PAGE_SIZES[0], work: str | None = None) -> DataFrame:
    """The page's rows in order, clamped to what there is."""
    found = found.where(F.col("work") == work) if work else found
    total = found.count()
    number = min(max(1, number), max(1, -(-total // size)))
    return found.orderBy("ord", "work", "i").offset((number - 1) * size).limit(size)


def locate(texts: DataFrame, needles: DataFrame, length: int, few: int = NEEDLES) -> DataFrame:
    """(key, id, at): the first place (from 1) of each needle (id, needle: exactly `length` characters) in each text
    (key, text) that has it. Null texts have none; shorter needles must be left out by the caller."""
    if needles.limit(few + 1).count() <= few:
        found = texts.join(F.broadcast(needles), F.col("text").contains(F.col("needle")))
        return found.select("key", "id", F.instr(F.col("text"), F.col("needle")).cast("long").alias("at"))
    # every window goes to its needle: `length` times the text is moved, but no text meets a needle that it lacks
    windows = texts.where(F.length("text") >= length).select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text") - length + 1), lambda k: F.substring(F.col("text"), k, F.lit(length)))).alias("p", "needle"))
    return windows.join(needles, "needle").groupBy("key", "id").agg((F.min("p") + 1).cast("long").alias("at"))


def page_numbers(total: int, number: int, size: int) -> dict:
    """First and last page of the block that holds the page, and where first, prev, next and last lead."""
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    first = (number - 1) // BLOCK * BLOCK + 1
    last = min(pages, first + BLOCK - 1)
    return {"pages": pages, "page": number, "block": list(range(first, last + 1)), "prev": first - 1 if first > 1 else None, "next": last + 1 if last < pages else None, "from": (number - 1) * size + 1 if total else 0, "to": min(total, number * size)}


def spotlight(units: DataFrame, query: str, where: str) -> DataFrame:
    """units with cn_marks and ko_marks: ranges of the query on the side of the hit; where that has none, on both.
    Compared as highlighting does: paragraphs apart, punctuation dropped on both sides."""
    row = units.sparkSession.createDataFrame([(query,)], "q string").select(T.norm_highlight(F.col("q"), "cn"), T.norm_highlight(F.col("q"), "ko")).first()
    c, k = schemas.unused(units, "_c"), schemas.unused(units, "_k")
    u = units.withColumn(c, T.find_ranges(F.array_join("cn", "\n"), F.lit(row[0]), "cn")).withColumn(k, T.find_ranges(F.array_join("ko", "\n"), F.lit(row[1]), "ko"))
    own = F.size(c) if where == "cn" else F.size(k)
    none = F.array().cast("array<struct<start:int,end:int>>")
    show = lambda side, x: F.when((own == 0) | F.lit(where == side), F.col(x)).otherwise(none)
    return u.withColumn("cn_marks", show("cn", c)).withColumn("ko_marks", show("ko", k)).drop(c, k)
