"""Statistics of works and the catalogue: overlay of bibliography, order, totals, rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T

DEFAULT_SOURCE = "CBETA"


def work_stats(units: DataFrame, length=None, ingest: bool = True) -> DataFrame:
    """One row a work: units, translated, chars_cn, chars_ko, coverage, range_first, range_last, has_translation.

    length(column) counts a text's characters, by default those of its search text. As the ingest has it, the range
    leaves out unmatched units (x) and translation is counted unjoined; a rebuild (ingest=False) counts x as well.
    """
    length = length or (lambda c: F.length(T.norm_cn(c, search=False)))
    u = units.withColumn("_n", length(F.array_join("cn", " "))).withColumn("_done", F.size("ko") > 0)
    m = F.when(F.col("x").isNull(), F.col("m")) if ingest and "x" in units.columns else F.col("m")
    g = u.groupBy("work").agg(
        F.count("*").alias("units"),
        F.count_if("_done").alias("translated"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("chars_cn"),
        F.coalesce(F.sum(F.when(F.col("_done"), F.col("_n"))), F.lit(0)).cast("long").alias("_chars"),
        F.coalesce(F.sum(F.length(F.array_join("ko", ""))), F.lit(0)).cast("long").alias("chars_ko"),
        F.min(m).alias("range_first"),
        F.max(m).alias("range_last"),
    )
    return g.select("work", "units", "translated", T.coverage(F.col("_chars"), F.col("chars_cn")).alias("coverage"), "chars_cn", "chars_ko", "range_first", "range_last", (F.col("translated") > 0).alias("has_translation"))


def totals(stats: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return stats.agg(F.count("*").alias("works"), total("units"), total("translated"), total("chars_cn"))


def upper_median(values: str) -> Column:
    """Of a grouped numeric SQL expression: sorted[n div 2] as a double, 0 where there is none. A count a distinct
    value is held and merged, not the values; exact up to 500 million values a group (a share just over one half)."""
    return F.coalesce(F.expr(f"percentile_disc(0.500000001) WITHIN GROUP (ORDER BY {values})"), F.lit(0.0))


def overlay(stats: DataFrame, meta: DataFrame, registry: DataFrame, defaults: dict) -> DataFrame:
    """One row a work; each column by precedence statistics, the document's own meta, registry, default."""
    names = list(dict.fromkeys([*stats.columns, *meta.columns, *registry.columns, *defaults]))
    j = stats.alias("s").join(meta.alias("d"), "work", "left").join(registry.alias("r"), "work", "left")

    def pick(c):
        given = [F.col(f"{a}.{c}") for a, df in (("s", stats), ("d", meta), ("r", registry)) if c in df.columns]
        return F.coalesce(*given, *([F.lit(defaults[c])] if c in defaults else [])).alias(c)

    out = j.select(F.col("work"), *[pick(c) for c in names if c != "work"])
    return out.withColumn("verify", (F.coalesce("canon_id", F.lit("")) == "Z") | F.coalesce("verify", F.lit(False))) if "canon_id" in out.columns and "verify" in out.columns else out


def canon_key(canon: Column, vol: Column, no: Column) -> list[Column]:
    rank = F.lit(9)
    for i, c in reversed(list(enumerate(T.CANONS))):
        rank = F.when(canon == c, i).otherwise(rank)
    return [rank, F.coalesce(vol, F.lit(0)), F.coalesce(no, F.lit(0))]


def canon_sort(works: DataFrame, ordinal: str = "ord") -> DataFrame:
    return works.orderBy(*canon_key(F.col("canon_id"), F.col("canon_vol"), F.col("canon_no")), ordinal)


def rights_flags(works: DataFrame, rights: DataFrame) -> DataFrame:
    """(source, ids): works whose source isn't known to be free: false, null and missing all flag."""
    j = works.withColumn("source", F.coalesce("source", F.lit(DEFAULT_SOURCE))).join(rights.select("source", "ok"), "source", "left")
    return j.where(~F.col("ok").eqNullSafe(True)).groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def rights_table(registry: DataFrame, column: str = "rights") -> DataFrame:
    return registry.select(F.explode(column).alias("source", "r")).select("source", "r.*")
