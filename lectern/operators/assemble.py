"""Blocks to units: gaps and islands over one ordering of a document, and the split at translation markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lectern.functions import text as T

SPLIT_LEAST, SPLIT_SHARE = 2, 0.8


def _flow(blocks: DataFrame, key: str, order) -> DataFrame:
    """Blocks with what has happened before them: note mode, suppression, unit number. All windows share one sort."""
    w = W.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    kind, hkind, lv = F.col("kind"), F.col("hkind"), F.col("lv")
    is_note = (kind == "head") & (hkind == "note")
    mode = F.when(is_note, True).when(kind == "cn", False).when((kind == "head") & (lv < 3), False)
    b = blocks.withColumn("_mode", F.coalesce(F.last(mode, True).over(before), F.lit(False)))
    # what the block counts as
    b = b.withColumn("_as", F.when(is_note, "notehead").when((kind == "head") & F.col("_mode") & (lv >= 3), "noteline").when(kind == "head", hkind).otherwise(kind))
    shut = F.when(F.col("_as") == "apparatus", True).when(F.col("_as") == "cn", False)
    b = b.withColumn("_shut", F.coalesce(F.last(shut, True).over(before), F.lit(True)))
    last = F.last(F.when(F.col("_as") != "notehead", F.col("_as")), True).over(before)
    b = b.withColumn("_new", (F.col("_as") == "cn") & (F.coalesce(last, F.lit("")) != "cn"))
    b = b.withColumn("u", F.sum(F.col("_new").cast("int")).over(w) - 1)
    return b.withColumn("_begun", F.coalesce(F.max((F.col("_as") == "cn") & F.col("m").isNotNull()).over(before), F.lit(False)))


def _ordered(test, order):
    return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(*order, "text")))), lambda x: x["text"])


def units(blocks: DataFrame, key: str = "path", order=("pos", "k")) -> DataFrame:
    """(key, u, m, cn, ko, nt, h): runs of source blocks with the translation and notes after them; u counts from 0."""
    b = _flow(blocks, key, order).where("u >= 0")
    as_, mode, shut = F.col("_as"), F.col("_mode"), F.col("_shut")
    out = b.groupBy(key, "u").agg(
        F.min_by("m", F.when((as_ == "cn") & F.col("m").isNotNull(), F.struct(*order))).alias("m"),
        _ordered(as_ == "cn", order).alias("cn"),
        _ordered((as_ == "ko") & ~shut & ~mode, order).alias("ko"),
        _ordered((as_ == "noteline") | ((as_ == "note") & ~shut) | ((as_ == "ko") & ~shut & mode), order).alias("nt"),
        F.min_by("head", F.when(F.col("_new"), F.struct(*order))).alias("h"),
    )
    return out


def matter(blocks: DataFrame, key: str = "path", order=("pos", "k")) -> DataFrame:
    """(key, front, appendix): translation and notes that belong to no unit, before and after the text begins."""
    b = _flow(blocks, key, order).where(F.col("_as").isin("ko", "note") & (F.col("_shut") | (F.col("u") < 0)))
    return b.groupBy(key).agg(_ordered(~F.col("_begun"), order).alias("front"), _ordered(F.col("_begun"), order).alias("appendix"))


def sections(blocks: DataFrame, key: str = "path", order=("pos", "k")) -> DataFrame:
    """(key, i, ord, lv, t): structure headings at the unit that follows, without repeats; trailing ones are dropped."""
    b = _flow(blocks, key, order)
    last = b.groupBy(key).agg(F.max("u").alias("_last"))
    s = b.where("_as = 'structure'")
    w = W.partitionBy(key, "u").orderBy(*order)
    s = s.withColumn("_prev", F.lag("text").over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col("text")))
    s = s.join(last, key).where(F.col("u") < F.col("_last"))
    return s.select(key, (F.col("u") + 1).alias("i"), F.struct(*order).alias("ord"), "lv", F.col("text").alias("t"))


def split_by_translation(units_: DataFrame, key: str = "path") -> DataFrame:
    """(key, u, piece, m, cn, ko, nt, h): units whose translation paragraphs carry markers, in pieces; others whole.

    Needs two marked paragraphs and four in five marked. A piece's source begins at the line with its marker, sought
    from the last piece's on; where there is none, with that one.
    """
    marks = F.transform("ko", lambda k: T.first_marker(k, leading=True))
    n = F.size(F.filter(marks, lambda m: m.isNotNull()))
    df = units_.withColumn("_km", marks).withColumn("_go", (n >= SPLIT_LEAST) & (n >= F.size("ko") * SPLIT_SHARE))
    cm = F.transform("cn", lambda c: T.first_marker(c, leading=True))
    group = F.struct(F.lit(None).cast("string").alias("m"), F.array().cast("array<string>").alias("ko"))
    put = lambda a, k, m: F.when(m.isNotNull(), F.concat(a, F.array(F.struct(m.alias("m"), F.array(k).alias("ko"))))).when(
        F.size(a) > 0, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["m"].alias("m"), F.concat(F.element_at(a, -1)["ko"], F.array(k)).alias("ko"))))
    ).otherwise(a)
    groups = F.aggregate(F.arrays_zip(F.col("ko").alias("k"), F.col("_km").alias("m")), F.slice(F.array(group), 1, 0), lambda a, x: put(a, x["k"], x["m"]))
    df = df.withColumn("_cm", cm).withColumn("_g", F.when(F.col("_go"), groups))

    def seek(a, g):
        at = F.when(F.size(a) == 0, F.lit(0)).otherwise(F.element_at(a, -1))
        rest = F.slice("_cm", at + 1, F.greatest(F.size("_cm") - at, F.lit(0)))
        found = F.array_position(F.transform(rest, lambda m: F.coalesce(m, F.lit(""))), g["m"])
        return F.concat(a, F.array(F.when(found > 0, at + found.cast("int") - 1).otherwise(at)))

    starts = F.aggregate("_g", F.array().cast("array<int>"), lambda a, g: F.when(F.size(a) == 0, seek(F.array().cast("array<int>"), g)).otherwise(seek(F.filter(a, lambda x: x.isNotNull()), g)))
    df = df.withColumn("_s", F.when(F.col("_go"), starts))
    whole = df.where("not _go").select(key, "u", F.lit(0).alias("piece"), "m", "cn", "ko", "nt", "h")
    cut = df.where("_go").select("*", F.posexplode("_g").alias("piece", "_one"))
    s0 = F.get("_s", F.col("piece"))
    s1 = F.greatest(s0, F.coalesce(F.get("_s", F.col("piece") + 1), F.size("cn")))
    begin = F.when(F.col("piece") == 0, F.lit(0)).otherwise(s0)
    none = F.array().cast("array<string>")
    cut = cut.select(key, "u", "piece", F.col("_one.m").alias("m"), F.slice("cn", begin + 1, s1 - begin).alias("cn"), F.col("_one.ko").alias("ko"), F.when(F.col("piece") == F.size("_g") - 1, F.col("nt")).otherwise(none).alias("nt"), F.when(F.col("piece") == 0, F.col("h")).alias("h"))
    return whole.unionByName(cut)


def remap(split: DataFrame, key: str = "path") -> DataFrame:
    """(key, old, new): where each unit's first piece stands after a split (both from 0), and one past the last."""
    sizes = split.groupBy(key, "u").agg(F.count("*").alias("n"))
    w = W.partitionBy(key).orderBy("u")
    at = sizes.select(key, F.col("u").cast("long").alias("old"), (F.sum("n").over(w) - F.col("n")).alias("new"))
    end = sizes.groupBy(key).agg((F.max("u") + 1).cast("long").alias("old"), F.sum("n").alias("new"))
    return at.unionByName(end)
