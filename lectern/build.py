"""The build: folders of sources and translations to units, chapters, work documents and the catalogue; and the
catalogue rebuilt from work documents alone.

A folder a work: sources are files whose names begin with the word for source text (.txt, .docx), in name order; the
translation is one Word file. Every step is an operator of this package over all works at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lectern.functions import text as T
from lectern.operators import align, assemble, sections as S, stats
from lectern.sources import docx, text as texts, works as W_

#: Names of files (fixed values).
SOURCE, TRANSLATION = "원문", "번역.docx"
#: Bibliography and statistics that a rebuilt catalogue keeps (fixed values).
KEEP = (
    "id", "title_cn", "title_ko", "author_cn", "author_ko", "dynasty", "canon", "canon_id", "canon_vol", "canon_no", "canon_label", "canon_ko", "source", "底本_publisher",
    "collection", "tags", "verify", "note", "units", "translated", "coverage", "chars_cn", "chars_ko", "range", "has_source", "has_translation", "chapters",
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, work, name) of all files under a folder of works."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return f.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("work"), F.element_at(F.split("path", "/"), -1).alias("name"))


def source_units(found: DataFrame) -> DataFrame:
    """(work, i, m, cn, src): source units of all files of a work in name order, numbered through."""
    own = found.where(F.col("name").startswith(SOURCE))
    plain = texts.segment(texts.decoded(own.where(F.col("name").endswith(".txt"))))
    word = docx.source_units(docx.paragraphs_of(own.where(F.col("name").endswith(".docx")).select("path", "content")))
    parts = plain.select("path", "i", "m", "cn").unionByName(word.select("path", "i", "m", "cn")).join(found.select("path", "work", "name"), "path")
    parts = texts.concat_parts(parts.withColumn("src", F.col("name")))
    return parts.select("work", "i", "m", "cn", F.regexp_replace("src", r"\.[^.]*$", "").alias("src"))


def translations(found: DataFrame) -> dict[str, DataFrame]:
    """units (work, u, m, cn, ko, nt, h), matter (work, front, appendix), sections (work, i, ord, lv, t), glossary and
    bibliography of the translations, each read as its layout asks: aligned tables, translation alone, or in general."""
    own = found.where(F.col("name") == TRANSLATION)
    named = lambda df: df.join(own.select("path", "work"), "path").drop("path")
    p, t = docx.paragraphs_of(own.select("path", "content")), docx.tables_of(own.select("path", "content"))
    kind = docx.layout(p, t)
    of = lambda df, k: df.join(kind.where(F.col("layout") == k).select("path"), "path", "left_semi")
    none, text = F.array().cast("array<string>"), "string"
    ordered = lambda c: F.array_sort(F.collect_list(c))

    table = docx.table_units(of(t, "table")).select("path", (F.col("i") - 1).alias("u"), "m", "cn", "ko", "nt", F.lit(None).cast(text).alias("h"))
    table_front = of(p, "table").where(~T.is_source_line(F.col("text"))).groupBy("path").agg(ordered(F.struct("pos", "text")).alias("l")).select("path", F.col("l.text").alias("front"), none.alias("appendix"))

    alone = docx.translation_units(of(p, "translation"))
    body = alone.where("place = 'body'").select("path", (F.col("u") - 1).cast("int").alias("u"), "m", none.alias("cn"), "ko", "nt", F.lit(None).cast(text).alias("h"))
    side = lambda k: F.coalesce(F.flatten(F.collect_list(F.when(F.col("place") == k, F.col("texts")))), none)
    alone_matter = alone.where("place != 'body'").groupBy("path").agg(side("front").alias("front"), side("back").alias("appendix"))

    blocks = docx.blocks(of(p, "general"))
    split = assemble.split_by_translation(assemble.units(blocks))
    general = split.select("path", (F.row_number().over(W.partitionBy("path").orderBy("u", "piece")) - 1).alias("u"), "m", "cn", "ko", "nt", "h")
    heads = assemble.sections(blocks).join(assemble.remap(split).select("path", F.col("old").alias("i"), "new"), ["path", "i"], "left")
    heads = heads.select("path", F.coalesce("new", "i").alias("i"), "ord", "lv", "t")

    side_tables = docx.side_tables(t).join(kind.where("layout != 'translation'").select("path"), "path", "left_semi")
    return {
        "units": named(table.unionByName(body).unionByName(general)),
        "matter": named(table_front.unionByName(alone_matter).unionByName(assemble.matter(blocks))),
        "sections": named(heads),
        "glossary": named(docx.glossary(side_tables)),
        "bibliography": named(docx.bibliography(side_tables)),
        "works": named(own.select("path")),
    }


def build(spark: SparkSession, folder: str, registry: DataFrame, rights: DataFrame, out: str, version: str = "1", compose: bool = True) -> dict[str, DataFrame]:
    """Build all works of a folder into `out` (units, documents, manifest) and return what was built: units, sections,
    chapters, works (catalogue rows in order), totals, flagged (sources whose texts may not go on), and report lines.

    registry: an entry a work (id and bibliography); folders that it lacks are taken in with default bibliography.
    rights: source, ok. Registered works without files have no units.
    """
    found = files(spark, folder)
    names = found.groupBy(F.col("work").alias("id")).agg(F.collect_set("name").alias("names"))
    entries = registry.unionByName(texts.discover(names, registry), allowMissingColumns=True)
    ids = entries.select(F.col("id").alias("work"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    src = kept(source_units(found).join(ids, "work", "left_semi"), "source")
    tr = {k: kept(v.join(ids, "work", "left_semi"), f"translation-{k}") for k, v in translations(found).items()}
    aligned = kept(align.align_works(src, tr["units"], compose), "aligned")
    sizes = aligned.groupBy("work").agg(F.count("*").cast("int").alias("n"))
    headed = align.section_places(tr["sections"].select("work", "i", "lv", "t"), align.moved(aligned).select("work", F.col("old").cast("long").alias("old"), "new"))
    bare = aligned.join(headed.select("work").distinct(), "work", "left_anti")
    raw = headed.select("work", F.col("i").cast("int").alias("i"), "lv", "t").unionByName(S.volume_lines(bare))
    sections = kept(S.clean(raw, sizes), "sections")
    lengths = aligned.select("work", "i", "m", F.length(T.norm_cn(F.array_join("cn", " "), search=False, compose=compose)).alias("n"))
    chapters = kept(S.choose(aligned, S.chapters(sections, sizes), lengths), "chapters")
    units = kept(S.assign(aligned, chapters), "units")

    length = lambda c: F.length(T.norm_cn(c, search=False, compose=compose))
    st = stats.work_stats(units, length).drop("has_translation")
    yes = lambda df, c: df.select("work").distinct().withColumn(c, F.lit(True))
    st = ids.join(st, "work", "left").join(yes(src, "has_source"), "work", "left").join(yes(tr["works"], "has_translation"), "work", "left")
    st = st.join(chapters.groupBy("work").agg(F.count("*").alias("chapters")), "work", "left")
    st = st.select("work", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("units", "translated", "chars_cn", "chars_ko", "chapters")], F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(F.col("range_first").isNotNull(), F.array("range_first", "range_last")).alias("range"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_source", "has_translation")])
    meta = entries.withColumn("work", F.col("id")).join(st, "work")
    book = tr["bibliography"].groupBy("work").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("biblio_extracted"))
    meta = kept(meta.join(book, "work", "left").withColumn("ord", F.monotonically_increasing_id()), "meta")

    # sub-tables of the documents; a work's order in the catalogue
    docs = W_.documents(meta.drop("ord"), units.drop("places"), sections, chapters, tr["glossary"], tr["matter"])
    W_.write_documents(docs, f"{out}/works")
    totals = stats.totals(meta)
    W_.manifest(_ordered(meta).drop("work"), totals, version).withColumnRenamed("json", "value").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return {"units": units, "sections": sections, "chapters": chapters, "works": meta, "totals": totals, "flagged": stats.rights_flags(meta, rights), "report": report(meta)}


def _ordered(works: DataFrame) -> DataFrame:
    """ord: the place in catalogue order. One ordered window: a catalogue has a row a work."""
    key = stats.canon_key(F.col("canon_id"), F.col("canon_vol"), F.col("canon_no"))
    return works.withColumn("ord", F.row_number().over(W.orderBy(*key, "ord")))


def report(works: DataFrame) -> DataFrame:
    """(id, line): a work's line of the build's report."""
    share = F.format_string("%5.1f%%", F.col("coverage") * 100)
    return works.select("id", F.concat_ws("  ", "id", F.format_number("units", 0), F.format_number("translated", 0), share, F.array_join("range", "–")).alias("line"))


def summary(totals: DataFrame) -> DataFrame:
    """(line): works, units and source characters in all, with thousands separators."""
    return totals.select(F.concat_ws(" · ", F.concat(F.format_number("works", 0), F.lit("종")), F.concat(F.format_number("units", 0), F.lit("단위")), F.concat(F.lit("원문 "), F.format_number("chars_cn", 0), F.lit("자"))).alias("line"))


def rebuild(spark: SparkSession, documents: str, registry: DataFrame, length=None) -> dict[str, DataFrame]:
    """The catalogue from work documents (a path of JSON files): works (the columns of KEEP that are there, in order),
    totals, skipped (file, reason). A column's value is the recounted statistics', else the document's own, else the
    registry's, else the default."""
    good, skipped = W_.scan(spark, documents)
    name = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    good = good.withColumn("work", F.coalesce(F.col("meta")["id"], name))
    units = good.select("work", F.explode("units").alias("u")).select("work", "u.*")
    st = good.select("work").join(stats.work_stats(units, length, ingest=False), "work", "left")
    counted = st.select("work", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("units", "translated", "chars_cn", "chars_ko")], F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(F.col("range_first").isNotNull(), F.array("range_first", "range_last")).alias("range"), F.col("units").isNotNull().alias("has_source"), F.coalesce("has_translation", F.lit(False)).alias("has_translation"))
    counted = counted.join(good.select("work", F.coalesce(F.size("chapters"), F.lit(0)).cast("long").alias("chapters")), "work").withColumn("id", F.col("work"))
    kinds = {f.name: f.dataType for f in registry.schema}
    own = {c: F.col("meta")[c].try_cast("int") if c in ("canon_vol", "canon_no") else F.col("meta")[c].try_cast("boolean") if c == "verify" else F.from_json(F.col("meta")[c], "array<string>") if c == "tags" else F.col("meta")[c] for c in KEEP if c not in counted.columns}
    meta = good.select("work", *[v.cast(kinds[c]).alias(c) if c in kinds else v.alias(c) for c, v in own.items()])
    reg = registry.withColumn("work", F.col("id")).drop("id")
    plain = {k: v for k, v in texts.UNREGISTERED.items() if k not in ("canon_ko", "collection", "verify")}
    w = stats.overlay(counted, meta, reg, plain)
    w = w.withColumn("title_cn", F.coalesce("title_cn", "work")).withColumn("title_ko", F.coalesce("title_ko", "work"))
    w = _ordered(w.withColumn("ord", F.col("work")))
    return {"works": w.select("ord", *[c for c in KEEP if c in w.columns]), "totals": stats.totals(w), "skipped": skipped}
