"""Work documents: registry, scan with quarantine, and the JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern import schemas


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRY).json(path, multiLine=True).select(F.explode("works").alias("w")).select("w.*")


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, skipped): documents with units, and (file, reason) of malformed or unit-less ones."""
    df = spark.read.schema(schemas.WORK).option("mode", "PERMISSIVE").json(path, multiLine=True).withColumn("file", F.input_file_name())
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("units").isNull(), "no units")
    return df.where(reason.isNull()).drop("_corrupt_record"), df.where(reason.isNotNull()).select("file", reason.alias("reason"))


def units_of(works: DataFrame) -> DataFrame:
    return works.select(F.col("meta")["id"].alias("work"), F.explode("units").alias("u")).select("work", "u.*")


def documents(meta: DataFrame, units: DataFrame, sections: DataFrame, chapters: DataFrame, glossary: DataFrame, matter: DataFrame) -> DataFrame:
    """One JSON a work. A unit always has m (null where there is none); h, x and c only where they are set."""
    shown = F.concat(F.lit('{"i":'), F.col("i").cast("string"), F.lit(',"m":'), F.coalesce(F.to_json(F.array("m")).substr(F.lit(2), F.length(F.to_json(F.array("m"))) - 2), F.lit("null")), F.lit(","), F.expr("substring(to_json(struct(cn, ko, nt, h, x, c)), 2)"))
    u = units.groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("j")))), lambda x: x["j"]), ",").alias("units"))
    listed = lambda df, *cols: df.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("i", *cols))).alias("l"))
    s = listed(sections, "lv", "t").select("work", F.to_json(F.transform("l", lambda x: F.struct(x["lv"].alias("lv"), x["t"].alias("t"), x["i"].alias("i")))).alias("sections"))
    c = listed(chapters, "t").select("work", F.to_json(F.transform("l", lambda x: F.struct(x["t"].alias("t"), x["i"].alias("i")))).alias("chapters"))
    g = glossary.select("work", F.to_json("entries").alias("glossary"))
    m = matter.select("work", F.to_json(F.concat("front", "appendix")).alias("front"))
    df = meta.select("work", F.to_json(F.struct(*[x for x in meta.columns if x != "work"])).alias("meta"))
    for side in (g, m, c, s, u):
        df = df.join(side, "work", "left")
    part = lambda n: F.concat(F.lit(f'"{n}":'), F.coalesce(F.concat(F.lit("["), "units", F.lit("]")) if n == "units" else F.col(n), F.lit("[]")))
    return df.select("work", F.concat(F.lit('{"meta":'), "meta", F.lit(","), F.concat_ws(",", *[part(n) for n in ("glossary", "front", "chapters", "sections", "units")]), F.lit("}")).alias("json"))


def write_documents(docs: DataFrame, path: str) -> None:
    """A folder a work, overwritten."""
    docs.withColumnRenamed("json", "value").write.mode("overwrite").partitionBy("work").text(path)


def manifest(works: DataFrame, totals: DataFrame, generated: str, site: str = "") -> DataFrame:
    """The catalogue as one JSON row: works in catalogue order (ord) and totals. A row a work goes in, never a unit."""
    cols = [c for c in works.columns if c not in ("ord", "biblio_extracted")]
    listed = works.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("works"))
    return listed.crossJoin(totals.select(F.struct("*").alias("totals"))).select(F.to_json(F.struct(F.lit(generated).alias("generated"), F.lit(site).alias("site"), "works", "totals")).alias("json"))
