"""Text sources: decoding, segmentation into marked units, concatenation and discovery."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as T

#: Bibliography of works that no registry has (fixed values); their titles are their ids.
UNREGISTERED = {
    "author_cn": "", "author_ko": "미상", "dynasty": "", "canon": "서지 미기재", "canon_label": "미분류", "canon_id": "Z", "canon_vol": 999, "canon_no": 999,
    "canon_ko": "", "collection": "미분류", "verify": True,
}
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "utf-16")


@F.pandas_udf(StringType())
def sniffed(content: pd.Series) -> pd.Series:
    """The text in the first encoding that fits, with plain newlines; ValueError where none does."""

    def one(raw):
        for e in ENCODINGS:
            try:
                return bytes(raw).decode(e).replace("\r\n", "\n").replace("\r", "\n")
            except UnicodeError:
                continue
        raise ValueError("no known encoding fits")

    return content.map(one)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file."""
    return decoded(spark.read.format("binaryFile").load(path))


def decoded(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content)."""
    return files.select("path", sniffed("content").alias("text"))


def segment(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, i, m, cn): blocks between blank lines, split again before each marker; m only where a piece starts
    with one; i counts from 1 over a key's pieces. Null and blank texts give no units."""
    blocks = df.select(F.col(key), F.posexplode(F.split(text, r"\n\s*\n")).alias("_b", "_block"))
    pieces = blocks.select(key, "_b", F.posexplode(F.split("_block", T.BEFORE_MARKER)).alias("_p", "_piece"))
    pieces = pieces.withColumn("cn", T.collapse(F.col("_piece"))).where("cn != ''")
    i = F.row_number().over(W.partitionBy(key).orderBy("_b", "_p"))
    return pieces.select(key, i.alias("i"), T.first_marker(F.col("cn"), leading=True).alias("m"), "cn")


def concat_parts(parts: DataFrame, work: str = "work", src: str = "src") -> DataFrame:
    """Units of several sources of a work in source order, numbered through."""
    i = F.row_number().over(W.partitionBy(work).orderBy(src, "i"))
    return parts.withColumn("i", i)


def discover(folders: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries with default bibliography for folders (id, names) that aren't registered but hold a source or a
    translation under its exact name."""
    new = folders.join(registry.select("id"), "id", "left_anti").where(F.arrays_overlap("names", F.array(F.lit("원문.txt"), F.lit("번역.docx"))))
    named = [F.col("id").alias("title_cn"), F.col("id").alias("title_ko")]
    return new.select("id", *named, *[F.lit(v).alias(k) for k, v in UNREGISTERED.items()], F.array().cast("array<string>").alias("tags"))
