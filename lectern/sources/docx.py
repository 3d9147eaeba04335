"""Word sources: paragraphs and tables, the three layouts of translations, glossary and bibliography."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lectern import schemas
from lectern.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NOTE_LINE_MOST = 8


def _text(p) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def parse(raw: bytes):
    """[(text, style name)] of the body's paragraphs and [[[cell]]] of its tables; a merged cell repeats."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
            n = s.find(_W + "name")
            names[s.get(_W + "styleId")] = n.get(_W + "val") if n is not None else s.get(_W + "styleId")
    body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    paragraphs, tables = [], []
    for e in body:
        if e.tag == _W + "p":
            s = e.find(f"{_W}pPr/{_W}pStyle")
            style = names.get(s.get(_W + "val"), s.get(_W + "val")) if s is not None else "Normal"
            # built-in heading names are stored in lower case
            paragraphs.append((_text(e), style[:1].upper() + style[1:]))
        elif e.tag == _W + "tbl":
            rows = []
            for r in e.findall(_W + "tr"):
                cells = []
                for c in r.findall(_W + "tc"):
                    span = c.find(f"{_W}tcPr/{_W}gridSpan")
                    cells += ["\n".join(_text(p) for p in c.findall(_W + "p")).strip()] * int(span.get(_W + "val") if span is not None else 1)
                rows.append(cells)
            tables.append(rows)
    return paragraphs, tables


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    return paragraphs_of(files_of(spark, path))


def paragraphs_of(files: DataFrame) -> DataFrame:
    """(path, pos, text, style) of files (path, content); blank paragraphs are left out."""

    def run(frames):
        for f in frames:
            for p, c in zip(f.path, f.content):
                rows = parse(bytes(c))[0]
                yield pd.DataFrame({"path": [p] * len(rows), "pos": range(len(rows)), "text": [r[0] for r in rows], "style": [r[1] for r in rows]})

    df = files.mapInPandas(run, schemas.PARAGRAPHS)
    return df.withColumn("text", T.collapse(F.col("text"))).withColumn("style", F.trim("style")).where("text != ''")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return tables_of(files_of(spark, path))


def tables_of(files: DataFrame) -> DataFrame:
    """(path, t, rows) of files (path, content); empty tables are left out."""

    def run(frames):
        for f in frames:
            for p, c in zip(f.path, f.content):
                for t, rows in enumerate(parse(bytes(c))[1]):
                    yield pd.DataFrame({"path": [p], "t": [t], "rows": [[r for r in rows if any(r)]]})

    return files.mapInPandas(run, schemas.TABLES).where(F.size("rows") > 0)


def source_units(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """(key, i, m, cn) of a source-only document: source lines, split before markers, the marker carried on."""
    p = paragraphs.where(T.is_source_line(F.col("text")) & ~F.regexp_like("text", F.lit(T.EDITORIAL)))
    p = p.select(key, "pos", F.posexplode(F.split("text", T.BEFORE_MARKER)).alias("k", "cn")).withColumn("cn", F.trim("cn")).where("cn != ''")
    w = W.partitionBy(key).orderBy("pos", "k")
    carried = F.last(T.first_marker(F.col("cn"), leading=True), ignorenulls=True).over(w)
    return p.select(key, F.row_number().over(w).alias("i"), carried.alias("m"), "cn")


def layout(paragraphs: DataFrame, tables: DataFrame, key: str = "path") -> DataFrame:
    """(key, layout): table, translation or general, in this order of precedence."""
    flags = tables.groupBy(key).agg(F.bool_or(_is_body(F.col("rows")) & (F.size("rows") >= 3)).alias("table"))
    counts = paragraphs.groupBy(key).agg(F.count("*").alias("n"), F.count_if(T.is_source_line(F.col("text"))).alias("source"), F.count_if(T.pure_marker(F.col("text")).isNotNull()).alias("anchors"))
    kind = F.when(F.coalesce("table", F.lit(False)), "table").when((F.coalesce("anchors", F.lit(0)) >= 20) & (F.col("source") < F.col("n") * 0.03), "translation").otherwise("general")
    return counts.join(flags, key, "full").select(key, kind.alias("layout"))


def translation_units(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """(key, place, u, m, ko, nt, texts) of a translation-only document: front, body and back are the stretches before
    the first marker, up to the first heading after it, and from there on."""
    w = W.partitionBy(key).orderBy("pos")
    m = T.pure_marker(F.col("text"))
    p = paragraphs.withColumn("m", m).withColumn("seen", F.max(F.col("m").isNotNull()).over(w))
    p = p.withColumn("back", F.max(F.col("seen") & F.col("m").isNull() & F.lower("style").startswith("heading")).over(w))
    p = p.withColumn("place", F.when(F.col("back"), "back").when(F.col("seen"), "body").otherwise("front"))
    p = p.withColumn("u", F.when(F.col("place") == "body", F.sum(F.col("m").isNotNull().cast("int")).over(w)))
    noted = F.lower("style").contains("audit") | F.col("style").contains("검증") | F.col("style").contains("교감")
    line = F.struct("pos", "text")
    plain = F.col("m").isNull() | (F.col("place") == "back")
    g = p.groupBy(key, "place", "u").agg(
        F.first("m", ignorenulls=True).alias("m"),
        F.array_sort(F.collect_list(F.when(plain & ~noted, line))).alias("ko"),
        F.array_sort(F.collect_list(F.when(plain & noted, line))).alias("nt"),
        F.array_sort(F.collect_list(F.when(plain, line))).alias("texts"),
    )
    return g.select(key, "place", "u", F.when(F.col("place") == "body", F.col("m")).alias("m"), F.col("ko.text").alias("ko"), F.col("nt.text").alias("nt"), F.col("texts.text").alias("texts"))


def _is_body(rows):
    head = F.array_join(F.get(rows, 0), " ")
    return (F.size(F.get(rows, 0)) >= 3) & ((head.contains("위치표지") & head.contains("원문")) | T.pure_marker(F.get(F.get(rows, 0), 0)).isNotNull())


def side_tables(tables: DataFrame) -> DataFrame:
    """Tables of an aligned document that hold no text: where its glossary and bibliography are looked for."""
    return tables.where(~_is_body(F.col("rows")))


def table_units(tables: DataFrame, key: str = "path") -> DataFrame:
    """(key, i, m, cn, ko, nt) of the rows (marker, source, translation) of aligned tables. In a translation cell the
    lines after a short note heading are notes."""
    head = F.array_join(F.get("rows", 0), " ")
    labelled = head.contains("위치표지") | head.contains("원문")
    rows = tables.where(_is_body(F.col("rows"))).select(key, "t", F.posexplode(F.when(labelled, F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))).alias("r", "row"))
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(key, "t", "r", T.first_marker(F.get("row", 0)).alias("m"), lines(F.get("row", 1)).alias("cn"), lines(F.get("row", 2)).alias("all"))
    rows = rows.where((F.size("cn") > 0) | (F.size("all") > 0))
    heads = F.transform("all", T.is_note_head)
    at = F.array_position(heads, True)
    ko = F.when(at > 0, F.slice("all", F.lit(1), (at - 1).cast("int"))).otherwise(F.col("all"))
    nt = F.when(at > 0, F.filter(F.slice("all", (at + 1).cast("int"), F.size("all")), lambda x: ~T.is_note_head(x))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.row_number().over(W.partitionBy(key).orderBy("t", "r")).alias("i"), "m", "cn", ko.alias("ko"), nt.alias("nt"))


def blocks(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, k, kind, hkind, text, lv, m, head) of a general document, in order of (pos, k)."""
    p = paragraphs.withColumn("note", T.is_note_head(F.col("text"))).withColumn("alone", T.pure_marker(F.col("text")))
    drop = ~F.col("note") & (T.is_label(F.col("text")) | (F.col("alone").isNull() & T.is_unit_label(F.col("text"))))
    p = p.where(~drop).withColumn("s", T.strip_side(F.col("text")))
    p = p.withColumn("body", F.when(F.col("note") | F.col("alone").isNotNull(), F.col("text")).otherwise(F.col("s.text"))).where("body != ''")
    is_head = T.is_heading(F.col("body"), F.col("style"))
    hkind = F.when(F.col("note"), "note").when(is_head, T.classify_head(F.col("body")))
    p = p.withColumn("hkind", hkind).where("hkind is null or hkind != 'label'")
    kind = F.when(F.col("hkind").isNotNull(), "head").when(F.col("alone").isNotNull(), "marker").otherwise(T.block_kind(F.col("body"), F.col("s.side"), F.col("style")))
    p = p.withColumn("kind", kind)
    pieces = F.when(F.col("kind") == "cn", F.filter(F.transform(F.split("body", T.BEFORE_MARKER), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array("body"))
    p = p.select(key, "pos", "kind", "hkind", T.head_level(F.col("style")).alias("lv"), "alone", F.posexplode(pieces).alias("k", "text"))
    named = (F.col("kind") == "head") & ~F.col("hkind").isin("note", "apparatus")
    sets = F.when(F.col("kind") == "marker", F.col("alone")).when(F.col("kind") == "cn", T.first_marker(F.col("text"), leading=True)).when(named, T.first_marker(F.col("text")))
    w = W.partitionBy(key).orderBy("pos", "k")
    p = p.withColumn("m", F.last(sets, ignorenulls=True).over(w)).withColumn("head", F.last(F.when(named, F.col("text")), ignorenulls=True).over(w))
    return p.where("kind != 'marker'").select(key, "pos", "k", "kind", "hkind", "text", F.when(F.col("kind") == "head", F.col("lv")).alias("lv"), "m", F.when(F.col("kind") != "head", F.col("head")).alias("head"))


def glossary(tables: DataFrame, key: str = "path") -> DataFrame:
    """(key, entries) of the first table with a fitting header that yields rows."""
    head = F.transform(F.get("rows", 0), lambda h: F.trim(h))
    joined = F.array_join(head, " ")
    fits = (joined.contains("원어") | joined.contains("번역어") | joined.contains("원문")) & (F.size(head) >= 2)
    last = lambda test: F.array_max(F.transform(head, lambda h, i: F.when(test(h, i), i)))
    t = tables.where(fits).withColumn("hi", F.coalesce(last(lambda h, i: h.contains("원어") | (h == "원문")), F.lit(0)))
    t = t.withColumn("ki", F.coalesce(last(lambda h, i: h.contains("번역") & (i != F.col("hi"))), F.when(F.col("hi") == 0, 1).otherwise(0)))
    cell = lambda r, c: F.get(r, F.col(c))
    full = F.filter(F.slice("rows", 2, F.size("rows")), lambda r: F.coalesce(cell(r, "hi"), F.lit("")).__ne__("") & F.coalesce(cell(r, "ki"), F.lit("")).__ne__(""))
    rows = F.transform(full, lambda r: F.struct(cell(r, "hi").alias("cn"), cell(r, "ki").alias("ko"), F.coalesce(F.get(r, F.greatest("hi", "ki") + 1), F.lit("")).alias("note")))
    return t.withColumn("entries", rows).where(F.size("entries") > 0).groupBy(key).agg(F.min_by("entries", "t").alias("entries"))


def bibliography(tables: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, value): the first value of each name in two-column item tables."""
    marks = F.array(F.lit("항목"), F.lit("구분"))
    first = F.get("rows", 0)
    fits = (F.size(first) == 2) & (F.array_contains(marks, F.get(first, 0)) | F.exists("rows", lambda r: F.get(r, 0).contains("문헌명")))
    rows = tables.where(fits).select(key, "t", F.posexplode("rows").alias("r", "row")).select(key, "t", "r", F.get("row", 0).alias("name"), F.get("row", 1).alias("value"))
    rows = rows.where("name != '' and value != ''").where(~F.col("name").isin("항목", "구분"))
    return rows.groupBy(key, "name").agg(F.min_by("value", F.struct("t", "r")).alias("value"))
