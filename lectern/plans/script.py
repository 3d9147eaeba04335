"""Registered queries of the operators on paragraphs, tables and units of mixed script, and their SQL.

The driver's tables have no such texts, so paragraphs are made by one expression that both engines run, over the lines
of documents or over a supplier's order lines (a work of some 600 units, counted from 1).
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lectern.functions import text as T
from lectern.operators import assemble, search, sections
from lectern.plans.corpus import _LINES, _indexed, _lines, _works, query, table
from lectern.sources import docx, works

#: A paragraph of a line: work, i and s, the line's beginning.
_MADE = """CASE (work * 5 + i * 7) % 24 WHEN 0 THEN '문단 ' || i WHEN 1 THEN '[0123a0' || (i % 10) || '] 원문' WHEN 2 THEN '한국어 번역'
WHEN 3 THEN '원문: 大乘 ' || s WHEN 4 THEN '번역 ' || s WHEN 5 THEN '[0' || (i % 900 + 100) || 'b07]' WHEN 6 THEN '大乘起信論' WHEN 7 THEN '【大乘】경'
WHEN 8 THEN '주' WHEN 9 THEN '문단 3 주' WHEN 10 THEN '제' || i || '항 ' || s WHEN 11 THEN i || '. ' || s WHEN 12 THEN 'A. ' || s WHEN 13 THEN '편집 안내'
WHEN 14 THEN '번역 각주 ' || s WHEN 15 THEN '주석 ' || i || ' ' || s WHEN 16 THEN '卷第一 大乘' WHEN 17 THEN '원문 목차' WHEN 18 THEN '직역: ' WHEN 19 THEN '[0100a01]大乘無量'
WHEN 20 THEN '대승 大乘' WHEN 21 THEN '大' WHEN 22 THEN '권 제' || i || ' ' || s ELSE s END"""
_STYLE = "CASE (work + i) % 7 WHEN 0 THEN 'Heading 3' WHEN 1 THEN 'Unit Label' WHEN 2 THEN 'Footnote Text' WHEN 3 THEN 'Editorial' WHEN 4 THEN 'heading' ELSE 'Normal' END"
_MADE_SQL = f"SELECT work, i, {_MADE} AS t, {_STYLE} AS style FROM (SELECT work, i, trim(substr(line, 1, 12)) AS s FROM ({_LINES}))"
_UNITS = "SELECT l_suppkey AS work, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS INTEGER) AS i FROM lineitem"
_BARE = r"trim(regexp_replace(regexp_replace(t, '\[\d{3,4}[abc]\d{2}\]', '', 'g'), '^[【〔\[(（]+|[】〕\])）]+$', '', 'g'))"
_SIDE = f"regexp_replace(regexp_extract(t, '{T.SIDE_PREFIX}', 1), '\\s', '', 'g')"


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _source_sql(t: str) -> str:
    letters, korean = r"len(regexp_extract_all(b, '\p{L}'))", r"len(regexp_extract_all(b, '[\x{ac00}-\x{d7a3}]'))"
    return rf"(SELECT length(b) >= 2 AND regexp_matches(b, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]') AND {korean} < 0.12 * {letters} FROM (SELECT {_BARE.replace('(t,', f'({t},')} AS b))"


def _made(spark, sf_dir):
    u = _lines(spark, sf_dir).select("work", "i", F.trim(F.substring("line", 1, 12)).alias("s"))
    return u.select("work", "i", F.expr(_MADE).alias("t"), F.expr(_STYLE).alias("style"))


def _unit_rows(spark, sf_dir):
    i = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("work"), i.alias("i"))


@query(
    f"SELECT work, i, {_source_sql('t')} AS source_like, trim(t) <> '' AND length(trim(t)) <= 40 AND regexp_matches(trim(t), '{'|'.join(T.LABEL_WORDS)}') AND regexp_matches(trim(t), '{T.UNIT_LABEL}') AS unit_label, "
    rf"rtrim(t, ' :：') IN {_words(T.LABELS)} AS label, CASE WHEN regexp_full_match(t, '\[\d{{3,4}}[abc]\d{{2}}\]') THEN t[2:-2] END AS marker, length(t) <= 8 AND regexp_matches(t, '{T.NOTE_HEAD}') AS note_head "
    f"FROM ({_MADE_SQL})"
)
def paragraph_labels(spark, sf_dir):
    t = F.col("t")
    return _made(spark, sf_dir).select("work", "i", T.is_source_line(t).alias("source_like"), T.is_unit_label(t).alias("unit_label"), T.is_label(t).alias("label"), T.pure_marker(t).alias("marker"), T.is_note_head(t).alias("note_head"))


@query(
    f"SELECT work, i, regexp_matches(style, '[Hh]eading') OR style IN {_words(T.HEAD_STYLES)} OR regexp_matches(t, '{T.HEAD_PREFIX}') AS heading, "
    f"CASE WHEN regexp_matches(trim(t), '{T.NOTE_HEAD}') THEN 'note' WHEN rtrim(t, ' :：') IN {_words(T.LABEL_HEADS)} THEN 'label' WHEN regexp_matches(trim(t), '{T.UNIT_HEAD}') THEN 'unit' WHEN regexp_matches(trim(t), '{T.APPARATUS_HEAD}') THEN 'apparatus' ELSE 'structure' END AS kind, "
    f"CAST(CASE WHEN style = 'Heading 3' THEN 3 ELSE 2 END AS INTEGER) AS level FROM ({_MADE_SQL})"
)
def paragraph_headings(spark, sf_dir):
    t, style = F.col("t"), F.col("style")
    return _made(spark, sf_dir).select("work", "i", T.is_heading(t, style).alias("heading"), T.classify_head(t).alias("kind"), T.head_level(style).alias("level"))


@query(
    f"WITH p AS (SELECT *, CASE WHEN {_SIDE} = '' THEN NULL WHEN {_SIDE} IN ('원문', '한문원문', '본문') THEN 'cn' ELSE 'ko' END AS side FROM ({_MADE_SQL})), "
    f"q AS (SELECT work, i, side, style, CASE WHEN side IS NULL THEN t ELSE trim(regexp_replace(t, '{T.SIDE_PREFIX}', '')) END AS text FROM p) "
    f"SELECT work, i, side, text, CASE WHEN side = 'cn' OR side IS NULL AND {_source_sql('text')} THEN 'cn' WHEN coalesce(side, '') <> 'ko' AND (style IN ('Footnote Text', 'Editorial') OR regexp_matches(text, '{T.NOTE_PREFIX}')) THEN 'note' ELSE 'ko' END AS block FROM q"
)
def paragraph_sides(spark, sf_dir):
    p = _made(spark, sf_dir).withColumn("x", T.strip_side(F.col("t"))).select("work", "i", "style", "x.text", "x.side")
    return p.select("work", "i", "side", "text", T.block_kind(F.col("text"), F.col("side"), F.col("style")).alias("block"))


_MARK = "'[0' || (i % 900 + 100) || 'a01]'"
_CARRIED = f"CASE (work + i * 3) % 7 WHEN 0 THEN {_MARK} || '大乘起信' || {_MARK} || ' 論曰無量' WHEN 1 THEN '衆生無邊' WHEN 2 THEN '【科文】大乘' WHEN 3 THEN '대승기신론 ' || i WHEN 4 THEN '經' || {_MARK} || '卷' ELSE '如是我聞 ' END"


@query(
    f"WITH p AS (SELECT work, i AS pos, {_CARRIED} AS t FROM ({_UNITS})), s AS (SELECT work, pos, unnest(string_split(replace(t, '[', chr(1) || '['), chr(1))) AS x, generate_subscripts(string_split(replace(t, '[', chr(1) || '['), chr(1)), 1) AS k FROM p WHERE {_source_sql('t')} AND NOT starts_with(t, '【')) "
    "SELECT work, CAST(row_number() OVER w AS INTEGER) AS i, last_value(CASE WHEN starts_with(x, '[') THEN x[2:8] END IGNORE NULLS) OVER w AS m, trim(x) AS cn FROM s WHERE trim(x) <> '' WINDOW w AS (PARTITION BY work ORDER BY pos, k)"
)
def source_documents(spark, sf_dir):
    """Word files of source text alone: the last marker is carried on."""
    p = _unit_rows(spark, sf_dir).select("work", F.col("i").alias("pos"), F.expr(_CARRIED).alias("text"))
    return docx.source_units(p, "work").select("work", "i", "m", "cn")


_LAID = f"CASE WHEN work % 3 = 1 AND i % 3 = 0 THEN {_MARK} WHEN work % 3 = 1 AND i % 200 = 1 OR work % 3 = 2 AND i % 5 = 0 THEN '大乘起信論' ELSE '대승 ' || i END"


@query(
    rf"WITH p AS (SELECT work, count(*) AS n, count(*) FILTER (regexp_full_match(t, '\[\d+[abc]\d+\]')) AS a, count(*) FILTER (t = '大乘起信論') AS s FROM (SELECT work, {_LAID} AS t FROM ({_UNITS})) GROUP BY work) "
    "SELECT work, CASE WHEN work % 4 = 0 THEN 'table' WHEN a >= 20 AND s < 0.03 * n THEN 'translation' ELSE 'general' END AS layout FROM p"
)
def document_layouts(spark, sf_dir):
    """Aligned tables of fewer than three rows don't make a table document."""
    p = _unit_rows(spark, sf_dir).select("work", F.expr(_LAID).alias("text"))
    row = "array('[0100a01]', '大', '대')"
    t = p.select("work").distinct().where("work % 2 = 0").select("work", F.expr(f"CASE WHEN work % 4 = 0 THEN array(array('위치표지', '원문', '번역'), {row}, {row}) ELSE array(array('위치표지', '원문', '번역'), {row}) END").alias("rows"))
    return docx.layout(p, t, "work")


_ALONE = f"CASE WHEN i > 3 AND i % 4 = 0 THEN {_MARK} ELSE '대승 ' || i END"
_ALONE_STYLE = "CASE WHEN i IN (2, 401) THEN 'Heading 1' WHEN i % 7 = 0 THEN 'Audit' ELSE 'Normal' END"


@query(
    f"WITH p AS (SELECT work, i, {_ALONE} AS t, i % 7 = 0 AS noted, CASE WHEN i < 4 THEN 'front' WHEN i < 401 THEN 'body' ELSE 'back' END AS place FROM ({_UNITS})), "
    "q AS (SELECT *, CASE WHEN place = 'body' THEN i // 4 END AS u, place = 'back' OR i % 4 > 0 OR i < 4 AS plain FROM p) "
    "SELECT work, place, CAST(u AS BIGINT) AS u, max(CASE WHEN place = 'body' AND i % 4 = 0 THEN t[2:-2] END) AS m, coalesce(string_agg(t, '|' ORDER BY i) FILTER (plain AND NOT noted), '') AS ko, coalesce(string_agg(t, '|' ORDER BY i) FILTER (plain AND noted), '') AS nt FROM q GROUP BY work, place, u"
)
def translation_documents(spark, sf_dir):
    """Word files of the translation alone: a marker a unit, what stands before the first, what follows a heading."""
    p = _unit_rows(spark, sf_dir).select("work", F.col("i").alias("pos"), F.expr(_ALONE).alias("text"), F.expr(_ALONE_STYLE).alias("style"))
    u = docx.translation_units(p, "work")
    return u.select("work", "place", "u", "m", F.array_join("ko", "|").alias("ko"), F.array_join("nt", "|").alias("nt"))


def _nation_tables(spark, sf_dir, head: str, row: str, t: int = 0):
    """A table a nation: the head's row (where it isn't null), then its customers'."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path"), F.col("c_custkey").alias("c"))
    g = c.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("c", F.expr(row).alias("r")))).alias("l"))
    h = F.expr(head)
    return g.select("path", F.lit(t).alias("t"), F.concat(F.when(h.isNotNull(), F.array(h)).otherwise(F.array_remove(F.array(F.array(F.lit(""))), F.array(F.lit("")))), "l.r").alias("rows"))


@query(
    "WITH c AS (SELECT c_nationkey AS path, c_custkey AS c FROM customer WHERE c_custkey % 7 > 0) SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY c) AS INTEGER) AS i, lpad(CAST(c % 9000 + 100 AS VARCHAR), 4, '0') || 'a01' AS m, "
    "CASE WHEN c % 3 = 0 THEN '' ELSE '大乘' || c || '|經' END AS cn, '대승|' || c AS ko, CASE WHEN c % 5 = 0 THEN '풀이' ELSE '' END AS nt FROM c"
)
def table_documents(spark, sf_dir):
    """Aligned tables, with and without a head: lines after a note heading are notes; empty rows go."""
    row = (
        "CASE WHEN c % 7 = 0 THEN array('[' || lpad(CAST(c % 9000 + 100 AS STRING), 4, '0') || 'a01]', '', ' ') ELSE array('[' || lpad(CAST(c % 9000 + 100 AS STRING), 4, '0') || 'a01]', "
        "CASE WHEN c % 3 = 0 THEN '' ELSE '大乘' || c || chr(10) || ' 經 ' END, '대승' || chr(10) || chr(10) || c || CASE WHEN c % 5 = 0 THEN chr(10) || '각주' || chr(10) || '풀이' ELSE '' END) END"
    )
    t = _nation_tables(spark, sf_dir, "CASE WHEN path % 2 = 0 THEN array('위치표지', '원문', '번역') END", row)
    u = docx.table_units(t)
    return u.select("path", "i", "m", *[F.array_join(c, "|").alias(c) for c in ("cn", "ko", "nt")])


_GLOSSED = "array('가' || c, CASE WHEN c % 6 = 0 THEN '' ELSE '나' || c END, '다' || c)"


@query(
    "SELECT c_nationkey AS path, CASE c_nationkey % 3 WHEN 0 THEN '나' ELSE '가' END || c_custkey AS cn, CASE c_nationkey % 3 WHEN 0 THEN '가' ELSE '나' END || c_custkey AS ko, "
    "'다' || c_custkey AS note FROM customer WHERE c_custkey % 6 > 0"
)
def glossaries(spark, sf_dir):
    """The first fitting table: later ones and those without a fitting head are passed over."""
    none = _nation_tables(spark, sf_dir, "array('구분', '값', '값')", _GLOSSED)
    first = _nation_tables(spark, sf_dir, "CASE path % 3 WHEN 0 THEN array('번역어', '원어', '비고') WHEN 1 THEN array('원어', ' 번역어', '') ELSE array('원문', '번역', '주') END", _GLOSSED, 1)
    later = _nation_tables(spark, sf_dir, "array('원어', '번역어')", "array('x', 'y')", 2)
    g = docx.glossary(none.unionByName(first).unionByName(later))
    return g.select("path", F.explode("entries").alias("e")).select("path", "e.cn", "e.ko", "e.note")


@query(
    "SELECT DISTINCT c_nationkey AS path, k AS name, CASE k WHEN '문헌명' THEN CASE WHEN c_nationkey % 4 = 0 THEN '둘' ELSE '하나' END WHEN '역자' THEN '모' || c_nationkey ELSE '3' END AS value FROM customer, (VALUES ('문헌명'), ('역자'), ('권수')) t(k)"
)
def bibliographies(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path")).distinct()
    made = lambda t, e: p.select("path", F.lit(t).alias("t"), F.expr(e).alias("rows"))
    first = made(0, "array(array('항목', '내용'), array('문헌명', CASE WHEN path % 4 = 0 THEN '' ELSE '하나' END), array('역자', '모' || path))")
    wide = made(1, "array(array('항목', '내용', '비고'), array('판본', '넷', ''))")
    later = made(2, "array(array('구분', '내용'), array('문헌명', '둘'), array('권수', '3'), array('역자', '다른 이'))")
    return docx.bibliography(first.unionByName(wide).unionByName(later), "path")


_EVENT_UNITS = (
    "WITH b AS (SELECT user_id, event_id, ts, event_type AS k FROM events), p AS (SELECT *, lag(CASE WHEN k <> 'x' THEN k END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pk FROM b), "
    "q AS (SELECT *, sum(CASE WHEN k = 'view' AND coalesce(pk, '') <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS u FROM p)"
)


def _event_blocks(spark, sf_dir, head: str):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'cn' WHEN 'click' THEN 'ko' WHEN 'purchase' THEN 'head' ELSE 'note' END")
    m = F.expr("CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN '0100a01' END")
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", kind.alias("kind"), F.when(kind == "head", head).alias("hkind"), F.expr("event_type || (event_id % 3)").alias("text"), F.lit(1).alias("lv"), m.alias("m"), F.lit(None).cast("string").alias("head")
    )


@query(
    _EVENT_UNITS + ", l AS (SELECT user_id, max(u) AS last FROM q GROUP BY user_id), s AS (SELECT user_id, u, k || (event_id % 3) AS t, event_id, lag(k || (event_id % 3)) OVER (PARTITION BY user_id, u ORDER BY ts, event_id) AS prev FROM q WHERE k = 'purchase') "
    "SELECT user_id, CAST(u + 1 AS BIGINT) AS i, event_id, t FROM s JOIN l USING (user_id) WHERE u < last AND prev IS DISTINCT FROM t"
)
def pending_sections(spark, sf_dir):
    s = assemble.sections(_event_blocks(spark, sf_dir, "structure"), "user_id", ("ts", "event_id"))
    return s.select("user_id", F.col("i").cast("long").alias("i"), "ord.event_id", "t")


@query(
    _EVENT_UNITS + ", f AS (SELECT *, coalesce(last_value(CASE k WHEN 'purchase' THEN true WHEN 'view' THEN false END IGNORE NULLS) OVER w, true) AS shut, coalesce(max(k = 'view' AND event_id % 2 = 0) OVER w, false) AS begun FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT user_id, coalesce(string_agg(k || (event_id % 3), '|' ORDER BY ts, event_id) FILTER (NOT begun), '') AS front, coalesce(string_agg(k || (event_id % 3), '|' ORDER BY ts, event_id) FILTER (begun), '') AS appendix FROM f WHERE k IN ('click', 'signup', 'error') AND (shut OR u < 0) GROUP BY user_id"
)
def front_and_appendix(spark, sf_dir):
    m = assemble.matter(_event_blocks(spark, sf_dir, "apparatus"), "user_id", ("ts", "event_id"))
    return m.select("user_id", F.array_join("front", "|").alias("front"), F.array_join("appendix", "|").alias("appendix"))


#: Ten lines a unit. Every second has a marked paragraph, some with a marker that the source lacks; after the fifth an
#: unmarked one comes, in every fourth unit two.
_LINE_OF = "'[' || lpad(CAST(i % 9000 + 100 AS STRING), 4, '0') || 'a01]'"
_PIECE_MARK = f"CASE WHEN i % 23 = 0 THEN '[9999c99]' ELSE {_LINE_OF} END"


def _split_units(spark, sf_dir):
    u = _unit_rows(spark, sf_dir).withColumn("u", F.expr("CAST((i - 1) div 10 AS INT)")).withColumn("j", F.expr("(i - 1) % 10"))
    said = F.expr(f"CASE WHEN j % 2 = 0 THEN concat(array({_PIECE_MARK} || '대승' || i), CASE WHEN j < 8 THEN CAST(array() AS ARRAY<STRING>) WHEN u % 4 = 3 THEN array('하나', '둘') ELSE array('하나') END) END")
    u = u.withColumn("mk", F.expr(_LINE_OF)).withColumn("ko", said).withColumn("cn", F.expr(f"{_LINE_OF} || '大乘' || i"))
    none = F.array().cast("array<string>")
    g = u.groupBy("work", "u").agg(F.array_sort(F.collect_list(F.struct("j", "mk", "cn", "ko"))).alias("l"))
    return g.select("work", "u", F.expr("substring(l[0].mk, 2, 7)").alias("m"), F.col("l.cn").alias("cn"), F.expr("flatten(filter(l.ko, x -> x IS NOT NULL))").alias("ko"), none.alias("nt"), F.lit(None).cast("string").alias("h"))


_SPLIT_SQL = f"""WITH b AS (SELECT work, i, (i - 1) // 10 AS u, (i - 1) % 10 AS j, trim({_LINE_OF}, '[]') AS mk, trim({_PIECE_MARK}, '[]') AS pm, i % 23 > 0 AS found FROM ({_UNITS})),
n AS (SELECT work, u, CAST(count(*) AS INTEGER) AS n, NOT (u % 4 = 3 AND count(*) >= 9) AND count(*) >= 3 AS go, min(mk) FILTER (j = 0) AS mk, CASE WHEN count(*) < 9 THEN (count(*) + 1) // 2 ELSE 7 END AS k FROM b GROUP BY work, u),
s AS (SELECT work, u, n, j // 2 AS piece, pm, CASE WHEN found THEN j ELSE greatest(j - 2, 0) END AS s0 FROM b JOIN n USING (work, u) WHERE go AND j % 2 = 0),
e AS (SELECT *, greatest(s0, coalesce(lead(s0) OVER (PARTITION BY work, u ORDER BY piece), n)) AS s1 FROM s),
z AS (SELECT work, u, piece, pm AS m, s1 - s0 AS n_cn, CASE WHEN piece = 4 THEN 2 ELSE 1 END AS n_ko FROM e UNION ALL SELECT work, u, 0, mk, n, CASE WHEN n < 9 THEN (n + 1) // 2 ELSE 7 END FROM n WHERE NOT go)"""


@query(_SPLIT_SQL + " SELECT work, CAST(u AS INTEGER) AS u, CAST(piece AS INTEGER) AS piece, m, CAST(n_cn AS INTEGER) AS n_cn, CAST(n_ko AS INTEGER) AS n_ko FROM z")
def split_pieces(spark, sf_dir):
    s = assemble.split_by_translation(_split_units(spark, sf_dir), "work")
    return s.select("work", "u", "piece", "m", F.size("cn").alias("n_cn"), F.size("ko").alias("n_ko"))


@query(
    _SPLIT_SQL + ", c AS (SELECT work, u, count(*) AS k FROM z GROUP BY work, u) SELECT work, CAST(u AS BIGINT) AS old, CAST(sum(k) OVER (PARTITION BY work ORDER BY u) - k AS BIGINT) AS new FROM c "
    "UNION ALL SELECT work, CAST(max(u) + 1 AS BIGINT), CAST(sum(k) AS BIGINT) FROM c GROUP BY work"
)
def split_places(spark, sf_dir):
    return assemble.remap(assemble.split_by_translation(_split_units(spark, sf_dir), "work"), "work").select("work", "old", F.col("new").cast("long").alias("new"))


_PAGE_MARK = "lpad(CAST((i - 1) // 7 + 100 AS VARCHAR), 4, '0') || 'a0' || ((i - 1) % 7 + 1)"
_LABEL = "{} || '–' || {}"


def _at(i: str) -> str:
    return "(" + _PAGE_MARK.replace("(i - 1)", f"(({i}) - 1)") + ")"


@query(
    f"""WITH n AS (SELECT work, CAST(CASE WHEN work % 3 = 1 THEN 84 + work % 4 ELSE count(*) END AS INTEGER) AS n FROM ({_UNITS}) GROUP BY work),
r AS (SELECT work, n, 0 AS base, n AS stop, CASE work % 3 WHEN 1 THEN 28 ELSE 91 END AS step, CASE work % 3 WHEN 1 THEN 3 ELSE 45 END AS tail, NULL AS t FROM n WHERE work % 3 > 0
UNION ALL SELECT work, n, 0, 210, 91, 45, 'A' FROM n WHERE work % 3 = 0 UNION ALL SELECT work, n, 210, n, 91, 45, 'B' FROM n WHERE work % 3 = 0),
k AS (SELECT *, unnest(range(base + step, stop, step)) AS cut FROM r), l AS (SELECT *, lead(cut) OVER (PARTITION BY work, base ORDER BY cut) AS nxt FROM k),
c AS (SELECT * FROM l WHERE nxt IS NOT NULL OR stop - cut >= tail), e AS (SELECT *, coalesce(lead(cut) OVER w, stop) AS fin, row_number() OVER w AS p, min(cut) OVER (PARTITION BY work, base) AS least FROM c WINDOW w AS (PARTITION BY work, base ORDER BY cut))
SELECT work, CAST(cut AS INTEGER) AS i, coalesce(t || ' (' || (p + 1) || ') ', '') || {_at('cut + 1')} || '–' || {_at('fin')} AS t FROM e
UNION ALL SELECT work, 0, {_at('1')} || '–' || {_at('least')} FROM e WHERE t IS NULL AND p = 1 UNION ALL SELECT work, base, t FROM r WHERE t IS NOT NULL"""
)
def chapter_policy(spark, sf_dir):
    """Works with headings, long texts of few units, and works of many units: long chapters are cut again by page."""
    u = _unit_rows(spark, sf_dir).where("work % 3 != 1 or i <= 84 + work % 4")
    u = u.select("work", "i", F.expr(_PAGE_MARK.replace("VARCHAR", "STRING").replace("//", "div")).alias("m"))
    heads = u.where("work % 3 = 0 and i in (1, 211)").select("work", (F.col("i") - 1).alias("i"), F.lit(1).alias("lv"), F.when(F.col("i") == 1, "A").otherwise("B").alias("t"))
    lengths = u.select("work", "i", "m", F.lit(1000).alias("n"))
    return sections.choose(u, heads, lengths).select("work", F.col("i").cast("int").alias("i"), "t")


@query(
    f"SELECT work, CAST(i - 1 AS INTEGER) AS i, CASE WHEN i % 5 = 1 THEN '經卷第' || substr('一二三四五六七八九十', i // 5 + 1, 1) ELSE '論卷' || substr('上中下', i % 3 + 1, 1) END AS t FROM ({_UNITS}) WHERE i <= 50 AND i % 5 = 1 OR i IN (2, 3, 4)"
)
def volume_titles(spark, sf_dir):
    """Each unit's first volume title that none before was given; longer lines and other volumes are none."""
    cn = F.expr("array(' 經卷第' || substr('一二三四五六七八九十', (i - 1) div 5 + 1, 1), '如是我聞卷' || i, '論卷' || substr('上中下', i % 3 + 1, 1))")
    u = _unit_rows(spark, sf_dir).where("i <= 50").select("work", "i", cn.alias("cn"))
    return sections.volume_lines(u).select("work", "i", "t")


_SHOWN = "lower(regexp_replace(text, '[\\s。，、．・？！：；「」『』（）()〔〕【】\\[\\]“”‘’·…—　]', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n_cn, CASE WHEN lang = 'en' THEN 0 ELSE CAST((length({_SHOWN}) - length(replace({_SHOWN}, 'en', ''))) // 2 AS INTEGER) END AS n_ko FROM documents")
def spotlights(spark, sf_dir):
    """Places of the query on the side of the hit; where that has none, on both."""
    u = table(spark, sf_dir, "documents").select("doc_id", F.array("lang").alias("cn"), F.array("text").alias("ko"))
    return search.spotlight(u, "e n", "cn").select("doc_id", F.size("cn_marks").alias("n_cn"), F.size("ko_marks").alias("n_ko"))


@query("SELECT source AS work, doc_id AS i, upper(source) AS title FROM documents WHERE contains(lower(text), 'tion') ORDER BY source, doc_id LIMIT 25")
def search_limited(spark, sf_dir):
    """The first hits in the order of the catalogue and of units, with their work's title."""
    return search.hits(_indexed(spark, sf_dir), _works(spark, sf_dir), "TION", "ko", 25).select("work", "i", "title")


_UNIT_JSON = """'{"i":' || i || ',"m":' || CASE WHEN i % 3 = 0 THEN 'null' ELSE '"0100a0' || (i % 10) || '"' END || ',"cn":["大\\"乘' || i || '"],"ko":' || CASE WHEN i % 2 = 0 THEN '[]' ELSE '["대승","둘"]' END || ',"nt":[]' || CASE WHEN i % 5 = 0 THEN ',"h":"h"' ELSE '' END || CASE WHEN i % 7 = 0 THEN ',"x":1' ELSE '' END || ',"c":' || i // 50 || '}'"""


@query(
    f"""SELECT work, '{{"meta":{{"title":"책 ' || work || '"}},"glossary":' || CASE WHEN work % 2 = 0 THEN '[{{"cn":"大","ko":"대","note":""}}]' ELSE '[]' END || ',"front":' || CASE WHEN work % 3 = 0 THEN '["앞","뒤"]' ELSE '[]' END || ',"chapters":[{{"t":"A","i":0}},{{"t":"B","i":50}}],"sections":' ||
CASE WHEN work % 5 = 0 THEN '[]' ELSE '[{{"lv":1,"t":"A","i":0}}]' END || ',"units":[' || string_agg({_UNIT_JSON}, ',' ORDER BY i) || ']}}' AS json FROM ({_UNITS}) GROUP BY work"""
)
def work_documents(spark, sf_dir):
    """The whole document of a work as it is written."""
    none = "CAST(array() AS ARRAY<STRING>)"
    u = _unit_rows(spark, sf_dir)
    u = u.select(
        "work", "i", F.expr("CASE WHEN i % 3 > 0 THEN '0100a0' || (i % 10) END").alias("m"), F.array(F.concat(F.lit('大"乘'), F.col("i").cast("string"))).alias("cn"), F.expr(f"CASE WHEN i % 2 = 0 THEN {none} ELSE array('대승', '둘') END").alias("ko"), F.expr(none).alias("nt"),
        F.expr("CASE WHEN i % 5 = 0 THEN 'h' END").alias("h"), F.expr("CASE WHEN i % 7 = 0 THEN 1 END").alias("x"), F.expr("CAST(i div 50 AS INT)").alias("c"),
    )
    w = u.select("work").distinct()
    chapters = w.select("work", F.explode(F.expr("array(struct('B' AS t, 50 AS i), struct('A' AS t, 0 AS i))")).alias("c")).select("work", "c.t", "c.i")
    heads = w.where("work % 5 > 0").select("work", F.lit(0).alias("i"), F.lit(1).alias("lv"), F.lit("A").alias("t"))
    gloss = w.where("work % 2 = 0").select("work", F.expr("array(struct('大' AS cn, '대' AS ko, '' AS note))").alias("entries"))
    matter = w.where("work % 3 = 0").select("work", F.array(F.lit("앞")).alias("front"), F.array(F.lit("뒤")).alias("appendix"))
    meta = w.select("work", F.concat(F.lit("책 "), F.col("work").cast("string")).alias("title"))
    return works.documents(meta, u, heads, chapters, gloss, matter)
