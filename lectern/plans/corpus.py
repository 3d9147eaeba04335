"""Registered queries of the corpus operators over the driver's tables, and their SQL.

Documents stand for units and their source for the work; markers are made by one expression in both engines.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window as W, functions as F

from lectern.functions import text as T
from lectern.operators import align, assemble, reader, search, sections, stats
from lectern.sources import text as source_text

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _indexed(spark, sf_dir):
    """Documents as translation, their language as source text."""
    d = table(spark, sf_dir, "documents")
    return search.index(d.select(F.col("source").alias("work"), F.col("doc_id").alias("i"), F.lit(None).cast("string").alias("m"), F.array("lang").alias("cn"), F.array("text").alias("ko")))


def _works(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.col("source").alias("work")).distinct()
    return w.select("work", F.upper("work").alias("title"), F.lit(None).cast("string").alias("title_ko"), F.col("work").alias("ord"))


_DROP = r"[\s。，、．・？！：；「」『』（）()〔〕【】\[\]“”‘’·…—　]"


def _norm_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '\[(\d{{3,4}}[abc]\d{{2}})\]', '', 'g'), '\[(?:\d{{1,3}}|＊|\*)\]', '', 'g'), '{_DROP}', '', 'g')"


_FOLDED = f"translate({_norm_sql('text')}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"


#: A needle's first place in search text, and what the raw text has there: by the places of the characters that stay.
def _placed_sql(needle: str, drop: str, extra: str = "") -> str:
    return rf"""WITH n AS (SELECT doc_id, source, lang, text, string_split(text, '') AS ch, lower(regexp_replace(text, '{drop}', '', 'g')) AS norm FROM documents),
f AS (SELECT *, list_filter(generate_series(1, len(ch)), lambda i: NOT regexp_matches(ch[i], '{drop}')) AS pl, instr(norm, '{needle}') AS p FROM n WHERE contains(norm, '{needle}')){extra} """


_SPACE = r"\s"
_SNIP_SQL = """SELECT {} CASE WHEN pl[p] > 35 THEN '…' ELSE '' END || array_to_string(ch[greatest(1, pl[p] - 34):pl[p] - 1], '') AS pre,
array_to_string(ch[pl[p]:pl[p + 4]], '') AS hit, array_to_string(ch[pl[p + 4] + 1:pl[p + 4] + 34], '') || CASE WHEN pl[p + 4] + 34 < len(ch) THEN '…' ELSE '' END AS post FROM f"""


@query("SELECT w.source AS work, CAST(count(d.doc_id) AS BIGINT) AS n FROM (SELECT DISTINCT source FROM documents) w LEFT JOIN documents d ON d.source = w.source AND contains(regexp_replace(lower(d.text), '\\s', '', 'g'), 'erththe') GROUP BY w.source")
def search_counts_zero_filled(spark, sf_dir):
    return search.counts(_indexed(spark, sf_dir), _works(spark, sf_dir), "Erth the", "ko").select("work", "n")


@query(_placed_sql("tione", _SPACE) + _SNIP_SQL.format("source AS work, upper(source) AS title, doc_id AS i, 'ko' AS side, lang AS alt,"))
def search_hits(spark, sf_dir):
    h = search.hits(_indexed(spark, sf_dir), _works(spark, sf_dir), "Ti one", "both")
    return h.select("work", "title", "i", F.col("where").alias("side"), "alt", "snip.pre", "snip.hit", "snip.post")


@query("SELECT doc_id, CASE WHEN contains(lower(lang), 'e') THEN 'cn' ELSE 'ko' END AS side FROM documents WHERE contains(lang, 'e') OR contains(lower(text), 'e')")
def search_source_first(spark, sf_dir):
    h = search.hits(_indexed(spark, sf_dir), _works(spark, sf_dir), "e")
    return h.select(F.col("i").alias("doc_id"), F.col("where").alias("side"))


@query("WITH c AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn, text) AS u, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn, text) AS a FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN contains(u, 'the') THEN 'cn' WHEN contains(a, 'the') THEN 'ko' END AS side FROM c WHERE contains(u, 'the') OR contains(a, 'the')")
def search_scoped_precedence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    c = c.groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"))
    return c.withColumn("side", search.side_of(F.col("u"), F.col("a"), "the", "the")).where("side is not null").select("conv_id", "side")


@query("SELECT source AS work, CAST(count(*) AS BIGINT) AS n FROM documents WHERE contains(text, 'tion') GROUP BY ROLLUP (source)")
def facet_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("tion")).groupBy("source").count()
    return search.facets(d.select(F.col("source").alias("work"), F.col("count").alias("n"), F.col("source").alias("ord"))).select("work", F.col("n").cast("long").alias("n"))


@query("SELECT source AS work, doc_id AS i FROM documents WHERE contains(text, 'tion') ORDER BY source, doc_id LIMIT 10 OFFSET 20")
def hit_paging(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("tion")).select(F.col("source").alias("work"), F.col("doc_id").alias("i"), F.lit(0).alias("ord"))
    return search.page(d, 3, 10).select("work", "i")


@query(_placed_sql("tion,", _SPACE) + _SNIP_SQL.format("doc_id,"))
def kwic_first(spark, sf_dir):
    """A needle with a mark, which search text of the translation keeps."""
    d = table(spark, sf_dir, "documents").where(T.norm_ko(F.col("text")).contains("tion,"))
    return d.select("doc_id", T.kwic(F.col("text"), F.lit("tion,"), "ko").alias("k")).select("doc_id", "k.pre", "k.hit", "k.post")


@query(
    _placed_sql("tione", _DROP, ", g AS (SELECT doc_id, pl, list_transform(string_split(norm, 'tione'), lambda x: length(x)) AS l FROM f), h AS (SELECT doc_id, pl, list_transform(range(1, len(l)), lambda k: CAST(list_sum(l[1:k]) AS BIGINT) + 5 * (k - 1)) AS ps FROM g)")
    + "SELECT doc_id, list_transform(ps, lambda p: CAST(pl[p + 1] - 1 AS VARCHAR) || '-' || CAST(pl[p + 5] AS VARCHAR)) AS ranges FROM h"
)
def ranges_all(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.find_ranges(F.col("text"), F.lit("tione"), "ko").alias("r")).where(F.size("r") > 0)
    return d.select("doc_id", F.transform("r", lambda r: F.concat_ws("-", r["start"], r["end"])).alias("ranges"))


@query("SELECT doc_id, replace(replace(replace(replace(regexp_replace(text, 'tion', chr(1) || 'tion' || chr(2), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;').replace(chr(1), '<mark class=\"hit-mark\">').replace(chr(2), '</mark>') AS html FROM documents WHERE NOT regexp_matches(text, '[Tt][^a-zA-Z]*[Ii][^a-zA-Z]*[Oo][^a-zA-Z]*[Nn]') OR regexp_replace(text, 'tion', '', 'g') NOT SIMILAR TO '(?s).*[Tt][^a-zA-Z]*[Ii][^a-zA-Z]*[Oo][^a-zA-Z]*[Nn].*'")
def marked_html(spark, sf_dir):
    """Every place of the needle marked, of texts that have it in one spelling only."""
    d = table(spark, sf_dir, "documents")
    spelled = r"(?i)t[^a-zA-Z]*i[^a-zA-Z]*o[^a-zA-Z]*n"
    d = d.where(~F.regexp_like(F.regexp_replace("text", "tion", ""), F.lit(spelled)))
    return d.select("doc_id", T.mark_ranges(F.col("text"), T.find_ranges(F.col("text"), F.lit("tion"), "ko")).alias("html"))


_FOLDS = f"SELECT doc_id, lang || substr('{T.FOLD_FROM}', doc_id % {len(T.FOLD_FROM)} + 1, 2) || lang AS s FROM documents"


@query(f"SELECT doc_id, translate(s, '{T.FOLD_FROM}', '{T.FOLD_TO}') AS search, translate(s, '{T.FOLD_FROM[:-1]}', '{T.FOLD_TO[:-1]}') AS aligned FROM ({_FOLDS})")
def fold_translate(spark, sf_dir):
    """Every variant character in turn, as search and as alignment fold it."""
    at = (F.col("doc_id") % len(T.FOLD_FROM) + 1).cast("int")
    s = F.concat("lang", F.substring(F.lit(T.FOLD_FROM), at, F.lit(2)), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(s).alias("search"), T.fold(s, False).alias("aligned"))


@query(f"SELECT doc_id, {_FOLDED} AS norm FROM documents")
def norm_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_cn(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, CASE WHEN l = 0 THEN 0.0 ELSE h / l END AS ratio, false AS source_like FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}')) AS DOUBLE) AS l, CAST(len(regexp_extract_all(text, '[\x{ac00}-\x{d7a3}]')) AS DOUBLE) AS h FROM documents)")
def script_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hangul_ratio(F.col("text")).alias("ratio"), T.is_source_line(F.col("text")).alias("source_like"))


def _marked(text):
    """A text whose lines carry made-up markers."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("["), F.lpad((i + 100).cast("string"), 4, "0"), F.lit("a01]"), x)), " ")


_MARKED = "list_aggregate(list_transform(generate_series(1, len(string_split(text, chr(10)))), lambda i: '[' || lpad(CAST(i + 99 AS VARCHAR), 4, '0') || 'a01]' || string_split(text, chr(10))[i]), 'string_agg', ' ')"


@query(
    f"WITH p AS (SELECT doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS piece FROM (SELECT doc_id, string_split(regexp_replace({_MARKED}, '(\\[\\d{{3,4}}[abc]\\d{{2}}\\])', chr(1) || '\\1', 'g'), chr(1)) AS x FROM documents)) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, regexp_extract(piece, '^\\[(\\d{3,4}[abc]\\d{2})\\]', 1) AS m, CAST(length(trim(regexp_replace(piece, '[ \\t]+', ' ', 'g'))) AS BIGINT) AS n FROM p WHERE trim(piece) <> ''"
)
def split_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", _marked(F.col("text")).alias("text"))
    u = source_text.segment(d, "doc_id")
    return u.select("doc_id", F.col("i").cast("long").alias("i"), "m", F.length("cn").cast("long").alias("n"))


_KINDS = "CASE event_type WHEN 'view' THEN 'cn' WHEN 'click' THEN 'ko' WHEN 'purchase' THEN 'structure' ELSE 'note' END"


@query(
    f"WITH b AS (SELECT user_id, event_id, ts, {_KINDS} AS k FROM events), "
    "p AS (SELECT *, lag(k) OVER w AS pk, max(CASE WHEN k = 'cn' THEN 1 END) OVER w AS open FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "q AS (SELECT *, sum(CASE WHEN k = 'cn' AND coalesce(pk, '') <> 'cn' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS u FROM p) "
    "SELECT user_id, CAST(u AS BIGINT) AS u, CAST(count(*) FILTER (k = 'cn') AS BIGINT) AS n_cn, CAST(count(*) FILTER (k = 'ko') AS BIGINT) AS n_ko, CAST(count(*) FILTER (k = 'note') AS BIGINT) AS n_nt FROM q WHERE u >= 0 GROUP BY user_id, u"
)
def assemble_units(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "cn").when(F.col("event_type") == "click", "ko").when(F.col("event_type") == "purchase", "head").otherwise("note")
    b = e.select("user_id", "ts", "event_id", kind.alias("kind"), F.when(kind == "head", "structure").alias("hkind"), F.col("event_type").alias("text"), F.lit(1).alias("lv"), F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("head"))
    u = assemble.units(b, "user_id", ("ts", "event_id"))
    size = lambda c: F.size(c).cast("long")
    return u.select("user_id", F.col("u").cast("long").alias("u"), size("cn").alias("n_cn"), size("ko").alias("n_ko"), size("nt").alias("n_nt"))


@query("SELECT o.o_orderkey, c.start AS chapter FROM orders o ASOF LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS start FROM orders GROUP BY o_custkey, o_orderkey // 1000) c ON o.o_custkey = c.o_custkey AND o.o_orderkey >= c.start")
def chapters_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("i"))
    # units count from 1, chapters from 0
    c = o.groupBy("work", F.floor(F.col("i") / 1000)).agg(F.min("i").alias("start")).select("work", (F.col("start") - 1).alias("i"))
    u = sections.assign(o, c)
    ranked = c.withColumn("c", F.row_number().over(W.partitionBy("work").orderBy("i")) - 1)
    return u.join(ranked.select("work", "c", (F.col("i") + 1).alias("chapter")), ["work", "c"], "left").select(F.col("i").alias("o_orderkey"), "chapter")


@query("SELECT e.event_id, (SELECT min(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id >= e.event_id) AS place FROM events e WHERE e.event_type = 'signup' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id >= e.event_id)")
def section_forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.where("event_type = 'signup'").select(F.col("user_id").alias("work"), F.col("event_id").alias("i"), F.lit(1).alias("lv"), F.col("event_id").cast("string").alias("t"))
    p = e.where("event_type = 'purchase'").select(F.col("user_id").alias("work"), F.col("event_id").alias("old"), F.col("event_id").alias("new"))
    return align.section_places(s, p).select(F.col("t").cast("long").alias("event_id"), F.col("i").alias("place"))


@query(f"WITH k AS (SELECT doc_id, substr({_FOLDED}, 1, 14) AS key FROM documents) SELECT key, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM k GROUP BY key HAVING count(*) > 1")
def fingerprint_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.head_key(F.col("text")).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT b.item_id, d.doc_id, CAST(instr(d.text, substr(b.text, 1, 24)) AS BIGINT) AS at FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 24)) WHERE length(b.text) >= 24")
def passage_locate(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 24).alias("needle"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = search.locate(d, b.where(F.length("needle") == 24).withColumnRenamed("item_id", "id"), 24)
    return found.select(F.col("id").alias("item_id"), F.col("key").alias("doc_id"), "at")


@query("SELECT c.c_custkey AS work, coalesce(c.c_mktsegment, 'none') AS segment, coalesce(n.n_name, '?') AS canon FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def overlay_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    s = c.select(F.col("c_custkey").alias("work"))
    meta = c.select(F.col("c_custkey").alias("work"), F.col("c_mktsegment").alias("segment"))
    reg = c.select(F.col("c_custkey").alias("work"), F.col("n_name").alias("canon"))
    return stats.overlay(s, meta, reg, {"segment": "none", "canon": "?"}).select("work", "segment", "canon")


@query("SELECT coalesce(CAST(l.quality AS VARCHAR), 'none') AS source, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1 GROUP BY 1")
def rights_flag(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    works = d.select(F.col("doc_id").alias("id"), F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("source"))
    rights = works.select("source").distinct().select("source", F.when(F.col("source") != "none", F.col("source") == "1").alias("ok"))
    return stats.rights_flags(works, rights).select("source", F.size("ids").cast("long").alias("n"))


_TOGETHER = "SELECT d.source AS work, l.doc_id IS NOT NULL AS done, length(regexp_replace(d.text, '\\s', '', 'g')) AS n FROM documents d LEFT JOIN labels l USING (doc_id)"


def _units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit("k").alias("k")), "doc_id", "left")
    none = F.array().cast("array<string>")
    marker = F.concat(F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit("a01"))
    return d.select(F.col("source").alias("work"), F.col("doc_id").alias("i"), marker.alias("m"), F.array("text").alias("cn"), F.when(F.col("k").isNotNull(), F.array("k")).otherwise(none).alias("ko"), F.lit(None).cast("int").alias("x"))


def _stats(spark, sf_dir):
    return stats.work_stats(_units(spark, sf_dir), lambda c: F.length(F.regexp_replace(c, r"\s", "")))


@query(f"SELECT work, CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (done) AS BIGINT) AS translated, round_even(CASE WHEN sum(n) > 0 THEN CAST(coalesce(sum(n) FILTER (done), 0) AS DOUBLE) / sum(n) ELSE 0 END, 4) AS coverage, CAST(sum(n) AS BIGINT) AS chars_cn FROM ({_TOGETHER}) GROUP BY work")
def work_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("work", "units", "translated", "coverage", "chars_cn")


@query(f"SELECT CAST(count(DISTINCT work) AS BIGINT) AS works, CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (done) AS BIGINT) AS translated, CAST(sum(n) AS BIGINT) AS chars_cn FROM ({_TOGETHER})")
def catalogue_totals(spark, sf_dir):
    return stats.totals(_stats(spark, sf_dir))


@query("SELECT source AS work, min(lpad(CAST(doc_id AS VARCHAR), 4, '0') || 'a01') AS range_first, max(lpad(CAST(doc_id AS VARCHAR), 4, '0') || 'a01') AS range_last FROM documents GROUP BY source")
def marker_range(spark, sf_dir):
    return _stats(spark, sf_dir).select("work", "range_first", "range_last")


@query("SELECT l_orderkey, CAST(v AS DOUBLE) AS median FROM (SELECT l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r = n // 2 + 1")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(stats.upper_median("l_quantity").alias("median"))


@query("SELECT r_name AS work, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'T' THEN 0 ELSE 9 END, r_regionkey) AS BIGINT) AS place FROM region")
def canon_sort_rank(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("work"), F.col("r_name").alias("canon_id"), F.lit(None).cast("int").alias("canon_vol"), F.lit(None).cast("int").alias("canon_no"), F.col("r_regionkey").alias("ord"))
    w = W.orderBy(*stats.canon_key(F.col("canon_id"), F.col("canon_vol"), F.col("canon_no")), "ord")
    return r.select("work", F.row_number().over(w).cast("long").alias("place"))


@query("WITH s AS (SELECT conv_id AS work, turn AS i, min(role) AS t FROM conversations GROUP BY conv_id, turn) SELECT work, i, t, CAST(coalesce(lead(i) OVER (PARTITION BY work ORDER BY i), n) - i AS BIGINT) AS units FROM s JOIN (SELECT conv_id AS work, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) USING (work)")
def section_dedupe_lead(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = c.groupBy(F.col("conv_id").alias("work")).agg((F.max("turn") + 1).alias("n"))
    s = sections.clean(c.select(F.col("conv_id").alias("work"), F.col("turn").alias("i"), F.lit(1).alias("lv"), F.col("role").alias("t")), n)
    return sections.chapter_sizes(s, n).select("work", "i", "t", F.col("units").cast("long").alias("units"))


_PARTS = "SELECT p_brand AS work, p_partkey AS i, p_size AS lv, p_name AS t FROM part"


@query("WITH n AS (SELECT p_brand AS work, count(*) AS n FROM part GROUP BY 1), per AS (SELECT p_brand AS work, p_size % 5 AS lv, count(*) AS k FROM part WHERE p_size <= 6 GROUP BY 1, 2), up AS (SELECT work, lv, sum(k) OVER (PARTITION BY work ORDER BY lv) AS k FROM per) SELECT work, CAST(min(lv) AS INTEGER) AS level FROM up JOIN n USING (work) WHERE n >= 60 AND k BETWEEN 2 AND 40 AND n / k >= 3 GROUP BY work")
def level_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    n = p.groupBy(F.col("p_brand").alias("work")).agg(F.count("*").alias("n"))
    s = p.where("p_size <= 6").select(F.col("p_brand").alias("work"), "i", (F.col("p_size") % 5).alias("lv"), F.col("p_name").alias("t"))
    return sections.chapters(sections.clean(s, n), n).groupBy("work").agg(F.max("lv").cast("int").alias("level"))


def _lines(spark, sf_dir):
    """A document as the work, its lines as units, seven to a page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marker = F.concat(F.lpad(F.floor(F.col("at") / 7 + 100).cast("string"), 4, "0"), F.lit("a"), F.lpad((F.col("at") % 7 + 1).cast("string"), 2, "0"))
    return d.select("work", (F.col("at") + 1).alias("i"), marker.alias("m"), F.length("line").alias("n"), "line")


_LINES = "SELECT doc_id AS work, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_LINE_MARK = "lpad(CAST((i - 1) // 7 + 100 AS VARCHAR), 4, '0') || 'a' || lpad(CAST((i - 1) % 7 + 1 AS VARCHAR), 2, '0')"


@query(
    f"WITH RECURSIVE l AS (SELECT work, i - 1 AS k, (i - 1) // 7 AS page, length(line) AS n FROM ({_LINES})), "
    "f AS (SELECT work, k, page, CAST(n AS BIGINT) AS acc, CAST([] AS INTEGER[]) AS cuts FROM l WHERE k = 0 UNION ALL "
    "SELECT l.work, l.k, l.page, CASE WHEN f.acc >= 2000 AND l.page <> f.page THEN 0 ELSE f.acc END + l.n, CASE WHEN f.acc >= 2000 AND l.page <> f.page THEN list_append(f.cuts, l.k) ELSE f.cuts END FROM f JOIN l ON l.work = f.work AND l.k = f.k + 1), "
    "z AS (SELECT work, max(k) + 1 AS n, arg_max(cuts, k) AS cuts FROM f GROUP BY work) "
    "SELECT work, array_to_string(CASE WHEN len(cuts) > 0 AND n - cuts[-1] < 3 THEN cuts[:-2] ELSE cuts END, ',') AS cuts FROM z"
)
def greedy_chunks(spark, sf_dir):
    return sections.char_cuts(_lines(spark, sf_dir), 2000).select("work", F.array_join("cuts", ",").alias("cuts"))


@query(
    "SELECT doc_id AS work, array_to_string(list_filter(range(21, n, 21), lambda k: k < (n - 1) // 21 * 21 OR n - k >= 10), ',') AS cuts "
    "FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) WHERE n > 7"
)
def page_chunks(spark, sf_dir):
    u = _lines(spark, sf_dir)
    r = u.groupBy("work").agg(F.lit(0).alias("start"), F.count("*").alias("end"))
    return sections.page_cuts(u, r, 20).select("work", F.array_join("cuts", ",").alias("cuts"))


@query(f"WITH l AS (SELECT work, i, (i - 1) // 30 AS part, {_LINE_MARK} AS m FROM ({_LINES})) SELECT work, CAST(part * 30 AS INTEGER) AS start, CASE WHEN count(*) = 1 THEN min(m) ELSE min(m) || '–' || max(m) END AS label FROM l GROUP BY work, part")
def range_labels(spark, sf_dir):
    u = _lines(spark, sf_dir)
    part = F.floor((F.col("i") - 1) / 30).cast("int")
    r = u.groupBy("work", part.alias("k")).agg((F.min("i") - 1).alias("start"), F.max("i").alias("end")).drop("k")
    return sections.range_labels(u, r).select("work", "start", "label")


@query(f"SELECT work, i, {_LINE_MARK} AS m FROM ({_LINES}) WHERE i = 2 AND work = 7")
def lookup_by_marker(spark, sf_dir):
    u = _lines(spark, sf_dir)
    return reader.lookup(u, 7, "0100a02").select("work", "i", "m")


@query(f"SELECT work, i, CASE WHEN i % 2 = 0 THEN NULL ELSE {_LINE_MARK} END IS NULL AND length(line) <= 80 AS title_like, i % 3 = 0 AS untranslated FROM ({_LINES})")
def display_rules(spark, sf_dir):
    u = _lines(spark, sf_dir).select("work", "i", F.when(F.col("i") % 2 == 1, F.col("m")).alias("m"), F.array("line").alias("cn"), F.when(F.col("i") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k"))).alias("ko"))
    return reader.display(u).select("work", "i", "title_like", "untranslated")


@query(
    f"SELECT work, i, regexp_replace(replace(replace(replace(replace('[' || {_LINE_MARK} || ']' || line || '[12]', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '^\\[(\\d{{3,4}}[abc]\\d{{2}})\\](.*)\\[12\\]$', '<span class=\"mk\">[\\1]</span>\\2<span class=\"ap\">[12]</span>', 's') AS html, line AS plain FROM ({_LINES})"
)
def source_markup(spark, sf_dir):
    u = _lines(spark, sf_dir)
    s = F.concat(F.lit("["), "m", F.lit("]"), "line", F.lit("[12]"))
    return u.select("work", "i", T.decorate_source(s).alias("html"), T.strip_leading_marker(F.concat(F.lit("["), "m", F.lit("] "), F.lit("x"), "line")).substr(F.lit(2), F.length("line")).alias("plain"))


_OCC = f"regexp_replace(lower(text), '{_DROP}', '', 'g')"


@query(f"SELECT doc_id, CAST((length({_OCC}) - length(replace({_OCC}, 'tione', ''))) // 5 AS BIGINT) AS n FROM documents WHERE contains({_OCC}, 'tione')")
def occurrences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(T.find_ranges(F.col("text"), F.lit("tione"), "ko")).cast("long").alias("n"))
    return d.where("n > 0")


@query("SELECT page_id, '#/w/' || CAST(page_id AS VARCHAR) || '/u' || CAST(page_id AS VARCHAR) || '?q=' || url_encode(url || ' &?') || '&in=ko&u=' || CAST(page_id AS VARCHAR) AS link FROM pages")
def deep_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.deep_link(F.col("page_id").cast("string"), F.lit(None).cast("string"), F.col("page_id"), F.concat("url", F.lit(" &?")), F.lit("ko")).alias("link"))


@query("SELECT page_id, 'w' AS \"view\", CAST(page_id AS VARCHAR) AS id, 'u' || CAST(page_id AS VARCHAR) AS anchor, url || ' &?' AS q, 'ko' AS side FROM pages")
def routes(spark, sf_dir):
    d = deep_links(spark, sf_dir).select("page_id", T.route(F.col("link")).alias("r"))
    return d.select("page_id", "r.view", "r.id", "r.anchor", F.col("r.params")["q"].alias("q"), F.col("r.params")["in"].alias("side"))


@query("SELECT n_nationkey AS id, coalesce(n_regionkey <> lag(n_regionkey) OVER (ORDER BY n_nationkey), true) AS head, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ',b' END AS tags FROM nation")
def canon_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("canon_id"), F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")).otherwise(F.array("n_name", F.lit("b"), F.lit("c"))).alias("tags"))
    return reader.group_headers(n).select("id", "head", F.array_join("tags2", ",").alias("tags"))


@query("SELECT conv_id AS work, turn AS i, arg_max(role, text) AS t FROM conversations WHERE turn % 3 <> 0 GROUP BY conv_id, turn")
def sections_without_chapters(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("i"), F.lit(1).alias("lv"), F.col("role").alias("t"), F.col("text").alias("ord"))
    return sections.sub_headings(c, c.where("i % 3 = 0"))


@query(
    "WITH c AS (SELECT p_brand AS work, p_partkey AS i, p_name AS t FROM part WHERE p_size = 7), s AS (SELECT p_brand AS work, max(p_partkey) + 1 AS n FROM part GROUP BY 1) "
    "SELECT work, i, coalesce(lead(i) OVER w, n) - i AS units, lag(t) OVER w AS prev, lead(t) OVER w AS next FROM c JOIN s USING (work) WINDOW w AS (PARTITION BY work ORDER BY i)"
)
def chapter_neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("work"), F.col("p_partkey").alias("i"), F.col("p_name").alias("t"), "p_size")
    sizes = p.groupBy("work").agg((F.max("i") + 1).alias("n"))
    return sections.chapter_sizes(p.where("p_size = 7"), sizes).select("work", "i", "units", "prev", "next")


@query(f"SELECT work, i, line, CASE WHEN i = 15 THEN 'here' END AS heading FROM ({_LINES}) CROSS JOIN (SELECT least(1, (len(string_split(text, chr(10))) - 1) // 10) * 10 AS start FROM documents WHERE doc_id = 7) WHERE work = 7 AND i > start AND i <= start + 10")
def chapter_scan(spark, sf_dir):
    u = _lines(spark, sf_dir)
    c = u.where("(i - 1) % 10 = 0").select("work", (F.col("i") - 1).alias("i"))
    sub = u.where("i = 15").select("work", (F.col("i") - 1).alias("i"), F.lit("here").alias("t"))
    return reader.chapter(u, c, sub, 7, 1).select("work", "i", "line", "heading")


@query("SELECT conv_id AS work, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS i FROM conversations")
def concatenated_parts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), "role", F.col("role").alias("src"), "turn", F.col("turn").alias("i"))
    return source_text.concat_parts(c).select("work", "role", "turn", F.col("i").cast("long").alias("i"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS title_ko, '미상' AS author_ko, '서지 미기재' AS canon, '미분류' AS collection, 'Z' AS canon_id, 999 AS canon_no, true AS verify FROM documents WHERE n_chars % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def discover_defaults(spark, sf_dir):
    name = F.when(F.col("n_chars") % 2 == 0, "원문.txt").otherwise("원문2.txt")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(name).alias("names"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return source_text.discover(d, known).select("id", "title_ko", "author_ko", "canon", "collection", "canon_id", "canon_no", "verify")


@query(f"SELECT work, CAST(count(*) AS BIGINT) AS units, min({_LINE_MARK}) FILTER (i % 5 <> 0) AS ingest_first, max({_LINE_MARK}) FILTER (i % 5 <> 0) AS ingest_last, min({_LINE_MARK}) AS rebuilt_first, max({_LINE_MARK}) AS rebuilt_last FROM ({_LINES}) GROUP BY work")
def rebuilt_ranges(spark, sf_dir):
    u = _lines(spark, sf_dir).select("work", "i", "m", F.array("line").alias("cn"), F.array().cast("array<string>").alias("ko"), F.when(F.col("i") % 5 == 0, 1).alias("x"))
    a, b = stats.work_stats(u, F.length), stats.work_stats(u, F.length, ingest=False)
    a = a.select("work", "units", F.col("range_first").alias("ingest_first"), F.col("range_last").alias("ingest_last"))
    return a.join(b.select("work", F.col("range_first").alias("rebuilt_first"), F.col("range_last").alias("rebuilt_last")), "work")


@query(f"SELECT work, i, CAST((i - 1) // 7 + 100 AS INTEGER) AS page, 'a' AS col, CAST((i - 1) % 7 + 1 AS INTEGER) AS line FROM ({_LINES})")
def marker_coordinates(spark, sf_dir):
    return _lines(spark, sf_dir).select("work", "i", T.marker_parts(F.col("m")).alias("p")).select("work", "i", "p.page", F.col("p.column").alias("col"), "p.line")


@query(
    f"WITH s AS (SELECT conv_id, turn, text, role, substr({_FOLDED}, 1, 14) AS key FROM conversations), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS r FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS r FROM s WHERE role = 'user'), "
    "p AS (SELECT a.conv_id, a.turn, b.turn AS place FROM a LEFT JOIN b USING (conv_id, key, r)) "
    "SELECT CAST(conv_id AS VARCHAR) AS work, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS i, CAST(count(place) OVER (PARTITION BY conv_id, turn) AS INTEGER) AS n_ko, CAST(NULL AS INTEGER) AS x, coalesce(CAST(place AS VARCHAR), '') AS places FROM p"
)
def align_greedy(spark, sf_dir):
    """A conversation as the work: its turns are the source, what users say the translated units; a text that comes
    again goes to the next turn that has it."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("work"), F.col("turn").cast("int").alias("i"), F.lit(None).cast("string").alias("m"), F.col("text").alias("cn"), "role")
    none = F.array().cast("array<string>")
    tr = c.where("role = 'user'").select("work", F.col("i").alias("u"), "m", F.array("cn").alias("cn"), F.array("role").alias("ko"), none.alias("nt"), F.lit(None).cast("string").alias("h"))
    return align.align_works(c.drop("role"), tr).select("work", "i", F.size("ko").alias("n_ko"), "x", F.array_join("places", ",").alias("places"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("SELECT doc_id, '#/w/' || source || '/u' || CAST(doc_id AS VARCHAR) AS url, CAST(floor(n_chars / 1000.0 * 100 + 0.5) AS BIGINT) AS pct FROM documents")
def anchors_and_percent(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.anchor_url(F.col("source"), F.lit(None).cast("string"), F.col("doc_id")).alias("url"), T.percent(F.col("n_chars") / 1000.0).alias("pct"))


@query("SELECT source AS work, doc_id AS i, text AS t FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("i"), F.lit(None).cast("string").alias("m"), F.col("text").alias("t"))
    work = d.where("i = 17").select("work").first()[0]
    return reader.lookup(d, work, "u17").select("work", "i", "t")
