"""Corpus operators: registered queries against SQL, and synthetic cases for what the driver's tables lack."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import build
from lectern.functions import text as T
from lectern.operators import align, assemble, reader, search, sections, stats
from lectern.plans import corpus, script  # noqa: F401
from lectern.sources import docx, text as source_text, works


@pytest.mark.parametrize("name", sorted(corpus.QUERIES))
def test_query(spark, sf, name):
    df = corpus.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in corpus.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(corpus.ORACLE_SQL[name])
    order = sorted(c[0] for c in cur.description)
    assert order == sorted(df.columns)
    at = [[c[0] for c in cur.description].index(c) for c in order]
    show = lambda v: str(round(v, 9) if isinstance(v, float) else v)
    assert sorted(tuple(show(r[c]) for c in order) for r in rows) == sorted(tuple(show(r[i]) for i in at) for r in cur.fetchall())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("v")).first().v


def test_normalise(spark):
    assert one(spark, "衆，生？！：；．…a。、「」（）　 [0123a04]b[12]", T.norm_cn) == "眾,生?!:;....ab"
    assert one(spark, "观", T.norm_cn) == "觀" and one(spark, "观", lambda c: T.norm_cn(c, search=False)) == "观"
    assert one(spark, "가 나。　B", T.norm_ko) == "가나。b"
    assert one(spark, "한漢漢漢", T.hangul_ratio) == 0.25 and one(spark, "12", T.hangul_ratio) == 0.0
    assert [one(spark, s, T.is_source_line) for s in ("大乘起信", "大", "【大乘】", "번역 大", "abc")] == [True, False, True, False, False]
    assert one(spark, "원문  大乘", lambda c: T.strip_side(c)["side"]) == "cn"
    assert one(spark, "[1206c22]  문단 001 · 원문", T.is_unit_label) is True
    assert one(spark, "a<b&\"c\">", T.escape_html) == "a&lt;b&amp;&quot;c&quot;&gt;"


def test_ranges_and_kwic(spark):
    raw = "一二[0001a01]三衆生衆" + "后" * 40
    assert T.ranges_of(raw, "三眾", "cn") == [(11, 13)] and T.ranges_of("", "x", "cn") == []
    s = spark.createDataFrame([(raw,)], "s string").select(T.kwic(F.col("s"), F.lit("眾生"), "cn").alias("k"), T.kwic(F.col("s"), F.lit("無"), "cn").alias("n")).first()
    assert s.k.hit == "衆生" and s.k.post.endswith("…") and len(s.k.post) == 23 and s.n is None
    marked = spark.createDataFrame([("a<b>a",)], "s string").select(T.mark_ranges(F.col("s"), T.find_ranges(F.col("s"), F.lit("a"), "ko")).alias("m")).first().m
    m = '<mark class="hit-mark">a</mark>'
    assert marked == f"{m}&lt;b&gt;{m}"
    # marks: search keeps those of the translation, highlighting drops them on both sides
    assert T.snippet_of("가·나 다.", "가·나", "ko")[1] == "가·나" and T.snippet_of("가·나 다.", "가나", "ko") is None
    assert T.ranges_of("가·나 다.", "나다", "ko") == [(2, 5)] and T.ranges_of("가·나 다.", "가·나", "ko") == []
    # a character whose composed form holds a mark goes whole, where marks go
    assert T.mapped("a㈜b", "cn", True)[0] == "ab" == T.mapped("a㈜b", "ko", True)[0] and T.mapped("a㈜b", "ko", False)[0] == "a(주)b"
    assert T.snippet_of("x" * 40 + "ﬁn" + "y" * 40, "fin", "ko") == ("…" + "x" * 34, "ﬁn", "y" * 34 + "…")


def test_segment(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿머리 [0001a01]一  二\r\n\r\n[0001a02]三[12b03]四[0002b03]五".encode())
    (tmp_path / "b.txt").write_bytes("가나".encode("cp949"))
    got = source_text.segment(source_text.read_text(spark, str(tmp_path / "*.txt"))).orderBy("path", "i").collect()
    assert [(r.i, r.m, r.cn) for r in got] == [(1, None, "머리"), (2, "0001a01", "[0001a01]一 二"), (3, "0001a02", "[0001a02]三[12b03]四"), (4, "0002b03", "[0002b03]五"), (1, None, "가나")]


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def word_file(paragraphs, tables=()):
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = "".join(p(*x) for x in paragraphs) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{''.join(p(l) for l in c.split(chr(10)))}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_general_document(spark, tmp_path):
    (tmp_path / "g.docx").write_bytes(word_file([("해제입니다",), ("제1장", "H1"), ("[0001a01]大乘起信論",), ("번역 하나",), ("[0001a02]",), ("如是我聞一時[0001a03]佛在",), ("번역 둘",), ("주",), ("각주 줄",), ("끝 장", "H1")]))
    b = docx.blocks(docx.read_paragraphs(spark, str(tmp_path / "g.docx")))
    u = assemble.units(b).orderBy("u").collect()
    assert [(r.m, r.cn, r.ko, r.nt) for r in u] == [("0001a01", ["[0001a01]大乘起信論"], ["하나"], []), ("0001a02", ["如是我聞一時", "[0001a03]佛在"], ["둘"], ["각주 줄"])]
    assert [(r.i, r.t) for r in assemble.sections(b).collect()] == [(0, "제1장")]
    assert assemble.matter(b).first().front == ["해제입니다"]


def test_table_and_translation_documents(spark, tmp_path):
    (tmp_path / "t.docx").write_bytes(word_file([("앞",)], [[["위치표지", "원문", "번역"], ["[0001a01]", "大乘\n起信", "번역\n주\n각주 줄"], ["", "", ""], ["[0001a02]", "佛", ""]], [["원어", "번역어", "비고"], ["佛", "부처", "n"]], [["항목", "내용"], ["문헌명", "가"], ["문헌명", "나"]]]))
    (tmp_path / "o.docx").write_bytes(word_file([("서문",)] + [x for k in range(20) for x in ((f"[{1000 + k}a01]",), (f"번역 {k}",))] + [("부록", "H1"), ("뒤",)]))
    t = docx.read_tables(spark, str(tmp_path / "*.docx"))
    p = docx.read_paragraphs(spark, str(tmp_path / "*.docx"))
    assert {r.path[-6:]: r.layout for r in docx.layout(p, t).collect()} == {"t.docx": "table", "o.docx": "translation"}
    assert [(r.m, r.cn, r.ko, r.nt) for r in docx.table_units(t).orderBy("i").collect()] == [("0001a01", ["大乘", "起信"], ["번역"], ["각주 줄"]), ("0001a02", ["佛"], [], [])]
    assert docx.glossary(docx.side_tables(t)).first().entries[0].asDict() == {"cn": "佛", "ko": "부처", "note": "n"}
    assert [(r.name, r.value) for r in docx.bibliography(docx.side_tables(t)).collect()] == [("문헌명", "가")]
    o = docx.translation_units(p.where(F.col("path").endswith("o.docx"))).collect()
    assert sum(r.place == "body" for r in o) == 20 and {r.place: r.texts for r in o if r.place != "body"} == {"front": ["서문"], "back": ["부록", "뒤"]}


def test_split_by_translation(spark):
    rows = [("w", 0, "0001a01", ["x", "[0001a01]a", "b", "[0001a02]c"], ["[0001a01]k", "[0001a02]l", "[0009a09]m"], ["n"], "h"), ("w", 1, None, ["d"], ["[0001a03]k", "l", "m"], [], None)]
    df = spark.createDataFrame(rows, "path string, u int, m string, cn array<string>, ko array<string>, nt array<string>, h string")
    s = assemble.split_by_translation(df)
    got = [(r.u, r.m, r.cn, r.nt, r.h) for r in s.orderBy("u", "piece").collect()]
    assert got == [(0, "0001a01", ["x", "[0001a01]a", "b"], [], "h"), (0, "0001a02", [], [], None), (0, "0009a09", ["[0001a02]c"], ["n"], None), (1, None, ["d"], [], None)]
    assert sorted((r.old, r.new) for r in assemble.remap(s).collect()) == [(0, 0), (1, 3), (2, 4)]


UNITS = "work string, i int, m string, cn string"
TRANSLATED = "work string, u int, m string, cn array<string>, ko array<string>, nt array<string>, h string"


def aligned(spark, source, translated):
    """Rows (i, source texts, translation, x, places) of one work; translated: (marker, pieces, translation, heading)."""
    s = spark.createDataFrame([("w", k + 1, m, t) for k, (m, t) in enumerate(source)], UNITS)
    t = spark.createDataFrame([("w", k, m, cn, ko, [f"n{k}"], h) for k, (m, cn, ko, h) in enumerate(translated)], TRANSLATED)
    return [(r.i, r.cn, r.ko, r.h, r.x, r.places) for r in align.align_works(s, t).orderBy("i").collect()]


def test_align(spark):
    src = [("0001a01", "如是我聞一時佛在舍衛國"), ("0001a01", "與大比丘眾千二百五十人俱"), (None, "爾時世尊食時著衣持鉢"), ("0001a03", "入城乞食")]
    got = aligned(spark, src, [("0001a01", [src[0][1], src[2][1]], ["가"], ""), ("0001a03", [], ["나"], "ㄴ"), ("0001a03", [], ["다"], "ㄷ"), (None, ["全然不同之文字"], ["라"], "ㄹ")])
    assert got == [(1, [t for _, t in src[:3]], ["가"], None, None, [0]), (2, [src[3][1]], ["나", "다"], "ㄴ", None, [1, 2]), (3, ["全然不同之文字"], ["라"], None, 1, [3])]
    assert aligned(spark, [], [("m", ["a"], ["k"], "h")]) == [(1, ["a"], ["k"], "h", None, [0])]
    assert aligned(spark, [("m", "甲乙丙")], []) == [(1, ["甲乙丙"], [], None, None, [])]


def test_align_ways(spark):
    text = [chr(0x4E00 + 37 * k) + chr(0x4E05 + 37 * k) + chr(0x4E09 + 37 * k) * 6 for k in range(30)]
    src = [(f"{k:04d}a01", t) for k, t in enumerate(text)]
    # a repeated fingerprint goes to the next free unit; then by marker; then where the text stands, taken or not
    got = aligned(spark, [(None, text[0]), (None, text[0]), ("0009a01", text[1]), *src[2:6]], [(None, [text[0]], ["a"], None), (None, [text[0]], ["b"], None), (None, ["[0009a01]" + text[0]], ["c"], None), (None, [text[0]], ["d"], None)])
    assert [(r[1], r[2]) for r in got][:3] == [([text[0]], ["a", "d"]), ([text[0]], ["b"]), ([text[1]], ["c"])]
    # six characters that straddle two units belong to the first; five are too few
    got = aligned(spark, src[:3], [(None, [text[0][-3:] + text[1][:3]], ["a"], None), (None, [text[1][-2:] + text[2][:3]], ["b"], None)])
    assert [(r[2], r[4]) for r in got] == [(["a"], None), ([], None), ([], None), (["b"], 1)]
    # two pieces of one unit can have one place; a place 14 beyond the first is near enough for a unit of two pieces, 15 is not
    got = aligned(spark, src, [(None, [text[2], text[2]], ["a"], None), (None, [text[4], text[18]], ["b"], None), (None, [text[5], text[20]], ["c"], None)])
    assert {r[5][0]: len(r[1]) for r in got if r[5]} == {0: 1, 1: 14, 2: 1} and len(got) == 30 - 13
    # bundles of five pieces: what is left between two owners goes to the first
    got = aligned(spark, src[:14], [(None, text[1:6], ["a"], None), (None, text[8:13], ["b"], None)])
    assert [r[1] for r in got] == [[text[0]], text[1:8], text[8:14]]
    # bundles of four: it stays
    got = aligned(spark, src[:14], [(None, text[1:5], ["a"], None), (None, text[8:12], ["b"], None)])
    assert [len(r[1]) for r in got] == [1, 4, 1, 1, 1, 4, 1, 1]
    # a translation with more units that hold at least 93 % of the source stands for it
    got = aligned(spark, [(None, text[0] + text[1] + text[2])], [(None, [text[k]], [str(k)], None) for k in range(3)])
    assert [r[1] for r in got] == [[text[k]] for k in range(3)]
    m = align.moved(align.align_works(spark.createDataFrame([("w", 1, None, "甲乙丙丁戊己庚")], UNITS), spark.createDataFrame([("w", 0, None, ["甲乙丙丁戊己庚"], ["k"], [], None)], TRANSLATED)))
    assert [tuple(r) for r in m.collect()] == [("w", 0, 0)]


def test_sections_and_chapters(spark):
    n = spark.createDataFrame([("w", 60), ("v", 59)], "work string, n int")
    s = spark.createDataFrame([("w", 5, 2, "b"), ("w", 5, 1, "a"), ("w", 20, 1, "c"), ("w", 70, 1, "out"), ("v", 5, 1, "a"), ("v", 9, 1, "b")], "work string, i int, lv int, t string")
    c = sections.chapters(sections.clean(s, n), n).orderBy("i").collect()
    assert [(r.work, r.i, r.t) for r in c] == [("w", 0, "권두"), ("w", 5, "a"), ("w", 20, "c")]
    u = spark.createDataFrame([("w", k + 1, f"{100 + k // 40:04d}a01") for k in range(300)], "work string, i int, m string")
    cut = sections.page_cuts(u, spark.createDataFrame([("w", 0, 300)], "work string, start int, end int")).first().cuts
    assert cut == [120, 240]
    v = spark.createDataFrame([("w", 1, ["某經卷第一"]), ("w", 2, ["某經卷第一", "某經卷下"])], "work string, i int, cn array<string>")
    assert [(r.i, r.t) for r in sections.volume_lines(v).orderBy("i").collect()] == [(0, "某經卷第一"), (1, "某經卷下")]


def test_search_and_reader(spark):
    rows = [("w", 1, "0001a01", ["衆生無邊"], ["중생은 끝이 없다"]), ("w", 2, None, ["煩惱"], []), ("v", 1, None, ["佛"], ["衆生"])]
    u = spark.createDataFrame(rows, "work string, i int, m string, cn array<string>, ko array<string>")
    ix = search.index(u)
    works_ = spark.createDataFrame([("w", "W", "더블유", 0), ("v", "V", None, 1), ("z", "Z", None, 2)], "work string, title string, title_ko string, ord int")
    h = search.hits(ix, works_, "众生").collect()
    assert [(r.work, r["where"]) for r in h] == [("w", "cn")] and h[0].snip.hit == "衆生"
    assert {r.work: r.n for r in search.counts(ix, works_, "佛").collect()} == {"w": 0, "v": 1, "z": 0}
    assert search.counts(ix, works_, "。").count() == 3 and search.counts(ix, works_, " ").count() == 0
    assert search.page_numbers(95, 12, 10) == {"pages": 10, "page": 10, "block": list(range(1, 11)), "prev": None, "next": None, "from": 91, "to": 95}
    assert reader.lookup(u, "w", "0001a01").first().i == 1 and reader.lookup(u, "w", "u2").first().i == 2
    assert [r.title_like for r in reader.display(u).orderBy("work", "i").collect()] == [True, False, True]


@pytest.mark.parametrize("few", [200, 0])
def test_locate_both_ways(spark, few):
    t = spark.createDataFrame([(1, "xabcabc"), (2, "abd"), (3, None), (4, "a"), (1, "zzabc")], "key int, text string")
    n = spark.createDataFrame([(7, "abc"), (8, "abd"), (9, "xyz")], "id int, needle string")
    got = search.locate(t.where("text is null or text != 'zzabc'"), n, 3, few=few).collect()
    assert sorted((r.key, r.id, r["at"]) for r in got) == [(1, 7, 2), (2, 8, 1)]


def test_as_of_both_ways(spark):
    s = spark.createDataFrame([("w", 3, 1, "a"), ("w", 5, 1, "b"), ("w", 9, 1, "c"), ("v", 1, 1, "d")], "work string, i int, lv int, t string")
    p = spark.createDataFrame([("w", 3, 30), ("w", 6, 61), ("w", 6, 60)], "work string, old int, new int")
    assert sorted((r.t, r.i) for r in align.section_places(s, p).collect()) == [("a", 30), ("b", 60)]
    u = spark.createDataFrame([("w", 1, 9), ("w", 4, 9), ("w", 6, 9), ("v", 1, 9)], "work string, i int, c int")
    c = spark.createDataFrame([("w", 3), ("w", 5)], "work string, i int")
    assert sorted((r.work, r.i, r.c) for r in sections.assign(u, c).fillna(-1).collect()) == [("v", 1, -1), ("w", 1, -1), ("w", 4, 0), ("w", 6, 1)]


def test_stats_rights_and_scan(spark, tmp_path):
    rows = [("w", 1, "0002a01", ["一二。"], ["가 나"], None), ("w", 2, "0001a01", ["三"], [], 1)]
    u = spark.createDataFrame(rows, "work string, i int, m string, cn array<string>, ko array<string>, x int")
    a, b = stats.work_stats(u).first(), stats.work_stats(u, ingest=False).first()
    assert (a.units, a.translated, a.chars_cn, a.chars_ko, a.coverage, a.range_first) == (2, 1, 3, 3, 0.6667, "0002a01") and b.range_first == "0001a01"
    w = spark.createDataFrame([("a", None), ("b", "X"), ("c", "Y"), ("d", "Z")], "id string, source string")
    r = spark.createDataFrame([("CBETA", True), ("X", False), ("Y", None)], "source string, ok boolean")
    assert {x.source: x.ids for x in stats.rights_flags(w, r).collect()} == {"X": ["b"], "Y": ["c"], "Z": ["d"]}
    (tmp_path / "good.json").write_text('{"meta":{"id":"g"},"glossary":[],"chapters":[],"units":[{"i":1,"m":null,"cn":["一"],"ko":[],"nt":[]}]}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text('{"meta":{"id":"n"}}')
    good, skipped = works.scan(spark, str(tmp_path / "*.json"))
    assert [x.work for x in works.units_of(good).collect()] == ["g"] and sorted(x.reason for x in skipped.collect()) == ["malformed", "no units"]


def test_build_and_rebuild(spark, tmp_path):
    """Works of each layout, end to end; then the catalogue from the written documents alone."""
    import json

    src = tmp_path / "sources"
    for w in ("general", "table", "alone", "bare"):
        (src / w).mkdir(parents=True)
    (src / "general" / "원문-1.txt").write_text("[0001a01]大乘起信論\n\n[0001a02]如是我聞一時[0001a03]佛在", encoding="utf-8")
    (src / "general" / "원문-2.docx").write_bytes(word_file([("[0009a01]舍衛國祇樹",)]))
    (src / "general" / "번역.docx").write_bytes(word_file([("해제입니다",), ("제1장", "H1"), ("[0001a01]大乘起信論",), ("번역 하나",), ("[0001a02]如是我聞一時",), ("번역 둘",)], [[["원어", "번역어", "비고"], ["佛", "부처", "n"]]]))
    (src / "table" / "번역.docx").write_bytes(word_file([("앞",)], [[["위치표지", "원문", "번역"], ["[0001a01]", "某經卷第一", "번역"], ["[0001a02]", "佛", ""]]]))
    (src / "alone" / "원문.txt").write_text("\n\n".join(f"[{1000 + k}a01]大乘{chr(0x4E00 + 9 * k)}" for k in range(20)), encoding="utf-16")
    (src / "alone" / "번역.docx").write_bytes(word_file([("서문",)] + [x for k in range(20) for x in ((f"[{1000 + k}a01]",), (f"번역 {k}",))] + [("부록", "H1")]))
    (src / "bare" / "other.txt").write_text("x", encoding="utf-8")
    reg = spark.createDataFrame([("general", "G", "가", "T", 3, 5, ["t"], False, "CBETA"), ("alone", "A", None, "X", 1, 1, None, None, "Y"), ("nothing", "N", None, "T", 1, 1, None, True, None)], "id string, title_cn string, title_ko string, canon_id string, canon_vol int, canon_no int, tags array<string>, verify boolean, source string")
    rights = spark.createDataFrame([("CBETA", True), ("Y", None)], "source string, ok boolean")
    out = str(tmp_path / "out")
    b = build.build(spark, str(src), reg, rights, out)
    u = {(r.work, r.i): r for r in b["units"].collect()}
    assert [(u["general", k].m, u["general", k].cn, u["general", k].ko) for k in range(1, 5)] == [("0001a01", ["[0001a01]大乘起信論"], ["하나"]), ("0001a02", ["[0001a02]如是我聞一時"], ["둘"]), ("0001a03", ["[0001a03]佛在"], []), ("0009a01", ["[0009a01]舍衛國祇樹"], [])]
    assert [u["alone", k].ko for k in (1, 20)] == [["번역 0"], ["번역 19"]] and len(u) == 4 + 2 + 20
    assert {(r.work, r.i, r.t) for r in b["sections"].collect()} == {("general", 0, "제1장"), ("table", 0, "某經卷第一")}
    w = {r.id: r for r in b["works"].collect()}
    assert set(w) == {"general", "table", "alone", "nothing"}
    g = w["general"]
    assert (g.units, g.translated, g.chars_cn, g.chars_ko, g.coverage, g.range, g.has_source, g.has_translation, g.chapters) == (4, 2, 18, 3, 0.6111, ["0001a01", "0009a01"], True, True, 0)
    assert (w["table"].has_source, w["table"].canon_id, w["table"].verify, w["nothing"].units, w["nothing"].range) == (False, "Z", True, 0, None)
    assert {r.source: r.ids for r in b["flagged"].collect()} == {"Y": ["alone"]}
    assert b["totals"].first().asDict() == {"works": 4, "units": 26, "translated": 23, "chars_cn": 18 + 6 + 60}
    assert build.summary(b["totals"]).first().line == "4종 · 26단위 · 원문 84자" and "61.1%" in {r.id: r.line for r in b["report"].collect()}["general"]
    (m,) = spark.read.text(f"{out}/manifest").collect()
    m = json.loads(m.value)
    assert [x["id"] for x in m["works"]] == ["nothing", "general", "alone", "table"] and m["totals"]["units"] == 26 and "biblio_extracted" not in m["works"][0]

    docs = tmp_path / "docs"
    docs.mkdir()
    for r in spark.read.text(f"{out}/works").collect():
        (docs / f"{r.work}.json").write_text(r.value, encoding="utf-8")
    d = json.loads((docs / "general.json").read_text(encoding="utf-8"))
    assert d["glossary"] == [{"cn": "佛", "ko": "부처", "note": "n"}] and d["front"] == ["해제입니다"] and d["sections"] == [{"lv": 1, "t": "제1장", "i": 0}] and d["units"][2]["m"] == "0001a03"
    (docs / "bad.json").write_text("{")
    r = build.rebuild(spark, str(docs), reg)
    got = {x.id: x for x in r["works"].collect()}
    assert [x.reason for x in r["skipped"].collect()] == ["malformed"]
    assert {k: (v.units, v.chars_cn, v.coverage, v.range) for k, v in got.items()} == {k: (v.units, v.chars_cn, v.coverage, v.range) for k, v in w.items()}
    assert [x.id for x in sorted(got.values(), key=lambda x: x.ord)] == ["nothing", "general", "alone", "table"] and "canon_full" not in r["works"].columns
