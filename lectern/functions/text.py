"""Column functions on text: normalisation, predicates and small formats of parallel-text corpora."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# ---- Fixed values: patterns, word lists and tables that results depend on ----
MARKER = r"\[(\d{3,4}[abc]\d{2})\]"
APPARATUS = r"\[(?:\d{1,3}|＊|\*)\]"
BEFORE_MARKER = r"(?=\[\d{3,4}[abc]\d{2}\])"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
HANGUL = r"[\x{ac00}-\x{d7a3}]"
#: Dropped from search text after NFKC; its ASCII forms of full-width marks aren't among them.
DROPPED = r"(?U)[\s。，、．・？！：；「」『』（）()〔〕【】\[\]“”‘’·…—　]"
#: Variant characters and what they fold to, for search; alignment and statistics leave the pair of 观 out.
FOLD_FROM = "眞衆众觉说为无与体万来实义经论号当从学断边转显现应处随点师净凈烦恼萨刹弥广严华会个于后裏么并余观"
FOLD_TO = "真眾眾覺說為無與體萬來實義經論號當從學斷邊轉顯現應處隨點師淨淨煩惱薩剎彌廣嚴華會個於後裡麼並餘觀"
LABELS = ("원문", "한문 원문", "한국어 번역", "한국어 직역", "번역", "직역", "【註】", "【本文】", "【科文】", "【科層】", "【논서 번역】", "【주석서 번역】", "【번역 각주】", "번역 각주")
LABEL_WORDS = ("원문", "번역", "직역", "본문", "대조", "문단", "단락", "단위")
LABEL_HEADS = ("원문", "원문 목차", "한국어 목차", "한국어 직역", "한국어 번역", "번역", "직역")
HEAD_STYLES = ("Unit Heading", "Unit Label", "Title", "Subtitle", "Small Meta")
UNIT_LABEL = r"^\s*(?:\[\d{3,4}[abc]\d{2}\])?\s*(?:(?:문단|단락|단위|제)\s*\d+\s*(?:항|번|단)?)?\s*(?:\d{1,4}\s*[.)]?)?\s*(?:[·・|/:：\-—~]\s*)?(?:한문\s*)?(?:한국어\s*)?(?:원문|본문|번역|직역|대조|원문·번역)?\s*$"
SIDE_PREFIX = r"^(원문|한문\s*원문|본문|번역|직역|한국어\s*직역|한국어\s*번역)\s*[:：·|]?\s+"
APPARATUS_HEAD = (
    r"^[A-Z]\.\s|문헌\s*정보|편집|안내|범례|용어\s*(?:표|대응)|검증|검수|선독|판본\s*정보|교정\s*(?:기록|보고|사항)|정리\s*(?:기록|보고|사항)|작업\s*(?:기록|보고)|"
    r"(?:편집|번역|대조|원문)\s*(?:검증|검수|확인)\s*(?:요약|결과|보고)?|검증\s*요약|검수\s*요약|번역상|쟁점|한계|읽는\s*법|과단\s*계층|부록|참고\s*문헌|대역\s*목차"
)
UNIT_HEAD = r"^(?:문단\s*\d+|\d{2,4}\.\s|권두\s*표제|\[\d{3,4}[abc]\d{2}\])"
NOTE_HEAD = r"(?:^|\s)(?:주|주석|각주|교감)$"
NOTE_PREFIX = r"^\s*(?:주석\s*\d*|각주\s*\d*|교감[·\s]|번역 각주|【번역 각주】|\[구두 불확실\]|\[판독 불확실\]|\[구문 불확실\])"
HEAD_PREFIX = r"^(문단\s*\d+|제\s*\d+\s*항|권\s*제?\d+)"
EDITORIAL = r"^【(?:科層|科文|本文|註|論|疏)】"
VOLUME_LINE = r"^.{0,24}?卷(?:第[一二三四五六七八九十]+|[上中下])(?:[(（].{0,12}?[)）])?\s*$"
CANONS = ("T", "X", "L", "K", "B", "ZW")
SOURCE_MOST_HANGUL, HEAD_KEY, NEEDLE, LEAST_NEEDLE = 0.12, 14, 24, 6
PAD = {"cn": 22, "ko": 34}
PREVIEW = {"ko": 90, "cn": 60}
# ---- end of fixed values ----


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no function for it. Null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(s: Column, search: bool = True) -> Column:
    n = len(FOLD_FROM) if search else len(FOLD_FROM) - 1
    return F.translate(s, FOLD_FROM[:n], FOLD_TO[:n])


def bare(s: Column) -> Column:
    """Without markers, apparatus tags, white space and the dropped punctuation."""
    s = F.regexp_replace(F.regexp_replace(s, MARKER, ""), APPARATUS, "")
    return F.regexp_replace(s, DROPPED, "")


def norm_cn(s: Column, search: bool = True, compose: bool = True) -> Column:
    """Search text of the source side; search=False: as alignment has it. compose=False leaves NFKC out (text known
    to be composed), which keeps the plan free of Python."""
    return fold(bare(nfkc(s) if compose else s), search)


def norm_ko(s: Column, compose: bool = True) -> Column:
    """Search text of the translation: lower case, without white space; punctuation stays."""
    return F.regexp_replace(F.lower(nfkc(s) if compose else s), r"(?U)\s|　", "")


def norm_highlight(s: Column, kind: str, compose: bool = True) -> Column:
    """What highlighting compares: punctuation dropped on both sides, folded or lower-cased."""
    s = F.regexp_replace(nfkc(s) if compose else s, DROPPED, "")
    return fold(s) if kind == "cn" else F.lower(s)


def head_key(s: Column, n: int = HEAD_KEY, compose: bool = True) -> Column:
    return F.substring(norm_cn(s, search=False, compose=compose), 1, n)


def collapse(s: Column) -> Column:
    """Runs of spaces and tabs to one space; trimmed of all white space."""
    return F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def hangul_ratio(s: Column) -> Column:
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(s, F.lit(HANGUL)) / letters)


def is_source_line(s: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(s, MARKER, ""), r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"^[【〔\[(（]+|[】〕\])）]+$", ""), r"(?U)^\s+|\s+$", "")
    return (F.length(body) >= 2) & F.regexp_like(body, F.lit(HAN)) & (hangul_ratio(body) < SOURCE_MOST_HANGUL)


def is_unit_label(s: Column) -> Column:
    t = F.trim(s)
    word = F.regexp_like(t, F.lit("|".join(LABEL_WORDS)))
    return (t != "") & (F.length(t) <= 40) & word & F.regexp_like(t, F.lit(UNIT_LABEL))


def is_label(s: Column) -> Column:
    return s.isin(*LABELS) | F.regexp_replace(s, "[：: ]+$", "").isin(*LABELS)


def strip_side(s: Column) -> Column:
    """struct(text, side): a leading side label is taken off; side is cn, ko or null."""
    head = F.regexp_replace(F.regexp_extract(s, SIDE_PREFIX, 1), r"\s", "")
    side = F.when(head == "", None).when(head.isin("원문", "한문원문", "본문"), "cn").otherwise("ko")
    return F.struct(F.when(head == "", s).otherwise(F.trim(F.regexp_replace(s, SIDE_PREFIX, ""))).alias("text"), side.alias("side"))


def pure_marker(s: Column) -> Column:
    """The marker that is all of s, else null."""
    m = F.regexp_extract(s, "^" + MARKER + "$", 1)
    return F.when(m != "", m)


def first_marker(s: Column, leading: bool = False) -> Column:
    m = F.regexp_extract(s, ("^" if leading else "") + MARKER, 1)
    return F.when(m != "", m)


def is_note_head(s: Column) -> Column:
    return (F.length(s) <= 8) & F.regexp_like(s, F.lit(NOTE_HEAD))


def is_heading(s: Column, style: Column) -> Column:
    return F.lower(style).contains("heading") | style.isin(*HEAD_STYLES) | F.regexp_like(s, F.lit(HEAD_PREFIX))


def classify_head(s: Column) -> Column:
    """note, label, unit, apparatus or structure; the first that holds."""
    t = F.trim(s)
    return (
        F.when(F.regexp_like(t, F.lit(NOTE_HEAD)), "note")
        .when(t.isin(*LABEL_HEADS) | F.regexp_replace(t, "[：: ]+$", "").isin(*LABEL_HEADS), "label")
        .when(F.regexp_like(t, F.lit(UNIT_HEAD)), "unit")
        .when(F.regexp_like(t, F.lit(APPARATUS_HEAD)), "apparatus")
        .otherwise("structure")
    )


def head_level(style: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(style, F.lit("")), r"(\d+)", 1).try_cast("int"), F.lit(2))


def block_kind(s: Column, side: Column, style: Column) -> Column:
    """cn, note or ko of a paragraph that is no heading."""
    noted = F.lower(style).contains("note") | style.contains("각주") | style.contains("Editorial") | F.regexp_like(s, F.lit(NOTE_PREFIX))
    return F.when((side == "cn") | (side.isNull() & is_source_line(s)), "cn").when((side.isNull() | (side != "ko")) & noted, "note").otherwise("ko")


def page_of(marker: Column) -> Column:
    """The page of a marker: all but its last three characters."""
    return F.substring(marker, F.lit(1), F.length(marker) - 3)


def marker_parts(marker: Column) -> Column:
    p = F.regexp_extract(marker, r"^(\d{3,4})([abc])(\d{2})$", 1)
    return F.struct(p.try_cast("int").alias("page"), F.regexp_extract(marker, r"^(\d{3,4})([abc])(\d{2})$", 2).alias("column"), F.regexp_extract(marker, r"^(\d{3,4})([abc])(\d{2})$", 3).try_cast("int").alias("line"))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def decorate_source(s: Column) -> Column:
    """Escaped, with line-leading markers and all apparatus tags wrapped."""
    s = F.regexp_replace(escape_html(s), r"(?m)^\[(\d{3,4}[abc]\d{2})\]", '<span class="mk">[$1]</span>')
    return F.regexp_replace(s, "(" + APPARATUS + ")", '<span class="ap">$1</span>')


def strip_leading_marker(s: Column) -> Column:
    """Without a leading marker or range of markers."""
    one = r"\[\d{3,4}[abc]\d{2}\]"
    inside = r"\[\d{3,4}[abc]\d{2}\s*[–—~-]\s*(?:\d{3,4})?[abc]?\d{2}\]"
    return F.regexp_replace(s, rf"^\s*(?:{inside}|{one}(?:\s*[–—~-]\s*{one})?)\s*", "")


def percent(x: Column) -> Column:
    """Half up."""
    return F.floor(x * 100 + 0.5).cast("long")


def coverage(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(done / total, 4)).otherwise(F.lit(0.0))


def anchor_url(work: Column, marker: Column, i: Column) -> Column:
    return F.concat(F.lit("#/w/"), work, F.lit("/"), F.coalesce(marker, F.concat(F.lit("u"), i.cast("string"))))


def deep_link(work: Column, marker: Column, i: Column, query: Column, side: Column) -> Column:
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(anchor_url(work, marker, i), F.lit("?q="), code(query), F.lit("&in="), side, F.lit("&u="), i.cast("string"))


def route(url: Column) -> Column:
    """struct(view, id, anchor, params) of a #/view/id/anchor?k=v address."""
    path = F.regexp_replace(F.substring_index(url, "?", 1), r"^#?/?", "")
    seg = F.split(path, "/")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.contains("=")), lambda p: F.struct(F.substring_index(p, "=", 1), F.url_decode(F.regexp_replace(p, "^[^=]*=", ""))))
    return F.struct(F.get(seg, 0).alias("view"), F.get(seg, 1).alias("id"), F.get(seg, 2).alias("anchor"), F.map_from_entries(F.array_distinct(pairs)).alias("params"))


# ---- offset maps: what a match in normalised text covers in the raw text (code points) ----

_DROPPED = frozenset("。，、．・？！：；「」『』（）()〔〕【】[]“”‘’·…—　")
_TAGS = r"\[(?:\d{3,4}[abc]\d{2}|\d{1,3}|＊|\*)\]"
_FOLDS = dict(zip(FOLD_FROM, FOLD_TO))


@functools.cache
def _char(c: str, kind: str, marks: bool) -> str:
    """What one character becomes. Search text of the translation keeps its marks; where marks go, a character goes
    whole if any part of its composed form is one."""
    n = unicodedata.normalize("NFKC", c)
    if not marks:
        return "" if c.isspace() or c == "\ufeff" else n.lower()
    if any(x in _DROPPED or x.isspace() for x in n):
        return ""
    return "".join(_FOLDS.get(x, x) for x in n) if kind == "cn" else n.lower()


def mapped(raw: str, kind: str, highlight: bool) -> tuple[str, list[int]]:
    """Normal text and each of its characters' place in raw; as highlighting compares, or as search does."""
    skip = {i for m in re.finditer(_TAGS, raw) for i in range(*m.span())} if kind == "cn" and "[" in raw else ()
    marks = highlight or kind == "cn"
    parts = [(i, x) for i, c in enumerate(raw) if i not in skip for x in _char(c, kind, marks)]
    return "".join(x for _, x in parts), [i for i, _ in parts]


def ranges_of(raw: str | None, needle: str | None, kind: str) -> list[tuple[int, int]]:
    """[start, end) of all non-overlapping occurrences of a needle that is normalised for highlighting."""
    if not raw or not needle:
        return []
    text, at = mapped(raw, kind, highlight=True)
    return [(at[m.start()], at[m.end() - 1] + 1) for m in re.finditer(re.escape(needle), text)]


def snippet_of(raw: str | None, needle: str | None, kind: str) -> tuple[str, str, str] | None:
    """(before, hit, after) of the first occurrence of a needle that is normalised for search."""
    if not raw or not needle:
        return None
    text, at = mapped(raw, kind, highlight=False)
    p, pad = text.find(needle), PAD[kind]
    if p < 0:
        return None
    a, z = at[p], at[p + len(needle) - 1] + 1
    return ("…" if a > pad else "") + raw[max(0, a - pad) : a], raw[a:z], raw[z : z + pad] + ("…" if z + pad < len(raw) else "")


def find_ranges(raw: Column, needle: Column, kind: str) -> Column:
    """[start, end) of all occurrences. Only texts that can hold the needle go to Python: those that have it when
    normalised as a whole, and those beyond ASCII, where a character can become several."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": z} for a, z in ranges_of(x, y, kind)] for x, y in zip(r, n)], dtype=object)

    plain = norm_highlight(raw, kind, compose=False)
    if kind == "cn":
        plain = norm_highlight(F.regexp_replace(F.regexp_replace(raw, MARKER, ""), APPARATUS, ""), kind, compose=False)
    can = F.coalesce(plain.contains(needle) | F.regexp_like(raw, F.lit(r"[^\x00-\x7F]")), F.lit(False))
    # the argument is null where there is nothing to find, so that the text isn't sent
    found = run(F.when(can, raw), needle)
    return F.when(can, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def kwic(raw: Column, needle: Column, kind: str) -> Column:
    """struct(pre, hit, post) around the first occurrence of a needle that is normalised for search, with ellipses
    where cut; null where there is none."""

    @F.pandas_udf("struct<pre:string,hit:string,post:string>")
    def run(r: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet_of(x, y, kind) or (None, None, None) for x, y in zip(r, n)], columns=["pre", "hit", "post"])

    s = run(raw, needle)
    return F.when(s["hit"].isNotNull(), s)


def mark_ranges(raw: Column, ranges: Column) -> Column:
    """Escaped text with each range wrapped."""
    cut = F.aggregate(
        ranges,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, r: F.struct(
            r["end"].alias("at"),
            F.concat(a["out"], escape_html(F.substring(raw, a["at"] + 1, r["start"] - a["at"])), F.lit('<mark class="hit-mark">'), escape_html(F.substring(raw, r["start"] + 1, r["end"] - r["start"])), F.lit("</mark>")).alias("out"),
        ),
    )
    return F.concat(cut["out"], escape_html(F.substring(raw, cut["at"] + 1, F.length(raw))))
