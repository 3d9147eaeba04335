"""HTML main text by equivalence-class template deduction.

A page is a sequence of tokens: opening and closing tags of block elements, each with its path of open elements, and
words with the path of their block. Over the pages of a group (the pages of a host that use the same structural
elements) a token's occurrence vector is its count in each page.

1. Classes: tokens in every page whose vectors are equal. Vectors are held as keyed sums, which add up across tasks.
   A token with the same count in all pages is told apart by its occurrence number, so each of its occurrences is a
   token of the root class, which every page has once. The other classes of several tokens are the nested ones.
2. Validity: a root token counts on a page if it keeps the order of the group's reference page; an element is valid if
   on every page both its tags count and it lies in the same valid element; a nested class is valid if on every page
   its tokens come round in one order inside one element. The valid elements, nested, are the template.
3. Slots: what the template leaves open is summed up for each element over all pages: free words, linked words, fixed
   words, blocks. From the page down, the slot that holds the larger part of the free text is followed as long as it
   is a container and leaves no page heading behind; there the article is. Elements of it that are mostly links or
   hold fixed words alone are none of its text; names of tags and classes decide only on elements of the template that hold the
   smaller part of it.

Pages of a host that has fewer than LEAST_PAGES different ones with these elements are grouped with such pages of
other hosts; where there are too few as well, there is no template, and names of elements decide.
"""

from __future__ import annotations

import bisect
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import join_checked, written

#: Different pages that a group needs for a template; tokens of a nested class; occurrences told apart.
LEAST_PAGES, LEAST_CLASS, MOST_COUNT = 3, 2, 64
#: Share of the free text that a slot needs to be followed, of links that sets an element apart, and average blocks of
#: a container.
FOLLOW, APART, BLOCKS_EACH = 0.5, 0.5, 1.5
#: Path steps that are told apart; elements below share their ancestor's path.
MOST_DEPTH = 60
_MASK = (1 << 63) - 1

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed sets of element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_NEVER = frozenset("head script style noscript template iframe object embed svg canvas audio video map form button select textarea input".split())
_ASIDE = frozenset("nav aside footer menu dialog".split())
#: Whole class words, ids and roles that name what is no part of an article (fixed values).
_MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comments cookie-banner menu navbar navigation newsletter related share sidebar site-header sponsored".split())
#: Structural elements whose presence tells layouts of a host apart.
LAYOUT = r"(?i)<(nav|aside|article|main|header|footer|section|form|table|ul|div|h1)\b"
_CLOSES_P = _BLOCKS - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "option", "optgroup", "legend", "summary"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def tokens(page: str):
    """(kind, value, attributes) of a page: open, close or text, in order. Comments and declarations are left out;
    the insides of raw elements are skipped, so tags in scripts count for nothing."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at : m.start()], None
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>").replace("&", "&amp;"), None
            continue
        name = name.lower()
        if m[1]:
            yield "close", name, None
            continue
        yield "open", name, m[3]
        if name in _RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if name == "textarea" or name == "title":
                yield "text", page[at : close.start() if close else end], None
            at = close.end() if close else end
            yield "close", name, None


class Page:
    """One walk over a page: its stream of tags and blocks, and its elements.

    stream: tag tokens ("<path" or ">path") and, for a block, its number. blocks: (text, path, linked characters,
    heading). elements: [open place, close place, aside by name, main by name] of block elements, by opening.
    """

    def __init__(self, html: str) -> None:
        self.stream: list = []
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.elements: list[list] = []
        self._parts: list[str] = []
        self._linked, self._link, self._open_p = 0, False, 0
        stack: list[tuple[str, str, bool, int | None]] = []  # name, path, off, element
        for kind, value, attrs in tokens(html):
            if kind == "text":
                if not (stack and stack[-1][2]):
                    self._parts.append(value)
                    if self._link:
                        self._linked += len("".join(value.split()))
            elif kind == "open":
                if self._open_p and value in _CLOSES_P:
                    self._close(stack, "p", ("table", "button", "object", "td", "th"))
                elif value == "li":
                    self._close(stack, "li", ("ul", "ol", "menu"))
                elif value in ("dt", "dd"):
                    self._close(stack, "dt", ("dl",))
                    self._close(stack, "dd", ("dl",))
                elif value in ("tr", "td", "th", "option"):
                    self._close(stack, value, ("table",))
                if value in _BLOCKS:
                    self._flush(stack)
                elif value in ("br", "td", "th"):
                    self._parts.append(" ")
                if value == "a":
                    self._link = True
                a = _attributes(attrs) if attrs and ("=" in attrs or "hidden" in attrs) else {}
                if value in _VOID or (attrs or "").rstrip().endswith("/") and value not in _BLOCKS:
                    continue
                above, off = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                hidden = a and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())
                place = None
                if value in _BLOCKS:
                    sign, aside, main = value, value in _ASIDE, value in ("article", "main")
                    if a:
                        # digits in class names number pages and records, not kinds of elements
                        sign = ".".join([value, *re.sub(r"[0-9]+", "", a.get("class", "")).split()])
                        words = {*a.get("class", "").lower().split(), a.get("id", "").lower(), a.get("role", "").lower()}
                        aside, main = (aside or bool(words & _MARKS)) and value not in ("html", "body"), main or "main" in words
                    above = f"{above}/{sign}" if len(stack) < MOST_DEPTH else above
                    place = len(self.elements)
                    self.elements.append([len(self.stream), -1, aside, main, value])
                    self.stream.append("<" + above)
                self._open_p += value == "p"
                stack.append((value, above, off or hidden or value in _NEVER, place))
            else:
                if value in _BLOCKS:
                    self._flush(stack)
                elif value in ("td", "th"):
                    self._parts.append(" ")
                elif value == "a":
                    self._link = False
                if stack and stack[-1][0] == value or any(s[0] == value for s in stack):
                    while self._pop(stack) != value:
                        pass
        self._flush(stack)
        while stack:
            self._pop(stack)

    def _pop(self, stack) -> str:
        name, path, _, place = stack.pop()
        self._open_p -= name == "p"
        if place is not None:
            self.elements[place][1] = len(self.stream)
            self.stream.append(">" + path)
        return name

    def _close(self, stack, name, stop) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                self._flush(stack)
                while len(stack) > i:
                    self._pop(stack)
                return
            if stack[i][0] in stop:
                return

    def _flush(self, stack) -> None:
        if self._parts:
            text = "".join(self._parts)
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            linked, self._parts, self._linked = self._linked, [], 0
            if text and not (stack and stack[-1][2]):
                self.stream.append(len(self.blocks))
                self.blocks.append((text, stack[-1][1] if stack else "", linked, any(s[0] in ("h1", "h2") for s in stack[-2:])))

    def counts(self, paths: set[str] | None = None) -> dict[str, int]:
        """Token counts; of words only those in blocks of the given paths."""
        out: dict[str, int] = {}
        for t in self.ordered(paths):
            out[t] = out.get(t, 0) + 1
        return out

    def ordered(self, paths: set[str] | None = None):
        for t in self.stream:
            if t.__class__ is str:
                yield t
            else:
                text, path, _, _ = self.blocks[t]
                if paths is None or path in paths:
                    for w in text.split():
                        yield f"{path} {w}"


def token_hash(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) & _MASK


def page_key(html: str) -> int:
    """Equal for equal payloads: copies of a page add multiples of the same terms, which leave equal vectors equal."""
    import xxhash

    return xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass")) & _MASK


def classes(found: dict[int, int], total: int, order: list[int]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The root class, as (token, occurrence from 0) in the reference page's order, and the nested classes.

    found: the vector sum of each token that all pages have; total: the sum of a vector of ones; order: the reference
    page's tokens as they come.
    """
    constant = {(n * total) & _MASK: n for n in range(MOST_COUNT, 0, -1)}
    root, seen = [], {}
    for t in order:
        if found.get(t) in constant:
            k = seen.get(t, 0)
            seen[t] = k + 1
            root.append((t, k))
    by: dict[int, list[int]] = {}
    for t in dict.fromkeys(order):
        if t in found and found[t] not in constant:
            by.setdefault(found[t], []).append(t)
    return root, [ts for ts in by.values() if len(ts) >= LEAST_CLASS]


def rising(places: list[int]) -> set[int]:
    """Indexes of a longest strictly rising subsequence (of several that with the smallest ends)."""
    ends, at, before = [], [], [-1] * len(places)
    for i, v in enumerate(places):
        k = bisect.bisect_left(ends, v)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = before[i]
    return out


class Template:
    """A group's root and nested classes, looked up on a page."""

    def __init__(self, root: list[int], ks: list[int], nested: list[int], group: list[int], paths: list[int]) -> None:
        #: paths: of blocks that hold words of the root class
        self.paths = set(paths)
        self.place = {(t, k): i for i, (t, k) in enumerate(zip(root, ks))}
        self.known, self.nested = set(root), dict(zip(nested, group))
        self.order: dict[int, list[int]] = {}
        for t, g in zip(nested, group):
            self.order.setdefault(g, []).append(t)

    def places(self, page: Page, hashed) -> tuple[dict[int, int], list[tuple[int, int]], list[int]]:
        """Stream place of tags to root place, the words that keep the order (block, characters), and the stream's hashes."""
        seen: dict[int, int] = {}
        found, where = [], []
        for at, t in enumerate(page.stream):
            if t.__class__ is str:
                h = hashed(t)
                if h in self.known:
                    k = seen.get(h, 0)
                    seen[h] = k + 1
                    if (h, k) in self.place:
                        found.append(self.place[h, k])
                        where.append((at, 0))
            else:
                text, path, _, _ = page.blocks[t]
                for w in text.split() if self.paths and hashed(path) in self.paths else ():
                    h = hashed(f"{path} {w}")
                    if h in self.known:
                        k = seen.get(h, 0)
                        seen[h] = k + 1
                        if (h, k) in self.place:
                            found.append(self.place[h, k])
                            where.append((at, len(w)))
        keep = rising(found)
        tags = {where[i][0]: found[i] for i in keep if not where[i][1]}
        return tags, [where[i] for i in keep if where[i][1]]


#: Kinds of statistics rows: an element, a nested class, a page.
_ELEMENT, _CLASS, _PAGE = 0, 1, 2


def slots(page: Page, template: Template, hashed) -> dict[tuple, list[int]]:
    """(kind, open, close, parent) to [pages, free, linked, fixed characters, blocks, free heading characters, aside by
    name] for the template's elements on a page (-1: the page), and its nested classes with the element around them."""
    tags, words = template.places(page, hashed)
    fixed: dict[int, int] = {}
    for at, n in words:
        fixed[at] = fixed.get(at, 0) + n
    close_of = {e[0]: e for e in page.elements}
    opened = [(-1, 1 << 30, [0, 0, 0, 0, 0])]  # root place, stream place of the end, sums
    out: dict[tuple, list[int]] = {(_PAGE, 0, 0, 0): [1, 0, 0, 0, 0, 0, 0]}
    runs: dict[int, list] = {}
    done = []
    for at, t in enumerate(page.stream):
        while at > opened[-1][1]:
            done.append(opened.pop())
            opened[-1][2][:] = [a + b for a, b in zip(opened[-1][2], done[-1][2])]
        if t.__class__ is str:
            e = close_of.get(at) if t[0] == "<" else None
            if e and at in tags and e[1] in tags:
                key = (_ELEMENT, tags[at], tags[e[1]], opened[-1][0])
                sums = [0, 0, 0, 0, 0]
                out[key] = [1, sums, int(e[2])]
                opened.append((tags[at], e[1], sums))
                continue
            g = template.nested.get(hashed(t))
            if g is not None:
                runs.setdefault(g, []).append((hashed(t), opened[-1][0]))
        else:
            text, _, linked, heading = page.blocks[t]
            n = len(text) - text.count(" ")
            linked = min(linked, n)
            kept = min(fixed.get(at, 0), n - linked)
            s = opened[-1][2]
            s[0] += n - linked - kept
            s[1] += linked
            s[2] += kept
            s[3] += 1
            s[4] += n - linked - kept if heading else 0
    while len(opened) > 1:
        done.append(opened.pop())
        opened[-1][2][:] = [a + b for a, b in zip(opened[-1][2], done[-1][2])]
    out[_ELEMENT, -1, -1, -2] = [1, opened[0][2], 0]
    for key, v in out.items():
        if key[0] == _ELEMENT:
            out[key] = [1, *v[1], v[2]]
    for g, run in runs.items():
        order, around = template.order[g], {p for _, p in run}
        if len(around) == 1 and all(h == order[i % len(order)] for i, (h, _) in enumerate(run)) and len(run) % len(order) == 0:
            out[_CLASS, g, 0, around.pop()] = [1, 0, 0, 0, 0, 0, 0]
    return out


def choose(stats: dict[tuple, list[int]]) -> tuple[int | None, int | None, list[int] | None]:
    """(open, close, left out) of the article's element and of those inside it that are none of its text; from a
    group's summed statistics. -1 is the page; None where no page has free text."""
    total = stats.get((_PAGE, 0, 0, 0), [0])[0]
    valid = {k[1]: (k[2], k[3], v) for k, v in stats.items() if k[0] == _ELEMENT and v[0] == total}
    records = {k[3] for k, v in stats.items() if k[0] == _CLASS and v[0] == total}
    inside: dict[int, list[int]] = {}
    for e, (_, parent, _) in sorted(valid.items()):
        if parent in valid or parent == -2:
            inside.setdefault(parent, []).append(e)
    free = lambda e: valid[e][2][1]
    if -1 not in valid or not free(-1):  # no page says anything of its own
        return None, None, None
    at = -1
    while kids := inside.get(at):
        top = max(kids, key=lambda e: (free(e), -e))
        holds = valid[top][2][4] >= BLOCKS_EACH * total or top in records or top in inside
        title = sum(valid[e][2][5] for e in kids if e < top and valid[e][2][4] < 2 * BLOCKS_EACH * total)
        if not free(top) or free(top) < FOLLOW * free(at) or not holds or title:
            break
        at = top

    def apart(e):
        _, f, linked, fixed, _, _, named = valid[e][2]
        all_ = f + linked + fixed
        return all_ > 0 and (not f or linked > APART * all_ or (named > APART * total and f < FOLLOW * free(at)))

    out, todo = [], list(inside.get(at, ()))
    while todo:
        e = todo.pop()
        if apart(e):
            out.append(e)
        else:
            todo += inside.get(e, ())
    return at, valid[at][0], sorted(out)


def by_names(page: Page) -> str:
    """The main text by names of elements, for pages without a template: what main, else article elements hold, else
    the whole page, without elements that are something else by name."""
    from itertools import accumulate

    def spans(test):
        return [(e[0], e[1]) for e in page.elements if test(e)]

    def text(inside, out):
        depth = [0] * (len(page.stream) + 2)
        for a, z in inside:
            depth[a] += 1
            depth[z + 1] -= 1
        off = [0] * (len(page.stream) + 2)
        for a, z in out:
            off[a] += 1
            off[z + 1] -= 1
        depth, off = list(accumulate(depth)), list(accumulate(off))
        return [page.blocks[t][0] for at, t in enumerate(page.stream) if t.__class__ is int and (depth[at] or not inside) and not off[at]]

    mains = [e for e in page.elements if e[3]]
    named = [e for e in mains if e[4] != "article"]
    main = [(e[0], e[1]) for e in named] or [(e[0], e[1]) for e in mains if not any(x[2] and x[0] <= e[0] and e[1] <= x[1] for x in page.elements)]
    out = spans(lambda e: e[2] and not any(e[0] <= a and z <= e[1] for a, z in main))
    return "\n".join((main and text(main, out)) or text([], out + spans(lambda e: e[4] == "header")) or text([], out))


def extract(html: str | None, template: Template | None = None, article: tuple | None = None, hashed=token_hash) -> str:
    """The main text of a page: blocks joined by newlines. article: the open and close place and what is left out."""
    if not html:
        return ""
    page = Page(html)
    if template is None or article is None:
        return by_names(page)
    tags, _ = template.places(page, hashed)
    begin, end, skip = -1, len(page.stream), set(article[2])
    for a, z, *_ in page.elements:
        if tags.get(a) == article[0] and tags.get(z) == article[1]:
            begin, end = a, z
    out, until = [], -1
    ends = {a: z for a, z, *_ in page.elements if tags.get(a) in skip}
    for at in range(begin + 1, end):
        if at in ends:
            until = max(until, ends[at])
        t = page.stream[at]
        if t.__class__ is int and at > until:
            out.append(page.blocks[t][0])
    return "\n".join(out)


def _hasher():
    memo: dict[str, int] = {}

    def hashed(t: str) -> int:
        h = memo.get(t)
        if h is None:
            if len(memo) > 1 << 20:
                memo.clear()
            h = memo[t] = token_hash(t)
        return h

    return hashed


def _emit(rows: list, schema: pa.Schema):
    for at in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512]), schema.types)], schema=schema)


def grouped(pages: DataFrame) -> DataFrame:
    """page_id, url, html, grp, n_pages: each page's group and its number of different pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host.alias("host"))
    layout = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LAYOUT), F.lit(1)), lambda x: F.lower(x)))), ",")
    own = own.withColumn("layout", layout)
    sizes = own.select("host", "layout", F.xxhash64("html").alias("x")).groupBy("host", "layout").agg(F.count_distinct("x").alias("n"))
    pooled = sizes.withColumn("grp", F.when(F.col("n") >= LEAST_PAGES, F.concat_ws("|", "host", "layout")).otherwise(F.concat(F.lit("*|"), "layout")))
    both = pooled.groupBy("grp").agg(F.sum("n").alias("n_pages"))
    sizes = written(pooled.join(both, "grp").select("host", "layout", "grp", "n_pages"), "page-groups")
    return join_checked(own, sizes, ["host", "layout"]).select("page_id", "url", "html", "grp", "n_pages")


def vectors(pages: DataFrame) -> DataFrame:
    """(grp, total, ref, tokens): of each group with enough pages the sum of ones, the reference page's tokens in order,
    and (token, sum, path of a word's block) of the tokens that all its pages have.

    A task keeps for each group only what all its pages there have; what is in every page of the group is in every
    page of each task. The sums are added up token by token, so no task sees a group's tasks at once.
    """
    schema = pa.schema([("grp", pa.string()), ("total", pa.int64()), ("key", pa.int64()), ("ref", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("paths", pa.list_(pa.int64()))])

    def run(batches):
        held: dict[str, list] = {}
        for b in batches:
            for grp, html in zip(b.column(0).to_pylist(), b.column(1)):
                html = html.as_py()
                page, key = Page(html), page_key(html)
                if not page.stream:
                    continue
                h = held.get(grp)
                if h is None:
                    counts = page.counts()
                    held[grp] = h = [key, key, list(page.ordered()), {t: (n * key) & _MASK for t, n in counts.items()}, None]
                else:
                    counts = page.counts(h[4])
                    h[0] = (h[0] + key) & _MASK
                    if key < h[1]:
                        h[1], h[2] = key, list(page.ordered(h[4]))
                    h[3] = {t: (s + counts[t] * key) & _MASK for t, s in h[3].items() if t in counts}
                h[4] = {t[: t.rindex(" ")] for t in h[3] if t[0] not in "<>"}
        rows = []
        for grp, (total, key, order, sums, _) in held.items():
            hashes = {t: token_hash(t) for t in sums}
            rows.append((grp, total, key, [hashes[t] for t in order if t in hashes], list(hashes.values()), list(sums.values()), [0 if t[0] in "<>" else token_hash(t[: t.rindex(" ")]) for t in hashes]))
        yield from _emit(rows, schema)

    seen = written(pages.where(f"n_pages >= {LEAST_PAGES}").select("grp", "html").mapInArrow(run, "grp string, total long, key long, ref array<long>, tokens array<long>, sums array<long>, paths array<long>"), "page-vectors")
    added = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(19,0)")), F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    groups = seen.groupBy("grp").agg(F.count("*").alias("tasks"), added("total").alias("total"), F.min_by("ref", F.struct("key", "ref")).alias("ref"))
    each = seen.select("grp", F.explode(F.arrays_zip("tokens", "sums", "paths")).alias("t")).select("grp", "t.tokens", "t.sums", "t.paths")
    each = each.groupBy("grp", "tokens").agg(F.count("*").alias("n"), added("sums").alias("sum"), F.max("paths").alias("path")).join(groups.select("grp", "tasks"), "grp").where("n = tasks")
    return groups.drop("tasks").join(each.groupBy("grp").agg(F.collect_list(F.struct(F.col("tokens").alias("token"), "sum", "path")).alias("tokens")), "grp")


_CLASSES = "root array<long>, ks array<int>, nested array<long>, class array<int>, paths array<long>"


def templates(pages: DataFrame) -> DataFrame:
    """(grp, root, ks, nested, class, paths): the classes of each group of pages (as `grouped` has them)."""
    schema = pa.schema([("grp", pa.string()), ("root", pa.list_(pa.int64())), ("ks", pa.list_(pa.int32())), ("nested", pa.list_(pa.int64())), ("class", pa.list_(pa.int32())), ("paths", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for grp, total, order, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                root, nested = classes({t["token"]: t["sum"] for t in found}, total, order)
                fixed = {t for t, _ in root}
                rows.append((grp, [t for t, _ in root], [k for _, k in root], [t for ts in nested for t in ts], [i for i, ts in enumerate(nested) for _ in ts], sorted({t["path"] for t in found if t["path"] and t["token"] in fixed})))
            yield from _emit(rows, schema)

    return vectors(pages).select("grp", "total", "ref", "tokens").mapInArrow(run, f"grp string, {_CLASSES}")


def _looked_up(known: dict, grp, arrays) -> Template | None:
    """The group's template: arrays are read once a group and batch."""
    if grp not in known:
        known[grp] = Template(*(a.as_py() for a in arrays)) if arrays[0].as_py() else None
    return known[grp]


def articles(pages: DataFrame, classes_: DataFrame) -> DataFrame:
    """(grp, open, close, skip): where the article of each group's template is. pages: with the group's classes."""
    names = ("pages", "free", "linked", "fixed", "blocks", "heading", "named")
    schema = pa.schema([("grp", pa.string()), ("kind", pa.int32()), ("open", pa.int64()), ("close", pa.int64()), ("parent", pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(batches):
        hashed, sums = _hasher(), {}
        for b in batches:
            known: dict = {}
            for i, grp in enumerate(b.column(0).to_pylist()):
                template = _looked_up(known, grp, [b.column(c)[i] for c in range(2, 7)])
                page = Page(b.column(1)[i].as_py())
                if template is None or not page.stream:
                    continue
                for key, v in slots(page, template, hashed).items():
                    have = sums.setdefault((grp, *key), [0] * len(names))
                    have[:] = [x + y for x, y in zip(have, v)]
        yield from _emit([(*k, *v) for k, v in sums.items()], schema)

    stats = pages.where("root is not null").select("grp", "html", "root", "ks", "nested", "class", "paths").mapInArrow(run, "grp string, kind int, open long, close long, parent long, " + ", ".join(f"{n} long" for n in names))
    stats = stats.groupBy("grp", "kind", "open", "close", "parent").agg(*[F.sum(n).alias(n) for n in names])
    stats = stats.groupBy("grp").agg(F.collect_list(F.struct("kind", "open", "close", "parent", *names)).alias("stats"))
    out = pa.schema([("grp", pa.string()), ("open", pa.int64()), ("close", pa.int64()), ("skip", pa.list_(pa.int64()))])

    def decide(batches):
        for b in batches:
            rows = []
            for grp, all_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {(s["kind"], s["open"], s["close"], s["parent"]): [s[n] for n in names] for s in all_}
                rows.append((grp, *choose(found)))
            yield from _emit(rows, out)

    return stats.mapInArrow(decide, "grp string, open long, close long, skip array<long>")


#: Groups up to which templates are broadcast: a template has no more tokens than its group's smallest page.
BROADCAST_GROUPS = 2000


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty html give empty text; pages without a host in their
    url are one host's; repeated rows each get their text; extra columns are ignored.
    """
    own = grouped(pages)
    found = written(templates(own), "templates")
    df = join_checked(own, found, "grp", limit=BROADCAST_GROUPS)
    where = written(articles(df, found), "articles")
    df = join_checked(df, where, "grp", limit=BROADCAST_GROUPS).select("page_id", "url", "html", "grp", "root", "ks", "nested", "class", "paths", "open", "close", "skip")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        hashed = _hasher()
        for b in batches:
            known: dict = {}
            places: dict = {}
            out, size = [], 0
            for i, (page_id, url, grp, open_) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 9)))):
                template = article = None
                if open_ is not None:
                    template = _looked_up(known, grp, [b.column(c)[i] for c in range(4, 9)])
                    if grp not in places:
                        places[grp] = (open_, b.column(10)[i].as_py(), b.column(11)[i].as_py())
                    article = places[grp]
                text = extract(b.column(2)[i].as_py(), template, article, hashed)
                out.append((page_id, url, text, len(text)))
                size += len(text)
                if size > 4 << 20:
                    yield from _emit(out, schema)
                    out, size = [], 0
            yield from _emit(out, schema)

    return df.mapInArrow(run, "page_id long, url string, text string, n_chars long")
