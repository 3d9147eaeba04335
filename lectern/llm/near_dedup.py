"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers (five words) are labelled with their occurrence number. Each of several sketches takes the labelled
k-mers with the smallest keyed hashes and keeps them in text order, so it collides for texts that share k-mers in
the same order. Texts of few k-mers are also met by what is left of them after each choice of as many deletions as the
threshold allows, which misses none. Texts that share a sketch or such a rest are candidates; a banded alignment of
their k-mer sequences finds the k-mers kept in order, c, and the similarity c / (n_a + n_b - c) decides. Classes are
the connected components.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm import textvec
from lectern.llm.common import BROADCAST_IDS, join_checked, written

#: Five k-mers a sketch and 32 sketches: two texts that share a fifth of their k-mers (a common passage) meet in one
#: of 100 cases, two long ones at the threshold are missed in 3 of a million (of 100 k-mers in 5 of a million).
WORDS, SIMILARITY, SKETCHES, KEPT = 5, 0.8, 32, 5
#: Texts of up to FEW k-mers meet by their rests, with certainty; below MEDIUM k-mers a text has twice the sketches,
#: so that two at the threshold (8 of 10 k-mers at worst) are missed in 1 of 10 million.
FEW, MEDIUM = 9, 100
#: Rows with texts that go to Python at a time: both sides hold them, and the work is done in blocks of 1 MB anyway.
BATCH = 500
#: Members as near as this to their centre are compared by what sets them apart from it.
NEAR = 0.5
_U = np.uint64
_SEEDS = textvec.mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each element stood before, by place."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    run = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    out = np.empty(len(x), dtype=np.int64)
    out[order] = run
    return out


def order_minhash(kmers: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> list[int]:
    """`sketches` signed 64-bit values: each of the `kept` labelled k-mers with smallest hashes, in text order."""
    n = len(kmers)
    if not n:
        return []
    label = textvec.mix(kmers + occurrences(kmers).astype(_U) * _U(0x9FB21C651E98DF25))
    out = []
    step = max(1, (1 << 19) // n)  # so many rows of hashes at a time
    for at in range(0, sketches, step):
        h = label[None, :] * _SEEDS[at : min(sketches, at + step), None]
        rows = np.arange(len(h))
        picks = []
        for _ in range(min(kept, n)):
            i = h.argmin(axis=1)
            h[rows, i] = _U(0xFFFFFFFFFFFFFFFF)
            picks.append(i)
        where = np.sort(np.stack(picks, axis=1), axis=1)
        v = np.zeros(len(h), dtype=_U)
        for c in range(where.shape[1]):
            v = textvec.mix(v * _U(0x9E3779B97F4A7C15) + label[where[:, c]])
        out.append(v)
    return np.concatenate(out).view(np.int64).tolist()


def rests(kmers: np.ndarray, least: float = SIMILARITY, few: int = FEW) -> list[int]:
    """Signed 64-bit values: what is left of the k-mers, in text order, after each choice of deletions.

    Two texts that keep c k-mers in order reach `least` only if c is at least that share of either one's, so they
    have a rest of c k-mers in common. Where the shorter has up to `few`, c is no more: longer rests aren't needed.
    """
    n = len(kmers)
    low, high = max(1, int(np.ceil(least * n - 1e-9))), min(n, few)
    out = set()
    for c in range(low, high + 1):
        kept = kmers[np.array(list(itertools.combinations(range(n), c)))]
        v = np.full(len(kept), c, dtype=_U)
        for i in range(c):
            v = textvec.mix(v * _U(0x9E3779B97F4A7C15) + kept[:, i])
        out.update(v.view(np.int64).tolist())
    return sorted(out)


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of a and b within `band` places off the diagonal.

    Bit-parallel: a row's cells inside the band are one integer, which moves one place a row.
    """
    if len(a) > len(b):
        a, b = b, a
    head = int(np.argmax(np.append(a != b[: len(a)], True)))
    a, b = a[head:], b[head:]
    tail = int(np.argmax(np.append((a[::-1] != b[::-1][: len(a)]), True))) if len(a) else 0
    if tail:
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return head + tail
    places: dict[int, list[int]] = {}
    for i, v in enumerate(a.tolist()):
        places.setdefault(v, []).append(i)
    whole = {v: sum(1 << i for i in p) for v, p in places.items() if len(p) > 16}
    width = 2 * band + 1
    full = (1 << width) - 1
    low, v, kept = -band, full, 0  # bit i of v stands for place low + i of a; a zero bit is a step of the count
    n = len(a)
    for row in b.tolist():
        m = 0
        if row in whole:
            m = (whole[row] >> low if low >= 0 else whole[row] << -low) & full
        else:
            for p in places.get(row, ()):
                if 0 <= p - low < width:
                    m |= 1 << (p - low)
        u = v & m
        v = ((v + u) | (v - u)) & full
        if low >= 0 and not v & 1:
            kept += 1  # the lowest place leaves the band with its step
        v = (v >> 1) | (1 << (width - 1))
        low += 1
    # what is left inside the band: zero bits at places of a
    inside = range(max(0, -low), min(width, n - low))
    return head + tail + kept + sum(1 for i in inside if not v >> i & 1)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """c / (n_a + n_b - c) for k-mers kept in order; 0.0 where it can't reach `least`."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return float(na == nb)
    need = least / (1 + least) * (na + nb)
    if min(na, nb) < need - 1e-9:
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need - 1e-9:  # without order there can't be more
        return 0.0
    # an alignment with enough in common leaves at most so many k-mers of both out
    c = banded_common(a, b, int(na + nb - 2 * need) + 1)
    s = c / (na + nb - c)
    return s if s >= least - 1e-12 else 0.0


def _kmers(texts: list[bytes], k: int) -> list[np.ndarray]:
    h, counts = textvec.words(texts)
    ends = np.cumsum(counts)
    return [textvec.shingles(h[e - c : e], k) for e, c in zip(ends, counts)]


def _blocks(column, limit: int = 1 << 20):
    """(start, texts as bytes) of a string column, about `limit` bytes at a time; null is empty."""
    out, at, size = [], 0, 0
    for i, t in enumerate(column):
        b = t.as_buffer().to_pybytes() if t.is_valid else b""
        if out and size + len(b) > limit:
            yield at, out
            out, at, size = [], i, 0
        out.append(b)
        size += len(b)
    if out:
        yield at, out


def sketch(documents: DataFrame, k: int = WORDS, sketches: int = SKETCHES, kept: int = KEPT, least: float = SIMILARITY) -> DataFrame:
    """doc_id, d1, d2 (digest of the word sequence), n_kmers, sketches, rests of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_kmers", pa.int64()), ("sketches", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64()))])
    twice = min(2 * sketches, len(_SEEDS))

    def run(batches):
        for b in batches:
            for at, texts in _blocks(b.column(1)):
                h, counts = textvec.words(texts)
                d1, d2, n, sk, rs = [], [], [], [], []
                for e, c in zip(np.cumsum(counts).tolist(), counts.tolist()):
                    w = h[e - c : e]
                    pw, _ = textvec.powers(c + 1)
                    d1.append(int((w * pw[1:]).sum(dtype=_U).view(np.int64)) ^ c)
                    d2.append(int((textvec.mix(w ^ _U(0x5851F42D4C957F2D)) * pw[1:]).sum(dtype=_U).view(np.int64)))
                    x = textvec.shingles(w, k)
                    n.append(len(x))
                    sk.append(order_minhash(x, twice if len(x) < MEDIUM else sketches, kept) if len(x) > FEW else [])
                    rs.append(rests(x, least))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(sk, pa.list_(pa.int64())), pa.array(rs, pa.list_(pa.int64()))], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, d1 long, d2 long, n_kmers long, sketches array<long>, rests array<long>")


def labelled(kmers: np.ndarray) -> np.ndarray:
    """A multiset's elements as a sorted set: each k-mer with its occurrence number."""
    return np.sort(textvec.mix(kmers + occurrences(kmers).astype(_U) * _U(0x9FB21C651E98DF25)))


def compare(pairs: DataFrame, documents: DataFrame, k: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """a, b, linked, jaccard, n_a, n_b, lost, diff for each of pairs (a, b).

    linked: the alignment reaches `least`. jaccard: of the k-mers as multisets, at least as large. lost: how many of
    b's a lacks; diff: what only one of the two has, where jaccard is at least NEAR. Both texts are joined by
    shuffles that split hot ids.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("jaccard", pa.float64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("lost", pa.int64()), ("diff", pa.list_(pa.int64()))])

    def one(x, y):
        p, q = labelled(x), labelled(y)
        common = np.intersect1d(p, q, assume_unique=True)
        j = len(common) / max(1, len(p) + len(q) - len(common)) if len(p) or len(q) else 1.0
        diff = np.setxor1d(p, q, assume_unique=True).view(np.int64).tolist() if j >= NEAR else []
        return similarity(x, y, least) > 0, j, len(p), len(q), len(q) - len(common), diff

    def run(batches):
        for b in batches:
            at, size = 0, 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or size > 1 << 20:
                    part = b.slice(at, i - at)
                    if part.num_rows:
                        x = _kmers([t.as_buffer().to_pybytes() for t in part.column(2)], k)
                        y = _kmers([t.as_buffer().to_pybytes() for t in part.column(3)], k)
                        cols = zip(*[one(u, v) for u, v in zip(x, y)])
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(cols, schema.types[2:])]], schema=schema)
                    at, size = i, 0
                if i < b.num_rows:
                    size += len(b.column(2)[i].as_buffer()) + len(b.column(3)[i].as_buffer())

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    own = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # only texts of candidates go on; rows that share a doc_id are one document
    own = written(join_checked(own, ids, "id", "left_semi", BROADCAST_IDS).groupBy("id").agg(F.min("text").alias("text")), "pair-texts")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean, jaccard double, n_a long, n_b long, lost long, diff array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of its component, for every id of edges (a, b). Alternating stars, no collecting."""
    one = lambda df: df.where("u != v").distinct()
    now = written(one(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = one(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # every u keeps its smallest neighbour, to which its other smaller neighbours go
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(one(small), "edges")
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = after


def classes(documents: DataFrame, k: int = WORDS, least: float = SIMILARITY, sketches: int = SKETCHES, kept: int = KEPT) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and is_representative for every row with a doc_id.

    Texts with the same words in the same order (texts without words among themselves, null included) are one class
    from the start; doc_id is taken to name a document, so rows that repeat one count once in the search. Rows with
    a null doc_id get a null class. Extra columns are ignored.
    """
    rows = written(sketch(documents, k, sketches, kept, least), "sketches", BATCH)
    known = rows.where("doc_id is not null")
    exact = written(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_kmers").alias("n"), F.first("sketches").alias("sketches"), F.first("rests").alias("rests")), "distinct-texts")
    way = lambda h, j: F.struct(j.alias("j"), h.alias("h"))
    ways = F.concat(F.transform("sketches", way), F.transform("rests", lambda h: way(h, F.lit(-1))))
    bucket = exact.select("rep", "n", F.explode(ways).alias("way")).select("rep", "n", "way.j", "way.h")
    many = bucket.groupBy("j", "h").agg(F.count("*").alias("many")).where("many > 1")
    bucket = written(bucket.join(many, ["j", "h"]), "buckets")
    # 1: everyone against the centre of its bucket: the member with most company, likely the text that the rest vary
    company = bucket.groupBy("rep").agg(F.sum("many").alias("company"))
    centre = bucket.join(company, "rep").groupBy("j", "h").agg(F.max(F.struct("company", (-F.col("rep")).alias("low"))).alias("top"))
    bucket = written(bucket.join(centre.select("j", "h", (-F.col("top.low")).alias("c")), ["j", "h"]).select("j", "h", "rep", "n", "c"), "buckets")
    star = written(compare(bucket.where("rep != c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct(), documents, k, least), "star", BATCH)
    links = star.where("linked").select("a", "b")
    root = written(components(links), "roots")
    # 2: a centre's members that are still apart. By way of the centre their common k-mers are counted without a look
    # at the texts: what both share with it, and what both have or lack unlike it.
    near = star.where(F.col("jaccard") >= NEAR).join(root, star.a == root.id, "left").select("a", "b", "n_a", "n_b", "lost", "diff", F.coalesce("root", "a").alias("root"))
    split = near.groupBy("b").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("b")
    near = written(near.join(split, "b"), "near")
    x, y = near.alias("x"), near.alias("y")
    bound = F.lit(least / (1 + least)) * (F.col("x.n_a") + F.col("y.n_a")) - 1e-9
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.a") > F.col("y.a")) & (F.least("x.n_a", "y.n_a") >= bound)
    common = F.col("x.n_b") - F.col("x.lost") - F.col("y.lost") + F.size(F.array_intersect("x.diff", "y.diff"))
    varied = x.join(y, (F.col("x.b") == F.col("y.b")) & apart & (common >= bound)).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))
    # 3: members of a bucket of which one is far from the centre: those whose distances to it differ no more than theirs may
    place = bucket.join(star.select(F.col("a").alias("rep"), F.col("b").alias("c"), "jaccard"), ["rep", "c"], "left").join(root, bucket.rep == root.id, "left")
    place = place.select("j", "h", "rep", "n", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), F.coalesce("root", "rep").alias("root"))
    split = place.groupBy("j", "h").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("jaccard").alias("least")).where((F.col("r1") != F.col("r2")) & (F.col("least") < NEAR)).select("j", "h")
    place = written(place.join(split, ["j", "h"]), "far")
    x, y = place.alias("x"), place.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.rep") > F.col("y.rep")) & (F.col("x.n") >= least * F.col("y.n")) & (F.col("y.n") >= least * F.col("x.n"))
    apart = apart & (F.abs(F.col("x.jaccard") - F.col("y.jaccard")) <= 1 - least + 1e-9) & (F.least("x.jaccard", "y.jaccard") < NEAR)
    far = x.join(y, (F.col("x.j") == F.col("y.j")) & (F.col("x.h") == F.col("y.h")) & apart).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    more = written(compare(written(varied.union(far).distinct(), "apart"), documents, k, least).where("linked").select("a", "b"), "links", BATCH)
    if not more.isEmpty():
        root = written(components(links.union(more)), "roots")
    member = known.select("doc_id", "d1", "d2").join(exact.select("d1", "d2", "rep"), ["d1", "d2"])
    out = member.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    out = out.union(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))
    return out.withColumn("is_representative", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(documents: DataFrame, k: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """documents with one row of each class: the smallest doc_id's; of rows that repeat it the one whose text sorts
    first. Rows without doc_id stay."""
    c = written(classes(documents, k, least), "classes")
    drop = c.where("not is_representative").select("doc_id").distinct()
    out = join_checked(documents, written(drop, "copies"), "doc_id", "left_anti", BROADCAST_IDS)
    again = c.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not again.isEmpty():
        repeated = out.join(again.select("doc_id"), "doc_id", "left_semi")
        one = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.struct(F.coalesce("text", F.lit("")), F.col("text").isNotNull())).alias("_row"))
        out = out.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(one.select("_row.*"))
    return out.select(*documents.columns)
