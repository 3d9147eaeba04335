"""Repeated byte windows by a depth-limited radix sort of suffixes.

Every window of `depth` bytes is dealt out by its anchor: the smallest hash of its 16-byte pieces, a function of
the window alone, so equal windows meet. Anchors that occur only once in the corpus are dropped first, as no
window around them repeats. In each bucket the windows left are suffixes in an array that most-significant-digit
passes of eight bytes order only as deep as `depth`; a pass drops what is alone in its group. After the last pass
the groups are exactly the repeated windows, and the smallest doc_id of each decides.

Documents are worked on in chunks (of one input task). A chunk sends each distinct context once, with its smallest
doc_id, so a passage that a third of the corpus holds is as many rows as there are chunks. An anchor of many
occurrences, whose contexts can all differ, is split by a further digit: its windows are dealt out by their second
smallest hash as well, so no task gets all that surrounds a common phrase. Texts are never shuffled: they are written once,
bucketed by chunk, and what comes back is sent to the chunk.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm import textvec
from lectern.llm.common import scratch_path, written

DEPTH, PIECE = 50, 16
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 6 << 20
#: Occurrences of an anchor beyond which its windows are dealt out by a second one, too. A task that sorts so many
#: contexts holds some 40 MB of places.
HOT = 20_000
#: Files that the texts are written to at most (several chunks share one), and input bytes of a chunk, about.
MOST_FILES, CHUNK_BYTES = 50_000, 32 << 20
BLOCK = 1 << 20
_U = np.uint64
_VALUES = textvec.mix(np.arange(1, 257, dtype=_U))
_TOP = np.iinfo(np.int64).max
_HASH = _U((1 << 48) - 1)


def anchors(texts: list[bytes], depth: int = DEPTH):
    """Runs of windows with one anchor, of adjoined texts: (text index, first and last start, anchor place, hash).

    Places count from the text's start. All windows of `depth` bytes inside a text are in exactly one run.
    """
    piece = min(PIECE, depth)
    sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < depth:
        return none, none, none, none, none.astype(_U)
    pw, inv = textvec.powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_VALUES[buf] * pw[: len(buf)], out=total[1:])
    h = textvec.mix((total[piece:] - total[:-piece]) * inv[: len(buf) - piece + 1])
    key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)  # the leftmost of equal ones
    span, m = 1, key
    width = depth - piece + 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    starts = np.arange(len(buf) - depth + 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(starts)]
    ok = starts + depth <= ends[owner]
    starts, owner = starts[ok], owner[ok]
    if not len(starts):
        return none, none, none, none, none.astype(_U)
    place = (m[: len(ok)][ok] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    begin = (ends - sizes)[owner[first]]
    return owner[first], starts[first] - begin, starts[last] - begin, place[first] - begin, h[place[first]] & _HASH


def _groups(ids: list, texts: list, skip: set):
    """(positions, texts) of documents that take part, about BLOCK bytes at a time."""
    out, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < DEPTH or i in skip:
            continue
        if out and size + len(t) > BLOCK:
            yield out, [texts[j] for j in out]
            out, size = [], 0
        out.append(i)
        size += len(t)
    if out:
        yield out, [texts[j] for j in out]


def _chunk(left: pa.Table):
    """Ids and texts of a chunk in a fixed order, whatever order the rows came in."""
    ids = [_TOP if i is None else i for i in left.column("doc_id").to_pylist()]
    texts = left.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(_U)


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, positions) for hashes, in ascending bucket."""
    b = (textvec.mix(h) % _U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    return [(int(b[p[0]]), p) for p in np.split(order, cut) if len(p)]


def _right(right: pa.Table):
    """From a chunk's messages: shared hashes, those of them that are hot, and what came back by bucket."""
    shared, hot, back = [], [], {}
    for kind, bucket, blob in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "blob"))):
        if kind == "shared":
            shared.append(_unpack48(blob))
        elif kind == "hot":
            hot.append(_unpack48(blob))
        elif kind == "back":
            back[bucket] = blob
    joined = lambda x: np.sort(np.concatenate(x)) if x else np.zeros(0, dtype=_U)
    return joined(shared), set(joined(hot).tolist()), back


def _parted(body: bytes, first: int, depth: int) -> list[tuple[int, int, int]]:
    """(first start, last start, second anchor) of runs of a context's windows: the second is the smallest piece hash
    of a window but the first anchor's, so it, too, is a function of the window alone."""
    piece = min(PIECE, depth)
    buf = np.frombuffer(body, dtype=np.uint8)
    pw, inv = textvec.powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_VALUES[buf] * pw[: len(buf)], out=total[1:])
    h = textvec.mix((total[piece:] - total[:-piece]) * inv[: len(buf) - piece + 1]) & _HASH
    h[h == _U(first)] = _HASH  # none is larger
    second = np.lib.stride_tricks.sliding_window_view(h, depth - piece + 1).min(axis=1)
    cut = [0, *(np.flatnonzero(second[1:] != second[:-1]) + 1).tolist(), len(second)]
    return [(i, j - 1, int(second[i])) for i, j in zip(cut, cut[1:])]


def _contexts(ids, texts, skip, shared, hot, depth: int, buckets: int):
    """Distinct contexts around shared anchors, by bucket, and each run's place there.

    Returns {bucket: list of (context, anchor offset, smallest id)} and [(document, first start, bucket, index)]. A
    run around a hot anchor is parted by a second one, in buckets that both name.
    """
    table, known, runs = {}, {}, []

    def add(key, b, doc, start):
        rows = table.setdefault(b, [])
        i = known.get(key)
        if i is None:
            i = known[key] = len(rows)
            rows.append((*key, ids[doc]))
        runs.append((doc, start, b, i))

    for where, block in _groups(ids, texts, skip):
        doc, s0, s1, place, h = anchors(block, depth)
        at = np.searchsorted(shared, h)
        hit = np.zeros(len(h), dtype=bool) if not len(shared) else shared[np.minimum(at, len(shared) - 1)] == h
        bucket = (textvec.mix(h[hit]) % _U(buckets)).astype(np.int64).tolist()
        for d, a, z, p, b, x in zip(doc[hit].tolist(), s0[hit].tolist(), s1[hit].tolist(), place[hit].tolist(), bucket, h[hit].tolist()):
            if x in hot:
                body = block[d][a : z + depth]
                for i, j, second in _parted(body, x, depth):
                    add((body[i : j + depth], -1), int(textvec.mix(np.asarray([x ^ ((second << 16) & 0xFFFFFFFFFFFFFFFF)], dtype=_U))[0] % _U(buckets)), where[d], a + i)
            else:
                add((block[d][a : z + depth], p - a), b, where[d], a)
    return table, runs


def radix_repeats(buf: np.ndarray, starts: np.ndarray, owner: np.ndarray, depth: int = DEPTH):
    """(positions in starts, smallest owner) of all windows that occur more than once.

    Most-significant-digit passes over eight bytes at a time; the last digit is what is left of depth.
    """
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).astype(_U)
    digits = np.zeros(len(buf), dtype=_U)
    for k in range(8):
        digits |= padded[k : k + len(buf)] << _U(56 - 8 * k)
    live, group = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for d in range(0, depth, 8):
        digit = digits[starts[live] + d]
        if depth - d < 8:
            digit = digit >> _U(64 - 8 * (depth - d))
        order = np.lexsort((digit, group)) if d else np.argsort(digit, kind="stable")
        live, group, digit = live[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(live) else np.zeros(0, dtype=bool)
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(live) else np.zeros(0, dtype=bool)
        live, group = live[many], number[many]
        if not len(live):
            break
    if not len(live):
        return live, owner[:0]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(owner[live], cut)
    return live, np.repeat(least, np.diff(np.append(cut, len(live))))


_MESSAGE = "chunk long, kind string, bucket long, doc long, blob binary"
_MESSAGES = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("doc", pa.int64()), ("blob", pa.binary())])


def _message(rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MESSAGES.types)], schema=_MESSAGES) if rows else _MESSAGES.empty_table()


def repeats(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left) for every row.

    A byte goes if a window of `depth` bytes that covers it also starts in a document with a smaller doc_id. Null
    texts are empty; rows that share a doc_id don't remove each other; a null doc_id counts as larger than all.
    Extra columns are ignored. The smallest task is a chunk: the documents of one input task.
    """
    assert depth == DEPTH, "contexts are laid out for the depth that the module states"
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    # large input tasks are several chunks, so that a Python worker never holds more than about CHUNK_BYTES of input
    pieces = max(1, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) // CHUNK_BYTES)
    chunk = F.spark_partition_id().cast("long") * pieces + F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces))
    base = base.withColumn("chunk", chunk).withColumn("digest", F.sha2("text", 256)).withColumn("n", F.octet_length("text").cast("long"))
    name, parts = f"lectern_chunks_{uuid.uuid4().hex}", min(MOST_FILES, max(1, base.rdd.getNumPartitions() * pieces))
    base.write.option("path", scratch_path(spark, "chunks")).option("compression", "zstd").bucketBy(parts, "chunk").saveAsTable(name)
    table = spark.table(name)
    texts = table.select("chunk", "doc_id", "text").groupBy("chunk")
    total = table.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, int(total // BUCKET_BYTES))

    # exact copies: only the smallest doc_id takes part
    rank = F.coalesce("doc_id", F.lit(_TOP))
    first = table.where(F.col("n") >= depth).groupBy("digest").agg(F.min(rank).alias("least"), F.max(rank).alias("most")).where("least < most").select("digest", "least")
    copies = table.where(F.col("n") >= depth).select("chunk", rank.alias("doc"), "digest").join(first, "digest").where("doc > least")
    copies = written(copies.select("chunk", F.lit("copy").alias("kind"), F.lit(0).cast("long").alias("bucket"), "doc", F.unhex("digest").alias("blob")), "copies")

    def skipped(ids, texts, right):
        """Positions of copies: by doc_id, and by digest where rows share a doc_id."""
        marks = {(d, b) for k, d, b in zip(right.column("kind").to_pylist(), right.column("doc").to_pylist(), right.column("blob").to_pylist()) if k == "copy"}
        docs = {d for d, _ in marks}
        return {i for i, (d, t) in enumerate(zip(ids, texts)) if d in docs and (d, hashlib.sha256(t).digest()) in marks}

    def hashes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _message([])
        ids, bodies = _chunk(left)
        skip = skipped(ids, bodies, right)
        seen, owners = [], []
        for where, block in _groups(ids, bodies, skip):
            doc, _, _, _, h = anchors(block)
            seen.append(h)
            owners.append(np.asarray(where, dtype=np.int64)[doc])
        if not seen:
            return _message([])
        h, o = np.concatenate(seen), np.concatenate(owners)
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(head, len(h)))
        several = o[head] != o[np.append(head[1:], len(o)) - 1]  # documents here share it
        once, chunk, out = h[head], left.column("chunk")[0].as_py(), []
        for b, p in _by_bucket(once, buckets):
            out.append((chunk, "hash", b, 0, _pack48(once[p])))
            if len(p := p[several[p] | (count[p] > 1)]):  # beside their hashes: how often, and whether in several documents
                out.append((chunk, "more", b, len(p), _pack48(once[p]) + count[p].astype("<u4").tobytes() + several[p].astype("u1").tobytes()))
        return _message(out)

    def meet(rows: pa.Table) -> pa.Table:
        found, hashes_, counts, docs = [], [], [], []
        for chunk, kind, n, blob in zip(*(rows.column(c).to_pylist() for c in ("chunk", "kind", "doc", "blob"))):
            own = _unpack48(blob[: 6 * n] if kind == "more" else blob)
            hashes_.append(own)
            if kind == "more":
                counts.append(np.frombuffer(blob, dtype="<u4", count=n, offset=6 * n).astype(np.int64) - 1)
                docs.append(np.frombuffer(blob, dtype="u1", count=n, offset=10 * n).astype(np.int64))
            else:
                found.append((chunk, own))
                counts.append(np.ones(len(own), dtype=np.int64))
                docs.append(np.ones(len(own), dtype=np.int64))
        value, at = np.unique(np.concatenate(hashes_), return_inverse=True)
        times, holders = np.bincount(at, np.concatenate(counts)), np.bincount(at, np.concatenate(docs))
        shared, hot = value[holders > 1], value[(holders > 1) & (times > HOT)]
        out = []
        for chunk, own in found:
            if len(own := own[np.isin(own, shared)]):
                out.append((chunk, "shared", 0, 0, _pack48(own)))
            if len(own := own[np.isin(own, hot)]):
                out.append((chunk, "hot", 0, 0, _pack48(own)))
        return _message(out)

    sent = texts.cogroup(copies.groupBy("chunk")).applyInArrow(hashes, _MESSAGE)
    shared = written(sent.groupBy("bucket").applyInArrow(meet, _MESSAGE), "shared")
    told = shared.unionByName(copies)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _message([])
        ids, bodies = _chunk(left)
        hits, hot, _ = _right(right)
        table, _ = _contexts(ids, bodies, skipped(ids, bodies, right), hits, hot, depth, buckets)
        chunk, out = left.column("chunk")[0].as_py(), []
        for b, rows in table.items():
            size = np.asarray([len(r[0]) for r in rows], dtype="<u1")
            owner = np.asarray([r[2] for r in rows], dtype="<i8")
            out.append((chunk, "context", b, len(rows), size.tobytes() + owner.tobytes() + b"".join([r[0] for r in rows])))
        return _message(out)

    def sort(rows: pa.Table) -> pa.Table:
        size, owner, body, chunk, index = [], [], [], [], []
        for c, n, blob in zip(rows.column("chunk").to_pylist(), rows.column("doc").to_pylist(), rows.column("blob").to_pylist()):
            size.append(np.frombuffer(blob, dtype="<u1", count=n).astype(np.int64))
            owner.append(np.frombuffer(blob, dtype="<i8", count=n, offset=n))
            body.append(np.frombuffer(blob, dtype=np.uint8, offset=9 * n))
            chunk.append(np.full(n, c))
            index.append(np.arange(n))
        size, owner, buf, chunk, index = (np.concatenate(x) for x in (size, owner, body, chunk, index))
        windows = size - depth + 1
        of = np.repeat(np.arange(len(size)), windows)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        least = owner[of].copy()
        live, smallest = radix_repeats(buf, (np.cumsum(size) - size)[of] + inside, owner[of], depth)
        least[live] = smallest
        # runs of windows of one context with one answer, of contexts that have a smaller doc_id somewhere
        told = np.zeros(len(size), dtype=bool)
        told[of[least < owner[of]]] = True
        keep = told[of]
        of, least = of[keep], least[keep]
        if not len(of):
            return _message([])
        head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])]))
        count = np.diff(np.append(head, len(of)))
        of, least = of[head], least[head]
        out, bucket = [], rows.column("bucket")[0].as_py()
        for c in np.unique(chunk[of]).tolist():
            mine = chunk[of] == c
            out.append((c, "back", bucket, int(mine.sum()), index[of[mine]].astype("<u4").tobytes() + count[mine].astype("<u1").tobytes() + least[mine].astype("<i8").tobytes()))
        return _message(out)

    back = written(texts.cogroup(told.groupBy("chunk")).applyInArrow(contexts, _MESSAGE).groupBy("bucket").applyInArrow(sort, _MESSAGE), "smaller")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _kept([])
        ids, bodies = _chunk(left)
        skip = skipped(ids, bodies, right)
        hits, hot, came = _right(right)
        rows, runs = _contexts(ids, bodies, skip, hits, hot, depth, buckets)
        answers = {}
        for b, blob in came.items():
            n = len(blob) // 13
            index = np.frombuffer(blob, dtype="<u4", count=n).tolist()
            count = np.frombuffer(blob, dtype="<u1", count=n, offset=4 * n).tolist()
            least = np.frombuffer(blob, dtype="<i8", count=n, offset=5 * n).tolist()
            for i, c, v in zip(index, count, least):
                answers.setdefault((b, i), []).append((c, v))
        cover: dict[int, list] = {}
        for doc, start, b, i in runs:
            parts = answers.get((b, i))
            if parts is None:
                context, _, own = rows[b][i]
                parts = ((len(context) - depth + 1, own),)
            for c, v in parts:
                if v < ids[doc]:
                    cover.setdefault(doc, []).append((start, start + c - 1 + depth))
                start += c
        out = []
        for i, (d, t) in enumerate(zip(ids, bodies)):
            spans = [(0, len(t))] if i in skip else _merged(cover.get(i, []))
            pieces, at = [], 0
            for a, z in spans:
                pieces.append(t[at:a])
                at = z
            kept = b"".join([*pieces, t[at:]])
            out.append((None if d == _TOP else d, len(t), len(t) - len(kept), len(spans), kept))
        return _kept(out)

    result = texts.cogroup(told.unionByName(back).groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    # the plan holds the files; the catalogue needn't keep their name
    spark.sql(f"DROP TABLE {name}")
    return result


def _merged(spans: list) -> list:
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _kept(rows: list) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


def repeat_digests(documents: DataFrame) -> DataFrame:
    r = repeats(documents)
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
