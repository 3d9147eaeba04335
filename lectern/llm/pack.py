"""Packing: a non-negative least squares plan over shallow length combinations.

Documents become token ids, cut into pieces of at most `window` tokens. Full pieces are sequences of their own.
For the shorter ones, all pairs and triples of lengths that fill the window exactly are enumerated, and
coordinate descent solves the repeat counts x >= 0 that minimise ||Ax - histogram||. The counts are rounded down
and dealt out; the residual pieces are packed greedily end to end, cut where a sequence is full. Every piece gets
its place in closed form from its rank among pieces of its length, so no task sees more than its own pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lectern.llm.common import written

WINDOW = 1024
SWEEPS = 12
#: Pieces of one length and bucket are ranked in one task: about this many rows.
BUCKET_ROWS = 20_000
#: Where byte-level pre-tokenizers split (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_tokenizers: dict = {}


class Encoder:
    """Ids of a tokenizers file.

    A byte-level BPE whose token ids are its ranks is run by a faster library on the same vocabulary; the merges
    are checked for that when the file is read. Texts that hold an added token's string, and files of another
    kind, go to the file's own library.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_file(path), json.load(open(path, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.added, self.fast = tuple(t["content"] for t in spec.get("added_tokens", [])), None
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            self.fast = self._ranked(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])

    def _ranked(self, vocab: dict, merges: list):
        import tiktoken

        # the printable stand-in of each byte: itself where printable, else the next from U+0100 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        added = set(self.added)
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False)


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def tokenize(documents: DataFrame, path: str, end: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, doc_tokens, start, length, ids, ids_crc32, row): each document's ids, then `end`, cut every
    `window` ids. ids is little-endian unsigned 32-bit; row numbers the pieces, without order. Null text counts as
    empty: one piece, the end id alone.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, row = encoder(path), TaskContext.get().partitionId() << 36
        for b in batches:
            out = [[] for _ in range(7)]
            size = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for s in range(0, len(ids), window):
                    raw = ids[s : s + window].tobytes()
                    for c, v in zip(out, (doc, len(ids), s, len(raw) // 4, raw, zlib.crc32(raw), row)):
                        c.append(v)
                    row += 1
                    size += len(raw)
                if size > 4 << 20:
                    yield _pieces(out)
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield _pieces(out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids binary, ids_crc32 long, row long")


def _pieces(out):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["doc_id", "doc_tokens", "start", "length", "ids", "ids_crc32", "row"])


def combinations(lengths: list[int], window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window exactly, of those that occur; pairs come first."""
    have = np.zeros(window + 1, dtype=bool)
    have[[x for x in lengths if 0 < x < window]] = True
    one = np.flatnonzero(have)
    pairs = [(a, window - a, 0) for a in one if a <= window - a and have[window - a]]
    out = [np.asarray(pairs, dtype=np.int64).reshape(-1, 3)]
    for a in one[one <= window // 3]:
        b = one[(one >= a) & (one <= (window - a) // 2)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1).reshape(-1, 3))
    return np.concatenate(out)


def solve(histogram: dict[int, int], window: int = WINDOW, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts: non-negative least squares by coordinate descent, rounded down, then
    raised one by one as long as pieces of all lengths remain, largest lost fraction first.
    """
    combos = combinations(list(histogram), window)
    rest = [0.0] * (window + 1)
    for n, k in histogram.items():
        if n < window:
            rest[n] = float(k)
    cols = [tuple(int(v) for v in c if v) for c in combos]
    weight = [float(sum(c.count(v) ** 2 for v in set(c))) for c in cols]
    x = [0.0] * len(cols)
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(cols):
            step = sum([rest[v] for v in c]) / weight[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                moved += abs(step)
                for v in c:
                    rest[v] -= step
        if moved <= 1e-3 * max(1, sum(histogram.values())):
            break
    left = {n: k for n, k in histogram.items() if n < window}
    counts = np.floor(np.asarray(x) + 1e-9).astype(np.int64)
    order = np.argsort(-(np.asarray(x) - counts), kind="stable")
    for j in range(len(cols)):  # least squares can ask for more than there is
        most = min((left[v] // cols[j].count(v) for v in cols[j]), default=0)
        counts[j] = min(counts[j], most)
        for v in cols[j]:
            left[v] -= int(counts[j])
    for j in order:
        most = min(left[v] // cols[j].count(v) for v in cols[j])
        extra = min(most, 1)
        counts[j] += extra
        for v in cols[j]:
            left[v] -= extra
    for j in order:  # what is still whole
        most = min(left[v] // cols[j].count(v) for v in cols[j])
        counts[j] += most
        for v in cols[j]:
            left[v] -= most
    used = counts > 0
    return combos[used], counts[used]


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Slots (length, first, last, sequence, offset, stream) over the ranks of each length.

    Ranks first..last-1 of a length go to sequences sequence, sequence+1, ... at the offset; where offset is -1 they
    stand end to end in the residual stream, from token `stream` on, whose sequences begin at `sequence`.
    """
    combos, counts = solve(histogram, window)
    slots, taken, seq = [], dict.fromkeys(histogram, 0), 0
    if full := histogram.get(window):
        slots.append((window, 0, full, 0, 0, 0))
        seq, taken[window] = full, full
    for c, k in zip(combos.tolist(), counts.tolist()):
        at = 0
        for n in (v for v in sorted(c, reverse=True) if v):
            slots.append((n, taken[n], taken[n] + k, seq, at, 0))
            taken[n] += k
            at += n
        seq += k
    token = 0
    for n in sorted(histogram, reverse=True):
        if (k := histogram[n] - taken[n]) > 0:
            slots.append((n, taken[n], histogram[n], seq, -1, token))
            token += n * k
    return slots


def pack(documents: DataFrame, path: str, window: int = WINDOW, end: int = 0) -> DataFrame:
    """Pieces with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token lies in exactly one piece; a sequence's offsets run gapless from 0, and only the last sequence
    can be short. Null and empty texts are one piece of one token; repeated rows are packed each for itself; an
    empty table gives none. Extra columns are ignored.
    """
    pieces = written(tokenize(documents, path, end, window), "pieces")
    total = pieces.count()
    buckets = max(1, total // BUCKET_ROWS)
    # a rank needs its length's pieces in one order: buckets, each small, whose starts are sums of counts. The row's own
    # number deals them out, so null or repeated ids don't share a bucket, and breaks ties, so a rank is always the same
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    counts = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `window` rows
    slots = plan(histogram, window)
    first = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(first, F.lit(0)).alias("base"), F.lit(True).alias("is_base"))
    spark = documents.sparkSession
    slots = spark.createDataFrame(slots or [(0, 0, 0, 0, 0, 0)], "slot_length long, first long, last long, sequence long, at long, stream long")

    # ids travel only where a cut may need them; the base of a (length, bucket) goes first in its group
    narrow = pieces.select("length", "bucket", "doc_id", "start", "row", "doc_tokens", "ids_crc32", F.when(F.col("length") < window, F.col("ids")).alias("ids"))
    narrow = narrow.join(counts.select("length", "bucket", "base"), ["length", "bucket"])
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = narrow.withColumn("rank", F.col("base") + rank)
    # slots of one length: at most one a combination that holds it, so window squared / 4 rows at most
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    whole = placed.where("at >= 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + k).alias("sequence_id"), F.col("at").alias("offset"))
    token = F.col("stream") + k * F.col("length")
    loose = placed.where("at < 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", token.alias("token"), "ids")
    over = F.greatest(F.lit(0), F.pmod(F.col("token"), F.lit(window)) + F.col("length") - window)
    loose = loose.withColumn("over", over)
    bit = lambda off, n: F.struct(off.alias("off"), n.alias("n"))
    cut = loose.withColumn("part", F.explode(F.when(F.col("over") > 0, F.array(bit(F.lit(0).cast("long"), F.col("length") - F.col("over")), bit(F.col("length") - F.col("over"), F.col("over")))).otherwise(F.array(bit(F.lit(0).cast("long"), F.col("length"))))))
    part = F.substring(F.col("ids"), (F.col("part.off") * 4 + 1).cast("int"), (F.col("part.n") * 4).cast("int"))
    at = F.col("token") + F.col("part.off")
    cut = cut.select("doc_id", (F.col("start") + F.col("part.off")).alias("start"), F.col("part.n").alias("length"), F.when(F.col("over") > 0, F.crc32(part)).otherwise(F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens", (F.col("sequence") + F.floor(at / window)).alias("sequence_id"), F.pmod(at, F.lit(window)).alias("offset"))
    return whole.unionByName(cut)
