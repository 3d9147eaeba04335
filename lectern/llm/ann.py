"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt to shards. A shard's graph starts from random edges; for each vector a greedy beam search on the
graph so far proposes neighbours, and relaxed distance pruning keeps an edge only where no kept one is closer to
its end by the factor alpha. Every query is searched in every shard, as a stream of blocks; the best of all shards
are ranked by the exact measure in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lectern.llm.common import written

#: Vectors of a shard, about; degree, beam widths and pruning factor of its graph.
SHARD, DEGREE, BEAM, SEARCH_BEAM, ALPHA = 5000, 24, 48, 96, 1.2
BLOCK = 256


class Graph:
    """A directed graph over unit vectors (float32 rows)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> None:
        n = len(x)
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, 2 * degree), -1, dtype=np.int32)  # room for edges that come back
        self.used = np.zeros(n, dtype=np.int64)
        self.start = int(np.argmax(x @ x.mean(axis=0))) if n else 0
        if n <= 1:
            return
        few = min(degree // 2, n - 1)
        first = rng.integers(0, n - 1, (n, few))
        self.edges[:, :few] = first + (first >= np.arange(n)[:, None])
        self.used[:] = few
        order = rng.permutation(n)
        for at in range(0, n, BLOCK):
            self._insert(order[at : at + BLOCK])

    def _insert(self, ids: np.ndarray) -> None:
        found, _ = self.search(self.x[ids], self.beam)
        self._prune(ids, np.concatenate([found, self.edges[ids]], axis=1))
        to, back = [], []
        for p in ids.tolist():
            e = self.edges[p, : self.used[p]]
            to.append(e)
            back.append(np.full(len(e), p, dtype=np.int32))
        to, back = np.concatenate(to), np.concatenate(back)
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        cut = np.flatnonzero(np.diff(to)) + 1
        full, offered = [], []
        for q, ps in zip(to[np.concatenate([[0], cut])].tolist() if len(to) else [], np.split(back, cut)):
            have = self.edges[q, : self.used[q]]
            ps = ps[~np.isin(ps, have)]
            if self.used[q] + len(ps) <= self.edges.shape[1]:
                self.edges[q, self.used[q] : self.used[q] + len(ps)] = ps
                self.used[q] += len(ps)
            else:
                full.append(q)
                offered.append(np.concatenate([have, ps]))
        if full:
            width = max(map(len, offered))
            table = np.full((len(full), width), -1, dtype=np.int32)
            for i, o in enumerate(offered):
                table[i, : len(o)] = o
            for at in range(0, len(full), BLOCK):
                self._prune(np.asarray(full[at : at + BLOCK]), table[at : at + BLOCK])

    def _prune(self, ids: np.ndarray, offered: np.ndarray) -> None:
        """Out-edges of ids from those offered (-1: none): nearest first, without what a kept one covers."""
        offered = np.sort(offered, axis=1)
        bad = (offered < 0) | (offered == ids[:, None])
        bad[:, 1:] |= offered[:, 1:] == offered[:, :-1]
        v = self.x[np.maximum(offered, 0)]
        far = np.where(bad, np.inf, 2 - 2 * np.einsum("bcd,bd->bc", v, self.x[ids]))
        alive = far.copy()
        rows, a2 = np.arange(len(ids)), self.alpha**2
        kept = np.full((len(ids), self.degree), -1, dtype=np.int32)
        count = np.zeros(len(ids), dtype=np.int64)
        for _ in range(self.degree):
            i = alive.argmin(axis=1)
            ok = np.isfinite(alive[rows, i])
            if not ok.any():
                break
            kept[rows[ok], count[ok]] = offered[rows[ok], i[ok]]
            count[ok] += 1
            between = 2 - 2 * np.einsum("bcd,bd->bc", v, v[rows, i])
            alive[(a2 * between <= far) & ok[:, None]] = np.inf
            alive[rows, i] = np.inf
        self.edges[ids] = -1
        self.edges[ids, : self.degree] = kept
        self.used[ids] = count

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam nearest found for each row of q, nearest first; -1 where there are fewer."""
        n, rows = len(self.x), np.arange(len(q))[:, None]
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        near = np.full((len(q), beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(q), beam), dtype=bool)
        seen = np.zeros((len(q), n + 1), dtype=bool)
        seen[:, n] = True  # where no edge goes
        ids[:, 0], near[:, 0], open_[:, 0] = self.start, q @ self.x[self.start], True
        seen[:, self.start] = True
        while open_.any():
            best = np.argsort(~open_, axis=1, kind="stable")[:, :width]  # beams are kept nearest first
            go = open_[rows, best]
            open_[rows, best] = False
            step = np.where(go[:, :, None], self.edges[np.maximum(ids[rows, best], 0)], -1).reshape(len(q), -1)
            step = np.sort(np.where(step < 0, n, step), axis=1)
            new = ~seen[rows, step]
            new[:, 1:] &= step[:, 1:] != step[:, :-1]
            seen[rows, step] = True
            most = int(new.sum(axis=1).max()) if len(q) else 0
            if not most:
                continue
            pick = np.argsort(~new, axis=1, kind="stable")[:, :most]
            step, new = step[rows, pick], new[rows, pick]
            cos = np.where(new, np.einsum("qcd,qd->qc", self.x[np.minimum(step, n - 1)], q), -np.inf)
            ids, near, open_ = np.concatenate([ids, step], axis=1), np.concatenate([near, cos], axis=1), np.concatenate([open_, new], axis=1)
            top = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            ids, near, open_ = ids[rows, top], near[rows, top], open_[rows, top]
            open_ &= np.isfinite(near)
        return np.where(np.isfinite(near), ids, -1), near


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    df = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Equal vectors are one node of a graph; of each the k + 1 smallest vec_ids are kept, more than which no query
    can return. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
    null vec_id; rows that repeat a vec_id count once. Vectors meet only those of their own length.
    """
    live = usable(embeddings)
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    nodes = live.dropDuplicates(["v", "vec_id"]).withColumn("r", rank).where(F.col("r") <= k + 1)
    nodes = written(nodes.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    dims = written(nodes.groupBy(F.size("v").alias("dim")).agg(F.max(F.lit(1)).alias("one"), F.ceil(F.count("*") / shard).cast("int").alias("shards")), "dims")
    total = dims.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    placed = nodes.join(F.broadcast(dims), F.size("v") == F.col("dim")) if dims.limit(1001).count() <= 1000 else nodes.join(dims, F.size("v") == F.col("dim"))
    vectors = placed.select("dim", F.pmod(F.xxhash64("ids"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), "ids", "v")
    asked = live.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).join(dims, F.size("v") == F.col("dim"))
    queries = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), F.lit(None).cast("array<long>").alias("ids"), "v")
    stream = vectors.unionByName(queries).repartition(max(1, int(total)), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    out = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(batches):
        key, graph, raw, ids, pending = None, None, None, [], []
        for b in batches:
            head = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)], axis=1)
            cut = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(head)]):
                part = b.slice(a, z - a)
                dim, number, kind = head[a].tolist()
                if (dim, number) != key:
                    key, graph, ids, pending = (dim, number), None, [], []
                v = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if kind == 0:
                    pending.append(v.copy())
                    ids += part.column(4).to_pylist()
                    continue
                if graph is None:
                    if not pending:
                        continue
                    raw = np.concatenate(pending)
                    big = np.abs(raw).max(axis=1, keepdims=True)  # so that no square overflows
                    unit = raw / big
                    graph = Graph((unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).astype(np.float32))
                for s in range(0, len(v), BLOCK):
                    q = v[s : s + BLOCK]
                    u = q / np.abs(q).max(axis=1, keepdims=True)
                    found, _ = graph.search((u / np.sqrt((u * u).sum(axis=1, keepdims=True))).astype(np.float32), min(beam, max(8, len(raw))))
                    found = found[:, : 4 * k]
                    exact = np.where(found >= 0, cosine(raw[np.maximum(found, 0)], q[:, None, :]), -np.inf)
                    top = np.argsort(-exact, axis=1, kind="stable")[:, : k + 3]
                    rows = [(qi, ids[found[i, j]], float(exact[i, j])) for i, qi in enumerate(part.column(3).slice(s, BLOCK).to_pylist()) for j in top[i].tolist() if found[i, j] >= 0]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    found = stream.mapInArrow(run, "query_id long, ids array<long>, score double").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
