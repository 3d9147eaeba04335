"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good (1) or bad (0). A line's features are its own and its neighbours' measures; transitions join
adjacent lines. Training maximises the chains' log-likelihood on a bounded, documented sample of labelled
documents, whose lines take the document's label: labels of lines are not given, so transitions learn how seldom
quality changes within a document. A document's score is the mean of its lines' forward-backward
marginals, weighted by length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import BROADCAST_ROWS

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of doc_id; and lines of each,
#: at most: adjacent ones, from a place that the hash names. So training sees at most SAMPLE x LINES lines.
SAMPLE, LINES = 6000, 60
THRESHOLD = 0.3
FOLDS = 5

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_STOPS, _SYMBOLS, _HIGH = b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))
#: Measures of a line; with one neighbour to each side, and a constant.
MEASURES = 18
WIDTH = 3 * MEASURES + 1


def _count(b: bytes, drop: bytes) -> int:
    return len(b) - len(b.translate(None, drop))


def measures(line: str) -> list[float]:
    b = line.encode("utf-8", "surrogatepass")
    ws = line.split()
    n, k = max(1, len(b)), max(1, len(ws))
    upper, lower, digits, stops, symbols, high = (_count(b, x) for x in (_UPPER, _LOWER, _DIGIT, _STOPS, _SYMBOLS, _HIGH))
    kinds = len(set(ws)) / k
    same = sum(map(str.__eq__, ws, ws[1:])) / k
    odd = symbols / k
    return [
        1.0, min(1.0, len(b) / 200), np.log1p(len(b)) / 8, np.log1p(len(ws)) / 6, upper / max(1, upper + lower), digits / n, stops / n, symbols / n,
        min(odd, 3.0), min(1.0, 2 * odd), high / n, n / k / 10, kinds, max(0.0, 1 - kinds) ** 0.5, same, line.count("|") / k, line.count("!!") / k,
        float(line.rstrip()[-1:] in ".!?:"),
    ]


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x WIDTH features, line lengths, lines of each text). A null or empty text is one empty line."""
    rows, sizes, counts = [], [], []
    for t in texts:
        lines = (t or "").split("\n")
        counts.append(len(lines))
        sizes += [max(1, len(x)) for x in lines]
        rows += [measures(x) for x in lines]
    m = np.asarray(rows, dtype=np.float64).reshape(-1, MEASURES)
    counts = np.asarray(counts, dtype=np.int64)
    x = np.zeros((len(m), WIDTH))
    x[:, :MEASURES], x[:, -1] = m, 1.0
    x[1:, MEASURES : 2 * MEASURES], x[:-1, 2 * MEASURES : 3 * MEASURES] = m[:-1], m[1:]
    ends = np.cumsum(counts)
    x[ends - counts, MEASURES : 2 * MEASURES] = 0.0  # nothing before a first line or after a last
    x[ends - 1, 2 * MEASURES : 3 * MEASURES] = 0.0
    return x, np.asarray(sizes, dtype=np.float64), counts


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def forward_backward(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray):
    """Marginals (lines x 2), pair marginals' sum (2 x 2) and log partition of each chain. All chains step together."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) if len(sizes) else 0)]
    alpha, beta = unary.copy(), np.zeros_like(unary)
    for t in range(1, len(alive)):
        i = starts[: alive[t]] + t
        alpha[i] += _lse(alpha[i - 1][:, :, None] + trans[None], 1)
    for t in range(len(alive) - 1, 0, -1):
        i = starts[: alive[t]] + t
        beta[i - 1] = _lse(trans[None] + (unary[i] + beta[i])[:, None, :], 2)
    log_z = _lse(alpha[starts + sizes - 1], 1)
    of_line = np.empty(len(unary))
    rank = np.repeat(np.arange(len(counts)), counts)
    z = np.empty(len(counts))
    z[order] = log_z
    of_line = z[rank]
    marginal = np.exp(alpha + beta - of_line[:, None])
    inner = np.ones(len(unary), dtype=bool)
    inner[np.cumsum(counts) - counts] = False
    i = np.flatnonzero(inner)
    pair = np.exp(alpha[i - 1][:, :, None] + trans[None] + (unary[i] + beta[i])[:, None, :] - of_line[i][:, None, None]).sum(axis=0) if len(i) else np.zeros((2, 2))
    return marginal, pair, z


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 500, rate: float = 0.1, decay: float = 2e-5) -> dict:
    """Weights of the chain, by Adam on the penalised log-likelihood for each line. Without both labels: all good."""
    w, trans = np.zeros((x.shape[1] if len(x) else WIDTH, 2)), np.zeros((2, 2))
    if len(set(labels.tolist())) < 2:
        w[-1, 1] = 5.0 if not len(labels) or labels[0] == 1 else -5.0
        return {"w": w, "trans": trans}
    y = np.repeat(labels, counts).astype(int)
    target = np.eye(2)[y]
    held = np.zeros((2, 2))
    for label in (0, 1):
        held[label, label] = (counts[labels == label] - 1).sum()
    m, v = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        marginal, pair, _ = forward_backward(x @ w, trans, counts)
        grads = [x.T @ (marginal - target) / len(x) + decay * w, (pair - held) / len(x) + decay * trans]
        for k, (p, g) in enumerate(zip((w, trans), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"w": w, "trans": trans}


def scores(texts: list[str | None], model: dict) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x, sizes, counts = line_features(texts)
    good = forward_backward(x @ model["w"], model["trans"], counts)[0][:, 1]
    first = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(good * sizes, first) / np.add.reduceat(sizes, first), 0.0, 1.0)


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> dict:
    """A model from at most `sample` labelled documents whose fold is not 0, and `lines` lines of each.

    Null labels are passed over. Labels that repeat a doc_id count once, as the worse one; so do documents that repeat
    one, as the text that sorts first.
    """
    assert sample <= BROADCAST_ROWS
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("_quality"))
    marked = marked.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(sample)

    def gather(batches):
        for b in batches:
            for doc, text, q in zip(*(b.column(i).to_pylist() for i in range(3))):
                x, _, _ = line_features([text])
                over = len(x) - lines
                begin = zlib.crc32(str(doc).encode()) % (over + 1) if over > 0 else 0
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([x[begin : begin + lines].astype("<f4").tobytes()], pa.binary())], names=["quality", "x"])

    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_quality").alias("_quality"))
    rows = own.mapInArrow(gather, "quality int, x binary").collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)  # whatever order the tasks end in
    xs = [np.frombuffer(r[1], dtype="<f4").reshape(-1, WIDTH) for r in rows]
    return fit(np.concatenate(xs).astype(np.float64) if xs else np.zeros((0, WIDTH)), np.asarray([len(x) for x in xs], dtype=np.int64), np.asarray([r[0] for r in rows]))


def score(documents: DataFrame, model: dict, keep=("doc_id",)) -> DataFrame:
    """keep columns and score (0 to 1) of every row; null text scores as empty text, repeated rows alike."""
    from pyspark.sql import types as T

    df = documents.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out, at, size = [], 0, 0
            for i in range(b.num_rows + 1):  # a few MB of text at a time
                if i == b.num_rows or size > 2 << 20:
                    out.append(scores(texts.slice(at, i - at).to_pylist(), model))
                    at, size = i, 0
                if i < b.num_rows:
                    size += len(texts[i].as_py() or "")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out), pa.float64())], names=[*b.schema.names[:-1], "score"])

    return df.mapInArrow(run, schema)


def rated(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    s = score(documents, train(documents, labels))
    return s.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
