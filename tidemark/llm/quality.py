"""Quality classifier over random-indexing word vectors (operator 4).

Every word has a sparse random index vector, fixed by its hash bucket. A pass
over the training sample adds to each word's context vector the index vectors of
the words near it in the same text. A document is the mean of its words' context vectors beside
the mean of their index vectors; a two-layer network in numpy turns that into a
log-odds, and a temperature fitted on rows kept out of the training makes it a
calibrated probability. Besides words, a text has marks for words in capitals
and for a word that repeats the one before.

The training sample is bounded: ``SAMPLE_ROWS`` labelled rows, those whose ids
hash lowest; word vectors, network and temperature are fitted on it. They have a
size fixed by parameters and are broadcast. Scoring reads every whole text.

Defined results: a null text is the empty text, whose vector is zero, and is
scored as such; texts of any length are pooled whole; a row without a label or
with a null ``doc_id`` teaches nothing, and one with a null id is never held out;
rows that repeat a ``doc_id`` all teach with its label and are scored each for
itself; if a document has several labels the lowest counts; a probability of
exactly 0.5 predicts 1; ids that hash alike go by the smaller; with no labelled
rows, or labels of one kind only, all documents get that share of ones (1 without
any); an empty table gives no rows; other columns are ignored, or carried along
by ``score``, whatever their names. However rows are dealt to tasks, the fit and
the scores are the same.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import bounded_batches, crc_mod, fresh, stage, text_of, unstage

SAMPLE_ROWS = 6000
BUCKETS = 1 << 14
DIM = 64
NONZEROS = 4
NEAR = 2
HIDDEN = 32
SEED = 20240501
#: Words whose buckets a worker keeps, and tokens pooled at a time.
CACHE_WORDS = 200_000
POOLED = 1 << 14
SCORED = "doc_id long, held_out boolean, score double, predicted int"

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    """A text's part between white space -> the buckets of its tokens, two bytes each."""

    def __missing__(self, part: str) -> bytes:
        found = []
        for token in _TOKEN.findall(part):
            if len(token) > 1 and token.isupper():
                found.append(_bucket("<capitals>"))
            found.append(_bucket(token.lower()))
        out = np.array(found, "<u2").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(part) <= 64:
            self[part] = out
        return out


_PARTS = _Buckets()
_AGAIN = np.array([_bucket("<again>")], "<u2").tobytes()


def token_buckets(text: str) -> bytes:
    """Buckets of the tokens of a whole text, then one mark for each word that repeats the one before."""
    parts = text.split()
    again = sum(map(operator.eq, parts, parts[1:]))
    return b"".join(map(_PARTS.__getitem__, parts)) + _AGAIN * again


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector; one more, without any, stands for a gap."""
    rng = np.random.default_rng(SEED)
    place = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZEROS].astype(np.int64)
    sign = rng.choice([-1.0, 1.0], (BUCKETS, NONZEROS))
    return np.vstack((place, place[:1])), np.vstack((sign, 0 * sign[:1]))


@lru_cache(maxsize=1)
def index_matrix() -> np.ndarray:
    place, sign = index_vectors()
    out = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(out, place[:BUCKETS], sign[:BUCKETS].astype(np.float32), axis=1)
    return out


_GAP = np.full(NEAR, BUCKETS, np.int64)


def add_contexts(total: np.ndarray, texts: list[np.ndarray]) -> None:
    """Add to ``total`` (buckets and gap x dimensions, flat) the index vectors of each token's neighbours in its own text."""
    place, sign = index_vectors()
    tokens = np.concatenate([x for t in texts for x in (t.astype(np.int64), _GAP)]) if texts else _GAP
    for at in range(0, len(tokens), POOLED):
        for d in range(1, NEAR + 1):
            # each pair once: where its second token lies in this part
            right = tokens[max(at, d) : at + POOLED]
            left = tokens[max(at, d) - d : at + POOLED - d][: len(right)]
            for word, near in ((left, right), (right, left)):
                flat = word[:, None] * DIM + place[near]
                total += np.bincount(flat.ravel(), sign[near].ravel(), (BUCKETS + 1) * DIM)


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS + 1) * DIM)
    pending: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            pending.append(np.frombuffer(x, "<u2"))
            size += len(pending[-1])
            if size >= 1 << 18:
                add_contexts(total, pending)
                pending, size = [], 0
    add_contexts(total, pending)
    # whole numbers, so that the order in which parts are added changes nothing
    yield pa.RecordBatch.from_arrays([pa.array([total[: BUCKETS * DIM].astype("<f8").tobytes()])], ["total"])


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(tokens: bytes, context: np.ndarray) -> np.ndarray:
    """Mean context vector and mean index vector of a document."""
    ids = np.frombuffer(tokens, "<u2")
    out = np.zeros(2 * DIM, np.float32)
    if len(ids):
        counts = np.bincount(ids, minlength=BUCKETS) if len(ids) > POOLED else None
        if counts is not None:
            used = np.flatnonzero(counts)
            weight = counts[used].astype(np.float32)
            out[:DIM], out[DIM:] = weight @ context[used], weight @ index_matrix()[used]
        else:
            out[:DIM], out[DIM:] = context[ids].sum(0), index_matrix()[ids].sum(0)
        out /= len(ids)
    return out


class Network:
    """Standardised inputs, one hidden tanh layer, a log-odds, a temperature."""

    def __init__(self, inputs: int, constant: float | None = None):
        rng = np.random.default_rng(SEED)
        self.constant = constant
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -500, 500)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> None:
        """Adam on the cross entropy; the last fifth of the rows sets the temperature."""
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        own, apart = order[: max(1, len(x) * 4 // 5)], order[max(1, len(x) * 4 // 5) :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-3
        z, t = (x[own] - self.mean) / self.scale, y[own].astype(float)
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(z))
            for at in range(0, len(z), batch):
                rows = shuffled[at : at + batch]
                w1, b1, w2, b2 = self.weights
                h = np.tanh(z[rows] @ w1 + b1)
                error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -60, 60))) - t[rows]) / len(rows)
                back = error[:, None] * w2 * (1 - h * h)
                grads = [z[rows].T @ back + decay * w1, back.sum(0), h.T @ error + decay * w2, np.array([error.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(apart):
            odds, t = self.log_odds(x[apart]), y[apart].astype(float)
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, -np.where(t == 1, odds, -odds) / c).mean() for c in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, context: np.ndarray, network: Network):
        self.context, self.network = context, network


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [token_buckets(x) for x in text_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["quality", "tokens"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn ``labels.quality`` (1 good) from the texts of at most ``rows`` labelled documents."""
    spark = documents.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    taught = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "_id")  # broadcast: ``rows`` rows at most
    tokens = stage(taught.select("quality", "text").mapInArrow(_token_batches, "quality int, tokens binary"), "quality-sample")
    context = np.zeros(BUCKETS * DIM)
    for r in tokens.select("tokens").coalesce(8).mapInArrow(_context_batches, "total binary").toLocalIterator():
        context += np.frombuffer(r["total"], "<f8")
    context = unit_rows(context.reshape(BUCKETS, DIM))
    held = spark.sparkContext.broadcast(context)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(t, held.value).astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["quality", "x"])

    # one vector for each of the sampled rows
    found = sorted((r["x"], r["quality"]) for r in tokens.mapInArrow(features, "quality int, x binary").collect())
    unstage(tokens)
    y = np.array([q for _, q in found], int)
    if len(set(y.tolist())) < 2:
        return Model(context, Network(2 * DIM, float(y.mean()) if len(y) else 1.0))
    network = Network(2 * DIM)
    network.train(np.array([np.frombuffer(v, "<f4") for v, _ in found], float), y)
    return Model(context, network)


def score(documents: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Score and predict (doc_id, text); ``keep`` names columns to carry along, ``names`` the two new ones."""
    spark = documents.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if batch.num_rows:
                x = np.array([pooled(token_buckets(t), m.context) for t in text_of(batch.column(0))])
                p = m.network.probability(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names[1:], *names])

    columns = keep or ["doc_id"]
    rows = documents.select(F.col("text").cast("string").alias(fresh("_scored_text", columns)), *columns)
    new = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[1:] + new))


def taught(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.filter(crc_mod("doc_id", 3) != 1)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(documents, taught(labels))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return score(rows, model, ["doc_id", "held_out"])
