"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated scores.

Units are runs of letters, of digits and of other signs (bytes; A-Z lower-cased), and marks for each run of two or more
capitals and for each run of letters that equals the one before. Units are hashed to UNITS slots. Random indexing: each slot has a sparse ternary index vector; a slot's word vector is the sum
of the index vectors of the units within REACH of it in the training texts, scaled to length one. A document is the mean
vector over all its units. A network (one hidden layer, numpy, Adam) scores it; a temperature fitted on rows that the weights were not
fitted to makes the scores probabilities.

The fit uses labelled rows whose crc32(doc_id) mod 4 is not 2, one row an id, at most SAMPLE a class and SAMPLE_BYTES of text, half for
each class, in the order of a hash of the id. A text that doesn't fit in what is left of its class's half is passed over, and the
shortest one of a class is taken if none fits. Class weights restore the shares that the classes have among all such labels. The model has a fixed size and is
broadcast.

Scores read whole texts of any length. Null and empty texts have the zero vector and get the network's score for it. Null doc_id: scored, held_out false. Labels with
null quality or id are ignored; of several labels of one id the mean decides. Repeated rows are each scored; of rows with one labelled id the fit takes the one with the
greatest text. Other columns, whatever their names, are ignored by score() and kept by keep_good(). An empty table gives an
empty result; without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import Roller, as_binary, discard, held_out, mix64, prepare, stored, table

UNITS, DIM, REACH, NONZERO = 1 << 15, 64, 2, 6
HIDDEN, EPOCHS, BATCH = 32, 60, 128
SAMPLE, SAMPLE_BYTES = 3000, 48 << 20
THRESHOLD = 0.7
_R = Roller(0xBEEF)
_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_CAPS_SLOT, _AGAIN_SLOT = 0, 1


def units(text: bytes) -> np.ndarray:
    """The slots of a text's units, in order."""
    if not text:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    _R._room(len(raw))
    sums = np.add.reduceat(_R.bytes[_LOWER[raw]] * _R.up[: len(raw)], starts) * _R.down[starts]
    capitals = np.add.reduceat(_CAPITAL[raw], starts)
    keep = kind[starts] != 0
    lengths = np.diff(np.concatenate((starts, [len(raw)])))
    slots = (mix64(sums[keep]) % np.uint64(UNITS - 2)).astype(np.int64) + 2
    loud = np.flatnonzero(((capitals > 1) & (capitals == lengths))[keep])
    letters = np.flatnonzero(kind[starts][keep] == 1)
    again = letters[1:][slots[letters[1:]] == slots[letters[:-1]]]
    marks = np.concatenate((np.full(len(loud), _CAPS_SLOT), np.full(len(again), _AGAIN_SLOT)))
    return np.insert(slots, np.concatenate((loud, again)), marks) if len(marks) else slots


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(7)
    out = np.zeros((UNITS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(UNITS), rng.integers(0, DIM, UNITS)] += rng.choice(np.array([-1, 1], np.float32), UNITS)
    return out


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    index, out = index_vectors(), np.zeros((UNITS, DIM), np.float32)
    gap = np.full(REACH, -1, np.int64)
    padded = [x for t in texts for x in (t, gap)]
    stream = np.concatenate([gap, *padded]) if texts else gap
    index = np.vstack([index, np.zeros((1, DIM), np.float32)])  # slot -1: between texts
    for low in range(REACH, len(stream) - REACH, 50_000):
        high = min(low + 50_000, len(stream) - REACH)
        near = sum(index[stream[low + d : high + d]] for d in range(-REACH, REACH + 1) if d)
        here = stream[low:high]
        order = np.argsort(here, kind="stable")
        slots, first = np.unique(here[order], return_index=True)
        sums = np.add.reduceat(near[order], first)
        real = slots >= 0
        out[slots[real]] += sums[real]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    own = index_vectors() / math.sqrt(NONZERO)  # a unit never seen in training is its own index vector
    return np.where(norm > 0, out / np.maximum(norm, 1e-9), own).astype(np.float32)


def pooled(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(vectors.shape[1], np.float64)
    for i in range(0, len(slots), 1 << 15):
        total += vectors[slots[i : i + (1 << 15)]].sum(axis=0, dtype=np.float64)
    return total / max(1, len(slots))


class Network:
    """tanh(x W1 + b1) W2 + b2, on standardised inputs; a temperature divides the logit."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh(np.clip((x - self.mean) / self.std, -8, 8) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        rng, m, v, t = np.random.default_rng(3), [0.0] * 4, [0.0] * 4, 0
        z = np.clip((x - self.mean) / self.std, -8, 8)
        for epoch in range(EPOCHS):
            rate = 3e-3 * (1 - epoch / EPOCHS)
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
                w1, b1, w2, b2 = self.p
                h = np.tanh(z[part] @ w1 + b1)
                d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[part]) * w[part] / len(part)
                dh = np.outer(d, w2) * (1 - h * h)
                grads = [z[part].T @ dh + 1e-4 * w1, dh.sum(axis=0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        logit = self.logit(x)

        def loss(temperature: float) -> float:
            p = 1 / (1 + np.exp(-np.clip(logit / temperature, -30, 30)))
            return -float(np.sum(w * (y * np.log(p) + (1 - y) * np.log1p(-p))))

        self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss)


def _units(batches):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        held = [units(t).astype(np.int32).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([len(t) for t in texts], pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "y", "lot", "n_bytes", "slots"])


def chosen_ids(rows: list[tuple[int, int, int, int]], room: int) -> list[int]:
    """Ids whose texts fit in half the room for each class. rows: lot, doc_id, class, bytes."""
    out = []
    for y in (0, 1):
        own, left, taken = sorted(r for r in rows if r[2] == y), room // 2, []
        for _, doc_id, _, n in own:
            if n <= left:
                taken.append(doc_id)
                left -= n
        out += taken or [r[1] for r in sorted(own, key=lambda r: r[3])[:1]]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """(word vectors, network), or (None, share of label 1) if there are not labels of both classes."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    total = sum(counts.values())
    if len(counts) < 2:
        return None, float(next(iter(counts), 0.5))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary("text").alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))  # 2 * sample ids at most
    read = stored(joined.withColumn("lot", F.xxhash64("doc_id")).mapInArrow(_units, "doc_id long, y int, lot long, n_bytes long, slots binary"), "quality-sample")
    chosen = chosen_ids([tuple(r) for r in read.select("lot", "doc_id", "y", "n_bytes").collect()], sample_bytes)
    mine = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = [(r.doc_id, np.frombuffer(r.slots, np.int32).astype(np.int64), r.y) for r in read.join(F.broadcast(mine), "doc_id").toLocalIterator()]
    discard(read)
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    if len({r[2] for r in rows}) < 2:
        return None, counts[1] / total
    y = np.array([r[2] for r in rows], float)
    vectors = word_vectors([r[1] for r in rows])
    x = np.stack([pooled(r[1], vectors) for r in rows])
    share = {c: counts[c] / total / max(1e-9, float((y == c).mean())) for c in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    apart = (np.random.default_rng(5).random(len(y)) < 0.2) & (len(y) >= 20)
    network = Network(x[~apart])
    network.fit(x[~apart], y[~apart], w[~apart])
    if apart.any():
        network.calibrate(x[apart], y[apart], w[apart])
    return vectors, network


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if vectors is None:
                scores = np.full(len(texts), network)
            else:
                scores = network.score(np.stack([pooled(units(t), vectors) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    id_ = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(id_, held_out(F.col("doc_id")).alias("held_out"), as_binary("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            scores = np.full(len(texts), 0.0 if not texts else network) if vectors is None or not texts else network.score(np.stack([pooled(units(t), vectors) for t in texts]))
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
