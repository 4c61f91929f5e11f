"""Text quality by random-indexing word vectors and a small calibrated network.

Every word has a fixed sparse random index vector (by its hash). A word's vector is
the sum of the index vectors of its neighbours, two to each side, over all
documents. A document's words and shapes (what is left of its tokens without small
letters) are pooled to one vector each, with their sizes and how much they repeat.
A two-layer network, trained in numpy on a bounded sample of labelled rows, gives a
logit; a temperature fitted on rows that the network has not seen makes it a
probability.

Null text is the empty text; empty texts have a vector of zeros and get a score like
any other. Rows are scored one by one, so ids may be null or repeated. Of repeated
labels of an id the greatest counts. Without labels every score is 0.5.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docfathom.llm.text import ALNUM, held_out, raw_texts

#: Hash buckets of words, and dimensions of their vectors: the model has this size
#: for any corpus.
BUCKETS, DIMS = 1 << 14, 64
#: Places that are not zero in an index vector.
NONZERO = 8
#: At most so many labelled rows, those of least hash, train the network.
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
#: Rows of the table of vectors that travel together.
CHUNK = 256
KNOWN_WORDS = 400_000

#: Keeps digits, capitals (as A) and punctuation; small letters and all outside
#: ASCII go.
SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
SMALL = bytes([*range(97, 123), *range(128, 256)])
WIDTH = 2 * DIMS + 5


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word) % BUCKETS
        return value


@functools.cache
def known_buckets() -> Buckets:
    return Buckets()


@functools.cache
def index_vectors() -> np.ndarray:
    """The random index vector of every bucket: a few +1 and -1."""
    rng = np.random.default_rng(20)
    where = rng.random((BUCKETS, DIMS)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    np.put_along_axis(vectors, where, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), axis=1)
    return vectors


def _buckets(found: list[bytes], known: Buckets) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.int32, len(found))


def words(raw: bytes, known: Buckets) -> np.ndarray:
    return _buckets(raw.translate(ALNUM).split(), known)


def shapes(raw: bytes, known: Buckets) -> np.ndarray:
    return _buckets(raw.translate(SHAPE, SMALL).split(), known)


def _squeezed(sums: np.ndarray) -> bytes:
    """Sums of +1 and -1, compressed: a task over few words sends little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(sums.astype("<i8").tobytes())


def _unsqueezed(sums: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(sums), "<i8")


def _contexts(batches):
    """A task's sums of neighbours' index vectors, in chunks of buckets."""
    vectors, known = index_vectors(), known_buckets()
    sums = np.zeros((BUCKETS, DIMS), np.float32)
    for batch in batches:
        if len(known) > KNOWN_WORDS:
            known.clear()
        for raw in raw_texts(batch):
            found = words(raw, known)
            for a in range(0, len(found), 8192):
                piece = found[max(0, a - 2) : a + 8194]
                own = vectors[piece]
                around = np.zeros_like(own)
                for d in (1, 2):
                    around[d:] += own[:-d]
                    around[:-d] += own[d:]
                skip = min(a, 2)
                piece, around = piece[skip : skip + 8192], around[skip : skip + 8192]
                order = np.argsort(piece, kind="stable")
                keys, starts = np.unique(piece[order], return_index=True)
                sums[keys] += np.add.reduceat(around[order], starts, axis=0)
    used = [c for c in range(0, BUCKETS, CHUNK) if sums[c : c + CHUNK].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([_squeezed(sums[c : c + CHUNK]) for c in used], pa.binary())],
        ["chunk", "sums"],
    )


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
            own = _unsqueezed(sums)
            total[chunk] = total[chunk] + own if chunk in total else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([_squeezed(v) for v in total.values()], pa.binary())],
        ["chunk", "sums"],
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, over all of ``docs``.

    A task sends one table of fixed size, and the driver receives one.
    """
    schema = "chunk int, sums binary"
    # Twice, so that no task adds up the tables of all tasks.
    partial = docs.select("text").mapInArrow(_contexts, schema).withColumn("part", F.spark_partition_id() % 32)
    partial = partial.repartition("chunk", "part").select("chunk", "sums").mapInArrow(_add_up, schema)
    vectors = np.zeros((BUCKETS, DIMS))
    for row in partial.repartition("chunk").mapInArrow(_add_up, schema).collect():
        vectors[row.chunk : row.chunk + CHUNK] += _unsqueezed(row.sums).reshape(-1, DIMS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _repeats(found: np.ndarray) -> tuple[float, float]:
    """How far words, and pairs of words, repeat: 0 if all differ, to 1."""
    if len(found) < 2:
        return 0.0, 0.0
    pairs = found[:-1].astype(np.int64) * BUCKETS + found[1:]
    return 1 - len(np.unique(found)) / len(found), 1 - len(np.unique(pairs)) / len(pairs)


def features(raw: bytes, vectors: np.ndarray, known: Buckets) -> np.ndarray:
    """The pooled vector of a document."""
    out = np.zeros(WIDTH, np.float32)
    found, other = words(raw, known), shapes(raw, known)
    for at, own, table in ((0, found, vectors), (DIMS, other, index_vectors())):
        for a in range(0, len(own), 65536):
            out[at : at + DIMS] += table[own[a : a + 65536]].sum(axis=0)
        out[at : at + DIMS] /= max(1, len(own))
    out[-5:-3] = np.log1p(len(found)), np.log1p(len(other))
    out[-3] = len(other) / max(1, len(found))
    out[-2:] = _repeats(found)
    return out


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), 0.5)
        return probability(self.logits(x) / self.temperature)


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def log_loss(logit: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(probability(logit), 1e-9, 1 - 1e-9)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 1) -> QualityModel:
    """Adam on four fifths of the rows; the temperature of least loss on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    cut = max(1, len(x) * 4 // 5)
    mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-3
    z = (x - mean) / scale
    layers = [
        rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(cut), max(1, cut // 128)):
            hidden = np.tanh(z[rows] @ layers[0] + layers[1])
            error = (probability(hidden @ layers[2] + layers[3]) - y[rows]) / len(rows)
            back = error[:, None] * layers[2] * (1 - hidden**2)
            slopes = [z[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                layers[i] -= (
                    0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                )
    model = QualityModel(vectors, mean, scale, tuple(layers), 1.0)
    if cut == len(x):
        return model
    logits = model.logits(x[cut:])
    best = min(np.geomspace(0.25, 16, 121), key=lambda t: (log_loss(logits / t, y[cut:]), t))
    return QualityModel(vectors, mean, scale, tuple(layers), float(best))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from the rows of ``docs`` that ``labels`` (doc_id and ``label``) name."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    sent = spark.sparkContext.broadcast(vectors)

    def run(batches):
        hashes = known_buckets()
        for batch in batches:
            found = [features(raw, sent.value, hashes).tobytes() for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "x"]
            )

    found = rows.mapInArrow(run, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return QualityModel(vectors, np.zeros(WIDTH), np.ones(WIDTH), None, 1.0)
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return train(vectors, x, (found["label"].to_numpy() > 0).astype(int))


def score(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        hashes = known_buckets()
        for batch in batches:
            if len(hashes) > KNOWN_WORDS:
                hashes.clear()
            found = [features(raw, sent.value.vectors, hashes) for raw in raw_texts(batch)]
            scores = sent.value.scores(np.array(found, np.float64).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= least).cast("int")
    )


def learns(doc_id: str = "doc_id"):
    """Rows that labels may be learned from: four of five by their id's crc32."""
    return ~held_out(doc_id, 5, 0)
