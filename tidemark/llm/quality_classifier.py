"""Document quality by random-indexing word vectors and a small neural network.

*Random indexing.* Every word has an index vector, a few +1 and -1 drawn from its hash, never stored. A word's context
vector is the sum of the index vectors of its neighbours over the whole table; contexts are kept by word hash bucket, so
their table has a fixed size (5 MB), in which words of a large vocabulary share rows. Beside it stands a small table of the same kind for
the shapes of words (letters, capitals, digits and marks in their order), so that words never seen before share what their shape has learnt.

*Pooling.* A text's vector is the mean over its words of the unit context vectors (length 1 each) of word and shape,
the mean of the index vectors of the shapes, how often a word's index vector is that of the word one or two places before,
and the logarithm of the word count.

*Network.* Two layers in numpy, fitted by full-batch Adam on a bounded sample of labelled rows; a temperature is fitted on
a fifth of that sample that the weights never saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import collect_blocks, documents, materialize, sum_blocks
from .textops import U64, Chunk, Hasher, chunks, mix

WORD_BITS, SHAPE_BITS, DIMS, NONZERO, REACH = 15, 12, 32, 4, 2
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)  # words, then shapes
BLOCK = 128  # buckets in a row of the summed table
#: Labelled rows that the network is fitted on at most, taken by hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.02, 1e-4


class _Shapes:
    """Words as hashes of what kinds of bytes they hold, runs as one."""

    def __init__(self):
        kind = np.full(256, 5, np.uint8)  # marks: each its own kind
        kind[ord("a") : ord("z") + 1] = 1
        kind[ord("A") : ord("Z") + 1] = 2
        kind[ord("0") : ord("9") + 1] = 3
        kind[128:] = 1
        marks = np.flatnonzero(kind == 5)
        kind[marks] = 6 + np.arange(len(marks)) % 200
        kind[[0x20, *range(0x09, 0x0E)]] = 0
        self.kind = kind
        self.turn = mix(np.arange(16, dtype=U64) + U64(11)) | U64(1)
        self.value = mix(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15))  # 0 for separators

    def __call__(self, chunk: Chunk) -> np.ndarray:
        if not len(chunk.starts):
            return np.zeros(0, U64)
        k = self.kind[chunk.buf]
        keep = np.ones(len(k), bool)
        keep[1:] = k[1:] != k[:-1]
        keep[chunk.starts] = True
        step = np.cumsum(keep)
        first = np.zeros(len(k), np.int64)
        first[chunk.starts] = step[chunk.starts]
        np.maximum.accumulate(first, out=first)
        run = np.clip(step - first, 0, 15)
        value = self.value[k] * self.turn[run]
        value[~keep] = 0
        return mix(np.add.reduceat(value, chunk.starts))


def _draws(value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of index vectors, one pair of arrays for each of their ``NONZERO`` draws."""
    for i in range(NONZERO):
        h = mix(value + U64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        yield (h >> U64(8)).astype(np.int64) % DIMS, np.where(h & U64(1), 1, -1).astype(np.int32)


def _index(value: np.ndarray) -> np.ndarray:
    """Dense index vectors of a few distinct units."""
    out = np.zeros((len(value), DIMS), np.float32)
    for place, sign in _draws(value):
        np.add.at(out, (np.arange(len(value)), place), sign)
    return out


def _word_bucket(value: np.ndarray) -> np.ndarray:
    return (value >> U64(64 - WORD_BITS)).astype(np.int64)


def _shape_bucket(value: np.ndarray) -> np.ndarray:
    return (value >> U64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by bucket, words of words and shapes of shapes; blocks without any aren't sent."""
    words, shapes = Hasher(5), _Shapes()
    total = np.zeros(BUCKETS * DIMS, np.int32)
    for _, texts in chunks(batches, size=1 << 20):
        chunk = Chunk(texts)
        doc = chunk.doc_of_word()
        if not len(doc):
            continue
        for unit, bucket in ((words.words(chunk), _word_bucket), (shapes(chunk), _shape_bucket)):
            row = bucket(unit) * DIMS
            for place, sign in _draws(unit):
                for far in range(1, REACH + 1):
                    same = doc[far:] == doc[:-far]
                    np.add.at(total, row[far:][same] + place[:-far][same], sign[:-far][same])
                    np.add.at(total, row[:-far][same] + place[far:][same], sign[far:][same])
    parts = total.reshape(-1, BLOCK * DIMS)
    used = np.flatnonzero(parts.any(1)).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["block", "data"])


def _pooled(contexts: np.ndarray, texts: list[bytes], words: Hasher, shapes: _Shapes) -> np.ndarray:
    chunk = Chunk(texts)
    out = np.zeros((len(texts), 3 * DIMS + 1 + REACH), np.float32)
    out[:, -1] = np.log1p(chunk.n_words)
    if not len(chunk.starts):
        return out
    w, s = words.words(chunk), shapes(chunk)
    kinds, which = np.unique(s, return_inverse=True)
    index = _index(kinds)
    full = chunk.n_words > 0
    doc = chunk.doc_of_word()
    for far in range(1, REACH + 1):
        again = (w[far:] == w[:-far]) & (doc[far:] == doc[:-far])
        out[:, -1 - far] = np.bincount(doc[far:][again], minlength=len(texts)) / np.maximum(chunk.n_words, 1)
    begin = chunk.word_start[:-1][full]
    for i, rows in enumerate((contexts[_word_bucket(w)], contexts[_shape_bucket(kinds)][which], index[which])):
        out[full, i * DIMS : (i + 1) * DIMS] = np.add.reduceat(rows, begin, axis=0) / chunk.n_words[full][:, None]
    return out


def _vectors(contexts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = Hasher(5), _Shapes()
        for table, texts in chunks(batches, size=1 << 20):
            rows = _pooled(contexts.value, texts, words, shapes)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "vector"])

    return run


class Network:
    """``sigmoid((relu(x A + a) B + b) / temperature)`` on standardised inputs."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for step in range(1, EPOCHS + 1):
            hidden = np.maximum(z[used] @ self.w[0] + self.w[1], 0)
            off = (_sigmoid(hidden @ self.w[2] + self.w[3]) - y[used]) / len(used)
            back = np.outer(off, self.w[2]) * (hidden > 0)
            grads = [z[used].T @ back + DECAY * self.w[0], back.sum(0), hidden.T @ off + DECAY * self.w[2], np.array([off.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        logit = self._logit(z[held])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t)) if len(held) else 0.0 for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0
        return self

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scores(contexts, network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes, net = Hasher(5), _Shapes(), network.value
        for table, texts in chunks(batches, "_text", size=1 << 20):
            score = net.score(_pooled(contexts.value, texts, words, shapes).astype(np.float64)) if net else np.full(len(texts), 0.5)
            rest = table.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rest.columns], pa.array(score, pa.float64())], names=[*rest.column_names, "score"])

    return run


def word_contexts(docs: DataFrame) -> np.ndarray:
    """Context vectors of length 1 by bucket, over all of ``docs`` (``text``); a bucket without neighbours stays zero."""
    summed = sum_blocks(docs.select("text").mapInArrow(_contexts, "block int, data binary"), "<i4", BUCKETS // BLOCK, into="<i8")
    out = collect_blocks(summed, "<i8", BUCKETS // BLOCK, BLOCK * DIMS).reshape(BUCKETS, DIMS).astype(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def quality_scores(docs: DataFrame, labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``; all columns are carried) with ``score, predicted``.

    ``labelled`` has ``doc_id`` and ``quality`` (1 good, 0 bad, else ignored); the network is fitted on ``sample_rows`` of
    its texts at most, least id hash first (of rows that repeat an id, one). Only the text is scored. A null or empty text scores as a text without words;
    equal texts score alike. Without labels of both kinds all scores are 0.5. An empty table gives an empty one. Columns
    of ``docs`` named like the two that are added are replaced.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text")
    contexts = sc.broadcast(word_contexts(texts))
    marks = labelled.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = materialize(marks.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(sample_rows))
    sample = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # one row an id
    vectors = sample.mapInArrow(_vectors(contexts), "doc_id bigint, vector array<float>")
    rows = vectors.join(F.broadcast(chosen), "doc_id").select("doc_id", "vector", "quality").toArrow().sort_by("doc_id")  # sample_rows at most
    y = rows.column("quality").to_numpy().astype(np.float64)
    network = None
    if len(set(y.tolist())) == 2:
        network = Network().fit(np.stack(rows.column("vector").to_numpy()).astype(np.float64), y)
    rows = docs.drop("score", "predicted").select(F.col("text").alias("_text"), F.struct("*").alias("_row"))
    schema = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_scores(contexts, sc.broadcast(network)), schema).select("_row.*", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", "quality")
    scores = quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")
