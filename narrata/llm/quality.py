"""Quality classifier: random-indexing word vectors pooled over a document, and a two-layer network with calibrated scores.

Random indexing: each word has a fixed sparse index vector (a few +1 and -1 drawn from its hash), and its word vector is
the sum of the index vectors of the words beside it, over all documents. Words share rows of a table of fixed size by
hash, so what is gathered and broadcast is bounded (BUCKETS x DIMS) however large the corpus. A document is the mean and
the deviation of its words' vectors, and the mean product of neighbours' (repeated words have equal ones). The network is trained in numpy on at most SAMPLE labelled documents outside the
held-out fold, and its temperature is fitted on a fifth of them.

Defined cases: null or white text pools to zeros and gets the network's score for that; labels with null ids or values, or
of several values for one id, are left out of training; with no labels, or of one class only, every score is the share of
label 1 (0.5 if there are none); repeated rows each get the same score, and a labelled doc_id that repeats trains once, with
its least text; other columns are ignored, or kept by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from narrata.llm.common import lean, stage, table
from narrata.llm.minhash import Words

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
FEATURES = 2 * DIMS + 2
#: Labelled documents that are used for training, at most; those of the least hashes of doc_id are taken.
SAMPLE = 20_000
HIDDEN, STEPS, RATE = 32, 1500, 0.01
OUT = "doc_id long, held_out boolean, score double, predicted int"


def word_hashes(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one after the other, and the number of words of each text."""
    split = [(t or "").encode().split() for t in texts]
    n = np.array([len(s) for s in split], np.int64)
    return np.array([words[w] for s in split for w in s], np.uint64), n


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, total = Words(), np.zeros(BUCKETS * DIMS)

    def add(texts: list) -> None:
        h, n = word_hashes(texts, words)
        if len(h):
            doc = np.repeat(np.arange(len(n)), n)
            row = (h & np.uint64(BUCKETS - 1)).astype(np.int64) * DIMS
            places = [((h >> np.uint64(20 + 5 * k)) % np.uint64(DIMS)).astype(np.int64) for k in range(NONZERO)]
            signs = [((h >> np.uint64(50 + k)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(NONZERO)]
            for d in range(1, REACH + 1):
                same = np.flatnonzero(doc[d:] == doc[:-d])
                for a, b in ((same, same + d), (same + d, same)):
                    for place, sign in zip(places, signs, strict=True):
                        np.add(total, np.bincount(row[a] + place[b], sign[b], BUCKETS * DIMS), out=total)

    texts, size = [], 0
    for b in batches:
        for t in b.column("text").to_pylist():
            texts.append(t)
            size += len(t or "")
            if size > 2_000_000:
                add(texts)
                texts, size = [], 0
    add(texts)
    used = np.flatnonzero(total.reshape(BUCKETS, DIMS).any(1))
    vectors = total.reshape(BUCKETS, DIMS)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(vectors[:, i]) for i in range(DIMS))], ["bucket", *(f"v{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors from the contexts of all words of all documents; at most BUCKETS rows reach the driver."""
    columns = [f"v{i}" for i in range(DIMS)]
    parts = docs.select("text").mapInArrow(lean(_contexts), "bucket int, " + ", ".join(f"{c} long" for c in columns))
    rows = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).collect()
    out = np.zeros((BUCKETS, DIMS))
    for r in rows:
        out[r[0]] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, words: Words) -> np.ndarray:
    """A row for each text: mean and deviation of its words' vectors, how alike neighbours are, and the logarithm of its length."""
    h, n = word_hashes(texts, words)
    out = np.zeros((len(n), FEATURES))
    if len(h):
        full = n > 0
        at = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
        v = vectors[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
        mean = np.add.reduceat(v, at, dtype=np.float64) / n[full, None]
        square = np.add.reduceat(v * v, at, dtype=np.float64) / n[full, None]
        beside = np.zeros(len(h))
        beside[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:])
        beside[np.cumsum(n)[full] - 1] = 0  # a text's last word has none after it
        alike = np.add.reduceat(beside, at) / np.maximum(n[full] - 1, 1)
        out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0)), alike[:, None], np.log1p(n[full, None])])
    return out


def _features(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        x = pooled(b.column("text").to_pylist(), vectors.value, words)
        yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = net["layers"]
    return np.tanh((x - net["mean"]) / net["scale"] @ w1 + b1) @ w2 + b2


def scores(net: dict, x: np.ndarray) -> np.ndarray:
    if "layers" not in net:
        return np.full(len(x), net["share"])
    return 1 / (1 + np.exp(-np.clip(logits(net, x) / net["temperature"], -500, 500)))


def trained(x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    """Two layers, tanh then logistic, and a temperature fitted on a fifth of the rows; only the share of label 1 if there is nothing to learn from."""
    net: dict = {"share": float(y.mean()) if len(y) else 0.5}
    if not 0 < net["share"] < 1 or len(y) < 10:
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(np.float64)
    net |= {"mean": x.mean(0), "scale": x.std(0) + 1e-6}
    kept = max(1, len(y) // 5)
    fit_x, fit_y, held_y = (x[kept:] - net["mean"]) / net["scale"], y[kept:], y[:kept]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, STEPS + 1):
        some = rng.integers(0, len(fit_x), min(512, len(fit_x)))
        a, t = fit_x[some], fit_y[some]
        hidden = np.tanh(a @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - t) / len(t)
        back = np.outer(error, p[2]) * (1 - hidden**2)
        for i, g in enumerate([a.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net["layers"] = p
    z = logits(net, x[:kept])
    net["temperature"] = float(min(np.geomspace(0.25, 8, 61), key=lambda t: np.logaddexp(0, np.where(held_y == 1, -z, z) / t).mean()))
    return net


def _scored(batches: Iterator[pa.RecordBatch], model, column: str, out: str) -> Iterator[pa.RecordBatch]:
    words = Words()
    vectors, network = model.value
    for b in batches:
        s = scores(network, pooled(b.column(column).to_pylist(), vectors, words))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])


def held_out(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A broadcast (word vectors, network): vectors of all docs, network of a bounded sample of labelled ones."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("m")).where("quality = m")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = docs.select("doc_id", "text").join(F.broadcast(stage(known, "labelled")), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = known.select("quality", "text").mapInArrow(lean(partial(_features, vectors=shared)), "quality int, x array<double>").collect()
    x, y = np.array([r.x for r in rows]).reshape(len(rows), FEATURES), np.array([r.quality for r in rows])
    order = np.lexsort((*x.T, y))  # rows come in any order
    return spark.sparkContext.broadcast((vectors, trained(x[order], y[order])))


def score_quality(docs: DataFrame, labels: DataFrame, out: str = "_score", **how) -> DataFrame:
    """docs with a score from 0 to 1 in a last column, out; docs may have no column of that name."""
    model = fit(docs, labels, **how)
    schema = StructType([*docs.schema, StructField(out, DoubleType())])
    return docs.mapInArrow(lean(partial(_scored, model=model, column="text", out=out)), schema)


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs whose score is 0.5 or more."""
    out = "_score"
    while out in {c.lower() for c in docs.columns}:
        out += "_"
    return score_quality(docs, labels, out, **how).where(F.col(out) >= 0.5).select(docs.columns)


def op8_quality_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels")).withColumn("score", F.col("_score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
