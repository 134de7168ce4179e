"""Quality classifier: random-indexing word vectors pooled per document and a two-layer network.

A word is a bucket of the hash of the whole word. Every bucket has a fixed sparse ternary index vector;
its word vector is the sum of the index vectors that stand next to it in all training texts, labelled
or not, summed by Spark into a table of fixed size. A document is the mean
of its word vectors, beside the mean of its own index vectors. A two-layer network learns from a
bounded sample of labelled rows, and a temperature fitted on rows set apart calibrates its output.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow
from strandline.session import settled

BUCKETS, DIM, HIDDEN = 16_384, 48, 32
#: About so many labelled rows are learnt from.
SAMPLE = 4000
#: Parts the table of context vectors is summed in, and tasks whose sums meet in the first step.
BLOCKS, FAN = 32, 16
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    out[np.arange(BUCKETS)[:, None], rng.integers(0, DIM, (BUCKETS, 4))] = rng.choice([-1.0, 1.0], (BUCKETS, 4))
    return out


def pieces(text: str) -> np.ndarray:
    """Buckets of the words and runs of marks of a text; a word's case pattern and its repetition are words of their own."""
    found, last = [], None
    for p in PIECE.findall(text):
        if p == last:
            found.append("\x00again")
        elif len(p) > 1 and p.isupper():
            found.append("\x00upper")
        found.append(p)
        last = p
    return np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in found), np.int64, len(found))


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(vectors.shape[1] + 2, np.float32)
    seen = np.unique(ids)
    return np.concatenate([vectors[ids].mean(0), [np.log1p(len(ids)) / 8, len(seen) / (len(ids) + 10)]]).astype(np.float32)


def _neighbours(batches):
    """Sums of the index vectors beside each bucket over the texts of a task: (block, int64 table as bytes)."""
    index = index_vectors()
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :4]
    sign = np.take_along_axis(index, at, 1)
    table = np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        ids = [pieces(t or "") for t in batch.column("text").to_pylist()]
        left = np.concatenate([np.zeros(0, np.int64), *[x[:-1] for x in ids]])
        right = np.concatenate([np.zeros(0, np.int64), *[x[1:] for x in ids]])
        word, beside = np.concatenate([left, right]), np.concatenate([right, left])
        for k in range(4):
            table += np.rint(np.bincount(word * DIM + at[beside, k], sign[beside, k], len(table))).astype(np.int64)
    parts = table.reshape(BLOCKS, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["block", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS * DIM // BLOCKS, np.int64)
    for part in table.column("sums"):
        total += np.frombuffer(part.as_buffer(), np.int64)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM sums of the index vectors beside each bucket over all rows of docs.

    Tasks send sums of whole numbers, added in two steps, so the result does not depend on how rows are dealt.
    """
    sums = map_arrow(docs.select(F.col(text).alias("text")), _neighbours, "block long, sums binary")
    kind = "block long, sums binary"
    some = sums.withColumn("part", F.floor(F.spark_partition_id() / FAN)).groupBy("block", "part").applyInArrow(_add, kind)
    whole = settled(some.groupBy("block").applyInArrow(_add, kind), "context")
    out = np.zeros((BLOCKS, BUCKETS * DIM // BLOCKS), np.int64)
    for r in whole.collect():
        out[r["block"]] = np.frombuffer(r["sums"], np.int64)
    return out.reshape(BUCKETS, DIM)


def fit(texts: list[str], labels: list[int], sums: np.ndarray, seed: int = 5) -> dict:
    """Network and temperature on word vectors from sums; without both labels the score is the share of label 1 (0.5 without rows)."""
    index = index_vectors()
    ids = [pieces(t) for t in texts]
    context = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    vectors = np.concatenate([context, index], 1)
    y = np.array(labels, np.float64)
    if len(y) < 10 or y.min() == y.max():
        return {"vectors": vectors, "share": float(y.mean()) if len(y) else 0.5}
    x = np.stack([pooled(i, vectors) for i in ids]).astype(np.float64)
    mean, dev = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / dev
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart, learn = order[: len(y) // 5], order[len(y) // 5 :]
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(40):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            h = np.tanh(x[part] @ w[0] + w[1])
            err = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(err, w[2]) * (1 - h * h)
            grads = [x[part].T @ back + 1e-3 * w[0], back.sum(0), h.T @ err + 1e-3 * w[2], err.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(x[apart] @ w[0] + w[1]) @ w[2] + w[3]
    loss = lambda t: np.logaddexp(0, np.where(y[apart] == 1, -logit, logit) / t).mean()
    return {"vectors": vectors, "mean": mean, "dev": dev, "w": w, "temperature": float(min(np.geomspace(0.25, 8, 60), key=loss))}


def score(model: dict, text: str) -> float:
    if "share" in model:
        return model["share"]
    x = (pooled(pieces(text), model["vectors"]) - model["mean"]) / model["dev"]
    w = model["w"]
    logit = float((np.tanh(x @ w[0] + w[1]) @ w[2] + w[3])[0]) / model["temperature"]
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, usable: str, sample: int = SAMPLE, text: str = "text", ident: str = "doc_id") -> dict:
    """Model from the rows where usable (over _id) holds: word vectors from all of them, the network and
    the temperature from about sample labelled ones (the least hashes of their ids).

    The sample is bounded, its texts are whole. Rows with null ids are left out, those with null labels
    are only in the word vectors.
    """
    ready = labels.where("quality is not null").select(F.col(ident).alias("_id"), F.col("quality").alias("_y")).where(usable)
    count = ready.count()
    share = min(1.0, sample / max(count, 1))
    picked = ready.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(picked, "_id").orderBy("_id").collect()
    training = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).where("_id is not null").where(usable)
    return fit([r["_t"] for r in rows], [int(r["_y"]) for r in rows], context_vectors(training, "_t"))


def scores(docs: DataFrame, model: dict, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(_id, score) of every row from its whole text; a null text counts as empty. The model is broadcast: its size is fixed by BUCKETS and DIM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [score(shared.value, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.float64())], ["_id", "score"])

    return map_arrow(docs.select(F.col(ident).alias("id"), F.col(text).alias("text")), run, f"_id {docs.schema[ident].dataType.simpleString()}, score double")
