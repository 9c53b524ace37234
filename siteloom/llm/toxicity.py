"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Fitted on at most TRAIN_ROWS labelled ids, the ones with the smallest hash. Character
n-grams of the lower-cased text fall in buckets; a bucket's ratio is the logarithm of how much more
often toxic than other training texts hold it. The buckets that tell most are kept, a text's counts
in them are divided by the root of its length and multiplied by the ratios, and a logistic
regression is fitted on these features. Scoring reads every whole text once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm.common import documents, map_texts
from siteloom.llm.ngrams import Batch, logistic
from siteloom.session import checkpointed, ship, table

#: Bound on the labelled rows that are learnt from.
TRAIN_ROWS = 4000
ORDERS, BITS = (4, 5, 6), 18
#: Buckets that are kept, the least number of training texts that hold one, and the smoothing of counts.
FEATURES, LEAST_TEXTS, SMOOTH = 4096, 4, 1.0
PENALTY = 1e-4


def _batch(texts: list[str]) -> Batch:
    return Batch([t.lower().encode("utf-32-le", "replace") for t in texts], max(ORDERS) - 1, "<u4")


def _buckets(batch: Batch) -> list[np.ndarray]:
    return [batch.hashed(n, BITS) + np.uint32(k << BITS) for k, n in enumerate(ORDERS)]


class Model:
    """table: a weight for every bucket; score = 1 / (1 + exp(-(sum of weights / sqrt(places) + intercept)))."""

    def __init__(self, table: np.ndarray, intercept: float):
        self.table, self.intercept = table.astype(np.float32), intercept

    def scores(self, texts: list[str]) -> np.ndarray:
        batch = _batch(texts)
        total = sum(batch.sums(self.table[h]).astype(np.float64) for h in _buckets(batch))
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(batch.sizes) + self.intercept, -30, 30)))


def _held(batches):
    """(bucket, label, n): in how many texts a bucket stands."""
    counts = np.zeros((2, len(ORDERS) << BITS), np.int64)
    for b in batches:
        texts, labels = [t or "" for t in b.column("text").to_pylist()], b.column("label").to_pylist()
        for first in range(0, len(texts), 64):
            batch = _batch(texts[first : first + 64])
            every = _buckets(batch)
            for k, y in enumerate(labels[first : first + 64]):
                counts[y, np.unique(np.concatenate([h[batch.of(k)] for h in every]))] += 1
    for y in (0, 1):
        at = np.flatnonzero(counts[y])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), y), pa.int32()), pa.array(counts[y, at])], names=["bucket", "label", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows (label 0 or 1; other and null labels, null ids are passed over; the
    larger label counts if an id has several, and the first of its texts). Without rows of both labels every score is the share
    of label 1, or 0.0 without any rows."""
    spark = docs.sparkSession
    ship(spark)
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    some = some.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
    texts = checkpointed(texts)  # at most `rows` texts
    many = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = many.get(0, 0), many.get(1, 0)
    empty = np.zeros(len(ORDERS) << BITS)
    if not n0 or not n1:
        return Model(empty, 30.0 if n1 else -30.0)
    held = texts.mapInArrow(_held, "bucket int, label int, n long").groupBy("bucket").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    rate = (F.col("p") + F.col("q")) / (n0 + n1)
    told = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt(rate * (1 - rate) + 1e-4)
    kept = held.where(F.col("p") + F.col("q") >= LEAST_TEXTS).orderBy(told.desc(), "bucket").limit(FEATURES).collect()
    if not kept:
        return Model(empty, float(np.log(n1 / n0)))
    bucket = np.array([r.bucket for r in kept])
    p, q = (np.array([r[c] for r in kept], float) + SMOOTH for c in ("p", "q"))
    ratio = np.log(p / (n1 + 2 * SMOOTH)) - np.log(q / (n0 + 2 * SMOOTH))
    place = np.full(len(ORDERS) << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    shared = spark.sparkContext.broadcast(place)

    def counted(batches):
        for b in batches:
            held, labels = [t or "" for t in b.column("text").to_pylist()], b.column("label")
            at, n = [], []
            for first in range(0, len(held), 64):
                batch = _batch(held[first : first + 64])
                every = [shared.value[h] for h in _buckets(batch)]
                for k in range(len(held[first : first + 64])):
                    own = np.concatenate([h[batch.of(k)] for h in every])
                    which, times = np.unique(own[own >= 0], return_counts=True)
                    at.append(which.astype(np.int32).tobytes())
                    n.append((times / np.sqrt(batch.sizes[k])).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([labels, pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["label", "at", "n"])

    rows_ = texts.mapInArrow(counted, "label int, at binary, n binary").collect()  # the kept counts of at most `rows` texts
    x = np.zeros((len(rows_), len(bucket)), np.float32)
    for k, r in enumerate(rows_):
        x[k, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.n, np.float32)
    x *= ratio.astype(np.float32)
    y = np.array([r.label for r in rows_], float)
    w, intercept = logistic(x, y, np.ones(len(y)), PENALTY)
    out = empty
    out[bucket] = w * ratio
    return Model(out, intercept)


def toxicity(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, score and predicted of every whole text, of any length; null texts count as empty. All rows stay, repeated
    ones with one score; an empty table gives an empty one. Other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            scores = shared.value.scores(texts)
            return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return work

    return map_texts(docs, id_cols, text_col, "score double, predicted int", make)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model that fit learns from the labelled rows outside the held-out fold; a row without id is not held out."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, labels.where(fold != 0), "doc_id", "text", "toxic")
    scored = toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
