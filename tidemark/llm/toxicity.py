"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased. A document's features are
the distinct buckets of its words, word pairs and pairs one word apart, so a text that repeats a phrase
counts it once and a long text isn't diluted. Pairs pay twice the L1 of words, and positive rows, where they are few, count up to
`positive` times. Per-coordinate rates and L1 leave a few hundred weights,
which are small enough to broadcast whatever the corpus.

The classifier is fitted on at most `max_train` labelled rows, those whose hashed doc_id is smallest, and of
these, in that order, on as many as have `max_features` features in total: a bounded sample at every corpus size,
and the same rows on a rerun. Of rows that repeat a doc_id one is learnt from, that of the least set of features as bytes; tasks keep one
row per id before anything is shuffled, so an id of a million rows is no burden. Everything else reads every row and whole texts.

Edges: a null or empty text has no features and scores the bias; a very long one has as many as it has distinct words and pairs. Null labels are
ignored; of several labels of one doc_id the largest counts. Repeated rows are scored each. Without any label the bias is -1, so that nothing
is rejected. An empty table gives no rows. Other columns pass through; one named as the column of scores is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, crc_mod5, table, written
from tidemark.llm.textops import ALNUM, U64, mix, ngrams, parts, words

#: Bytes of text that a task turns into features at once: some 60 bytes of memory for each.
PIECE = 1 << 20
KINDS = {"word": U64(0x51), "pair": U64(0x52), "skip": U64(0x53)}


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    max_train: int = 12_000
    max_features: int = 64 << 20
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l1_pairs: float = 16.0
    positive: float = 3.0
    l2: float = 0.01


def document_features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word, pair and skip-pair of a column, not yet made distinct; words have the upper half of the buckets."""
    found = words(column, ALNUM)
    h = found.hashes()
    doc = np.repeat(np.arange(len(found.counts)), found.counts)
    shift = U64(65 - bits)
    docs, buckets = [doc], [mix(h ^ KINDS["word"]) >> shift | U64(1 << (bits - 1))]
    pairs = ngrams(h, 2)
    same = doc[:-1] == doc[1:]
    docs.append(doc[:-1][same])
    buckets.append(mix(pairs[same] ^ KINDS["pair"]) >> shift)
    if len(h) > 2:
        same = doc[:-2] == doc[2:]
        skips = h[:-2] * KINDS["skip"] + h[2:]
        docs.append(doc[:-2][same])
        buckets.append(mix(skips[same]) >> shift)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def _pack(bits: int):
    """Rows (place, label, text) to (place, label, features): distinct buckets as packed int32."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text", PIECE):
                d, b = document_features(part.column("text"), bits)
                key = np.unique(d << bits | b)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) << bits)
                packed = (key & ((1 << bits) - 1)).astype("<i4")
                feats = [packed[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), pa.array(feats, pa.binary())], ["place", "label", "features"])

    return run


class Ftrl:
    """FTRL-proximal state; coordinate 2**bits is the bias, which L1 leaves alone."""

    def __init__(self, p: FtrlParams):
        self.p, size = p, (1 << p.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias = 1 << p.bits
        self.l1 = np.full(size, p.l1)
        self.l1[: size // 2] = p.l1_pairs
        self.l1[self.bias] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, p, l1 = self.z[at], self.p, self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def learn(self, buckets: np.ndarray, label: int, weight: float) -> None:
        at = np.append(buckets, self.bias)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def _fit(p: FtrlParams):
    """One task streams the ordered sample, keeps it packed, and returns the weights that aren't zero."""

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for label, feats in zip(batch.column("label").to_pylist(), batch.column("features").to_pylist(), strict=True):
                size += len(feats) // 4
                if size <= p.max_features:
                    rows.append((np.frombuffer(feats, "<i4"), label))
        model, order = Ftrl(p), np.random.default_rng(1)
        toxic = sum(label for _, label in rows)
        weight = min(p.positive, max(1.0, (len(rows) - toxic) / max(1, toxic) / 2))  # never over half of all weight
        for _ in range(p.epochs):
            for i in order.permutation(len(rows)):
                model.learn(rows[i][0].astype(np.int64), rows[i][1], weight if rows[i][1] else 1.0)
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["bucket", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams()) -> dict[int, float]:
    """Weights by bucket. labels: (doc_id, label 0/1) of the rows that may be learnt from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = (
        labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .withColumn("place", F.xxhash64("doc_id")).orderBy("place").limit(p.max_train)
    )
    sample = written(sample, "toxic_sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_train rows of three numbers
    packed = rows.select("place", "label", "text").mapInArrow(_pack(p.bits), "place long, label int, features binary")
    packed = packed.groupBy("place", "label").agg(F.min("features").alias("features"))  # one row for each id of the sample
    ordered = packed.repartition(1).sortWithinPartitions("place", "features")
    model = ordered.select("label", "features").mapInArrow(_fit(p), "bucket long, weight double")
    return {r.bucket: r.weight for r in model.collect()}  # bounded by 2**bits, a few hundred with L1


def _score(column: pa.Array, weights: np.ndarray, bits: int, bias: float) -> np.ndarray:
    d, b = document_features(column, bits)
    hit = np.flatnonzero(weights[b])
    key = np.unique(d[hit] << bits | b[hit])
    total = np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], minlength=len(column))[: len(column)]
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def score(docs: DataFrame, model: dict[int, float], p: FtrlParams = FtrlParams(), column: str = "toxicity") -> DataFrame:
    """docs with the column of scores; any column of that name is replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(column)
    bias = model.get(1 << p.bits, -1.0)
    shared = spark.sparkContext.broadcast((np.array(sorted(k for k in model if k < 1 << p.bits), np.int64), np.array([model[k] for k in sorted(model) if k < 1 << p.bits])))

    def run(batches):
        at, w = shared.value
        dense = np.zeros(1 << p.bits)
        dense[at] = w
        for batch in batches:
            for part in parts(batch, "text", PIECE):
                got = _score(part.column("text"), dense, p.bits, bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(crc_mod5(F.col("doc_id")) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = score(docs.select("doc_id", "text"), fit(docs, seen), column="score")
    return scored.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score under 0.5; learns from the labels of the documents it is given."""
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    return score(docs, model, column="__toxicity").where("__toxicity < 0.5").drop("__toxicity")
