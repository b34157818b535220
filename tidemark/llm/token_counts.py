"""Exact length histogram: how many documents encode to each number of tokens, and what follows for every context limit.

Whole texts are encoded in Arrow batches by a byte-level BPE whose vocabulary is a parameter; only lengths leave Python.
Documents are then summed by length with partial sums before the shuffle, so a hot length is no burden, and sums over all
lengths up to and from each one answer, for a context limit of that many tokens: how many documents fit whole, the
tokens in total, the tokens that remain if longer documents are cut at the limit, and the quantile the limit is.
The sums run in two levels, within blocks of lengths and over blocks, so no task holds all lengths.

Between two lengths of the table nothing changes but the cut: for a limit c between, take the row of the greatest length
below it; truncated = tokens_upto + (documents - documents_upto) * c. limits() does that.

Edges: null and empty texts have 0 tokens and are counted. Repeated rows count each. An empty table gives no rows. Other columns are ignored. Texts
with very long runs of white space, which the tokenizer's pattern engine can't take at once, are split by an equal pattern first.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, small, table, written

BLOCK = 1024
#: Beyond so many white-space characters in a row the pattern engine may run out of stack.
LONG_SPACE = regex.compile(r"\s{10000}")


@functools.cache
def _encoder(path: str | None, pattern: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = pattern or public_tokenizers.PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


def encoded_length(text: str | None, encoder, pattern) -> int:
    if not text:
        return 0
    if len(text) >= 10_000 and LONG_SPACE.search(text):
        return sum(len(encoder.encode_single_piece(x)) if hasattr(encoder, "encode_single_piece") else len(encoder._encode_single_piece(x)) for x in pattern.findall(text))
    return len(encoder.encode_ordinary(text))


def _lengths(path: str | None, pattern: str | None):
    def run(batches):
        encoder, split = _encoder(path, pattern)
        for batch in batches:
            n = np.fromiter((encoded_length(x, encoder, split) for x in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            length, documents = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(documents.astype(np.int64))], ["length", "documents"])

    return run


def length_histogram(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(length, documents): exact, one row per distinct length."""
    bounded_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_lengths(path, pattern), "length long, documents long")
    return counted.groupBy("length").agg(F.sum("documents").alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """(length, documents, documents_upto, documents_from, tokens_upto, tokens_from, tokens_total, truncated, quantile)."""
    h = written(histogram.select("length", "documents", (F.col("length") * F.col("documents")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block")), "histogram")
    blocks = h.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1,024 lengths
    every = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(every).alias("d1"), F.sum("t").over(every).alias("t1"),
    )
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = h.join(small(written(blocks, "blocks"), 1_000_000), "block")
    rows = rows.withColumn("documents_upto", F.col("d0") + F.sum("documents").over(upto)).withColumn("tokens_upto", F.col("t0") + F.sum("tokens").over(upto))
    return rows.select(
        "length", "documents", "documents_upto", (F.col("d1") - F.col("documents_upto") + F.col("documents")).alias("documents_from"),
        "tokens_upto", (F.col("t1") - F.col("tokens_upto") + F.col("tokens")).alias("tokens_from"), F.col("t1").alias("tokens_total"),
        (F.col("tokens_upto") + (F.col("d1") - F.col("documents_upto")) * F.col("length")).alias("truncated"),
        (F.col("documents_upto") / F.col("d1")).alias("quantile"),
    )


def limits(sums: DataFrame, contexts: list[int]) -> DataFrame:
    """(context, fitting, tokens_total, truncated) for any context limits."""
    spark = sums.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(c).cast("long") for c in contexts])).alias("context"))
    total = sums.agg(F.max("tokens_total").alias("tokens_total"), F.max("documents_upto").alias("all"))
    upto = sums.select("length", "documents_upto", "tokens_upto").join(F.broadcast(asked), F.col("length") <= F.col("context"))  # a stated list
    best = upto.groupBy("context").agg(F.max("documents_upto").alias("fitting"), F.max("tokens_upto").alias("kept"))
    best = asked.join(best, "context", "left").fillna(0, ["fitting", "kept"])
    return best.join(F.broadcast(total)).select("context", "fitting", "tokens_total", (F.col("kept") + (F.col("all") - F.col("fitting")) * F.col("context")).alias("truncated"))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
