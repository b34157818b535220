"""Nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking.

Vectors are cut into pieces of two dimensions, each replaced by one of 16 centres (four bits). Centres and codes minimise
the anisotropic loss eta * |parallel residual|^2 + |orthogonal residual|^2, parallel to the vector itself: an error along the
vector changes large inner products most. Codes are chosen by coordinate descent over the pieces, centres by the
weighted least squares that the loss gives. Both are fitted on at most `train` vectors, those of least hashed id.

Index: every vector is encoded once and written with its code and the length of what the code leaves of it, in files of about `shard` rows.

Search: the stated queries are broadcast in blocks of a bounded number of components, and one pass over the index answers a block: vectors
are read where they lie, never shuffled. A task scans a piece of the index in codes: two codes make one byte and two pieces' tables one of 256
sums, so a candidate costs a look-up a byte. The `keep` best of each query are multiplied exactly and their k-th best is its floor, which the
task's next pieces start from and raise. A vector is reranked by its exact double-precision product if its scanned product comes within
`deviations` standard errors of the floor: the part of a query along what a code leaves out is 1 / sqrt(dimensions) of its length
on average, so three deviations lose about one neighbour in a thousand, and codes that don't tell the members of a dense cluster apart
cost time and not recall. The k best, ties to smaller ids, leave the task. Equal vectors share a product and are scanned once; of each the
k smallest ids are all that can count: this is the exact way for buckets of any size. All these cuts are taken without the
rows that bear the query's own id.

Edges: null, empty, zero vectors and vectors that hold null or non-finite components take no part, nor do rows with a null id. Vectors of each
number of dimensions are searched among themselves, with centres of their own. Very long vectors make smaller blocks. Repeated ids are each a
row, repeated queries one; a query is never its own candidate, by id. Fewer candidates than k give fewer rows, an empty table none. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, empty, fresh_path, table, written


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    keep: int = 64
    deviations: float = 3.0
    width: int = 2
    train: int = 8192
    rounds: int = 6
    threshold: float = 0.2
    shard: int = 8192
    block: int = 1 << 19
    """Components of the queries of a block, 4 MB: 8,192 queries of 64 dimensions."""


class Codebook:
    """16 centres for each piece: centres[piece, code, width]."""

    def __init__(self, x: np.ndarray, p: AnnParams):
        n, d = x.shape
        self.width, self.d = p.width, d
        self.pieces = -(-d // p.width)
        self.pieces += self.pieces % 2  # an even number, so that two codes fill a byte
        x = self._pad(x)
        # the ratio of the parallel to the orthogonal weight for a score threshold t and d dimensions
        self.eta = max(1.0, (d - 1) * p.threshold**2 / (1 - p.threshold**2))
        rng = np.random.default_rng(5)
        take = np.stack([rng.permutation(n)[np.arange(16) % n] for _ in range(self.pieces)])
        y = x.reshape(n, self.pieces, self.width)
        self.centres = np.stack([y[take[m], m] for m in range(self.pieces)])
        for r in range(p.rounds):
            codes = self.encode(x, sweeps=0 if r < 2 else 1)
            self._refit(x, codes)

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pieces * self.width - x.shape[1])))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, pieces): nearest centres first, then coordinate descent on the anisotropic loss."""
        x = self._pad(x) if x.shape[1] < self.pieces * self.width else x
        n = len(x)
        y = x.reshape(n, self.pieces, self.width)
        unit = y / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = np.empty((n, self.pieces), np.uint8)
        along = np.zeros(n)  # the residual along the vector
        for m in range(self.pieces):
            codes[:, m] = ((y[:, m, None, :] - self.centres[m]) ** 2).sum(axis=2).argmin(axis=1)
            along += ((y[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.pieces):
                gap = y[:, m, None, :] - self.centres[m]
                part = (gap * unit[:, m, None, :]).sum(axis=2)
                here = part[np.arange(n), codes[:, m]]
                loss = (gap**2).sum(axis=2) + (self.eta - 1) * (along[:, None] - here[:, None] + part) ** 2
                codes[:, m] = loss.argmin(axis=1)
                along += part[np.arange(n), codes[:, m]] - here
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres of least anisotropic loss, piece by piece, with the other pieces' codes as they are."""
        n = len(x)
        y = x.reshape(n, self.pieces, self.width)
        unit = y / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        along = sum(((y[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(self.pieces))
        for m in range(self.pieces):
            u = unit[:, m]
            here = ((y[:, m] - self.centres[m][codes[:, m]]) * u).sum(axis=1)
            rest = along - here
            for c in range(16):
                i = np.flatnonzero(codes[:, m] == c)
                if len(i):
                    a = np.eye(self.width) * len(i) + (self.eta - 1) * (u[i].T @ u[i])
                    b = y[i, m].sum(axis=0) + (self.eta - 1) * (u[i] * (rest[i] + (y[i, m] * u[i]).sum(axis=1))[:, None]).sum(axis=0)
                    self.centres[m, c] = np.linalg.solve(a, b)
            along = rest + ((y[:, m] - self.centres[m][codes[:, m]]) * u).sum(axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.pieces), codes].reshape(len(codes), -1)[:, : self.d]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256) products with each pair of centres."""
        q = self._pad(q).reshape(len(q), self.pieces, self.width)
        t = np.einsum("qmw,mcw->qmc", q, self.centres).astype(np.float32)
        low, high = t[:, 0::2], t[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), self.pieces // 2, 256)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added from the first component to the last: equal vectors give equal doubles wherever they stand."""
    return np.cumsum(x * q, axis=1)[:, -1]


def search_piece(ids: np.ndarray, x: np.ndarray, packed: np.ndarray, left: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, book: Codebook, p: AnnParams, tally: dict | None = None):
    """One piece of the index: arrays query_id, vec_id, score, at most k rows a query besides ties of the floor; raises `floor` (a number a query).

    packed: codes, a row a vector; left: lengths of what they leave. tally counts the pairs scanned and those reranked.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, first, same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    u, codes = x[first], np.ascontiguousarray(packed[order][first].T)
    group = np.argsort(same, kind="stable")  # rows by distinct vector, ids ascending within
    begin = np.searchsorted(same[group], np.arange(len(first) + 1))
    count, own = np.diff(begin), np.zeros(len(first), np.int64)
    length = np.linalg.norm(u, axis=1)
    near_enough = (min(1.0, p.deviations / np.sqrt(x.shape[1])) * left[order][first] + 1e-5 * length).astype(np.float32)
    slack = 1e-9 * length.max(initial=0.0)
    norms = np.linalg.norm(q, axis=1)
    own_from, own_to = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, side="right")
    out_q, out_v, out_s = [], [], []
    for i in range(0, len(q), 64):
        part = q[i : i + 64]
        tables = book.tables(part)
        approx = np.zeros((len(part), len(u)), np.float32)
        for b in range(len(codes)):
            approx += tables[:, b].take(codes[b], axis=1)
        for j in range(len(part)):
            at, scanned = i + j, approx[j]
            # rows with the query's own id don't count: vectors that have no others are out before anything is cut
            vector, times = np.unique(same[own_from[at] : own_to[at]], return_counts=True) if own_from[at] < own_to[at] else (group[:0], group[:0])
            scanned[vector[times == count[vector]]] = -np.inf
            least = floor[at]
            if least == -np.inf and len(u) > p.keep >= p.k:
                best = np.argpartition(scanned, len(u) - p.keep)[len(u) - p.keep :]
                best = best[scanned[best] > -np.inf]
                if len(best) >= p.k:
                    least = np.partition(u[best] @ part[j], len(best) - p.k)[len(best) - p.k]
            rank = np.flatnonzero(scanned + np.float32(norms[at]) * near_enough >= least)
            rank = rank[scanned[rank] > -np.inf]
            if tally is not None:
                tally["scanned"], tally["reranked"] = tally.get("scanned", 0) + len(u), tally.get("reranked", 0) + len(rank)
            # a plain product tells which of them can count; only these are multiplied in order
            near = u[rank] @ part[j]
            least = max(least, np.partition(near, len(near) - p.k)[len(near) - p.k]) if len(near) > p.k else least
            rank = rank[near >= least - slack * norms[at]]
            if not len(rank):
                continue
            exact = _products(u[rank], part[j])
            good = rank[np.argsort(-exact, kind="stable")]
            score = -np.sort(-exact, kind="stable")
            # enough distinct vectors for k rows; each gives its k smallest ids at most, besides the query's own
            own[vector] = times
            size = np.minimum(count[good] - own[good], p.k)
            enough = np.searchsorted(np.cumsum(size), p.k) + 1
            enough = np.searchsorted(-score, -score[min(enough, len(score)) - 1], side="right")  # with all that tie with the last
            size += own[good]
            own[vector] = 0
            rows = np.concatenate([group[begin[g] : begin[g] + s] for g, s in zip(good[:enough], size[:enough], strict=True)])
            scores = np.repeat(score[:enough], size[:enough])
            fit = ids[rows] != query_ids[at]
            v, s = ids[rows][fit], scores[fit]
            top = np.lexsort((v, -s))[: p.k]
            if len(top) == p.k:
                floor[at] = max(floor[at], s[top[-1]])
            top = top[s[top] >= floor[at]]
            out_q.append(np.full(len(top), query_ids[at]))
            out_v.append(v[top])
            out_s.append(s[top])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return v.where(finite & F.exists("v", lambda a: a != 0.0))


def indexed(vectors: DataFrame, p: AnnParams) -> tuple[DataFrame, Codebook]:
    """(vec_id, v, code, left), written once, and the centres, of vectors (vec_id, v) of one number of dimensions."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(p.train).collect()  # a bounded sample for the centres
    book = Codebook(np.array([r.v for r in sample]), p)
    shared = spark.sparkContext.broadcast(book)

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            codes = shared.value.encode(x)
            packed, left = shared.value.pack(codes), np.linalg.norm(x - shared.value.decode(codes), axis=1)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), code, pa.array(left)], ["vec_id", "v", "code", "left"])

    coded = vectors.mapInArrow(encode, "vec_id long, v array<double>, code binary, left double")
    return written(coded.repartition(max(1, -(-vectors.count() // p.shard))), "index"), book


def _search(shared, p: AnnParams):
    """Answers a block of queries from the index rows of a task, gathered into pieces of about a shard; floors go on from piece to piece."""

    def run(batches):
        query_ids, q, book = shared.value
        floor, held, size = np.full(len(q), -np.inf), [], 0

        def piece():
            t = pa.Table.from_batches(held).combine_chunks()
            packed = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            found = search_piece(t.column("vec_id").to_numpy(), _matrix(t.column("v")), packed, t.column("left").to_numpy(), query_ids, q, floor, book, p)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= p.shard:
                yield piece()
                held, size = [], 0
        if held:
            yield piece()

    return run


def _blocks(queries: DataFrame, d: int, p: AnnParams):
    """(ids, vectors) of the stated queries, a block at a time on the driver."""
    most, ids, rows = max(1, p.block // d), [], []
    for r in queries.toLocalIterator():
        ids.append(r.vec_id)
        rows.append(r.v)
        if len(ids) == most:
            yield np.array(ids, np.int64), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows)


def nearest(vectors: DataFrame, queries: DataFrame, p: AnnParams = AnnParams()) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors and queries: (vec_id, v) as usable() gives; queries is the stated set."""
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    vectors, queries = written(vectors, "vectors"), written(queries.dropDuplicates(["vec_id", "v"]), "queries")
    at, parts = fresh_path(spark, "found"), 0
    for d in sorted(r.d for r in queries.select(F.size("v").alias("d")).distinct().collect()):  # a row for each number of dimensions
        of = vectors.where(F.size("v") == d)
        if of.isEmpty():
            continue
        index, book = indexed(of, p)
        for ids, q in _blocks(queries.where(F.size("v") == d), d, p):
            shared = spark.sparkContext.broadcast((ids, q, book))
            index.mapInArrow(_search(shared, p), FOUND).write.parquet(f"{at}/{parts}")  # a block's answers: lineage stays short however many blocks there are
            shared.destroy()
            parts += 1
    found = spark.read.schema(FOUND).parquet(*[f"{at}/{i}" for i in range(parts)]) if parts else empty(spark, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def op9_ann(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def brute_force(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> dict[int, list[int]]:
    """The true neighbours, for tests and for measuring recall."""
    out = {}
    for i, v in zip(query_ids, q, strict=True):
        s = (x * v).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


OP9_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM (SELECT DISTINCT * FROM v) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 20
"""
