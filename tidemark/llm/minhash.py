"""MinHash near-duplicates: many universal hash minima, banding, signature check, exact check, components.

1. One pass in Arrow batches finds each whole text's set of distinct word shingles, its size, a 128-bit digest
   of the set, `bands` keys over `rows` minima each, and eight bits of every minimum.
2. Texts with equal sets form a class; one row stands for it, so copies never meet each other.
3. Round one compares each member of a bucket with the bucket's least member only: as many pairs as members.
   Pairs pass the signature check, then the exact check 100 * intersection >= percent * union on full sets.
4. Components of these links. Round two takes the buckets that still hold several components and compares all
   their pairs from different components, in large buckets block by block, so no link that could join two components
   is lost, while a group of a million mutual near-copies costs a million comparisons and not their square.

With 40 bands of 6 rows a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**6)**40 = 5e-6, and a pair
at 0.3 does share one with probability 0.03: passages that many documents share make few needless pairs.

Edges: null and empty texts and texts without words have no shingles, are linked with nothing and stay. Fewer words than
`shingle` make one shingle. Very long texts are signed and compared whole. Rows that repeat a doc_id with equal sets are one class and
share their fate in near_duplicates(); stage() keeps one of them. A null doc_id takes part: components are named by the least non-null
doc_id, or null if there is none. An empty table gives no rows. near_duplicates() ignores other columns; stage() passes them through.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, small, table, written
from tidemark.llm.components import components
from tidemark.llm.textops import NON_SPACE, U64, mix, ngrams, parts, words


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    seed: int = 20_240_601
    slack: float = 0.17
    """How far the share of equal minima may fall short of the similarity: over six standard deviations at 240 minima."""

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and the n+1 places where the sets begin."""
    found = words(column, NON_SPACE)
    h, first = found.hashes(), found.first
    grams = ngrams(h, k)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(ngrams(h[a:b], b - a) + U64(b - a))
        else:
            sets.append(h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def minima(shingles: np.ndarray, cuts: np.ndarray, p: MinHashParams) -> np.ndarray:
    """uint32 minima, a row for each document with shingles."""
    a, b = p.coefficients()
    x = (shingles >> U64(32)).astype(np.uint32)
    starts = cuts[:-1][np.diff(cuts) > 0]
    out = np.empty((len(starts), len(a)), np.uint32)
    if not len(starts):
        return out
    t = np.empty_like(x)
    for i in range(len(a)):
        np.multiply(x, a[i], out=t)
        t += b[i]
        out[:, i] = np.minimum.reduceat(t, starts)
    return out


def _digests(shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    raw = b"".join(blake2b(shingles[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


SIGNED = "uid long, doc_id {id}, mark long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary"


def _sign(p: MinHashParams):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text", 1 << 20):
                shingles, cuts = shingle_sets(part.column("text"), p.shingle)
                size = np.diff(cuts)
                d = _digests(shingles, cuts)
                low = minima(shingles, cuts, p)
                n = len(low)
                keys = np.zeros((n, p.bands), U64) + np.arange(1, p.bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
                for r in range(p.rows):
                    keys = mix(keys ^ low[:, r :: p.rows][:, : p.bands].astype(U64))
                offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, p.bands, 0))]).astype(np.int32)
                sig = (low & np.uint32(255)).astype(np.uint8)
                width = sig.shape[1]
                sig_offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, width, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("uid"), part.column("doc_id"), part.column("mark"), pa.array(size), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())),
                        pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(sig_offsets), pa.py_buffer(np.ascontiguousarray(sig))]),
                    ],
                    ["uid", "doc_id", "mark", "n_shingles", "d1", "d2", "keys", "sig"],
                )

    return run


def _sets(p: MinHashParams):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                shingles, cuts = shingle_sets(part.column("text"), p.shingle)
                d = _digests(shingles, cuts)
                sets = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), sets], ["d1", "d2", "set"])

    return run


def _alike(p: MinHashParams):
    """Keeps the pairs whose signatures agree in enough places."""
    need = (p.percent / 100 - p.slack) * p.bands * p.rows

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                width = p.bands * p.rows
                a, b = (np.frombuffer(batch.column(c).buffers()[2], np.uint8)[batch.column(c).offset * width :][: batch.num_rows * width].reshape(-1, width) for c in ("sa", "sb"))
                keep = np.flatnonzero((a == b).sum(axis=1) >= need)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


def _class_sets(needed: DataFrame, docs: DataFrame, p: MinHashParams, most: int) -> DataFrame:
    """(cid, set) of the classes (cid, d1, d2, least_id), from the whole texts of the documents that stand for them."""
    ids = small(needed.select(F.col("least_id").alias("doc_id")).distinct(), most)
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(p), "d1 long, d2 long, set array<long>").join(small(needed, most), ["d1", "d2"])
    return written(sets.dropDuplicates(["cid"]).select("cid", "set"), "sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: MinHashParams, most: int) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets are similar enough."""
    sig = classes.select("cid", "sig")
    signed = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    close = written(signed.mapInArrow(_alike(p), "a long, b long"), "close")
    needed = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = _class_sets(written(classes.select("cid", "d1", "d2", "least_id").join(needed, "cid", "left_semi"), "needed"), docs, p, most)
    both = close.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("n"))
    return written(both.where(f"100 * cast(n as long) >= {p.percent} * cast(nx + ny - n as long)").select("a", "b"), "links")


def block_links(x: list[np.ndarray], y: list[np.ndarray], percent: int, width: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with 100 * |x[i] & y[j]| >= percent * |x[i] | y[j]|, by products of membership matrices over common elements."""
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    sizes = [np.array([len(s) for s in side], np.float64) for side in (x, y)]
    shared = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(common), width):
        part = common[at : at + width]
        sides = []
        for side in (x, y):
            m = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                k = np.searchsorted(part, s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")])
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                m[i, k[part[np.minimum(k, len(part) - 1)] == s]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    n = shared.astype(np.float64)
    return np.nonzero(100 * n >= percent * (sizes[0][:, None] + sizes[1] - n))


def _block_task(p: MinHashParams):
    def run(rows: pa.Table) -> pa.Table:
        left = np.flatnonzero(rows.column("side").to_numpy() == 0)
        right = np.flatnonzero(rows.column("side").to_numpy() == 1)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            cid, root = rows.column("cid").to_numpy(), rows.column("root").to_numpy()
            sets = rows.column("set").combine_chunks()
            cuts, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            pick = lambda at: [flat[cuts[i] : cuts[i + 1]] for i in at]
            i, j = block_links(pick(left), pick(right), p.percent)
            i, j = left[i], right[j]
            apart = root[i] != root[j]
            a, b = np.minimum(cid[i], cid[j])[apart], np.maximum(cid[i], cid[j])[apart]
        return pa.table({"a": a, "b": b})

    return run


def _between_roots(member: DataFrame, root: DataFrame, tested: DataFrame, classes: DataFrame, docs: DataFrame, p: MinHashParams, most: int, bucket: int, block: int) -> DataFrame:
    """All links between members of one bucket that lie in different components.

    A bucket's largest component is its main one; members of others are strays, and each is compared with the whole
    bucket. In buckets of up to `bucket` members that gives fewer than `bucket` pairs a member, which are listed, made
    distinct and verified. Larger buckets are cut into blocks, strays by members, and each pair of blocks is compared
    in one task that returns links only: rows grow with the number of blocks, not with the number of pairs.
    """
    placed = member.join(root, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("n").alias("n_main")).where("roots > 1")
    mixed = small(written(mixed.select("key", "main", "n", "n_main"), "mixed"), most)
    placed = written(placed.join(mixed, "key"), "placed")
    few = placed.where(F.col("n") <= bucket)
    x, y = few.where("root <> main").select(F.col("key"), F.col("cid").alias("a"), F.col("root").alias("ra"), "main"), few.select("key", F.col("cid").alias("b"), F.col("root").alias("rb"))
    rest = x.join(y, "key").where("ra <> rb and (rb = main or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    links = _verified(rest, classes, docs, p, most)
    many = placed.where(F.col("n") > bucket)
    needed = written(classes.select("cid", "d1", "d2", "least_id").join(many.select("cid").distinct(), "cid", "left_semi"), "needed")
    if needed.isEmpty():
        return links
    # strays and members are dealt into blocks by hash; every stray meets every block of members, every member every block of strays
    strays, members = F.ceil((F.col("n") - F.col("n_main")) / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    at = lambda blocks, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), blocks).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    left = many.where("root <> main").select("key", "cid", "root", F.lit(0).alias("side"), at(strays, 1).alias("i"), all_of(members).alias("j"))
    right = many.select("key", "cid", "root", F.lit(1).alias("side"), at(members, 2).alias("j"), all_of(strays).alias("i"))
    rows = left.unionByName(right).join(_class_sets(needed, docs, p, most), "cid")
    found = rows.groupBy("key", "i", "j").applyInArrow(_block_task(p), "a long, b long")
    return links.union(written(found.distinct(), "links"))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), most: int = 1_000_000, bucket: int = 16, block: int = 256) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept, group) per row of docs (doc_id, text); mark is xxhash64(text), group a number of the
    component, null for texts without words.

    most: rows of a few numbers up to which a side is broadcast; beyond, Spark shuffles it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("uid"))
    signed = marked.mapInArrow(_sign(p), SIGNED.format(id=id_type.simpleString()))
    signed = written(signed, "signed")
    full = signed.where("n_shingles > 0")
    # a class for each distinct set; partial sums take a hot group of copies before the shuffle
    named = written(full.groupBy("d1", "d2").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_id")), "classes")
    classes = written(full.select(F.col("uid").alias("cid"), "keys", "sig").join(named, "cid"), "representatives")
    member = classes.select("cid", F.explode("keys").alias("key"))
    shared = written(member.groupBy("key").agg(F.min("cid").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead"), "shared")
    member = written(member.join(small(shared, most), "key"), "members")
    # round one: each member against its bucket's least
    stars = written(member.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    root = written(components(_verified(stars, classes, docs, p, most).toDF("u", "v")), "roots")
    # round two: buckets that still hold several components; its links join components, so these are its nodes
    more = _between_roots(member.select("key", "cid"), root, stars, classes, docs, p, most, bucket, block)
    of = lambda c, name: F.coalesce(F.col(c), F.col(name))
    joined = more.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
    again = written(components(joined.select(of("ra", "a").alias("u"), of("rb", "b").alias("v"))), "roots")
    owner = named.join(root, F.col("cid") == F.col("node"), "left").select("d1", "d2", "least_id", F.coalesce("root", "cid").alias("first"))
    owner = owner.join(again, F.col("first") == F.col("node"), "left").select("d1", "d2", "least_id", F.coalesce("root", "first").alias("root"))
    least = owner.groupBy("root").agg(F.min("least_id").alias("component_id"))
    owner = written(owner.join(least, "root").select("d1", "d2", "component_id", "root"), "owners")
    alone = signed.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    found = full.join(owner, ["d1", "d2"]).select("doc_id", "mark", "n_shingles", "component_id", F.col("root").alias("group"))
    return found.union(alone).select("doc_id", "mark", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, MinHashParams(shingle=4)).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the least doc_id (nulls last), then of the least hash of its text, and
    one of rows that repeat both. Texts without words stay, each row of them."""
    found = written(near_duplicates(docs).where("group is not null").groupBy("group", "doc_id", "mark").agg(F.count("*").alias("times")), "found")
    name = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    best = found.groupBy("group").agg(F.min(name).alias("best"), F.sum("times").alias("n")).where("n > 1").select("group", "best")
    several = found.join(small(written(best, "best"), 1_000_000), "group").withColumn("is_best", name.eqNullSafe(F.col("best")))
    gone = small(written(several.where("not is_best").select(F.col("doc_id").alias("gone_id"), "mark"), "gone"), 1_000_000)
    twice = small(written(several.where("is_best and times > 1").select(F.col("doc_id").alias("twice_id"), F.col("mark").alias("twice_mark")), "twice"), 1_000_000)
    text = F.xxhash64(docs.text)
    left = docs.join(gone, docs.doc_id.eqNullSafe(gone.gone_id) & (text == gone.mark), "left_anti")
    if twice.isEmpty():
        return left
    same = docs.doc_id.eqNullSafe(twice.twice_id) & (text == twice.twice_mark)
    one = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(one)


OP4_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, row_number() OVER () AS uid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, uid,
         CASE WHEN len(w) = 0 THEN []::VARCHAR[]
              WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM worded),
single AS (SELECT uid, len(s) AS size, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.uid AS a, b.uid AS b, any_value(a.size) AS x, any_value(b.size) AS y, count(*) AS n
  FROM single a JOIN single b ON a.g = b.g AND a.uid < b.uid AND 100 * a.size >= 80 * b.size AND 100 * b.size >= 80 * a.size GROUP BY a.uid, b.uid),
half AS (SELECT a, b FROM shared WHERE 100 * n >= 80 * (x + y - n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT uid AS start, uid AS node FROM sets UNION SELECT start, b FROM reach JOIN links ON a = node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM min(t.doc_id) AS kept
FROM sets s JOIN reach r ON r.start = s.uid JOIN sets t ON t.uid = r.node
GROUP BY s.uid, s.doc_id, s.s
"""
