"""Benchmark decontamination with suffix arrays of the training text.

The corpus is taken in shards of whole documents (an Arrow batch of a few MB). Each shard's words become integers, with a
stop after each document, and a suffix array of the words is built by prefix doubling, as deep as the longest benchmark
item. Every suffix of every benchmark item is then binary-searched in it, all suffixes at once: word by word each
suffix's interval of the array narrows; where it runs empty the longest verbatim match is known, and any entry of the
last interval is a location of it. The interval at the window's length gives all places of that window.

It is one pass over the corpus without a shuffle. The benchmark is broadcast if it has at most `max_block_words` words;
beyond, it is split into blocks of whole items of about that size, one pass each, and the passes' hits are united by document.

Edges: null and empty texts have no words: no hits, not contaminated. A very long text is a shard of its own, whole: some 60 bytes of
memory a word. Empty tables give no rows and no hits. Items without words match nothing. Items of fewer words
than the window are one window. Repeated rows and repeated items each count; a repeated item_id counts once. A null
item_id never counts as an item, but its words hit. Other columns pass through.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, small, table, written
from tidemark.llm.textops import ALNUM, parts, words

WINDOW = 10


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids (ints >= 0) in order of the suffixes that begin there, by their first `depth` values at least."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    h = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        if j < n:
            key[: n - j] |= ids[j:]
    sa = np.argsort(key)
    group = np.ones(n, bool)  # does an entry of sa begin a group of equal keys?
    ordered = key[sa]
    group[1:] = ordered[1:] != ordered[:-1]
    rank = np.zeros(n + 1, np.int64)  # of a group: 1 + the place of its first entry; 0 beyond the end
    rank[sa] = np.maximum.accumulate(np.where(group, np.arange(1, n + 1), 0))
    while h < depth:
        alone = group.copy()
        alone[:-1] &= group[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        s = sa[tied]
        key = rank[s] << 32 | rank[np.minimum(s + h, n)]
        order = np.argsort(key)
        s, key = s[order], key[order]
        sa[tied] = s
        fresh = np.ones(len(s), bool)
        fresh[1:] = key[1:] != key[:-1]
        group[tied] = fresh
        rank[s] = np.maximum.accumulate(np.where(fresh, tied + 1, 0))
        h *= 2
    return sa


@dataclass
class Tests:
    """Benchmark words: word j belongs to item[j], whose name is names[item[j]]; left[j] words remain from j on."""

    hashes: np.ndarray
    item: np.ndarray
    left: np.ndarray
    window: np.ndarray
    names: list

    @staticmethod
    def of(names: list, texts: list, window: int) -> Tests:
        found = words(pa.array(texts, pa.string()), ALNUM)
        n = found.counts
        item = np.repeat(np.arange(len(n)), n)
        left = np.repeat(found.first[1:], n) - np.arange(len(item))
        return Tests(found.hashes(), item, left, np.minimum(window, np.repeat(n, n)), names)


@dataclass
class Shard:
    """Words of a few documents as integers from 1, a 0 after each document, and their suffix array."""

    known: np.ndarray
    ids: np.ndarray
    sa: np.ndarray
    counts: np.ndarray
    begins: np.ndarray

    @staticmethod
    def of(column: pa.Array, depth: int) -> Shard:
        found = words(column, ALNUM)
        h, n = found.hashes(), found.counts
        order = np.argsort(h)
        ordered = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(fresh)
        ids = np.zeros(len(h) + len(n), np.int64)
        ids[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = number
        return Shard(ordered[fresh], ids, suffix_array(ids, depth), n, found.first[:-1] + np.arange(len(n)))

    def search(self, t: Tests):
        """Longest match and a location of each test suffix; and the array's interval of each that begins a window."""
        n, m = len(self.ids), len(t.hashes)
        at = np.searchsorted(self.known, t.hashes)
        want = np.where(at < len(self.known), at + 1, 0)
        if len(self.known):
            want[self.known[np.minimum(at, len(self.known) - 1)] != t.hashes] = 0
        ends = np.concatenate([np.cumsum(np.bincount(self.ids, minlength=len(self.known) + 1)), [n]])
        low, high = np.where(want > 0, ends[want - 1], 0), np.where(want > 0, ends[want], 0)
        longest, where = np.zeros(m, np.int64), np.full(m, -1)
        wide = np.zeros((m, 2), np.int64)
        live = np.flatnonzero(low < high)
        padded = np.concatenate([self.ids, [0]])
        depth = 1
        while len(live):
            longest[live], where[live] = depth, self.sa[low[live]]
            full = live[t.window[live] == depth]
            wide[full, 0], wide[full, 1] = low[full], high[full]
            live = live[t.left[live] > depth]
            target = want[live + depth]
            live, target = live[target > 0], target[target > 0]
            for bound, value in ((low, target), (high, target + 1)):
                a, b = low[live].copy(), high[live].copy()
                while len(open_ := np.flatnonzero(a < b)):
                    mid = (a[open_] + b[open_]) >> 1
                    less = padded[np.minimum(self.sa[mid] + depth, n)] < value[open_]
                    a[open_[less]] = mid[less] + 1
                    b[open_[~less]] = mid[~less]
                if bound is low:
                    first = a
                else:
                    low[live], high[live] = first, a
            live = live[low[live] < high[live]]
            depth += 1
        return longest, where, wide

    def hits(self, t: Tests):
        """Which words lie in an occurrence of a window, and the distinct (document, item) pairs."""
        _, _, wide = self.search(t)
        size = wide[:, 1] - wide[:, 0]
        source = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)
        place = self.sa[wide[source, 0] + offset]
        n = len(self.ids)
        edge = np.bincount(place, minlength=n + 1) - np.bincount(place + t.window[source], minlength=n + 1)
        doc = np.searchsorted(self.begins, place, side="right") - 1
        return np.cumsum(edge[:n]) > 0, np.unique(doc * len(t.names) + t.item[source])


def _hits(shared, depth: int):
    """Adds to each row its number of words, the hit words' places and the items found."""

    def run(batches):
        t = shared.value
        for batch in batches:
            for part in parts(batch, "text"):
                shard = Shard.of(part.column("text"), depth)
                hit, pairs = shard.hits(t)
                at = np.flatnonzero(hit)
                doc = np.searchsorted(shard.begins, at, side="right") - 1
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(cuts), pa.array(at - shard.begins[doc]))
                cuts = np.searchsorted(pairs // max(1, len(t.names)), np.arange(part.num_rows + 1)).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(cuts), pa.array([t.names[i % len(t.names)] for i in pairs.tolist()], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(shard.counts), places, items], ["doc_id", "mark", "n_words", "places", "items"])

    return run


def _matches(shared, depth: int, least: int):
    """The longest match in each shard of each test suffix, where it has `least` words or more and can't be begun earlier."""

    def run(batches):
        t = shared.value
        for batch in batches:
            for part in parts(batch, "text"):
                shard = Shard.of(part.column("text"), depth)
                longest, where, _ = shard.search(t)
                inner = np.zeros(len(longest), bool)
                inner[1:] = (longest[:-1] == longest[1:] + 1) & (t.item[1:] == t.item[:-1])
                j = np.flatnonzero((longest >= least) & ~inner)
                doc = np.searchsorted(shard.begins, where[j], side="right") - 1
                first = np.concatenate([[0], np.flatnonzero(np.diff(t.item)) + 1]) if len(t.item) else np.zeros(0, np.int64)
                begin = first[np.searchsorted(first, j, side="right") - 1] if len(j) else j
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t.names[i] for i in t.item[j].tolist()], pa.string()), pa.array(j - begin), part.column("doc_id").take(pa.array(doc)), pa.array(where[j] - shard.begins[doc]), pa.array(longest[j])],
                    ["item_id", "item_word", "doc_id", "doc_word", "length"],
                )

    return run


def _blocks(benchmark: DataFrame, window: int, most: int):
    """Blocks of whole items with about `most` words each, one at a time on the driver."""
    rows = benchmark.where("text is not null and text <> ''").select(F.col("item_id").cast("string"), "text")
    names, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        names.append(r.item_id)
        texts.append(r.text)
        size += len(r.text) // 2 + 1
        if size >= most:
            yield Tests.of(names, texts, window)
            names, texts, size = [], [], 0
    yield Tests.of(names, texts, window)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, items) per row of docs; items are the sorted distinct ids as strings; mark is xxhash64(text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, n_words long, places array<long>, items array<string>"
    passes = []
    for t in _blocks(benchmark, window, max_block_words):
        found = _marked(docs).mapInArrow(_hits(spark.sparkContext.broadcast(t), int(t.left.max(initial=1))), schema)
        passes.append(found)
    united = passes[0]
    if len(passes) > 1:
        # rows that repeat a doc_id and text have the same hits: each pass's hits are kept once, gathered by document, and joined to all rows once
        passes = [written(p, "hits") for p in passes]
        found = [p.where("size(places) > 0").dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", "places", "items") for p in passes]
        together = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  a block's hits each
        hits = functools.reduce(DataFrame.union, found).groupBy("doc_id", "mark").agg(together("places").alias("places"), together("items").alias("items"))
        hits = hits.toDF("id2", "mark2", "places", "items")
        every = passes[0].select("doc_id", "mark", "n_words")
        united = every.join(hits, every.doc_id.eqNullSafe(hits.id2) & every.mark.eqNullSafe(hits.mark2), "left")
        nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        united = united.select("doc_id", "mark", "n_words", nothing("places", "array<long>"), nothing("items", "array<string>"))
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    return united.select("doc_id", "mark", "n_words", F.size("places").cast("long").alias("n_hit"), items.alias("items"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, max_block_words: int = 2_000_000) -> DataFrame:
    """(item_id, item_word, doc_id, doc_word, length): per shard the longest verbatim match of each benchmark suffix and a location."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = f"item_id string, item_word long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_word long, length long"
    found = [docs.select("doc_id", "text").mapInArrow(_matches(spark.sparkContext.broadcast(t), int(t.left.max(initial=1)), least), schema) for t in _blocks(benchmark, least, max_block_words)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a window of a benchmark item."""
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    gone = written(found.where("n_hit > 0").select(F.col("doc_id").alias("gone_id"), "mark").distinct(), "leaks")
    gone = small(gone, 1_000_000)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.gone_id) & (F.xxhash64(docs.text) == gone.mark), "left_anti")


OP10_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS size FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT uid, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT uid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, lengths)),
found AS (SELECT uid, i, p.size, item_id FROM place p JOIN win USING (g, size)),
words AS (SELECT uid, count(DISTINCT k) AS n_hit FROM (SELECT uid, unnest(range(i, i + size)) AS k FROM found) GROUP BY uid),
items AS (
  SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT uid, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""
