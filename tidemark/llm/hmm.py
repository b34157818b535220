"""LM scoring: a hidden Markov language model trained by Baum-Welch over partitions, scored by scaled forward recursion.

1. Word counts of all training texts, partially summed in each batch, as a written table (word hash, class of its ending, count).
   Words are known by a 64-bit hash.
2. The `dictionary` most frequent words (a fixed bound) are broadcast. The hidden chain emits classes: the `own` most
   frequent words are classes of their own, the dictionary's others and all rarer words fall into `endings` classes each by
   their last bytes. Within a class a word has its share of the class's tokens. In the rare classes, which hold
   all words seen once, a share `discount` of one count of each word type is set aside for unseen words, so the probabilities of all words and of "an unseen word of this
   ending" add up to one: the model is proper, over a finer set of events than known words and one unknown word.
3. Each text is encoded once as a row of class numbers and written. Rare words' counts are looked up by a join on the
   word's hash, distinct words per document only; no table that grows with the corpus is broadcast.
4. Baum-Welch: each task runs forward and backward over its documents, all documents of a batch in step, and returns one row
   of expected counts; sixteen tasks and then the driver add them up (states * (states + classes) numbers a row). All
   `rounds` run on all training documents, as many for any corpus.
5. Scores: the exact likelihood, by the forward recursion scaled at every token, of whole texts.

Edges: null and empty texts are one end token. Texts of any length are scored whole. Repeated rows count each. If no row may be
trained on, there is no model: score is base_score, which is then 0 for any text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, crc_mod5, table, written
from tidemark.llm.textops import NON_SPACE, U64, mix, parts, words

END_HASH = np.int64(-1)


@dataclass(frozen=True)
class HmmParams:
    states: int = 8
    dictionary: int = 200_000
    own: int = 2048
    endings: int = 64
    rounds: int = 14
    smoothing: float = 0.1
    discount: float = 0.6
    seed: int = 3

    @property
    def classes(self) -> int:
        return self.own + 2 * self.endings


def tokens(column: pa.Array, endings: int):
    """(hash, ending class, n+1 offsets) of all words, each text followed by one end token."""
    found = words(column, NON_SPACE)
    h = found.hashes()
    h[h == U64(0xFFFFFFFFFFFFFFFF)] = 0
    n = len(h)
    tail = np.zeros(n, U64)
    for k in range(1, 4):
        at = found.ends - k
        ok = at >= found.starts
        tail = tail << U64(8) | np.where(ok, found.low[np.maximum(at, 0)] if n else 0, 0).astype(U64)
    tail = (mix(tail + U64(1)) % U64(endings)).astype(np.int16)
    docs = len(found.counts)
    offsets = found.first + np.arange(docs + 1)
    place = np.arange(n) + np.repeat(np.arange(docs), found.counts)
    out = np.full(n + docs, END_HASH)
    out[place] = h.view(np.int64)
    ending = np.zeros(n + docs, np.int16)
    ending[place] = tail
    return out, ending, offsets


def _count(p: HmmParams):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text", 8 << 20):
                h, ending, _ = tokens(part.column("text"), p.endings)
                word, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(ending[first]), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

    return run


class Dictionary:
    """The frequent words: sorted hashes, their counts and classes."""

    def __init__(self, rows: list, p: HmmParams):
        w = np.array([r.word for r in rows], np.int64)
        n = np.array([r.n for r in rows], np.int64)
        kind = p.own + np.array([r.ending for r in rows], np.int64)
        kind[: p.own] = np.arange(min(p.own, len(rows)))  # rows come with the most frequent first
        order = np.argsort(w)
        self.words, self.counts, self.classes = w[order], n[order], kind[order].astype(np.int16)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


ENCODED = "uid long, doc_id {id}, role int, n_tokens long, n_frequent long, frequent_base double, frequent_log double, classes binary, rare array<long>, times array<int>, endings array<int>"


def _encode(p: HmmParams, shared, denominator: float):
    def run(batches):
        d, share = shared.value
        log_base = np.log10((d.counts + 0.5) / denominator)
        log_share = np.log10(np.maximum(d.counts, 1) / share[d.classes])
        for batch in batches:
            for part in parts(batch, "text", 8 << 20):
                h, ending, offsets = tokens(part.column("text"), p.endings)
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                at, known = d.find(h)
                kind = np.where(known, d.classes[at] if len(d.words) else 0, p.own + p.endings + ending).astype("<i2")
                sums = [np.bincount(doc[known], v[at[known]] if v is not None else None, minlength=part.num_rows) for v in (None, log_base, log_share)]
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
                head = np.flatnonzero(fresh)
                times = np.diff(np.append(head, len(order)))
                cuts = pa.array(np.searchsorted(doc[order[head]], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("uid", "doc_id", "role")), pa.array(np.diff(offsets)),
                        pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float)),
                        pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(kind)]),
                        pa.ListArray.from_arrays(cuts, pa.array(h[order[head]])), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(ending[order[head]].astype(np.int32))),
                    ],
                    [x.split(" ")[0] for x in ENCODED.split(", ")],
                )

    return run


class Hmm:
    """start[state], move[state, state], emit[class, state]."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def random(totals: np.ndarray, p: HmmParams) -> Hmm:
        rng = np.random.default_rng(p.seed)
        k = p.states
        emit = (totals + 1e-9)[:, None] * rng.uniform(0.5, 1.5, (len(totals), k))
        move = np.full((k, k), 0.2 / k) + 0.8 * np.eye(k)
        return Hmm(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @staticmethod
    def of(counts: tuple, totals: np.ndarray, p: HmmParams) -> Hmm:
        """From expected counts, smoothed towards the classes' totals."""
        start, move, emit = (c.astype(float) for c in counts)
        prior = (totals + 1e-9) / (totals + 1e-9).sum()
        emit = emit + p.smoothing * len(totals) * prior[:, None]
        move, start = move + p.smoothing, start + p.smoothing
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _in_step(sequences: list[np.ndarray]):
    """Documents by falling length: order, the number that still runs at each step, where each step's tokens begin, tokens step by step, their documents."""
    length = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-length, kind="stable")
    running = len(length) - np.searchsorted(np.sort(length), np.arange(1, length.max(initial=0) + 1))
    begin = np.concatenate([[0], np.cumsum(running)])
    length = length[order]
    flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.zeros(0, np.int16)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    row = np.repeat(np.arange(len(order), dtype=np.int32), length)
    at = begin[step] + row
    symbols, owner = np.empty(len(flat), np.int16), np.empty(len(flat), np.int32)
    symbols[at], owner[at] = flat, order[row]
    return running.tolist(), begin.tolist(), symbols, owner


def _forward(model: Hmm, running: list[int], begin: list[int], symbols: np.ndarray, kind: type):
    """Emissions, scaled forward rows (token by state) and scales, step by step."""
    k, n = len(model.start), len(symbols)
    emitted = np.ascontiguousarray(model.emit, dtype=kind).take(symbols, axis=0)
    alpha, scale = np.empty((n, k), kind), np.empty(n, kind)
    move, start, ones, last = model.move.astype(kind), model.start.astype(kind), np.ones(k, kind), None
    for t, m in enumerate(running):
        at = slice(begin[t], begin[t + 1])
        now = alpha[at]
        if last is None:
            np.multiply(emitted[at], start, out=now)
        else:
            np.matmul(last[:m], move, out=now)
            now *= emitted[at]
        now /= np.matmul(now, ones, out=scale[at])[:, None]
        last = now
    return emitted, alpha, scale


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence, by the forward recursion scaled at every token."""
    running, begin, symbols, owner = _in_step(sequences)
    scale = _forward(model, running, begin, symbols, np.float64)[2]
    return np.bincount(owner, np.log10(scale), minlength=len(sequences))


def expected_counts(model: Hmm, sequences: list[np.ndarray], kind: type = np.float64) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch's E step: (log10 likelihood, start, move, emit) summed over the sequences in double precision.

    kind is the precision of the recursions; every row of theirs is scaled to one, so single precision loses no small sequence.
    """
    running, begin, symbols, _ = _in_step(sequences)
    emitted, gamma, scale = _forward(model, running, begin, symbols, kind)
    k = len(model.start)
    move, back, beta = np.zeros((k, k)), np.ascontiguousarray(model.move.T, dtype=kind), None
    emitted /= scale[:, None]
    for t in range(len(running) - 1, -1, -1):
        now = emitted[begin[t] : begin[t + 1]]  # becomes what the step before needs: emission times backward, over the scale
        if beta is not None:
            m = len(beta)
            here = gamma[begin[t] : begin[t] + m]
            move += here.T @ beta
            b = beta @ back
            here *= b
            now[:m] *= b
        beta = now
    start = gamma[: running[0]].sum(axis=0, dtype=np.float64) if running else np.zeros(k)
    emit = np.stack([np.bincount(symbols, gamma[:, j], minlength=len(model.emit)) for j in range(k)], axis=1)
    return float(np.log10(scale, dtype=np.float64).sum()), start, move * model.move, emit


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2") for x in column.to_pylist()]


def _gathered(batches, most: int):
    """Batches joined until they hold about `most` tokens, so that stepping pays; memory stays bounded."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("classes").nbytes // 2
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _expect(shared, most: int = 1 << 21):
    def run(batches):
        sums = None
        for rows in _gathered(batches, most):
            got = expected_counts(shared.value, _sequences(rows.column("classes")), np.float32)
            sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums[0]]), *(pa.array([x.astype(float).tobytes()], pa.binary()) for x in sums[1:])], ["likelihood", "start", "move", "emit"])

    return run


COUNTS = "likelihood double, start binary, move binary, emit binary"


def _add(batches):
    """Adds rows of expected counts as they stream by: one row a task."""
    sums = None
    for batch in batches:
        for raw in zip(*(batch.column(c).to_pylist() for c in ("likelihood", "start", "move", "emit")), strict=True):
            got = [np.array([raw[0]]), *(np.frombuffer(x) for x in raw[1:])]
            sums = [g.copy() for g in got] if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array(sums[0]), *(pa.array([x.tobytes()], pa.binary()) for x in sums[1:])], ["likelihood", "start", "move", "emit"])


def em_round(encoded: DataFrame, model: Hmm, totals: np.ndarray, p: HmmParams) -> tuple[Hmm, float]:
    """One Baum-Welch round: partitions' expected counts are added in 16 tasks, whose sums the driver adds: as much for any corpus."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # states * (states + classes) numbers
    rows = encoded.select("classes").mapInArrow(_expect(shared), COUNTS).repartition(16).mapInArrow(_add, COUNTS)
    k, c = p.states, p.classes
    sums, likelihood = [np.zeros(k), np.zeros((k, k)), np.zeros((c, k))], 0.0
    for r in rows.collect():
        likelihood += r.likelihood
        for s, raw in zip(sums, (r.start, r.move, r.emit), strict=True):
            s += np.frombuffer(raw).reshape(s.shape)
    shared.destroy()
    return Hmm.of(tuple(sums), totals, p), likelihood


def _score(shared, most: int = 1 << 20):
    def run(batches):
        for rows in _gathered(batches, most):
            got = forward(shared.value, _sequences(rows.column("classes")))
            yield pa.RecordBatch.from_arrays([rows.column("uid").combine_chunks(), pa.array(got)], ["uid", "chain"])

    return run


def score_texts(docs: DataFrame, p: HmmParams = HmmParams()) -> DataFrame:
    """(doc_id, role, n_tokens, n_known, train_tokens, base_score, score); docs: (doc_id, text, role), role 1: not trained on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text", "role")
    train = docs.where("role = 0")
    counts = train.select("text").mapInArrow(_count(p), "word long, ending short, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))
    counts = written(counts, "counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    denominator = total + 0.5 * (types + 1)
    # The dictionary is all words from a count on, the least count (on a scale of 1,024 steps) that leaves `dictionary` words at most.
    # Words seen once stay out: they tell what unseen words are like.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.where("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()  # at most 1,024 rows
    held, lowest = 0, 1 << 20
    for r in steps:
        held += r.words
        if held > p.dictionary:
            break
        lowest = r.step
    often = (F.col("n") > 1) & (step >= lowest)
    frequent = sorted(counts.where(often).collect(), key=lambda r: (-r.n, r.word))  # at most `dictionary` rows
    d = Dictionary(frequent, p)
    # tokens of each class, and word types of the rare ones
    share = np.zeros(p.classes)
    np.add.at(share, d.classes.astype(np.int64), d.counts)
    rare = counts.where(~often)
    kinds = np.zeros(p.endings)
    for r in rare.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # a row per ending
        share[p.own + p.endings + r.ending], kinds[r.ending] = r.n, r.types
    mass = share[p.own + p.endings :]
    no_rare = mass == 0  # the unseen share of an ending without rare words: half a count
    share[p.own + p.endings :][no_rare] = 0.5
    unseen = np.where(no_rare, 1.0, p.discount * kinds / np.maximum(mass, 1))
    shared = spark.sparkContext.broadcast((d, share))
    source = docs.withColumn("uid", F.monotonically_increasing_id())
    schema = ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString())
    encoded = written(source.mapInArrow(_encode(p, shared, denominator), schema), "encoded")
    # Baum-Welch
    learn = encoded.where("role = 0")
    totals = share.copy()
    model = Hmm.random(totals, p)
    for _ in range(p.rounds if total else 0):
        model, _ = em_round(learn, model, totals, p)
    # rare words: counts by a join on the word, summed by document
    looked = encoded.select("uid", F.explode(F.arrays_zip("rare", "times", "endings")).alias("r")).select("uid", "r.rare", "r.times", "r.endings")
    looked = looked.join(counts.select(F.col("word").alias("rare"), "n"), "rare", "left")
    weight = F.element_at(F.array(*[F.lit(float(np.log10(share[p.own + p.endings + i]))) for i in range(p.endings)]), F.col("endings") + 1)
    nothing = F.element_at(F.array(*[F.lit(float(np.log10(unseen[i]))) for i in range(p.endings)]), F.col("endings") + 1)
    n = F.coalesce("n", F.lit(0))
    looked = looked.groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(denominator))).alias("rare_base"),
        F.sum(F.col("times") * F.when(n > 0, F.log10(n - p.discount) - weight).otherwise(nothing)).alias("rare_log"),
    )
    final = spark.sparkContext.broadcast(model)
    chain = encoded.select("uid", "classes").mapInArrow(_score(final), "uid long, chain double")
    rows = encoded.select("uid", "doc_id", "role", "n_tokens", "n_frequent", "frequent_base", "frequent_log").join(chain, "uid").join(looked, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base, own = F.col("frequent_base") + zero("rare_base"), F.col("chain") + F.col("frequent_log") + zero("rare_log")
    return rows.select(
        "doc_id", "role", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (own if total else base).alias("score"),
    )


def op5_hmm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod5(F.col("doc_id")) == 1).cast("int").alias("role"))
    return score_texts(docs).select("doc_id", (F.col("role") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
