"""Brute force for the operators on documents: awkward tables, empty tables, clashing columns."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import decontaminate, hmm, licenses, minhash, mixing, textops, token_counts, toxicity
from tidemark.llm.components import components

BENCH = [(1, "w1 w2"), (2, None), (3, ""), (4, "one two three"), (5, " ".join(f"w{i}" for i in range(25))), (None, "emoji 🙂 text"), (1, "licensed under the mit license")]


@pytest.fixture(scope="module")
def docs(spark):
    return H.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("kind,pattern", [(textops.NON_SPACE, H.SPACED), (textops.ALNUM, H.WORDS)])
def test_words_and_hashes(kind, pattern):
    texts = H.awkward_texts()
    found = textops.words(pa.array(texts), kind)
    h = found.hashes()
    seen = {}
    for d, t in enumerate(texts):
        mine = [bytes(found.low[a:b]).decode() for a, b in zip(found.starts[found.first[d] : found.first[d + 1]], found.ends[found.first[d] : found.first[d + 1]], strict=True)]
        assert mine == H.lower_words(t, pattern)
        for w, x in zip(mine, h[found.first[d] : found.first[d + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_parts_cover_a_sliced_batch():
    batch = pa.RecordBatch.from_pydict({"text": H.awkward_texts()}).slice(3, 20)
    got = [x for p in textops.parts(batch, "text", 300) for x in p.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()


def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = H.lower_words(t, H.SPACED)
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and (least[find(i)] is None or d < least[find(i)]):
            least[find(i)] = d
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("bucket", [16, 1])
def test_near_duplicates(docs, bucket):
    got = minhash.near_duplicates(docs, minhash.MinHashParams(shingle=4), bucket=bucket, block=2).collect()
    want = brute_components(texts_of(docs), 4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_chain_group(spark):
    """A group of near copies that link with some of each other only: no link may be lost to stars or blocks."""
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rng.choice(80, rng.integers(0, 5), replace=False):
            w[i] = f"m{rng.integers(10**6)}"
        texts.append(" ".join(w))
    docs = H.documents(spark, texts, extra=False)
    want = sorted(brute_components(texts_of(docs), 4), key=repr)
    for bucket, block in ((1000, 256), (4, 7)):
        got = minhash.near_duplicates(docs, minhash.MinHashParams(shingle=4), bucket=bucket, block=block)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == want


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    """Null ids, ids on several near copies and rows that repeat both: one row of each group stays, texts without words stay all."""
    base = [f"t{i}" for i in range(60)]
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (3, 20, 59)]
    far = " ".join(f"n{i}" for i in range(40))
    rows = [(5, near[0]), (5, near[1]), (5, near[1]), (None, near[2]), (9, " ".join(base)), *[(None, far)] * 4, (None, far + " more"), (7, "alone in the world"), (7, "alone in the world"), (None, None), (None, None), (1, ""), (1, "")]
    docs = H.documents(spark, [], extra=False).sparkSession.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], H.DOCS).withColumn("mark", F.lit("kept as it is")).repartition(4)
    got = minhash.stage(spark, docs, None)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    mark = {t: docs.where(F.col("text") == t).select(F.xxhash64("text")).first()[0] for t in (near[0], near[1], far, far + " more")}
    want = [(5, min(near[:2], key=mark.get)), (None, min((far, far + " more"), key=mark.get)), (7, "alone in the world"), (None, None), (None, None), (1, ""), (1, "")]
    assert left == sorted(want, key=repr)


def test_block_links_match_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))) for _ in range(30)]
    i, j = minhash.block_links(sets[:12], sets[12:], 50, width=7)
    want = {(a, b) for a in range(12) for b in range(18) if 100 * len(set(sets[a]) & set(sets[12 + b])) >= 50 * len(set(sets[a]) | set(sets[12 + b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(29, 50), (60, 61)]])
def test_components(spark, edges):
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, {a}), parent.setdefault(b, {b})
            both = parent[a] | parent[b]
            for x in both:
                parent[x] = both
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in got.collect()} == {(x, min(g)) for x, g in parent.items()}


def brute_hits(text, items, window=10):
    w = H.lower_words(text, H.WORDS)
    hit, found = set(), set()
    for item, t in items:
        v = H.lower_words(t, H.WORDS)
        size = min(window, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_benchmark_hits(docs, bench, block):
    got = decontaminate.benchmark_hits(docs, bench, max_block_words=block).collect()
    short = [(d, t) for d, t in texts_of(docs) if len(t or "") < 50_000]
    want = sorted(((d, *brute_hits(t, BENCH)) for d, t in short), key=repr)
    mine = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got if r.n_words < 20_000), key=repr)
    assert mine == want and len(got) == docs.count()


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(1)
    for n, high in ((0, 1), (1, 1), (50, 2), (300, 5), (200, 1), (100, 1 << 40)):
        ids = rng.integers(1, high + 1, n)
        sa = decontaminate.suffix_array(ids, n + 1)
        assert [ids[i:].tolist() for i in sa] == sorted(ids[i:].tolist() for i in range(n))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g x"), (8, "q c d e f g h")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "z b c d e f g h y")], "item_id long, text string")
    got = {(r.item_word, r.doc_id, r.doc_word, r.length) for r in decontaminate.longest_matches(docs, bench, least=3).collect()}
    assert got == {(1, 7, 1, 6), (2, 8, 1, 6)}


def brute_taken_ok(rows, epochs=3):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    caps = {s: epochs * sum(r.size for r in g) for s, g in by.items()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    clamped = set()
    while True:
        rest = total - sum(caps[s] for s in clamped)
        open_ = [s for s in by if s not in clamped]
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > caps[s]}
        if not over:
            break
        clamped |= over
    for s, g in by.items():
        target = caps[s] if s in clamped else rest * weight[s] / w
        assert all(math.isclose(r.target, target, rel_tol=1e-12) and r.source_size * epochs == caps[s] for r in g)
        assert sum(r.taken for r in g) == math.floor(target + 1e-9)
    assert all(0 <= r.taken <= epochs * r.size for r in rows)


def test_mixing(docs):
    got = mixing.mixed(docs.select("doc_id", "text", "source", "size", "mark")).collect()
    assert all(r.size == len(H.lower_words(r.text, H.SPACED)) and r.mark == "kept as it is" for r in got)
    brute_taken_ok(got)
    brute_taken_ok(mixing.mixed_sizes(docs).collect())
    again = mixing.mixed(docs.repartition(7).select("doc_id", "text", "source")).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)


def test_mixing_of_hot_ids(spark):
    """Half of all rows repeat one id: their words are taken one after the other, and reruns agree."""
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.lit("a").alias("source"))
    rest = spark.range(10, 3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5).cast("int")).alias("text"), F.when(F.col("id") % 7 > 1, "a").when(F.col("id") % 7 == 1, "b").alias("source"))
    got = [mixing.mixed_sizes(hot.union(rest).repartition(n)).collect() for n in (3, 8)]
    brute_taken_ok(got[0])
    assert sorted(got[0], key=repr) == sorted(got[1], key=repr)


def test_mixing_plan_is_native(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def brute_licenses(text):
    w = H.lower_words(text, H.WORDS)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(docs):
    got = licenses.scan(docs).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.mark == "kept as it is"
    assert "gpl-2-or-later" in {x for r in got for x in r.labels.split(",")}
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_license_rules_match_python(spark):
    """Places and suppression of all rules, against Python's regular expressions."""
    import re

    texts = ["GNU Lesser General Public License v2.1 or later; Apache License, Version 2.0", "BSD 3-Clause License. BSD license", "MIT License mit license", "creative commons attribution sharealike 4.0 international license"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        n = " " + " ".join(H.lower_words(r.text, H.WORDS)) + " "
        hits = [(n[: m.start()].count(" ") - 1, n[: m.end()].count(" ") - 1, i, x) for i, x in enumerate(licenses.rules()) if f" {x.keyword}" in n for m in re.finditer(f"(?<= ){x.pattern}(?= )", n)]
        own = [h for h in hits if h[3].priority < 9]

        def beaten(x, own=own):
            return any(
                y[0] <= x[0] and y[1] >= x[1] and (y[3].priority > x[3].priority or y[3].priority == x[3].priority and (y[1] - y[0] > x[1] - x[0] or (y[:2] == x[:2] and y[2] < x[2]))) for y in own
            )

        want = {h[3].label for h in hits if h[3].priority == 9} | {h[3].label for h in own if not beaten(h)}
        assert set(r.labels.split(",")) == want


def test_licenses_in_a_text_of_many_hits(spark):
    """Thousands of hits in one text: the work doesn't grow with their pairs."""
    import time

    def took(n):
        df = spark.createDataFrame([(1, "gpl v2 x mit license y apache license version 2.0 " * n)], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = licenses.scan(df).collect()
        assert r.n_base == 2 * n and r.last_word == 11 * n - 5 and set(r.labels.split(",")) == {"apache", "apache-2.0", "gpl-2", "mit"}
        return time.perf_counter() - began

    took(10)
    assert took(20_000) < 20


def test_license_rules_without_the_gate(spark):
    """Every rule's pattern counts, whatever other words the text holds; holders' names may be of any length."""
    import re

    clause = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products."
    texts = [clause.format("the holder"), clause.format("holder " * 40), "CC Zero 1.0", "Creative Commons Zero v1.0 universal", "CC0 1.0", "MIT License"]
    want = ["bsd-3-clause"] * 2 + ["cc0-1.0"] * 3
    got = [r.labels.split(",") for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(w in g for w, g in zip(want, got))
    for text, labels in zip(texts, got, strict=True):
        n = " " + " ".join(H.lower_words(text, H.WORDS)) + " "
        top = max((x.priority for x in licenses.rules() if x.priority < 9 and re.search(f"(?<= ){x.pattern}(?= )", n)), default=0)
        assert {x.label for x in licenses.rules() if x.priority == top and re.search(f"(?<= ){x.pattern}(?= )", n)} & set(labels)


def test_toxicity(spark, docs, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 4 == 0
        if bad:
            w[rng.integers(40)] = "Awful"
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    seen = df.where(toxicity.crc_mod5(F.col("doc_id")) != 0).select("doc_id", "label")
    model = toxicity.fit(df, seen.union(seen.limit(5)).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, label int")))
    got = toxicity.score(df, model).where(toxicity.crc_mod5(F.col("doc_id")) == 0).collect()
    assert len(got) > 40 and all((r.toxicity >= 0.5) == bool(r.label) for r in got)
    scored = toxicity.score(docs.drop("score"), model, column="score").collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.mark == "kept as it is" for r in scored)
    assert toxicity.fit(df, seen) == toxicity.fit(df.repartition(5), seen)
    none = toxicity.fit(df, seen.where("false"))
    assert {r.toxicity < 0.5 for r in toxicity.score(df, none).collect()} == {True}


def plain_ftrl(rows, p, weight):
    """Per-coordinate FTRL-proximal one feature at a time: rows (features, label) in order of learning; weights that aren't zero."""
    z, n, bias = defaultdict(float), defaultdict(float), 1 << p.bits

    def w(i):
        l1 = 0.0 if i == bias else p.l1_pairs if i < (1 << p.bits) // 2 else p.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for features, label in rows:
        at = [*features, bias]
        score = 1 / (1 + math.exp(-sum(w(i) for i in at)))
        g = (score - label) * (weight if label else 1.0)
        for i, old in [(i, w(i)) for i in at]:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * old
            n[i] += g * g
    return {i: w(i) for i in n if w(i)}


def test_toxicity_weights_match_plain_ftrl(spark):
    """fit() against a twin on plain numbers: features from plain words, rows in the documented order."""
    rng = np.random.default_rng(8)
    p = toxicity.FtrlParams(bits=14, epochs=2, l1=0.5, l1_pairs=0.7)
    texts = {i: " ".join(["vile"] * (i % 3 == 0) + [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 12))]) for i in range(60)}
    df = spark.createDataFrame([(i, t, int(i % 3 == 0)) for i, t in texts.items()] + [(5, "another row of an id", 0)], "doc_id long, text string, label int").repartition(4)
    got = toxicity.fit(df, df.select("doc_id", "label"), p)

    def features(text):
        w = H.lower_words(text, H.WORDS)
        h = textops.words(pa.array([text]), textops.ALNUM).hashes()
        assert len(h) == len(w)
        word, shift = textops.U64(1 << (p.bits - 1)), textops.U64(65 - p.bits)
        one = [int(textops.mix(h[i : i + 1] ^ toxicity.KINDS["word"])[0] >> shift | word) for i in range(len(h))]
        two = [int(textops.mix(textops.ngrams(h[i : i + 2], 2) ^ toxicity.KINDS["pair"])[0] >> shift) for i in range(len(h) - 1)]
        skip = [int(textops.mix(h[i : i + 1] * toxicity.KINDS["skip"] + h[i + 2 : i + 3])[0] >> shift) for i in range(len(h) - 2)]
        return sorted({*one, *two, *skip})

    packed = lambda f: np.array(f, "<i4").tobytes()
    place = {r.doc_id: r.place for r in df.select("doc_id", F.xxhash64("doc_id").alias("place")).collect()}
    by_id = {i: min((features(t) for t in [texts[i]] + ["another row of an id"] * (i == 5)), key=packed) for i in texts}
    rows = [(by_id[i], int(i % 3 == 0)) for i in sorted(texts, key=place.get)]
    order = np.random.default_rng(1)
    learnt = [rows[i] for _ in range(p.epochs) for i in order.permutation(len(rows))]
    toxic = sum(x for _, x in rows)
    want = plain_ftrl(learnt, p, min(p.positive, max(1.0, (len(rows) - toxic) / max(1, toxic) / 2)))
    assert got.keys() == want.keys() and len(want) > 20
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_toxicity_learns_one_row_of_an_id(spark):
    """An id with a hot share of all rows is one row of the training task."""
    hot = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("awful text again").alias("text"))
    rest = spark.range(100, 130).select(F.col("id").alias("doc_id"), F.concat(F.lit("fine text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1), *((i, 0) for i in range(100, 130))], "doc_id long, label int")
    p = toxicity.FtrlParams(l1=0.1, l1_pairs=0.1)
    one = rest.union(hot.limit(1))
    assert toxicity.fit(rest.union(hot), labels, p) == toxicity.fit(one, labels, p)


def brute_forward(model, seq):
    """Sum over all paths of states."""
    from itertools import product

    k, total = len(model.start), 0.0
    for path in product(range(k), repeat=len(seq)):
        p = model.start[path[0]]
        for t, s in enumerate(path):
            p *= (model.move[path[t - 1], s] if t else 1) * model.emit[seq[t], s]
        total += p
    return math.log10(total)


def small_model(k=3, c=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((c, k)), 0))


def test_forward_is_exact():
    model, rng = small_model(), np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n).astype(np.int16) for n in (1, 6, 3, 5, 1)]
    assert np.allclose(hmm.forward(model, seqs), [brute_forward(model, s) for s in seqs])


def test_expected_counts_and_training():
    model, rng = small_model(), np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n).astype(np.int16) for n in (7, 4, 1, 9)]
    total, start, move, emit = hmm.expected_counts(model, seqs)
    for a, b in zip((total, start, move, emit), hmm.expected_counts(model, seqs, np.float32), strict=True):
        assert np.allclose(a, b, rtol=1e-5)
    assert math.isclose(start.sum(), 4) and math.isclose(move.sum(), 17) and math.isclose(emit.sum(), 21)
    assert np.allclose(emit.sum(axis=1), np.bincount(np.concatenate(seqs), minlength=5))
    # the gradient of the likelihood in one parameter equals its expected count over the parameter
    e = 1e-6
    changed = hmm.Hmm(model.start, model.move.copy(), model.emit)
    changed.move[0, 1] += e
    slope = (hmm.forward(changed, seqs).sum() - total) * math.log(10) / e
    assert math.isclose(slope, move[0, 1] / model.move[0, 1], rel_tol=1e-3)
    for _ in range(5):
        p = hmm.HmmParams(smoothing=0.0)
        model = hmm.Hmm.of((start, move, emit), np.ones(5), p)
        again, start, move, emit = hmm.expected_counts(model, seqs)
        assert again >= total - 1e-9
        total = again


@pytest.mark.parametrize("dictionary", [200_000, 20])
def test_lm_scores(docs, dictionary):
    p = hmm.HmmParams(states=3, dictionary=dictionary, own=16, endings=4, rounds=4)
    role = (hmm.crc_mod5(F.col("doc_id")) == 1).cast("int")
    got = hmm.score_texts(docs.withColumn("role", role).withColumns({c: F.lit("clash") for c in ("n", "word", "rare", "classes", "chain", "place")}), p).collect()
    n, want = H.base_scores(texts_of(docs))
    key = lambda r: (repr(r[0]), r[1], round(r[3], 6))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)


def test_hmm_trains_on_all_documents_in_every_round(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(hmm, "em_round", lambda encoded, model, totals, p: (seen.append(encoded.count()), (model, 0.0))[1])
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b w"), F.col("id") % 7).alias("text"), (F.col("id") % 5 == 1).cast("int").alias("role"))
    assert hmm.score_texts(docs.union(docs.select(F.col("doc_id") + 2500, "text", "role"))).count() == 5000
    assert seen == [4000] * 14


def trained(monkeypatch):
    """Keeps the model of the last round."""
    kept, once = [], hmm.em_round
    monkeypatch.setattr(hmm, "em_round", lambda *a: (kept.append(found := once(*a)), found)[1])
    return lambda: kept[-1][0]


def language(train, p):
    """The classes and shares of op5's model in plain Python: word (None: end) -> class and log10 of its share; unseen words by their ending."""
    c = Counter()
    for t in train:
        c.update([*lower(t), None])
    hashed, ending = {}, {}

    def told(word):
        h, e, _ = hmm.tokens(pa.array([word or ""]), p.endings)
        hashed[word], ending[word] = int(h[0]), int(e[0])

    for w in c:
        told(w)
    order = sorted((w for w in c if c[w] > 1), key=lambda w: (-c[w], hashed[w]))
    kind = {w: i if i < p.own else p.own + ending[w] for i, w in enumerate(order)}
    kind |= {w: p.own + p.endings + ending[w] for w in c if c[w] == 1}
    mass = Counter()
    for w in c:
        mass[kind[w]] += c[w]
    types = Counter(ending[w] for w in c if c[w] == 1)

    def of(word):
        if word not in ending:
            told(word)
        if c[word] > 1:
            return kind[word], math.log10(c[word] / mass[kind[word]])
        at = p.own + p.endings + ending[word]
        if c[word] == 1:
            return at, math.log10((1 - p.discount) / mass[at])
        return at, math.log10(p.discount * types[ending[word]] / mass[at]) if mass[at] else 0.0

    return c, of


def lower(text):
    return H.lower_words(text, H.SPACED)


def test_lm_scores_match_paths(spark, monkeypatch):
    """Whole scores against sums over all paths of states, with classes and shares from plain counts."""
    train = ["aa bb cc aa", "bb aa dd", "ee aa ff gg", "aa", "hh bb ee", None, "Aa ii dd"]
    tests = ["aa bb", "zz aa", "gg zzz yy", "", None, "cc ee cc bb", "xxyy"]
    rows = [(i, t, 0) for i, t in enumerate(train)] + [(100 + i, t, 1) for i, t in enumerate(tests)]
    p = hmm.HmmParams(states=2, own=3, endings=3, rounds=3)
    model = trained(monkeypatch)
    got = {r.doc_id: r.score for r in hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, role int"), p).collect()}
    _, of = language(train, p)
    for i, t, _ in rows:
        said = [of(w) for w in [*lower(t), None]]
        assert math.isclose(got[i], brute_forward(model(), [k for k, _ in said]) + sum(s for _, s in said), rel_tol=1e-9)


def test_lm_probabilities_add_up(spark, monkeypatch):
    """First tokens: every known word, the end, and an unseen word of each ending; their chances before an end add up to the chance that the second token is an end."""
    train = ["aa bb cc aa", "bb aa dd", "ee aa ff gg", "aa", "hh bb ee"]
    p = hmm.HmmParams(states=2, own=2, endings=2, rounds=3)
    model = trained(monkeypatch)
    c, of = language(train, p)
    unseen = {}
    for i in range(200):
        unseen.setdefault(of(f"q{i}")[0], f"q{i}")
    assert len(unseen) == p.endings
    probes = [w for w in c if w is not None] + list(unseen.values())
    rows = [(i, t, 0) for i, t in enumerate(train)] + [(100 + i, w, 1) for i, w in enumerate(probes)]
    total = sum(10**r.score for r in hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, role int"), p).where("role = 1").collect())
    m, (end, share) = model(), of(None)
    twice = 10 ** (2 * share) * ((m.start * m.emit[end]) @ m.move @ m.emit[end])
    assert math.isclose(total + twice, 10**share * (m.start @ m.move @ m.emit[end]), rel_tol=1e-9)


def test_lm_without_training_rows(spark):
    got = hmm.score_texts(spark.createDataFrame([(1, "a b", 1), (2, None, 1)], "doc_id long, text string, role int")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = defaultdict(int)
    lengths = []
    for _, text in texts_of(docs):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want[n] += 1
        lengths.append(n)
    histogram = token_counts.length_histogram(docs)
    assert {r.length: r.documents for r in histogram.collect()} == dict(want)
    sums = token_counts.suffix_sums(histogram).cache()
    for r in sums.collect():
        assert r.documents_from == sum(n >= r.length for n in lengths) and r.documents_upto == sum(n <= r.length for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= r.length) and r.tokens_total == sum(lengths)
        assert r.truncated == sum(min(n, r.length) for n in lengths)
    for r in token_counts.limits(sums, [0, 1, 50, 77, 10**6]).collect():
        assert r.truncated == sum(min(n, r.context) for n in lengths) and r.fitting == sum(n <= r.context for n in lengths)
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]


def test_long_white_space():
    encoder, split = token_counts._encoder(None, None)
    text = "a" + " " * 20_000 + "b" + "\n" * 15_000
    assert token_counts.encoded_length(text, encoder, split) == len(encoder.encode_ordinary("a" + " " * 20_000 + "b")) + len(encoder.encode_ordinary("\n" * 15_000))
    assert token_counts.encoded_length(" " * 600_000, encoder, split) > 0


def test_empty_tables(spark, empty, bench):
    assert minhash.near_duplicates(empty).count() == 0
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    assert decontaminate.benchmark_hits(H.documents(spark), bench.where("false")).where("n_hit > 0").count() == 0
    assert mixing.mixed(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert hmm.score_texts(empty.withColumn("role", F.lit(0))).count() == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0
    assert toxicity.score(empty, {}).count() == 0
