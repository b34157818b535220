"""Round trips and brute force for archives, conversations, vectors and the pipeline."""

import base64
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import ann, chat, warc
from tidemark.llm.common import fresh_path

PAGES = [
    (3, "http://a/b c\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n\r\n"),
    (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n\r\n"), (None, "u", "<p>é</p>"), (9, "u", "y" * 3_000_000),
]


@pytest.mark.parametrize("gz", [False, True])
def test_warc_round_trip(spark, tmp_path, gz):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = fresh_path(spark, "warc")
    warc.write_warc(pages, path, per_file=2)
    if gz:
        import gzip

        for f in os.listdir(path.removeprefix("file://")):
            if f.startswith("part"):
                raw = open(f"{path.removeprefix('file://')}/{f}", "rb").read()
                half = len(raw) // 2
                (tmp_path / f"{f}.gz").write_bytes(gzip.compress(raw[:half]) + gzip.compress(raw[half:]))
        path = str(tmp_path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    left = sorted(PAGES, key=lambda p: (str(p[0]), len(p[2] or "")))
    for r, (i, _, h) in zip(sorted(got, key=lambda r: (r.record_id.removeprefix(warc.URN).replace("null", "None"), r.payload_bytes)), left, strict=True):
        raw = (h or "").encode()
        assert r.record_id == warc.URN + ("null" if i is None else str(i))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.payload_bytes == len(raw)
        response = first[h or ""] == i
        assert r.record_type == ("response" if response else "revisit")
        assert r.payload == (bytearray(raw) if response else None)
        assert r.refers_to == (None if response else f"{warc.URN}{first[h or '']}")


def test_warc_pushes_predicates(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    all_ = warc.read_warc(spark, path)
    some = all_.where(F.col("record_type").isin("revisit") & (F.col("payload_bytes") > 0))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "record_type" not in plan.split("BatchScan")[0].split("Filter")[1]
    assert some.count() == 2
    assert all_.where("record_type = 'none'").count() == 0
    assert all_.where("refers_to is null").count() == 5
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0


def test_warc_empty_and_cut(spark, tmp_path):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100\r\n\r\nshort")
    for payload in (True, False):
        with pytest.raises(Exception, match="ends within"):
            warc.read_warc(spark, str(tmp_path), payload).collect()
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, str(tmp_path)).where("record_type = 'none'").collect()


def test_warc_cut_anywhere_is_an_error(spark, tmp_path):
    """A whole archive cut at any place within its last record fails on every path; what is after the last payload may be missing."""
    pages = spark.createDataFrame([(1, "u", "first"), (2, "u", "second " * 9)], "page_id long, url string, html string").coalesce(1)
    pages = pages.withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit(0)).withColumn("payload", F.lit("clash")).withColumn("first", F.lit(1))
    path = fresh_path(spark, "warc").removeprefix("file://")
    warc.write_warc(pages, f"file://{path}")
    (name,) = [f for f in os.listdir(path) if f.startswith("part")]
    raw = open(f"{path}/{name}", "rb").read()
    last = raw.rindex(b"WARC/1.1")
    for end in (last + 30, len(raw) - 40, len(raw) - 5):
        (tmp_path / "y.warc").write_bytes(raw[:end])
        for payload in (True, False):
            reader = warc.WarcReader({"path": str(tmp_path / "y.warc"), "payload": str(payload)})
            with pytest.raises(ValueError, match="ends within"):
                [list(reader.read(x)) for x in reader.partitions()]
    (tmp_path / "y.warc").write_bytes(raw)
    for payload in (True, False):
        got = warc.read_warc(spark, str(tmp_path / "y.warc"), payload).collect()
        assert [r.payload_bytes for r in got] == [5, 63] and [r.payload is not None for r in got] == [payload] * 2


def test_warc_query_reads_payloads(spark, tmp_path, monkeypatch):
    """Bytes changed in the archive between writing and reading show in the query's size and digest."""
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    write = warc.write_warc

    def tampered(pages, path):
        write(pages.coalesce(1), path)
        folder = path.removeprefix("file://")
        (name,) = [f for f in os.listdir(folder) if f.startswith("part")]
        raw = open(f"{folder}/{name}", "rb").read()
        open(f"{folder}/{name}", "wb").write(raw.replace(b"y" * 100, b"z" * 100, 1))
        os.remove(f"{folder}/.{name}.crc")

    monkeypatch.setattr(warc, "write_warc", tampered)
    got = {r.page_id: r for r in warc.op6_warc(spark, str(tmp_path)).collect() if r.page_id == 9}
    changed = b"z" * 100 + b"y" * (3_000_000 - 100)
    assert got[9].payload_bytes == 3_000_000 and got[9].payload_digest == base64.b32encode(hashlib.sha1(changed).digest()).decode()


HOSTILE = ["<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|im_end|>", "<", "<\\", "<\\\\|", "", None, "é🙂\0", "\\n", "a\nb", "<|<|", "x" * 100_000]


def test_chat_round_trip(spark):
    rows = []
    for c, t in enumerate(HOSTILE):
        rows += [(c, 0, "user", t), (c, 1, "assistant", t), (c, 1, "assistant", t), (c, None, "odd\nrole\\n<|x", t), (c, 2, None, t)]
    rows += [(None, i, "assistant", f"t{i}") for i in range(12_000)] + [(50, 1, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash")).repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    low = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, (x or "").encode())
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort(key=lambda r: (low(r[1]), text(r[2]), text(r[3])))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_output_is_the_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    assert bytes(r.formatted).decode() == "<|im_start|>user\na<\\|b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert bytes(r.formatted)[r.spans[0] : r.spans[1]] == b"c"
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:400] = x[7] * 3  # a hot vector with the largest products
    df = vectors(spark, x)
    v = ann.usable(df)
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), ann.AnnParams(shard=1000, block=40 * 32)).collect()
    ids = np.arange(3000)
    q = ids[::20]
    want = ann.brute_force(ids, x.astype(float), q, x[::20].astype(float), 20)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float((x[r.query_id].astype(float) * x[r.vec_id].astype(float)).sum()), rel=1e-12)
    assert all(len(m) == 20 for m in mine.values()) and mine.keys() == set(q.tolist())
    recall = np.mean([len(set(mine[i]) & set(want[i])) / 20 for i in mine])
    assert recall >= 0.9
    hot = [i for i in mine if want[i][0] in range(100, 400)]
    assert hot and all(mine[i] == want[i] for i in hot)


def test_ann_dense_clusters():
    """Thousands of near-equal vectors that codes don't tell apart: recall holds, and few pairs are reranked where codes do tell."""
    rng = np.random.default_rng(3)
    p = ann.AnnParams()
    centres = rng.normal(size=(4, 48))
    for x, most in ((centres[rng.integers(0, 4, 6000)] + 0.03 * rng.normal(size=(6000, 48)), 0.5), (rng.normal(size=(6000, 48)), 0.12)):
        book, ids, tally = ann.Codebook(x[:2000], p), np.arange(6000), {}
        codes = book.encode(x)
        left, q = np.linalg.norm(x - book.decode(codes), axis=1), ids[::60]
        floor, found = np.full(len(q), -np.inf), []
        for a in range(0, 6000, 2000):
            found.append(ann.search_piece(ids[a : a + 2000], x[a : a + 2000], book.pack(codes[a : a + 2000]), left[a : a + 2000], q, x[q], floor, book, p, tally))
        who, v, score = (np.concatenate(c) for c in zip(*found))
        want = ann.brute_force(ids, x, q, x[q], 20)
        mine = {i: v[who == i][np.lexsort((v[who == i], -score[who == i]))][:20] for i in q.tolist()}
        assert np.mean([len(set(mine[i]) & set(want[i])) / 20 for i in mine]) >= 0.99
        assert tally["reranked"] <= most * tally["scanned"]


def test_ann_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    v = ann.usable(df)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (0, 4, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 6, 0.5), (20, 3, 7, 0.5)]
    other = ann.usable(spark.createDataFrame([(80, [1.0, 2.0, 3.0]), (81, [1.0, 0.0, 0.0]), (8, [2.0]), (100, [3.0]), (120, [4.0] * 5)], "vec_id long, embedding array<float>")).union(v)
    both = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(other, other.where("vec_id % 20 = 0")).collect())
    assert both == sorted([*got, (80, 1, 81, 1.0), (100, 1, 8, 6.0), (100, 2, 8, 3.0)])
    assert ann.nearest(v.where("false"), v).count() == 0
    none = ann.usable(df.where("false"))
    assert ann.nearest(none, none).count() == 0


@pytest.mark.parametrize("times", [2, 3, 30, 300])
def test_ann_repeated_query_rows(spark, times):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[0] *= 5  # the query's own vector ranks first
    x[50] = x[0]  # and another id has it too
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [rows[0]] * (times - 1) + [(0, [float(a) for a in x[0] * (2 + i)]) for i in range(times)]  # its id on other vectors as well
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ask = v.where("vec_id = 0").where(F.col("v") == F.array(*[F.lit(float(a)) for a in x[0]]))
    ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for p in (ann.AnnParams(), ann.AnnParams(keep=32), ann.AnnParams(keep=32, shard=100), ann.AnnParams(block=8)):
        got = sorted((r["rank"], r.vec_id) for r in ann.nearest(v, ask, p).collect())
        assert [i for _, i in got] == ann.brute_force(ids, y, ids[:1], y[:1], 20)[0] and got[0][1] == 50


def test_codes_weigh_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    book = ann.Codebook(x, ann.AnnParams(threshold=0.5))

    def loss(codes):
        y = book._pad(x).reshape(500, book.pieces, book.width)
        r = (y - np.stack([book.centres[m][codes[:, m]] for m in range(book.pieces)], axis=1)).reshape(500, -1)
        along = (r * book._pad(x)).sum(axis=1) / np.linalg.norm(x, axis=1)
        return (r**2).sum() + (book.eta - 1) * (along**2).sum()

    assert loss(book.encode(x, sweeps=2)) < loss(book.encode(x, sweeps=0))
    q = rng.normal(size=(3, 16))
    packed = book.pack(book.encode(x))
    scanned = sum(book.tables(q)[:, b][:, packed[:, b]] for b in range(packed.shape[1]))
    rebuilt = np.stack([book.centres[m][book.encode(x)[:, m]] for m in range(book.pieces)], axis=1).reshape(500, -1)
    assert np.allclose(scanned, book._pad(q) @ rebuilt.T, atol=1e-4)


@pytest.mark.parametrize("name", ["op2_mixing", "op4_near_duplicates", "op6_warc", "op8_chat", "op9_ann", "op10_decontaminate"])
def test_query_equals_sql(spark, sf, name):
    from tests.test_catalog import plain
    from tidemark.llm import registry

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got = registry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[x]) for x in columns) for r in got.collect()), key=repr)
    found = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(plain(r[names.index(x)]) for x in columns) for r in found.fetchall()), key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    clean = [" ".join(f"c{x}" for x in rng.integers(0, 5000, 80)) for _ in range(200)]
    leak = "the one passage that a benchmark holds and no training text may hold as well"
    texts = clean + [clean[3], clean[4] + " more"] + [f"{clean[9][:100]} {leak} end"] + [None, ""] + [" ".join(f"x{x}" for x in rng.integers(0, 5000, 80)) + " Vile" for _ in range(60)]
    docs = H.documents(spark, texts, extra=False)
    n = len(texts)
    first_toxic = n - 60
    labels = spark.createDataFrame([(i, 1, int(i >= first_toxic)) for i in range(n)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    sf = H.write_tables(spark, tmp_path, docs, labels=labels, benchmark=bench)
    step = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf).cache()
        kept.append({r.doc_id for r in step.collect()})
    assert all(kept[i + 1] <= kept[i] for i in range(3))
    assert kept[0] == set(range(first_toxic)) | {None}
    assert kept[0] - kept[1] == {200, 201}
    assert kept[1] - kept[2] == {202}
    assert step.columns == [*H.DOCS.names, "size", "source_size", "target", "taken"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept[3]


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    import corpus_pipeline

    docs = H.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 0, None), (5, 1, 1), (5, 1, 0), *((i, 1, 0) for i in range(6, 20))], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "one two three"), (2, "")], "item_id long, text string")
    sf = H.write_tables(spark, tmp_path, docs, labels=labels, benchmark=bench)
    for start in (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/documents.parquet").where("false")):
        step, empty = start, start.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            columns = [c for c in step.columns if name != "mixing" or c not in ("size", "source_size", "target", "taken")]
            step = stage(spark, step, sf)
            assert step.columns[: len(columns)] == columns
            n = step.count()
            assert (n == 0) == empty
        if not empty:
            texts = [r.text for r in step.collect()]
            assert "one two three" not in texts and "🙂 emoji 🙂 text" in texts
