"""Small tables with every awkward case, and plain Python twins of the operators."""

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names clash with what operators add or use inside.
CLASHES = ["score", "size", "taken", "target", "mark", "uid", "kept", "n_words", "labels", "cid", "key", "w"]


def lower_words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


def awkward_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "été", "Straße", "\u0130", "\u212a", "M\u0130T", "MIT", "license", "x" * 40]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(12)]
    out = [None, "", "   \t\n", "one", "One", "one two three", "a b c d", "A B\tC D"]
    for t in base:
        words = t.split()
        near = list(words)
        near[rng.randrange(60)] = "changed"
        out += [t, t, " ".join(near), "!! " + t.upper(), t[:200]]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    out += ["\x00odd\x01bytes\x7f", "🙂 emoji 🙂 text", "licensed under the MIT License", "GNU General Public License, version 2 or later", "cc by-sa 4.0 and CC BY"]
    return out


def documents(spark, texts=None, extra=True):
    texts = awkward_texts() if texts is None else texts
    sources = ["b", "a", None, "c", "a", "a"]
    rows = [(i, t, "en", sources[i % 6], len(t or "")) for i, t in enumerate(texts)]
    if texts:
        rows += [rows[-1], (None, "a text without an id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("kept as it is").alias(c) for c in CLASHES])
    return df.repartition(3)


def write_tables(spark, folder, docs, **more):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for name, df in more.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def crc5(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def base_scores(rows):
    """op5's counts: doc -> (n_tokens, n_known, base) by the formula."""
    tokens = [(i, [*lower_words(t, SPACED), None]) for i, t in rows]
    c = Counter()
    for i, w in tokens:
        if crc5(i) != 1:
            c.update(w)
    n = sum(c.values())
    d = n + 0.5 * (len(c) + 1)
    return n, [(i, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / d) for x in w)) for i, w in tokens]
