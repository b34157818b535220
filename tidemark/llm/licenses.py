"""License scans with DataFrame functions only: ordered signature rules behind a keyword gate.

The text has A-Z lower-cased and every run of other characters made one blank, so that a rule is a Java regular expression over
words and a place is a number of words. A rule has a label, a priority, a weight and a keyword. A text is searched by a rule
only if it contains the rule's keyword, and rules are looked at only if any keyword occurs at all, which few texts pass.

Detections are intervals of words. One is suppressed if another of a higher priority contains it, or one of equal
priority that is longer (of equal intervals and priorities the first rule's stays). The four base phrases have the
highest priority but suppress nothing and are never suppressed: they are the labels that a plain search would find.

The rules come from families (versions, wordings, clauses) and are ordered: exact titles and notices first (priority 3),
then references with versions (2), then bare mentions (1).

Edges: null and empty texts have no words, no places (null first and last), no labels (empty string) and score 0. Repeated rows
count each. Very long texts are searched whole: the work grows with a text's words and its matches, not with pairs of matches. An empty
table gives no rows. Other columns pass through scan(); clashing ones are replaced.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str


def _gnu() -> list[Rule]:
    out = []
    for name, short in (("general", "gpl"), ("lesser general", "lgpl"), ("library general", "lgpl"), ("affero general", "agpl")):
        title = f"gnu {name} public licen[sc]e"
        for version in ("1", "2", "2 1", "3"):
            label = f"{short}-{version.replace(' ', '.')}"
            v = rf"v(?:ersion )?{version}(?: 0)?"
            out += [
                Rule(f"{label}-or-later", 3, 0.98, "public licen", rf"{title} as published by the free software foundation either {v} of the licen[sc]e or at your option any later version"),
                Rule(f"{label}-or-later", 2, 0.95, "public licen", rf"{title} {v} or (?:any )?later(?: version)?"),
                Rule(f"{label}-only", 2, 0.95, "public licen", rf"{title} {v} only"),
                Rule(label, 2, 0.9, "public licen", rf"{title} {v}"),
                Rule(f"{label}-or-later", 2, 0.9, short, rf"{short} {v} or later"),
                Rule(f"{label}-only", 2, 0.9, short, rf"{short} {v} only"),
                Rule(label, 1, 0.7, short, rf"{short} {v}"),
                Rule(label, 1, 0.7, short + "v", rf"{short}v{version}(?: 0)?"),
            ]
        out.append(Rule(short, 1, 0.8, "public licen", title))
        out.append(Rule(short, 1, 0.6, "public licen", rf"{name} public licen[sc]e"))
    return out


def _creative_commons() -> list[Rule]:
    out = []
    words = {"by": "attribution", "nc": "noncommercial", "nd": "no ?deriv(?:ative)?s?", "sa": "share ?alike"}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        code, title = " ".join(parts), " ".join(words[p] for p in parts)
        label = "cc-" + "-".join(parts)
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            v = version.replace(" ", ".")
            out += [
                Rule(f"{label}-{v}", 3, 0.98, "creative commons", rf"creative commons {title} {version}(?: international| unported| generic)?(?: public)? licen[sc]e"),
                Rule(f"{label}-{v}", 2, 0.95, "creative commons", rf"creative commons {title} {version}"),
                Rule(f"{label}-{v}", 2, 0.95, "creativecommons", rf"creativecommons org licenses {code} {version}"),
                Rule(f"{label}-{v}", 2, 0.9, "cc by", rf"cc {code} {version}"),
            ]
        out.append(Rule(label, 1, 0.8, "creative commons", rf"creative commons {title}"))
        out.append(Rule(label, 1, 0.7, "cc by", rf"cc {code}"))
    zero = r"(?:creative commons zero|cc0|cc zero)(?: v?1 0)?(?: universal)?"
    return [*out, Rule("cc0-1.0", 2, 0.9, "cc0", zero), Rule("cc0-1.0", 2, 0.9, "creative commons", zero), Rule("cc0-1.0", 2, 0.9, "cc zero", zero), Rule("cc", 1, 0.5, "creative commons", "creative commons")]


def _permissive() -> list[Rule]:
    out = [
        Rule("mit", 3, 0.98, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
        *(Rule("mit", 2, 0.9, f"{verb} under", rf"{verb} under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?") for verb in ("licensed", "released", "distributed", "available")),
        Rule("mit", 1, 0.8, "mit licen", r"mit licen[sc]e"),
        Rule("mit", 1, 0.7, "x11 mit", r"x11 mit"),
        Rule("mit", 2, 0.9, "expat", r"expat licen[sc]e"),
        Rule("isc", 3, 0.98, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        Rule("isc", 1, 0.8, "isc licen", r"isc licen[sc]e"),
        Rule("zlib", 3, 0.95, "this software is provided", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        Rule("zlib", 1, 0.8, "zlib", r"zlib(?: libpng)? licen[sc]e"),
        Rule("unlicense", 3, 0.98, "public domain", r"this is free and unencumbered software released into the public domain"),
        Rule("unlicense", 1, 0.8, "unlicense", r"(?:the )?unlicense"),
        Rule("public-domain", 1, 0.5, "public domain", r"(?:in|into) the public domain"),
        Rule("wtfpl", 1, 0.8, "what the fuck", r"do what the fuck you want to public licen[sc]e"),
        Rule("artistic", 1, 0.7, "artistic", r"artistic licen[sc]e"),
        Rule("boost-1.0", 2, 0.9, "boost software", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
        Rule("python-2.0", 2, 0.9, "python software", r"python software foundation licen[sc]e(?: version 2)?"),
        Rule("openssl", 1, 0.8, "openssl", r"openssl licen[sc]e"),
        Rule("proprietary", 1, 0.5, "all rights reserved", r"all rights reserved"),
        Rule("spdx", 1, 0.4, "spdx", r"spdx license identifier"),
    ]
    for clauses, word in (("2", "two"), ("3", "three"), ("4", "four")):
        for form in (rf"bsd {clauses} clause", rf"bsd {word} clause", rf"{clauses} clause bsd", rf"{word} clause bsd"):
            out += [Rule(f"bsd-{clauses}-clause", 2, 0.95, "bsd", form + r" licen[sc]e"), Rule(f"bsd-{clauses}-clause", 1, 0.8, "bsd", form)]
    kinds = {"simplified": "2", "freebsd": "2", "new": "3", "revised": "3", "modified": "3", "original": "4"}
    out += [Rule(f"bsd-{c}-clause", 2, 0.9, "bsd", rf"{k} bsd licen[sc]e") for k, c in kinds.items()]
    out += [
        Rule("bsd", 1, 0.7, "bsd", r"bsd (?:style )?licen[sc]e"),
        Rule("bsd-3-clause", 3, 0.95, "nor the names", r"(?:neither the name of .{1,80}? )?nor the names of its contributors may be used to endorse or promote products"),
        Rule("bsd", 3, 0.9, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ]
    return out


def _versioned() -> list[Rule]:
    """Licences with a title, a short name and versions."""
    families = [
        ("apache", "apache", r"apache(?: software)? licen[sc]e", "apache", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", r"eclipse public licen[sc]e", "epl", ("1 0", "2 0")),
        ("cddl", "common development", r"common development and distribution licen[sc]e", "cddl", ("1 0", "1 1")),
        ("eupl", "european union", r"european union public licen[sc]e", "eupl", ("1 1", "1 2")),
        ("gfdl", "free documentation", r"gnu free documentation licen[sc]e", "gfdl", ("1 1", "1 2", "1 3")),
        ("odbl", "open database", r"open database licen[sc]e", "odbl", ("1 0",)),
        ("ofl", "sil open font", r"sil open font licen[sc]e", "ofl", ("1 0", "1 1")),
        ("osl", "open software licen", r"open software licen[sc]e", "osl", ("1 0", "2 0", "3 0")),
        ("afl", "academic free", r"academic free licen[sc]e", "afl", ("1 2", "2 0", "3 0")),
        ("cecill", "cecill", r"cecill(?: free software)? licen[sc]e", "cecill", ("1 0", "2 0", "2 1")),
        ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", "ms pl", ("1 0",)),
        ("artistic", "artistic", r"artistic licen[sc]e", "artistic", ("1 0", "2 0")),
    ]
    out = []
    for label, keyword, title, short, versions in families:
        for v in versions:
            dotted = v.replace(" ", ".")
            out += [
                Rule(f"{label}-{dotted}", 3, 0.98, keyword, rf"licensed under the {title} version {v}"),
                Rule(f"{label}-{dotted}", 2, 0.95, keyword, rf"{title}(?: version| v)? {v}"),
                Rule(f"{label}-{dotted}", 2, 0.9, short, rf"{short}(?: version| v)? {v}"),
            ]
        out.append(Rule(label, 1, 0.8, keyword, title))
    return out


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order; the earlier of two equal claims wins. Base phrases come first, with priority 9."""
    base = [Rule(label, 9, 1.0, phrase, phrase) for phrase, label in BASE.items()]
    found = [*_gnu(), *_creative_commons(), *_permissive(), *_versioned()]
    return tuple(base + list(dict.fromkeys(sorted(found, key=lambda r: -r.priority))))


def normal(text: Column) -> Column:
    """Words in lower case, one blank between, before and after.

    lower() is many times as fast as replacing A-Z one by one. Beyond ASCII it changes letters to other letters beyond ASCII,
    which no rule and no word boundary tells apart, but for two: U+0130 and U+212A have i and k as their lower case.
    These are put out of the way first.
    """
    low = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _literal() -> Column:
    """Rules by keyword: array<struct<k, rules>>, a constant, as one SQL expression that is parsed at once."""
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(rules()):
        rule = f"named_struct('i', {i}, 'label', '{r.label}', 'p', {r.priority}, 'w', {r.weight}D, 're', r'(?<= ){r.pattern}(?= )')"
        by_keyword.setdefault(r.keyword, []).append(rule)
    return F.expr("array(" + ", ".join(f"named_struct('k', ' {k}', 'rules', array({', '.join(group)}))" for k, group in by_keyword.items()) + ")")


#: A match in the text stands between these; neither can be in a word or between words once the text is normal.
BEGIN, END = "\x01", "\x02"
#: What sorts hits for the sweep: begin, longest first, highest priority first, first rule first.
HITS = "array<struct<b:int,ne:int,np:int,i:int,w:double,label:string>>"


def _intervals(norm: Column, r: Column) -> Column:
    """Intervals of words [b, -ne) of all matches of rule r: their ends are marked in one replacement, and words counted up to the marks."""
    marked = F.split(F.regexp_replace(norm, r["re"], F.lit(f"{BEGIN}$0{END}")), F.lit(" "))
    # the text begins with a blank, so word n is the piece n + 1
    begins = F.filter(F.transform(marked, lambda w, n: F.when(F.startswith(w, F.lit(BEGIN)), n - 1)), lambda n: n.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, n: F.when(F.endswith(w, F.lit(END)), -n)), lambda n: n.isNotNull())
    one = lambda x: F.struct(x["b"].alias("b"), x["ne"].alias("ne"), (-r["p"]).alias("np"), r["i"].alias("i"), r["w"].alias("w"), r["label"].alias("label"))
    return F.transform(F.arrays_zip(begins.alias("b"), ends.alias("ne")), one)


def _survivors(hits: Column) -> Column:
    """(labels, w): the distinct labels and the greatest weight of hits that none suppresses, in one sweep over them in order.

    What can suppress a hit stands before it in that order: a containing interval begins no later, and of equal ones the higher priority
    and then the earlier rule come first. So a hit falls exactly if one before it, of its priority or higher, ends no earlier.
    """
    none = F.lit(0)
    start = F.struct(none.alias("e1"), none.alias("e2"), none.alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("w"))

    def step(acc, x):
        e, p = -x["ne"], -x["np"]
        reach = F.when(p == 3, acc["e3"]).when(p == 2, acc["e2"]).otherwise(acc["e1"])  # the furthest end of priority p or higher
        stays = reach < e
        seen = lambda name, least: F.when(p >= least, F.greatest(acc[name], e)).otherwise(acc[name]).alias(name)
        fresh = stays & ~F.array_contains(acc["labels"], x["label"])
        labels = F.when(fresh, F.concat(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"])
        return F.struct(seen("e1", 1), seen("e2", 2), seen("e3", 3), labels.alias("labels"), F.when(stays, F.greatest(acc["w"], x["w"])).otherwise(acc["w"]).alias("w"))

    return F.aggregate(F.array_sort(hits), start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["w"].alias("w")))


def _gate() -> str:
    """Any keyword at the beginning of a word, alternatives grouped by first letter."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted({r.keyword for r in rules()}):
        by_letter.setdefault(k[0], []).append(k[1:])
    return " (?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.drop(*ADDED)
    df = docs.withColumn("__norm", normal(F.col("text")))
    n = F.col("__norm")
    # a gate in one pass over the text: most texts hold no keyword
    gate = n.rlike(_gate())
    fit = F.flatten(F.transform(F.filter(_literal(), lambda g: F.contains(n, g["k"])), lambda g: g["rules"]))
    hits = F.flatten(F.transform(F.filter(fit, lambda r: F.regexp_like(n, r["re"])), lambda r: _intervals(n, r)))
    df = df.withColumn("__hits", F.when(gate, hits).otherwise(F.array().cast(HITS)))
    df = df.withColumn("n_words", F.greatest(_blanks(n) - 1, F.lit(0)).cast("long"))
    base = F.filter("__hits", lambda x: x["np"] == -9)
    own = F.filter("__hits", lambda x: x["np"] > -9)
    # levels of names keep the search and the sweep from being repeated for each column
    df = df.withColumn("__base", base).withColumn("__own", own)
    df = df.withColumn("__left", _survivors(F.col("__own")))
    begins = F.transform("__base", lambda x: x["b"].cast("long"))
    labels = F.transform("__base", lambda x: x["label"])
    return df.select(
        *docs.columns, "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(begins).alias("first_word"), F.array_max(begins).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.col("__left.labels")))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("__base", lambda x: x["w"])), F.lit(0.0)), F.col("__left.w")).alias("score"),
    )


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
