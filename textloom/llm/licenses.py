"""License scans by a positional rare-token index, in DataFrame functions alone.

The index holds each word of a few licence templates with its positions, and its rarity: the logarithm of templates over templates
that hold it. For each text, the words that the index knows are listed with their positions, and all of them are looked up, so that
prose or other notices in a text take nothing from a notice. A posting votes for (template, position in the text less position in
the template); votes of the same relative position (within blocks of SLACK words, each vote in its own block and the next) intersect
into a match. A match counts if enough of the template's rare words agree and the template's mandatory key phrases stand in the
text. The words' own consecutive matches of plain phrases (BASE) come beside.

Most texts hold no word of the index and end after one scan. The others list a few rows for each rare word; what is shuffled is
keyed by the row of the input, so a hot source gathers nowhere.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAREST = 40  # words of a template, by rarity, that are looked up, besides those of its key phrases
SLACK = 8
LEAST_SHARE = 0.6  # of the looked-up words of a template that agree in position
#: Plain phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed values: (label, notice, mandatory key phrases), the notices in words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("substantial portions of the software", "noninfringement")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("www apache org licenses license 2 0", "unless required by applicable law")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "free software foundation", "either version 3 of the license")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "free software foundation", "either version 2 of the license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license", "free software foundation")),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages", ("the author disclaims all warranties",)),
)


def build_index() -> tuple[dict[str, float], list[tuple[str, int, int]], list[int]]:
    """Rarity of each word; postings (word, template, position) of the words that are looked up; how many those are by template.

    A template looks up the words of its key phrases, and of its words that at most a third of the templates hold the RAREST
    rarest, ties by the first place. All templates are looked up in every text, whatever else it holds."""
    words = [t[1].split() for t in TEMPLATES]
    holds = defaultdict(set)
    for k, ws in enumerate(words):
        for w in ws:
            holds[w].add(k)
    rarity = {w: math.log(len(TEMPLATES) / len(ks)) for w, ks in holds.items()}
    postings = []
    for k, (_, _, keys) in enumerate(TEMPLATES):
        key_words = {w for phrase in keys for w in phrase.split()}
        rare = sorted((w for w in dict.fromkeys(words[k]) if 3 * len(holds[w]) <= len(TEMPLATES)), key=lambda w: -rarity[w])[:RAREST]
        postings += [(w, k, i) for i, w in enumerate(words[k]) if w in rare or w in key_words]
    return rarity, postings, [len({i for _, t, i in postings if t == k}) for k in range(len(TEMPLATES))]


RARITY, POSTINGS, LOOKED_UP = build_index()
INDEXED = sorted({w for w, _, _ in POSTINGS})


def build_anchors() -> list[str]:
    """Strings such that a text with a plain phrase, or with all key phrases of a template, holds one: for each phrase the longest
    word, unless one that was chosen before serves it."""
    chosen: list[str] = []
    for phrase in [*BASE, *(t[2][0] for t in TEMPLATES)]:
        if not any(a in w for a in chosen for w in phrase.split()):
            chosen.append(max(phrase.split(), key=lambda w: (len(w), w)))
    return chosen


ANCHORS = build_anchors()


def _starts(words: Column, phrase: str) -> Column:
    """Positions (from 0) where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def body(ws: Column) -> Column:
        def here(i: Column) -> Column:
            hit = F.get(ws, i) == first
            for k, w in enumerate(rest, 1):
                hit = hit & F.coalesce(F.get(ws, i + k) == w, F.lit(False))
            return hit

        return F.filter(F.sequence(F.lit(0), F.size(ws) - 1), here)

    return F.when(F.array_contains(words, first), let(words, body)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with n_words, n_base, first_word, last_word, base_labels, labels and score, one row for each row of docs.

    A null or empty text has no word, empty labels and score 0. score is the best share of a template's looked-up words that agree,
    or 1 where a plain phrase stands. Rows with the same id are scanned apart; repeated rows each get their result.
    """
    index = docs.sparkSession.createDataFrame(POSTINGS, "__w string, __t int, __q int")  # fixed, a few hundred rows
    kept = [F.col(f"`{c}`") for c in keep]
    lower = F.translate(F.coalesce(F.col("__text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(*[c.alias(f"__k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("__text")).withColumn("__row", F.monotonically_increasing_id())
    folded = F.lower("__text")  # folds more than A-Z, so it can only let more texts through
    anchored = F.lit(False)
    for word in ANCHORS:
        anchored = anchored | F.contains(folded, F.lit(word))
    n_words = F.coalesce(F.regexp_count("__text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    words = F.when(anchored, F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    keys = [f"__k{i}" for i in range(len(keep))]
    rows = rows.select("__row", *keys, n_words.alias("n_words"), words.alias("__words"))

    def read(ws: Column) -> Column:
        found = F.struct(*[_starts(ws, phrase).alias(label) for phrase, label in BASE.items()])
        phrases = sorted({p for t in TEMPLATES for p in t[2]})
        holds = F.array(*[F.size(_starts(ws, p)) > 0 for p in phrases])
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: x["w"].isin(INDEXED))
        keyed = let(holds, lambda h: F.array(*[_all_of(h, [phrases.index(p) for p in t[2]]) for t in TEMPLATES]))
        return F.struct(found.alias("base"), keyed.alias("keyed"), hits.alias("hits"))

    rows = rows.withColumn("__read", F.when(F.size("__words") > 0, let(F.col("__words"), read)))
    base = F.col("__read.base")
    places = F.concat(*[F.coalesce(base[label], F.array().cast("array<int>")) for label in BASE.values()])
    labels = F.array_compact(F.array(*[F.when(F.size(base[label]) > 0, F.lit(label)) for label in sorted(BASE.values())]))
    rows = rows.select("__row", *keys, "n_words", places.alias("__places"), labels.alias("__base"), F.col("__read.keyed").alias("__keyed"), F.col("__read.hits").alias("__hits"))
    rows = materialize(rows, "licences")  # a row for each text, without the text; its row numbers are then fixed
    # Votes: only rows that hold a word of the index and a key phrase take part; the others keep one row without a template.
    some = F.when(F.exists(F.coalesce("__keyed", F.array().cast("array<boolean>")), lambda x: x), F.col("__hits"))
    hits = rows.select("__row", *keys, "n_words", "__places", "__base", "__keyed", F.explode_outer(some).alias("__hit"))
    votes = hits.join(F.broadcast(index), F.col("__hit.w") == F.col("__w"), "left").where(F.col("__t").isNull() | F.get("__keyed", F.col("__t")))
    block = F.floor((F.col("__hit.p") - F.col("__q")) / SLACK).cast("int")
    votes = votes.select("__row", *keys, "n_words", "__places", "__base", "__t", "__q", F.explode(F.array(block, block + 1)).alias("__block"))
    group = ["__row", *keys, "n_words", "__places", "__base"]
    agreed = votes.groupBy("__row", "__t", "__block").agg(F.count_distinct("__q").alias("__n"))
    total = F.get(F.array(*[F.lit(float(n)) for n in LOOKED_UP]), F.col("__t"))
    label = F.get(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("__t"))
    found = agreed.where(F.col("__t").isNotNull()).select("__row", label.alias("__label"), F.least(F.lit(1.0), F.col("__n") / total).alias("__share"))
    found = found.where(F.col("__share") >= LEAST_SHARE).groupBy("__row").agg(F.collect_set("__label").alias("__labels"), F.max("__share").alias("__score"))
    out = rows.select(*group).join(found, "__row", "left")
    joined = F.array_sort(F.array_distinct(F.concat("__base", F.coalesce("__labels", F.array().cast("array<string>")))))
    some_place = F.size("__places") > 0
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)],
        "n_words",
        F.size("__places").cast("long").alias("n_base"),
        F.when(some_place, F.array_min("__places")).cast("long").alias("first_word"),
        F.when(some_place, F.array_max("__places")).cast("long").alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(joined, ",").alias("labels"),
        F.when(some_place, F.lit(1.0)).otherwise(F.coalesce(F.round("__score", 6), F.lit(0.0))).alias("score"),
    )


def _all_of(holds: Column, which: list[int]) -> Column:
    out = F.lit(True)
    for k in which:
        out = out & F.get(holds, F.lit(k))
    return out


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


def _sql() -> str:
    """The same in DuckDB SQL."""

    def stands(phrase: str) -> str:
        return " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))

    def starts(phrase: str) -> str:
        return f"list_filter(range(len(w)), lambda i: coalesce({stands(phrase)}, false))"

    base = ", ".join(f"{starts(phrase)} AS b{k}" for k, phrase in enumerate(BASE))
    keyed = ", ".join(" AND ".join(f"len({starts(p)}) > 0" for p in t[2]) + f" AS key{k}" for k, t in enumerate(TEMPLATES))
    names = list(BASE.values())
    labels = ", ".join(f"CASE WHEN len(b{names.index(label)}) > 0 THEN '{label}' END" for label in sorted(names))
    index = ", ".join(f"('{w}', {t}, {q})" for w, t, q in POSTINGS)
    templates = ", ".join(f"({k}, '{t[0]}', {LOOKED_UP[k]})" for k, t in enumerate(TEMPLATES))
    keys = " UNION ALL ".join(f"SELECT rid, {k} AS t FROM l_keyed WHERE key{k}" for k in range(len(TEMPLATES)))
    return rf"""
WITH l_words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
l_base AS (SELECT rid, doc_id, len(w) AS n_words, {base} FROM l_words),
l_rows AS (SELECT rid, doc_id, n_words, {" || ".join(f"b{k}" for k in range(len(BASE)))} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM l_base),
l_keyed AS (SELECT rid, {keyed} FROM l_words),
l_keys AS ({keys}),
l_index AS (SELECT * FROM (VALUES {index}) v(x, t, q)),
l_each AS (SELECT rid, unnest(range(len(w))) AS p, unnest(w) AS x FROM l_words WHERE rid IN (SELECT rid FROM l_keys)),
l_votes AS (SELECT rid, t, q, floor((p - q) / {SLACK}.0)::BIGINT AS block FROM l_each JOIN l_index USING (x) JOIN l_keys USING (rid, t)),
l_agreed AS (SELECT rid, t, block, count(DISTINCT q) AS n FROM (SELECT rid, t, q, block FROM l_votes UNION ALL SELECT rid, t, q, block + 1 FROM l_votes) GROUP BY ALL),
l_found AS (SELECT rid, list(DISTINCT label) AS labels, max(least(1.0, n / total::DOUBLE)) AS share FROM l_agreed JOIN (VALUES {templates}) v(t, label, total) USING (t) WHERE least(1.0, n / total::DOUBLE) >= {LEAST_SHARE} GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(round(share, 6), 0.0) END::DOUBLE AS score
FROM l_rows LEFT JOIN l_found USING (rid)"""


ORACLE_SQL = _sql()
