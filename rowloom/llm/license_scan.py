"""License scans (2): a positional rare-token index of licence notices, native.

Method: templates (licence texts, their customary headers and short notices) are word sequences with
mandatory key phrases.  Inverse document frequencies of all licence words are counted over the
whole corpus; each template is indexed by its rarest words, with their positions.  A text's
occurrences of indexed words are looked up, and postings that agree in relative position
(place in the text minus place in the template) are added up.  The best alignment's share of the
template's indexed weight is its score.  A template gives its label only if that share reaches
``MIN_SHARE`` and all its key phrases stand in the text: mention of a licence's name is not enough.

Texts are read once: the licence words that each holds are stored and, of texts with a key phrase,
the places of those words.  Frequencies, index and alignments follow from that table.

Defined cases: null or empty text has no words and no labels; null ids are kept;
repeated rows get equal results; overlapping notices all count; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm._shared import LOWER, UPPER, ascii_lower, load, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Least share of a template's indexed weight in one alignment.
MIN_SHARE = 0.8

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_CONDITIONS = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
#: (label, words, key phrases): licence texts, customary headers and short notices.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("agpl", _FREE.format("affero general public license", "3"), ["gnu affero general public license as published by"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0", "except in compliance with the license"]),
    ("apache-2.0", "apache license version 2 0 january 2004 terms and conditions for use reproduction and distribution", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {_CONDITIONS}", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["to endorse or promote products derived from this software"]),
    ("bsd-named", "released under the 3 clause bsd license", ["bsd license"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["copy of the software and accompanying documentation"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("creative-commons", "this work is licensed under the creative commons attribution license", ["creative commons attribution license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", _FREE.format("general public license", "2"), ["gnu general public license as published by", "either version 2 of the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", _FREE.format("general public license", "3"), ["gnu general public license as published by", "either version 3 of the license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", _FREE.format("lesser general public license", "3"), ["gnu lesser general public license as published by"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "distributed under the terms of the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mit-text", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("proprietary", "proprietary and confidential unauthorized copying of this file is strictly prohibited", ["proprietary and confidential"]),
    ("public-domain", "released into the public domain", ["released into the public domain"]),
    ("public-domain", "dedicated to the public domain", ["dedicated to the public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
]
#: Indexed words of a template, at least, and one for so many words; besides the rarest of each key phrase.
RARE_WORDS, WORDS_EACH = 4, 4


def _rare_words(words: list[str]) -> int:
    return max(RARE_WORDS, len(words) // WORDS_EACH)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def document_frequencies(scanned: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those holding each licence word (at most one row per word is collected)."""
    rows = scanned.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return scanned.count(), {r["w"]: r["n"] for r in rows}


def build_index(n: int, df: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """Postings (word, template, position in the template, share of the template's indexed weight)."""
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3
    out = []
    for number, (_, text, keys) in enumerate(TEMPLATES):
        words = text.split()
        rare = sorted(set(words), key=lambda w: (-idf(w), w))[: _rare_words(words)]
        rare += [min(k.split(), key=lambda w: (-idf(w), w)) for k in keys]
        places = [(w, k) for k, w in enumerate(words) if w in rare]
        total = sum(idf(w) for w, _ in places)
        out += [(w, number, k, idf(w) / total) for w, k in places]
    return out


def _starts(words: Column, phrase: str) -> Column:
    """Word numbers at which a phrase stands."""
    parts = phrase.split()
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))

    def here(i: Column) -> Column:
        ok = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.coalesce(ok, F.lit(False))

    return F.filter(places, here)


def _marked(words: Column, phrase: str, label: str) -> Column:
    return F.transform(_starts(words, phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row."""
    spark, words = docs.sparkSession, F.array(*map(F.lit, vocabulary()))
    keys = sorted({k for _, _, ks in TEMPLATES for k in ks})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), _words(F.col(text)).alias("w"))
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    last_words = sorted({k.split()[-1] for k in BASE})
    may_base = F.arrays_overlap("w", F.array(*map(F.lit, last_words)))
    found = [_marked(F.col("w"), p, name) for p, name in BASE.items()]
    # a text without any key phrase's longest word needs no look at the phrases
    longest = F.array(*map(F.lit, sorted({max(k.split(), key=lambda w: (len(w), w)) for k in keys})))
    phrases = F.array(*map(F.lit, keys))
    marked = F.flatten(F.transform(F.array(line), lambda x: F.filter(phrases, lambda k: F.contains(x, F.concat(F.lit(" "), k, F.lit(" "))))))
    scanned = rows.select(
        "doc_id",
        "th",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.when(may_base, F.flatten(F.array(*found))).alias("base"),
        F.array_intersect("w", words).alias("seen"),
        F.when(F.arrays_overlap("w", longest), marked).alias("keys"),
    )
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: F.array_contains(words, x["w"]))
    scanned = stored(scanned.withColumn("hits", F.when(F.size("keys") > 0, hits)).drop("w"), "license-words")

    postings = build_index(*document_frequencies(scanned))
    index = spark.createDataFrame(postings, "word string, template int, pos int, share double")
    wanted = spark.createDataFrame([(k, label, keys) for k, (label, _, keys) in enumerate(TEMPLATES)], "need int, label string, phrases array<string>")
    some = scanned.where(F.size("keys") > 0)
    occurrences = some.select("doc_id", "th", "keys", F.explode("hits").alias("h"))
    looked = occurrences.join(F.broadcast(index), occurrences["h.w"] == index["word"])
    aligned = looked.select("doc_id", "th", "keys", "template", (F.col("h.at") - F.col("pos")).alias("offset"), "pos", "share").distinct()
    scores = aligned.groupBy("doc_id", "th", "template", "offset").agg(F.sum("share").alias("share"), F.first("keys").alias("keys"))
    best = scores.groupBy("doc_id", "th", "template").agg(F.max("share").alias("share"), F.first("keys").alias("keys"))
    valid = best.join(F.broadcast(wanted), best["template"] == wanted["need"])
    valid = valid.where((F.col("share") >= MIN_SHARE) & (F.size(F.array_except("phrases", "keys")) == 0))
    notices = valid.groupBy(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th")).agg(
        F.collect_set("label").alias("found"), F.max("share").alias("share")
    )

    joined = scanned.join(notices, scanned["doc_id"].eqNullSafe(notices["f_id"]) & (scanned["th"] == notices["f_th"]), "left")
    base_set = F.array_sort(F.array_distinct(F.transform(F.coalesce("base", F.array().cast("array<struct<at:int,label:string>>")), lambda b: b["label"])))
    at = F.transform("base", lambda b: b["at"].cast("long"))
    n_base = F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long")
    labels = F.array_sort(F.array_union(base_set, F.coalesce("found", F.array().cast("array<string>"))))
    floor = F.when(n_base > 0, 0.5).otherwise(0.0)
    return joined.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(F.least(F.greatest(F.coalesce("share", F.lit(0.0)), floor), F.lit(1.0)), 6).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple:
    """The base columns of one text, plainly (for tests)."""
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, name) for p, name in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in hits}))


def _sql() -> str:
    """The same result in DuckDB's SQL, by joining words instead of texts."""
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    notices = [(n, label, len(text.split()), k, w) for n, (label, text, _) in enumerate(TEMPLATES) for k, w in enumerate(text.split())]
    keys = [(n, phrase, w) for n, (_, _, phrases) in enumerate(TEMPLATES) for phrase in phrases for w in sorted(set(phrase.split()))]
    base = []
    for phrase, label in BASE.items():
        words = phrase.split()
        joins = " ".join(f"JOIN w w{k} ON w{k}.doc_id = w0.doc_id AND w{k}.i = w0.i + {k} AND w{k}.w = '{x}'" for k, x in enumerate(words) if k)
        base.append(f"SELECT w0.doc_id, w0.i, '{label}' AS label FROM w w0 {joins} WHERE w0.w = '{words[0]}'")
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM t),
b AS ({" UNION ALL ".join(base)}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
notice(t, label, size, pos, word) AS (VALUES {values(notices)}),
key(t, phrase, word) AS (VALUES {values(keys)}),
df AS (SELECT w AS word, count(DISTINCT doc_id) AS n FROM w WHERE w IN (SELECT word FROM notice) GROUP BY w),
idf AS (SELECT v.word, ln((SELECT count(*) + 1 FROM documents) / (coalesce(df.n, 0) + 1)) + 1e-3 AS idf FROM (SELECT DISTINCT word FROM notice) v LEFT JOIN df ON df.word = v.word),
ranked AS (SELECT v.t, v.size, v.word, row_number() OVER (PARTITION BY v.t ORDER BY idf.idf DESC, v.word) AS r
  FROM (SELECT DISTINCT t, size, word FROM notice) v JOIN idf ON idf.word = v.word),
in_key AS (SELECT k.t, k.word, row_number() OVER (PARTITION BY k.t, k.phrase ORDER BY idf.idf DESC, k.word) AS r FROM key k JOIN idf ON idf.word = k.word),
rare AS (SELECT t, word FROM ranked WHERE r <= greatest({RARE_WORDS}, size // {WORDS_EACH}) UNION SELECT t, word FROM in_key WHERE r = 1),
posting AS (SELECT n.t, n.word, n.pos, idf.idf / sum(idf.idf) OVER (PARTITION BY n.t) AS share
  FROM notice n JOIN rare r ON r.t = n.t AND r.word = n.word JOIN idf ON idf.word = n.word),
line AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM t),
phrases AS (SELECT DISTINCT t, phrase FROM key),
holds AS (SELECT l.doc_id, p.t FROM line l, phrases p GROUP BY l.doc_id, p.t, l.line HAVING bool_and(contains(l.line, ' ' || p.phrase || ' '))),
aligned AS (SELECT DISTINCT w.doc_id, p.t, w.i - p.pos AS place, p.pos, p.share FROM holds h JOIN w ON w.doc_id = h.doc_id JOIN posting p ON p.word = w.w AND p.t = h.t),
best AS (SELECT doc_id, t, max(share) AS share FROM (SELECT doc_id, t, place, sum(share) AS share FROM aligned GROUP BY ALL) GROUP BY doc_id, t),
found AS (SELECT b.doc_id, n.label, b.share FROM best b JOIN (SELECT DISTINCT t, label FROM notice) n ON n.t = b.t WHERE b.share >= {MIN_SHARE}
  UNION ALL SELECT doc_id, label, 0.5 FROM b),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(base.n_base, 0) AS BIGINT) AS n_base, base.first_word, base.last_word,
  coalesce(base.base_labels, '') AS base_labels, coalesce(labels.labels, '') AS labels, round(least(coalesce(labels.score, 0.0), 1.0), 6) AS score
FROM t LEFT JOIN base ON base.doc_id = t.doc_id LEFT JOIN labels ON labels.doc_id = t.doc_id
"""


QUERIES = {"op2_license_scan": op2_license_scan}
SQL = {"op2_license_scan": _sql()}
