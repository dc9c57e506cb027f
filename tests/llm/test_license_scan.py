import random
import re

from rowloom.llm import license_scan as ls
from tests.helpers import same

TEXTS = [
    "Licensed under CC BY-NC 4.0.", "All rights reserved. ALL RIGHTS RESERVED all rights reserved", "cc", "by", "CC-BY CC.BY cc by cc by",
    "This work is licensed under the GNU General Public License, version 3.", "general public", "General Public\n\nLicense", "Released under the MIT License.",
    "MIT license but nothing else", "Licensed under the Apache License, Version 2.0.", "apache is a people", None, "", "é cc é by", "cc\u00a0by", "ıcc by",
    "x " * 500 + "All Rights Reserved " * 300, "permission is hereby granted", "licence of mit", "version 3 public general license",
]


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return ls.scan_licenses(df).collect()


def test_base_columns_match_brute_force(spark):
    for r in scan(spark, list(enumerate(TEXTS))):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == ls.brute_force(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_base_columns_on_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in ls.op2_license_scan(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == ls.brute_force(texts[r["doc_id"]])


def test_templates_are_found_wherever_they_stand(spark):
    rows = [(n, f"some words first. {text.upper()}, and more") for n, (_, text, _) in enumerate(ls.TEMPLATES)]
    rows += [(1000 + i, "the general text of this work is by a version with no notice at all") for i in range(50)]
    got = {r["doc_id"]: r for r in scan(spark, rows)}
    for n, (label, _, _) in enumerate(ls.TEMPLATES):
        assert label in got[n]["labels"].split(",") and got[n]["score"] == 1.0, label
    assert all(got[1000 + i]["labels"] == "" and got[1000 + i]["score"] == 0 for i in range(50))


def test_a_name_alone_gives_no_label(spark):
    """Labels come through the alignment: most of a template's weight must stand in place."""
    false = ["we compared the mit license with others", "he moved into the public domain debate", "the apache license is a license", "an article on the bsd license and its history",
             "a gnu affero general public license exists", "the mozilla public license has a version"]
    true = {"released under the mit license": "mit", "released into the public domain": "public-domain", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    rows = list(enumerate([*false, *true])) + [(100 + i, "the work of a day into the night is on the table") for i in range(40)]
    got = {r["doc_id"]: r["labels"] for r in scan(spark, rows)}
    assert all(set(got[i].split(",")) <= {"", "gpl"} for i in range(len(false))), [got[i] for i in range(len(false))]
    assert [got[len(false) + k] for k in range(len(true))] == list(true.values())


def test_damaged_texts_keep_their_label(spark):
    """A licence text of which a tenth of the words changed, none of them in a key phrase."""
    text = next(t for label, t, _ in ls.TEMPLATES if label == "mit-text" and len(t.split()) > 50).split()
    rng = random.Random(1)
    worn = [w if k < 10 or rng.random() > 0.1 else "changed" for k, w in enumerate(text)]
    rows = [(1, " ".join(worn)), (2, " ".join(text[:12])), (3, " ".join(sorted(text)))]
    got = {r["doc_id"]: r["labels"] for r in scan(spark, rows + [(10 + i, f"other text {i}") for i in range(20)])}
    assert got[1] == "mit-text" and got[2] == got[3] == ""


def plain_labels(texts):
    """Labels and score of every text, template by template and offset by offset."""
    words = {i: re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    df = {w: sum(w in set(ws) for ws in map(set, words.values())) for w in ls.vocabulary()}
    index = ls.build_index(len(words), df)
    out = {}
    for i, ws in words.items():
        line, shares = f" {' '.join(ws)} ", [0.0]
        labels = set(filter(None, ls.brute_force(texts[i])[4].split(",")))
        shares += [0.5] * bool(labels)
        for n, (label, _, keys) in enumerate(ls.TEMPLATES):
            if all(f" {k} " in line for k in keys):
                at = {(w, k): share for w, t, k, share in index if t == n}
                best = max(sum(share for (w, k), share in at.items() if 0 <= o + k < len(ws) and ws[o + k] == w) for o in range(-200, len(ws)))
                if best >= ls.MIN_SHARE:
                    labels.add(label)
                    shares.append(best)
        out[i] = (",".join(sorted(labels)), round(min(max(shares), 1.0), 6))
    return out


def test_labels_match_a_plain_version(spark, sf):
    texts = dict(enumerate(TEXTS + [f"x y {t[: 40 + 30 * k]}" for k, (_, t, _) in enumerate(ls.TEMPLATES)]))
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in scan(spark, list(texts.items()))} == plain_labels(texts)
    same(ls.op2_license_scan(spark, sf), ls.SQL["op2_license_scan"], sf)


def test_key_phrase_is_mandatory(spark):
    rows = [(1, "released under the mit terms of a license"), (2, "released under the mit license")]
    got = {r["doc_id"]: r["labels"] for r in scan(spark, rows)}
    assert got == {1: "", 2: "mit"}


def test_odd_rows(spark, odd_docs, no_docs):
    got = ls.scan_licenses(odd_docs)
    assert got.count() == odd_docs.count() and got.where("doc_id is null").count() == 2
    assert ls.scan_licenses(no_docs).count() == 0
