import itertools
import random

import numpy as np
import pytest

from rowloom.llm import minmax_dedup as md


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[k:] for k in range(width))))


def brute(rows, width=3, percent=85):
    """(doc_id, n_shingles, component) of rows with distinct ids."""
    s = {i: sets_of(t, width) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, len(s[i]), find(i)) for i in s}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in md.near_duplicates(df, **options).collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    """A large family of near copies around the threshold, chains, exact copies and strangers."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [edited(rng, base, rng.randrange(0, 9)) for _ in range(300)]
    chain = list(base[:60])
    for k in range(20):  # each link is similar to the next, the ends are not
        chain[3 * k] = f"c{k}"
        rows.append(" ".join(chain))
    rows += [rows[5]] * 40 + [rows[6].upper()] * 3 + ["one", "one", "one two", "ONE  two", "", " \t", None]
    rows += [" ".join(f"s{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_family_matches_brute_force(spark, family):
    assert run(spark, family) == brute(family)


def test_pipeline_parameters(spark, family):
    assert run(spark, family, width=5, percent=80) == brute(family, 5, 80)


def test_documents_match_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in md.op5_minmax_dedup(spark, sf).collect()}
    assert got == brute(rows)


def test_short_passage_families(spark):
    """Many short texts that share most words but not enough: buckets stay open and are settled."""
    rng = random.Random(8)
    base = [f"p{i}" for i in range(40)]
    rows = list(enumerate(edited(rng, base, rng.choice([0, 1, 2, 3, 4])) for _ in range(150)))
    assert run(spark, rows) == brute(rows)


def test_links_of_members_unlike_their_pivot(spark):
    """Where the pivot is linked with one of two linked documents only, whatever their sizes."""
    rng, rows = random.Random(11), []
    for f in range(100):
        word = lambda k, f=f: f"f{f}w{k}"
        p = [word(k) for k in range(102)]
        rows += [p, p + [word("x")], p + [word("x"), *(word(f"y{k}") for k in range(17))]]
    for f in range(20):  # the pivot is much larger than y; x shares y's own part
        word = lambda k, f=f: f"g{f}w{k}"
        y = [word(k) for k in range(70)] + [word(f"o{k}") for k in range(16)]
        rows += [y, y + [word(f"x{k}") for k in range(6)], [word(k) for k in range(100)]]
    rows = list(enumerate(" ".join(r) for r in rng.sample(rows, len(rows))))
    want = brute(rows)
    assert run(spark, rows) == want
    assert sum(i != c for i, _, c in want) >= 200


def test_form_letters_do_not_meet(spark, monkeypatch):
    """Texts that share a template but not enough stay apart, and few pairs are looked at."""
    rng, seen = random.Random(12), []
    base = [f"t{i}" for i in range(100)]
    rows = [" ".join(base + [f"z{rng.randrange(10**8)}" for _ in range(14)]) for _ in range(400)]
    rows += [rows[7] + " more", rows[9] + " more", "odd " + rows[11]]
    rows = list(enumerate(rows))
    keep = md.stored
    monkeypatch.setattr(md, "stored", lambda df, label: seen.append((label, (out := keep(df, label)).count())) or out)
    assert run(spark, rows) == brute(rows)
    assert all(n < 400 for label, n in seen if label == "difference-index")


def test_repeated_ids_with_unlike_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a + " x"), (5, b), (5, b), (9, b + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = md.near_duplicates(df).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {1}  # id 5 links both families
    assert [r["doc_id"] for r in md.drop_near_duplicates(df).collect()] == [1]
    kept = md.drop_near_duplicates(spark.createDataFrame([(3, a), (3, b), (3, b), (4, a + " x")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"][0]) for r in kept.collect()) == [(3, "a"), (3, "b")]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 2**64, 200, dtype=np.uint64)])
    (a, b), (c, d) = md.min_max_signature(np.unique(x)), md.min_max_signature(np.unique(y))
    same = np.concatenate([a == c, b == d]).mean()
    assert len(a) + len(b) == 2 * md.PERMUTATIONS and abs(same - 800 / 1200) < 0.12


def test_components_of_graphs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in md.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))


def test_odd_rows(spark, odd_docs, no_docs):
    got = md.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["n_shingles"] == 0 and by[2]["kept"] and by[6]["component_id"] == 1 and by[7]["component_id"] == 1
    assert by[None]["component_id"] is None and by[10]["component_id"] == 5
    kept = md.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in by if i is not None} - {6, 7, 10}) and ids.count(None) == 2
    assert md.near_duplicates(no_docs).count() == 0 and md.drop_near_duplicates(no_docs).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f")] * 4 + [(4, "q r s t u v")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in md.drop_near_duplicates(df).collect()) == [3, 4]


def test_bands_fit_the_threshold():
    import numpy as np

    from rowloom.llm import minmax_dedup as mm

    assert mm.band_shape(85) == (24, 6) and mm.band_shape(80) == (28, 5)
    for percent in range(5, 101):
        bands, rows = mm.band_shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= mm.MISS
    bands, rows = mm.band_shape(80)
    rng, missed = np.random.default_rng(5), 0
    for _ in range(10_000):  # pairs of similarity 0.8 exactly; 24 bands of 6 miss about seven
        x = rng.integers(0, 2**64, 100, dtype=np.uint64)
        a, b = (mm.band_keys(*mm.min_max_signature(s, bands * rows // 2), rows) for s in (x[:90], np.concatenate([x[:80], x[90:]])))
        missed += not (a == b).any()
    assert missed <= 1
