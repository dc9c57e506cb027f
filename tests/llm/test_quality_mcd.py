import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import quality_mcd as qm
from rowloom.llm.text_stats import count_text


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    often = [i for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len({i + k for i in often for k in range(3)})


@settings(max_examples=500, deadline=None, database=None)
@given(st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\x85 é漢#*| ", max_size=60))
def test_counts(text):
    assert count_text(text) == plain(text)


def test_counts_of_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = qm.op7_quality_mcd(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in qm.STAT_NAMES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_labelled_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = qm.op7_quality_mcd(spark, sf).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in j if r["quality"]], [r["kept"] for r in j if not r["quality"]]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05


def test_chi2():
    assert qm.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert qm.chi2_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


def moments(x):
    """Rows, sums and cross products of fixed-point rows."""
    x = x.astype(float)
    return len(x), x.sum(0), x.T @ x


def finish(mean, cross, factor):
    center = mean / qm.SCALE
    cov = factor * (cross / qm.SCALE**2 - np.outer(center, center))
    cov[np.diag_indices(qm.DIM)] += np.maximum(0, np.square(qm.FLOORS) - np.diag(cov))
    return center, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def quartile_start(x):
    n, s = len(x), np.sort(x, axis=0)
    at = lambda p: s[int(np.ceil(n * p)) - 1] / qm.SCALE
    return at(0.5), np.diag(1 / np.maximum((at(0.75) - at(0.25)) / 1.349, qm.FLOORS) ** 2), 1e300


def shrunk(parts, tree, prior):
    """Mean moments by group; tree: group -> parent, parents first."""
    out = {}
    for g, up in tree.items():
        m, s, q = parts.get(g, (0, np.zeros(5), np.zeros((5, 5))))
        out[g] = (s / max(m, 1), q / max(m, 1)) if up is None else ((s + prior * out[up][0]) / max(m + prior, 1e-9), (q + prior * out[up][1]) / max(m + prior, 1e-9))
    return out


def plain_mcd(rows, share=0.75, steps=6, prior=qm.PRIOR):
    """Estimates by group from rows (language key, source key, vector): the same steps in numpy."""
    factor = share / qm._chi2_cdf(qm.chi2_quantile(share, qm.DIM), qm.DIM + 2)
    tree = {"all": None} | {r[0]: "all" for r in rows} | {r[1]: r[0] for r in rows}
    xs = {g: np.array([r[2] for r in rows if g in ("all", r[0], r[1])]) for g in tree}
    first = shrunk({g: moments(x) for g, x in xs.items()}, tree, prior)
    model = {(0, g): quartile_start(xs[g]) for g in tree} | {(1, g): finish(*first[g], 1.0) for g in tree}
    last = None
    for _ in range(steps):
        near = {}
        for (k, g), (center, inv, _) in model.items():
            d = xs[g] / qm.SCALE - center
            bins = np.floor(np.log2(np.einsum("ni,ij,nj->n", d, inv, d) + 2.0**-20) * qm.BINS_PER_OCTAVE)
            edge = np.sort(bins)[int(np.ceil(len(bins) * share)) - 1]
            near[k, g] = moments(xs[g][bins <= edge])
        model = {}
        for k in qm.STARTS:
            model |= {(k, g): finish(*m, factor) for g, m in shrunk({g: near[k, g] for g in tree}, tree, prior).items()}
        fit = sum(m[2] for m in model.values())
        if last is not None and fit >= last - 1e-9:
            break
        last = fit
    return {g: min((model[k, g] for k in qm.STARTS), key=lambda m: m[2]) for g in tree}


def test_estimates_match_numpy_and_resist_outliers(spark):
    rng = np.random.default_rng(1)
    good = rng.normal([450, 0, 0, 0, 1500], [20, 30, 30, 30, 200], (600, 5))
    x = np.concatenate([good, rng.normal([900, 900, 0, 0, 1500], 5, (120, 5))]).round().astype(int)
    cols = ["doc_id", "lang_key", "src_key", "base_failed"] + [f"x{i}" for i in range(5)]
    stats = spark.createDataFrame([(i, "l", "s", False, *map(int, r)) for i, r in enumerate(x)], cols)
    want = plain_mcd([("l", "s", r) for r in x])
    for r in qm.fit_mcd(stats, max_steps=6).collect():
        center, inv, _ = want[r["grp"]]
        assert np.allclose([r[f"c{i}"] for i in range(5)], center)
        assert np.allclose([r[f"p{i}_{j}"] for i in range(5) for j in range(i, 5)], [inv[i, j] for i in range(5) for j in range(i, 5)])
    dev = x / qm.SCALE - want["s"][0]
    far = np.einsum("ni,ij,nj->n", dev, want["s"][1], dev) > qm.chi2_quantile(0.9999, 5)
    assert far[600:].all() and far[:600].mean() < 0.01


def test_verdicts_on_documents_match_numpy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = qm._stats_table(docs, "doc_id", "text", "lang", "source").collect()
    vector = lambda r: [r[f"x{i}"] for i in range(qm.DIM)]
    model = plain_mcd([(r["lang_key"], r["src_key"], vector(r)) for r in rows if not r["base_failed"]])
    got = {r["doc_id"]: r for r in qm.op7_quality_mcd(spark, sf).collect()}
    cutoff = qm.chi2_quantile(0.9999, qm.DIM)
    for r in rows:
        if r["src_key"] in model:
            d = np.array(vector(r)) / qm.SCALE - model[r["src_key"]][0]
            dist = d @ model[r["src_key"]][1] @ d
            assert got[r["doc_id"]]["distance"] == pytest.approx(dist, rel=1e-6, abs=1e-5)
            assert got[r["doc_id"]]["kept"] == (not r["base_failed"] and dist <= cutoff)


def test_estimates_move_from_the_language_to_the_source(spark):
    """The more rows a source has, the more its centre is its own; no size switches."""
    rng = np.random.default_rng(3)
    sizes, rows = [3, 30, 300], []
    for k, n in enumerate(sizes):
        rows += [("l", f"s{k}", r) for r in rng.normal([450, 0, 0, 0, 1800], 20, (n, 5)).round().astype(int)]
    rows += [("l", "big", r) for r in rng.normal([450, 0, 0, 0, 1500], 20, (3000, 5)).round().astype(int)]
    cols = ["doc_id", "lang_key", "src_key", "base_failed"] + [f"x{i}" for i in range(5)]
    stats = spark.createDataFrame([(i, a, b, False, *map(int, r)) for i, (a, b, r) in enumerate(rows)], cols)
    c = {r["grp"]: r["c4"] * qm.SCALE for r in qm.fit_mcd(stats).collect()}
    assert 1500 - 10 < c["big"] < c["s0"] < c["s1"] < c["s2"] < 1800 + 10
    assert set(c) == {"all", "l", "big", "s0", "s1", "s2"}


def test_odd_rows(spark, odd_docs, no_docs):
    got = qm.quality_scores(odd_docs)
    assert got.count() == odd_docs.count()
    kept = qm.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(r[0]) for r in got.where("kept").select("doc_id").collect())
    assert qm.quality_scores(no_docs).count() == 0 and qm.keep_good(no_docs).count() == 0
