import random
import zlib

import numpy as np
import pytest

from rowloom.llm import toxic_subwords as tx


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    clean, bad = [f"w{rng.randrange(10**6):x}or" for _ in range(3000)], ["stupidest", "disgusting", "worthless"]
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.choice([10, 60, 300]))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels), clean


def score(model, text):
    words = text.lower().split()
    v = np.array([model.values[tx.subwords(w)].mean() for w in words])
    return 1 / (1 + np.exp(-(model.slope * (tx.passage_scores(v).max() if words else model.empty) + model.offset)))


def test_unseen_misspellings(corpus):
    texts, labels, clean = corpus
    m = tx.train(texts, labels)
    rng = random.Random(9)
    plain = [" ".join(rng.choice(clean) for _ in range(100)) for _ in range(40)]
    toxic = [p + " " + w + " " + w for p, w in zip(plain, ["stupidestt", "disgustingg", "worthlesss", "sstupidest"] * 10)]
    s, t = np.array([score(m, x) for x in plain]), np.array([score(m, x) for x in toxic])
    assert (t >= 0.5).mean() > 0.9 and (s < 0.5).mean() > 0.9
    assert score(m, "") < 0.5


def test_same_training_twice(corpus):
    texts, labels, _ = corpus
    a, b = tx.train(texts[:200], labels[:200]), tx.train(texts[:200], labels[:200])
    assert np.array_equal(a.values, b.values) and a.slope == b.slope


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = tx.op8_toxic_subwords(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    j = rows.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in j)
    held = [r for r in j if r["held_out"]]
    p, n = (np.array([r["score"] for r in held if r["toxic"] == k]) for k in (1, 0))
    auc = np.mean([(x > n).mean() + (x == n).mean() / 2 for x in p])
    # 350 toxic texts to learn four languages from, and some labels contradict their texts;
    # the larger check tables reach 0.99 and more
    assert auc > 0.9 and (p >= 0.5).mean() > 0.65 and (n < 0.5).mean() > 0.97


def test_scores_match_a_plain_version(spark, sf, corpus):
    """Whole texts, scored one word and one n-gram at a time."""
    texts, labels, _ = corpus
    m = tx.train(texts[:300], labels[:300])
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:80]
    docs += [(1000, ""), (1001, None), (1002, "stupidestt"), (1003, texts[0]), (1004, " \n ")]
    got = {r["doc_id"]: r["score"] for r in tx.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), m).collect()}
    for i, t in docs:
        words = (t or "").lower().split()
        v = [float(np.mean([m.values[b] for b in tx.subwords(w)])) for w in words]
        starts = [min(k, max(len(v) - tx.WINDOW, 0)) for k in range(0, max(len(v) - tx.WINDOW, 0) + tx.STRIDE, tx.STRIDE)]
        x = max(sum(v[a : a + tx.WINDOW]) / len(v[a : a + tx.WINDOW]) for a in starts) if v else m.empty
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30))), abs=1e-4)


def test_few_labelled_texts_teach_something():
    clean = ["the cat sat on the mat", "we went to the market", "rain fell all day long", "a quiet evening at home"]
    texts = [f"{c} you {w} fool" for c, w in zip(clean, ["worthless"] * 4)] + clean
    m = tx.train(texts, np.array([1] * 4 + [0] * 4))
    assert score(m, "so worthless indeed") > score(m, "so quiet indeed")


def test_sample_is_bounded_in_bytes(spark, corpus):
    texts, labels, _ = corpus
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:60])] + [(60, "x " * 5_000_000)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels[:60])] + [(60, 0)], "doc_id long, toxic int")
    a, b = tx.fit_toxicity(docs, known, max_bytes=1 << 20), tx.fit_toxicity(docs.where("doc_id < 60"), known, max_bytes=1 << 20)
    assert np.array_equal(a.values, b.values)
    assert tx.fit_toxicity(docs, known, max_bytes=1) is None


def test_passages():
    a, b = tx.windows(5)
    assert (a.tolist()[0], b.tolist()[-1]) == (0, 5)
    for n in (8, 9, 12, 100):
        a, b = tx.windows(n)
        assert a[0] == 0 and b[-1] == n and set(b - a) == {tx.WINDOW}
        assert {i for s, e in zip(a, b) for i in range(s, e)} == set(range(n))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    m = tx.fit_toxicity(odd_docs, labels)
    out = tx.score_toxicity(odd_docs, m)
    assert out.count() == odd_docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert tx.score_toxicity(no_docs, m).count() == 0
    assert tx.fit_toxicity(no_docs, labels) is None and tx.fit_toxicity(odd_docs, labels.limit(0)) is None
    assert tx.score_toxicity(odd_docs, None).where("score = 0").count() == odd_docs.count()
