"""Toxicity (8): averaged subword-bag embeddings under a linear softmax, trained in numpy.

Method: a word is the mean of the embeddings of its character n-grams (hashed) and of
itself; a passage is the mean of its words; a linear softmax over the two labels reads
the mean.  Embeddings and softmax are trained jointly by adaptive gradient steps, so
unseen misspellings score like the words whose n-grams they share.

A text is scored by its most toxic passage of ``WINDOW`` words, so one insult in a long
text counts like one in a short text, and whole texts are read.  Labels belong to
texts, so training chooses each toxic text's most toxic passage as the positive example,
and the most toxic passage of each other text besides random ones as negatives; the
first round takes them by the words' association with toxic texts, later ones by the
model.  A final one-dimensional logistic fit calibrates the score.

Training uses a bounded sample: at most ``per_label`` labelled texts and ``max_bytes`` bytes of each
label (the smallest hashes of their ids; a text that no longer fits is passed over), with words counted
over whole texts.  Scoring needs one
number per hash bucket, which is broadcast (``BUCKETS`` floats, fixed).

Defined cases: null and empty texts score like the median clean training text; with no labelled text of either label all scores are 0; null ids are scored and
never used for training; repeated rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rowloom.llm._shared import discard, load, stored

BUCKETS, DIM = 1 << 17, 16
NGRAMS = (3, 4, 5)
WINDOW, STRIDE = 8, 4
PER_LABEL = 2000
#: A bucket met in n training texts counts by n / (n + RARITY): what few texts hold is hardly learned.
RARITY = 4.0
#: Training texts are taken by the hashes of their ids up to this many bytes for each label.
MAX_BYTES = 64 << 20
EPOCHS, BATCH, RATE = 12, 512, 0.5
_EDGES = string.punctuation + "«»“”„…–—¿¡"


def _powers(n: int) -> np.ndarray:
    """Odd multipliers for the places in a word."""
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15 | 1, np.uint64))


def subword_bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words' n-grams and of the words, and the number of each one's word.

    The words stand in one array of code points between ``<`` and ``>``; n-grams that
    would reach into the next word are left out.
    """
    framed = [f"<{w.strip(_EDGES)}>" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    power = _powers(int(sizes.max(initial=1)))
    whole = np.add.reduceat(code * power[np.arange(len(code)) - starts[word]], starts) if len(words) else code
    hashes, owners = [whole], [np.arange(len(words))]
    for n in NGRAMS:
        m = len(code) - n + 1
        if m > 0:
            inside = word[:m] == word[n - 1 :]
            h = sum(code[k : k + m] * power_k for k, power_k in enumerate(_powers(n))) + np.uint64(n)
            hashes.append(h[inside])
            owners.append(word[:m][inside])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def subwords(word: str) -> list[int]:
    return subword_bags([word])[0].tolist()


def word_values(words: list[str], bucket_values: np.ndarray) -> np.ndarray:
    """Mean value of each word's buckets."""
    rows, owner = subword_bags(words)
    return np.bincount(owner, bucket_values[rows], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of a text of ``n`` words (one at least)."""
    starts = np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE)
    starts = np.minimum(starts, max(n - WINDOW, 0))
    return starts, np.minimum(starts + WINDOW, n)


def passage_scores(values: np.ndarray) -> np.ndarray:
    """Mean of the words' values in every passage."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    a, b = windows(len(values))
    return (total[b] - total[a]) / np.maximum(b - a, 1)


class _Sample:
    """Labelled texts as word numbers, and every word's buckets."""

    def __init__(self, texts: list[str | None], labels: np.ndarray):
        self.y = labels.astype(float)
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in (t or "").lower().split()], np.int64) for t in texts]
        rows, owner = subword_bags(list(number))
        order = np.argsort(owner, kind="stable")
        self.flat = rows[order]
        self.sizes = np.bincount(owner, minlength=len(number))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.df, self.pos = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for d, y in zip(self.docs, self.y):
            met = np.unique(self.rows_of(np.unique(d))[0])
            self.df[met] += 1
            self.pos[met] += int(y)
        # buckets of few texts would only memorise them
        self.trust = self.df / (self.df + RARITY)

    def word_values(self, bucket_values: np.ndarray) -> np.ndarray:
        if not len(self.sizes):
            return np.empty(0)
        return np.add.reduceat(bucket_values[self.flat], self.starts[:-1]) / self.sizes

    def first_values(self) -> np.ndarray:
        """How surely each word has a bucket of toxic texts: its buckets' greatest z-score.

        Log odds of document counts with a prior, over their standard error; below 2
        nothing is sure.
        """
        n1 = self.y.sum()
        n0 = len(self.y) - n1
        prior = 10 * n1 / (n1 + n0)
        a, b = self.pos + prior, self.df - self.pos + 10 - prior
        z = (np.log(a / (n1 - self.pos + 10)) - np.log(b / (n0 - self.df + self.pos + 10))) / np.sqrt(1 / a + 1 / b)
        z = np.where(z > 2, z, 0.0)
        return np.maximum.reduceat(z[self.flat], self.starts[:-1]) if len(self.flat) else np.empty(0)

    def rows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the given words, one after another, and the position of each one's word."""
        n = self.sizes[words]
        owner = np.repeat(np.arange(len(words)), n)
        first = np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return self.flat[first + np.arange(n.sum())], owner


class ToxicModel:
    """One value per bucket (the softmax's log odds of its embedding), calibration, and the
    value of a text without words."""

    def __init__(self, values: np.ndarray, slope: float, offset: float, empty: float):
        self.values, self.slope, self.offset, self.empty = values, slope, offset, empty


def train(texts: list[str | None], labels: np.ndarray, *, odds: float | None = None, seed: int = 5) -> ToxicModel | None:
    """Joint training of embeddings and softmax; None unless both labels occur.

    ``odds``: of the positive label among all labelled texts, if the sample has other ones.
    """
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    data = _Sample(texts, labels)
    emb, trust = rng.normal(0, 0.1, (BUCKETS, DIM)), data.trust
    soft, bias = np.stack([-np.ones(DIM), np.ones(DIM)]) * rng.normal(0, 0.3, DIM), np.zeros(2)
    emb_g, soft_g, bias_g = np.full(BUCKETS, 1e-6), np.full((2, DIM), 1e-6), np.full(2, 1e-6)
    live = [i for i, d in enumerate(data.docs) if len(d)]
    for epoch in range(EPOCHS):
        picks: list[tuple[np.ndarray, float]] = []
        values = data.first_values() if epoch == 0 else data.word_values(emb @ (soft[1] - soft[0]) * trust)
        for i in live:
            d = data.docs[i]
            a, b = windows(len(d))
            top = int(passage_scores(values[d]).argmax())
            use = [top] if data.y[i] else {top, *rng.integers(0, len(a), 2).tolist()}
            picks += [(d[a[k] : b[k]], data.y[i]) for k in use]
        rng.shuffle(picks := np.array(picks, dtype=object))
        for at in range(0, len(picks), BATCH):
            part = picks[at : at + BATCH]
            y = np.array([p[1] for p in part], float)
            sizes = np.array([len(p[0]) for p in part])
            words, inverse = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
            owner = np.repeat(np.arange(len(part)), sizes)
            rows, of = data.rows_of(words)
            vec = np.zeros((len(words), DIM))
            np.add.at(vec, of, emb[rows] * trust[rows, None])
            vec /= data.sizes[words][:, None]
            mean = np.zeros((len(part), DIM))
            np.add.at(mean, owner, vec[inverse])
            mean /= sizes[:, None]
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.stack([1 - y, y], 1)) / len(part)
            g_soft, g_bias, g_mean = d.T @ mean, d.sum(0), d @ soft
            g_word = np.zeros((len(words), DIM))
            np.add.at(g_word, inverse, (g_mean / sizes[:, None])[owner])
            g_word /= data.sizes[words][:, None]
            used, back = np.unique(rows, return_inverse=True)
            g = np.zeros((len(used), DIM))
            np.add.at(g, back, g_word[of] * trust[rows, None])
            emb_g[used] += (g**2).mean(1)
            emb[used] -= RATE * g / np.sqrt(emb_g[used])[:, None]
            soft_g += g_soft**2
            soft -= RATE * g_soft / np.sqrt(soft_g)
            bias_g += g_bias**2
            bias -= RATE * g_bias / np.sqrt(bias_g)
    values = emb @ (soft[1] - soft[0]) * trust
    words = data.word_values(values)
    x = np.array([passage_scores(words[data.docs[i]]).max() for i in live])
    y = data.y[live]
    if len(set(y.tolist())) < 2:
        return None
    slope, offset = _calibrate(x, y)
    if odds:
        offset += float(np.log(odds) - np.log(y.sum() / (len(y) - y.sum())))
    return ToxicModel(values.astype(np.float32), slope, offset, float(np.median(x[y == 0])))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly penalised logistic fit (Newton steps)."""
    scale = x.std() + 1e-9
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.01])
        w = w + np.clip(np.linalg.solve(h, a.T @ (y - p) - np.array([0.05, 0.01]) * w), -5, 5)
    return float(w[0] / scale), float(w[1])


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text: str = "text", label: str = "toxic"
) -> ToxicModel | None:
    """Train on at most ``per_label`` texts and ``max_bytes`` bytes of each label that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("l_id"), F.col("l_id")]
    n1, n0 = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    some = known.where("y = 0").orderBy(*order).limit(per_label).unionByName(known.where("y = 1").orderBy(*order).limit(per_label))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(some), texts["id"] == some["l_id"]).groupBy("id", "y").agg(F.max("text").alias("text"))
    rows = stored(rows, "toxic-sample")
    sizes = rows.select("id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("id").alias("h")).collect()
    left, use = {0: max_bytes, 1: max_bytes}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"])):
        if r["size"] <= left[r["y"]]:
            left[r["y"]] -= r["size"]
            use.append(r["id"])
    sample = sorted(rows.where(F.col("id").isin(use)).collect(), key=lambda r: r["id"])  # bounded by per_label and max_bytes
    discard(rows)
    return train([r["text"] for r in sample], np.array([r["y"] for r in sample], int), odds=n1 / n0 if n0 else None)


def score_toxicity(docs: DataFrame, model: ToxicModel | None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.values)
    slope, offset, empty = model.slope, model.offset, model.empty

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 500):  # the words of a few hundred texts at a time
            split = [t.lower().split() if t else [] for t in texts.iloc[at : at + 500]]
            fresh = sorted(set().union(*split))
            value = dict(zip(fresh, word_values(fresh, shared.value).tolist()))
            for words in split:
                v = np.fromiter(map(value.__getitem__, words), np.float32, len(words))
                out.append(passage_scores(v).max() if words else empty)
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * np.array(out, float) + offset, -30, 30))))

    return docs.select(F.col(id_col).alias("doc_id"), score(F.col(text)).alias("score"))


def op8_toxic_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op8_toxic_subwords": op8_toxic_subwords}
SQL: dict[str, str] = {}
