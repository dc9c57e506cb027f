"""Quality rules (7): base rules and robust multivariate outliers.

Method: every document becomes a vector of five transformed statistics.  For each
(language, source) group a minimum-covariance-determinant estimate of centre and
scatter is fitted by concentration steps; documents whose squared Mahalanobis
distance exceeds a chi-square quantile are rejected.

A concentration step is one aggregation over all rows: rows are binned by the
logarithm of their distance, each bin carries counts, sums and cross products, and the
nearest bins that hold a share ``h`` of the group give the next centre and scatter.
Languages and all rows are groups too: a source's moments are those of its own nearest rows
and of ``prior`` rows like its language's, and a language's of ``prior`` rows like all rows', so every
source has its own estimate, the closer to its language's the fewer rows it has.
Steps run from two starts, medians with quartile spreads and means with full scatter; each
group keeps the estimate of the smaller determinant.

Vectors are fixed-point integers, so sums are exact and do not depend on row order.
No group is ever collected: a hot source costs one partial row per bin and task, which meet by
(group, bin) in a stored table before anything is dealt by group.

Defined cases: null or empty text counts as zero words and fails the base rule; null
``lang`` or ``source`` is a group value of its own; a group without passing rows has its
language's estimate; equal rows get equal verdicts; an empty table gives an empty
result; other columns of the input are ignored by ``quality_scores`` and kept
unchanged by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rowloom.llm._shared import discard, if_small, load, small_batches, stored
from rowloom.llm.text_stats import count_text

STAT_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIM = 5
#: Fixed-point steps of a transformed statistic.
SCALE = 256
#: Least standard deviation of each transformed statistic: word length, symbols,
#: repeated lines, repeated words, length.  Most clean texts have no symbols and no
#: repetition at all, so these scatters would otherwise vanish.
FLOORS = (0.05, 0.25, 0.2, 0.2, 0.5)
BINS_PER_OCTAVE = 16
#: Rows of its parent's kind that count in a group's moments.
PRIOR = 50
STARTS = (0, 1)


@pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in STAT_NAMES]))
def _stats(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in text], columns=STAT_NAMES, dtype="int64")


def _chi2_cdf(x: float, k: int) -> float:
    """Series for the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics as integers (rows with at least one word)."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    raw = [
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / words, F.lit(1.0)))),
        F.log(words),
    ]
    return [F.round(r * SCALE).cast("long").alias(f"x{i}") for i, r in enumerate(raw)]


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance to the joined estimate (columns c*, p*_*)."""
    dev = [(x[i] / F.lit(float(SCALE)) - F.col(f"c{i}")) for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + F.lit(1.0 if i == j else 2.0) * F.col(f"p{i}_{j}") * dev[i] * dev[j]
    return total


_CELLS = [f"{i}_{j}" for i in range(DIM) for j in range(i, DIM)]
MOMENTS = [f"s{i}" for i in range(DIM)] + [f"q{c}" for c in _CELLS]
MODEL = "start int, grp string, logdet double, " + ", ".join([f"c{i} double" for i in range(DIM)] + [f"p{c} double" for c in _CELLS])


def _finish(factor: float):
    """From a group's mean moments to centre and floored, inverted scatter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in MODEL.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(DIM)], float) / SCALE
                cov = np.zeros((DIM, DIM))
                for i in range(DIM):
                    for j in range(i, DIM):
                        cov[i, j] = cov[j, i] = float(r[f"q{i}_{j}"]) / SCALE**2 - mean[i] * mean[j]
                cov *= factor
                cov[np.diag_indices(DIM)] += np.maximum(0, np.square(FLOORS) - np.diag(cov))
                inv = np.linalg.inv(cov)
                rows.append(
                    [int(r["start"]), r["grp"], float(np.linalg.slogdet(cov)[1]), *mean]
                    + [inv[i, j] for i in range(DIM) for j in range(i, DIM)]
                )
            yield pd.DataFrame(rows, columns=names)

    return run


def _stats_table(docs: DataFrame, id_col: str, text: str, lang: str, source: str) -> DataFrame:
    """doc_id, language and source keys, counts, base verdict and vector; no text."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.to_json(F.array(F.col(lang))).alias("lang_key"),
        F.to_json(F.array(F.col(lang), F.col(source))).alias("src_key"),
        _stats(F.col(text)).alias("s"),
    )
    flat = base.select("doc_id", "lang_key", "src_key", *[F.col(f"s.{n}").alias(n) for n in STAT_NAMES])
    return flat.select("*", _base_failed().alias("base_failed"), *_vector())


def _tree(stats: DataFrame) -> DataFrame:
    """grp and parent of every source, language, and of all rows (stored)."""
    per = stats.select("lang_key", "src_key").distinct()
    rows = per.select(F.col("src_key").alias("grp"), F.col("lang_key").alias("parent"))
    rows = rows.unionByName(per.select(F.col("lang_key").alias("grp"), F.lit("all").alias("parent")).distinct())
    top = stats.sparkSession.createDataFrame([("all", None)], "grp string, parent string")
    return stored(rows.unionByName(top), "groups")


def _fit_rows(stats: DataFrame) -> DataFrame:
    """Every passing row under its source, its language and all."""
    good = stats.where(~F.col("base_failed"))
    return good.select(F.explode(F.array("src_key", "lang_key", F.lit("all"))).alias("grp"), *[f"x{i}" for i in range(DIM)])


def _sums() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(DIM)]
    return [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(DIM) for j in range(i, DIM)]


def _shrunk(totals: DataFrame, tree: DataFrame, prior: float) -> DataFrame:
    """Mean moments of each group of ``tree``, with ``prior`` rows like its parent's.

    totals: start, grp, m (rows) and sums.  A row a group and start: few enough to be joined
    level by level.
    """
    base = tree.select("*", F.explode(F.array(*map(F.lit, STARTS))).alias("b_start"))
    t = totals.withColumnRenamed("grp", "t_grp")
    own = base.join(t, (base["grp"] == t["t_grp"]) & (base["b_start"] == t["start"]), "left")
    own = own.select(F.col("b_start").alias("start"), "grp", "parent", F.coalesce("m", F.lit(0)).alias("m"), *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in MOMENTS])
    own = stored(own, "moments")

    def under(rows: DataFrame, above: DataFrame) -> DataFrame:
        up = above.select(F.col("start").alias("u_start"), F.col("grp").alias("u_grp"), *[F.col(c).alias(f"u_{c}") for c in MOMENTS])
        both = rows.join(up, (rows["parent"] == up["u_grp"]) & (rows["start"] == up["u_start"]))
        return both.select("start", "grp", *[((F.col(c) + prior * F.col(f"u_{c}")) / F.greatest(F.col("m") + prior, F.lit(1e-9))).alias(c) for c in MOMENTS])

    top = own.where("grp = 'all'").select("start", "grp", *[(F.col(c) / F.greatest("m", F.lit(1))).alias(c) for c in MOMENTS])
    lang = under(own.where("parent = 'all'"), top)
    out = stored(top.unionByName(lang).unionByName(under(own.where("parent <> 'all'"), lang)), "shrunk")
    discard(own)
    return out


def _quartiles(rows: DataFrame) -> DataFrame:
    """The first start: coordinatewise medians and quartile spreads, exact, from value counts."""
    long = rows.select("grp", F.posexplode(F.array(*[f"x{i}" for i in range(DIM)])).alias("dim", "x"))
    counts = stored(long.groupBy("grp", "dim", "x").count(), "value-counts")
    w = Window.partitionBy("grp", "dim").orderBy("x")
    cum = counts.select(
        "grp", "dim", "x", F.sum("count").over(w).alias("cum"), F.sum("count").over(Window.partitionBy("grp", "dim")).alias("n")
    )
    at = [F.min(F.when(F.col("cum") >= F.col("n") * p, F.col("x"))).alias(a) for p, a in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))]
    quart = cum.groupBy("grp", "dim").agg(*at)
    spread = F.greatest((F.col("hi") - F.col("lo")) / SCALE / 1.349, F.element_at(F.array(*map(F.lit, FLOORS)), F.col("dim") + 1))
    cell = quart.select("grp", "dim", (F.col("mid") / SCALE).alias("c"), (1 / spread**2).alias("p"))
    wide = [F.max(F.when(F.col("dim") == i, F.col("c"))).alias(f"c{i}") for i in range(DIM)]
    for i in range(DIM):
        for j in range(i, DIM):
            value = F.max(F.when(F.col("dim") == i, F.col("p"))) if i == j else F.lit(0.0)
            wide.append(value.alias(f"p{i}_{j}"))
    out = stored(cell.groupBy("grp").agg(*wide).select(F.lit(STARTS[0]).alias("start"), "grp", F.lit(1e300).alias("logdet"), *[f"c{i}" for i in range(DIM)], *[f"p{c}" for c in _CELLS]), "start")
    discard(counts)
    return out


def _start(rows: DataFrame, tree: DataFrame, prior: float) -> DataFrame:
    """Both starts of every group."""
    whole = stored(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), *_sums()).withColumn("start", F.lit(STARTS[1])), "sums")
    means = _shrunk(whole, tree, prior).where(F.col("start") == STARTS[1]).mapInPandas(_finish(1.0), MODEL)
    return stored(_quartiles(rows).unionByName(means), "mcd")


def _concentrate(rows: DataFrame, model: DataFrame, tree: DataFrame, share: float, factor: float, prior: float) -> DataFrame:
    """One concentration step for all groups and starts at once."""
    m = model.withColumnRenamed("grp", "m_grp").drop("logdet")
    joined = rows.join(if_small(_same_path(m, model)), rows["grp"] == m["m_grp"])
    x = [F.col(f"x{i}") for i in range(DIM)]
    bin_ = F.floor(F.log2(_distance(x) + F.lit(2.0**-20)) * BINS_PER_OCTAVE).cast("int").alias("bin")
    bins = joined.select("start", "grp", *x, bin_).groupBy("start", "grp", "bin").agg(F.count(F.lit(1)).alias("m"), *_sums())
    bins = stored(bins, "bins")
    w = Window.partitionBy("start", "grp")
    before = F.coalesce(F.sum("m").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = bins.withColumn("before", before).withColumn("n", F.sum("m").over(w))
    near = ranked.where(F.col("before") < F.col("n") * share)
    total = stored(near.groupBy("start", "grp").agg(*[F.sum(c).alias(c) for c in ("m", *MOMENTS)]), "near")
    new = stored(_shrunk(total, tree, prior).mapInPandas(_finish(factor), MODEL), "mcd")
    discard(bins, total, model)
    return new


def _same_path(df: DataFrame, stored_df: DataFrame) -> DataFrame:
    df._rowloom_path = stored_df._rowloom_path
    return df


def fit_mcd(stats: DataFrame, *, share: float = 0.75, max_steps: int = 6, prior: float = PRIOR) -> DataFrame:
    """Estimates (grp, logdet, centre c*, inverse scatter p*) of every (language, source), language
    and of all rows."""
    factor = share / _chi2_cdf(chi2_quantile(share, DIM), DIM + 2)
    tree = _tree(stats)
    rows = _fit_rows(stats)
    model = _start(rows, tree, prior)
    last = None
    for _ in range(max_steps):
        model = _concentrate(rows, model, tree, share, factor, prior)
        fit = model.agg(F.sum("logdet")).first()[0]
        if fit is None or (last is not None and fit >= last - 1e-9):
            break
        last = fit
    best = F.min_by(F.struct(*[c for c in model.columns if c != "grp"]), F.struct("logdet", "start"))
    out = stored(model.groupBy("grp").agg(best.alias("b")).select("grp", "b.*"), "estimates")
    discard(tree, model)
    return out


def _judged(stats: DataFrame, model: DataFrame, cutoff_p: float) -> DataFrame:
    cutoff = chi2_quantile(cutoff_p, DIM)
    m = _same_path(model.withColumnRenamed("grp", "m_grp").drop("start", "logdet"), model)
    joined = stats.join(if_small(m), stats["src_key"] == m["m_grp"], "left")
    d = _distance([F.col(f"x{i}") for i in range(DIM)])
    return joined.withColumn("distance", d).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    )


def quality_scores(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    cutoff_p: float = 0.9999,
    **fit,
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance, one row per input row."""
    with small_batches(docs.sparkSession):
        stats = stored(_stats_table(docs, id_col, text, lang, source), "stats")
    return _judged(stats, fit_mcd(stats, **fit), cutoff_p).select("doc_id", *STAT_NAMES, "base_failed", "kept", "distance")


def keep_good(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", cutoff_p: float = 0.9999, **fit
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows that pass the base rules are stored with their vectors, so that every text is
    counted once and none is shuffled.
    """
    packed = docs.withColumn("_row", F.struct(*docs.columns))
    with small_batches(docs.sparkSession):
        stats = _stats_table(packed, "_row", text, lang, source)
        good = stored(stats.where("not base_failed").withColumnRenamed("doc_id", "row").drop(*STAT_NAMES), "passing")
    return _judged(good, fit_mcd(good.drop("row"), **fit), cutoff_p).where("kept").select("row.*")


def op7_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_scores(docs).select(
        "doc_id", *STAT_NAMES, "base_failed", "kept", F.round("distance", 6).alias("distance")
    )


QUERIES = {"op7_quality_mcd": op7_quality_mcd}
SQL: dict[str, str] = {}
