import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import topk_search as ts
from tests.helpers import same
from tests.llm.conftest import with_clashes

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append(tuple(math.floor(float(np.float32(x)) * 256) for x in v))
    out = set()
    for q in good:
        if q % 50:
            continue
        found = {(-sum(a * b for a, b in zip(x, y)), i) for x in good[q] for i in good for y in good[i] if i != q and len(x) == len(y)}
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def run(spark, rows, **options):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = ts.top_k(df, F.col("vec_id") % 50 == 0, **options)
    return {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()}


def test_matches_sql(spark, sf):
    same(ts.op1_topk_search(spark, sf), ts.SQL["op1_topk_search"], sf)


@pytest.mark.parametrize("dim", [1, 16, 40])
def test_brute_force_with_ties_nulls_and_repeats(spark, dim):
    rng = random.Random(dim)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0, rng.random()]) for _ in range(dim)]) for i in range(300)]
    rows += [(300 + i, [1.0] * dim) for i in range(40)] + rows[:60]
    rows += [(400, None), (450, [None] * dim), (500, [float("nan")] * dim), (501, [float("inf")] * dim), (None, [1.0] * dim), (550, [1.0] * (dim + 1)), (600, [])]
    assert run(spark, rows, block_bytes=3 * 8 * (dim + 1), candidate_block=64) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [3e5 + i, -1e5 * i, 7.0]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0])]) == set()


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(1)
    c, q = rng.integers(-256, 256, (64, 5000)).astype(float), rng.integers(-256, 256, (64, 7)).astype(float)
    best = ts.search_block(np.arange(7) - 100, q, np.arange(5000), c, 5)
    for n, b in enumerate(best):
        s = (q[:, n] @ c).astype(int)
        want = sorted(range(5000), key=lambda i: (-s[i], i))[:5]
        assert b.ids.tolist() == want and b.scores.tolist() == [s[i] for i in want]
