"""Exact top-k search (1): columnar branch and bound over integer inner products.

Method: vectors are kept in vertical layout (dimensions by rows).  Scores accumulate
one block of dimensions after another; after each block a candidate's score cannot
exceed its partial sum plus the product of the remaining norms (Cauchy-Schwarz), so
candidates whose bound is below the query's k-th best score are dropped and the
survivors are compacted.  Results are exact; ties go to the smaller id.

Vectors are dealt once into blocks of bounded bytes, packed by dimensions, and stored.  Every block of
queries is broadcast (its size is bounded) to the stored candidate blocks of its length, so candidates are
never shuffled again: the shuffle grows with the table, the work with queries times rows.  Each pair of blocks
gives k rows per query, which are merged per query.

Defined cases: null vectors and vectors with null or non-finite components take no
part, neither do rows with a null id, nor vectors of another length than the query's;
a query never meets rows with its own id; repeated rows of a query give one list;
repeated candidate rows are one candidate; scores beyond 64 bits are ranked exactly and
given as the nearest 64-bit number; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm._shared import discard, if_small, load, stored

FACTOR = 256
#: Bytes of a packed block of queries or candidates, and the most rows of a candidate block.
BLOCK_BYTES, CANDIDATE_BLOCK = 8 << 20, 16384
#: Tasks that pack blocks, at most.
MAX_TASKS = 20_000
#: Queries scored at once.
QUERIES_AT_ONCE = 1024
#: Dimensions per block, and rows per step inside a block of candidates.
DIMS, STEP = 16, 2048
_EXACT, _LONG = float(2**53), 2**63 - 1

_OUT = "query_id long, vec_id long, score long"


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]


def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of what remains from each block of dimensions on; m is dims x rows."""
    square = np.square(m)
    parts = [square[d:].sum(0) for d in range(0, max(len(m), 1), DIMS)] + [np.zeros(m.shape[1])]
    return np.sqrt(np.array(parts)) * (1 + 1e-12)


def search_block(q_ids, q, c_ids, c, k: int):
    """Top k of the candidates (dims x rows) for each query (dims x queries), as lists of _Best."""
    energy = np.argsort(-(np.abs(q).mean(1) * np.abs(c).mean(1)), kind="stable")
    q, c = q[energy], c[energy]
    q_rest, best = _suffix_norms(q), [_Best(k) for _ in q_ids]
    for at in range(0, len(c_ids), STEP):
        ids, v = c_ids[at : at + STEP], np.ascontiguousarray(c[:, at : at + STEP])
        c_rest = _suffix_norms(v)
        first = q[:DIMS].T @ v[:DIMS]
        bound = first + np.outer(q_rest[1], c_rest[1])
        for n, b in enumerate(best):
            alive = np.flatnonzero((bound[n] >= b.least) & (ids != q_ids[n]))
            partial = first[n, alive]
            for block, d in enumerate(range(DIMS, len(q), DIMS), 1):
                if not len(alive):
                    break
                partial = partial + q[d : d + DIMS, n] @ v[d : d + DIMS, alive]
                near = partial + q_rest[block + 1, n] * c_rest[block + 1, alive] >= b.least
                if not near.all():
                    alive, partial = alive[near], partial[near]
            if len(alive):
                b.add(partial.astype(np.int64), ids[alive])
    return best


_BLOCK = "dims int, block int, ids binary, m binary"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One block as bytes: ids, and components by dimension."""
    n, dims = len(rows), int(rows["dims"].iloc[0])
    m = np.array(rows["v"].tolist(), np.int64).reshape(n, dims).T
    ids = rows["vec_id"].to_numpy(np.int64)
    return pd.DataFrame([[dims, int(rows["block"].iloc[0]), ids.tobytes(), np.ascontiguousarray(m).tobytes()]], columns=["dims", "block", "ids", "m"])


def _unpack(ids: bytes, m: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(m, np.int64).reshape(dims, len(ids))


def _exact(q_ids, q, c_ids, c, k: int) -> list[tuple[int, int, int]]:
    """The same in integers of any size."""
    found = []
    columns = [[int(x) for x in c[:, n]] for n in range(len(c_ids))]
    for n, a in enumerate(q_ids):
        x = [int(u) for u in q[:, n]]
        scores = sorted((-sum(u * w for u, w in zip(x, y)), int(b)) for b, y in zip(c_ids, columns) if b != a)
        found += [(int(a), b, max(min(-s, _LONG), -_LONG)) for s, b in scores[:k]]
    return found


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, q_ids, q_m, c_ids, c_m in batch.itertuples(index=False):
                (q_ids, q), (c_ids, c) = _unpack(q_ids, q_m, dims), _unpack(c_ids, c_m, dims)
                large = dims and float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * dims >= _EXACT
                cf = c.astype(float)
                for at in range(0, len(q_ids), QUERIES_AT_ONCE):
                    some, m = q_ids[at : at + QUERIES_AT_ONCE], q[:, at : at + QUERIES_AT_ONCE]
                    if large:  # beyond exact doubles
                        found = _exact(some, m, c_ids, c, k)
                    else:
                        best = search_block(some, m.astype(float), c_ids, cf, k)
                        found = [(int(a), i, s) for a, b in zip(some, best) for i, s in zip(b.ids.tolist(), b.scores.tolist())]
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * FACTOR).cast("long"))


def _usable(vector: Column) -> Column:
    """False for null vectors and for null, NaN or infinite components."""
    big = F.lit(float("inf"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _blocks(rows: DataFrame, sizes: DataFrame, count: str, label: str) -> DataFrame:
    """Stored blocks of the rows; ``count`` names the column of ``sizes`` with their number by length."""
    s = sizes.select(F.col("dims").alias("s_dims"), F.col(count).alias("of"))
    s._rowloom_path = sizes._rowloom_path
    many = int(sizes.agg(F.coalesce(F.sum(count), F.lit(1))).first()[0])
    laid = rows.join(if_small(s), rows["dims"] == s["s_dims"])
    laid = laid.select("dims", F.pmod(F.xxhash64("vec_id", "v"), F.col("of")).cast("int").alias("block"), "vec_id", "v")
    # a partition of its own for each block, so that the search runs in as many tasks
    dealt = laid.repartition(min(many, MAX_TASKS), "dims", "block")
    return stored(dealt.groupBy("dims", "block").applyInPandas(_pack, _BLOCK), label)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each query row."""
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector))).select(
        F.col(id_col).cast("long").alias("vec_id"), _integers(F.col(vector)).alias("v"), is_query.alias("asks")
    )
    rows = stored(rows.distinct().withColumn("dims", F.size("v")), "vectors")
    fit = F.greatest(F.lit(1), F.floor(block_bytes / (8 * F.col("dims") + 8)))  # rows in a block's bytes
    n, asked = F.col("n"), F.col("asked")
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asked")).where("asked > 0")
    # at least a few blocks, so that small inputs keep a cluster busy too
    nc = F.greatest(F.ceil(n / F.least(fit, F.lit(candidate_block))), F.least(F.lit(12), F.ceil(n / 512)))
    sizes = stored(sizes.select("dims", F.ceil(asked / fit).alias("nq"), nc.alias("nc")), "sizes")
    queries, candidates = _blocks(rows.where("asks"), sizes, "nq", "query-blocks"), _blocks(rows, sizes, "nc", "candidate-blocks")
    waves = [(r["dims"], r["block"]) for r in queries.select("dims", "block").orderBy("dims", "block").collect()]  # one for each block of queries
    discard(rows, sizes)
    parts = []
    for dims, block in waves:
        q = queries.where((F.col("dims") == dims) & (F.col("block") == block)).select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
        c = candidates.where(F.col("dims") == dims)
        pairs = c.join(F.broadcast(q), c["dims"] == q["q_dims"]).select("dims", "q_ids", "q_m", "ids", "m")
        found = pairs.mapInPandas(_search(k), _OUT)
        parts.append(stored(found, "best") if len(waves) > 1 else found)
    spark = vectors.sparkSession
    if len(parts) > 1:
        part = spark.read.schema(_OUT).parquet(*[p._rowloom_path for p in parts])
    else:
        part = parts[0] if parts else spark.createDataFrame([], _OUT)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = part.distinct().select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS e
           FROM embeddings WHERE embedding IS NOT NULL),
     p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op1_topk_search": op1_topk_search}
SQL = {"op1_topk_search": _SQL}
