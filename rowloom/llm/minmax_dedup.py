"""MinHash near-dedup (5): min-max hashing, banding, exact confirmation, components.

Method: one evaluation of each of ``PERMUTATIONS`` hash functions over a document's
shingle set yields two signature values, the minimum and the maximum, so a signature
of twice that many values costs half the evaluations.  Values are banded; documents
that share a band key are candidates; every candidate link that is used is confirmed
on the full shingle sets.

No group of copies is expanded into all pairs.  Documents with equal sets form one
class, represented by its smallest doc_id.  In each bucket every member, of whatever
size, is first compared with one pivot only, which leaves its difference from the pivot.
After the components of those links are known, members of buckets that still hold
several components are settled exactly by their differences: two linked documents, one
of which is not linked with the pivot, always have a difference in common, so members meet
through an index of their differences, rarest first.  A member's part of the index is as
long as the overlap that a link needs demands (a prefix filter), and its partners' sizes are
bounded by how many of its shingles any other member has.  No candidate is capped or
sampled; a link is missed only if its documents share no band (``band_shape``).

Defined cases: null or empty text has an empty set, is linked with nothing and kept;
a null doc_id takes no part in linking (component null); rows with the same doc_id are
one node, whose links are those of all its texts; exact repeats get equal results, and
``drop_near_duplicates`` keeps one row of each (doc_id, text) whose doc_id stays; an empty table gives
an empty result; other columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm._shared import LOWER, UPPER, discard, giving_back, if_small, load, small_batches, stored

#: At 0.85 12 + 12 bands of 6 values, at 0.8 14 + 14 of 5: a pair of that similarity is missed with probability 1e-5.
PERMUTATIONS, BAND_ROWS = 72, 6
#: Most that a band shape may miss of the pairs at the threshold.
MISS = 1.5e-5
WIDTH = 3
_CHUNK = 4096


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


_PLACE = _constants(8, 13) | np.uint64(1)
_IN_BAND = _constants(BAND_ROWS, 14) | np.uint64(1)


def band_shape(percent: int) -> tuple[int, int]:
    """Bands (an even number) and values in each: the longest bands that miss at most MISS of the pairs
    at ``percent`` with 2 * PERMUTATIONS values; below that, as many bands of one value as it takes."""
    for rows in range(BAND_ROWS, 0, -1):
        same = min(percent / 100, 1 - 1e-9) ** rows
        bands = 2 * math.ceil(math.log(MISS) / math.log(1 - same) / 2)
        if bands * rows <= 2 * PERMUTATIONS:
            break
    return bands, rows


class _WordHashes(dict):
    """Hash of each word, kept for the common ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 50_000:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words_of: _WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        whole = np.full(1, len(h), np.uint64)
        for k in range(len(h)):
            whole = _mix((whole ^ h[k : k + 1]) * _PLACE[k % 8])
        return whole
    n = len(h) - width + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, width):
        total = _mix(total) + h[k : k + n] * _PLACE[k % 8]
    return np.unique(_mix(total))


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _constants(n, 11)[:, None], (_constants(n, 12) | np.uint64(1))[:, None]


@functools.cache
def _band(n: int) -> np.ndarray:
    return _constants(n, 15)


def min_max_signature(sets: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation."""
    xor, mul = _permutations(permutations)
    low = high = None
    for at in range(0, len(sets), _CHUNK):
        y = (sets[None, at : at + _CHUNK] ^ xor) * mul
        lo, hi = y.min(1), y.max(1)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, length: int = BAND_ROWS) -> np.ndarray:
    rows = np.concatenate([low, high]).reshape(-1, length)
    return _mix(_mix(rows * _IN_BAND[:length]).sum(1, dtype=np.uint64) + _band(len(rows))).view(np.int64)


_SIGNATURES = "doc_id long, th long, n_shingles long, set_key string, bands array<long>"


def _sign(width: int, percent: int):
    count, length = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _WordHashes()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words_of, width)
                sizes.append(len(s))
                if len(s):
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    bands.append(band_keys(*min_max_signature(s, count * length // 2), length))
                else:
                    keys.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "th", "n_shingles", "set_key", "bands"],
            )

    return run


#: a and b with the sizes of their sets, and the hashes that only a or only b has.
_VERIFIED = "a long, a_th long, b long, b_th long, n_a long, n_b long, lacks array<long>, more array<long>"


def _compare(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, last, pivot = _WordHashes(), None, None
        for batch in batches:
            sizes, lacks, more = [], [], []
            for a, th, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), batch.column(5)):
                if (a, th) != last:
                    last, pivot = (a, th), shingle_set(ta.as_py(), words_of, width)
                other = shingle_set(tb.as_py(), words_of, width)
                sizes.append((len(pivot), len(other)))
                lacks.append(np.setdiff1d(pivot, other, assume_unique=True).view(np.int64))
                more.append(np.setdiff1d(other, pivot, assume_unique=True).view(np.int64))
            na, nb = (pa.array([n[k] for n in sizes], pa.int64()) for k in (0, 1))
            hashes = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], na, nb, pa.array(lacks, hashes), pa.array(more, hashes)],
                ["a", "a_th", "b", "b_th", "n_a", "n_b", "lacks", "more"],
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest reachable node) for every node of ``edges`` (a, b).

    Alternates large-star and small-star contraction; each step's result is a table
    in the shared folder.  A hub is only ever seen as a minimum and as a join key.
    """

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(sym: DataFrame, low: DataFrame) -> DataFrame:
        return sym.join(low, sym["a"] == low["n"])

    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = mark(now)
    while seen[0]:
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(sym.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("b")).alias("m")), "low")
        large = stored(star(sym, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = stored(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        down = star(large, least)
        tips = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(tips.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        discard(low, large, least, now)
        now, was = new, seen
        seen = mark(now)
        if seen == was:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._rowloom_path = now._rowloom_path
    return out


def _confirm(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """pairs: a, a_th, b, b_th of representatives; texts: id, th, text.  Returns the columns of
    _VERIFIED, from the whole texts."""
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("id"), F.col("a_th").alias("th")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("b_th").alias("th"))
    )
    nodes = stored(nodes.distinct(), "nodes")
    some = texts.join(if_small(nodes), ["id", "th"], "left_semi").groupBy("id", "th").agg(F.first("text").alias("text"))
    some = stored(some, "texts")
    tb = some.select(F.col("id").alias("b"), F.col("th").alias("b_th"), F.col("text").alias("text_b"))
    ta = some.select(F.col("id").alias("a"), F.col("th").alias("a_th"), F.col("text").alias("text_a"))
    both = pairs.join(tb, ["b", "b_th"]).join(ta, ["a", "a_th"])
    out = stored(both.select("a", "a_th", "b", "b_th", "text_a", "text_b").mapInArrow(giving_back(_compare(width)), _VERIFIED), "verified")
    discard(pairs, nodes, some)
    return out


def _links(verified: DataFrame, percent: int) -> DataFrame:
    both = F.col("n_b") - F.size("more")
    return verified.where(both * 100 >= (F.col("n_a") + F.size("more")) * percent).select("a", "b")


def _members(reps: DataFrame) -> DataFrame:
    """Every representative in each bucket that it shares with others, with the bucket's pivot
    (p): the member that meets most others over all buckets."""
    banded = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "th", F.col("n_shingles").alias("n"))
    buckets = banded.groupBy(F.col("key").alias("bucket")).agg(F.count(F.lit(1)).alias("m"))
    buckets = stored(buckets.where("m > 1"), "buckets")
    found = stored(banded.join(if_small(buckets), banded["key"] == buckets["bucket"]).drop("bucket"), "found")
    central = stored(found.groupBy(F.col("id").alias("c_id")).agg(F.sum("m").alias("central")), "central")
    found_central = found.join(if_small(central), found["id"] == central["c_id"]).drop("c_id", "m")
    first = F.max(F.struct("central", (-F.col("id")).alias("o"), "id", "th", "n")).alias("p")
    pivots = found_central.groupBy(F.col("key").alias("bucket")).agg(first).select("bucket", F.struct("p.id", "p.th", "p.n").alias("p"))
    pivots = stored(pivots, "pivots")
    out = stored(found.drop("m").join(if_small(pivots), found["key"] == pivots["bucket"]).drop("bucket"), "members")
    discard(buckets, found, central, pivots)
    return out


def _classes(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (k, component) of all sets."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        sig = stored(keyed.mapInArrow(giving_back(_sign(width, percent)), _SIGNATURES), "signatures")
        live = sig.where("n_shingles > 0 and doc_id is not null")
        first = F.min(F.struct("doc_id", "th", "n_shingles", "bands")).alias("r")
        reps = stored(live.groupBy("set_key").agg(first).select("set_key", "r.*"), "representatives")
        members = _members(reps)
        own = (F.col("id") == F.col("p.id")) & (F.col("th") == F.col("p.th"))
        star = members.where(~own).select(F.col("p.id").alias("a"), F.col("p.th").alias("a_th"), F.col("id").alias("b"), F.col("th").alias("b_th"))
        verified = _confirm(keyed, star.distinct(), width)
    edges = stored(_links(verified, percent), "links")
    comp = components(edges)
    open_ = _open_members(members, comp, verified)
    discard(members, verified)
    if not open_.isEmpty():
        more = stored(_open_links(open_, percent), "links")
        done, comp = comp, components(edges.unionByName(more))
        discard(done, more)
    discard(edges, open_)
    same = reps.select(F.col("set_key").alias("k"), F.col("doc_id").alias("rep"))
    nodes = same.join(comp, same["rep"] == comp["node"], "left").select("k", F.coalesce("component", "rep").alias("component"))
    nodes = stored(nodes, "components")
    discard(reps, comp)
    return sig, nodes


def _open_members(members: DataFrame, comp: DataFrame, verified: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, once for each pivot: its id and hash
    (p_id, p_th), id, th, n, component (c), difference from the pivot (d), and how many shingles
    of that the pivot has not (k)."""
    known = members.join(comp, members["id"] == comp["node"], "left")
    known = stored(known.select("key", "id", "th", "n", F.col("p.id").alias("p_id"), F.col("p.th").alias("p_th"), F.coalesce("component", "id").alias("c")), "known")
    some = known.groupBy(F.col("key").alias("bucket")).agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    some = stored(some.select("bucket"), "open")
    rows = known.join(if_small(some), known["key"] == some["bucket"]).select("p_id", "p_th", "id", "th", "n", "c").distinct()
    d = verified.select(
        F.col("a").alias("va"), F.col("a_th").alias("va_th"), F.col("b").alias("vb"), F.col("b_th").alias("vb_th"),
        F.concat("lacks", "more").alias("d"), F.size("more").alias("k"),
    )
    on = (rows["p_id"] == d["va"]) & (rows["p_th"] == d["va_th"]) & (rows["id"] == d["vb"]) & (rows["th"] == d["vb_th"])
    out = stored(rows.join(d, on).drop("va", "va_th", "vb", "vb_th"), "open-members")
    discard(known, some)
    return out


def _open_links(members: DataFrame, percent: int) -> DataFrame:
    """All links between members of one pivot that are in different components.

    With differences D from the pivot, ``|x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|``, and a link of x
    and y means ``|x ^ y| <= n * (100 - percent) / percent`` for the size n of either.  So the overlap
    of Dx with any partner's is at least |Dx| less that, and at least one; both members then share
    one of their rarest differences, up to that overlap.
    """
    pivot, node = ["p_id", "p_th"], ["p_id", "p_th", "id", "th"]
    mark = F.transform("d", lambda t, i: F.struct(t.alias("t"), (i >= F.size("d") - F.col("k")).cast("int").alias("own")))
    each = members.select(*node, F.explode(mark).alias("x")).select(*node, "x.t", "x.own")
    often = each.groupBy(*pivot, "t").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    often = stored(often, "differences")
    # differences that no other member has are left out: nothing meets through them
    shared = each.join(if_small(often), [*pivot, "t"])
    lists = shared.groupBy(*node).agg(F.sum("own").alias("k_shared"), F.sort_array(F.collect_list(F.struct("m", "t"))).alias("ts"))
    rows = members.join(lists, node)
    most = F.col("n") - F.col("k") + F.col("k_shared")  # shingles that others may have too
    rows = rows.withColumn("upto", F.floor(most * (100 + percent) / percent) - F.col("n"))  # a partner's greatest size
    least = F.greatest(F.lit(1), F.size("d") - F.floor(F.col("n") * (100 - percent) / percent))
    rows = rows.withColumn("prefix", F.slice("ts", F.lit(1), F.greatest(F.size("ts") - least + 1, F.lit(0)).cast("int")))
    rows = rows.where((F.col("upto") * 100 >= F.col("n") * percent) & (F.size("prefix") > 0))
    rows = rows.select(*node, "n", "c", "upto", F.size("d").alias("nd"), F.size("ts").alias("of"), F.posexplode("prefix.t").alias("at", "t"))
    rows = rows.withColumn("left", F.col("of") - F.col("at")).drop("of", "at")
    rows = stored(rows, "difference-index")
    x, y = (rows.select([F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "xy")
    y = y.where("y_upto >= y_n")
    meet = (F.col("x_p_id") == F.col("y_p_id")) & (F.col("x_p_th") == F.col("y_p_th")) & (F.col("x_t") == F.col("y_t"))
    may = (  # x is the larger one
        (F.col("x_c") != F.col("y_c"))
        & (F.col("y_n") <= F.least("x_n", "x_upto"))
        & (F.col("x_n") <= F.col("y_upto"))
        & (F.col("y_n") * 100 >= F.col("x_n") * percent)
        & (2 * F.least("x_left", "y_left") * (100 + percent) >= (F.col("x_nd") + F.col("y_nd")) * (100 + percent) - (F.col("x_n") + F.col("y_n")) * (100 - percent))
    )
    ids = ["x_p_id", "x_p_th", "x_id", "x_th", "y_id", "y_th"]
    pairs = x.join(y, meet & may).select(*ids).distinct()
    dx = members.select(*[F.col(c).alias(f"x_{c}") for c in node], F.col("d").alias("dx"), F.col("n").alias("nx"))
    dy = members.select(F.col("p_id").alias("x_p_id"), F.col("p_th").alias("x_p_th"), F.col("id").alias("y_id"), F.col("th").alias("y_th"), F.col("d").alias("dy"), F.col("n").alias("ny"))
    both = pairs.join(dx, ["x_p_id", "x_p_th", "x_id", "x_th"]).join(dy, ["x_p_id", "x_p_th", "y_id", "y_th"])
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    links = both.where(apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent))
    return links.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def _near(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``near_duplicates``, and the stored tables they are read from."""
    sig, nodes = _classes(docs, id_col, text, width, percent)
    left = sig.select("doc_id", "th", "n_shingles", "set_key")
    out = left.join(nodes, (left["set_key"] == nodes["k"]) & left["doc_id"].isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", "th", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return out, [sig, nodes]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 85) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept: one row per input row."""
    return _near(docs, id_col, text, width, percent)[0]


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id."""
    found, tables = _near(docs, id_col, text, width, percent)
    found = stored(found, "near")
    discard(*tables)
    gone = stored(found.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_th")).distinct(), "gone")
    on = (docs[id_col].cast("long") == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_gone_th"])
    out = docs.join(if_small(gone), on, "left_anti")
    again = not found.where("doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    discard(found)
    if again:
        key = F.xxhash64(F.col(text))
        named = out.where(F.col(id_col).isNotNull()).withColumn("_again_th", key).dropDuplicates([id_col, "_again_th"]).drop("_again_th")
        out = named.unionByName(out.where(F.col(id_col).isNull()))
    return out


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).drop("th")


QUERIES = {"op5_minmax_dedup": op5_minmax_dedup}
SQL = {
    "op5_minmax_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= 85 * (x.k + y.k - i.k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
}
