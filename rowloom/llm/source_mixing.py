"""Mixing sources to target weights (4): hierarchical budgeting, native operations only.

Method: a token budget flows from the root through a domain-language-source tree.  At
every node it is divided among the children in proportion to their weights, but no
child gets more than its leaves can supply in ``max_epochs`` passes; what a child cannot
use goes to its siblings first, and only what the whole family cannot use is
left to the parent's siblings.  Leaves under a node of weight 0 supply nothing.  Shares are cut at
whole tokens from running totals, so no token of a family's budget is left over.  A leaf with
``b`` tokens of budget and ``a`` tokens of text takes ``b div a`` whole epochs and then a
token-prefix of one more epoch, whose order is drawn by a seeded hash: documents are taken in that
order as long as their tokens fit.

The tree has a row per leaf and is planned with windows over siblings.  Leaf orders are
never sorted as a whole: a leaf's n documents fall into about sqrt(n) hash ranges, which are summed
first (into a table, before anything is dealt by leaf), and only the range in which a leaf's
prefix ends is ranked, by draw, with equal draws summed first.

Domains are ``domain``, a Column, or by ``domains``, a mapping from source to domain; other sources
fall into two domains by their names.

Defined cases: null ``lang`` or ``source`` count as the empty name; null or empty texts
have no tokens and are taken whenever the order reaches them within the budget; rows
with the same id are taken together; rows without an id draw by their texts, equal ones together;
weights not named are 1; a weight of 0 takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm._shared import discard, load, stored

SEED = 7
#: Weights of tree nodes by path; nodes not named weigh 1.
WEIGHTS = {"web": 3, "books": 2, "web/en": 4, "web/de": 2, "books/en": 3, "books/fr": 2, "web/en/src0": 2}
LEVELS = ("domain", "lang", "source")


def default_domain(source: Column) -> Column:
    """Two domains, drawn from the source's name (the tables have no domain column)."""
    return F.when(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1) < "8", F.lit("web")).otherwise(F.lit("books"))


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x09-\x0D\x20]+"))).cast("long")


def _name(id_col: Column, text: Column) -> Column:
    """What a row draws by: its id or, without one, its text."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))


def _draw(seed: int, epoch: Column, name: Column) -> Column:
    """60 random bits for a document in an epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name)
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(weights: dict[str, float], path: Column) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, path), F.lit(1.0))


def divide(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Budget of each node from its parent's ``budget``, by ``weight`` up to ``supply``.

    With siblings in ascending order of supply per weight, those that cannot use their
    share come first; the level at which the others stop follows from the first sibling
    that can.  The others get the steps of their running share, cut at whole tokens.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy("ratio", name)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.where("weight > 0").withColumn("ratio", F.col("supply") / F.col("weight"))
    n = n.select(
        "*",
        F.row_number().over(order).alias("rn"),
        ((F.col("budget") - F.coalesce(F.sum("supply").over(upto), F.lit(0))) / F.sum("weight").over(onward)).alias("level"),
    )
    n = n.withColumn("stop", F.min(F.when(F.col("ratio") > F.col("level"), F.col("rn"))).over(family))
    n = n.withColumn("at", F.max(F.when(F.col("rn") == F.col("stop"), F.col("level"))).over(family))
    sharing = F.when(F.col("rn") >= F.col("stop"), F.col("weight")).otherwise(0.0)
    total = F.sum(sharing).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = lambda w: F.floor(w * F.col("at") + 1e-6)
    share = F.when(F.col("stop").isNull() | (F.col("rn") < F.col("stop")), F.col("supply")).otherwise(whole(total) - whole(total - F.col("weight")))
    return n.withColumn("budget", share.cast("long")).drop("ratio", "rn", "level", "stop", "at", "weight", "supply")


def plan_leaves(leaves: DataFrame, total: Column, weights: dict[str, float], max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens, n.  Adds budget, full (epochs), rest (tokens), ranges;
    leaves under a weight of 0 are left out."""
    at = {"w1": F.col("domain"), "w2": F.concat_ws("/", "domain", "lang"), "w3": F.concat_ws("/", *LEVELS)}
    live = leaves.withColumns({w: _weight(weights, path) for w, path in at.items()}).where("w1 > 0 and w2 > 0 and w3 > 0")
    live = live.withColumn("supply", (F.col("tokens") * max_epochs).cast("long"))
    supply = F.sum("supply").cast("long").alias("supply")
    top = divide(live.groupBy("domain").agg(supply, F.first("w1").alias("weight")).withColumn("budget", total), [], "domain")
    mid = live.groupBy("domain", "lang").agg(supply, F.first("w2").alias("weight"))
    mid = divide(mid.join(top, "domain"), ["domain"], "lang")
    low = live.withColumnRenamed("w3", "weight").drop("w1", "w2")
    low = divide(low.join(mid, ["domain", "lang"]), ["domain", "lang"], "source")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    out = low.withColumn("full", full).withColumn("rest", (F.col("budget") - F.col("full") * F.col("tokens")).cast("long"))
    return out.withColumn("ranges", F.ceil(F.sqrt("n")).cast("int"))


def _keys(docs: DataFrame, domain: Column, lang: str, source: str) -> list[Column]:
    return [domain.alias("domain"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")]


def _placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their leaf's plan, their draw in the last epoch and its hash range."""
    p = plan.select([F.col(c).alias(f"p_{c}") for c in LEVELS] + [c for c in plan.columns if c not in (*LEVELS, "tokens", "n")])
    joined = rows.join(p, [rows[c] == p[f"p_{c}"] for c in LEVELS]).drop(*[f"p_{c}" for c in LEVELS])
    drawn = joined.withColumn("draw", _draw(seed, F.col("full"), F.col("name")))
    return drawn.withColumn("range", F.floor(F.col("draw") / F.lit(2.0**60) * F.col("ranges")).cast("int"))


class Mixture:
    """The plan of a mixture: leaf budgets, and where each leaf's prefix ends."""

    def __init__(self, docs: DataFrame, *, share: float = 0.5, weights: dict[str, float] | None = None, max_epochs: int = 2, seed: int = SEED,
                 domain: Column | None = None, domains: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"):
        self.seed, self.id_col, self.text, self.max_epochs = seed, id_col, text, max_epochs
        if domain is None:
            named = F.create_map(*[F.lit(x) for pair in (domains or {}).items() for x in pair]) if domains else F.lit(None).cast("map<string,string>")
            domain = F.coalesce(F.try_element_at(named, F.coalesce(F.col(source), F.lit(""))), default_domain(F.col(source)))
        self.keys = _keys(docs, domain, lang, source)
        weights = WEIGHTS if weights is None else weights
        name = _name(F.col(id_col), F.col(text))
        self.rows = stored(docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), *self.keys, count_tokens(F.col(text)).alias("tokens")), "tokens")
        leaves = stored(self.rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        self.leaves = stored(plan_leaves(leaves, F.lit(int(total * share)), weights, max_epochs), "leaf-budgets")
        ranges = stored(_placed(self.rows, self.leaves, seed).groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("t")), "ranges")
        w = Window.partitionBy(*LEVELS).orderBy("range")
        sums = ranges.select(*[F.col(c).alias(f"k_{c}") for c in LEVELS], "range", "t", F.sum("t").over(w).alias("upto"))
        k = [self.leaves[c] == F.col(f"k_{c}") for c in LEVELS]
        over = self.leaves.join(sums, k).where("upto > rest")
        cut = over.groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("before"))).alias("c"))
        cut = cut.select([F.col(c).alias(f"k_{c}") for c in LEVELS] + [F.col("c.range").alias("cut"), F.col("c.before").alias("before")])
        none = F.coalesce("cut", F.lit(2**31 - 1))
        plan = self.leaves.join(cut, k, "left").select(*self.leaves.columns, none.alias("cut"), F.coalesce("before", F.lit(0)).alias("before"))
        self.plan = stored(plan, "plan")
        discard(leaves, ranges)
        self.ends = stored(self._ending(), "prefix-ends")

    def _ending(self) -> DataFrame:
        """Leaf and name of documents in a prefix's last range that still fit."""
        last = _placed(self.rows, self.plan, self.seed).where("range = cut")
        draws = last.groupBy(*LEVELS, "draw", "name", "rest", "before").agg(F.sum("tokens").alias("t"))
        draws = stored(draws, "last-draws")
        upto = F.col("before") + F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("draw", "name"))
        return draws.withColumn("upto", upto).where("upto <= rest").select(*LEVELS, "name")

    def _parts(self, rows: DataFrame) -> list[tuple[DataFrame, Column, Column]]:
        """Disjoint parts of the selected rows, with the first epoch and how many each one gets."""
        placed = _placed(rows, self.plan, self.seed)
        early = placed.where("range < cut")
        late = placed.where("range >= cut and full > 0")
        e = self.ends.select([F.col(c).alias(f"e_{c}") for c in self.ends.columns])
        tail = placed.where("range = cut").where(F.col("full") < self.max_epochs)
        tail = tail.join(e, [tail[c] == e[f"e_{c}"] for c in self.ends.columns], "left_semi")
        # a leaf that is used up has no further epoch, even for texts without tokens
        return [(early, F.lit(0), F.least(F.col("full") + 1, F.lit(self.max_epochs))), (late, F.lit(0), F.col("full")), (tail, F.col("full"), F.lit(1))]

    def _epochs(self, rows: DataFrame, cols: list[str]) -> DataFrame:
        parts = [p.select(*cols, F.explode(F.sequence(at, at + n - 1)).alias("epoch")) for p, at, n in self._parts(rows)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def selection(self) -> DataFrame:
        """doc_id, domain, lang, source, tokens, epoch: one row per document and epoch."""
        return self._epochs(self.rows, ["doc_id", *LEVELS, "tokens"])

    def documents(self, docs: DataFrame) -> DataFrame:
        """The selected rows of ``docs`` with all their columns, once per epoch."""
        name = _name(F.col(self.id_col), F.col(self.text))
        rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"), *self.keys)
        return self._epochs(rows, ["row"]).select("row.*")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(load(spark, sf_dir, "documents")).selection()


def _sql(share: float = 0.5, max_epochs: int = 2) -> str:
    def weight(path: str) -> str:
        return "CASE " + " ".join(f"WHEN {path} = '{k}' THEN {float(v)}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END"

    def level(name: str, source: str, parents: str, order: str) -> str:
        part = f"PARTITION BY {parents}" if parents else ""
        return f"""
{name}_r AS (SELECT *, supply / weight AS ratio FROM {source} WHERE weight > 0),
{name}_l AS (SELECT *, row_number() OVER ({part} ORDER BY ratio, {order}) AS rn,
  (budget - coalesce(sum(supply) OVER ({part} ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({part} ORDER BY ratio, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}_r),
{name}_s AS (SELECT *, min(CASE WHEN ratio > lev THEN rn END) OVER ({part}) AS stop FROM {name}_l),
{name}_a AS (SELECT *, max(CASE WHEN rn = stop THEN lev END) OVER ({part}) AS lv FROM {name}_s),
{name}_t AS (SELECT *, sum(CASE WHEN rn >= stop THEN weight ELSE 0.0 END) OVER ({part} ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tw FROM {name}_a),
{name} AS (SELECT * EXCLUDE (budget), CAST(CASE WHEN stop IS NULL OR rn < stop THEN supply
  ELSE floor(tw * lv + 1e-6) - floor((tw - weight) * lv + 1e-6) END AS BIGINT) AS budget FROM {name}_t)"""

    return f"""
WITH d AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS BIGINT) AS tokens FROM documents),
every AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) AS budget FROM every),
leaves AS (SELECT * FROM every WHERE {weight('domain')} > 0 AND {weight("domain || '/' || lang")} > 0 AND {weight("domain || '/' || lang || '/' || source")} > 0),
top0 AS (SELECT domain, CAST(sum(tokens) * {max_epochs} AS DOUBLE) AS supply, {weight('domain')} AS weight,
    (SELECT budget FROM total) AS budget FROM leaves GROUP BY domain),{level('top', 'top0', '', 'domain')},
mid0 AS (SELECT l.domain, l.lang, l.supply, {weight("l.domain || '/' || l.lang")} AS weight, t.budget
    FROM (SELECT domain, lang, CAST(sum(tokens) * {max_epochs} AS DOUBLE) AS supply FROM leaves GROUP BY domain, lang) l
    JOIN top t ON l.domain = t.domain),{level('mid', 'mid0', 'domain', 'lang')},
low0 AS (SELECT l.domain, l.lang, l.source, l.tokens AS leaf, CAST(l.tokens * {max_epochs} AS DOUBLE) AS supply,
    {weight("l.domain || '/' || l.lang || '/' || l.source")} AS weight, m.budget
    FROM leaves l JOIN mid m ON l.domain = m.domain AND l.lang = m.lang),{level('low', 'low0', 'domain, lang', 'source')},
plan AS (SELECT domain, lang, source, leaf, budget, CAST(CASE WHEN leaf > 0 THEN floor(budget / leaf) ELSE 1 END AS INTEGER) AS full_e FROM low),
placed AS (SELECT d.*, p.full_e, p.budget - p.full_e * p.leaf AS rest,
    CAST('0x' || substr(md5('{SEED}:' || p.full_e || ':' || d.doc_id), 1, 15) AS BIGINT) AS draw
    FROM d JOIN plan p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id) AS upto FROM placed),
e AS (SELECT CAST(unnest(range(0, {max_epochs})) AS INTEGER) AS epoch)
SELECT doc_id, domain, lang, source, tokens, epoch FROM cum, e
WHERE epoch < full_e OR (epoch = full_e AND upto <= rest)
"""


QUERIES = {"op4_source_mixing": op4_source_mixing}
SQL = {"op4_source_mixing": _sql()}
