"""URL filters (3): rules, then a tree of path templates with smoothed labelled purity.

Method: explicit rules (host suffix and path prefix, the longest wins) decide first.
For the rest, each host's paths form a tree of segments, built level by level.  Segments that vary
are generalised into wildcards: those that hold digits or hashes by their shape, and the rare children
of a branch, whatever its frequent ones hold: with the branch's children that are no more
frequent than it, a child is folded if these are more kinds than the square root of their pages
and it holds less than that root itself.  The next level continues below the wildcard, so what
stands under a variable segment is one branch.  At every depth, branches whose share of bad labels
does not differ significantly from that of their siblings are merged (their counts are pooled), and
those that differ are merged with others that differ alike.  A branch's share is smoothed with its
parent's as the prior, from the overall share through the host down to the template; a label
counts at the deepest level that holds it only, and one by a rule's path prefix not above that
prefix, as the rule says nothing of the host's other paths.  A template is rejected when its smoothed share
reaches a limit; one without labels has its nearest labelled ancestor's.
Labels are a column of the table or, by default, host names with well-known words of spam, advertising
and tracking hosts (bad) and the verdicts of the rules, which templates generalise within a host.

Hosts, templates and segments are only counted with partial aggregation; a branch's children meet as a
histogram of their counts, which has at most about the root of twice its pages rows; a hot host's
rows meet a template's verdict through a join that adaptive execution can split.  What follows the
``DEPTH``-th segment of a path is one segment.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule
and are judged like any template of the empty host; repeated rows get equal results;
null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm._shared import ascii_lower, discard, if_small, load, stored

#: (verdict, host suffix, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Most segments of a path; the rest of a longer one is its last segment.
DEPTH = 16
#: Words in host names that label a page as bad: gambling, drugs, adult, scams, advertising, malware.
BAD_WORDS = """
    casino casinos bet bets betting poker slots roulette jackpot lottery gambling
    pill pills viagra cialis pharmacy steroids weed
    adult porn porno sex xxx escort escorts nude camgirls
    spam scam phishing malware warez cracks keygen replica payday
    ad ads adserver adserv banner banners track tracker trackers tracking clicktrack popup popunder
""".split()
SEEDS = rf"(^|[.-])({'|'.join(BAD_WORDS)})([.-]|$)"
#: Weight of the prior, and the share of bad labels at which a template is rejected.
PRIOR, LIMIT = 4.0, 0.6
#: Branches are pooled while a two-sample test of their shares stays below this (about 99 %).
Z = 2.58


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.when(has, ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))).otherwise(F.lit(""))
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path


def _reach(path: str) -> int:
    """Depth of the branch that a rule's path prefix decides."""
    return len([x for x in path.split("/") if x])


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null if none does)."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    """A segment with its digit runs and hashes as wildcards."""
    hashed = F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{12,}\b", "{hash}")
    return F.regexp_replace(hashed, "[0-9]+", "{n}")


def _segments(path: Column) -> Column:
    """The shaped segments of a path, at most DEPTH."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    rest = F.array_join(F.slice(parts, F.lit(DEPTH), F.greatest(F.size(parts) - DEPTH + 1, F.lit(0))), "/")
    bounded = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(rest))).otherwise(parts)
    return F.transform(bounded, _shape)


def _folded(each: DataFrame) -> DataFrame:
    """each: host, above, segment, n.  The children that become a wildcard (host, above, segment)."""
    on = ["host", "above"]
    counts = stored(each.groupBy(*on, "n").agg(F.count(F.lit(1)).alias("kinds")), "histogram")
    upto = Window.partitionBy(*on).orderBy("n")
    pages, kinds = F.sum(F.col("n") * F.col("kinds")).over(upto), F.sum("kinds").over(upto)
    rare = (kinds * kinds > pages) & (F.col("n") * F.col("n") < pages)
    rare = stored(counts.withColumn("rare", rare).where("rare").select(*on, "n"), "rare")
    out = stored(each.join(if_small(rare), [*on, "n"], "left_semi").select(*[F.col(c).alias(f"f_{c}") for c in (*on, "segment")]), "folded")
    discard(counts, rare)
    return out


def templates(pages: DataFrame, deepest: int = 0) -> DataFrame:
    """pages: host, path, bad (1, 0 or null), reach (the least depth at which the label counts, at
    most ``deepest``).  Host, segments, template, and bad and known: counts by depth 0 to ``deepest``."""
    counted = pages.withColumn("segments", _segments(F.col("path"))).groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("reach") <= k, F.col("bad"))), F.lit(0)) for k in range(deepest + 1)]).alias("bad"),
        F.array(*[F.count(F.when(F.col("reach") <= k, F.col("bad"))) for k in range(deepest + 1)]).alias("known"),
    )
    paths = stored(counted.withColumn("above", F.lit("")), "paths")
    long = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(long):  # at most DEPTH
        rows = paths.withColumn("segment", F.get("segments", F.lit(level)))
        each = stored(rows.where("segment is not null").groupBy("host", "above", "segment").agg(F.sum("n").alias("n")), "segments")
        folded = _folded(each)
        on = (rows["host"] == folded["f_host"]) & (rows["above"] == folded["f_above"]) & (rows["segment"] == folded["f_segment"])
        marked = rows.join(if_small(folded), on, "left")
        part = F.when(F.col("f_host").isNotNull(), "*").otherwise(F.col("segment"))
        above = F.when(F.col("segment").isNull(), F.col("above")).otherwise(F.concat("above", F.lit("/"), part))
        new = stored(marked.select("host", "segments", "n", "bad", "known", above.alias("above")), "paths")
        discard(each, folded, paths)
        paths = new
    out = paths.withColumnRenamed("above", "template")
    out._rowloom_path = paths._rowloom_path
    return out


def _alike(bad: Column, known: Column, bad2: Column, known2: Column) -> Column:
    """Whether two samples' shares do not differ significantly."""
    mean = (bad + bad2) / (known + known2)
    return F.abs(bad / known - bad2 / known2) <= Z * F.sqrt(mean * (1 - mean) * (1 / known + 1 / known2))


def _pooled(nodes: DataFrame) -> DataFrame:
    """nodes: host, up, node, bad, known, and the part of these that counts in the parent, up_bad and up_known.
    The sums (gb, gk, ub, uk) over each labelled node's group of siblings."""
    on = ["host", "up"]
    sums = nodes.groupBy(*on).agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"))
    sums = stored(sums.where("all_known > 0"), "families")
    some = nodes.where("known > 0").join(if_small(sums), on)
    rest_bad, rest = F.col("all_bad") - F.col("bad"), F.nullif(F.col("all_known") - F.col("known"), F.lit(0))
    share = F.col("bad") / F.col("known")
    differs = F.coalesce(~_alike(F.col("bad"), F.col("known"), rest_bad, rest), F.lit(False))
    # 0: like the other siblings together; those above (1) or below (-1) pool among themselves
    side = F.when(differs, F.signum(share - rest_bad / rest).cast("int")).otherwise(0)
    some = some.withColumn("side", side).withColumn("share", F.when(F.col("side") != 0, share).otherwise(0.0))
    some = stored(some.select("host", "up", "node", "bad", "known", "up_bad", "up_known", "side", "share"), "sided")
    equal = some.groupBy(*on, "side", "share").agg(*[F.sum(c).cast("double").alias(k) for c, k in (("bad", "b"), ("known", "k"), ("up_bad", "ub"), ("up_known", "uk"))])
    row = F.struct("side", "share", "b", "k", "ub", "uk")
    family = equal.groupBy(*on).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["side"].alias("side"), last["share"].alias("share"), *[(last[k] + x[k]).alias(k) for k in ("b", "k", "ub", "uk")])
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        same = (last["side"] == x["side"]) & _alike(last["b"], last["k"], x["b"], x["k"])
        return F.when(same, grown).otherwise(F.concat(done, F.array(x)))

    groups = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 1, 1), step)
    family = stored(family.select(*on, groups.alias("groups")), "groups")
    own = F.struct("side", "share")
    of = F.element_at(F.filter("groups", lambda g: F.struct(g["side"].alias("side"), g["share"].alias("share")) <= own), -1)
    out = some.join(if_small(family), on).select("host", "node", of["b"].alias("gb"), of["k"].alias("gk"), of["ub"].alias("ub"), of["uk"].alias("uk"))
    out = stored(out, "pooled")
    discard(sums, some, family)
    return out


def judge_templates(paths: DataFrame, deepest: int = 0, *, prior: float = PRIOR, limit: float = LIMIT) -> DataFrame:
    """host, segments, template, purity and rejected for every shaped path."""
    t = paths.groupBy("host", "template").agg(*[F.array(*[F.sum(F.col(c)[k]) for k in range(deepest + 1)]).alias(c) for c in ("bad", "known")])
    t = stored(t, "template-counts")
    sums = t.agg(*[F.coalesce(F.sum(F.col(c)[deepest]), F.lit(0)) for c in ("bad", "known")]).first()
    base = (sums[0] + 1) / (sums[1] + 2)
    # nodes: the host (""), each prefix, and the end of the path ("#" cannot occur in one)
    ends = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col("template"), F.lit("/[^/]*"), F.lit(0)), F.array(F.lit("#")))
    steps = t.withColumn("parts", ends).select("host", "template", "bad", "known", "parts", F.posexplode("parts").alias("level", "part"))
    node = F.array_join(F.slice("parts", F.lit(1), F.col("level") + 1), "")
    up = F.when(F.col("level") == 0, F.lit("^")).otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("level")), ""))

    def at(c: str, level: Column) -> Column:
        return F.when(level < 0, 0).otherwise(F.get(c, F.least(level, F.lit(deepest))))

    counts = [at(c, F.col("level") - d).alias(k) for c, d, k in (("bad", 0, "bad"), ("known", 0, "known"), ("bad", 1, "up_bad"), ("known", 1, "up_known"))]
    chain = stored(steps.select("host", "template", *counts, "level", node.alias("node"), up.alias("up")), "chains")
    nodes = stored(chain.groupBy("host", "up", "node").agg(*[F.sum(c).alias(c) for c in ("bad", "known", "up_bad", "up_known")]), "nodes")
    pooled = _pooled(nodes)

    found = chain.select("host", "template", "level", "node").join(if_small(pooled), ["host", "node"], "left")
    counts = F.struct("level", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gb", "gk", "ub", "uk")])
    lines = found.groupBy("host", "template").agg(F.array_sort(F.collect_list(counts)).alias("c"))
    # from the host down, each level adds the labels that the next one does not hold, so each counts once
    below = F.struct(F.lit(0).alias("level"), *[F.lit(0.0).alias(c) for c in ("gb", "gk", "ub", "uk")])
    ring = F.zip_with("c", F.concat(F.slice("c", F.lit(2), F.size("c")), F.array(below)), lambda x, y: F.struct((x["gb"] - y["ub"]).alias("b"), (x["gk"] - y["uk"]).alias("k")))
    purity = F.aggregate(ring, F.lit(float(min(base, 0.5))), lambda p, r: (r["b"] + prior * p) / (r["k"] + prior))
    j = stored(lines.select(F.col("host").alias("j_host"), F.col("template").alias("j_template"), purity.alias("purity")), "purities")
    discard(t, chain, nodes, pooled)
    out = paths.join(j, (paths["host"] == j["j_host"]) & (paths["template"] == j["j_template"]))
    return out.select("host", "segments", "template", "purity", (F.col("purity") >= limit).alias("rejected"))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", bad: Column | None = None, rules=RULES, seeds: str = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity; one row per input row.

    ``bad``: 1, 0 or null for pages with known labels; where null, spam words in the host and
    the rules' verdicts stand in.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("int") if bad is None else bad).alias("given"))
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", name).withColumn("said", verdict)
    by_rule = F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    by_name = F.when(F.col("host").rlike(seeds), 1)
    known = F.coalesce("given", by_name)
    reach = F.lit(0)
    for _, h, p in rules:
        reach = F.when(known.isNull() & (F.col("rule") == h + p), _reach(p)).otherwise(reach)
    deepest = max((_reach(p) for _, _, p in rules), default=0)
    ruled = ruled.withColumn("bad", F.coalesce(known, by_rule)).withColumn("reach", reach).drop("given")
    paths = templates(ruled.select("host", "path", "bad", "reach"), deepest)
    judged = stored(judge_templates(paths, deepest), "judged")
    discard(paths)
    judged = judged.withColumnRenamed("host", "g_host").withColumnRenamed("segments", "g_segments")
    shaped = ruled.withColumn("segments", _segments(F.col("path")))
    out = shaped.join(judged, (shaped["host"] == judged["g_host"]) & (shaped["segments"] == judged["g_segments"]), "left")
    by_template = F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", by_template).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))


QUERIES = {"op3_url_templates": op3_url_templates}
SQL: dict[str, str] = {}
