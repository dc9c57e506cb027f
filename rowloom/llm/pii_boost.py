"""Personal data (10): candidate spans, boosted trees, calibrated thresholds; native.

Method: high-recall generators propose spans, which may overlap: e-mail addresses,
IP addresses, card-like digit runs, international and local phone numbers, social
security numbers, and long mixed strings such as access tokens.  Each candidate has
format features (length, character mix, borders) and context features (cue words and
quotes before it).  Weak labels come from validators (checksums, ranges, digit counts)
for the first kinds and from cue words or known key forms for secrets; the validator, or
the cue, is not among the features of the kind it labels.  Boosted trees are fitted to the counts of
all candidates of the corpus by feature cell, on one half of the texts; the other half
calibrates, by isotonic regression, one threshold per kind.  Spans that pass the base
rules stay in any case; other candidates are added where they do not overlap a base span
and their score reaches the threshold, or a cue word or a published key form marks them,
however common unmarked candidates of the same looks are.

Patterns use possessive quantifiers and border checks, so that they are linear in the
text; they find what the plain patterns find.  All work on texts is in DataFrame
expressions.  Texts are searched once: candidates are stored, the trees are fitted to their
counts, and spans are chosen from the stored candidates.  Places come from running sums over a
text's matches in blocks of the square root of their number, and overlaps with base spans from
a binary search, so that a text of very many matches stays cheap.

Defined cases: null or empty text has no spans (and the digest of an empty string); null ids
are kept; repeated rows give equal results; with no candidates nothing is added; an
empty table gives an empty result; other columns are ignored by ``find_spans`` and kept
by ``redact``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import boosting
from rowloom.llm._shared import load, stored

LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = ("email", "ip", "card", "phone")
#: Kinds of which a cue word or a known form selects a candidate without the trees.
BY_CUE = ("secret", "local")
#: kind: (cheap test for texts that can hold it, pattern)
GENERATORS = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9]){11,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "secret": (r"[A-Za-z0-9_/-]{20}", r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])(?=[0-9_/-]*+[A-Za-z])[A-Za-z0-9_/-]{20,}+"),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local": (r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+(] |[0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
KINDS = list(GENERATORS)
CUES = {
    "email": r"(?i)mail|contact|address|@",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|credit|account|pay",
    "phone": r"(?i)phone|tel|call|fax|mobile",
    "secret": r"(?i)token|secret|passw|api.?key|access|credential|bearer",
    "ssn": r"(?i)ssn|social|security",
    "local": r"(?i)phone|tel|call|fax|mobile",
}
#: Published forms of access keys.
KEY_FORMS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^sk-[A-Za-z0-9_-]{20,}$"
FEATURES = ["kind", "length", "mix", "border", "quoted", "cue"]
CONTEXT = 32
PRECISION = 0.9


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _running(a: Column, fold, both) -> Column:
    """The folds (``_total`` or ``array_max``) of all beginnings of an array; ``both`` joins two.

    Block by block: n ** 1.5 steps for n values.
    """
    def blocks(x: Column) -> Column:
        k = F.sequence(F.lit(0), F.floor((F.size(x["a"]) - 1) / x["b"]).cast("int"))
        heads = F.transform(k, lambda i: fold(F.slice(x["a"], i * x["b"] + 1, x["b"])))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), heads.alias("heads")), starts)

    def starts(x: Column) -> Column:
        before = F.transform(x["heads"], lambda _, i: F.when(i == 0, 0).otherwise(fold(F.slice(x["heads"], F.lit(1), F.greatest(i, F.lit(1))))))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), before.alias("before")), whole)

    def whole(x: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            at = i % x["b"]
            block = ((i - at) / x["b"]).cast("int")
            return both(F.get(x["before"], block), fold(F.slice(x["a"], i - at + 1, at + 1)))

        return F.transform(x["a"], one)

    size = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
    return F.when(F.size(a) > 0, _let(F.struct(a.alias("a"), size.alias("b")), blocks)).otherwise(F.array().cast("array<int>"))


def _ends(spans: Column) -> Column:
    """The greatest end of each span and those before it."""
    return _running(F.transform(spans, lambda s: s["end"]), F.array_max, F.greatest)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column, before: Column) -> Column:
    """The base rule of a base kind; the weak label of the others."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(s, r"\."), lambda p: F.coalesce(F.try_to_number(F.right(p, F.lit(9)), F.lit("999999999")), F.lit(999)) <= 255
        )
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & F.coalesce(F.call_function("luhn_check", _digits(s)), F.lit(False))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "ssn":
        return ~s.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "secret":
        return before.rlike(CUES[kind]) | s.rlike(KEY_FORMS)
    return before.rlike(CUES[kind])


def _label(kind: str, s: Column, valid: Column) -> Column:
    return s.rlike(r"\.[A-Za-z]{2,}$") if kind == "email" else valid


def _candidates(kind: str, text: Column) -> Column:
    """Array of candidates with places (code points), base verdict, label and features."""
    test, pattern = GENERATORS[kind]
    p = F.lit(pattern)

    def places(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.right(F.get(x["gaps"], i), F.lit(CONTEXT))
            after = F.left(F.get(x["gaps"], i + 1), F.lit(1))
            start = F.get(x["upto"], i) - F.length(s)
            valid = _valid(kind, s, before)
            size = F.length(s)
            cell = {
                "kind": F.lit(KINDS.index(kind)),
                "length": F.when(size < 8, 0).when(size < 12, 1).when(size < 16, 2).when(size < 20, 3).when(size < 33, 4).otherwise(5),
                "mix": F.when(s.rlike("^[0-9]+$"), 0).when(~s.rlike("[A-Za-z]"), 1).when(s.rlike("^[0-9a-f]+$"), 2)
                .when(s.rlike("^[0-9A-Z]+$"), 3).when(s.rlike("[A-Z]") & s.rlike("[a-z]"), 4).otherwise(5),
                "border": (F.when(before.rlike(r"[\p{L}0-9]$"), 1).otherwise(0) + F.when(after.rlike(r"^[\p{L}0-9]"), 2).otherwise(0)),
                "quoted": F.when(before.rlike(r"[\"'`]$"), 1).otherwise(0),
                "cue": F.lit(0) if kind in BY_CUE else F.when(before.rlike(CUES[kind]), 1).otherwise(0),
            }
            return F.struct(
                F.lit(kind).alias("name"),
                start.alias("start"),
                (start + size).alias("end"),
                (valid if kind in BASE else F.lit(False)).alias("base"),
                F.when(_label(kind, s, valid), 1).otherwise(0).alias("y"),
                *[c.cast("int").alias(k) for k, c in cell.items()],
            )

        return F.transform(x["found"], one)

    parts = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    def measured(x: Column) -> Column:
        steps = F.transform(x["found"], lambda s, i: F.length(F.get(x["gaps"], i)) + F.length(s))
        upto = _running(steps, _total, lambda u, v: u + v)
        return _let(F.struct(x["found"].alias("found"), x["gaps"].alias("gaps"), upto.alias("upto")), places)

    can = text.contains("@") if kind == "email" else text.rlike(test)
    return F.when(can, _let(parts, measured))


def _with_candidates(docs: DataFrame, text: str, name: str = "_found") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = [_candidates(k, body) for k in KINDS]
    arrays = F.filter(F.array(*kinds), lambda a: a.isNotNull())
    return docs.withColumn(name, F.flatten(arrays))


class SpanModel:
    """Boosted trees and one threshold per kind."""

    def __init__(self, trees: list[boosting.Node], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def adds(self, c: Column) -> Column:
        """Whether a cue, a known form or the trees select a candidate."""
        cued = c["name"].isin(*BY_CUE) & (c["y"] == 1)
        live = {k: t for k, t in self.thresholds.items() if np.isfinite(t)}
        if not live:
            return cued
        least = F.create_map(*[F.lit(x) for k, t in live.items() for x in (k, float(t) - 1e-9)])
        return cued | F.coalesce(boosting.column(self.trees, [c[f] for f in FEATURES]) >= F.try_element_at(least, c["name"]), F.lit(False))


def _half(text: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("int")


def fit_model(docs: DataFrame, *, text: str = "text", precision: float = PRECISION) -> SpanModel:
    """Trees and thresholds from the candidates of all texts."""
    return _fit(_with_candidates(docs.select(_half(text).alias("half"), text), text).select("half", "_found"), precision)


def _fit(rows: DataFrame, precision: float = PRECISION) -> SpanModel:
    """rows: half, _found.

    What reaches the driver is the contingency table, at most the product of the features'
    ranges (under 7,000 cells).
    """
    rows = rows.where(F.size("_found") > 0).select("half", F.explode("_found").alias("c"))
    cells = rows.groupBy("half", "c.name", *[f"c.{f}" for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum("c.y").alias("pos"))
    table = cells.orderBy("half", *FEATURES).collect()
    none = SpanModel([], {})
    by = [[r for r in table if r["half"] == h] for h in (0, 1)]
    if not by[0] or not by[1]:
        return none
    x, n, pos = ([np.array([[r[f] for f in FEATURES] for r in t]) for t in by], [np.array([r["n"] for r in t], float) for t in by], [np.array([r["pos"] for r in t], float) for t in by])
    trees = boosting.fit(x[0], n[0], pos[0])
    score = boosting.predict(trees, x[1])
    names = np.array([r["name"] for r in by[1]])
    limits = {}
    for k in KINDS:
        at = names == k
        if at.any():
            limits[k] = boosting.calibrated_threshold(score[at], n[1][at], pos[1][at], precision)
    return SpanModel(trees, limits)


def _meets(base: Column, ends: Column, c: Column) -> Column:
    """Whether a candidate overlaps a base span (sorted by start, with running ends)."""
    start = F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & F.coalesce(F.get(base, mid)["start"] < c["end"], F.lit(False))
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + F.lit(1.0))).cast("int"))
    before = F.aggregate(turns, start, step, lambda s: s["lo"])  # base spans that start before its end
    return F.coalesce(F.get(ends, before - 1) > c["start"], F.lit(False))


def _chosen(found: Column, model: SpanModel) -> Column:
    """Base spans, and what the model adds beside them; sorted by kind and place."""
    base = F.array_sort(F.transform(F.filter(found, lambda c: c["base"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))

    def pick(x: Column) -> Column:
        some = F.filter(x["all"], lambda c: c["base"] | (model.adds(c) & ~_meets(x["base"], x["ends"], c)))
        return F.array_sort(
            F.transform(some, lambda c: F.struct(c["kind"].alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["name"].alias("name"), c["base"].alias("base")))
        )

    sorted_ = F.struct(found.alias("all"), base.alias("base"))
    return _let(sorted_, lambda x: _let(F.struct(x["all"].alias("all"), x["base"].alias("base"), _ends(x["base"]).alias("ends")), pick))


def find_spans(docs: DataFrame, model: SpanModel | None = None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, found: array of (order, start, end, name, base), sorted by kind and start."""
    rows = _with_candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "_text")
    rows = rows.select("doc_id", _half("_text").alias("half"), "_found")
    if model is None:
        rows = stored(rows, "candidates")
        model = _fit(rows)
    some = F.when(F.size("_found") > 0, _chosen(F.col("_found"), model))
    return rows.select("doc_id", some.alias("found"))


#: Code points in a chunk of a text that is cut at spans.
CHUNK = 2048


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """The text from a to b, from its chunks."""
    at, end = a % CHUNK, b % CHUNK
    i, j = ((a - at) / CHUNK).cast("int"), ((b - end) / CHUNK).cast("int")
    across = F.concat(F.substring(F.get(chunks, i), at + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(chunks, j), F.lit(1), end))
    return F.when(i == j, F.substring(F.get(chunks, i), at + 1, b - a)).otherwise(across)


def _cleaned(text: Column, spans: Column) -> Column:
    """The text with spans replaced by the name of the first span of each run of overlapping ones."""
    size = F.length(text)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(size / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK)))

    def join(x: Column) -> Column:
        placed = F.transform(x["s"], lambda s, i: F.struct(s["start"].alias("start"), s["name"].alias("name"), F.when(i == 0, 0).otherwise(F.get(x["ends"], i - 1)).alias("from")))
        parts = F.transform(F.filter(placed, lambda s: s["start"] >= s["from"]), lambda s: F.concat(_cut(x["chunks"], s["from"], s["start"]), F.lit("["), F.upper(s["name"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _cut(x["chunks"], F.element_at(x["ends"], -1), x["size"]))

    parts = F.struct(spans.alias("s"), _ends(spans).alias("ends"), chunks.alias("chunks"), size.alias("size"))
    return _let(parts, join)


def redact(docs: DataFrame, model: SpanModel | None = None, *, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping ones by the
    kind of the first, of the longest if they start together).

    Rows are stored with their candidates: the patterns cost more than writing the texts.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    rows = _with_candidates(packed, "_text").withColumn("half", _half("_text")).drop("_text")
    if model is None:
        rows = stored(rows, "candidates")
        model = _fit(rows)
    whole = F.col(f"_row.`{text}`")
    spans = F.transform(_chosen(F.col("_found"), model), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("o"), s["end"].alias("end"), s["name"].alias("name")))
    some = rows.withColumn("_spans", F.when(F.size("_found") > 0, F.array_sort(spans)))
    clean = F.when(F.size("_spans") > 0, _cleaned(whole, F.col("_spans"))).otherwise(whole)
    done = some.select("_row", clean.alias("_clean"))
    return done.select(*[F.col("_clean").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op10_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(load(spark, sf_dir, "documents"))

    def listed(a: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ","), F.lit(""))

    def count(kind: str) -> Column:
        n = F.size(F.filter("found", lambda s: s["base"] & (s["name"] == kind)))
        return F.when(F.col("found").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


QUERIES = {"op10_pii_boost": op10_pii_boost}
SQL: dict[str, str] = {}
