"""Personal data: weak-supervision aggregation, on DataFrame functions only.

Patterns propose spans. Labelers (pattern, gazetteer, check, context) vote on each; expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is and how likely each pattern is
personal data; these soft labels train a logistic span classifier on the spans' features. Spans that
fulfil the base rules always stay, the classifier decides on the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import sheltered
from slotwise.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
_SPAN = "array<struct<start:int,end:int,match:string>>"

# Possessive groups, and starts only at the end of a match or of a run, keep Java's matcher from recursion and
# from trying every place of a long run; what they match is the same.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with single spaces or hyphens; only runs of 13 to 19 digits can matter.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# Gazetteers: words before a span that speak for its kind, in four languages, and words that speak against any.
CUES = {
    "email": "mail|correo|courriel|kontakt|contact|write to|escrib|schreib",
    "ip": "ip|host|server|address|adresse|servidor|serveur|login",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobile|anruf|appel|llam|telefon",
}
ANTI_CUES = "version|release|order|invoice|isbn|serial|build|section|rfc|part no|sku"
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us"
LABELERS = ("by_pattern", "by_gazetteer", "by_check", "by_context")
FEATURES = ("strict", "cue", "anti_cue", "valid", "free_left", "free_right", "parted")
#: Code points before a span in which cues are looked for.
CONTEXT = 40


def _spans(text: Column, pattern: str) -> Column:
    """Matches with code point positions: between two matches lies a part of the split text."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["part"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), done["out"]).otherwise(
            F.concat(done["out"], F.array(span))).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(parts, nothing, step, lambda done: done["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits fulfil the checksum of card numbers."""
    digits = F.filter(F.split(F.reverse(_digits(text)), ""), lambda d: d != "")

    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return total + F.when(x["i"] % 2 == 0, x["d"]).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    numbered = F.transform(digits, lambda d, i: F.struct(F.try_to_number(d, F.lit("9")).cast("int").alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add) % 10 == 0


def _small_parts(text: Column) -> Column:
    """Whether the four numbers of an address are at most 255."""
    plain = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= F.lit("255")))


def _in_base(kind: str, match: Column) -> Column:
    count = F.length(_digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _small_parts(match)
    if kind == "card":
        return (count >= 16) & (count <= 19) & _luhn(match)
    return (count >= 8) & (count <= 15)


def _valid(kind: str, match: Column) -> Column:
    """The kind's own check, for spans of any shape."""
    count = F.length(_digits(match))
    if kind == "email":
        return F.lower(match).rlike(rf"[.\])] ?({TOP_DOMAINS})$")
    if kind == "ip":
        # Four small numbers are more likely a version.
        return match.contains(":") | (_small_parts(match) & match.rlike("[0-9]{2}"))
    if kind == "card":
        return _luhn(match)
    return (count >= 8) & (count <= 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _judged(kind: str, text: Column, spans: Column, strict: bool) -> Column:
    """Spans with base flag, features and votes."""

    def judge(s: Column) -> Column:
        base = _in_base(kind, s["match"]) if strict else F.lit(False)
        before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
        left = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(" ")
        right = F.substring(text, s["end"] + 1, F.lit(1))
        first = F.struct(base.alias("base"), before.rlike(rf"\b({CUES[kind]})").alias("cue"),
                         before.rlike(rf"\b({ANTI_CUES})\b").alias("anti_cue"), _valid(kind, s["match"]).alias("valid"),
                         (~left.rlike(r"[\p{L}\p{N}_]")).alias("free_left"),
                         (~right.rlike(r"[\p{L}\p{N}_]")).alias("free_right"),
                         F.length(s["match"]).alias("size"), s["match"].rlike("[ ().-]").alias("parted"))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        first.alias("f"), F.lit(strict).alias("strict"))

    return F.transform(spans, judge)


def candidates(text: Column) -> Column:
    """All proposed spans of a text, by kind and then start; loose ones only where no strict one of the kind lies."""
    found = []
    for kind in KINDS:
        strict = _judged(kind, text, _spans(text, STRICT[kind]), True)
        found.append(strict)
        if kind in LOOSE:
            found.append(_judged(kind, text, _spans(text, LOOSE[kind]), False))
    return F.array_sort(F.concat(*found))


def _without_overlaps(spans: Column) -> Column:
    """Leaves out loose spans that overlap a strict span of their kind."""
    # Overlaps are looked for only if there are loose spans at all, which is rare.
    return F.when(F.exists(spans, lambda s: ~s["strict"]), F.filter(spans, lambda s: s["strict"] | ~F.exists(
        spans, lambda o: o["strict"] & (o["kind"] == s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]),
    ))).otherwise(spans)


def _votes(s: Column) -> dict[str, Column]:
    f = s["f"]
    return {
        "by_pattern": F.when(s["strict"], F.when(f["base"], 1).otherwise(-1)).otherwise(0),
        "by_gazetteer": _vote(f["cue"], f["anti_cue"]),
        "by_check": _vote(f["valid"], ~f["valid"]),
        "by_context": _vote(f["free_left"] & f["free_right"], ~f["free_left"] | ~f["free_right"]),
    }


def _features(s: Column) -> dict[str, Column]:
    f = s["f"]
    return {name: (s["strict"] if name == "strict" else f[name]) for name in FEATURES}


def propose(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and `p_spans`, the proposed spans, staged. A null or empty text has none."""
    text = F.coalesce(docs["text"], F.lit(""))
    # Without a digit, an at sign, its spelling or an address of hex letters there is nothing to look for.
    spans = F.when(text.rlike(r"[0-9@]|[(\[]at[)\]]|[A-Fa-f]:[A-Fa-f]"), candidates(text))
    staged = stage(docs.select(*(docs[c] for c in columns), spans.alias("p_spans")), "proposed")
    return staged.withColumn("p_spans", _without_overlaps(F.col("p_spans")))


def vote_counts(proposed: DataFrame) -> list:
    """Spans per kind, votes and features: at most 4 * 3^4 * 2^7 rows, whatever the input."""
    spans = proposed.where(F.size("p_spans") > 0).select(F.explode("p_spans").alias("s"))
    s = F.col("s")
    return spans.select(
        s["kind"].alias("kind"), *(v.alias(n) for n, v in _votes(s).items()),
        *(v.alias(n) for n, v in _features(s).items()),
    ).groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).orderBy(
        "kind", *LABELERS, *FEATURES).collect()


def estimate_labelers(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: probability that each vote pattern is personal data, and P(vote | truth).

    `votes` has a row per pattern with -1, 0, 1 per labeler, `n` its spans. Starting from the vote sum,
    with the prior that a labeler that votes is more often right than wrong, worth 10 spans.
    """
    labelers = votes.shape[1]
    prior = np.array([[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]])  # truth x vote (-1, 0, 1)
    truth = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    tables = np.empty((labelers, 2, 3))
    for _ in range(rounds):
        for j in range(labelers):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                tables[j, 0, v + 1] = prior[0, v + 1] + (n[at] * (1 - truth[at])).sum()
                tables[j, 1, v + 1] = prior[1, v + 1] + (n[at] * truth[at]).sum()
        tables /= tables.sum(2, keepdims=True)
        share = ((n * truth).sum() + 1) / (n.sum() + 2)
        ones, zeros = np.full(len(n), math.log(share)), np.full(len(n), math.log(1 - share))
        for j in range(labelers):
            ones += np.log(tables[j, 1, votes[:, j] + 1])
            zeros += np.log(tables[j, 0, votes[:, j] + 1])
        truth = 1 / (1 + np.exp(np.clip(zeros - ones, -60, 60)))
    return truth, tables


def fit_classifier(cells: np.ndarray, truth: np.ndarray, n: np.ndarray, shrink: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; cells have 0/1 features, the first column is 1."""
    weights = np.zeros(cells.shape[1])
    if not len(n):
        return weights
    scale = n / n.sum() * min(n.sum(), 10_000)  # so that the ridge keeps its meaning at any size
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(cells @ weights, -30, 30)))
        slope = cells.T @ (scale * (truth - p)) - shrink * weights
        bend = (cells * (scale * p * (1 - p))[:, None]).T @ cells + shrink * np.eye(len(weights))
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def train(proposed: DataFrame) -> dict[str, float]:
    """Weights of the span classifier: bias, one per kind, one per feature."""
    rows = vote_counts(proposed)
    names = ["bias", *KINDS, *FEATURES]
    if not rows:
        return dict.fromkeys(names, 0.0) | {"bias": -1.0}
    n = np.array([r.n for r in rows], float)
    truth, _ = estimate_labelers(np.array([[r[v] for v in LABELERS] for r in rows]), n)
    cells = np.array([[1, *(r.kind == k for k in range(len(KINDS))), *(r[f] for f in FEATURES)] for r in rows], float)
    return dict(zip(names, fit_classifier(cells, truth, n).tolist()))


def accept(proposed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Keeps in `p_spans` the base spans and those that the classifier takes for personal data."""

    def score(s: Column) -> Column:
        total = F.lit(weights["bias"]) + F.element_at(F.array(*(F.lit(weights[k]) for k in KINDS)), s["kind"] + 1)
        for name, value in _features(s).items():
            total = total + F.when(value, F.lit(weights[name])).otherwise(0.0)
        return total

    return proposed.withColumn("p_spans",
        F.filter("p_spans", lambda s: s["f"]["base"] | (score(s) > 0)))


def find(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and `p_spans`: array of (kind number, start, end, f.base, ...) by kind and start, or null.

    Positions are code points, the end is exclusive. Whole texts; a null or empty text has no spans; rows
    with null ids and repeated rows are judged like any other; an empty table trains nothing. A column p_spans that is
    there already is replaced.
    """
    proposed = propose(docs, [c for c in columns if c.lower() != "p_spans"])
    return accept(proposed, train(proposed))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def digest(found: DataFrame) -> DataFrame:
    """Per row of `find`: doc_id, base spans per kind, a hash of them, and all spans as text."""
    base = F.filter("p_spans", lambda s: s["f"]["base"])

    def count(number: int) -> Column:
        return F.coalesce(F.size(F.filter(base, lambda s: s["kind"] == number)), F.lit(0)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("p_spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by its kind in angle brackets; other columns as they were, whatever
    their names. An empty table gives no rows.

    Where spans overlap, the one that starts first (then the longer one) is replaced and the others go
    with it, each character at most once.
    """
    inner, restore = sheltered(docs)
    found = find(inner, inner.columns)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    ordered = F.array_sort(F.transform("p_spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("negative_end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        end = -s["negative_end"]
        gap = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        replaced = F.struct(end.alias("at"), F.concat(done["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out"))
        covered = F.struct(F.greatest(done["at"], end).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], replaced).otherwise(covered)

    masked = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda d: F.concat(
        d["out"], F.substring(F.col("text"), d["at"] + 1, F.length(F.col("text")) - d["at"])))
    text = F.when(F.size("p_spans") > 0, masked).otherwise(F.col("text"))
    return restore(found.withColumn("text", text))
