"""Operator 6: quality rules with risk-controlled thresholds.

Every whole text gets counts (words, symbols, repeated lines, words in repeated 3-word windows, ...) and from them rule values, higher
being worse. The base rules reject short and repetitive texts. Beyond them each rule has a fixed grid of cutoffs, chosen before any label
is seen. The labelled good documents (quality 1) that pass the base rules are the holdout: per stratum (language), rule and cutoff the
number of good documents rejected has an exact (Clopper-Pearson) upper bound. The cutoffs of a rule are nested, so they are tested in fixed
order from loose to strict until one fails, which needs no correction over cutoffs: a rule takes its strictest cutoff whose bound is within
ALPHA / rules at confidence 1 - DELTA / (strata * rules). A stratum whose holdout is too small for that even without a rejection tests one
combined rule instead: all rules at the same step of their grids, within ALPHA at confidence 1 - DELTA / strata. The choice looks at the size
of the holdout only. So all rules together reject at most ALPHA of a stratum's good documents, in all strata at once, with probability
1 - DELTA. A stratum with too few labels for either gets no cutoff, so nothing is rejected there beyond the base.

Defined results: a null or empty text has no words and fails the base; a very long text is counted whole, in one task; a null language is a stratum of its own; repeated rows each get
their row; a document with several labels counts by its lowest; labels of unknown documents are ignored; empty tables give empty results
or no cutoffs; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, stash, table, texts

ALPHA, DELTA = 0.02, 0.05
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_BROADCAST_STRATA = 10_000
ALL = "all"

#: Rule values as SQL over the counts, and the cutoffs: a document fails a rule when its value is above the cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.02 * i for i in range(1, 16)]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05 * i for i in range(2, 17)]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.03 * i for i in range(1, 16)]),
    "capitals": ("n_upper_words / greatest(n_words, 1)", [0.05 * i for i in range(1, 16)]),
    "long_words": ("word_chars / greatest(n_words, 1)", [6.0 + 0.75 * i for i in range(15)]),
}


def repeat_words(words: list[str]) -> int:
    """Words in 3-word windows found twice or more, first occurrences included."""
    n = len(words) - 2
    if n < 2:
        return 0
    first: dict[tuple[str, str, str], int] = {}
    again: set[int] = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(w, i)
        if j != i:
            again.add(i)
            again.add(j)
    if not again:
        return 0
    return len(again | {i + 1 for i in again} | {i + 2 for i in again})


def count_text(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_upper_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines),
        sum(w.isupper() for w in words if len(w) > 1),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words"]


def quality_counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts, base_failed."""

    def make():
        def each(ids, text, strata):
            return [ids, ["" if s is None else str(s) for s in strata], *([list(c) for c in zip(*map(count_text, text))] or [[]] * len(COUNTS))]

        return each

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = map_rows(texts(docs, stratum), make, f"doc_id {id_type}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta function of 1 - p at (n - k, k + 1), in constant memory."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b = n - k, k + 1
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    if (1 - p) * (a + b + 2) < a + 1:
        return min(1.0, front * beta_fraction(a, b, 1 - p) / a)
    return max(0.0, 1 - front * beta_fraction(b, a, p) / b)


def beta_fraction(a: int, b: int, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from the front (Lentz) until it stands; about sqrt(a + b) steps."""
    tiny = 1e-300
    safe = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1 / safe(1 - (a + b) * x / (a + 1))
    value, m = d, 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            c, d = safe(1 + step / c), 1 / safe(1 + step * d)
            value *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10_000_000:
            return value


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate p for which k or fewer of n still have probability delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def choose_cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, holdout, rejected, bound: the chosen cutoffs only; a few rows a stratum."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1 and doc_id is not null").select("doc_id")
    held = counts.filter("not base_failed").join(good, "doc_id", "left_semi")
    strata = max(1, held.select("stratum").distinct().count())
    steps = min(len(c) for _, c in RULES.values())
    # how many cutoffs a value is above: a document is rejected by exactly those cutoffs, the least strict first to stop
    above = {r: sum(F.when(F.expr(v) > F.lit(c), 1).otherwise(0) for c in cuts) for r, (v, cuts) in RULES.items()}
    above[ALL] = F.greatest(*above.values())
    each = held.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), a.cast("int").alias("above")) for r, a in above.items()])).alias("x")).select("stratum", "x.*")
    hist = each.groupBy("stratum", "rule", "above").count()
    grid = hist.groupBy("stratum", "rule").agg(F.sum("count").alias("holdout"), F.collect_list(F.struct("above", "count")).alias("hist"))  # at most 16 a list

    def certify(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for s, r, n, h in zip(*(pdf[c] for c in ("stratum", "rule", "holdout", "hist"))):
                apart = binomial_cdf(0, int(n), alpha / len(RULES)) <= delta / (strata * len(RULES))  # by the size alone
                if apart == (r == ALL):
                    continue
                most, share = (alpha, delta / strata) if r == ALL else (alpha / len(RULES), delta / (strata * len(RULES)))
                last = None
                for i in reversed(range(steps if r == ALL else len(RULES[r][1]))):  # loose to strict
                    k = int(sum(x["count"] for x in h if x["above"] > i))
                    if binomial_cdf(k, int(n), most) > share:
                        break
                    last = i, k
                if last is not None:
                    i, k = last
                    out += [(s, x, float(RULES[x][1][i]), int(n), k, upper_bound(k, int(n), share)) for x in (RULES if r == ALL else [r])]
            yield pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "holdout", "rejected", "bound"])

    return grid.mapInPandas(certify, "stratum string, rule string, cutoff double, holdout long, rejected long, bound double")


def judge_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, failed_rules (those whose certified cutoff it exceeds), kept."""
    counts = stash(quality_counts(docs), "quality-counts")
    cutoffs = stash(choose_cutoffs(counts, labels, alpha, delta), "quality-cutoffs")
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    small = cutoffs.count() <= MAX_BROADCAST_STRATA * len(RULES)
    failing = F.array(*[F.when(F.expr(v) > F.element_at("cuts", F.lit(r)), F.lit(r)) for r, (v, _) in RULES.items()])
    judged = counts.join(F.broadcast(by_stratum) if small else by_stratum, "stratum", "left")
    judged = judged.withColumn("failed_rules", F.coalesce(F.array_compact(failing), F.array().cast("array<string>")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL: dict[str, str] = {}
