"""Quality rules (6): risk-controlled thresholds, in DataFrame operations alone.

Per document a few statistics of the whole text; per rule (statistic above a cutoff: reject) and stratum
(language) a grid of cutoffs. For every cutoff the labelled holdout tells how many good documents it would
reject; the exact binomial test of "the false-rejection rate is RISK / rules or more" must reject at
``LEVEL`` divided by all tests (strata x rules x cutoffs, Bonferroni). Since all those tests hold at once, any
certified cutoff may be chosen after seeing the data: the one that rejects most bad documents net of
good ones, the loosest on ties. Every stratum is tested on its own, however small: a rule without a certified,
useful cutoff rejects nothing in that stratum, and a stratum without labels loses nothing beyond the base rule.
So with probability 1 - LEVEL every stratum loses less than RISK of its good documents to the method.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import BLANKS, stored, table

#: False rejections allowed in a stratum over all rules; chance of any wrong certificate.
RISK, LEVEL = 0.05, 0.05
GRID = 64
#: Rule -> statistic scaled so that 1/GRID steps of it from 0 to 1 are the cutoffs.
RULES = {
    "repeat": "n_repeat_words / n_words",
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "long_words": "(word_chars / n_words) / 32",
    "short_words": "1 - (word_chars / n_words) / 8",
}


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Null and empty texts have none of anything. Repeated three-word windows are told by 64-bit
    fingerprints of their words; texts without a repeated fingerprint skip the position search.
    """
    blank = " \t\n\x0b\x0c\r"
    t = docs.select(F.col(id_col).alias("doc_id"),
                    F.coalesce(F.col(stratum_col).cast("string") if stratum_col else F.lit(None), F.lit("")).alias("stratum"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("trimmed", F.btrim("text", F.lit(blank)))
    t = t.withColumn("w", F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("trimmed", f"[{BLANKS}]+")))
    t = t.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")))
    t = t.withColumn("h", F.expr("CASE WHEN size(w) < 3 THEN cast(array() AS array<bigint>) ELSE "
                                 "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) END"))
    t = t.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN "
                                 "sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i))) END"))
    t = t.withColumn("at", F.expr("sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h OR x.h = get(s, i + 1).h), x -> x.p))"))
    covered = F.expr("aggregate(at, named_struct('last', -3, 'n', 0L), "
                     "(a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)")
    return t.select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _level(rule: str) -> Column:
    """Grid step of a rule's statistic: a document is rejected by cutoff k / GRID if its step is above k."""
    value = F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN {RULES[rule]} ELSE 0e0 END")
    return F.least(F.lit(GRID + 1), F.greatest(F.lit(0), F.ceil(value * GRID))).cast("int")


def binomial_tail(n: int, x: int, p: float) -> float:
    """P(Binomial(n, p) <= x), summed from the largest term down until nothing is added."""
    if x >= n:
        return 1.0
    if x >= n * p:
        return 1.0                     # not below the mean: no evidence, as p-value 1
    log = (math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1)
           + x * math.log(p) + (n - x) * math.log1p(-p))
    term = total = 1.0
    for i in range(x, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(log) * total)


def certified_cutoffs(statistics: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality",
                      risk: float = RISK, level: float = LEVEL) -> dict[str, dict[str, int]]:
    """Cutoff (grid step) by stratum and rule from the labelled documents that pass the base rule; the key
    ``None`` stands for all other strata and is empty. Null labels are left out, a repeated id counts once (its lowest label)."""
    own = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("q")).groupBy("doc_id").agg(F.min("q").alias("q"))
           .filter("q is not null"))
    held = statistics.filter(~base_failed()).join(own, "doc_id")
    steps = held.select("stratum", "q", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), _level(r).alias("step")) for r in RULES])).alias("x"))
    # bounded: strata with labels x rules x (GRID + 2) steps
    rows = (steps.groupBy("stratum", "x.rule", "x.step").agg(F.sum((F.col("q") == 1).cast("long")).alias("good"),
                                                          F.sum((F.col("q") != 1).cast("long")).alias("bad")).collect())
    counts: dict[tuple, dict[int, tuple[int, int]]] = {}
    for r in rows:
        counts.setdefault((r.stratum, r.rule), {})[r.step] = (r.good, r.bad)
    tests = max(1, len(counts) * (GRID + 1))
    out: dict[str, dict[str, int]] = {None: {}}
    for (stratum, rule), by in sorted(counts.items(), key=str):
        n, good, bad, best = sum(g for g, _ in by.values()), 0, 0, None
        for k in range(GRID, -1, -1):            # from the loosest cutoff on
            g, b = by.get(k + 1, (0, 0))
            good, bad = good + g, bad + b
            if bad > good and (best is None or bad - good > best[0]) and \
                    binomial_tail(n, good, risk / len(RULES)) <= level / tests:
                best = (bad - good, k)
        if best:
            out.setdefault(stratum, {})[rule] = best[1]
    return out


def verdicts(statistics: DataFrame, cutoffs: dict[str, dict[str, int]]) -> DataFrame:
    """``statistics`` with base_failed and kept."""
    spark = statistics.sparkSession
    names = list(RULES)
    schema = "stratum string, " + ", ".join(f"c_{r} int" for r in names)
    own = spark.createDataFrame([(s, *[c.get(r) for r in names]) for s, c in cutoffs.items() if s is not None], schema)
    joined = statistics.join(own, "stratum", "left")
    rejected = F.lit(False)
    for r in names:
        rejected = rejected | F.coalesce(_level(r) > F.col(f"c_{r}"), F.lit(False))
    return (joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
            .select(*statistics.columns, "base_failed", "kept"))


def risk_controlled(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """Statistics, base_failed and kept of every document (null and empty texts fail the base rule)."""
    statistics = stored(text_statistics(docs, **names), "statistics")
    return verdicts(statistics, certified_cutoffs(statistics, labels))


def op6_risk_controlled_rules(spark, sf_dir: str) -> DataFrame:
    return (risk_controlled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
