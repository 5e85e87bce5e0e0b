"""Quality rules as a learned decision list.

Statistics of every text are plain column expressions. Sequential covering then learns
an ordered list of threshold conjunctions that reject: each is grown literal by literal
on one part of the labelled statistics, pruned on another, and what it covers is taken
out before the next. All counts are grouped aggregations; the driver sees one count per
feature and threshold bin. The list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, table, words

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What the list may test, as SQL over the statistics.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_case": "n_upper / greatest(word_chars, 1)",
}


def _n_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = F.transform(F.array(s), lambda a: F.filter(a, lambda e, i: (F.get(a, i - 1)["x"] == e["x"]) | (F.get(a, i + 1)["x"] == e["x"])))[0]
        at = F.sort_array(F.transform(F.filter(twice, lambda e: e.isNotNull()), lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"].cast("long"))

    some = F.transform(F.array(grams), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))[0]
    return F.when(F.size(w) >= 3, some).otherwise(F.lit(0).cast("long"))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper and
    n_repeat_words (all long) of the whole text; a null text has none of anything."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = df.withColumns({"__w": words(F.col(text)), "__l": lines})
    return out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": _n_without(t, SPACE),
            "n_symbols": F.length(t).cast("long") - _n_without(t, SYMBOLS),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_upper": F.length(t).cast("long") - _n_without(t, UPPER),
            "n_repeat_words": _repeated(F.col("__w")),
        }
    ).drop("__w", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float
    bin: int  # the cut is the bin's upper edge

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D"

    def on_bins(self) -> Column:
        b = F.col(f"b_{self.feature}")
        return b > self.bin if self.above else b <= self.bin


Rule = tuple[Literal, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.on_bins()
    return out


def learn_decision_list(labelled: DataFrame, *, max_rules: int = 8, max_literals: int = 3, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Rules that reject, in order. ``labelled``: the statistics, doc_id, and ``bad``
    (1 to reject, 0 to keep); all its rows count. Cuts lie half-way between quantiles of
    either class, so a cut keeps its distance to both. An empty or one-sided table
    gives no rule. The order of equal gains is fixed by feature and cut.
    """
    probs = [0.0, 0.005, 0.01, *(i / 20 for i in range(1, 20)), 0.99, 0.995, 1.0]
    values = labelled.select("bad", "doc_id", *(F.expr(f"CAST({sql} AS DOUBLE)").alias(k) for k, sql in FEATURES.items()))
    seen = values.groupBy("bad").agg(*(F.percentile_approx(k, probs, 5000).alias(k) for k in FEATURES)).collect()
    if len(seen) < 2:
        return []
    cuts = {}
    for k in FEATURES:
        points = sorted({x for r in seen for x in r[k]})
        cuts[k] = [(a + b) / 2 for a, b in zip(points, points[1:])]
    bins = [F.coalesce(sum((F.when(F.col(k) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0)), F.lit(0)).cast("int").alias(f"b_{k}") for k in FEATURES]
    part = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("held")
    cells, path = table(values.select("bad", part, *bins).groupBy("held", "bad", *(f"b_{k}" for k in FEATURES)).agg(F.count("*").alias("n")), "cells")
    good, bad = F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = F.lit(True)
        for r in rules:
            left = left & ~_all(r)
        rule = _grow(cells.filter(left & ~F.col("held")), good, bad, cuts, max_literals)
        if not rule:
            break
        kept = cells.filter(left & F.col("held"))
        ends = range(1, len(rule) + 1)
        got = kept.agg(*(F.sum(F.when(_all(rule[:e]) & (F.col("bad") == y), F.col("n")).otherwise(0)).alias(f"n{y}_{e}") for e in ends for y in (0, 1))).collect()[0]
        worth = {e: ((got[f"n1_{e}"] or 0), (got[f"n0_{e}"] or 0)) for e in ends}
        best = max(ends, key=lambda e: ((worth[e][0] - worth[e][1]) / max(1, sum(worth[e])), worth[e][0], -e))
        p, n = worth[best]
        if p < min_covered / 3 or p < min_precision * (p + n):
            break
        rules.append(rule[:best])
    discard(cells.sparkSession, path)
    return rules


def _grow(cells: DataFrame, good: Column, bad: Column, cuts: dict[str, list[float]], max_literals: int) -> Rule:
    rule: Rule = ()
    while len(rule) < max_literals:
        rows = cells.filter(_all(rule)).select("bad", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f"b_{k}").alias("bin")) for k in FEATURES))).alias("b"))
        counts = {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in rows.groupBy("b.feature", "b.bin").agg(bad.alias("p"), good.alias("n")).collect()}
        first = next(iter(FEATURES))
        total_p, total_n = (sum(v[i] for k, v in counts.items() if k[0] == first) for i in (0, 1))
        if not total_p or not total_n:
            break
        options = []
        for k in FEATURES:
            p = n = 0
            for b, cut in enumerate(cuts[k]):
                x = counts.get((k, b), (0, 0))
                p, n = p + x[0], n + x[1]
                for above, (pp, nn) in ((False, (p, n)), (True, (total_p - p, total_n - n))):
                    if pp and pp + nn < total_p + total_n:
                        gain = pp * (math.log2(pp / (pp + nn)) - math.log2(total_p / (total_p + total_n)))
                        options.append((round(gain, 9), Literal(k, above, cut, b)))
        best = max((g for g, _ in options), default=0)
        if best <= 0:
            break
        tied = [x for g, x in options if g == best]
        same = [x for x in tied if (x.feature, x.above) == (tied[0].feature, tied[0].above)]
        rule += (same[len(same) // 2],)  # the middle of the cuts that divide these rows alike
        if not any(counts.get((rule[-1].feature, b), (0, 0))[1] for b in range(len(cuts[rule[-1].feature]) + 1) if (b > rule[-1].bin) == rule[-1].above):
            break  # no good row is covered any more
    return rule


def emit(rules: Sequence[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that
    rejects, from 1, or 0."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(" AND ".join(x.sql() for x in rule)), i).otherwise(out)
    return out


def _rules_from(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    bad = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return learn_decision_list(stats.filter(~base_failed()).join(bad, "doc_id"))


def _with_verdict(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", emit(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict for every row of ``df``: doc_id, the statistics,
    base_failed, rule (0: none rejects) and kept. ``labels``: doc_id, quality (1 good,
    0 bad); the list learns from every labelled row that passes the base rules.

    A null or empty text has zero counts and fails the base; a null doc_id is judged but
    never labelled; a doc_id labelled twice counts by its lowest label; repeated rows
    give repeated results; empty tables give an empty result or no rules; other columns
    are not read.
    """
    stats, _ = table(text_statistics(df.select("doc_id", "text")).drop("text"), "statistics")
    return _with_verdict(stats, _rules_from(stats, labels))


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, unchanged. Rows are written once
    with their statistics; learning reads these only, and the verdict filters the rows."""
    rows = df.select("doc_id", "text", F.struct(*df.columns).alias("row"))
    stats, _ = table(text_statistics(rows).drop("text"), "rows-with-statistics")
    return _with_verdict(stats, _rules_from(stats.drop("row"), labels)).filter("kept").select("row.*")
