"""Quality rules: base rules of text statistics, and a decision list learned from labelled statistics.

Everything is DataFrame functions. One pass turns the texts into statistics, which are written;
the list is learned from those of labelled documents that pass the base rules, by sequential
covering. A rule is a conjunction of thresholds. It grows, on two thirds of the rows, by the
threshold with the largest information gain (one count by feature and bin for each step), until it
covers no good document or nothing gains; then it is pruned, on the last third, to the
conjunction's beginning with the best margin of bad over good documents. The rows it covers go, and
the next rule follows, until a pruned rule is wrong more often than not. The list is emitted as one
ordered conditional expression: the first rule that holds says why a document is not kept.

Only counts by feature and bin reach the driver. The fit sees SAMPLE_ROWS labelled documents at most.

Defined results: null and empty texts have no words and fail the base rules; texts of any length
are taken whole, each by one task, which needs some hundred bytes of memory for a word; repeated
rows are judged each; rows without a doc_id are judged, and never learned from; equal gains go to
the feature first in order, then to the smaller threshold; without labelled rows of both kinds the
list is empty and the base rules alone decide; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import free_name
from tidelane.llm.labelled import SAMPLE_ROWS, held_out, known_labels
from tidelane.operators.materialise import saved

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_points", "n_marks")
#: What rules are made of: thresholds on shares of the statistics.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_lines_share": "n_dup_lines / n_lines",
    "repeat_words_share": "n_repeat_words / n_words",
    "distinct_words_share": "n_distinct_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "points_per_word": "n_points / n_words",
    "marks_per_word": "n_marks / n_words",
    "words_per_line": "n_words / n_lines",
}
#: Base rules, fixed values: fewer words fail, and so do larger shares of repeated words, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
BINS, MAX_RULES, MAX_CONDITIONS, LEAST_COVERED = 32, 12, 4, 5


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: equal windows lie side by side in order, and their places are covered by three words each.

    Windows are told apart by their 64-bit hashes. Most texts repeat none, which needs no order to see.
    """

    def covered(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last"))
        return F.aggregate(F.sort_array(F.transform(same, lambda x: x["at"])), start, step, lambda acc: acc["n"])

    def of_hashes(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - 1)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.arrays_zip(hashes.alias("h"), places.alias("at"))), covered))

    hashes = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, of_hashes))


def _length_of(text: Column, others: str) -> Column:
    """Letters of the text that are not among the others."""
    return F.length(F.regexp_replace(text, others, ""))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))
    counted = {"n_symbols": "[^#*$%&|<>]+", "n_upper": "[^A-Z]+", "n_digits": "[^0-9]+", "n_points": "[^.,;:]+", "n_marks": "[^!?]+"}
    telling = F.regexp_replace(text, "[^#*$%&|<>A-Z0-9.,;:!?]+", "")  # short: the rest are letters and spaces
    parts = texts.select("doc_id", _let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), F.length(text).cast("long").alias("n_chars"), _let(telling, lambda t: F.struct(*(_length_of(t, others).cast("long").alias(name) for name, others in counted.items()))).alias("c"))
    flat = parts.select("doc_id", "w.*", "l.*", "c.*", "n_chars")
    return flat.select("doc_id", *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature; 0 where its divisor is."""
    top, _, bottom = FEATURES[name].partition(" / ")
    return F.col(top).cast("double") if not bottom else F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """feature > threshold if above, else feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return functools.reduce(Column.__and__, (c.column() for c in rule))


def rule_text(rule: Rule) -> str:
    return " and ".join(map(str, rule))


def verdict(rules: list[Rule]) -> Column:
    """The text of the first rule that holds, or null: an ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("string")
    return functools.reduce(lambda chain, rule: chain.when(holds(rule), rule_text(rule)), rules[1:], F.when(holds(rules[0]), rule_text(rules[0])))


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Quantiles of each feature, and of the bad rows alone, so that a rare kind has bounds of its own."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    found = rows.agg(*(F.percentile(feature(f), shares).alias(f"{f}_all") for f in FEATURES), *(F.percentile(F.when(F.col("bad") == 1, feature(f)), shares).alias(f"{f}_bad") for f in FEATURES)).first()
    return {f: sorted({x for k in ("all", "bad") for x in found[f"{f}_{k}"] or []}) for f in FEATURES}


def _counts(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """For each feature, the bad and the good rows in each bin; bin k is above k of its thresholds."""
    bins = [F.struct(F.lit(f).alias("feature"), F.size(F.filter(F.array(*map(F.lit, edges[f])), functools.partial(lambda v, x: v > x, feature(f)))).alias("bin")) for f in FEATURES if edges[f]]
    if not bins:
        return {}
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.select("bad", F.explode(F.array(*bins)).alias("at")).groupBy("at.feature", "at.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():  # bins of features
        out.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"])
    return out


def _best(counts: dict[str, dict[int, tuple[int, int]]], edges: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None, tuple[int, int]]:
    """The condition with the largest gain: bad rows it leaves, times what their share of the rows gains in bits."""
    best: tuple[float, Condition | None, tuple[int, int]] = (1e-9, None, (0, 0))
    for f in FEATURES:
        p = n = 0
        for k, threshold in enumerate(edges[f]):
            add = counts.get(f, {}).get(k, (0, 0))
            p, n = p + add[0], n + add[1]
            for above, (pc, nc) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if pc >= LEAST_COVERED and pc + nc < p0 + n0:
                    gain = pc * (math.log2(pc / (pc + nc)) - math.log2(p0 / (p0 + n0)))
                    if gain > best[0]:
                        best = (gain, Condition(f, above, threshold), (pc, nc))
    return best


def _pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best margin on the rows, and the bad and good ones it covers; the shortest of equals."""
    sums = [x for k in range(1, len(rule) + 1) for x in (F.sum(F.when(holds(rule[:k]), F.col("bad"))), F.sum(F.when(holds(rule[:k]), 1 - F.col("bad"))))]
    found = [x or 0 for x in rows.agg(*sums).first()]
    margins = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k, (p, n) in enumerate(zip(found[::2], found[1::2]), 1)]
    _, k, p, n = max(margins)
    return rule[:-k], p, n


def learned(rows: DataFrame, *, bins: int = BINS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """Rules for bad rows by sequential covering. rows: STATISTICS, bad (0 or 1), pruning (boolean: the rows that prune)."""
    edges = _thresholds(rows, bins)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.filter(verdict(rules).isNull())
        grow, prune = left.filter("NOT pruning"), left.filter("pruning")
        total = grow.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
        p, n = total[0], total[1] - total[0]
        rule: Rule = ()
        if p < LEAST_COVERED:
            break
        while len(rule) < max_conditions and n:
            gain, condition, left_counts = _best(_counts(grow.filter(holds(rule)) if rule else grow, edges), edges, p, n)
            if condition is None:
                break
            rule, (p, n) = (*rule, condition), left_counts
        if not rule:
            break
        rule, bad, good = _pruned(rule, prune)
        if bad <= good:
            break
        rules.append(rule)
    return rules


def quality_rules(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, rule (the first learned one that holds) and held_out of every document.

    The labels of a fifth of the documents, those held out, are never learned from. Given rules are taken instead of learned ones.
    """
    rows = saved(statistics(documents))
    if rules is None:
        label = free_name("quality", list(STATISTICS))
        known = known_labels(labels, "quality", sample_rows).select(F.col("doc_id").alias("labelled_id"), F.col("label").alias(label))
        sample = rows.join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).filter(~base_failed())
        one = sample.groupBy("doc_id", label).agg(F.min(F.struct(*STATISTICS)).alias("s"))
        fitted = saved(one.select((1 - F.col(label)).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"), "s.*"))
        rules = learned(fitted)
    judged = rows.select("doc_id", *STATISTICS[:5], base_failed().alias("base_failed"), verdict(rules).alias("rule"), held_out().alias("held_out"))
    return judged.select("doc_id", *STATISTICS[:5], "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", "held_out")
