"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a condition over the text and the features that every row carries anyway; what it needs beyond them (capitals,
lines) is part of its condition and worked out only where the cascade gets that far.  On a bounded sample of raw texts
every rule's cost (seconds over the sample, beyond those of an empty condition) and selectivity (share it rejects) are
measured; rules then run in the order of rejection per cost, and CASE WHEN stops at the first that rejects.  The
order changes the time, never the verdict: a document is kept when no rule rejects it.

Defined results: a null text counts as empty, has no words and fails the base rules; repeated rows are judged alike; a
rule whose condition is null does not reject; an empty table gives no rows, and leaves the rules in the given order; extra
columns pass through, but for one that has the name of a result, which gives way to it, and names that begin with `__q_`, which are for work.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, sample_rows

#: Rows of the sample on which cost and selectivity are measured, and how often; it decides the order only.
SAMPLE_ROWS, RUNS = 2_000, 3
#: Words to a window of the repetition feature.
WINDOW = 5
#: The name of the text, never null, in a rule's condition.
TEXT = "__q_text"


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over the features and the text, which is named TEXT there."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)  # below a millisecond is noise


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and TEXT.

    n_repeat_words: words in WINDOW-word windows that the text holds twice or more.  Windows are compared by 64-bit
    hash; only a text whose hashes repeat is sorted, so most texts cost one pass.
    """
    out = docs.withColumn(TEXT, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("__q_words", F.array_remove(F.split(TEXT, WS), ""))
    n = F.size("__q_words").cast("long")
    hashes = F.transform(F.sequence(F.lit(0), F.size("__q_words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("__q_words"), i + k) for k in range(WINDOW)]))
    out = out.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(TEXT, "[^#*$%&|<>]+", "")).cast("long"),
        "__q_lines": _lines(),
        "__q_hashes": F.when(n > WINDOW, hashes),
    })
    again = F.size("__q_hashes") > F.size(F.array_distinct("__q_hashes"))
    order = F.sort_array(F.transform("__q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumns({
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_order": F.when(again, order),
    })
    same = lambda x, i: F.coalesce(F.get(F.col("__q_order"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("__q_order"), i + 1)["h"] == x["h"], F.lit(False))
    out = out.withColumn("__q_at", F.sort_array(F.transform(F.filter("__q_order", same), lambda x: x["i"])))
    covered = F.aggregate(
        "__q_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("__q_words", "__q_lines", "__q_hashes", "__q_order", "__q_at")


def _lines() -> Column:
    return F.filter(F.split(TEXT, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Integers only, so every engine agrees on every text.  Capitals and lines are counted by their own rules alone."""
    c = F.col
    capitals = F.length(F.regexp_replace(TEXT, "[^A-Z]+", ""))
    return [
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("capitals", 10 * capitals > 5 * c("word_chars")),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
        Rule("long_words", c("word_chars") > 25 * c("n_words")),
        Rule("dup_lines", (c("n_dup_lines") > 0) & (2 * c("n_dup_lines") > F.size(_lines()))),
    ]


def estimate(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows_: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample, best rejection per cost first; ties keep the given order."""
    sample = materialize(with_features(sample_rows(docs, [text_col], sample_rows_), text_col), "quality-sample").where(~base_failed())
    total = max(1, sample.count())

    def measured(condition: Column) -> tuple[float, float]:
        took, rejected = [], 0
        for _ in range(RUNS):  # the first run compiles
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(condition)).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), rejected / total

    idle = measured(F.lit(False))[0]
    found = []
    for rule in rules:
        seconds, rejected = measured(rule.rejects)
        found.append(Estimate(rule, max(0.0, seconds - idle), rejected))
    return sorted(found, key=lambda e: -e.rank)


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none: later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with features, base_failed, rejected_by (null: kept, or failed the base) and kept."""
    rules = default_rules() if rules is None else rules
    ordered = [e.rule for e in estimate(docs, rules, text_col)]
    out = with_features(docs, text_col).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(~F.col("base_failed"), first_rejection(ordered)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(TEXT)
