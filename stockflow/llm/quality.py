"""Quality rules as a short-circuit cascade.

Every document gets the base measures; documents that pass the base verdict
go through further rules. On a sample of bounded size the cost of each rule (seconds)
and its selectivity (share rejected) are estimated; the rules run in falling
order of rejection per cost inside one CASE, which stops at the first that
rejects. A rule that needs only the base measures is nearly free; one that
scans the text again is paid for only by documents that all cheaper rules
let through. The order changes cost and the reported first rule, never the
verdict, which is the conjunction of all rules.

Defined results: null text has no words and fails the base verdict; repeated
rows are judged alike; an empty table gives no rows; extra columns are
ignored. Whole texts are measured, of any length.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import WORD, cut, words_of

REPEAT_WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The base measures of every document (one projection, no shuffle)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                     *[F.col(c) for c in keep])
    df = df.withColumn("words", words_of(F.col("text")))
    # Repeated windows: place i repeats if its window hash stands next to an equal one in sorted order.
    k = REPEAT_WINDOW
    df = df.withColumn("wins", F.when(F.size("words") > k, F.transform(
        F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))))
    df = df.withColumn("wins", F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.sort_array(
        F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda z, j: F.get("wins", j)["h"] == z["h"]
    df = df.withColumn("again", F.sort_array(F.transform(
        F.filter(F.transform("wins", lambda z, j: F.struct(
            z["i"].alias("i"), ((j > 0) & same(z, F.greatest(j - 1, F.lit(0))) | F.coalesce(same(z, j + 1), F.lit(False))).alias("r"))),
            lambda z: z["r"]), lambda z: z["i"])))
    covered = F.aggregate(
        F.transform("again", lambda i, j: F.least(F.lit(k), F.coalesce(F.get("again", j + 1) - i, F.lit(k)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(WORD))
    # Of n equal lines, n - 1 are equal to an earlier one.
    dup_lines = F.size(lines) - F.size(F.array_distinct(lines))
    return df.select(
        "doc_id", "text", *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents that the rule turns down; it may use
    the base measures and ``text``."""
    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    t = F.col("text")
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("symbol_words", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.regexp_count(t, F.lit(r"[^\n]+"))),
        Rule("adjacent_repeats", F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))")) * 10 > 3 * F.col("n_words")),
        Rule("letters", F.regexp_count(t, F.lit(r"\p{L}")) * 10 < 6 * F.col("word_chars")),
        Rule("ellipsis_lines", F.regexp_count(t, F.lit(r"(?m)(\.\.\.|…)\s*$")) * 10 > 3 * F.regexp_count(t, F.lit(r"[^\n]+"))),
        Rule("bullet_lines", F.regexp_count(t, F.lit(r"(?m)^\s*[-*•]")) * 10 > 9 * F.regexp_count(t, F.lit(r"[^\n]+"))),
    ]


def estimate(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule on a materialised sample."""
    rows = max(sample.count(), 1)
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.where(rule.rejects).count()
        found.append((rule, max(time.perf_counter() - began, 1e-6), rejected / rows))
    return found


def order_rules(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Falling rejection per cost; ties by cost, then name."""
    return [r for r, cost, share in sorted(estimates, key=lambda e: (-e[2] / e[1], e[1], e[0].name))]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
            sample_rows: int = 2000, base: Column | None = None) -> DataFrame:
    """Measures, base verdict and cascade verdict of every document.

    About ``sample_rows`` random rows serve to estimate costs; they have no
    influence on ``kept``. Adds ``base_failed, rejected_by, kept``.
    """
    rules = default_rules() if rules is None else rules
    base = base_failed() if base is None else base
    measured = measures(docs, id_col=id_col, text_col=text_col)
    if len(rules) > 1:
        share = min(1.0, sample_rows / max(docs.count(), 1))
        sample = cut(measures(docs.sample(share, seed=1), id_col=id_col, text_col=text_col), "quality-sample")
        rules = order_rules(estimate(sample.where(~base), rules))
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        chain = chain.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    judged = measured.withColumn("base_failed", base).withColumn("rejected_by", chain if rules else F.when(F.col("base_failed"), F.lit("base")))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("text")
