"""Quality rules as one Spark projection, compiled from a table of thresholds.

Each rule names a measure and the range it must lie in. Measures are counts and
ratios over words, symbols, stop words and lines; all are built-in expressions,
so a scan with the rules is a scan with a wider projection and shuffles nothing.

Defined results: a null or empty text has no words, all its measures are 0 and
it fails the base rules; repeated rows are judged one by one; other columns pass
through, and measures replace columns of the same name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import SPACE, SPACE_CLASS, whole

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that was for it with as on be at by from are this an "
    "der die und den das von zu mit sich auf für nicht ein eine ist dem im "
    "le la les de des du et un une est en que qui pour dans sur par avec "
    "el los las y por con para se del una no su al"
).split()


class Rule(NamedTuple):
    """Holds if ``low <= measure <= high``, or the text has fewer than ``from_words`` words."""

    name: str
    measure: str
    low: float
    high: float
    from_words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0, 10),
    Rule("symbols", "symbol_ratio", 0.0, 0.10),
    Rule("stop_words", "stop_ratio", 0.005, 1.0, 100),
    Rule("duplicate_lines", "dup_line_ratio", 0.0, 0.60, 50),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in text order.

    Sorting (hash, place) pairs puts equal windows side by side: n log n for a
    text of any length. Texts without a repeated window skip the sort.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_pairs: Column) -> Column:
        def same(i: Column, other: Column) -> Column:
            return F.get(sorted_pairs, i)["h"] == F.get(sorted_pairs, other)["h"]

        marked = F.transform(
            sorted_pairs,
            lambda p, i: F.when(
                F.coalesce(same(i, i - 1), F.lit(False))
                | F.coalesce(same(i, i + 1), F.lit(False)),
                p["i"],
            ),
        )
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))

    def widen(seen: Column, place: Column) -> Column:
        end = place + WINDOW
        return F.struct(
            (seen["n"] + end - F.greatest(place, seen["end"])).alias("n"), end.alias("end")
        )

    # The pairs are bound once by a one-element array, so that the lambdas share them.
    places = F.flatten(F.transform(F.array(pairs), repeated))
    return F.aggregate(places, start, widen, lambda seen: seen["n"])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ratios."""
    raw = whole(text)
    staged = docs.withColumns(
        {
            "_words": F.array_remove(F.split(raw, SPACE_CLASS + "+"), ""),
            "_lines": F.filter(F.split(raw, "\n"), lambda line: _without(line, SPACE) != ""),
            "word_chars": F.char_length(_without(raw, SPACE)).cast("long"),
            "n_symbols": (F.char_length(raw) - F.char_length(_without(raw, SYMBOLS))).cast("long"),
        }
    )
    staged = staged.withColumns(
        {
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "n_words": F.size("_words").cast("long"),
            "_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
            "_n_lines": F.size("_lines"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_words", "_lines")
    staged = staged.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.slice("_hashes", 1, F.col("n_words").cast("int") - (WINDOW - 1)),
                lambda h, i: F.xxhash64(h, *(F.get("_hashes", i + k) for k in range(1, WINDOW))),
            ),
        ),
    ).drop("_hashes")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return staged.withColumns(
        {
            "n_repeat_words": F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))
            )
            .otherwise(0)
            .cast("long"),
            "mean_word_chars": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / n,
            "stop_ratio": F.col("_stop") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        }
    ).drop("_windows", "_stop", "_n_lines")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as an array."""
    broken = [
        F.when(
            (F.col("n_words") >= r.from_words)
            & ~F.col(r.measure).between(F.lit(r.low), F.lit(r.high)),
            F.lit(r.name),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` plus the measures, ``base_failed``, ``broken_rules`` and ``kept``."""
    measured = measures(docs, text)
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return measured.withColumns({"base_failed": base, "broken_rules": compiled(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that keep all rules, with their own columns."""
    # A filter on a plain projection is pushed below it, and the measures would be
    # written out anew for every use in it. A column that is no pure function of
    # the row holds the filter above the measures, so they are computed once.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    judged = judge(rows, rules, "_text").withColumn("_task", F.spark_partition_id())
    return judged.where(F.col("kept") & (F.col("_task") >= 0)).select("_row.*")
