"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null and empty texts have no words and fail the base rules. Extra columns are dropped, repeated rows are judged alike,
and very long texts cost time in proportion to their length (the repeated windows: n log n).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Common function words of four languages.
STOP_WORDS = "the of and to in is that it for as with on be at by this le la les de des du et un une que qui en est der die das und ist von zu den mit el los las y del se por con para".split()


_STOP_FORMS = [*STOP_WORDS, *map(str.capitalize, STOP_WORDS)]


@dataclass(frozen=True)
class Rule:
    """A ratio `top / bottom`, held to `low <= ratio <= high`, when bottom > 0. Both name measures of `MEASURES`."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("long_enough", "n_words", "one", low=20),
    Rule("word_length", "word_chars", "n_words", low=2, high=12),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("alphabetic", "n_alpha_words", "n_words", low=0.6),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.3),
)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, and only where the whole is needed."""
    return F.transform(F.array(value), body)[0]


def _pairwise(h: Column, step: int, f, kind: str) -> Column:
    """f(h[i], h[i + step]) for each i."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, F.least(F.size(h), F.lit(step)) + 1, n), f).cast(f"array<{kind}>")


def _doubled(h: Column, step: int) -> Column:
    return _pairwise(h, step, lambda a, b: F.xxhash64(a, b), "bigint")


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, given a hash for each window.

    Positions of windows that share a hash are found by sorting pairs of hash and position; the union of the extents is a
    sum over the sorted positions.
    """

    def extent(at: Column) -> Column:
        gaps = _pairwise(at, 1, lambda a, b: F.least(b - a, F.lit(WINDOW)), "int")
        return F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g)).otherwise(0)

    def positions(keys: Column) -> Column:
        def both(a: Column, b: Column) -> Column:
            return F.when(a["hash"] == b["hash"], F.array(a["at"], b["at"]))

        return F.sort_array(F.array_distinct(F.flatten(F.filter(_pairwise(keys, 1, both, "array<int>"), lambda x: x.isNotNull()))))

    keys = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    found = _let(keys, lambda k: _let(positions(k), extent))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(found)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: the key and all measures that rules may name."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.col("_t"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    steps = docs.select(F.col(key).alias("doc_id"), body.alias("_t"))
    steps = steps.select("doc_id", "_t", words.alias("_w"), lines.alias("_l"))
    hashes = F.transform("_w", lambda w: F.xxhash64(w))
    windows = _let(_let(_let(hashes, lambda h: _doubled(h, 1)), lambda h: _doubled(h, 2)), lambda h: _doubled(h, 4))
    steps = steps.select("doc_id", "_t", "_w", "_l", windows.alias("_h"))
    return steps.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_h")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: w.isin(_STOP_FORMS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: F.lower(w) != F.upper(w))).cast("long").alias("n_alpha_words"),
    )


def verdict(rule: Rule) -> Column:
    """True where the row keeps the rule."""
    top, bottom = (F.lit(1) if x == "one" else F.col(x) for x in (rule.top, rule.bottom))
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (top >= F.lit(float(rule.low)) * bottom)
    if rule.high is not None:
        ok = ok & (top <= F.lit(float(rule.high)) * bottom)
    return F.when(bottom > 0, ok).otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures, `base_failed`, the list of broken rules and `kept`, all in one projection of the input."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(~verdict(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return measures(docs, key, text).withColumns({"base_failed": base, "broken": broken, "kept": ~base & (F.size(broken) == 0)})
