"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is a reject condition over text statistics. The cascade measures, on a random sample of
bounded size, how long each rule takes a row and what share of rows it rejects, and orders the rules by
rejections per second; a nested CASE then stops at the first rule that rejects, and a statistic that no
rule came to is not worked out. The order changes the cost only: the verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.shared import SPACE_CLASS, free_names

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows of the sample that orders the rules, and the seed that draws it.
SAMPLE_ROWS, SAMPLE_SEED = 2000, 17


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, parted by ASCII white space; none for null or blank."""
    # split() may give an empty first and last part
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def word_chars(word_list: Column) -> Column:
    return F.length(F.array_join(word_list, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{SYMBOLS}]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(word_list: Column, window: int = WINDOW) -> Column:
    """Words in `window`-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by chained 64-bit hashes. Sorting, which costs most, runs only where the
    distinct count shows a repeat.
    """
    none = F.array().cast("array<bigint>")

    def hashes(w: Column) -> Column:
        # eight reads of an array cost less than a slice
        spans = F.transform(F.slice(w, 1, F.size(w) - (window - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))
        return F.when(F.size(w) >= window, spans).otherwise(none)

    def starts(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

        return F.sort_array(_let(ordered, repeated))

    def covered(s: Column) -> Column:
        first = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"))
        return F.aggregate(s, first, step, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(starts(h))).otherwise(F.lit(0).cast("bigint"))

    hashed = F.transform(word_list, lambda x: F.xxhash64(x))
    return _let(_let(hashed, hashes), count)


def n_echoes(word_list: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(word_list, lambda x, i: x == F.get(word_list, i - 1))).cast("long")


#: What a rule may look at, each worked out only where a rule asks for it.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: word_chars(w),
    "n_symbols": lambda text, w: n_symbols(text),
    "n_dup_lines": lambda text, w: n_dup_lines(text),
    "n_repeat_words": lambda text, w: n_repeat_words(w),
    "n_echoes": lambda text, w: n_echoes(w),
}


#: What judge() returns of every row. The others are worked out where the cascade comes to them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named reject condition: a function of a getter of statistics."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda get: get("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda get: 100 * get("n_repeat_words") > MAX_REPEAT_PERCENT * get("n_words")),
)
#: The cascade's own rules.
RULES = (
    Rule("symbols_per_word", lambda get: 10 * get("n_symbols") > get("n_words")),
    Rule("short_words", lambda get: get("word_chars") < 2 * get("n_words")),
    Rule("long_words", lambda get: get("word_chars") > 20 * get("n_words")),
    Rule("echoes", lambda get: 5 * get("n_echoes") > get("n_words")),
    Rule("duplicate_lines", lambda get: (get("n_dup_lines") >= 3) & (10 * get("n_dup_lines") > get("n_words"))),
)


def cascade(rules: Sequence[Rule], get: Callable[[str], Column]) -> Column:
    """The name of the first rule, in this order, that rejects a row; null if none does. Later rules aren't worked out."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(get), F.lit(rule.name)).otherwise(verdict)
    return verdict


def first_rejection(text: Column, rules: Sequence[Rule]) -> Column:
    """cascade() straight from the text: a statistic is worked out only if the cascade comes to a rule that reads it."""
    return _let(words(text), lambda w: cascade(rules, lambda name: STATISTICS[name](text, w)))


def order_rules(texts: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejections per second of work on a row, best first; of equals the first by name.

    Measured on a random sample of about sample_rows rows of `text`, drawn from the whole table in one
    pass over that column. What a job takes without a rule is measured too and taken off. The sample only
    sets the order of evaluation, never a verdict; without rows the order is by name.
    """
    share = min(1.0, sample_rows / max(texts.count(), 1))
    sample = texts.sample(fraction=share, seed=SAMPLE_SEED).limit(2 * sample_rows).cache()

    def run(rejected: Column) -> tuple[float, int]:
        times = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            n = sample.agg(F.count(rejected)).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), n

    rated = []
    try:
        total = max(sample.count(), 1)
        idle, _ = run(F.when(F.octet_length("text") < 0, 1))
        for rule in rules:
            taken, rejected = run(first_rejection(F.col("text"), [rule]))
            cost = max(taken - idle, 1e-4) / total  # seconds a row
            rated.append((-(rejected / total) / cost, rule.name, rule))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with struct `stats` (REPORTED), `base_failed`, `rejected_by` (the cascade's first rejecting rule) and `kept`.

    The cascade runs for rows that pass the base rules, and stops at the first rule that rejects.
    Null and blank texts have no words and fail the base rules. Texts of any length are read whole, each
    in one row's memory. Repeated rows are judged alike, each on its own. Columns of docs with these four
    names are replaced, any others stay. An empty table stays empty.
    """
    text = F.col(f"`{text_col}`")
    ordered = order_rules(docs.select(text.alias("text")), rules)

    def verdicts(w: Column) -> Column:
        reported = F.struct(*[STATISTICS[name](text, w).alias(name) for name in REPORTED])

        def of(s: Column) -> Column:
            get = lambda name: s[name] if name in REPORTED else STATISTICS[name](text, w)
            failed = cascade(BASE_RULES, get).isNotNull()
            return F.struct(s.alias("stats"), failed.alias("base_failed"), F.when(~failed, cascade(ordered, get)).alias("rejected_by"))

        return _let(reported, of)

    (own,) = free_names(docs, "judged")
    judged = docs.withColumn(own, _let(words(text), verdicts))
    fields = {name: F.col(f"{own}.{name}") for name in ("stats", "base_failed", "rejected_by")}
    return judged.withColumns(fields | {"kept": ~F.col(f"{own}.base_failed") & F.col(f"{own}.rejected_by").isNull()}).drop(own)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns, by one short-circuit cascade of all rules.

    Null, blank and repeated rows, long texts and empty tables are as in judge().
    """
    text = F.col(f"`{text_col}`")
    ordered = order_rules(docs.select(text.alias("text")), [*BASE_RULES, *rules])
    return docs.where(first_rejection(text, ordered).isNull())
