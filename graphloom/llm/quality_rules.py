"""Quality rules as a short-circuit cascade (DataFrame operations only).

Every rule has a name, the counts it needs, and a condition that rejects a text. A sample that is spread over all
partitions gives each rule's cost (seconds over the sample, beyond those of reading it) and selectivity (share rejected);
rules then run in falling order of rejection per cost, and what a text that one rule rejects would cost the next ones is not
spent on it. The order changes the cost alone, never the verdict.

``quality_counts`` has to report five counts of every text, so these are known to its cascade, which is of the rules beyond
the base ones; they have counts of their own. ``quality_filter`` knows nothing before its cascade, which is of all rules.

Defined cases: a null text has no words; empty texts have zero counts and fail the base rule on the number of words; ties in
rejection per cost keep the order in which the rules are given; an empty table gives an empty result; rows may repeat; extra
columns are ignored by ``quality_counts`` and kept by ``quality_filter``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, forget, let, materialize, split_words, text_of

#: Symbols that count, the window of repeats, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEAT_PERCENT = 20, 30
#: Rows that the sample has on average, and how often each rule is timed on it; the shortest time counts.
SAMPLE_ROWS, TIMES = 2_000, 3


def count_symbols(text: Column, chars: str = SYMBOLS) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _window_hashes(words: Column) -> Column:
    """A hash of each window of eight words, by doubling: pairs, fours, eights."""

    def pair(hashes: Column, step: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, F.lit(step + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))

    return let(pair(words, 1), lambda two: let(pair(two, 2), lambda four: F.slice(pair(four, 4), F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash comes twice or more, from all windows' hashes."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    starts = let(ranked, lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"])))
    return let(starts, lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda n, x: n + x))


def repeat_words(words: Column) -> Column:
    """Words in windows of eight that come twice or more in the text, the first included."""
    count = let(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(count)


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words, count)``: true for texts to drop; ``count(name)`` is a count, known or computed here."""

    name: str
    rejects: Callable[[Column, Column, Callable[[str], Column]], Column]


#: The counts that rules use.
COUNTS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: word_chars(words),
    "n_symbols": lambda text, words: count_symbols(text),
    "n_dup_lines": lambda text, words: dup_lines(text),
    "n_repeat_words": lambda text, words: repeat_words(words),
    "n_lines": lambda text, words: F.size(F.split(text, "\n")).cast("long"),
    "n_bangs": lambda text, words: count_symbols(text, "!"),
}
#: Those that ``quality_counts`` reports.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_RULES = (
    Rule("few_words", lambda t, w, n: n("n_words") < LEAST_WORDS),
    Rule("repeated_passages", lambda t, w, n: n("n_repeat_words") * 100 > n("n_words") * MOST_REPEAT_PERCENT),
)
MORE_RULES = (
    Rule("symbols", lambda t, w, n: n("n_symbols") * 10 > n("n_words")),
    Rule("word_length", lambda t, w, n: (n("word_chars") * 2 < n("n_words") * 5) | (n("word_chars") > n("n_words") * 12)),
    Rule("repeated_lines", lambda t, w, n: n("n_dup_lines") * 2 > n("n_lines")),
    Rule("shouting", lambda t, w, n: n("n_bangs") * 10 > n("n_words") * 3),
)


def _seconds(job: Callable[[], object]) -> float:
    took = []
    for _ in range(TIMES):
        began = time.perf_counter()
        job()
        took.append(time.perf_counter() - began)
    return min(took)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", known: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling share rejected per second, both measured on about ``sample_rows`` rows.

    Every row has the same chance to be in the sample, which is written to the shared folder: whole texts, none on the
    driver. ``known`` names the counts that cost a rule nothing. A rule is run once before it is timed.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)
    text = F.col("__text")
    drawn = docs.select(text_of(text_col).alias("__text")).sample(min(1.0, sample_rows / total), 7)
    counts = {name: COUNTS[name](text, F.col("__words")) for name in known}
    drawn = materialize(drawn, "quality-sample")
    sample = drawn.withColumn("__words", split_words(text)).withColumns(counts).coalesce(1).persist()
    try:
        flags = {r.name: r.rejects(text, F.col("__words"), lambda name: F.col(name) if name in counts else COUNTS[name](text, F.col("__words"))) for r in rules}
        shares = sample.agg(*[F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias(name) for name, flag in flags.items()]).first()
        idle = lambda: sample.agg(F.count_if(F.isnotnull(text) & F.isnotnull("__words"))).collect()
        idle()
        floor, rates = _seconds(idle), {}
        for name, flag in flags.items():
            job = lambda flag=flag: sample.agg(F.count_if(flag)).collect()
            job()
            rates[name] = shares[name] / max(_seconds(job) - floor, 1e-3)
    finally:
        sample.unpersist()
        forget(drawn)
    return sorted(rules, key=lambda r: -rates[r.name])


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, the five counts, base_failed and kept."""
    rules = order_rules(docs, MORE_RULES, text_col, known=REPORTED)
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).withColumn("__words", split_words(F.col("__text")))
    rows = rows.withColumns({name: COUNTS[name](F.col("__text"), F.col("__words")) for name in REPORTED})
    rows = rows.withColumn("base_failed", BASE_RULES[0].rejects(None, None, F.col) | BASE_RULES[1].rejects(None, None, F.col))
    own = lambda name: F.col(name) if name in REPORTED else COUNTS[name](F.col("__text"), F.col("__words"))
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.rejects(F.col("__text"), F.col("__words"), own), F.lit(False))
    return rows.select(F.col("__id").alias(id_col), *REPORTED, "base_failed", verdict.otherwise(F.lit(True)).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a rule rejects; no rule runs on what an earlier one rejected."""
    text = text_of(text_col)

    def verdict(words: Column) -> Column:
        out = F.lit(True)
        for rule in reversed(order):
            out = F.when(rule.rejects(text, words, lambda name: COUNTS[name](text, words)), F.lit(False)).otherwise(out)
        return out

    order = order_rules(docs, BASE_RULES + MORE_RULES, text_col)
    return docs.where(let(split_words(text), verdict))
