"""Quality rules as a short-circuit cascade (operator 2, DataFrame functions only).

A rule is a boolean column that rejects a document, built from measures of its
text. ``plan_cascade`` runs every rule on a sample of bounded size, takes the
share it rejects and the seconds it adds to splitting the texts into words, and
orders the rules by rejection per second: cheap rules that reject much come
first. ``apply_cascade`` nests
the rules in that order in one CASE expression, of which Spark evaluates only
the branches it reaches, so a rejected document never pays for the rules that
follow. The order changes the cost, never the verdict.

Defined results: a null text has no words and counts as empty; an empty text
has zero in every measure and is rejected (too few words); repeated rows get
equal results, one for each row; an empty table gives an empty result; other
columns of the input pass through (or are ignored by the query), whatever
their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, free_name, let, text_or_empty, words_of

WINDOW = 8
MIN_WORDS = 20

#: Rows of the sample that costs and selectivities are estimated on (about).
SAMPLE_ROWS = 200
#: Seconds that the words of the repeated sample should take, so that a job's own
#: start does not count; timed runs of a rule, of which the fastest counts; cost
#: differences below this share of the words' cost are noise.
WORK_SECONDS, RUNS, NOISE = 0.15, 2, 0.1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(text), r"[^#*$%&|<>]+", "")).cast("long")


def count_dup_lines(text: Column) -> Column:
    """Lines (split at \\n) that hold a word and equal an earlier line. Lines
    are searched for words only where two lines are equal."""
    def repeated(x):
        full = F.filter(x, lambda y: y.rlike(r"[^\x20\x09-\x0D]"))
        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(
            let(full, lambda y: (F.size(y) - F.size(F.array_distinct(y))).cast("long")))
    return let(F.split(text_or_empty(text), "\n"), repeated)


def count_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text_or_empty(text), "\n"),
                           lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")


def _window_hashes(words: Column) -> Column:
    """One 64-bit hash for each window of eight words, by doubling: hashes of
    one word give those of two, these of four, these of eight."""
    def pairs(h, step):
        return let(h, lambda x: F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x), F.lit(1))),
                                           lambda a, b: F.xxhash64(a, b)))
    hashes = pairs(pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return let(hashes, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))


def _covered(win: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: windows are
    sorted by (hash, place); those equal to a neighbour are the repeated ones;
    each covers its eight words less those the previous one covers."""
    at = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        n = F.size(s)
        rep = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"]) & (j > 0))
                       | (F.get(s, j + 1)["h"].eqNullSafe(x["h"]) & (j + 1 < n)))
        return F.array_sort(F.transform(rep, lambda x: x["i"]))

    def total(p):
        return F.aggregate(F.transform(p, lambda x, j: F.when(j == 0, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), x - F.get(p, j - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(at, places), total)


def count_repeat_words(words: Column) -> Column:
    """Words inside eight-word windows found twice or more in the text, the
    first occurrence included. Sorting happens only where a window repeats."""
    return let(_window_hashes(words), lambda win: F.when(
        F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(_covered(win)))


class Measures:
    """What rules read: the text, its words and the base measures, each a column.
    ``known`` holds those that are computed already."""

    def __init__(self, text: Column, words: Column, known: Column | None = None):
        self.text, self.words = text, words
        self.n_words = F.size(words)
        self.chars = known["word_chars"] if known is not None else F.length(F.concat_ws("", words))
        self.n_symbols = known["n_symbols"] if known is not None else count_symbols(text)
        self.n_dup_lines = known["n_dup_lines"] if known is not None else count_dup_lines(text)
        self.n_repeat_words = known["n_repeat_words"] if known is not None else count_repeat_words(words)


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)`` gives a boolean column, true where the text fails."""
    name: str
    rejects: Callable[[Measures], Column]


def _shouting(m):
    loud = F.size(F.filter(m.words, lambda x: x.endswith("!!")))
    return F.when(F.contains(text_or_empty(m.text), F.lit("!!")), loud * 10 > m.n_words * 3).otherwise(False)


def _repeated_lines(m):
    return F.when(m.n_dup_lines == 0, False).otherwise(m.n_dup_lines * 100 > count_lines(m.text) * 60)


def _word_runs(m):
    """Words that equal the word before them."""
    same = F.zip_with(m.words, F.slice(m.words, 2, F.greatest(m.n_words, F.lit(1))), lambda x, y: x == y)
    return F.size(F.filter(same, lambda x: x)) * 100 > m.n_words * 30


#: The two base rules first: the cascade may put any rule anywhere.
BASE_RULES = (Rule("few_words", lambda m: m.n_words < MIN_WORDS),
              Rule("repeated_windows", lambda m: m.n_repeat_words * 100 > m.n_words * 30))
RULES = BASE_RULES + (
    Rule("symbols", lambda m: m.n_symbols * 10 > m.n_words * 3),
    Rule("repeated_lines", _repeated_lines),
    Rule("shouting", _shouting),
    Rule("word_length", lambda m: (m.chars < m.n_words * 2) | (m.chars > m.n_words * 20)),
    Rule("word_runs", _word_runs))


def _timed(sample: DataFrame, check: Column, times: int, runs: int) -> tuple[int, float]:
    """Rows that fail ``check``, and the seconds of the fastest of ``runs`` jobs
    that evaluate it on the sample ``times`` times over."""
    again = sample.select("text", F.explode(F.array_repeat(F.lit(0), times)).alias("again"))
    bad, seconds = 0, float("inf")
    for _ in range(runs):
        began = time.perf_counter()
        bad = again.agg(F.count_if(check == False)).first()[0]  # noqa: E712
        seconds = min(seconds, time.perf_counter() - began)
    return bad // times, seconds


def hash_sample(docs: DataFrame, rows: int) -> DataFrame:
    """From ``rows`` to twice as many rows of ``docs`` on average (all, if there are
    fewer), taken by a hash of their place, so from every part of the table."""
    step = max(1, docs.count() // rows)
    at = free_name(docs, "at")
    return docs.withColumn(at, F.monotonically_increasing_id()).where(F.pmod(F.xxhash64(at), F.lit(step)) == 0).drop(at)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
                 sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """``(rule, share rejected, seconds)`` in cascade order.

    The sample is written once (it feeds the estimate, not the result) and
    repeated until splitting it into words, which every rule needs and the cascade
    does once, outweighs the start of a job; a rule's cost is what its job takes
    beyond the same job without a rule. Each job runs twice, as the first run
    compiles its code. Selectivity is smoothed, so a
    rule without a rejection is ranked by its cost. An empty table keeps the
    given order."""
    sample = cut_lineage(hash_sample(docs.select(F.col(text).alias("text")), sample_rows).repartition(1), "quality-sample")
    n = sample.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    t = F.col("text")
    only_words = let(words_of(t), lambda w: F.size(w) >= 0)
    start = _timed(sample, F.lit(True), 1, RUNS)[1]
    work = max(_timed(sample, only_words, 1, RUNS)[1] - start, WORK_SECONDS / 100)
    times = max(1, round(WORK_SECONDS / work))
    words = _timed(sample, only_words, times, RUNS)[1]
    found = []
    for i, rule in enumerate(rules):
        bad, seconds = _timed(sample, cascade([rule], t), times, RUNS)
        found.append((rule, bad / n, max(seconds - words, NOISE * words) / times, i))
    found.sort(key=lambda x: (-((x[1] * n + 0.5) / (n + 1)) / x[2], x[3]))
    return [x[:3] for x in found]


def _nested(order: list[Rule], m: Measures) -> Column:
    out = F.lit(True)
    for rule in reversed(order):
        out = F.when(rule.rejects(m), F.lit(False)).otherwise(out)
    return out


def cascade(order: list[Rule], text: Column) -> Column:
    """True where no rule rejects; later rules run only where earlier ones passed."""
    return let(words_of(text), lambda w: _nested(order, Measures(text, w)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule passes, columns unchanged."""
    order = [r for r, _, _ in plan_cascade(docs, rules, text)]
    return docs.where(cascade(order, F.col(text)))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the base measures, ``base_failed`` and the verdict ``kept``, a row
    for each row of ``docs``.

    The base rules read the measures, which are returned anyway; the cascade
    orders and runs the other rules, for rows that pass the base."""
    rest = tuple(r for r in rules if r not in BASE_RULES)
    order = [r for r, _, _ in plan_cascade(docs, rest, text)]
    t = F.col(text)

    def judged(w, b):
        m = Measures(t, w, b)
        failed = BASE_RULES[0].rejects(m) | BASE_RULES[1].rejects(m)
        return F.struct(*[b[c].alias(c) for c in MEASURES], failed.alias("base_failed"),
                        F.when(failed, F.lit(False)).otherwise(_nested(order, m)).alias("kept"))

    def base(w):
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
                        count_symbols(t).alias("n_symbols"), count_dup_lines(t).alias("n_dup_lines"),
                        count_repeat_words(w).alias("n_repeat_words"))

    row = let(words_of(t), lambda w: let(base(w), lambda b: judged(w, b)))
    return docs.select(F.col(key).alias("doc_id"), F.inline(F.array(row)))
