"""Quality rules as a short-circuit cascade, DataFrame functions only.

A rule is a test over measures of a text (words, repeated words, symbols, lines, letters, marks). On a sample the
operator times each measure and counts which rules reject which rows; rules are then ordered greedily by rows rejected,
of those still left, per second of the measures that the rule would add. A measure is taken only for
rows that every rule before it let pass, so dear measures (letters, repeats) are seldom taken for junk. The order
changes what the cascade costs, never which documents it keeps: a document stays when no rule rejects it.

The sample is `sample_rows` rows on average, drawn row by row; all else covers all rows and whole texts.

Defined cases: a null text has no words; a text without words is rejected by the rule of few words; equal rows get equal
results; an empty table gives an empty result, with the rules in their stated order; columns that clash with new ones
are replaced. Columns of other names, null or not, are passed on as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch, columns

BLANKS = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
# timing of a measure on the sample: the least of so many runs
RUNS = 2
# what a rule over measures already taken costs, in seconds a sample
LEAST_COST = 1e-4

TEXT, WORDS, HASHES, PAIRS, AGAIN = "_rules_text", "_rules_words", "_rules_hashes", "_rules_pairs", "_rules_again"
INTERNAL = (TEXT, WORDS, HASHES, PAIRS, AGAIN)


def _words(df: DataFrame, alive: Column) -> DataFrame:
    split = F.array_remove(F.split(F.col(TEXT), BLANKS), "")
    df = df.withColumn(WORDS, F.when(alive, split))
    return df.withColumns({"n_words": F.size(WORDS).cast("long"), "word_chars": F.length(F.array_join(WORDS, "")).cast("long")})


def _repeats(df: DataFrame, alive: Column) -> DataFrame:
    """Words inside windows that occur again. Only texts whose window hashes are not all different are sorted."""
    w, h, p, r = (F.col(c) for c in (WORDS, HASHES, PAIRS, AGAIN))
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    df = df.withColumn(HASHES, F.when(alive & (F.size(w) >= WINDOW), F.transform(
        starts, lambda i: F.xxhash64(*[F.get(w, i + j if j else i) for j in range(WINDOW)]))))
    some = F.size(h) > F.size(F.array_distinct(h))
    df = df.withColumn(PAIRS, F.when(some, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn(AGAIN, F.sort_array(F.transform(
        F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])), lambda x: x["i"])))
    # a window covers the words up to the next one
    covered = F.transform(r, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(r, i + 1), at + WINDOW) - at))
    total = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return df.withColumn("n_repeat_words", F.when(alive, total)).drop(HASHES, PAIRS, AGAIN)


def _lines(df: DataFrame, alive: Column) -> DataFrame:
    lines = F.filter(F.split(F.col(TEXT), "\n"), lambda line: line.rlike(A_WORD))
    df = df.withColumn(PAIRS, F.when(alive, lines))
    return df.withColumns({"n_lines": F.size(PAIRS).cast("long"),
                           "n_dup_lines": (F.size(PAIRS) - F.size(F.array_distinct(PAIRS))).cast("long")}).drop(PAIRS)


def _counts(**patterns: str) -> Callable[[DataFrame, Column], DataFrame]:
    def add(df: DataFrame, alive: Column) -> DataFrame:
        return df.withColumns({name: F.when(alive, F.regexp_count(F.col(TEXT), F.lit(p)).cast("long")) for name, p in patterns.items()})

    return add


@dataclass(frozen=True)
class Measure:
    """Columns that `add` takes from the text of rows that are still alive, after the measures it `needs`."""

    add: Callable[[DataFrame, Column], DataFrame]
    gives: tuple[str, ...]
    needs: tuple[str, ...] = ()


MEASURES = {
    "words": Measure(_words, ("n_words", "word_chars")),
    "symbols": Measure(_counts(n_symbols=SYMBOLS), ("n_symbols",)),
    "lines": Measure(_lines, ("n_lines", "n_dup_lines")),
    "repeats": Measure(_repeats, ("n_repeat_words",), ("words",)),
    "letters": Measure(_counts(n_letters=r"\p{L}", n_capitals=r"\p{Lu}"), ("n_letters", "n_capitals")),
    "exclaims": Measure(_counts(n_exclaims="!"), ("n_exclaims",)),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text where `fails` holds; SQL over the columns of the measures it `needs`."""

    name: str
    needs: tuple[str, ...]
    fails: str


BASE_RULES = (
    Rule("few_words", ("words",), "n_words < 50"),
    Rule("repeated_words", ("words", "repeats"), "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("words", "symbols"), "10 * n_symbols > n_words"),
    Rule("duplicate_lines", ("lines",), "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", ("words",), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("few_letters", ("words", "letters"), "100 * n_letters < 70 * word_chars"),
    Rule("capitals", ("letters",), "2 * n_capitals > n_letters"),
    Rule("exclaims", ("words", "exclaims"), "5 * n_exclaims > n_words"),
)


def _closure(names: tuple[str, ...] | list[str]) -> list[str]:
    """The measures and all that they need, each behind its needs."""
    out: list[str] = []
    for name in names:
        out += [m for m in [*_closure(MEASURES[name].needs), name] if m not in out]
    return out


def measured(df: DataFrame, names: list[str], alive: Column | None = None) -> DataFrame:
    for name in names:
        df = MEASURES[name].add(df, F.lit(True) if alive is None else alive)
    return df


def order_rules(rejects: list[tuple[frozenset, int]], costs: dict[str, float], rules: tuple[Rule, ...], taken: list[str]) -> list[Rule]:
    """Greedy order: rows rejected of those left, per second of measures not yet taken; ties keep the stated order.

    `rejects` counts sample rows by the set of rules that reject them, `costs` has seconds per measure."""
    left, order, taken = list(rules), [], list(taken)
    while left:
        def worth(rule: Rule) -> float:
            return sum(n for failed, n in rejects if rule.name in failed) / max(
                LEAST_COST, sum(costs[m] for m in _closure(rule.needs) if m not in taken))

        best = max(left, key=worth)
        left.remove(best)
        order.append(best)
        taken += [m for m in _closure(best.needs) if m not in taken]
        rejects = [(failed, n) for failed, n in rejects if best.name not in failed]
    return order


def estimate(sample: DataFrame, rules: tuple[Rule, ...]) -> tuple[list[tuple[frozenset, int]], dict[str, float]]:
    """What `order_rules` reads, from a stored sample with the text column of this module."""
    def seconds(names: list[str]) -> float:
        gives = [F.sum(c) for n in names for c in MEASURES[n].gives]
        best = float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            measured(sample, names).agg(F.count(F.lit(1)), *gives).collect()
            best = min(best, time.perf_counter() - began)
        return best

    names = _closure([m for r in rules for m in r.needs])
    nothing = seconds([])
    costs = {m: max(LEAST_COST, seconds(_closure((m,))) - (seconds(_closure(MEASURES[m].needs)) if MEASURES[m].needs else nothing)) for m in names}
    failed = F.array_compact(F.array(*[F.when(F.expr(r.fails), r.name) for r in rules]))
    # a row per set of rules that occurs, no more than the sample has rows
    counted = measured(sample, names).groupBy(failed.alias("failed")).count().collect()
    return [(frozenset(r["failed"]), r["count"]) for r in counted], costs


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, always: tuple[str, ...] = (), sample_rows: int = 2000, seed: int = 5,
            text_col: str = "text") -> DataFrame:
    """`docs` with `failed_rule` (the first rule of the cascade that rejects, null if none), `kept`, and the columns of
    the measures named in `always`, which are taken for every row."""
    new = (*(c for m in MEASURES.values() for c in m.gives), "failed_rule", "kept", *INTERNAL)
    if text_col.lower() in new:
        raise ValueError(f"the text column can't be named {text_col}")
    scratch = Scratch(docs.sparkSession, "rules")
    narrow = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(TEXT))
    rows = docs.count()
    order = list(rules)
    taken = _closure(always)
    if rows:
        sample = scratch.store(narrow.sample(min(1.0, sample_rows / rows), seed))
        order = order_rules(*estimate(sample, rules), rules, taken)
        scratch.drop(sample)
    out = docs.select(*columns(docs, new), F.coalesce(F.col(text_col), F.lit("")).alias(TEXT))
    out = measured(out, taken).withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in order:
        alive = F.col("failed_rule").isNull()
        for name in _closure(rule.needs):
            if name not in taken:
                out = measured(out, [name], alive)
                taken.append(name)
        out = out.withColumn("failed_rule", F.when(alive, F.when(F.expr(rule.fails), rule.name)).otherwise(F.col("failed_rule")))
    gives = [c for m in _closure(always) for c in MEASURES[m].gives]
    # a generator, so that filters on the verdict are not pushed below, where they would unfold all steps anew
    out = out.select(*columns(docs, new), *gives, F.explode(F.array("failed_rule")).alias("failed_rule"))
    return out.withColumn("kept", F.col("failed_rule").isNull())


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", **options) -> DataFrame:
    """Documents that no rule rejects, with their own columns, whatever their names."""
    whole = docs.select(F.struct("*").alias("_rules_row"), F.col(text_col).alias("_text"))
    return cascade(whole, rules, text_col="_text", **options).filter("kept").select("_rules_row.*")
