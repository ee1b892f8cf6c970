"""Operator 9: quality rules as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lograft.session import stored

# About so many rows are drawn to estimate costs and selectivities; they only decide the order of the rules.
SAMPLE_ROWS = 2000
# Steps that a regular expression takes for a character, as against a byte search.
PATTERN_STEPS = 10


@dataclass(frozen=True)
class Rule:
    """``failed``: a Column that is true for a row to reject; NULL counts as passed.

    ``work``: a Column of the steps this takes on a row, such as the characters passed over; one
    step, a comparison of numbers, if not given. It only decides the order of the rules.
    """

    name: str
    failed: Column
    work: Column | None = None


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    """The text without these characters; plain byte searches, far cheaper than a pattern."""
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def add_measures(docs: DataFrame) -> DataFrame:
    """Adds the base measures (long) to every row; columns of these names are replaced.

    A NULL text has no words, lines or symbols. All is done within the row, with no
    shuffle: hashes of the three-word windows tell whether any can be equal, and
    only then are the windows themselves sorted, n log n in the text's length.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(docs["text"], F.lit(""))
    spaced = text
    for char in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(char), F.lit(" "))
    rows = docs.select(
        *(docs[c] for c in kept),
        text.alias("__text"),
        F.array_remove(F.split(spaced, " "), "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "").alias("__lines"),
    )
    windows = F.greatest(F.size("__words") - 2, F.lit(0))
    zipped = F.arrays_zip(
        F.slice("__words", F.lit(1), windows).alias("a"),
        F.slice("__words", F.lit(2), windows).alias("b"),
        F.slice("__words", F.lit(3), windows).alias("c"),
    )
    rows = rows.select(
        *kept,
        "__text",
        "__lines",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        zipped.alias("__windows"),
    )
    rows = rows.withColumn("__hashes", F.transform("__windows", lambda w: F.xxhash64(w["a"], w["b"], w["c"])))
    # Windows sorted by their words, each with its place; equal ones then stand side by side.
    in_order = F.sort_array(
        F.transform(
            "__windows", lambda w, i: F.struct(F.concat_ws(" ", w["a"], w["b"], w["c"]).alias("gram"), i.alias("at"))
        )
    )
    some_equal = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    none = F.array().cast("array<struct<gram:string,at:int>>")
    rows = rows.withColumn("__sorted", F.when(some_equal, in_order).otherwise(none)).drop("__windows", "__hashes")
    pairs = F.greatest(F.size("__sorted") - 1, F.lit(0))
    rows = rows.withColumn(
        "__same",
        F.zip_with(
            F.slice("__sorted.gram", F.lit(1), pairs), F.slice("__sorted.gram", F.lit(2), pairs), lambda x, y: x == y
        ),
    )
    first, last = F.concat(F.array(F.lit(False)), "__same"), F.concat("__same", F.array(F.lit(False)))
    repeated = F.zip_with("__sorted.at", F.zip_with(first, last, lambda x, y: x | y), lambda i, r: F.when(r, i))
    rows = rows.withColumn("__repeated", F.sort_array(F.array_compact(repeated)))
    # A window covers three words, fewer new ones if the next begins within it.
    gaps = F.greatest(F.size("__repeated") - 1, F.lit(0))
    steps = F.zip_with(
        F.slice("__repeated", F.lit(1), gaps),
        F.slice("__repeated", F.lit(2), gaps),
        lambda x, y: F.least(y - x, F.lit(3)),
    )
    covered = F.aggregate(steps, F.lit(3), lambda total, step: total + step)
    return rows.select(
        *kept,
        "n_words",
        "word_chars",
        _removed(F.col("__text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__repeated") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Rules over ``text`` and the base measures; marks, shouting, odd word lengths, repeated lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = _removed(text, "\n") + 1
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    chars = F.length(text)
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * lines, chars),
        Rule("shouting", 2 * capitals > F.col("word_chars"), PATTERN_STEPS * chars),
        Rule("exclamations", 5 * _removed(text, "!") > F.col("n_words"), chars),
    ]


@dataclass(frozen=True)
class Estimate:
    """``rejected`` and ``work`` are means over the sampled rows that all rules before have let pass."""

    rule: Rule
    rejected: float
    work: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.work, 1e-9)


def estimate(rows: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """The rules in the order to run them, with their estimates on the rows of a bounded sample.

    Next is always the rule that rejects most per step among the rows that no rule before has
    rejected, so one that only repeats another comes late; of equals the cheaper, then by name.
    Costs are counted in steps (:class:`Rule`), not timed: a pass over a sample takes about as
    long as the start of its job, and equal samples then give equal orders. One
    aggregation by the rules' verdicts, of which a sample has no more than rows.
    """
    if not rules:
        return []
    failed = [F.coalesce(r.failed, F.lit(False)).alias(f"failed{i}") for i, r in enumerate(rules)]
    steps = [F.lit(1.0) if r.work is None else F.coalesce(r.work.cast("double"), F.lit(0.0)) for r in rules]
    judged = rows.select(*failed, *(s.alias(f"work{i}") for i, s in enumerate(steps)))
    groups = (
        judged.groupBy(*(f"failed{i}" for i in range(len(rules))))
        .agg(F.count("*").alias("n"), *(F.sum(f"work{i}").alias(f"work{i}") for i in range(len(rules))))
        .collect()
    )

    def among(i: int) -> Estimate:
        n = max(sum(g["n"] for g in groups), 1)
        return Estimate(rules[i], sum(g["n"] for g in groups if g[f"failed{i}"]) / n, sum(g[f"work{i}"] for g in groups) / n)

    found, left = [], set(range(len(rules)))
    while left:
        estimates = {i: among(i) for i in left}
        best = min(left, key=lambda i: (-estimates[i].worth, estimates[i].work, rules[i].name))
        found.append(estimates[best])
        left.remove(best)
        groups = [g for g in groups if not g[f"failed{best}"]]
    return found


def cascade(rules: list[Rule]) -> Column:
    """True if no rule fails. A rule is evaluated only for rows that all before it have let pass."""
    verdict = None
    for rule in rules:
        failed = F.coalesce(rule.failed, F.lit(False))
        verdict = F.when(failed, F.lit(False)) if verdict is None else verdict.when(failed, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds the base measures, ``base_failed`` and ``kept`` to every row, in one pass.

    Rows keep their other columns; columns of the added names are replaced. An
    empty table gives an empty result. ``kept`` does not depend on the order of the
    rules, so neither on the sample. ``rules`` replace :func:`standard_rules`.
    """
    docs = docs.drop("base_failed", "kept")
    measured = add_measures(docs).withColumn("base_failed", base_failed())
    # A share of every partition; a limit would send its number of rows from each to one task.
    share = min(1.0, sample_rows / max(docs.count(), 1))
    # Written before it is judged, so that the measures are computed once and not once a rule.
    sample = stored(add_measures(docs.sample(share, seed=9)), "rules-sample").where(~base_failed())
    ordered = [e.rule for e in estimate(sample, rules or standard_rules())]
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered))
    return measured.withColumn("kept", verdict)
