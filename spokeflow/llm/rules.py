"""Quality rules: base limits, then a decision list learned from labelled statistics by sequential covering.

Every statistic is a whole number in a fixed range (shares in thousandths, word length in tenths of a character), so a condition
is a plain threshold that can be read and argued with. Rules reject; what no rule takes is kept. One rule after the other is
grown on two thirds of the labelled rows that no rule covers yet: the condition with the most information gain is added until
no kept row is left or nothing is gained. It is then pruned on the other third: the end of the conjunction goes where the rest
does better there. Learning ends with the first rule that is not precise enough on that third, so clean documents stay.

Spark counts the labelled rows by statistic and value, combined before the shuffle; what is collected for each condition is at
most one row per statistic and value, however many rows there are. The list is one ordered conditional expression, and all of
it is built-in functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.llm.quality import held_out
from spokeflow.session import checkpointed

BLANKS = " \t\n\x0b\x0c\r"
# Characters that are counted.
SIGNS = {"n_symbols": "[#*$%&|<>]", "n_upper": "[A-Z]", "n_digits": "[0-9]", "n_calls": "[!?]"}
RUN = 3
# The base limits.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_digits", "n_calls", "n_echoes")
# What conditions are about: (name, count, out of which count, how many of it make one).
STATISTICS = (
    ("symbols", "n_symbols", "word_chars", 1000),
    ("upper", "n_upper", "word_chars", 1000),
    ("digits", "n_digits", "word_chars", 1000),
    ("calls", "n_calls", "word_chars", 1000),
    ("repeat_words", "n_repeat_words", "n_words", 1000),
    ("echoes", "n_echoes", "n_words", 1000),
    ("dup_lines", "n_dup_lines", "n_lines", 1000),
    ("word_length", "word_chars", "n_words", 10),
)
MOST = 1000
# Bounds of the list, and the share of rejected ones among the rows a rule takes, on those that it was not grown on.
RULES, CONDITIONS, PRECISION = 16, 4, 0.9


def with_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of a text column. NULL is empty. Steps are columns of their own, so that none is computed twice.

    Write the result to a table before filtering by a count: the optimizer would move the filter below the steps and put all of
    them into one expression, which computes each step anew for every word.
    """
    made = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    count = lambda signs: F.length("_text") - F.length(F.regexp_replace("_text", signs, ""))
    made = made.withColumns(
        {
            "_words": F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: F.rtrim(line, F.lit(BLANKS)) != ""),
            **{name: count(signs) for name, signs in SIGNS.items()},
        }
    )
    run = lambda i: F.concat_ws(" ", *[F.get("_words", i + j) for j in range(RUN)])
    runs = F.transform(F.sequence(F.lit(0), F.size("_words") - RUN), lambda i: F.struct(run(i).alias("run"), i.alias("at")))
    made = made.withColumns(
        {
            "n_words": F.size("_words"),
            "word_chars": F.length(F.array_join("_words", "")),
            "n_echoes": F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))),
            "n_lines": F.size("_lines"),
            "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
            "_runs": F.when(F.size("_words") >= RUN, F.sort_array(runs)),
        }
    ).drop("_words", "_lines", "_text")
    # Equal runs stand side by side; those that have an equal neighbour, by place.
    near = lambda i: F.get("_runs", i)["run"]
    found = F.filter("_runs", lambda r, i: (r["run"] == near(i - 1)) | (r["run"] == near(i + 1)))
    made = made.withColumn("_at", F.sort_array(F.transform(found, lambda r: r["at"]))).drop("_runs")
    # A run takes the words that the run before it has not taken.
    own = F.transform("_at", lambda at, i: F.least(F.lit(RUN), at - F.coalesce(F.get("_at", i - 1), F.lit(-RUN))))
    covered = F.aggregate(own, F.lit(0), lambda total, n: total + n)
    made = made.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("_at")
    return made.withColumns({n: F.col(n).cast("bigint") for n in (*COUNTS, *MORE_COUNTS)})


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def statistic(name: str) -> Column:
    """A statistic from the counts, 0 to 1000."""
    _, part, whole, scale = next(s for s in STATISTICS if s[0] == name)
    share = F.when(F.col(whole) > 0, F.floor(scale * F.col(part) / F.col(whole))).otherwise(0)
    return F.least(F.lit(MOST), share).cast("int")


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: int

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold}"

    def expression(self) -> Column:
        value = statistic(self.statistic)
        return value >= self.threshold if self.at_least else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with the rejected and kept rows that it took of those it was pruned on."""

    conditions: tuple[Condition, ...]
    right: int = 0
    wrong: int = 0

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} ({self.right} right, {self.wrong} wrong)"

    def expression(self) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.expression()
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def number(self) -> Column:
        """The first rule that takes a row, from 1; NULL if none does."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.expression(), F.lit(i)).otherwise(out)
        return out

    def kept(self) -> Column:
        return self.number().isNull()


def _tallies(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(statistic, value) → rejected and kept rows."""
    values = F.posexplode(F.array(*[statistic(s[0]) for s in STATISTICS]))
    counted = rows.select("_bad", values).groupBy("pos", "col").agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good"))
    return {(r.pos, r.col): (r.bad, r.good) for r in counted.collect()}


def _information(bad: int, good: int) -> float:
    return math.log2(bad / (bad + good)) if bad else 0.0


def best_condition(tallies: dict[tuple[int, int], tuple[int, int]]) -> tuple[Condition, int, int] | None:
    """The condition with the most gain over all rows counted, and the rows that it leaves; None if none gains. Thresholds are
    in the middle between two values; ties go to more rejected rows, then to the statistic that comes first."""
    found = None
    for number, (name, *_) in enumerate(STATISTICS):
        values = sorted(v for s, v in tallies if s == number)
        bad, good = (sum(tallies[number, v][i] for v in values) for i in (0, 1))
        whole = _information(bad, good)
        for at_least, ordered in ((True, values[::-1]), (False, values)):
            p = n = 0
            for value, following in zip(ordered, ordered[1:]):
                p, n = p + tallies[number, value][0], n + tallies[number, value][1]
                gain = p * (_information(p, n) - whole) if p else 0.0
                if gain > 1e-9 and (found is None or (round(gain, 9), p) > found[0]):
                    threshold = (value + following + 1) // 2 if at_least else (value + following) // 2
                    found = (round(gain, 9), p), (Condition(name, at_least, threshold), p, n)
    return found and found[1]


def grown(rows: DataFrame, most: int = CONDITIONS) -> tuple[Condition, ...]:
    """Conditions added one by one, until they take no kept row."""
    conditions: tuple[Condition, ...] = ()
    while len(conditions) < most:
        found = best_condition(_tallies(rows.where(Rule(conditions).expression())))
        if found is None:
            break
        conditions += (found[0],)
        if not found[2]:
            break
    return conditions


def pruned(rows: DataFrame, conditions: tuple[Condition, ...]) -> Rule:
    """The beginning of the conjunction that does best on ``rows``: most right less wrong of those it takes; the shorter of equals."""
    takes = [Rule(conditions[:n]).expression() for n in range(1, len(conditions) + 1)]
    sums = rows.agg(*[F.count_if(t & (F.col("_bad") == bad)) for t in takes for bad in (True, False)]).first()
    found = [(sums[2 * i], sums[2 * i + 1]) for i in range(len(takes))]
    worth = lambda i: (found[i][0] - found[i][1]) / (sum(found[i]) or 1)
    best = max(range(len(found)), key=lambda i: (worth(i), -i))
    return Rule(conditions[: best + 1], *found[best])


def covering(rows: DataFrame, most: int = RULES, precision: float = PRECISION, conditions: int = CONDITIONS) -> DecisionList:
    """A decision list from rows with the counts, ``_bad`` (whether to reject) and ``_grow`` (which part a row is in).

    Empty if there is nothing to reject or to keep, or if no rule is precise enough.
    """
    found = DecisionList()
    while len(found.rules) < most:
        left = rows.where(found.kept())
        made = grown(left.where("_grow"), conditions)
        if not made:
            break
        rule = pruned(left.where("not _grow"), made)
        if not rule.right or rule.right < precision * (rule.right + rule.wrong):
            break
        found.rules.append(rule)
    return found


def learned(counted: DataFrame, labels: DataFrame, label: str = "quality") -> DecisionList:
    """A decision list that rejects label 0, from rows with counts (``doc_id``, …).

    All labelled rows count, whether or not they pass the base limits, but the held-out ones, whose labels are never looked at.
    Labels other than 0 and 1 do not count; a document that is labelled several times counts as often.
    """
    wanted = labels.where(~held_out("doc_id") & F.col(label).isin(0, 1)).select("doc_id", (F.col(label) == 0).alias("_bad"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    rows = counted.join(wanted, "doc_id").select("_bad", part.alias("_grow"), *COUNTS, *MORE_COUNTS)
    return covering(checkpointed(rows))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the number of the ``rule`` that rejects, for every row of
    ``documents`` (``doc_id``, ``text``).

    Each row is judged by its own text, repeated ones too. NULL and empty texts have no words and fail the base limits.
    """
    counted = checkpointed(with_counts(documents.select("doc_id", "text")).drop("text"))
    found = learned(counted, labels)
    rule = F.when(~base_failed(), found.number())
    return counted.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & found.kept()).alias("kept"), rule.alias("rule")
    )


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that neither the base limits nor the list reject; all columns. Rows that repeat a ``doc_id``
    are judged each by its own text."""
    columns = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(documents.columns)]
    carried = documents.select("doc_id", "text", *columns)
    # A column that differs from run to run keeps the filter above the steps.
    counted = with_counts(carried).drop("text").withColumn("_above", F.monotonically_increasing_id())
    found = learned(with_counts(documents.select("doc_id", "text")).drop("text"), labels)
    kept = counted.where((F.col("_above") >= 0) & ~base_failed() & found.kept())
    return kept.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(documents.columns)])
