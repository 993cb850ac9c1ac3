"""URL filter: rules by host and path first; a ratio of two character language models where no rule fits.

Two smoothed Markov models, one of the URLs that the rules accept and one of those that they reject, give each URL the
difference of its log-likelihoods per character. They read the characters as they are (only A-Z in lower case). The order
varies: a context of up to ``ORDER - 1`` characters that a model has not seen leaves the next shorter one (Witten-Bell). What
the models gather is a table of strings that grows with the input, so it is joined by a shuffle; strings that make up a
``HOT``-th or more of all places, which can only be ``HOT`` of them, are broadcast instead and so never meet in one task.

Two thirds of the URLs that the rules decide, by a hash of the URL, are learnt from. The threshold is calibrated on the last
third, which no model has seen: the one that parts accepted and rejected ones best, where either class has the same weight.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.session import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What stands before a URL in place of characters.
BEGIN = "\u0002"
ORDER = 5
# One of so many URLs that the rules decide is for the calibration; a share of all places from which a string is hot.
PARTS, HOT = 3, 1_000
CLASSES = ("allow", "block")
# Width and range of the bins in which scores are counted for the calibration.
BIN, EDGE = 0.005, 10.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: str | Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as ``rule`` (host and path) and ``verdict``; NULL if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of rules of the same length the first in
    the alphabet is taken.
    """
    found = [
        F.when(
            ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host)))
            & F.startswith(F.col(path), F.lit(r.path)),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def folded(url: str | Column) -> Column:
    """The URL after its scheme, A-Z in lower case."""
    return F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), UPPER, LOWER)


def masked(url: str | Column, rule: Column) -> Column:
    """A folded URL without the strings by which a rule was found: the end of the host and the start of the path."""
    url = F.col(url) if isinstance(url, str) else url
    host, path = F.substring_index(rule, "/", 1), F.substring(rule, F.length(F.substring_index(rule, "/", 1)) + 1, 2_147_483_647)
    at = F.instr(url, F.concat(host, path))
    rest = F.substring(url, at + F.length(host) + F.length(path), 2_147_483_647)
    return F.when(rule.isNotNull() & (at > 0), F.concat(F.substring(url, F.lit(1), at - 1), rest)).otherwise(url)


def _strings(text: str) -> Column:
    """The string of ``ORDER`` characters that ends at each character of a folded URL."""
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), F.col(text))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER}}}))."), F.lit(1))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``gram`` and ``ratio``, ln P(last character | those before) of the accepted less that of the rejected model.

    ``counts`` has each string's number in either class (``allow``, ``block``); it may be 0 in both. A context has at most one
    row per character that occurs, so the windows by context are small.
    """
    level = _shorter(counts, 1)
    ones = level.agg(
        F.count("*").alias("signs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in CLASSES],
        *[F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in CLASSES],
    ).first()
    flat = 1.0 / max(1, ones["signs"])
    for c in CLASSES:
        total, kinds = ones[f"n_{c}"], ones[f"kinds_{c}"]
        p = (F.col(c) + F.lit(kinds * flat)) / F.lit(total + kinds) if total else F.lit(flat)
        level = level.withColumn(f"p_{c}", p)
    for length in range(2, ORDER + 1):
        shorter = level.select(F.col("gram").alias("_end"), *[F.col(f"p_{c}").alias(f"_p_{c}") for c in CLASSES])
        level = _shorter(counts, length).withColumn("_end", F.substring("gram", 2, length - 1))
        by_context = W.partitionBy(F.substring("gram", 1, length - 1))
        for c in CLASSES:
            level = level.withColumn(f"_n_{c}", F.sum(c).over(by_context))
            level = level.withColumn(f"_kinds_{c}", F.sum((F.col(c) > 0).cast("int")).over(by_context))
        level = level.join(shorter, "_end")
        for c in CLASSES:
            backed = (F.col(c) + F.col(f"_kinds_{c}") * F.col(f"_p_{c}")) / (F.col(f"_n_{c}") + F.col(f"_kinds_{c}"))
            level = level.withColumn(f"p_{c}", F.when(F.col(f"_n_{c}") > 0, backed).otherwise(F.col(f"_p_{c}")))
        level = level.select("gram", *CLASSES, *[f"p_{c}" for c in CLASSES])
    return level.select("gram", (F.ln(f"p_{CLASSES[0]}") - F.ln(f"p_{CLASSES[1]}")).alias("ratio"))


def _shorter(counts: DataFrame, length: int) -> DataFrame:
    """Counts of the strings of the last ``length`` characters."""
    end = F.substring("gram", ORDER - length + 1, length)
    return counts.groupBy(end.alias("gram")).agg(*[F.sum(c).alias(c) for c in CLASSES])


def scores(urls: DataFrame) -> DataFrame:
    """Add ``score`` to distinct folded URLs (``folded``, ``allow``, ``block``: pages of either class; ``learnt``: whether the
    models may read it); an empty one gets 0. A URL moves once per column, only its number moves with its strings."""
    urls = checkpointed(urls.withColumn("_url", F.monotonically_increasing_id()))
    grams = urls.select("_url", "learnt", *CLASSES, F.explode(_strings("folded")).alias("gram"))
    counts = checkpointed(
        grams.groupBy("gram").agg(
            F.count("*").alias("places"), *[F.sum(F.when(F.col("learnt"), F.col(c)).otherwise(0)).alias(c) for c in CLASSES]
        )
    )
    places = counts.agg(F.sum("places")).first()[0] or 0
    ratios = checkpointed(log_ratios(counts).join(counts.select("gram", "places"), "gram"))
    hot = F.col("places") * HOT >= F.lit(places)
    common, rare = F.broadcast(ratios.where(hot).drop("places")), ratios.where(~hot).drop("places")
    met = grams.select("_url", "gram")
    found = met.join(common, "gram").unionByName(met.join(common, "gram", "left_anti").join(rare, "gram"))
    summed = found.groupBy("_url").agg((F.sum("ratio") / F.count("*")).alias("score"))
    return urls.join(summed, "_url", "left").select("folded", "learnt", *CLASSES, F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """The score from which URLs are accepted; None if the rules decide none of one class.

    Scores are counted in a bounded number of bins. Of the borders between two bins of such URLs the best is taken, the lowest
    of equals, and of the scores between the two the middle.
    """
    at = F.floor(F.least(F.lit(EDGE), F.greatest(F.lit(-EDGE), "score")) / BIN).alias("bin")
    bins = scored.groupBy(at).agg(*[F.sum(c).alias(c) for c in CLASSES]).where(" + ".join(CLASSES) + " > 0")
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    allow, block = CLASSES
    gain = F.coalesce(F.sum(block).over(below), F.lit(0)) / F.sum(block).over(everything) - F.coalesce(
        F.sum(allow).over(below), F.lit(0)
    ) / F.sum(allow).over(everything)
    both = bins.withColumn("total", F.least(F.sum(allow).over(everything), F.sum(block).over(everything))).where("total > 0")
    border = (F.coalesce(F.lag("bin").over(W.orderBy("bin")) + 1, F.col("bin")) + F.col("bin")) / 2 * BIN
    best = both.withColumn("gain", gain).withColumn("border", border).orderBy(F.desc("gain"), "bin").first()
    return None if best is None else float(best["border"])


def _part(text: str) -> Column:
    """Whether a URL belongs to those that the models learn from."""
    return F.pmod(F.xxhash64(text), F.lit(PARTS)) != 0


def _decided(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    found = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), folded(F.col("url")).alias("folded"))
    return found.withColumn("_ruled", ruled(rules)).select(
        "page_id", "host", "path", "folded", "_ruled.rule", F.col("_ruled.verdict").alias("_verdict")
    )


def _scored(found: DataFrame) -> DataFrame:
    urls = found.groupBy("folded").agg(
        *[F.count_if(F.coalesce(F.col("_verdict") == c, F.lit(False))).alias(c) for c in CLASSES]
    )
    return checkpointed(scores(urls.withColumn("learnt", _part("folded"))))


def _limit(scored: DataFrame) -> float | None:
    """The calibrated threshold; 0 if the part for the calibration lacks a class, NULL if all URLs do."""
    limit = threshold(scored.where("not learnt"))
    if limit is None:
        both = scored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES]).first()
        return 0.0 if both[0] and both[1] else None
    return limit


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``score`` to rows of ``page_id`` and ``url``.

    A NULL or empty URL scores 0 and has an empty host and path. Without any page of one class, pages without a rule are
    allowed; where only the part for the calibration lacks a class, the threshold is 0. Repeated rows each get their verdict.
    """
    found = _decided(pages, rules)
    scored = _scored(found)
    limit = _limit(scored)
    accepted = F.lit(True) if limit is None else F.col("score") >= limit
    verdict = F.coalesce("_verdict", F.when(accepted, CLASSES[0]).otherwise(CLASSES[1]))
    return found.join(scored.select("folded", "score"), "folded").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "score"
    )


def held_out_errors(pages: DataFrame, rules: Sequence[Rule], mask: bool = True) -> DataFrame:
    """How often the models err on the pages that the rules decide and that were not learnt from: ``verdict`` (the rule's),
    ``pages``, ``wrong``. ``mask`` takes the strings that the rule looks at out of every URL first, so that the models cannot
    read the rule itself. No row if nothing is decided; with one class nothing is rejected."""
    found = _decided(pages, rules)
    if mask:
        found = found.withColumn("folded", masked("folded", F.col("rule")))
    scored = _scored(found)
    limit = _limit(scored)
    accepted = F.lit(True) if limit is None else F.col("score") >= limit
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("verdict"), F.col(c).alias("n")) for c in CLASSES])).alias("k")
    rows = scored.where("not learnt").select(accepted.alias("accepted"), kinds).where("k.n > 0")
    wrong = F.when(F.col("accepted") != (F.col("k.verdict") == CLASSES[0]), F.col("k.n")).otherwise(0)
    return rows.groupBy("k.verdict").agg(F.sum("k.n").alias("pages"), F.sum(wrong).alias("wrong"))
