"""Document fingerprints: threshold-scaled sketches of five-word shingles, in built-in functions only.

A sketch keeps every shingle hash below a fixed fraction of the range of hashes. So its size follows the text, two sketches
keep the same of what their texts share, and sketches of parts merge to the sketch of the whole. The share of the smaller
sketch that is in the larger one estimates how far one text contains the other, however unequal they are. A text with
shingles, none of which is below the threshold, keeps its least one, so only texts without words have an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.session import checkpointed

K = 5
FRACTION = 1 / 4
LARGEST = (1 << 63) - 1
DIGITS = 16


def _words(text: Column) -> Column:
    """Words between ASCII white space in lower case; a text without any has none."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashes(words: Column) -> Column:
    """A non-negative hash of every run of five words, or of all words if there are fewer."""
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])
    all_runs = F.transform(F.sequence(F.lit(0), F.size(words) - K), run)
    hashes = F.when(F.size(words) >= K, all_runs).when(F.size(words) > 0, F.array(F.xxhash64(words)))
    return F.transform(F.coalesce(hashes, F.array().cast("array<bigint>")), lambda h: h.bitwiseAND(LARGEST))


def _kept(hashes: Column, fraction: float) -> Column:
    limit = F.lit(int(LARGEST * fraction))
    below = F.filter(hashes, lambda h: h < limit)
    return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(
        F.slice(F.array_sort(hashes), 1, 1)
    )


def with_sketch(rows: DataFrame, text: str, sketch: str, fraction: float = FRACTION) -> DataFrame:
    """Add the sketch of a text column: sorted distinct hashes. NULL is empty.

    Done in steps, each a column of its own, so that no step is computed twice.
    """
    made = rows.withColumn("_words", _words(F.coalesce(F.col(text), F.lit(""))))
    made = made.withColumn("_hashes", _hashes(F.col("_words"))).drop("_words")
    return made.withColumn(sketch, _kept(F.col("_hashes"), fraction)).drop("_hashes")


def merged(sketch: str | Column, other: str | Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    return _kept(F.array_union(sketch, other), fraction)


def likeness(sketch: str | Column, other: str | Column) -> Column:
    """The share of the smaller sketch that is in the other, 1 for equal ones, 0 if only one is empty."""
    sketch, other = (F.col(s) if isinstance(s, str) else s for s in (sketch, other))
    smaller = F.least(F.size(sketch), F.size(other))
    shared = F.size(F.array_intersect(sketch, other)) / F.nullif(smaller, F.lit(0))
    return F.when(sketch == other, 1.0).otherwise(F.coalesce(shared, F.lit(0.0)))


def as_string(sketch: str | Column) -> Column:
    """The hashes as hexadecimal numbers of 16 digits, one after the other."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def from_string(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    places = F.sequence(F.lit(0), (F.length(text) / DIGITS).cast("int") - 1)
    number = lambda i: F.conv(F.substring(text, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("bigint")
    return F.when(F.length(text) > 0, F.transform(places, number)).otherwise(F.array().cast("array<bigint>"))


KEY = ["_none", "_id", "_hash"]


def before_each(keys: DataFrame) -> DataFrame:
    """Each key's neighbour before it in descending order, around the end: ``before`` (the key, with ``n_chars``).

    ``keys`` are distinct rows of ``_none``, ``_id``, ``_hash`` and ``n_chars``; NULL ids (``_none``) come last. Keys are
    dealt out by ranges and numbered within each; only the last key of each range passes through one window.
    """
    order = [F.asc("_none"), F.desc("_id"), F.asc("_hash")]
    ranged = keys.repartitionByRange(F.asc("_none"), F.desc("_id")).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)  # the ranges are drawn from a sample: from here on they are the same for all uses
    own = F.struct(*KEY, "n_chars")
    inside = W.partitionBy("_range").orderBy(*order)
    # Order within a range: NULL ids last, ids descending, hashes ascending; so the last is the largest of these.
    last = ranged.groupBy("_range").agg(
        F.max_by(own, F.struct(F.col("_none"), -F.col("_id").cast("decimal(38,0)"), F.col("_hash"))).alias("_last")
    )
    in_turn = W.orderBy("_range")
    around = F.last("_last").over(in_turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = last.select("_range", F.coalesce(F.lag("_last").over(in_turn), around).alias("_other"))
    return (
        ranged.withColumn("_inside", F.lag(own).over(inside))
        .join(heads, "_range")
        .select(*KEY, F.coalesce("_inside", "_other").alias("before"))
    )


def fingerprints(documents: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """The sketches of every text of ``documents`` (``doc_id``, ``text``), of its edited text and of the next document's.

    The next document is the one with the next smaller ``doc_id`` (after the last: the first). The edited text has its last
    third (rounded down) replaced by the first as many characters of the next document, or all of it. Rows are ordered by
    ``doc_id``, NULL last, equal ones by a hash of their texts; rows that repeat ``doc_id`` and text share their place in the
    order, and each comes back. NULL texts are empty.

    Columns: ``doc_id``, ``text``, ``edited``, ``sketch``, ``edited_sketch``, ``next_sketch``. Each text is moved once, and
    once more as far as its neighbour needs it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(
        F.col("doc_id").isNull().alias("_none"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        text.alias("text"),
    )
    links = before_each(keyed.select(*KEY, F.length("text").alias("n_chars")).distinct())
    links = checkpointed(links)
    # One exchange of the texts for both sides: nothing is computed before it, so it is the same and is used twice.
    texts = keyed.repartition(*KEY)
    sent = (
        with_sketch(texts.dropDuplicates(KEY).join(links, KEY), "text", "next_sketch", fraction)
        .withColumn("_head", F.substring(F.col("text"), F.lit(1), F.floor(F.col("before.n_chars") / 3).cast("int")))
        .select(*[F.col(f"before.{c}").alias(c) for c in KEY], "_head", "next_sketch")
    )
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - F.floor(F.length("text") / 3).cast("int"))
    both = texts.join(sent, KEY).withColumn("edited", F.concat(kept, "_head")).drop("_head")
    made = with_sketch(with_sketch(both, "text", "sketch", fraction), "edited", "edited_sketch", fraction)
    return made.select(
        F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "text", "edited", "sketch", "edited_sketch", "next_sketch"
    )
