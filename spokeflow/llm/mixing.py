"""Mixing sources to target weights: equal-token blocks are dealt to sources by Sainte-Laguë's highest quotients.

1. Every source's target is its weight's share of all words, at most ``cap`` times its own; the excess goes to the others.
2. A source's words are cut into blocks of equal length (about ``block`` words). The seats of the mix, one per block, go to
   the sources by the highest quotients target / (2k + 1), which gives whole quotas near the targets.
3. Big sources are cut into shards by a hash of the document. The same rule deals a source's quota to its shards.
4. In each shard, documents stand in an order drawn by a seeded hash. The quota is taken as whole passes and one run of blocks
   from a seeded start, around the end. A document's share of it follows from its place alone; no row per block is made.

Only the tables of sources and of shards pass through one window each; documents are split by source and shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.functions.sizing import broadcast_if_small
from spokeflow.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
BLOCK = 8
SHARD_WORDS = 1_000_000
SHARD_ROWS = 20_000
SEED = 20_240_229


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space; NULL and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``source``, ``words``).

    Sources take the weights in turn, by code point, NULL last. A target is min(cap * words, level * weight), where the
    level makes all targets together as large as all sources. The sources are sorted by the level at which each is full;
    the level is that of the first source which its own remainder does not fill.
    """
    everything = W.partitionBy()
    in_turn = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        sources.withColumn("weight", F.get(cycle, ((F.row_number().over(in_turn) - 1) % len(weights)).cast("int")))
        .withColumn("_most", F.col("words") * F.lit(float(cap)))
        .withColumn("_full", F.col("_most") / F.col("weight"))
    )
    filled = W.orderBy("_full", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    after = filled.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("words").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    unfilled = F.col("_full") >= F.col("_level") * (1 - 1e-12)
    first = F.min(F.when(unfilled, F.struct(F.col("_full"), (-F.col("_level")).alias("minus")))).over(everything)
    return (
        weighed.withColumn("_level", left / F.sum("weight").over(after))
        .withColumn("_level", -first["minus"])
        .withColumn("target", F.least("_most", F.coalesce(F.col("_level") * F.col("weight"), F.col("_most"))))
        .drop("_most", "_full", "_level")
    )


def apportion(parties: DataFrame, within: Sequence[str], ident: Sequence[str], quota: str) -> DataFrame:
    """Deal ``_seats`` seats to the parties of each group by the highest quotients ``_claim`` / (2k + 1), at most ``_cap``
    each; ties go to the smaller ``ident``. Adds ``quota``.

    With d the last winning quotient, a party has _claim/d seats up to rounding, and rounding moves all seats together by at
    most half the number of parties. So seats below that range are won for certain, and only quotients inside it are ranked:
    a few rows for each party, however many seats there are.
    """
    group = W.partitionBy(*within)
    n, seats = F.count("*").over(group), F.col("_seats").cast("double")
    claims = F.sum("_claim").over(group)
    ranged = (
        parties.withColumn("_x", F.when(claims > 0, F.col("_claim") / claims).otherwise(0.0))
        .withColumn("_n", n)
        .withColumn("_sure", F.floor(F.col("_x") * F.greatest(F.lit(0.0), seats - F.col("_n")) - 1).cast("bigint"))
        .withColumn("_sure", F.least(F.greatest(F.lit(0), "_sure"), "_cap"))
        .withColumn("_last", F.least(F.ceil(F.col("_x") * (seats + 2 * F.col("_n")) + 2).cast("bigint"), F.col("_cap")))
        .withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    )
    ranks = F.when(F.col("_last") > F.col("_sure"), F.sequence("_sure", F.col("_last") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    order = [F.desc("_quotient"), *[F.col(c).asc_nulls_last() for c in ident]]
    won = (
        ranged.withColumn("_k", F.explode_outer(ranks))
        .withColumn("_quotient", F.when(F.col("_k").isNotNull(), F.col("_claim") / (2 * F.col("_k") + 1)))
        .withColumn("_rank", F.row_number().over(group.orderBy(*order)))
        .withColumn("_won", (F.col("_quotient") > 0) & (F.col("_rank") <= F.col("_open")))
    )
    keep = [c for c in parties.columns if c not in ident]
    return (
        won.groupBy(*ident)
        .agg(*[F.first(c).alias(c) for c in keep], (F.first("_sure") + F.count_if("_won")).alias(quota))
        .drop("_claim", "_seats", "_cap")
    )


def _blocks(words: str | Column, length: Column) -> Column:
    words = F.col(words) if isinstance(words, str) else words
    return F.when(words > 0, F.greatest(F.lit(1), F.round(words / F.nullif(length, F.lit(0))))).otherwise(0).cast("bigint")


def mix(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    block: int = BLOCK,
    seed: int = SEED,
    shard_words: int = SHARD_WORDS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to rows of ``doc_id``, ``source`` and ``size``.

    Each row is a document of its own, repeated ones too. A document without words takes nothing. No document is taken more
    than ``cap`` times. Reruns agree: everything follows from hashes of ``doc_id`` and the seed.
    """
    whole = F.lit(float(block))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("_docs"))
    sources = (
        targets(sources, weights, cap)
        .withColumn("_blocks", _blocks("words", whole))
        .withColumn("_claim", F.when(F.col("_blocks") > 0, F.col("target") * F.col("_blocks") / F.col("words")).otherwise(0.0))
        .withColumn("_seats", F.round(F.sum("_claim").over(W.partitionBy())).cast("bigint"))
        .withColumn("_cap", F.col("_blocks") * cap)
    )
    # Few rows, counted: the documents, which may carry their texts, need not move for this join then.
    sources = broadcast_if_small(
        apportion(sources, [], ["source"], "quota").select(
            F.col("source").alias("_source"),
            F.col("words").alias("source_size"),
            "target",
            F.col("_blocks").alias("_source_blocks"),
            F.col("quota").alias("_source_quota"),
            F.greatest(F.ceil(F.col("words") / shard_words), F.ceil(F.col("_docs") / shard_rows), F.lit(1)).alias("_shards"),
        )
    )
    rows = (
        sizes.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_draw", F.xxhash64(F.lit(seed), F.col("doc_id")))
        .withColumn("_shard", F.pmod("_draw", F.col("_shards")))
    )
    per_source = ["source_size", "_source_blocks", "_source_quota"]
    shards = (
        rows.groupBy("_source", "_shard")
        .agg(F.sum("size").alias("_words"), *[F.first(c).alias(c) for c in per_source])
        .withColumn("_blocks", _blocks("_words", F.col("source_size") / F.greatest(F.lit(1), "_source_blocks")))
        .withColumn("_claim", F.col("_words").cast("double"))
        .withColumn("_seats", F.col("_source_quota"))
        .withColumn("_cap", F.col("_blocks") * cap)
    )
    shards = apportion(shards, ["_source"], ["_source", "_shard"], "_quota").select(
        F.col("_source").alias("_of"), F.col("_shard").alias("_at"), "_words", "_blocks", "_quota"
    )
    run = W.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_draw")), "doc_id", "size")
    n, size = F.greatest(F.lit(1), "_blocks"), F.col("size")
    first = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_source"), F.col("_shard")), n)
    placed = (
        rows.join(shards, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_at")))
        .withColumn("_end", F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_end") - size)
        .withColumn("_first", first)
        .withColumn("_to", F.col("_first") + F.col("_quota") % n)
    )

    def edge(block_no: Column) -> Column:
        return F.floor(block_no.cast("decimal(38,0)") * F.col("_words") / n).cast("bigint")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_end"), hi) - F.greatest(F.col("_from"), lo))

    # The run of blocks may go around the end of the shard.
    run_taken = overlap(edge(F.col("_first")), edge(F.least("_to", n))) + overlap(
        F.lit(0), edge(F.greatest(F.lit(0), F.col("_to") - n))
    )
    taken = F.when(F.col("_blocks") > 0, F.floor(F.col("_quota") / n) * size + run_taken).otherwise(0)
    return placed.select(*sizes.columns, "source_size", "target", taken.cast("bigint").alias("taken"))


def mixture(documents: DataFrame) -> DataFrame:
    """The mix of all ``documents`` (``doc_id``, ``source``, ``text``): size, source's size and target, words taken."""
    # Counted once: the sizes serve the totals and the documents.
    return mix(checkpointed(documents.select("doc_id", "source", word_count().alias("size"))))


def mixed(documents: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, to the nearest whole copy; columns as given.

    Rows are told apart by ``doc_id`` and their own content only where they must be: a repeated row is mixed on its own.
    """
    columns = documents.columns
    sized = documents.select(
        "doc_id", "source", word_count().alias("size"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    )
    taken = mix(sized.withColumn("_row", F.col("_row")))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), copies))).select("_row.*")
