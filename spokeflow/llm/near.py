"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. Each text becomes the set of its five-word shingles (64-bit hashes). Texts with equal sets form a class, and only one
   text of a class, its representative, goes on.
2. One hash of each shingle gives both its bin (the top bits) and its rank. A signature is the least shingle of each of
   ``BINS`` bins. An empty bin takes the value of a bin drawn by a hash of its number and the attempt, until a filled one is
   met: two signatures then agree in a bin as often as the sets are alike.
3. Four bins make a band; equal bands share a bucket. Sets with a similarity of 0.75 miss all 32 buckets with a probability of
   6 in a million, more similar ones more seldom.
4. Every bucket is a star: its members are compared with one member only, the hub, so a bucket of n has n - 1 pairs. Pairs
   are confirmed on the full sets.
5. A member may be similar to another one and not to the hub. So texts that are in two or more buckets whose members are not
   all connected yet get new stars: with other hubs, drawn by seeded hashes, and within finer buckets of two and three bands
   together, where nearly all members are similar. These rounds join large groups cheaply and decide nothing; they end with
   the first that links few.
6. Whatever members of buckets are then still parted, in one bucket or more, meet exactly, by a prefix filter. Only shingles
   of two components or more count. Two similar sets have their rarest common one among the few rarest of each, so sets with
   such a shingle in common are paired if sizes and places allow the similarity, and confirmed on the full sets. A pair that
   shares a bucket is therefore never left out; what MinHash misses is a pair without a common bucket.

A hot bucket is never gathered: hubs are least values, combined before the shuffle, and members meet them in a plain join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeflow.functions.sizing import broadcast_if_small
from spokeflow.llm import words
from spokeflow.llm.components import components, sized
from spokeflow.session import checkpointed

K = 5
PERCENT = 75
BIN_BITS = 7
BINS = 1 << BIN_BITS
ROWS = 4
BANDS = BINS // ROWS
ATTEMPTS = 1024
# Bands that are put together in a round of finer stars: each band with the ones so many places on.
FINER = ((1,), (3,), (2, 9))
# Rounds of finer stars end with one that links less than one in so many of the vertices in it.
FEW = 100
# Pairs with their sets in a task.
PAIRS_PER_TASK = 4_000


def drawn_bins() -> np.ndarray:
    """For each bin and attempt, the bin it takes its value from if it is empty."""
    cell = np.arange(BINS * ATTEMPTS, dtype=np.uint64) + np.uint64(0x5EED)
    return (words.mix(cell * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int64).reshape(BINS, -1)


def signatures(sets: list[np.ndarray], drawn: np.ndarray) -> np.ndarray:
    """Densified least values per bin of non-empty sets, each sorted."""
    shift = np.uint64(64 - BIN_BITS)
    numbers = np.arange(BINS, dtype=np.uint64)
    values = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, members in enumerate(sets):
        at = np.searchsorted(members, numbers << shift)
        found = members[np.minimum(at, len(members) - 1)]
        filled[i] = (at < len(members)) & (found >> shift == numbers)
        values[i] = found
    out = values.copy()
    rows, bins = np.nonzero(~filled)
    for attempt in range(ATTEMPTS):
        if not len(rows):
            return out
        source = drawn[bins, attempt]
        hit = filled[rows, source]
        out[rows[hit], bins[hit]] = values[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
    for row, bin_ in zip(rows, bins, strict=True):  # as good as never: the next filled bin, around the end
        known = np.flatnonzero(filled[row])
        out[row, bin_] = values[row, known[np.searchsorted(known, bin_) % len(known)]]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band, different from the keys of all other bands."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    key = np.broadcast_to(key, (len(signature), BANDS)).copy()
    for j in range(ROWS):
        key = words.mix(key ^ signature[:, j::ROWS]) + np.uint64(j + 1)
    return words.mix(key)


def featured(rows: DataFrame, with_bands: bool, with_shingles: bool, text: str = "text") -> DataFrame:
    """``rows`` without their text, with its shingle set: size ``n``, 128 bits ``high`` and ``low`` that tell it from other sets,
    ``bands`` of keys, and the set itself (``shingles``).

    Texts are worked on and handed on about a megabyte at a time, so neither the sets nor the signatures of a batch are ever
    in memory together.
    """
    others = [c for c in rows.columns if c != text]
    schema = T.StructType([rows.schema[c] for c in others])
    for name in ("n", "high", "low"):
        schema = schema.add(name, T.LongType())
    for name in ("bands", "shingles"):
        schema = schema.add(name, T.ArrayType(T.LongType()))

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, none = drawn_bins(), np.zeros(0, np.uint64)
        for batch in batches:
            for scan in words.scans(batch.column(len(others)), words.BETWEEN_SPACES):
                hashes, at = words.shingles(scan, scan.word_hashes(), K)
                sets = [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]
                bands = [none] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if with_bands and full:
                    for i, keys in zip(full, band_keys(signatures([sets[i] for i in full], drawn)), strict=True):
                        bands[i] = keys
                sums = [s.sum(dtype=np.uint64) for s in sets]
                more = [words.mix(s).sum(dtype=np.uint64) for s in sets]
                columns = [batch.column(i).slice(scan.lo, scan.hi - scan.lo) for i in range(len(others))]
                columns += [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(sums, np.uint64).view(np.int64)),
                    pa.array(np.array(more, np.uint64).view(np.int64)),
                    lists(bands),
                    lists(sets if with_shingles else [none] * len(sets)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(*others, text).mapInArrow(shingled, schema)


def _keys(bands: Column, round_: int) -> Column:
    """Keys of the stars of a later round: each band's own bucket, and finer ones of each band with others ``steps`` on."""

    def family(number: int, steps: tuple[int, ...]) -> Column:
        others = lambda i: [F.get(bands, (i + s) % BANDS) for s in steps]
        return F.transform(bands, lambda key, i: F.xxhash64(F.lit(round_), F.lit(number), key, *others(i)))

    turned = [tuple((s + 11 * (round_ - 1)) % BANDS for s in steps) for steps in FINER]
    return F.flatten(F.array(*[family(number, steps) for number, steps in enumerate([(), *turned])]))


def _parted(members: DataFrame, order: Column) -> DataFrame:
    """Buckets (``key``) with members of more than one component, with the first member by ``order`` as ``hub``."""
    return (
        members.groupBy("key")
        .agg(
            F.min(F.struct(order.alias("order"), F.col("vertex"), F.col("component"))).alias("hub"),
            F.min("component").alias("_least"),
            F.max("component").alias("_most"),
        )
        .where("_least < _most")
        .select("key", F.col("hub.vertex").alias("hub"), F.col("hub.component").alias("hub_component"))
    )


def star_edges(members: DataFrame) -> DataFrame:
    """Members (``key``, ``vertex``, ``component``) with the hub of their bucket, drawn by a hash, if it is of another
    component: edges ``a`` < ``b``."""
    hubs = _parted(members, F.xxhash64("key", "vertex"))
    edges = members.join(hubs, "key").where("component != hub_component")
    return edges.select(F.least("hub", "vertex").alias("a"), F.greatest("hub", "vertex").alias("b")).distinct()


def confirmed(edges: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The edges (``a``, ``b``) whose full sets are similar enough."""
    edges = checkpointed(edges)
    pairs = edges.count()
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    either = F.size("_sa") + F.size("_sb") - both
    with_sets = sized(sized(edges, pairs).join(left, "a"), pairs, PAIRS_PER_TASK).join(right, "b")
    found = sized(with_sets.where(100 * both >= percent * either).select("a", "b"), pairs, PAIRS_PER_TASK)
    return checkpointed(found)


def open_members(placed: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``vertex``, ``component`` and ``n`` of the members (``key``, ``vertex``, ``component``) of parted buckets that have a
    member of another component and of a fitting size in their bucket."""
    # Sizes that fit are in the same or in neighbouring classes; the step is a little wider than the ratio, against rounding.
    step = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    place = F.floor(F.ln("n") / step)
    twice = placed.join(sizes, "vertex").select(
        "vertex", "component", "n", F.explode(F.array(*[F.xxhash64("key", place + i) for i in (0, 1)])).alias("key")
    )
    meeting = twice.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    return twice.join(meeting.where("_least < _most").select("key"), "key").select("vertex", "component", "n").distinct()


def prefixes(active: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rarest shingles (``key``) of each of ``active`` (``vertex``, ``component``, ``n``), as many as it takes that two
    similar sets of different components have the first of their common ones in both. ``rest`` counts the shingles from it on.

    Shingles of one component are in no pair and do not count; a set with too few others has no prefix.
    """
    tokens = active.join(sets, "vertex").select("vertex", "component", "n", F.explode("shingles").alias("key"))
    shared = (
        tokens.groupBy("key")
        .agg(F.count("*").alias("_df"), F.min("component").alias("_least"), F.max("component").alias("_most"))
        .where("_least < _most")
        .select("key", "_df")
    )
    in_order = F.sort_array(F.collect_set(F.struct("_df", "key")))
    needed = F.ceil(F.col("n") * percent / 100).cast("int")
    return (
        tokens.join(shared, "key")
        .groupBy("vertex", "component", "n")
        .agg(in_order.alias("_in_order"))
        .withColumn("_size", F.size("_in_order"))
        .where(F.col("_size") >= needed)
        .select(
            "vertex", "component", "n", "_size", F.posexplode(F.slice("_in_order", F.lit(1), F.col("_size") - needed + 1))
        )
        .select("vertex", "component", "n", F.col("col.key").alias("key"), (F.col("_size") - F.col("pos")).alias("rest"))
    )


def prefix_edges(active: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair ``a`` < ``b`` of ``active`` of different components that can be similar enough.

    Components of a key meet before their members do, so members of one component are never paired, however many they are.
    """
    rows = checkpointed(prefixes(active, sets, percent))
    groups = rows.groupBy("key", "component").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest")
    )

    def fits(least_a: str, least_b: str, most_a: str, most_b: str, rest_a: str, rest_b: str) -> Column:
        sizes = (100 * F.col(most_b) >= percent * F.col(least_a)) & (100 * F.col(most_a) >= percent * F.col(least_b))
        common = (100 + percent) * F.least(rest_a, rest_b)
        return sizes & (common >= percent * (F.col(least_a) + F.col(least_b)))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "key"])

    met = (
        side(groups, "a")
        .join(side(groups, "b"), "key")
        .where("component_a < component_b")
        .where(fits("least_a", "least_b", "most_a", "most_b", "rest_a", "rest_b"))
        .drop("least_a", "most_a", "rest_a")
    )
    # A member meets the other component's bounds before its members.
    ones = met.join(side(rows, "a"), ["key", "component_a"]).where(
        fits("n_a", "least_b", "n_a", "most_b", "rest_a", "rest_b")
    )
    pairs = ones.drop("least_b", "most_b", "rest_b").join(side(rows, "b"), ["key", "component_b"])
    found = pairs.where(fits("n_a", "n_b", "n_a", "n_b", "rest_a", "rest_b"))
    return found.select(
        F.least("vertex_a", "vertex_b").alias("a"), F.greatest("vertex_a", "vertex_b").alias("b")
    ).distinct()


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``documents`` (``doc_id``, ``text``).

    NULL and empty texts have no shingle and are linked with nothing. Rows are compared by their texts; of rows with equal
    sets the smallest ``doc_id`` stands for all, and a row whose ``doc_id`` is NULL has a NULL component only if no row of
    its component has a ``doc_id``.
    """
    rows = checkpointed(featured(documents.select("doc_id", "text"), True, False).drop("shingles"))
    same = ["n", "high", "low"]
    classes = checkpointed(
        rows.where("n > 0 and doc_id is not null")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("vertex"), F.first("bands").alias("bands"))
    )
    # Buckets of one member are most of all buckets; they go first.
    in_bands = classes.select("vertex", F.explode("bands").alias("key"))
    shared = in_bands.groupBy("key").agg(F.min("vertex").alias("hub"), F.max("vertex").alias("_most")).where("hub < _most")
    members = checkpointed(in_bands.join(shared.select("key", "hub"), "key").select("key", "vertex", "hub"))
    members = sized(members, members.count())
    candidates = broadcast_if_small(classes.join(members.select("vertex").distinct(), "vertex", "left_semi").drop("bands"))
    # Sets are kept of candidates only; a doc_id may come with other texts too, which are not the candidate's.
    of_candidate = candidates.select(F.col("vertex").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in same])
    texts = documents.select("doc_id", "text").join(of_candidate, "doc_id")
    again = featured(texts, False, True)
    sets = checkpointed(again.where("n = _n and high = _high and low = _low").select(F.col("doc_id").alias("vertex"), "shingles"))
    first = members.where("vertex != hub").select(F.col("hub").alias("a"), F.col("vertex").alias("b")).distinct()
    links = confirmed(first, sets, percent)
    found = components(links)
    parted = members.select("key", "vertex")
    round_ = 0
    while True:
        # Buckets whose members are all connected need no more comparisons.
        placed = parted.join(found, "vertex", "left").select("key", "vertex", F.coalesce("component", "vertex").alias("component"))
        keys = _parted(placed, F.col("vertex")).select("key")
        placed = checkpointed(placed.join(keys, "key"))
        placed = sized(placed, placed.count())
        parted = placed.select("key", "vertex")
        # Similar texts share about ten buckets; those in a single one wait for the exact comparison.
        vertices = placed.groupBy("vertex", "component").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        round_ += 1
        bands = classes.select("vertex", "bands").join(vertices, "vertex")
        keyed = bands.select("vertex", "component", F.explode(_keys(F.col("bands"), round_)).alias("key"))
        new = confirmed(star_edges(keyed), sets, percent)
        linked = new.count()
        if linked:
            links = links.union(new)
            found = components(links)
        if linked * FEW <= vertices.count():
            break
    placed = parted.join(found, "vertex", "left").select("key", "vertex", F.coalesce("component", "vertex").alias("component"))
    active = checkpointed(open_members(placed, classes.select("vertex", "n"), percent))
    new = confirmed(prefix_edges(active, sets, percent), sets, percent)
    if not new.isEmpty():
        found = components(links.union(new))
    of_class = classes.join(found, "vertex", "left").select(
        *[F.col(c).alias(f"_{c}") for c in same], F.coalesce("component", "vertex").alias("_component")
    )
    match = (F.col("n") == F.col("_n")) & (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low"))
    return rows.join(of_class, match, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id")
    )


def deduplicated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``; all columns. Texts without words all stay.

    Of rows that repeat the kept ``doc_id`` one stays; rows without a ``doc_id`` stay.
    """
    found = near_duplicates(documents.select("doc_id", "text"), percent)
    kept = checkpointed(found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct())
    known = documents.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    return known.dropDuplicates(["doc_id"]).union(documents.where("doc_id is null"))
