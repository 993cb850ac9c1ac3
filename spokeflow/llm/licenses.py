"""License scan by diagonal voting.

Every run of k words of a text is hashed and joined to the places where a template has the same run. A match of word ``i`` of
the text and word ``j`` of the template votes for the diagonal i - j. A verbatim copy puts all its votes on one diagonal; a
word more or less moves the rest to a neighbouring one, so neighbouring diagonals of a template are merged. A span is verified
by the words themselves, which travel with the hash, and by the share of the template that it covers.

Tasks drop the runs whose hash no template has before the join, as a join filter does; all others meet the template table,
whose size is that of the template list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.llm import words
from spokeflow.session import checkpointed


class Template(NamedTuple):
    """``exact``: every place where all words stand one after the other; else notices that may differ in a few words."""

    label: str
    text: str
    exact: bool


# The phrases that are always looked for, and wordings of well-known notices.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", False),
    Template("apache-2.0", "licensed under the apache license version 2.0", False),
    Template("cc-by-nc", "licensed under cc by-nc 4.0", False),
    Template("mit-notice", "released under the mit license", False),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files",
        False,
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        False,
    ),
)
# Words in a run; shorter for exact phrases, which may be of two words.
RUN, PHRASE_RUN = 3, 2
# Diagonals that are as near as this are merged; share of a template's runs that a span must cover.
NEAR, SHARE = 2, 0.75
TEMPLATE_RUNS = 100_000


def run_sums(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on."""
    sums = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        sums += hashes[j : j + len(sums)] * words.STEPS[j]
    return words.mix(sums + words.LENGTHS[k])


def _codes() -> np.ndarray:
    return words.byte_codes(words.LETTERS_DIGITS)


def template_runs(templates: Sequence[Template]) -> list[tuple]:
    """``template``, ``k``, ``runs`` in all, ``place`` of the run, its ``hash`` and its words, joined by spaces."""
    out = []
    for number, template in enumerate(templates):
        k = PHRASE_RUN if template.exact else RUN
        (scan,) = words.scans(pa.array([template.text]), words.LETTERS_DIGITS)
        text = [scan.data[a:b].tobytes().decode().lower() for a, b in zip(scan.starts, scan.ends, strict=True)]
        hashes = run_sums(scan.hashes(_codes()), k).view(np.int64).tolist()
        if not hashes:
            raise ValueError(f"template {template.label} has fewer than {k} words")
        out += [(number, k, len(hashes), at, h, " ".join(text[at : at + k])) for at, h in enumerate(hashes)]
    if len(out) > TEMPLATE_RUNS:
        raise ValueError(f"more than {TEMPLATE_RUNS} runs of template words")
    return out


def matching_runs(text: str | Column, runs: list[tuple]) -> Column:
    """Per text its number of words, and every run that some template has: first word, k, hash and words."""
    kind = pa.struct([("at", pa.int64()), ("k", pa.int32()), ("hash", pa.int64()), ("run", pa.string())])
    wanted = {k: np.unique(np.array([r[4] for r in runs if r[1] == k], np.int64)) for k in {r[1] for r in runs}}

    @F.arrow_udf("n_words bigint, hits array<struct<at:bigint,k:int,hash:bigint,run:string>>")
    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _codes()
        for texts in batches:
            counts, hits = [], []
            for scan in words.scans(texts, words.LETTERS_DIGITS):
                hashes = scan.hashes(codes)
                counts += np.diff(scan.word_at).tolist()
                found: list[list] = [[] for _ in range(scan.hi - scan.lo)]
                for k, known in wanted.items():
                    sums = run_sums(hashes, k).view(np.int64)
                    place = np.minimum(np.searchsorted(known, sums), len(known) - 1)
                    first = np.flatnonzero(known[place] == sums)
                    text_of = np.searchsorted(scan.word_at, first, "right") - 1
                    inside = first + k <= scan.word_at[text_of + 1]
                    for i, t in zip(first[inside].tolist(), text_of[inside].tolist(), strict=True):
                        run = b" ".join(scan.data[a:b].tobytes() for a, b in zip(scan.starts[i : i + k], scan.ends[i : i + k]))
                        # Bytes lower() changes A-Z only.
                        run = run.lower().decode("utf-8", "replace")
                        found[t].append({"at": i - int(scan.word_at[t]), "k": k, "hash": int(sums[i]), "run": run})
                hits += found
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(kind))], names=["n_words", "hits"]
            )

    return scan_texts(text)


def _template_table(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    schema = "template int, k int, runs int, place int, hash bigint, words string"
    return F.broadcast(spark.createDataFrame(runs, schema))


def spans(rows: DataFrame, templates: Sequence[Template], runs: list[tuple]) -> DataFrame:
    """Verified spans of ``rows`` (``row``, ``hits``): ``row``, ``template``, ``first`` word, ``length`` in words, ``share``."""
    votes = (
        rows.select("row", F.explode("hits").alias("hit"))
        .select("row", "hit.*")
        .join(_template_table(rows.sparkSession, runs), ["k", "hash"])
        .where("run = words")
        .groupBy("row", "template", "k", "runs", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    exact = F.get(F.array(*[F.lit(t.exact) for t in templates]), F.col("template"))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along)
    return (
        votes.withColumn("_new", F.when(exact | (apart > NEAR) | apart.isNull(), 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("row", "template", "k", "runs", "_island")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("_covered"),
            F.min("first").alias("first"),
            F.max("last").alias("_last"),
        )
        .withColumn("share", F.col("_covered") / F.col("runs"))
        .where(F.when(exact, F.col("share") == 1).otherwise(F.col("share") >= SHARE))
        .select("row", "template", "first", (F.col("_last") - F.col("first") + F.col("k")).alias("length"), "share")
    )


def scanned(
    documents: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``documents`` (``doc_id``, ``text``) with a number ``row`` and ``n_words``, and all their :func:`spans`.

    NULL and empty texts have no words. Every row is scanned by itself, repeated ones too.
    """
    runs = template_runs([*phrases, *notices])
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), matching_runs("text", runs).alias("m"))
    rows = checkpointed(rows.select("doc_id", "row", "m.n_words", "m.hits"))  # row numbers hold from here on
    return rows.select("doc_id", "row", "n_words"), spans(rows, [*phrases, *notices], runs)


def labelled(
    documents: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES
) -> DataFrame:
    """One row per document: ``n_words``; places of the phrases (``n_base``, ``first_word``, ``last_word``, ``base_labels``);
    all ``labels``; ``score``, the largest share of a template found. Without any: 0, NULL, NULL, empty, empty, 0."""
    rows, found = scanned(documents, phrases, notices)
    label = F.get(F.array(*[F.lit(t.label) for t in (*phrases, *notices)]), F.col("template"))
    base = F.col("template") < len(phrases)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    per_row = (
        found.withColumn("label", label)
        .groupBy("row")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set("label")).alias("labels"),
            F.max("share").alias("score"),
        )
    )
    return rows.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
