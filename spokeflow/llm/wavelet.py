"""Token ids of a corpus in compressed shard files, each a wavelet matrix.

A shard holds the ids of neighbouring documents, about ``SHARD_TOKENS`` of them, in ascending order of ``doc_id``. Its
distinct ids are numbered, and the numbers are stored as bit planes: the first plane has the highest bit of each number; then
all numbers with a 0 there move to the front, in order, and the next plane has the next bit, and so on. With the count of ones
before every 512th bit of a plane, a token at a place, the count of an id and the place of its k-th occurrence each take a few
steps per plane, and no other part of the planes is touched.

Spark writes each shard as one Parquet file of one row, so a shard whose task is lost is written again and never half there.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.llm import bpe, words

SHARD_TOKENS = 1 << 20
BLOCK = 512
GROUP_BYTES = 8 << 20
PIECES = 500_000
SHARD = (
    "first_doc bigint, part int, seq int, n_tokens bigint, doc_ids array<bigint>, doc_tokens binary, alphabet binary, "
    "zeros array<bigint>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Bit planes of a sequence of numbers below 2 ** len(planes)."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, numbers: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = ((numbers >> level) & 1).astype(bool)
            plane = np.packbits(ones)
            counts = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8)
            ranks.append(np.concatenate(([0], np.cumsum(counts.sum(axis=1, dtype=np.int64)))).astype("<u4"))
            planes.append(plane)
            front = numbers[~ones]
            zeros.append(len(front))
            numbers = np.concatenate((front, numbers[ones]))
        return cls(len(numbers), zeros, planes, ranks)

    def _rank(self, level: int, place: int) -> int:
        """Ones before a place of a plane."""
        block, rest = divmod(place, BLOCK)
        count = int(self.ranks[level][block])
        if rest:
            some = np.unpackbits(self.planes[level][block * BLOCK // 8 : (place + 7) // 8], count=rest)
            count += int(some.sum())
        return count

    def _select(self, level: int, k: int, one: bool) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def access(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        number = 0
        for level, front in enumerate(self.zeros):
            one = self.planes[level][place >> 3] >> (7 - (place & 7)) & 1
            ones = self._rank(level, place)
            place = front + ones if one else place - ones
            number = number << 1 | int(one)
        return number

    def _span(self, number: int, place: int) -> tuple[int, int]:
        """Where the occurrences of a number before a place stand after the last plane."""
        lo, hi = 0, place
        for level, front in enumerate(self.zeros):
            a, b = self._rank(level, lo), self._rank(level, hi)
            one = number >> (len(self.zeros) - 1 - level) & 1
            lo, hi = (front + a, front + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, number: int, place: int) -> int:
        """Occurrences of a number before a place."""
        lo, hi = self._span(number, place)
        return hi - lo

    def select(self, number: int, k: int) -> int:
        """Place of the k-th occurrence of a number, from 0; -1 if there are not as many."""
        lo, hi = self._span(number, self.n)
        if not 0 <= k < hi - lo:
            return -1
        place = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = number >> (len(self.zeros) - 1 - level) & 1
            place = self._select(level, place - self.zeros[level] if one else place, bool(one))
        return place

    def everything(self) -> np.ndarray:
        numbers = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            up = np.empty_like(numbers)
            up[~ones] = numbers[: self.zeros[level]]
            up[ones] = numbers[self.zeros[level] :] | numbers.dtype.type(1 << (len(self.zeros) - 1 - level))
            numbers = up
        return numbers


class Shard:
    """One shard row, for token access, counting and lookup."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.ends = np.cumsum(np.frombuffer(row["doc_tokens"], "<i8"))
        self.alphabet = np.frombuffer(row["alphabet"], "<u4")
        planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
        ranks = [np.frombuffer(r, "<u4") for r in row["ranks"]]
        self.matrix = WaveletMatrix(row["n_tokens"], row["zeros"], planes, ranks)

    def token(self, place: int) -> int:
        return int(self.alphabet[self.matrix.access(place)])

    def _number(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def count(self, token: int, before: int | None = None) -> int:
        number = self._number(token)
        return 0 if number < 0 else self.matrix.rank(number, self.matrix.n if before is None else before)

    def occurrences(self, token: int) -> Iterator[tuple[int, int]]:
        """Documents and places within them, in order."""
        number = self._number(token)
        for k in range(self.count(token)):
            place = self.matrix.select(number, k)
            doc = int(np.searchsorted(self.ends, place, "right"))
            yield self.doc_ids[doc], place - (int(self.ends[doc - 1]) if doc else 0)

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.matrix.everything()] if self.matrix.n else np.zeros(0, "<u4")


def shard_row(part: int, seq: int, doc_ids: list, ids: list[np.ndarray]) -> dict:
    tokens = np.concatenate(ids)
    if len(tokens) and tokens.max() < 1 << 20:
        present = np.bincount(tokens) > 0
        alphabet = np.flatnonzero(present)
        numbers = (np.cumsum(present) - 1)[tokens]
    else:
        alphabet, numbers = np.unique(tokens, return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    matrix = WaveletMatrix.build(numbers.astype(np.uint32 if bits > 16 else np.uint16), bits)
    return {
        "first_doc": doc_ids[0], "part": part, "seq": seq, "n_tokens": len(tokens), "doc_ids": doc_ids,
        "doc_tokens": np.array([len(a) + len(b) for a, b in zip(ids[::2], ids[1::2], strict=True)], "<i8").tobytes(),
        "alphabet": alphabet.astype("<u4").tobytes(), "zeros": matrix.zeros,
        "planes": [p.tobytes() for p in matrix.planes], "ranks": [r.tobytes() for r in matrix.ranks],
    }


# What a byte is, a bit each: white space; an ASCII letter or digit; another ASCII sign; a line end; a byte that goes on a
# character; the first byte of a letter of two bytes from U+00C0 on.
WHITE, LETTER_DIGIT, SIGN, LINE_END, GOES_ON, TWO_BYTES = (1 << i for i in range(6))


def _kind(code: int) -> int:
    if code >= 0x80:
        return GOES_ON if code < 0xC0 else TWO_BYTES if 0xC3 <= code < 0xE0 else 0
    if code in (0x20, *range(0x09, 0x0E)):
        return WHITE | (LINE_END if code == 0x0A else 0)
    return LETTER_DIGIT if chr(code).isalnum() else SIGN


KINDS = bytes(_kind(code) for code in range(256))


def piece_starts(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Places where pre-tokens part whatever stands around them; at least the beginning of every text.

    White space after a character that is none; a character that is none after a line end that follows one; a sign after an
    ASCII letter or digit. Runs of white space stay with what follows.
    """
    n = len(data)
    kinds = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
    white, ascii_ = (kinds & WHITE) != 0, (kinds & (LETTER_DIGIT | SIGN)) != 0
    two = (kinds & TWO_BYTES) != 0
    # Whether the character that ends here is known to be no white space.
    solid = ascii_.copy()
    solid[1:] |= ((kinds[1:] & GOES_ON) != 0) & two[:-1]
    starts = np.zeros(n, bool)
    starts[1:] = white[1:] & solid[:-1]
    starts[2:] |= (ascii_ | two)[2:] & ((kinds[1:-1] & LINE_END) != 0) & solid[:-2]
    starts[1:] |= ((kinds[1:] & SIGN) != 0) & ((kinds[:-1] & LETTER_DIGIT) != 0)
    starts[text_at[:-1][text_at[:-1] < n]] = True
    return np.flatnonzero(starts)


class LibraryEncoder:
    """Ids from the tokenizers library, which encodes each distinct piece of a group of texts once.

    Texts are cut where pre-tokens always part. Pieces are told apart by their bytes (an Arrow dictionary); ids are gathered by
    piece. A text with a special token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = bpe.Bounded(lambda piece: self._many([piece])[0], PIECES)

    @classmethod
    def of_process(cls, path: str) -> LibraryEncoder:
        """The one of this worker process, which runs one task after the other: it keeps what it knows from task to task."""
        return bpe.kept_by_worker(("library", path), lambda: cls(path))

    def _many(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that follow each other in ``data``, and where each text's begin (one more at the end)."""
        raw = data.tobytes()
        if any(special in raw for special in self.special):
            texts = [raw[a:b] for a, b in zip(text_at, text_at[1:])]
            ids = [np.frombuffer(i, "<u4") for i in self._many(texts)]
            return np.concatenate(ids or [np.zeros(0, "<u4")]), np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(int)
        starts = piece_starts(data, text_at)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(text_at), int)
        kind_of, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(width))
        told_apart = pa.Array.from_buffers(kind_of, len(starts), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        pieces, kind = told_apart.dictionary.to_pylist(), told_apart.indices.to_numpy()
        ids = [self.known.get(p) or self.known.older.get(p) for p in pieces]
        new = [i for i, found in enumerate(ids) if found is None]
        for i, found in zip(new, self._many([pieces[i] for i in new]), strict=True):
            ids[i] = found
            self.known.put(pieces[i], found)
        lengths = np.fromiter(map(len, ids), width, len(ids)) // 4  # a byte has one id at most
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths, dtype=width) - lengths
        own = lengths[kind]
        ends = np.cumsum(own, dtype=width)
        places = np.repeat(begins[kind] - (ends - own), own)
        places += np.arange(ends[-1], dtype=width)
        tokens = flat[places]
        return tokens, np.concatenate(([0], ends))[np.searchsorted(starts, text_at)]


def write_shards(
    documents: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode ``documents`` (``doc_id``, ``text``) and write them as shard files.

    Every document ends with ``end_id``; NULL and empty texts are just that. Order: ``doc_id``, NULL first, then the text. A
    shard is closed as soon as it has ``shard_tokens`` tokens, so one very long document makes one larger shard.
    """
    schema = pa.schema(
        [
            ("first_doc", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()), ("alphabet", pa.binary()),
            ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
        ]
    )
    end = np.array([end_id], "<u4")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of_process(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, ids, tokens = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard_row(part, seq, doc_ids, ids)], schema)

        for batch in batches:
            some_ids = batch.column(0).to_pylist()
            at, data = words.buffers(batch.column(1))
            for lo, hi in words.groups(at, GROUP_BYTES):
                found, begins = encoder.encode(data[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64))
                for doc_id, a, b in zip(some_ids[lo:hi], begins.tolist(), begins[1:].tolist()):
                    doc_ids.append(doc_id)
                    ids += [found[a:b], end]
                    tokens += b - a + 1
                    if tokens >= shard_tokens:
                        yield row()
                        seq, doc_ids, ids, tokens = seq + 1, [], [], 0
        if doc_ids:
            yield row()

    rows = documents.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id")
    rows.sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.option("maxRecordsPerFile", 1).option(
        "compression", "zstd"
    ).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """Tokens before each shard (``part``, ``seq``, ``shard_start``), from the narrow columns of the files."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    # One row per part of the write, and one per shard within a part.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_part_start"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "seq", (F.col("_part_start") + F.col("_inside")).alias("shard_start"))
    )


def read_documents(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document, read back through the planes: ``doc_id``, ``part``, ``seq``, ``offset`` in the shard, ``n_tokens``, the
    ``crc`` of its ids, and the packed ``ids`` unless ``with_ids`` is False."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                packed = memoryview(shard.tokens().astype("<u4").tobytes())
                ends = shard.ends.tolist()
                ids = [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
                columns = {
                    "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "part": pa.array([row["part"]] * len(ids), pa.int32()),
                    "seq": pa.array([row["seq"]] * len(ids), pa.int32()),
                    "offset": pa.array([0, *ends[:-1]], pa.int64()),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "crc": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([i.tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, part int, seq int, offset bigint, n_tokens bigint, crc bigint"
    return shards.mapInArrow(documents, schema + (", ids binary" if with_ids else ""))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Every place of a token (``doc_id``, ``place``), by select on the planes; files are not decoded."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(Shard(batch.slice(i, 1).to_pylist()[0]).occurrences(token))
                columns = [pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place"])

    return shards.mapInArrow(find, "doc_id bigint, place bigint")


def document_index(shards: DataFrame) -> DataFrame:
    """Per document: ``start`` among all ids, ``n_tokens`` and ``ids_crc32``, read from the files."""
    documents = read_documents(shards, with_ids=False)
    return documents.join(shard_starts(shards), ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )
