import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeflow.llm import bpe, slate, wavelet, words

ALPHABET = list(" \n\t\r '’s0129abcXYZ.,!-<|>endoftext\x85\xa0 　\x1c\x1f\x0béß漢字한😀²½Ⅷ٣́\x00​")
PIECES = [" ", "  ", "\n", " \n", "a", "the", " of", "<|endoftext|>", "'s", "\n\n", "ing", "12", "!", "\t"]
LONG = ["a" * 20_000, "ab" * 5_000, "=" * 999, " " * 3_000 + "x", "z" * 5_000 + " " + "qwertyuiop" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(slate.TOKENIZER)


@pytest.fixture(scope="module")
def own():
    vocabulary = bpe.Vocabulary(slate.TOKENIZER)
    return bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)


def texts():
    rng = random.Random(5)
    yield from LONG
    for _ in range(4_000):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14)))
    for _ in range(2_000):
        yield "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))


def test_encodes_and_decodes_as_the_library(library, own):
    encoder, decoder = own
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text[:50])
        assert decoder.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_backtracking_alone(own):
    """The path without the shortcut gives the same tokens, also where a longest match must be taken back."""
    vocabulary = bpe.Vocabulary(slate.TOKENIZER)
    rng = random.Random(7)
    taken_back = 0
    for _ in range(3_000):
        piece = "".join(rng.choice("theronigsad") for _ in range(rng.randrange(2, 20))).encode()
        greedy = [r for _, r in vocabulary.automaton.iter_long(piece.decode("latin-1"))]
        found = vocabulary.encode_piece(piece)
        assert b"".join(vocabulary.tokens[r] for r in found) == piece
        assert all(vocabulary.stay_apart(a, b) for a, b in zip(found, found[1:]))
        taken_back += found != greedy
    assert taken_back > 100


def test_library_by_pieces_is_the_library(library):
    encoder = wavelet.LibraryEncoder(slate.TOKENIZER)
    some = list(texts())
    for lo in range(0, len(some), 500):
        group = some[lo : lo + 500]
        for part in (group, [t for t in group if "<|endoftext|>" not in t]):
            at, data = words.buffers(pa.array(part))
            ids, begins = encoder.encode(data, at.astype(np.int64))
            for text, a, b in zip(part, begins, begins[1:], strict=False):
                assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_given_documents(spark, given, library):
    rows = {r["doc_id"]: r["text"] for r in given("sf0.001", "documents")}
    found = slate.op4_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_odd_rows(documents):
    rows = documents([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "<|endoftext|>")])
    found = rows.select("doc_id", bpe.encoded("text", slate.TOKENIZER).alias("ids")).select(
        "doc_id", bpe.token_count("ids").alias("n"), bpe.decoded("ids", slate.TOKENIZER).alias("text")
    )
    assert sorted((r.doc_id or 0, r.n, r.text) for r in found.collect()) == [
        (0, 1, "<|endoftext|>"), (1, 0, ""), (2, 0, ""), (3, 1, "a"), (3, 1, "a")
    ]
    assert rows.where(F.lit(False)).select(bpe.encoded("text", slate.TOKENIZER)).collect() == []
