"""Byte-level BPE in linear time: longest matches, checked for compatible pairs, with backtracking.

Merging never crosses a pre-token, so each pre-token is encoded alone. From left to right, the longest vocabulary token that
begins at the position is tried; an Aho-Corasick automaton finds all of them in one pass. It is kept if it and the token
before it stay two tokens when their joint text is merged (the pair-compatibility table); else the next shorter token that
begins there is tried, and when none is left the token before is taken back. Positions that turned out to lead nowhere are
marked, so no position is left twice, and the first complete encoding is the one that the merge rules give.

Decoding gathers token bytes by an offset table.

Texts are cut at single spaces first, which always part pre-tokens, and the encoding of each piece is kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of byte-level BPE: the pre-token pattern, and white space by Unicode.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
RUNS = ("  ", "\n ", " \n", "\n\n")
RARE = WHITE.replace("\n", "").replace(" ", "")
# Entries of the tables of a Python worker; a full table is begun anew.
PIECES = 120_000
PAIRS = 1_000_000
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens in merge order, with the two halves of each, and the tables of the encoder and the decoder."""

    def __init__(self, path: str, encodes: bool = True):
        """``encodes=False`` leaves out the encoder's tables."""
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        letters = byte_letters()
        known = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges")}
        if spec["normalizer"] or any(known.values()) or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not plain byte-level BPE")
        plain = lambda text: bytes(letters[c] for c in text)
        ids = {plain(text): id_ for text, id_ in model["vocab"].items() if all(c in letters for c in text)}
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has special tokens that take in their neighbourhood")
        self.special = {t["content"]: t["id"] for t in added}
        # The offset table: the bytes of all ids, one after the other.
        by_id = {id_: token for token, id_ in ids.items()} | {id_: text.encode() for text, id_ in self.special.items()}
        size = max(by_id) + 1
        self.offsets = np.concatenate(([0], np.cumsum([len(by_id.get(i, b"")) for i in range(size)])))
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        if encodes:
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self._encoder(path, [(plain(a), plain(b)) for a, b in pairs], ids)

    def _encoder(self, path: str, pairs: list[tuple[bytes, bytes]], ids: dict[bytes, int]) -> None:
        # Ranks: the single bytes, then one token for each merge.
        tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in pairs]
        self.rank = {token: r for r, token in enumerate(tokens)}
        if len(self.rank) != len(tokens):
            raise ValueError(f"two merges of {path} make the same token")
        self.halves = [(r, r) for r in range(256)]
        self.merged = {}
        for r, (a, b) in enumerate(pairs, 256):
            self.halves.append((self.rank[a], self.rank[b]))
            self.merged[self.halves[r]] = r
        self.length = [len(t) for t in tokens]
        self.packed = [ids[t].to_bytes(4, "little") for t in tokens]
        self.tokens = tokens
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for r, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), r)
        self.automaton.make_automaton()
        longest = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def next_shorter(self, rank: int) -> int:
        """The longest token that this one begins with, but itself; -1 if there is none."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.tokens[rank]
            found = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)
            self.shorter[rank] = found
        return found

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are when their joint text is merged from its bytes.

        Undo the later of the two merges step by step; at every step the two tokens at the border must not have a merge that
        comes before what was undone last, for it would have been made first.
        """
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is not None:
            return known
        a, b, limit = left, right, NEVER
        apart = True
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < limit:
                apart = False
                break
            if a >= 256 and (a > b or b < 256):
                limit, a = a, self.halves[a][1]
            elif b >= 256:
                # On a tie of ranks the pair further left is merged first.
                limit, b = b + 1, self.halves[b][0]
            else:
                break
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[key] = apart
        return apart

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token.

        Tokens of which all neighbours stay apart are the encoding, and the only one.
        """
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        # Mostly nothing has to be taken back: the longest tokens one after the other, if all pairs are compatible.
        out = [r for _, r in self.automaton.iter_long(text)]
        known = self.compatible.get
        for left, right in zip(out, out[1:]):
            apart = known(left << 20 | right)
            if not (self.stay_apart(left, right) if apart is None else apart):
                break
        else:
            return out
        n = len(piece)
        length = self.length
        matches = self.automaton.iter_long
        longest = [-1] * n
        longest[0] = rank = next(matches(text))[1]
        out = []
        usable = [True] * (n + 1)
        at, before = 0, -1
        while at < n:
            end = at + length[rank]
            if usable[end]:
                apart = before < 0 or known(before << 20 | rank)
                if self.stay_apart(before, rank) if apart is None else apart:
                    out.append(rank)
                    at, before = end, rank
                    if at < n:
                        rank = longest[at]
                        if rank < 0:
                            longest[at] = rank = next(matches(text, at))[1]
                    continue
            rank = self.next_shorter(rank)
            if rank < 0:
                usable[at] = False
                rank = out.pop()
                at -= length[rank]
                before = out[-1] if out else -1
        return out


class Bounded(dict):
    """Results of a function by argument, the newer ones: when ``most`` are kept, only what is used again stays."""

    def __init__(self, make: Callable[[str], bytes], most: int = PIECES):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key: str, found: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found


AFTER_WORDS = regex.compile(rf"(?<=[^{regex.escape(WHITE)}])(?= )").split


def cut(text: str) -> tuple[list[str], list[str]]:
    """Cut a text where pre-tokens always part: pieces as they stand, then pieces to be read with :func:`uncut`.

    A space after a word, and a line end between two, is such a place unless more white space follows. Texts with runs or
    other kinds of white space are cut with more care, into pieces as they stand.
    """
    if any(run in text for run in RUNS) or any(c in text for c in (RARE[:4] if text.isascii() else RARE)):
        return AFTER_WORDS(text), []
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first], rest


def uncut(piece: str) -> str:
    """A piece after a space, or one that begins with a line end instead."""
    return piece if piece[:1] == "\n" else " " + piece


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        white = regex.escape(WHITE)
        self.pre_tokens = regex.compile(
            PRE_TOKEN.replace(r"[^\s", f"[^{white}").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")
        ).findall
        self.token = Bounded(self._token).__getitem__
        self.piece = Bounded(self._piece).__getitem__
        self.spaced = Bounded(self._spaced).__getitem__

    def _token(self, token: str) -> bytes:
        packed = self.vocabulary.packed
        return b"".join([packed[r] for r in self.vocabulary.encode_piece(token.encode())])

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.token, self.pre_tokens(piece)))

    def _spaced(self, piece: str) -> bytes:
        return self._piece(uncut(piece))

    def part(self, text: str) -> bytes:
        """Encode a text without special tokens."""
        raw, spaced = cut(text)
        return b"".join(map(self.piece, raw)) + b"".join(map(self.spaced, spaced))

    def encode(self, text: str) -> bytes:
        special = self.vocabulary.special_at
        if special is None or not special.search(text):
            return self.part(text)
        parts = special.split(text)
        ids = self.vocabulary.special
        return b"".join(
            ids[p].to_bytes(4, "little") if i % 2 else self.part(p) for i, p in enumerate(parts)
        )


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.starts = vocabulary.offsets[:-1].astype(np.int32)
        self.lengths = np.diff(vocabulary.offsets).astype(np.int32)
        self.longest = int(self.lengths.max(initial=0))
        self.bytes = vocabulary.bytes

    def decode(self, packed: bytes) -> str:
        """The text of the ids; bytes that are not UTF-8 become replacement characters."""
        ids = np.frombuffer(packed, "<u4")
        lengths = self.lengths[ids]
        width = np.int32 if len(ids) * self.longest < 1 << 31 else np.int64
        ends = np.cumsum(lengths, dtype=width)
        if not len(ids) or not ends[-1]:
            return ""
        # Source position of every byte: consecutive within a token, a jump at its beginning.
        jump = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        jump += np.arange(ends[-1], dtype=width)
        return self.bytes[jump].tobytes().decode("utf-8", "replace")


def encoded(text: str | Column, path: str) -> Column:
    """Ids of a text column, packed as little-endian unsigned 32-bit integers. NULL and empty texts have none."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(path))
        for texts in batches:
            yield pa.array((encoder.encode(t.as_py() or "") for t in texts), pa.binary(), size=len(texts))

    return encode(text)


def decoded(ids: str | Column, path: str) -> Column:
    """The text of packed ids; NULL is empty."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(Vocabulary(path, encodes=False))
        for packed in batches:
            packed = pc.fill_null(packed, b"")
            yield pa.array((decoder.decode(p.as_py()) for p in packed), pa.string(), size=len(packed))

    return decode(ids)


def kept_by_worker(key: tuple, make: Callable[[], object]):
    """What this worker process made before under the key: it runs one task after the other, and tables need be made once."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _tables(path: str) -> tuple[Encoder, Decoder]:
    vocabulary = Vocabulary(path)
    return Encoder(vocabulary), Decoder(vocabulary)


def round_trip(text: str | Column, path: str, keep: bool = True) -> Column:
    """:func:`encoded` ``ids`` of a text column and the SHA-256 of the text :func:`decoded` from them (``decoded_sha256``, of its
    UTF-8), by one worker with one set of tables. Decoded texts do not leave it.

    With ``keep`` a worker process keeps its tables for its next task. Without, a task makes its own and they go with it: for jobs
    whose workers go on to other stages.
    """

    @F.arrow_udf("ids binary, decoded_sha256 string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = kept_by_worker(("bpe", path), lambda: _tables(path)) if keep else _tables(path)
        for texts in batches:
            ids, digests = [], []
            for text in texts:
                packed = encoder.encode(text.as_py() or "")
                ids.append(packed)
                digests.append(hashlib.sha256(decoder.decode(packed).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.string())], ["ids", "decoded_sha256"])

    return both(text)


def token_count(ids: str) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("bigint")
