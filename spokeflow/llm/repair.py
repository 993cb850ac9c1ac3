"""Structure repair of conversations: the cheapest edits that leave a system turn at most, then user and assistant in turns.

A conversation of n rows spans a lattice of nodes (rows consumed, what was said last). Keeping, reroling and deleting a row lead
to the next row's nodes, inserting stays at its row. The cheapest path from the start to an accepting node at the end is found
by a bidirectional Dijkstra: one heap goes forward from the start, the other backward from both accepting ends, and the one with
the smaller top goes on. They meet where both know a node. The search stops when the two tops together cost more than the best
meeting, so that all meetings of that cost are finished; every cheapest path then has an edge from a settled node of the one to
a settled node of the other.

Of all cheapest paths the one with the least string of edits counts. The edits so far tell the node, so that string is read off
in one walk: forward nodes that lead to a meeting are marked, backwards, and from the start the least letter is taken whose
node is marked, or is behind a meeting, at the right cost. No string is kept at any node; a row takes about a hundred bytes.

Two passes over the rows of each conversation in order: the first one reads a few bytes a row and finds the edits, the second
one applies them while the texts stream through. Neither holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeflow.session import checkpointed

DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
BLANKS = " \t\n\x0b\x0c\r"
# What was said last: nothing, the system, the user, the assistant. Only nothing and the assistant may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = frozenset(("su", "ua", "au"))
FOLLOWS = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (NOTHING, SYSTEM, ASSISTANT), (USER,))
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60


def kept_as(initial: str, last: int) -> int:
    """What is said last after a row of a role with this initial is kept; -1 if it may not be kept there."""
    if initial == "s":
        return SYSTEM if last == NOTHING else -1
    if initial == "u":
        return USER if last != USER else -1
    return ASSISTANT if initial == "a" and last == USER else -1


@dataclass
class Lattice:
    """The rows of one conversation: initials of their roles, which ones must go, and which cost more if they stay."""

    initials: list[str] = field(default_factory=list)
    must_go: bytearray = field(default_factory=bytearray)
    truncated: bytearray = field(default_factory=bytearray)

    def after(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(edit, next node, cost) of the edges from a node, by edit."""
        row, last = node >> 2, node & 3
        more = row < len(self.initials)
        if more:
            yield DELETE, node + 4, COSTS[DELETE]
        says = FOLLOWS[last]
        yield INSERT, row << 2 | says, COSTS[INSERT]
        if more and not self.must_go[row]:
            extra = TRUNCATED if self.truncated[row] else 0
            kept = kept_as(self.initials[row], last)
            if kept >= 0:
                yield KEEP, row + 1 << 2 | kept, extra
            yield REROLE, row + 1 << 2 | says, extra + COSTS[REROLE]

    def before(self, node: int) -> Iterator[tuple[int, int]]:
        """(node before, cost) of the edges into a node."""
        row, last = node >> 2, node & 3
        for said in BEFORE[last]:
            yield row << 2 | said, COSTS[INSERT]
        if not row:
            return
        row -= 1
        yield node - 4, COSTS[DELETE]
        if self.must_go[row]:
            return
        extra = TRUNCATED if self.truncated[row] else 0
        if last == SYSTEM and self.initials[row] == "s":
            yield row << 2 | NOTHING, extra
        for said in BEFORE[last]:
            kept = kept_as(self.initials[row], said) == last
            yield row << 2 | said, extra + (COSTS[KEEP] if kept else COSTS[REROLE])

    def cheapest(self) -> tuple[int, str]:
        """The least cost of all edits, and the least string of edits of that cost."""
        n = len(self.initials)
        size = n + 1 << 2
        ends = (n << 2 | NOTHING, n << 2 | ASSISTANT)
        forward, backward = array("q", [FAR]) * size, array("q", [FAR]) * size
        done_f, done_b = bytearray(size), bytearray(size)
        forward[0] = 0
        for end in ends:
            backward[end] = 0
        # A heap's number is cost * size + place; of one cost, each goes through the rows in its own direction.
        heap_f, heap_b = [0], sorted(size - 1 - end for end in ends)
        best, settled = FAR, []
        while heap_f and heap_b and heap_f[0] // size + heap_b[0] // size <= best:
            if heap_f[0] // size <= heap_b[0] // size:
                cost, node = divmod(heapq.heappop(heap_f), size)
                if done_f[node]:
                    continue
                done_f[node] = 1
                settled.append(node)
                best = min(best, cost + backward[node])
                for _, to, more in self.after(node):
                    if cost + more < forward[to]:
                        forward[to] = cost + more
                        heapq.heappush(heap_f, (cost + more) * size + to)
            else:
                cost, place = divmod(heapq.heappop(heap_b), size)
                node = size - 1 - place
                if done_b[node]:
                    continue
                done_b[node] = 1
                best = min(best, cost + forward[node])
                for to, more in self.before(node):
                    if cost + more < backward[to]:
                        backward[to] = cost + more
                        heapq.heappush(heap_b, (cost + more) * size + size - 1 - to)
        # Forward nodes on a cheapest path: an end of that cost, or one with an edge to a marked node or over a meeting.
        marked = bytearray(size)
        for node in reversed(settled):
            marked[node] = (node in ends and forward[node] == best) or any(
                (done_b[to] and forward[node] + more + backward[to] == best) or (marked[to] and forward[node] + more == forward[to])
                for _, to, more in self.after(node)
            )
        edits, node, cost = [], 0, 0
        while not (cost == best and node in ends):
            for edit, to, more in self.after(node):
                if (marked[to] and forward[to] == cost + more) or (done_b[to] and cost + more + backward[to] == best):
                    edits.append(edit)
                    node, cost = to, cost + more
                    break
        return best, "".join(edits)


class Conversation:
    """What the first pass gathers of one conversation."""

    def __init__(self) -> None:
        self.lattice, self.seen = Lattice(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, truncated: bool) -> None:
        """Rows come by turn, NULL first. A row's first fault counts."""
        duplicate = not blank and digest in self.seen
        self.seen.add(digest)
        truncated = truncated and not (blank or duplicate)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        rows = self.lattice
        self.illegal += bool(rows.initials) and rows.initials[-1] + initial not in LEGAL
        rows.initials.append(initial)
        rows.must_go.append(blank or duplicate)
        rows.truncated.append(truncated)
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def report(self) -> dict:
        cost, audit = self.lattice.cheapest()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": audit,
        }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (``conv_id``, ``turn``, ``role``, ``text``; NULLs are one space) with seeded damage.

    By the checksum of ``conv_id:turn``, one row in twenty each is lost, emptied, loses its ends of sentences, comes twice, or
    is said by the user. Rows that repeat are damaged alike.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with NULLs as one space, and a digest of role and text, by which rows of one turn and role are ordered."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text")
    ).withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def _in_order(rows: DataFrame, *kind: str) -> DataFrame:
    """Each conversation in one partition, in order; a long one is sorted on disk and streams through."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *kind, F.asc_nulls_first("turn"), "role", "digest")


def _schema(conversations: DataFrame, numbers: Iterable[str], texts: Iterable[str]) -> T.StructType:
    named = [(n, T.LongType()) for n in numbers] + [(n, T.StringType()) for n in texts]
    return T.StructType([T.StructField(n, t) for n, t in [("conv_id", conversations.schema["conv_id"].dataType), *named]])


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def reports(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``): its faults (``gaps`` in the
    turns, ``blank``, ``duplicate``, ``truncated`` rows, ``illegal`` neighbours), the least ``cost`` of a repair and the
    ``audit``, a letter for each edit in order.

    NULL roles and texts are one space; rows without ``conv_id`` are one conversation. Rows go by turn, NULL first, then by
    role and a digest of the text; equal rows are duplicates.
    """
    schema = _schema(conversations, COUNTS, ["audit"])
    columns = _arrow(schema)
    bare = F.rtrim("text", F.lit(BLANKS))
    narrow = _rows(conversations).select(
        "conv_id", "turn", "role", "digest",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def found() -> pa.RecordBatch:
            return _batch({"conv_id": [now], **{n: [v] for n, v in held.report().items()}}, columns)

        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "turn", "initial", "digest", "blank", "truncated")]
            for conv_id, *row in zip(*rows, strict=True):
                if held is None or conv_id != now:
                    if held is not None:
                        yield found()
                    now, held = conv_id, Conversation()
                held.add(*row)
        if held is not None:
            yield found()

    return _in_order(narrow).mapInArrow(examine, schema)


@dataclass
class Repair:
    """Applies the edits of one conversation to its rows as they come."""

    conv_id: object
    audit: str
    at: int = 0
    place: int = 0
    last: int = NOTHING

    def _said(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return self.conv_id, self.place - 1, edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            self.last = FOLLOWS[self.last]
            yield self._said(INSERT, NAMES[self.last], "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.last = kept_as(role[:1], self.last)
            yield self._said(KEEP, role, text)
        elif edit == REROLE:
            self.last = FOLLOWS[self.last]
            yield self._said(REROLE, NAMES[self.last], text)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Repaired rows, a batch at a time: a conversation's edits come as its first row, with the audit as its text."""
    repair = None
    for batch in batches:
        out: list[tuple] = []
        rows = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "is_row", "role", "text")]
        for conv_id, is_row, role, text in zip(*rows, strict=True):
            if is_row:
                out += repair.row(role, text)
            else:
                out += repair.inserted() if repair else ()
                repair = Repair(conv_id, text)
        yield out
    if repair:
        yield list(repair.inserted())


REPAIRED = ("conv_id", "place", "edit", "role", "text")


def _with_edits(conversations: DataFrame, found: DataFrame) -> DataFrame:
    edits = found.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(False).alias("is_row"),
    )
    return _in_order(_rows(conversations).withColumn("is_row", F.lit(True)).unionByName(edits), "is_row")


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I), ``role`` and ``text``.

    ``found`` are the :func:`reports` of ``conversations``, if they are at hand as a table.
    """
    found = checkpointed(reports(conversations)) if found is None else found
    schema = _schema(conversations, ["place"], ["edit", "role", "text"])
    columns = _arrow(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _edited(batches):
            yield _batch({name: [r[i] for r in rows] for i, name in enumerate(REPAIRED)}, columns)

    return _with_edits(conversations, found).mapInArrow(apply, schema)


def digests(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``, of the repaired rows as ``role:text`` with line ends between, for conversations
    with a repaired row. Hashed as the rows stream through, so a long conversation needs no more memory than a short one."""
    schema = _schema(conversations, [], ["repaired_sha256"])
    columns = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for rows in _edited(batches):
            ended: list[tuple] = []
            for conv_id, place, _, role, text in rows:
                if place == 0:
                    if held is not None:
                        ended.append((now, held.hexdigest()))
                    now, held = conv_id, hashlib.sha256()
                held.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield _batch({n: [e[i] for e in ended] for i, n in enumerate(columns.names)}, columns)
        if held is not None:
            yield _batch({n: [v] for n, v in zip(columns.names, (now, held.hexdigest()), strict=True)}, columns)

    return _with_edits(conversations, found).mapInArrow(digest, schema)


def repair_digest(conversations: DataFrame, all_ids: DataFrame) -> DataFrame:
    """The reports and digests of every conversation named in ``all_ids`` (``conv_id``); those without rows have zeros."""
    found = checkpointed(reports(conversations))
    whole = found.withColumnRenamed("conv_id", "_id")
    hashed = digests(conversations, found).withColumnRenamed("conv_id", "_of")
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    zero: dict[str, Column] = {n: F.coalesce(n, F.lit(0)).cast("bigint") for n in COUNTS}
    return (
        all_ids.select("conv_id").distinct()
        .join(whole, same("_id"), "left")
        .join(hashed, same("_of"), "left")
        .select(
            "conv_id",
            *[c.alias(n) for n, c in zero.items()],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
