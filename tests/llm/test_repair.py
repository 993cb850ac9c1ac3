import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

from spokeflow.llm import repair, slate

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def plain_cheapest(initials, must_go, truncated):
    """Least (cost, audit) over all edits, by trying all of them from the end."""
    n = len(initials)
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, last, inserted):
        found = [(0, "")] if i == n and last in ("", "a") else []
        add = lambda cost, letter, tail: found.append((cost + tail[0], letter + tail[1]))
        if inserted < 4:
            add(5, "I", rest(i, "a" if last == "u" else "u", inserted + 1))
        if i < n:
            add(2, "D", rest(i + 1, last, 0))
            if not must_go[i]:
                more = 5 * truncated[i]
                if initials[i] and initials[i] in nexts[last]:
                    add(more, "K", rest(i + 1, initials[i], 0))
                add(1 + more, "R", rest(i + 1, "a" if last == "u" else "u", 0))
        return min(found, default=(10**9, ""))

    return rest(0, "", 0)


def plain_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of one conversation's (turn, role, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    rows = sorted(rows, key=key)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = plain_cheapest(tuple(initials), tuple(f in ("b", "d") for f in faults), tuple(f == "t" for f in faults))
    out, left, last = [], iter(rows), ""
    for letter in audit:
        _, role, text = next(left) if letter != "I" else (None, "", "")
        if letter != "D":
            last = role[:1] if letter == "K" else "a" if last == "u" else "u"
            out.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, "\n".join(out)


def expected(rows):
    after = plain_damage(rows)
    found = {}
    for conv in {r[0] for r in rows}:
        *counts, text = plain_report([r[1:] for r in after if r[0] == conv])
        found[conv] = (*counts, hashlib.sha256(text.encode()).hexdigest())
    return found


def found(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    got = repair.repair_digest(repair.damaged(table), table).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_least_cost_and_audit_of_random_lattices():
    rng = random.Random(7)
    for _ in range(3_000):
        n = rng.randint(0, 9)
        initials = [rng.choice(["s", "u", "a", "a", "u", "t", "", " "]) for _ in range(n)]
        must_go = [rng.random() < 0.2 for _ in range(n)]
        truncated = [not m and rng.random() < 0.3 for m in must_go]
        lattice = repair.Lattice(initials, bytearray(must_go), bytearray(truncated))
        assert lattice.cheapest() == plain_cheapest(tuple(initials), tuple(must_go), tuple(truncated))


def test_search_meets_in_the_middle():
    """Far less than all nodes are settled where few edits are needed, and the answer is that of the plain search."""
    initials = ["s"] + ["u", "a"] * 200
    lattice = repair.Lattice(initials, bytearray(401), bytearray(401))
    assert lattice.cheapest() == (0, "K" * 401)
    lattice.initials[100] = "u"
    looked = 0
    after, before = lattice.after, lattice.before
    lattice.after = lambda node: [counted() or e for e in after(node)]
    lattice.before = lambda node: [counted() or e for e in before(node)]

    def counted():
        nonlocal looked
        looked += 1

    assert lattice.cheapest()[0] == 1 and looked < 401 * 4 * 4


def test_long_conversation_without_blowing_up():
    rng = random.Random(3)
    initials = [rng.choice("uaas") for _ in range(20_000)]
    cost, audit = repair.Lattice(initials, bytearray(20_000), bytearray(20_000)).cheapest()
    assert cost > 0 and len(audit) - audit.count("I") == 20_000


def test_given_conversations(spark, given):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given("sf0.01", "conversations")]
    got = {r.conv_id: r for r in slate.op13_repair(spark, "/root/testdata/sf0.01").collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {c: tuple(r[n] for n in names) for c, r in got.items()} == expected(rows)


def test_odd_rows(spark):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(rng.randint(1, 8)):
            role = rng.choice(["system", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "what", None, "", " \t\n", "Done?  \n", "é.", "x" * 5000 + ".", "é"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), role, text))
    rows += [(200, t, "user", "Same.") for t in (1, 1, 1)] + [(None, None, None, None)] * 3
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_lost_conversations(spark):
    assert found(spark, []) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(lost, 0, "user", "Gone.")]) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}


def test_repaired_rows(spark):
    """The operator's own result: rows in order, and the digest is theirs."""
    rows = [(1, 0, "system", "Be short."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Yes."), (2, 0, "user", " "), (3, 5, "user", "A?")]
    table = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in repair.repaired(table).collect())
    by_conv = {c: list(g) for c, g in groupby(got, key=lambda r: r[0])}
    assert by_conv[1] == [(1, 0, "K", "system", "Be short."), (1, 1, "R", "user", "Hello."), (1, 2, "K", "assistant", "Yes.")]
    assert 2 not in by_conv and 3 not in by_conv
    reports = repair.reports(table)
    assert {r.conv_id: r.audit for r in reports.collect()} == {1: "KRK", 2: "D", 3: "D"}
    hashed = {r.conv_id: r.repaired_sha256 for r in repair.digests(table, reports).collect()}
    for conv, lines in by_conv.items():
        text = "\n".join(f"{role}:{text}" for _, _, _, role, text in lines)
        assert hashed[conv] == hashlib.sha256(text.encode()).hexdigest()
