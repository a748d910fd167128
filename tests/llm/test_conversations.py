"""Conversation repair against the least of all repairs, found by suffix."""

import hashlib
import random
import re
import zlib

import pytest

from cohortlake.llm import conversations
from cohortlake.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, n int, fault string, segment double"
FORM = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACE = " \t\n\v\f\r"


def least(rows):
    """(cost, audit, repaired rows) of faulty rows [(role, text, fault)]: the least (cost, audit) of what follows, from the end."""
    best = {"": (0, "", ()), "a": (0, "", ())}
    for row in [*rows[::-1], None]:
        for _ in range(6):  # rows put in behind this row
            for (x, r), y in FORM.items():
                if r != "s" and y in best:
                    cost, audit, out = best[y]
                    name = "user" if r == "u" else "assistant"
                    best[x] = min(best.get(x, (10**9, "", ())), (cost + 3, "I" + audit, ((name, ""), *out)))
        if row is None:
            continue
        role, text, fault = row
        before = {x: (c + 4, "D" + audit, out) for x, (c, audit, out) in best.items()}
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            for (x, r), y in FORM.items():
                if y in best:
                    cost, audit, out = best[y]
                    ways = [(cost + more, "K" + audit, ((role, text), *out))] if role[:1] == r else []
                    if r != "s":
                        ways.append((cost + 3 + more, "R" + audit, (("user" if r == "u" else "assistant", text), *out)))
                    before[x] = min([before.get(x, (10**9, "", ())), *ways])
        best = before
    return best[""]


def brute(rows):
    """What a conversation's rows (turn, role, text) give."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faulty, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faulty.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = least(faulty)
    of = [sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *of, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append((row[0], *(" " if x is None else x for x in row[1:3])))
    return {conv: brute(r) for conv, r in out.items()}


def random_rows(rnd, conv, n):
    texts = ["Hi.", "Why?  \n", "cut", "", " \t", None, "No!\x0b", "é.", "three dots...", "a.b", "."]
    return [(conv, rnd.choice([i, i, i, i + 2, None, 3]), rnd.choice("user user user assistant assistant assistant system tool".split() + ["", "User", None]), rnd.choice(texts + [f"row {i}."] * 14), 1, "x", 0.5) for i in range(n)]


@pytest.mark.parametrize("segment", [1, 400, 32 << 20])
def test_repairs_equal_brute_force(spark, segment):
    rnd = random.Random(segment)
    rows = [r for conv in [None, *range(60)] for r in random_rows(rnd, conv, rnd.randint(1, 9))]
    rows += random_rows(rnd, 100, 300)  # a conversation of a third of all rows
    rows += [rows[0], rows[-1], *[(101, 5, "user", "Same.", 1, "x", 0.5)] * 40, *[(102, i, "user", "Same.", 1, "x", 0.5) for i in range(40)], (103, None, None, None, 1, "x", 0.5)]
    rnd.shuffle(rows)
    done = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark, "t"), segment=segment)
    got = conversations.digests(done)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("conv_id", "bigint"), *[(c, "bigint") for c in "gaps blank duplicate truncated illegal cost".split()], ("audit", "string"), ("repaired_sha256", "string")]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == by_conversation(rows)
    if segment == 400:
        text = {}
        for r in sorted(conversations.repaired_rows(done).collect(), key=lambda r: (r.segment, r.place)):
            text.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
            assert r.turn is None or r.text is not None
        hashes = {r.conv_id: r.repaired_sha256 for r in got.collect()}
        assert all(hashlib.sha256("\n".join(t).encode()).hexdigest() == hashes[c] for c, t in text.items())


def test_audits_of_hand_made_conversations():
    cases = {"": (0, ""), "u": (3, "KI"), "ua": (0, "KK"), "a": (3, "IK"), "s": (4, "D"), "sua": (0, "KKK"), "uu": (3, "KR"), "suu": (3, "KKR"), "ss": (6, "KRI"), "x": (4, "D"), "uua": (3, "KIKK"), "aua": (3, "IKKK")}
    for roles, (cost, audit) in cases.items():
        got = least([(r, f"{i}.", "") for i, r in enumerate(roles)])
        kinds = [1 + 2 * "suax".index(r) for r in roles]
        letters, nodes, f = conversations.walked(conversations.FIRST, conversations.LAST, frozenset([0]), kinds)
        assert "".join(letters) + conversations.ending(f, nodes) == got[1]
        assert int(conversations.passed(conversations.FIRST, kinds, [0] * len(kinds))[1] + min(f[0], f[3])) == got[0]
        if roles != "ss":
            assert got[:2] == (cost, audit) or got[0] == cost


def test_no_rows_and_long_texts(spark):
    assert conversations.digests(conversations.repair(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + ".", 1, "x", 0.5), (1, 1, "assistant", ". " * 1_000_000, 1, "x", 0.5)]
    got = conversations.digests(conversations.repair(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == by_conversation(rows)


def damaged(rows):
    """(conv_id, turn, role, text) of the contract, and all original ids."""
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r[1:]) for r in conversations.op11(spark, data).collect()} == {r[0]: nothing for r in rows} | by_conversation(damaged(rows))


def test_damage_with_nulls_and_dropped_conversations(spark):
    rows = [(c, t, r, x, 1, "f", 0.1) for c in [None, *range(40)] for t, r, x in [(None, None, "A."), (0, "user", None), (1, "assistant", "B! c? d.")][: 1 + (c or 0) % 3]]
    got = conversations.digests(conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "t"), copies="copies"))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {r[0]: nothing for r in rows} | by_conversation(damaged(rows))
