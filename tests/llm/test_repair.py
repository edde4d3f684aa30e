"""Operator 11 against an enumeration of edit scripts."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pagegrain.llm import repair
from tests.llm.conftest import SF

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """What the query says of a conversation's rows (turn, role, text) after damage, from the definitions."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.rstrip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @functools.cache
    def best(i, said):
        return min(scripts(i, said, 2))

    def scripts(i, said, insertions):
        """(cost, audit, rows) from row i on, where ``said`` is the last initial so far."""
        out = [(0, "", ())] if i == len(rows) and said in ("", "a") else []
        due = "assistant" if said == "u" else "user"
        if insertions:
            out += [(3 + c, "I" + a, (f"{due}:", *x)) for c, a, x in scripts(i, due[0], insertions - 1)]
        if i < len(rows):
            _, role, text = rows[i]
            c, a, x = best(i + 1, said)
            out.append((4 + c, "D" + a, x))
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                c, a, x = best(i + 1, due[0])
                out.append((3 + more + c, "R" + a, (f"{due}:{text}", *x)))
                if role[:1] == due[0] or role[:1] == "s" and said == "":
                    c, a, x = best(i + 1, role[:1])
                    out.append((more + c, "K" + a, (f"{role}:{text}", *x)))
        return out or [(1 << 40, "", ())]

    cost, audit, left = best(0, "")
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def damaged(rows):
    out, text_of = {}, lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        said = {1: "", 2: re.sub("[.!?]", "", text_of(text))}.get(kind, text_of(text))
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else text_of(role), said)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, g in out.items()}


def told(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations_equal_brute_force(spark):
    rng = random.Random(1)
    roles, texts = ["user", "assistant"] * 3 + ["system", "tool", None, ""], [None, "", " \t", "Hi.", "Hi", "Yes!  ", "No?\n", "é", "ok.", "x"]
    rows = [(c or None, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in range(400) for _ in range(rng.randint(1, 12))]
    want = {c: brute(g) for c, g in damaged(rows).items()}
    assert told(repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA).repartition(3)))) == want
    assert len({w[6] for w in want.values()}) > 200


def test_the_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(repair.op11_repair(spark, SF)) == {c: brute(g) for c, g in damaged(rows).items()}


@pytest.mark.parametrize("stretch", [1, 2, 7, 1 << 15])
def test_stretches_change_nothing(monkeypatch, stretch):
    rng = random.Random(stretch)
    convs = []
    for _ in range(60):
        c = repair.Open(1)
        for k in range(rng.randint(0, 40)):
            c.note(k, rng.choice("uuaas "), rng.random() < 0.1, rng.random() < 0.3, rng.randbytes(1), 1)
        convs.append(c)
    repair.decide(convs)
    want = [c.audit for c in convs]
    monkeypatch.setattr(repair, "STRETCH", stretch)
    repair.decide(convs)
    assert [c.audit for c in convs] == want


def test_ranks_order_audits():
    """A node's rank orders its least audit among those of all nodes."""
    rng = random.Random(7)
    _, letter, target = repair.optimal_arcs([rng.choice("uas") for _ in range(60)], [rng.random() < 0.2 for _ in range(60)], [rng.random() < 0.3 for _ in range(60)])
    rank, pointers = repair.double(letter, target)
    audits = ["".join(repair.LETTERS[k] for k in repair.spell(letter, pointers, i, 60)[0]) for i in range(len(letter))]
    order = sorted(set(audits))
    assert rank.tolist() == [order.index(a) for a in audits]
    for i, a in enumerate(audits):
        node, out = i, ""
        while letter[node] >= 0:
            out, node = out + repair.LETTERS[letter[node]], int(target[node])
        assert out == a


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    of = lambda rows: told(repair.repair(spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, copies int")))
    assert of([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]) == {1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())}
    assert of([(1, 5, "user", ""), (1, 9, "user", " ")])[1] == (3, 2, 0, 0, 1, 8, "DD", empty)
    assert of([(None, None, "system", "S.")])[None][6] in ("D", "KII") and of([(None, None, "system", "S.")])[None][5] == 4
    dropped = spark.createDataFrame([(3, 1, "user", "a.", 0)], f"{SCHEMA}, copies int")
    assert told(repair.repair(dropped)) == {3: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repair.repair(dropped.limit(0)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "Hi.", "mine", "mine", "mine")], f"{SCHEMA}, copies string, late string, place string")
    assert repair.repair(repair.damage(extra)).count() == 1


def test_a_long_conversation(spark):
    """Texts are not held, and a least path goes through many stretches."""
    n = 20_000
    rows = [(1, k, "user" if k % 3 else "assistant", f"text {k}" + "." * (k % 5 > 0)) for k in range(n)]
    got = told(repair.repair(spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, copies int")))[1]
    assert got[3] == sum(k % 5 == 0 for k in range(n)) and got[6].count("K") + got[6].count("D") + got[6].count("R") == n
    cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in got[6])
    kept, at = 0, 0
    for e in got[6]:
        if e != "I":
            kept += 3 * (e != "D" and rows[at][3][-1] != ".")
            at += 1
    assert got[5] == cost + kept
    assert np.isfinite(got[5])
