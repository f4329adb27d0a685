"""Conversation repair against an exhaustive search over edits, whole and in pieces."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from allelic.llm import conversation_repair
from allelic.llm.queries import op13_conversation_repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    """Each conversation's rows after damage, by turn."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(h, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, h in out.items()}


def search(turns):
    """(cost, audit) of the cheapest edits: every edit is tried at every place, inserts before deletions too."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(turns) and state in ("", "a") else []

        def add(cost, op, rest):
            if rest:
                found.append((cost + rest[0], op + rest[1]))

        if inserts < 2:
            for r in NEXT[state].replace("s", ""):
                add(3, "I", best(i, r, inserts + 1))
        if i < len(turns):
            add(4, "D", best(i + 1, state, 0))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if turns[i][1][:1] and turns[i][1][:1] in NEXT[state]:
                    add(more, "K", best(i + 1, turns[i][1][:1], 0))
                for r in NEXT[state].replace("s", ""):
                    add(3 + more, "R", best(i + 1, r, 0))
        return min(found, default=None)

    for i in range(len(turns), 0, -1):  # so that the recursion stays shallow
        for state in NEXT:
            best(i, state, 0)
    cost, audit = best(0, "", 0)
    return cost, audit, faults


def brute(rows):
    out = {}
    for conv, turns in damage(rows).items():
        cost, audit, faults = search(turns)
        lines, k, last = [], 0, ""
        for op in audit:
            if op == "I" or op == "R":
                last = "assistant" if last[:1] == "u" else "user"
            if op == "I":
                lines.append(f"{last}:")
                continue
            if op == "K":
                last = turns[k][1]
            if op != "D":
                lines.append(f"{last}:{turns[k][2]}")
            k += 1
        known = [t for t, _, _ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def made(seed=5, conversations=60):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut off", "", "  ", " \t\n", "Why?", None, "ends. \n", "Yes.", "é", "é.", "."]
    for c in range(conversations):
        turn = rnd.choice([0, 3])
        for _ in range(rnd.randrange(1, 12)):
            turn += rnd.choice([0, 1, 1, 1, 3])
            rows.append((c if c else None, None if rnd.random() < 0.05 else turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ups", "Assistant"]), rnd.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind int, ord long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "k") for r in rows], SCHEMA)


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


# one row a piece, three turns a block; or all at once
@pytest.mark.parametrize(("split", "bits"), [(1 << 16, 12), (1, 0), (4, 1)])
def test_against_search(spark, split, bits):
    rows = made()
    df = conversation_repair.repair(frame(spark, rows), damage=True, split=split, block_bits=bits)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = result(df)
    assert len(got) == df.count() and got == brute(rows)


def test_turns_give_the_hash(spark):
    rows = frame(spark, made(9))
    lines = {}
    for split in (1 << 16, 2):
        turns = conversation_repair.repair(rows, damage=True, turns=True, split=split, block_bits=1)
        lines[split] = {}
        for r in turns.orderBy("conv_id", "n").collect():
            lines[split].setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = {c: v[-1] for c, v in result(conversation_repair.repair(rows, damage=True)).items()}
    for found in lines.values():
        assert {c: hashlib.sha256("\n".join(found.get(c, [])).encode()).hexdigest() for c in want} == want


def test_one_long_conversation(spark):
    """Third of all rows in one conversation, repeated texts and copies, a very long text, over many ranges and pieces."""
    rows = [(7, t, ["user", "assistant", "user"][t % 3], f"text {t % 50}{'.' * (t % 4 > 0)}") for t in range(900)] + made(3, 20) + [(7, 5000, "assistant", "long " * 1_000_000 + "."), (7, 5000, "user", "cut")]
    got = result(conversation_repair.repair(frame(spark, rows).repartition(16), damage=True, split=50, block_bits=4))
    assert got == brute(rows)


def test_all_copies(spark):
    rows = [(1, 2, "user", "Same.")] * 400 + [(1, 1, "assistant", "x.")]
    got = result(conversation_repair.repair(frame(spark, rows), split=30, block_bits=3))[1]
    assert got[1:3] == (0, 399) and got[5] == 6 + 399 * 4 and len(got[6]) == 403


def test_empty_table_and_dropped_rows(spark):
    assert conversation_repair.repair(frame(spark, []), damage=True).count() == 0
    dropped = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = result(conversation_repair.repair(frame(spark, dropped), damage=True))
    assert len(got) == len(dropped) > 3 and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_registered_query(spark, tmp_path):
    rows = made(11, 200)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(op13_conversation_repair(spark, str(tmp_path))) == brute(rows)
