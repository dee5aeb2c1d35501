"""Conversation repair against all edits of short conversations and a plain table of longer ones."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from tidemark.llm import repair
from tidemark.llm.common import prepare, table

DATA = "/root/testdata/sf0.001"
PATTERN = re.compile("(s?(ua)+)?")
WORD = re.compile("[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, fault) by trying every edit, at most two insertions at a place."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    options = []
    for role, text, fault in rows:
        ways = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = int(fault == "truncated")
            ways += [(more, "K", (role, text)), (2 + more, "R", ("user", text)), (2 + more, "R", ("assistant", text))]
        options.append(ways)
    for placed in itertools.product(inserts, repeat=len(rows) + 1):
        for ways in itertools.product(*options):
            turns, audit, cost = [], "", 0
            for i, ins in enumerate(placed):
                cost += 2 * len(ins)
                audit += "I" * len(ins)
                turns += [("user" if x == "u" else "assistant", "") for x in ins]
                if i < len(ways):
                    cost += ways[i][0]
                    audit += ways[i][1]
                    turns += [ways[i][2]] if ways[i][2] else []
            if best is None or (cost, audit) < best[:2]:
                if PATTERN.fullmatch("".join(r[:1] for r, _ in turns)):
                    best = cost, audit, turns
    return best


def plain_table(rows):
    """The same by a table over all rows that keeps (cost, audit, turns) of every state's best beginning."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(table):
        while True:
            more = dict(table)
            for state, (cost, audit, turns) in table.items():
                for x in "ua":
                    if (state, x) in steps:
                        offer = cost + 2, audit + "I", turns + [(names[x], "")]
                        to = steps[state, x]
                        if to not in more or offer[:2] < more[to][:2]:
                            more[to] = offer
            if more == table:
                return table
            table = more

    def ending(table):
        # Beginnings that may go on differently are compared only where they end alike.
        return min((v for s, v in inserted(table).items() if s in ("", "a")), key=lambda v: v[:2])

    table = {"": (0, "", [])}
    for role, text, fault in rows:
        after = {}

        def offer(to, cost, audit, turns):
            if to not in after or (cost, audit) < after[to][:2]:
                after[to] = cost, audit, turns

        for state, (cost, audit, turns) in inserted(table).items():
            offer(state, cost + 3, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if (state, role[:1]) in steps:
                    offer(steps[state, role[:1]], cost + more, audit + "K", turns + [(role, text)])
                for x in "ua":
                    if (state, x) in steps:
                        offer(steps[state, x], cost + 2 + more, audit + "R", turns + [(names[x], text)])
        # A beginning that was reached before insertions must not hide the one they would have led to.
        table = after
    return ending(table)


def brute(rows, solve):
    """The contract over (conv_id, turn, role, text) rows."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in after:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[0] for r in after} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, kept = solve(faulty)
        count = lambda f: sum(x[2] == f for x in faulty)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"),
                    count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, digest string, copies string, block long"


def found(spark, rows):
    prepare(spark)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repair.repaired(repair.damaged(df)).collect()), key=repr)


def talk(rng, n_convs, longest, texts):
    rows = []
    for conv in range(n_convs):
        rows += [(conv, t * rng.choice((1, 1, 1, 2)), rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None)),
                  rng.choice(texts)) for t in range(rng.randrange(1, longest + 1))]
    return rows


TEXTS = ["Yes.", "No!", "Well", "So it is. \n", "  ", "", None, "Ends, with? no", "é…", "Fine.\x85"]


def test_every_edit_of_short_conversations():
    rng = random.Random(1)
    for _ in range(12):
        rows = [(rng.choice(("system", "user", "assistant", "other")), "t", rng.choice(("", "", "truncated", "blank")))
                for _ in range(rng.randrange(0, 3))]
        codes = bytes(4 * {"": 0, "truncated": 1, "blank": 2}[f] + "sua".find(r[0]) % 4 for r, _, f in rows)
        cost, audit = repair.repair(codes)
        turns = repair.applied(audit, [r for r, _, _ in rows], ["t"] * len(rows))
        best = cheapest(rows)
        assert (cost, audit, turns) == (best[0], best[1], [f"{r}:{t}" for r, t in best[2]])


def test_against_a_plain_table(spark):
    rng = random.Random(2)
    rows = talk(rng, 80, 14, TEXTS) + [(None, None, "user", "A."), (None, None, "user", "A."), (None, 3, None, None), (900, None, "user", "B")]
    assert found(spark, rows) == brute(rows, plain_table)


def test_cut_conversations(spark, monkeypatch):
    """Conversations over several tasks and blocks, beside short ones."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    texts = TEXTS + [f"Sentence {i}." for i in range(300)]
    rows = talk(rng, 6, 6, texts)
    rows += [(50, t, rng.choice(("system", "user", "assistant")), rng.choice(texts)) for t in range(700)]
    rows += [(51, t // 3, rng.choice(("user", "assistant")), rng.choice(texts[:12])) for t in range(300)]
    assert found(spark, rows) == brute(rows, plain_table)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "x")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(spark, []) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_query_on_the_tables(spark):
    rows = [tuple(r) for r in table(prepare(spark), DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in repair.op12(spark, DATA).collect()), key=repr) == brute(rows, plain_table)
