"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation reads ``(s?(ua)+)?`` in role initials.  Four states follow that pattern: nothing
yet, after a system turn, after a user turn, after an assistant turn.  Each row is kept, given another
role or deleted, turns may be inserted before it, and what that costs between two states is an edge.
The cheapest way through a stretch of rows is found without a table of all its rows: forward costs of
the first half and backward costs of the second half, four numbers each, meet in the middle, and the
halves follow between the states that were crossed.

Among equally cheap ways the one whose edits spell the least string is wanted.  A forward vector
therefore also ranks the strings of its states: they hold equally many row edits and end in one, so
none begins another and the ranks decide whatever follows.

Rows are dealt out by range, so that a conversation of any length is spread over tasks.  One that lies
inside a task is repaired there.  Others are cut into blocks; a block is a matrix of costs and ranks
between states, which takes the place of a row in the same recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of that initial; the turn that an insertion or a new role makes.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
INITIALS = "sua?"
SOUND, TRUNCATED, UNFIT = range(3)
#: What is left to insert after the last row.
ENDS = {START: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: A block holds this many rows and characters at most, but one row at least.
BLOCK_ROWS, BLOCK_CHARS = 4_096, 1 << 18
#: Repeats that travel to the rows by broadcast; beyond that both sides are shuffled.
BROADCAST_REPEATS = 200_000

Edge = tuple[int, int, int, object]


def row_edges(initial: str, fault: int) -> list[Edge]:
    """(from, to, cost, edits): the best way from state to state over one row, insertions before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for inserted in range(3):
            ways = [(state, 3, "D")]
            if fault != UNFIT:
                ways.append((FOLLOWS[state][MADE[state]], 2 + (fault == TRUNCATED), "R"))
                if initial in FOLLOWS[state]:
                    ways.append((FOLLOWS[state][initial], int(fault == TRUNCATED), "K"))
            for to, cost, edit in ways:
                offer = 2 * inserted + cost, "I" * inserted + edit
                if (start, to) not in best or offer < best[start, to]:
                    best[start, to] = offer
            state = FOLLOWS[state][MADE[state]]
    return [(a, b, cost, edits) for (a, b), (cost, edits) in sorted(best.items())]


#: Edges of a row by its code: the initial's place in INITIALS, plus four times its fault.
EDGES = [row_edges(initial, fault) for fault in (SOUND, TRUNCATED, UNFIT) for initial in INITIALS]


def forward(items: list[list[Edge]], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least cost from ``start`` to each state over items lo to hi, and the ranks of the least edits that reach it so."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for at in range(lo, hi):
        best: list[tuple | None] = [None] * 4
        for a, b, more, edits in items[at]:
            if cost[a] < NEVER:
                offer = cost[a] + more, rank[a], edits
                if best[b] is None or offer < best[b]:
                    best[b] = offer
        reached = sorted((s for s in range(4) if best[s] is not None), key=lambda s: best[s][1:])
        cost, rank = [NEVER] * 4, [0] * 4
        for place, s in enumerate(reached):
            cost[s], rank[s] = best[s][0], place
    return cost, rank


def backward(items: list[list[Edge]], lo: int, hi: int, end: int) -> list[int]:
    """Least cost from each state to ``end`` over items lo to hi."""
    cost = [NEVER] * 4
    cost[end] = 0
    for at in range(hi - 1, lo - 1, -1):
        before = [NEVER] * 4
        for a, b, more, _ in items[at]:
            before[a] = min(before[a], cost[b] + more)
        cost = before
    return cost


def way(items: list[list[Edge]], start: int, end: int) -> list[tuple[int, int]]:
    """(from, to) of every item on the best way from ``start`` to ``end``; the recursion keeps no more than that."""
    found: list[tuple[int, int]] = []

    def solve(lo: int, hi: int, start: int, end: int) -> None:
        if hi - lo == 1:
            found.append((start, end))
            return
        mid = (lo + hi) // 2
        cost, rank = forward(items, lo, mid, start)
        rest = backward(items, mid, hi, end)
        crossing = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
        solve(lo, mid, start, crossing)
        solve(mid, hi, crossing, end)

    if items:
        solve(0, len(items), start, end)
    return found


def last_state(items: list[list[Edge]]) -> tuple[int, int]:
    """(cost, state after the last item) of the best way from the start to a repaired conversation."""
    cost, rank = forward(items, 0, len(items), START)
    end = min(range(4), key=lambda s: (cost[s] + ENDS[s][0], rank[s]))
    return cost[end] + ENDS[end][0], end


def edits_of(codes: bytes, start: int, end: int) -> str:
    items = [EDGES[c] for c in codes]
    label = [{(a, b): edits for a, b, _, edits in edges} for edges in EDGES]
    return "".join(label[c][step] for c, step in zip(codes, way(items, start, end)))


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if not codes:
        return 0, ""
    cost, end = last_state([EDGES[c] for c in codes])
    return cost, edits_of(codes, START, end) + ENDS[end][1]


repair_short = lru_cache(1 << 16)(repair)


def applied(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[str]:
    """``role:text`` of every turn that the edits leave."""
    turns, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        made = MADE[state]
        if edit == "I":
            turns.append(NAMES[made] + ":")
        else:
            turns.append(f"{roles[at] if edit == 'K' else NAMES[made]}:{texts[at]}")
            made = roles[at][:1] if edit == "K" else made
            at += 1
        state = FOLLOWS[state][made]
    return turns


class Stretch:
    """Neighbouring rows of one conversation and what is counted over them."""

    def __init__(self) -> None:
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        end = text.rstrip(SPACE)[-1:]
        if not end or repeated:
            fault = UNFIT
            self.counts["duplicate" if end else "blank"] += 1
        else:
            fault = SOUND if end in ".!?" else TRUNCATED
            self.counts["truncated"] += fault == TRUNCATED
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.last_turn:
            self.counts["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = INITIALS.find(role[:1]) if role and role[0] in "sua" else 3
        self.codes.append(4 * fault + initial)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def finished(self) -> tuple:
        codes = bytes(self.codes)
        cost, audit = repair_short(codes) if len(codes) <= 64 else repair(codes)
        text = "\n".join(applied(audit, self.roles, self.texts))
        n = self.counts
        gaps = self.last_turn - self.first_turn + 1 - n["turns"] if n["turns"] else 0
        return gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256(text.encode()).hexdigest()


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
#: A row is a repaired conversation, or a block (with a number) of one that is not whole in its task.
WORK = (f"conv_id long, {RESULT}, block long, codes binary, roles array<string>, texts array<string>, "
        "b_blank long, b_duplicate long, b_truncated long, b_illegal long, b_turns long, first_turn long, last_turn long")
WORK_NAMES = [c.split()[0] for c in WORK.split(", ")]
#: Arrow types of the columns of WORK.
_LONG, _TEXT = pa.int64(), pa.string()
WORK_TYPES = [_LONG, *[_LONG] * 6, _TEXT, _TEXT, _LONG, pa.binary(), pa.list_(_TEXT), pa.list_(_TEXT), *[_LONG] * 7]


def repaired_or_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their conversations to repaired conversations and blocks."""
    number = TaskContext.get().partitionId() << 32
    out: list[tuple] = []
    size = 0
    key, stretch, opened, before = None, None, False, None

    def block() -> tuple:
        nonlocal number
        number += 1
        s = stretch
        return (key[0], *[None] * 8, number, bytes(s.codes), s.roles, s.texts, *[s.counts[c] for c in COUNTS], s.first_turn, s.last_turn)

    def rows() -> pa.RecordBatch:
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out), WORK_TYPES)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, WORK_NAMES)

    def close(open_end: bool) -> None:
        out.append(block() if opened or open_end else (key[0], *stretch.finished(), *[None] * 11))

    for _, c in rows_of(batches):
        for conv, turn, role, text, copies, late in zip(c["conv_id"], c["turn"], c["role"], c["text"], c["copies"], c["late"]):
            if key != (conv,):
                if key is not None:
                    close(False)
                # The first conversation of a task may have begun in the one before.
                opened, stretch, before = key is None, Stretch(), None
                key = (conv,)
            for _ in range(copies):
                repeated = late or before == (turn, role, text)
                before = turn, role, text
                if len(stretch.codes) >= BLOCK_ROWS or stretch.codes and stretch.chars + len(text) > BLOCK_CHARS:
                    size += stretch.chars
                    out.append(block())
                    opened, stretch = True, Stretch()
                stretch.add(turn, role, text, repeated)
            if size > 8 * BLOCK_CHARS:
                yield rows()
                size = 0
        if len(out) > 4_096:
            yield rows()
            size = 0
    if key is not None:
        close(True)
    if out:
        yield rows()


def crossings(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one conversation with the states between which each is to be repaired, and the sums of all."""
    group = group.sort_values("block")
    filled = group[group.n_rows > 0]
    items = [[(i // 4, i % 4, c, r) for i, (c, r) in enumerate(zip(costs, ranks)) if c < NEVER]
             for costs, ranks in zip(filled.costs, filled.ranks)]
    cost, end = last_state(items) if items else (0, START)
    steps = dict(zip(filled.block, way(items, START, end)))
    known = filled[filled.b_turns > 0]
    distinct = int(known.b_turns.sum()) - sum(a == b for a, b in zip(known.last_turn.iloc[:-1], known.first_turn.iloc[1:]))
    gaps = int(known.last_turn.iloc[-1] - known.first_turn.iloc[0]) + 1 - distinct if len(known) else 0
    borders = sum(a + b not in LEGAL for a, b in zip(filled.last_initial.iloc[:-1], filled.first_initial.iloc[1:]))
    last = filled.block.iloc[-1] if len(filled) else -1
    return pd.DataFrame({
        "block": group.block,
        "s_in": [steps.get(b, (0, 0))[0] for b in group.block], "s_out": [steps.get(b, (0, 0))[1] for b in group.block],
        "last": [b == last for b in group.block], "gaps": gaps, "blank": int(filled.b_blank.sum()), "duplicate": int(filled.b_duplicate.sum()),
        "truncated": int(filled.b_truncated.sum()), "illegal": int(filled.b_illegal.sum()) + borders, "cost": cost,
    })


CROSSINGS = ("block long, s_in int, s_out int, last boolean, gaps long, blank long, duplicate long, truncated long, "
             "illegal long, cost long")


def block_matrix(codes: bytes) -> tuple[list[int], list[int]]:
    """Costs and ranks between all pairs of states, by 4 x from + to."""
    items = [EDGES[c] for c in codes]
    both = [forward(items, 0, len(items), s) for s in range(4)]
    return [c for cost, _ in both for c in cost], [r for _, rank in both for r in rank]


def repaired_blocks(work: DataFrame) -> DataFrame:
    """Results of the conversations that were cut into blocks."""
    blocks = work.where("block IS NOT NULL")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in rows_of(batches):
            found = [block_matrix(codes) for codes in c["codes"]]
            extra = [pa.array([len(codes) for codes in c["codes"]], pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int64())),
                     pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "n_rows", "costs", "ranks"])

    first = [F.coalesce(F.substring(F.element_at("roles", i), 1, 1), F.lit("")).alias(n) for i, n in ((1, "first_initial"), (-1, "last_initial"))]
    roles = F.when(F.size("roles") > 0, F.col("roles"))
    narrow = blocks.withColumn("roles", roles).select(
        "conv_id", "block", "codes", *first, *[f"b_{c}" for c in COUNTS], "first_turn", "last_turn")
    schema = ("conv_id long, block long, codes binary, first_initial string, last_initial string, b_blank long, b_duplicate long, b_truncated long, "
              "b_illegal long, b_turns long, first_turn long, last_turn long, n_rows long, costs array<long>, ranks array<long>")
    # A conversation sends a few numbers per block to one task, whatever its rows hold.
    decided = narrow.mapInArrow(matrices, schema).drop("codes").groupBy("conv_id").applyInPandas(crossings, CROSSINGS)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in rows_of(batches):
            audits, texts = [], []
            for codes, a, b, last, roles, said in zip(c["codes"], c["s_in"], c["s_out"], c["last"], c["roles"], c["texts"]):
                audit = edits_of(codes, a, b) + (ENDS[b][1] if last else "")
                audits.append(audit)
                turns = applied(audit, roles, said, a)
                texts.append("\n".join(turns).encode() if turns else None)
            kept = batch.select(["conv_id", "block", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(audits, pa.string()), pa.array(texts, pa.binary())],
                                             [*kept.schema.names, "audit", "piece"])

    joined = blocks.select("conv_id", "block", "codes", "roles", "texts").join(decided, "block")
    cut = joined.mapInArrow(pieces, "conv_id long, block long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                    "cost long, audit string, piece binary")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of a conversation takes its pieces one by one in their order."""
        key, sums, audit, digest, begun, out = None, None, [], None, False, []

        def close() -> None:
            out.append((key[0], *sums, "".join(audit), digest.hexdigest()))

        for _, c in rows_of(batches):
            for conv, *numbers, edits, piece in zip(*(c[n] for n in (
                    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "piece"))):
                if key != (conv,):
                    if key is not None:
                        close()
                    key, sums, audit, digest, begun = (conv,), numbers, [], hashlib.sha256(), False
                audit.append(edits)
                if piece is not None:
                    digest.update(b"\n" + piece if begun else piece)
                    begun = True
        if key is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*out), WORK_TYPES[:9])], WORK_NAMES[:9])

    ordered = cut.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(chained, f"conv_id long, {RESULT}")


def damaged(talk: DataFrame) -> DataFrame:
    """Rows as the contract of operator 12 damages them: dropped ones have no copies, repeated ones two."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return talk.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(talk: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``talk`` has (conv_id, turn, role, text, copies); rows with 0 copies count for nothing but keep their
    conversation in the result.  Rows go by turn, nulls first, then by role and text.  Null roles and
    texts count as one space; a role that begins with none of the three initials (an empty one too) must be
    given another or go.  Rows with a null conv_id are one conversation.  A conversation without rows
    gets zeros, an empty audit and the digest of an empty text; an empty table gives no rows.
    """
    rows = talk.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeats = cut_lineage(seen.where("first < last").select(
        F.col("conv_id").alias("r_conv"), F.col("role").alias("r_role"), F.col("digest").alias("r_digest"), "first"))
    few = repeats.count() <= BROADCAST_REPEATS
    same = rows["conv_id"].eqNullSafe(F.col("r_conv")) & (rows["role"] == F.col("r_role")) & (rows["digest"] == F.col("r_digest"))
    late = F.coalesce(F.col("first") < place, F.lit(False))
    flagged = rows.join(F.broadcast(repeats) if few else repeats, same, "left").withColumn("late", late)
    flagged = flagged.select("conv_id", "turn", "role", "text", "copies", "late")
    order: list[Column] = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = flagged.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, F.asc("text"))
    work = cut_lineage(dealt.mapInArrow(repaired_or_cut, WORK))
    whole = work.where("block IS NULL").select("conv_id", *[c.split()[0] for c in RESULT.split(", ")])
    return whole.unionByName(repaired_blocks(work))


@query("op12_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
