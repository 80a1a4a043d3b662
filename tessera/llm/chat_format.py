"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, at its start, then user and assistant in turn, and ends with the
assistant. Every turn of a conversation keeps its role or is relabelled, and it opens a message or is merged into the
one before; empty messages may be inserted where one is missing. The cheapest sequence of such choices is a shortest
path through the automaton of legal turns, found by dynamic programming, and the repaired conversation is rendered.

Costs of a stretch of turns form a matrix (state before, state after) under (min, +), which is associative. So
conversations are range-partitioned by (conversation, turn), one may span any number of tasks, and only the stretches
at the edges of partitions, two matrices a partition, meet on the driver. Each row comes back as a fragment of the
rendering with its place in the conversation; fragments by place make up the conversation, so no conversation has to
fit into one row. rendered() puts them together, PAGE turns to a row.

A text can't open or close a turn: between `<` and `|` it gets a backslash more than it has, which unescaped() takes
away again.

Nulls: a null text is empty, a null or unknown role is relabelled, a null turn comes first, and null conversation
ids form one conversation. Ties of (conv_id, turn) follow role and text; repeated rows are merged like any others.
Equal-cost repairs are settled by the order of roles. An empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, written

ROLES = ("system", "user", "assistant")
#: The state before any turn; otherwise the role of the last message.
START = 3
MERGE, INSERT = 2, 3
FAR = 1 << 40
#: Cost of giving a turn another role: by the role it has (None: unknown), to each of ROLES.
RELABEL = {"system": (0, 4, 6), "user": (5, 0, 4), "assistant": (6, 4, 0), None: (4, 1, 1)}
OPEN, CLOSE, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"
#: Turns in one row of rendered().
PAGE = 10_000
_MARKER = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Messages to insert before one of a role, by the state before; None: not allowed.
BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, 0): (), (START, 1): (), (START, 2): (1,),
    (0, 1): (), (0, 2): (1,),
    (1, 2): (), (1, 1): (2,),
    (2, 1): (), (2, 2): (1,),
}
#: Messages to insert at the end.
ENDING = {START: (), 0: (1, 2), 1: (2,), 2: ()}


def moves(role: str | None) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(state before, state after, cost, merged, inserted) for a turn of this role."""
    given = RELABEL.get(role, RELABEL[None])
    found = [(a, b, given[b] + INSERT * len(put), False, put) for (a, b), put in BETWEEN.items()]
    return found + [(b, b, given[b] + MERGE, True, ()) for b in range(3)]


MOVES = {r: moves(r) for r in (*ROLES, None)}


def _best(role: str | None) -> dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]]:
    found: dict = {}
    for a, b, cost, merged, put in MOVES[role]:
        if (a, b) not in found or cost < found[a, b][0]:
            found[a, b] = (cost, merged, put)
    return found


BEST = {r: _best(r) for r in MOVES}


def identity() -> list[list[int]]:
    return [[0 if i == j else FAR for j in range(4)] for i in range(4)]


def extend(m: list[list[int]], role: str | None) -> list[list[int]]:
    out = [[FAR] * 4 for _ in range(4)]
    for (a, b), (cost, _, _) in BEST[role].items():
        for i in range(4):
            if (c := m[i][a] + cost) < out[i][b]:
                out[i][b] = c
    return out


def solve(roles: list[str | None], before: int, after: int | None) -> tuple[int, list[tuple[int, bool, tuple[int, ...], int]]]:
    """Cost and (new role, merged, inserted, cost) of each turn on the cheapest path; after=None: to the end."""
    cost = [FAR] * 4
    cost[before] = 0
    back = []
    for role in roles:
        step, came = [FAR] * 4, [0] * 4
        for (a, b), (c, _, _) in BEST[role].items():
            if cost[a] + c < step[b]:
                step[b], came[b] = cost[a] + c, a
        cost = step
        back.append(came)
    ends = [c + (INSERT * len(ENDING[s]) if after is None else 0 if s == after else FAR) for s, c in enumerate(cost)]
    state = min(range(4), key=lambda s: ends[s])
    total, found = ends[state], []
    for role, came in zip(reversed(roles), reversed(back)):
        a = came[state]
        c, merged, put = BEST[role][a, state]
        found.append((state, merged, put, c))
        state = a
    return total, found[::-1]


def escaped(text: str) -> str:
    """The text without anything that reads as a marker."""
    return _MARKER.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def fragments(texts: list[str | None], choices: list, first: bool, last: bool) -> list[str]:
    """Each turn's part of the rendering. A message is closed by what follows it."""
    out = []
    for i, (text, (role, merged, put, _)) in enumerate(zip(texts, choices)):
        if merged:
            part = JOIN
        else:
            empty = "".join(OPEN.format(role=ROLES[r]) + CLOSE for r in put)
            part = ("" if first and i == 0 else CLOSE) + empty + OPEN.format(role=ROLES[role])
        out.append(part + escaped(text or ""))
    if last and out:
        out[-1] += CLOSE + "".join(OPEN.format(role=ROLES[r]) + CLOSE for r in ENDING[choices[-1][0]])
    return out


COLUMNS = ["conv_id", "turn", "role", "text", "part", "side", "seq", "new_role", "merged", "inserted", "cost", "fragment", "costs"]


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, merged, inserted (messages before or, at the end, after), cost, fragment, and
    seq, the place in the conversation, from 0."""
    spark = turns.sparkSession
    kind = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role", "text")}
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string, part int, side int, seq bigint, new_role string, merged boolean, inserted int, cost bigint, fragment string, costs array<bigint>"

    def known(role):
        return role if role in ROLES else None

    def batch(rows, types):
        import pyarrow as pa

        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=COLUMNS)

    def types_of(ids, turn):
        import pyarrow as pa

        return [ids, turn, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def answer(rows, part, first, last, before, after, base=0):
        """Rows (conv_id, turn, role, text, seq) of a stretch with their choices. base: turns before the stretch."""
        _, choices = solve([known(r[2]) for r in rows], before, after)
        shown = fragments([r[3] for r in rows], choices, first, last)
        for i, (r, (state, merged, put, cost), text) in enumerate(zip(rows, choices, shown)):
            tail = ENDING[state] if last and i == len(rows) - 1 else ()
            yield (r[0], r[1], r[2], None, part, None, base + i, ROLES[state], merged, len(put) + len(tail), cost + INSERT * len(tail), text, None)

    def open_stretch(rows, part, side):
        m = identity()
        for r in rows:
            m = extend(m, known(r[2]))
        for i, r in enumerate(rows):
            # with the first row, the matrix and the number of turns
            yield (*r[:4], part, side, r[4], None, None, None, None, None, [*(c for line in m for c in line), len(rows)] if i == 0 else None)

    def first_pass(batches):
        """Conversations inside a partition are done; the first and the last may go on in a neighbour and stay open."""
        from pyspark import TaskContext

        part, seq, rows, done, types, side = TaskContext.get().partitionId(), 0, [], [], None, 0
        for b in batches:
            types = types or types_of(b.column(0).type, b.column(1).type)
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns[:4])):
                if rows and rows[0][0] != conv:
                    done += open_stretch(rows, part, 0) if side == 0 else answer(rows, part, True, True, START, None)
                    side, rows = 1, []
                rows.append((conv, turn, role, text, seq))
                seq += 1
                if len(done) >= 2000:
                    yield batch(done, types)
                    done = []
        if rows:
            done += open_stretch(rows, part, side)
        if done:
            yield batch(done, types)

    wanted = turns.select("conv_id", "turn", "role", "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text").asc(), F.col("salt").asc()]
    # equal rows may go to any task: a salt lets the ranges cut through them
    salted = wanted.withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    table = written(in_arrow(ranged, first_pass, schema), "chat-turns")

    # two stretches a partition at most
    edges = table.where("costs is not null").select("part", "side", "conv_id", "costs").orderBy("part", "side").collect()
    ends: dict[tuple[int, int], tuple[bool, bool, int, int | None, int]] = {}
    chain: list = []
    for i, e in enumerate(edges):
        chain.append(e)
        if i + 1 < len(edges) and edges[i + 1]["conv_id"] == e["conv_id"]:
            continue
        # forward over the chain's matrices, then back along the cheapest states
        ahead = [[FAR] * 4]
        ahead[0][START] = 0
        for s in chain:
            m, last = s["costs"], ahead[-1]
            ahead.append([min(last[a] + m[4 * a + b] for a in range(4)) for b in range(4)])
        state = min(range(4), key=lambda s: ahead[-1][s] + INSERT * len(ENDING[s]))
        base = [0, *accumulate(s["costs"][16] for s in chain)]
        for n in range(len(chain) - 1, -1, -1):
            m = chain[n]["costs"]
            came = min(range(4), key=lambda a: ahead[n][a] + m[4 * a + state])
            ends[chain[n]["part"], chain[n]["side"]] = (n == 0, n == len(chain) - 1, came, None if n == len(chain) - 1 else state, base[n])
            state = came
        chain = []
    shared = spark.sparkContext.broadcast(ends)

    def second_pass(key, t):
        import pyarrow as pa

        part, side = key[0].as_py(), key[1].as_py()
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seq"))), key=lambda r: r[4])
        first, last, before, after, base = shared.value[part, side]
        return pa.Table.from_batches([batch(list(answer(rows, part, first, last, before, after, base)), types_of(t.column("conv_id").type, t.column("turn").type))])

    rest = table.where("side is not null").groupBy("part", "side").applyInArrow(lambda key, t: second_pass(key, t), schema)
    out = table.where("side is null").unionByName(rest)
    return out.select("conv_id", "turn", "role", "new_role", "merged", "inserted", "cost", "fragment", "seq")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, page, n_turns, cost, text: each conversation as one text, or as several of PAGE turns, to be joined in
    the order of pages."""
    found = formatted(turns).withColumn("page", F.floor(F.col("seq") / PAGE))
    parts = F.sort_array(F.collect_list(F.struct("seq", "fragment")))
    return found.groupBy("conv_id", "page").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["fragment"]), "").alias("text"))
