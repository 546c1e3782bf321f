"""Minimum-cost role repair of conversations, then rendering.

Legal sequences: an optional system turn, then user and assistant in turn, the last
turn the assistant's.  For each turn, in order, the repair keeps it, gives it another
role, or merges it into the turn before; before a turn and at the end it may insert
empty turns.  A shortest path over the automaton's states finds the cheapest repair.

Costs form (min, +) matrices over the states, so a conversation can be cut anywhere:
every partition of the sorted turns gives one matrix for the conversations at its
edges, the matrices are chained, and each piece is then repaired between known states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
#: Turns that may follow each state, and the states a conversation may end in.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (ASSISTANT,)
#: Costs: merging a turn into one of its own role, giving another role, inserting an empty
#: turn.  A turn of no known role must be given one, or merged at the cost of both.
MERGE, RELABEL, INSERT = 2, 5, 4
FAR = 1 << 40


def _inserts() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """Cheapest insertions from state to state, and the turns they insert."""
    cost = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    way: list[list[tuple[int, ...]]] = [[() for _ in range(4)] for _ in range(4)]
    for a in range(4):
        front = [(0, a, ())]
        while front:
            c, s, turns = front.pop(0)
            for t in NEXT[s]:
                if t != a and c + INSERT < cost[a][t]:
                    cost[a][t], way[a][t] = c + INSERT, (*turns, t)
                    front.append((c + INSERT, t, (*turns, t)))
    return cost, way


INSERT_COST, INSERT_WAY = _inserts()


def step_choices(role: str | None) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """[state before][state after]: (cost, action, turns inserted before), the cheapest."""
    own = ROLES.get((role or "").strip().lower())
    out = [[(FAR, "", ()) for _ in range(4)] for _ in range(4)]
    for a in range(4):
        for mid in range(4):
            if INSERT_COST[a][mid] >= FAR:
                continue
            for b in NEXT[mid]:
                cost = INSERT_COST[a][mid] + (0 if b == own else RELABEL)
                if cost < out[a][b][0]:
                    out[a][b] = cost, "keep" if b == own else "relabel", INSERT_WAY[a][mid]
        if a != START:
            cost = MERGE + (0 if a == own else RELABEL)
            if cost < out[a][a][0]:
                out[a][a] = cost, "merge", ()
    return out


_CHOICES = {r: step_choices(r) for r in (*ROLES, None)}
_COSTS = {r: np.array([[c[0] for c in row] for row in t], np.int64) for r, t in _CHOICES.items()}


def known(role: str | None) -> str | None:
    r = (role or "").strip().lower()
    return r if r in ROLES else None


def piece_matrix(roles: list[str | None]) -> np.ndarray:
    """(min, +) product of the turns' cost matrices."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        total = np.minimum((total[:, :, None] + _COSTS[known(r)][None]).min(axis=1), FAR)
    return total


def end_costs() -> np.ndarray:
    return np.array([min(INSERT_COST[a][e] for e in ENDS) for a in range(4)], np.int64)


def repair_piece(roles: list[str | None], begin: int = START, end: int | None = None) -> tuple[int, list[tuple[int, str, tuple[int, ...]]], tuple[int, ...]]:
    """Cheapest repair of turns from state ``begin``: (cost, per turn (state, action,
    inserted before), inserted at the end).  ``end``: the state to arrive in, None: any
    legal end.  Ties go to the lower state."""
    n = len(roles)
    best = np.full((n + 1, 4), FAR, np.int64)
    best[0, begin] = 0
    back = np.zeros((n, 4), np.int8)
    for i, r in enumerate(roles):
        sums = best[i][:, None] + _COSTS[known(r)]
        back[i] = sums.argmin(axis=0)
        best[i + 1] = np.minimum(sums.min(axis=0), FAR)
    tail: tuple[int, ...] = ()
    if end is None:
        state = int((best[n] + end_costs()).argmin())
        goal = min(ENDS, key=lambda e: INSERT_COST[state][e])
        cost, tail = int(best[n, state]) + INSERT_COST[state][goal], INSERT_WAY[state][goal]
    else:
        state, cost = end, int(best[n, end])
    path = []
    for i in range(n - 1, -1, -1):
        before = int(back[i, state])
        _, action, inserted = _CHOICES[known(roles[i])][before][state]
        path.append((state, action, inserted))
        state = before
    return cost, path[::-1], tail


def render_turn(state: int, action: str, inserted: tuple[int, ...], text: str, first: bool) -> str:
    """The turn's part of the rendered conversation; the parts of a conversation, one
    after the other, are its rendering.  Every part closes what it opens but leaves the
    turn's own end to the part that follows, as that may merge into it."""
    out = []
    if action != "merge":
        if not first:
            out.append("<|end|>\n")
        out += [f"<|{NAMES[t]}|>\n<|end|>\n" for t in inserted]
        out.append(f"<|{NAMES[state]}|>\n{text}")
    else:
        out.append(f"\n{text}")
    return "".join(out)


def render_end(tail: tuple[int, ...]) -> str:
    return "<|end|>\n" + "".join(f"<|{NAMES[t]}|>\n<|end|>\n" for t in tail)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repair every conversation; one row per input turn.

    Returns conv, turn, role, position (order in the conversation), new_role, action
    (keep, relabel, merge), inserted (roles put before the turn), closing (roles put
    after the last turn), cost (of the turn, with what is inserted), rendered (its part
    of the rendered conversation).  The parts in order of position are the rendering.

    Turns are ordered by turn number, then role and text, nulls first; repeated rows
    are turns of their own.  Null texts are empty, null or unknown roles must be given a
    role.  Rows with a null conversation form one conversation.  A conversation of any
    length is spread over partitions: only costs, never its turns, come together.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "text"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = durable(dealt, "sorted-turns")
    # a reader may cut or join files: every piece is brought back whole, in order
    dealt = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", *order)
    conv_type, turn_type = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        """((part, conv), rows) of every stretch of one conversation in one part."""
        name, held = None, []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("part", "conv", "turn", "role", "text")), strict=True):
                if held and r[:2] != name:
                    yield name, held
                    held = []
                name = r[:2]
                held.append(r)
        if held:
            yield name, held

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last piece of every part: only these can go on elsewhere."""
        part, conv, data, count, edge = [], [], [], [], []
        last = None
        for (p, c), held in pieces_of_roles(batches):
            if last is None or last[0] != p:
                if last and last[0] != p:
                    edge[-1] = True
                keep = True
            else:
                keep = False
            if part and part[-1] == p and not edge[-1]:
                # the piece before was inside its part
                for col in (part, conv, data, count, edge):
                    col.pop()
            part.append(p)
            conv.append(c)
            data.append(held[0].reshape(-1).tolist())
            count.append(held[1])
            edge.append(keep)
            last = (p, c)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(conv, conv_arrow), pa.array(data, pa.list_(pa.int64())), pa.array(count, pa.int64())], ["part", "conv", "costs", "n"])

    def pieces_of_roles(batches: Iterator[pa.RecordBatch]):
        name, matrix, n = None, None, 0
        for b in batches:
            for p, c, r in zip(*(b.column(x).to_pylist() for x in ("part", "conv", "role")), strict=True):
                if name is not None and (p, c) != name:
                    yield name, (matrix, n)
                    matrix = None
                if matrix is None:
                    matrix, n = piece_matrix([]), 0
                name = p, c
                matrix = np.minimum((matrix[:, :, None] + _COSTS[known(r)][None]).min(axis=1), FAR)
                n += 1
        if name is not None:
            yield name, (matrix, n)

    from pyspark.sql.pandas.types import to_arrow_type

    conv_arrow = to_arrow_type(rows.schema["conv"].dataType)
    turn_arrow = to_arrow_type(rows.schema["turn"].dataType)
    ends = dealt.select("part", "conv", "role").mapInArrow(costs, f"part int, conv {conv_type}, costs array<long>, n long").collect()
    chains: dict[object, list] = {}
    for r in sorted(ends, key=lambda r: r["part"]):
        chains.setdefault(r["conv"], []).append(r)
    borders: dict[tuple, tuple[int, int | None, int]] = {}
    for name, chain in chains.items():
        if len(chain) < 2:
            continue
        mats = [np.array(r["costs"], np.int64).reshape(4, 4) for r in chain]
        ahead = [end_costs()]
        for m in reversed(mats):
            ahead.append(np.minimum((m + ahead[-1][None]).min(axis=1), FAR))
        ahead.reverse()
        state, before = START, 0
        for i, (r, m) in enumerate(zip(chain, mats, strict=True)):
            to = int((m[state] + ahead[i + 1]).argmin())
            borders[(r["part"], name)] = state, None if i == len(chain) - 1 else to, before
            state, before = to, before + r["n"]
    shared = spark.sparkContext.broadcast(borders)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "turn", "role", "position", "new_role", "action", "inserted", "closing", "cost", "rendered"]
        kinds = [conv_arrow, turn_arrow, pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string()]
        cols: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            for c in cols:
                c.clear()
            return out

        size = 0
        for name, held in pieces(batches):
            begin, end, skip = shared.value.get(name, (START, None, 0))
            _, path, tail = repair_piece([r[3] for r in held], begin, end)
            state = begin
            for i, (r, (to, action, inserted)) in enumerate(zip(held, path, strict=True)):
                closing = tail if i == len(held) - 1 and end is None else ()
                body = render_turn(to, action, inserted, r[4], skip + i == 0)
                if i == len(held) - 1 and end is None:
                    body += render_end(tail)
                cost = _CHOICES[known(r[3])][state][to][0] + INSERT * len(closing)
                for col, v in zip(cols, (r[1], r[2], r[3], skip + i, NAMES[to], action, [NAMES[t] for t in inserted], [NAMES[t] for t in closing], cost, body), strict=True):
                    col.append(v)
                state = to
                size += len(body) + 100
            if size > 4 << 20:
                yield flush()
                size = 0
        yield flush()

    out = dealt.mapInArrow(repair, f"conv {conv_type}, turn {turn_type}, role string, position long, new_role string, action string, inserted array<string>, closing array<string>, cost long, rendered string")
    return out.withColumnsRenamed({"conv": conv, "turn": turn, "role": role})
