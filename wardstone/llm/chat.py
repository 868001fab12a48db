"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation from a user turn to an
assistant turn. Dynamic programming over that automaton chooses for every turn the cheapest of: keep its role (0), merge it
into the turn before (1 with the same role, 4 with another), give it another role (3); an empty turn of the missing role
may be inserted before it, or at the end (2 each). Equal costs are settled by that order, then by the lower state.

A step of the program is a (min, +) matrix over the four states, so conversations are cut into chunks of bounded size
whose matrices are multiplied: rows are ordered by ranges of (conversation, turn), each chunk is up to 512 neighbouring turns
of one conversation in one range. Matrices of up to 4,096 neighbouring chunks are multiplied in one place and only their
product, 16 numbers for up to two million turns, meets the conversation's others; the states that are chosen between products
are then handed down to the chunks. A conversation with a third of all turns is thus spread like any other.

Results: one row for each turn, in order, with what happens to it and the piece of the rendered conversation that it adds;
the pieces of a conversation, joined, are its rendering. Turns are ordered by number, role and text; null numbers come
first. A null conversation id is one conversation. A null text is empty; a null or unknown role must be changed or
merged. Repeated rows are turns of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
MERGE, MERGE_OTHER, RELABEL, INSERT = 1, 4, 3, 2
FAR = 1 << 40
CHUNK_TURNS, CHUNK_CHARS = 512, 1 << 20
GROUP = 12  # bits: chunks whose matrices are multiplied in one place


def _after(state: int, role: int) -> bool:
    """Whether a turn of this role may follow the state."""
    return (role == SYSTEM and state == START) or (role == USER and state != USER) or (role == ASSISTANT and state == USER)


def _steps(role: int) -> list[tuple[int, int, int, str, int]]:
    """All (state, next state, cost, action, inserted role) for a turn, in the order that settles equal costs."""
    out = []
    for state in range(4):
        if state != START:
            out.append((state, state, MERGE if state == role else MERGE_OTHER, "merge", 0))
        for new in (SYSTEM, USER, ASSISTANT):
            cost, action = (0, "keep") if new == role else (RELABEL, "relabel")
            if _after(state, new):
                out.append((state, new, cost, action, 0))
            for extra in (USER, ASSISTANT):
                if _after(state, extra) and _after(extra, new):
                    out.append((state, new, cost + INSERT, action, extra))
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    return sorted(out, key=lambda x: (bool(x[4]), rank[x[3]], x[0]))


STEPS = [_steps(r) for r in range(4)]
MATRICES = np.full((4, 4, 4), FAR, np.int64)
for _r in range(4):
    for _s, _n, _c, _, _ in STEPS[_r]:
        MATRICES[_r, _s, _n] = min(MATRICES[_r, _s, _n], _c)
#: Cost and inserted roles that end a conversation, by state.
ENDS = {START: (0, []), SYSTEM: (2 * INSERT, [USER, ASSISTANT]), USER: (INSERT, [ASSISTANT]), ASSISTANT: (0, [])}


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def product(roles: list[int]) -> np.ndarray:
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for r in roles:
        out = (out[:, :, None] + MATRICES[r][None]).min(axis=1)
    return np.minimum(out, FAR)


def multiplied(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).min(axis=1)
    return np.minimum(out, FAR)


def plan(matrices: list[np.ndarray], entry: int = START, leave: int | None = None) -> list[tuple[int, int]]:
    """Entry and exit states of neighbouring chunks, from one state to another or to the cheapest end of a conversation."""
    cost = np.full(4, FAR, np.int64)
    cost[entry] = 0
    entries = [cost]
    for m in matrices:
        entries.append((entries[-1][:, None] + m).min(axis=0))
    end = min(range(4), key=lambda s: (entries[-1][s] + ENDS[s][0], s)) if leave is None else leave
    out = []
    for m, before in zip(reversed(matrices), reversed(entries[:-1]), strict=True):
        begin = min(range(4), key=lambda s: (before[s] + m[s, end], s))
        out.append((begin, end))
        end = begin
    return out[::-1]


def repair(roles: list[int], entry: int, exit: int) -> list[tuple[int, int, int, str, int]]:
    """The chosen step of every turn on the cheapest way from one state to the other."""
    cost = [[FAR] * 4]
    cost[0][entry] = 0
    for r in roles:
        now = [FAR] * 4
        for s, n, c, _, _ in STEPS[r]:
            if cost[-1][s] + c < now[n]:
                now[n] = cost[-1][s] + c
        cost.append(now)
    out, state = [], exit
    for i in range(len(roles) - 1, -1, -1):
        step = next(x for x in STEPS[roles[i]] if x[1] == state and cost[i][x[0]] + x[2] == cost[i + 1][state])
        out.append(step)
        state = step[0]
    return out[::-1]


def opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "<|end|>\n"


def pieces(texts: list[str], steps: list[tuple[int, int, int, str, int]], last: bool) -> list[str]:
    out = []
    for text, (state, new, _, action, extra) in zip(texts, steps, strict=True):
        if action == "merge":
            out.append("\n" + text)
        else:
            out.append((CLOSED if state != START else "") + (opened(extra) + CLOSED if extra else "") + opened(new) + text)
    if last and out:
        out[-1] += CLOSED + "".join(opened(r) + CLOSED for r in ENDS[steps[-1][1]][1])
    return out


CHUNKS = "conv long, chunk long, turns array<long>, roles array<string>, texts array<string>, matrix array<long>"
TURNS = "conv_id long, position long, turn long, role string, action string, new_role string, inserted string, inserted_after string, cost long, rendered string"


def chunked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Chunks of every conversation in order; chunk numbers rise with the order of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            conv, *columns = zip(*rows, strict=True)
            matrix = product([role_number(r) for r in columns[1]]).ravel().tolist()
            values = [[conv[0]], [number], *[[list(c)] for c in columns], [matrix]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
            number, size = number + 1, 0
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and (row[0] != rows[-1][0] or len(rows) >= CHUNK_TURNS or size >= CHUNK_CHARS):
                    yield flush()
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush()

    order = ["conv", "turn", "role", "text"]
    named = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    # equal rows may be many: their place in the input parts them between ranges, and any order of theirs is right
    dealt = named.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, "place").sortWithinPartitions(*order)
    return stored(dealt.select(*order).mapInArrow(run, CHUNKS))


def formatted(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn, with its repair and the piece of the rendering that it adds."""
    chunks = chunked(turns, conv_col, turn_col, role_col, text_col)
    together = F.array_sort(F.collect_list(F.struct("chunk", F.size("turns").alias("n"), "matrix"))).alias("all")
    groups = stored(chunks.groupBy("conv", F.shiftright("chunk", GROUP).alias("group")).agg(together, F.min("chunk").alias("first")))
    square = lambda m: np.array(m, np.int64).reshape(4, 4)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [multiplied([square(r["matrix"]) for r in rows]).ravel().tolist() for rows in df["all"]]
            yield pd.DataFrame({"conv": df["conv"].astype("Int64"), "first": df["first"], "n": [sum(r["n"] for r in rows) for rows in df["all"]], "matrix": found})

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """States between the groups of a conversation."""
        for df in batches:
            out = []
            for rows in df["all"]:
                at = 0
                for i, (r, (begin, end)) in enumerate(zip(rows, plan([square(r["matrix"]) for r in rows]), strict=True)):
                    out.append((r["first"], begin, end, at, i == len(rows) - 1))
                    at += r["n"]
            yield pd.DataFrame(out, columns=["first", "begin", "stop", "offset", "final"])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """States between the chunks of a group."""
        for df in batches:
            out = []
            for rows, begin, stop, at, final in zip(df["all"], df["begin"], df["stop"], df["offset"], df["final"], strict=True):
                for i, (r, way) in enumerate(zip(rows, plan([square(r["matrix"]) for r in rows], begin, stop), strict=True)):
                    out.append((r["chunk"], *way, at, bool(final) and i == len(rows) - 1))
                    at += r["n"]
            yield pd.DataFrame(out, columns=["chunk", "begin", "stop", "offset", "final"])

    up = groups.mapInPandas(products, "conv long, first long, n long, matrix array<long>")
    top = up.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "n", "matrix"))).alias("all"))
    chosen = top.select("all").mapInPandas(between, "first long, begin int, stop int, offset long, final boolean")
    ways = groups.join(chosen, "first").select("all", "begin", "stop", "offset", "final").mapInPandas(within, "chunk long, begin int, stop int, offset long, final boolean")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TURNS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 5 + [pa.int64(), pa.string()]
        for b in batches:
            for conv, numbers, roles, texts, begin, stop, offset, final in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                steps = repair([role_number(r) for r in roles], begin, stop)
                shown = pieces(texts, steps, final)
                n = len(steps)
                after = [""] * n
                costs = [x[2] for x in steps]
                if final:
                    after[-1] = ",".join(ROLES[r] for r in ENDS[steps[-1][1]][1])
                    costs[-1] += ENDS[steps[-1][1]][0]
                columns = [[conv] * n, range(offset, offset + n), numbers, roles, [x[3] for x in steps], [ROLES[x[1]] for x in steps], [ROLES[x[4]] for x in steps], after, costs, shown]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    both = chunks.drop("matrix").join(ways, "chunk").select("conv", "turns", "roles", "texts", "begin", "stop", "offset", "final")
    return both.mapInArrow(repaired, TURNS)


def query(turns: DataFrame) -> DataFrame:
    return formatted(turns)
