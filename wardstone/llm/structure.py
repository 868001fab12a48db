"""Conversation structure repair: cheapest edits to a legal sequence of turns, the least of equal edit scripts by ranks.

A legal sequence is empty, or an optional system turn and pairs of a user's and an assistant's turn. Edits: keep a turn,
give it the role user or assistant, delete it (blank and repeated turns have to go), insert an empty turn. The audit is the
string of the edits' initials in order; of the cheapest scripts that with the least audit is taken.

1. Turns are ordered by conversation, turn (nulls first), role and text, and cut into chunks of bounded size. Most
   conversations lie within one chunk and need no shuffle after that one.
2. A step of the cost program is a (min, +) matrix over four states. For conversations of several chunks the chunks' matrices
   stream past in order, from the end, and leave each chunk the costs of all that follows; no conversation is held at once.
3. Within a chunk every arc that lies on a cheapest way is a node. Nodes are ranked by their label, then by the audits of
   length two, four, eight and so on that begin with them: the rank of a pair of ranks, the second one found through a
   pointer that doubles its reach each round. A state and a label lead to one state only, so nodes of equal rank have the same
   audit, and the least node of a state begins its least audit. Doubled pointers give the nodes on the way.
4. A chunk thereby maps entry states to exit states; the maps stream past from the beginning and give each chunk its entry.

A turn repeats an earlier one of its role and text; across chunks, the first chunk of each (by SHA-256) is found by an
aggregate that has one row for each chunk and digest.

Null roles and texts count as one space; a null conversation id is a conversation, a null turn number comes first and is in
no gap. Roles are known by their first letter. Rows of equal number are turns of their own. Other columns are ignored. A hash
over a whole conversation reads it in order, a chunk at a time: one conversation's is one task's, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = ["", "system", "user", "assistant"]
#: The only role that may be given or inserted after a state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
#: Edits that end a conversation after each state, and what they cost.
ENDS = [0, 2, 1, 0]
END_COSTS = np.array([INSERT * n for n in ENDS], np.int64)
FINE, BLANK, DUPLICATE, CUT = range(4)
LABELS = " DIKR"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_TURNS, CHUNK_CHARS = 512, 1 << 20


def allowed(state: int, role: int) -> bool:
    return role == SYSTEM and state == START or role in (USER, ASSISTANT) and NEXT[state] == role


def _row(kind: int, fault: int) -> np.ndarray:
    """Cheapest cost from state to state of one turn, with the insertions before it."""
    inserts = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        inserts[s, s] = 0
        inserts[s, NEXT[s]] = INSERT
        again = NEXT[NEXT[s]]
        inserts[s, again] = min(inserts[s, again], 2 * INSERT)
    edits = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        edits[s, s] = DELETE
        if fault in (FINE, CUT):
            extra = TRUNCATED * (fault == CUT)
            edits[s, NEXT[s]] = min(edits[s, NEXT[s]], REROLE + extra)
            if kind and allowed(s, kind):
                edits[s, kind] = min(edits[s, kind], extra)
    return (inserts[:, :, None] + edits[None]).min(axis=1)


ROWS = np.array([[_row(k, f) for f in range(4)] for k in range(4)])


def matrix_of(kinds: np.ndarray, faults: np.ndarray) -> np.ndarray:
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for m in ROWS[kinds, faults]:
        out = (out[:, :, None] + m[None]).min(axis=1)
    return np.minimum(out, FAR)


def costs(kinds: np.ndarray, faults: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost of all that follows, for every place between turns and every state."""
    out = np.empty((len(kinds) + 1, 4), np.int64)
    out[-1] = after
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = (ROWS[kinds[i], faults[i]] + out[i + 1]).min(axis=1)
    return out


class Ways:
    """Least cheapest scripts of many chunks at once: (kinds, faults, costs of what follows) of each.

    Node 4 * place + state stands for a state at a place between turns; places of all chunks follow each other. Arcs leave a
    node by deleting, inserting, keeping or giving a role, where that is on a cheapest way. The last place of a chunk has an
    arc to itself for every state, without a label, which ends all scripts.
    """

    def __init__(self, chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        sizes = np.array([len(k) for k, _, _ in chunks])
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        togo = np.concatenate([costs(*c) for c in chunks])
        places = len(togo)
        kinds, faults, inner = np.zeros(places, np.int64), np.zeros(places, np.int64), np.ones(places, bool)
        inner[self.begin + sizes] = False
        kinds[inner] = np.concatenate([k for k, _, _ in chunks])
        faults[inner] = np.concatenate([f for _, f, _ in chunks])
        place, state = (x.ravel() for x in np.meshgrid(np.arange(places), np.arange(4), indexing="ij"))
        now, kind, extra = togo.ravel(), kinds[place], TRUNCATED * (faults[place] == CUT)
        after = togo[np.minimum(place + 1, places - 1)]
        follows, stays = inner[place], (faults[place] == FINE) | (faults[place] == CUT)
        fits = np.array([[allowed(s, k) for k in range(4)] for s in range(4)])[state, kind]
        pick = np.arange(len(place))
        arcs = [
            (1, 4 * (place + 1) + state, follows & (now == DELETE + after[pick, state])),
            (2, 4 * place + NEXT[state], follows & (now == INSERT + togo[place, NEXT[state]])),
            (3, 4 * (place + 1) + kind, follows & stays & fits & (now == extra + after[pick, kind])),
            (4, 4 * (place + 1) + NEXT[state], follows & stays & (now == REROLE + extra + after[pick, NEXT[state]])),
            (0, pick, ~follows),
        ]
        self.source = np.concatenate([pick[ok] for _, _, ok in arcs])
        self.target = np.concatenate([to[ok] for _, to, ok in arcs])
        self.label = np.concatenate([np.full(int(ok.sum()), n) for n, _, ok in arcs])
        self._rank(len(pick))

    def _rank(self, nodes: int) -> None:
        rank = self.label.copy()
        self.first = np.zeros(nodes, np.int64)
        order = np.lexsort((rank, self.source))[::-1]
        self.first[self.source[order]] = order  # the least arc of each node is written last
        jump = self.first[self.target]
        self.jumps = [jump]
        while True:
            rank = np.unique(rank * (len(rank) + 5) + rank[jump], return_inverse=True)[1]
            if not self.label[jump].any():
                break
            jump = jump[jump]
            self.jumps.append(jump)
        self.rank = rank
        order = np.lexsort((rank, self.source))[::-1]
        self.first[self.source[order]] = order

    def leave(self, chunk: int, entry: int) -> int:
        """State in which the least script leaves a chunk."""
        arc = self.first[4 * self.begin[chunk] + entry]
        return int(self.source[self.jumps[-1][arc] if self.label[arc] else arc] % 4)

    def script(self, chunk: int, entry: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Labels of the least script, the state after each edit, and the state at the chunk's end."""
        arcs = self.first[[4 * self.begin[chunk] + entry]]
        for jump in reversed(self.jumps):  # places between those known, half as far apart each time
            arcs = np.stack([arcs, jump[arcs]], axis=1).ravel()
        end = int(self.source[arcs[-1]] % 4) if not self.label[arcs[-1]] else int(self.target[arcs[-1]] % 4)
        arcs = arcs[self.label[arcs] > 0]
        return self.label[arcs], self.target[arcs] % 4, end


def faults_of(roles: list[str], texts: list[str], seen: set[bytes]) -> np.ndarray:
    """Each turn's first fault. ``seen`` has digests of earlier chunks' turns."""
    out = np.zeros(len(roles), np.int8)
    here: set[tuple[str, str]] = set()
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        body = text.strip(WHITE)
        if not body:
            out[i] = BLANK
        elif (role, text) in here or seen and digest(role, text) in seen:
            out[i] = DUPLICATE
        elif body[-1] not in ".!?":
            out[i] = CUT
        here.add((role, text))
    return out


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def kinds_of(roles: list[str]) -> np.ndarray:
    return np.array([INITIALS.get(r[:1], 0) for r in roles], np.int8)


CHUNKS = "conv long, chunk long, whole boolean, turns array<long>, roles array<string>, texts array<string>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def chunked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Chunks of every conversation in order; numbers rise with the order of turns. A chunk is ``whole`` if its conversation
    surely begins and ends in it: it was not cut, and other conversations lie before and after it in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size, begins = 0, False  # whether the chunk begins a conversation that is not the range's first

        def flush(ends: bool) -> pa.RecordBatch:
            nonlocal number, size
            conv, *columns = zip(*rows, strict=True)
            out = _batch([(conv[0], number, begins and ends, *map(list, columns))], CHUNKS)
            number, size = number + 1, 0
            rows.clear()
            return out

        for b in batches:
            for row in _rows(b):
                other = bool(rows) and row[0] != rows[-1][0]
                if rows and (other or len(rows) >= CHUNK_TURNS or size >= CHUNK_CHARS):
                    yield flush(other)
                    begins = other
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush(False)

    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    order = ["conv", "turn", "role", "text"]
    named = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # equal rows may be many: their place in the input parts them between ranges, and any order of theirs is right
    dealt = named.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, "place").sortWithinPartitions(*order)
    return stored(dealt.select(*order).mapInArrow(run, CHUNKS))


def _streamed(rows: DataFrame, descending: bool, step: Callable, schema: str) -> DataFrame:
    """``step`` over the rows of each conversation in the order of chunks: it takes a state (None at first) and a row (conv,
    chunk, ...), and returns the next state and a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            out = []
            for row in _rows(b):
                if row[0] != at:
                    at, state = row[0], None
                state, made = step(state, row)
                out.append(made)
            yield _batch(out, schema)

    return rows.repartition("conv").sortWithinPartitions("conv", F.desc("chunk") if descending else "chunk").mapInArrow(run, schema)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for conv, chunk, roles, texts, seen in _rows(b):
            faults, kinds = faults_of(roles, texts, set(seen or ())), kinds_of(roles)
            out.append((conv, chunk, kinds.tobytes(), faults.tobytes(), matrix_of(kinds, faults).ravel().tolist()))
        yield _batch(out, JUDGED)


def _after(state: np.ndarray | None, row: tuple) -> tuple[np.ndarray, tuple]:
    now = END_COSTS if state is None else state
    return (np.array(row[2], np.int64).reshape(4, 4) + now).min(axis=1), (row[0], row[1], now.tolist(), state is None)


def _entry(state: int | None, row: tuple) -> tuple[int, tuple]:
    now = START if state is None else state
    return row[2][now], (row[0], row[1], now)


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(_rows(b))
        if rows:
            ways = Ways([(np.frombuffer(k, np.int8), np.frombuffer(f, np.int8), np.array(a, np.int64)) for _, _, k, f, a in rows])
            yield _batch([(r[0], r[1], [ways.leave(i, s) for s in range(4)]) for i, r in enumerate(rows)], "conv long, chunk long, leaves array<long>")


JUDGED = "conv long, chunk long, kinds binary, faults binary, matrix array<long>"
EDITED = "conv long, chunk long, turns array<long>, roles array<string>, faults binary, cost long, edits array<string>, new_roles array<string>, new_texts array<string>, edit_turns array<long>"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, known = list(_rows(b)), []
        for _, _, _, roles, texts, faults, after, _, _ in rows:
            found = faults_of(roles, texts, set()) if faults is None else np.frombuffer(faults, np.int8)
            known.append((kinds_of(roles), found, END_COSTS if after is None else np.array(after, np.int64)))
        if not rows:
            continue
        ways, out = Ways(known), []
        for i, (conv, chunk, turns, roles, texts, _, _, last, entry) in enumerate(rows):
            begin = START if entry is None else entry
            labels, states, end = ways.script(i, begin)
            edits, new_roles, new_texts, numbers, at = [], [], [], [], 0
            for label, state in zip(labels.tolist(), states.tolist(), strict=True):
                inserted, kept = label == 2, label in (1, 3)
                edits.append(LABELS[label])
                new_roles.append(roles[at] if kept else ROLES[state])
                new_texts.append("" if inserted else texts[at])
                numbers.append(None if inserted else turns[at])
                at += not inserted
            costs_now = costs(*known[i])
            cost = int(costs_now[0, begin] - costs_now[-1, end])
            if last is None or last:
                cost += int(END_COSTS[end])
                for role in (ROLES[USER], ROLES[ASSISTANT])[2 - ENDS[end] :]:
                    edits, new_roles, new_texts, numbers = [*edits, "I"], [*new_roles, role], [*new_texts, ""], [*numbers, None]
            out.append((conv, chunk, turns, roles, known[i][1].astype(np.int8).tobytes(), cost, edits, new_roles, new_texts, numbers))
        yield _batch(out, EDITED)


def repaired(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Chunks of all conversations with their turns, faults and edits; see ``edits`` and ``summary``."""
    chunks = chunked(turns, conv_col, turn_col, role_col, text_col)
    linked = chunks.where(~F.col("whole"))
    each = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.unhex(F.sha2(F.concat(F.length(t["roles"]).cast("string"), F.lit(":"), t["roles"], t["texts"]), 256)))
    digests = linked.select("conv", "chunk", F.explode(F.array_distinct(each)).alias("digest"))
    first = digests.groupBy("conv", "digest").agg(F.min("chunk").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("__conv"), "digest", "first")
    later = digests.join(first, "digest").where(F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("chunk") > F.col("first")))
    seen = later.groupBy("chunk").agg(F.collect_set("digest").alias("seen"))  # at most a digest for each turn of the chunk
    judged = stored(linked.join(seen, "chunk", "left").select("conv", "chunk", "roles", "texts", "seen").mapInArrow(_judged, JUDGED))
    after = stored(_streamed(judged.select("conv", "chunk", "matrix"), True, _after, "conv long, chunk long, after array<long>, last boolean"))
    maps = judged.join(after.drop("conv"), "chunk").select("conv", "chunk", "kinds", "faults", "after").mapInArrow(_mapped, "conv long, chunk long, leaves array<long>")
    entry = _streamed(maps, False, _entry, "conv long, chunk long, entry long")
    many = linked.join(judged.select("chunk", "faults"), "chunk").join(after.drop("conv"), "chunk").join(entry.drop("conv"), "chunk")
    both = chunks.where("whole").unionByName(many, allowMissingColumns=True)
    return both.select("conv", "chunk", "turns", "roles", "texts", "faults", "after", "last", "entry").mapInArrow(_edited, EDITED)


def edits(found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text) of every edit in order; kept, given and inserted turns are the repaired
    conversation, deleted ones show what went. Places rise within a conversation."""
    rows = F.arrays_zip(F.col("edits").alias("edit"), F.col("edit_turns").alias("turn"), F.col("new_roles").alias("role"), F.col("new_texts").alias("text"))
    return found.select(F.col("conv").alias("conv_id"), "chunk", F.posexplode(rows).alias("at", "e")).select("conv_id", (F.col("chunk") * (1 << 12) + F.col("at")).alias("place"), "e.*")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, known = None, False
    total = np.zeros(4, np.int64)
    low = high = None
    distinct = illegal = cost = 0
    before, audit, empty, sha = None, [], True, hashlib.sha256()

    def done() -> tuple:
        gaps = 0 if low is None else high - low + 1 - distinct
        return (at, gaps, *total[1:].tolist(), illegal, cost, "".join(audit), sha.hexdigest())

    for b in batches:
        out = []
        for conv, turns, roles, faults, spent, made, new_roles, new_texts in _rows(b):
            if not known or conv != at:
                if known:
                    out.append(done())
                at, known, total, low, high = conv, True, np.zeros(4, np.int64), None, None
                distinct = illegal = cost = 0
                before, audit, empty, sha = None, [], True, hashlib.sha256()
            total += np.bincount(np.frombuffer(faults, np.int8), minlength=4)
            numbers = sorted({t for t in turns if t is not None})
            if numbers:
                distinct += len(numbers) - (numbers[0] == high)
                low, high = numbers[0] if low is None else low, numbers[-1]
            for role in roles:
                illegal += before is not None and before + role[:1] not in LEGAL
                before = role[:1]
            cost += spent
            audit.append("".join(made))
            for edit, role, text in zip(made, new_roles, new_texts, strict=True):
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
        if out:
            yield _batch(out, SUMMARY)
    if known:
        yield _batch([done()], SUMMARY)


def summary(found: DataFrame) -> DataFrame:
    """One row for each conversation: gaps in turn numbers, faults, illegal neighbours, cost, audit, hash of the repair."""
    taken = ["conv", "turns", "roles", "faults", "cost", "edits", "new_roles", "new_texts"]
    return found.repartition("conv").sortWithinPartitions("conv", "chunk").select(*taken).mapInArrow(_summed, SUMMARY)


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with turns lost, emptied, cut, repeated or relabelled by the hash of their key."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    out = turns.where(hit != 0).select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def query(turns: DataFrame) -> DataFrame:
    """The summary of every conversation of the damaged table; those that lost all turns have zeros and an empty audit."""
    found = summary(repaired(damaged(turns)))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    both = ids.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(F.col("conv").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _oracle() -> str:
    """The query in SQL: a recursion over each conversation's rows from its end, the best (cost, audit, turns) of every state."""
    crc = "xor(4294967295::bigint, list_reduce([4294967295::bigint] || list_transform(string_split(key, ''), lambda c: ascii(c)::bigint), lambda a, b: list_reduce([xor(a, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"
    white = "||".join(f"chr({ord(c)})" for c in WHITE)

    def best(state: int) -> str:
        found, inserted = [], []
        for k in range(3):
            before = f"[{', '.join(inserted)}]::varchar[]"
            step = lambda to, cost, label, line, when, k=k, before=before: f"case when {when} then {{'c': d[{to + 1}].c + {INSERT * k} + {cost}, 'a': '{'I' * k}{label}' || d[{to + 1}].a, 't': {before} || {line} || d[{to + 1}].t}} end"
            stays, extra = "fault in (0, 3)", f"case when fault = 3 then {TRUNCATED} else 0 end"
            found.append(step(state, DELETE, "D", "[]::varchar[]", "true"))
            found += [step(kind, extra, "K", "[role || ':' || text]", f"{stays} and kind = {kind}") for kind in (SYSTEM, USER, ASSISTANT) if allowed(state, kind)]
            new = int(NEXT[state])
            found.append(step(new, f"{REROLE} + {extra}", "R", f"['{ROLES[new]}:' || text]", stays))
            inserted.append(f"'{ROLES[new]}:'")
            state = new
        return f"list_sort(list_filter([{', '.join(found)}], lambda x: x is not null))[1]"

    ends, at = [], []
    for state, n in enumerate(ENDS):
        at = [f"'{r}:'" for r in (ROLES[USER], ROLES[ASSISTANT])[2 - n :]]
        ends.append(f"{{'c': {INSERT * n}::bigint, 'a': '{'I' * n}', 't': [{', '.join(at)}]::varchar[]}}")
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
h AS (SELECT *, {crc} % 20 AS hit FROM k),
m AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn, count(*) OVER (PARTITION BY conv_id) AS rows, right(trim(text, {white}), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind, left(lag(role) OVER (PARTITION BY conv_id ORDER BY rn), 1) || left(role, 1) AS pair FROM o),
dp AS (
    SELECT conv_id, 0::bigint AS n, [{', '.join(ends)}] AS d FROM (SELECT DISTINCT conv_id FROM f)
    UNION ALL
    SELECT f.conv_id, n + 1, [{', '.join(best(s) for s in range(4))}] FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.rows - f.rn = dp.n
),
s AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(rn > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(rows) AS rows FROM f GROUP BY conv_id
),
x AS (SELECT s.*, dp.d[1] AS best FROM s JOIN dp ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.n = s.rows)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
coalesce(best.c, 0)::bigint AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
