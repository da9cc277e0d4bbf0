"""Conversation repair: the cheapest edits that give ``(s?(ua)+)?``, by a backward programme kept at square-root checkpoints.

A state says which role may come next: 0 before anything, 1 after a system turn, 2 after a user turn, 3 after an
assistant turn. ``v[s]`` is the least cost of all that follows; a conversation may end in states 0 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
Row = tuple[str, bool, bool, int]
EDITS = "conv string, turn long, role string, digest binary, letters string, blank long, duplicate long, truncated long, illegal long, new_turn long, cost long"
AUDIT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv string, place long, edit string, role string, text string"


def before(v: tuple, row: Row) -> tuple:
    """Costs in front of a row from those behind it. The row: role initial, whether it must go, whether its text is cut
    off, and how many equal rows it stands for, of which all but the first must go."""
    initial, forced, cut, n = row
    if forced:
        b = [x + DELETE * n for x in v]
    else:
        t, b = TRUNCATED * cut, [x + DELETE for x in v]
        user, other = REROLE + t + v[2], REROLE + t + v[3]
        if initial == "u":
            user = t + v[2]
        elif initial == "a":
            other = t + v[3]
        elif initial == "s":
            b[0] = min(b[0], t + v[1])
        b = [min(b[0], user), min(b[1], user), min(b[2], other), min(b[3], user)]
        if n > 1:
            b = [x + DELETE * (n - 1) for x in b]
    two, three = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return min(b[0], INSERT + two), min(b[1], INSERT + two), two, three


def keeps(initial: str, state: int) -> int | None:
    """The state behind a kept row, if its role may stand here."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def edit(row: Row, state: int, here: tuple, behind: tuple) -> tuple[str, int]:
    """The ASCII-least letters of tight edits up to and with this row, and the state behind them."""
    initial, forced, cut, n = row
    if forced:
        return "D" * n, state
    letters, rest = "", DELETE * (n - 1)
    while True:
        left = here[state] - rest
        kept = keeps(initial, state)
        if DELETE + behind[state] == left:
            return letters + "D" * n, state
        if INSERT + here[NEXT[state]] == here[state]:
            letters, state = letters + "I", NEXT[state]
        elif kept is not None and TRUNCATED * cut + behind[kept] == left:
            return letters + "K" + "D" * (n - 1), kept
        else:
            return letters + "R" + "D" * (n - 1), NEXT[state]


def walk(rows: list[Row], state: int, end: tuple) -> Iterator[tuple[str, int]]:
    """Letters and state behind each row. Costs are held at every ``sqrt(n)``-th row only; a block's own are computed
    again when the walk comes to it."""
    n, step = len(rows), isqrt(len(rows)) + 1
    held, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            held[i // step] = v
        v = before(v, rows[i])
    for block in range(0, n, step):
        inside = rows[block:block + step]
        costs = [held[block // step]]
        for row in reversed(inside):
            costs.append(before(costs[-1], row))
        costs.reverse()
        for i, row in enumerate(inside):
            letters, state = edit(row, state, costs[i], costs[i + 1])
            yield letters, state


def _through(rows: list[Row]) -> list[list[int]]:
    """Least cost from each state in front of the rows to each behind them."""
    columns = []
    for k in range(4):
        v = tuple(0 if s == k else FAR for s in range(4))
        for row in reversed(rows):
            v = before(v, row)
        columns.append(v)
    return [[min(FAR, columns[k][s]) for k in range(4)] for s in range(4)]


class Chunk:
    """Light rows of whole conversations, or of the part of one that lies in this partition."""

    def __init__(self, batches: list[pa.RecordBatch], first: bool, last: bool):
        self.table = pa.Table.from_batches(batches)
        self.conv, self.turn, self.role = (self.table.column(c).to_pylist() for c in ("conv", "turn", "role"))
        *flags, self.blank = [self.table.column(c).to_pylist() for c in ("forced", "cut", "n", "blank")]
        self.rows: list[Row] = [(r[:1], f, c, n) for r, f, c, n in zip(self.role, *flags)]
        starts = [i for i, c in enumerate(self.conv) if i == 0 or c != self.conv[i - 1]]
        self.spans = list(zip(starts, [*starts[1:], len(self.conv)]))
        self.first, self.last = first, last


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches cut between conversations; memory is bounded by a batch and the longest part of one conversation."""
    held: list[pa.RecordBatch] = []
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_pylist()
        cut = max(i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1])
        if cut == 0 and (not held or held[-1].column(0)[-1].as_py() == conv[0]):
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        yield Chunk(held, first, False)
        held, first = [batch.slice(cut)], False
    if held:
        yield Chunk(held, first, True)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a partition: its first and last conversation and what crossing them costs."""
    seen = None
    for chunk in chunks(batches):
        (a, b), (c, d) = chunk.spans[0], chunk.spans[-1]
        seen = seen or {"first": chunk.conv[a], "through": sum(_through(chunk.rows[a:b]), []), "single": False}
        if chunk.last:
            seen |= {"last": chunk.conv[c], "last_through": sum(_through(chunk.rows[c:d]), []), "single": chunk.first and len(chunk.spans) == 1,
                     "initial": chunk.role[-1][:1], "turn": chunk.turn[-1]}
    if seen:
        yield pa.RecordBatch.from_pylist([seen | {"pid": TaskContext.get().partitionId()}], SUMMARY_ARROW)


SUMMARY_ARROW = pa.schema([("pid", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("initial", pa.string()), ("turn", pa.int64()),
                           ("through", pa.list_(pa.int64())), ("last_through", pa.list_(pa.int64()))])
SUMMARY = "pid int, first string, last string, single boolean, initial string, turn long, through array<long>, last_through array<long>"


class Borders:
    """What a partition must know of its neighbours: costs behind its last rows (``ends``), the state its first rows
    begin in (``states``) and the row in front of them (``previous``). A few numbers for each partition."""

    def __init__(self, rows: list):
        self.parts = sorted(rows, key=lambda r: r["pid"])
        self.ends, self.states, self.previous = {}, {}, {}
        behind = None
        for i in range(len(self.parts) - 1, -1, -1):
            me = self.parts[i]
            follows = self.parts[i + 1] if i + 1 < len(self.parts) else None
            if follows is not None and follows["first"] == me["last"]:
                self.ends[me["pid"]] = behind
                self.previous[follows["pid"]] = (me["initial"], me["turn"])
            end = self.ends.get(me["pid"], END) if me["single"] else END
            m = me["through"]
            behind = tuple(min(m[4 * s + k] + end[k] for k in range(4)) for s in range(4))

    def exits(self, ordered: DataFrame) -> None:
        """Walk the parts of split conversations once from every state, then follow the states from part to part."""
        if not self.ends:
            return
        ends, previous = self.ends, self.previous

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid = TaskContext.get().partitionId()
            for chunk in chunks(batches):
                if chunk.last and pid in ends:
                    a, b = chunk.spans[-1]
                    out = []
                    for state in range(4):
                        for _, state in walk(chunk.rows[a:b], state, ends[pid]):
                            pass
                        out.append(state)
                    yield pa.RecordBatch.from_pylist([{"pid": pid, "out": out}], pa.schema([("pid", pa.int32()), ("out", pa.list_(pa.int32()))]))

        found = {r["pid"]: r["out"] for r in ordered.mapInArrow(run, "pid int, out array<int>").collect()}
        state = 0
        for me in self.parts:
            entered = state if me["pid"] in previous else 0
            self.states[me["pid"]] = entered
            if me["pid"] in found:
                state = found[me["pid"]][entered if me["single"] else 0]


def _edits(borders: Borders) -> Callable:
    ends, states, previous = borders.ends, borders.states, borders.previous

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for chunk in chunks(batches):
            letters, counts = [], []
            for k, (a, b) in enumerate(chunk.spans):
                opens, closes = chunk.first and k == 0, chunk.last and k == len(chunk.spans) - 1
                end = ends.get(pid, END) if closes else END
                state = states.get(pid, 0) if opens else 0
                back = previous.get(pid) if opens else None
                for i, (own, state) in zip(range(a, b), walk(chunk.rows[a:b], state, end)):
                    initial, forced, cut, n = chunk.rows[i]
                    blank = forced and chunk.blank[i]
                    pairs = [initial + initial] * (n - 1) + ([] if back is None else [back[0] + initial])
                    cost = sum({"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[x] for x in own) + (TRUNCATED if cut and not forced and ("K" in own or "R" in own) else 0)
                    counts.append((n * blank, 0 if blank else n - (not forced), int(cut and not forced), sum(p not in ("su", "ua", "au") for p in pairs),
                                   int(chunk.turn[i] is not None and (back is None or back[1] != chunk.turn[i])), cost))
                    back = (initial, chunk.turn[i])
                    letters.append(own)
                if not (closes and pid in ends):
                    while state in (1, 2):
                        letters[-1] += "I"
                        counts[-1] = (*counts[-1][:-1], counts[-1][-1] + INSERT)
                        state = NEXT[state]
            t = chunk.table
            columns = [t.column(c).combine_chunks() for c in ("conv", "turn", "role", "digest")] + [pa.array(letters, pa.string())] + [pa.array([c[i] for c in counts], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "turn", "role", "digest", "letters", "blank", "duplicate", "truncated", "illegal", "new_turn", "cost"])
    return run


def _key(conv_id: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(_key(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"),
                                (F.lit(True) if present is None else present).alias("present"))


def plan_edits(rows: DataFrame) -> DataFrame:
    """``EDITS`` of each distinct row. Only keys, role and a digest of the text are moved here, never the text.

    Equal rows are counted together first, and a repeated pair of role and text is found by its earliest turn. The rest
    is sorted over all conversations at once, so a long one lies in several partitions; what its parts cost and the
    states between them are put together from a few numbers for each partition.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.where("present").select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    equal = light.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    first = equal.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("earliest"))
    known = equal.join(first, ["conv", "role", "digest"])
    known = known.select("conv", "turn", "role", "digest", (F.col("blank") | ~F.col("turn").eqNullSafe(F.col("earliest.turn"))).alias("forced"), (F.col("cut") & ~F.col("blank")).alias("cut"), "n", "blank")
    order = ["conv", "turn", "role", "digest"]
    ordered = cut_lineage(known.repartitionByRange(*order).sortWithinPartitions(*order))
    borders = Borders(ordered.mapInArrow(_summary, SUMMARY).collect())
    borders.exits(ordered)
    return ordered.mapInArrow(_edits(borders), EDITS)


class _Reader:
    """One conversation after the other: edits come just before the text they are for."""

    def __init__(self) -> None:
        self.conv, self.open = None, False

    def begin(self, conv: str) -> None:
        self.conv, self.open = conv, True
        self.state, self.lines, self.audit, self.low, self.high, self.pending = 0, 0, [], None, None, None
        self.sums, self.hash = [0] * 6, hashlib.sha256()

    def turns(self, letters: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        for x in letters:
            if x == "D":
                yield x, role, text
                continue
            now = keeps(role[:1], self.state) if x == "K" else NEXT[self.state]
            said, text_out = (role, text) if x == "K" else (ROLE[now], text if x == "R" else "")
            self.state = now
            self.hash.update((("\n" if self.lines else "") + f"{said}:{text_out}").encode())
            self.lines += 1
            yield x, said, text_out

    def result(self) -> tuple:
        blank, duplicate, truncated, illegal, distinct, cost = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - distinct
        return self.conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(self.audit), self.hash.hexdigest()


def _read(batches: Iterator[pa.RecordBatch], out: Callable, done: Callable) -> Iterator:
    me = _Reader()
    for batch in batches:
        for conv, turn, role, kind, letters, text, *sums in zip(*(c.to_pylist() for c in batch.columns)):
            if not me.open or conv != me.conv:
                if me.open:
                    yield from done(me)
                me.begin(conv)
            if kind == 0:
                me.pending = letters
                me.sums = [a + b for a, b in zip(me.sums, sums)]
                if turn is not None:
                    me.low, me.high = (turn if me.low is None else me.low), turn
            elif kind == 1 and me.pending is not None:
                own, me.pending = me.pending, None
                me.audit.append(own)
                for x in me.turns(own, role, text):
                    yield from out(me, x)
    if me.open:
        yield from done(me)


def _stream(audit: bool, size: int = 2000):
    kind = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]) if audit \
        else pa.schema([("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def turn(me: _Reader, x: tuple[str, str, str]) -> Iterator[tuple]:
        letter, role, text = x
        if not audit:
            yield me.conv, None if letter == "D" else me.lines, letter, role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _read(batches, turn, lambda me: [me.result()] if audit else []):
            rows.append(row)
            if len(rows) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
    return run


def _beside(rows: DataFrame) -> DataFrame:
    """Edits and texts side by side in the order of each conversation; the text is moved once."""
    sums = ["blank", "duplicate", "truncated", "illegal", "new_turn", "cost"]
    none = [F.lit(None).cast("long").alias(c) for c in sums]
    edits = plan_edits(rows).select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), "letters", F.lit(None).cast("string").alias("text"), *sums)
    here = F.col("present")
    texts = rows.select("conv", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("role")).alias("role"), F.when(here, F.unhex(F.md5("text"))).alias("digest"), F.when(here, 1).otherwise(2).alias("kind"),
                        F.lit(None).cast("string").alias("letters"), F.when(here, F.col("text")).alias("text"), *none)
    order = ["conv", "turn", "role", "digest", "kind"]
    return edits.unionByName(texts).repartition("conv").sortWithinPartitions(*order).select("conv", "turn", "role", "kind", "letters", "text", *sums)


def _named(found: DataFrame, conversations: DataFrame, conv_id: str) -> DataFrame:
    given = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(conversations.schema[conv_id].dataType)
    return found.select(given.alias("conv_id"), *[c for c in found.columns if c != "conv"])


def audit_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Faults, cost, edits and digest of the repaired turns of each conversation.

    Rows stand by turn, null turns first, rows of one turn by role and a digest of their text. A null role or text counts as one
    space; null ids are one conversation. Rows that are not ``present`` only say that their conversation exists; one
    without other rows has zeros, an empty audit and the digest of nothing. An empty table gives no rows; other columns
    play no part. A digest is one sequence, so the last pass reads a conversation in one task, row by row and without
    holding it; all else is spread.
    """
    rows = _rows(conversations, conv_id, turn, role, text, present)
    return _named(_beside(rows).mapInArrow(_stream(True), AUDIT), conversations, conv_id)


def repair_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """``conv_id, place, edit, role, text``: every turn of the repaired conversations, numbered from 1, with its edit (K
    kept, R given another role, I inserted); deleted rows (D) have no place. Odd rows as in ``audit_conversations``."""
    rows = _rows(conversations, conv_id, turn, role, text, present)
    return _named(_beside(rows).mapInArrow(_stream(False), TURNS), conversations, conv_id)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of id and turn; ``present`` is false for those taken out."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("_hit") == 1, F.lit("")).when(F.col("_hit") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    given = conversations.select("conv_id", "turn", "role", "text").withColumn("_hit", hit)
    return given.select("conv_id", "turn", F.when(F.col("_hit") == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), (F.col("_hit") != 0).alias("present"),
                        F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
