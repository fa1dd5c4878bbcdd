"""Conversation structure repair: the cheapest edits that give a legal order of roles.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Rows are kept, given the
role that fits, or deleted, and rows without text are inserted; the cheapest edits win, and of
equally cheap ones those whose initials come first in ASCII.  This is a Viterbi search over four
states (nothing yet, system, user, assistant said last).  Each state's survivor is a node in a
tree of back-pointers; a node that no survivor leads back to goes, and as soon as all
survivors share an ancestor the edits up to it are emitted, with the rows they belong to, so that memory holds
only what is unresolved.  Survivors that cannot win whatever follows are given up at once.  A tie at a state compares the complete unresolved edits of both survivors:
their order is kept as a rank, as an edit's token (inserts, then one edit of a row) is never the
beginning of another, so that survivors differ at their first different token.

Scale: rows are sorted by conversation and turn over range partitions, so that a conversation of any
size is cut over tasks.  One that begins and ends within a partition is repaired there.  The first and
the last of a partition may be parts of a longer one: a part is decoded from every state it may
start in, parts of a conversation (one a partition at most) are put together from costs and
ranks alone, and the chosen edits go back to the rows.  Only the final digest of such a conversation
reads its rows in one task, in sorted Arrow batches, since SHA-256 cannot be
split; it keeps no rows.  Equal rows are one row with a number of copies before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, materialize

#: Costs of a new role, of a row deleted, of a row inserted, of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, system, user or assistant said last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: State after a row with this initial, where it is legal.
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after a row that was inserted or given a role, and that role.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: What any rest of a conversation costs more, at most, from the first state than from the second: a
#: kept system row is deleted, or the role that is missing is inserted.
DETOUR = {
    (SYSTEM, NOTHING): 2 * INSERT, (USER, NOTHING): INSERT + DELETE, (ASSISTANT, NOTHING): DELETE,
    (NOTHING, SYSTEM): 0, (USER, SYSTEM): INSERT, (ASSISTANT, SYSTEM): 0,
    (NOTHING, USER): INSERT, (SYSTEM, USER): INSERT, (ASSISTANT, USER): INSERT,
    (NOTHING, ASSISTANT): 0, (SYSTEM, ASSISTANT): 2 * INSERT, (USER, ASSISTANT): INSERT,
}
#: Rows of a partition aimed at.
TASK_ROWS = 50_000


def _moves(initial: str, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, token) of a row that may stay."""
    found = []
    for start in STATES:
        found.append((start, start, DELETE, "D"))
        state, inserts = start, ""
        while len(inserts) < 3:  # after two inserts a state comes back, at a cost
            extra = INSERT * len(inserts) + (TRUNCATED if truncated else 0)
            if (state, initial) in AFTER:
                found.append((start, AFTER[state, initial], extra, inserts + "K"))
            found.append((start, NEXT[state], extra + REROLE, inserts + "R"))
            state, inserts = NEXT[state], inserts + "I"
    return found


MOVES = {(c, t): _moves(c, t) for c in "sua-" for t in (False, True)}
FORCED = [(s, s, DELETE, "D") for s in STATES]


class Node:
    __slots__ = ("parent", "token", "refs", "child")

    def __init__(self, parent: Node | None, token: str):
        self.parent, self.token, self.refs, self.child = parent, token, 0, None
        if parent is not None:
            parent.refs += 1
            parent.child = self  # the youngest; the only one where refs is one and the other has gone


class Survivors:
    """The cheapest edits to every state from one start; step() returns the tokens now resolved."""

    def __init__(self, start: int):
        self.root = Node(None, "")
        self.best = {start: (0, 0, self.root)}  # state: cost, rank, node
        self.held = 0

    def step(self, moves: list) -> list[str]:
        new: dict = {}
        for before, after, cost, token in moves:
            if before in self.best:
                total, rank, node = self.best[before]
                key = (total + cost, rank, token)
                if after not in new or key < new[after][0]:
                    new[after] = (key, node)
        # A survivor goes when another one, with any detour, is cheaper whatever follows.
        new = {s: x for s, x in new.items() if not any(t != s and x[0][0] > y[0][0] + DETOUR[t, s] for t, y in new.items())}
        old = [node for _, _, node in self.best.values()]
        order = sorted(new, key=lambda s: new[s][0][1:])
        self.best = {s: (new[s][0][0], k, Node(new[s][1], new[s][0][2])) for k, s in enumerate(order)}
        for node in old:  # what leads to no survivor goes
            while node.refs == 0 and node is not self.root:
                parent, node.parent = node.parent, None
                parent.refs -= 1
                node = parent
        self.held += 1
        return self._resolved()

    def _resolved(self) -> list[str]:
        """Tokens from the root to where survivors part."""
        out = []
        while self.root.refs == 1:
            below = self._only_child()
            below.parent = None
            out.append(below.token)
            self.root = below
        self.held -= len(out)
        return out

    def _only_child(self) -> Node:
        if self.root.child.parent is self.root:
            return self.root.child
        node = next(iter(self.best.values()))[2]
        while node.parent is not self.root:
            node = node.parent
        self.root.child = node
        return node

    def path(self, state: int) -> list[str]:
        """Unresolved tokens of a state's survivor."""
        node, out = self.best[state][2], []
        while node is not self.root:
            out.append(node.token)
            node = node.parent
        return out[::-1]

    def finish(self) -> tuple[int, list[str], str]:
        """Cost, unresolved tokens and last inserts of the best legal end."""
        state = best_end({s: b[:2] for s, b in self.best.items()})
        return self.best[state][0] + INSERT * len(ENDS[state]), self.path(state), ENDS[state]


def best_end(survivors: dict[int, tuple[int, int]]) -> int:
    """The state of (cost, rank) survivors from which a legal end is cheapest."""
    return min(survivors, key=lambda s: (survivors[s][0] + INSERT * len(ENDS[s]), survivors[s][1]))


class Written:
    """Digest and edits of a repaired conversation, token by token."""

    def __init__(self):
        self.state, self.audit, self.sha, self.first = NOTHING, [], hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def apply(self, token: str, role: str = "", text: str = "") -> None:
        self.audit.append(token)
        for edit in token:
            if edit == "K":
                self.state = AFTER[self.state, role[:1]]
                self._put(role, text)
            elif edit != "D":
                self.state = NEXT[self.state]
                self._put(ROLE[self.state], text if edit == "R" else "")


class Tally:
    """Faults and turns of consecutive rows."""

    FIELDS = ("lo", "hi", "turns", "first_turn", "last_turn", "first_role", "last_role", "rows", "blank", "duplicate", "truncated", "illegal")

    def __init__(self):
        self.lo = self.hi = self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.turns = self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, copies: int, blank: bool, seen: bool, cut: bool) -> None:
        one = Tally()
        if turn is not None:
            one.lo = one.hi = one.first_turn = one.last_turn = turn
            one.turns = 1
        one.first_role = one.last_role = initial
        one.rows, one.illegal = copies, copies - 1
        one.blank, one.duplicate = (copies, 0) if blank else (0, copies - 1 + seen)
        one.truncated = int(cut and not blank and not seen)
        self.merge(one)

    def merge(self, late: Tally) -> None:
        """Add the rows that follow."""
        if late.first_role is not None:
            if self.first_role is None:
                self.first_role = late.first_role
            elif self.last_role + late.first_role not in LEGAL or len(self.last_role) != 1:
                self.illegal += 1
            self.last_role = late.last_role
        if late.turns:
            self.turns += late.turns - (self.turns > 0 and self.last_turn == late.first_turn)
            self.lo, self.hi = (late.lo, late.hi) if self.lo is None else (min(self.lo, late.lo), max(self.hi, late.hi))
            self.first_turn = late.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = late.last_turn
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(late, name))

    def out(self) -> dict:
        return {"gaps": self.hi - self.lo + 1 - self.turns if self.turns else 0} | {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal")}

    def fields(self) -> dict:
        return {k: getattr(self, k) for k in self.FIELDS}

    @classmethod
    def of(cls, row: dict) -> Tally:
        t = cls()
        for k in cls.FIELDS:
            setattr(t, k, row[k])
        return t


class Whole:
    """A conversation that begins here: one decoder, rows held until their edits are resolved."""

    def __init__(self):
        self.tally, self.decoder, self.waiting, self.written = Tally(), Survivors(NOTHING), deque(), Written()

    def add(self, moves: list, role: str, text: str) -> None:
        self.waiting.append((role, text))
        for token in self.decoder.step(moves):
            self.written.apply(token, *self.waiting.popleft())

    def result(self) -> dict:
        cost, rest, end = self.decoder.finish()
        for token in rest:
            self.written.apply(token, *self.waiting.popleft())
        self.written.apply(end)
        return {"cost": cost, "audit": "".join(self.written.audit), "repaired_sha256": self.written.sha.hexdigest()} | self.tally.out()


class Part:
    """Rows of a conversation that may have begun earlier: a decoder for every start."""

    def __init__(self):
        self.tally, self.decoders, self.done = Tally(), [Survivors(s) for s in STATES], [[] for _ in STATES]

    def add(self, moves: list, role: str, text: str) -> None:
        for decoder, done in zip(self.decoders, self.done, strict=True):
            done += decoder.step(moves)

    def part(self) -> dict:
        return _part(self.tally, self.decoders, ["".join(d) for d in self.done])


def _part(tally: Tally, decoders: list, done: list[str]) -> dict:
    costs, ranks, tails = [], [], []
    for d in decoders:
        for s in STATES:
            cost, rank, _ = d.best.get(s, (-1, -1, None)) if d else (-1, -1, None)
            costs.append(cost)
            ranks.append(rank)
            tails.append("".join(d.path(s)) if cost >= 0 else None)
    return {"costs": costs, "ranks": ranks, "heads": done, "tails": tails} | tally.fields()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
RESULT_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: What a part has besides: its tally so far, without the counts that results have too.
_MORE = [c for c in Tally.FIELDS if c not in COUNTS]
TALLY = ", ".join(f"{c} string" if c.endswith("role") else f"{c} long" for c in _MORE)
TALLY_ARROW = [(c, pa.string() if c.endswith("role") else pa.int64()) for c in _MORE]
PASS = RESULT + ", slice long, costs array<long>, ranks array<int>, heads array<string>, tails array<string>, " + TALLY
PASS_ARROW = pa.schema([*RESULT_ARROW, ("slice", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("heads", pa.list_(pa.string())), ("tails", pa.list_(pa.string())), *TALLY_ARROW])


def _pass(batches):
    """Over rows sorted by conversation: results of those that begin and end here, parts of the first and last."""
    here, current, now = TaskContext.get().partitionId(), None, None
    opened = False
    out: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if not opened or r["conv_id"] != now:
                if isinstance(current, Whole):
                    out.append({"conv_id": now} | current.result())
                elif opened:
                    out.append({"conv_id": now, "slice": here} | current.part())
                now, current, opened = r["conv_id"], Whole() if opened else Part(), True
            if not r["copies"]:
                continue  # dropped: the conversation is known, the row is not there
            current.tally.add(r["turn"], r["role"][:1], r["copies"], r["blank"], r["seen"], r["cut"])
            gone = r["blank"] or r["seen"]
            current.add(FORCED if gone else MOVES[r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "-", r["cut"]], r["role"], r["text"])
            for _ in range(r["copies"] - 1):
                current.add(FORCED, r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=PASS_ARROW)
            out = []
    if isinstance(current, Whole):  # it may go on in the next partition
        done = ["".join(current.written.audit), "", "", ""]
        out.append({"conv_id": now, "slice": here} | _part(current.tally, [current.decoder, None, None, None], done))
    elif opened:
        out.append({"conv_id": now, "slice": here} | current.part())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=PASS_ARROW)


MARK = "conv_id long, slice long, start int, stop int, last boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def _put_together(parts: pa.Table) -> pa.Table:
    """The states in which each part of a conversation starts and stops under the cheapest edits."""
    rows = parts.sort_by("slice").to_pylist()
    best, back, tally = {NOTHING: (0, 0)}, [], Tally()
    for r in rows:
        tally.merge(Tally.of(r))
        new: dict = {}
        for start, (cost, rank) in best.items():
            for stop in STATES:
                if (more := r["costs"][4 * start + stop]) >= 0:
                    key = (cost + more, rank, r["ranks"][4 * start + stop])
                    if stop not in new or key < new[stop][0]:
                        new[stop] = (key, start)
        order = sorted(new, key=lambda s: new[s][0][1:])
        back.append({s: new[s][1] for s in new})
        best = {s: (new[s][0][0], k) for k, s in enumerate(order)}
    state = best_end(best)
    shared = tally.out() | {"cost": best[state][0] + INSERT * len(ENDS[state])}
    out = []
    for k in range(len(rows) - 1, -1, -1):
        start = back[k][state]
        out.append({"conv_id": rows[k]["conv_id"], "slice": rows[k]["slice"], "start": start, "stop": state, "last": k == len(rows) - 1} | shared)
        state = start
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("slice", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("last", pa.bool_()), *[(c, pa.int64()) for c in COUNTS]]))


def _rewrite(batches):
    """Over a conversation's chosen edits and then its rows in order: its result."""
    now, opened, edits, result, written = None, False, [], {}, None
    out: list[dict] = []

    def tokens():
        """Inserts and the edit that they precede."""
        start = 0
        text = "".join(edits)
        for i, letter in enumerate(text):
            if letter != "I":
                yield text[start : i + 1]
                start = i + 1

    def close():
        written.apply(ENDS[result["stop"]])
        out.append({"conv_id": now} | {c: result[c] for c in COUNTS} | {"audit": "".join(written.audit), "repaired_sha256": written.sha.hexdigest()})

    for batch in batches:
        for r in batch.to_pylist():
            if not opened or r["conv_id"] != now:
                if opened:
                    close()
                now, opened, edits, written, source = r["conv_id"], True, [], Written(), None
            if r["edits"] is not None:
                edits.append(r["edits"])
                result = r if r["last"] else result
                continue
            source = source or tokens()
            for _ in range(r["copies"]):
                written.apply(next(source), r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=RESULT_ARROW)
            out.clear()
    if opened:
        close()
        yield pa.RecordBatch.from_pylist(out, schema=RESULT_ARROW)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) and copies after the contract's damage by
    crc32 of ``conv_id:turn``: 0 copies of a dropped row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), code.alias("_code"))
    said = F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return told.select("conv_id", "turn", F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.  rows: conv_id, turn, role, text and copies (0: the row is not there).

    Turns come in order, nulls first, rows of one turn by role and by the digest of role and text; rows
    equal in all are copies.  Null conversation ids are one conversation.  A null role
    or text is one space.  A role of other initials is legal nowhere and gets a role or goes.  A conversation
    without rows, or with deleted rows alone, has an empty audit or one of D, and the digest of nothing.
    Empty tables give no rows; other columns are not looked at.  Texts may be of any length."""
    spark = rows.sparkSession
    with Scratch(spark, "conversations") as scratch:
        there = F.col("copies") > 0
        told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(there, F.col("turn").cast("long")).alias("turn"), *[F.when(there, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")], F.col("copies").cast("long").alias("copies"))
        last = F.right(F.rtrim("text", F.lit(ASCII_SPACE)), F.lit(1))
        key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
        one = told.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        one = scratch.write(one.withColumns({"key": key, "blank": F.coalesce(last == "", F.lit(False)), "cut": F.coalesce((last != "") & ~last.isin(".", "!", "?"), F.lit(False))}), "rows")
        # Equal role and text at several turns: seen before, but at the first.
        first = one.where("copies > 0").groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
        first = scratch.write(first.where("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "_first"), "first")
        marked = one.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
        marked = marked.withColumn("seen", F.coalesce(F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("_first"), F.lit(False)))
        order = ["conv_id", "turn", "role", "key"]
        slices = max(8, -(-one.count() // task_rows))
        sliced = marked.select(*order, "text", "copies", "blank", "seen", "cut").repartitionByRange(slices, *order).sortWithinPartitions(*order)
        found = scratch.write(sliced.mapInArrow(_pass, PASS), "found")
        parts = found.where("slice IS NOT NULL")
        names = RESULT_ARROW.names
        marks = parts.select("conv_id", "slice", "costs", "ranks", *Tally.FIELDS).groupBy("conv_id").applyInArrow(_put_together, MARK)
        strings = parts.select(F.col("conv_id").alias("_conv"), F.col("slice").alias("_slice"), "heads", "tails")
        marks = marks.join(strings, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("slice") == F.col("_slice")))
        marks = scratch.write(marks.withColumn("edits", F.concat(F.get("heads", F.col("start")), F.get("tails", 4 * F.col("start") + F.col("stop")))).drop("heads", "tails", "_conv", "_slice"), "marks")
        cut = one.join(marks.select(F.col("conv_id").alias("_conv")).distinct(), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").where("copies > 0")
        both = marks.unionByName(cut.select(*order, "text", "copies"), allowMissingColumns=True)
        again = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("edits").isNull(), "slice", *order[1:])
        rest = again.mapInArrow(_rewrite, RESULT)
        return materialize(found.where("slice IS NULL").select(*names).unionByName(rest), "repaired")
