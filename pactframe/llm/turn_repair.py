"""Conversations whose turns are put in order by the cheapest edits.

Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn) 5;
a truncated turn that stays adds 5.  Blank and duplicate turns must go.  What
remains has role initials ``(s?(ua)+)?``.

The edits of a conversation are a path through a graph of (rows read, state of
the initials).  A path weighs one integer: its high digits are the cost, the low
digits, of fixed width, are the audit letters from the left, zeros behind the
last one.  The least integer is therefore the cheapest path and, among equals,
the one whose audit comes first in ASCII order, so plain minima decide all.
Integers stay short in long conversations: after ``BLOCK`` rows the letters so
far are replaced by their rank among the (at most four) states.  That loses
nothing: there all paths have just read the same row, so no audit is a proper
prefix of another, and ranks compare as the letters do.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pactframe.sources.tables import stored

BLOCK = 128
# Costs of the edits and of a truncated turn that stays.
REROLED, DELETED, INSERTED, CUT_SHORT = 1, 2, 5, 5
LETTERS = " DIKR"  # a letter's digit is its place; ASCII order
SPACE = " \t\n\x0b\x0c\r"
# State of the initials so far, and what each next initial makes of it.
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = ({"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
LEGAL = {"su", "ua", "au"}
BITS = 3
WIDTH = BITS * (3 * BLOCK + 2)  # two insertions and one more edit a row, two insertions at the end
DIGITS = {c: n for n, c in enumerate(LETTERS)}
PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def wanted_role(state: int) -> str:
    return "assistant" if state == ASKED else "user"


class Paths:
    """Least weights into each state, row by row."""

    def __init__(self):
        self.costs = {START: 0}
        self.ranks = {START: 0}
        self.audits: dict[int, tuple] = {START: ()}  # (earlier blocks, letters of the last one)
        self.open()

    def open(self) -> None:
        self.rows = 0
        # state: (weight, letters so far in this block, state at the block's start)
        self.now = {q: ((self.costs[q] << WIDTH + BITS) | (self.ranks[q] << WIDTH), 0, q) for q in self.costs}

    @staticmethod
    def edge(path, letter: str, cost: int):
        weight, n, begin = path
        return weight + (cost << WIDTH + BITS) + (DIGITS[letter] << WIDTH - BITS * (n + 1)), n + 1, begin

    def inserted(self) -> dict:
        """The paths, and those with one or two more turns; more than two come back to a state they left."""
        best, last = dict(self.now), self.now
        for _ in range(2):
            last = {NEXT[q][wanted_role(q)[0]]: self.edge(p, "I", INSERTED) for q, p in last.items()}
            for q, p in last.items():
                if q not in best or p[0] < best[q][0]:
                    best[q] = p
        return best

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        if self.rows == BLOCK:
            self.close()
        self.rows += 1
        extra = CUT_SHORT if truncated else 0
        after: dict = {}

        def arrive(q, path):
            if q not in after or path[0] < after[q][0]:
                after[q] = path

        for q, path in self.inserted().items():
            arrive(q, self.edge(path, "D", DELETED))
            if not must_go:
                if initial in NEXT[q]:
                    arrive(NEXT[q][initial], self.edge(path, "K", extra))
                arrive(NEXT[q][wanted_role(q)[0]], self.edge(path, "R", REROLED + extra))
        self.now = after

    def letters(self, path) -> str:
        weight, n, _ = path
        return "".join(LETTERS[weight >> WIDTH - BITS * (i + 1) & 7] for i in range(n))

    def close(self) -> None:
        """Start a new block: costs, ranks and letters of the paths so far."""
        mask = (1 << WIDTH + BITS) - 1
        order = {w: r for r, w in enumerate(sorted({p[0] & mask for p in self.now.values()}))}
        self.audits = {q: (self.audits[p[2]], self.letters(p)) for q, p in self.now.items()}
        self.costs = {q: p[0] >> WIDTH + BITS for q, p in self.now.items()}
        self.ranks = {q: order[p[0] & mask] for q, p in self.now.items()}
        self.open()

    def best(self) -> tuple[int, str]:
        """Cost and audit of the least path that ends with nothing or an answer."""
        path = min((p for q, p in self.inserted().items() if q in (START, ANSWERED)), key=lambda p: p[0])
        parts, chain = [self.letters(path)], self.audits[path[2]]
        while chain:
            chain, letters = chain
            parts.append(letters)
        return path[0] >> WIDTH + BITS, "".join(reversed(parts))


class Conversation:
    """Counts and edits of one conversation, from its rows in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.greatest = self.before = None
        self.paths = Paths()

    def read(self, turn, role: str, text: str, seen: bool) -> None:
        end = text.rstrip(SPACE)[-1:]
        again = seen or (self.before is not None and self.before == (turn, role, text))
        blank, truncated = not end, end not in (".", "!", "?")
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None:
            if self.greatest is None:
                self.least = turn
            if turn != self.greatest:
                self.turns += 1
            self.greatest = turn
        self.before = turn, role, text
        self.paths.read(role[:1], blank or again, truncated)

    def plan(self) -> tuple:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        cost, audit = self.paths.best()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as a test of the repair: some gone, emptied, cut, repeated or given a wrong role.

    What befalls a row follows from the CRC-32 of ``conv_id:turn``; a null in
    any of the four columns counts as one space, though a null turn or conv_id
    stays null in the result.  A row that is dropped stays with a null role and
    text, so that a conversation of which nothing is left is still known.
    """
    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    role, text = part("role"), part("text")
    return conversations.select(
        "conv_id", "turn",
        F.when(lot == 4, "user").when(lot != 0, role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).when(lot != 0, text).alias("text"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def with_earlier(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with ``seen``: an earlier turn has this role and text.

    Only texts that a conversation holds twice come back through the join, with
    their first turn; the count is an aggregate that map tasks reduce, whatever
    a conversation's size.  Equal rows of one turn are not told apart here.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = turns.withColumn("digest", F.unhex(F.sha2("text", 256)))
    firsts = rows.where("role is not null").groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    f = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    found = rows.join(f, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return found.select("conv_id", "turn", "role", "text", F.coalesce(F.col("first") < place, F.lit(False)).alias("seen"))


ORDER = ("turn", "role", "text")


def plans(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the counts and costs of ``PLAN``, and ``audit``, the edits' initials.

    ``turns`` has conv_id, turn, role, text and ``seen``.  Rows are dealt by
    conversation, sorted by turn (nulls first), role and text, and read as a
    stream; a task holds the letters of one conversation, not its texts.  A row
    with a null role only makes its conversation known.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", *ORDER, "seen").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *ORDER)

    def run(batches):
        now, state, done, key_type = None, None, [], None

        def rows():
            columns = [[k for k, _ in done], *([p[n] for _, p in done] for n in range(7))]
            kinds = [key_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", *PLAN, "audit"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, turn, role, text, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, state.plan()))
                    now, state = key, Conversation()
                if role is not None:
                    state.read(turn, role, text, seen)
            if len(done) > 10_000:
                yield rows()
                done = []
        if state is not None:
            done.append((now, state.plan()))
            yield rows()

    return dealt.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in PLAN) + ", audit string")


def applied(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), role, text, edit (K, R or I).

    A conversation's audit comes before its rows in the stream, which is read
    once.  The rows of a conversation come out together and in order.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    heads = planned.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
                           F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    body = turns.where("role is not null").select("conv_id", F.lit(1).alias("part"), *ORDER, F.lit(None).cast("string").alias("audit"))
    dealt = heads.unionByName(body).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", *ORDER)

    def run(batches):
        audit, at, tail, state, position = "", 0, 0, START, 0
        for batch in batches:
            out = []

            def put(key, role, text, edit):
                nonlocal state, position
                out.append((key, position, role, text, edit))
                state, position = NEXT[state][role[0]], position + 1

            def insertions(key):
                nonlocal at
                while audit[at : at + 1] == "I":
                    at += 1
                    put(key, wanted_role(state), "", "I")

            for key, part, _, role, text, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    audit, at, tail, state, position = letters, 0, len(letters.rstrip("I")), START, 0
                    continue
                insertions(key)
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(key, role if edit == "K" else wanted_role(state), text, edit)
                if at == tail:
                    insertions(key)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "position", "role", "text", "edit"])

    return dealt.mapInArrow(run, f"conv_id {kind}, position long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns as ``applied`` gives them: ``role:text``, joined by newlines."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state, done, key_type = None, None, [], None

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], key_type), pa.array([s for _, s in done], pa.string())],
                                              names=["conv_id", "repaired_sha256"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if len(done) > 10_000:
                yield rows()
                done = []
        if state is not None:
            done.append((now, state.hexdigest()))
            yield rows()

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired turns) of rows (conv_id, turn, role, text).

    Turns go by number, nulls first, and rows of one turn by role and text.  A
    null conv_id is a conversation of its own.  A row with a null role only
    makes its conversation known; a null text is blank.  Other columns are
    ignored; an empty table gives empty tables.  A conversation without turns
    has zeros and an empty audit.
    """
    turns = stored(with_earlier(conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))), "turns")
    planned = stored(plans(turns), "plans")
    return planned, applied(turns, planned)
