"""Chat records of differing layouts to canonical turns, and turns to training text.

A record is JSON.  Its nested field paths, sorted and hashed, are the
fingerprint of its layout, which selects a declarative mapping to turns.  The
template marks turns, escapes its control strings in texts so that they can be
read back, and says which characters are trained on.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pactframe.llm.common import extended, map_batches

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns.

    ``each`` is the list of turns with ``role`` and ``text`` inside, or empty
    if the record is one turn itself or has its turns in fields of their own,
    which ``fields`` then gives as (role, path).  ``optional`` paths may lack.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn", ("turn",), ("role", "text"), role="role", text="text"),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), ("id",), each="messages", role="role", text="content"),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), ("id", "system"), each="conversations",
           role="from", text="value", fields=(("system", "system"),)),
    Layout("prompt", ("prompt", "response"), ("id", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("prompt", "completion"), ("id",), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system"),
           fields=(("system", "system"), ("user", "instruction\ninput"), ("assistant", "output"))),
    Layout("question", ("question", "answer"), ("id", "context"), fields=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
    Layout("nested", ("data", "data.dialog", "data.dialog[].speaker", "data.dialog[].utterance"), ("id",), each="data.dialog",
           role="speaker", text="utterance"),
)
# Other names of the three roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all fields that are not null; list elements share one path."""
    out: set[str] = set()
    if isinstance(value, dict):
        for name, inner in value.items():
            path = f"{at}.{name}" if at else name
            if inner is not None:
                out.add(path)
                out |= field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            out |= field_paths(inner, f"{at}[]")
    return out


def fingerprint(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode())


def fingerprints(layouts=LAYOUTS) -> dict[int, Layout]:
    """Every fingerprint a layout can have, with each choice of its optional fields."""
    out: dict[int, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for chosen in itertools.combinations(layout.optional, n):
                out.setdefault(fingerprint({*layout.required, *chosen}), layout)
    return out


def at_path(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def plain(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def role_name(value) -> str:
    role = plain(value)
    return ROLES.get(role, role)


def turns_of(record, layout: Layout) -> list[tuple[str, str]] | None:
    """The turns, or None if one of them is no object, which the field paths of the others hide."""
    out = []
    for role, paths in layout.fields:
        found = [plain(v) for v in (at_path(record, p) for p in paths.split("\n")) if v is not None]
        if found:
            out.append((role, "\n".join(found)))
    if layout.each:
        if not all(isinstance(t, dict) for t in at_path(record, layout.each)):
            return None
        out += [(role_name(t.get(layout.role)), plain(t.get(layout.text))) for t in at_path(record, layout.each)]
    elif layout.role:
        out.append((role_name(record.get(layout.role)), plain(record.get(layout.text))))
    return out


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def canonical_turns(records: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """The other columns with ``layout``, ``position`` in the record, ``role`` and ``text``, a row per turn.

    A record whose fingerprint no layout has, that holds a turn that is no object,
    or that is not JSON or nested too deeply to be read, gives one row
    with a null layout, position, role and text, so that none goes unseen.
    """
    kept = [c for c in records.columns if c not in (record, "layout", "position", "role", "text")]
    known = fingerprints(layouts)

    def start():
        def read(text):
            try:
                value = json.loads(text)
                layout = known.get(fingerprint(field_paths(value)))
                turns = layout and turns_of(value, layout)
            except (TypeError, ValueError, RecursionError):
                return None, None
            if turns is None:
                return None, None
            return layout.name, [{"role": r, "text": t} for r, t in turns]

        def step(batch):
            names, turns = zip(*map(read, batch.column("__record").to_pylist()))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(turns, TURNS)], names=[*kept, "layout", "turns"])

        return step

    rows = records.select(*[f"`{c}`" for c in kept])
    schema = extended(rows, layout="string", turns="array<struct<role:string,text:string>>")
    rows = map_batches(records.select(*[f"`{c}`" for c in kept], records[record].alias("__record")), start, schema)
    return rows.select(*[f"`{c}`" for c in kept], "layout", F.posexplode_outer("turns").alias("position", "t")).select(
        *[f"`{c}`" for c in kept], "layout", "position", "t.role", "t.text")


# --------------------------------------------------------------- template

OPEN, CLOSE = "### ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)", re.S)
HEAD_END = re.compile(r"(?:[^\\:]|\\.)*?: ", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def escape_role(role: str) -> str:
    return re.sub(r"[:\n]", lambda m: "\\" + m.group(), escape(role))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m.group(1), text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = f"{OPEN}{escape_role(role)}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        head = HEAD_END.match(formatted, at + len(OPEN))
        role = unescape(formatted[at + len(OPEN) : head.end() - 2])
        scan = head.end()
        while True:
            end = formatted.index(CLOSE, scan)
            # the mark is a text's own if an odd number of backslashes stands before it
            slashes = end
            while slashes > head.end() and formatted[slashes - 1] == "\\":
                slashes -= 1
            if (end - slashes) % 2 == 0:
                break
            scan = end + 1
        out.append((role, unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return out


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The rows with ``segment``, and ``loss_start`` and ``loss_end`` of the characters in it that are trained on.

    The segments of a conversation in order, one after the other, are its
    training text.  Nulls count as empty; only turns of ``trained`` roles have
    loss positions.  No shuffle, and no conversation is held in one row.
    """
    kept = [c for c in turns.columns if c not in ("segment", "loss_start", "loss_end")]
    rows = turns.select(*[f"`{c}`" for c in kept])

    def start():
        def step(batch):
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            made = [segment(r or "", t or "") for r, t in zip(roles, texts)]
            loss = [(a, b) if r in trained else (None, None) for r, (_, a, b) in zip(roles, made)]
            columns = [pa.array([s for s, _, _ in made], pa.string()), *(pa.array([x[n] for x in loss], pa.int32()) for n in (0, 1))]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "segment", "loss_start", "loss_end"])

        return step

    return map_batches(rows, start, extended(rows, segment="string", loss_start="int", loss_end="int"))


def conversations(segments: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """(key, formatted, loss_spans): whole conversations, each of which must fit in one row."""
    parts = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "segment", "loss_start", "loss_end"))).alias("p"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    walked = F.aggregate("p", begin, lambda a, s: F.struct(
        (a["at"] + F.length(s["segment"])).alias("at"),
        F.concat(a["spans"], F.when(s["loss_start"].isNotNull(), F.array(F.struct(
            (a["at"] + s["loss_start"]).alias("start"), (a["at"] + s["loss_end"]).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))).alias("spans")))
    return parts.select(key, F.array_join(F.transform("p", lambda s: s["segment"]), "").alias("formatted"), walked["spans"].alias("loss_spans"))


def digests(segments: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """What a conversation's formatted turns say when read back, as digests; one row per key.

    Rows are dealt by key and sorted, and each task reads them as a stream, so
    a conversation of any length needs little memory.
    """
    kind = segments.schema[key].dataType.simpleString()
    dealt = segments.repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, "segment", "loss_start", "loss_end")

    def run(batches):
        def begin():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def rows(done):
            columns = [[r[0] for r in done], *([r[1][n] for r in done] for n in (0, 2, 4)), *([r[1][n].hexdigest() for r in done] for n in (1, 3))]
            kinds = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                              names=[key, "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256"])

        now, state, done, key_type = None, None, [], None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, piece, a, b in zip(*(batch.column(n).to_pylist() for n in range(4))):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = k, begin()
                for role, text in read_back(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learned = unescape(piece[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(piece)
            if len(done) > 10_000:
                yield rows(done)
                done = []
        if state is not None:
            yield rows([*done, (now, state)])

    return dealt.mapInArrow(run, f"{key} {kind}, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string")
