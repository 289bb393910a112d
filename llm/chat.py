"""Chat formatting: a role machine checks the order of turns, a template turns each into text segments.

A template is data: for every role the strings before and after a text and whether the text is learned
from, the transitions between states by role, and the control strings. Inside texts and unknown roles every control
string is broken by the escape character after its first character, and the escape character is
doubled. So no text holds a control string, the formatted text can be read back turn by turn, and
every text comes back as it was.

Formatting a turn needs nothing but its row, so the turns of a long conversation are formatted and written wherever they
lie. The role machine reads roles only, in order, and keeps one state. Reading back sorts by conversation and runs the
digests along; both hold one turn at a time, however long a conversation is. One conversation's digest is a single chain and so
the work of one task; that is what a digest of its whole text means.

Edge cases: null text and null role are empty; roles that the template does not know get a segment that
names them; turns out of order are formatted all the same and reported by the machine; rows with equal turn numbers are
ordered by role, then text, and repeated rows are turns of their own; null turn numbers come first; rows without a
conv_id are one conversation; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ship

SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Turn:
    """What stands around a text; `loss` says whether the text is learned from."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`turns` by role; `other` for further roles, whose name stands between `before` and `named`."""

    turns: dict[str, Turn]
    other: Turn
    named: str
    controls: tuple[str, ...]
    moves: dict[str, dict[str, str]]
    start: str
    accepting: frozenset[str]
    escape: str = "\\"

    def __post_init__(self):
        fixed = [x for t in (*self.turns.values(), self.other) for x in (t.before, t.after)] + [self.named]
        for c in self.controls:
            if len(c) < 2 or self.escape in c:
                raise ValueError(f"control string {c!r} is too short or holds the escape character")
            for cut in range(1, len(c)):
                # Half in a text, half in the template: could be read as a control string.
                if any(f.startswith(c[cut:]) or f.endswith(c[:cut]) for f in fixed):
                    raise ValueError(f"{c!r} could arise where a text meets the template")
        befores = [t.before for t in self.turns.values()] + [self.other.before]
        if any(a is not b and b.startswith(a) for a in befores for b in befores):
            raise ValueError("one opening begins another")
        for t in (*self.turns.values(), self.other):
            if not any(c in t.after for c in self.controls):
                raise ValueError(f"nothing ends a text before {t.after!r}")
        if not any(c in self.named for c in self.controls):
            raise ValueError("nothing ends the name of a role")

    @property
    def escapes(self) -> str:
        """A pattern of the characters that the escape character follows."""
        starts = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls]
        return "|".join([re.escape(self.escape), *starts])

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.escapes), F.lit("$0" + re.escape(self.escape)))

    def plain(self, text: str) -> str:
        """The text before it was escaped: doubled escape characters once, single ones gone."""
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text) if self.escape in text else text

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        at = 0
        while at < len(formatted):
            role = next((r for r, t in self.turns.items() if formatted.startswith(t.before, at)), None)
            turn = self.other if role is None else self.turns[role]
            if not formatted.startswith(turn.before, at):
                raise ValueError(f"no turn begins at {at}")
            at += len(turn.before)
            if role is None:
                end = formatted.index(self.named, at)
                role, at = self.plain(formatted[at:end]), end + len(self.named)
            end = formatted.index(turn.after, at)
            yield role, self.plain(formatted[at:end])
            at = end + len(turn.after)


INSTRUCTIONS = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]\n"),
        "assistant": Turn("<s> ", " </s>\n", loss=True),
    },
    other=Turn("[ROLE] ", " [/ROLE]\n"),
    named=" [TEXT] ",
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]"),
    moves={
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    accepting=frozenset({"answered"}),
)


def _turns(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def format_turns(rows: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """(conv_id, turn, segments): the text segments of each row of (conv_id, turn, role, text)."""
    turns = _turns(rows)

    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    body = template.escaped(F.col("text"))
    opened = F.concat(F.lit(template.other.before), template.escaped(F.col("role")), F.lit(template.named))
    segments = F.array(piece(opened, False), piece(body, template.other.loss), piece(F.lit(template.other.after), False))
    for role, t in template.turns.items():
        own = F.array(piece(F.lit(t.before), False), piece(body, t.loss), piece(F.lit(t.after), False))
        segments = F.when(F.col("role") == role, own).otherwise(segments)
    return turns.select("conv_id", "turn", segments.cast(SEGMENTS).alias("segments"))


def _in_order(rows: DataFrame, *within: str) -> DataFrame:
    """All rows of a conversation in one task, sorted; tasks read them one after the other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", *within)


def _conversations(batches, columns: list[str]) -> Iterator[tuple[bool, dict]]:
    """Rows, each with a mark whether a conversation begins."""
    last: object = columns  # equals no id
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            yield row["conv_id"] != last, row
            last = row["conv_id"]


def _records(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == 1000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _states(batches, template: Template) -> Iterator[pa.RecordBatch]:
    def rows():
        now = None
        for begins, row in _conversations(batches, ["conv_id", "role"]):
            if begins:
                if now:
                    yield *now, now[2] in template.accepting
                now = [row["conv_id"], 0, template.start, None]
            moved = template.moves.get(now[2], {}).get(row["role"])
            if moved is None and now[3] is None:
                now[3] = now[1]
            now[1], now[2] = now[1] + 1, moved if now[3] is None else "broken"
        if now:
            yield *now, now[2] in template.accepting

    yield from _records(rows(), pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("state", pa.string()), ("first_break", pa.int64()), ("valid", pa.bool_()),
    ]))


def turn_order(rows: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """(conv_id, n_turns, state, first_break, valid): the machine's last state for each conversation,
    the place of the first turn out of order, and whether it ended in an accepting state without one."""
    ship(rows.sparkSession)
    roles = _turns(rows).select("conv_id", "turn", "role")
    out = "conv_id long, n_turns long, state string, first_break long, valid boolean"
    return _in_order(roles, "turn", "role").mapInArrow(partial(_states, template=template), out)


def write_chat(rows: DataFrame, path: str, template: Template = INSTRUCTIONS) -> None:
    """Write `turns` (formatted) and `conversations` (order) below `path`, which must not exist."""
    path = path.rstrip("/")
    format_turns(rows, template).write.mode("errorifexists").parquet(f"{path}/turns")
    turn_order(rows, template).write.mode("errorifexists").parquet(f"{path}/conversations")


def _read(batches, template: Template) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            formatted = "".join(s["text"] for s in row["segments"])
            learned = "".join(template.plain(s["text"]) for s in row["segments"] if s["loss"])
            found = list(template.read(formatted))
            # One row holds one turn; its length and loss text go with it.
            (role, text), = found
            out.append((row["conv_id"], row["turn"], role, text, learned if learned != text else None, learned == text, len(formatted)))
        names = ["conv_id", "turn", "role", "text", "learned", "same", "chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)


def read_chat(spark: SparkSession, path: str, template: Template = INSTRUCTIONS) -> DataFrame:
    """(conv_id, turn, role, text, learned, same, chars) of each written turn, read from its segments.

    `learned` is the text under the loss mask, null where it is the whole text (`same`).
    """
    ship(spark)
    schema = f"conv_id long, turn long, segments {SEGMENTS}"
    out = "conv_id long, turn long, role string, text string, learned string, same boolean, chars long"
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/turns").mapInArrow(partial(_read, template=template), out)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    def rows():
        now = None
        for begins, row in _conversations(batches, ["conv_id", "role", "text", "learned", "same", "chars"]):
            if begins:
                if now:
                    yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{row['role']}\n{row['text']}\n".encode())
            learned = row["text"] if row["same"] else row["learned"]
            now[3] += len(learned)
            now[4].update(learned.encode())
            now[5] += row["chars"]
        if now:
            yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

    yield from _records(rows(), pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of `read_chat`: digests of its turns and of its learned text, and sizes."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _in_order(turns, "turn", "role", "text").mapInArrow(_digests, out)
