"""Chats rebuilt from a log of events, and written in a training format with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import stored

#: Kinds of events; what each does to the message it names.
OPEN, DELTA, EDIT, REGENERATE, DISCARD = "open", "delta", "edit", "regenerate", "discard"
ESCAPE = "\\"
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``begin`` role ``middle`` text ``end``. The control strings never appear in what they enclose.

    In roles and texts, each backslash is doubled and each control string gets a backslash after its first character,
    so a single backslash always marks a broken control string and ``unescaped`` gives the text back.
    """

    begin: str = "<s>[INST] "
    middle: str = " [/INST]\n"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")
        if not all(any(c in mark for c in self.controls) for mark in (self.begin, self.middle, self.end)):
            raise ValueError("each mark contains a control string")

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for control in self.controls:
            text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
        return text

    def parse(self, turn: str) -> tuple[str, str]:
        """The role and the text of a formatted turn."""
        whole = f"{re.escape(self.begin)}(.*?){re.escape(self.middle)}(.*){re.escape(self.end)}"
        role, text = re.fullmatch(whole, turn, re.DOTALL).groups()
        return unescaped(role), unescaped(text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text


class Batches:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= BATCH_ROWS or self.chars >= BATCH_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.chars = [], 0


def fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages from events sorted by conversation, message and sequence number; one message in memory at a time."""
    out, key, live, role, parts = None, None, False, None, []

    def done() -> Iterator[pa.RecordBatch]:
        if live:
            text = "".join(parts)
            yield from out.add((*key, role, text), len(text))

    for batch in batches:
        if out is None:
            named = [batch.schema.field("conv_id"), batch.schema.field("message")]
            out = Batches(pa.schema([*named, ("role", pa.string()), ("text", pa.string())]))
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text")]
        for conv, message, kind, said_by, text in zip(*columns, strict=True):
            if key is None or (conv, message) != key:
                if key is not None:
                    yield from done()
                key, live, role, parts = (conv, message), False, None, []
            if kind == OPEN:
                live, role, parts = True, said_by, [text or ""]
            elif kind == DELTA:
                live = True
                parts.append(text or "")
            elif kind == EDIT:
                live, parts = True, [text or ""]
            elif kind == REGENERATE:
                live, parts = True, []
            elif kind == DISCARD:
                live, role, parts = False, None, []
    if out is not None:
        yield from done()
        yield from out.rest()


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages of a log with ``conv_id``, ``message``, ``seq``, ``kind``, ``role`` and ``text``.

    ``message`` names a message within its conversation and gives its place (any type that can be ordered). In the order of
    ``seq``, ``open`` begins a message with a role (and text, if any), ``delta`` appends, ``edit`` replaces the text, ``regenerate``
    drops it for the deltas that follow, ``discard`` removes the message unless it is opened or written again. Other kinds do
    nothing. A NULL text is empty; a message never opened has no role; NULL is an ordinary conversation or message; events
    that tie in ``seq`` are taken by kind, role and text. An empty log gives no messages. Other columns are not read.

    The log is dealt out by ranges of (conversation, message), so that a long conversation fills as many tasks as it needs,
    and rows come back in that order. A task holds one message at a time.
    """
    order = ["conv_id", "message"]
    log = events.select(*order, "seq", "kind", "role", "text")
    parted = log.repartitionByRange(*order).sortWithinPartitions(*order, "seq", "kind", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    return parted.mapInArrow(fold_sorted, f"conv_id {kinds['conv_id']}, message {kinds['message']}, role string, text string")


def format_turns(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """Each message in the template as ``formatted``; ``loss_from`` and ``loss_to`` are the code points of it that are trained on.

    The turns of a conversation, joined in the order of ``message``, are its formatted text. Only texts of the ``trained`` roles
    have a loss span (NULL elsewhere; empty for an empty text). A NULL role is written as an empty one.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    opening = F.concat(F.lit(template.begin), template.escaped(role), F.lit(template.middle))
    turns = messages.select("conv_id", "message", "role", opening.alias("opening"), template.escaped(text).alias("body"))
    begins = F.when(F.col("role").isin(*template.trained), F.length("opening"))
    return turns.select(
        "conv_id", "message", F.concat("opening", "body", F.lit(template.end)).alias("formatted"),
        begins.alias("loss_from"), (begins + F.length("body")).alias("loss_to"),
    )


class Reading:
    """What one conversation's formatted turns say, read turn by turn."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = sha256(), sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, loss_from: int | None, loss_to: int | None) -> None:
        role, text = self.template.parse(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.formatted_chars += len(formatted)
        if loss_from is not None:
            trained = unescaped(formatted[loss_from:loss_to])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_FIELDS = [
    ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
]
TURN = ("conv_id", "message", "formatted", "loss_from", "loss_to")


def turns_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in TURN], strict=True)


def read_within(template: Template):
    """Reads the conversations that lie whole within a partition; passes the turns of others on.

    The first and the last conversation may go on in a neighbouring partition, and one that exceeds a batch is not held: their
    turns are passed on as they come.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, chars, passing, current, started = None, [], 0, True, None, False
        for batch in batches:
            if out is None:
                out = Batches(pa.schema([*[batch.schema.field(c) for c in TURN], *READ_FIELDS]))
            for turn in turns_of(batch):
                if not started or turn[0] != current:
                    if started and not passing:
                        reading = Reading(template)
                        for _, _, *said in held:
                            reading.add(*said)
                        yield from out.add((current, None, None, None, None, *reading.row()), 0)
                    passing = not started
                    current, started, held, chars = turn[0], True, [], 0
                if passing:
                    yield from out.add((*turn, *[None] * len(READ_FIELDS)), len(turn[2]))
                    continue
                held.append(turn)
                chars += len(turn[2])
                if chars >= BATCH_CHARS:
                    passing = True
                    for earlier in held:
                        yield from out.add((*earlier, *[None] * len(READ_FIELDS)), len(earlier[2]))
                    held = []
        if out is not None:
            for turn in held:
                yield from out.add((*turn, *[None] * len(READ_FIELDS)), len(turn[2]))
            yield from out.rest()

    return read


def read_sorted(template: Template):
    """Reads conversations from sorted turns with a constant amount of memory."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, reading, current = None, None, None
        for batch in batches:
            if out is None:
                out = Batches(pa.schema([batch.schema.field("conv_id"), *READ_FIELDS]))
            for conv, _, *said in turns_of(batch):
                if reading is None or conv != current:
                    if reading is not None:
                        yield from out.add((current, *reading.row()), 0)
                    reading, current = Reading(template), conv
                reading.add(*said)
        if reading is not None:
            yield from out.add((current, *reading.row()), 0)
        if out is not None:
            yield from out.rest()

    return read


def read_back(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, digests of the roles and texts that the formatted turns hold and of the text under the loss mask.

    ``turns`` are those of ``format_turns`` over ``fold_events``, which come in order. A digest is one chain over a
    conversation, so the turns of a conversation that is spread over partitions are brought together, as a stream; all
    others are read where they lie.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    turn = ", ".join(f"{c} {kinds[c]}" for c in TURN)
    within = stored(turns.select(*TURN).mapInArrow(read_within(template), f"{turn}, {READ}"))
    names = [name for name, _ in READ_FIELDS]
    spread = within.where("n_turns IS NULL").select(*TURN).repartition("conv_id").sortWithinPartitions("conv_id", "message")
    across = spread.mapInArrow(read_sorted(template), f"conv_id {kinds['conv_id']}, {READ}")
    return within.where("n_turns IS NOT NULL").select("conv_id", *names).union(across)


def events_of_rows(rows: DataFrame, draft: int = 64, piece: int = 1024) -> DataFrame:
    """The log that would have led to ``rows`` (conv_id, turn, role, text): a message each, ordered by turn.

    An assistant's answer begins with a draft of ``draft`` code points, is regenerated and streams in pieces; any other message
    is typed that far, then edited to its first piece and completed. Rows that repeat a turn are messages each, ordered
    by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    answered = F.coalesce(F.col("role") == "assistant", F.lit(False))
    none = F.lit(None).cast("string")

    def event(seq: Column, kind: Column, role: Column, said: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), kind.alias("kind"), role.alias("role"), said.alias("text"))

    begun = F.array(
        event(F.lit(0), F.lit(OPEN), F.col("role"), none),
        event(F.lit(1), F.lit(DELTA), none, text.substr(F.lit(1), F.lit(draft))),
        event(F.lit(2), F.when(answered, REGENERATE).otherwise(EDIT), none, none),
    )
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    streamed = F.transform(pieces, lambda said, i: event(i + 3, F.lit(DELTA), none, said))
    same = F.monotonically_increasing_id()  # tells repeated rows apart; decides the order of equal texts only
    message = F.struct("turn", "role", F.sha2(text, 256).alias("digest"), same.alias("copy"))
    logged = rows.select("conv_id", message.alias("message"), F.concat(begun, streamed).alias("events"))
    return logged.select("conv_id", "message", F.inline("events"))
