"""Conversations as formatted texts with a mask of what a model should learn to say.

A template marks the turns with control strings. Where a text or a role holds such a string itself, the string
is broken up by ``\\|`` after its first character, and a backslash is doubled; so no control string ever
comes from a text, and reading back is exact. What stands inside the template's ``generation`` is the loss mask, in
code points of the formatted text.

A conversation is the rows of one ``conv_id`` in order of ``turn``, ties in order of role and text. Its rows are rendered as
they come, in parts of about ``PART_CHARS``; only the settings of the template are held. A conversation of more
than ``LONG_TURNS`` turns is numbered over range partitions first and rendered by many tasks. Its digests need its turns in
one order, so that they are fed with its parts one after the other.

Null texts and roles count as empty, a null ``turn`` comes first, rows with a null ``conv_id`` are one conversation. Rows that
repeat each other are turns of their own. Columns beside these four aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import written
from tablewise.llm.decontaminate import sized
from tablewise.llm.template import Rendering, Template
from tablewise.operators.ordering import row_numbers

PART_CHARS = 1_000_000
LONG_TURNS = 1_000
BEGIN, END = "<s>", "</s>"
#: A user's text, an assistant's text, any other role; each text stands between these.
CONTROLS = (BEGIN, END, "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = """
{%- for message in messages -%}
  {%- if loop.first -%} {{ begin }} {%- endif -%}
  {%- if message.role == 'user' -%}
    {{ '[INST] ' ~ (message.text | escape) ~ ' [/INST]' }}
  {%- elif message.role == 'assistant' -%}
    {%- generation -%} {{ message.text | escape }} {%- endgeneration -%} {{ end }}
  {%- else -%}
    [ROLE] {{- message.role | escape -}} [/ROLE] {{- message.text | escape -}} {{ end }}
  {%- endif -%}
{%- endfor -%}
"""
FORMATTED = "conv_id long, first_turn long, whole boolean, text string, mask array<struct<start:long,stop:long>>"
REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_NEEDS = re.compile(rf"\\|{_CONTROL.pattern}")
_BROKEN = re.compile(r"\\([\\|])")
_MARKED = re.compile(f"({_CONTROL.pattern})")
if any(c[0] in other[1:] or "\\" in other or "|" in other for c in CONTROLS for other in CONTROLS):
    raise ValueError("a control string may not begin inside another or hold the signs of the escape")


def escape(text: str) -> str:
    """The text without control strings; ``unescape`` gives it back."""
    return _NEEDS.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\|{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: "\\" if m[1] == "\\" else "", text) if "\\" in text else text


def chat_template() -> Template:
    return Template(TEMPLATE, {"begin": BEGIN, "end": END}, {"escape": escape})


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    signs = iter(_MARKED.split(text))
    for sign in signs:
        if sign in ("", BEGIN):
            continue
        if sign == "[INST]":
            body = next(signs)
            close, role = next(signs), "user"
            if close != "[/INST]" or body[:1] != " " or body[-1:] != " " or len(body) < 2:
                raise ValueError("a user's turn isn't closed")
            body = body[1:-1]
        elif sign == "[ROLE]":
            role, close, body = unescape(next(signs)), next(signs), next(signs)
            if close != "[/ROLE]" or next(signs) != END:
                raise ValueError("a turn isn't closed")
        else:  # an assistant's text, or if that is empty what closes it
            role, body = "assistant", "" if sign == END else sign
            if sign != END and next(signs) != END:
                raise ValueError("an assistant's turn isn't closed")
        yield role, unescape(body)


class _Part:
    """A stretch of one conversation's turns as it is rendered."""

    def __init__(self, template: Template, conversation: int | None, first: int) -> None:
        self.template, self.conversation, self.first, self.index, self.out = template, conversation, first, first, Rendering()
        self.env = template.begin(self.out if first == 0 else None)

    def add(self, role: str, text: str, last: bool) -> None:
        self.template.message(self.env, self.out, {"role": role, "text": text}, self.index, last)
        self.index += 1
        if last:
            self.template.tail(self.env, self.out)

    def row(self, last: bool) -> dict:
        mask = [{"start": a, "stop": b} for a, b in self.out.spans]
        return {"conv_id": self.conversation, "first_turn": self.first, "whole": self.first == 0 and last, "text": "".join(self.out.parts), "mask": mask}

    def go_on(self) -> None:
        self.first, self.out = self.index, Rendering()


def _rendered(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (conv_id, role, text, place, size) in order: formatted parts. ``place`` and ``size`` are null where all turns are in the task."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row, part, done, held = next(rows, None), None, [], 0
        while row is not None:
            after = next(rows, None)
            conversation, role, text, place, size = row
            goes_on = after is not None and after[0] == conversation and (place is None or after[3] == place + 1)
            last = not goes_on if place is None else place == size
            part = part or _Part(template, conversation, 0 if place is None else place - 1)
            part.add(role, text, last)
            if not goes_on or part.out.length >= PART_CHARS:
                done.append(part.row(last))
                held += part.out.length
                if goes_on:
                    part.go_on()
                else:
                    part = None
            if held >= PART_CHARS or len(done) >= 2_000:
                yield pa.RecordBatch.from_pylist(done, _FORMATTED)
                done, held = [], 0
            row = after
        if done:
            yield pa.RecordBatch.from_pylist(done, _FORMATTED)

    return run


_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("first_turn", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()),
    ("mask", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def format_conversations(rows: DataFrame, template: Template | None = None, long_turns: int = LONG_TURNS) -> DataFrame:
    """(conv_id, first_turn, whole, text, mask): a conversation's formatted text, in parts that begin with their ``first_turn``.

    ``whole`` says that a part is all of its conversation; ``mask`` has the generated stretches of the part, in code points.
    """
    template = template or chat_template()
    empty = F.lit("")
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    render = _rendered(template)
    long_ones = written(turns.groupBy(F.col("conv_id").alias("_long")).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > long_turns))
    named = F.col("conv_id").eqNullSafe(F.col("_long"))
    none = F.lit(None).cast("long")
    if not long_ones.count():
        short, parted = turns, None
    else:
        short = turns.join(sized(long_ones.select("_long")), named, "left_anti")
        numbered = row_numbers(turns.join(sized(long_ones), named).drop("_long"), [F.col("turn"), F.col("role"), F.col("text")], ["conv_id"], output="_place")
        dealt = numbered.withColumn("_piece", F.floor((F.col("_place") - 1) / long_turns)).repartition("conv_id", "_piece")
        parted = dealt.sortWithinPartitions("conv_id", "_place").select("conv_id", "role", "text", "_place", "_size").mapInArrow(render, FORMATTED)
    placed = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    found = placed.select("conv_id", "role", "text", none.alias("_place"), none.alias("_size")).mapInArrow(render, FORMATTED)
    return found if parted is None else found.unionByName(parted)


class _Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, mask: Sequence[dict]) -> None:
        for role, said in read_turns(text):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for span in mask:
            learned = unescape(text[span["start"] : span["stop"]])
            self.loss_chars += len(learned)
            self.learned.update(learned.encode())
        self.chars += len(text)

    def row(self) -> list:
        return [self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars]


_REPORT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (conv_id, text, mask), those of a conversation in order: one row for each conversation."""
    name, digest = None, None
    for batch in batches:
        done = []
        for conversation, text, mask, whole in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or whole or conversation != name:
                if digest is not None:
                    done.append([name, *digest.row()])
                name, digest = conversation, _Digest()
            digest.add(text, mask)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([name, *digest.row()], _REPORT)], schema=_REPORT)


def conversation_report(rows: DataFrame, long_turns: int = LONG_TURNS) -> DataFrame:
    """Format the conversations, write them in the shared folder, read them back, and say what each of them holds."""
    formatted = written(format_conversations(rows, long_turns=long_turns)).select("conv_id", "text", "mask", "whole", "first_turn")
    read = ["conv_id", "text", "mask", "whole"]
    whole = formatted.where("whole").select(read).mapInArrow(_read_back, REPORT)
    parts = formatted.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return whole.unionByName(parts.select(read).mapInArrow(_read_back, REPORT))


def with_control_conversation(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose two texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    more = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return rows.select(columns).unionByName(more)


#: The same result in DuckDB.
CONVERSATION_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + 2 * len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[/?ROLE\]')) AS t,
 length(role) + length(role) - length(replace(role, '\', '')) + 2 * len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[/?ROLE\]')) AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (3 + sum(CASE role WHEN 'user' THEN t + 15 WHEN 'assistant' THEN t + 4 ELSE r + t + 17 END))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
