"""Chat formatting whose result a deterministic parser reads back to exactly the turns that went in.

A ``Template`` gives each role an opening and a closing mark; a turn of any other role names it. The parser knows
the marks only: a turn runs from its opening mark to the next mark of any kind, which has to be its closing one. Each
turn is rendered as it is and parsed again. If anything else than the source comes back, its content is escaped:
one more backslash behind the first character of every mark, of those with backslashes already there as
well. Reading removes one. That goes on until the turn comes back identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.llm.conversations import LONG_CHARS, LONG_ROWS, by_conversation, ordered_conversations, record_batches

#: Characters of formatted text after which a piece of a long conversation ends with its turn.
PIECE_CHARS = 1 << 20


class Conflict(ValueError):
    """Text that the grammar does not accept."""


@dataclass(frozen=True)
class Template:
    """Opening and closing mark by role. Marks begin with ``<`` or ``[``; spaces around them belong to the turn's frame."""

    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"))
    #: before the name of another role, between name and text, and after the text
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: str = "assistant"

    @cached_property
    def by_role(self) -> dict[str, tuple[str, str]]:
        return {role: (opening, closing) for role, opening, closing in self.marks}

    @cached_property
    def by_opening(self) -> dict[str, tuple[str, str]]:
        return {opening: (role, closing) for role, opening, closing in self.marks}

    @cached_property
    def controls(self) -> tuple[str, ...]:
        return tuple(sorted({m.strip() for row in self.marks for m in row[1:]} | set(self.named), key=lambda m: (-len(m), m)))

    @cached_property
    def pattern(self) -> str:
        """A mark, with any number of backslashes behind its first character, as two groups."""
        firsts = sorted({m[0] for m in self.controls})
        return "|".join(f"({re.escape(c)})(\\\\*(?:{'|'.join(re.escape(m[1:]) for m in self.controls if m[0] == c)}))" for c in firsts)

    @cached_property
    def _marked(self) -> re.Pattern:
        return re.compile(self.pattern)

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))

    @cached_property
    def _opening(self) -> re.Pattern:
        return re.compile("|".join(re.escape(m) for m in sorted([*self.by_opening, self.named[0]], key=len, reverse=True)))

    def escape(self, text: str) -> str:
        def longer(m: re.Match) -> str:
            first, rest = (x for x in m.groups() if x is not None)
            return f"{first}\\{rest}"

        return self._marked.sub(longer, text)

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text

        def shorter(m: re.Match) -> str:
            first, rest = (x for x in m.groups() if x is not None)
            return first + rest.removeprefix("\\")

        return self._marked.sub(shorter, text)

    def frame(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn with its content as given, and where its text lies."""
        if role in self.by_role:
            opening, closing = self.by_role[role]
        else:
            opening, closing = f"{self.named[0]}{role}{self.named[1]}", self.named[2]
        return opening + text + closing, len(opening), len(opening) + len(text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn that parses to exactly this role and text, and where its text lies."""
        as_role, as_text = role, text
        while True:
            framed = self.frame(as_role, as_text)
            try:
                if self.parse_turn(framed[0]) == (role, text, len(framed[0])):
                    return framed
            except Conflict:
                pass
            if role not in self.by_role:
                as_role = self.escape(as_role)
            as_text = self.escape(as_text)

    def parse_turn(self, source: str, at: int = 0) -> tuple[str, str, int]:
        """Role, text and end of the turn that begins at ``at``."""
        opening = self._opening.match(source, at)
        if not opening:
            raise Conflict(f"no turn begins at {at}")
        if opening[0] in self.by_opening:
            role, closing = self.by_opening[opening[0]]
            text, at = self._until(source, opening.end(), closing)
        else:
            role, at = self._until(source, opening.end(), self.named[1])
            if role in self.by_role:
                raise Conflict(f"role {role!r} has marks of its own")
            text, at = self._until(source, at, self.named[2])
        return role, text, at

    def _until(self, source: str, at: int, closing: str) -> tuple[str, int]:
        found = self._control.search(source, at)
        pad = len(closing) - len(closing.lstrip())
        if not found or found[0] != closing.strip() or found.start() - pad < at or not source.startswith(closing, found.start() - pad):
            raise Conflict(f"expected {closing!r} after {at}")
        return self.unescape(source[at : found.start() - pad]), found.start() - pad + len(closing)

    def parse(self, source: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of a formatted conversation or of a piece of one."""
        at = 0
        while at < len(source):
            role, text, at = self.parse_turn(source, at)
            yield role, text


TEMPLATE = Template()
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_SPARK = "conv_id long, place long, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def _pieces(template: Template, rows, size: int | None) -> Iterator[dict]:
    """Formatted conversations of sorted rows: one piece each, or one for every ``size`` characters."""
    for (conv_id,), own in rows:
        place, parts, loss, turns, at = 0, [], [], [], 0
        for r in chain(own, (None,)):
            if turns and (r is None or (size is not None and at >= size)):
                text = "".join(parts)
                if list(template.parse(text)) != turns:
                    raise Conflict(f"conversation {conv_id} does not come back")
                yield {"conv_id": conv_id, "place": place, "n_turns": len(turns), "formatted": text, "loss": loss}
                place, parts, loss, turns, at = place + 1, [], [], [], 0
            if r is None:
                break
            role, text = r["role"] or "", r["text"]
            rendered, start, end = template.render(role, text)
            if role == template.learned:
                loss.append({"start": at + start, "end": at + end})
            parts.append(rendered)
            turns.append((role, text))
            at += len(rendered)


def _formatter(template: Template, size: int | None):
    def run(batches):
        yield from record_batches(_pieces(template, by_conversation(batches), size), _FORMATTED, lambda r: len(r["formatted"]))

    return run


def format_conversations(
    rows: DataFrame, template: Template = TEMPLATE, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``conv_id, piece, whole, n_turns, formatted, loss`` for the conversations of ``rows`` (``conv_id, turn, role, text``).

    ``loss`` lists the spans of ``formatted``, in code points, that hold the texts to learn (still escaped). A
    conversation is ``whole`` in one row; only one beyond ``long_rows`` or ``long_chars`` is in pieces, whole turns
    each, which follow one another by ``piece``. A null text is empty, a null role is the role without a name, a null
    ``turn`` comes first, rows of one turn go by role and the digest of the text, and rows without a ``conv_id`` are
    one conversation. Repeated rows are turns like any other. An empty table gives an empty one; other columns are ignored.
    """
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    short, ranges = ordered_conversations(rows, long_rows, long_chars)
    narrow, columns = ("conv_id", "role", "text"), ("n_turns", "formatted", "loss")
    out = short.select(*narrow).mapInArrow(_formatter(template, None), _SPARK)
    out = out.select("conv_id", F.col("place").alias("piece"), F.lit(True).alias("whole"), *columns)
    if ranges is None:
        return out
    cut = ranges.select(*narrow).mapInArrow(_formatter(template, piece_chars), _SPARK)
    # ranges are numbered in order, and none has 2**33 pieces of a conversation
    piece = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("place")
    return out.unionByName(cut.select("conv_id", piece.alias("piece"), F.lit(False).alias("whole"), *columns))


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(template: Template, conversations) -> Iterator[dict]:
    for (conv_id,), pieces in conversations:
        turns, learned = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        for piece in pieces:
            text = piece["formatted"]
            for role, content in template.parse(text):
                turns.update(f"{role}\n{content}\n".encode())
                n_turns += 1
            for span in piece["loss"]:
                content = template.unescape(text[span["start"] : span["end"]])
                learned.update(content.encode())
                loss_chars += len(content)
            chars += len(text)
        yield {"conv_id": conv_id, "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": learned.hexdigest(), "formatted_chars": chars}


def _digester(template: Template):
    def run(batches):
        yield from record_batches(_digests(template, by_conversation(batches)), _DIGESTS, lambda r: 1)

    return run


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, what the parser and the loss spans recover from ``format_conversations``: counts and digests.

    A whole conversation is read where it lies. The pieces of others are streamed in order, one in memory at a
    time, through one task for each conversation: a digest of all of it has no parts that could be merged.
    """
    types = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ("conv_id", "formatted", "loss")
    one = formatted.where("whole").select(*columns).mapInArrow(_digester(template), types)
    more = formatted.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*columns)
    return one.unionByName(more.mapInArrow(_digester(template), types))
