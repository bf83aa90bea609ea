"""Chat formatting: a template is a black box; rendering successive turn prefixes shows where each turn's text lies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import mapped, small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns of a window that suits turn_template, whose output for a turn follows from that turn alone.
WINDOW = 16

# The template's control strings. A backslash is doubled and `\-` goes into each control string of a text, so none is left.
_CONTROLS = ("### Role:", "### Assistant:", "<turn>", "</turn>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, _CONTROLS)) + ")")
_ESCAPED = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    """text without control strings, reversibly."""
    text = text.replace("\\", "\\\\")
    cuts = [m.start() for m in _CONTROL.finditer(text)]
    return "\\-".join(text[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*[c + 1 for c in cuts], len(text)], strict=True))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def turn_template(turns: list[Turn]) -> str:
    """The template of this library: `### Role: ` and the role, then the text between `<turn>` and `</turn>`."""
    return "".join(f"### Role: {escape(role)}\n<turn>{escape(text)}</turn>\n" for role, text in turns)



class RewritesHistory(ValueError):
    """A template that changes what it wrote for earlier turns when a turn is added."""


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Spans:
    """Locates the turns of one conversation in a template's output, turn by turn.

    add(role, text) renders the prefix with the new turn, compares it with the prefix before, and gives the turn's own output
    and where its text lies in it. The text is found by rendering the turn a second time with a mark for its text: what comes
    before and after the mark is the template's. A prefix that does not begin with the one before it is a rewritten history.

    All prefixes are whole, so time grows with the square of a conversation's turns. Only where the caller declares a window (that a
    turn's output follows from it and so many turns before it) do prefixes beyond 2 x window turns start at most so many turns back, at
    least window; whenever the start moves on, the last turn must come out the same with the longer and the shorter history, and close(), called after the
    last turn, holds the joined output against one rendering of the whole conversation.
    """

    def __init__(self, template: Template, window: int | None = None):
        self.template = template
        self.window = window
        self.turns: list[Turn] = []
        self.dropped: list[Turn] = []
        self.before = template([])
        self.opening = self.before
        self.joined = hashlib.sha256(self.opening.encode("utf-8", "surrogatepass"))

    def close(self) -> None:
        if self.dropped and hashlib.sha256(self.template([*self.dropped, *self.turns]).encode("utf-8", "surrogatepass")).digest() != self.joined.digest():
            raise RewritesHistory("the whole conversation's output is not that of its windows")

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        if self.window is not None and len(self.turns) >= 2 * self.window:
            shorter = self.turns[-self.window :]
            last = len(self.before) - len(self.template(self.turns[:-1]))
            again = self.template(shorter)
            if last and not again.endswith(self.before[-last:]):
                raise RewritesHistory("a turn's output depends on turns far before it")
            self.dropped.extend(self.turns[: -self.window])
            self.turns, self.before = shorter, again
        now = self.template([*self.turns, (role, text)])
        if not now.startswith(self.before):
            raise RewritesHistory(f"the output changes from character {_common(self.before, now)} on when a turn is added")
        own = now[len(self.before) :]
        mark = "\ue000"
        while mark in own:
            mark += "\ue000"
        probe = self.template([*self.turns, (role, mark)])[len(self.before) :]
        head, found, tail = probe.partition(mark)
        if not found or not own.startswith(head) or not own.endswith(tail) or len(own) < len(head) + len(tail):
            raise RewritesHistory("the template changes more than the text when a turn's text changes")
        self.turns.append((role, text))
        self.before = now
        if self.window is not None:
            self.joined.update(own.encode("utf-8", "surrogatepass"))
        return own, len(head), len(own) - len(tail)


_SCHEMA = "conv_id {kind}, seq long, role string, text string, formatted string, text_start long, text_end long, in_loss boolean"


def _sorted_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    picked = df.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_x"))
    return picked.repartition("_c").sortWithinPartitions("_c", "_t", "_r", "_x")


def format_turns(df: DataFrame, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int | None = None) -> DataFrame:
    """One row per turn, in conversations sorted by turn: conv_id, seq (from 0), role, text, formatted (the turn's own part of the
    output), text_start and text_end (the text's place in it, in code points), in_loss (the text is trained on).

    Conversations stay together in partitions sorted by (conversation, turn, role, text), and stream through the task one turn
    at a time: what a task holds is one batch and the turns of one conversation, which is the one unit that is not split: each
    prefix is rendered from all turns before it. Rows of one conversation come out together and in order.

    Defined results: null roles and texts are empty; null turns come first; turns that tie go by role, then text; repeated rows
    are turns of their own; rows without conv_id form one conversation; an empty table gives no rows; other columns are ignored.
    A template that rewrites history raises RewritesHistory, at whatever turn it does so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, spans, seq = object(), None, 0
        for b in small_batches(batches):
            out = []
            for c, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if spans is None or c != conv:
                    if spans is not None:
                        spans.close()
                    conv, spans, seq = c, Spans(template, window), 0
                own, start, end = spans.add(r, x)
                if seq == 0 and spans.opening:
                    own, start, end = spans.opening + own, start + len(spans.opening), end + len(spans.opening)
                out.append((c, seq, r, x, own, start, end, r in loss_roles))
                seq += 1
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], ["conv_id", "seq", "role", "text", "formatted", "text_start", "text_end", "in_loss"])
        if spans is not None:
            spans.close()

    return mapped(_sorted_turns(df, conv_col, turn_col, role_col, text_col), run, _SCHEMA.format(kind=df.schema[conv_col].dataType.simpleString()))


_TURN = re.compile(r"### Role: (.*?)\n<turn>(.*?)</turn>\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read from format_turns' output alone, one row per conversation: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Takes rows as format_turns leaves them, a conversation's together and in order, and streams: the digests grow turn by turn.
    Roles and texts are parsed from the output of the library's own template; the loss text is cut out by the spans.

    Defined results: rows without conv_id are one conversation, as format_turns has it; a conversation of null or empty texts has
    the digests of its roles and line ends; no rows give none; other columns are ignored; output of another template raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row():
            n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        kinds = None
        for b in small_batches(batches):
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = []
            for c, seq, own, start, end, trained in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if seq == 0:
                    if state is not None:
                        out.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = _TURN.fullmatch(own).groups()
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[4] += len(own)
                if trained:
                    cut = unescape(own[start:end])
                    state[2] += len(cut)
                    state[3].update(cut.encode())
            yield _digest_batch(out, kinds)
        if state is not None:
            yield _digest_batch([row()], kinds)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    picked = formatted.select("conv_id", "seq", "formatted", "text_start", "text_end", "in_loss")
    return mapped(picked, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
