"""Chat formatting with turn spans found by incremental black-box rendering.

A template is any function from messages to text. A conversation is rendered turn by turn; comparing each output
with the one before shows the span that the new turn takes. Rendering the turn with two probe texts instead of
its own shows where in the span its text begins. If an output does not begin with the one before, the template
has rewritten history; then the spans are looked for anew in the final output, by probing every turn.

All prefixes of a conversation are compared, at every length, which is quadratic in its turns. A template that declares itself ``local``
(each turn's output depends on that turn alone) is spared this: its turns are rendered in windows, each by its own successive prefixes, and the
windows' outputs laid end to end are held against one rendering of the whole. If they differ after all, all prefixes are rendered.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm._common import partitions

Message = tuple[str, str]
Template = Callable[[list[Message]], str]
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PROBES = ("\x01", "\x02")
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    """Put a backslash into every opening of a control string, also into one that has backslashes already."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(messages: list[Message]) -> str:
    """The default template; control strings inside roles and texts are escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in messages)


chatml.local = True


def parse(formatted: str) -> list[Message]:
    """The messages of a text that ``chatml`` made."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _first_difference(a: str, b: str) -> int:
    """The length of the common beginning."""
    return len(os.path.commonprefix([a, b]))


def _content(before: list[Message], turn: Message, after: list[Message], rendered: str, template: Template, shared: int = 0) -> tuple[int, int] | None:
    """Where the text of ``turn`` lies in ``rendered``, or nothing if the template leaves it out.

    Two probes that differ in their only character show the place; the rest of the output shows the length.
    ``shared`` characters at the start are known to be the same in all outputs.
    """
    one, two = (template([*before, (turn[0], p), *after]) for p in _PROBES)
    if one == two:
        return None
    start = shared + _first_difference(one[shared:], two[shared:])
    return start, start + len(rendered) - (len(one) - 1)


Spans = list[tuple[int, int, int, int]]
#: Turns of a window of a local template.
WINDOW = 16


def _prefixes(messages: list[Message], template: Template) -> tuple[str, Spans, bool]:
    """The last output, the spans of the turns by successive prefixes, and whether a prefix rewrote the one before."""
    spans: Spans = []
    output = template([])
    for k, turn in enumerate(messages):
        new = template(messages[: k + 1])
        if not new.startswith(output):
            return template(messages), spans, True
        text = _content(messages[:k], turn, [], new, template, len(output))
        spans.append((len(output), len(new), *(text or (-1, -1))))
        output = new
    return output, spans, False


def _windows(messages: list[Message], template: Template) -> tuple[str, Spans] | None:
    """The output and spans laid end to end from windows of turns, or nothing where the template does not allow that."""
    head = template([])
    pieces, spans, at = [head], [], len(head)
    for start in range(0, len(messages), WINDOW):
        output, found, rewritten = _prefixes(messages[start : start + WINDOW], template)
        if rewritten or not output.startswith(head):
            return None
        spans += [tuple(x if x < 0 else x - len(head) + at for x in span) for span in found]
        pieces.append(output[len(head) :])
        at += len(output) - len(head)
    whole = template(messages)
    return (whole, spans) if whole == "".join(pieces) else None


def render(messages: list[Message], template: Template = chatml) -> tuple[str, Spans, bool]:
    """The output, for each turn (start, end, start of its text, end of its text), and whether history was rewritten.

    All prefixes are rendered and compared, whose work grows with the square of the turns, unless the template declares by an attribute
    ``local`` that what it writes for a turn does not depend on other turns. Such a template is rendered in windows, which are held against one rendering of the whole.

    A turn that does not show in the output has the span (-1, -1, -1, -1).
    """
    if getattr(template, "local", False) and len(messages) > WINDOW and (found := _windows(messages, template)):
        return *found, False
    output, spans, rewritten = _prefixes(messages, template)
    if rewritten:
        spans = []
        for k, turn in enumerate(messages):
            text = _content(messages[:k], turn, messages[k + 1 :], output, template)
            spans.append((*text, *text) if text else (-1, -1, -1, -1))
    return output, spans, rewritten


_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.large_string()), ("rewritten", pa.bool_()), ("spans", pa.list_(pa.struct([(n, pa.int32() if n == "turn" else pa.int64()) for n in ("turn", "start", "end", "text_start", "text_end")] + [("loss", pa.bool_())])))])
_DDL = "conv_id long, formatted string, rewritten boolean, spans array<struct<turn:int,start:long,end:long,text_start:long,text_end:long,loss:boolean>>"


def format_conversations(turns: DataFrame, template: Template = chatml, loss_role: str = LOSS_ROLE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation as one text, with the spans of its turns and the loss mask.

    :return: ``conv_id``, ``formatted``, ``rewritten``, ``spans`` (per turn its place, the place of its text, and
        whether the text bears loss).

    Turns are ordered by their number, ties and repeated rows by role and text; null numbers come first. Null
    roles and texts count as empty. Rows with a null conversation form one conversation. An empty table gives
    an empty result. The rows of a conversation are read as a sorted stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        messages: list[Message] = []
        begun = False

        def done() -> dict:
            text, spans, rewritten = render(messages, template)
            marked = [{"turn": i, "start": a, "end": b, "text_start": c, "text_end": d, "loss": role == loss_role and c >= 0} for i, ((a, b, c, d), (role, _)) in enumerate(zip(spans, messages, strict=True))]
            return {"conv_id": current, "formatted": text, "rewritten": rewritten, "spans": marked}

        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and conv != current:
                    out.append(done())
                    messages.clear()
                current, begun = conv, True
                messages.append((role or "", text or ""))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)
        if begun:
            yield pa.RecordBatch.from_pylist([done()], schema=_OUT)

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, _DDL)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from conversations in the default template.

    :return: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``,
        ``rewritten``.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in row["spans"] if s["loss"])
                out.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text), "rewritten": row["rewritten"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
