"""Chat formatting by a template that is a black box, rendered turn by turn.

A template is any function from a list of (role, text) turns to one string. Each prefix of a
conversation is rendered; as long as every rendering starts with the one before it, what was
added is the span of the new turn. Two more renderings, in which the new text is one letter
and then another, differ just where the text begins, which locates the text inside its span
without knowing the template. A template that changes what it wrote before is found out by
the first prefix that does not fit; such a conversation has no spans.

The default template marks turns and escapes control strings reversibly: of ``<``, any
backslashes and ``|`` in a text, one more backslash is put before the bar, so no text can
hold a mark.

Rows are dealt by conversation and sorted, and each task passes over its conversations as a
stream, holding one at a time. The work per conversation grows with the square of its turns,
which black-box prefixes imply.

Defined results: turns go by number, then role, then text; nulls come first and null roles
and texts count as empty. Rows that repeat are turns of their own. Rows with a null
conversation are one conversation. An empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>\n"
SPAN = "struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,loss:boolean>"
OUTPUT = f"conv_id bigint, formatted string, rewritten boolean, spans array<{SPAN}>"


def escape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    import re

    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain, flags=re.S)


def chat_template(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a text that ``chat_template`` wrote."""
    import re

    found = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", formatted, flags=re.S)
    return [(unescape_role(role), unescape(text)) for role, text in found]


def text_span(before: int, whole: str, one: str, other: str) -> tuple[int, int] | None:
    """Where the new text is in ``whole``, from renderings with the texts "a" and "b".

    None if the template does not put the text in one piece.
    """
    start = before
    while start < min(len(one), len(other)) and one[start] == other[start]:
        start += 1
    after = len(one) - start - 1
    end = len(whole) - after
    same = one[start:start + 1] == "a" and whole[before:start] == one[before:start]
    return (start, end) if same and end >= start and whole[end:] == one[start + 1:] else None


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[tuple] | None]:
    """The whole rendering, and per turn (start, end, text start, text end).

    No spans if some prefix changes what an earlier one wrote.
    """
    spans, before = [], template([])
    for i, (role, _) in enumerate(turns):
        now = template(turns[:i + 1])
        if not now.startswith(before):
            return template(turns), None
        probes = [template([*turns[:i], (role, letter)]) for letter in "ab"]
        text = text_span(len(before), now, *probes)
        spans.append((len(before), len(now), *(text or (None, None))))
        before = now
    return before, spans


def _format(template: Template, loss_roles: frozenset[str]):
    def done(conv_id, turns):
        formatted, spans = locate(template, turns)
        named = None if spans is None else [
            {"role": role, "start": s, "end": e, "text_start": ts, "text_end": te,
             "loss": role in loss_roles}
            for (role, _), (s, e, ts, te) in zip(turns, spans)
        ]
        return {"conv_id": conv_id, "formatted": formatted, "rewritten": spans is None,
                "spans": named}

    def run(batches):
        import pyarrow as pa

        span = pa.struct([
            ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()),
        ])
        schema = pa.schema([
            ("conv_id", pa.int64()), ("formatted", pa.string()), ("rewritten", pa.bool_()),
            ("spans", pa.list_(span)),
        ])
        current, turns, begun, rows, held = None, [], False, [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist()
                                             for c in ("conv_id", "role", "text"))):
                if begun and conv_id != current:
                    rows.append(done(current, turns))
                    held += len(rows[-1]["formatted"])
                    turns = []
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                current, begun = conv_id, True
                turns.append((role or "", text or ""))
        if begun:
            rows.append(done(current, turns))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def format_chats(
    rows: DataFrame, template: Template = chat_template, loss_roles=("assistant",)
) -> DataFrame:
    """One row per conversation: its text and where each turn and its text are in it.

    The loss mask is the text spans of the turns whose ``loss`` is true.
    """
    turns = rows.select("conv_id", "turn", "role", "text")
    sorted_rows = turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text"
    )
    return sorted_rows.mapInArrow(_format(template, frozenset(loss_roles)), OUTPUT)


def _digest(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        rows = []
        for conv in batch.to_pylist():
            formatted = conv["formatted"]
            if conv["rewritten"]:
                # Nothing can be told about single turns.
                rows.append((conv["conv_id"], None, None, None, None, len(formatted)))
                continue
            turns = read_back(formatted)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            masked = "".join(unescape(formatted[s["text_start"]:s["text_end"]])
                             for s in conv["spans"] if s["loss"])
            rows.append((
                conv["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(),
                len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted),
            ))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                   "formatted_chars"],
        )


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted chats of the default template, as digests.

    Of a chat whose template rewrote earlier turns only the id and the length are known.
    """
    return chats.mapInArrow(_digest, (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    ))
