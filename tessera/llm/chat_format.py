"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Its successive prefixes are rendered and
consecutive outputs compared: where an output starts with the one before, the rest is the new turn's span, and where it
doesn't, the template rewrites history. Two probes in place of a turn's text show how much of the span is header and
footer, so the text's own span, and with it the loss mask, is found without knowing the template.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
PROBES = ("x", "yz")

_IN_TEXT, _IN_ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*) </turn>\n", re.S)


def escape(text: str, control: re.Pattern = _IN_TEXT) -> str:
    """A backslash before each character that could begin a control string; reversible."""
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _ESCAPED.sub(r"\1", text)


def _role_name(role: str) -> str:
    """Known roles by their names; others escaped, with a backslash in front where they would read like a name."""
    return NAMES.get(role) or ("\\" if role in NAMES.values() else "") + escape(role, _IN_ROLE)


def marked(turns: Sequence[Turn]) -> str:
    """The built-in template: `### Role: text </turn>` and a line end per turn, with control strings inside escaped."""
    return "".join(f"### {_role_name(role)}: {escape(text)} </turn>\n" for role, text in turns)


def parse_marked(output: str) -> list[Turn]:
    """The turns that `marked` rendered."""
    roles = {name: role for role, name in NAMES.items()}
    return [(roles.get(m[1], unescape(m[1])), unescape(m[2])) for m in _TURN.finditer(output)]


def _common(a: str, b: str) -> int:
    """Length of the common start of two strings."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] == b[:low] throughout
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    return low


def locate(turns: Sequence[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The output for all turns, and per turn (start, text start, text end, end) in it; None if history is rewritten.

    Each prefix is rendered as a whole. A turn whose header or footer can't be told from its text (the probes differ
    outside it) counts as rewritten as well.
    """
    before, spans = template([]), []
    for k in range(1, len(turns) + 1):
        head, (role, _) = list(turns[: k - 1]), turns[k - 1]
        now = template(turns[:k])
        if not now.startswith(before):
            return template(turns), None
        one, two = (template([*head, (role, probe)]) for probe in PROBES)
        start = _common(one, two)
        tail = len(one) - start - 1
        if tail < 0 or not one.startswith(before) or one[start + 1 :] != two[start + 2 :] or now[:start] != one[:start] or (tail and now[-tail:] != one[-tail:]):
            return template(turns), None
        spans.append((len(before), start, len(now) - tail, len(now)))
        before = now
    return before, spans


def format_chats(turns: DataFrame, template: Template = marked, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """Conversations as formatted text with turn spans and the loss mask: one row per conv_id.

    turns has conv_id, turn, role and text, one row per turn; the order is (turn, role, text), null first, and rows that
    repeat all of these are turns of their own. Null roles and texts count as empty. Each row without a conv_id is a
    conversation of its own, of one turn: which of them belong together isn't known. Columns: conv_id, n_turns,
    formatted, turn_spans and loss_spans (arrays of [start, end) in code points; loss_spans covers the texts of
    `trained` roles), rewrites (the template changes what it has rendered: the spans are then null). An empty table
    gives no rows; other columns are ignored.

    A conversation is rendered in one task, prefix by prefix, as a template sees it as a whole, so the work on one grows
    with its length times its turns, as for any black box. Conversations are as long as their own turns, not as the
    table; a very long text is held by its conversation's task only.
    """
    roles = frozenset(trained)
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    chats = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    chats = chats.unionAll(rows.filter("conv_id is null").select("conv_id", F.array("one").alias("turns")))

    def run(batches):
        import pyarrow as pa

        spans_kind = pa.list_(pa.list_(pa.int64()))
        for batch in (part for whole in batches for part in pieces(whole, "turns", 2_000)):
            out = []
            for chat in batch.column("turns"):
                said = [(t["role"], t["text"]) for t in chat.as_py()]
                text, spans = locate(said, template)
                loss = None if spans is None else [[s[1], s[2]] for s, (role, _) in zip(spans, said) if role in roles]
                out.append((len(said), text, None if spans is None else [[s[0], s[3]] for s in spans], loss, spans is None))
            kinds = [pa.int64(), pa.string(), spans_kind, spans_kind, pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[k] for r in out], kinds[k]) for k in range(5))], ["conv_id", "n_turns", "formatted", "turn_spans", "loss_spans", "rewrites"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewrites boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of `marked` says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The turns are parsed from the formatted text; the loss text is cut out by the mask and unescaped.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in (part for whole in batches for part in pieces(whole, "formatted")):
            out = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                turns = parse_marked(text)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                masked = "".join(unescape(text[a:b]) for a, b in loss or [])
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
