"""Chat formatting in budgeted windows (operator 9).

Each turn is written as ``<turn>role, newline, text, newline, </turn>, newline``
with a backslash before every ``\\`` and ``<`` inside role and text, so no text
can pose as a marker and the template can be undone. A conversation longer than
the token budget is cut between turns: prefix sums of the turns' token counts
give the longest span that fits beside what a window repeats, namely the system
turn and the last few turns before it. A turn's tokens are those of its opening
with the role, of its escaped text and of its closing, each by itself. Loss spans cover the texts of assistant
turns that are new in their window; what is repeated is context and masked.

Conversations are handled as a stream of rows sorted by turn: memory holds the
turns of one window at most, however long a conversation or partition is.

Defined results: a null text or role is the empty string; rows that share a turn
number follow each other by role and text, repeated rows stay; where the next turn
doesn't fit beside what is repeated, the oldest repeated turn goes first and the
system turn last, so a window exceeds the budget only if it is a single turn that
does by itself: such a turn stays whole, however long; a null ``turn`` comes first;
a null ``conv_id`` is one conversation; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches, partitions_for, stage, text_of

BUDGET = 2048
HISTORY_TURNS = 2
#: Repeated history may take this share of a window's budget at most.
HISTORY_SHARE = 0.25
WINDOWS = "conv_id long, window int, context_turns int, new_turns int, tokens long, text string, loss_spans array<int>"

_BODY = r"[^<\\]*(?:\\.[^<\\]*)*"
_TURN = re.compile(rf"<turn>([^<\\\n]*(?:\\.[^<\\\n]*)*)\n({_BODY})\n</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _role_out(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _role_in(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


_CLOSING = "\n</turn>\n"


def _opening(role: str) -> str:
    return f"<turn>{_role_out(role)}\n"


def format_turn(role: str, text: str) -> str:
    return _opening(role) + escape(text) + _CLOSING


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Windows:
    """Cuts the turns of one conversation after another into windows."""

    def __init__(self, budget: int, history_turns: int, history_share: float):
        self.budget, self.keep, self.share = budget, history_turns, int(budget * history_share)
        self.conv: int | None = None
        self.begun = False
        self.rows: list[tuple] = []

    def start(self, conv: int | None) -> None:
        self.finish()
        self.conv, self.begun, self.window = conv, True, 0
        self.system: tuple[str, str, int] | None = None
        self.history: list[tuple[str, str, int]] = []
        self.pending: list[tuple[str, str, int]] = []
        self.cost, self.seen = 0, 0

    def add(self, role: str, formatted: str, tokens: int) -> None:
        turn = (role, formatted, tokens)
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        self.pending.append(turn)
        self.cost += tokens
        while self.pending and self._context_cost() + self.cost > self.budget and len(self.pending) > 1:
            self._cut()

    def finish(self) -> None:
        while self.begun and self.pending:
            self._cut()

    def _context(self) -> list[tuple[str, str, int]]:
        if not self.window:
            return []
        head = [self.system] if self.system else []
        return head + self.history

    def _context_cost(self) -> int:
        return sum(t[2] for t in self._context())

    def _cut(self) -> None:
        """Write the longest turn-aligned span that fits, one turn at least."""
        sums = np.cumsum([t[2] for t in self.pending])
        context = self._context()
        while context and sum(t[2] for t in context) + self.pending[0][2] > self.budget:
            del context[1 if len(context) > 1 and context[0] is self.system else 0]
        room = self.budget - sum(t[2] for t in context)
        n = max(1, int(np.searchsorted(sums, room, "right")))
        new, self.pending = self.pending[:n], self.pending[n:]
        self.cost -= int(sums[n - 1])
        text, spans, at = [], [], 0
        for k, (role, formatted, _) in enumerate(context + new):
            if k >= len(context) and role == "assistant":
                spans += [at + len(_opening(role)), at + len(formatted) - len(_CLOSING)]
            text.append(formatted)
            at += len(formatted)
        self.rows.append((self.conv, self.window, len(context), len(new), sum(t[2] for t in context + new), "".join(text), spans))
        self.window += 1
        # what the next window repeats: the last turns but the system turn, as far as their share goes
        history, left = [], self.share
        for turn in reversed((self.history + new)[-self.keep :] if self.keep else []):
            if turn is self.system or turn[2] > left:
                break
            history.insert(0, turn)
            left -= turn[2]
        self.history = history


def _cost_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Format and count each turn; runs before rows are dealt out by conversation."""
    from tidemark.llm._tokens import tokenizer

    encoder = tokenizer(path)
    closing = len(encoder.ids(_CLOSING)) // 4
    for batch in batches:
        roles, texts = text_of(batch.column(2)), text_of(batch.column(3))
        opening = {r: len(encoder.ids(_opening(r))) // 4 for r in set(roles)}
        formatted = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        tokens = [opening[r] + len(encoder.ids(escape(t))) // 4 + closing for r, t in zip(roles, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(formatted, pa.string()), pa.array(tokens, pa.int64())], ["conv_id", "turn", "role", "formatted", "tokens"])


def _window_batches(batches: Iterator[pa.RecordBatch], budget: int, history_turns: int, history_share: float) -> Iterator[pa.RecordBatch]:
    cutter, last = _Windows(budget, history_turns, history_share), object()
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())]

    def flushed() -> Iterator[pa.RecordBatch]:
        if cutter.rows:
            columns, cutter.rows = list(zip(*cutter.rows, strict=True)), []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in WINDOWS.split(", ")])

    for batch in batches:
        for conv, role, formatted, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if conv != last:
                cutter.start(conv)
                last = conv
            cutter.add(role, formatted, tokens)
        yield from flushed()
    cutter.finish()
    yield from flushed()


def format_windows(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE) -> DataFrame:
    """(conv_id, turn, role, text) -> formatted windows with their loss spans (pairs of code point offsets)."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    costed = rows.mapInArrow(lambda b: _cost_batches(b, tokenizer_path), "conv_id long, turn long, role string, formatted string, tokens long")
    placed = costed.repartition(partitions_for(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return placed.mapInArrow(lambda b: _window_batches(b, budget, history_turns, history_share), WINDOWS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = object(), None

    def row() -> pa.RecordBatch:
        conv, n, turns, chars, loss, formatted = state
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}], pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    done: list[pa.RecordBatch] = []
    for batch in batches:
        for conv, context, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 5, 6)), strict=True):
            if state is None or conv != last:
                if state:
                    done.append(row())
                last, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse_turns(text)[context:]:
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                said = unescape(text[a:b])
                state[3] += len(said)
                state[4].update(said.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        if len(done) >= 1000:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if state:
        done.append(row())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def digest(windows: DataFrame) -> DataFrame:
    """Undo the template of every window and describe each conversation."""
    bounded_batches(windows.sparkSession)
    placed = windows.repartition(partitions_for(windows), "conv_id").sortWithinPartitions("conv_id", "window")
    return placed.mapInArrow(_digest_batches, DIGEST)


def round_trip(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the windows to the shared folder, then read them back and describe each conversation."""
    return digest(stage(format_windows(conversations, tokenizer_path), "chat"))
