r"""Chat formatting by columnar byte assembly, with a reversible escape and a loss mask.

A turn becomes one segment; a conversation's text is its segments in order, nothing between:

    system     <s>[SYS] text [/SYS]
    user       <s>[INST] text [/INST]
    assistant  <s>[ANS] text </s>
    another    <s>[ROLE] role [|] text [/ROLE]

Control strings inside texts and roles get one backslash before them and before the backslashes that
they follow; reading takes it away.  Control strings of the template follow a blank or begin the
segment, so they never look escaped.  The loss mask covers the (escaped) text of assistant turns.

Turns are shuffled by conversation and sorted; a task assembles runs of whole conversations at once, in numpy: the lengths of all
pieces of all segments, their running sums as offsets, and for each kind of piece the places where its bytes go in
one buffer of the final size, which is the data of the Arrow column.  Conversations are slices of it.

A conversation is one row up to ``PIECE_BYTES``; a longer one goes on in further rows (``piece``), cut between turns, so a
conversation that holds a third of all turns is written in bounded memory.  ``digests`` reads turns and loss texts back from
the formatted text alone.  A hash over a whole conversation can't be split, so it is one task's stream.

Edge cases: null roles and texts are empty; rows of one turn number are ordered by role and text;
null turns come first; null conv_ids are one conversation; repeated rows are repeated turns; further columns of turns
have no place in a conversation and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .textbytes import flat, slices, strings

PIECE_BYTES = 1 << 20
#: Before and after the text of each role; the last is for any other role.
ROLES = ("system", "user", "assistant")
HEADS = (b"<s>[SYS] ", b"<s>[INST] ", b"<s>[ANS] ", b"<s>[ROLE] ")
TAILS = (b" [/SYS]", b" [/INST]", b" </s>", b" [/ROLE]")
BETWEEN = b" [|] "
CONTROL = r"(?:</?s>|\[/?INST\]|\[/?SYS\]|\[ANS\]|\[/?ROLE\]|\[\|\])"
_ESCAPED = re.compile(r"\\(\\*" + CONTROL + ")")
_OWN = re.compile(r"(?<!\\)" + CONTROL)


def escape(column: pa.Array) -> pa.Array:
    """A backslash more before each control string (null: empty)."""
    return pc.replace_substring_regex(pc.fill_null(column, ""), r"(\\*" + CONTROL + ")", r"\\\1")


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _scatter(out: np.ndarray, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
    """Copy the spans of ``data``, of these sizes one after another, to the places ``at`` of ``out``."""
    first = np.cumsum(sizes) - sizes
    out[np.arange(len(data)) + np.repeat(at - first, sizes)] = data


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns' segments, their n + 1 offsets, and the loss range of each in code points of its segment."""
    n = batch.num_rows
    role = pc.fill_null(batch.column("role"), "")
    code = np.asarray(pc.fill_null(pc.index_in(role, pa.array(ROLES)), len(ROLES))).astype(np.int64)
    named = code == len(ROLES)
    texts = escape(batch.column("text"))
    others = escape(pc.if_else(pa.array(named), role, ""))
    body, body_at = flat(texts)
    other, other_at = flat(others)
    head, tail = (np.array([len(x) for x in parts])[code] for parts in (HEADS, TAILS))
    between = np.where(named, len(BETWEEN), 0)
    # the pieces of a segment in order: head, role, what is between, text, tail
    sizes = np.stack([head, np.diff(other_at), between, np.diff(body_at), tail], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5) if n else sizes
    at = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k in range(len(HEADS)):
        some = code == k
        for column, piece in ((0, HEADS[k]), (4, TAILS[k])):
            out[at[some, column][:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    out[at[named, 2][:, None] + np.arange(len(BETWEEN))] = np.frombuffer(BETWEEN, np.uint8)
    _scatter(out, other, at[:, 1], sizes[:, 1])
    _scatter(out, body, at[:, 3], sizes[:, 3])
    chars = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    answer = code == ROLES.index("assistant")
    loss = np.stack([np.where(answer, head, 0), np.where(answer, head + chars, 0)], axis=1)
    length = sizes[:, [0, 2, 4]].sum(1) + np.asarray(pc.utf8_length(others)).astype(np.int64) + chars
    return out, np.append(0, ends[:, -1]), loss, length


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows have another conv_id than the row before (the first: true)."""
    codes = np.asarray(batch.column("conv_id").dictionary_encode(null_encoding="encode").indices)
    return np.append(True, codes[1:] != codes[:-1])[: len(codes)]


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    return flat(batch.column("role"))[1] + flat(batch.column("text"))[1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in batches of whole conversations; only one of ``PIECE_BYTES`` or more may be cut, between turns."""

    def several(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts, size, at = np.append(np.flatnonzero(_changes(batch)), batch.num_rows), _bytes(batch), 0
        while at < batch.num_rows:
            k = np.searchsorted(size[starts], size[at] + PIECE_BYTES, "right") - 1
            end = int(starts[k]) if starts[k] > at else int(starts[np.searchsorted(starts, at, "right")])
            if size[end] - size[at] > PIECE_BYTES:
                yield from slices(iter([batch.slice(at, end - at)]), limit=PIECE_BYTES)
            else:
                yield batch.slice(at, end - at)
            at = end

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = int(np.flatnonzero(_changes(batch))[-1])
        held = batch.slice(last)
        if _bytes(held)[-1] >= PIECE_BYTES:
            last, held = batch.num_rows, None
        if last:
            yield from several(batch.slice(0, last))
    if held is not None:
        yield held


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of sorted turns."""
    before, count = None, 0
    for batch in _runs(batches):
        n = batch.num_rows
        data, ends, loss, length = _segments(batch)
        new = _changes(batch)
        begin = np.flatnonzero(new)
        row = np.cumsum(new) - 1
        # places in code points from the row's begin on
        at = np.cumsum(length) - length
        spans = loss + (at - at[begin][row])[:, None]
        some = loss[:, 1] > 0
        bounds = np.append(0, np.cumsum(np.bincount(row[some], minlength=len(begin))))
        held = pa.StructArray.from_arrays([pa.array(spans[some, 0]), pa.array(spans[some, 1])], ["first", "last"])
        ids = batch.column("conv_id").take(pa.array(begin))
        piece = np.zeros(len(begin), np.int64)
        if before is not None and before.equals(ids[0]):
            piece[0] = count
        before, count = ids[-1], int(piece[-1]) + 1
        turns = np.diff(np.append(begin, n))
        text = strings(data, ends[np.append(begin, n)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(piece), pa.array(turns), text, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), held)], names=["conv_id", "piece", "n_turns", "formatted", "loss_spans"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss_spans) of ``conversations`` (conv_id, turn, role, text).

    ``loss_spans`` is the loss mask: half-open ranges of the row's code points, one for each assistant turn.  A
    conversation's rows come one after another, by ``piece``.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    new = "piece long, n_turns long, formatted string, loss_spans array<struct<first:long,last:long>>"
    schema = StructType([turns.schema["conv_id"], *StructType.fromDDL(new).fields])
    return ordered.mapInArrow(_assemble, schema)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation, found by the template's own control strings alone."""
    out, own = [], [m.span() for m in _OWN.finditer(formatted)]
    at = 0
    while at < len(own):
        head = formatted[own[at][0] : own[at + 1][1]] + " "
        kind = HEADS.index(head.encode())
        first = own[at + 1][1] + 1
        if kind < len(ROLES):
            role, at = ROLES[kind], at + 2
        else:
            role, first, at = unescape(formatted[first : own[at + 2][0] - 1]), own[at + 2][1] + 1, at + 3
        out.append((role, unescape(formatted[first : own[at][0] - 1])))
        at += 1
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = None

    def rows(done: list[list]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    def closed(s: list) -> list:
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done, kind = [], batch.schema.field("conv_id").type
        for conv, piece, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "formatted", "loss_spans")), strict=True):
            if piece == 0:
                if state is not None:
                    done.append(closed(state))
                state = [conv, 0, sha256(), 0, sha256(), 0]
            for role, text in read_turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in spans:
                learnt = unescape(formatted[span["first"] : span["last"]])
                state[3] += len(learnt)
                state[4].update(learnt.encode())
            state[5] += len(formatted)
        if done:
            yield rows(done)
    if state is not None:
        yield rows([closed(state)])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation of ``format_conversations``, read back from its text: turns and digests of turns and of the loss texts.

    It takes the rows as they come from there, without a shuffle.
    """
    schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    return formatted.mapInArrow(_digest, schema)
