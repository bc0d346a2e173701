"""Chat formatting by columnar byte assembly, and its exact inverse.

Rows of one conversation are brought together in turn order. For a whole Arrow batch the
lengths of all segments (header, content, footer of each turn) are known at once; their
cumulative sums are the places in one preallocated buffer, and numpy scatters headers,
contents and footers into it without building a string for any turn.

Template: a user turn is `<s>[INST] text [/INST]`, an assistant turn ` text</s>`, a system
turn `<<SYS>>` line, text, `<</SYS>>` line, any other role `[ROLE name] text[/ROLE]`. A
control string inside a text gets a backslash after its first character (one more where
there are some), so texts never hold a control string and the inverse removes one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

#: Header and footer of each role.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER = ("[ROLE {}] ", "[/ROLE]")
CONTROL = r"/?s>|</?SYS>>|/?INST\]|ROLE |/ROLE\]"
ESCAPE, ESCAPED = rf"([<\[])(\\*)({CONTROL})", r"\1\2\\\3"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
TURN = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,length:bigint>>"
SCATTER, BATCH_BYTES = 1_000_000, 8_000_000
_LIMIT = (1 << 31) - 1


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (OTHER[0].format(quote(role, safe="")), OTHER[1])


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _bytes_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and offsets of a string column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)), at


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pieces that hold about SCATTER bytes together, so that arrays of their bytes stay small; a longer
    piece stands alone."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SCATTER, "right")))
        yield at, stop
        at = stop


def _scatter(out: np.ndarray, places: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy values[starts : starts + lengths] to out[places ...], all pieces of a group at once."""
    for a, b in _groups(lengths):
        if b == a + 1:
            out[places[a] : places[a] + lengths[a]] = values[starts[a] : starts[a] + lengths[a]]
        else:
            size = lengths[a:b]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(places[a:b], size) + step] = values[np.repeat(starts[a:b], size) + step]


def _letters(raw: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code points of raw[places : places + lengths], pieces that follow one another."""
    count, some = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    for a, b in _groups(lengths[some]):
        own = some[a:b]
        begin, end = places[own[0]], places[own[-1]] + lengths[own[-1]]
        heads = (raw[begin:end] & 0xC0) != 0x80
        count[own] = np.count_nonzero(heads) if b == a + 1 else np.add.reduceat(heads, places[own] - begin, dtype=np.int64)
    return count


def assemble(roles: pa.StringArray, contents: pa.StringArray, first: np.ndarray) -> tuple[pa.StringArray, pa.ListArray]:
    """Formatted text and loss spans of each conversation of a batch. first: whether a row begins one."""
    n = len(roles)
    names = roles.dictionary_encode()
    known = [marks(r) for r in names.dictionary.to_pylist()]
    kind = np.asarray(names.indices)
    contents = pc.replace_substring_regex(contents, pattern=ESCAPE, replacement=ESCAPED)
    body, at = _bytes_of(contents)
    pieces = [np.frombuffer("".join(m[side] for m in known).encode(), np.uint8) for side in (0, 1)]
    sizes = [np.array([len(m[side].encode()) for m in known], np.int64) for side in (0, 1)]
    begins = [np.cumsum(s) - s for s in sizes]
    lengths = np.stack([sizes[0][kind], at[1:] - at[:-1], sizes[1][kind]], axis=1)
    places = np.concatenate([[0], np.cumsum(lengths)])
    total, places = int(places[-1]), places[:-1].reshape(n, 3)
    out = np.empty(total, np.uint8)
    _scatter(out, places[:, 0], pieces[0], begins[0][kind], lengths[:, 0])
    _scatter(out, places[:, 1], body, at[:-1], lengths[:, 1])
    _scatter(out, places[:, 2], pieces[1], begins[1][kind], lengths[:, 2])
    starts = np.flatnonzero(first)
    if total > _LIMIT:
        raise ValueError("one conversation is longer than a value can be (2 GiB)")
    offsets = np.append(places[starts, 0], total).astype(np.int32)
    text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(out))
    count = _letters(out, places.ravel(), lengths.ravel())
    before = (np.cumsum(count) - count).reshape(n, 3)
    owner = np.cumsum(first) - 1
    chosen = np.flatnonzero(kind == _index(names.dictionary, "assistant"))
    low = before[chosen, 1] - before[starts[owner[chosen]], 0]
    size = count.reshape(n, 3)[chosen, 1]
    spans = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(size, pa.int64())], names=["start", "length"])
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[chosen], minlength=len(starts)))]).astype(np.int32)
    return text, pa.ListArray.from_arrays(pa.array(cuts), spans)


def _index(dictionary: pa.Array, value: str) -> int:
    return pc.index(dictionary, value).as_py()


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_col, formatted string, loss_spans array<struct<start,
    length>> (code points of `formatted` that hold assistant texts, escaped as they stand there).

    Rows are ordered by turn (null first), ties by role and text; null roles and texts count as
    empty, repeated rows stay; rows with a null conversation id form one conversation. Other columns
    are not read. One shuffle, by conversation. A conversation is one output value, so its size
    bounds a task's memory, and one of over 2 GiB fails with a message; others are put together by bytes.
    """
    small_batches(turns.sparkSession)
    key_type = turns.schema[conv_col].dataType.simpleString()
    ready = turns.select(
        F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )
    ready = ready.repartition("__conv").sortWithinPartitions("__conv", "__turn", "__role", "__text").select("__conv", "__role", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of conversations that may go on

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            conv, role, text = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns)
            first = _begins(conv)
            formatted, spans = assemble(role, text, first)
            return pa.RecordBatch.from_arrays([conv.take(pa.array(np.flatnonzero(first))), formatted, spans], names=[conv_col, "formatted", "loss_spans"])

        for batch in text_batches(batches, 2, 4096, BATCH_BYTES):
            begins = np.flatnonzero(_begins(batch.column(0)))
            same = held and held[-1].column(0)[-1] == batch.column(0)[0]
            cut = int(begins[-1])  # the last conversation of this batch stays
            if cut or not same:
                done = [*held, batch.slice(0, cut)] if cut else held
                if sum(p.num_rows for p in done):
                    yield finish(done)
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield finish(held)

    return ready.mapInArrow(run, f"`{conv_col}` {key_type}, formatted string, loss_spans {SPANS}")


def _begins(conv: pa.Array) -> np.ndarray:
    """Whether a row's conversation differs from that of the row before."""
    n = len(conv)
    out = np.ones(n, bool)
    if n > 1:
        a, b = conv.slice(1), conv.slice(0, n - 1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~np.asarray(equal.to_numpy(zero_copy_only=False), bool)
    return out


def parse(formatted: str) -> list[dict]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (head, foot) in MARKS.items():
            if formatted.startswith(head, at):
                break
        else:
            end = formatted.index("] ", at)
            role, head, foot = unquote(formatted[at + len("[ROLE ") : end]), formatted[at : end + 2], OTHER[1]
        start = at + len(head)
        end = formatted.index(foot, start)
        turns.append({"role": role, "text": unescape(formatted[start:end])})
        at = end + len(foot)
    return turns


def read_conversations(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: conv_col, turns array<struct<role, text>> and loss_text,
    the text under the loss spans, unescaped, with nothing between. Null reads as no turns."""
    key_type = formatted.schema[conv_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1, 512, BATCH_BYTES):
            whole = [x or "" for x in batch.column(1).to_pylist()]
            loss = ["".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans or []) for text, spans in zip(whole, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(t) for t in whole], kind), pa.array(loss, pa.string()), batch.column(1)], names=[conv_col, "turns", "loss_text", "formatted"])

    return formatted.select(conv_col, "formatted", "loss_spans").mapInArrow(run, f"`{conv_col}` {key_type}, turns {TURN}, loss_text string, formatted string")
