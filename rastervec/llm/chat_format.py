"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone under the loss
mask. Turns after the last assistant turn (or a conversation without any) make one more example without a trainable
part, so nothing is lost. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is written twice and
``<|`` as ``<\\|``, in roles also a line feed as ``\\n``; no control string can thus stand inside a text, and reading is exact.

The examples of a conversation of n turns hold O(n^2) text: that is what the expansion asks for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastervec.llm.common import ident, mapped

START, END = "<|im_start|>", "<|im_end|>\n"
EXAMPLE = "conv_id long, example long, is_last boolean, formatted string, loss_start long, loss_end long"
MOST_CHARS = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and from where to where its text is."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return turns


def _ids(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            yield from zip(*(batch.column(batch.schema.get_field_index(n)).slice(lo, 1024).to_pylist() for n in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars > MOST_CHARS or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each example (EXAMPLE); loss_start and loss_end are code points of ``formatted``, equal if nothing is trainable.

    Null roles and texts are empty ones. Null turns come first; turns with the same number follow by role and text, and repeated
    rows are turns of their own. Rows with a null conv_id are one conversation. An empty table gives no example. A
    conversation's rows come sorted to one task and are read one by one; only its formatted prefix is held.
    """
    rows = turns.select(ident(conv_id).cast("long").alias("conv_id"), ident(turn).alias("turn"), *(F.coalesce(ident(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("is_last", pa.bool_()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, prefix, ready, n, open_turns = object(), "", None, 0, False

        def closing():
            """What is left when a conversation ends: its last example, or the turns after it."""
            if open_turns:
                if ready is not None:
                    yield (*ready[:2], False, *ready[3:])
                yield (now, n, True, prefix, len(prefix), len(prefix))
            elif ready is not None:
                yield ready

        for conv, who, what in _ids(batches, "conv_id", "role", "text"):
            if conv != now:
                yield from closing()
                now, prefix, ready, n, open_turns = conv, "", None, 0, False
            piece, start, end = format_turn(who, what)
            if who == "assistant":
                if ready is not None:
                    yield (*ready[:2], False, *ready[3:])
                ready = (conv, n, True, prefix + piece, len(prefix) + start, len(prefix) + end)
                n, open_turns = n + 1, False
            else:
                open_turns = True
            prefix += piece
        yield from closing()

    return mapped(rows, lambda batches: _batches(expanded(batches), schema, lambda r: len(r[3])), EXAMPLE)


def read_back(examples: DataFrame) -> DataFrame:
    """From format_chats()' rows, for each conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_examples.

    Every formatted text is parsed by itself; the text under the masks is then hashed in order, row by row.
    """
    each = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, example, last, formatted, start, end in _ids(batches, *schema_names):
            digest, turns = None, []
            if last:
                turns, h = parse(formatted), hashlib.sha256()
                for who, what in turns:
                    h.update(f"{who}\n{what}\n".encode())
                digest = h.hexdigest()
            yield conv, example, len(turns), digest, unescape(formatted[start:end]), len(formatted)

    schema_names = ("conv_id", "example", "is_last", "formatted", "loss_start", "loss_end")
    rows = mapped(examples, lambda b: _batches(parsed(b), each, lambda r: len(r[4])), "conv_id long, example long, n_turns long, turns_sha256 string, loss string, formatted_chars long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = object(), None
        for conv, _, n, digest, loss, chars in _ids(batches, *each.names):
            if conv != now:
                if held:
                    yield (now, held[0], held[1], held[2], held[3].hexdigest(), held[4], held[5])
                now, held = conv, [0, None, 0, hashlib.sha256(), 0, 0]
            held[0], held[1] = (n, digest) if digest else held[:2]
            held[2] += len(loss)
            held[3].update(loss.encode())
            held[4] += chars
            held[5] += 1
        if held:
            yield (now, held[0], held[1], held[2], held[3].hexdigest(), held[4], held[5])

    return mapped(rows, lambda b: _batches(digests(b), out, lambda r: 1), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
