"""Token ids as binary blocks under Re-Pair grammar compression.

Documents are range-sorted by id and encoded; the ids of consecutive documents fill blocks of about ``BLOCK_IDS`` ids, the
shards of the format. In each block, frequent pairs of neighbouring symbols are replaced by nonterminals, again and again: a
round counts all pairs exactly and replaces up to ``BATCH`` of the most frequent ones, overlaps from the left, until none saves room.

A payload holds a header, the length of what each rule expands to, the rules, and the remaining symbols, all little-endian; symbols have as many bits as
they need. From the lengths follows where each symbol's ids begin, so any range of ids is decoded without the ids before it.

Blocks are rows of a table that Spark writes: a task that is lost leaves nothing behind and is run again.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastervec.llm.common import ident, mapped, slices, texts_of

END_ID = 2
BLOCK_IDS = 1 << 20
#: Pairs replaced in a round, how often a pair must occur (a rule takes about as much room as four symbols, and others take some of a pair's places), and bits of the table of pairs.
BATCH, LEAST, SLOTS = 4096, 8, 17
#: Characters of a text that are split at a time, and words that are kept with their ids.
PIECE, MOST_MEMO = 1 << 20, 1_200_000
#: New words that are encoded as one text.
JOINED_WORDS = 200
MAGIC, HEADER = b"RPG2", "<4s4I2Q"
BLOCKS = "part int, block int, doc_ids array<long>, n_tokens array<long>, n_ids long, payload binary"


#: The normaliser and the pre-tokenizer that let a text be taken apart at blanks, and full stops and commas off letters and digits.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: A full stop or comma that may belong to a longer piece with the mark before it.
_JOINED = re.compile("[^a-z0-9ß-öø-ÿ ][.,] ")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def takes_apart(spec: dict) -> bool:
    """Whether a tokenizer's file says that blanks part pieces, letters and marks are pieces of their own, and case is folded first."""
    parts = [(spec.get(k) or {}).get(name) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    return parts == [NORMALISER, SPLITTER] and not spec.get("truncation") and not spec.get("padding") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))


class Encoder:
    """A tokenizers file. If it takes texts apart at blanks, what stands between them is encoded once; else texts are encoded whole."""

    def __init__(self, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.model = Tokenizer.from_file(model_file)
        spec = json.loads(self.model.to_str())
        self.parts = takes_apart(spec)
        self.special = [t["content"].lower() for t in spec.get("added_tokens", [])]
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.memo: dict[str, bytes] = {"": b""}

    def _words(self, text: str) -> list[str]:
        """What stands between blanks. Where all agree on case (up to U+00FF, and no special string is about) it is folded before, and full stops and commas
        at the ends of words stand by themselves; so there are fewer different words."""
        low = text.lower().replace("\n", " ") + " "
        try:
            low.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if _JOINED.search(low) or any(t in low for t in self.special):
            return text.replace("\n", " ").split(" ")
        return low.replace(". ", " . ").replace(", ", " , ").split(" ")

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone, which are one piece each, are encoded many in a text: a piece ends with an id that says so."""
        single = list(filter(_LETTERS.fullmatch, words)) if self.ends is not None else []
        parts = [single[at : at + JOINED_WORDS] for at in range(0, len(single), JOINED_WORDS)]
        for part, e in zip(parts, self.model.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts, raw = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            self.memo.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
        if rest := [w for w in words if w not in self.memo]:
            self.memo.update(zip(rest, [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(rest, add_special_tokens=False)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.parts:
            return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.memo) > MOST_MEMO:
            self.memo = {"": b""}
        gc.disable()  # millions of strings come and go, none of them in a cycle
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        get, rows, todo = self.memo.get, [], set()
        for text in texts:
            if len(text) > PIECE:
                rows.append((text, None, ()))
                continue
            words = self._words(text)
            found, gaps, at = list(map(get, words)), [], -1
            with suppress(ValueError):  # index() finds no more
                while True:
                    at = found.index(None, at + 1)
                    gaps.append(at)
                    todo.add(words[at])
            rows.append((words, found, gaps))
        if todo:
            self._learn(list(todo))
        out = []
        for words, found, gaps in rows:
            for i in gaps:
                found[i] = self.memo[words[i]]
            out.append(b"".join(found) if found is not None else self._encode_long(words))
        return out

    def _encode_long(self, text: str) -> bytes:
        own, at = [], 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):  # a piece ends at a blank; without one it grows
                cut = text.rfind(" ", at, end)
                end = cut if cut > at else next((i for i in (text.find(" ", end),) if i > 0), len(text))
            words = self._words(text[at:end])
            if todo := set(words).difference(self.memo):
                self._learn(list(todo))
            own.append(b"".join(map(self.memo.__getitem__, words)))
            at = end
        return b"".join(own)


_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One for each Python worker."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


def compress(ids: np.ndarray, first: int, *, batch: int = BATCH, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule i is the pair of symbols that nonterminal first + i stands for. All ids are below ``first``.

    Rounds go on until no pair occurs ``least`` times, or a round takes less than a thousandth off."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    while len(seq) > 1 and first + len(rules) + batch < 1 << 32:
        # pairs of 16-bit symbols are sorted twice as fast
        kind, half, odd, bits = (np.uint32, np.uint32(16), np.uint32(2654435761), 32) if first + len(rules) + batch <= 1 << 16 else (np.uint64, np.uint64(32), np.uint64(0x9E3779B97F4A7C15), 64)
        slot_of = lambda keys, odd=odd, room=kind(bits - SLOTS): ((keys * odd) >> room).astype(np.int64)
        keys = (seq[:-1].astype(kind) << half) | seq[1:]
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        n = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        often = often[np.argsort(-n[often], kind="stable")[:batch]][::-1]
        chosen = ordered[edge[often]]
        # a table by hash; of pairs with one slot the more frequent is replaced in this round
        table, number = np.zeros(1 << SLOTS, kind), np.zeros(1 << SLOTS, np.int64)
        table[0] = 1  # an empty slot holds a key of another slot: 0 belongs to slot 0, 1 doesn't
        slots = slot_of(chosen)
        table[slots], number[slots] = chosen, np.arange(len(chosen))
        slot = slot_of(keys)
        at = np.flatnonzero(table[slot] == keys)
        new = np.append(True, np.diff(at) > 1)
        begin = at[new][np.cumsum(new) - 1]
        at = at[(at - begin) % 2 == 0]  # of overlapping pairs every other one, from the left
        used, which, times = np.unique(number[slot[at]], return_inverse=True, return_counts=True)
        worth = times >= least // 2  # others took some of its places; it comes again if they are many
        if not worth.any():
            break
        at, which = at[worth[which]], (np.cumsum(worth) - 1)[which[worth[which]]]
        seq[at] = (first + len(rules) + which).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        pairs = chosen[used[worth]]
        rules = np.concatenate([rules, np.stack([pairs >> half, pairs & kind((1 << int(half)) - 1)], 1).astype(np.uint32)])
        if 1000 * len(at) < len(seq):
            break
    return rules, seq


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """What all rules expand to, one after another, and the length of each."""
    lengths: list[int] = []
    for a, b in rules.tolist():  # a rule's parts are ids or earlier rules
        lengths.append((lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1))
    size = np.array(lengths, np.int64)
    begin = np.cumsum(size) - size
    rule = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(rule)) - begin[rule]
    left, right = (rules[:, k].astype(np.int64) for k in (0, 1)) if len(size) else (np.zeros(0, np.int64),) * 2
    half = np.where(left >= first, size[np.maximum(left - first, 0)], 1) if len(size) else left
    out, open_ = np.zeros(len(rule), np.uint32), np.arange(len(rule))
    while len(open_):  # each place goes down to the part it stands in, until that is an id
        r, o = rule[open_], offset[open_]
        first_part = o < half[r]
        symbol, o = np.where(first_part, left[r], right[r]), np.where(first_part, o, o - half[r])
        done = symbol < first
        out[open_[done]] = symbol[done]
        open_ = open_[~done]
        rule[open_], offset[open_] = symbol[~done] - first, o[~done]
    return out, size


def to_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits (32 at most), the lowest bit first."""
    start = np.arange(len(values), dtype=np.int64) * width
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    shifted = values.astype(np.uint64) << (start & 7).astype(np.uint64)
    for k in range((width + 14) // 8):  # bits of a number lie in so many bytes; two numbers meet in a byte in different bits
        np.add.at(out, (start >> 3) + k, ((shifted >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8))
    return out[: (len(values) * width + 7) // 8].tobytes()


def from_bits(data: bytes, width: int, n: int) -> np.ndarray:
    start = np.arange(n, dtype=np.int64) * width
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    word = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))[start >> 3]
    return ((word >> (start & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def pack(ids: np.ndarray, first: int) -> bytes:
    rules, seq = compress(ids, first)
    lengths = expansions(rules, first)[1]
    width = max(1, (first + len(rules) - 1).bit_length())
    head = struct.pack(HEADER, MAGIC, width, first, len(rules), 0, len(seq), len(ids))
    return head + lengths.astype("<u4").tobytes() + to_bits(np.concatenate([rules.ravel(), seq]), width)


class Packed:
    """A payload, open for reading."""

    def __init__(self, payload: bytes):
        magic, width, self.first, n_rules, _, n_symbols, self.n_ids = struct.unpack_from(HEADER, payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = struct.calcsize(HEADER)
        self.lengths = np.frombuffer(payload, "<u4", n_rules, at).astype(np.int64)
        symbols = from_bits(payload[at + 4 * n_rules :], width, 2 * n_rules + n_symbols)
        rules, self.seq = symbols[: 2 * n_rules].reshape(-1, 2), symbols[2 * n_rules :]
        self.flat, _ = expansions(rules, self.first)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.ends = np.cumsum(self._length(self.seq))

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.lengths[symbols[rule] - self.first]
        return out

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids from lo to hi; only the symbols that they stand under are expanded."""
        hi = self.n_ids if hi is None else hi
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, lo, "right"), np.searchsorted(self.ends, hi, "left") + 1
        symbols, ends = self.seq[a:b], self.ends[a:b]
        length = self._length(symbols)
        starts = ends - length - (ends[0] - length[0])
        out = np.empty(int(length.sum()), np.uint32)
        rule = symbols >= self.first
        out[starts[~rule]] = symbols[~rule]
        k, n = symbols[rule] - self.first, length[rule]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(starts[rule], n) + within] = self.flat[np.repeat(self.begin[k], n) + within]
        skip = lo - int(ends[0] - length[0])
        return out[skip : skip + hi - lo]


def encoded(docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, order: list[Column] | None = None) -> DataFrame:
    """BLOCKS rows; in the order of (part, block), and within a block, documents stand in ascending order of id, or of the columns ``order``.

    A null text is empty: its only id is the end. Null ids come first; rows with one id stand in the order of a hash of their text, and repeated
    rows are documents of their own. An empty table gives no block; a text longer than a block has a block alone.
    """
    body = F.coalesce(ident(text), F.lit(""))
    by = [ident(doc_id).cast("long"), F.xxhash64(body)] if order is None else order
    rows = docs.select(ident(doc_id).cast("long").alias("_id"), *(c.alias(f"_by{i}") for i, c in enumerate(by)), body.alias("_text"))
    keys = [f"_by{i}" for i in range(len(by))]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    tail = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, block = encoder(model_file), TaskContext.get().partitionId(), 0
        first = max(own.model.get_vocab_size(), end_id + 1)
        ids, held, total = [], [], 0

        def done() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(held), "<u4")
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), *lists, pa.array([len(raw)], pa.int64()), pa.array([pack(raw, first)], pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in slices(batches, "_text", 1 << 20):
            for i, e in zip(batch.column(0).to_pylist(), own.encode(texts_of(batch, "_text").to_pylist())):
                if held and total + len(e) // 4 + 1 > block_ids:
                    yield done()
                    ids, held, total, block = [], [], 0, block + 1
                ids.append(i)
                held.append(e + tail)
                total += len(held[-1]) // 4
        if held:
            yield done()

    return mapped(rows, blocks, BLOCKS)


def read_back(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a table of blocks, from the decoded ids."""
    sizes = blocks.select("part", "block", "n_ids")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    offsets = sizes.withColumn("_own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("_base") + F.col("_own")).alias("_offset"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, ids, n, payload = (batch.column(k)[i] for k in range(5))
                own = Packed(payload.as_py()).ids().astype("<u4")
                n = n.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(n)
                crc = [zlib.crc32(own[a:b].tobytes()) for a, b in zip(ends - n, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(n), pa.int32()), pa.array([block.as_py()] * len(n), pa.int32()), ids.values, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = mapped(blocks.select("part", "block", "doc_ids", "n_tokens", "payload"), decoded, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "block"]).select("doc_id", (F.col("_offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
