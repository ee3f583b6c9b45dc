"""Token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks. Two chunks are spliced at a place where both have a token boundary
and that is proven stable: no piece of the vocabulary holds the two characters at its sides next to each
other, so no merge can ever cross it and the tokens at either side don't depend on the other side. If an overlap has no
such place it is widened, to the last such place, at last to the splice before. Counts therefore equal those of the whole text.

Texts of one chunk are cut at the same kind of place (before a space after another character), and each cut part is
encoded once a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from rastervec.llm.common import ident, mapped, slices, texts_of

#: Characters of a chunk and of an overlap.
CHUNK, OVERLAP = 16384, 256
MOST_MEMO = 400_000
_PARTS = re.compile(r" *[^ ]+| +")


class Encoder:
    """A sentencepiece model with what is needed to splice: characters of each piece, and pairs that a piece joins."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        byte = [self.model.is_byte(i) for i in range(len(pieces))]
        plain = [p for i, p in enumerate(pieces) if not (byte[i] or self.model.is_control(i) or self.model.is_unknown(i))]
        #: characters that a token adds; the later bytes of a character add none
        self.adds = np.array([len(p) if not b else int(int(p[3:5], 16) & 0xC0 != 0x80) for p, b in zip(pieces, byte)], np.int64)
        self.joined = {(a, b) for p in plain for a, b in zip(p, p[1:])}
        self.joined_codes = np.sort(np.array([ord(a) << 32 | ord(b) for a, b in self.joined] or [0], np.uint64))
        self.words_stand_alone = not any(b == "▁" != a for a, b in self.joined)
        self.memo: dict[str, int] = {}

    def stable_places(self, text: str) -> np.ndarray:
        """The places between two characters that no piece holds next to each other."""
        codes = np.frombuffer(text.replace(" ", "▁").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        pairs = codes[:-1] << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.joined_codes, pairs), len(self.joined_codes) - 1)
        return np.flatnonzero(self.joined_codes[at] != pairs) + 1

    def starts(self, text: str) -> np.ndarray | None:
        """The character at which each token starts (-1: at the space that the model puts before); None if they don't add up."""
        ids = np.asarray(self.model.encode(text, num_threads=1), np.int64)
        adds = self.adds[ids]
        ends = np.cumsum(adds)
        return ends - np.maximum(adds, 1) - 1 if len(ids) and ends[-1] == len(text) + 1 else None

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """done: everything before it is counted, and it is 0 or a proven boundary.

        An overlap reaches back over the last stable place before the chunk's end; without one it is widened back over ``done``, and the next chunk is twice as
        long: a text without stable places is encoded about twice, not once for each chunk."""
        n, done, total, end = len(text), 0, 0, min(chunk, len(text))
        places = self.stable_places(text)
        a = self.starts(text[:end])
        while end < n and a is not None:
            to = min(n, end + chunk)
            last = np.searchsorted(places, end) - 1
            since = max(0, int(places[last] if last >= 0 and places[last] > done else done) - overlap)
            b = self.starts(text[since:to])
            if b is None:
                return len(self.model.encode(text, num_threads=1))
            b = b + since
            here = places[np.searchsorted(places, max(since, done), "right") : np.searchsorted(places, end)]
            common = np.intersect1d(np.intersect1d(a[(a > max(since, done)) & (a < end)], b), here)
            if len(common):
                total += int(((a >= done) & (a < common[-1])).sum() if done else (a < common[-1]).sum())
                done = int(common[-1])
            elif since > max(0, done - overlap):  # not aligned after all: again from ``done`` on
                b = self.starts(text[max(0, done - overlap) : to])
                if b is None:
                    return len(self.model.encode(text, num_threads=1))
                b = b + max(0, done - overlap)
            if not len(common):
                chunk *= 2
            a, end = b, to
        if a is None:
            return len(self.model.encode(text, num_threads=1))
        return total + int((a >= done).sum() if done else len(a))

    def counts(self, texts: list[str]) -> list[int]:
        texts = [t.replace("▁", " ") for t in texts]  # the model has one character for both
        parts = [_PARTS.findall(t) if len(t) <= CHUNK and self.words_stand_alone else None for t in texts]
        if len(self.memo) > MOST_MEMO:
            self.memo.clear()
        # after the first part, a part's first space is the one that the model puts before
        new = {p[1:] for ps in parts if ps for p in ps[1:]}
        new.update(ps[0] for ps in parts if ps)
        todo = [p for p in new if p not in self.memo]
        self.memo.update(zip(todo, map(len, self.model.encode(todo, num_threads=1)))) if todo else None
        self.memo[""] = 1  # a single space after another character; an empty text has no parts
        get = self.memo.__getitem__
        out = []
        for t, ps in zip(texts, parts):
            if ps:
                out.append(get(ps[0]) + sum(get(p[1:]) for p in ps[1:]))
            elif ps is None:
                out.append(self.count_long(t) if len(t) > CHUNK else len(self.model.encode(t, num_threads=1)))
            else:
                out.append(0)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One for each Python worker."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


def count_tokens(docs: DataFrame, model_file: str, *, text: str = "text", keep: list[str] | None = None, limit: int = 4096) -> DataFrame:
    """The columns ``keep`` (doc_id alone unless given) with n_bytes, n_tokens and over_limit of every whole text.

    A null text is empty: no bytes, no tokens. Rows are counted one by one, so repeated rows, ties and extra columns don't matter; an empty table gives none.
    model_file is a path that every executor has.
    """
    rows = docs.select(*(ident(c) for c in (["doc_id"] if keep is None else keep)), ident(text).alias("_text"))
    schema = rows.drop("_text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file)
        for batch in slices(batches, "_text", 4 << 20):
            col = texts_of(batch, "_text")
            n = np.array(own.counts(col.to_pylist()), np.int64)
            size = pa.array([len(t.encode()) for t in col.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_text"]).columns, size, pa.array(n), pa.array(n > limit)], names=schema.names)

    return mapped(rows, counted, schema)
