"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``least`` (400) bytes over it also starts anywhere else. Shorter strings, of ``short`` (256) bytes, are judged in the same sort: they
remove nothing, but name the passages of over fifty words that repeat. A window is such a shorter string, by its first byte.

1. Suffix buckets. The bucket of a window is set by its anchor, the least of the hashes of short strings in its first
   ``2^k`` bytes: equal windows have equal anchors, so they share a bucket. Neighbouring windows with one anchor make
   a run, which is stored once, as hashes. Buckets met once in the whole corpus are done. Where whole runs are equal, all their windows repeat.
2. What is left are runs that share a bucket but differ: the ends of repeated passages. Their bytes, one copy of each different run, are
   sent to their bucket's task, and the task sorts the suffixes of one block of buckets at a time:
   a difference cover D modulo v holds, for any two places, a shift d < v that takes both into D. Cover places are ranked once by a
   fixed length of their suffix; suffixes are sorted by their first v bytes only, and longer ties are resolved by comparing ranks d places
   on. So ties of any length cost a look-up, and memory is bounded by the block. Equal windows are told apart further by the ``least`` bytes.
3. The found strings are united for each document, and the remaining bytes are hashed.

A bucket with more than ``HEAVY`` different runs (a passage between ever new neighbours) is never gathered: its strings are counted one by one
by their 128-bit hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastervec.llm.common import bytes_of, discard, ident, mapped, sized, slices, stored, texts_of

LEAST, SHORT = 400, 256
#: A passage is a maximal repeated run of more whole words than this.
PASSAGE_WORDS = 50
#: Bytes that are hashed at a time, bytes of a block of suffix buckets, runs of a bucket.
PIECE, BLOCK_BYTES, HEAVY = 1 << 20, 2 << 20, 8192
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shape(least: int) -> tuple[int, int, int]:
    """Anchor places of a window (a power of 2), bytes that are hashed at each, and bytes from the anchor on that all its windows share."""
    if least < 16:
        raise ValueError("windows have 16 bytes at least")
    places = 1 << ((least * 2 // 3).bit_length() - 1)
    return places, min(32, (least - places + 1) // 8 * 8), least - places + 1


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes at each place as a number; data ends with eight bytes of padding."""
    return np.ndarray((len(data) - 7,), f"{order}u8", data, strides=(1,)).astype(np.uint64)


def runs(raw: np.ndarray, at: np.ndarray, least: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """For the documents raw[at[i]:at[i + 1]]: (document, first window, windows, anchor) of all runs, places counted in raw."""
    places, gram, _ = shape(least)
    low = np.uint64((1 << 24) - 1)
    n = len(raw)
    for lo in range(0, max(0, n - least + 1), piece):
        hi = min(lo + piece, n - least + 1)
        data = np.zeros(hi - lo + least + 8, np.uint8)
        part = raw[lo : hi + least - 1]
        data[: len(part)] = part
        w = words_at(data, "<")
        m = hi - lo + places - 1
        h = np.zeros(m, np.uint64)
        for k in range(gram // 8):
            h += w[8 * k : 8 * k + m] * _MIX[k]
        h ^= h >> np.uint64(32)
        h *= _MIX[4]
        h = (h & ~low) | np.arange(m, dtype=np.uint64)
        step = 1
        while step < places:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        anchor = (h & low).astype(np.int64) + lo
        start = np.arange(lo, hi)
        doc = np.searchsorted(at, start, "right") - 1 if len(at) > 2 else np.zeros(hi - lo, np.int64)
        ok = start + least <= at[doc + 1]
        start, doc, anchor = start[ok], doc[ok], anchor[ok]
        if len(start):
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
            yield doc[new], start[new], np.diff(np.append(new, len(start))), anchor[new]


RUN = "id long, h long, bucket long, run long, first long, n int, m int"


def run_table(docs: DataFrame, least: int, short: int) -> DataFrame:
    """Runs of all documents of (id, h, text): hash of the bucket, hash of the run's bytes, place of its first window, number of windows, and bytes up
    to where strings of ``least`` bytes from these windows end, or the document does."""
    shared = shape(short)[2]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            raw, at = bytes_of(texts_of(batch, "text"))
            view = memoryview(raw)
            for doc, first, n, anchor in runs(raw, at, short):
                m = np.minimum(n + least - 1, at[doc + 1] - first)
                bucket = b"".join([xxhash.xxh3_64_digest(view[a : a + shared]) for a in anchor.tolist()])
                run = b"".join([xxhash.xxh3_64_digest(view[a : a + k], seed=c) for a, k, c in zip(first.tolist(), m.tolist(), n.tolist())])
                which = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array(np.frombuffer(bucket, "<i8")), pa.array(np.frombuffer(run, "<i8")), pa.array(first - at[doc]), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32))],
                    names=["id", "h", "bucket", "run", "first", "n", "m"],
                )

    return mapped(docs, found, RUN)


def difference_cover(v: int) -> list[int]:
    """A small set with every difference modulo v: greedily, the number that adds the most new ones."""
    cover, have = [0], {0}
    while len(have) < v:
        gain = {x: {(x - c) % v for c in cover} | {(c - x) % v for c in cover} for x in range(v) if x not in cover}
        best = max(gain, key=lambda x: (len(gain[x] - have), -x))
        cover.append(best)
        have |= gain[best]
    return sorted(cover)


class Block:
    """Ranks of the cover places of a text, by the length bytes from there on."""

    def __init__(self, data: np.ndarray, least: int):
        self.v = v = 32 if least >= 128 else 8
        cover = difference_cover(v)
        size = len(data)
        self.length = (least - v + 1) // v * v
        self.word = words_at(np.concatenate([data, np.zeros(8, np.uint8)]), ">")
        inside = np.isin(np.arange(size) % v, cover)
        places = np.flatnonzero(inside)
        self.number = np.full(size + 1, len(places), np.int64)
        self.number[places] = np.arange(len(places))
        order = np.lexsort([self.word[np.minimum(places + 8 * k, size)] for k in range(v // 8 - 1, -1, -1)])
        same = np.ones(len(places), bool)
        for k in range(v // 8):
            w = self.word[np.minimum(places + 8 * k, size)][order]
            same[1:] &= w[1:] == w[:-1]
        same[:1] = False
        first = np.zeros(len(places) + 1, np.int64)
        first[order] = np.cumsum(~same)
        blocks, have, doubled = self.length // v, 0, first
        rank, width = None, 1
        while width <= blocks:  # rank of a length that is a sum of doubled lengths
            if blocks & width:
                rank = doubled if rank is None else self._joined(rank, doubled, places, have * v)
                have += width
            width *= 2
            if width <= blocks:
                doubled = self._joined(doubled, doubled, places, width // 2 * v)
        self.rank = rank
        member = np.zeros(v, bool)
        member[cover] = True
        self.shift = np.array([[next(d for d in range(v) if member[(a + d) % v] and member[(b + d) % v]) for b in range(v)] for a in range(v)])
        self.tail = sorted({*range(self.length, least - 8, 8), least - 8}) if self.length < least else []

    def _joined(self, a: np.ndarray, b: np.ndarray, places: np.ndarray, distance: int) -> np.ndarray:
        """Ranks by a, then by b at the place ``distance`` on."""
        later = b[self.number[np.minimum(places + distance, len(self.number) - 1)]]
        return np.append(np.unique(a[:-1] * (len(b) + 1) + later, return_inverse=True)[1] + 1, 0)

    def compared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0, 1 for suffixes whose first v bytes are equal, over ``least`` bytes."""
        d = self.shift[x % self.v, y % self.v]
        out = np.sign(self.rank[self.number[x + d]] - self.rank[self.number[y + d]])
        for t in self.tail:
            tie = np.flatnonzero(out == 0)
            a, b = self.word[x[tie] + t], self.word[y[tie] + t]
            out[tie] = np.where(a == b, 0, np.where(a < b, -1, 1))
        return out


def repeated(texts: list[bytes], counts: list[int], buckets: list[int], least: int, short: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, which of its first ``counts`` windows equal another window of the same bucket, and which also over ``least`` bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])
    block = Block(data, short)
    own = np.concatenate([b + np.arange(n) for b, n in zip(begin, counts)])
    whole = np.concatenate([np.arange(n) + least <= e - b for b, e, n in zip(begin, begin[1:], counts)])
    group = np.repeat(np.unique(buckets, return_inverse=True)[1], counts)
    longer, shorter = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    longer[own[whole]] = True  # those that have ``least`` bytes, for now
    for k in range(0, block.v, 8):
        own, group = _split(own, group, block.word[own + k])
    same = np.full(len(data) + 1, -1)
    _pivoted(block, own, group, 0, same)
    shorter[np.flatnonzero(same >= 0)] = True
    own = np.flatnonzero(shorter & longer)
    longer[:] = False
    if least > short:
        own, group = _split(own, same[own], np.zeros(len(own), np.uint64))
        again = np.full(len(data) + 1, -1)
        _pivoted(block, own, group, least - short, again)  # equal windows: the last ``short`` of the ``least`` bytes decide
        same = again
        longer[np.flatnonzero(same >= 0)] = True
    else:
        longer[own] = True
    return [(shorter[b : b + n], longer[b : b + n]) for b, n in zip(begin, counts)]


def _pivoted(block: Block, own: np.ndarray, group: np.ndarray, on: int, same: np.ndarray) -> None:
    """Sorts groups of places by what stands ``on`` bytes on; of equal places, ``same`` gets one's number."""
    while len(own):
        new = np.append(True, group[1:] != group[:-1])
        pivot = own[new][np.cumsum(new) - 1]
        c = block.compared(own + on, pivot + on)
        hit = (c == 0) & ~new
        same[own[hit]] = same[pivot[hit]] = pivot[hit]
        left = c != 0
        own, group = _split(own[left], group[left], (c[left] > 0).astype(np.uint64))


def _split(own: np.ndarray, group: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each group by a key and makes groups of equal keys; groups of one are done."""
    order = np.lexsort((by, group))
    own, group, by = own[order], group[order], by[order]
    new = np.append(True, (group[1:] != group[:-1]) | (by[1:] != by[:-1]))[: len(own)]
    group = np.cumsum(new)
    several = np.bincount(group, minlength=1)[group] > 1
    return own[several], group[several]


#: Bytes from lo under repeated windows, and (null: none) under repeated strings of the full length.
SPAN = "id long, h long, lo long, short_hi long, hi long"


def _spans(id_: pa.Array, h: pa.Array, first: list[int], flags: list[tuple[np.ndarray, np.ndarray]], least: int, short: int) -> pa.RecordBatch:
    """Bytes under the flagged windows of each run, a row for each length."""
    which, lo, ends = [], [], ([], [])
    for i, (start, both) in enumerate(zip(first, flags)):
        for k, (f, size) in enumerate(zip(both, (short, least))):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
            which += [i] * (len(edge) // 2)
            lo += (start + edge[::2]).tolist()
            ends[k].extend((start + edge[1::2] + size - 1).tolist())
            ends[1 - k].extend([None] * (len(edge) // 2))
    at = pa.array(which, pa.int64())
    return pa.RecordBatch.from_arrays([id_.take(at), h.take(at), pa.array(lo, pa.int64()), *(pa.array(e, pa.int64()) for e in ends)], names=[c.split()[0] for c in SPAN.split(", ")])


def sorted_blocks(shipped: DataFrame, least: int, short: int) -> DataFrame:
    """SPAN rows for (bucket, id, h, first, n, data): whole buckets stand in one task, in order, and are sorted a block at a time."""
    rows = shipped.repartition("bucket").sortWithinPartitions("bucket")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            bucket, id_, h, first, n, data = zip(*held)
            return _spans(pa.array(id_, pa.int64()), pa.array(h, pa.int64()), list(first), repeated(list(data), list(n), list(bucket), least, short), least, short)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if held and size > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield done()

    return mapped(rows, sort, SPAN)


def counted_windows(shipped: DataFrame, least: int, short: int) -> DataFrame:
    """SPAN rows for the same input, of buckets of any size: each string of either length is counted by its 128-bit hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                first, n, data = (part.column(k).to_pylist() for k in (3, 4, 5))
                which, lo = pa.array(np.repeat(np.arange(len(n)), n)), np.concatenate([f + np.arange(c) for f, c in zip(first, n)])
                words = [np.frombuffer(b"".join([xxhash.xxh3_128_digest(d[k : k + size]) for d, c in zip(data, n) for k in range(c)]), "<i8").reshape(-1, 2) for size in (short, least)]
                none = np.concatenate([np.arange(c) + least > len(d) for d, c in zip(data, n)])  # not so long
                hashes = [pa.array(w[:, k].copy(), mask=none if j else None) for j, w in enumerate(words) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(1).take(which), part.column(2).take(which), pa.array(lo), *hashes], names=["id", "h", "lo", "s1", "s2", "w1", "w2"])

    rows = stored(mapped(shipped, hashed, "id long, h long, lo long, s1 long, s2 long, w1 long, w2 long"), "windows")

    def repeated_by(a: str, b: str) -> DataFrame:
        own = rows.where(F.col(a).isNotNull())
        often = stored(own.groupBy(a, b).count().where("count > 1").select(a, b), "often")
        return own.join(sized(often), [a, b], "left_semi")

    none = F.lit(None).cast("long")
    shorter = repeated_by("s1", "s2").select("id", "h", "lo", (F.col("lo") + short).alias("short_hi"), none.alias("hi"))
    return shorter.union(repeated_by("w1", "w2").select("id", "h", "lo", none.alias("short_hi"), (F.col("lo") + least).alias("hi")))


def repeated_spans(docs: DataFrame, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """SPAN rows (not united) of (id, h, text)."""
    every = stored(run_table(docs, least, short), "runs")
    several = stored(every.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    live = stored(every.join(several, "bucket", "left_semi"), "live")
    discard(every, several)
    kinds = stored(live.groupBy("bucket", "run").agg(F.count("*").alias("times"), F.min(F.struct("id", "h", "first", "n", "m")).alias("one")), "kinds")
    whole = live.join(kinds.where("times > 1").select("bucket", "run"), ["bucket", "run"], "left_semi")
    end = F.col("first") + F.col("n")
    spans = stored(whole.select("id", "h", F.col("first").alias("lo"), (end + short - 1).alias("short_hi"), F.when(F.col("m") >= least, F.least(end + least - 1, F.col("first") + F.col("m"))).alias("hi")), "whole")
    discard(live)
    # buckets with different runs, of which one at least occurs once
    mixed = stored(kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("times").alias("_t")).where("kinds > 1 and _t = 1").select("bucket", (F.col("kinds") > HEAVY).alias("heavy")), "mixed")
    wanted = kinds.join(mixed, "bucket").select("bucket", "heavy", "one.*")
    wanted = stored(wanted.groupBy("id", "h").agg(F.collect_list(F.struct("bucket", "heavy", "first", "n", "m")).alias("runs")), "wanted")
    discard(kinds, mixed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                id_, h, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode()
                asked = batch.column(3)[i].as_py()
                for k in range(0, len(asked), 4096):
                    out = [{"bucket": r["bucket"], "id": id_, "h": h, "first": r["first"], "n": r["n"], "data": data[r["first"] : r["first"] + r["m"]], "heavy": r["heavy"]} for r in asked[k : k + 4096]]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("heavy", pa.bool_())]))

    same = [docs["id"].eqNullSafe(wanted["id"]), docs["h"] == wanted["h"]]
    shipped = stored(mapped(docs.join(wanted, same).select(docs["id"], docs["h"], "text", "runs"), cut, "bucket long, id long, h long, first long, n int, data binary, heavy boolean").dropDuplicates(["bucket", "id", "h", "first"]), "shipped")
    discard(wanted)
    return spans.union(sorted_blocks(shipped.where("not heavy").drop("heavy"), least, short)).union(counted_windows(shipped.where("heavy").drop("heavy"), least, short))


def whole_words(data: memoryview, lo: int, hi: int) -> int:
    """Words that stand whole in data[lo:hi]."""
    part = bytes(data[lo:hi])
    blank = lambda at: bytes(data[at : at + 1]).isspace()
    cut = (lo > 0 and not blank(lo - 1) and not blank(lo)) + (hi < len(data) and not blank(hi - 1) and not blank(hi))
    return max(0, len(part.split()) - cut)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(ident(text), F.lit(""))
    return docs.select(ident(doc_id).cast("long").alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))


def _united(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes under spans, which come in order."""
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, short: int | None = None, more_words: int = PASSAGE_WORDS, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and n_passages of every document; with ``texts`` also kept, the remaining bytes.

    n_passages: maximal runs of bytes under strings of ``short`` bytes (SHORT, or ``least`` if that is less) that also start anywhere else, where such a run holds more than ``more_words`` whole words.
    A null text is empty. Documents may share an id: rows are told apart by id and text, and a row that is there twice is a repetition of
    itself, so both lose what is longer than a string. Ids may be null. An empty table gives no rows; extra columns are not read.
    """
    short = min(SHORT, least) if short is None else short
    rows = _rows(docs, doc_id, text)
    ordered = lambda hi: F.sort_array(F.collect_list(F.when(F.col(hi).isNotNull(), F.struct("lo", F.col(hi).alias("hi")))))
    spans = stored(repeated_spans(rows, least, short).groupBy("id", "h").agg(ordered("hi").alias("spans"), ordered("short_hi").alias("passages")), "spans")
    joined = rows.join(spans, [rows["id"].eqNullSafe(spans["id"]), rows["h"] == spans["h"]], "left").select(rows["id"], "text", "spans", "passages")
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * texts

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            raw, at = bytes_of(texts_of(batch, "text"))
            view, out = memoryview(raw), []
            for i, both in enumerate(zip(batch.column(2), batch.column(3))):
                own = view[int(at[i]) : int(at[i + 1])]
                gone, passages = (_united(*(x.values.field(k).to_numpy() for k in (0, 1))) if x.is_valid else [] for x in both)
                edges = [0, *(x for span in gone for x in span), len(own)]
                pieces = [own[a:b] for a, b in zip(edges[::2], edges[1::2])]
                sha = hashlib.sha256()
                for p in pieces:
                    sha.update(p)
                out.append((len(own), sum(b - a for a, b in gone), len(gone), sha.hexdigest(), sum(whole_words(own, a, b) > more_words for a, b in passages), *([b"".join(pieces)] if texts else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=[c.split()[0] for c in kept.split(", ")])

    return mapped(joined, removed, kept)
