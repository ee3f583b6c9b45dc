"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: a block holds the postings of some thousand documents, for every term of the test set
where in the block's running numbering of words it stands. Documents are numbered with gaps, so no match crosses one.
Blocks are a table of their own. A phrase is looked up in a block from its rarest term there: that term's positions, less its
offset in the phrase, are intersected with the offset-adjusted postings of the next rarest, and so on;
what is left are exact matches. A phrase with a term that the block lacks is done at once.

Phrases reach the blocks by broadcast. Test items are taken in groups of at most ``GROUP_WORDS`` words, each with an index of its own
terms, so what is broadcast has a bound whatever the size of the test set. ``dict.get`` of a word's bytes keeps other words out of the postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastervec.llm.common import bytes_of, ident, mapped, slices, stored, texts_of

WINDOW = 10
GROUP_WORDS = 2_000_000
#: Bytes of text in an index block, and candidates that are intersected at a time.
BLOCK_BYTES, MOST_CANDIDATES = 8 << 20, 1 << 20
#: 0-9, a-z and every byte of a character beyond ASCII stay, A-Z are lower-cased, all other bytes part words.
_FOLD = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
INDEX = "part int, block long, doc_ids array<long>, starts array<long>, n_words array<long>, terms array<int>, offsets array<long>, positions array<long>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has."""
    raw, at = bytes_of(texts)
    folded = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(_FOLD[raw])])
    split = pc.ascii_split_whitespace(_as_text(folded))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool) if len(flat) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    return flat.filter(pa.array(full)), np.bincount(owner[full], minlength=len(texts)).astype(np.int64)


def _as_text(folded: pa.Array) -> pa.Array:
    """The same buffers as text; folding changes ASCII bytes only, so they are still UTF-8."""
    return pa.Array.from_buffers(pa.large_string(), len(folded), folded.buffers())


def phrases(items: list[tuple], window: int) -> tuple[list[str], np.ndarray, list[list]]:
    """From (item, words): the terms, the distinct phrases as term numbers (-1 after a short item's words), and each phrase's items."""
    number: dict[str, int] = {}
    owners: dict[tuple, set] = {}
    for item, words in items:
        ids = [number.setdefault(w, len(number)) for w in words]
        for k in range(max(1, len(ids) - window + 1) if ids else 0):
            p = ids[k : k + window]
            owners.setdefault(tuple(p + [-1] * (window - len(p))), set()).add(item)
    table = np.array(list(owners), np.int64).reshape(-1, window)
    return list(number), table, [sorted(o, key=str) for o in owners.values()]


def build_index(docs: DataFrame, terms: list[str], *, doc_id: str = "doc_id", text: str = "text", gap: int = WINDOW) -> DataFrame:
    """INDEX rows: the documents of a block, where each begins, its words, and for the terms that occur in the block (by number, in
    order) their positions from offsets[i] to offsets[i + 1]. A null text has no words; repeated rows are documents of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.large_string())
        part = TaskContext.get().partitionId()
        for block, batch in enumerate(slices(batches, "_text", BLOCK_BYTES, 1 << 14)):
            words, n = words_of(texts_of(batch, "_text"))
            starts = np.concatenate([[0], np.cumsum(n + gap)])[:-1]
            ids = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            where = np.arange(len(ids)) + np.repeat(np.arange(len(n)) * gap, n)
            hit = np.flatnonzero(ids >= 0)
            hit = hit[np.argsort(ids[hit], kind="stable")]
            found, first = np.unique(ids[hit], return_index=True)
            lists = [batch.column(0).to_pylist(), starts, n, found, np.append(first, len(hit)), where[hit]]
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds))], names=[c.split()[0] for c in INDEX.split(", ")])

    return mapped(docs.select(ident(doc_id).cast("long").alias("_id"), ident(text).alias("_text")), indexed, INDEX)


class Block:
    """Postings of one block."""

    def __init__(self, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray, n_terms: int):
        self.first, self.count = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms + 1, np.int64)
        self.first[terms], self.count[terms] = offsets[:-1], np.diff(offsets)
        self.positions = positions
        self.shift = int(positions.max(initial=0)) + 1
        self.keys = np.repeat(terms.astype(np.int64), np.diff(offsets)) * self.shift + positions

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether a posting of the term stands at the position."""
        key = term * self.shift + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (position >= 0) & (position < self.shift) & (self.keys[at] == key)

    def exact(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all exact matches, found from each phrase's rarest term on."""
        counts = np.where(table >= 0, self.count[table], np.iinfo(np.int64).max)
        alive = np.flatnonzero((counts > 0).all(1))
        order = np.argsort(counts[alive], axis=1, kind="stable")
        most = counts[alive, order[:, 0]] if len(alive) else np.zeros(0, np.int64)
        cuts = np.searchsorted(np.cumsum(most), np.arange(MOST_CANDIDATES, most.sum() + 1, MOST_CANDIDATES)) if len(alive) else []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for part in np.split(np.arange(len(alive)), cuts):
            if not len(part):
                continue
            p, o, n = alive[part], order[part], most[part]
            rare = table[p, o[:, 0]]
            row = np.repeat(np.arange(len(p)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rare], n)
            start = self.positions[at] - o[row, 0]
            for k in range(1, table.shape[1]):
                offset = o[row, k]
                term = table[p[row], offset]
                ok = (term < 0) | self.holds(term, start + offset)
                row, start = row[ok], start[ok]
            ok = start >= 0
            out.append((p[row[ok]], start[ok]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self, table: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest term) where every other term stands within slop words of it."""
        counts = np.where(table >= 0, self.count[table], np.iinfo(np.int64).max)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero((counts > 0).all(1)):
            order = np.argsort(counts[i], kind="stable")
            order = order[table[i][order] >= 0]
            rare = table[i, order[0]]
            here = self.positions[self.first[rare] : self.first[rare] + self.count[rare]]
            for term in table[i, order[1:]]:
                other = self.positions[self.first[term] : self.first[term] + self.count[term]]
                after = np.searchsorted(other, here)
                apart = np.minimum(np.abs(other[np.minimum(after, len(other) - 1)] - here), np.abs(here - other[np.maximum(after - 1, 0)]))
                here = here[apart <= slop]
            out.append((np.full(len(here), i), here))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def look_up(index: DataFrame, n_terms: int, table: np.ndarray, owners: list[list], *, slop: int | None = None) -> DataFrame:
    """For every document of the index: part, block, place, doc_id, n_words, its hit words as spans from_word to to_word (not
    included, merged and in order), and the items that occur, sorted as text. With ``slop``, proximity instead of exact matches: spans are the
    rarest term's words where all other terms of the phrase are within ``slop`` words of it."""
    shared = index.sparkSession.sparkContext.broadcast((n_terms, table, owners))
    schema = "part int, block long, place long, doc_id long, n_words long, from_word array<long>, to_word array<long>, items array<string>"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, table, owners = shared.value
        length = (table >= 0).sum(1)
        for whole in batches:
            for i in range(whole.num_rows):
                row = {n: whole.column(k)[i] for k, n in enumerate(whole.schema.names)}
                arr = {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("starts", "n_words", "terms", "offsets", "positions")}
                docs, starts = row["doc_ids"].values, arr["starts"]
                block = Block(arr["terms"], arr["offsets"], arr["positions"], n_terms)
                none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                which, at = none if not len(block.keys) or not len(table) else block.exact(table) if slop is None else block.near(table, slop)
                ends = at + (length[which] if slop is None else 1)
                order = np.lexsort((ends, at))
                which, at, ends = which[order], at[order], ends[order]
                owner = np.searchsorted(starts, at, "right") - 1
                # runs of overlapping or touching matches of one document
                reach = np.maximum.accumulate(ends) if len(ends) else ends
                new = np.append(True, (at[1:] > reach[:-1]) | (owner[1:] != owner[:-1])) if len(at) else np.zeros(0, bool)
                lo, hi = at[new], np.append(reach[:-1][new[1:]], reach[-1:])
                run_owner = owner[new]
                cuts = np.searchsorted(run_owner, np.arange(len(docs) + 1))
                items: list[list[str]] = [[] for _ in range(len(docs))]
                pairs = np.unique(owner * max(1, len(table)) + which)
                for d, p in zip(pairs // max(1, len(table)), pairs % max(1, len(table))):
                    items[d].extend(map(str, owners[p]))
                spans = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x - starts[run_owner], pa.int64())) for x in (lo, hi)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["block"].as_py()] * n, pa.int64()), pa.array(np.arange(n)), docs, pa.array(arr["n_words"]), *spans, pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                    names=["part", "block", "place", "doc_id", "n_words", "from_word", "to_word", "items"],
                )

    return mapped(index, found, schema)


def test_items(items: DataFrame, *, item_id: str = "item_id", text: str = "text", most: int = GROUP_WORDS) -> Iterator[list[tuple]]:
    """(item, words) in groups of at most ``most`` words, or one item; ids as text. Items come to the driver a group at a time."""
    group, n = [], 0
    rows = items.select(ident(item_id).cast("string").alias("i"), F.coalesce(ident(text), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        words = words_of(pa.array([r["t"]], pa.large_string()))[0].to_pylist()
        if group and n + len(words) > most:
            yield group
            group, n = [], 0
        group.append((r["i"] if r["i"] is not None else "", words))
        n += len(words)
    yield group


def matches(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None, most: int = GROUP_WORDS) -> DataFrame:
    """look_up()'s rows for every document and the whole test set; a document has a row for each group of items.

    A null text has no words and no row is lost for it; an item without words has no phrase; one with fewer words than ``window`` is one
    phrase. Null ids stay null, ids of items count as text (null: empty). Repeated rows are documents of their own. Extra columns are not read.
    """
    out = None
    for group in test_items(items, item_id=item_id, text=item_text, most=most):
        terms, table, owners = phrases(group, window)
        index = stored(build_index(docs, terms, doc_id=doc_id, text=text, gap=max(window, (slop or 0) + 1)), "postings")
        found = look_up(index, len(terms), table, owners, slop=slop)
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit (words within any match), n_items, items (ids as text, sorted) and contaminated (n_hit > 0) of every document."""
    found = matches(docs, items, **how)
    groups = found.groupBy("part", "block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("from_word", "to_word"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = found.select("doc_id", "n_words", F.arrays_zip("from_word", "to_word").alias("_spans"), "items")
    rows = one if not _several(items, how) else groups.select(one.columns)
    # the words of spans in order, less what an earlier one covers
    covered = F.aggregate(F.array_sort("_spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["to_word"] - F.greatest(a["to"], s["from_word"]))).alias("n"), F.greatest(a["to"], s["to_word"]).alias("to")))["n"]
    rows = rows.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def _several(items: DataFrame, how: dict) -> bool:
    """Whether the test set takes more than one group: a bound on its words by its bytes says no for sure."""
    size = items.agg(F.sum(F.octet_length(ident(how.get("item_text", "text"))))).first()[0] or 0
    return size > how.get("most", GROUP_WORDS)


def clean_documents(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit word, with their own columns only. Rows are told apart by a 64-bit hash of the text, which alone decides; ids are not read."""
    key = F.xxhash64(ident(text))
    hit = contamination(docs.select(key.alias("key"), ident(text).alias("text")), items, doc_id="key").where("contaminated").select(F.col("doc_id").alias("_hit")).distinct()
    rows = docs.select(F.struct(*(ident(c) for c in docs.columns)).alias("_row"), key.alias("_key"))
    return rows.join(hit, F.col("_key") == F.col("_hit"), "left_anti").select("_row.*")
