"""Language identification by prediction by partial matching.

For every language a tree of byte contexts, of order 0 to ``max_order`` (3), holds how often each
byte followed. A byte's code length is that of its longest known context; a byte that the context
has not seen costs the escape (method C: distinct / (total + distinct)) and is coded one order lower, at
last as one of 256. Statistics are frozen after training, so the code length of a byte depends
only on the node of its context, and whole texts are scored by table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastervec.llm.common import bytes_of, ident, mapped, slices, texts_of

ORDER = 3
#: Bounds of what a model is fitted on, for each language; the documents with the smallest hashes are taken.
TRAIN_DOCS, TRAIN_BYTES = 1500, 4_000_000
#: Contexts seen less often than this in all languages together are left out of the tree.
LEAST_SEEN = 4


class Model:
    """symbols: byte to symbol, 0 unseen. nodes: three symbols to a node. cost: node, next symbol, language: bits."""

    def __init__(self, languages: list[str], symbols: np.ndarray, nodes: np.ndarray, cost: np.ndarray):
        self.languages, self.symbols, self.nodes, self.cost = languages, symbols, nodes, cost


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, four bytes as an integer, count) for the texts of each batch."""
    for batch in batches:
        languages = np.array(batch.column("lang").to_pylist(), dtype=object)
        raw, at = bytes_of(texts_of(batch, "text"))
        for lang in sorted(set(languages)):
            parts = [raw[at[i] : at[i + 1]] for i in np.flatnonzero(languages == lang)]
            pad = np.full(ORDER, 10, np.uint8)
            data = np.concatenate([x for p in parts for x in (pad, p)]).astype(np.uint32)
            grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
            # grams that end in a pad are no text
            ends = np.cumsum([len(p) + ORDER for p in parts])[:-1] - ORDER
            keep = np.ones(len(grams), bool)
            for k in range(ORDER):
                keep[ends + k] = False
            values, counts = np.unique(grams[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"]
            )


def train_rows(docs: DataFrame, *, text: str, lang: str, by: str, most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """About most_docs documents and most_bytes bytes at most for each language, by a hash of ``by``: a share that
    depends on the language's totals, so no language's rows are gathered or sorted. Every single text stays whole.
    A language whose share takes no document, being few long texts, has one of those with its smallest hash."""
    rows = docs.select(ident(text).alias("text"), ident(lang).alias("lang"), F.xxhash64(ident(by)).alias("_h")).where("lang is not null and text is not null and text <> ''")
    totals = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.min(F.pmod("_h", F.lit(1_000_000))).alias("least")).collect()  # a row for each language of the model
    if not totals:
        return rows.select("lang", "text")
    shares = {r["lang"]: min(1.0, most_docs / r["docs"], most_bytes / r["bytes"]) for r in totals}
    share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang"))
    taken = rows.where(F.pmod("_h", F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    bare = [(F.col("lang") == r["lang"]) & (F.pmod("_h", F.lit(1_000_000)) == r["least"]) for r in totals if r["least"] >= shares[r["lang"]] * 1_000_000]
    if not bare:
        return taken
    first = rows.where(reduce(Column.__or__, bare)).groupBy("lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return taken.unionByName(first)


def fit(rows: DataFrame) -> Model:
    """Fits a model on (lang, text). The driver gets counts of four-byte strings: bounded by the bounded rows, and by bytes to the power 4."""
    counts = mapped(rows, _gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    seen = np.unique(np.concatenate([np.array([10], np.int64), *(counts["gram"].to_numpy() >> s & 255 for s in (0, 8, 16, 24))])).astype(int)
    symbols = np.zeros(256, np.uint8 if len(seen) < 255 else np.int32)
    symbols[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    gram = counts["gram"].to_numpy()
    parts = [symbols[gram >> s & 255].astype(np.int64) for s in (24, 16, 8, 0)]
    which = np.searchsorted(languages, counts["lang"].to_numpy().astype(str)) if languages else np.zeros(0, int)
    weight = counts["n"].to_numpy()
    # contexts of order k are the last k symbols before the byte, as a number in base size
    cost = np.full((1, size, max(1, len(languages))), 8.0, np.float32)  # order -1: one of 256
    ids = np.zeros(size**ORDER, np.int32) if languages else np.zeros(1, np.int32)
    known = np.zeros(1, np.int64)
    for order in range(ORDER + 1):
        context = np.zeros(len(gram), np.int64)
        for p in parts[ORDER - order : ORDER]:
            context = context * size + p
        nodes, inverse = np.unique(context, return_inverse=True)
        enough = np.bincount(inverse, weights=weight, minlength=len(nodes)) >= LEAST_SEEN if order else np.ones(len(nodes), bool)
        renumber = np.where(enough, np.cumsum(enough) - 1, -1)
        kept = nodes[enough]
        n = np.zeros((len(kept), size, max(1, len(languages))))
        node = renumber[inverse]
        np.add.at(n, (node[node >= 0], parts[ORDER][node >= 0], which[node >= 0]), weight[node >= 0])
        total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        shorter = kept % size ** max(0, order - 1)
        lower = cost[known_index(known, shorter)] if order > 1 else np.broadcast_to(cost[0], n.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            escaped = lower - np.log2(distinct / (total + distinct))
            own = np.where(n > 0, -np.log2(n / (total + distinct)), escaped)
        cost_here = np.where(total > 0, own, lower).astype(np.float32)
        if order == 0:
            known, cost = np.zeros(1, np.int64), cost_here if len(kept) else cost
            all_cost, base = [cost], len(cost)
        else:
            # every longer context falls into the node of its known suffix
            block = np.arange(size**ORDER) % size**order
            lookup = np.full(size**order, -1, np.int32)
            lookup[kept] = base + np.arange(len(kept))
            hit = lookup[block]
            ids = np.where(hit >= 0, hit, ids).astype(np.int32)
            all_cost.append(cost_here)
            base += len(kept)
            # contexts that were left out stand with the cost of their suffix, for the next order
            missing = np.setdiff1d(nodes, kept)
            cost = np.concatenate([cost_here, cost[known_index(known, missing % size ** (order - 1))] if order > 1 else np.broadcast_to(cost[0], (len(missing), *cost.shape[1:]))])
            known = np.concatenate([kept, missing])
            sort = np.argsort(known)
            known, cost = known[sort], cost[sort]
    return Model(languages, symbols, ids, np.concatenate(all_cost))


def known_index(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.searchsorted(known, wanted)


def code_lengths(model: Model, texts: pa.Array, most: int = 1 << 19) -> np.ndarray:
    """Bits of each whole text under each language; texts are coded in slices of ``most`` bytes, so memory is bounded."""
    raw, at = bytes_of(texts)
    n, size = len(at) - 1, model.cost.shape[1]
    flat = model.cost.reshape(-1, model.cost.shape[2])
    bits = np.zeros((n, flat.shape[1]))
    newline = int(model.symbols[10])
    for lo in range(0, len(raw), most):
        hi = min(len(raw), lo + most)
        s = model.symbols[raw[max(0, lo - ORDER) : hi]].astype(np.int32)
        if lo < ORDER:
            s = np.concatenate([np.full(ORDER - lo, newline, np.int32), s])
        first, last = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left") - 1
        owner = np.repeat(np.arange(first, last + 1), np.diff(np.clip(at[first : last + 2], lo, hi)))
        a, b, c = s[:-3].copy(), s[1:-2].copy(), s[2:-1].copy()
        starts = at[first : last + 1]
        for k, back in ((0, (a, b, c)), (1, (a, b)), (2, (a,))):  # a text starts after line ends
            i = starts + k - lo
            i = i[(i >= 0) & (i < hi - lo)]
            i = i[owner[i] == owner[np.maximum(i - k, 0)]] if k and len(i) else i
            for x in back:
                x[i] = newline
        code = (a * size + b) * size + c
        costs = flat[model.nodes[code].astype(np.int64) * size + s[3:]]
        for l in range(flat.shape[1]):
            bits[first : last + 1, l] += np.bincount(owner - first, weights=costs[:, l], minlength=last + 1 - first)
    return bits


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, a posterior over the learned languages.

    Null texts, texts without a letter and all texts of a model without languages: ``und`` and score 0.
    Every row is predicted by itself, so repeated rows and ids of any kind are fine; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.symbols, model.nodes, model.cost))
    rows = docs.select(*keep, ident(text).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in slices(batches, "_text", 4 << 20):
            col = texts_of(batch, "_text")
            letters = np.array([any(map(str.isalpha, t)) for t in col.to_pylist()], bool)
            names, best, p = [], np.zeros(len(col), int), np.zeros(len(col))
            if own.languages:
                bits = code_lengths(own, col)
                best = bits.argmin(1)
                p = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
            known = letters & bool(own.languages)
            names = [own.languages[b] if k else "und" for b, k in zip(best, known)]
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(np.where(known, p, 0.0))], names=[*kept.schema.names, "lang_pred", "score"])

    return mapped(rows, score, schema)


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None) -> DataFrame:
    """Learns from the rows with a language that ``held_out`` leaves and predicts every row: doc_id, held_out, lang_pred, score.

    Rows with a null language or without text teach nothing; null texts and texts without a letter are ``und`` with score 0. Whole texts are
    scored, however long. Repeated rows and ids are predicted one by one. An empty table gives no rows; other columns are not read.
    """
    held = F.lit(False) if held_out is None else held_out
    model = fit(train_rows(docs.where(~held), text=text, lang=lang, by=doc_id))
    return predict(docs, model, text=text, keep=[ident(doc_id).alias("doc_id"), held.alias("held_out")])
