"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a text by itself. On a bounded sample each rule's cost (seconds a text) and selectivity (share of
texts it rejects) are estimated; the cascade runs the rules by rejection per cost and stops at the first that rejects.
The order changes the time only: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import string
import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd  # not in the workers

from rastervec.llm.common import SMALL_BATCH, ident, mapped, slices, texts_of

SAMPLE_DOCS = 2000
WINDOW = 8
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def repeated_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that occur at least twice, the first included; exact, by ranks of doubled length."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        pairs = rank[:-step] * len(words) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
    often = np.bincount(rank)[rank] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if WORDS.search(line):
            n += line in seen
            seen.add(line)
    return n


class Text:
    """A whole text with its measures; each is taken once, when it is asked for."""

    def __init__(self, text: str):
        self.text = text

    words = cached_property(lambda self: WORDS.findall(self.text))
    n_words = cached_property(lambda self: len(self.words))
    word_chars = cached_property(lambda self: sum(map(len, self.words)))
    n_symbols = cached_property(lambda self: len(self.text) - len(self.text.translate(SYMBOLS)))
    n_dup_lines = cached_property(lambda self: repeated_lines(self.text))
    n_repeat_words = cached_property(lambda self: repeated_words(self.words))

    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _many_symbols(t: Text) -> bool:
    return 20 * t.n_symbols > len(t.text)


def _many_marks(t: Text) -> bool:
    return 25 * t.text.count("!") > len(t.text)


def _shouting(t: Text) -> bool:
    upper = sum(map(t.text.count, string.ascii_uppercase))
    return upper >= 25 and upper > sum(map(t.text.count, string.ascii_lowercase))


def _many_digits(t: Text) -> bool:
    return 4 * sum(map(t.text.count, string.digits)) > len(t.text) > 0


def _long_words(t: Text) -> bool:
    return t.word_chars > 25 * t.n_words


def _same_lines(t: Text) -> bool:
    return t.n_dup_lines >= 3 and 100 * t.n_dup_lines > 30 * (t.text.count("\n") + 1)


#: Name to a test of a text that is true where the rule rejects it.
RULES: dict[str, Callable[[Text], bool]] = {"symbols": _many_symbols, "marks": _many_marks, "upper_case": _shouting, "digits": _many_digits, "word_length": _long_words, "same_lines": _same_lines}


def estimate(docs: DataFrame, *, text: str = "text", rules: dict | None = None, sample: int = SAMPLE_DOCS) -> pd.DataFrame:
    """rule, cost (seconds a text), selectivity (share rejected) and gain (selectivity / cost) on about ``sample`` rows, whatever texts repeat."""
    rules = RULES if rules is None else rules
    rows = docs.select(F.coalesce(ident(text), F.lit("")).alias("_text"))
    share = sample / max(sample, docs.select(F.lit(1)).count())
    rows = rows.sample(share, seed=9)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for name, rule in rules.items():
                began = time.perf_counter()
                rejected = sum(rule(Text(t)) for t in texts)
                yield pa.RecordBatch.from_pylist([{"rule": name, "n": len(texts), "rejected": rejected, "s": time.perf_counter() - began}])

    sums = mapped(rows, tried, "rule string, n long, rejected long, s double").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("n", "rejected", "s"))).toPandas()
    out = sums.set_index("rule").reindex(list(rules), fill_value=0).reset_index()
    out["cost"] = out["s"] / out["n"].clip(lower=1)
    out["selectivity"] = out["rejected"] / out["n"].clip(lower=1)
    out["gain"] = out["selectivity"] / out["cost"].clip(lower=1e-9)
    return out[["rule", "cost", "selectivity", "gain"]]


def order(estimates: pd.DataFrame) -> list[str]:
    """Rules by rejection per cost, the cheapest first among those that reject nothing."""
    return list(estimates.sort_values(["gain", "cost", "rule"], ascending=[False, True, True])["rule"])


def judge(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, rules: dict | None = None, sequence: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id alone unless given) with the measures of the whole text, base_failed and kept.

    A null text is an empty one: no words, so it fails the base. Rows are judged one by one: repeated rows and extra columns
    don't matter, very long texts are measured whole, an empty table gives an empty result. kept is false if the base fails, else unless a rule of the cascade rejects.
    """
    rules = RULES if rules is None else rules
    sequence = order(estimate(docs, text=text, rules=rules)) if sequence is None else sequence
    cascade = [rules[name] for name in sequence]
    rows = docs.select(*(ident(c) for c in (["doc_id"] if keep is None else keep)), ident(text).alias("_text"))
    schema = rows.drop("_text").schema
    for name in MEASURES:
        schema = schema.add(f"{name}", "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            found = []
            for t in map(Text, texts_of(batch, "_text").to_pylist()):
                failed = t.base_failed()
                found.append((*(getattr(t, m) for m in MEASURES), failed, not failed and not any(rule(t) for rule in cascade)))
            columns = zip(*found)
            own = [pa.array(c, pa.int64()) for _, c in zip(range(5), columns)] + [pa.array(c, pa.bool_()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_text"]).columns, *own], names=schema.names)

    return mapped(rows, judged, schema)


def good_documents(docs: DataFrame, *, text: str = "text", rules: dict | None = None, sequence: list[str] | None = None) -> DataFrame:
    """The rows that judge() keeps, with their own columns only. Only the verdict is worked out: the base by the number of words first, then the cascade, the base by repeated words last."""
    names, rules = docs.columns, RULES if rules is None else rules
    sequence = order(estimate(docs, text=text, rules=rules)) if sequence is None else sequence
    cascade = [rules[name] for name in sequence]
    rows = docs.select(F.struct(*(ident(c).alias(f"c{i}") for i, c in enumerate(names))).alias("_row"))
    schema, place = rows.schema, names.index(text)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (batch.append_column("_text", batch.column(0).field(place)) for batch in batches)  # a text goes to Python once
        for batch in slices(texts, "_text", SMALL_BATCH):
            kept = [t.n_words >= 20 and not any(rule(t) for rule in cascade) and not t.base_failed() for t in map(Text, texts_of(batch, "_text").to_pylist())]
            yield batch.drop_columns(["_text"]).filter(pa.array(kept, pa.bool_()))

    return mapped(rows, passed, schema, SMALL_BATCH).select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)))
