"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into symbols: insult (with a weight), threat, target, negation, reported speech, quote, end of clause, other.
Insults are learned: words and beginnings of words that labelled toxic texts have and others don't, as few as explain the toxic texts, weighted
by their log odds. Four small machines - negation with a scope of three words, reported speech and quotes, targets, threats - run
over the symbols; their composition is one table from (state, symbol) to (state, output). The output says how
an insult or threat stands in its clause: plain, aimed at someone, denied, reported, or as a threat against someone, and has a fixed weight. What all clauses of a text weigh,
what that is for a hundred of its words, and the share of its clauses that match are made a probability by logistic regression on the labelled texts, with weights that are not negative.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastervec.llm.common import ident, mapped, slices, texts_of

#: Labelled documents that a model is fitted on, about; by a hash of the id. Least number of toxic texts that a candidate is in.
LABELLED_DOCS, LEAST_TEXTS = 20_000, 3
#: Least log odds of a candidate, and distinct insults that explain a toxic text.
LEAST_WEIGHT, EXPLAINED = 2.5, 4
PREFIXES = range(3, 10)
MOST_MEMO = 500_000
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”«»„]")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
#: Function words of the grammar in four languages; insults are not listed but learned.
WORDS = {
    THREAT: "kill hurt destroy beat burn shoot stab töten schlagen vernichten umbringen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yourself he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils tú ti usted ustedes él ella ellos",
    NEGATION: "not no never neither nor nicht kein keine niemals nie non ne pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says called calls wrote claimed reported sagte sagt nannte schrieb behauptete dit disait appelle écrit dijo dice llamó escribió",
}
MARKS = {c: END for c in ".!?;:\n"} | {c: QUOTE for c in "\"“”«»„"}
PLAIN, AIMED, DENIED, REPORTED, THREATENED = range(5)
#: What an insult's or threat's weight is multiplied by.
OUTPUT_WEIGHT = {DENIED: 0.5, REPORTED: 0.7, PLAIN: 1.0, AIMED: 1.25, THREATENED: 1.5}


def negation(state: int, symbol: int) -> int:
    """Words that are left in a negation's scope."""
    return 3 if symbol == NEGATION else 0 if symbol == END else max(0, state - 1) if symbol != QUOTE else state


def speech(state: int, symbol: int) -> int:
    """0 own words, 1 after a verb of saying, 2 within quotes; all end with the clause."""
    if symbol == END:
        return 0
    if symbol == QUOTE:
        return 0 if state == 2 else 2
    return 1 if symbol == REPORT and state == 0 else state


def target(state: int, symbol: int) -> int:
    """Whether someone has been named in the clause."""
    return 0 if symbol == END else 1 if symbol == TARGET else state


def threat(state: int, symbol: int) -> int:
    """Whether the clause has a verb of threat."""
    return 0 if symbol == END else 1 if symbol == THREAT else state


MACHINES = ((negation, 4), (speech, 3), (target, 2), (threat, 2))


def compose() -> tuple[list[list[int]], list[list[int]]]:
    """(next state, output) by state and symbol of all machines together; output -1: none. State 0 is the start."""
    states = list(product(*(range(n) for _, n in MACHINES)))
    number = {s: i for i, s in enumerate(states)}
    after, out = [], []
    for s in states:
        after.append([number[tuple(m(x, symbol) for (m, _), x in zip(MACHINES, s))] for symbol in range(8)])
        denied, said, aimed, threatened = s
        for_insult = DENIED if denied else REPORTED if said else THREATENED if aimed and threatened else AIMED if aimed else PLAIN
        for_threat = DENIED if denied else REPORTED if said else THREATENED if aimed else -1
        out.append([for_insult if symbol == INSULT else for_threat if symbol == THREAT else -1 for symbol in range(8)])
    return after, out


class Lexicon(dict):
    """Word to (symbol, weight), filled as words come."""

    def __init__(self, insults: dict[str, float]):
        super().__init__({c: (s, 0.0) for c, s in MARKS.items()})
        self.insults = insults
        self.listed = {w: s for s, words in WORDS.items() for w in words.split()}

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.insults.get(word) or next((w for k in reversed(PREFIXES) if (w := self.insults.get(word[:k] + "*"))), 0.0)
        entry = (self.listed[word], found or 1.0) if word in self.listed else (INSULT, found) if found else (OTHER, 0.0)
        if len(self) > MOST_MEMO:
            self.clear()
            self.update({c: (s, 0.0) for c, s in MARKS.items()})
        self[word] = entry
        return entry


N_FEATURES = 3
#: Words and weight of the penalty that keep short texts and rare matches from standing out.
LEAST_WORDS, RIDGE = 20, 0.2
AFTER, OUTPUT = compose()


def clauses(text: str, lexicon: Lexicon) -> list[list[tuple[int, float]]]:
    """The matches (output, weight) of each clause of a whole text that has any."""
    return _matches(list(map(lexicon.__getitem__, TOKENS.findall(text.lower()))))


def _matches(entries: list[tuple[int, float]]) -> list[list[tuple[int, float]]]:
    if not any(s in (INSULT, THREAT) for s, _ in set(entries)):
        return []
    out: list[list[tuple[int, float]]] = []
    state, clause = 0, []
    for symbol, weight in entries:
        kind = OUTPUT[state][symbol]
        if kind >= 0:
            clause.append((kind, weight * OUTPUT_WEIGHT[kind]))
        elif symbol == END and clause:
            out.append(clause)
            clause = []
        state = AFTER[state][symbol]
    return [*out, clause] if clause else out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """log(1 + weight) of all clauses together, the same for a hundred words (a text counts as LEAST_WORDS at least), and the share of clauses that match."""
    entries = list(map(lexicon.__getitem__, TOKENS.findall(text.lower())))
    found = _matches(entries)
    if not found:
        return [0.0] * N_FEATURES
    weight = sum(w for clause in found for _, w in clause)
    words = n = 0
    within = False
    for symbol, _ in entries:
        if symbol == END:
            n, within = n + within, False
        else:
            words, within = words + (symbol != QUOTE), True
    return [math.log1p(weight), math.log1p(100 * weight / max(LEAST_WORDS, words)), len(found) / (n + within)]


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def _named(word: str) -> list[str]:
    """A word and its beginnings, with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def _known(text: str) -> set[str]:
    return {f for w in _words(text) for f in _named(w)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def batch_of() -> pa.RecordBatch:
        keys = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([held[k][w] for w in keys], pa.int64()) for k in (1, 0))], names=["feature", "pos", "neg"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text").to_pylist()):
            held[toxic].update(_known(text))
            if len(held[0]) + len(held[1]) > 400_000:
                yield batch_of()
                held = (Counter(), Counter())
    if held[0] or held[1]:
        yield batch_of()


def labelled(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, most: int = LABELLED_DOCS) -> DataFrame:
    """(toxic, text) of about ``most`` labelled documents. The labels are thinned by a hash of the id before they meet the texts, so few ids are
    sent to the texts; several labels of an id count as their greatest."""
    ids = labels.select(ident(doc_id).alias("_id"), ident(label).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    share = min(1.0, most / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(ident(doc_id).alias("_id"), F.coalesce(ident(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "_id").select("toxic", "text")


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings (with a star) to log odds, from (toxic, text).

    Candidates are counted in all rows; then the one that covers most words of toxic texts with fewer than EXPLAINED known insults is taken, again and again. Rare words that
    only copies of one toxic text share are thus left out.
    """
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}
    counts = mapped(rows, _counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    best = counts.where(F.col("pos") >= LEAST_TEXTS).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    candidates = {r["feature"]: r["weight"] for r in best.select("feature", "weight").collect()}  # as many as the bounded labelled texts have
    names = sorted(candidates, key=lambda f: (-len(f.rstrip("*")), f.endswith("*"), f))
    number = {f: i for i, f in enumerate(names)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[own for w in sorted(_words(t)) if (own := sorted(number[f] for f in _named(w) if f in number))] for t in texts_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.list_(pa.int32())))], names=["found"])

    texts = [[list(w) for w in t] for t in mapped(rows.where("toxic = 1").select("toxic", "text"), held, "found array<array<int>>").toPandas()["found"]]
    left = [EXPLAINED] * len(texts)
    open_words = [set(range(len(t))) for t in texts]
    having: dict[int, list[tuple[int, int]]] = {}
    for t, words in enumerate(texts):
        for w, found in enumerate(words):
            for f in found:
                having.setdefault(f, []).append((t, w))
    gain = {f: len(places) for f, places in having.items()}
    chosen: dict[str, float] = {}

    def close(t: int, w: int) -> None:
        open_words[t].discard(w)
        for g in texts[t][w]:
            if g in gain:
                gain[g] -= 1

    while gain:
        f = min(gain, key=lambda f: (-gain[f], f))  # of equal ones the longest
        if gain.pop(f) < max(LEAST_TEXTS, pos // 200):
            break
        chosen[names[f]] = candidates[names[f]]
        for t, w in having[f]:
            if w in open_words[t]:
                close(t, w)
                left[t] -= 1
                if left[t] == 0:
                    for other in list(open_words[t]):
                        close(t, other)
    return chosen


class Model:
    """insults: Lexicon's entries. weights: of features() and, last, of 1. None if there was nothing to learn from."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray | None):
        self.insults, self.weights = insults, weights


def regression(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the last of 1; a column whose weight would be negative gets none."""
    used = list(range(x.shape[1]))
    while True:
        own = np.column_stack([x[:, used], np.ones(len(x))])
        w, penalty = np.zeros(len(used) + 1), np.array([ridge] * len(used) + [1e-3])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient = own.T @ (p - y) + penalty * w
            hessian = (own * (p * (1 - p))[:, None]).T @ own + np.diag(penalty)
            move = np.linalg.solve(hessian, gradient)
            w -= move
            if np.abs(move).max() < 1e-6:
                break
        worst = int(np.argmin(w[:-1])) if used else 0
        if not used or w[worst] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        del used[worst]


def _matched(rows: DataFrame, insults: dict[str, float]) -> DataFrame:
    """rows with the features of the column text in its place."""
    shared = rows.sparkSession.sparkContext.broadcast(insults)
    schema = rows.drop("text").schema.add("features", T.ArrayType(T.DoubleType()))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in slices(batches, "text", 4 << 20):
            found = [features(t, lexicon) for t in texts_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return mapped(rows, match, schema)


def fit(rows: DataFrame) -> Model:
    """A model from (toxic, text), which should be stored: it is read several times."""
    insults = learn_insults(rows)
    seen = _matched(rows, insults).toPandas()  # a few numbers for each of the bounded rows
    if not len(seen) or not insults:
        return Model(insults, None)
    return Model(insults, regression(np.array(seen["features"].tolist()), seen["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str | Column] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` with score and predicted (1 from ``threshold`` on) of every whole text.

    A null text is empty and has no clause. Rows are scored one by one: ties, repeated rows and extra columns don't matter, an empty table gives none, a very long text
    is read token by token to its end. A model that had no toxic or no other texts to learn from gives 0.
    """
    rows = _matched(docs.select(*keep, F.coalesce(ident(text), F.lit("")).alias("text")), model.insults)
    if model.weights is None:
        value = F.lit(0.0)
    else:
        w = [float(x) for x in model.weights]
        z = sum((F.col("features")[i] * w[i] for i in range(N_FEATURES)), F.lit(w[-1]))
        value = 1 / (1 + F.exp(-z))
    rows = rows.withColumn("score", value)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("features")
