"""Spelling variants: words one edit apart, found by their rarest bigrams, and chains of forms from variants to roots."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastervec.llm.common import discard, ident, mapped, stored, texts_of

#: Letters of a run: ASCII and Latin-1.
RUN, OTHER = re.compile("[A-Za-z\u00C0-\u00FF]+"), re.compile("[^A-Za-z\u00C0-\u00FF]")
#: One edit touches two bigrams of a word at most, so of any three in a common order one stays.
PREFIX = 3
#: Least code points of a word: with four bigrams, two stay after an edit.
SHORTEST = 5
#: Characters of a text that are cut into runs at once, and words that a task counts before it hands them on.
PART, MOST_WORDS = 1 << 20, 1 << 18


def parts_of(text: str, most: int = PART) -> Iterator[str]:
    """Pieces of a text of about ``most`` characters that end where a run of letters ends."""
    at = 0
    while len(text) - at > most:
        stop = OTHER.search(text, at + most)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def misspelt(run: str, h: int) -> str:
    """A run without one code point, the one that ``h`` tells: a misspelling whose place is known."""
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = 3, misspell_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case; words of ``shortest`` code points with ``least`` occurrences at least.

    With ``misspell_every``, a run loses a code point where that divides the crc32 of `<id>:<run>` (a null id is written as nothing).
    Null and empty texts have no words, repeated rows count again, other columns are not read, an empty table has no words. Very long texts are cut into runs a part at a time,
    and a task sums what it counts before it is shuffled, so a word in every document is a few rows a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
                crc = zlib.crc32(f"{'' if key is None else key}:".encode())
                for part in parts_of(value.as_py().encode().lower().decode()):
                    for run, n in Counter(RUN.findall(part)).items():
                        if len(run) >= shortest:
                            if misspell_every and (h := zlib.crc32(run.encode(), crc)) % misspell_every == 0:
                                run = misspelt(run, h)
                            words[run] = words.get(run, 0) + n
                if len(words) > MOST_WORDS:
                    yield rows()
        yield rows()

    counted = mapped(docs.select(ident(doc_id).cast("string").alias("id"), ident(text).alias("text")), count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.length("word") >= shortest))


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, len, gram, pos): the PREFIX rarest bigrams of each word, in the order of how often a bigram occurs in all words at any place, then of itself, then of its place.

    The order does not look at places first, since an edit moves the bigrams behind it by one. The table of frequencies has at most as many rows as pairs of letters (8,100)."""
    at = F.sequence(F.lit(0), F.length("word") - 2)
    grams = words.select("word", "n", F.explode(F.transform(at, lambda i: F.struct(F.substring("word", i + 1, 2).alias("gram"), i.alias("pos")))).alias("g")).select("word", "n", "g.gram", "g.pos")
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    rows = grams.join(F.broadcast(often), "gram").groupBy("word", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "pos"))), 1, PREFIX).alias("rare"))
    return rows.select("word", "n", F.length("word").alias("len"), F.inline("rare")).drop("often")


def _quarters(pos: Column, length: Column) -> list[tuple[Column, Column]]:
    """Where one edit can be in a word of that length whose bigram at ``pos`` it leaves alone: halves of what is before and of what is behind, as (from, to)."""
    middle, after = F.floor(pos / 2).cast("int"), pos + 2
    behind = after + F.floor((length - after) / 2).cast("int")
    return [(F.lit(0), middle), (middle, pos), (after, behind), (behind, length)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair in both directions: two words that one inserted, deleted or replaced code point makes equal. ``words``: distinct words of SHORTEST code points at least.

    Two such words have a bigram among the rarest of both in common that the edit does not touch: at the same place if the edit is behind it, one place on in the longer word if it is before.
    What the edit can't have touched either, all but a half of one side, must be equal as well, so the join has it as key, with the place of the bigram and the length.
    Words look among those of their own length and of one more. Whole words decide; a key that many words share is split by the join itself (adaptive execution)."""
    rare = stored(rarest_bigrams(words), "rare-bigrams")
    word, pos, length = F.col("word"), F.col("pos"), F.col("len")

    def keys(to_pos: Column, to_len: Column, quarters, shorter: int) -> list[Column]:
        """Keys of words of length ``to_len`` with the bigram at ``to_pos``, as this word has them if it is as long, or by one shorter."""
        cut = ((k, *_quarters(to_pos, to_len)[k]) for k in quarters)
        return [F.when(start < end, F.xxhash64(F.lit(k), to_pos, to_len, F.substring(word, F.lit(1), start), F.substring(word, end + 1 - shorter, length))) for k, start, end in cut]

    own = keys(pos, length, range(4), 0)
    longer = keys(pos, length + 1, (2, 3), 1) + keys(pos + 1, length + 1, (0, 1), 1)
    exploded = lambda found: F.explode(F.array_compact(F.array(*found))).alias("key")
    home = rare.select(word.alias("other"), F.col("n").alias("other_n"), exploded(own)).distinct()
    look = rare.select("word", "n", exploded(own + longer)).distinct()
    met = look.join(home, "key").where((F.length("word") < F.length("other")) | (F.col("word") < F.col("other"))).where(F.levenshtein("word", "other", 1) == 1)
    pairs = stored(met.select("word", "n", "other", "other_n").distinct(), "near-words")
    discard(rare)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def variant_groups(words: DataFrame, *, times: int = 2) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of distinct ``words`` (word, n): how many words are near, the most frequent of them (ties: the least) if it is ``times`` as frequent, and the end of the chain of forms.

    A form is at least twice as frequent as its word, so a chain has at most log2(largest n) steps, and doubled steps reach its end in as many rounds as the logarithm of that.
    Without near words form and form_n are null, n_near is 0 and the root is the word itself. An empty table gives none."""
    if times < 2:
        raise ValueError("forms must be at least twice as frequent, or chains need not end")
    words = words.select("word", "n")
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    chosen = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    best = stored(best.select("word", "n_near", chosen["other"].alias("form"), (-chosen["less"]).alias("form_n")), "forms")
    steps = best.where("form is not null").select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2.0, math.log2(top + 1))))):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    out = words.join(best, "word", "left").join(steps, "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
