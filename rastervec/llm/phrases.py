"""Collocations: phrases counted by position bitmaps of words, scored by how much more often they stand together than their parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastervec.llm.common import bytes_of, ident, mapped, slices, stored, texts_of

#: Classes of bytes: 0 of words, 1 between words, 2 between pieces. A-Z become a-z.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of the texts of a shard (a longer text is one alone), positions of a block of a bitmap, and ANDs that are done at once.
SHARD_BYTES, BLOCK, AT_ONCE = 2 << 20, 16, 1 << 17
#: Bits of the filter of frequent pairs (8 MB at every size of input): it lets all of them pass, and of the others fewer as long as it is not full.
FILTER_BITS, FILTER_PART = 1 << 26, 1 << 15


class Shard:
    """Words of some texts on one axis of positions, an empty one between pieces, as compressed bitmaps: for each (language and) word the blocks of positions that it is in, with a bit for each.

    ``words``, ``langs``: of each word number; ``n``: its occurrences. The rows (word, block, bits) are kept by word, and once more by block."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, at = bytes_of(texts)
        kind, raw = _CLASS[raw], _LOWER[raw]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(at))
        first[at[full]], last[at[full + 1] - 1] = inside[at[full]], inside[at[full + 1] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(at, start, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        self.position = np.arange(len(start)) + (np.cumsum(np.diff(piece, prepend=piece[:1]) + np.diff(doc, prepend=doc[:1]) > 0) if len(start) else 0)
        edges = np.stack([start, end], 1).ravel()
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)])
        coded = runs.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64)
        lang = langs.dictionary_encode()
        used, word = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] * (len(coded.dictionary) + 1) + codes, return_inverse=True)
        self.words = coded.dictionary.take(pa.array(used % (len(coded.dictionary) + 1))).cast(pa.large_string())
        self.langs = lang.dictionary.take(pa.array(used // (len(coded.dictionary) + 1)))
        self.n = np.bincount(word, minlength=len(used))
        order = np.argsort(word, kind="stable")
        word, position = word[order], self.position[order]
        block = position // BLOCK
        new = np.flatnonzero(np.diff(word, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool))
        bits = np.left_shift(1, position % BLOCK).astype(np.uint16)
        self.word, self.block, self.bits = word[new], block[new], np.bitwise_or.reduceat(bits, new) if len(new) else bits
        order = np.argsort(self.block, kind="stable")
        self.word_at, self.bits_at = self.word[order], self.bits[order]
        self.many = np.bincount(self.block, minlength=int(self.position[-1]) // BLOCK + 2 if len(start) else 1)
        self.since = np.cumsum(self.many) - self.many

    def followers(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of the phrases by one word, as rows (phrase, word, block, bits): bitmaps of last words, shifted by one place, AND those of the words in the same blocks."""
        shifted = bits.astype(np.uint32) << 1
        over = np.flatnonzero(shifted >> BLOCK)
        phrase, block = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1])
        shifted = np.concatenate([shifted & 0xFFFF, np.ones(len(over), np.uint32)]).astype(np.uint16)
        many = self.many[block]
        row = np.repeat(np.arange(len(block)), many)
        other = np.arange(len(row)) + np.repeat(self.since[block] - (np.cumsum(many) - many), many)
        both = shifted[row] & self.bits_at[other]
        hit = np.flatnonzero(both)
        row = row[hit]
        return phrase[row], self.word_at[other[hit]], block[row], both[hit]

    def grow(self, most: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases as rows of word numbers, popcounts) of two to ``most`` words, depth first; ``keep`` says which pairs of neighbours may stand in a phrase. A phrase may come several times, with parts of its count."""

        def extend(words: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            cost = np.cumsum(2 * self.many[block] + 1)
            cuts = np.searchsorted(cost, np.arange(0, cost[-1] if len(cost) else 0, AT_ONCE))
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                old, word, at, both = self.followers(phrase[a:b], block[a:b], bits[a:b])
                used, new = np.unique(old * len(self.words) + word, return_inverse=True)
                longer = np.concatenate([words[used // len(self.words)], (used % len(self.words))[:, None]], 1)
                good = keep(longer[:, -2], longer[:, -1])
                count = np.bincount(new, np.bitwise_count(both), minlength=len(used)).astype(np.int64)
                yield longer[good], count[good]
                if longer.shape[1] < most:
                    rows = np.flatnonzero(good[new])
                    rows = rows[np.argsort(new[rows], kind="stable")]
                    yield from extend(longer, new[rows], at[rows], both[rows])

        yield from extend(np.arange(len(self.words))[:, None], self.word, self.block, self.bits)

    def rows(self, phrases: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        text = self.words.take(pa.array(phrases[:, 0]))
        for k in range(1, phrases.shape[1]):
            text = pc.binary_join_element_wise(text, self.words.take(pa.array(phrases[:, k])), pa.scalar(" ", pa.large_string()))
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(phrases[:, 0])), text, pa.array(count)], names=["lang", "phrase", "n"])

    def hashes(self) -> np.ndarray:
        """64 bits of each word with its language."""
        return _hashes(self.langs.to_pylist(), self.words.to_pylist())


def _hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f"{lang}\t{word}".encode()) for lang, word in zip(langs, words)), np.uint64, len(words))


def _places(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each pair of word hashes."""
    h = (first * np.uint64(0x9E3779B97F4A7C15) ^ (first >> np.uint64(29))) + second
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(38)).astype(np.int64) % bits, (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % bits


def _filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bits that pairs (lang, phrase) set, packed: parts are made where their bits meet, ``bits`` in all come to the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, two = batch.column(0).to_pylist(), [p.split(" ") for p in batch.column(1).to_pylist()]
            at = np.unique(np.concatenate(_places(_hashes(langs, [a for a, _ in two]), _hashes(langs, [b for _, b in two]), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_PART), pa.array(at % FILTER_PART)], names=["part", "bit"])

    def packed(rows: pa.Table) -> pa.Table:
        own = np.zeros(FILTER_PART, bool)
        own[rows["bit"].to_numpy()] = True
        return pa.table({"part": rows["part"][:1], "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    parts = mapped(pairs.select("lang", "phrase"), places, "part long, bit long").distinct().groupBy("part").applyInArrow(packed, "part long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for part in parts.toLocalIterator():
        out[part["part"] * FILTER_PART // 8 : (part["part"] + 1) * FILTER_PART // 8] = np.frombuffer(part["bits"], np.uint8)
    return out


def _counted(docs: DataFrame, emit: Callable[[Shard], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(lang, phrase, n): what ``emit`` gives for each shard of ``docs`` (text, lang), summed.

    A shard has summed its own rows; most are the only ones of their phrase in a task, so they are summed again only after they have met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD_BYTES):
            yield from emit(Shard(texts_of(part, "text"), texts_of(part, "lang")))

    return mapped(docs, rows, "lang string, phrase string, n long").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", most_words: int = 3, least: int = 10, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, n): words and phrases of up to ``most_words`` words with ``least`` occurrences within pieces at least, and under the empty phrase how many words a language has.

    Words and pairs are counted first. Longer phrases can only be frequent where all their pairs are, so shards extend bitmaps depth first through pairs that a filter of fixed size lets pass (all frequent ones, and some
    others, whose phrases are counted and dropped). Each shard sends a row for each different phrase, so a phrase of every document is no hot spot. Null texts are empty, null languages `und`; repeated rows
    count again; a very long text is a shard of its own; other columns are not read; an empty table gives none."""
    docs = docs.select(ident(text).alias("text"), F.coalesce(ident(lang).cast("string"), F.lit("und")).alias("lang"))

    def short(shard: Shard) -> Iterator[pa.RecordBatch]:
        own = np.arange(len(shard.words))[:, None]
        yield shard.rows(own, shard.n)
        totals = shard.rows(own, shard.n).set_column(1, "phrase", pa.array([""] * len(own), pa.large_string()))
        yield from pa.table(totals.to_pydict(), totals.schema).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"]).to_batches()
        if most_words > 1:
            for phrases, count in shard.grow(2, lambda a, b: np.ones(len(a), bool)):
                yield shard.rows(phrases, count)

    out = stored(_counted(docs, short).where((F.col("n") >= least) | (F.col("phrase") == "")), "short-phrases")
    if most_words < 3:
        return out
    passing = docs.sparkSession.sparkContext.broadcast(_filter(out.where(F.contains("phrase", F.lit(" "))), filter_bits))

    def long(shard: Shard) -> Iterator[pa.RecordBatch]:
        bits, hashes = passing.value, shard.hashes()

        def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            good = np.ones(len(a), bool)
            for at in _places(hashes[a], hashes[b], filter_bits):
                good &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            return good

        for phrases, count in shard.grow(most_words, keep):
            if phrases.shape[1] > 2:
                yield shard.rows(phrases, count)

    return out.unionByName(stored(_counted(docs, long).where(F.col("n") >= least), "long-phrases"))


def _parts(words: Column, sizes: Column, m: Column) -> Column:
    """All runs of ``sizes`` words."""
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), m - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", most_words: int = 3, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more that stand ``least`` times in its pieces, by score, then a, then the phrase.

    Cut after its first words, a phrase scores floor(1,000,000 a a / (l r)), with l and r the counts of both parts; the least of its cuts counts, the shortest first part on ties. Phrases within a longer one that has
    ``covered`` percent of their count go. Numbers are decimals of 38 digits. Tables without phrases give no rows; for odd rows see phrase_counts()."""
    counts = phrase_counts(docs, text=text, lang=lang, most_words=most_words, least=least)
    words = F.split("phrase", " ")
    found = counts.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("m"))
    phrases = found.where("m > 1")
    cuts = phrases.select("lang", "phrase", "a", "m", "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("m")), " ").alias("right"))
    count_of = lambda part, n: found.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    cuts = cuts.join(count_of("left", "l"), ["lang", "left"]).join(count_of("right", "r"), ["lang", "right"])
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000000 * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')})")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if most_words > 2:
        inner = phrases.where("m > 2").select("lang", "a", F.explode(_parts(F.col("words"), F.sequence(F.lit(2), F.col("m") - 1), F.col("m"))).alias("phrase"))
        longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # tasks keep their own first rows before they meet
    return best.join(counts.where("phrase = ''").select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
