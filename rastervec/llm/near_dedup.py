"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints at most two bits apart have a segment at most
one bit apart, so each probes, for each segment, the table under the segment's value and its 32 neighbours at one
bit; complete distances of the matches are then verified. Equal fingerprints are one entry.

A table bucket with more than ``HEAVY`` entries (near copies that share half of their bits) would give all pairs of its entries.
Those entries, and all that probe such a bucket, meet otherwise: each names the 65 words within one bit of itself. Two
fingerprints are at most two bits apart exactly if they name a common word, so linking each to the least of a word's namers
loses no link and adds none between components.

one_of_each() asks for a similarity of texts, 0.8 of their runs of five words. Such fingerprints of 64 bits are up to twenty bits apart, and balls of that size
hold most of a segment's table. So sets have fingerprints of 1024 bits, cut into segments of two bits more than the number of sets takes: those that share a whole
segment are candidates, complete distances thin them out, and whole sets decide. What this links is one component. An exact check by shared rare runs
between the components follows, since two sets at 0.8 may share no segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rastervec.llm.common import SMALL_BATCH, discard, ident, mapped, sized, slices, stored, texts_of

SHINGLE, DISTANCE, HEAVY = 3, 2, 64
#: Of one_of_each(): words of a run, beyond how many sets a hash comes last, sets of a block, how many common hashes are told apart at most, and the share of
#: sets (one in so many) that tells which hashes are common. The last two change the order of hashes only, not what is found.
RUN, COMMON, BLOCK, MOST_LATE, TELLING = 5, 64, 512, 1 << 20, 4
#: Longs of a set's fingerprint, and how many sets of a bucket of its segments are compared in all pairs: chance rarely brings more together, and groups of near copies must not give the square of their size.
WORDS, FEW = 16, 4
#: Bits that fingerprints (64, 128 and all 1024 of them) of sets with a resemblance of 0.8 may differ in; they do in 10, 19 and 155 (deviation 3, 4 and 12). Smaller sets than SMALL aren't judged by theirs.
#: A link of a resemblance near 0.8 may be lost to these bounds about once in some millions; ``exact`` leaves them out.
NEAR_64, NEAR_128, NEAR_ALL, SMALL = 24, 42, 240, 64
_CUT = 1 << 16
#: Odd factors that mix a hash anew for each long of a fingerprint but the first.
_FACTORS = np.array([0xD6E8FEB86659FD93 * pow(0x9E3779B97F4A7C15, k, 1 << 64) % (1 << 64) for k in range(WORDS - 1)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a whole text, in slices of shingles; 0 if it has no words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _CUT):
        part = words[lo : min(n, lo + _CUT) + shingle - 1]
        parts = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in parts], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with fp, the fingerprint of the whole text; a null text has no words."""
    rows = docs.select(*keep, ident(text).alias("_text"))
    schema = rows.drop("_text").schema.add("fp", "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            fps = pa.array([fingerprint(t) for t in texts_of(batch, "_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_text"]).columns, fps], names=schema.names)

    return mapped(rows, hashed, schema)


def _flips(value: str, bits: range) -> str:
    """SQL for a value and its neighbours at one of these bits."""
    return f"transform(array(0L, {', '.join(f'{1 << b if b < 63 else -(1 << 63)}L' if b < 63 else 'shiftleft(1L, 63)' for b in bits)}), m -> {value} ^ m)"


def links(fps: DataFrame, *, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp`` at most two bits apart; complete for light buckets, enough for the same components in all."""
    low = "fp & 4294967295L"
    high = "shiftrightunsigned(fp, 32)"
    entries = fps.select("fp", F.expr(f"inline(array(struct(0 AS seg, {high} AS val), struct(1 AS seg, {low} AS val)))"))
    full = entries.groupBy("seg", "val").count().where(F.col("count") > heavy).select("seg", "val")
    light = entries.join(full, ["seg", "val"], "left_anti")
    probes = entries.select("seg", F.col("fp").alias("a"), F.explode(F.expr(_flips("val", range(32)))).alias("val"))
    near = probes.join(light.withColumnRenamed("fp", "b"), ["seg", "val"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    around = full.select("seg", F.explode(F.expr(_flips("val", range(32)))).alias("val")).distinct()
    meeting = entries.join(around, ["seg", "val"], "left_semi").select("fp").distinct().select("fp", F.explode(F.expr(_flips("fp", range(64)))).alias("word"))
    least = meeting.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("_b")).where("a < _b").select("word", "a")
    stars = meeting.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root the least node of its component; alternately large and small stars.

    Every round is written to the shared folder, so lineage stays short and no round is computed twice.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
        before = now
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        state = stored(small.where("u <> v").distinct(), "links")


def classes(rows: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """(fp, root, component_id, row of the class) of all distinct fingerprints of ``rows`` (doc_id, fp), which are read from files."""
    own = stored(rows.groupBy("fp").agg(F.min(doc_id).alias("_least")), "fingerprints")
    roots = components(links(own.select("fp")))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of all that can be reached over links.

    Null and empty texts have fingerprint zero and are linked like any other. Null ids count for no component_id (null if a component
    has no other); rows with the same id keep a row each. Very long texts are hashed in slices. An empty table gives no rows; extra columns are not read.
    """
    rows = stored(fingerprints(docs, text=text, keep=[ident(doc_id).alias("doc_id")]), "rows")
    out = rows.join(classes(rows), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def resemblance_set(text: str) -> np.ndarray:
    """The different runs of ``RUN`` words of a text as sorted 64-bit hashes; a shorter text is one run, one without words has none."""
    words = text.encode().lower().split()
    n = len(words) - RUN + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))][: len(words)], "<u8").view("<i8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(RUN):
        out = (out ^ h[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def set_fingerprints(runs: np.ndarray, longs: int = WORDS) -> np.ndarray:
    """The SimHash of a set of hashes: signed longs, each from hashes mixed anew, in slices whose sums fit a byte."""
    h, ones = runs.view(np.uint64), np.zeros(64 * longs, np.int64)
    for lo in range(0, len(h), 255):
        part = h[lo : lo + 255, None]
        mixed = (part ^ (part >> np.uint64(31))) * _FACTORS[: longs - 1]
        every = np.concatenate([part, mixed ^ (mixed >> np.uint64(29))], axis=1)
        ones += np.unpackbits(every.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def _prefix(runs: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 hashes of a set in an order in which ``late`` ones (sorted) come last."""
    last = late[np.minimum(np.searchsorted(late, runs), len(late) - 1)] == runs if len(late) else np.zeros(len(runs), bool)
    return (np.concatenate([runs[~last], runs[last]]) if last.any() else runs)[: len(runs) // 5 + 1]


def _with_sets(rows: DataFrame, *, prefix: bool, late: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``_text`` replaced by node (a hash of the whole set), n (its size) and set; with ``prefix`` this is only what _prefix() takes of it, and fp its fingerprint's first long; without ``late`` there are also fq, the second, and wide, all of it."""
    schema = rows.drop("_text").schema.add("node", "long").add("n", "long").add("set", ArrayType(LongType()))
    if prefix:
        schema = schema.add("fp", "long")
    if prefix and late is None:
        schema = schema.add("fq", "long").add("wide", ArrayType(LongType()))
    shared = rows.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64) if late is None else late)
    longs = WORDS if late is None else 1

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            sets = [resemblance_set(t) for t in texts_of(batch, "_text").to_pylist()]
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64))
            own = [nodes, pa.array([len(s) for s in sets], pa.int64()), _lists([_prefix(s, shared.value) for s in sets] if prefix else sets)]
            if prefix:
                prints = [set_fingerprints(s, longs) for s in sets]
                own += [pa.array([x[k] for x in prints], pa.int64()) for k in range(min(2, longs))]
                own += [_lists(prints)] if longs > 1 else []
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_text"]).columns, *own], names=schema.names)

    return mapped(rows, described, schema, SMALL_BATCH)


#: What pairs of sets must have to be compared further: like sizes, and fingerprints that are not far apart.
_CLOSE = "5 * n_a >= 4 * n_b AND 5 * n_b >= 4 * n_a"
_ALIKE = f"(least(n_a, n_b) < {SMALL} OR bit_count(fp_a ^ fp_b) <= {NEAR_64})"


#: Complete distances, of whole fingerprints and of their first two longs, the bound, and the columns they take.
_WHOLE = " + ".join(f"bit_count(wide_a[{k}] ^ wide_b[{k}])" for k in range(WORDS)), NEAR_ALL, ("wide",)
_TWO = "bit_count(fp_a ^ fp_b) + bit_count(fq_a ^ fq_b)", NEAR_128, ("fp", "fq")


def _resembling(pairs: DataFrame, entries: DataFrame, sets_of: Callable[[DataFrame], DataFrame], exact: bool, *, distance: tuple[str, int, tuple[str, ...]] = _TWO, roots: DataFrame | None = None) -> DataFrame:
    """The different pairs (a, b) whose sets resemble: first by complete distances of their fingerprints, then by whole sets. With ``roots``, only pairs between these components."""
    own = lambda side, rows, *more: rows.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *more)))
    known = stored(pairs.select("a", "b").distinct(), "pairs")
    apart = known
    if roots is not None:
        root = lambda side: sized(roots).select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        apart = known.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    bits, most, columns = distance
    near = f"least(n_a, n_b) < {SMALL} OR {bits} <= {most}"
    likely = stored((apart if exact else apart.join(own("a", entries, *columns), "a").join(own("b", entries, *columns), "b").where(near)).select("a", "b"), "likely")
    named = stored(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    sets = stored(sets_of(named), "sets")
    both = likely.join(own("a", sets, "set"), "a").join(own("b", sets, "set"), "b")
    out = stored(both.where("9 * size(array_intersect(set_a, set_b)) >= 4 * (n_a + n_b)").select("a", "b"), "resembling")
    discard(known, likely, named, sets)
    return out


def _forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links by place that join the components of resembling sets, from all pairs."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    meet = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1, 4096):
        i, j = np.searchsorted(column, (lo, lo + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        meet += part @ part.T
    near = 9 * meet.astype(np.int64) >= 4 * (sizes[:, None] + sizes[None, :])
    links, new = [], np.ones(len(sets), bool)
    for k in range(len(sets)):
        if new[k]:
            new[k], edge = False, np.array([k])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(0) & new)
                new[edge] = False
                links += [(k, int(x)) for x in edge]
    return links


def _in_families(posts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """(a, b): links within the families of ``posts`` (node, hash), which are joined by common hashes; all pairs of blocks of a family meet in a task."""
    ties = posts.join(posts.groupBy("hash").agg(F.min("node").alias("b")), "hash").select(F.col("node").alias("a"), "b").distinct()
    kin = components(ties).select("node", F.col("root").alias("family"))
    blocks = F.ceil(F.count("*").over(Window.partitionBy("family")) / block)
    named = stored(kin.select("node", "family", blocks.alias("_k"), F.pmod(F.xxhash64("node"), blocks).alias("_b")), "families")
    others = F.when(F.col("_k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda x: x != F.col("_b")))
    cells = named.join(sets_of(named.select("node")), "node").select("node", "set", "family", "_b", F.explode(others).alias("_o"))
    cells = cells.select("node", "set", "family", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))

    def joined(cell: pa.Table) -> pa.Table:
        nodes, sets = cell["node"].to_numpy(), [x.values.to_numpy(zero_copy_only=False) for x in cell["set"]]
        found = np.array(_forest(sets), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})

    return stored(cells.groupBy("family", "i", "j").applyInArrow(joined, "a long, b long"), "kin")


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` whose hash is in several, with their number as _of. Hashes are counted before they are shuffled, and the join splits a common one (adaptive execution)."""
    return rows.join(rows.groupBy("hash").agg(F.count("*").alias("_of")).where("_of > 1"), "hash")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours (kind 0) among rows (hash, node, n, fp) that come in order, and the first (1) and last row (2) of the partition, for its borders."""
    part, last = TaskContext.get().partitionId(), None
    names = [f"{c}_{s}" for s in "ab" for c in ("hash", "node", "n", "fp")]

    def rows(kind: int, a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        k = np.full(len(a[0]), kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), part, np.int32)), *map(pa.array, (*a, *b))], names=["kind", "part", *names])

    for batch in batches:
        own = [batch.column(i).to_numpy().astype(np.int64) for i in range(4)]
        if not len(own[0]):
            continue
        if last is None:
            yield rows(1, [c[:1] for c in own], [c[:1] for c in own])
            last = [c[:0] for c in own]
        every = [np.concatenate([x, c]) for x, c in zip(last, own)]
        same = np.flatnonzero(every[0][1:] == every[0][:-1])
        yield rows(0, [c[same] for c in every], [c[same + 1] for c in every])
        last = [c[-1:] for c in own]
    if last is not None:
        yield rows(2, last, last)


def _neighbours(posts: DataFrame) -> DataFrame:
    """(node_a, n_a, fp_a, node_b, n_b, fp_b): neighbours in the list of sets with a hash, by size. All lists are one range-sorted table, so a long list lies in many
    partitions; the rows at their borders, two for each partition, meet in one window."""
    kinds = ", ".join(f"{c}_{s} long" for s in "ab" for c in ("hash", "node", "n", "fp"))
    order = posts.select("hash", "node", F.col("n").cast("long").alias("n"), "fp").repartitionByRange("hash", "n", "node").sortWithinPartitions("hash", "n", "node")
    found = stored(mapped(order, _beside, f"kind int, part int, {kinds}", SMALL_BATCH), "neighbours")
    at = Window.orderBy("part", "kind")
    border = found.where("kind > 0").select(*(F.lag(f"{c}_a").over(at).alias(f"{c}_a") for c in ("hash", "node", "n", "fp")), *(f"{c}_b" for c in ("hash", "node", "n", "fp")), "kind").where("kind = 1 AND hash_a = hash_b")
    columns = [f"{c}_{s}" for s in "ab" for c in ("node", "n", "fp")]
    return found.where("kind = 0").select(columns).union(border.select(columns))


def _segments(size: int) -> list[str]:
    """SQL for the whole segments of ``size`` bits (32 at most) of a fingerprint ``wide``, each with its place in the upper half of a long."""
    out = []
    for k in range(64 * WORDS // size):
        word, bit = divmod(k * size, 64)
        above = f" | shiftleft(wide[{word + 1}], {64 - bit})" if bit + size > 64 else ""
        out.append(f"{k << 32}L | ((shiftrightunsigned(wide[{word}], {bit}){above}) & {(1 << size) - 1}L)")
    return out


def by_segments(entries: DataFrame, sets_of: Callable[..., DataFrame], *, size: int | None = None, heavy: int = FEW, exact: bool = False) -> DataFrame:
    """(a, b): links between different sets of a resemblance of 0.8 at least whose fingerprints share a whole segment (multi-index hashing); all within 1024 // ``size`` - 1 bits do.

    A segment has two bits more than the number of sets takes, so that a bucket of its table holds a fraction of a set by chance, however many sets there are. Of a bucket
    with more than ``heavy`` sets, neighbours by size are compared, which links groups of near copies; what else it may hold is left to the exact check.
    """
    size = size or min(32, max(16, entries.count().bit_length() + 2))
    posts = entries.where("n > 0").select("node", "n", "fp", F.explode(F.expr(f"array({', '.join(_segments(size))})")).alias("hash"))
    posts = stored(_counted(posts), "segments")
    alike = f"{_CLOSE} AND {'true' if exact else _ALIKE}"
    side = lambda s: posts.where(F.col("_of") <= heavy).select("hash", *(F.col(c).alias(a) for c, a in (("node", s), ("n", f"n_{s}"), ("fp", f"fp_{s}"))))
    pairs = side("a").join(side("b"), "hash").where(f"a < b AND {alike}").select("a", "b")
    full = posts.where(F.col("_of") > heavy)
    if not full.isEmpty():
        beside = _neighbours(full).withColumnsRenamed({"node_a": "a", "node_b": "b"}).where(alike)
        pairs = pairs.union(beside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    out = _resembling(pairs, entries, sets_of, exact, distance=_WHOLE)
    discard(posts)
    return out


def resemblances(entries: DataFrame, sets_of: Callable[..., DataFrame], *, common: int = COMMON, block: int = BLOCK, most_late: int = MOST_LATE, telling: int = TELLING, exact: bool = False) -> DataFrame:
    """(a, b): links between different sets of a resemblance of 0.8 at least, enough for the components of all such pairs.

    entries: node, n, set (the prefix), wide, fp and fq of each set; sets_of: node, n and whole sets for a stored table of nodes. Segments of the fingerprints link first. The exact check
    that follows is between their components: two sets of that resemblance share a hash of both prefixes, in whatever order all sets are sorted. Neighbours in a list of
    the sets with a hash are compared first, so that groups of near copies are components, and only pairs between components are compared then. Where over ``common`` sets of several components share a hash, the hashes that many of
    these sets hold come last in the order (the ``most_late`` most common ones, as one in ``telling`` of the sets shows): prefixes are taken anew. What still crowds then are texts made of such hashes, whole families; they
    are compared block by block.
    """
    hashed = by_segments(entries, sets_of, exact=exact)
    linked = stored(components(hashed), "roots")
    discard(hashed)
    listed = entries.where("n > 0").select("node", "n", "fp", F.explode("set").alias("hash"))
    shared = lambda rows: stored(_counted(rows), "shared")
    posts = shared(listed)
    beside = _neighbours(posts).withColumnsRenamed({"node_a": "a", "node_b": "b"})
    alike = "true" if exact else _ALIKE
    found = linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_resembling(beside.where(f"{_CLOSE} AND {alike}"), entries, sets_of, exact, roots=linked))
    roots = stored(components(found), "roots")

    def rooted(rows: DataFrame) -> DataFrame:
        """Of hashes shared by several components."""
        rows = stored(rows.join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "posts")
        several = stored(rows.groupBy("hash").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).where("_r < _s").select("hash"), "several")
        out = stored(rows.join(sized(several), "hash", "left_semi"), "rooted")
        discard(rows, several)
        return out

    met = rooted(posts)
    discard(posts)
    crowd = stored(met.where(F.col("_of") > common).select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        some = stored(crowd.where(F.pmod(F.xxhash64("node"), F.lit(telling)) == 0), "some")
        held = sets_of(some).select(F.explode("set").alias("hash")).groupBy("hash").count().where(F.col("count") > common / telling / 3)  # few that over ``common`` sets hold are missed
        late = stored(held.orderBy(F.desc("count"), "hash").limit(most_late).select("hash"), "late")  # a bounded number; any order of the hashes gives the same links
        anew = stored(listed.join(sized(late), "hash", "left_semi").select("node").distinct(), "anew")
        discard(met)
        again = stored(sets_of(anew, late=np.sort(late.toPandas()["hash"].to_numpy(np.int64))), "again")  # read twice below, so written once
        posts = shared(listed.join(sized(anew), "node", "left_anti").unionByName(again.select("node", "n", "fp", F.explode("set").alias("hash"))))
        discard(again)
        met = rooted(posts)
        discard(posts)
        found = found.union(_in_families(met.where(F.col("_of") > common), sets_of, block))
    side = lambda s: met.where(F.col("_of") <= common).select("hash", *(F.col(c).alias(a) for c, a in (("node", s), ("n", f"n_{s}"), ("root", f"root_{s}"), ("fp", f"fp_{s}"))))
    across = side("a").join(side("b"), "hash").where(f"a < b AND root_a <> root_b AND {_CLOSE} AND {alike}")
    return found.union(_resembling(across, entries, sets_of, exact))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """The documents with their own columns only, one of each component of documents whose sets of runs of five words have a Jaccard index of 0.8 at least.

    It is the row with the least id, of rows with the same id any one; a null id comes last. Texts without words (null, empty) are copies of each other; a text of fewer than five words is
    one run; case is folded as for fingerprints. A very long text is one set of all its runs. Repeated rows leave one. An empty table gives no rows. Extra columns are carried along, whatever their names.
    """
    names = docs.columns
    place = names.index(text)
    base = stored(docs.select(F.monotonically_increasing_id().alias("_at"), F.struct(*(ident(c).alias(f"c{i}") for i, c in enumerate(names))).alias("_row"), ident(doc_id).alias("_id")), "base")
    rows = stored(_with_sets(base.select("_at", "_id", F.col(f"_row.c{place}").alias("_text")), prefix=True), "rows")  # texts don't come back from Python
    slim = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_at")).alias("_best")), "best")
    first_of = stored(slim.select(F.col("_best._at").alias("_at")), "first-of")
    entries = stored(rows.select("_at", "node", "n", "set", "fp", "fq", "wide").join(sized(first_of), "_at", "left_semi").drop("_at"), "entries")
    discard(rows, first_of)

    def sets_of(nodes: DataFrame, late: np.ndarray | None = None) -> DataFrame:
        at = stored(slim.join(sized(nodes), "node", "left_semi").select(F.col("_best._at").alias("_at")), "at")
        return _with_sets(base.select("_at", F.col(f"_row.c{place}").alias("_text")).join(sized(at), "_at", "left_semi").select("_text"), prefix=late is not None, late=late)

    roots = stored(components(resemblances(entries, sets_of, exact=exact)), "roots")
    discard(entries)
    first = stored(slim.join(sized(roots), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("_best").alias("_best")).select("_best._at"), "first")
    kept = stored(base.join(sized(first), "_at", "left_semi").select(F.col("_row")), "kept")
    discard(base, slim, roots, first)
    return kept.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)))
