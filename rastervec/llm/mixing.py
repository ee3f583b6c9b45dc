"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a target in words and a weight that changes linearly over training time 0..1. The
integral of that weight up to time t, scaled to the target, is the source's cumulative demand D(t).
Its documents, in an order by hash and repeated as often as the target asks, form a stream of words; an
occurrence that begins after u words is trained at the time t with D(t) = u, so a document's repeats lie apart. Occurrences
are then range-sorted by that position.

Running totals never gather a source: each source is cut into ``BUCKETS`` ranges of a hash, ranges are
summed first, and a window runs within one range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rastervec.llm.common import ident, sized, stored

WEIGHTS = (1.0, 2.0, 3.0)
#: Weight at the start and at the end of training, as multiples of the mean; repeated over the sources like the weights.
SCHEDULE = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
MOST_PASSES = 3
BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Words of characters other than space, tab to carriage return; null: none. Each word becomes one letter first."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "a")
    return F.coalesce(F.length(F.regexp_replace(letters, r"[\x20\x09-\x0D]++", "")), F.lit(0)).cast("long")


def place_of(doc_id: Column) -> Column:
    """Where a document stands in its source's stream: the first 60 bits of its id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _slot(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, most: int = MOST_PASSES) -> DataFrame:
    """(_null, _source, size) of all sources to their target in words and their schedule.

    A target is min(most x size, weight x level); the level at which targets add up to all words is the largest of
    (words - caps of the sources before) / (weights from here on) in the order of most x size / weight, which is where
    resharing the excess ends. The windows run over one row for each source.
    """
    every = Window.orderBy("_null", "_source")
    w = sizes.withColumn("_rank", F.row_number().over(every))
    w = w.withColumn("_weight", _slot(F.col("_rank"), weights)).withColumn("_cap", most * F.col("size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.sum(F.col("size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
    w = w.withColumn("target", F.least("_cap", F.col("_weight") * F.max("_level").over(whole)))
    return w.select("_null", "_source", F.col("size").alias("source_size"), "target", _slot(F.col("_rank"), tuple(a for a, _ in schedule)).alias("_w0"), _slot(F.col("_rank"), tuple(b for _, b in schedule)).alias("_w1"))


def at_time(share: Column, w0: Column, w1: Column) -> Column:
    """The time by which ``share`` of a source's demand has come up: the inverse of the weight's integral."""
    return share * (w0 + w1) / (w0 + F.sqrt(w0 * w0 + (w1 * w1 - w0 * w0) * share))


def _placed(docs: DataFrame, *, doc_id: str, text: str, source: str, keep: list[str], weights: tuple, schedule: tuple, most: int) -> DataFrame:
    """_kept (a struct of ``keep``), size, source_size, target, taken, copies, _hash, and what position_of() needs."""
    rows = docs.select(
        F.struct(*(ident(c) for c in keep)).alias("_kept"), word_count(ident(text)).alias("size"), ident(source).isNull().alias("_null"), F.coalesce(ident(source), F.lit("")).alias("_source"), place_of(ident(doc_id)).alias("_hash"), ident(doc_id).alias("_id")
    )
    rows = rows.withColumn("_bucket", F.expr(f"int(_hash div {(1 << 60) // BUCKETS})"))
    keys = ["_null", "_source", "_bucket"]
    ranges = rows.groupBy(*keys).agg(F.sum("size").alias("_words"))
    sources = targets(ranges.groupBy("_null", "_source").agg(F.sum("_words").alias("size")), weights=weights, schedule=schedule, most=most)
    earlier = Window.partitionBy("_null", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words").join(sources, ["_null", "_source"])
    within = Window.partitionBy(*keys).orderBy("_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(ranges, keys).withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    demand = F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size"))
    full = F.when(F.col("source_size") > 0, F.expr("_demand div source_size")).otherwise(F.lit(0))
    out = out.withColumn("_demand", demand).withColumn("_full", full)
    out = out.withColumn("_last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_demand") - F.col("_full") * F.col("source_size") - F.col("_start"))))
    copies = F.when(F.col("size") > 0, F.col("_full") + ((F.col("_last") > 0) & (2 * F.col("_last") >= F.col("size"))).cast("long")).otherwise(F.lit(0)).cast("int")
    return out.withColumn("taken", (F.col("_full") * F.col("size") + F.col("_last")).cast("long")).withColumn("copies", copies)


def position_of(repeat: Column) -> Column:
    """The time of an occurrence, 0 being the first: it begins after all words of its source that stand before it, and ``repeat`` times the whole source."""
    start = F.col("_start") + repeat * F.col("source_size")
    return F.when((F.col("size") > 0) & (start < F.col("_demand")), at_time(start / F.col("_demand"), F.col("_w0"), F.col("_w1")))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, most: int = MOST_PASSES) -> DataFrame:
    """The columns ``keep`` (doc_id alone unless given) with size, source_size, target, taken, copies and position, range-sorted by position.

    Sources are ordered by code point, null last, for their weights. taken: words of the document in the mix; the
    stream stops in the middle of a document where the target does. copies: occurrences of which at least half is taken.
    position: time of the first occurrence, null if there is none. Null and empty texts have size 0 and are never
    taken; very long ones are counted as a whole; repeated rows are documents of their own, and equal rows may change places. An empty table gives no rows.
    """
    keep = [doc_id] if keep is None else keep
    out = _placed(docs, doc_id=doc_id, text=text, source=source, keep=keep, weights=weights, schedule=schedule, most=most)
    out = out.select(*(F.col("_kept").getField(c).alias(c) for c in keep), "size", "source_size", "target", "taken", "copies", position_of(F.lit(0)).alias("position"), F.col("_hash").alias("_tie"))
    return out.repartitionByRange("position", "_tie").sortWithinPartitions("position", "_tie").drop("_tie")  # rows without a position are many: the hash spreads them


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, most: int = MOST_PASSES) -> DataFrame:
    """The documents in training order with their own columns only: each as often as the mix takes it, none that it doesn't, and every occurrence at its own time.

    Documents are numbered and written once; places are found on a few numbers for each, without the texts, which then join them and are sorted. Nulls, empty and very long texts, repeated rows and empty tables are as for mix(); extra columns are carried along, whatever their names.
    """
    names = docs.columns
    rows = stored(docs.select(F.struct(*(ident(c).alias(f"c{i}") for i, c in enumerate(names))).alias("_row"), F.monotonically_increasing_id().alias("_at")), "rows")
    part = lambda c: F.col(f"_row.c{names.index(c)}")
    slim = rows.select(part(doc_id).alias("_doc"), part(text).alias("_text"), part(source).alias("_from"), "_at")
    slim = _placed(slim, doc_id="_doc", text="_text", source="_from", keep=["_at"], weights=weights, schedule=schedule, most=most).where("copies > 0")
    slim = stored(slim.select("_kept._at", "copies", "size", "source_size", "_start", "_demand", "_w0", "_w1", "_hash"), "placed")
    taken = rows.select("_at", "_row").join(sized(slim), "_at").withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    taken = taken.select("_row", position_of(F.col("_repeat")).alias("_position"), F.col("_hash").alias("_tie")).repartitionByRange("_position", "_tie").sortWithinPartitions("_position", "_tie")
    return taken.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)))
