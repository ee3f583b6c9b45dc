"""Zip archives of any size: members are packed in parts by many tasks, and what must be known of whole members follows from the parts.

A part is deflated on its own and ends on a byte; parts after one another, and an empty last block, are one deflated member. The CRC-32 of a member is the
exclusive or of its parts' CRC-32, each moved over the bytes behind it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastervec.operators.components import settled

#: Bytes of a part before it is packed.
PART = 1 << 20
#: Marks of the records, the polynomial of CRC-32, an empty last block, the greatest 32-bit number, and the first day of the format.
LOCAL, CENTRAL, END, END_64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
POLYNOMIAL, LAST_BLOCK, FULL, FIRST_DAY = 0xEDB88320, b"\x03\x00", 0xFFFFFFFF, (1 << 5) + 1


def crc_moved(crc: int, n: int) -> int:
    """What a CRC-32 adds to that of a text of ``n`` bytes more: its polynomial times x to the power 8 n."""

    def times(a: int, b: int) -> int:
        out = 0
        for _ in range(32):
            if a & 0x80000000:
                out ^= b
            b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
            a = a << 1 & FULL
        return out

    power = 0x00800000  # x to the power 8
    while n:
        if n & 1:
            crc = times(power, crc)
        power, n = times(power, power), n >> 1
    return crc


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, size, crc, bytes): parts of about PART bytes, of one file each, from rows (file, part, seq, bytes) in order."""
    name, held, size = None, [], 0

    def part() -> pa.RecordBatch:
        data, coder = b"".join(held), zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = coder.compress(data) + coder.flush(zlib.Z_FULL_FLUSH)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([zlib.crc32(data)], pa.int64()), pa.array([packed], pa.binary())], names=["file", "size", "crc", "bytes"])

    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if held and (file != name or size >= PART):
                yield part()
                held, size = [], 0
            name, size = file, size + len(data)
            held.append(data)
    if held:
        yield part()


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        moved = [crc_moved(c, n) for c, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved, pa.int64())], names=["file", "crc"])


def _local(name: bytes, crc: int, size: int, packed: int) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, packed)
    return struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 8, 0, FIRST_DAY, crc, FULL, FULL, len(name), len(extra)) + name + extra


def _directory(members: list) -> bytes:
    """The central directory, with sizes and places of 64 bits, and the end of the archive."""
    out, at = b"", members[-1]["at"] + members[-1]["whole"] if members else 0
    for m in members:
        name, extra = m["file"].encode(), struct.pack("<HHQQQ", 1, 24, m["size"], m["packed"], m["at"])
        out += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 8, 0, FIRST_DAY, m["crc"], FULL, FULL, len(name), len(extra), 0, 0, 0, 0, FULL) + name + extra
    end_64 = struct.pack("<IQHHIIQQQQ", END_64, 44, 45, 45, 0, 0, len(members), len(members), len(out), at) + struct.pack("<IIQI", LOCATOR, 0, at + len(out), 1)
    return out + end_64 + struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, FULL, FULL, 0)


def archive(parts: DataFrame, *, order: list[str] | None = None) -> DataFrame:
    """(member, seq, bytes): one after another in this order, the rows are a zip archive of the files whose pieces are ``parts`` (file, part, seq, bytes); null bytes are empty.

    Files stand as in ``order``, others behind them by name. Pieces are brought into order by ranges, packed where they are and stored once; what is gathered is a row for each part of 1 MB
    without its bytes, in the task of its file, and a row for each file on the driver. No pieces: an archive without members."""
    spark = parts.sparkSession
    rank = F.coalesce(*(F.when(F.col("file") == f, i) for i, f in enumerate(order or [])), F.lit(len(order or [])))
    rows = parts.select("file", "part", "seq", F.coalesce("bytes", F.lit(b"")).alias("bytes"), rank.alias("_rank")).repartitionByRange("_rank", "file", "part", "seq").sortWithinPartitions("_rank", "file", "part", "seq")
    packed = settled(rows.mapInArrow(_packed, "file string, size long, crc long, bytes binary").withColumn("seq", F.monotonically_increasing_id()))
    behind = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crcs = packed.select("file", "crc", behind.alias("behind")).mapInArrow(_moved, "file string, crc long").groupBy("file").agg(F.bit_xor("crc").alias("crc"))
    sums = packed.groupBy("file").agg(F.sum("size").alias("size"), (F.sum(F.length("bytes")) + len(LAST_BLOCK)).alias("packed"))
    members, at = [], 0
    for m in sums.join(crcs, "file").orderBy(rank, "file").toLocalIterator():  # a row for each file
        head = _local(m["file"].encode(), m["crc"], m["size"], m["packed"])
        members.append({**m.asDict(), "at": at, "head": head, "whole": len(head) + m["packed"]})
        at += members[-1]["whole"]
    fixed = [(k, -1, m["head"]) for k, m in enumerate(members)] + [(k, (1 << 63) - 1, LAST_BLOCK) for k in range(len(members))] + [(len(members), 0, _directory(members))]
    out = spark.createDataFrame([(k, s, bytearray(b)) for k, s, b in fixed], "member int, seq long, bytes binary")
    if not members:
        return out
    places = spark.createDataFrame([(m["file"], k) for k, m in enumerate(members)], "file string, member int")
    return out.unionByName(packed.join(F.broadcast(places), "file").select("member", "seq", "bytes"))
