"""Ranges of addresses from a database in the public MMDB layout, as a table for ``enrich_geo``.

The file holds a binary trie over the bits of addresses, whose leaves point into a section of typed values. It is read
by Spark (below 2 GB, as a row), and one task walks the trie and gives its leaves as they come, in order of addresses;
nothing but the way to the current leaf is kept. A leaf is the longest prefix of what lies below it, so the ranges don't
overlap. IPv4 addresses stand at ::/96; other places of the trie that lead to the same node are names for it and skipped.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"\xab\xcd\xefMaxMind.com"
#: Numbers of the types of values.
POINTER, STRING, DOUBLE, BYTES, UINT16, UINT32, MAP, INT32, UINT64, UINT128, ARRAY, BOOLEAN, FLOAT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15
_RANGES = "first string, last string, geo_country string, asn long, source_sha256 string"


class Values:
    """Typed values at offsets of a section; a value may be a pointer to another one."""

    def __init__(self, data: bytes):
        self.data = data

    def at(self, offset: int) -> tuple[object, int]:
        """The value at an offset, and where the next one begins."""
        control = self.data[offset]
        kind, offset = control >> 5, offset + 1
        if kind == POINTER:
            size = (control >> 3) & 3
            raw = int.from_bytes(self.data[offset : offset + size + 1])
            target = raw if size == 3 else ((control & 7) << (8 * (size + 1))) + raw + (0, 2048, 526336)[size]
            return self.at(target)[0], offset + size + 1
        if kind == 0:
            kind, offset = 7 + self.data[offset], offset + 1
        size = control & 31
        if size >= 29:  # the size goes on in one to three bytes
            more = size - 28
            size = int.from_bytes(self.data[offset : offset + more]) + (29, 285, 65821)[more - 1]
            offset += more
        if kind == MAP:
            out = {}
            for _ in range(size):
                key, offset = self.at(offset)
                out[key], offset = self.at(offset)
            return out, offset
        if kind == ARRAY:
            items = []
            for _ in range(size):
                item, offset = self.at(offset)
                items.append(item)
            return items, offset
        if kind == BOOLEAN:
            return bool(size), offset
        raw, offset = self.data[offset : offset + size], offset + size
        if kind == STRING:
            return raw.decode(), offset
        if kind in (DOUBLE, FLOAT):
            return struct.unpack(">d" if kind == DOUBLE else ">f", raw)[0], offset
        if kind == BYTES:
            return raw, offset
        if kind == INT32:
            return int.from_bytes(raw.rjust(4, b"\0"), signed=True), offset
        if kind in (UINT16, UINT32, UINT64, UINT128):
            return int.from_bytes(raw), offset
        raise ValueError(f"unknown kind of value: {kind}")


class Database:
    def __init__(self, content: bytes):
        where = content.rfind(MARK)
        if where < 0:
            raise ValueError("not a database of address ranges")
        about, _ = Values(content[where + len(MARK) :]).at(0)
        self.nodes, self.width, self.bits = about["node_count"], about["record_size"], 128 if about["ip_version"] == 6 else 32
        if self.width not in (24, 28, 32):
            raise ValueError("records of 24, 28 or 32 bits are known")
        self.content, size = content, self.nodes * self.width // 4
        self.values = Values(content[size + 16 : where])

    def children(self, node: int) -> tuple[int, int]:
        at, bytes_ = node * self.width // 4, self.width // 4
        raw = self.content[at : at + bytes_]
        if self.width == 28:  # the middle byte holds the top four bits of both
            return (raw[3] >> 4) << 24 | int.from_bytes(raw[:3]), (raw[3] & 15) << 24 | int.from_bytes(raw[4:])
        half = bytes_ // 2
        return int.from_bytes(raw[:half]), int.from_bytes(raw[half:])

    def leaves(self) -> Iterator[tuple[int, int, object]]:
        """First address, length of the prefix and value, in order; IPv4 addresses as those of ::/96."""
        four = 0
        if self.bits == 128:
            for _ in range(96):
                if four >= self.nodes:
                    break
                four = self.children(four)[0]
        known: dict[int, object] = {}
        todo = [(0, 0, 0)]
        while todo:
            node, first, depth = todo.pop()
            if node == self.nodes or depth > 0 and self.bits == 128 and node == four < self.nodes and (first or depth != 96):
                continue  # nothing there, or another name for the IPv4 addresses
            if node > self.nodes:
                if node not in known and len(known) > 1 << 18:
                    known.clear()
                if node not in known:
                    known[node] = self.values.at(node - self.nodes - 16)[0]
                yield first, depth, known[node]
                continue
            left, right = self.children(node)
            todo += [(right, first | 1 << (self.bits - depth - 1), depth + 1), (left, first, depth + 1)]


def ranges(content: bytes) -> Iterator[tuple[str, str, str | None, int | None]]:
    """first, last (32 hexadecimal digits, IPv4 mapped into IPv6), country and number of the autonomous system."""
    base = Database(content)
    for first, depth, value in base.leaves():
        last = first + (1 << (base.bits - depth)) - 1
        if base.bits == 32 or last < 1 << 32:
            first, last = first + (0xFFFF << 32), last + (0xFFFF << 32)
        value = value if isinstance(value, dict) else {}
        country = (value.get("country") or value.get("registered_country") or {}).get("iso_code")
        number = value.get("autonomous_system_number")
        if country is not None or number is not None:
            yield f"{first:032x}", f"{last:032x}", country, number


def read_mmdb(spark: SparkSession, path: str) -> DataFrame:
    """first, last, geo_country, asn, source_sha256 of every range with a country or a number; the hash is that of the file."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("geo_country", pa.string()), ("asn", pa.int64()), ("source_sha256", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                data, rows = content.as_py(), []
                digest = hashlib.sha256(data).hexdigest()
                for row in ranges(data):
                    rows.append((*row, digest))
                    if len(rows) == 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, _RANGES)


def both(countries: DataFrame, systems: DataFrame) -> DataFrame:
    """One table of ranges from a database of countries and one of systems, for ``enrich_geo``: cut at the ends of both.

    Ranges of one table don't overlap, so at each border the last that began in each is the only one that can hold.
    """
    from pyspark.sql import Window

    ends = lambda t: t.select(F.col("first").alias("at")).unionByName(t.select(_next("last").alias("at")))
    marks = ends(countries).unionByName(ends(systems)).distinct()
    # the first digits deal the borders, so no task orders all; what began before a part is carried in
    four = "0" * 20 + "ffff"
    part = F.when(F.col("at") < four, "a").when(F.col("at").startswith(four), F.concat(F.lit("b"), F.substring("at", 25, 3))).otherwise(F.concat(F.lit("c"), F.substring("at", 1, 6)))
    told = lambda t, c, name: t.select(F.col("first").alias("at"), F.struct("last", F.col(c).alias("v")).alias(name))
    rows = marks.join(told(countries, "geo_country", "c"), "at", "left").join(told(systems, "asn", "s"), "at", "left").withColumn("part", part)
    inner, whole = Window.partitionBy("part").orderBy("at"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy("part").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("at"))).alias("c"), F.max_by("s", F.when(F.col("s").isNotNull(), F.col("at"))).alias("s"), F.min("at").alias("begin"))
    carried = lasts.select("part", F.last("c", True).over(whole).alias("c0"), F.last("s", True).over(whole).alias("s0"), F.lead("begin").over(Window.orderBy("part")).alias("begin"))
    held = rows.join(carried, "part").select("at", F.coalesce(F.last("c", True).over(inner), "c0").alias("c"), F.coalesce(F.last("s", True).over(inner), "s0").alias("s"), F.coalesce(F.lead("at").over(inner), "begin").alias("next"))
    valid = lambda x: F.when(F.col(f"{x}.last") >= F.col("at"), F.col(f"{x}.v"))
    out = held.filter("next IS NOT NULL").select(F.col("at").alias("first"), _before("next").alias("last"), valid("c").alias("geo_country"), valid("s").alias("asn"))
    return out.filter("geo_country IS NOT NULL OR asn IS NOT NULL")


def _half(text: F.Column, step: int) -> F.Column:
    """The number of 32 hexadecimal digits, one more or less; the halves carry into one another."""
    low, high = F.conv(F.substring(text, 17, 16), 16, 10).cast("decimal(20,0)"), F.conv(F.substring(text, 1, 16), 16, 10).cast("decimal(20,0)")
    most = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    turn = low == (most if step > 0 else F.lit(0).cast("decimal(20,0)"))
    new_low = F.when(turn, F.lit(0).cast("decimal(20,0)") if step > 0 else most).otherwise((low + step).cast("decimal(20,0)"))
    new_high = F.when(turn, (high + step).cast("decimal(20,0)")).otherwise(high)
    digits = lambda d: F.lpad(F.lower(F.conv(d.cast("string"), 10, 16)), 16, "0")
    return F.concat(digits(new_high), digits(new_low))


def _next(name: str) -> F.Column:
    return _half(F.col(name), 1)


def _before(name: str) -> F.Column:
    return _half(F.col(name), -1)
