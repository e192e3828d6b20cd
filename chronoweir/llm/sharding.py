"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts. Groups by decreasing size each enter the bin with the least remaining room that holds them; the bins stand in a balanced tree by remaining room. Packing works on counts: a group's size is rounded up to a class (exact up to 4096 bytes, then to a relative 1/1024), so the sorted groups are a list of (class, number), which has at most 4096 + 1024 rows for each doubling of the largest size (under 40,000 for groups up to 2**47 bytes) whatever the number of documents; only that list comes to the driver. A run of equal groups goes to one bin as long as that bin takes them, which is what best fit does with equal items. Each (class, run of ranks) has a bin; documents find their own by the rank of their group in its class, given in two levels (salted counts, then ranks in a salt), so no class or bin is ever in one task.

pack() with a capacity opens as few bins as best fit finds; into_shards() has the number of bins and seeks the least capacity that they suffice for, which makes their sizes near equal (law `bytes`). Groups are never split: one that is larger than a shard's share of what is left has a shard for itself, and the other shards are near equal without it.

Cases: null ids: rows like others, last in their shard. Null text: size 1, checksum 0, and all nulls are one group, another than that of empty texts (size 1 too). Repeated rows are rows like others. Equal sizes: ranks go by hash. Empty table: empty result. Only doc_id and text are read; other columns don't matter.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS = 16
SALT_BITS = 10


class Bins:
    """Bins by (remaining room, number) in a treap with priorities from the number: insertion, removal and search take logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Bins._merge(a[3], b)
            return a
        b[2] = Bins._merge(a, b[2])
        return b

    @staticmethod
    def _cut(node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = Bins._cut(node[3], key)
            return node, right
        left, node[2] = Bins._cut(node[2], key)
        return left, node

    def add(self, room: int, number: int) -> None:
        left, right = self._cut(self.root, (room, number))
        self.root = self._merge(self._merge(left, [(room, number), zlib.crc32(str(number).encode()), None, None]), right)

    def take(self, size: int):
        """Removes and gives (room, number) of the bin with the least room >= size, None if there is none."""
        left, right = self._cut(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        first = right
        while first[2] is not None:
            first = first[2]
        key = first[0]
        _, right = self._cut(right, (key[0], key[1] + 1))
        self.root = self._merge(left, right)
        return key


def pack(counts: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best fit for (size, number of groups), sizes decreasing: rows (size, first rank, last rank + 1, bin), or None if over `most` bins are needed. A size above the capacity is an error."""
    bins, rows, opened = Bins(), [], 0
    for size, n in counts:
        if size > capacity:
            if most is None:
                raise ValueError(f"a group of {size} bytes exceeds the capacity of {capacity}")
            return None
        done = 0
        while done < n:
            found = bins.take(size)
            if found is None:
                if opened == most:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, number = found
            k = min(n - done, room // size)
            rows.append((size, done, done + k, number))
            done += k
            bins.add(room - k * size, number)
    return rows


def into_shards(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """pack() into so many bins: groups larger than an equal share of what is left get bins of their own, the others the least capacity (to a millionth) for which the rest of the bins suffice."""
    left = sorted(counts, reverse=True)
    total, alone, first = sum(s * n for s, n in left), [], {}
    while left and len(alone) < shards - 1 and left[0][0] * (shards - len(alone)) > total:
        size, n = left.pop(0)
        alone.append((size, first.get(size, 0), first.get(size, 0) + 1, len(alone)))
        first[size], total = first.get(size, 0) + 1, total - size
        if n > 1:
            left.insert(0, (size, n - 1))
    if not left:
        return alone
    bins = shards - len(alone)
    low = max(left[0][0], -(-total // bins))
    high = low * 2
    while pack(left, high, bins) is None:
        high *= 2
    while high - low > max(0, total // bins // 1_000_000):
        mid = (low + high) // 2
        low, high = (low, mid) if pack(left, mid, bins) is not None else (mid + 1, high)
    return alone + [(size, a + first.get(size, 0), z + first.get(size, 0), number + len(alone)) for size, a, z, number in pack(left, high, bins)]


def rounded(size):
    """Sizes up to 4096 as they are; larger ones up to a multiple of a power of two that is under 1/1024 of them."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(size)) - 12, F.lit(0)))
    return (F.ceil(size / step) * step).cast("long")


def ranked(rows: DataFrame, group: str, by: list, salt: str, name: str) -> DataFrame:
    """rows with `name`: ranks from 0 without gaps in each `group`, in an order that starts with `salt`."""
    counts = rows.groupBy(group, salt).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, salt, before.alias("_before"))
    inner = Window.partitionBy(group, salt).orderBy(*by)
    return rows.join(counts, [group, salt]).withColumn(name, (F.col("_before") + F.row_number().over(inner) - 1).cast("long")).drop("_before")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digest = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2("text", 256)))
    slim = common.stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("_group")), "shard-sizes")
    groups = slim.groupBy("_group").agg(rounded(F.sum("size")).alias("_class")).withColumn("_salt", F.pmod(F.xxhash64("_group"), F.lit(1 << SALT_BITS)))
    groups = common.stored(groups, "shard-groups")
    counts = [(r["_class"], r["count"]) for r in groups.groupBy("_class").count().collect()]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_size", "_first", "_last", "shard")])
    # bounded as the list of classes is
    runs = F.broadcast(spark.createDataFrame(into_shards(counts, shards), schema))
    placed = ranked(groups, "_class", ["_group"], "_salt", "_rank").join(runs, (F.col("_class") == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    placed = common.stored(placed.select("_group", F.col("shard").cast("int").alias("shard")), "shard-places")
    return slim.join(placed, "_group").select("doc_id", "size", "text_crc32", "shard")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard by law `bytes` and its place in the shard."""
    rows = common.stored(shard(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "shards")
    rows = ranked(rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(256))), "shard", [F.col("doc_id").asc_nulls_last(), "text_crc32"], "_salt", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
