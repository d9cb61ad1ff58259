"""Sharding by extendible hashing, in DataFrame functions only.

Every document has a 60-bit hash of its id. The directory is indexed by hash-prefix bits; a
bucket whose documents exceed the byte limit splits on its next bit, and only such buckets do,
until each fits. Bytes are summed per prefix of 16 bits first (with partial sums before the
shuffle); only prefixes that are still too large are summed again, 8 bits deeper at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_prefix

HASH_BITS, FIRST_BITS, MORE_BITS = 60, 16, 8
#: Directories of at most so many shards (about 60 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_SHARDS = 100_000


def key_hash(key: Column, text: Column) -> Column:
    """60 bits of md5 of the id; rows without an id are dealt by their text."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    """The first bits of a hash."""
    if isinstance(depth, int):
        return F.shiftright(h, HASH_BITS - depth)
    return F.expr(f"shiftright(_h, {HASH_BITS} - _depth)")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The shards of (_h, _bytes) rows: (depth, prefix, shard_bytes), prefix-free and covering all rows."""
    shards, low, high, left = [], 0, FIRST_BITS, sizes
    while True:
        fine = left.groupBy(_prefix(F.col("_h"), high).alias("_p")).agg(F.sum("_bytes").alias("_b"))
        levels = fine.select("_b", "_p", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.groupBy("depth", F.expr(f"shiftright(_p, {high} - depth)").alias("prefix")).agg(F.sum("_b").alias("shard_bytes"))
        levels = checkpoint(levels)
        over = levels.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_q"))
        last = high >= HASH_BITS
        fits = levels.where(F.col("shard_bytes") <= limit) if not last else levels.where((F.col("shard_bytes") <= limit) | (F.col("depth") == high))
        # A shard is a bucket that fits under one that doesn't; the first level stands alone.
        under = fits.join(over, (F.col("depth") == F.col("_d")) & (F.expr("shiftright(prefix, 1)") == F.col("_q")), "left_semi")
        shards.append(under if low else fits.where(F.col("depth") == 0).unionByName(under))
        open_ = over.where(F.col("_d") == high + 1).select(F.col("_q").alias("_open"))
        if last or open_.isEmpty():
            return reduce(DataFrame.unionByName, shards)
        left = left.join(open_, _prefix(F.col("_h"), high) == F.col("_open"), "left_semi")
        low, high = high, min(HASH_BITS, high + MORE_BITS)


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with shard_depth, shard_prefix, shard_bytes and shard_oversize.

    A shard is named by its depth and the first so many bits of the hash; its bytes are those of
    its texts in UTF-8 and at most limit, unless it is marked oversize: one document above the
    limit, or rows that share an id (rows without an id: a text) and together exceed it, which no
    further bit can part. A null text has 0 bytes and repeated rows count each time; an empty
    table gives no rows. All columns of docs are kept, but for those named like an added one,
    which is replaced.
    """
    named = ["shard_depth", "shard_prefix", "shard_bytes", "shard_oversize"]
    docs = docs.drop(*named)
    x = free_prefix(docs)
    key = key_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    sizes = checkpoint(docs.select(key.alias("_h"), size.alias("_bytes")).groupBy("_h").agg(F.sum("_bytes").alias("_bytes")))
    large = sizes.where(F.col("_bytes") > limit).select(F.lit(HASH_BITS).alias("depth"), F.col("_h").alias("prefix"), F.col("_bytes").alias("shard_bytes"), F.lit(True).alias("shard_oversize"))
    rows = sizes.where(F.col("_bytes") <= limit)
    found = checkpoint(directory(rows, limit).withColumn("shard_oversize", F.lit(False)).unionByName(large))
    shard_of = F.struct(F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), "shard_bytes", "shard_oversize")
    by_depth = {r["depth"]: r["count"] for r in found.groupBy("depth").count().collect()}  # at most HASH_BITS + 1 rows
    out = docs.withColumn(f"{x}h", key)
    # A document lies in one shard, but an oversize one also under another: the deepest is its own.
    depths = F.array(*[F.lit(int(d)) for d in sorted(by_depth)]).cast("array<int>")
    if sum(by_depth.values()) <= BROADCAST_SHARDS:
        # The directory is one small map, looked up at each depth that it has.
        entry = F.struct(F.concat_ws(":", "depth", "prefix").alias("at"), shard_of.alias("shard"))
        table = F.broadcast(found.agg(F.map_from_entries(F.collect_list(entry)).alias(f"{x}map")))
        at = lambda d: F.concat_ws(":", d, F.call_function("shiftright", F.col(f"{x}h"), F.lit(HASH_BITS) - d))
        hits = F.filter(F.transform(depths, lambda d: F.try_element_at(F.col(f"{x}map"), at(d))), lambda s: s.isNotNull())
        out = out.crossJoin(table).withColumn(f"{x}s", F.try_element_at(hits, F.lit(-1)))  # one row
    else:
        of = sizes.select("_h", F.explode(depths).alias("_depth")).withColumn("_p", F.expr(f"shiftright(_h, {HASH_BITS} - _depth)"))
        of = of.join(found, (F.col("_depth") == F.col("depth")) & (F.col("_p") == F.col("prefix")))
        of = of.groupBy(F.col("_h").alias(f"{x}k")).agg(F.max(shard_of).alias(f"{x}s"))
        out = out.join(of, F.col(f"{x}h") == F.col(f"{x}k"), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{x}s.{c}").alias(c) for c in named])
