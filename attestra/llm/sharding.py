"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits.  The directory is indexed by prefixes of
these bits; a bucket is the shortest prefix whose rows fit the byte limit, so
only oversized buckets are split on another bit.  All depths of one pass are
counted from one histogram; only rows of buckets that are oversized at the
pass's last bit go on to the next pass.

* A row larger than the limit is a shard of its own (depth 60).
* Rows whose whole hash is equal and exceeds the limit (one hot key) are
  hashed again by their place in the stored key table, and marked ``spread``.

The key table is written once to the shared folder and read from there, so
every pass sees the same rows and a lost executor changes nothing.  It holds
keys and sizes, never the texts.

Defined results: null texts have 0 bytes; null keys hash as the empty string;
repeated rows are separate rows; an empty table has no shards; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

BITS = 60
SHARD_BYTES = 1 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 digest."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a hash."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _directory(rest: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each prefix of ``high`` bits its bucket: the shortest prefix of at
    least ``low`` bits that fits; depth is null if none does."""
    histogram = stored(rest.groupBy(prefix(F.col("h"), high).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("r")), "histogram")
    levels = histogram.select("p", "b", "r", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.call_function("shiftright", "p", (F.lit(high) - F.col("depth")).cast("int")))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows")).where(F.col("shard_bytes") <= limit)
    fits = levels.select("p", "depth", "prefix").join(buckets, ["depth", "prefix"]).groupBy("p").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s"))
    return stored(histogram.select("p").join(fits, "p", "left").select("p", "s.*"), "directory")


def shards(rows: DataFrame, key_col: str, text_col: str, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: key, n_bytes, depth and prefix of its shard, the
    shard's bytes and rows, and whether its key had to be spread."""
    keys = rows.select(F.col(f"`{key_col}`").alias("key"), F.monotonically_increasing_id().alias("place"), _size(text_col))
    return _placed(keys, limit).drop("place", "own").withColumnRenamed("key", key_col)


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes")


def _placed(keys: DataFrame, limit: int) -> DataFrame:
    """The shard of each row of keys (key, place, n_bytes).  A row over the limit
    is a shard of its own, which depth and prefix do not name: ``own`` holds its
    place, and is null for all others."""
    keys = stored(keys.withColumn("h", hash_bits(F.col("key"))), "keys")
    own = F.col("n_bytes") > limit
    columns = ["key", "place", "own", "n_bytes", "depth", "prefix", "shard_bytes", "shard_rows", "spread"]
    keys = keys.withColumn("own", F.when(own, F.col("place")))
    parts = [keys.where(own).select("key", "place", "own", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows"), F.lit(False).alias("spread"))]
    rest, spread = keys.where(~own), False
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    while True:
        found = _directory(rest, low, high, limit)
        at = prefix(F.col("h"), high) == F.col("p")
        leaves = found.where("depth is not null")
        parts.append(rest.join(leaves, at).withColumn("spread", F.lit(spread)).select(*columns))
        over = found.where("depth is null").select("p")
        if over.isEmpty():
            break
        rest = stored(rest.join(over, at, "left_semi"), "rest")
        if high == BITS:
            if spread:
                raise ValueError("rows of different places hash alike at full depth")
            rest, spread = stored(rest.withColumn("h", hash_bits(F.concat_ws(":", "key", "place"))), "spread"), True
            total = rest.agg(F.sum("n_bytes")).first()[0]
            low, high = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + 3)
        else:
            low, high = high + 1, min(BITS, high + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("depth", F.col("depth").cast("int"))


def write_shards(rows: DataFrame, key_col: str, text_col: str, path: str, limit: int = SHARD_BYTES) -> None:
    """Write ``rows`` with one folder for each shard.  Rows are stored with their
    places first, so keys may repeat or be null."""
    place = fresh(rows, "row_place")
    held = stored(rows.withColumn(place, F.monotonically_increasing_id()), "rows")
    placed = _placed(held.select(F.col(f"`{key_col}`").alias("key"), F.col(place).alias("place"), _size(text_col)), limit)
    name = F.concat_ws("-", F.lpad("depth", 2, "0"), F.hex("prefix"), F.when(F.col("spread"), F.lit("s")), F.hex("own"))
    shard = fresh(rows, "shard")
    placed = placed.select(F.col("place").alias(place), name.alias(shard))
    held.join(placed, place).drop(place).repartition(shard).write.partitionBy(shard).parquet(path)


ORACLE = f"""
WITH k AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
rest AS (SELECT * FROM k WHERE n_bytes <= {SHARD_BYTES}),
levels AS (SELECT depth::INTEGER AS depth, h >> ({BITS} - depth::INTEGER) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
           FROM rest, range(0, 41) AS r(depth) GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES}),
placed AS (SELECT rest.doc_id, rest.n_bytes, l.*, row_number() OVER (PARTITION BY rest.doc_id ORDER BY l.depth) AS nth
           FROM rest JOIN levels l ON l.prefix = rest.h >> ({BITS} - l.depth))
SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_rows, false AS spread FROM placed WHERE nth = 1
UNION ALL SELECT doc_id, n_bytes, {BITS}::INTEGER, h, n_bytes, 1::BIGINT, false FROM k WHERE n_bytes > {SHARD_BYTES}
"""
