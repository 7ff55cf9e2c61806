"""Sharding by jump consistent hashing, in column expressions only.

The hash is Lamping and Veach's: a 64-bit linear congruential walk whose jumps lengthen, so the
shard of a key follows from key and shard count alone, without a ring table, and one more shard
takes keys only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published walk: its multiplier 2862933555777941757 in 16-bit limbs, low first.
LIMBS = (45309, 34736, 12006, 10171)
#: Rows are numbered in BUCKETS x SLICES groups a shard, so no window holds a whole shard.
BUCKETS, SLICES = 512, 16
LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the walk on the two 32-bit halves of its state; no product exceeds 63 bits (ANSI mode would fail)."""
    c0, c1, c2, c3 = (F.lit(c).cast("long") for c in LIMBS)
    p1 = lo * c1
    low = lo * c0 + F.shiftleft(p1.bitwiseAND(LOW16), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + lo * c2 + F.shiftleft((lo * c3).bitwiseAND(LOW16), 16) + hi * c0 + F.shiftleft((hi * c1).bitwiseAND(LOW16), 16)
    return high.bitwiseAND(LOW32), low.bitwiseAND(LOW32)


def jump_walk(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards`, and among one more. A null key counts as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(LOW32).alias("lo"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("j"))

    def step(a: Column, _: Column) -> Column:
        hi, lo = _advance(a["hi"], a["lo"])
        jump = F.floor((a["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), F.when(a["j"] < shards, a["j"]).otherwise(a["shard"]).alias("shard"), a["j"].alias("grown"), jump.alias("j"))
        return F.when(a["j"] <= shards, moved).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda a: F.struct(a["shard"].cast("int").alias("shard"), a["grown"].cast("int").alias("grown")))


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, and size, text_crc32, law, shard, slot, grown_shard (clashing columns are replaced).

    Equal keys share a shard. `slot` numbers a shard's rows from 0 without gaps, by (bucket of the
    key, slice of the text, key, checksum, size); rows equal in all of these are interchangeable.
    Null key: as key 0, before it. Null text: size 1, checksum 0. An empty table gives no rows.
    Two shuffles: of the counts (at most shards x BUCKETS x SLICES rows, so their broadcast is
    bounded) and of the rows for numbering; the text is dropped before by column pruning where
    the caller does not select it.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    body, own = F.coalesce(F.col(text), F.lit("")), [c for c in docs.columns if c not in new]
    k = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    _, low = _advance(F.shiftrightunsigned(k, 32), k.bitwiseAND(LOW32))
    sized = docs.select(F.struct(*own).alias("row"), F.col(key).alias("key"), F.octet_length(body).cast("long").alias("n"), F.crc32(body.cast("binary")).alias("text_crc32"), jump_walk(F.col(key), shards).alias("w"), F.shiftright(low, 23).cast("int").alias("bucket"))
    placed = sized.select("row", "key", (F.col("n") + 1).alias("size"), "text_crc32", F.lit("key").alias("law"), "w.shard", F.col("w.grown").alias("grown_shard"), "bucket", (F.col("text_crc32") % SLICES).cast("int").alias("slice"))
    group = ["shard", "bucket", "slice"]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("shard").orderBy("bucket", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*group).orderBy(F.asc_nulls_first("key"), "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(within)).join(F.broadcast(offsets), group)
    return numbered.withColumn("slot", (F.col("offset") + F.col("nth") - 1).cast("long")).select(*[F.col("row")[c].alias(c) for c in own], *new)


def write_shards(docs: DataFrame, path: str, shards: int = 16, **names: str) -> None:
    """Write one folder a shard; `slot` is the order inside."""
    shard(docs, shards, **names).write.partitionBy("shard").parquet(path)


def op4_jump_sharding(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE = r"""
WITH RECURSIVE walk AS (
  SELECT DISTINCT coalesce(doc_id, 0) AS k, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::HUGEINT AS s, 0::BIGINT AS shard, 0::BIGINT AS grown, 0::BIGINT AS j
  FROM documents
  UNION ALL
  SELECT k, n AS s, CASE WHEN j < 16 THEN j ELSE shard END, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, ((s // 4294967296 * 2862933555777941757::HUGEINT % 4294967296 * 4294967296) + (s % 4294967296) * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS n FROM walk WHERE j <= 16)
), ended AS (SELECT k, shard, grown FROM walk WHERE j > 16),
crc_table AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) t(i)
), crc_list AS (SELECT list(v ORDER BY i) AS v FROM crc_table),
d AS (
  SELECT doc_id, coalesce(doc_id, 0) AS k, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c // 256, v[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_list
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ((k::HUGEINT + 18446744073709551616::HUGEINT) % 4294967296 * 2862933555777941757::HUGEINT + 1) % 4294967296 // 8388608, text_crc32 % 16, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  grown::INTEGER AS grown_shard
FROM d JOIN ended USING (k)
"""
