"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id and text. A source's mix holds its rows below a hash threshold,
so reruns agree. The threshold is found without sorting: sizes are summed by (source, leading
bits), the bucket in which the running sum passes the budget is found, and only that bucket's rows
are summed again by their next bits. What the budget then lacks, less than the next row, is offered
to the next FILL rows in turn: each that still fits is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, table, written

#: Bits of the hash, and of each level of the histogram.
BITS, LEVEL = 60, 15
#: Hashes of a source behind its threshold that are offered the rest of its budget.
FILL = 256
#: Weights of the sources in their order, repeating; the share of all words that the mix has; copies of a source at most.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2


def unit_hash(key: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of key and text (null: empty), with a line break between them."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size) with source_no and target: the mix's words, shared by weight, none above copies x source_size.

    Closed form of resharing the excess until none is above: in the order of cap / weight, the
    first sources are at their caps and the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weighed = totals.withColumn("source_no", F.row_number().over(order).cast("int")).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % n + 1).cast("int")))
    all_ = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") * copies / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    cap = (F.col("source_size") * copies).cast("double")
    level = (F.sum("source_size").over(all_) * share - copies * F.coalesce(F.sum("source_size").over(by_cap), F.lit(0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(by_cap), F.lit(0.0)))
    levelled = weighed.withColumn("level", level).withColumn("found", F.min(F.when(F.col("level") <= cap / F.col("w"), F.struct(cap / F.col("w"), "source_no", "level"))).over(all_)["level"])
    return levelled.select("source", "source_size", "source_no", F.round(F.least(cap, F.col("found") * F.col("w")), 6).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source_no, below, left): the rows of a source with hash < below fit its budget and leave `left` of it, less than the next hash's rows; null: all rows fit."""
    state = budgets.select("source_no", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"), F.lit(True).alias("open"))
    for done in range(LEVEL, BITS + 1, LEVEL):
        bucket = F.shiftright("hash", BITS - done)
        sums = (
            sized.join(state.filter("open").select("source_no", "prefix"), "source_no")
            .filter(F.shiftright(F.col("hash"), BITS - done + LEVEL) == F.col("prefix"))
            .groupBy("source_no", bucket.alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        running = Window.partitionBy("source_no").orderBy("bucket")
        passed = (
            sums.join(state, "source_no")
            .withColumn("upto", F.sum("n").over(running))
            .filter(F.col("upto") > F.col("left"))
            .groupBy("source_no")
            .agg(F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"))).alias("m"))
        )
        state = written(state.join(passed, "source_no", "left").select("source_no", F.coalesce("m.bucket", "prefix").alias("prefix"), F.coalesce("m.left", "left").alias("left"), F.col("m").isNotNull().alias("open")))
    return state.select("source_no", F.when(F.col("open"), F.col("prefix")).alias("below"), "left")


def filled(sized: DataFrame, limits_: DataFrame) -> DataFrame:
    """(source_no, extra): hashes at or behind the threshold that are taken too: of the next FILL, in order, each whose rows fit what is left.

    Rows of one hash are summed before they are ranked, and each task ranks FILL of a source at most.
    """
    behind = sized.filter("size > 0").join(limits_.filter("below IS NOT NULL AND left > 0"), "source_no").filter("hash >= below")
    summed = behind.groupBy("source_no", "hash", "left").agg(F.sum("size").alias("n"))
    nth = F.row_number().over(Window.partitionBy("source_no").orderBy("hash"))
    offered = summed.withColumn("nth", nth).filter(F.col("nth") <= FILL).groupBy("source_no", "left").agg(F.sort_array(F.collect_list(F.struct("hash", "n"))).alias("next"))
    start = F.struct(F.col("left"), F.array().cast("array<long>").alias("extra"))

    def offer(a: Column, x: Column) -> Column:
        fits = x["n"] <= a["left"]
        return F.struct(F.when(fits, a["left"] - x["n"]).otherwise(a["left"]).alias("left"), F.when(fits, F.array_append(a["extra"], x["hash"])).otherwise(a["extra"]).alias("extra"))

    return offered.select("source_no", F.aggregate("next", start, offer)["extra"].alias("extra"))


def limits(docs: DataFrame, key: str, text: str, source: str, weights, share: float, copies: int) -> tuple[DataFrame, DataFrame]:
    """All rows as (_key, source, hash, size), and per source (as _s) its size, target, whole times and threshold."""
    rows = written(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), unit_hash(F.col(key), F.col(text)).alias("hash"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size")))
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies).withColumn("times", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")).withColumn("budget", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long")))
    numbered = rows.join(targets.select(F.col("source").alias("_s"), "source_no"), F.col("source").eqNullSafe(F.col("_s"))).select("source_no", "hash", "size")
    cut = written(thresholds(numbered, targets))
    found = targets.join(cut, "source_no").join(filled(numbered, cut), "source_no", "left")
    return rows, written(found.withColumnRenamed("source", "_s"))


def copies_taken(hash_: Column, copies: int) -> Column:
    """How often the mix takes a row, given the columns of limits()."""
    more = F.coalesce((hash_ <= F.array_max("extra")) & F.array_contains("extra", hash_), F.lit(False))
    once = (F.col("below").isNull() | (hash_ < F.col("below")) | more) & (F.col("budget") > 0)
    return F.least(F.lit(copies).cast("long"), F.col("times") + once.cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(key, source, size, source_size, target, taken) of every row: how many words of it the mix takes.

    taken is a multiple of size, at most copies x size: a source whose target exceeds its words
    is taken whole as often as fits, and the rest of the target is filled by the threshold and by rows
    behind it that still fit. Rows equal in id and text go together; a source falls short of its target by less than
    the least of the FILL rows behind the threshold that are not taken. Null text: size 0. A null source is a source of its own, the last. An empty table gives no rows.
    Texts are read once; all later passes are over (key, source, hash, size).
    """
    rows, per_source = limits(docs, key, text, source, weights, share, copies)
    taken = F.col("size") * copies_taken(F.col("hash"), copies)
    return rows.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("_key").alias(key), "source", "hash", "size", "source_size", "target", taken.alias("taken"))


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """The rows of docs, with their columns, as often as the mix takes them; rows without words are left out.

    The join is with one row a source; Spark broadcasts it if it is small, and else shuffles.
    """
    _, per_source = limits(docs, key, text, source, weights, share, copies)
    here = docs.select(F.struct("*").alias("_row"), F.col(source).alias("source"), unit_hash(F.col(key), F.col(text)).alias("hash"), F.coalesce(F.col(text).rlike(WORDS), F.lit(False)).alias("_any"))
    times = F.when(F.col("_any"), copies_taken(F.col("hash"), copies)).otherwise(0).cast("int")
    return here.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source
), w AS (SELECT *, [3.0, 1.0, 2.0][(no - 1) % 3 + 1]::DOUBLE AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER o, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size * 2 / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT level FROM l WHERE level <= source_size * 2 / w ORDER BY source_size * 2 / w, no LIMIT 1),
t AS (SELECT no, source, source_size, round(least(source_size * 2.0::DOUBLE, f.level * w), 6) AS target FROM l, f),
b AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS times FROM t),
r AS (
  SELECT d.*, no, source_size, target, times, floor(target - times * source_size)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY no ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), g AS (
  SELECT no, h, sum(size)::BIGINT AS n, any_value(budget) - coalesce(any_value(fit), 0) AS rest, row_number() OVER (PARTITION BY no ORDER BY h) AS nth
  FROM r LEFT JOIN (SELECT no, max(upto) AS fit FROM r WHERE upto <= budget GROUP BY no) USING (no)
  WHERE upto > budget AND size > 0 GROUP BY no, h
), fill AS (
  SELECT no, h, nth, n <= rest AS yes, (rest - CASE WHEN n <= rest THEN n ELSE 0 END)::BIGINT AS rest FROM g WHERE nth = 1 AND rest > 0
  UNION ALL
  SELECT g.no, g.h, g.nth, g.n <= fill.rest, (fill.rest - CASE WHEN g.n <= fill.rest THEN g.n ELSE 0 END)::BIGINT
  FROM fill JOIN g ON g.no = fill.no AND g.nth = fill.nth + 1 AND g.nth <= 256
)
SELECT doc_id, size, source_size, target,
  (size * least(2, times + CASE WHEN budget > 0 AND (upto <= budget OR coalesce(yes, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN fill ON fill.no = r.no AND fill.h = r.h
"""
