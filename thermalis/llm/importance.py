"""Target-distribution importance resampling with array scores and distributed radix selection.

Every run of words is a feature, and a feature's bucket is its CRC-32 modulo the number of buckets.
The gain of a bucket is the log ratio of its share in the target and in the documents, a document's
weight the mean gain of its features. Gumbel noise drawn from the document's id makes "the highest
scores" a sample without replacement. Which score is the last that is drawn is found digit by digit:
rows are counted by the next digit of their key, and only the rows of one digit go on. Only drawn
rows are sorted, by ranges.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import WORD

#: Words of a feature at most; buckets; per cent of the documents drawn; the word of the noise; words that a drawn document has at least.
RUNS, BUCKETS, PERCENT, SEED, LEAST = 1, 10_000, 10, "2024", 20
#: Bits of a digit; a round counts rows in 2**DIGIT classes at most.
DIGIT = 16


def feature_buckets(data: np.ndarray, at: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of some texts, text by text, and where each text's begin (and the end)."""
    data = C.LOWER[data]
    starts, ends, first = C.word_bounds(WORD[data], at)
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = coded.indices.to_numpy()[::2]
    kinds = coded.dictionary.to_pylist()
    single = np.array([zlib.crc32(k) for k in kinds], np.int64)[which] % buckets
    if runs == 1:
        return single, first
    # longer runs: the checksum of "a b" goes on from that of "a"
    found, doc, last = [single], [np.repeat(np.arange(len(at) - 1), np.diff(first))], np.repeat(first[1:], np.diff(first))
    known: dict[tuple[int, ...], int] = {}
    words = which.tolist()
    for n in range(2, runs + 1):
        begin = np.flatnonzero(np.arange(len(words)) + n <= last)
        out = np.empty(len(begin), np.int64)
        for i, s in enumerate(begin.tolist()):
            run = tuple(words[s : s + n])
            if run not in known:
                known[run] = zlib.crc32(b" ".join([kinds[w] for w in run])) % buckets
            out[i] = known[run]
        found.append(out)
        doc.append(doc[0][begin])
    order = np.argsort(np.concatenate(doc), kind="stable")
    ends = np.bincount(np.concatenate(doc), minlength=len(at) - 1).cumsum()
    return np.concatenate(found)[order], np.append(0, ends)


def bucket_counts(docs: DataFrame, text: str, runs: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: each task counts in one array, and what comes to the driver is one number a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, at in C.chunks(b.column(0)):
                total += np.bincount(feature_buckets(data, at, runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the documents)) of every bucket, one feature more in each."""
    k, s, t = len(docs), docs.astype(np.float64) + 1, target.astype(np.float64) + 1
    return np.floor(1000 * np.log(t * float(docs.sum() + k) / (s * float(target.sum() + k)))).astype(np.int64)


def scored(docs: DataFrame, gains: np.ndarray, runs: int, seed: str, key: str, text: str) -> DataFrame:
    """(row, doc_id, n_features, weight, score, n_words) of every row, written; `row` numbers the rows."""
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches):
        for b in batches:
            for i, j, data, at in C.chunks(b.column("text")):
                bucket, first = feature_buckets(data, at, runs, len(gains))
                sums = np.append(0, np.cumsum(gains[bucket]))
                n = np.diff(first)
                # of n words there are n, n - 1, ... runs; the words alone are asked for
                words = n if runs == 1 else np.diff(C.word_bounds(WORD[data], at)[2])
                weight = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(weight), pa.array(words)], ["doc_id", "n_features", "weight", "n_words"])

    weighed = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(weigh, f"doc_id {kind}, n_features long, weight long, n_words long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return C.written(weighed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), "n_words"))


def _order(table: DataFrame) -> list[Column]:
    """The order of drawing as longs that ascend: score falling, id rising (null first; of what is no number, a hash), and the number of the row.

    Rows that agree in score and id are interchangeable but for n_features; the row's number parts them.
    """
    kind = table.schema["doc_id"].dataType.simpleString()
    number = F.col("doc_id").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("doc_id")
    return [-F.col("score"), F.coalesce(number, F.lit(-(2**63)).cast("long")), F.col("row")]


def select_least(table: DataFrame, keys: list[Column], k: int, digit: int = DIGIT) -> list[tuple[int, int]]:
    """The k-th least row's key (k >= 1), as (value, digits still open) of each long in turn; keys must be unique.

    A row is among the k least if its key, with the open digits dropped, is not above this. Each round
    counts rows by one digit, so that at most 2**digit numbers reach the driver, and only rows whose digits before
    agree are counted in the next one; it ends as soon as a digit's rows are wanted whole.
    """
    found: list[tuple[int, int]] = []
    for key in keys:
        table, width, prefix = table.withColumn("_k", key), 64, 0
        while width:
            width -= digit
            # the first digit is signed
            counts = table.groupBy(F.shiftright("_k", width).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
            for r in sorted(counts, key=lambda r: r["d"]):
                if k <= r["n"]:
                    prefix, whole = r["d"], k == r["n"]
                    break
                k -= r["n"]
            table = table.filter(F.shiftright("_k", width) == prefix)
            if whole:
                return [*found, (prefix, width)]
        found.append((prefix, 0))
    return found


def _not_above(keys: list[Column], last: list[tuple[int, int]]) -> Column:
    """True for rows whose key, cut where `last` is, is at most `last`."""
    out = F.lit(True)
    for key, (value, width) in reversed(list(zip(keys, last, strict=False))):
        cut = F.shiftright(key, width)
        out = (cut < value) | ((cut == value) & out)
    return out


def ranked(table: DataFrame, keys: list[Column]) -> DataFrame:
    """table with `rank` from 1 in the order of keys: dealt by ranges, sorted there, numbered by what the ranges before hold."""
    cols = [f"_k{i}" for i in range(len(keys))]
    keyed = table.withColumns(dict(zip(cols, keys, strict=True))).repartitionByRange(*cols).sortWithinPartitions(*cols)
    # the id holds the number of the range above bit 33 and the place in it below; written, it stays
    placed = C.written(keyed.withColumn("_at", F.monotonically_increasing_id()).drop(*cols))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT, seed: str = SEED, least: int = LEAST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where the row is not drawn.

    Drawn are percent of the rows with `least` words or more, the highest scores, ties to the smaller
    id; of rows that agree in score and id any. A null or empty text has no features and weight 0; a
    null id counts as empty text in the noise and comes before all others; rows that repeat stand for
    themselves; with an empty target all its shares are equal; an empty table gives no rows. Ids that are not
    integers are ordered by a hash where scores tie. Other columns, whatever their names, are not looked at.
    Texts are read twice and never shuffled; later passes are over a line of numbers a row.
    """
    gains = bucket_gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    rows = scored(docs, gains, runs, seed, key, text)
    long_enough = rows.filter(F.col("n_words") >= least)
    k, keys = long_enough.count() * percent // 100, _order(rows)
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns, undrawn)
    drawn = (F.col("n_words") >= least) & _not_above(keys, select_least(long_enough, keys, k))
    return ranked(rows.filter(drawn), keys).select(*columns, "rank").unionByName(rows.filter(~drawn).select(*columns, undrawn))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs whose ids are drawn, with their columns; for tables whose ids are unique and not null."""
    ids = resample(docs, target, key, text, **settings).filter("rank IS NOT NULL").select(F.col("doc_id").alias(key))
    return docs.join(ids, key, "left_semi")


def op13_importance(spark, sf_dir):
    return resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH crc_table AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) t(i)
), crc_list AS (SELECT list(v ORDER BY i) AS v FROM crc_table),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents
), dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
kinds AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c // 256, v[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), crc_list
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN kinds USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN kinds USING (w) GROUP BY bucket),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN kinds USING (w) JOIN gains USING (bucket) GROUP BY r),
scores AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scores LEFT JOIN drawn USING (r)
"""
