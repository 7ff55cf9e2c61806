"""Exact removal of repeated byte strings by distributed prefix doubling over few positions.

Prefix doubling names the prefixes of all positions at growing lengths and drops a position once its
name is unique. Three facts keep the shuffled positions few:

- Start positions whose 200-byte window has its least 64-byte hash at one place form a segment, and
  equal windows have equal least hashes at equal offsets. A segment is named by those 64 bytes
  first; if that name is unique, all its positions drop out.
- Segments are named next by all bytes that their windows cover. Where that name repeats, all their
  windows do, and one segment stands for the others from there on.
- Only segments whose first name repeats under several second names are taken apart, into four
  parts by how far their windows start before the 64 bytes. The windows of a part share 166 bytes,
  which name it, and it drops out if that name is unique. The positions left over are named by 100
  bytes, dropped if unique, then by the pair of names at offsets 0 and 100.

Names are hashes in place of dense ranks, as only equality matters; what decides is 96 bits long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .substring import LAST

#: Length that counts as repeated; bytes of the first name; windows of them in one length; half of the length.
LENGTH, SEED = 200, 64
WIDTH, HALF = LENGTH - SEED + 1, LENGTH // 2
#: Parts of a segment's windows, by how far they start before the 64 bytes; offsets of a part; bytes that a part's windows share.
PARTS, STEP = 4, 35
SHARED = LENGTH - STEP + 1


def segments(data: np.ndarray, at: np.ndarray, rolling: C.Rolling) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, place of the least hash, first name) of every segment, in the chunk."""
    starts_of = np.maximum(np.diff(at) - LENGTH + 1, 0)
    none = np.empty(0, np.int64)
    if not starts_of.any():
        return none, none, none, none, np.empty(0, np.uint64)
    seeds = rolling.windows(SEED)
    bits = np.uint64(max(1, int(len(seeds)).bit_length()))
    least = (seeds >> bits << bits) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while width * 2 <= WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (WIDTH - width)], least[WIDTH - width :])
    doc = np.repeat(np.arange(len(at) - 1), starts_of)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of) + at[doc]
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.diff(np.append(first, len(start))), place[first], seeds[place[first]]


def _named(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            rolling = C.Rolling(C.BYTE_SYMBOLS[data])
            doc, lo, n, place, seed = segments(data, at, rolling)
            whole = C.digests(data.tobytes(), lo, lo + n + LENGTH - 1).view(np.uint64)
            whole, whole2 = whole[:, 0].copy(), whole[:, 1].copy()
            ids, tags = (b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False)[doc] for c in ("id", "tag"))
            # equal segments of the chunk: the first stands for all, the others are known to repeat and go anywhere
            order = np.lexsort((whole2, whole, seed))
            new = np.ones(len(order), bool)
            new[1:] = (whole[order][1:] != whole[order][:-1]) | (whole2[order][1:] != whole2[order][:-1]) | (seed[order][1:] != seed[order][:-1])
            stands = np.zeros(len(order), np.int32)
            stands[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
            seed = np.where(stands > 0, seed, C.mixed(whole + np.arange(len(order), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed.view(np.int64), whole.view(np.int64), whole2.astype(np.uint32).view(np.int32), ids, tags, mark(lo - at[doc], n, place - lo), stands)], ["seed", "whole", "whole2", "id", "tag", "mark", "stands"])


def mark(lo: np.ndarray, n: np.ndarray, to_place: np.ndarray) -> np.ndarray:
    """A segment as one number, in the order of lo."""
    return lo << 18 | n << 9 | to_place


def _marks(b: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, mark) of rows i to j."""
    lists = b.column("marks").slice(i, j - i)
    count = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(j - i), count), flat


def _parts(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            doc, marks = _marks(b, i, j)
            far, n = marks & 511, (marks >> 9) & 511
            place, rolling = at[doc] + (marks >> 18) + far, C.Rolling(C.BYTE_SYMBOLS[data], 3)
            for part in range(PARTS):
                begin = place - part * STEP
                ok = np.flatnonzero((begin >= at[doc]) & (begin + SHARED <= at[doc + 1]) & (far >= part * STEP) & (far - n + 1 < (part + 1) * STEP))
                ids, tags = (b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False)[doc[ok]] for c in ("id", "tag"))
                name = C.mixed(rolling.slices(begin[ok], begin[ok] + SHARED) + np.uint64(part))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), ids, tags, marks[ok] * PARTS + part)], ["name", "id", "tag", "mark"])


def _positions(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            doc, marks = _marks(b, i, j)
            part, marks = marks % PARTS, marks // PARTS
            lo, n, place = marks >> 18, (marks >> 9) & 511, (marks >> 18) + (marks & 511)
            begin, end = np.maximum(lo, place - (part + 1) * STEP + 1), np.minimum(lo + n, place - part * STEP + 1)
            n = np.maximum(end - begin, 0)
            doc, pos = np.repeat(doc, n), np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, rolling = at[doc] + pos, C.Rolling(C.BYTE_SYMBOLS[data], 2)
            full = C.digests(data.tobytes(), start, start + LENGTH)
            names = rolling.slices(start, start + HALF).view(np.int64), full[:, 0].copy(), full[:, 1].astype(np.uint32).view(np.int32)
            ids, tags = (b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False)[doc] for c in ("id", "tag"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, ids, tags, pos.astype(np.int32))], ["a", "b", "b2", "id", "tag", "pos"])


def _removed(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            doc, marks = _marks(b, i, j)
            lo, n = marks >> 18, (marks >> 9) & 511
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, at[doc] + lo, 1)
            np.add.at(change, at[doc] + lo + n + LENGTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edge = at[1:-1][at[1:-1] < len(data)]
            first[edge] = gone[edge]
            sums = np.zeros((2, len(data) + 1), np.int64)
            np.cumsum(gone, out=sums[0, 1:])
            np.cumsum(first, out=sums[1, 1:])
            per = sums[:, at[1:]] - sums[:, at[:-1]]
            kept = [hashlib.sha256((data[s:e][~gone[s:e]] if k else data[s:e]).tobytes()).hexdigest() for s, e, k in zip(at[:-1].tolist(), at[1:].tolist(), per[0].tolist(), strict=True)]
            spans_at = np.flatnonzero(first)
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            last[edge - 1] = gone[edge - 1]
            spans_end = np.flatnonzero(last) + 1
            owner = np.searchsorted(at, spans_at, "right") - 1
            bounds = pa.array((np.stack([spans_at, spans_end], 1) - at[owner][:, None]).ravel())
            offsets = np.concatenate([[0], np.cumsum(2 * per[1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.array(per[0]), pa.array(per[1]), pa.array(kept), pa.ListArray.from_arrays(offsets, bounds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    A byte goes if a LENGTH-byte string over it also starts elsewhere, in the same text or another;
    strings are judged on the input and never cross texts. spans: start and end of the removed runs.
    Null and shorter texts lose nothing; rows that repeat in full lose all. Ids are only names: they
    may be null or repeat. An empty table gives no rows; other columns are not looked at. Shuffled:
    one row for about 69 bytes, by first name (equal segments met in one task count as one); the parts and then the positions of segments taken
    apart; the marks of each text; and the texts once, as all three reads use the same exchange.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    named = rows.select("id", "tag", "text").mapInArrow(_named, "seed long, whole long, whole2 int, id long, tag long, mark long, stands int")
    seed, whole = Window.partitionBy("seed"), Window.partitionBy("seed", "whole", "whole2")
    judged = (
        named.withColumns({"least": F.min(F.struct("whole", "whole2")).over(seed), "most": F.max(F.struct("whole", "whole2")).over(seed), "same": F.sum("stands").over(seed)})
        .filter("same <> 1")
        .withColumns({"equal": F.sum("stands").over(whole), "nth": F.row_number().over(whole.orderBy("id", "tag", "mark"))})
        .withColumns({"repeats": F.col("equal") != 1, "open": (F.col("least") != F.col("most")) & (F.col("nth") == 1)})
        .filter("repeats or open")
    )
    judged = C.written(judged.select("id", "tag", "mark", "repeats", "open"))
    texts = rows.select("doc_id", "id", "tag", "text")

    def with_text(marks: DataFrame) -> DataFrame:
        return texts.join(marks.groupBy("id", "tag").agg(F.collect_set("mark").alias("marks")), ["id", "tag"]).select("doc_id", "id", "tag", "text", "marks")  # doc_id stays, so that the exchange is the one that the last join reads

    parts = with_text(judged.filter("open")).mapInArrow(_parts, "name long, id long, tag long, mark long")
    apart = parts.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("k > 1").select("id", "tag", "mark")
    positions = with_text(apart).mapInArrow(_positions, "a long, b long, b2 int, id long, tag long, pos int")
    short, full = Window.partitionBy("a"), Window.partitionBy("a", "b", "b2")
    doubled = positions.withColumn("k", F.count(F.lit(1)).over(short)).filter("k > 1").withColumn("k", F.count(F.lit(1)).over(full)).filter("k > 1")
    gone = judged.filter("repeats").select("id", "tag", "mark").union(doubled.select("id", "tag", F.expr("shiftleft(cast(pos as bigint), 18) + 512").alias("mark"))).groupBy("id", "tag").agg(F.collect_set("mark").alias("marks"))
    return texts.join(gone, ["id", "tag"], "left").select("doc_id", "text", "marks").mapInArrow(_removed, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op2_suffix_dedup(spark, sf_dir):
    return repeated_bytes(C.table(spark, sf_dir, "documents")).drop("spans")
