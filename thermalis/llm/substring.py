"""Removal of repeated word passages with difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two positions some shift below PERIOD brings
both onto cover positions. So if two documents share a window of WINDOW words, they share a short
hash of WINDOW - PERIOD + 1 words that starts at cover positions in both, inside the window. Only
those positions are hashed and shuffled; where an anchor occurs in two documents, it extends to the
windows around it, and these decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
#: A perfect difference set: every residue mod 31 is a difference of two of the six.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: A null id counts as the largest.
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, id, tag, text): id is the key as long with nulls last; id and tag name a row, rows equal in both being copies."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))


def word_symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of all texts, and the first word of each text (and the end)."""
    starts, ends, first = C.word_bounds(~C.SPACE[data], at)
    return C.word_hashes(data, starts, ends), starts, ends, first


def _column(b: pa.RecordBatch, name: str, i: int, j: int) -> np.ndarray:
    return b.column(name).slice(i, j - i).to_numpy(zero_copy_only=False)


def _met(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row: least and greatest id among the rows of its keys here, and whether it is the first of its keys, or of those with the greatest id."""
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(order) + 1, bool)
    new[0] = new[-1] = True
    for k in keys:
        new[1:-1] |= k[order][1:] != k[order][:-1]
    bounds = np.flatnonzero(new)
    size = np.diff(bounds)
    low, high, ends = (np.empty(len(order), t) for t in (np.int64, np.int64, bool))
    low[order], high[order] = np.repeat(ids[order[bounds[:-1]]], size), np.repeat(ids[order[bounds[1:] - 1]], size)
    ends[:] = False
    ends[order[bounds[:-1]]] = ends[order[bounds[1:] - 1]] = True
    return low, high, ends


def _apart(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """h, with rows that need no more company sent to places of their own."""
    return np.where(known, C.mixed(h + np.arange(len(h), dtype=np.uint64)), h).view(np.int64)


def _anchors(batches):
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            symbols, _, _, first = word_symbols(data, at)
            n = np.diff(first)
            doc = np.repeat(np.arange(j - i), n)
            pos = np.arange(len(symbols)) - first[doc]
            here = np.flatnonzero(on[pos % PERIOD] & (pos <= n[doc] - ANCHOR) & (n[doc] >= WINDOW))
            h = C.Rolling(symbols).slices(here, here + ANCHOR)
            doc, pos = doc[here], pos[here]
            ids = _column(b, "id", i, j)[doc]
            low, high, ends = _met([h], ids)
            known = (low < high) & ~ends
            yield pa.RecordBatch.from_arrays([pa.array(_apart(h, known)), pa.array(ids), pa.array(_column(b, "tag", i, j)[doc]), pa.array(pos.astype(np.int32)), pa.array(known)], ["h", "id", "tag", "pos", "known"])


def spread(marks: np.ndarray, owner: np.ndarray, first: np.ndarray, before: int, after: int) -> np.ndarray:
    """Flags of the positions from mark - before to mark + after, each inside its own text."""
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, np.maximum(first[owner] + marks - before, first[owner]), 1)
    np.add.at(change, np.minimum(first[owner] + marks + after + 1, first[owner + 1]), -1)
    return np.cumsum(change[:-1]) > 0


def _marks(b: pa.RecordBatch, name: str, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(name).slice(i, j - i)
    n = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(j - i), n)


def window_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b (two columns) of the windows that begin at the words `here`, their words joined by one space."""
    if not len(here):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    used = np.cumsum(np.bincount(here, minlength=len(starts) + WINDOW) - np.bincount(here + WINDOW, minlength=len(starts) + WINDOW))[: len(starts)] > 0
    size = np.where(used, ends - starts + 1, 0)
    end = np.cumsum(size)
    joined = np.full(int(end[-1]), 0x20, np.uint8)
    length = (ends - starts)[used]
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat((end - size)[used], length) + step] = data[np.repeat(starts[used], length) + step]
    found = C.digests(joined.tobytes(), (end - size)[here], end[here + WINDOW - 1] - 1).view(np.uint64)
    return np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])


def _windows(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            starts, ends, first = C.word_bounds(~C.SPACE[data], at)
            marks, owner = _marks(b, "marks", i, j)
            near = spread(marks, owner, first, WINDOW - ANCHOR, 0)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            near &= np.arange(len(starts)) <= first[doc + 1] - WINDOW
            here = np.flatnonzero(near)
            h, check = window_digests(data, starts, ends, here)
            doc = doc[here]
            ids = _column(b, "id", i, j)[doc]
            known = ids > _met([check, h], ids)[0]
            yield pa.RecordBatch.from_arrays([pa.array(_apart(h, known)), pa.array(check.astype(np.uint32).view(np.int32)), pa.array(ids), pa.array(_column(b, "tag", i, j)[doc]), pa.array((here - first[doc]).astype(np.int32)), pa.array(known)], ["h", "h2", "id", "tag", "pos", "known"])


def _kept(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            starts, ends, first = C.word_bounds(~C.SPACE[data], at)
            gone = spread(*_marks(b, "marks", i, j), first, 0, WINDOW - 1) if len(starts) else np.zeros(0, bool)
            raw, texts = data.tobytes(), []
            for d in range(j - i):
                mine = slice(first[d], first[d + 1])
                keep = ~gone[mine]
                texts.append(b" ".join(raw[s:e] for s, e in zip(starts[mine][keep].tolist(), ends[mine][keep].tolist(), strict=True)))
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if j > i else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def by_row(places: DataFrame) -> DataFrame:
    """(id, tag, marks): the positions of each row, once each."""
    return places.groupBy("id", "tag").agg(F.collect_set("pos").alias("marks"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row.

    A word goes if a window of WINDOW words over it also starts in a row with a smaller id; windows
    are judged on the input. Kept words are joined by one space. Null and empty texts have no words.
    A null id counts as the largest; rows with one id never remove from each other. An empty table
    gives no rows; other columns are not looked at. Four shuffles: anchors (a fifth of the word
    positions) by hash, windows around shared anchors by hash, the marks of each row, and the texts,
    once, as both later reads use the same exchange. What the rows of one task already decide among
    themselves is not brought together again, so a passage that a third of all rows share does not
    fill one task. A window's group is never brought into memory:
    its smallest id comes from a sorted, spilling window.
    """
    rows = keyed(docs, key, text)
    schema = "h long, id long, tag long, pos int, known boolean"
    same = Window.partitionBy("h")
    shared = rows.select("id", "tag", "text").mapInArrow(_anchors, schema).withColumns({"lo": F.min("id").over(same), "hi": F.max("id").over(same)}).filter("known or lo < hi")
    marked = C.written(by_row(shared.select("id", "tag", "pos")))
    near = rows.join(marked, ["id", "tag"]).select("id", "tag", "text", "marks")
    equal = Window.partitionBy("h", "h2")
    repeats = near.mapInArrow(_windows, "h long, h2 int, id long, tag long, pos int, known boolean").withColumn("lo", F.min("id").over(equal)).filter("known or id > lo")
    gone = by_row(repeats.select("id", "tag", "pos"))
    return rows.join(gone, ["id", "tag"], "left").select("doc_id", "text", "marks").mapInArrow(_kept, f"doc_id {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark, sf_dir):
    kept = remove_repeats(C.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM s),
rep AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) WHERE doc_id > lo),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM rep) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
