"""Benchmark decontamination with suffix arrays of the training text.

A shard is a run of training documents of a few megabytes. Its suffix array holds the word suffixes
that can begin a match, sorted by their first words; every suffix of every test item is
binary-searched in every shard, which gives all verbatim matches and their places. The benchmark is
sent to the tasks in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of a window; bytes of benchmark text in a block (the bound of what is broadcast); bytes of a shard.
WINDOW, BLOCK_BYTES, SHARD_BYTES = 10, 8 << 20, 4 << 20
#: Pairs of a place in a document and one in an item that are open at once, unless one item has more.
MOST_PAIRS = 1 << 20
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FILTER_BITS = 22
MATCH = pa.struct([("item", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])
ADDED = "n_words long, n_hit long, cover array<int>, items array<string>, matches array<struct<item:string,doc_word:int,item_word:int,words:int>>"


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text with a 0 after each text and WINDOW more at the end; first word of each text there."""
    data = C.LOWER[data]
    starts, ends, first = C.word_bounds(WORD[data], at)
    hashes = np.maximum(C.word_hashes(data, starts, ends), np.uint64(1))
    out = np.zeros(len(hashes) + len(at) - 1 + WINDOW, np.uint64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    out[np.arange(len(hashes)) + doc] = hashes
    return out, first + np.arange(len(at))


class TestSuffixes:
    """The different windows of a block of benchmark items, by width, where each stands, and a bit filter of the word pairs that begin one.

    A window that repeats inside an item stands at its first place there.
    """

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        words, first = word_hashes(*C.utf8(pa.array(texts, pa.large_string())))
        self.ids, n = ids, np.diff(first) - 1
        width = np.minimum(n, WINDOW)
        count = np.where(n > 0, n - width + 1, 0)
        item = np.repeat(np.arange(len(ids)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows = words[(first[item] + offset)[:, None] + np.arange(WINDOW)] if len(item) else np.empty((0, WINDOW), np.uint64)
        rows[np.arange(WINDOW) >= width[item][:, None]] = 0
        order = np.lexsort((offset, item, *rows.T[::-1]))
        rows, item, offset = rows[order], item[order], offset[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        self.words, window = rows[new], np.cumsum(new) - 1
        self.width = (self.words != 0).sum(1)
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        # places: (window, item, offset), by window
        self.window, self.item, self.offset = window[once], item[once], offset[once]
        self.places = np.searchsorted(self.window, np.arange(len(self.words) + 1))
        self.pairs, self.singles = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << FILTER_BITS, bool)
        two = self.width > 1
        self.pairs[self.slot(self.words[two, 0], self.words[two, 1])] = True
        self.singles[self.slot(self.words[~two, 0], np.uint64(0))] = True
        self.any_single = bool((~two).any())

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def suffix_array(words: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Positions that can begin a match, in the order of their first WINDOW words, and those words."""
    n = len(words) - WINDOW
    may = test.pairs[test.slot(words[:n], words[1 : n + 1])]
    if test.any_single:
        may |= test.singles[test.slot(words[:n], np.uint64(0))]
    at = np.flatnonzero(may & (words[:n] != 0))
    keys = words[at[:, None] + np.arange(WINDOW)]
    order = np.lexsort(keys.T[::-1])
    return at[order], keys[order]


def bound(keys: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each wanted row, how many sorted rows of keys are below it (upper: or equal) in its columns."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    columns = np.arange(len(wanted))
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        row = keys[np.minimum(mid, len(keys) - 1), : wanted.shape[1]]
        differ = row != wanted
        first = differ.argmax(1)
        less = np.where(differ.any(1), row[columns, first] < wanted[columns, first], upper)
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def find(words: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, position) of every occurrence of a test window in the shard."""
    at, keys = suffix_array(words, test)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for w in np.unique(test.width) if len(at) else ():
        which = np.flatnonzero(test.width == w)
        lo, hi = (bound(keys, test.words[which, :w], up) for up in (False, True))
        n = hi - lo
        row, k = _expand(lo, n)
        found.append((which[row], at[k]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _lists(per_row: np.ndarray, values: pa.Array) -> pa.ListArray:
    ends = np.zeros(len(per_row) + 1, np.int32)
    np.cumsum(per_row, out=ends[1:])
    return pa.ListArray.from_arrays(ends, values)


def _expand(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start of the row + 0..n-1) for every row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def longest(q: np.ndarray, p: np.ndarray, doc: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, ...]:
    """(doc, item, place in the shard, place in the item, words) of the longest match of every item in every document that has one; the first of equals.

    Items are taken in groups, so that the pairs of places that are open at once stay few.
    """
    order = np.lexsort((p, q))
    q, p, doc = q[order], p[order], doc[order]
    at = np.searchsorted(q, np.arange(len(test.words) + 1))
    entry = np.flatnonzero(np.diff(at)[test.window])
    entry = entry[np.argsort(test.item[entry], kind="stable")]
    n = np.diff(at)[test.window[entry]]
    item = test.item[entry]
    upto, found, i = np.cumsum(n), [], 0
    while i < len(entry):
        j = max(int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MOST_PAIRS, "right")), i + 1)
        j = int(np.searchsorted(item, item[j], "left")) if j < len(entry) else j
        j = j if j > i else int(np.searchsorted(item, item[i], "right"))
        row, k = _expand(at[test.window[entry[i:j]]], n[i:j])
        e = entry[i:j][row]
        diagonal = p[k] - test.offset[e]
        by = np.lexsort((p[k], diagonal, test.item[e]))
        e, k, diagonal = e[by], k[by], diagonal[by]
        new = np.ones(len(e) + 1, bool)
        new[1:-1] = (np.diff(test.item[e]) != 0) | (np.diff(diagonal) != 0) | (np.diff(p[k]) != 1)
        begin, end = np.flatnonzero(new)[:-1], np.flatnonzero(new)[1:] - 1
        words = p[k[end]] + test.width[q[k[end]]] - p[k[begin]]
        by = np.lexsort((p[k[begin]], -words, test.item[e[begin]], doc[k[begin]]))
        begin, words = begin[by], words[by]
        first = np.ones(len(begin), bool)
        first[1:] = (np.diff(doc[k[begin]]) != 0) | (np.diff(test.item[e[begin]]) != 0)
        begin, words = begin[first], words[first]
        found.append((doc[k[begin]], test.item[e[begin]], p[k[begin]], test.offset[e[begin]], words))
        i = j
    if not found:
        return (np.empty(0, np.int64),) * 5
    out = [np.concatenate(c) for c in zip(*found, strict=True)]
    by = np.lexsort((out[1], out[0]))
    return tuple(c[by] for c in out)


def search(data: np.ndarray, at: np.ndarray, test: TestSuffixes, before: pa.Array | None) -> list[pa.Array]:
    """The columns ADDED of one shard. before: the cover of earlier blocks."""
    words, first = word_hashes(data, at)
    docs = len(at) - 1
    n_words = np.diff(first) - 1
    q, p = find(words, test)
    doc = np.searchsorted(first, p, "right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, p, 1)
    np.add.at(change, p + test.width[q], -1)
    if before is not None:
        pairs, owner = before.flatten().to_numpy().reshape(-1, 2), np.repeat(np.arange(docs), np.diff(before.offsets.to_numpy()) // 2)
        np.add.at(change, first[owner] + pairs[:, 0], 1)
        np.add.at(change, first[owner] + pairs[:, 1], -1)
    hit = (np.cumsum(change) > 0).astype(np.int8)
    edges = np.diff(np.concatenate([[0], hit]))
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(first, start, "right") - 1
    n_hit = np.bincount(owner, stop - start, docs).astype(np.int64)
    cover = _lists(2 * np.bincount(owner, minlength=docs), pa.array((np.stack([start, stop], 1) - first[owner][:, None]).ravel().astype(np.int32)))
    d, item, place, offset, length = longest(q, p, doc, test)
    per_doc = np.bincount(d, minlength=docs)
    names = pa.array([test.ids[i] for i in item], pa.string())
    fields = [names, pa.array((place - first[d]).astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(length.astype(np.int32))]
    return [pa.array(n_words), pa.array(n_hit), cover, _lists(per_doc, names), _lists(per_doc, pa.StructArray.from_arrays(fields, fields=list(MATCH)))]


_built: dict[tuple, TestSuffixes] = {}


def built(key: tuple, rows: list) -> TestSuffixes:
    """The suffixes of a block, built once in each worker; only the last block's are kept."""
    if key not in _built:
        _built.clear()
        _built[key] = TestSuffixes([r[0] for r in rows], [r[1] for r in rows])
    return _built[key]


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row of docs (all: None), and those of ADDED; clashing columns are replaced.

    cover: word ranges in any match, as start, end, start, end; items: the items with a window here
    (an item without an id has matches, but no name); matches: the longest verbatim match of each of
    these items, of at least a window. Null and empty texts have no words; an empty benchmark matches nothing. A block's texts are
    sent as they are and made into suffixes in the tasks. Narrow: no row is shuffled, each row is judged by itself, so repeated ids do no harm.
    """
    added = ("n_words", "n_hit", "cover", "items", "matches")
    docs = docs.drop(*added)
    keep = [c for c in (keep or docs.columns) if c in docs.columns]
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    for k in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select(F.col("item_id").cast("string"), "text").collect()
        sent, name = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), (uuid.uuid4().hex, k)
        columns = keep if k == blocks - 1 else list(dict.fromkeys([*keep, "text"]))

        def one(batches, k=k, sent=sent, name=name, columns=columns):
            test = built(name, sent.value)
            for b in batches:
                for i, j, data, at in C.chunks(b.column("text"), SHARD_BYTES):
                    own = b.slice(i, j - i)
                    new = search(data, at, test, own.column("cover") if k else None)
                    if k:
                        for c in (3, 4):
                            new[c] = pa.array([x + y for x, y in zip(own.column(added[c]).to_pylist(), new[c].to_pylist(), strict=True)], new[c].type)
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in columns), *new], [*columns, *added])

        shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
        out = out.mapInArrow(one, f"{shape}, {ADDED}")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, in which no benchmark window occurs."""
    names = docs.columns
    clash = {c: f"_own_{c}" for c in names if c in ("n_words", "n_hit", "cover", "items", "matches")}
    found = annotate(docs.withColumnsRenamed(clash), benchmark).filter("n_hit = 0")
    return found.select(*[F.col(clash.get(c, c)).alias(c) for c in names])


def op3_decontamination(spark, sf_dir):
    found = annotate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, item_id, n, s FROM dwin JOIN bwin USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
