"""How the sources of a language differ from each other and from the language, by mergeable radix tries.

Each task counts the terms of its texts in one trie a language, whose leaves hold a counter for every
source. A trie's leaves, read in the order of their bytes, are a sorted run; runs are dealt by ranges of
(language, term) and merged there into the whole trie, read leaf by leaf. A second reading of the terms
that are kept gives, for each run of them, the sums for pairs of sources and the terms that lead there,
both in UTF-8 order, so that ties are in order before they are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents of its language that a kept term is in; what is added to every count; the scale of the shares; ranks of terms.
LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Leaves and counters that a task's tries hold before they are given out, and leaves of a batch; kept terms of a run; sources of a block; bytes of text counted at once.
LEAVES, COUNTERS, GIVEN, RUN, BLOCK, ROUND_BYTES = 200_000, 600_000, 20_000, 4096, 128, 4 << 20
TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LEAF = "lang string, term string, sources array<string>, ns array<long>, docs array<long>"


class Trie:
    """A radix trie over bytes whose leaves are numbered; a leaf's counters, [occurrences, documents] by source, lie in arrays.

    A node is [label, children by first byte or None, number of its leaf or -1]; no node but the root has no leaf and one child only.
    """

    def __init__(self):
        self.root, self.size = [b"", {}, -1], 0
        self.counts: list[np.ndarray] = []

    def leaf(self, term: bytes) -> int:
        """The number of a term's leaf, which is made if it is not there."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(term[at])
            if child is None:
                children[term[at]] = [term[at:], None, self.size]
                self.size += 1
                return self.size - 1
            label = child[0]
            if term.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = 1
            while at + same < end and same < len(label) and term[at + same] == label[same]:
                same += 1
            middle = [label[:same], {label[same]: child}, -1]
            child[0] = label[same:]
            children[term[at]] = middle
            node, at = middle, at + same
        if node[2] < 0:
            node[2] = self.size
            self.size += 1
        return node[2]

    def add(self, terms: list[bytes], term: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        """Count n occurrences in docs documents of terms[term] for each source."""
        if not len(term):
            return
        used, place = np.unique(term, return_inverse=True)
        leaves = np.fromiter(map(self.leaf, [terms[t] for t in used.tolist()]), np.int64, len(used))
        self.counts.append(np.stack([leaves[place], source, n, docs]))
        if sum(c.shape[1] for c in self.counts) > 2 * self.settled + COUNTERS:
            self.settle()

    @property
    def settled(self) -> int:
        return self.counts[0].shape[1] if self.counts else 0

    def settle(self) -> None:
        """One counter for each leaf and source."""
        if self.counts:
            leaf, source, n, docs = np.concatenate(self.counts, 1)
            order = np.lexsort((source, leaf))
            leaf, source = leaf[order], source[order]
            first = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1])))
            self.counts = [np.stack([leaf[first], source[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)])]

    def walk(self):
        """(term, number of its leaf) in the order of the bytes, which for UTF-8 is that of the code points."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node[0]
            if node[2] >= 0:
                yield here, node[2]
            if node[1]:
                stack.extend([(node[1][c], here) for c in sorted(node[1], reverse=True)])

    def leaves(self) -> tuple[list[bytes], np.ndarray]:
        """All terms in order, and the counters in the same order: number of the term, source, occurrences, documents."""
        self.settle()
        terms, numbers = [], np.empty(self.size, np.int64)
        for term, number in self.walk():
            numbers[number] = len(terms)
            terms.append(term)
        leaf, *rest = self.counts[0] if self.counts else np.empty((4, 0), np.int64)
        leaf = numbers[leaf]
        order = np.argsort(leaf, kind="stable")
        return terms, np.stack([leaf[order], *(r[order] for r in rest)])


def term_counts(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of some texts, and for every term and group of texts that meet: term's number, group, occurrences, texts."""
    data = C.LOWER[data]
    starts, ends, first = C.word_bounds(TERM[data], at)
    if not len(starts):
        none = np.empty(0, np.int64)
        return [], none, none, none, none
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    term = coded.indices.to_numpy()[::2].astype(np.int64)
    n_docs = len(at) - 1
    pair, n = np.unique(term * n_docs + np.repeat(np.arange(n_docs), np.diff(first)), return_counts=True)
    groups = int(group.max()) + 1
    both, which = np.unique(pair // n_docs * groups + group[pair % n_docs], return_inverse=True)
    return coded.dictionary.to_pylist(), both // groups, both % groups, np.bincount(which, n).astype(np.int64), np.bincount(which)


def count_tries(docs: DataFrame) -> DataFrame:
    """Leaves (LEAF) of the tries of all tasks, each trie's in order. docs: lang, source, text without nulls."""

    def leaves(tries: dict[str, Trie], names: list[str]):
        source_names = pa.array(names, pa.string())
        for lang in sorted(tries):
            terms, (term, source, n, in_docs) = tries[lang].leaves()
            bounds = np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int32)
            for i in range(0, len(terms), GIVEN):
                some = terms[i : i + GIVEN]
                cut, at = slice(bounds[i], bounds[i + len(some)]), pa.array(bounds[i : i + len(some) + 1] - bounds[i])
                lists = [pa.ListArray.from_arrays(at, x) for x in (source_names.take(pa.array(source[cut])), pa.array(n[cut]), pa.array(in_docs[cut]))]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.array(some, pa.binary()).cast(pa.string()), *lists], ["lang", "term", "sources", "ns", "docs"])

    def count(batches):
        pa.default_memory_pool().release_unused()
        tries: dict[str, Trie] = {}
        names: dict[str, int] = {}
        for b in batches:
            for i, j, data, at in C.chunks(b.column("text"), ROUND_BYTES):
                keys = list(zip(b.column("lang").slice(i, j - i).to_pylist(), b.column("source").slice(i, j - i).to_pylist(), strict=True))
                kinds = {k: n for n, k in enumerate(sorted(set(keys)))}
                terms, term, group, n, in_docs = term_counts(data, at, np.fromiter((kinds[k] for k in keys), np.int64, len(keys)))
                source = np.array([names.setdefault(source, len(names)) for _, source in kinds], np.int64)
                langs = np.array([lang for lang, _ in kinds], object)
                for lang in dict.fromkeys(langs.tolist()):
                    here = (langs == lang)[group]
                    tries.setdefault(lang, Trie()).add(terms, term[here], source[group[here]], n[here], in_docs[here])
                if sum(t.size for t in tries.values()) >= LEAVES or sum(t.settled for t in tries.values()) >= COUNTERS:
                    yield from leaves(tries, list(names))
                    tries, names = {}, {}
        yield from leaves(tries, list(names))

    return docs.mapInArrow(count, LEAF)


def merged_trie(leaves: DataFrame, least: int) -> DataFrame:
    """(lang, term, run, sources, ns) of the terms in `least` documents of their language or more, written.

    A range of (lang, term) is one task's; its leaves come in order, equal ones one behind the other,
    and are merged as they pass. `run` numbers runs of at most RUN kept terms of one range.
    """
    ordered = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def merge(batches):
        pa.default_memory_pool().release_unused()
        # what follows the last whole term waits for the next batch
        waiting, task, kept = [], TaskContext.get().partitionId() << 32, 0
        for b in batches:
            if not b.num_rows:
                continue
            lang, term = b.column("lang"), b.column("term")
            n = b.num_rows
            new = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1)))
            last = np.flatnonzero(new.to_numpy(zero_copy_only=False))
            cut = int(last[-1]) + 1 if len(last) else 0
            if waiting and (cut or waiting[-1].column("term")[-1] != term[0] or waiting[-1].column("lang")[-1] != lang[0]):
                whole = [*waiting, b.slice(0, cut)]
                waiting = []
            else:
                whole = [b.slice(0, cut)]
            if cut < n:
                waiting.append(b.slice(cut))
            for out in _merged(whole, least):
                yield pa.RecordBatch.from_arrays([*out[:2], pa.array(task + (kept + np.arange(len(out[0]))) // RUN), *out[2:]], ["lang", "term", "run", "sources", "ns"])
                kept += len(out[0])
        for out in _merged(waiting, least):
            yield pa.RecordBatch.from_arrays([*out[:2], pa.array(task + (kept + np.arange(len(out[0]))) // RUN), *out[2:]], ["lang", "term", "run", "sources", "ns"])

    return C.written(ordered.mapInArrow(merge, "lang string, term string, run long, sources array<string>, ns array<long>"))


def _merged(batches: list[pa.RecordBatch], least: int):
    """The kept terms of sorted leaves, if there are any: lang, term, and lists of sources and counts."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    lang, term, lists, ns, docs = (table.column(c).combine_chunks() for c in ("lang", "term", "sources", "ns", "docs"))
    changed = lambda a: pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    new = np.append(True, changed(lang) | changed(term))
    terms, of_row = np.flatnonzero(new), np.cumsum(new) - 1
    of_leaf = np.repeat(of_row, pc.list_value_length(lists).to_numpy())
    n, docs = ns.flatten().to_numpy(), docs.flatten().to_numpy()
    leaf = (np.bincount(of_leaf, docs, len(terms)) >= least)[of_leaf]  # documents of a language are below 2**53
    if not leaf.any():
        return
    coded = lists.flatten().filter(pa.array(leaf)).dictionary_encode()
    sources = len(coded.dictionary)
    counter, which = np.unique(of_leaf[leaf] * sources + coded.indices.to_numpy(), return_inverse=True)
    total = np.zeros(len(counter), np.int64)
    np.add.at(total, which, n[leaf])
    kept, count = np.unique(counter // sources, return_counts=True)
    bounds, place = pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(terms[kept])
    yield lang.take(place), term.take(place), pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(counter % sources))), pa.ListArray.from_arrays(bounds, pa.array(total))


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED terms)), by long division, so that nothing overflows below 9e15 words."""
    over = np.asarray(total, np.int64) + ADDED * terms
    out, rest = np.divmod(np.asarray(count, np.int64) + ADDED, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digit
    return out + 1


def _compare(kept: pa.Table, blocks: pa.Table, top: int) -> pa.Table:
    """Of one run of kept terms and two blocks of sources: sums of differences for pairs, and, if the blocks are one, the leading terms of its sources.

    blocks has one or two rows: lang, block, sources, totals, and the language's number of terms and total.
    """
    none = pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())], ["lang", "source", "part", "item", "value"])
    if not kept.num_rows or not blocks.num_rows:
        return none
    kept, blocks = kept.sort_by("term"), blocks.sort_by("block")
    lang, terms, all_ = blocks.column("lang")[0].as_py(), blocks.column("terms")[0].as_py(), blocks.column("all")[0].as_py()
    lists = kept.column("sources").combine_chunks()
    names = lists.flatten()
    counts = kept.column("ns").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(kept.num_rows), pc.list_value_length(lists).to_numpy())
    dense = []
    for r in range(blocks.num_rows):
        own = blocks.column("sources")[r].values
        count = np.zeros((len(own), kept.num_rows), np.int64)
        place = pc.index_in(names, own).fill_null(-1).to_numpy()
        here = place >= 0
        count[place[here], row[here]] = counts[here]
        total = blocks.column("totals")[r].values.to_numpy()
        dense.append((own.to_pylist(), count, shares(count, total[:, None], terms)))
    parts = [none]
    own, count, p = dense[0]
    other, _, q = dense[-1]
    values = []
    for i, source in enumerate(own):
        sums = np.abs(q - p[i]).sum(1)
        for j, item in enumerate(other):
            if source != item:
                values.append((lang, source, "pair", item, int(sums[j])))
                if len(dense) == 2:
                    values.append((lang, item, "pair", source, int(sums[j])))
    if len(dense) == 1:
        whole = shares(np.add.reduceat(counts, np.append(0, np.flatnonzero(np.diff(row)) + 1)), all_, terms)  # every kept term has a counter
        term = kept.column("term").to_pylist()
        for i, source in enumerate(own):
            f = np.where(count[i] > 0, p[i] - whole, 0)
            first = np.argsort(-f, kind="stable")[:top]  # ties stay in the order of the trie
            values += [(lang, source, "term", term[k], int(f[k])) for k in first.tolist() if f[k] > 0]
    if values:
        parts.append(pa.table([pa.array(list(c), t) for c, t in zip(zip(*values, strict=True), none.schema.types, strict=True)], none.column_names))
    return pa.concat_tables(parts)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its leading terms.

    Nulls in the three columns count as ''. Part `pair` has each other source of the language, with the
    summed difference of the shares of all kept terms; part `term` has the `top` terms whose share is most
    above the language's. Ranks go by value falling, then item. A language without kept terms has pairs of
    value 0 and no terms; a source alone in its language has no pairs; rows that repeat count as
    often; an empty table gives no rows; other columns, whatever their names, are not looked at.

    Shuffled are leaves of tries, kept terms once for each two blocks of BLOCK sources, and results.
    A task of the second reading holds RUN terms of two blocks: 8 RUN BLOCK bytes a table.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    kept = merged_trie(C.written(count_tries(rows)), least)
    found = kept.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.ns").alias("total"))
    groups = rows.select("lang", "source").distinct().join(found, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    groups = C.written(groups)
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("all")).join(terms, "lang", "left").select("lang", "n", "all", F.coalesce("terms", F.lit(0)).alias("terms"))
    block = F.pmod(F.xxhash64("source"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    own = F.sort_array(F.collect_list(F.struct("source", "total")))
    blocks = groups.join(langs, "lang").groupBy("lang", block, "terms", "all").agg(own.alias("o")).select("lang", "block", "terms", "all", F.col("o.source").alias("sources"), F.col("o.total").alias("totals"))
    blocks = C.written(blocks)
    # a unit is two blocks of a language, or one with itself
    i, j = blocks.select("lang", F.col("block").alias("i")), blocks.select("lang", F.col("block").alias("j"))
    units = C.written(i.join(j, "lang").filter("i <= j"))
    runs = C.written(kept.select("lang", "run").distinct().join(units, "lang"))
    unit = ["lang", "run", "i", "j"]
    left = kept.join(units, "lang").groupBy(*unit)
    right = runs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).join(blocks, ["lang", "block"]).groupBy(*unit)
    values = left.cogroup(right).applyInArrow(lambda a, b: _compare(a, b, top), "lang string, source string, part string, item string, value long")
    values = C.written(values)
    without = groups.join(langs.filter("terms = 0").select("lang"), "lang").select("lang", "source")
    zero = without.join(without.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    pairs = values.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(zero.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    leading = values.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(leading)


def op12_divergence(spark, sf_dir):
    return audit(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(total)::HUGEINT AS total FROM gn GROUP BY lang),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p
  FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term
), q AS (
  SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 5) // (total + 5 * v) AS q
  FROM c JOIN ln ON ln.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term, total, v
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
