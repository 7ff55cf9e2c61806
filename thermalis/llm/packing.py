"""Best-fit packing of tokenized documents into sequences of a fixed size.

Documents are tokenized once and cut into pieces. Pieces that fill a sequence stand alone; the
others are dealt to groups of bounded size, and each group is packed in one task: best fit by
falling length, then a local search that moves pieces, or exchanges one for one, two for one or
one for two, from an emptier sequence to a fuller one. Every step raises the sum of the squared fills,
so the search ends; a sequence that has given all away is gone. The emptiest sequences of every
group are packed again together with those of other groups, until one group is left.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import ROUND_BYTES, encoder

#: Tokens of a sequence; the id after each document; pieces of a group, about; of a group's pieces, one in SHARE goes on to the next round.
SIZE, END, GROUP, SHARE = 1024, 2, 32_768, 8
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document.

    A document is its ids and `end`; one of at most `size` ids is one piece, a longer one is cut
    from its end into pieces of `size` ids, so that the first may be shorter. Null texts count as
    empty: they are `end` alone. `row` numbers the pieces, and stays as the table is written.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        code = encoder(tokenizer)
        for b in batches:
            for i, j, _, _ in C.chunks(b.column("text"), ROUND_BYTES):
                one = b.slice(i, j - i)
                ids, n = code.encode(one.column("text"), end)
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * size
                start = np.where(nth > 0, first[doc] + (nth - 1) * size, 0)
                length = np.where(nth > 0, size, first[doc])
                at = np.repeat(np.cumsum(n) - n, count) + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [pc.take(one.column("doc_id"), pa.array(doc)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if with_ids:  # pieces lie one behind the other
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, PIECE + ["ids"] * with_ids)

    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    cut_up = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, shape)
    return C.written(cut_up.select(F.monotonically_increasing_id().alias("row"), "*"))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each piece and the gap of each bin: longest first, each into the fullest bin that takes it."""
    bins, gaps, by_gap, open_ = np.zeros(len(lengths), np.int64), [], [[] for _ in range(size + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            gap = (fits & -fits).bit_length() - 1 + n
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_ ^= 1 << gap
        else:
            b, gap = len(gaps), size
            gaps.append(size)
        bins[i], gaps[b] = b, gap - n
        if gap > n:
            by_gap[gap - n].append(b)
            open_ |= 1 << gap - n
    return bins, gaps


class Search:
    """Local search over the bins that have a gap. Arrays are over their pieces."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, gaps: list[int], size: int):
        self.size, self.gap = size, np.array(gaps, np.int64)
        self.own = np.flatnonzero(self.gap[bins] > 0)
        self.length, self.bin = lengths[self.own].astype(np.int64), bins[self.own]
        self.members: dict[int, set[int]] = {int(b): set() for b in np.unique(self.bin)}
        for k, b in enumerate(self.bin.tolist()):
            self.members[b].add(k)
        self.pairs()

    def pairs(self) -> None:
        """Two pieces of one bin, for each bin and each pair of different lengths in it (a bin has few: their sum is bounded)."""
        first, second = [], []
        for own in self.members.values():
            kinds: dict[int, list[int]] = {}
            for k in own:
                kinds.setdefault(int(self.length[k]), []).append(k)
            some = [k for ks in kinds.values() for k in ks[:2]]
            for i, a in enumerate(some):
                for b in some[i + 1 :]:
                    first.append(a)
                    second.append(b)
        self.first, self.second = np.array(first, np.int64), np.array(second, np.int64)

    def put(self, k: int, b: int) -> None:
        old = int(self.bin[k])
        self.members[old].discard(k)
        self.members[b].add(k)
        self.bin[k] = b
        self.gap[old] += self.length[k]
        self.gap[b] -= self.length[k]

    def best(self, gain: np.ndarray, room: np.ndarray) -> int:
        """The place with the largest gain that is positive and fits; -1 if there is none."""
        gain = np.where(gain <= room, gain, 0)
        k = int(gain.argmax()) if len(gain) else 0
        return k if len(gain) and gain[k] > 0 else -1

    def step(self, b: int) -> bool:
        """One move or exchange that takes tokens from bin b to a bin at least as full."""
        fuller = (self.gap > 0) & (self.gap <= self.gap[b])
        fuller[b] = False
        room = np.where(fuller, self.gap, 0)
        own = sorted(self.members[b], key=lambda k: (-self.length[k], k))
        sizes: dict[int, int] = {}
        for k in own:
            sizes.setdefault(int(self.length[k]), k)
        for n, k in sizes.items():  # move
            fits = np.flatnonzero(room >= n)
            if len(fits):
                self.put(k, int(fits[room[fits].argmin()]))
                return True
        item_room = room[self.bin]
        for n, k in sizes.items():  # one for one
            if (j := self.best(n - self.length, item_room)) >= 0:
                a = int(self.bin[j])
                self.put(j, b), self.put(k, a)
                return True
        done = set()
        for i, k in enumerate(own):  # two for one
            for m in own[i + 1 :]:
                n = int(self.length[k] + self.length[m])
                if n in done:
                    continue
                done.add(n)
                if (j := self.best(n - self.length, item_room)) >= 0:
                    a = int(self.bin[j])
                    self.put(j, b), self.put(k, a), self.put(m, a)
                    return True
        if len(self.first):
            there = self.bin[self.first]
            pair_room = np.where(there == self.bin[self.second], room[there], 0)
            both = self.length[self.first] + self.length[self.second]
            for n, k in sizes.items():  # one for two
                if (j := self.best(n - both, pair_room)) >= 0:
                    a, x, y = int(there[j]), int(self.first[j]), int(self.second[j])
                    self.put(x, b), self.put(y, b), self.put(k, a)
                    return True
        return False

    def run(self, bins: np.ndarray, least: int) -> np.ndarray:
        """Bins of all pieces after the search; it ends when a whole round finds no step, or `least` bins are left."""
        alive, stepped = len(self.gap), True
        while alive > least and stepped:
            stepped = False
            for b in sorted(self.members, key=lambda b: (-self.gap[b], b)):
                while self.members[b] and self.step(b):
                    stepped = True
                if not self.members[b]:
                    del self.members[b]
                    self.gap[b] = 0  # takes nothing any more
                    alive -= 1
                    if alive <= least:
                        break
            self.pairs()
        out = bins.copy()
        out[self.own] = self.bin
        return out


def pack_lengths(lengths: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Bin of each piece (0 < length <= size), in as few bins as best fit and the local search find."""
    bins, gaps = best_fit(lengths, size)
    least = -(-int(lengths.sum()) // size)
    if len(gaps) > least:
        bins = Search(lengths, bins, gaps, size).run(bins, least)
    return np.unique(bins, return_inverse=True)[1]


def _group_packer(size: int, last: bool):
    """The function of one table that Spark calls for each group."""
    return lambda table: _packed_group(table.drop_columns(["g"]), size, last)


def _packed_group(table: pa.Table, size: int, last: bool) -> pa.Table:
    """A group's pieces with sequence_id (the least row in it), offset and done; not done are the emptiest sequences, with one piece in SHARE, unless it is the last group."""
    table = table.sort_by([("length", "descending"), ("row", "ascending")])
    length, row = (table.column(c).to_numpy() for c in ("length", "row"))
    bins = pack_lengths(length, size)
    order = np.argsort(bins, kind="stable")
    count = np.bincount(bins)
    before = np.cumsum(length[order]) - length[order]
    firsts = np.cumsum(count) - count
    offset = np.empty(len(length), np.int64)
    offset[order] = before - np.repeat(before[firsts], count)
    name = np.minimum.reduceat(row[order], firsts)
    done = np.ones(len(count), bool)
    if not last:
        fill = np.bincount(bins, weights=length).astype(np.int64)
        emptiest = np.argsort(fill, kind="stable")
        open_ = np.cumsum(count[emptiest]) <= max(len(length) // SHARE, count[emptiest[0]])
        done[emptiest[open_ & (fill[emptiest] < size)]] = False
    return table.append_column("sequence_id", pa.array(name[bins])).append_column("offset", pa.array(offset)).append_column("done", pa.array(done[bins]))


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document.

    Pieces are those of pieces(). Null and empty texts are one piece of the end id; rows that repeat
    are packed as often as they are there; ids may be null or repeat; other columns, whatever their
    names, are not looked at; an empty table gives no rows. Text never moves: what is shuffled is
    a line of numbers a piece. Rounds shrink by SHARE, each over groups of about GROUP pieces,
    dealt by a hash of the piece's number, so no key can be hot.
    """
    cut = pieces(docs, tokenizer, size, end, key, text, with_ids)
    columns = ["row", *PIECE]
    kind = docs.schema[key].dataType.simpleString()
    shape = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"
    parts = [cut.filter(F.col("length") == size).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, turn = cut.filter(F.col("length") < size).select(*columns), 0
    while True:
        n = left.count()
        groups = max(1, -(-n // GROUP))
        grouped = left.withColumn("g", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups))).groupBy("g")
        packed = C.written(grouped.applyInArrow(_group_packer(size, groups == 1), shape))
        parts.append(packed.filter("done").drop("done"))
        if groups == 1:
            break
        left, turn = packed.filter("NOT done").select(*columns), turn + 1
    found = reduce(DataFrame.unionByName, parts)
    if with_ids:
        found = found.join(cut.select("row", "ids"), "row")
    return found.drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, lengths, ids) of every sequence of pack(..., with_ids=True): what a trainer reads, with its documents' bounds."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    one = packed.groupBy("sequence_id").agg(parts.alias("p"))
    total = F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select("sequence_id", total.alias("length"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), F.flatten("p.ids").alias("ids"))


def op11_packing(spark, sf_dir):
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
