"""Token ids as files of range-coded blocks, written and read by Spark.

Rows of the written table are streams (see rangecoder) of about STREAM ids with an index of their
documents, in order of (part, seq): parts are ranges of ids, so the order of the files is that of
the documents. The table lies in Spark's own storage, which every executor reaches.
"""

from __future__ import annotations

import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import rangecoder

#: Ids of a stream, about; bytes of text that one round of tokenizing takes; pieces that a worker remembers, and the bytes of the longest of them.
STREAM, ROUND_BYTES, REMEMBERED, LONGEST = 4_000_000, 4 << 20, 600_000, 64
END = 0
#: Kinds of bytes: white space, letters, digits, marks, the apostrophe, and all that is cut nowhere.
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, UNCUT = range(6)
KIND = np.full(256, UNCUT, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
KIND[ord("'")] = APOSTROPHE
KIND[C.SPACE] = SPACE
#: Whether a piece ends between two kinds: the tokenizer's first step never puts both sides into one piece there.
CUT = np.zeros((6, 6), bool)
CUT[LETTER, [SPACE, DIGIT, MARK, APOSTROPHE]] = CUT[DIGIT, [SPACE, LETTER, MARK, APOSTROPHE]] = True
CUT[MARK, [SPACE, LETTER, DIGIT]] = CUT[APOSTROPHE, SPACE] = True
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
SCHEMA = "part int, seq int, n_tokens long, doc_id {0}, tokens array<int>, stream binary"


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte; the letters from U+00C0 to U+00FF are letters with both bytes."""
    kind = KIND.take(data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def piece_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets that cut texts into pieces which a byte-level tokenizer encodes independently; each text's own bounds are among them.

    Its first step takes runs of letters, of digits or of marks, each with the blank before it, runs
    of white space, and contractions after an apostrophe. A cut lies only where such a run must end:
    a letter before anything else, a digit likewise, a mark before white space, letter or digit.
    Beside characters of other kinds nothing is cut.
    """
    kind = kinds(data)
    pair = kind[:-1] * np.uint8(6)
    pair += kind[1:]
    cut = CUT.reshape(-1).take(pair)
    inner = np.zeros(len(data) + 1, bool)
    inner[1:-1] = cut
    inner[at] = True
    return np.flatnonzero(inner)


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct piece of a worker's texts being encoded once.

    Texts are cut where a byte-level tokenizer's pieces end anyway (piece_ends), equal pieces are
    found by their bytes, and the library encodes each of them. Texts that hold a special token's
    mark go to it whole, and so does everything if the tokenizer is not byte-level.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        first = parts.get("pre_tokenizer") or {}
        self.by_piece = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and parts.get("normalizer") is None
        self.special = [t["content"].encode() for t in parts.get("added_tokens", [])]
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. A run with the blank before it is what the model takes; the library's first step cuts the others."""
        joined = b"".join(pieces)
        data, at = np.frombuffer(joined, np.uint8), np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=at[1:])
        kind = kinds(data)
        change = np.zeros(len(data) + 1, np.int64)
        change[1:-1] = kind[1:] != kind[:-1]
        first = at[:-1] + (data[at[:-1]] == 0x20)
        change[first], change[at] = 0, 0
        changes = np.cumsum(change)
        run = (first < at[1:]) & (changes[at[1:]] == changes[at[:-1]])
        run &= np.isin(kind[np.minimum(first, len(data) - 1)], (LETTER, DIGIT, MARK))
        alphabet, tokenize = joined.decode("latin-1").translate(BYTE_CHARACTERS), self.whole.model.tokenize
        return [[t.id for t in tokenize(alphabet[s:e])] if r else self.whole.encode(p.decode(), add_special_tokens=False).ids for s, e, r, p in zip(at[:-1].tolist(), at[1:].tolist(), run.tolist(), pieces, strict=True)]

    def lookup(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in flat, and their number; what is not remembered comes after what is, until the next call."""
        count = len(self.known)
        used = int(self.ends[count])
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            lists = self.ids_of([pieces[i] for i in new])
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            while len(self.flat) < used + n.sum():
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.ends) < count + len(n) + 1:
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.flat[used : used + n.sum()] = np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum()))
            # first those that are remembered, so that their numbers stay
            kept = np.array([len(pieces[i]) <= LONGEST for i in new])
            kept &= np.cumsum(kept) <= REMEMBERED - count
            order = np.argsort(~kept, kind="stable")
            starts = used + np.cumsum(n) - n
            if not kept.all():
                self.flat[used : used + n.sum()] = self.flat[np.repeat(starts[order] - np.cumsum(n[order]) + n[order], n[order]) + np.arange(n.sum())]
            self.ends[count + 1 : count + len(n) + 1] = used + np.cumsum(n[order])
            number[np.array(new)[order]] = count + np.arange(len(new))
            self.known.update(zip([pieces[new[k]] for k in order[: kept.sum()].tolist()], range(count, count + int(kept.sum())), strict=True))
        return self.ends[number], self.ends[number + 1] - self.ends[number]

    def encode(self, column: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by `end`, and the number of each text's ids with it."""
        data, at = C.utf8(column)
        raw = data.tobytes()
        if not self.by_piece or any(s in raw for s in self.special):
            lists = [e.ids + [end] for e in self.whole.encode_batch_fast(pc.fill_null(column, "").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))
        cuts = piece_ends(data, at) if len(data) else np.zeros(1, np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        starts, sizes = self.lookup(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = sizes.take(which)
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        source = np.ones(upto[-1], np.int64)
        if len(size):  # steps of one inside a piece, and a jump where the next begins
            begin, real = starts.take(which), size > 0
            begin, first, length = begin[real], upto[:-1][real], size[real]
            source[first] = np.diff(begin, prepend=0)
            source[first[1:]] -= length[:-1] - 1
            np.cumsum(source, out=source)
        bounds = upto[np.searchsorted(cuts, at)]
        return np.insert(self.flat.take(source), bounds[1:], end), np.diff(bounds) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file, as it remembers pieces."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Streams (SCHEMA) of all rows in ascending order of the key (null first, ties by text).

    Null and empty texts have the end id alone; a very long text is a round of its own; rows that
    repeat are written as often as they are there; an empty table gives no streams; other columns,
    whatever their names, are not looked at. One shuffle, by ranges of the key and a hash of the text, so that rows of one key can part.
    """
    kind = docs.schema[key].dataType.simpleString()
    ordered = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def streams(batches):
        C.give_back()
        part, seq, code = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        keys, sizes, ids, n = [], [], [], 0

        def stream():
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(keys), pa.array(np.concatenate(sizes).astype(np.int32)))]
            plain = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64())]
            coded = rangecoder.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([*plain, *lists, pa.array([coded], pa.binary())], ["part", "seq", "n_tokens", "doc_id", "tokens", "stream"])

        for b in batches:
            for i, j, _, _ in C.chunks(b.column("text"), ROUND_BYTES):
                one = b.slice(i, j - i)
                new, lens = code.encode(one.column("text"))
                keys.append(one.column("doc_id")), sizes.append(lens), ids.append(new)
                n += len(new)
                if n >= STREAM:
                    yield stream()
                    seq, keys, sizes, ids, n = seq + 1, [], [], [], 0
        if keys:
            yield stream()

    return ordered.mapInArrow(streams, SCHEMA.format(f"array<{kind}>"))


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    encode_documents(docs, tokenizer).write.parquet(path)


def sound_ids(stream: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n ids of a stream and which of them are sound: those of damaged blocks, and all behind a damaged head, are 0 and not."""
    ids, sound = np.zeros(n, np.uint32), np.zeros(n, bool)
    for first, count, own in rangecoder.blocks(stream):
        if not count:
            break
        if own is not None:
            ids[first : first + count], sound[first : first + count] = own, True
    return ids, sound


def read_tokens(spark, path: str, with_ids: bool = False, damaged: str = "error") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path, and its ids if asked for.

    start: ids of all documents before it; it comes from sums of the streams, one row each. damaged: "error", or "null":
    documents with an id in a damaged block have no checksum and no ids, and all others are read.
    """
    streams = spark.read.parquet(path)
    kind = streams.schema["doc_id"].dataType.elementType.simpleString()
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = streams.select("part", "seq", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before("n", "part").alias("part_start"))
    starts = heads.withColumn("seq_start", before("n_tokens", "part", "seq")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("stream_start"))

    def documents(batches):
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["tokens"], np.int64)
                ends = np.cumsum(n)
                ids, sound = (rangecoder.decode(r["stream"]), None) if damaged == "error" else sound_ids(r["stream"], int(ends[-1]))
                whole = [True] * len(n) if sound is None else np.logical_and.reduceat(sound, ends - n).tolist()
                pieces = [ids[e - k : e].astype("<u4") for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array([r["part"]] * len(n), pa.int32()), pa.array([r["seq"]] * len(n), pa.int32()), pa.array(r["doc_id"], b.column("doc_id").type.value_type), pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(p) if w else None for p, w in zip(pieces, whole, strict=True)], pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) if w else None for p, w in zip(pieces, whole, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = f"part int, seq int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = streams.select("part", "seq", "doc_id", "tokens", "stream").mapInArrow(documents, shape)
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("stream_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokens_written(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to the shared folder and read back what the files say of each document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = C.shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)


def op1_token_output(spark, sf_dir):
    return tokens_written(C.table(spark, sf_dir, "documents"))
