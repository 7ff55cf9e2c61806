"""Helpers shared by the text operators: cutting lineage, and texts as byte arrays."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the word-count contracts: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled by one round of array work, unless a single text is longer.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine, which only a local session may use."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="thermalis-")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(spark))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to Parquet in the shared folder, computed once, and are read from there.

    A lost executor costs its running tasks only.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this worker has freed, in earlier stages too, to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `most` bytes; a longer text stands alone."""
    data, at = utf8(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers by rule, the same on every machine."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mixed(x)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> np.ndarray:
    """BLAKE2b of the given slices, of 8 or 16 bytes, as one or two columns of int64. These decide what is equal."""
    make = hashlib.blake2b
    out = b"".join([make(raw[s:e], digest_size=size).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, size // 8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b for each word; words do not touch. Each different word is hashed once."""
    if not len(starts):
        return np.empty(0, np.uint64)
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = runs.dictionary_encode()
    which = coded.indices.to_numpy()[::2]
    make, kinds = hashlib.blake2b, coded.dictionary.to_pylist()
    return np.frombuffer(b"".join([make(k, digest_size=8).digest() for k in kinds]), np.uint64)[which]


def sequences(words: np.ndarray, begin: np.ndarray, length: np.ndarray | int, most: int) -> np.ndarray:
    """64-bit hashes of runs of at most `most` words, each step mixed; equal runs of one length have equal hashes."""
    h = np.full(len(begin), 0x9E3779B97F4A7C15, np.uint64)
    length = np.broadcast_to(length, len(begin))
    for k in range(most):
        more = mixed(h + words.take(np.minimum(begin + k, len(words) - 1)) if len(words) else h)
        h = more if (length > k).all() else np.where(length > k, more, h)
    return h


class Rolling:
    """Polynomial hashes (mod 2**64) of any slice of an array of 64-bit symbols, from prefix sums.

    hash(i, j) depends on the symbols i..j-1 alone, not on where they stand. Strings made for it
    collide, so it only proposes what may be equal.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        n, base = len(symbols), int(splitmix(2, seed + 7)[1]) | 1
        up, down = self._powers.get(base, (np.empty(0), np.empty(0)))
        if len(up) <= n:
            size = max(1 << 16, n + n // 4 + 1)
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            np.cumprod(up, out=up), np.cumprod(down, out=down)
            self._powers[base] = (up, down) if size <= 16 << 20 else (np.empty(0), np.empty(0))
        self.down, self.sums = down, np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of one width, by start; not mixed beyond a multiply."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        h = (self.sums[width:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


#: A 64-bit symbol for each byte value.
BYTE_SYMBOLS = splitmix(256, 11) | np.uint64(1)
#: The contracts' white space, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(is_word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, none of which crosses a text, and the first word of each text (and the end)."""
    n = len(is_word)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    begin, end = is_word.copy(), is_word.copy()
    begin[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begin[edge] = is_word[edge]
    end[edge - 1] = is_word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)
