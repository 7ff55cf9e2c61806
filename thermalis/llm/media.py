"""GIF media columns: payloads stored as frames, and frames read from any GIF.

The reader decodes LZW code streams, applies palettes, interlacing, disposal and transparency, and
gives timed frames with a colour histogram, one at a time. The writer uses the same means: a growing
LZW table, a palette of as many colours as the payload needs, and rows that repeat the frame before
are left transparent. The payload is read back from the colours on the canvas.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A stored frame's width, and its most rows; time of a frame in hundredths of a second; levels of each colour in a histogram.
WIDTH, ROWS, DELAY, LEVELS = 64, 1024, 10, 4
#: Entries of an LZW table, and bits of its longest code.
ENTRIES, LONGEST = 4096, 12
#: Colours of the stored palette: red is the sample, green and blue tell near samples apart.
_V = np.arange(256)
COLOURS = np.stack([_V, _V * 37 % 256, 255 - _V * 11 % 256], 1).astype(np.uint8)


@dataclass
class Frame:
    """One frame: its own samples (rows x columns palette indices), and the canvas (rows x columns x 3) after it is drawn."""

    left: int
    top: int
    delay: int
    samples: np.ndarray
    canvas: np.ndarray


def _blocks(data: bytes) -> bytes:
    """data in sub-blocks of at most 255 bytes, ended by an empty one."""
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of n codes after a clear code: the k-th code finds clear + 2 + max(k - 1, 0) entries."""
    return np.clip(np.frexp((1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0))[1], bits + 1, LONGEST).astype(np.int64)


def lzw_encode(samples: bytes, bits: int) -> bytes:
    """The LZW stream of samples below 2**bits, with a clear code first and wherever the table is full."""
    clear = 1 << bits
    codes, runs, table, following, before = [clear], [], {}, clear + 2, -1
    for sample in samples:
        if before < 0:
            before = sample
            continue
        key = before << 8 | sample
        code = table.get(key)
        if code is not None:
            before = code
            continue
        codes.append(before)
        if following < ENTRIES:
            table[key] = following
            following += 1
        else:
            codes.append(clear)
            runs.append(len(codes))
            table, following = {}, clear + 2
        before = sample
    codes += [before, clear + 1] if before >= 0 else [clear + 1]
    # a clear code has the width of the table that it ends; the first one stands alone
    edges = [1, *runs, len(codes)]
    widths = np.concatenate([[bits + 1], *(_widths(e - s, bits) for s, e in zip(edges, edges[1:], strict=False))])
    flags = (np.array(codes)[:, None] >> np.arange(LONGEST)) & 1
    return np.packbits(flags[np.arange(LONGEST) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def encode(payload: bytes) -> bytes:
    """A looping GIF whose frames of WIDTH columns hold the payload, a positive multiple of WIDTH bytes."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    rows, samples = len(payload) // WIDTH, np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bits = max(2, int(samples.max()).bit_length())
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF0 | bits - 1, 0, 0), COLOURS[: 1 << bits].tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    unseen = (1 << bits) - 1
    for first in range(0, rows, ROWS):
        own = samples[first : first + ROWS]
        same = (own == samples[first - ROWS : first - ROWS + len(own)]).all(1) if first else np.zeros(len(own), bool)
        hidden = bool(same.any()) and not (own[~same] == unseen).any()
        if hidden:
            own = np.where(same[:, None], np.uint8(unseen), own)
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2 | hidden, DELAY, unseen if hidden else 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(own), 0), bytes([bits]), _blocks(lzw_encode(own.tobytes(), bits))]
    return b"".join(parts) + b"\x3b"


def _bits(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Codes of the given widths at bit offsets; data has three spare bytes at its end."""
    byte = at >> 3
    whole = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return (whole >> (at & 7)) & ((1 << width) - 1)


def _entries(codes: list[int], clear: int) -> list[bytes]:
    """What the codes between two clear codes stand for: every code but the first adds an entry, while there is room."""
    table = [bytes([i]) for i in range(min(clear, 256))] + [b""] * (clear + 2 - min(clear, 256))
    out, before = [], b""
    for code in codes:
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("a code is not in the table yet")
        if before and len(table) < ENTRIES:
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
    return out


def lzw(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n samples of an LZW stream whose literals have `bits` bits; a short stream is an error."""
    a = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    clear, total, at, parts, have = 1 << bits, len(data) * 8, 0, [], 0
    while have < n:
        # codes until the next clear or end code, in growing portions
        size, codes = 1 << 12, None
        while True:
            w = _widths(size, bits)
            o = np.cumsum(w) - w
            fits = int(np.searchsorted(at + o + w, total, "right"))
            codes = _bits(a, at + o[:fits], w[:fits])
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or fits < size:
                break
            size *= 4
        count = int(stop[0]) if len(stop) else len(codes)
        own = b"".join(_entries(codes[:count].tolist(), clear))
        parts.append(own)
        have += len(own)
        if not len(stop) or codes[count] == clear + 1:
            break
        at += int(o[count] + w[count])
    if have < n:
        raise ValueError("the image data ends early")
    return np.frombuffer(b"".join(parts)[:n], np.uint8)


def decode(gif: bytes) -> Iterator[Frame]:
    """The frames in order, one at a time. ValueError if the file is not a GIF or ends early."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _decode(gif)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _decode(gif: bytes) -> Iterator[Frame]:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", gif, 6)
    at, shared = 13, None

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 3 << ((flags & 7) + 1)
        colours = np.zeros((256, 3), np.uint8)
        colours[: n // 3] = np.frombuffer(gif, np.uint8, n, at).reshape(-1, 3)
        return colours, at + n

    if flags & 0x80:
        shared, at = palette(flags, at)
    empty = shared[background] if shared is not None else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = empty
    delay, disposal, clear_index = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := gif[at]:
            parts.append(gif[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while gif[at] != 0x3B:
        kind, at = gif[at], at + 1
        if kind == 0x21:
            label, at = gif[at], at + 1
            body, at = blocks(at)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = (packed >> 2) & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at)
        colours, at = palette(flags, at + 9) if flags & 0x80 else (shared if shared is not None else np.zeros((256, 3), np.uint8), at + 9)
        bits = gif[at]
        data, at = blocks(at + 1)
        samples = lzw(data, bits, w * h).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order, kind="stable")]
        before = canvas.copy() if disposal == 3 else None
        canvas = canvas.copy()
        area, own = canvas[top : top + h, left : left + w], samples[: max(0, height - top), : max(0, width - left)]
        if clear_index is None:
            area[:] = colours[own]
        else:
            seen = own != clear_index
            area[seen] = colours[own[seen]]
        yield Frame(left, top, delay * 10, samples, canvas)
        if disposal == 2:
            canvas = canvas.copy()
            canvas[top : top + h, left : left + w] = empty
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour, LEVELS levels for each of red, green and blue."""
    q = canvas >> (8 - LEVELS.bit_length() + 1)
    return np.bincount((q[..., 0].astype(np.int64) * LEVELS + q[..., 1]).reshape(-1) * LEVELS + q[..., 2].reshape(-1), minlength=LEVELS**3)


def _read(gif: bytes | None):
    """The rows of frames() for one GIF, without the key; ValueError if it cannot be read to its end."""
    for i, f in enumerate(decode(gif or b"")):
        yield i, f.delay, f.samples.shape[1], f.samples.shape[0], f.samples.tobytes(), histogram(f.canvas).tolist()


FRAME = pa.schema([("frame", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64()))])


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, frame, delay_ms, width, height, samples, histogram), one row for each frame of each GIF.

    A GIF without frames, a null and an empty one give one row with null in all but the key; of a
    damaged one come the frames before the damage, then such a row. Frames leave a task one by one,
    so a GIF's canvases are never together in memory. Rows that repeat are read as often; an empty
    table gives no rows; other columns are not looked at.
    """

    def read(batches):
        for b in batches:
            for k, gif in zip(b.column(key), b.column(column).to_pylist(), strict=True):
                found, whole = 0, True
                rows = _read(gif)
                while True:
                    try:
                        row = next(rows, None)
                    except ValueError:
                        row, whole = None, False
                    if row is None and (found and whole):
                        break
                    found += 1
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], b.column(key).type), *(pa.array([v], t) for v, t in zip(row or (None,) * len(FRAME), FRAME.types, strict=True))], [key, *FRAME.names])
                    if row is None:
                        break

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(read, f"`{key}` {kind}, frame int, delay_ms int, width int, height int, samples binary, histogram array<long>")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with zero bytes to a positive multiple of 64, as a GIF.

    Null and empty texts are 64 zero bytes; a very long text has many frames; equal texts have equal
    GIFs; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """

    def write(batches):
        for b in batches:
            for i, j, data, at in C.chunks(b.column("text")):
                raw, n = data.tobytes(), np.diff(at)
                media = [encode(raw[s:e] + bytes(-(e - s) % 64 or 64 * (e == s))) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


def payload(gif: bytes) -> tuple[bytes, int, int, np.ndarray]:
    """(payload, frames, milliseconds, colour histogram weighed by time) of a stored GIF, from the colours on its canvas."""
    parts, ms, colours = [], 0, np.zeros(LEVELS**3, np.int64)
    for f in decode(gif):
        parts.append(f.canvas[: len(f.samples), :, 0].tobytes())  # red is the sample
        ms += f.delay
        colours += histogram(f.canvas) * f.delay
    return b"".join(parts), len(parts), ms, colours


def _digests(batches):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for b in batches:
        out = []
        for gif in b.column("media").to_pylist():
            found, n, ms, colours = payload(gif)
            shown = ",".join(f"{c}:{colours[c]}" for c in np.flatnonzero(colours))
            out.append((len(found), hashlib.sha256(found).hexdigest(), zlib.crc32(found[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), f"frames={n};ms={ms};colour_ms={shown}"))
        if out:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(stored: DataFrame) -> DataFrame:
    """What is read back of store()'s rows: sizes, checksums, and a feature of the timed frames' colours."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(_digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_gif(spark, sf_dir):
    return digests(store(C.table(spark, sf_dir, "documents")))
