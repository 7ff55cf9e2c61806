import hashlib
import struct
import zlib

import numpy as np
import pytest

from thermalis.llm import media


@pytest.mark.parametrize("seed,n,colours,bits", [(1, 1, 2, 2), (2, 5000, 3, 2), (3, 70000, 4, 2), (4, 40000, 256, 8), (5, 30000, 1, 8), (6, 100000, 7, 8)])
def test_lzw_round_trip(seed, n, colours, bits):
    x = np.random.default_rng(seed).integers(0, colours, n)
    assert (media.lzw(media.lzw_encode(x.astype(np.uint8).tobytes(), bits), bits, n) == x).all()


def test_lzw_by_hand():
    """The stream of the format's own small example: 2-bit samples, codes of 3 and then 4 bits."""
    samples = bytes([1] * 5 + [2] * 5 + [1] * 5 + [2] * 5)
    codes, table, out = [4, 1, 6, 6, 2, 9, 9], {}, []
    stream = media.lzw_encode(samples, 2)
    bits = int.from_bytes(stream, "little")
    widths = [3, 3, 3, 3, 4, 4, 4]
    for w in widths:
        out.append(bits & (1 << w) - 1)
        bits >>= w
    assert out == codes and not table and media.lzw(stream, 2, len(samples)).tobytes() == samples


def test_full_table_and_codes_of_the_table_to_come():
    x = np.random.default_rng(7).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    assert media.lzw(media.lzw_encode(x, 8), 8, len(x)).tobytes() == x
    y = bytes(100_000)
    assert media.lzw(media.lzw_encode(y, 2), 2, len(y)).tobytes() == y and len(media.lzw_encode(y, 2)) < 1000


@pytest.mark.parametrize("n", [64, 128, 254 * 64, 64 * 1024, 64 * 1025, 64 * 5000])
def test_payload_round_trip(n):
    x = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    found, frames, ms, colours = media.payload(media.encode(x))
    assert found == x and frames == -(-n // (64 * 1024)) and ms == 100 * frames and colours.sum() == 100 * frames * 64 * min(n // 64, 1024)


def gif(frames, w=4, h=4, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(sum(colours, ()))
    for left, top, samples, disposal, clear_index, interlaced in frames:
        fh, fw = samples.shape
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear_index is not None), 5, clear_index or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, fw, fh, 0x40 * interlaced) + b"\x02" + media._blocks(media.lzw_encode(samples.astype(np.uint8).tobytes(), 2))
    return out + b"\x3b"


def test_disposal_and_transparency():
    full, one, two = np.full((4, 4), 1), np.full((2, 2), 2), np.array([[3, 0], [0, 3]])
    a, b, c, d = media.decode(gif([(0, 0, full, 1, None, False), (1, 1, one, 2, None, False), (0, 0, two, 3, 0, False), (2, 2, two, 0, None, False)]))
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    assert (a.canvas == red).all() and a.delay == 50
    assert tuple(b.canvas[1, 1]) == green and tuple(b.canvas[0, 0]) == red
    assert tuple(c.canvas[1, 1]) == blue and tuple(c.canvas[2, 2]) == black and tuple(c.canvas[0, 1]) == red
    assert tuple(d.canvas[0, 0]) == red and tuple(d.canvas[2, 2]) == blue and tuple(d.canvas[2, 3]) == black
    assert media.histogram(a.canvas).sum() == 16


def test_interlace():
    x = np.arange(40).reshape(10, 4) % 4
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    (f,) = media.decode(gif([(0, 0, x[order], 0, None, True)], h=10))
    assert (f.samples == x).all()


def test_broken_files():
    whole = media.encode(bytes(64))
    for bad in (b"", b"GIF89a", whole[:-20], whole[:-1], whole[:40]):
        with pytest.raises(ValueError):
            list(media.decode(bad))
    with pytest.raises(ValueError):
        media.encode(b"")


def test_rows_that_repeat_are_transparent():
    rng = np.random.default_rng(3)
    first = rng.integers(0, 100, (1024, 64)).astype(np.uint8)
    second = first.copy()
    second[::2] = rng.integers(0, 100, (512, 64))
    x = first.tobytes() + second.tobytes() + second[:7].tobytes()
    gif = media.encode(x)
    assert media.payload(gif)[0] == x and len(gif) < len(media.encode(first.tobytes())) * 1.8
    assert [int((f.samples == 127).all(1).sum()) for f in media.decode(gif)] == [0, 512, 7]
    full = np.full((1024, 64), 127, np.uint8).tobytes()  # no index is free: nothing is left out
    assert media.payload(media.encode(full + full + first.tobytes()))[0] == full + full + first.tobytes()


def texts():
    long = " ".join(f"word{k * k % 9973}" for k in range(60_000))
    return [(1, None), (2, ""), (3, "a"), (4, "é" * 32), (4, "é" * 32), (None, "no id"), (5, "x" * 64), (6, long), (7, "\x00\x7f"), (8, "plain prose of several words. " * 40)]


def test_query_columns(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, media string, n_bytes string")
    got = media.digests(media.store(docs))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    found = got.collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(want, key=str)
    assert all(r["media_bytes"] < r["payload_bytes"] for r in found if r["doc_id"] in (6,))
    pair = [tuple(r) for r in found if r["doc_id"] == 4]
    assert pair[0] == pair[1]
    assert media.digests(media.store(docs.limit(0))).count() == 0


def test_frames(spark):
    rows = texts()
    stored = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    got = media.frames(stored).collect()
    assert sum(r["doc_id"] == 6 for r in got) > 5 and all(sum(r["histogram"]) and r["delay_ms"] == 100 for r in got)
    whole = media.encode(np.random.default_rng(1).integers(0, 200, 2 * 64 * 1024).astype(np.uint8).tobytes())
    bad = spark.createDataFrame([(1, None), (2, b"no"), (3, whole[: len(whole) * 3 // 4])], "doc_id long, media binary")
    assert sorted((r["doc_id"], r["frame"]) for r in media.frames(bad).fillna({"frame": -1}).collect()) == [(1, -1), (2, -1), (3, -1), (3, 0)]
    assert media.frames(bad.limit(0)).count() == 0
