"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A stream of ids is cut into blocks; each starts from fresh contexts and has its own checksum, so a
damaged block harms no other. All blocks of a stream are coded in step: position t of every block is
one round of array operations.

P(id) = q2 [id = p2] + q1 [id = p1] + q0 P0(id). Order 0 is P0(id) = P(class) P(id | class): ids are dealt to
classes of about equal mass, the classes' distribution adapts in every block, and that of the ids in a class is the
stream's, sent ahead, since a table of all ids for every block would not fit. Order 1 and order 2 each
predict the id that followed the same one or two ids in the block, with a confidence. The weights q adapt
in the block: there is a row of them for every pair of confidences. Contexts learn after every RUN ids,
weights and classes after every WEIGH runs, as arrays over all ids since. One step of the coder takes
weight, class and id together, so every bit of an id goes through it. All arithmetic is on integers; any machine
decodes what another wrote.

Stream: magic, then chapters. A chapter: its length, counts, its ids, classes and frequencies (deflated), then
words and CRC-32 of each block, the CRC-32 of all this, then the coded words of each block, two in seven bytes. A
chapter holds at most 2**16 different ids; a stream with more is cut into several. Where a chapter's head is damaged its
blocks are lost, but not the other chapters'.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, HEAD = b"TIDS3", "<QQIIII"
#: Ids of a block: a power of two in this range, such that about LANES blocks run side by side.
LEAST_BLOCK, MOST_BLOCK, LANES = 512, 4096, 2048
#: Slots of the two contexts; bits of the weights, of the classes' total and of a class's total; ids between lessons; lessons between new weights.
ORDER1_BITS, ORDER2_BITS, WEIGHT, CLASS, WITHIN, RUN, WEIGH = 7, 8, 8, 10, 10, 8, 16
#: Classes have 1 / SHARES of the mass at most, or one id, and KINDS ids at most; what a class has seen before a block begins, in all.
SHARES, KINDS, BEFORE = 64, 512, 96
ORDER0 = CLASS + WITHIN
#: Confidences of a context, from 0 (nothing seen); different ids of a chapter at most; ids of any stream are below LIMIT.
CONFIDENCES, DIFFERENT, LIMIT = 4, 1 << 16, 1 << 28
#: Bits of a coded word, which no step's total exceeds; the coder's range is kept between 2**32 and 2**(32 + WORD).
WORD = ORDER0 + WEIGHT
FLOOR, START = 1 << 32, (1 << 32 + WORD) - 1
#: Confidence after a lesson, by the one before, plus 4 if the prediction was right.
NEXT = np.array([1, 1, 1, 1, 1, 2, 3, 3], np.int32)
#: What stays of the low end, without and with a word given out.
KEEP = np.array([-1, (1 << 32) - 1])
ROWS = 2 * CONFIDENCES**2
#: What a row has seen before its block begins, by (order-2 confidence, order-1 confidence, both predict the same): symbols order 2, order 1, order 0.
PRIOR = np.array([[1 + 3 * two, 1 + one * (1 - same), 8 - two] for two in range(CONFIDENCES) for one in range(CONFIDENCES) for same in range(2)])


def slots(prev1: np.ndarray, prev2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the order-1 and order-2 contexts, given the last two ids as uint32."""
    h = prev1 * np.uint32(2654435761)
    one = h >> np.uint32(32 - ORDER1_BITS)
    h ^= prev2
    h *= np.uint32(2246822519)
    h >>= np.uint32(32 - ORDER2_BITS)
    return one.astype(np.int64), h.astype(np.int64)


class Model:
    """Contexts, weights and classes of all lanes. A slot is 4 id + confidence, or negative."""

    def __init__(self, lanes: int, masses: np.ndarray, inverse: bool = False):
        self.lanes, lane = lanes, np.arange(lanes)
        self.classes, self.inverse = len(masses), inverse
        self.in_class = np.tile(masses.astype(np.int32), lanes)
        self.class0 = lane * self.classes
        self.s1, self.s2 = np.full(lanes << ORDER1_BITS, -4, np.int32), np.full(lanes << ORDER2_BITS, -4, np.int32)
        self.base1, self.base2, self.row0 = lane << ORDER1_BITS, lane << ORDER2_BITS, lane * ROWS
        self.seen, self.waiting = np.tile(PRIOR.reshape(-1), lanes), []
        self.weigh()

    def weigh(self) -> None:
        """The cuts of 2**WEIGHT of every row (the order-2 weight, and that with the order-1 weight), from what it has seen."""
        if self.waiting:  # all lessons in one count, as a count costs a pass over its table
            counters, classes = (np.concatenate([x.reshape(-1) for x in xs]) for xs in zip(*self.waiting, strict=True))
            self.seen += np.bincount(counters, minlength=len(self.seen))
            self.in_class += 4 * np.bincount(classes, minlength=len(self.in_class)).astype(np.int32)
            self.waiting.clear()
        count = self.in_class.reshape(self.lanes, self.classes)
        total = 1 << CLASS
        share = 1 + count * np.int64(total - self.classes) // count.sum(1, keepdims=True, dtype=np.int64)
        share[np.arange(self.lanes), count.argmax(1)] += total - share.sum(1)
        # a class's share and what lies before it, in one number; such tables are small, as many workers share a cache
        self.share = ((np.cumsum(share, 1) - share) << 16 | share).astype(np.int32).reshape(-1)
        if self.inverse:
            self.class_at = np.repeat(np.tile(np.arange(self.classes, dtype=np.uint8), self.lanes), share.reshape(-1))
        n = self.seen.reshape(-1, 3)
        two, one, all_ = n[:, 0].astype(np.float32), n[:, 1].astype(np.float32), (n[:, 0] + n[:, 1] + n[:, 2]).astype(np.float32)
        most = (1 << WEIGHT) - 3  # every symbol keeps 1 at least
        a = 1 + (two * most / all_).astype(np.int64)
        b = a + 1 + (one * most / all_).astype(np.int64)
        self.cuts = (a << 16 | b).astype(np.int32)

    def note(self, row: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, place: np.ndarray) -> None:
        """What the next weights learn from: the row and symbol of each id, and the place of its class among those of all lanes."""
        self.waiting.append((row * 3 + np.where(hit2, 0, 2 - hit1), place))

    def predict(self, at1: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, ...]:
        """(order-1 slot, order-2 slot, row) at the places."""
        v1, v2 = self.s1.take(at1), self.s2.take(at2)
        row = ((v2 & 3) << 3) + ((v1 & 3) << 1)
        row += (v1 ^ v2) < 4
        row = self.row0[: at1.shape[-1]] + row
        return v1, v2, row

    def learn(self, ids: np.ndarray, at1: np.ndarray, at2: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> None:
        """Slots after a run: of ids that met in one slot the last decides."""
        own = ids << 2
        for table, at, v in ((self.s1, at1, v1), (self.s2, at2, v2)):
            kind = v & 3
            kind += (v >> 2 == ids).view(np.int8) << 2
            new = NEXT.take(kind)
            new += own
            table[at.reshape(-1)] = new.reshape(-1)


def _sizes(n: int, block: int) -> np.ndarray:
    """Ids of each block; only the last may be short."""
    full, rest = divmod(n, block)
    return np.array([block] * full + [rest] * (rest > 0), np.int64)


class Classes:
    """Order 0 of a chapter: the class of each id, and its place and width within, in units of 1 / 2**WITHIN; the masses of the classes."""

    def __init__(self, lengths: np.ndarray, frequency: np.ndarray, masses: np.ndarray):
        self.lengths, self.frequency, self.masses = lengths, frequency, masses
        first = np.cumsum(lengths) - lengths
        self.of = np.repeat(np.arange(len(lengths)), lengths)
        before = np.cumsum(frequency) - frequency
        # what lies before an id in its class and the id's width, in one number
        self.place = (before - before[first][self.of] << 16 | frequency).astype(np.int32)

    @classmethod
    def made(cls, counts: np.ndarray) -> Classes:
        """Runs of ids in their order."""
        most, lengths, mass, n = max(1, int(counts.sum()) // SHARES), [], 0, 0
        for c in counts.tolist():
            if n and (mass + c > most or n == KINDS):
                lengths.append(n)
                mass = n = 0
            mass, n = mass + c, n + 1
        lengths = np.array([*lengths, n])
        first = np.cumsum(lengths) - lengths
        total, of = np.add.reduceat(counts, first), np.repeat(np.arange(len(lengths)), lengths)
        frequency = 1 + counts * ((1 << WITHIN) - lengths)[of] // total[of]
        # what is left of a class's total goes to its commonest id
        top = np.lexsort((-counts, of))[first]
        frequency[top] += (1 << WITHIN) - np.add.reduceat(frequency, first)
        return cls(lengths, frequency, 1 + total * BEFORE // total.sum())


def encode(ids: np.ndarray) -> bytes:
    """The coded stream of ids (any integer type, 0 <= id < LIMIT)."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= LIMIT):
        raise ValueError("an id is out of range")
    waiting, parts = [ids] if len(ids) else [], [MAGIC]
    while waiting:
        own = waiting.pop()
        if (highest := int(own.max())) < 1 << 22:
            counts = np.bincount(own)
            kinds = np.flatnonzero(counts)
            number = np.zeros(highest + 1, np.int32)
            number[kinds] = np.arange(len(kinds))
            index, counts = number[own], counts[kinds]
        else:
            kinds, index, counts = np.unique(own, return_inverse=True, return_counts=True)
        if len(kinds) > DIFFERENT:
            waiting += [own[len(own) // 2 :], own[: len(own) // 2]]
        else:
            parts.append(_chapter(own, index.astype(np.int32), kinds, Classes.made(counts)))
    return b"".join(parts)


def _packed(words: np.ndarray) -> bytes:
    """An even number of words of WORD bits, two in seven bytes."""
    pairs = words.astype("<u8").reshape(-1, 2)
    return (pairs[:, 0] | pairs[:, 1] << np.uint64(WORD)).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(data: bytes, at: int, n: int) -> np.ndarray:
    pairs = np.zeros((n // 2, 8), np.uint8)
    pairs[:, :7] = np.frombuffer(data, np.uint8, n // 2 * 7, at).reshape(-1, 7)
    pairs = pairs.view("<i8").reshape(-1)
    return np.stack([pairs & (1 << WORD) - 1, pairs >> WORD], 1).reshape(-1)


def _runs(sizes: np.ndarray, block: int):
    """(first step, step after the last, lanes that have all of them) of every run; the run in which a short block ends is cut there."""
    edges = sorted({*range(0, block, RUN), int(sizes[0]), int(sizes[-1])})
    for t, stop in zip(edges, edges[1:], strict=False):
        if t < sizes[0]:
            yield t, stop, len(sizes) - (t >= sizes[-1])


def _chapter(ids: np.ndarray, index: np.ndarray, kinds: np.ndarray, order0: Classes) -> bytes:
    block = LEAST_BLOCK
    while block < MOST_BLOCK and len(ids) > LANES * block:
        block *= 2
    sizes = _sizes(len(ids), block)
    lanes, width = len(sizes), block + 4
    padded = np.zeros(lanes * block, np.int32)
    padded[: len(ids)] = index
    by_step = np.zeros((block + 2, lanes), np.int32)  # two rows of zeros: what comes before the first id
    by_step[2:] = padded.reshape(lanes, block).T
    del padded
    model = Model(lanes, order0.masses)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, START)
    out, pos = np.zeros(lanes * width, np.int32), np.arange(lanes) * width
    for k, (t, stop, live) in enumerate(_runs(sizes, block)):
        now, at1, at2 = by_step[t + 2 : stop + 2, :live], *slots(by_step[t + 1 : stop + 1, :live].view(np.uint32), by_step[t:stop, :live].view(np.uint32))
        at1 += model.base1[:live]
        at2 += model.base2[:live]
        v1, v2, row = model.predict(at1, at2)
        cuts = model.cuts.take(row)
        two, both = cuts >> 16, cuts & 0xFFFF
        hit2, hit1 = v2 >> 2 == now, v1 >> 2 == now
        left, kind = (1 << WEIGHT) - both, order0.of.take(now)
        kind += model.class0[:live]
        share = model.share.take(kind)
        upto, share, place = share >> 16, share & 0xFFFF, order0.place.take(now)
        begin0 = (upto << WITHIN) + share * (place >> 16)
        begins = np.where(hit2, 0, np.where(hit1, two << ORDER0, (both << ORDER0) + left * begin0)).astype(np.int64)
        widths = np.where(hit2, two << ORDER0, np.where(hit1, both - two << ORDER0, left * share * (place & 0xFFFF))).astype(np.int64)
        l, s, here = low[:live], span[:live], pos[:live]  # noqa: E741
        for begin, size in zip(begins, widths, strict=True):
            s >>= WORD
            begin *= s
            l += begin
            s *= size
            out[here] = l >> 32
            short = (s < FLOOR).view(np.int8)
            here += short
            by = short * np.int64(WORD)
            l &= KEEP.take(short)
            l <<= by
            s <<= by
        model.learn(now, at1, at2, v1, v2)
        model.note(row, hit1, hit2, kind)
        if k % WEIGH == WEIGH - 1:
            model.weigh()
    out[pos] = (low + (1 << 32) - 1) >> 32  # a value in the last range, whatever follows
    words = pos - np.arange(lanes) * width + 1
    words += words & 1
    table = out.reshape(lanes, width)
    for c in range(int(words.max()) - 1, 0, -1):  # a word may hold a carry for the word before
        table[:, c - 1] += table[:, c] >> WORD
    coded = _packed(table[np.arange(width) < words[:, None]] & (1 << WORD) - 1)
    plain = ids.astype("<u4")
    crcs = [zlib.crc32(plain[i * block : i * block + n]) for i, n in enumerate(sizes)]
    listed = zlib.compress(np.concatenate([np.diff(kinds, prepend=0), order0.frequency, order0.lengths, order0.masses]).astype("<u4").tobytes(), 6)
    table = np.stack([words, np.array(crcs, np.int64)], 1).astype("<u4").tobytes()
    size = struct.calcsize(HEAD) + len(listed) + len(table) + 4 + len(coded)
    head = struct.pack(HEAD, size, len(ids), block, len(kinds), len(order0.lengths), len(listed)) + listed + table
    return head + struct.pack("<I", zlib.crc32(head)) + coded


def decode(data: bytes) -> np.ndarray:
    """The ids of a stream, as uint32; ValueError if it is not one, ends early, or a block does not agree with its checksum."""
    parts = [np.empty(0, np.uint32)]
    for at, _, ids in blocks(data):
        if ids is None:
            raise ValueError(f"the stream is damaged from id {at} on")
        parts.append(ids)
    return np.concatenate(parts)


def blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(place of the first id, how many, the ids as uint32) of every block in order; None in place of the ids of a damaged block.

    A chapter with a damaged head is one damaged block of no known length (0), and places are counted from 0 again behind it.
    ValueError if the data is no stream; a stream that breaks off ends in a damaged block.
    """
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a stream of ids")
    at, first = len(MAGIC), 0
    while at < len(data):
        size = struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else 0
        try:
            found = _read_chapter(data[at : at + size])
        except (struct.error, zlib.error, IndexError, ValueError):
            yield first, 0, None
            found, first = [], 0
        for ids, n in found:
            yield first, n, ids
            first += n
        if size < struct.calcsize(HEAD) or at + size > len(data):
            return
        at += size


def _read_chapter(data: bytes) -> list[tuple[np.ndarray | None, int]]:
    """(ids or None, how many) of each block; ValueError if the head is damaged."""
    whole, n, block, different, classes, size = struct.unpack_from(HEAD, data, 0)
    at = struct.calcsize(HEAD)
    lanes = -(-n // max(block, 1))
    end = at + size + 8 * lanes
    if not lanes or whole < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("the head is damaged")
    sizes = _sizes(n, block)
    listed = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4").astype(np.int64)
    kinds, frequency = np.cumsum(listed[:different]), listed[different : 2 * different]
    order0 = Classes(listed[2 * different : 2 * different + classes], frequency, listed[2 * different + classes :])
    # the id at each place of each class
    which = np.repeat(np.arange(different, dtype=np.uint16), frequency)
    head = np.frombuffer(data, "<u4", lanes * 2, at + size).reshape(lanes, 2).astype(np.int64)
    words, at = head[:, 0], end + 4
    coded = data[at:].ljust(int(words.sum()) // 2 * 7, b"\0")  # blocks that are cut off fail their checksum
    width = int(words.max()) + 4
    source = np.zeros((lanes, width), np.int64)
    source[np.arange(width) < words[:, None]] = _unpacked(coded, 0, int(words.sum()))
    # the window holds a word and 32 bits, so that words come in shifted by 32 - WORD bits
    source, pos = source.reshape(-1), np.arange(lanes) * width
    code, span = source.take(pos) << 32, np.full(lanes, START)
    source <<= 32 - WORD
    source[:-1] |= source[1:] >> WORD
    source &= (1 << WORD) - 1
    code |= (source.take(pos) & (1 << 32 - WORD) - 1) << WORD | source.take(pos + 1)
    source, pos = source.astype(np.int32), pos + 2
    model, out = Model(lanes, order0.masses, True), np.zeros((block + 2, lanes), np.int32)
    for k, (t, stop, live) in enumerate(_runs(sizes, block)):
        c, s, here = code[:live], span[:live], pos[:live]
        base1, base2, class0, slot0, ran = model.base1[:live], model.base2[:live], model.class0[:live], np.arange(live) << CLASS, []
        for step in range(t, stop):
            at1, at2 = slots(out[step + 1, :live].view(np.uint32), out[step, :live].view(np.uint32))
            at1 += base1
            at2 += base2
            v1, v2, row = model.predict(at1, at2)
            cuts = model.cuts.take(row)
            s >>= WORD
            two, both = (cuts >> 16) * s, (cuts & 0xFFFF) * s
            unit = (s << WEIGHT) - both
            two <<= ORDER0
            both <<= ORDER0
            hit2, hit1 = c < two, c < both
            slot = np.maximum(c - both, 0).view(np.uint64) // unit.view(np.uint64)
            slot = np.minimum(slot, (1 << ORDER0) - 1).astype(np.int32)
            kind = model.class_at.take(slot0 + (slot >> WITHIN))
            begin = model.share.take(class0 + kind)
            share = begin & 0xFFFF
            begin >>= 16
            begin <<= WITHIN
            slot -= begin
            # exact: both numbers are small
            ids = which.take((slot / share).astype(np.int32) + (kind.astype(np.int32) << WITHIN)).astype(np.int32)
            place = order0.place.take(ids)
            begin += share * (place >> 16)
            begin = begin * unit
            begin += both
            size = (place & 0xFFFF) * share * unit
            # a damaged block may predict what is no id
            hit = np.flatnonzero(hit1)
            begin[hit], size[hit], ids[hit] = two.take(hit), (both - two).take(hit), np.maximum(v1.take(hit) >> 2, 0)
            hit = np.flatnonzero(hit2)
            begin[hit], size[hit], ids[hit] = 0, two.take(hit), np.maximum(v2.take(hit) >> 2, 0)
            c -= begin
            s[:] = size
            short = (s < FLOOR).view(np.int8)
            by = short * np.int64(WORD)
            s <<= by
            c <<= by
            c |= source.take(here, mode="clip") * short  # a damaged block may run on into what is not its own
            here += short
            out[step + 2, :live] = ids
            ran.append((at1, at2, v1, v2, row, hit1, hit2))
        at1, at2, v1, v2, row, hit1, hit2 = (np.stack(x) for x in zip(*ran, strict=True))
        now = out[t + 2 : stop + 2, :live]
        model.learn(now, at1, at2, v1, v2)
        model.note(row, hit1, hit2, order0.of.take(now) + class0)
        if k % WEIGH == WEIGH - 1:
            model.weigh()
    plain = kinds.astype("<u4")[np.ascontiguousarray(out[2:].T)]
    own = [plain[i, : sizes[i]] for i in range(lanes)]
    return [(ids.astype(np.uint32) if zlib.crc32(ids) == crc else None, len(ids)) for ids, crc in zip(own, head[:, 1].tolist(), strict=True)]
