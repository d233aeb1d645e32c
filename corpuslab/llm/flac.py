"""Media columns: FLAC streams of 8-bit mono samples, written and read back.

A stream has a STREAMINFO block with the MD5 of its samples, a SEEKTABLE with one point
for every frame, and frames of up to BLOCK samples. A frame predicts its samples with a
fixed polynomial or a quantised linear predictor and stores the residuals as Rice codes in
partitions. The reader starts at the seek points, decodes one residual of every frame of a
slice of rows at a time, and verifies header and frame checksums, the chain of frames and
the MD5. It takes any 8-bit mono stream of constant, verbatim, fixed or linear-predictor
frames; a stream with fewer seek points is read frame after frame.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslab.llm.common import map_text, quoted

BLOCK = 1024
# frames that are worked on at once; bounds memory for texts of any length
TOGETHER = 1536
RATE = 8000
PAD = 64
# bits of a coefficient, and the shift of a prediction, as the writer chooses them
PRECISION = 12
SHIFT = 9
LPC_ORDER = 2
PARTITION_ORDER = 2
LONGEST_RUN = 31
FLIP = bytes(b ^ 0x80 for b in range(256))
# weights of the earlier samples for the fixed predictors of order 0 to 4
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) else c << 1
            c &= (1 << bits) - 1
        out[b] = c
    return out


CRC8 = crc_table(0x07, 8)
CRC16 = crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of ``data``, a byte of each at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, longest_first = starts[order], sizes[order]
    c = np.zeros(len(order), np.int64)
    active = len(order)
    for i in range(int(longest_first[0]) if active else 0):
        while longest_first[active - 1] <= i:
            active -= 1
        now = c[:active]
        c[:active] = CRC16[(now >> 8) ^ data[at[:active] + i]] ^ ((now << 8) & 0xFFFF)
    out = np.empty_like(c)
    out[order] = c
    return out


def frame_header(number: int, size: int) -> bytes:
    """Header of a frame of fixed block size: number in the extended UTF-8 form, size in 16 bits, CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        tail = [0x80 | (number >> (6 * i)) & 0x3F for i in range(n - 1)][::-1]
        coded = bytes([(0xFF00 >> n) & 0xFF | number >> (6 * (n - 1)), *tail])
    head = b"\xff\xf8\x70\x02" + coded + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def pack(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of bit fields written one after another; fields have at most 57 bits."""
    ends = np.cumsum(widths)
    starts = ends - widths
    words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    word, over = starts >> 6, (starts & 63) + widths - 64
    inside = over <= 0
    left = np.where(inside, -over, 0).astype(np.uint64)
    right = np.where(inside, 0, over).astype(np.uint64)
    placed = (values << left) >> right
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.bitwise_or.reduceat(placed, first)
    spill = np.flatnonzero(~inside)
    words[word[spill] + 1] |= values[spill] << (64 - over[spill]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: int(ends[-1] + 7) >> 3]


def encode_frames(blocks: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of frames one after another, and their sizes, from (frame number, unsigned samples)."""
    frames = len(blocks)
    lengths = np.array([len(b) for _, b in blocks], np.int64)
    samples = np.zeros((frames, BLOCK), np.int64)
    for f, (_, block) in enumerate(blocks):
        samples[f, : len(block)] = np.frombuffer(block, np.uint8)
        samples[f, : len(block)] -= 128
    column = np.arange(BLOCK)
    present = column < lengths[:, None]
    # candidates: fixed order 0 to 2, and a linear predictor from the autocorrelation
    r0, r1, r2 = ((samples[:, lag:] * samples[:, : BLOCK - lag]).sum(axis=1).astype(float) for lag in range(3))
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    limit = 1 << (PRECISION - 1)
    coefs = np.stack([np.where(det > 0, (r1 * r0 - r1 * r2) / safe, 0), np.where(det > 0, (r0 * r2 - r1 * r1) / safe, 0)], axis=1)
    coefs = np.clip(np.rint(coefs * (1 << SHIFT)), -limit, limit - 1).astype(np.int64)
    back1 = np.pad(samples, ((0, 0), (1, 0)))[:, :-1]
    back2 = np.pad(samples, ((0, 0), (2, 0)))[:, :-2]
    kinds = [
        (0, samples), (1, samples - back1), (2, samples - 2 * back1 + back2),
        (LPC_ORDER, samples - ((coefs[:, :1] * back1 + coefs[:, 1:] * back2) >> SHIFT)),
    ]
    cost = np.stack([(np.abs(r) * (present & (column >= o))).sum(axis=1) for o, r in kinds])
    kind = cost.argmin(axis=0)
    orders = np.array([o for o, _ in kinds])[kind]
    residual = samples.copy()
    for i, (_, r) in enumerate(kinds):
        residual[kind == i] = r[kind == i]
    zigzag = np.where(residual >= 0, residual * 2, -residual * 2 - 1)
    coded = present & (column >= orders[:, None])
    # Rice parameter of each partition: from its mean, with runs of at most LONGEST_RUN zeros
    parts = 1 << PARTITION_ORDER
    part_size = lengths >> PARTITION_ORDER
    part = np.minimum(column // part_size[:, None], parts - 1)
    cell = (np.arange(frames)[:, None] * parts + part)[coded]
    values = zigzag[coded]
    n_cell = np.bincount(cell, minlength=frames * parts)
    mean = np.bincount(cell, values, frames * parts).astype(np.int64) // np.maximum(n_cell, 1)
    largest = np.zeros(frames * parts, np.int64)
    np.maximum.at(largest, cell, values)
    bits = lambda v: np.frexp(v.astype(float))[1]
    rice = np.clip(np.maximum(bits(mean) - 1, bits(largest >> 5)), 0, 14)
    k = rice[cell]
    codes = ((1 << k) | (values & ((1 << k) - 1))).astype(np.uint64)
    code_bits = (values >> k) + 1 + k
    # fields of a frame: header bytes, type, warm-up, predictor, partitions with their codes, padding, CRC-16
    heads: dict[tuple[int, int], bytes] = {}
    fields_v: list[np.ndarray] = []
    fields_w: list[np.ndarray] = []
    cell_bits = np.bincount(cell, code_bits, frames * parts).astype(np.int64).reshape(frames, parts)
    cell_end = np.cumsum(n_cell).reshape(frames, parts)
    sizes = np.zeros(frames, np.int64)
    for f in range(frames):
        key = blocks[f][0], int(lengths[f])
        head = heads.get(key)
        if head is None:
            head = heads[key] = frame_header(*key)
        o, lpc = int(orders[f]), kind[f] == 3
        v = [*head, (32 + o - 1) << 1 if lpc else (8 + o) << 1, *(int(x) & 0xFF for x in samples[f, :o])]
        w = [8] * len(v)
        if lpc:
            v += [PRECISION - 1, SHIFT, *(int(c) & ((1 << PRECISION) - 1) for c in coefs[f])]
            w += [4, 5] + [PRECISION] * LPC_ORDER
        v += [0, PARTITION_ORDER]
        w += [2, 4]
        total = sum(w) + 4 * parts + int(cell_bits[f].sum())
        for p in range(parts):
            v.append(int(rice[f * parts + p]))
            w.append(4)
            fields_v.append(np.array(v, np.uint64))
            fields_w.append(np.array(w, np.int64))
            v, w = [], []
            stop = cell_end[f, p]
            fields_v.append(codes[stop - n_cell[f * parts + p] : stop])
            fields_w.append(code_bits[stop - n_cell[f * parts + p] : stop])
        pad = -total % 8
        fields_v.append(np.zeros(2, np.uint64))
        fields_w.append(np.array([pad, 16], np.int64))
        sizes[f] = (total + pad) // 8 + 2
    body = pack(np.concatenate(fields_v), np.concatenate(fields_w))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    crc = crc16(body, starts, sizes - 2)
    body[ends - 2], body[ends - 1] = crc >> 8, crc & 0xFF
    return body, sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload of unsigned 8-bit samples."""
    blocks = [(i, p[i * BLOCK : (i + 1) * BLOCK]) for p in payloads for i in range(-(-len(p) // BLOCK))]
    bodies, sizes = [], [np.empty(0, np.int64)]
    for first in range(0, len(blocks), TOGETHER):
        body, each = encode_frames(blocks[first : first + TOGETHER])
        bodies.append(body.tobytes())
        sizes.append(each)
    body = b"".join(bodies)
    size = np.concatenate(sizes)
    end = np.cumsum(size)
    out = []
    first = 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        own = slice(first, first + n)
        start = int(end[first] - size[first]) if n else 0
        info = (
            min(BLOCK, max(16, len(p))).to_bytes(2, "big") * 2 + int(size[own].min(initial=0)).to_bytes(3, "big")
            + int(size[own].max(initial=0)).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big")
            + hashlib.md5(p.translate(FLIP)).digest()
        )
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        points["sample"] = np.arange(n) * BLOCK
        points["offset"] = end[own] - size[own] - start
        points["size"] = np.minimum(BLOCK, len(p) - BLOCK * np.arange(n))
        seek = points.tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
                   + (body[start : int(end[first + n - 1])] if n else b""))
        first += n
    return out


@dataclass
class Stream:
    total: int
    md5: bytes
    start: int
    seek: np.ndarray


def metadata(media: bytes) -> Stream:
    """The STREAMINFO values, the place of the first frame and the seek points (sample, offset)."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, None, np.empty((0, 2), np.int64)
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = int.from_bytes(block[10:18], "big"), block[18:34]
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
            points = points[points["sample"] != 2**64 - 1]
            seek = np.stack([points["sample"].astype(np.int64), points["offset"].astype(np.int64)], axis=1)
        at += 4 + size
    if info is None or info[0] >> 41 & 7 or (info[0] >> 36 & 31) != 7:
        raise ValueError("only mono streams of 8-bit samples are read")
    return Stream(info[0] & ((1 << 36) - 1), info[1], at, seek)


SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def parse_header(data: bytes, at: int, seen: dict[bytes, tuple[int, int, int]]) -> tuple[int, int, int]:
    """(frame or sample number, block size, header length) with the CRC-8 verified."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame here")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] >> 4 or (data[at + 3] >> 1 & 7) not in (0, 1):
        raise ValueError("only mono frames of 8-bit samples are read")
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 7 - ((~lead & 0xFF).bit_length())
    size = 5 + more + (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * (rate in (13, 14)) + 1
    head = data[at : at + size]
    found = seen.get(head)
    if found is None:
        if crc8(head[:-1]) != head[-1]:
            raise ValueError("a frame header fails its checksum")
        number = lead if not more else lead & (0x3F >> more)
        for b in head[5 : 5 + more]:
            number = number << 6 | b & 0x3F
        tail = 5 + more
        block = head[tail] + 1 if code == 6 else int.from_bytes(head[tail : tail + 2], "big") + 1 if code == 7 else SIZES[code]
        found = seen[head] = number, block, size
    return found


def bits_at(data: bytes, bit: int, n: int) -> int:
    end = bit + n
    return int.from_bytes(data[bit >> 3 : (end + 7) >> 3], "big") >> (-end % 8) & ((1 << n) - 1)


def signed(v: int, n: int) -> int:
    return v - (1 << n) if v >> (n - 1) else v


def decode_frames(data: bytes, starts: list[int], seen: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples and ends of the frames that begin at ``starts``."""
    buffer = np.frombuffer(data + bytes(16), np.uint8)
    window = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    n_frames = len(starts)
    out: list[np.ndarray | None] = [None] * n_frames
    ends = np.zeros(n_frames, np.int64)
    rice: list[tuple] = []
    for f, at in enumerate(starts):
        _, n, size = parse_header(data, at, seen)
        at += size
        kind = data[at] >> 1
        if data[at] & 1 or data[at] >> 7:
            raise ValueError("frames with wasted bits are not read")
        at += 1
        if kind == 0:
            out[f] = np.full(n, signed(data[at], 8), np.int64)
            ends[f] = at + 1
        elif kind == 1:
            out[f] = np.frombuffer(data, np.int8, n, at).astype(np.int64)
            ends[f] = at + n
        else:
            order = kind - 8 if 8 <= kind <= 12 else kind - 31
            if order < 0 or (kind < 32 and kind > 12):
                raise ValueError("reserved frame type")
            warm = np.frombuffer(data, np.int8, order, at).astype(np.int64)
            bit, shift, weights = (at + order) * 8, 0, FIXED[order] if kind < 32 else ()
            if kind >= 32:
                precision = bits_at(data, bit, 4) + 1
                shift = signed(bits_at(data, bit + 4, 5), 5)
                weights = tuple(signed(bits_at(data, bit + 9 + i * precision, precision), precision) for i in range(order))
                bit += 9 + order * precision
            rice.append((f, n, order, warm, weights, shift, bits_at(data, bit, 2), bits_at(data, bit + 2, 4), bit + 6, kind < 32))
    if rice:
        residuals, last = decode_rice(window, rice)
        for (f, *_), end in zip(rice, last):
            ends[f] = (end + 7) >> 3
        for f, samples in restore(rice, residuals):
            out[f] = samples
    wide = ends - np.array(starts)
    stored = buffer[ends].astype(np.int64) << 8 | buffer[ends + 1]
    if (crc16(buffer, np.array(starts), wide) != stored).any():
        raise ValueError("a frame fails its checksum")
    return out, ends + 2


def decode_rice(window: np.ndarray, frames: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(residual number, frame) matrix and the bit after the last code of each frame."""
    counts = np.array([n - order for _, n, order, *_ in frames])
    rank = np.argsort(-counts, kind="stable")
    counts = counts[rank]
    pick = lambda i: np.array([frames[f][i] for f in rank])
    pos, order = pick(8), pick(2)
    wide, escape = np.where(pick(6) == 1, 5, 4), np.where(pick(6) == 1, 31, 15)
    part = pick(1) >> pick(7)
    left, k = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    raw = np.zeros(len(rank), bool)
    fresh = np.ones(len(rank), bool)
    residuals = np.zeros((int(counts[0]), len(rank)), np.int64)
    active = len(rank)
    some_raw = False
    u64 = np.uint64

    def peek(at):
        return window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    for j in range(int(counts[0])):
        while counts[active - 1] <= j:
            active -= 1
        new = np.flatnonzero(left[:active] == 0)
        while len(new):
            at = pos[new]
            k[new] = (peek(at) >> (64 - wide[new]).astype(np.uint64)).astype(np.int64)
            left[new] = part[new] - np.where(fresh[new], order[new], 0)
            fresh[new] = False
            pos[new] += wide[new]
            raw[new] = k[new] == escape[new]
            if raw[new].any():
                some_raw = True
                stored = new[raw[new]]
                k[stored] = (peek(pos[stored]) >> u64(59)).astype(np.int64)
                pos[stored] += 5
            new = new[left[new] == 0]
        at, kk = pos[:active], k[:active]
        w = peek(at)
        high = (w >> u64(32)).astype(np.float64)
        run = 32 - np.frexp(high)[1].astype(np.int64)
        long = np.flatnonzero((high == 0) & ~raw[:active])
        for f in long:
            run[f] = 0
            byte = int(at[f])
            while not int(window[byte >> 3]) >> (63 - (byte & 7)) & 1:
                run[f] += 1
                byte += 1
        shifted = w << (run + 1).astype(np.uint64) if not len(long) else peek(at + run + 1)
        low = ((shifted >> u64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        value = run << kk | low
        value = value >> 1 ^ -(value & 1)
        step = run + 1 + kk
        if some_raw and raw[:active].any():
            plain = raw[:active]
            bits = ((w >> u64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
            value = np.where(plain, bits - ((bits >> np.maximum(kk - 1, 0) & 1) << kk), value)
            step = np.where(plain, kk, step)
        residuals[j, :active] = value
        pos[:active] += step
        left[:active] -= 1
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    return residuals[:, back], pos[back]


def restore(frames: list[tuple], residuals: np.ndarray):
    """(frame, samples): residuals added to the predictions, all frames of one predictor order at a time."""
    alike: dict[tuple[bool, int], list[int]] = {}
    for i, frame in enumerate(frames):
        alike.setdefault((frame[9], frame[2]), []).append(i)
    for (fixed, order), members in alike.items():
        longest = max(frames[i][1] for i in members)
        s = np.zeros((longest, len(members)), np.int64)
        if order:
            s[:order] = np.stack([frames[i][3] for i in members], axis=1)
        s[order:] = residuals[: longest - order, members]
        if fixed and order <= 2:
            # sums undo differences; start from the differences of the warm-up
            if order == 2:
                s[1] -= s[0]
                s[1:] = np.cumsum(s[1:], axis=0)
            if order:
                s = np.cumsum(s, axis=0)
        else:
            weights = np.array([frames[i][4] for i in members], np.int64).T
            shift = np.array([frames[i][5] for i in members], np.int64)
            for j in range(order, longest):
                s[j] += (weights * s[j - order : j][::-1]).sum(axis=0) >> shift
        for c, i in enumerate(members):
            yield frames[i][0], s[: frames[i][1], c]


def decode(media: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """(payload, [(sample offset, samples, byte offset) of each frame]) of each stream, all checks made."""
    streams = [metadata(m) for m in media]
    bases = np.cumsum([0, *map(len, media)])
    data = b"".join(media)
    seen: dict = {}
    todo = []
    for s, stream in enumerate(streams):
        offsets = stream.seek[:, 1].tolist() if len(stream.seek) and stream.seek[0].tolist() == [0, 0] else [0]
        todo.append([int(bases[s]) + stream.start + o for o in offsets] if stream.total else [])
    found: list[list[tuple[int, int, bytes]]] = [[] for _ in media]
    while any(todo):
        owner = [s for s, starts in enumerate(todo) for _ in starts]
        starts = [a for each in todo for a in each]
        for first in range(0, len(starts), TOGETHER):
            part = slice(first, first + TOGETHER)
            blocks, ends = decode_frames(data, starts[part], seen)
            for s, at, end, block in zip(owner[part], starts[part], ends.tolist(), blocks):
                found[s].append((at, end, (block + 128).astype(np.uint8).tobytes()))
        todo = [[] for _ in media]
        for s, frames in enumerate(found):
            known = {at for at, _, _ in frames}
            todo[s] = [end for _, end, _ in frames if end not in known and end < bases[s + 1]]
    out = []
    for s, (stream, frames) in enumerate(zip(streams, found)):
        frames.sort(key=lambda x: x[0])
        place, offset, table, parts = int(bases[s]) + stream.start, 0, [], []
        for at, end, block in frames:
            if at != place:
                raise ValueError("frames do not follow each other")
            table.append((offset, len(block), at - int(bases[s])))
            offset, place = offset + len(block), end
            parts.append(block)
        payload = b"".join(parts)
        if offset != stream.total or place != bases[s + 1] or hashlib.md5(payload.translate(FLIP)).digest() != stream.md5:
            raise ValueError("samples differ from what the stream states")
        out.append((payload, table))
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zero bytes up to a positive multiple of PAD, and the length before."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % PAD if raw else PAD), len(raw)


def features(payload: bytes) -> str:
    """Mean, root mean square and crossings of the middle, from integer sums."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((s[1:] >= 0) != (s[:-1] >= 0)).sum())
    return f"mean={int(s.sum()) / len(s):.4f};rms={(int((s * s).sum()) / len(s)) ** 0.5:.4f};crossings={crossings}"


def media_column(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``media`` (binary), the FLAC stream of each text's padded bytes, and ``n_bytes`` before padding."""

    def make():
        def work(texts):
            made = [padded(t) for t in texts]
            return [encode([p for p, _ in made]), [n for _, n in made]]
        return work

    return map_text(docs, text, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], make, keep)


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media: str = "media") -> DataFrame:
    """(id, sample_offset, n_samples, byte_offset, pcm): one row per frame, null media none.

    ``byte_offset`` is where the frame starts in the stream, ``pcm`` its unsigned samples.
    """
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("sample_offset", T.LongType()),
        T.StructField("n_samples", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i, m in zip(batch.column(0), batch.column(1).to_pylist()):
                if m is None:
                    continue
                payload, table = decode([m])[0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i.as_py()] * len(table), batch.schema.field(0).type), *(pa.array(list(c), pa.int64()) for c in zip(*table)),
                    pa.array([payload[o : o + n] for o, n, _ in table], pa.binary())], names=schema.names)

    return df.select(F.col(quoted(id_col)), F.col(quoted(media))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Write each text as media, read the media back and describe what was read.

    A null text is an empty one, and an empty one is PAD zero bytes. Equal texts give equal
    values, as a stream depends on its own payload only.
    """

    def make():
        def work(texts):
            made = [padded(t) for t in texts]
            media = encode([p for p, _ in made])
            read = [p for p, _ in decode(media)]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return [
                [n for _, n in made], [len(p) for p in read], [sha(p) for p in read], [zlib.crc32(p[-PAD:]) for p in read],
                [len(m) for m in media], [sha(m) for m in media], [features(p) for p in read]]
        return work

    names = ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), \
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())
    return map_text(docs, text, [T.StructField(n, t) for n, t in names], make, keep)


def op9_flac(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
