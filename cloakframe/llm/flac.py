"""FLAC for bytes as 8-bit mono samples, in numpy over many frames at once.

Frames hold BLOCK samples (the last may be shorter). The encoder chooses between constant,
verbatim, fixed and linear predictors by the coded size; residuals are Rice codes. The decoder reads
Rice residuals of both parameter widths, partitions, escapes, fixed and linear predictors, checks the
CRC-8 of every frame header, the CRC-16 of every frame and the MD5 of the whole, and finds a sample
through the seek table. A step decodes one residual of every frame of a group together.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 576
RATE = 8000
#: Frames that are coded together; bounds memory for a long text.
GROUP = 4096
#: Quantised coefficients are signed numbers of so many bits, scaled by two to the SHIFT.
PRECISION, SHIFT = 12, 9
LINEAR_ORDER = 2
#: Frames between two points of the seek table.
SEEK_EVERY = 4


class FlacError(ValueError):
    """The bytes aren't a stream that this decoder accepts, or a checksum differs."""


def _table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if width == 16 else np.uint8)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span, a byte of every span at each step."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left = starts[order], length[order]
    crc = np.zeros(len(order), np.uint16)
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, side="left"))
        c = crc[:n]
        crc[:n] = CRC16[(c >> np.uint16(8)).astype(np.uint8) ^ data[at[:n] + i]] ^ (c << np.uint16(8))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    out = [(0xFF << (7 - more) & 0xFF) | n >> (6 * more)]
    out += [0x80 | n >> (6 * k) & 0x3F for k in range(more - 1, -1, -1)]
    return bytes(out)


def read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    more = 0
    while more < 7 and first << more & 0x80:
        more += 1
    if more == 0:
        return first, at + 1
    if more == 1 or more == 8:
        raise FlacError("bad frame number")
    value = first & (0x3F >> (more - 1))
    for b in data[at + 1 : at + more]:
        value = value << 6 | b & 0x3F
    return value, at + more


_HEADERS: dict[tuple[int, int], bytes] = {}


def frame_header(number: int, size: int) -> bytes:
    found = _HEADERS.get((number, size))
    if found is None:
        # Fixed blocks, 8 kHz, mono, 8 bits; code 2 is a block of 576, 7 a size of 16 bits at the end.
        head = bytes([0xFF, 0xF8, (0x20 if size == 576 else 0x70) | 4, 0x02]) + coded_number(number)
        if size != 576:
            head += (size - 1).to_bytes(2, "big")
        found = head + bytes([crc8(head)])
        if len(_HEADERS) < 1 << 14:
            _HEADERS[number, size] = found
    return found


def fixed_residual(x: np.ndarray, order: int) -> np.ndarray:
    """Differences of the given order along rows, without the warm-up samples."""
    return np.diff(x, n=order, axis=1)


def linear_coefficients(x: np.ndarray) -> np.ndarray:
    """Quantised predictors of order two, by the normal equations of each row."""
    f = x.astype(np.float32)
    r0, r1, r2 = ((f[:, : f.shape[1] - k] * f[:, k:]).sum(axis=1, dtype=np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    det = np.where(det > 1e-6 * np.maximum(r0 * r0, 1), det, np.inf)
    a = np.stack([(r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], axis=1)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top).astype(np.int32)


def linear_residual(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    guess = (x[:, 1:-1] * q[:, :1] + x[:, :-2] * q[:, 1:]) >> SHIFT
    return x[:, 2:] - guess


def rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded values, best parameter, coded bits) of each row."""
    folded = ((residual << 1) ^ (residual >> 31)).astype(np.uint32)
    n = folded.shape[1]
    mean = folded.sum(axis=1, dtype=np.int64) / max(n, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 13).astype(np.uint32)
    best, bits = guess, None
    for k in (guess, np.minimum(guess + np.uint32(1), 14)):
        size = (folded >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (k.astype(np.int64) + 1)
        if bits is None:
            bits = size
        else:
            best = np.where(size < bits, k, best)
            bits = np.minimum(size, bits)
    return folded, best, bits


def encode_frames(x: np.ndarray, first: list[int]) -> list[bytes]:
    """Frames of the rows of x (int32 samples of one length), numbered as given."""
    m, size = x.shape
    linear = linear_coefficients(x) if size > 2 else np.zeros((m, 2), np.int32)
    options = [("fixed", o, rice(fixed_residual(x, o))) for o in range(min(2, size))]
    if size > LINEAR_ORDER:
        options.append(("linear", LINEAR_ORDER, rice(linear_residual(x, linear))))
    cost = np.stack([8 * o + r[2] + 10 + (9 + 2 * PRECISION) * (kind == "linear") for kind, o, r in options] + [np.full(m, 8 * size)])
    choice = cost.argmin(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    out: list[bytes] = [b""] * m
    for i in np.flatnonzero(constant):
        out[i] = frame_header(first[i], size) + bytes([0, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(~constant & (choice == len(options))):
        out[i] = frame_header(first[i], size) + b"\x02" + x[i].astype(np.int8).tobytes()
    for c, (kind, order, (folded, k, bits)) in enumerate(options):
        rows = np.flatnonzero(~constant & (choice == c))
        if len(rows):
            for i, frame in zip(rows, _subframes(x[rows], kind, order, folded[rows], k[rows], bits[rows], linear[rows], [first[i] for i in rows]), strict=True):
                out[i] = frame
    data = np.frombuffer(b"".join(out), np.uint8)
    ends = np.cumsum([len(f) for f in out])
    crc = crc16(data, np.concatenate([[0], ends[:-1]]), ends)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(out, crc, strict=True)]


def _subframes(x, kind, order, folded, k, bits, linear, numbers) -> list[bytes]:  # noqa: ANN001
    """Frame headers and predicted subframes of rows with one kind and order."""
    heads = []
    for i, number in enumerate(numbers):
        fields = [((32 | order - 1) if kind == "linear" else (8 | order), 7), (0, 1)]
        fields += [(int(v) & 0xFF, 8) for v in x[i, :order]]
        if kind == "linear":
            fields += [(PRECISION - 1, 4), (SHIFT, 5)] + [(int(v) & ((1 << PRECISION) - 1), PRECISION) for v in linear[i]]
        fields += [(0, 2), (0, 4), (int(k[i]), 4)]
        value, width = 0, 0
        for v, w in fields:
            value, width = value << w | v, width + w
        heads.append((frame_header(number, x.shape[1]), value, width))
    width = heads[0][2]
    start = np.array([8 * len(h[0]) for h in heads]) + width
    total = (start + bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(total)])
    ones = np.zeros(8 * int(base[-1]), np.uint8)
    q = folded >> k[:, None]
    stop = np.cumsum(q.astype(np.int64) + 1 + k[:, None], axis=1) + (8 * base[:-1] + start)[:, None] - 1 - k[:, None]
    ones[stop.ravel()] = 1
    for j in range(int(k.max()) if len(k) else 0):
        rows = np.flatnonzero(k > j)
        ones[(stop[rows] + (k[rows, None] - j)).ravel()] = (folded[rows] >> np.uint32(j) & np.uint32(1)).ravel()
    packed = np.packbits(ones)
    out = []
    for i, (head, value, _) in enumerate(heads):
        front = value.to_bytes((width + 7) // 8, "big") if width % 8 == 0 else (value << (8 - width % 8)).to_bytes((width + 7) // 8, "big")
        body = bytearray(packed[base[i] : base[i + 1]].tobytes())
        body[: len(head)] = head
        for j, b in enumerate(front):
            body[len(head) + j] |= b
        out.append(bytes(body))
    return out


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A stream of each payload, whose bytes are samples (less 128)."""
    streams: list[list[bytes]] = [[] for _ in payloads]
    todo: dict[int, list[tuple[int, int, int]]] = {}
    for p, payload in enumerate(payloads):
        n = -(-len(payload) // block)
        streams[p] = [b""] * n
        for i in range(n):
            todo.setdefault(min(block, len(payload) - i * block), []).append((p, i, i * block))
    arrays = [np.frombuffer(p, np.uint8) for p in payloads]
    for size, frames in todo.items():
        for at in range(0, len(frames), GROUP):
            part = frames[at : at + GROUP]
            x = np.stack([arrays[p][s : s + size] for p, _, s in part]).astype(np.int32) - 128
            for (p, i, _), frame in zip(part, encode_frames(x, [i for _, i, _ in part]), strict=True):
                streams[p][i] = frame
    return [stream_head(payload, frames, block) + b"".join(frames) for payload, frames in zip(payloads, streams, strict=True)]


def stream_head(payload: bytes, frames: list[bytes], block: int) -> bytes:
    sizes = [len(f) for f in frames]
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = block.to_bytes(2, "big") * 2 + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    seek = b"".join((i * block).to_bytes(8, "big") + offsets[i].to_bytes(8, "big") + min(block, len(payload) - i * block).to_bytes(2, "big") for i in range(0, len(frames), SEEK_EVERY))
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek


# --- reading -----------------------------------------------------------------------------------


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int]], int]:
    """(stream info, seek points (sample, byte), where the frames begin)."""
    if stream[:4] != b"fLaC":
        raise FlacError("not FLAC")
    at, last, info, seek = 4, False, None, []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
    if info is None or info["channels"] != 1 or info["bits"] != 8:
        raise FlacError("only 8-bit mono")
    return info, seek, at


class Bits:
    """Positions in one buffer of many frames, read side by side."""

    def __init__(self, data: np.ndarray) -> None:
        wide = np.zeros(len(data) + 8, np.uint64)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        for j in range(5):
            wide = wide << np.uint64(8) | padded[j : j + len(wide)]
        self.words = wide  # 40 bits from each byte

    def take(self, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Up to 32 bits from each position, unsigned."""
        word = self.words[at >> 3] << ((at & 7).astype(np.uint64) + np.uint64(24))
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, word >> (np.uint64(64) - np.maximum(width, np.uint64(1))), 0).astype(np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.take(at, width)
        return v - ((v >> (width - 1)) << width)


_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.uint8)


def residuals(bits: Bits, at: np.ndarray, size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (size - order, frames) of frames whose coding starts at bit `at`; and their ends."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    at = at + 6
    wide = np.where(method == 1, 5, 4)
    per = size >> parts
    m = len(at)
    out = np.zeros((size - order, m), np.int32)
    k, escape, raw = np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(m, np.int64)
    left = np.zeros(m, np.int64)
    started = np.zeros(m, bool)
    simple = bool((parts == 0).all())
    for i in range(size - order):
        new = np.flatnonzero(left == 0) if not simple or i == 0 else ()
        if len(new):
            while True:
                k[new] = bits.take(at[new], wide[new])
                at[new] += wide[new]
                escape[new] = k[new] == (1 << wide[new]) - 1
                esc = new[escape[new]]
                raw[esc] = bits.take(at[esc], 5)
                at[esc] += 5
                left[new] = per[new] - np.where(started[new], 0, order)
                started[new] = True
                new = new[left[new] == 0]
                if not len(new):
                    break
            coded_all = not escape.any()
            shift = (64 - np.maximum(k, 1)).astype(np.uint64)
            some = k > 0
            every = bool(some.all())
        window = bits.words[at >> 3] << ((at & 7).astype(np.uint64) + np.uint64(24))
        q = _ZEROS[window >> np.uint64(48)].astype(np.int64)
        far = np.flatnonzero(q == 16)
        if len(far) and not coded_all:
            far = far[~escape[far]]
        while len(far):
            if (at[far] + q[far] >= 8 * (len(bits.words) - 8)).any():
                raise FlacError("run of zeros past the end")
            more = _ZEROS[bits.take(at[far] + q[far], 16)].astype(np.int64)
            q[far] += more
            far = far[more == 16]
        stop = at + q + 1
        low = (bits.words[stop >> 3] << ((stop & 7).astype(np.uint64) + np.uint64(24))) >> shift
        low = low.astype(np.int64) if every else np.where(some, low, 0).astype(np.int64)
        value = q << k | low
        value = value >> 1 ^ -(value & 1)
        end = stop + k
        if not coded_all:
            width = np.where(escape, raw, 0)
            v = bits.take(at, width)
            v = np.where(width > 0, v - ((v >> np.maximum(width - 1, 0)) << width), 0)
            value, end = np.where(escape, v, value), np.where(escape, at + raw, end)
        out[i] = value
        at = end
        if not simple:
            left -= 1
    return out, at


def decode_frames(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, size) of frames of one size whose subframes begin at byte `starts`; and
    the byte after each one's samples."""
    bits = Bits(data)
    kind = data[starts] >> 1 & 0x3F
    if (data[starts] & 0x81).any():
        raise FlacError("wasted bits aren't supported")
    x = np.zeros((len(starts), size), np.int32)
    end = np.zeros(len(starts), np.int64)
    for t in np.unique(kind):
        rows = np.flatnonzero(kind == t)
        at = 8 * (starts[rows].astype(np.int64) + 1)
        if t == 0:
            x[rows] = bits.signed(at, 8)[:, None]
            at = at + 8
        elif t == 1:
            x[rows] = data[(at >> 3)[:, None] + np.arange(size)].view(np.int8)
            at = at + 8 * size
        elif 8 <= t <= 12 or t >= 32:
            order = int(t - 8 if t <= 12 else t - 31)
            warm = np.stack([bits.signed(at + 8 * j, 8) for j in range(order)], axis=0) if order else np.zeros((0, len(rows)), np.int64)
            at = at + 8 * order
            if t >= 32:
                precision, shift = bits.take(at, 4) + 1, bits.signed(at + 4, 5)
                if (precision > 15).any() or (shift < 0).any():
                    raise FlacError("invalid predictor")
                at = at + 9 + precision * order
                # Coefficients of frames with one width are read together.
                q = np.zeros((order, len(rows)), np.int64)
                for p in np.unique(precision).tolist():
                    own = np.flatnonzero(precision == p)
                    q[:, own] = np.stack([bits.signed(at[own] + p * (j - order), p) for j in range(order)])
                r, at = residuals(bits, at, size, order)
                y = np.concatenate([warm, r]).astype(np.int64)
                for i in range(order, size):
                    y[i] += (q * y[i - order : i][::-1]).sum(axis=0) >> shift
                x[rows] = y.T
            else:
                r, at = residuals(bits, at, size, order)
                y = r
                # Undo the differences from the highest down; each starts at the warm-up's difference.
                for o in range(order - 1, -1, -1):
                    first = np.diff(warm, n=o, axis=0)[:1]
                    y = np.cumsum(np.concatenate([first, y]), axis=0)
                x[rows] = y.T
        else:
            raise FlacError("reserved subframe type")
        end[rows] = (at + 7) >> 3
    return x, end


def frame_at(stream: bytes, at: int) -> tuple[int, int, int]:
    """(number, samples, where the subframe begins) of the frame at byte `at`; checks the CRC-8."""
    if stream[at] != 0xFF or stream[at + 1] != 0xF8 or stream[at + 3] != 0x02:
        raise FlacError("no frame of fixed 8-bit mono blocks here")
    code = stream[at + 2] >> 4
    number, end = read_number(stream, at + 4)
    if code == 6:
        size, end = stream[end] + 1, end + 1
    elif code == 7:
        size, end = int.from_bytes(stream[end : end + 2], "big") + 1, end + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0
    rate = stream[at + 2] & 15
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or crc8(stream[at:end]) != stream[end]:
        raise FlacError("frame header's checksum differs")
    return number, size, end + 1


def frame_starts(stream: bytes, at: int) -> list[tuple[int, int, int, int]]:
    """(number, samples, byte, subframe's byte) of plausible frames from `at` on: sync code with a good CRC-8.

    A residual may look like a header; decode() then follows the frames from end to end."""
    out = []
    while (at := stream.find(b"\xff\xf8", at)) >= 0:
        try:
            number, size, body = frame_at(stream, at)
            out.append((number, size, at, body))
        except (FlacError, IndexError):
            pass
        at += 1
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; every checksum is verified."""
    try:
        return _decode(streams, False)
    except FlacError:  # residuals that look like a frame's header, or a damaged stream: then this fails too
        return _decode(streams, True)


def _decode(streams: list[bytes], chained: bool) -> list[bytes]:
    out: list[bytes] = []
    infos, frames = [], []
    for s, stream in enumerate(streams):
        info, _, at = metadata(stream)
        infos.append(info)
        found = frame_starts(stream, at)
        if chained or any(f[0] != i for i, f in enumerate(found)):
            found = _chained(stream, at, found)
        for number, size, begin, body in found:
            frames.append((s, number, size, begin, body))
        frames.append((s, -1, 0, len(stream), 0))
        out.append(b"")
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    data = np.frombuffer(b"".join(streams), np.uint8)
    begin = np.array([base[f[0]] + f[3] for f in frames], np.int64)
    stop = np.concatenate([begin[1:], [len(data)]])
    real = np.array([f[1] >= 0 for f in frames], bool)
    sizes, bodies = np.array([f[2] for f in frames]), np.array([base[f[0]] + f[4] for f in frames], np.int64)
    owner = np.array([f[0] for f in frames])
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    samples: dict[int, np.ndarray] = {}
    for size in np.unique(sizes[real]):
        own = np.flatnonzero(real & (sizes == size))
        for at in range(0, len(own), GROUP):
            rows = own[at : at + GROUP]
            low, high = int(begin[rows[0]]), int(stop[rows[-1]])
            crc = crc16(data, begin[rows], stop[rows] - 2)
            if (crc != (data[stop[rows] - 2].astype(np.uint16) << np.uint16(8) | data[stop[rows] - 1])).any():
                raise FlacError("frame's checksum differs")
            x, end = decode_frames(data[low:high], bodies[rows] - low, int(size))
            if (end + low != stop[rows] - 2).any():
                raise FlacError("frame's length differs")
            for i, row in enumerate(rows):
                samples[int(row)] = x[i].astype(np.int8).view(np.uint8)
    for i in np.flatnonzero(real):
        parts[owner[i]].append(samples[int(i)])
    for s, info in enumerate(infos):
        raw = np.concatenate(parts[s]) if parts[s] else np.zeros(0, np.uint8)
        if len(raw) != info["samples"] or hashlib.md5(raw.tobytes()).digest() != info["md5"]:
            raise FlacError("samples differ from the stream's digest")
        out[s] = (raw ^ 0x80).tobytes()
    return out


def _chained(stream: bytes, at: int, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The candidates that follow each other end to end from byte `at` on, decoded one by one."""
    at_byte = {f[2]: f for f in found}
    data, out = np.frombuffer(stream, np.uint8), []
    while at < len(stream):
        if at not in at_byte:
            raise FlacError("no frame where one must begin")
        number, size, begin, body = at_byte[at]
        _, end = decode_frames(data[begin:], np.array([body - begin]), size)
        out.append(at_byte[at])
        at = begin + int(end[0]) + 2
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Payload bytes [start, start + count) from the seek point before them, without the rest."""
    info, seek, first = metadata(stream)
    near = max((p for p in seek if p[0] <= start), default=(0, 0))
    at, sample, base, got = first + near[1], near[0], start, []
    data = np.frombuffer(stream, np.uint8)
    while sample < min(start + count, info["samples"]):
        _, size, body = frame_at(stream, at)
        x, end = decode_frames(data[at:], np.array([body - at]), size)
        stop = at + int(end[0])
        if int(crc16(data, np.array([at]), np.array([stop]))[0]) != int.from_bytes(stream[stop : stop + 2], "big"):
            raise FlacError("frame's checksum differs")
        if sample + size > start:
            base = base if got else sample
            got.append(x[0])
        sample, at = sample + size, stop + 2
    raw = np.concatenate(got).astype(np.int8).view(np.uint8) ^ 0x80 if got else np.zeros(0, np.uint8)
    return raw[start - base :][:count].tobytes()
