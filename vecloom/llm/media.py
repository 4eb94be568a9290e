"""AVI motion-JPEG: RIFF indexes, intra frames, shots as timed clips.

Frames are found by the `idx1` index (offsets from the file's or the list's start), by OpenDML `ix..` indexes, or by
walking the `movi` lists. Frames are baseline JPEG. All restart intervals of a batch are Huffman-decoded in step, one
symbol of each at a time, as numpy arrays; `scale=8` keeps one sample of each 8 x 8 block (its mean), `scale=1` gives
all pixels by the inverse DCT. A cut is where two frames' histograms differ by more than the mean of the neighbouring
differences plus a multiple of their deviation; what lies between cuts is a clip.

Bytes are stored losslessly as samples: each is a flat 8 x 8 block of a grey frame of 24 x 24 blocks, whose mean is
the byte. Each row of blocks is a restart interval.

Defined results: null media, and media that are no RIFF AVI file or have a broken frame, give no frames and a message
in `error`; the others of the batch are unharmed. Null texts are empty. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_bytes

SIDE = 24
UNIT = SIDE * SIDE
FPS = 25
BINS = 16
PAD = 255

#: The standard luminance and chrominance Huffman tables (codes of each length from 1 to 16; symbols), for frames without their own.
DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_LUMA = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
AC_CHROMA = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77]),
    bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
)


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: along antidiagonals, turning at the edges."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([r * 8 + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


ZIGZAG = zigzag()


def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    code = at = 0
    for n, count in enumerate(table[0], 1):
        for symbol in table[1][at : at + count]:
            out[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
            code += 1
        at += count
        code <<= 1
    return out


@dataclass
class Header:
    width: int = 0
    height: int = 0
    restart: int = 0
    #: (id, horizontal factor, vertical factor, quantisation table) of each component
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    dc: list[np.ndarray] = field(default_factory=list)
    ac: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    @property
    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def pattern(self) -> np.ndarray:
        """The component of each block of an MCU."""
        return np.array([0]) if len(self.parts) == 1 else np.repeat(np.arange(len(self.parts)), [p[1] * p[2] for p in self.parts])


def read_header(frame: bytes) -> Header:
    """What stands before a frame's entropy-coded data."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("a frame is no JPEG image")
    head, tables = Header(), {(0, 0): DC_LUMA, (0, 1): DC_CHROMA, (1, 0): AC_LUMA, (1, 1): AC_CHROMA}
    at = 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame's segments are broken")
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                head.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xC0 or mark == 0xC1:
            head.height, head.width = struct.unpack_from(">HH", body, 1)
            head.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline frames can be decoded")
        elif mark == 0xDD:
            head.restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if not head.parts or {p[0] for p in head.parts} != set(chosen) or any(p[3] not in head.quant for p in head.parts):
                raise ValueError("a frame's scan does not fit its header")
            head.dc = [lookup(tables[0, chosen[p[0]] >> 4]) for p in head.parts]
            head.ac = [lookup(tables[1, chosen[p[0]] & 15]) for p in head.parts]
            head.size = at
            return head


def _coefficients(head: Header, frames: list[bytes], full: bool) -> np.ndarray:
    """(frame, block in scan order, 64 or 1) quantised coefficients of frames with this same header."""
    across, down = head.grid
    pattern = head.pattern
    mcus = across * down
    per = head.restart or mcus
    scans = [np.frombuffer(f, np.uint8)[head.size :] for f in frames]
    raw = np.concatenate(scans)
    after = np.append(raw[1:], 0)
    is_ff = raw == 0xFF
    restart = is_ff & (after >= 0xD0) & (after <= 0xD7)
    drop = np.zeros(len(raw), bool)
    drop[1:] = is_ff[:-1] & ((raw[1:] == 0) | restart[:-1])
    drop |= restart
    place = np.concatenate(([0], np.cumsum(~drop)))
    data = np.concatenate((raw[~drop], np.zeros(8, np.uint8))).astype(np.int64)
    n_bits = (len(data) - 8) * 8
    five = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]  # the five bytes from each on
    begins = np.concatenate(([0], np.cumsum([len(s) for s in scans])))
    n_int = -(-mcus // per)
    marks = np.flatnonzero(restart)
    if not np.array_equal(np.bincount(np.searchsorted(begins, marks, "right") - 1, minlength=len(frames)), np.full(len(frames), n_int - 1)):
        raise ValueError("a frame's restart marks are broken")
    starts = np.sort(np.concatenate((begins[:-1], marks + 2)))
    bit = place[starts] * 8
    stop = np.append(place[starts[1:]] * 8, n_bits)
    todo = np.tile(np.append(np.full(n_int - 1, per), mcus - per * (n_int - 1)), len(frames)) * len(pattern)
    blocks = per * len(pattern)
    out = np.zeros((len(starts), blocks, 64 if full else 1), np.int16)
    tables = np.concatenate([*head.dc, *head.ac]).astype(np.int32)
    n_parts = len(head.parts)
    before = np.zeros((len(starts), n_parts), np.int64)
    k, done = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    act = np.arange(len(starts))
    low = (np.int64(1) << np.arange(17)) - 1
    half = (np.int64(1) << np.arange(17)) >> 1
    while len(act):
        p, kk = bit[act], k[act]
        part = pattern[done[act] % len(pattern)] if n_parts > 1 else 0
        window = five[np.minimum(p >> 3, len(five) - 1)] >> 8 - (p & 7)  # 32 bits: a code and a value
        is_ac = kk > 0
        got = tables[((part + n_parts * is_ac) << 16) + (window >> 16 & 0xFFFF)]
        length, symbol = got >> 8, got & 0xFF
        if not length.all():
            raise ValueError("a frame's data are broken")
        any_ac = bool(is_ac.any())
        if any_ac and is_ac.all() and not symbol.any():  # ends of blocks only
            bit[act] = p + length
            k[act] = 0
            done[act] += 1
        else:
            size = np.where(is_ac, symbol & 15, symbol) if any_ac else symbol
            value = window >> 32 - length - size & low[size]
            value -= low[size] * (value < half[size])
            bit[act] = p + length + size
            dc = np.flatnonzero(~is_ac) if any_ac else slice(None)
            rows, which = act[dc], part[dc] if n_parts > 1 else 0
            before[rows, which] += value[dc]
            out[rows, done[rows], 0] = before[rows, which]
            if any_ac:
                run = symbol >> 4
                new = np.where(is_ac, kk + np.where(size > 0, run + 1, np.where(run == 15, 16, 64)), 1)
                if full:
                    ac = np.flatnonzero(is_ac & (size > 0))
                    to = kk[ac] + run[ac]
                    if len(to) and to.max() > 63:
                        raise ValueError("a frame's data are broken")
                    out[act[ac], done[act[ac]], ZIGZAG[to]] = value[ac]
                ended = new > 63
                k[act] = np.where(ended, 0, new)
                done[act] += ended
            else:
                k[act] = 1
        if (bit[act] > stop[act]).any():
            raise ValueError("a frame ends too soon")
        left = done[act] < todo[act]
        if not left.all():
            act = act[left]
    if n_int == 1:
        return out
    keep = np.concatenate([np.arange(i * blocks, i * blocks + t) for i, t in enumerate(todo[:n_int])])
    return out.reshape(len(frames), n_int * blocks, -1)[:, keep]


def _cosines() -> np.ndarray:
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)


def decode(frames: list[bytes], scale: int = 8) -> list[list[np.ndarray]]:
    """The components of each frame as samples of 8 bits, at full size or at an eighth of it."""
    heads: dict[bytes, Header] = {}
    of: dict[bytes, list[int]] = {}
    last = b"\0"
    for i, f in enumerate(frames):
        if not f.startswith(last):
            head = read_header(f)
            last = f[: head.size]
            heads.setdefault(last, head)
        of.setdefault(last, []).append(i)
    out: list[list[np.ndarray]] = [[] for _ in frames]
    for key, places in of.items():
        head = heads[key]
        coef = _coefficients(head, [frames[i] for i in places], scale == 1)
        across, down = head.grid
        mcu = coef.reshape(len(places), down, across, len(head.pattern), -1)
        hmax, vmax = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
        at = 0
        for _, h, v, q in head.parts:
            if len(head.parts) == 1:
                h = v = hmax = vmax = 1
            part = mcu[:, :, :, at : at + h * v].reshape(len(places), down, across, v, h, -1).transpose(0, 1, 3, 2, 4, 5).reshape(len(places), down * v, across * h, -1)
            at += h * v
            table = head.quant[q]
            width, height = -(-head.width * h // hmax), -(-head.height * v // vmax)
            if scale == 8:
                pixels = np.clip((part[..., 0].astype(np.int32) * table[0] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
                width, height = -(-width // 8), -(-height // 8)
            else:
                values = np.zeros(64, np.int32)
                values[ZIGZAG] = table
                c = _cosines()
                square = (part * values).reshape(*part.shape[:3], 8, 8).astype(np.float64)
                pixels = np.einsum("xu,nrcuv,yv->nrxcy", c, square, c, optimize=True).reshape(len(places), part.shape[1] * 8, part.shape[2] * 8)
                pixels = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8)
            for i, image in zip(places, pixels[:, :height, :width], strict=True):
                out[i].append(image)
    return out


def _flat_header() -> bytes:
    quant = bytes([8, *[16] * 63])
    seg = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    size = SIDE * 8
    return (
        b"\xff\xd8"
        + seg(0xDB, b"\0" + quant)
        + seg(0xC0, struct.pack(">BHHB", 8, size, size, 1) + bytes([1, 0x11, 0]))
        + seg(0xC4, b"\0" + DC_LUMA[0] + DC_LUMA[1])
        + seg(0xC4, b"\x10" + bytes([1, *[0] * 15]) + b"\0")  # the only AC symbol is the end of a block: one bit
        + seg(0xDD, struct.pack(">H", SIDE))
        + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _flat_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits (left-aligned in 32) and their number for each difference + 255: DC code, value, end of block."""
    look = lookup(DC_LUMA)
    code = {int(x & 0xFF): (int(i) >> 16 - int(x >> 8), int(x >> 8)) for i, x in reversed(list(enumerate(look))) if x}
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        c, length = code[n]
        size[d + 255] = length + n + 1
        bits[d + 255] = (c << n | (d if d >= 0 else d + (1 << n) - 1)) << 1 << 32 - int(size[d + 255])
    return bits, size


_HEADER = _flat_header()
_BITS, _SIZES = _flat_codes()


def flat_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG image for each UNIT samples."""
    rows = samples.reshape(-1, SIDE).astype(np.int64) - 128
    d = np.diff(rows, axis=1, prepend=0) + 255
    size = _SIZES[d]
    end = np.cumsum(size, axis=1)
    n_bytes = -(-end[:, -1] // 8)
    base = np.concatenate(([0], np.cumsum(n_bytes)))
    data = np.zeros(base[-1] + 3, np.uint8)
    start = base[:-1, None] * 8 + end - size
    for j in range(SIDE):  # rows begin at whole bytes, so the samples of one column never share one
        at = start[:, j]
        word = _BITS[d[:, j]] >> (at & 7)
        at = at >> 3
        for k in range(3):
            data[at + k] |= (word >> 24 - 8 * k & 0xFF).astype(np.uint8)
    data = data[: base[-1]]
    fill = n_bytes * 8 - end[:, -1]
    data[base[1:] - 1] |= ((1 << fill) - 1).astype(np.uint8)
    # a zero after each 255, and a restart mark after each interval but a frame's last
    stuffed = data == 255
    extra = np.ones(len(data), np.int64) + stuffed
    rows_in = np.arange(len(rows)) % SIDE
    last = base[1:] - 1
    marked = last[rows_in < SIDE - 1]
    extra[marked] += 2
    to = np.concatenate(([0], np.cumsum(extra)))
    out = np.zeros(to[-1], np.uint8)
    out[to[:-1]] = data
    out[to[marked + 1] - 2] = 0xFF
    out[to[marked + 1] - 1] = 0xD0 + rows_in[rows_in < SIDE - 1] % 8
    flat = out.tobytes()
    cuts = to[base[::SIDE]].tolist()
    return [_HEADER + flat[a:b] + b"\xff\xd9" for a, b in zip(cuts, cuts[1:], strict=False)]


def avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and an idx1 index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    movi = b"movi" + b"".join(chunk(b"00dc", f) for f in frames)
    at, index = 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    body = b"AVI " + head + chunk(b"LIST", movi) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def demux(data: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file, by its index, and the milliseconds of one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI file")
    step, lists, entries, standard = 0.0, [], None, []

    def walk(at: int, end: int) -> None:
        nonlocal step, entries
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            body, stop = at + 8, min(at + 8 + size, end)
            if name in (b"LIST", b"RIFF"):
                kind = data[body : body + 4]
                if kind == b"movi":
                    lists.append((body, stop))
                else:
                    walk(body + 4, stop)
            elif name == b"avih":
                step = step or struct.unpack_from("<I", data, body)[0] / 1000
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                step = 1000 * scale / rate if rate else step
            elif name == b"idx1":
                entries = np.frombuffer(data[body : body + (stop - body) // 16 * 16], np.dtype("S4,<u4,<u4,<u4"))
            elif name == b"indx" and data[body + 3] == 0:
                for i in range(struct.unpack_from("<I", data, body + 4)[0]):
                    standard.append(struct.unpack_from("<Q", data, body + 24 + 16 * i)[0])
            at += 8 + size + size % 2

    walk(0, len(data))
    frames = []
    if standard:
        for at in standard:
            n, base = struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<Q", data, at + 20)[0]
            for i in range(n):
                offset, size = struct.unpack_from("<II", data, at + 32 + 8 * i)
                frames.append(data[base + offset : base + offset + (size & 0x7FFFFFFF)])
    elif entries is not None and len(entries) and lists:
        video = [(int(o), int(n)) for name, _, o, n in entries.tolist() if name[2:] in (b"dc", b"db")]
        base = 0
        if video:
            o, n = video[0]
            base = next((b for b in (lists[0][0], 0) if data[b + o + 2 : b + o + 4] in (b"dc", b"db") and struct.unpack_from("<I", data, b + o + 4)[0] == n), None)
            if base is None:
                raise ValueError("the index does not fit the frames")
        frames = [data[base + o + 8 : base + o + 8 + n] for o, n in video]
    else:
        for at, end in lists:
            at += 4
            while at + 8 <= end:
                name, size = struct.unpack_from("<4sI", data, at)
                if name == b"LIST":
                    at += 12
                    continue
                if name[2:] in (b"dc", b"db"):
                    frames.append(data[at + 8 : at + 8 + size])
                at += 8 + size + size % 2
    return [f for f in frames if f], step


def shots(difference: np.ndarray, reach: int = 8, factor: float = 3.0, least: float = 0.2) -> np.ndarray:
    """First frames of the shots; difference[t]: of frame t + 1 from frame t."""
    n = len(difference)
    if n == 0:
        return np.zeros(1, np.int64)
    sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (difference, difference**2))
    a, b = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    others = np.maximum(b - a - 1, 1)
    mean = (sums[b] - sums[a] - difference) / others
    spread = np.sqrt(np.maximum((squares[b] - squares[a] - difference**2) / others - mean**2, 0))
    return np.concatenate(([0], np.flatnonzero(difference > np.maximum(least, mean + factor * spread)) + 1))


def store(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, media: each text's bytes, filled with PAD up to a positive multiple of UNIT, as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                data, off = text_bytes(part.column(text_col))
                n = np.diff(off)
                units = np.maximum(-(-n // UNIT), 1)
                first = np.concatenate(([0], np.cumsum(units)))
                samples = np.full(first[-1] * UNIT, PAD, np.uint8)
                samples[np.arange(off[-1]) + np.repeat(first[:-1] * UNIT - off[:-1], n)] = data
                frames = flat_frames(samples)
                media = [avi(frames[a:b], SIDE * 8, SIDE * 8) for a, b in zip(first, first[1:], strict=False)]
                yield pa.record_batch([part.column(id_col), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


CLIPS = "array<struct<first:int,frames:int,start_ms:double,end_ms:double,level:double>>"
_CLIP = pa.list_(pa.struct([("first", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("level", pa.float64())]))


def _look(media: list[bytes | None]) -> list[tuple[bytes | None, list[dict], str | None]]:
    """(samples at an eighth of the size, clips, error) of each file."""
    out: list = [(None, [], "no media")] * len(media)
    frames, spans, steps = [], [], []
    for i, m in enumerate(media):
        if m is None:
            continue
        try:
            mine, step = demux(m)
            spans.append((i, len(frames), len(frames) + len(mine)))
            steps.append(step)
            frames += mine
        except (ValueError, struct.error) as e:
            out[i] = (None, [], str(e))
    try:
        luma = [f[0] for f in decode(frames)]
    except (ValueError, IndexError):
        if len(spans) == 1:
            out[spans[0][0]] = (None, [], "a frame cannot be decoded")
            return out
        for i, _, _ in spans:
            out[i] = _look([media[i]])[0]
        return out
    if not frames:
        return [(b"", [], None) if m is not None and o[2] == "no media" else o for m, o in zip(media, out, strict=True)]
    sizes = np.array([f.size for f in luma])
    flat = np.concatenate([f.ravel() for f in luma])
    own = np.repeat(np.arange(len(luma)), sizes)
    levels = (flat >> 4).astype(np.int64)
    hist = np.bincount(own * BINS + levels, minlength=len(luma) * BINS).reshape(-1, BINS) / sizes[:, None]
    mean = np.bincount(own, flat, len(luma)) / sizes
    change = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    at = np.concatenate(([0], np.cumsum(sizes)))
    samples = flat.tobytes()
    for (i, a, b), step in zip(spans, steps, strict=True):
        clips = []
        if b > a:
            first = shots(change[a : b - 1]).tolist()
            for s, e in zip(first, [*first[1:], b - a], strict=True):
                clips.append({"first": s, "frames": e - s, "start_ms": s * step, "end_ms": e * step, "level": round(float(mean[a + s : a + e].mean()), 6)})
        out[i] = (samples[at[a] : at[b]], clips, None)
    return out


def look(stored: DataFrame, id_cols: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media") -> DataFrame:
    """The id columns, media, samples (read back, at an eighth of the size), clips, error."""
    width = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col):
                media = part.column(media_col)
                samples, clips, error = zip(*_look(media.to_pylist()), strict=True)
                yield pa.record_batch([*part.columns[:width], media, pa.array(samples, pa.binary()), pa.array(clips, _CLIP), pa.array(error, pa.string())], names=[*id_cols, "media", "samples", "clips", "error"])

    kinds = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in id_cols)
    return stored.select(*id_cols, media_col).mapInArrow(run, f"{kinds}, media binary, samples binary, clips {CLIPS}, error string")


def clips(looked: DataFrame, *id_cols: str) -> DataFrame:
    """One row a clip: the id columns, first (frame), frames, start_ms, end_ms, level."""
    return looked.selectExpr(*id_cols, "inline(clips)")
